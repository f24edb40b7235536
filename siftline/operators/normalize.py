"""Nested source records to documents and units, one DataFrame for each kind of record."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _NFC, ZERO_WIDTH, _html_text, bn_to_ascii_digits, clean_unicode, html_to_text, normalize_section_number, normalize_whitespace, parse_year

# Fixed value: titles that mark a record as a trial entry.
EXCLUDED = r"(?i)^\s*test\b"

_NOTE = "struct<id:bigint,number:string,heading:string,content:string,note:string"
SUBSCHEDULE = f"array<{_NOTE}>>"
SCHEDULE = f"array<{_NOTE},subschedules:{SUBSCHEDULE}>>"
EBOOK = f"id bigint, title_of_act string, ebooks_type string, act_year string, number string, publication_date string, publication_by string, created_date string, file string, merged_file string, system_generated_pdf string, schedules string, branch string, meta_keywords array<string>, multiple_reference_link array<string>, sections array<{_NOTE},subsections:array<{_NOTE},schedules:{SCHEDULE}>>,schedules:{SCHEDULE}>>"
QNA = "id bigint, question string, answer string, category string, keyword string"
BLOG = "id bigint, title_name string, author string, content string, created_date string"
FORUM = "id string, name string, description string, badge string, topics array<struct<id:string,title:string,description:string,status:string,created_date:string>>"
# Who publishes law, who writes officially, and what a document without a type is called.
GAZETTE, OFFICIAL, DOCUMENT, NUMBER = "গেজেট", ("ভূমি মন্ত্রণালয়",), "দলিল", "নং"
TITLE_CHARS = 120
#: What is left of a text without markup when it is clean.
_SAYS = f"[^ \u00a0\u3000\t\r\f\v\n{ZERO_WIDTH}]"
#: Markup, entities, and spaces that only html_to_text strips; beyond Latin also what NFC may change.
_MARKS, _BEYOND, _CHANGES = "[<&\x1c-\x1f\x85]", "[^\\x00-\u02ff]", f"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f]|{_NFC}"


def clean(c: Column) -> Column:
    """Cleaned text, null if nothing is left."""
    return F.nullif(normalize_whitespace(clean_unicode(c)), F.lit(""))


def flexible_date(c: Column) -> Column:
    """Y-M-D, or D-M-Y with any of - / . between, at the beginning, in either digit set; null where that is no date."""
    s = F.trim(bn_to_ascii_digits(c))
    part = lambda y, m, d, p: F.concat_ws("-", F.regexp_extract(s, p, y), F.lpad(F.regexp_extract(s, p, m), 2, "0"), F.lpad(F.regexp_extract(s, p, d), 2, "0"))
    ymd, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
    pick = F.when(s.rlike(ymd), part(1, 2, 3, ymd)).when(s.rlike(dmy), part(3, 2, 1, dmy))
    return F.try_to_timestamp(pick, F.lit("yyyy-MM-dd")).cast("date")


def iso_datetime(c: Column) -> Column:
    """An ISO date and time as a timestamp, Z and offsets read; null where it is none."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(c)))


def urls(c: Column) -> Column:
    """The http and https addresses of a list, trimmed; a null list is empty."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda u: F.trim(u)), lambda u: u.rlike("^https?://"))


def from_template(template: str, **fields: Column) -> Column:
    """The template with its {names} filled in; null for the empty template."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out if template else F.lit(None).cast("string")


def excluded(title: Column, pattern: str = EXCLUDED) -> Column:
    """Whether a title marks a trial entry; the empty pattern marks none."""
    return F.coalesce(title.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def errors(**required: Column) -> Column:
    """Messages for required fields that are null or blank, at most five, joined."""
    found = F.filter(F.array(*(F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(f"{k}: required")) for k, c in required.items())), lambda e: e.isNotNull())
    return F.nullif(F.array_join(F.slice(found, 1, 5), "; "), F.lit(""))


def qna(records: DataFrame, exclude: str = EXCLUDED) -> DataFrame:
    """A document for each question; those that ``exclude`` marks as trial entries are left out."""
    body = F.concat(F.lit("প্রশ্ন: "), clean(F.col("question")), F.lit("\nউত্তর: "), clean(html_to_text("answer")))
    return records.where(~excluded(F.col("question"), exclude)).select(F.lit("qna").alias("source_type"), F.col("id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("parent_source_id"), clean(F.col("question")).alias("title"), F.nullif(F.lower(F.trim("category")), F.lit("")).alias("category"), F.lit(None).cast("int").alias("year"), F.lit(70).alias("authority"), body.alias("body"), errors(question=F.col("question"), answer=F.col("answer")).alias("errors"))


def blog(records: DataFrame, official: tuple[str, ...] = OFFICIAL, url: str = "") -> DataFrame:
    created = iso_datetime(F.col("created_date"))
    return records.where(~excluded(F.col("title_name"))).select(F.lit("blog").alias("source_type"), F.col("id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("parent_source_id"), clean(F.col("title_name")).alias("title"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("int").alias("year"), F.when(clean(F.col("author")).isin(*official), 50).otherwise(40).alias("authority"), clean(html_to_text("content")).alias("body"), clean(F.col("author")).alias("author"), created.cast("date").alias("publication_date"), from_template(url, id=F.col("id")).alias("url"), errors(title_name=F.col("title_name")).alias("errors"))


def forum(records: DataFrame) -> DataFrame:
    """A document for each group with a description and for each topic, whose parent the group is (and whose name it carries)."""
    groups = records.where(~excluded(F.col("name")))
    authority = F.when(F.lower("badge").isin("official", "verified"), 30).otherwise(10)
    cols = lambda kind, i, parent, title, body: [F.lit(kind).alias("source_type"), F.col(i).alias("source_id"), parent.alias("parent_source_id"), clean(F.col(title)).alias("title"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("int").alias("year"), authority.alias("authority"), clean(html_to_text(body)).alias("body"), errors(**{title.split(".")[-1]: F.col(title)}).alias("errors")]
    own = groups.where(F.trim(F.coalesce("description", F.lit(""))) != "").select(*cols("forum", "id", F.lit(None).cast("string"), "name", "description"))
    topics = groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"), "badge", F.explode("topics").alias("t")).where(~excluded(F.col("t.title")))
    topics = topics.select(*cols("topic", "t.id", F.col("group_id"), "t.title", "t.description"), clean(F.col("group_name")).alias("group"))
    return own.unionByName(topics, allowMissingColumns=True)


#: Fields of books that records may lack.
MORE = ("sub_branch", "proposal", "objective", "motto", "heading", "footer", "created_at_bn", "created_at_en", "applicable_date_bn", "applicable_date_en", "signature_position", "signature_by")


def book_metadata(r: DataFrame) -> Column:
    """What a book says beside its text, as a struct: dates as written, branch, signature, texts, files, sections.

    Of two fields for the same the English one counts where it says something. Empty texts are null.
    """
    joined = lambda *c: F.nullif(F.concat_ws(", ", *(clean(F.col(x)) for x in c)), F.lit(""))
    text = lambda c: F.nullif(html_to_text(F.coalesce(c, F.lit(""))), F.lit("")).alias(c)
    files = F.map_filter(F.create_map(*(x for c in ("file", "merged_file", "system_generated_pdf") for x in (F.lit(c), F.col(c)))), lambda k, v: F.coalesce(v, F.lit("")) != "")
    raw = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.struct(F.coalesce(clean(F.col("created_at_en")), clean(F.col("created_at_bn"))).alias("issued_date"), F.coalesce(clean(F.col("applicable_date_en")), clean(F.col("applicable_date_bn"))).alias("applicable_date"), joined("branch", "sub_branch").alias("branch"), joined("signature_by", "signature_position").alias("signature"), raw("act_year").alias("act_year_raw"), raw("publication_date").alias("publication_date_raw"), clean(F.col("publication_by")).alias("publication_by"), text("proposal"), text("objective"), text("motto"), text("heading"), files.alias("files"), F.size(F.coalesce("sections", F.array())).alias("section_count"))


def ebook(records: DataFrame, url: str = "") -> tuple[DataFrame, DataFrame]:
    """(documents, units): units carry their path (section, subsection, schedule ids) and stand in reading order.

    A document without a title has one of its type and number, else of its text's first line, else of its type and id
    (title_derived). A unit without text stays only if something under it stays; a schedule also if it has a heading.
    Null lists are empty. body is the text beside the sections: an appendix to them, or all there is (role).
    """
    kept = records.where(~excluded(F.col("title_of_act")))
    kept = kept.withColumns({c: F.lit(None).cast("string") for c in MORE if c not in kept.columns})
    kind, number, body = clean(F.col("ebooks_type")), clean(F.col("number")), F.col("_body")
    kept = kept.withColumn("_body", clean(html_to_text("schedules")))
    line = F.substring_index(body, "\n", 1)
    line = F.concat(F.substring(line, 1, TITLE_CHARS), F.when(F.length(line) > TITLE_CHARS, "…").otherwise(""))
    derived = F.coalesce(F.concat(kind, F.lit(f" ({NUMBER} "), number, F.lit(")")), line, F.concat(F.coalesce(kind, F.lit(DOCUMENT)), F.lit(" #"), F.col("id").cast("string")))
    own = clean(F.col("title_of_act"))
    docs = kept.select(F.lit("ebook").alias("source_type"), F.col("id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("parent_source_id"), F.coalesce(own, derived).alias("title"), own.isNull().alias("title_derived"), kind.alias("doc_type"), F.lower(F.trim("branch")).alias("category"), parse_year(F.col("act_year")).alias("year"), number.alias("act_number"), flexible_date(F.col("publication_date")).alias("publication_date"), F.when(F.trim("publication_by") == GAZETTE, 100).otherwise(90).alias("authority"), iso_datetime(F.col("created_date")).alias("source_updated_at"), from_template(url, id=F.col("id")).alias("url"), F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("file", "merged_file", "system_generated_pdf"))).alias("file_url"), F.filter(F.transform(F.coalesce("meta_keywords", F.array().cast("array<string>")), normalize_whitespace), lambda k: ~k.isin("", "[]")).alias("keywords"), urls(F.col("multiple_reference_link")).alias("links"), body.alias("body"), F.when(F.size(F.coalesce("sections", F.array())) > 0, "appendix").otherwise("body").alias("role"), book_metadata(kept).alias("metadata"), F.lit(None).cast("string").alias("errors"))

    # all units of a record come out of one pass over it: its texts are never shuffled, nor read again for each kind
    rows = kept.where("id is not null").select(F.col("id").cast("string").alias("source_id"), _units(F.col("sections")).alias("_all"))
    rows = rows.withColumn("_odd", F.transform("_all", lambda u: F.when(_odd(u["content"]), u["content"])))
    says = F.zip_with("_all", "_odd", lambda u, odd: (odd.isNull() & _left(u["content"])) | (u["kind"].isin("schedule", "subschedule") & _left(u["heading"])))
    rows = rows.withColumn("_held", _held(F.col("_odd"), F.transform("_all", lambda u: F.size(u["path"])), says))
    whole = F.zip_with("_all", "_held", lambda u, h: F.struct(u.alias("u"), h["text"].alias("text"), h["held"].alias("held")))
    u = rows.select("source_id", F.explode(F.filter(whole, lambda x: x["held"])).alias("_x")).select("source_id", "_x.u.*", "_x.text")
    return docs, u.select("source_id", "path", "kind", "unit_id", normalize_section_number(F.col("number")).alias("number"), clean(F.col("heading")).alias("heading"), clean(F.coalesce("text", "content")).alias("content"), clean(F.col("note")).alias("note"))


_UNITS = "array<struct<path:array<int>,kind:string,unit_id:string,number:string,heading:string,content:string,note:string>>"
#: A section's own schedules stand after its subsections.
AFTER = 1_000_000


def _units(sections: Column) -> Column:
    """All units of a record's sections in reading order, as written; null lists are empty."""

    def many(items: Column, f: Callable[[Column, Column], Column]) -> Column:
        return F.coalesce(F.flatten(F.transform(items, lambda x, i: f(x, i))), F.array().cast(_UNITS))

    def one(kind: str, x: Column, *path: Column) -> Column:
        return F.array(F.struct(F.array(*path).alias("path"), F.lit(kind).alias("kind"), x["id"].cast("string").alias("unit_id"), *(x[c].alias(c) for c in ("number", "heading", "content", "note")))).cast(_UNITS)

    def schedules(items: Column, after: int, *path: Column) -> Column:
        under = lambda w, *at: many(w["subschedules"], lambda x, m: one("subschedule", x, *at, m))
        return many(items, lambda w, k: F.concat(one("schedule", w, *path, k + after), under(w, *path, k + after)))

    subsections = lambda s, i: many(s["subsections"], lambda u, j: F.concat(one("subsection", u, i, j), schedules(u["schedules"], 0, i, j)))
    return many(sections, lambda s, i: F.concat(one("section", s, i), subsections(s, i), schedules(s["schedules"], AFTER, i)))


def _odd(c: Column) -> Column:
    """Whether html_to_text may make another text of this than clean() does alone. The slow pattern runs where it can match."""
    return c.rlike(_MARKS) | (c.rlike(_BEYOND) & c.rlike(_CHANGES))


def _left(c: Column) -> Column:
    """Whether a text without markup has anything left when it is clean."""
    return F.coalesce(c.rlike(_SAYS), F.lit(False))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("held", T.BooleanType())])))
def _held(odd: pa.Array, depths: pa.Array, says: pa.Array) -> pa.Array:
    """For each unit of records in reading order: the text of its markup, where its content is odd, and whether it says
    something or holds one that does."""
    texts = [x and _html_text(x) for x in odd.flatten().to_pylist()]
    out, parent = [], 0
    # backwards, where parent is how deep the next unit is that a held one stands in
    for text, depth, own in zip(reversed(texts), reversed(depths.flatten().to_pylist()), reversed(says.flatten().to_pylist())):
        if held := own or bool(text) or depth == parent:
            parent = depth - 1
        out.append(held)
    values = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(out[::-1], pa.bool_())], ["text", "held"])
    return pa.ListArray.from_arrays(pc.subtract(odd.offsets, odd.offsets[0]), values)


def normalize(records: dict[str, DataFrame]) -> DataFrame:
    """Documents of all kinds of records under the same columns; an unknown kind is an error."""
    make = {"ebook": lambda r: ebook(r)[0], "qna_type1": qna, "qna_type2": qna, "blog": blog, "forum": forum}
    if unknown := set(records) - set(make):
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    out = None
    for kind, rows in records.items():
        docs = make[kind](rows)
        docs = docs.withColumn("source_type", F.lit(kind)) if kind.startswith("qna") else docs
        out = docs if out is None else out.unionByName(docs, allowMissingColumns=True)
    return out
