"""From ranked passages to an answer: evidence gate, context budget, expansion, citations, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_to_bn_digits, bn_to_ascii_digits, clean_unicode

VECTOR_FLOOR, RERANK_FLOOR, COVERAGE_FLOOR = 0.50, 0.05, 0.6
CONTEXT_CHARS = 12_000


def evidence_gate(hits: DataFrame) -> DataFrame:
    """Per query whether its passages carry an answer. hits: query_id, vector, coverage, rerank, exact.

    Any exact hit passes; else the best rerank score decides where there is one, else the best similarity;
    with no similarity at all the coverage does.
    """
    a = hits.groupBy("query_id").agg(F.bool_or("exact").alias("exact"), F.max("rerank").alias("rerank"), F.max("vector").alias("vector"), F.max("coverage").alias("coverage"))
    ok = F.when(F.col("exact"), True).when(F.col("rerank").isNotNull(), F.col("rerank") >= RERANK_FLOOR).when(F.coalesce("vector", F.lit(0.0)) > 0, F.col("vector") >= VECTOR_FLOOR).otherwise(F.coalesce("coverage", F.lit(0.0)) >= COVERAGE_FLOOR)
    return a.withColumn("sufficient", ok)


def pack_context(passages: DataFrame, group: str, order: list[Column], size: Column, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Passages in order until the budget is full; the first always stays. Sizes are positive, so once over is over."""
    w = Window.partitionBy(group).orderBy(*order)
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return passages.withColumn("block", F.row_number().over(w)).withColumn("used", used).where((F.col("block") == 1) | (F.col("used") <= budget))


def first_block(text: Column, block: Column, budget: int = CONTEXT_CHARS, least: int = 200) -> Column:
    """The first block cut to the budget (of 200 characters at least), others as they are."""
    return F.when(block == 1, F.substring(text, 1, max(budget, least))).otherwise(text)


def expand_siblings(hits: DataFrame, chunks: DataFrame, on: list[str], k: int = 3) -> DataFrame:
    """All chunks of the first k distinct sections that hits fall in, placed where the best hit ranked."""
    best = hits.groupBy("query_id", *on).agg(F.min("rank").alias("at"))
    first = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at", *on))).where(F.col("n") <= k)
    return first.join(chunks, on)


# Tags of prompts, hints of injected instructions, and what marks a citation.
PROMPT_TAG = r"</?\s*(sources?|system|instructions?|user|assistant)\b[^>]*>"
HINTS = [r"ignore (all|any|the)? ?(previous|above|prior) (instructions|rules)", r"disregard (the )?(system|previous)", "you are now", "system prompt", r"reveal (your|the) (prompt|instructions)", "পূর্ববর্তী নির্দেশ(না)? উপেক্ষা"]
ODD_MARK = r"[【［〔]\s*([0-9০-৯]{1,2})\s*(?:†[^】］〕\n]{0,40})?[】］〕]"
REPEATED = r"(\[\d{1,2}\])(?:\s*\1)+"


def sanitize(c: Column) -> Column:
    """What looks like a tag of the prompt has ‹ and › for its angle brackets."""
    tags = F.regexp_extract_all(c, F.lit(f"(?iuU)({PROMPT_TAG})"), F.lit(1))
    # the longest first, so that no tag is changed inside another
    tags = F.reverse(F.array_sort(F.transform(F.array_distinct(tags), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))))
    return F.aggregate(tags, c, lambda text, t: F.replace(text, t["t"], F.translate(t["t"], "<>", "‹›")))


def clean_message(c: Column, limit: int = 1000) -> Column:
    """Control characters to spaces, spaces collapsed; null if empty, too long, or without a letter or digit."""
    s = F.trim(F.regexp_replace(clean_unicode(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")), r"\s+", " "))
    return F.when((F.length(s) <= limit) & s.rlike(r"[\p{L}\p{N}]"), s)


def injection_hint(c: Column) -> Column:
    """Whether a message sounds like instructions to the model; for logs only."""
    return c.rlike(f"(?iu)({'|'.join(HINTS)})")


def strip_urls(c: Column, allowed: Column) -> Column:
    """URLs that aren't allowed go; a full stop or comma at an URL's end isn't part of it."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1)), lambda u: F.regexp_replace(u, "[.,;।]+$", "")))
    # the longest first, so that no URL is cut inside another
    bad = F.reverse(F.array_sort(F.transform(F.array_except(found, allowed), lambda u: F.struct(F.length(u).alias("n"), u.alias("u")))))
    return F.aggregate(bad, c, lambda text, u: F.replace(text, u["u"], F.lit("")))


def plain_marks(c: Column) -> Column:
    """The text with each mark of one or two digits as [k] in ASCII, whatever brackets, digits and line ranges it had."""
    c = F.regexp_replace(c, ODD_MARK, "[$1]")
    marks = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\[[0-9০-৯]{1,2}\])"), F.lit(1)))
    return F.aggregate(marks, c, lambda text, m: F.replace(text, m, bn_to_ascii_digits(m)))


def _numbers(plain: Column) -> Column:
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda x: F.struct(x.alias("mark"), x.cast("int").alias("k")))


def citations(c: Column, n: Column) -> Column:
    """Distinct numbers cited (see plain_marks), 1 <= k <= n, in order of first use."""
    return F.array_distinct(F.filter(F.transform(_numbers(plain_marks(c)), lambda x: x["k"]), lambda k: (k >= 1) & (k <= n)))


def cited_text(c: Column, n: Column) -> Column:
    """The answer with the citations that ``citations`` counts as [k] in ASCII: others go, repeats beside each other are one."""
    plain = plain_marks(c)
    bad = F.array_distinct(F.filter(_numbers(plain), lambda x: (x["k"] < 1) | (x["k"] > n)))
    left = F.aggregate(bad, plain, lambda text, x: F.replace(text, F.concat(F.lit("["), x["mark"], F.lit("]")), F.lit("")))
    return F.regexp_replace(left, REPEATED, "$1")


def count_and_list(docs: DataFrame, kind: str, year: str, title: str, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """How many of each kind, and the k newest of each (unknown years last, then by title)."""
    listed = docs.withColumn("n", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc_nulls_last(year), F.asc(title)))).where(F.col("n") <= k)
    return docs.groupBy(kind).agg(F.count("*").alias("total")), listed


# What sources and provisions are called.
AUTHORITY = [(100, "সরকারি আইনি দলিল (গেজেট)"), (90, "সরকারি দলিল"), (70, "সরকারি প্রশ্নোত্তর"), (50, "সরকারি ব্লগ"), (40, "ব্লগ"), (30, "ফোরাম (অফিসিয়াল)"), (10, "ফোরাম আলোচনা (অযাচাইকৃত)")]
SECTION_OF = {"আইন": "ধারা", "অধ্যাদেশ": "ধারা", "রাষ্ট্রপতির আদেশ": "অনুচ্ছেদ", "বিধিমালা": "বিধি", "প্রবিধান": "প্রবিধান"}
PARAGRAPH, SUB, SCHEDULE, CLAUSE_WORD = "অনুচ্ছেদ", "উপ-", "তফসিল", "দফা"
ROLE_LABELS = {"appendix": "তফসিল/সংযুক্তি", "overview": "পরিচিতি ও সূচি", "toc": "পরিচিতি ও সূচি", "preamble": "প্রস্তাবনা"}
REFERENCES = "সূত্র:"
SNIPPET = 240


def authority_label(c: Column, labels: list[tuple[int, str]] = AUTHORITY) -> Column:
    """The label of the greatest level at or under it, the lowest one's below all."""
    out = F.lit(labels[-1][1])
    for level, label in reversed(labels):
        out = F.when(c >= level, label).otherwise(out)
    return out


def section_word(doc_type: Column) -> Column:
    out = F.lit(PARAGRAPH)
    for kind, word in SECTION_OF.items():
        out = F.when(doc_type == kind, word).otherwise(out)
    return out


def section_label(rows: DataFrame) -> Column:
    """Where in its document a passage stands, for readers; null for what is no book or has no place.

    rows: doc_source_type, doc_type, section_number, section_heading, subsection_numbers, schedule_number, clause_number, role.
    """
    word, subs = section_word(F.col("doc_type")), F.coalesce("subsection_numbers", F.array().cast("array<string>"))
    heading = F.trim(F.regexp_replace("section_heading", "।+$", ""))
    head = F.concat(word, F.lit(" "), ascii_to_bn_digits(F.nullif("section_number", F.lit(""))), F.coalesce(F.concat(F.lit(" — "), F.nullif(heading, F.lit(""))), F.lit("")))
    sub = F.when(F.size(subs) > 0, F.concat(F.lit(SUB), word, F.lit(" "), F.array_join(F.array_distinct(F.array(F.element_at(subs, 1), F.element_at(subs, -1))), "–")))
    inner = F.when(F.col("schedule_number") != "", F.concat(F.lit(f"{SCHEDULE} "), "schedule_number")).when(F.col("clause_number") != "", F.concat(F.lit(f"{CLAUSE_WORD} "), "clause_number")).when(F.col("role") == "appendix", ROLE_LABELS["appendix"])
    parts = F.array_compact(F.array(head, sub, inner))
    role = F.when(F.col("role").isin("overview", "toc"), ROLE_LABELS["overview"]).when(F.col("role") == "preamble", ROLE_LABELS["preamble"])
    return F.when(F.col("doc_source_type") == "ebook", F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(role))


def source_rows(passages: DataFrame, cited: Column) -> DataFrame:
    """One row of display for each passage: index, title, types and ids, section, year, authority, url, snippet, cited.

    passages: query_id, rank, title, doc_source_type, source_type, doc_source_id, source_id, doc_type, year, authority,
    url, file_url, content and section_label's columns.
    """
    text = F.replace(F.trim(F.coalesce("content", F.lit(""))), F.lit("\n"), F.lit(" "))
    snippet = F.concat(F.substring(text, 1, SNIPPET), F.when(F.length(text) > SNIPPET, "…").otherwise(""))
    return passages.select("query_id", F.col("rank").alias("index"), "title", F.col("doc_source_type").alias("source_type"), F.col("source_type").alias("element_type"), F.col("doc_source_id").alias("source_id"), F.col("source_id").alias("element_id"), "doc_type", section_label(passages).alias("section"), "year", authority_label(F.coalesce("authority", F.lit(0))).alias("authority"), F.coalesce(F.nullif("url", F.lit("")), "file_url").alias("url"), snippet.alias("snippet"), cited.alias("cited"))


def references(sources: DataFrame) -> DataFrame:
    """Per query a plain-text list of its sources (source_rows), in order of index."""
    label = F.concat(F.coalesce("title", F.lit("")), F.coalesce(F.concat(F.lit(", "), "section"), F.lit("")))
    line = F.concat(F.lit("["), ascii_to_bn_digits(F.col("index").cast("string")), F.lit("] "), label, F.lit(" ("), "authority", F.lit(")"), F.coalesce(F.concat(F.lit("\n    "), "url"), F.lit("")))
    lines = sources.select("query_id", "index", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "line"))).alias("l"))
    return lines.select("query_id", F.concat(F.lit(f"{REFERENCES}\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def visible(answer: Column, sources: Column, hidden: str = "qna") -> tuple[Column, Column]:
    """(answer, sources) as shown: sources that are cited and of no hidden type; marks of cited hidden ones leave the answer.

    sources: array of structs with index, source_type, cited.
    """
    shut = lambda s: s["source_type"].startswith(hidden)
    out = F.aggregate(F.filter(sources, shut), answer, lambda text, s: F.replace(text, F.concat(F.lit("["), s["index"].cast("string"), F.lit("]")), F.lit("")))
    return out, F.filter(sources, lambda s: F.coalesce(s["cited"], F.lit(True)) & ~shut(s))


def coverage_of(used: DataFrame, totals: DataFrame) -> DataFrame:
    """Per query of an answer about a whole document: sections in the context, in order of use, of how many, and whether
    all are; used: query_id, document_id, rank, section_number; totals: document_id, total."""
    first = used.where("section_number is not null").groupBy("query_id", "document_id", "section_number").agg(F.min("rank").alias("at"))
    own = first.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("at", "section_number"))).alias("s"))
    asked = used.select("query_id", "document_id").distinct().join(own, ["query_id", "document_id"], "left").join(totals, "document_id")
    names = F.coalesce(F.transform("s", lambda x: x["section_number"]), F.array().cast("array<string>"))
    return asked.select("query_id", "document_id", names.alias("included"), "total", ((F.col("total") == 0) | (F.size(names) >= F.col("total"))).alias("whole"))


def coverage_note(title: Column, doc_type: Column, included: Column, total: Column) -> Column:
    """What a partial context holds of the document's provisions; null if it holds all."""
    word = section_word(doc_type)
    nums = F.when(F.size(included) > 0, F.array_join(F.transform(included, ascii_to_bn_digits), ", ")).otherwise(ROLE_LABELS["overview"])
    text = F.concat(title, F.lit(": "), ascii_to_bn_digits(F.size(included).cast("string")), F.lit("/"), ascii_to_bn_digits(total.cast("string")), F.lit(" — "), word, F.lit(" "), nums)
    return F.when((total > 0) & (F.size(included) < total), text)


def focus_note(section: Column, subsection: Column, clause: Column) -> Column:
    """The provision that a question names, as a note for the answer; null if it names none."""
    parts = F.array_compact(F.array(F.concat(F.lit("ধারা/বিধি "), ascii_to_bn_digits(section)), F.concat(F.lit("উপ-ধারা "), ascii_to_bn_digits(subsection)), F.concat(F.lit(f"{CLAUSE_WORD} ("), clause, F.lit(")"))))
    return F.when(section.isNotNull(), F.array_join(parts, ", "))


#: Characters of context and tokens of output that a request keeps, however little room there is.
LEAST_CONTEXT, LEAST_OUTPUT = 1_500, 512
CHARS_PER_TOKEN = 3.0


def fit_request(prompt: int, context: list[int], input_limit: int | None, total_limit: int | None, output: int, budget: int = CONTEXT_CHARS, chars_per_token: float = CHARS_PER_TOKEN, rounds: int = 6) -> tuple[int, int]:
    """(how many blocks of context stay, tokens of output).

    prompt: characters of the request beside its context; context: characters of its blocks, best first. The budget for
    context shrinks by what the estimated tokens are over the input limit, and a tenth more, until they fit, the rounds
    are over or it is at its floor; output is then what the total limit leaves, at its floor at least. No limits: as asked.
    """
    for _ in range(rounds):
        used, size = 0, 0
        for n in context:
            if used and size + n > budget:
                break
            used, size = used + 1, size + (min(n, max(budget, 200)) if not used else n)
        tokens = int((prompt + size) / chars_per_token)
        if not input_limit or tokens <= input_limit or budget <= LEAST_CONTEXT:
            break
        budget = max(LEAST_CONTEXT, int(size - (tokens - input_limit) * chars_per_token * 1.1))
    return used, max(LEAST_OUTPUT, min(output, total_limit - tokens)) if total_limit else output


def expand_document(hits: DataFrame, chunks: DataFrame, most: int = 400) -> tuple[DataFrame, DataFrame]:
    """(passages, totals) for questions about a whole document: the first ``most`` chunks, as they stand and without its
    preamble, of the book that ranks best; a question whose hits hold no book keeps its hits.

    hits: query_id, id, document_id, rank, doc_source_type; chunks: id, document_id, chunk_index, role, section_number.
    passages: query_id, id, document_id, place; totals: query_id, document_id, total (distinct sections).
    """
    books = hits.where(F.col("doc_source_type") == "ebook").groupBy("query_id").agg(F.min_by("document_id", "rank").alias("document_id"))
    # a book's first chunks are found once, however many questions ask for it, and by each task among its own before any move
    first = chunks.select("document_id", "id", "chunk_index", "role").withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "id"))).where(F.col("n") <= most)
    own = books.join(first, "document_id")
    whole = own.where(~F.coalesce(F.col("role") == "preamble", F.lit(False))).select("query_id", "id", "document_id", F.col("n").alias("place"))
    rest = hits.join(books.select("query_id"), "query_id", "left_anti").select("query_id", "id", "document_id", F.col("rank").alias("place"))
    totals = books.join(chunks.groupBy("document_id").agg(F.countDistinct("section_number").alias("total")), "document_id")
    return whole.unionByName(rest), totals.select("query_id", "document_id", "total")
