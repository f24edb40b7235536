"""Validation of nested JSON records: one Column of error texts with paths, built by walking a description of the record."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Error texts of a record that are kept.
MOST = 5


@dataclass(frozen=True)
class Field:
    """What a record's field holds: int, str, bool, any, strs (a list of strings) or items (a list of records)."""

    name: str
    kind: str = "str"
    required: bool = False
    #: A string that has to say something.
    filled: bool = False
    items: tuple[Field, ...] = field(default=())


def _strs(names: str) -> tuple[Field, ...]:
    return tuple(Field(n) for n in names.split())


# The fields of the source's records in their order, and the texts of errors.
_ID = Field("id", "int", required=True)
_UNIT = (_ID, *_strs("number heading content note"))
_SCHEDULES = Field("schedules", "items", items=(*_UNIT, Field("subschedules", "items", items=_UNIT)))
EBOOK = (_ID, *_strs("title_of_act ebooks_type act_year number publication_date publication_by proposal objective motto file merged_file system_generated_pdf schedules heading footer created_at_bn created_at_en applicable_date_bn applicable_date_en branch sub_branch signature_position signature_by"), Field("meta_keywords", "strs"), Field("multiple_reference_link", "strs"), Field("created_date"), Field("sections", "items", items=(*_UNIT, Field("subsections", "items", items=(*_UNIT, _SCHEDULES)), _SCHEDULES)))
BLOG = (_ID, Field("title_name", required=True), *_strs("author content cover"), Field("featured", "bool"), Field("created_date"))
FORUM = (Field("id", required=True), Field("name", required=True), *_strs("description badge group_type"), Field("category", "any"), Field("created_date"), Field("topics", "items", items=(Field("id", required=True), Field("group"), Field("title", required=True), *_strs("description status"), Field("is_pinned", "bool"), Field("is_archived", "bool"), Field("created_date"))))
QNA = (_ID, Field("question", required=True, filled=True), Field("answer", required=True, filled=True), *_strs("category keyword"))
RECORDS = {"ebook": EBOOK, "blog": BLOG, "forum": FORUM, "qna_type1": QNA, "qna_type2": QNA}
ABSENT, NO_STRING, NO_LIST, NO_BOOL, NO_RECORD = "Field required", "Input should be a valid string", "Input should be a valid list", "Input should be a valid boolean", "Input should be a valid dictionary"
NO_INT, NO_INT_TEXT, FRACTION, BLANK = "Input should be a valid integer", "Input should be a valid integer, unable to parse string as an integer", "Input should be a valid integer, got a number with a fractional part", "Value error, empty question/answer"
NO_JSON = "not JSON"


def _kind(v: Column) -> Column:
    """VOID, STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, ARRAY or OBJECT; null for what is absent."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _one(kind: str, v: Column, filled: bool) -> Column:
    """The error of a value that is there, or null. Numbers in texts and whole fractions count as integers, as do true and
    false; booleans may also be 0, 1 and the usual words."""
    t = _kind(v)
    if kind == "any":
        return F.lit(None).cast("string")
    if kind == "str":
        out = F.when(t != "STRING", NO_STRING)
        return out.when(F.trim(F.regexp_replace(_text(v), r"(?U)\s+", " ")) == "", BLANK) if filled else out
    if kind == "bool":
        word = F.lower(_text(v)).isin("0", "1", "true", "false", "t", "f", "yes", "no", "y", "n", "on", "off")
        return F.when(~((t == "BOOLEAN") | (t.isin("STRING", "BIGINT") & word)), NO_BOOL)
    number = _text(v).rlike(r"^\s*[+-]?\d+(\.0*)?\s*$") | (t.isin("DECIMAL", "DOUBLE") & (F.try_variant_get(v, "$", "double") % 1 == 0))
    return F.when(t.isin("BIGINT", "BOOLEAN"), None).when(t == "STRING", F.when(~number, NO_INT_TEXT)).when(t.isin("DECIMAL", "DOUBLE"), F.when(~number, FRACTION)).otherwise(NO_INT)


def _list(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def problems(record: Column, fields: tuple[Field, ...], path: Column | None = None) -> Column:
    """An array of error texts `path: text` of a variant, in the order of its fields, items before what stands after them."""
    at = (lambda name: F.concat(path, F.lit(f".{name}"))) if path is not None else F.lit
    none = F.array().cast("array<string>")
    out = []
    for f in fields:
        v = F.try_variant_get(record, f"$.{f.name}", "variant")
        say = lambda text, here=None, name=f.name: F.array(F.concat(at(name) if here is None else here, F.lit(": "), text))
        absent = v.isNull()
        null = F.is_variant_null(v)
        if f.kind in ("strs", "items"):
            place = lambda i, name=f.name: F.concat(at(name), F.lit("."), i.cast("string"))
            if f.kind == "strs":
                each = F.transform(_list(v), lambda x, i: F.when(_kind(x) != "STRING", F.concat(place(i), F.lit(f": {NO_STRING}"))))
                inside = F.filter(each, lambda e: e.isNotNull())
            else:
                inside = F.flatten(F.transform(_list(v), lambda x, i: F.when(_kind(x) == "OBJECT", problems(x, f.items, place(i))).otherwise(F.array(F.concat(place(i), F.lit(f": {NO_RECORD}"))))))
            out.append(F.when(absent | null, none).when(_kind(v) != "ARRAY", say(F.lit(NO_LIST))).otherwise(inside))
        else:
            wrong = _one(f.kind, v, f.filled)
            there = F.when(wrong.isNotNull(), say(wrong)).otherwise(none)
            if f.required:
                out.append(F.when(absent, say(F.lit(ABSENT))).otherwise(there))
            else:
                out.append(F.when(absent | null, none).otherwise(there))
    return F.concat(*out)


def errors(record: Column, kind: str, most: int = MOST) -> Column:
    """The first errors of a JSON text as a record of that kind, joined by semicolons; null if there are none.

    A null text, one that is no JSON and one that is no object are errors; fields that are not described are no matter.
    """
    v = F.try_parse_json(record)
    found = F.slice(problems(v, RECORDS[kind]), 1, most)
    return F.when(v.isNull(), NO_JSON).when(_kind(v) != "OBJECT", NO_RECORD).otherwise(F.nullif(F.array_join(found, "; "), F.lit("")))


def validated(records: DataFrame, kind: str, column: str = "record") -> DataFrame:
    """records with source_id (the id as text, null where it is none) and errors (null: none), as sync.upsert_sources reads them."""
    v = F.try_parse_json(F.col(column))
    of = F.try_variant_get(v, "$.id", "string")
    return records.withColumns({"source_id": F.nullif(F.trim(of), F.lit("")), "errors": errors(F.col(column), kind)})


def guarded(rows: DataFrame, make, schema: str) -> DataFrame:
    """Rows of ``make(row) -> dict`` with an error text beside them: a row on which it fails is an error row, not a failed job."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made, failed = [], []
            for row in batch.to_pylist():
                try:
                    made.append(make(row))
                    failed.append(None)
                except Exception as e:
                    made.append({n: row.get(n) for n in names})
                    failed.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_pydict({**{n: [m.get(n) for m in made] for n in names}, "errors": failed})

    return rows.mapInArrow(run, f"{schema}, errors string")
