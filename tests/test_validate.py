"""Nested records with faults at each depth."""

import json

from pyspark.sql import functions as F

from siftline.operators import sync, validate
from siftline.operators.validate import ABSENT, BLANK, FRACTION, NO_BOOL, NO_INT, NO_INT_TEXT, NO_JSON, NO_LIST, NO_RECORD, NO_STRING


def told(spark, kind, records):
    df = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)], "i int, record string")
    return [r["errors"] for r in validate.validated(df, kind).orderBy("i").collect()]


def deep(**bad):
    """A book with all levels, the innermost schedule's fields replaced."""
    return {"id": 1, "title_of_act": "Act", "sections": [{"id": 1}, {"id": 2, "subsections": [{"id": 3, "schedules": [{"id": 4, "subschedules": [{"id": 5, "number": "1"} | bad]}]}], "schedules": None}]}


def test_books(spark):
    at = "sections.1.subsections.0.schedules.0.subschedules.0"
    want = [
        (deep(), None), (deep(id=None), f"{at}.id: {NO_INT}"), (deep(id="x"), f"{at}.id: {NO_INT_TEXT}"), (deep(id="12"), None), (deep(id=7.0), None), (deep(id=7.5), f"{at}.id: {FRACTION}"), (deep(id=True), None), (deep(id=[1]), f"{at}.id: {NO_INT}"),
        (deep(heading=3), f"{at}.heading: {NO_STRING}"), (deep(heading=None, other={"a": 1}), None), ({"id": 1}, None), ({}, f"id: {ABSENT}"),
        ({"id": 1, "sections": [{}, {"id": 2}, 5, None]}, f"sections.0.id: {ABSENT}; sections.2: {NO_RECORD}; sections.3: {NO_RECORD}"),
        ({"id": 1, "sections": {"id": 2}}, f"sections: {NO_LIST}"), ({"id": 1, "sections": [{"id": 1, "subsections": "x"}]}, f"sections.0.subsections: {NO_LIST}"),
        ({"id": 1, "sections": [{"id": 1, "schedules": [{"number": 4}]}]}, f"sections.0.schedules.0.id: {ABSENT}; sections.0.schedules.0.number: {NO_STRING}"),
        ({"id": 1, "meta_keywords": ["a", 2, None]}, f"meta_keywords.1: {NO_STRING}; meta_keywords.2: {NO_STRING}"), ({"id": 1, "meta_keywords": None, "sections": None}, None),
        ({"sections": [{}] * 9}, f"id: {ABSENT}; " + "; ".join(f"sections.{i}.id: {ABSENT}" for i in range(4))),
        ({"id": 1, "sections": [{"id": i} for i in range(300)] + [{}]}, f"sections.300.id: {ABSENT}"),
    ]
    assert told(spark, "ebook", [r for r, _ in want]) == [e for _, e in want]


def test_other_kinds(spark):
    assert told(spark, "qna_type1", [{"id": 0, "question": "q", "answer": "a"}, {"id": 1, "question": "  ", "answer": None}, {"question": 1}, "{", None, "[1]", '"x"']) == [None, f"question: {BLANK}; answer: {NO_STRING}", f"id: {ABSENT}; question: {NO_STRING}; answer: {ABSENT}", NO_JSON, NO_JSON, NO_RECORD, NO_RECORD]
    assert told(spark, "blog", [{"id": 1, "title_name": ""}, {"id": 1, "title_name": None}, {"id": 1, "title_name": "t", "featured": "yes"}, {"id": 1, "title_name": "t", "featured": 3}]) == [None, f"title_name: {NO_STRING}", None, f"featured: {NO_BOOL}"]
    assert told(spark, "forum", [{"id": "u", "name": "n", "category": [1], "topics": [{"id": "t", "title": "x"}, {"id": 9, "is_pinned": "maybe"}]}, {"id": 4, "name": "n"}]) == [f"topics.1.id: {NO_STRING}; topics.1.title: {ABSENT}; topics.1.is_pinned: {NO_BOOL}", f"id: {NO_STRING}"]


def test_a_record_that_breaks_a_function_is_an_error_row(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("d", "4")], "id string, record string")
    made = validate.guarded(rows, lambda r: {"id": r["id"], "hash": str(100 // int(r["record"])), "record": r["record"]}, "id string, hash string, record string")
    got = {r["id"]: (r["hash"], r["errors"]) for r in made.collect()}
    assert got["a"] == ("100", None) and got["d"] == ("25", None) and got["b"][1].startswith("ValueError") and got["c"][1].startswith("TypeError")
    # such a record stays present in a sync, as it was
    old = spark.createDataFrame([("t", "b", "h", "old", False)], "source_type string, id string, hash string, record string, deleted boolean").withColumns({"last_seen": F.lit(None).cast("timestamp"), "last_run_id": F.lit("r0")})
    table, told_ = sync.upsert_sources(old, made.withColumn("source_type", F.lit("t")), "r1", F.current_timestamp(), ["t"])
    kept = {r["id"]: (r["hash"], r["deleted"]) for r in table.collect()}
    assert kept == {"a": ("100", False), "b": ("h", False), "d": ("25", False)}
    assert {r["id"]: r["status"] for r in told_.collect()} == {"a": "created", "b": "error", "c": "error", "d": "created"}
