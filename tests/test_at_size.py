"""What larger tables have shown: each case is small, and failed before."""

import itertools
import os
import random
import re
import unicodedata

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.catalogue import ORACLE_SQL, QUERIES
from siftline.functions import text
from siftline.operators import answer, keep, normalize, postings, retrieval, sections

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder, **tables):
    """The query on some tables made here and the rest of SF, against DuckDB."""
    for t in os.listdir(SF):
        if t.split(".")[0] not in tables:
            os.symlink(f"{SF}/{t}", folder / t)
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
    for t in os.listdir(folder):
        at = f"{folder}/{t}"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def test_turns_are_no_trial_entries(spark, tmp_path):
    rows = [(1, 0, "user", "Test this"), (1, 1, "assistant", "a < b &amp; <p>c</p>"), (1, 4, "user", "after a gap"), (2, 0, "user", "alone")]
    same_as_sql(spark, "normalize_qna", tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_provisions_by_blocks_of_questions(spark):
    r = random.Random(5)
    words = ["land", "lands", "tax", "act", "ab", "abc", "1990", "1991", "rule"]
    titles = [(i, r.choices(words, k=r.randint(1, 5))) for i in range(60)] + [(60, []), (61, None)]
    chunks = [(i * 10 + s, i, str(s), s, [], f"{i}.{s}") for i in range(62) for s in range(r.randint(1, 3))]
    asked = [(q, str(r.randrange(3)), None, None, r.choice([1990, 1991, None]), r.sample(["land:*", "lan:*", "tax", "act", "ab:*", "1990", "none"], r.randint(1, 4))) for q in range(40)]
    want = {}
    for q, section, _, _, year, terms in asked:
        found = []
        for i, tokens in titles:
            hits = sum(any(w.startswith(t[:-2]) if t.endswith(":*") else w == t for w in tokens or []) for t in terms)
            if 2 * hits >= len(terms) and any(c[1] == i and c[2] == section for c in chunks):
                found.append((hits / len(terms), str(year) in (tokens or []), -len(tokens or []), i))
        best = sorted(x[3] for x in found if x[:3] == max(f[:3] for f in found))
        if 0 < len(best) <= 2:
            want[q] = best
    assert 5 < len(want) < 40
    frames = spark.createDataFrame(asked, "query_id long, section string, subsection string, clause string, year int, terms array<string>"), spark.createDataFrame(titles, "doc_id long, tokens array<string>"), spark.createDataFrame(chunks, "id long, doc_id long, section string, chunk_index int, numbers array<string>, content string")
    for block in (20, 1000):
        got = {}
        for x in retrieval.provision_lookup(*frames, block_terms=block).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append(x["doc_id"])
        assert got == want


def test_a_books_first_chunks_are_found_before_questions_meet_them(spark):
    hits = spark.range(30).selectExpr("id query_id", "id", "1L document_id", "1 rank", "'ebook' doc_source_type")
    chunks = spark.range(50).selectExpr("id", "1L document_id", "id chunk_index", "string(null) role", "'1' section_number")
    passages = answer.expand_document(hits, chunks, most=3)[0]
    assert passages.count() == 90
    plan = passages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # what stands first is done last


def test_scans_look_at_bounded_parts():
    size = [0, 300_000, 300_000, 900_000, 1] + [1] * 3000
    rows = pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(size)], pa.int32()), pa.array(["x"]).take(pa.array([0] * sum(size))))
    parts = list(retrieval._parts(pa.record_batch({"tokens": rows}), ("tokens",)))
    sizes = [[len(x) for x in p.column("tokens")] for p in parts]
    assert sum(sizes, []) == size and all(len(s) <= retrieval.ROWS and (len(s) == 1 or sum(s) <= retrieval.WORDS_AT_ONCE) for s in sizes)


def test_documents_are_dealt_before_their_words_are_told_apart(spark):
    docs = spark.createDataFrame([(1, ["a", None], ['"b', "a"], 1)], "id long, title array<string>, body array<string>, authority long")
    index = postings.build(docs)
    assert sorted((r["word"], r["docs"][0]["length"], r["docs"][0]["at"]) for r in index.collect()) == [('"b', 4, [6]), ("a", 4, [3, 8])]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # what stands first is done last


def test_units_of_records_come_out_of_one_pass(spark, tmp_path):
    # two records of one id: what one says keeps nothing of the other
    rows = [(1, "\nx"), (1, "y\n"), (2, "a\n" * 20), (3, "a < b &amp; c\né\n\n \nd" + "\n" * 30), (4, ""), (5, None)]
    same_as_sql(spark, "unnest_sections", tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    x = lambda i, content, *more: (i, None, None, content, None, *more)
    # an own schedule after the subsections; markup without text and odd spaces say nothing; text far down keeps what it stands in
    sections = [x(1, "<p> </p>", [x(2, "&nbsp;", [x(3, "", [x(4, " "), x(5, "<b>deep</b>")]), x(6, None, None)]), x(7, "\x1c", [])], [x(8, None, [x(9, "e​́")]), x(10, "​ ", None)]), None, x(11, "", None, None)]
    units = normalize.ebook(spark.createDataFrame([(7, *[None] * 14, sections), (None, *[None] * 14, sections), (8, *[None] * 15)], normalize.EBOOK))[1]
    got = [(r.source_id, r.path, r.unit_id, r.content) for r in units.orderBy("path").collect()]
    assert got == [("7", [0], "1", None), ("7", [0, 0], "2", None), ("7", [0, 0, 0], "3", None), ("7", [0, 0, 0, 1], "5", "deep"), ("7", [0, 1_000_000], "8", None), ("7", [0, 1_000_000, 0], "9", "é")]
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan and "Exchange" not in plan


def test_sections_are_dealt_once_and_cut_as_a_stream(spark):
    docs = spark.createDataFrame([(str(i), f"Act {i}") for i in range(50)] + [("7", "Again")], "source_id string, title string")
    units = spark.createDataFrame([(str(i), [j], "section", str(j), None, f"text {i} {j}", None) for i in range(51) for j in range(i % 4)], "source_id string, path array<int>, kind string, number string, heading string, content string, note string")
    out = sections.chunk_units(docs, units)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = sorted((int(r.id), r.chunk_index, r.context.split("\n")[0][-6:].strip(), r.content) for r in out.collect())
    assert got == [x for i in range(50) for x in [(i, 0, f"Act {i}", "\n".join(map(str, range(i % 4))) or f"Act {i}"), *((i, j + 1, f"Act {i}", f"text {i} {j}") for j in range(i % 4))]]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "FlatMapGroups" not in plan
    # a place costs its depth, not all that stands before it
    row = {"line": "x", "own": "x", "kind": "section", "number": "1", "heading": None, "note": None}
    tree = sections.Tree([row | {"path": p} for p in ([0], [0, 1], [0, 2], [0, 2, 5], [1], [1, 0, 0])], "s", 500, 700, 80, 30)
    assert tree.end == [4, 2, 4, 4, 6, 6] and tree.parent == [None, 0, 0, 2, None, 4]
    assert len(tree.place([3])["path"]) == 3


def token_docs(spark, n, seed, ids):
    r = random.Random(seed)
    words = ["".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(80)]
    rows = [(i, r.choices(words, k=r.randint(0, 3)), r.choices(words, k=r.choice([0, 3, 40, 200])), r.choice([None, 0, 9])) for i in ids[:n]]
    return rows, spark.createDataFrame(rows, "id long, title array<string>, body array<string>, authority long")


def test_a_sync_merges_ranges_where_they_arrive(spark, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_WORDS", 2000)  # long documents fill several ranges of a slot
    rows, docs = token_docs(spark, 150, 7, [*range(-20, 100), *range(400, 430)])
    changed_rows, changed = token_docs(spark, 40, 8, [*range(0, 60, 2), *range(700, 710)])
    off = [-20, 1, 2, 405, 9999]
    gone = spark.createDataFrame([(i,) for i in off], "id long")
    index = postings.build(docs, 64)
    assert index.select("range").distinct().count() > len({(i // 64, (len(t) + len(b)).bit_length()) for i, t, b, _ in rows if t or b})
    after = postings.update(index, changed, gone, 64)
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "collect_list(docs" not in plan  # no posting is looked up among a slot's ids
    now = {r[0]: r for r in rows if r[0] not in off} | {r[0]: r for r in changed_rows}
    want = postings.build(spark.createDataFrame(list(now.values()), docs.schema), 64)
    told = lambda df: sorted((r["range"], r["word"], r["n"], round(r["top"], 9), r["docs"]) for r in df.collect())
    assert told(postings.replaced(index, changed, gone, 64)) == told(want)
    asked = spark.createDataFrame([(q, t) for q in range(6) for t in ("ab:*", "c", "b" * (q + 1), "abca:*", "a:*")[: q + 1]], "query_id long, term string")
    got = postings.Search(want, asked, 7).hits
    assert sorted(got.collect()) == sorted(retrieval.lexical_topk(asked, spark.createDataFrame(list(now.values()), docs.schema), 7).collect())


def test_a_search_hands_on_the_best_of_a_task(spark):
    _, docs = token_docs(spark, 300, 9, range(300))
    asked = spark.createDataFrame([(q, t) for q in range(3) for t in ("a:*", "b:*")], "query_id long, term string")
    search = postings.Search(postings.build(docs, 16).coalesce(1), asked, 2)
    plan = search.hits._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
    found = postings._met_by_range(postings.build(docs, 16).select("range", "word", "top", "docs").mapInArrow(postings._weighed(spark.sparkContext.broadcast(postings._Places([0, 1], ["a:*", "b"])), 1.0, 0.4), "range long, query_id array<long>, bound array<double>, packed binary"), spark.sparkContext.broadcast(postings._Places([0, 1], ["a:*", "b"])), spark.sparkContext.broadcast(([], False, {})), 2)
    parts = found.where("step is null").groupBy(F.spark_partition_id().alias("task"), "query_id").count()
    assert parts.agg(F.max("count")).first()[0] == 2  # however many ranges a task meets


def test_words_have_the_queries_of_all_their_beginnings():
    r = random.Random(1)
    some = lambda a, b: "".join(r.choices("ab", k=r.randint(a, b)))
    for _ in range(100):
        pairs = sorted({(r.randrange(6) * 10, some(1, 5) + r.choice(["", ":*"])) for _ in range(r.randint(0, 20))})
        p = postings._Places([q for q, _ in pairs], [t for _, t in pairs])
        for word in (some(1, 8) for _ in range(40)):
            want = {q for q, t in pairs if t == word or t.endswith(":*") and word.startswith(t[:-2])}
            (code,) = p.codes([word])
            assert {int(p.ids[q]) for q in p.asking(p.codes([word]))[0]} == want if code >= 0 else not want


def test_latin_texts_go_round_what_only_some_need():
    beyond = re.compile(text._BEYOND)
    assert not beyond.search("".join(map(chr, [*range(0xAD), *range(0xAE, 0x300)])))
    for i in (i for i in range(0x110000) if not 0xD800 <= i < 0xE000):
        c = chr(i)
        if unicodedata.normalize("NFC", c) != c or unicodedata.category(c)[0] == "M" or c in text.ZERO_WIDTH or 0x980 <= i <= 0x9FF:
            assert beyond.search(c)


def test_what_is_spent_is_deleted(spark, tmp_path):
    other = spark.range(3)
    other.write.parquet(str(tmp_path / "own"))
    keep.spent(spark.read.parquet(str(tmp_path / "own")))  # not ours to delete
    assert os.path.isdir(tmp_path / "own")
    first = keep.stored(other)
    second = keep.stored(first.where("id > 0"))
    at = os.path.dirname(first.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(at)
    keep.spent(first)
    assert not os.path.exists(at) and second.count() == 2
