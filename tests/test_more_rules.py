"""Fusion by name, batch reranking, whole documents, medians, question sets, metadata of books and contexts."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from siftline.operators import answer, chunk, embed, evaluate, normalize, retrieval as R, sections


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, score double, rank int")


def test_fuse_by_name_with_exact_hits(spark):
    v, x = hits(spark, [(1, 10, 0.9, 1), (1, 11, 0.5, 2)]), hits(spark, [(1, 11, 3.0, 1)])
    exact = spark.createDataFrame([(1, 99, 1), (1, 11, 2)], "query_id long, id long, rank int")
    with pytest.raises(ValueError, match="unknown fusion"):
        R.fuse(v, x, "max")
    for method in ("rrf", "linear"):
        rows = {r["id"]: r for r in R.fuse(v, x, method, exact).collect()}
        assert set(rows) == {10, 11, 99} and rows[99]["fused"] == 0.0 and rows[99]["exact"] == 0 and rows[11]["exact"] == 1
        assert [r["id"] for r in R.pool(R.promote(R.fuse(v, x, method, exact), F.col("exact"))).orderBy("fused_rank").collect()][:2] == [99, 11]
    assert R.fuse(v, x, "rrf").count() == 2


def test_batch_reranking_falls_back_to_the_fused_order(spark):
    rows = [(q, 10 * q + i, f"question {q}", f"text {i}" if q != 2 or i else "break", 100 if i == 2 else None, i + 1) for q in (1, 2, 3) for i in range(3)]
    pool = spark.createDataFrame(rows, "query_id long, id long, question string, text string, authority int, fused_rank int")

    def model(pairs):
        if any(t == "break" for _, t in pairs):
            raise RuntimeError("no model")
        return [float(t[-1]) for _, t in pairs]

    got = R.rerank_with(pool, model, k=2, batch=1).orderBy("query_id", "final_rank").collect()
    assert [(r["query_id"], r["id"], r["reranked"], r["rerank"]) for r in got] == [(1, 12, True, 2.1), (1, 11, True, 1.0), (2, 20, False, None), (2, 21, False, None), (3, 32, True, 2.1), (3, 31, True, 1.0)]
    with pytest.raises(Exception, match="no model"):
        R.rerank_with(pool, model, fall_back=False).collect()


def test_each_text_is_embedded_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, text string")
    seen = str(tmp_path / "seen")

    def model(texts):
        with open(seen, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[1.0, float(len(t))] for t in texts]

    got = {r["id"]: r["v"] for r in embed.embed_once(rows, model, 2).collect()}
    assert got[1] == got[3] != got[4] == got[5] and set(got) == {1, 2, 3, 4, 5}
    assert sorted(open(seen).read().split("\n")[:-1]) == ["", "a", "b"]


def test_unit_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1e200, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, None), (8, [float("inf")])]
    got = {r["i"]: r["u"] for r in spark.createDataFrame(rows, "i int, v array<double>").select("i", embed.unit(F.col("v")).alias("u")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0] and got[3] == [1.0, 0.0] and all(got[i] is None for i in (4, 5, 6, 7, 8))


def test_whole_documents(spark):
    found = spark.createDataFrame([(1, 5, 50, 2, "ebook"), (1, 6, 60, 1, "blog"), (1, 7, 70, 3, "ebook"), (2, 8, 80, 1, "blog")], "query_id long, id long, document_id long, rank int, doc_source_type string")
    chunks = spark.createDataFrame([(500, 50, 0, "overview", None), (501, 50, 1, "preamble", None), (502, 50, 2, "section", "1"), (503, 50, 3, "section", "1"), (504, 50, 4, None, "2"), (700, 70, 0, "section", "1")], "id long, document_id long, chunk_index int, role string, section_number string")
    passages, totals = answer.expand_document(found, chunks, most=4)
    assert [tuple(r) for r in passages.orderBy("query_id", "place").collect()] == [(1, 500, 50, 1), (1, 502, 50, 3), (1, 503, 50, 4), (2, 8, 80, 1)]
    assert [tuple(r) for r in totals.collect()] == [(1, 50, 2)]


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [], [None, float("nan")], "skew", "repeats", "two", "wide"])
def test_exact_median(spark, monkeypatch, values):
    monkeypatch.setattr(evaluate, "FEW", 50)
    monkeypatch.setattr(evaluate, "ACCURACY", 100)
    r = random.Random(3)
    values = {"skew": [r.random() ** 30 * 1e6 for _ in range(4001)], "repeats": [1.0] * 1700 + [2.0] * 1700 + [r.random() for _ in range(600)] + [None] * 9, "two": [0.25] * 1000 + [0.75] * 1000, "wide": [10.0 ** r.randint(-300, 300) * r.choice([-1, 1]) for _ in range(3000)]}.get(values, values) if isinstance(values, str) else values
    df = spark.createDataFrame([(v,) for v in values], "seconds double").repartition(3)
    real = sorted(v for v in values if v is not None and v == v)
    assert evaluate.quantile(df, "seconds") == (pytest.approx(statistics.median(real), rel=1e-12) if real else None)
    if real:
        ranks = [0, len(real) // 3, len(real) - 1]
        assert evaluate.order_statistics(df, "seconds", [*ranks, len(real) + 5]) == {k: real[k] for k in ranks}


def test_run_summary_counts_refusals_and_errors(spark):
    rows = [(1.0, 0.1, True, True, False, True, None), (0.5, 0.3, True, False, True, False, None), (0.0, 0.2, True, True, None, None, "timeout"), (0.0, 0.4, False, False, True, None, None), (0.0, 0.9, False, True, False, None, None)]
    df = spark.createDataFrame(rows, "mrr double, seconds double, answerable boolean, sufficient boolean, refused boolean, grounded boolean, error string")
    got = evaluate.run_summary(df).first().asDict()
    assert got == {"n": 5, "mrr": 0.5, "grounded": 0.5, "p50_seconds": 0.3, "gate_pass_rate": 0.6667, "gate_refusal_rate": 0.5, "refusal_rate": 0.5, "false_refusal_rate": 0.5, "errors": 1}


def test_self_retrieval_set(spark):
    docs = spark.createDataFrame([("qna_type1", "1", "Q one"), ("qna_type1", "2", None), ("qna_type2", "3", "Q three"), ("blog", "4", "no")] + [("qna_type2", str(i), f"q{i}") for i in range(50, 60)], "source_type string, source_id string, title string")
    chunks = spark.createDataFrame([("section", "s1", "12", "Head।", "Act", 7, "ধারা", 1), ("section", "s1", "12", "Head again", "Act", 7, "ধারা", 2), ("section", "s2", None, "x", "Act", 7, "ধারা", 3), ("section", "s3", "4", None, "Act", 7, "ধারা", 4), ("subsection", "s4", "4", "y", "Act", 7, "ধারা", 5)], "source_type string, source_id string, section_number string, section_heading string, title string, doc_id long, word string, chunk_index int")
    got = {r["id"]: tuple(r)[1:] for r in evaluate.self_retrieval_set(docs, chunks, each=4).collect()}
    assert got["self-qna_type1-1"] == ("self_qna_type1", "Q one", "qna_type1:1") and sum(t[0] == "self_qna_type2" for t in got.values()) == 4
    assert got["self-section-s1"] == ("self_section_by_number", "Act এর ধারা ১২ এ কী বলা হয়েছে?", "section:s1")
    assert got["self-heading-s1"] == ("self_section_heading_to_act", "Head", "ebook:7") and len(got) == 7


def test_metadata_of_books_and_groups_of_topics(spark):
    schema = normalize.EBOOK + ", sub_branch string, created_at_bn string, created_at_en string, signature_by string, signature_position string, objective string, motto string"
    row = {"id": 7, "title_of_act": "Act", "ebooks_type": "আইন", "act_year": "১৯৯০", "file": "f.pdf", "merged_file": "", "branch": "Tax", "sub_branch": " Land ", "created_at_bn": "বাংলা", "created_at_en": " ", "signature_by": "A B", "signature_position": "Secretary", "objective": "<p>to <b>tax</b></p>", "motto": "", "sections": [{"id": 1}, {"id": 2}]}
    m = normalize.ebook(spark.createDataFrame([row], schema))[0].first()["metadata"]
    assert (m["issued_date"], m["applicable_date"], m["branch"], m["signature"], m["objective"], m["motto"], m["proposal"], m["files"], m["section_count"], m["act_year_raw"]) == ("বাংলা", None, "Tax, Land", "A B, Secretary", "to tax", None, None, {"file": "f.pdf"}, 2, "১৯৯০")
    f = spark.createDataFrame([("g", " Group ", "about", None, [("t", "Topic", "x", None, None)])], normalize.FORUM)
    assert {r["source_id"]: r["group"] for r in normalize.forum(f).collect()} == {"g": None, "t": "Group"}


def test_contexts_of_documents(spark):
    rows = spark.createDataFrame([("a", "Act A", "আইন", 1990, "5"), ("b", "B", None, None, None), ("c", "C", "পরিপত্র", 2001, "")], "source_id string, title string, doc_type string, year int, number string")
    called, lines = sections.document_lines(F.col("doc_type"), F.col("year"), F.col("number"))
    docs = rows.withColumns({"called": called, "lines": lines})
    none = spark.createDataFrame([], "source_id string, path array<int>, kind string, number string, heading string, content string")
    got = {r["id"]: r["context"].split("\n") for r in sections.chunk_units(docs, none).collect()}
    assert got["a"][:2] == ["আইনের নাম: Act A", "ধরন: আইন | সাল: ১৯৯০ | নম্বর: 5"]
    assert got["b"][0] == "দলিলের নাম: B" and len(got["b"]) == 2 and got["c"][1] == "ধরন: পরিপত্র | সাল: ২০০১"


def test_headings():
    yes = ["সংজ্ঞা ও প্রয়োগ", "Scope of the rules", "ক অংশ"]
    no = ["abc", "x" * 81, "- item here", "one | two", "(ক) এই ধারা", "“quoted", "স্বা/- সচিব", "মোঃ করিম", "১২। কর", "12) tax", "3 . tax", "১২-৩ (৪)", "এটি একটি বাক্য।", "as follows:-", "well;", "বিতরণ", "sentence."]
    assert [chunk.is_heading(x) for x in yes] == [True] * 3 and [x for x in no if chunk.is_heading(x)] == []


def test_books_are_numbered_once(spark):
    docs = spark.createDataFrame([("a", "Act", "তফসিল এক\n" + "কর আইন। " * 900, "appendix"), ("b", "Only text", "short text", "body"), ("c", "No text", None, "body")], "source_id string, title string, body string, role string")
    units = spark.createDataFrame([("a", [0], "section", "1", "Head", "text one"), ("a", [1], "section", "2", None, "text two")], "source_id string, path array<int>, kind string, number string, heading string, content string")
    got = sections.chunk_books(docs, units).orderBy("id", "chunk_index").collect()
    by = {i: [(r["chunk_index"], r["role"]) for r in got if r["id"] == i] for i in "abc"}
    assert all([k for k, _ in own] == list(range(len(own))) for own in by.values())
    roles = [r for _, r in by["a"]]
    assert roles[0] == "overview" and roles[-1] == "appendix" and roles.index("appendix") >= 2 and roles.count("appendix") > 2
    assert [r for _, r in by["b"]] == ["overview", "body"] and [r for _, r in by["c"]] == ["overview"]


def test_signature_and_suggestion_forms(spark, tmp_path):
    from siftline.sources import read_suggestions

    assert chunk.signature() != chunk.signature(excluded="^test") != chunk.signature(excluded="^trial")
    (tmp_path / "s.txt").write_text("ধারা ৫?\n# no\n\nধারা  5\n!!!\nOther One\n")
    assert {r["form"]: r["question"] for r in read_suggestions(spark, str(tmp_path / "s.txt")).collect()} == {"ধারা 5": "ধারা ৫?", "other one": "Other One"}
