"""Operators on literal rows: text rules, analysis, normalising, chunks, fusion, answers, tables, streams."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import analyze as A
from siftline.functions import text as X
from siftline.operators import answer, chunk, embed, normalize, retrieval, sections, sync
from siftline.sources import Conflict, VersionedTables, check_compatibility, export_index, fingerprint, import_index, read_questions, read_snapshot, read_suggestions, write_questions, write_snapshot
from siftline.streaming import rate_windows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("f", "value", "want"), [
    (X.bn_to_ascii_digits, "ধারা ১২৩", "ধারা 123"),
    (X.ascii_to_bn_digits, "12", "১২"),
    (X.clean_unicode, "é​", "é"),
    (X.normalize_whitespace, "  a  b \n\n\n\n c  ", "a b\n\nc"),
    (X.tokenize, "The Act, _ ১২ x_1", ["the", "act", "12", "x_1"]),
    (X.parse_year, "সন ১৯৯৬", 1996), (X.parse_year, "9999", None), (X.parse_year, "none", None),
    (X.normalize_section_number, " ১২ক। ", "12ক"), (X.normalize_section_number, "0", None), (X.normalize_section_number, "4a.", "4A"),
    (X.token_count, "", 0), (X.token_count, "a", 1), (X.token_count, "a" * 23, 10),
    (X.html_to_text, "<p>a &amp; b</p><ul><li>c</li></ul><table><tr><td>1</td><td>2</td></tr></table><script>x</script>", "a & b\n\n- c\n\n1 | 2"),
    (X.redact_secrets, "password=hunter2 ok", "password=*** ok"),
    (answer.sanitize, "a <source id=1> b", "a ‹source id=1› b"),
    (answer.clean_message, " a\x01b ", "a b"), (answer.clean_message, "?!", None),
    (lambda c: answer.citations(c, F.lit(3)), "a [২] b 【1】 [2] [7]", [2, 1]),
    (lambda c: answer.strip_urls(c, F.array(F.lit("https://a.b/c"))), "see https://a.b/c. or https://a.b/cd, x", "see https://a.b/c. or , x"),
    (A.looks_dependent, "what about it", True), (A.looks_dependent, "explain pension transfer rules", False),
    (lambda c: normalize.flexible_date(c).cast("string"), "০৫-০২-১৯৯৯", "1999-02-05"), (lambda c: normalize.flexible_date(c).cast("string"), "2001/2/30", None),
])
def test_scalar(spark, f, value, want):
    assert one(spark, value, f) == want


def test_analysis(spark):
    rows = [("section 12(3) of the 1996 act",), ("sub-section 4",), ("hello!",), ("how many acts",), ("ধারা ৫ কী",)]
    got = [r.asDict() for r in A.analyze(spark.createDataFrame(rows, "question string")).collect()]
    assert [g["section"] for g in got] == ["12", None, None, None, "5"]
    assert (got[0]["subsection"], got[0]["year"], got[1]["subsection"]) == ("3", 1996, "4")
    assert [g["route"] for g in got] == ["rag", "rag", "smalltalk", "structured", "rag"]


def test_chunks_keep_words_and_size():
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(i % 90)) + "." for i in range(60)) + "\n" + "z" * 5000
    parts = chunk.pack(text, 60, 90, 10, 5)
    assert all(chunk.tokens(p) <= 90 for p in parts)
    assert set(text.replace("z" * 5000, "").split()) <= {w for p in parts for w in p.split()}
    short = " ".join(["ab", "c", "def"] * 4000)
    assert all(chunk.tokens(p) <= 90 for p in chunk.pack(short, 60, 90, 10, 5))
    assert set(short.split()) == set(" ".join(chunk.pack(short, 60, 90, 10, 5)).split())
    assert chunk.pack("", 60) == [] and chunk.pack("a b") == ["a b"]


def test_fusion(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "query_id long, id long, score double, rank int")
    x = spark.createDataFrame([(1, 11, 0.3, 1)], "query_id long, id long, score double, rank int")
    linear = {r["id"]: r["fused"] for r in retrieval.fuse_linear(v, x).collect()}
    assert linear == {10: pytest.approx(0.7), 11: pytest.approx(0.3)}
    rrf = {r["id"]: r["fused"] for r in retrieval.fuse_rrf(retrieval.union_candidates(v, x)).collect()}
    assert rrf[11] == pytest.approx(0.6 / 62 + 0.4 / 61)
    top = retrieval.pool(retrieval.promote(retrieval.fuse_linear(v, x), F.when(F.col("id") == 11, 0)), 1).collect()
    assert [r["id"] for r in top] == [11]


def test_vector_topk_nulls(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, v array<double>")
    e = spark.createDataFrame([(1, [1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [2.0, 0.0]), (8, [1.0, 1.0])], "id long, v array<double>")
    assert [(r["id"], r["rank"]) for r in retrieval.vector_topk(q, e, 2).orderBy("rank").collect()] == [(7, 1), (8, 2)]


def test_sync(spark):
    old = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True), (4, "d", False)], "id long, hash string, deleted boolean")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (5, "e")], "id long, hash string")
    assert {r["id"]: r["status"] for r in sync.diff(old, new).collect()} == {1: "unchanged", 2: "updated", 3: "updated", 4: "missing", 5: "created"}


def test_embed_falls_back_to_rows(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[3.0, 4.0] for _ in texts]

    got = {r["id"]: r for r in embed.embed(spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, text string"), model, 2).collect()}
    assert got[1]["v"] == [0.6, 0.8] and got[2]["v"] is None and "RuntimeError" in got[2]["error"]


def test_normalize_records(spark):
    q = spark.createDataFrame([(0, "Q?", "A", " Tax ", None), (1, "test entry", "A", None, None), (2, "Q", " ", None, None)], normalize.QNA)
    got = {r["source_id"]: r for r in normalize.qna(q).collect()}
    assert set(got) == {"0", "2"} and got["0"]["category"] == "tax" and got["2"]["errors"] == "answer: required"
    f = spark.createDataFrame([("g", "Group", "about", "official", [("t1", "Topic", "text", None, None)])], normalize.FORUM)
    assert {(r["source_type"], r["source_id"], r["parent_source_id"]) for r in normalize.forum(f).collect()} == {("forum", "g", None), ("topic", "t1", "g")}
    e = spark.createDataFrame([(7, "Act", "law", "১৯৯০", None, None, None, None, None, None, None, None, "Tax", None, None, [(1, "১।", "Head", "<p>x</p>", None, [(2, "২", None, "y", None, [])], [(3, None, "S", "z", None, [])])])], normalize.EBOOK)
    docs, units = normalize.ebook(e)
    assert docs.first()["year"] == 1990
    assert [(r["kind"], r["number"]) for r in units.orderBy("path").collect()] == [("section", "1"), ("subsection", "2"), ("schedule", None)]


def test_versioned_tables(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path))
    assert t.version("docs") == 0
    t.publish("docs", spark.range(3))
    assert t.publish("docs", spark.range(5)) == 2
    assert t.read("docs").count() == 5
    m = t.manifest("docs", "id")
    t.check_import("docs", "id", m)
    t.publish("docs", spark.range(4))
    with pytest.raises(ValueError, match="differ"):
        t.check_import("docs", "id", m)


def test_publish_is_refused_where_another_came_first(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path))
    t.publish("docs", spark.range(3))
    seen = t.version("docs")
    t.publish("docs", spark.range(5))
    with pytest.raises(Conflict):
        t.publish("docs", spark.range(1), since=seen)
    assert t.version("docs") == 2 and t.read("docs").count() == 5


def test_fingerprints_tell_repeats_and_nulls_apart(spark):
    of = lambda rows: fingerprint(spark.createDataFrame(rows, "a int, b int"))
    assert of([(1, 2), (3, None)]) == of([(3, None), (1, 2)])
    assert len({str(of(r)) for r in ([(1, 1), (1, 1)], [(2, 2), (2, 2)], [(1, None), (2, 2)], [(None, 1), (2, 2)])}) == 4


def test_index_goes_out_and_in(spark, tmp_path):
    about = {"dim": 2, "model": "m", "pipeline": "p1", "signature": "s"}
    docs, chunks = spark.createDataFrame([(1, "x", 9)], "id long, title string, last_run_id long"), spark.createDataFrame([(1, 1, [0.5])], "id long, document_id long, v array<double>")
    with pytest.raises(ValueError, match="no vector"):
        export_index(spark, {"documents": docs}, str(tmp_path / "no"), about, pending=spark.range(1))
    export_index(spark, {"documents": docs, "chunks": chunks}, str(tmp_path / "out"), about, pending=spark.range(0))
    schemas = {"documents": docs.select("id", "title", "last_run_id", docs["title"].alias("more")).schema, "chunks": chunks.schema}
    into = VersionedTables(spark, str(tmp_path / "in"))
    manifest, warnings = import_index(spark, str(tmp_path / "out"), into, schemas, about | {"pipeline": "p2"})
    assert warnings == ["pipeline p1, not p2"] and into.read("documents").first().asDict() == {"id": 1, "title": "x", "last_run_id": None, "more": None}
    assert into.read("imports").count() == 1
    with pytest.raises(ValueError, match="has rows"):
        import_index(spark, str(tmp_path / "out"), into, schemas, about)
    import_index(spark, str(tmp_path / "out"), into, schemas, about, force=True)
    for bad in ({"dim": 3}, {"model": "n"}):
        with pytest.raises(ValueError):
            check_compatibility(manifest, about | bad)
    assert check_compatibility(manifest, about | {"model": "n"}, other_model=True) == ["model m, not n"]
    spark.createDataFrame([(1, "changed", None)], docs.schema).write.mode("overwrite").parquet(str(tmp_path / "out" / "documents"))
    with pytest.raises(ValueError, match="differ"):
        import_index(spark, str(tmp_path / "out"), into, schemas, about, force=True)


def test_snapshots(spark, tmp_path):
    schema = spark.createDataFrame([], normalize.QNA).schema
    (tmp_path / "a.json").write_text('[{"id": 1, "question": "q"}, {"id": 2}]')
    (tmp_path / "b.json").write_text('{"count": 1, "results": [{"id": 3, "question": "r"}]}')
    (tmp_path / "c.json").write_text("[]")
    ids = lambda p: sorted(r["id"] for r in read_snapshot(spark, str(p), schema).collect())
    assert [ids(tmp_path / f"{x}.json") for x in "abc"] == [[1, 2], [3], []]
    with pytest.raises(Exception):
        ids(tmp_path / "none.json")
    write_snapshot(spark.createDataFrame([(i, f"q{i}") for i in range(20)], "id long, question string").repartition(3), str(tmp_path / "w"))
    assert ids(tmp_path / "w") == list(range(20))


def test_sources_through_a_run(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    cols = "source_type string, id string, hash string, record string, deleted boolean, last_seen timestamp, last_run_id string"
    old = spark.createDataFrame([("a", "1", "h1", "r1", False, None, "r0"), ("a", "2", "h2", "r2", False, None, "r0"), ("a", "3", "h3", "r3", True, None, "r0"), ("a", "4", "h4", "r4", False, None, "r0"), ("b", "9", "h", "r", False, None, "r0"), *(("c", str(i), "h", "r", False, None, "r0") for i in range(12))], cols)
    new = spark.createDataFrame([("a", "1", "h1", "r1", None), ("a", "2", "x", "y", None), ("a", "3", "h3", "r3", None), ("a", "5", "h5", "r5", None), ("a", "6", None, None, "answer: required"), ("c", "0", "h", "r", None)], "source_type string, id string, hash string, record string, errors string")
    table, changes = sync.upsert_sources(old, new, "r1", now, ["a", "c"])
    status = {(r["source_type"], r["id"]): r["status"] for r in changes.collect()}
    assert [status["a", str(i)] for i in range(1, 7)] == ["unchanged", "updated", "updated", "deleted", "created", "error"]
    assert status["b", "9"] == "not fetched" and status["c", "5"] == "refused" and status["c", "0"] == "unchanged"
    got = {(r["source_type"], r["id"]): r for r in table.collect()}
    assert ("a", "6") not in got and got["a", "4"]["deleted"] and not got["a", "3"]["deleted"] and got["a", "2"]["record"] == "y" and not got["c", "5"]["deleted"]
    assert got["a", "1"]["last_seen"] is not None and got["b", "9"]["last_run_id"] == "r0"
    assert sync.upsert_sources(old, new, "r1", now, ["a", "c"], allow_large=True)[0].where("deleted").count() == 12
    row = sync.run_row(changes, "r1", now, now, ["a", "c"], ["b"]).first()
    assert (row["created"], row["updated"], row["deleted"], row["refused"], row["error"], row["changed"], row["status"]) == (1, 2, 1, 11, 1, True, "partial")
    # again, nothing changes
    again = sync.upsert_sources(table, new.where("errors is null and source_type = 'a'"), "r2", now, ["a"])[1]
    assert {r["status"] for r in again.where("source_type = 'a'").collect()} == {"unchanged", "gone"}


def test_documents_and_chunks_through_a_run(spark):
    d = "document_id long, source_type string, source_id string, title string, content_hash string, is_active boolean"
    old = spark.createDataFrame([(1, "a", "s1", "t", "h1", True), (2, "a", "s1", "t", "h2", True), (3, "a", "s2", "t", "h3", True), (4, "a", "s1", "t", "h4", True)], d)
    new = spark.createDataFrame([(1, "a", "s1", "t", "h1"), (2, "a", "s1", "u", "x2"), (5, "a", "s1", "t", "h5")], d.rsplit(",", 1)[0])
    table, status = sync.upsert_documents(old, new, spark.createDataFrame([("a", "s1")], "source_type string, source_id string"))
    assert {r["document_id"]: r["status"] for r in status.collect()} == {1: "unchanged", 2: "updated", 3: "kept", 4: "retired", 5: "created"}
    assert {r["document_id"]: (r["title"], r["is_active"]) for r in table.collect()} == {1: ("t", True), 2: ("u", True), 3: ("t", True), 4: ("t", False), 5: ("t", True)}
    c = "document_id long, chunk_index int, content_hash string, v array<double>, model string"
    chunks = spark.createDataFrame([(1, 0, "a", [1.0], "m"), (2, 0, "b", [2.0], "m"), (2, 1, "c", [3.0], "m"), (4, 0, "d", [4.0], "m")], c)
    fresh = spark.createDataFrame([(2, 0, "c"), (2, 1, "z"), (5, 0, "b")], "document_id long, chunk_index int, content_hash string")
    got = {(r["document_id"], r["chunk_index"]): (r["v"], r["model"]) for r in sync.rewrite_chunks(chunks, fresh, status, "m").collect()}
    assert got == {(1, 0): ([1.0], "m"), (2, 0): ([3.0], "m"), (2, 1): (None, None), (5, 0): (None, None)}


def test_ebook_rules(spark):
    sections = [(1, "১।", "Head", "<p> </p>", None, [(2, "0", "only a heading", " ", None, []), (3, "২", None, "", None, [(4, None, "Schedule", "", "n", [])])], []), (5, "2", "empty", "", None, [], [])]
    rows = [(1, " ", "আইন", None, "৭", "2001-2-3", "গেজেট", "2020-01-02T03:04:05Z", "", "m.pdf", None, None, None, ["a ", "[]", ""], [" https://x.y ", "ftp://z"], sections), (2, None, None, None, None, None, None, None, None, None, None, "<p>" + "x" * 130 + "</p><p>b</p>", None, None, None, None), (3, None, "law", None, None, "৩.২.২০০১", None, "bad", None, None, None, None, None, None, None, [])]
    docs, units = normalize.ebook(spark.createDataFrame(rows, normalize.EBOOK), url="https://e/{id}")
    got = {r["source_id"]: r for r in docs.collect()}
    assert [got[i]["title"] for i in "123"] == ["আইন (নং ৭)", "x" * 120 + "…", "law #3"] and all(r["title_derived"] for r in got.values())
    assert [(got[i]["authority"], got[i]["role"], str(got[i]["publication_date"])) for i in "123"] == [(100, "appendix", "2001-02-03"), (90, "body", "None"), (90, "body", "2001-02-03")]
    assert got["1"]["file_url"] == "m.pdf" and got["1"]["url"] == "https://e/1" and got["1"]["keywords"] == ["a"] and got["1"]["links"] == ["https://x.y"] and got["1"]["source_updated_at"] and not got["3"]["source_updated_at"]
    assert [(r["kind"], r["unit_id"], r["number"]) for r in units.orderBy("path").collect()] == [("section", "1", "1"), ("subsection", "3", "2"), ("schedule", "4", None)]
    q = spark.createDataFrame([(1, "Q?", "A", None, None)], normalize.QNA)
    assert {r["source_type"] for r in normalize.normalize({"qna_type2": q, "ebook": spark.createDataFrame(rows, normalize.EBOOK)}).collect()} == {"qna_type2", "ebook"}
    with pytest.raises(ValueError):
        normalize.normalize({"wiki": q})


def test_answer_display(spark):
    cols = "query_id long, rank int, title string, doc_source_type string, source_type string, doc_source_id string, source_id string, doc_type string, year int, authority int, url string, file_url string, content string, section_number string, section_heading string, subsection_numbers array<string>, schedule_number string, clause_number string, role string"
    rows = [(1, 1, "T", "ebook", "section", "7", "8", "আইন", 2001, 100, "", "f.pdf", "a\nb" + "c" * 300, "5", "Head।", ["১", "৩"], None, None, None), (1, 2, "Q", "qna_type2", "qna", "9", "9", None, None, 75, "u", None, "x", None, None, None, None, None, None), (1, 3, "O", "ebook", "ebook", "7", "7", None, None, None, None, None, None, None, None, None, None, None, "toc")]
    out = answer.source_rows(spark.createDataFrame(rows, cols), F.lit(True))
    got = [r.asDict() for r in out.orderBy("index").collect()]
    assert [g["section"] for g in got] == ["ধারা ৫ — Head, উপ-ধারা ১–৩", None, "পরিচিতি ও সূচি"]
    assert [g["authority"] for g in got] == ["সরকারি আইনি দলিল (গেজেট)", "সরকারি প্রশ্নোত্তর", "ফোরাম আলোচনা (অযাচাইকৃত)"]
    assert len(got[0]["snippet"]) == 241 and got[0]["snippet"].startswith("a bcc") and got[0]["url"] == "f.pdf"
    assert answer.references(out).first()["text"].split("\n")[:4] == ["সূত্র:", "[১] T, ধারা ৫ — Head, উপ-ধারা ১–৩ (সরকারি আইনি দলিল (গেজেট))", "    f.pdf", "[২] Q (সরকারি প্রশ্নোত্তর)"]
    assert one(spark, "a [১][১] b 【2†L1-L5】 [9] c ［১］", lambda c: answer.cited_text(c, F.lit(3))) == "a [1] b [2]  c [1]"
    assert one(spark, "x", lambda c: answer.focus_note(F.lit("5"), F.lit(None).cast("string"), c)) == "ধারা/বিধি ৫, দফা (x)"
    both = one(spark, "a [1] b [2].", lambda c: F.struct(*answer.visible(c, F.array(*(F.struct(F.lit(i).alias("index"), F.lit(k).alias("source_type"), F.lit(x).alias("cited")) for i, k, x in ((1, "ebook", True), (2, "qna_type1", True), (3, "blog", False)))))))
    assert both[0] == "a [1] b ." and [s["index"] for s in both[1]] == [1]
    assert answer.fit_request(100, [50, 60, 70], None, None, 100) == (3, 100)
    # 9,300 characters are 3,100 tokens: 1,100 too many take 3,630 off; blocks of 1,000 fill the 5,370 that are left
    assert answer.fit_request(300, [1000] * 9, 2000, None, 800, budget=9000) == (5, 800)
    assert answer.fit_request(300, [1000] * 9, 2000, 2500, 1500, budget=9000) == (5, 734)
    # the floors: 1,500 characters of context, 512 tokens of output
    assert answer.fit_request(9000, [700] * 9, 500, 3000, 800) == (2, 512) and answer.fit_request(0, [], 500, None, 9) == (0, 9)


def test_memory_rules(spark):
    from siftline.operators import memory

    conv = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2023-01-01 00:00:00")], "conv_id string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    msg = spark.createDataFrame([("a", 1, "user", "x"), ("b", 1, "user", "y")], "conv_id string, turn int, role string, text string")
    now = F.lit("2024-01-10").cast("timestamp")
    kept, left = memory.purge_with_messages(conv, msg, now)
    assert [r["conv_id"] for r in kept.collect()] == [r["conv_id"] for r in left.collect()] == ["a"]
    c, m = memory.append(conv, msg, msg.where("conv_id = 'b'").withColumns({"turn": F.lit(2)}).unionByName(spark.createDataFrame([("z", 1, "user", "n")], msg.schema)), now)
    assert c.count() == 3 and m.count() == 4 and c.where("updated_at = '2024-01-10'").count() == 2
    t = memory.transcript(spark.createDataFrame([("a", 1, "user", "x" * 700), ("a", 2, "assistant", " b\n c ")], msg.schema), names=("U", "S")).first()["transcript"]
    assert t == "U: " + "x" * 600 + "…\nS: b c"
    for text, want in (('"new question?\nmore"', "new question?"), ("", "old"), ("INSUFFICIENT", "old"), ("x" * 500, "old"), (None, "old")):
        df = spark.createDataFrame([(text,)], "x string")
        assert df.select(memory.accept_rewrite(F.lit("q"), F.col("x"), F.lit("old"))).first()[0] == want


def test_provisions_by_title(spark):
    titles = spark.createDataFrame([(1, ["land", "crime", "act", "2023"]), (2, ["land", "crime", "act", "repealed"]), (3, ["tax", "act"])], "doc_id long, tokens array<string>")
    chunks = spark.createDataFrame([(10, 1, "5", 0, [], "(১) a"), (11, 1, "5", 1, ["2"], "b"), (12, 2, "5", 0, [], "c"), (13, 3, "6", 0, [], "d")], "id long, doc_id long, section string, chunk_index int, numbers array<string>, content string")
    q = "query_id long, section string, subsection string, clause string, year int, terms array<string>"
    rows = [(1, "5", None, None, None, ["land:*", "crim:*"]), (2, "5", "2", None, 2023, ["land:*", "crime:*", "act"]), (3, "6", None, None, None, ["land:*"]), (4, "5", None, None, None, []), (5, "5", "1", None, 2023, ["land:*"])]
    got = {}
    for r in retrieval.provision_lookup(spark.createDataFrame(rows, q), titles, chunks).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {1: [10, 11, 12], 2: [11, 10], 5: [10, 11]}


def test_lexical_weights_beginnings_and_authority(spark):
    docs = spark.createDataFrame([(1, ["land"], ["x"], 1), (2, ["x"], ["land", "x"], 1), (3, ["x"], ["landlord"], 5), (4, ["x"], ["landlord"], 9), (5, None, None, None)], "id long, title array<string>, body array<string>, authority int")
    asked = spark.createDataFrame([(1, "land:*"), (1, "landl:*"), (2, "land"), (3, "none")], "query_id long, term string")
    got = [(r["query_id"], r["id"]) for r in retrieval.lexical_topk(asked, docs).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 4), (1, 3), (1, 2), (2, 1), (2, 2)]


def test_vector_topk_blocks_and_odd_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((300, 8)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] + [1.0] * 7), (902, [1.0]), (903, [float("inf")] * 8), (904, [0.0] * 8), (905, x[3].tolist()), (906, x[3].tolist())]
    e = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    q = e.where("id % 10 = 3 or id > 899").withColumnRenamed("id", "query_id")
    u = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    want = {i: sorted(((-(round(float(u[i] @ u[j]), 6) + 0.0), j) for j in u if j != i))[:5] for i in u if i % 10 == 3 or i > 899}
    for block in (64 << 20, 400):
        got = {}
        for r in retrieval.vector_topk(q, e, 5, block_bytes=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
        assert {k: [j for _, j in v] for k, v in got.items()} == {k: [j for _, j in v] for k, v in want.items()}


def test_suggestions_against_all_texts(spark, monkeypatch):
    from siftline.functions import text as X2
    from siftline.operators import suggest

    monkeypatch.setattr(suggest, "BLOCK", 2)
    texts = spark.createDataFrame([(1, "Rights of the citizen", [1.0, 0.0]), (2, "lost deed", [0.0, 1.0]), (3, "Right", [0.6, 0.8]), (4, None, None), (5, "of lorries", None)], "id long, text string, v array<double>")
    typed = spark.createDataFrame([(1, "ights", None), (2, "of l", None), (3, "r", None), (4, "zzz", [0.6, 0.8]), (5, "RIGHT", [0.0, 1.0]), (6, "", None)], "query_id long, typed string, v array<double>")
    got = {}
    for r in suggest.suggest(typed, texts).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert got[1] == [(1, 0.85)] and got[2][0] == (5, 1.0) and (2, 0.3) in got[2] and got[4] == [(3, 0.8), (2, 0.64), (1, 0.48)] and got[5] == [(3, 1.0), (1, 1.0), (2, 0.8)]
    assert 3 not in got and 6 not in got
    # the same score as a Column
    both = typed.select("query_id", X2.lexical_text(F.col("typed")).alias("a")).crossJoin(texts.select("id", F.coalesce(X2.lexical_text(F.col("text")), F.lit("")).alias("b")))
    plain_ = {(r["query_id"], r["id"]): r["s"] for r in both.select("query_id", "id", suggest.lexical_score(F.col("a"), F.col("b")).alias("s")).collect()}
    assert plain_[1, 1] == 0.85 and plain_[2, 2] == 0.3 and plain_[2, 5] == 1.0


def test_long_texts_and_other_kinds(spark):
    act = "\n".join(f"{'১২৩৪৫৬৭৮৯'[i]}। শাস্তি{i}ঃ " + "কথা " * 30 for i in range(9))
    parts = chunk.long_text("preface\n" + act, 150, 120, 20, 5)
    assert [n for _, _, p in parts for n in p] == list("১২৩৪৫৬৭৮৯") and all(chunk.tokens(c) <= 150 for c, _, _ in parts) and parts[0][1] is None or parts[0][1]
    plain_ = chunk.long_text("A heading here\n" + "\n".join("sentence number %d goes on." % i * 3 for i in range(40)), 90, 60, 10, 5)
    assert plain_[0][1] is None and {h for _, h, _ in plain_[1:]} == {"A heading here"}
    rows = [("qna_type2", "1", "Q", "প্রশ্ন: Q\nউত্তর: A", "tax", None), ("qna_type1", "2", "Q", "প্রশ্ন: Q\nউত্তর: " + "long answer. " * 400, None, None), ("blog", "3", "B", "text", None, "me"), ("topic", "4", "T", " ", None, None), ("ebook", "5", "E", act, None, None)]
    got = chunk.chunk_documents(spark.createDataFrame(rows, "source_type string, source_id string, title string, body string, category string, author string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["source_id"], []).append(r)
    assert by["1"][0]["context"] == "সরকারি প্রশ্নোত্তর\nবিষয়শ্রেণি: tax" and len(by["2"]) > 1 and by["2"][1]["content"].startswith("উত্তর (অংশ 2): ") and "4" not in by and by["3"][0]["context"] == "ব্লগ: B\nলেখক: me"
    assert all(r["token_count"] <= 720 for r in got) and "প্রসঙ্গ: ১। শাস্তি0" in by["5"][0]["context"]
    with pytest.raises(Exception, match="unknown source type"):
        chunk.chunk_documents(spark.createDataFrame([("wiki", "x")], "source_type string, body string")).collect()


def test_evaluation_rules(spark):
    from siftline.operators import evaluate

    rows = [("ebook", "7", "subsection", "9", [("section", "8"), ("subsection", "9")], ["9", "10"]), ("blog", "1", "blog", "1", None, None)]
    df = spark.createDataFrame(rows, "doc_source_type string, doc_source_id string, source_type string, source_id string, path array<struct<type:string,id:string>>, covers array<string>")
    assert [set(r[0]) for r in df.select(evaluate.relevance_keys(df)).collect()] == [{"ebook:7", "subsection:9", "section:8", "subsection:10"}, {"blog:1"}]
    runs = spark.createDataFrame([(1.0, 1, 0.1, True, True), (0.5, 0, 0.3, True, False), (0.0, 0, 0.2, False, False)], "mrr double, hit_at_1 int, seconds double, answerable boolean, sufficient boolean")
    assert evaluate.run_summary(runs).first().asDict() == {"n": 3, "mrr": 0.75, "hit_at_1": 0.5, "p50_seconds": 0.2, "gate_pass_rate": 0.5, "gate_refusal_rate": 1.0}
    c = "title string, source_type string, source_id string, section_id string, section_number string, section_heading string, word string, subsection_numbers array<string>, covers array<string>, content string, chunk_index int"
    chunks = spark.createDataFrame([("T", "section", "1", "1", "5", "H।", "ধারা", [], [], "w " * 40, 0), ("T", "section", "2", "2", "6", "G", "ধারা", [], [], "short", 1), ("T", "subsection", "3", "2", "6", None, "ধারা", ["(১)", "(২)"], ["3", "4"], "x", 2)], c)
    got = {r["tag"]: r for r in evaluate.hierarchy_set(chunks, each=1).collect()}
    assert set(got) == {"h_section_by_number", "h_section_by_heading", "h_subsection_by_number", "h_passage"}
    assert got["h_passage"]["question"] == " ".join(["w"] * 22) and "উপ-ধারা ১" in got["h_subsection_by_number"]["question"] or "উপ-ধারা ২" in got["h_subsection_by_number"]["question"]


def test_question_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('// note\n\n{"question":"a","expected_source_ids":["x:1"]}\n{"id":"b"}\n')
    with pytest.raises(Exception, match="not a question"):
        read_questions(spark, str(tmp_path / "q.jsonl")).collect()
    (tmp_path / "q.jsonl").write_text('// note\n\n{"question":"a","expected_source_ids":["x:1"]}\n{"id":"b","question":"c","expected_source_ids":[]}\n')
    got = read_questions(spark, str(tmp_path / "q.jsonl"))
    assert [(r["id"], r["question"]) for r in got.collect()] == [("ex0", "a"), ("b", "c")]
    write_questions(got, str(tmp_path / "back"))
    assert read_questions(spark, str(tmp_path / "back")).collect() == got.collect()
    (tmp_path / "s.txt").write_text("# c\nHow  now\nhow now\nElse\n")
    assert sorted(r["question"] for r in read_suggestions(spark, str(tmp_path / "s.txt")).collect()) == ["Else", "How  now"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = rate_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM rates").collect())) == sorted(map(tuple, rate_windows(events).collect()))


def test_entry_imports():
    import __spark_entry__ as e

    assert "hybrid_topk" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_sections_keep_words_size_and_places(spark):
    word = iter(f"w{i}" for i in range(100_000))
    text = lambda n: " ".join(next(word) for _ in range(n))
    rows = [("1", [0], "section", "১।", "Short", text(5)), ("1", [1], "section", "2", "Long", "opening words")]
    rows += [("1", [1, j], "subsection", str(j), None, text(30)) for j in range(1, 9)]
    rows += [("1", [1, 9], "subsection", "9", None, "lead"), ("1", [1, 9, 0], "schedule", "a", None, text(200)), ("1", [1, 9, 1], "subschedule", None, "Schedule", None)]
    rows += [("1", [2], "section", None, None, None), ("1", None, "section", None, None, "placeless"), ("9", [0], "section", "1", "orphan", "x")]
    units = spark.createDataFrame(rows, "source_id string, path array<int>, kind string, number string, heading string, content string")
    docs = spark.createDataFrame([("1", "Act"), ("2", "Alone"), ("3", None), (None, "n")], "source_id string, title string")
    got = sections.chunk_units(docs, units, target=120, most=180, overlap=20, least=10).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.role, r.content) for r in got if r.id != "1"] == [("2", "overview", "Alone")]
    one = [r for r in got if r.id == "1"]
    assert [r.chunk_index for r in one] == list(range(len(one)))
    assert one[0].role == "overview" and one[0].content == "১ Short\n2 Long"
    # joined parts may bring a tag of the numbers that they hold
    assert all(r.token_count <= 180 + 12 for r in one)
    body = " ".join(r.content for r in one if r.role == "body").split()
    assert {w for r in rows[:-1] for w in (r[5] or "").split()} <= set(body)
    assert all(r.context.startswith("দলিলের নাম: Act") for r in one)
    deep = [r for r in one if any(c.startswith("1.9") for c in r.covers)]
    assert any("দফা a" in r.context and "উপ-ধারা: 9" in r.context and "ধারা: 2 — Long" in r.context for r in deep)
    assert any("প্রারম্ভিক অংশ:" in r.context for r in one) and any("উপ-তফসিল — Schedule" in r.content for r in one)
    assert len({r.content_hash for r in one}) == len(one)


def test_last_wins_aggregates_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, None, None), (4, "b", 1), (5, "b", 3), (6, "b", 2)], "id long, k string, o int")
    out = sync.last_wins(rows, "k", F.col("o"))
    assert sorted(map(tuple, out.collect())) == sorted([(2, "a", 5, 1), (3, None, None, 0), (5, "b", 3, 2)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan


def test_spread_deals_out_small_tables_only(spark, tmp_path):
    from siftline.plans import spread

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/few")
    spark.range(100).repartition(8).write.parquet(f"{tmp_path}/many")
    few, many = spark.read.parquet(f"{tmp_path}/few"), spark.read.option("mergeSchema", False).parquet(f"{tmp_path}/many")
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread(few).collect()) == list(range(100))
    assert many.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism or spread(many) is many
