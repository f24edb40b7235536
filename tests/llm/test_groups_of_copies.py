"""Exact dedup, hard negatives and spelling variants against brute force, and on rows of every odd kind."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import exactdup, negatives, spelling
from siftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 9000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "Same"), (4, "Same"), (4, "Same"), (5, "same"), (6, "Same "), (None, "Same"), (None, "alone"), (None, "alone"), (7, LONG), (8, LONG), (9, "é"), (10, "é"), (11, "Same"), (11, "other")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "n": F.lit(2), "keep_id": F.lit(3), "word": F.lit("x"), "kept": F.lit(False)})


# 11

def plain_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def copies(df, **options):
    return sorted(map(tuple, exactdup.exact_copies(df, **options).drop("h").collect()), key=repr)


@pytest.mark.parametrize("digest", [exactdup.md5_bytes, lambda text: F.substring(F.unhex(F.md5(text)), 1, 0), lambda text: F.unhex(F.hex(F.length(text) % 2))])
def test_copies_are_told_by_bytes(odd, digest):
    """Also where all hashes, or half of them, are alike."""
    assert copies(odd, digest=digest) == plain_copies([tuple(r) for r in odd.select("doc_id", "text").collect()])


def test_copies_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert copies(docs) == plain_copies([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_copies_of_nothing(odd):
    assert copies(odd.where("false")) == []


def test_a_hot_group_moves_once_a_task(spark):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a copy").otherwise(F.col("id").cast("string")).alias("text"))
    got = exactdup.exact_copies(many).groupBy("kept", "group_size").count().collect()
    assert {(r["kept"], r["group_size"], r["count"]) for r in got} == {(True, 1, 10_000), (True, 20_000, 1), (False, 20_000, 19_999)}


def test_copies_use_no_python(odd):
    plan = exactdup.exact_copies(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 12

def plain_negatives(rows, anchor, n_positives=5, n_negatives=3, low=50, high=95):
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, tuple(math.floor(256 * x) for x in v))
        ok[i] = min(ok.get(i, own), own)
    out = []
    for a, (label, v) in ok.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, m) for i, (m, w) in ok.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:n_positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:n_negatives]
            out += [(a, p, k, x[1], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


def test_negatives_are_those_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 19))
    rows = [(i, int(rng.integers(3)), (centre[i % 6] + 0.4 * rng.normal(size=19)).tolist()) for i in range(700)]
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(60)]  # ties
    rows += [(2000, None, rows[1][2]), (2005, 1, None), (2010, 1, [None] * 19), (2015, 1, [math.nan] * 19), (2020, 1, [math.inf] * 19), (None, 1, rows[2][2]), (2025, 1, []), (2030, 1, [1e308] * 19)]
    rows += [(3000 + i, i % 2, [1.0, 2.0, float(i)]) for i in range(12)]  # another length
    rows += [(4000 + i, i % 2, [0.0] * 5) for i in range(8)]  # no direction: scores of 0
    rows += [(4100 + i, i % 2, [-1.0 - i, 0.0, 0.0, 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"cell": F.lit(1), "kind": F.lit(2), "v": F.lit(3), "k": F.lit(4), "score": F.lit(5)})
    want = plain_negatives([r for r in rows if r[0] != 2030], lambda i: i % 5 == 0)
    for size in (20_000, 40):  # one group of anchors and many
        monkeypatch.setattr(negatives, "ANCHORS", size)
        assert sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect())) == want
    assert len(want) > 500
    assert negatives.hard_negatives(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0
    assert negatives.hard_negatives(df.where("label = 1"), F.col("vec_id") % 5 == 0).count() == 0


def test_repeated_rows_are_one_row(spark):
    rows = [(i, i % 2, [1.0, i / 8.0]) for i in range(8)]
    df = spark.createDataFrame(rows * 3, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, negatives.hard_negatives(df, F.lit(True)).collect())) == plain_negatives(rows, lambda i: True)


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [1e9 + i, 3e8 * (i + 1), -1.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.hard_negatives(df, F.lit(True), high=100, scale=1)
    want = [r for r in plain_scaled(rows)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plain_scaled(rows):
    return plain_negatives([(i, m, [x / 256 for x in v]) for i, m, v in rows], lambda i: True, high=100)


def test_bounds_hold_at_each_level():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (50, 21)).astype(float)
    t = pa.table({"vec_id": list(range(50)), "label": [0] * 50, "dim": [21] * 50, "v": [b"\x02" + r.astype("<i2").tobytes() for r in x], "summary": [r.tobytes() for r in negatives.summaries(x)]})
    b = negatives.Block(t)
    i, j = (k.ravel() for k in np.meshgrid(np.arange(50), np.arange(50)))
    true, last = (x[i] * x[j]).sum(1), np.inf
    assert len(b.levels) == 4
    for level in range(4):
        low, high = negatives.bounds(b, i, b, j, level, least=True), negatives.bounds(b, i, b, j, level)
        tile = np.arange(50)
        assert np.allclose(negatives.bounds(b, tile[:, None], b, tile[None, :], level).T.ravel(), high)
        assert (low <= true).all() and (true <= high).all()
        assert (high - low).sum() < last  # finer segments bound more tightly
        last = (high - low).sum()
    assert (negatives.exact(b, i, b, j) == true).all()


# 13

def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_variants(rows):
    n = plain_words(rows)
    by = defaultdict(set)
    for w in n:  # each pair of near words has a common word with one code point out
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
        by[w].add(w)
    close = {w: set() for w in n}
    for own in by.values():
        for a, b in itertools.combinations(own, 2):
            if near(a, b):
                close[a].add(b)
                close[b].add(a)
    form = {}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def told(df, **options):
    return sorted((tuple(r) for r in spelling.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("leaf_bytes", [spelling.LEAF_BYTES, 30_000])
def test_variants_are_those_of_brute_force(spark, leaf_bytes):
    """In one leaf a length, and in shared trees of many."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert told(docs, leaf_bytes=leaf_bytes) == want
    assert sum(r[1] is not None for r in want) > 100


def test_variants_of_odd_rows(spark):
    long = "ab" * 40_000
    rows = [(1, "Ärztliche ärztliche ÄRZTLICHE"), (2, None), (3, ""), (None, "letters letters letterz"), (None, "letterz"), (4, "straße×÷ " * 3), (5, f"{long} {long} {long}x {long}x"), (6, "letters " * 50), (6, "letters " * 50), (7, "aaaaaaa aaaaaaa aaaaaab aaaaaab aaaaaaaa aaaaaaaa naïveté naïveté naivete naivete"), (8, "x1y2 short 漢字漢字漢字漢字")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "cell": F.lit(3), "root": F.lit("r"), "form": F.lit("f")})
    want = plain_variants(rows)
    assert told(df) == want and told(df, leaf_bytes=400) == want
    assert {r[0] for r in want} >= {"letters", "letterz", "straße×÷", long}
    assert told(df.where("false")) == []


def test_forms_are_followed_to_the_last(spark):
    words = {"abcdefgh": 2, "abcdefgi": 20, "abcdefji": 200, "abcdekji": 2000}
    rows = [(1, " ".join(w for w, k in words.items() for _ in range(k)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.variants(df, noise=1 << 40).collect()
    assert {r["word"]: (r["form"], r["root"]) for r in got} == {"abcdefgh": ("abcdefgi", "abcdekji"), "abcdefgi": ("abcdefji", "abcdekji"), "abcdefji": ("abcdekji", "abcdekji"), "abcdekji": (None, "abcdekji")}


def test_trees_lose_no_near_word():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), 9)) for _ in range(4000)]
    words = sorted(set(words))
    counts = spelling.counts_of(spelling.letters_of(words))
    tree = spelling.Tree(counts, 20)
    home = tree.leaf_of(counts)
    assert all((home[at] == k).all() for k, at in enumerate(tree.leaves)) and len(tree.leaves) > 50
    who, leaf = tree.reach(counts, 1, 1)
    met = set(zip(who.tolist(), leaf.tolist()))
    far = np.abs(counts[:, None, :].astype(int) - counts[None, :300, :]).sum(2) <= 2
    assert all((i, home[j]) in met for i, j in zip(*np.nonzero(far)))
    assert len(met) < 0.6 * len(words) * len(tree.leaves)  # and prune


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_spelling_variants"])
def test_queries(spark, name):
    df = QUERIES[name](spark, SF)
    if name.startswith("op12"):
        rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
        assert sorted(map(tuple, df.collect())) == plain_negatives(rows, lambda i: i % 50 == 0)
    else:
        assert sorted((tuple(r) for r in df.collect()), key=repr) == plain_variants([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
