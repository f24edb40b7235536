"""The ten operators and the pipeline against brute force, the libraries, and rows of every odd kind."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import common, components, decontaminate, embeddup, langid, licences, linededup, minhash, ngramlm, pieces, quality, tokencount
from siftline.llm.common import crc_mod, crc_mod_py
from siftline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 9000
#: Null and repeated ids, null, empty and blank texts, ties, a long text, columns that clash with the operators' own.
ODD = [(1, None, "en", 1), (2, "", "en", 2), (None, "alone with no id here", None, 3), (4, " \n\t ", "fr", 4), (5, LONG, "en", 5), (6, "a b c d e f g", "en", 6), (6, "a b c d e f g", "en", 6), (7, "A  b c\nd e f g", "de", 7), (8, "漢字 🙂 ß ▁ \x00", None, 8), (9, "x", "en", 9)]
SCHEMA = "doc_id long, text string, lang string, score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"mark": F.lit(1), "node": F.lit(2), "block": F.lit(3), "row": F.lit("x"), "train": F.lit(False)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    told = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(told)


# 1

@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(open(P.path("piece_bpe_32k.model"), "rb").read())


def ids(model, text):
    return np.frombuffer(model.encode(text), "<i4").tolist()


def test_pieces_are_the_librarys(docs, odd, model):
    for r in docs.select("text").collect() + odd.select("text").collect():
        assert ids(model, r["text"] or "") == model.sp.encode(r["text"] or "")


def test_streaming_window_is_bounded(model):
    text = model.sp.normalize(LONG.replace(" ", "") + "é漢" * 500)
    want = model.sp.encode(LONG.replace(" ", "") + "é漢" * 500)
    assert list(model.search(text)) == want
    assert model.widest <= 8 * model.longest


def test_unigram_lattice_takes_the_best_sum(model):
    """The same pieces and scores read as a unigram model: the stream finds what a full table finds."""
    try:
        model.bpe = False
        text = model.sp.normalize("the hand of nations, and other things")
        best = [(0.0, [])]
        for end in range(1, len(text) + 1):
            best.append(max(((best[s][0] + model.score[k], best[s][1] + [k]) for s in range(max(0, end - 16), end) if (k := model.ids.get(text[s:end])) is not None), key=lambda x: x[0]))
        got = list(model.search(text))
        assert sum(model.score[k] for k in got) == pytest.approx(best[-1][0])
    finally:
        model.bpe = True


def test_round_trip(spark, docs, odd, empty):
    path = P.path("piece_bpe_32k.model")
    assert pieces.round_trip(docs, path).where("not round_trip").count() == 0
    got = {r["doc_id"]: r for r in pieces.round_trip(odd, path).collect()}
    assert len(got) == 9 and got[1]["n_pieces"] == 0 and not got[8]["round_trip"] and got[5]["round_trip"]
    back = pieces.decode(pieces.encode(docs, path), path).join(docs.withColumnRenamed("text", "t"), "doc_id")
    assert back.where("text <> t").count() == 0
    assert pieces.round_trip(empty, path).count() == 0


# 2

def words_of(text):
    """Words between blanks, A-Z lower-cased, and the end."""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [" "]


def plain_lm(rows, held_out, order, k):
    """(id, log10 probability, base, tokens, known tokens) of each row by dictionaries of word tuples; training tokens."""
    toks = [(i, words_of(t)) for i, t in rows]
    train = [t for i, t in toks if not held_out(i)]
    count = Counter(tuple(t[i : i + n]) for t in train for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total, types = sum(map(len, train)), sum(len(g) == 1 for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 1) / (total + types + 1)
        return (count[gram] + k[len(gram) - 2] * p(gram[1:])) / (count[gram[:-1]] + k[len(gram) - 2])

    out = [(i if i is not None else -1, sum(np.log10(p(tuple(t[max(0, j - order + 1) : j + 1]))) for j in range(len(t))), sum(np.log10(p((w,))) for w in t), len(t), sum(count[(w,)] > 0 for w in t)) for i, t in toks]
    return sorted(out), total


def told_lm(df):
    got = df.collect()
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["score"], r["base_score"], r["n_tokens"], r["n_known"]) for r in got), {r["train_tokens"] for r in got}


@pytest.mark.parametrize(("order", "k", "block", "cell", "fan", "region"), [(2, (5.0,), 20_000, 1 << 22, 12, 1024), (3, (7.0, 5.0), 1 << 22, 1 << 22, 12, 1024), (3, (6400.0, 5.0), 20_000, 500, 2, 3), (4, (5.0, 3.0, 1.0), 9_000, 400, 1, 2)])
def test_lm_against_a_plain_model(spark, docs, odd, monkeypatch, order, k, block, cell, fan, region):
    """Also where cells are so many that blocks ask through regions, on two and on several levels."""
    for name, value in (("CELL_GRAMS", cell), ("FAN", fan), ("REGION", region), ("LANE", 100)):
        monkeypatch.setattr(ngramlm, name, value)
    rows = docs.select("doc_id", "text").limit(60).collect() + odd.select("doc_id", "text").collect()
    want, total = plain_lm(rows, lambda i: crc_mod_py(i, 7) == 2, order, k)
    table = odd.select("doc_id", "text").limit(0).unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({"block": F.lit(1), "asker": F.lit(2), "train": F.lit(True), "cell": F.lit(3), "ids": F.lit("x")})
    have, totals = told_lm(ngramlm.score_texts(table, lambda c: crc_mod(c, 7) == 2, order=order, k=k, block_bytes=block))
    assert [(w[0], *w[3:]) for w in want] == [(h[0], *h[3:]) for h in have]
    assert np.allclose([w[1:3] for w in want], [h[1:3] for h in have])
    assert totals == {total}


def test_lm_gives_probabilities_that_add_up_to_one():
    """After each history of the texts, and after ones that were never seen."""
    texts = ["a b c a b d", "a b c", "b c a b c d", "d"]
    vocabulary = sorted({w for t in texts for w in words_of(t)})
    asks = [[*h, w] for h in ([], ["a"], ["a", "b"], ["c", "d"], ["d", "d"], ["b", "zz"]) for w in [*vocabulary, "new"]]
    number = {w: i for i, w in enumerate(sorted({w for t in [*map(words_of, texts), *asks] for w in t}))}
    all_ = [*map(words_of, texts), *asks]
    gram, count, grams = {}, Counter(), []
    for n in (1, 2, 3):
        row = []
        for i, t in enumerate(all_):
            for j in range(len(t)):
                g = tuple(t[j : j + n])
                row.append(gram.setdefault(g, len(gram)) if len(g) == n else -1)
                count[g] += i < len(texts) and len(g) == n
        grams.append(np.array(row)[: len(row) - n + 1])
    counts = np.array([count[g] for g in gram])
    total, types = sum(len(words_of(t)) for t in texts), len(vocabulary)
    made = ngramlm.Automaton(grams, counts, (3.0, 2.0), total, types)
    score = made.score(grams[0], np.array(list(map(len, all_))))
    assert number and len(score) == len(all_)
    for at in range(len(texts), len(all_), len(vocabulary) + 1):
        h = all_[at][:-1]
        before = made.score(np.array([gram[(w,)] for w in h], np.int64), np.array([len(h)]))[0] if h else 0.0
        assert sum(10 ** (score[at : at + len(vocabulary) + 1] - before)) == pytest.approx(1.0)


def test_lm_runs_a_text_alike_in_one_lane_and_in_many(docs, monkeypatch):
    words, size = ngramlm.tokens([r["text"].encode() for r in docs.limit(30).collect()])
    grams, own = ngramlm.numbered(ngramlm.Keys(10_000, 3)(words, size))
    counts = np.bincount(np.concatenate([g[g >= 0] for g in grams]), minlength=len(own)) // 2
    made = ngramlm.Automaton(grams, counts, (9.0, 4.0), len(words), 1000)
    want = made.score(grams[0], size)
    monkeypatch.setattr(ngramlm, "LANE", 3)
    assert np.allclose(made.score(grams[0], size), want)


def test_lm_beats_the_base(spark, docs, empty):
    held = ngramlm.score_texts(docs, lambda c: crc_mod(c, 7) == 2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    assert ngramlm.score_texts(empty, lambda c: crc_mod(c, 7) == 2).count() == 0


def test_word_hashes_tell_words_apart():
    span = common._SPAN
    for texts in ([b"The cat\tsat  on THE mat ", b"", b" \n ", b"cat" * 3 + b" x", b"the"], [b"a b" + b"q" * (3 * span + 5) + b" c", b"b" + b"q" * (3 * span + 5)]):
        got, size = common.word_hashes(texts)
        words = [w for t in texts for w in t.lower().split()]
        assert size.tolist() == [len(t.split()) for t in texts]
        known = {}
        assert all(known.setdefault(w, h) == h for w, h in zip(words, got.tolist())) and len(set(known.values())) == len(known)


# 3

def test_licences(spark, odd, empty):
    mit = licences.TEMPLATES["MIT"][2]
    rows = [(1, "some words\nReleased under the  MIT license\nmore"), (2, mit.upper()), (3, "Copyright me\n\n" + mit.replace("free of charge", "gratis") + "\n\ncode"), (4, "nothing of the kind here"), (5, "x\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (6, "a b c " * 5000)]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 4: [], 5: ["CC-BY-NC-4.0", "MIT"], 6: []}
    assert licences.scan(odd).where("size(licences) > 0").count() == 0 and licences.scan(empty).count() == 0


def test_licence_pruning_loses_nothing(docs):
    known = licences.Templates(licences.TEMPLATES, 0.5)
    for text in [r["text"] for r in docs.select("text").collect()] + [t for ts in licences.TEMPLATES.values() for t in ts]:
        for line in text.split("\n"):
            own = licences.bigrams(licences.words(line.encode()))
            best = max((2 * len(own & g) / (len(own) + len(g)) for _, g in known.all), default=0) if own else 0
            got = known.best(licences.words(line.encode()))
            assert (got[0] if got else 0) == (best if best >= 0.5 else 0)


def test_licences_inside_documents():
    known = licences.Templates(licences.TEMPLATES, licences.THRESHOLD)
    mit, gpl = licences.TEMPLATES["MIT"][2], licences.TEMPLATES["GPL-3.0"][1]
    prose = "some other words that stand around it without end " * 40
    parts = mit.replace(": The above", ":\n\nThe above").replace(". THE SOFTWARE", ".\n\nTHE SOFTWARE")
    wrapped = re.sub(r"((?:\S+ ){8})", r"\1\n", gpl.replace("This program is distributed", "\n\nThis program is distributed"))
    for text, name in ((f"{prose}\nCopyright me\n\n{parts}\n\n{prose}", "MIT"), (f"{prose}\n# Copyright me\n{wrapped}\n{prose}", "GPL-3.0"), ("This project is maintained by volunteers. Released under the MIT License. See the file for details.", "MIT"), (wrapped.replace("version 3", "version 2"), "GPL-2.0")):
        assert list(known.scan(text.encode())) == [name]
    # a less like notice isn't hidden by its template's better likeness to another licence's notice
    two = "This work is licensed under the GNU General Public License, version 3.\nwords between\nThis piece is licensed under the GNU General Public License, version 2."
    assert sorted(known.scan(two.encode())) == ["GPL-2.0", "GPL-3.0"]
    assert known.scan(b"Released under the MIT License. " * 20_000) == {"MIT": 1.0}


def test_licence_stretches_against_all_runs_of_words():
    rng = np.random.default_rng(5)
    known = licences.Templates({"x": ["a b c d e f", "c a b"], "y": ["b c d a a b e"]}, 0.8)
    for _ in range(300):
        w = [b"abcdefg"[i : i + 1] for i in rng.integers(0, 7, rng.integers(0, 25))]
        runs = [licences.bigrams(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
        best = max((2 * len(r & g) / (len(r) + len(g)) for r in runs for _, g in known.all), default=0)
        assert max(known.scan(b" ".join(w)).values(), default=0) == (best if best >= 0.8 else 0)


def plain_licences(w, templates, threshold):
    """The best run of words of all, then the best that shares no word with those before; equal ones: the longer, then by name."""
    grams, taken, out = list(zip(w, w[1:])), [], {}
    known = [(name, {*zip(t, t[1:])}) for name, ts in templates.items() for t in (licences.words(x.encode()) for x in ts)]
    while True:
        found = []
        for name, own in known:
            for i in range(len(grams)):
                best = None
                for j in range(i, len(grams)):
                    if j > i and grams[j] == grams[i] or any(i <= b + 1 and j + 1 >= a for a, b in taken):
                        break
                    run = set(grams[i : j + 1])
                    dice = 2 * len(run & own) / (len(run) + len(own))
                    if best is None or dice > best[0]:
                        best = (dice, j)
                if best and best[0] >= threshold and grams[i] in own:
                    found.append((-best[0], i - best[1], name, i, best[1]))
        if not found:
            return out
        dice, _, name, i, j = min(found)
        out.setdefault(name, -dice)
        taken.append((i, j))


def test_licence_names_are_those_of_all_runs_of_words():
    """Also where two licences are equally like."""
    rng = np.random.default_rng(7)
    for templates in ({"x": ["a b c d e f", "c a b"], "y": ["b c d a a b e"]}, {"one": ["a b c", "d e f g"], "another": ["a b c"], "third": ["c b a d"]}):
        known, seen = licences.Templates(templates, 0.8), set()
        for _ in range(250):
            w = [b"abcdefg"[i : i + 1] for i in rng.integers(0, 7, rng.integers(0, 25))]
            told = known.scan(b" ".join(w))
            assert told == pytest.approx(plain_licences(w, templates, 0.8))
            seen.update(told)
        assert seen
    assert list(licences.Templates({"one": ["a b c"], "another": ["a b c"]}, 0.8).scan(b"x a b c y")) == ["another"]


# 4

def test_quality(spark, docs, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    trained = quality.learn(d, labels)
    r = quality.score(d, trained).join(labels, "doc_id").where(crc_mod(F.col("doc_id"), 4) == 2).agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.9 and 0 <= r[1] <= r[2] <= 1
    plain = odd.select("doc_id", "text")
    assert quality.score(plain, trained).where("score between 0 and 1").count() == len(ODD)
    none = quality.learn(plain, spark.createDataFrame([], "doc_id long, quality int"))
    assert {x["score"] for x in quality.score(plain, none).collect()} == {0.5}
    assert quality.score(empty.select("doc_id", "text"), trained).count() == 0


# 5

def test_token_counts(spark, docs, odd, empty):
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    extra = [(100, "a<|endoftext|>b"), (101, "x\t y \n\n z  \n"), (102, LONG + " \n" * 300 + "<|endoftext|>" + "q" * 3000)]
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = tokencount.count_tokens(table, path).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False))) for r in table.collect()]
    assert sorted(((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got)) == sorted((i or -1, b, n) for i, b, n in want)
    assert tokencount.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(16384, 256), (700, 64), (90, 10), (64, 64)])
def test_splices(docs, chunk, overlap):
    c = tokencount.Counter(open(P.path("byte_bpe_50k.json")).read())
    text = "\n".join(r["text"] for r in docs.limit(8).collect()) + " " * 500 + "z" * 700 + "<|endoftext|>" + "\n \n" * 99 + "don't  stop"
    assert c.huge(text, chunk, overlap) == c.plain([text])[0]


# 6

def test_decontamination_blocks_and_odd_rows(spark, docs, odd, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, None), (901, "b C d"), (None, "x"), (902, "")], "item_id long, text string"))
    one = decontaminate.digest(decontaminate.find(docs.union(docs.limit(3)), items)).collect()
    many = decontaminate.digest(decontaminate.find(docs.union(docs.limit(3)), items, block_bytes=2000)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    got = {r["doc_id"]: r for r in decontaminate.find(odd, items).collect()}
    assert got[6]["items"] == ["901"] and [tuple(s) for s in got[6]["spans"]] == [(1, 4)] and got[7]["items"] == ["901"] and not got[1]["spans"]
    assert decontaminate.find(empty, items).count() == 0
    assert decontaminate.digest(decontaminate.find(odd, items.limit(0))).where("contaminated").count() == 0
    assert decontaminate.offsets("Ab, çd é".encode(), [(1, 3)]) == [(4, 10)]


# 7

def sets_of(rows, n):
    out = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def groups_by_brute_force(rows, n, threshold):
    sets, up = sets_of(rows, n), {}
    find = lambda i: i if up.setdefault(i, i) == i else find(up[i])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows if i is not None}


def test_near_duplicates(spark, docs, odd, empty):
    base = "w" + " w".join(map(str, range(200)))
    near = [(1000 + i, base.replace(f"w{i} ", f"v{i} ") if i % 3 else base.replace(f"w{7 * i} ", "").replace(f"w{7 * i + 5} ", "u ")) for i in range(1, 29)]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + near + [(i + 5000, t) for i, t, *_ in ODD if i]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=85).collect()
    want = groups_by_brute_force(rows, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == dict(zip([i for i, _ in rows], map(len, sets_of(rows, 3))))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(odd).collect()}
    assert got[None]["component_id"] is None and got[None]["kept"] and got[1]["component_id"] == 1 and got[1]["n_shingles"] == 0 and got[7]["component_id"] == 6
    assert minhash.near_duplicates(empty).count() == 0


def test_large_nodes_and_blocks(spark, monkeypatch):
    """Small limits make every path run: branching, leftover nodes, groups in blocks."""
    monkeypatch.setattr(minhash, "LEAF", 3)
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 7)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if (j * 31 + i * 17) % 97 > 2 else f"{w}x{i}" for j, w in enumerate(words))) for i in range(60)]
    rows += [(100 + i, " ".join(f"q{i}z{j}" for j in range(60))) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, threshold=95).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups_by_brute_force(rows, 1, 95)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (300, 300), (None, 1), (2, 1)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 300: 300}


# 8

def test_language_id(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.97 and 0 <= got[1] <= got[2] <= 1
    kinds = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert kinds[1] == kinds[2] == kinds[4] == "und" and set(kinds.values()) <= {"en", "fr", "de", "und"}
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd.select("doc_id", "text"), langid.learn(odd.limit(0))).collect()} == {"und"}


def test_profiles_by_hand():
    owner, gram, alphabet, some = langid.trigrams(["Ab a", "1 2", ""])
    assert some.tolist() == [True, False, False]
    (first, last, counts, kinds), = langid.tables(owner, gram, alphabet, 0, 3)
    v = langid.trigram_vectors(kinds, 64)
    letter = {c: langid._letter_vector(c, 64) for c in (0, 97, 98)}
    want = sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in ((0, 97, 98), (97, 98, 0), (0, 97, 0)))
    assert (first, last) == (0, 3) and (counts[0] @ v == want).all()


def plain_languages(rows, dim=langid.DIM):
    """id to (label, cosine) from rows (id, text, lang): bundles added up trigram by trigram, compared one by one."""
    def bundle(text):
        spaced = " ".join("".join(c if c.isalpha() else " " for c in f" {text or ''} ").split(" "))
        low = [c.lower() if len(c.lower()) == 1 and c.lower().isalpha() else c for c in re.sub(" +", " ", spaced)]
        grams = Counter(zip(low, low[1:], low[2:]))
        v = np.zeros(dim)
        for (a, b, c), n in grams.items():
            if b != " ":
                x, y, z = (langid._letter_vector(0 if ch == " " else ord(ch), dim).astype(float) for ch in (a, b, c))
                v += n * np.roll(x, 2) * np.roll(y, 1) * z
        return v

    sums = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and crc_mod_py(i, 4) != 2:
            sums[lang] = sums.get(lang, 0) + bundle(text)
    sums = {k: v for k, v in sums.items() if v.any()}
    out = {}
    for i, text, _ in rows:
        v = bundle(text)
        cos = {k: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for k, s in sums.items()} if v.any() else {}
        best = max(sorted(cos), key=cos.get, default="und")
        out[i] = (best, max(0.0, cos.get(best, 0.0)), sorted(cos.values())[-2:] if len(cos) > 1 else [0, 1])
    return out


@pytest.mark.parametrize(("langs", "cells"), [(1000, 4_000_000), (2, 20_000)])
def test_languages_against_plain_bundles(spark, docs, odd, monkeypatch, langs, cells):
    """Also with prototypes in blocks, and with tables so small that texts are counted in halves."""
    monkeypatch.setattr(langid, "LANGS", langs)
    monkeypatch.setattr(langid, "_CELLS", cells)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.limit(120).collect()] + [(9000 + i, t, lang) for i, t, lang, _ in ODD if i not in (None, 5, 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "trigrams": F.lit(2), "v": F.lit(3), "i": F.lit(4)})
    got = {r["doc_id"]: r for r in langid.identify(table).collect()}
    for i, (lang, cos, two) in plain_languages(rows).items():
        assert got[i]["score"] == pytest.approx(cos, abs=1e-5)
        assert got[i]["lang_pred"] == lang or two[-1] - two[-2] < 1e-5


def test_many_short_texts_of_a_large_script_take_little_memory():
    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 100))) for _ in range(10_000)]
    tracemalloc.start()
    done = 0
    for part in (texts[i : i + 3400] for i in range(0, 10_000, 3400)):
        owner, gram, alphabet, _ = langid.trigrams(part)
        for first, last, counts, kinds in langid.tables(owner, gram, alphabet, 0, len(part)):
            assert counts.size <= langid._CELLS
            done += int(counts.sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == 100 * 10_000 and peak < 500 << 20


# 9

def test_line_dedup(spark, odd, empty):
    rows = [(i, f"Head\n line {i}\n\tHEAD \nx") for i in range(10)] + [(20, None), (21, ""), (22, "head"), (None, "head\nown"), (3, "x\nother")]
    got = linededup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert by[0] == [(" line 0", 4, 3)] and by[20] == by[21] == [("", 1, 0)] and by[22] == [("", 1, 1)] and by[None] == [("own", 2, 1)]
    assert sorted(by[3]) == [(" line 3", 4, 3), ("other", 2, 1)]
    assert linededup.drop_common_lines(odd).count() == len(ODD) and linededup.drop_common_lines(empty).count() == 0


# 10

def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[100:140] = x[0] + 0.12 * rng.standard_normal((40, 16))
    x[140:150] = x[5]
    x[150] = 3 * x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] + [1.0] * 15), (404, []), (405, [1.0]), (406, x[5].tolist()), (406, x[5].tolist())]
    got = {r["vec_id"]: r for r in embeddup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=0.99999, bits=4).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    u = np.vstack([u, u[5]])
    ids_ = [*range(300), 406]
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert [got[i]["n_links"] for i in ids_] == near.sum(1).tolist()
    up = {i: i for i in ids_}
    for _ in range(10):
        for a in range(len(u)):
            m = min([up[ids_[a]], *(up[ids_[b]] for b in np.flatnonzero(near[a]))])
            up[ids_[a]] = m
    assert {i: got[i]["component_id"] for i in ids_} == up
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(400, 406))
    assert embeddup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_links(rows, threshold=0.9):
    """(links, component) of each row (id, vector) by its own vector: all pairs of distinct vectors, ids counted once each."""
    classes = {}
    for i, v in rows:
        classes.setdefault(tuple(map(float, v)), set()).add(i)
    vectors = list(classes)
    u = [np.array(v) / np.linalg.norm(v) for v in vectors]
    near = [[len(a) == len(b) and a @ b >= threshold for b in u] for a in u]
    up = [min(classes[v]) for v in vectors]
    for _ in vectors:
        up = [min(up[j] for j in range(len(up)) if near[i][j]) for i in range(len(up))]
    at = {v: k for k, v in enumerate(vectors)}
    return [(i, sum(len(classes[vectors[j]]) for j in range(len(u)) if near[k][j]) - 1, up[k]) for i, v in rows for k in [at[tuple(map(float, v))]]]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_in_blocks_and_repeated_ids(spark, monkeypatch, kind):
    """Buckets in many pairs of blocks, ids that repeat with other vectors, two lengths, columns that clash."""
    monkeypatch.setattr(embeddup, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((9, 12))
    v = [np.float32(base[i % 9] + 0.25 * rng.standard_normal(12)) if kind == "float" else base[i % 9] + 0.25 * rng.standard_normal(12) for i in range(120)]
    rows = [(i % 110, x.tolist()) for i, x in enumerate(v)] + [(200 + i, v[0].tolist()[:5]) for i in range(3)] + [(3, v[40].tolist()), (300, v[5].tolist())]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("x") for c in ("mark", "v", "keys", "cls", "id", "t", "k", "block", "cell", "copies")})
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in embeddup.near_duplicates(table, recall=0.9999999, bits=2).collect()]
    assert sorted(got) == sorted(brute_links(rows))


def test_planted_pairs_at_the_threshold_are_found(spark):
    """2,000 pairs of cosine 0.90 to 0.91 at default settings."""
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = rng.uniform(0.9001, 0.91, (2000, 1))
    pairs = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * b])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(pairs)], "vec_id long, embedding array<double>")
    found = embeddup.near_duplicates(table).where("n_links = 1 and component_id = vec_id % 2000").count()
    assert found >= 0.998 * 4000


# the pipeline

def effective_trigrams(text):
    """Square of the number of trigrams around letters over the sum of their squared counts."""
    spaced = "".join(c if c.isalpha() else " " for c in f" {text or ''} ")
    low = [c.lower() if len(c.lower()) == 1 and c.lower().isalpha() else c for c in re.sub(" +", " ", spaced)]
    n = Counter(g for g in zip(low, low[1:], low[2:]) if g[1] != " ")
    return sum(n.values()) ** 2 / max(1, sum(x * x for x in n.values()))


def test_pipeline_against_plain_python(spark):
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    told = plain_languages([(r["doc_id"], r["text"], r["lang"]) for r in docs])
    least = lambda t: min(corpus_pipeline.MIN_LANGUAGE_SCORE, (effective_trigrams(t) / corpus_pipeline.REACH) ** 0.5 - corpus_pipeline.SPREAD)
    rows = {r["doc_id"]: r["text"] for r in docs if told[r["doc_id"]][0] != "und" and told[r["doc_id"]][1] >= least(r["text"])}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for t in rows.values() for k in {key(x) for x in t.split("\n")} if k)
    rows = {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for i, t in rows.items()}
    group = groups_by_brute_force(list(rows.items()), minhash.SHINGLE, minhash.THRESHOLD)
    rows = {i: t for i, t in rows.items() if group[i] == i}
    built = decontaminate.build([(str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = {i: t for i, t in rows.items() if not decontaminate.scan(t.encode(), built)[1]}
    assert set(out) == set(rows)
    assert all(out[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in rows.items())


def test_short_documents_pass_the_language_stage(spark, docs):
    short = ["Avec.", "This.", "A.", "Er\u00f6.", "Reorea. Nd.", "Thlyntsh.", "A.\nAll rights reserved.", "Avec. " * 500]
    other = ["123 456", "\u03be\u03b5\u03c3\u03ba\u03b5\u03c0\u03ac\u03b6\u03c9 \u03c4\u03b7\u03bd \u03c8\u03c5\u03c7\u03bf\u03c6\u03b8\u03cc\u03c1\u03b1 \u03b2\u03b4\u03b5\u03bb\u03c5\u03b3\u03bc\u03af\u03b1 " * 3, "".join(map(chr, range(0x4E00, 0x4F2C)))]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(short + other)], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more, True), SF).collect()}
    assert {i for i in kept if i < 0} == {-1 - i for i in range(len(short))}
    assert {r["doc_id"] for r in docs.where("text rlike '[A-Za-z]'").collect()} <= kept


def test_stages_keep_columns_and_odd_rows(spark):
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang, _ in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    table = table.withColumns({c: F.lit("x") for c in ("row", "mark", "score", "lang_pred", "trigrams", "spans", "items", "gone", "parts", "kept", "component_id", "n_words")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns and out.dtypes == table.dtypes, name
        assert name == "language_id" or out.where("doc_id is null").count() == 1, name
        assert stage(spark, table.limit(0), SF).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, table, SF).count() == len(ODD) and stage(spark, table.limit(0), SF).count() == 0


def test_long_items_in_pieces_have_the_same_windows(spark):
    rng = np.random.default_rng(2)
    item = " ".join(f"w{i}" for i in rng.integers(0, 5000, 4000))
    for text in (item, "one two three", "a " * 9 + "a", ""):
        df = spark.createDataFrame([("i", text)], "item string, text string")
        cut = [r["text"] for r in decontaminate.pieces(df, 10, 700).collect()]
        assert text is not item or len(cut) > 20
        windows = lambda w: {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
        assert set().union(*(windows(decontaminate.words(bytes(c))) for c in cut)) == windows(decontaminate.words(text.encode()))


def test_classifier_fit_against_a_plain_solver():
    """Dual coordinate descent reaches the optimum of the hinge loss that plain subgradient steps find."""
    rng = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([rng.integers(0, 64, 6), rng.integers(0, 32, 4) + 32 * (i % 2)])).astype(np.uint32) for i in range(120)]
    labels = np.array([i % 2 if i % 11 else 1 - i % 2 for i in range(120)])
    weights, bias, slope, _ = quality.fit(rows, labels, bits=6, c=1.0, epochs=400)
    own = len(rows) * 4 // 5
    y = np.where(labels > 0, 1.0, -1.0)[:own]
    count = {k: np.ones(64) for k in (1.0, -1.0)}
    for x, k in zip(rows[:own], y):
        count[k][x] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    x = np.zeros((own, 65))
    for i, r in enumerate(rows[:own]):
        x[i, r] = ratio[r] / np.sqrt(len(r))
        x[i, 64] = 1.0
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()
    w, best = np.zeros(65), np.inf
    for step in range(1, 60_001):
        w = w - (w - (y[:, None] * x)[y * (x @ w) < 1].sum(0)) / (step + 10)
        best = min(best, loss(w))
    used = ratio != 0
    got = np.append(np.where(used, weights / np.where(used, ratio, 1), 0), bias)
    assert loss(got) == pytest.approx(best, rel=2e-3) and slope > 0


def test_classifier_sample_is_bounded_in_rows_and_bytes(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels, bits: seen.append((len(rows), sum(x.nbytes for x in rows))))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    twice = docs.select("doc_id", "text").union(docs.select("doc_id", F.concat("text", F.lit(" more")))).union(docs.select("doc_id", "text"))
    quality.learn(twice, labels, sample=30)
    quality.learn(twice, labels, sample=30, sample_bytes=20_000)
    assert seen[0][0] == 30 and 0 < seen[1][0] < 30 and seen[1][1] <= 20_000


def test_operators_ignore_columns_that_clash(spark, docs):
    table = docs.limit(40).withColumns({c: F.lit("x") for c in ("mark", "block", "train", "score", "predicted", "n", "label_id", "held", "ids", "sizes", "n_bytes", "n_tokens", "keys")})
    plain = docs.limit(40).select("doc_id", "text")
    same = lambda f: sorted(map(tuple, f(table).collect())) == sorted(map(tuple, f(plain).collect()))
    assert same(lambda d: tokencount.count_tokens(d, P.path("byte_bpe_50k.json"))) and same(licences.scan)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(table, labels.withColumn("text", F.lit("y")))
    assert same(lambda d: quality.score(common.id_and_text(d), model))


def test_words_that_are_remembered_and_the_whole_text_take_the_same_search(docs, model):
    for r in docs.limit(60).collect():
        assert ids(model, r["text"]) == list(model.search(model.sp.normalize(r["text"])))
    assert model.widest <= 8 * model.longest


def test_crc():
    assert crc_mod_py(12, 7) == zlib.crc32(b"12") % 7
