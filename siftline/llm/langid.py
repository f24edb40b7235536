"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that its code point seeds. The vectors of three letters are
permuted (rotated) by their place and bound (multiplied) into a trigram's vector; a text's trigrams are
bundled (added) into its profile, a language's training texts into its prototype. A text's language is the
prototype of the greatest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, crc_mod, id_and_text, slices

DIM = 1024
#: Prototypes are broadcast in blocks of at most so many languages (4 MB).
LANGS = 1000
_ROWS = 2048
#: Cells of a table of texts by trigrams; texts that would need more are counted in halves.
_CELLS = 4_000_000


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter; its lower case where that is one letter."""
    chars = [chr(i) for i in range(0x110000)]
    is_letter = np.array([c.isalpha() for c in chars])
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(is_letter):
        low = chars[i].lower()
        if len(low) == 1 and low.isalpha():
            lower[i] = ord(low)
    return is_letter, lower


@lru_cache(20_000)
def _letter_vector(code: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(code)).choice(np.array([-1, 1], np.int8), dim)


def trigram_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    """grams: rows of three code points (0: a gap between words)."""
    codes, at = np.unique(grams, return_inverse=True)
    base = np.stack([_letter_vector(int(c), dim) for c in codes]) if len(codes) else np.zeros((0, dim), np.int8)
    at = at.reshape(grams.shape)
    return np.roll(base, 2, 1)[at[:, 0]] * np.roll(base, 1, 1)[at[:, 1]] * base[at[:, 2]]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each trigram's text and its number (in base len(alphabet)), the alphabet, and whether a text has a letter."""
    is_letter, lower = _letters()
    codes = [np.frombuffer(f" {t} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    code = np.where(is_letter[code], lower[code], 0)
    some = np.zeros(len(texts), bool)
    some[owner[code > 0]] = True
    keep = np.ones(len(code), bool)
    # a run of other characters is one gap, but each text begins with one of its own
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    if len(code) < 3:
        return owner[:0], np.zeros(0, np.int64), np.zeros(1, np.uint32), some
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    index = np.zeros(0x110000, np.int32)
    index[alphabet] = np.arange(len(alphabet))
    rank, n = index[code].astype(np.int64), len(alphabet)
    ok = (owner[2:] == owner[:-2]) & (code[1:-1] > 0)
    return owner[2:][ok], ((rank[:-2] * n + rank[1:-1]) * n + rank[2:])[ok], alphabet, some


def tables(owner: np.ndarray, gram: np.ndarray, alphabet: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, counts, kinds) for stretches of the texts: counts of text by trigram, trigrams as rows of three code points.

    A table has at most _CELLS cells or is of one text (which has no more kinds of trigrams than characters), so texts
    of very many kinds, as in a script of thousands of signs, take no more memory than others.
    """
    n = len(alphabet)
    a, b = np.searchsorted(owner, [first, last])
    own, of = gram[a:b], owner[a:b] - first
    if n**3 <= 8_000_000:
        seen = np.zeros(n**3, bool)
        seen[own] = True
        kinds = np.flatnonzero(seen)
        index = np.zeros(n**3, np.int32)
        index[kinds] = np.arange(len(kinds))
        col = index[own]
    else:
        kinds, col = np.unique(own, return_inverse=True)
    if last - first > 1 and (last - first) * len(kinds) > _CELLS:
        yield from tables(owner, gram, alphabet, first, (first + last) // 2)
        yield from tables(owner, gram, alphabet, (first + last) // 2, last)
        return
    counts = np.bincount(of * len(kinds) + col, minlength=(last - first) * len(kinds)).reshape(last - first, len(kinds))
    yield first, last, counts, np.stack([alphabet[kinds // (n * n)], alphabet[kinds // n % n], alphabet[kinds % n]], 1)


def learn(docs: DataFrame, lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """Rows (lang, v), the prototypes of all non-null labels over all texts given; nulls and texts without letters teach nothing.

    Each task adds up trigram counts for its labels and sends them as rows (label, trigram, count) before the
    only shuffle, which adds them; the sums are turned into vectors where they lie and added by place.
    """
    rows = docs.select(docs["text"].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, int, int], int] = {}

        def out() -> pa.RecordBatch:
            keys = list(total)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2, 3)), pa.array(list(total.values()), pa.int64())], ["lang", "x", "y", "z", "n"])

        for batch in slices(batches, size=1 << 20):
            langs, at = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            owner, gram, alphabet, _ = trigrams(batch.column("text").to_pylist())
            for first, last, counts, kinds in tables(owner, gram, alphabet, 0, batch.num_rows):
                for i in set(at[first:last].tolist()):
                    n = counts[at[first:last] == i].sum(0)
                    some = np.flatnonzero(n)
                    for key, m in zip(kinds[some].tolist(), n[some].tolist()):
                        key = (langs[i], *key)
                        total[key] = total.get(key, 0) + m
                if len(total) > 500_000:
                    yield out()
                    total.clear()
        yield out()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            grams = np.stack([batch.column(c).to_numpy() for c in "xyz"], 1)
            n = batch.column("n").to_numpy().astype(float)
            for i in range(0, len(langs), _ROWS):
                v = trigram_vectors(grams[i : i + _ROWS], dim)
                for lang in set(langs[i : i + _ROWS]):
                    mine = langs[i : i + _ROWS] == lang
                    sums[lang] = sums.get(lang, 0) + n[i : i + _ROWS][mine] @ v[mine].astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    grams = rows.mapInArrow(count, "lang string, x int, y int, z int, n long").groupBy("lang", "x", "y", "z").agg(F.sum("n").alias("n"))
    parts = grams.mapInArrow(vectors, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "v"))
    found = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v"))
    return checkpoint(found.select("lang", F.transform("v", lambda x: x["v"]).alias("v")))


def predict(docs: DataFrame, prototypes: DataFrame, dim: int = DIM) -> DataFrame:
    """Each row of docs (text and any others) with lang_pred, score and trigrams.

    score is the cosine, 0 where negative. A null or empty text, one without letters, and any text where
    nothing was learned get `und` and 0. Equal cosines: the label first in order. Texts count whole. trigrams is
    the effective number of trigrams, the square of their number over the sum of their squared counts.
    Prototypes are broadcast in blocks of LANGS; with more than one, each block's pass over the texts carries the best
    so far on. An empty table gives no rows; other columns may have any names but lang_pred, score and trigrams.
    """
    blocks = max(1, -(-prototypes.count() // LANGS))
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "trigrams")]
    out = docs.select(*rest, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("trigrams"))
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("trigrams", T.DoubleType())])
    for k in range(blocks):
        own = (prototypes.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k) if blocks > 1 else prototypes).orderBy("lang").collect()
        matrix = np.array([r["v"] for r in own]).reshape(-1, dim)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = docs.sparkSession.sparkContext.broadcast(([r["lang"] for r in own], matrix.astype(np.float32)))
        out = out.mapInArrow(_best(shared, rest, dim), schema)
        if k < blocks - 1:
            out = checkpoint(out)
            shared.unpersist()
    return out


def _best(shared, rest: list[str], dim: int):
    """The best label of one block of prototypes, or the one known before if that is as good or better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in slices(batches, size=1 << 20):
            owner, gram, alphabet, some = trigrams([t or "" for t in batch.column("text").to_pylist()])
            lang, score, effective = batch.column("lang_pred").to_pylist(), batch.column("score").to_numpy().copy(), np.zeros(batch.num_rows)
            for first, last, counts, kinds in tables(owner, gram, alphabet, 0, batch.num_rows):
                effective[first:last] = counts.sum(1) ** 2 / np.maximum(np.einsum("ij,ij->i", counts, counts), 1)
                if not names or not len(kinds):
                    continue
                profile = np.zeros((last - first, dim), np.float32)
                for i in range(0, len(kinds), _ROWS):
                    profile += counts[:, i : i + _ROWS].astype(np.float32) @ trigram_vectors(kinds[i : i + _ROWS], dim).astype(np.float32)
                cos = profile @ matrix.T / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
                best = cos.argmax(1)
                got = np.clip(cos[np.arange(last - first), best].astype(float), 0, 1)
                for i in np.flatnonzero(some[first:last]).tolist():
                    at, name = first + i, names[best[i]]
                    if lang[at] == "und" or got[i] > score[at] or got[i] == score[at] and name < lang[at]:
                        lang[at], score[at] = name, got[i]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(lang, pa.string()), pa.array(score), pa.array(effective)], [*rest, "lang_pred", "score", "trigrams"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """Learn from the labelled rows whose crc32(id) mod 4 is not 2, predict all rows.

    Returns doc_id, held_out, lang_pred, score. Repeated rows get equal predictions; an empty table gives none.
    """
    plain = id_and_text(docs, id_col, text_col)
    train = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang"), docs[id_col].alias("doc_id")).where(crc_mod(F.col("doc_id"), 4) != 2)
    out = predict(plain, learn(train, "lang", dim), dim)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
