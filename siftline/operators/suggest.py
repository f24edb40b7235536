"""Suggestions for what is typed so far."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .keep import kept
from .retrieval import _unit_rows, rank

SIMILAR, LIMIT, SHARE = 0.55, 5, 0.8
LEAST, LEAST_SIMILAR = 2, 3
#: Typed rows of one broadcast block.
BLOCK = 4096


def lexical_score(typed: Column, text: Column) -> Column:
    """1 for a beginning, 0.85 for a part, else 0.6 times the share of words found if half or more are (the last may be
    unfinished), of the two canonical forms."""
    words, have = F.split(typed, " "), F.split(text, " ")
    n = F.size(words)
    hit = F.size(F.filter(words, lambda w, i: F.when(i == n - 1, F.exists(have, lambda h: h.startswith(w))).otherwise(F.array_contains(have, w))))
    return F.when(typed == "", 0.0).when(text.startswith(typed), 1.0).when(F.contains(text, typed), 0.85).when((hit > 0) & (2 * hit >= n), F.round(0.6 * hit / n, 6)).otherwise(0.0)


class _Typed:
    """All typed forms at once: an automaton finds those that a text holds, postings by word those whose words it has."""

    def __init__(self, forms: list[str]):
        words = [f.split(" ") for f in forms]
        self.n = np.array([len(w) for w in words], np.int64)
        same: dict[str, list[int]] = {}
        inner: dict[str, list[int]] = {}
        last: dict[str, list[int]] = {}
        for i, (form, own) in enumerate(zip(forms, words)):
            same.setdefault(form, []).append(i)
            last.setdefault(own[-1], []).append(i)
            for w in own[:-1]:  # a word that is typed twice counts twice
                inner.setdefault(w, []).append(i)
        self.inner, self.last = ({w: np.array(i, np.int64) for w, i in d.items()} for d in (inner, last))
        self.longest = max(map(len, last), default=0)
        self.held = ahocorasick.Automaton()
        for form, i in same.items():
            self.held.add_word(form, (len(form), np.array(i, np.int64)))
        self.held.make_automaton()

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(places of forms with a score, scores), see lexical_score."""
        score = np.zeros(len(self.n))
        have = set(text.split(" "))
        whole = [self.inner[w] for w in have if w in self.inner]
        begun = {w[:k] for w in have for k in range(1, min(len(w), self.longest) + 1)} & self.last.keys()
        if whole or begun:
            hit = np.bincount(np.concatenate([*whole, *(self.last[w] for w in begun)]), minlength=len(self.n))
            some = np.flatnonzero((hit > 0) & (2 * hit >= self.n))
            score[some] = np.round(0.6 * hit[some] / self.n[some], 6)
        for end, (length, i) in self.held.iter(text):
            score[i] = np.maximum(score[i], 1.0 if end + 1 == length else 0.85)
        found = np.flatnonzero(score)
        return found, score[found]


def suggest(typed: DataFrame, texts: DataFrame, k: int = LIMIT, similar: float = SIMILAR) -> DataFrame:
    """Rows (query_id, id, score, rank): the k best texts for each typed row, by lexical_score and by similarity.

    typed: query_id, typed; texts: id, text; both may have v (an array of numbers): a cosine of ``similar`` or more
    counts 0.8 times itself if three characters or more are typed. Forms are canonical, those of under two characters
    get nothing, as do rows with a null id; texts of score 0 are none. Equal scores: the shorter text first, then by id. Null texts count as empty.

    What is typed is broadcast in blocks of bounded size, as one automaton over all forms and postings of their words; a
    text is read once for all of them, and only forms that it holds or shares enough words with are scored. A task keeps
    its own best k of each.
    """
    form = lambda c: F.coalesce(F.array_join(tokenize(F.col(c)), " "), F.lit(""))
    v = lambda df: (F.col("v").cast("array<double>") if "v" in df.columns else F.lit(None).cast("array<double>")).alias("v")
    asked = typed.where("query_id is not null").select("query_id", form("typed").alias("typed"), v(typed)).where(F.length("typed") >= LEAST)
    source = texts.where("id is not null").select("id", form("text").alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("length"), v(texts))
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked).toArrow()
        shared = typed.sparkSession.sparkContext.broadcast(rows.to_pydict())
        part = source.mapInArrow(_scan(shared, k, similar), "query_id long, id long, score double, length long")
        if blocks > 1:
            part = kept(part)
            shared.unpersist()
        out = part if out is None else out.union(part)
    return rank(out, ["query_id"], [F.desc("score"), F.asc("length"), F.asc("id")], k).select("query_id", "id", "score", "rank")


def _scan(shared, k: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        ids, forms = np.array(asked["query_id"], np.int64), asked["typed"]
        known = _Typed(forms)
        width = next((len(x) for x in asked["v"] if x), None)
        own_at, own = _unit_rows(pa.array(asked["v"], pa.list_(pa.float64())), width) if width else (np.zeros(0, int), np.zeros((0, 0)))
        long_ = np.array([len(f) >= LEAST_SIMILAR for f in forms], bool)
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))
        for batch in batches:
            for start in range(0, batch.num_rows if forms else 0, 1024):
                part = batch.slice(start, 1024)
                texts = part.column("text").to_pylist()
                length, name = part.column("length").to_numpy(), part.column("id").to_numpy()
                found = [known.scores(t) for t in texts]
                i, j, score = np.concatenate([f[0] for f in found]), np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), np.concatenate([f[1] for f in found])
                if width:
                    at, x = _unit_rows(part.column("v"), width)
                    near = np.round(own @ x.T, 6)
                    a, b = np.nonzero((near >= similar) & long_[own_at][:, None])
                    # of a form and text that both rules score, the better counts
                    pair, score = np.concatenate([i * len(texts) + j, own_at[a] * len(texts) + at[b]]), np.concatenate([score, SHARE * near[a, b]])
                    order = np.lexsort((-score, pair))
                    pair, score = pair[order], score[order]
                    best = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool)
                    (i, j), score = np.divmod(pair[best], len(texts)), score[best]
                i, j, score = i[score > 0], j[score > 0], score[score > 0]
                # the length orders equal scores: it goes before the id
                q, n, s, m = (np.concatenate(x) for x in zip(held, (i, name[j], score, length[j])))
                order = np.lexsort((n, m, -s, q))
                q, n, s, m = q[order], n[order], s[order], m[order]
                starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
                keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < k
                held = (q[keep], n[keep], s[keep], m[keep])
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2]), pa.array(held[3], pa.int64())], ["query_id", "id", "score", "length"])

    return run
