"""Quality classifier: naive Bayes features under a linear support vector machine.

A text is a set of n-gram indicators hashed into a fixed number of places: words and pairs of words (lower
case), and runs of one to three word shapes (case, marks at the end, digits, a word said again). Each indicator
is scaled by its class log-count ratio; a hinge-loss model is fitted by dual coordinate descent; a logistic
curve fitted on rows that the model has not seen turns margins into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, crc_mod, distinct, id_and_text, mix, slices, texts_of

BITS = 18
#: The model is fitted on at most so many labelled rows, those first by a hash of their id; scoring covers all.
SAMPLE = 12_000
#: ... and on at most so many bytes of their indicators.
SAMPLE_BYTES = 96 << 20
CUT = 0.7
_PARTS = re.compile(rb"^([^A-Za-z0-9\x80-\xff]*)(.*?)([^A-Za-z0-9\x80-\xff]*)$", re.S)


class _Shapes(dict):
    """Word to a small hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WordHashes.LIMIT:
            self.clear()
        head, body, tail = _PARTS.match(word).groups()
        text = body.decode("utf-8", "replace")
        kind = b"0" if not body else b"9" if text.isdigit() else b"u" if text.isupper() and len(text) > 1 else b"t" if text[:1].isupper() else b"l" if text.islower() else b"m"
        h = self[word] = xxhash.xxh3_64_intdigest(kind + b"/" + head[:3] + b"/" + tail[:3])
        return h


class Indicators:
    """Sets of hashed n-gram indicators of texts."""

    def __init__(self, bits: int = BITS):
        self.shift, self.hashes, self.shapes = np.uint64(64 - bits), WordHashes(), _Shapes()

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted places; a text without words has none."""
        words = text.split()
        if not words:
            return np.zeros(0, np.uint32)
        w = self.hashes.array(text.lower().split())
        s = np.fromiter(map(self.shapes.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            s[1:][w[1:] == w[:-1]] += np.uint64(12345)  # said again
            three = np.uint64(3)
            runs = [w, w[:-1] * three + mix(w[1:]), s * np.uint64(5), mix(s[:-1]) * three + s[1:], mix(mix(s[:-2]) + s[1:-1]) * three + s[2:]]
        return distinct((mix(np.concatenate([mix(r + np.uint64(i)) for i, r in enumerate(runs)])) >> self.shift).astype(np.uint32))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, c: float = 1.0, epochs: int = 8, seed: int = 0) -> tuple[np.ndarray, float, float, float]:
    """(weight of each place, bias, slope, offset): probability = 1 / (1 + exp(-(slope * margin + offset))).

    margin = weights[places].sum() / sqrt(len(places)) + bias. The last fifth of the rows fits the curve only.
    Without rows the probability is 0.5; with one class it is that class's share, smoothed.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    n, size = len(rows), 1 << bits
    if n == 0 or len(set(y)) < 2:
        p = (np.sum(y > 0) + 1) / (n + 2)
        return np.zeros(size, np.float32), 0.0, 0.0, float(np.log(p / (1 - p)))
    own = max(2, n * 4 // 5) if len(set(y[: max(2, n * 4 // 5)])) == 2 and n >= 20 else n
    count = {k: np.ones(size) for k in (1.0, -1.0)}
    for x, k in zip(rows[:own], y):
        count[k][x] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(own)
    unit = [ratio[x] / max(1.0, np.sqrt(len(x))) for x in rows]
    square = np.array([u @ u + 1.0 for u in unit])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(own):
            x, u = rows[i], unit[i]
            step = np.clip(alpha[i] - (y[i] * (weights[x] @ u + bias) - 1) / square[i], 0, c) - alpha[i]
            if step:
                alpha[i] += step
                weights[x] += step * y[i] * u
                bias += step * y[i]
    margin = np.array([weights[x] @ u + bias for x, u in zip(rows[own:], unit[own:])] if own < n else [weights[x] @ u + bias for x, u in zip(rows, unit)])
    target = (y[own:] if own < n else y) > 0
    slope, offset = _curve(margin, target)
    return (weights * ratio).astype(np.float32), bias, slope, offset


def _curve(margin: np.ndarray, target: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, with a slight pull towards slope 2 and offset 0."""
    a, b = 2.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(p - target) @ margin + 0.1 * (a - 2), (p - target).sum() + 0.1 * b])
        h = np.array([[w @ margin**2 + 0.1, w @ margin], [w @ margin, w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
    return max(a, 0.1), b


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, bits: int = BITS) -> tuple[np.ndarray, float, float, float]:
    """Fit on labelled documents whose crc32(id) mod 4 is not 2: at most ``sample`` of them, whose indicator sets have at
    most ``sample_bytes`` together, those first by a hash of their id.

    docs: doc_id, text. Null labels and ids without a text row teach nothing; an id that is labelled more than once
    counts once, with its smallest label, and so does one of several texts, with the set that sorts first. A set has at
    most 2**bits places. Sets that don't fit are left out whole.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels[label_col].cast("int").alias("label")).where("label_id is not null and label is not null")
    known = known.where(crc_mod(F.col("label_id"), 4) != 2).groupBy("label_id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    found = docs.join(F.broadcast(known), docs["doc_id"] == known["label_id"]).select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Indicators(bits)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([make(t).astype("<u4").tobytes() for t in texts_of(batch)], pa.binary())], ["doc_id", "label", "places"])

    sets = checkpoint(found.mapInArrow(run, "doc_id long, label int, places binary").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("places").alias("places")))
    # ``sample`` pairs of numbers at most
    sizes = sorted(((xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["doc_id"], r["n"]) for r in sets.select("doc_id", F.octet_length("places").alias("n")).collect()))
    room, chosen = sample_bytes, []
    for _, i, n in sizes:
        if n <= room:
            room -= n
            chosen.append((i,))
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long")
    got = {r["doc_id"]: r for r in sets.join(F.broadcast(chosen), "doc_id", "left_semi").collect()}
    rows = [got[i] for _, i, _ in sizes if i in got]
    return fit([np.frombuffer(r["places"], "<u4") for r in rows], np.array([r["label"] for r in rows]), bits)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float, float], cut: float = CUT, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, score, predicted) for each row of docs (doc_id, text), whole texts.

    A null or empty text has no indicators and gets the score of the bias alone. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, offset = shared.value
        make = Indicators(bits)
        for batch in slices(batches):
            margin = np.array([weights[x].sum(dtype=float) / max(1.0, np.sqrt(len(x))) + bias for x in map(make, texts_of(batch))])
            p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
