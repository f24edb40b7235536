"""Hard negatives: segment means and deviations bound inner products, segments are refined, what is left is scored exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, runs_of

N_POSITIVES, N_NEGATIVES = 5, 3
#: A negative's score lies between so many hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Segments of a vector whose means and deviations are stored; coarser levels follow from these.
SEGMENTS = 8
#: Vectors that a task holds as anchors; vectors of one cell.
ANCHORS, ROWS = 20_000, 2_000_000
#: Scores that are bounded at a time.
_AT_ONCE = 2 << 20
_LONG = np.iinfo(np.int64)


def _ints(vectors: pa.ListArray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, floor(scale * x) as doubles) of the vectors that take part, for each length."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)  # null components are NaN
    first = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * flat[first[at][:, None] + np.arange(n)]) + 0.0
        ok = np.isfinite(x).all(1)
        yield at[ok], x[ok]


def _cuts(dim: int) -> np.ndarray:
    """Ends of the stored segments: as even as can be, at most one for each component."""
    return np.unique(np.linspace(0, dim, min(dim, SEGMENTS) + 1).astype(int))


def summaries(x: np.ndarray) -> np.ndarray:
    """For each row the mean of each segment, then each segment's deviation (the length of what is left of it)."""
    cuts = _cuts(x.shape[1])
    mean = np.add.reduceat(x, cuts[:-1], 1) / np.diff(cuts)
    left = x - np.repeat(mean, np.diff(cuts), 1)
    most = np.maximum(np.abs(left).max(1, keepdims=True), 1.0)  # no overflow
    return np.concatenate([mean, np.sqrt(np.add.reduceat((left / most) ** 2, cuts[:-1], 1)) * most], 1)


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """vectors: vec_id, label, v array<double>. Rows (vec_id, label, dim, v, summary) of those that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _ints(batch.column("v"), scale):
                small = (np.abs(x) < 1 << 15).all(1).tolist()
                v = [b"\x02" + row.astype("<i2").tobytes() if s else b"\x08" + row.tobytes() for row, s in zip(x, small)]
                with np.errstate(over="ignore", invalid="ignore"):
                    told = [row.tobytes() for row in summaries(x)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("label").take(pa.array(at)), pa.array([x.shape[1]] * len(at), pa.int32()), pa.array(v, pa.binary()), pa.array(told, pa.binary())], ["vec_id", "label", "dim", "v", "summary"])

    return vectors.mapInArrow(run, "vec_id long, label long, dim int, v binary, summary binary")


class Block:
    """Vectors of one length with ids, labels and their summaries at each level, the coarsest first."""

    def __init__(self, t: pa.Table | pa.RecordBatch):
        self.id, self.label = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        raw, dim = t.column("v").to_pylist(), t.column("dim")[0].as_py()
        self.x = np.empty((len(raw), dim))
        kind = np.array([v[0] for v in raw])
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k)
            self.x[at] = np.frombuffer(b"".join([raw[i][1:] for i in at]), "<i2" if k == 2 else "<f8").reshape(len(at), dim)
        self.most = float(np.abs(self.x).max(initial=0))
        told = np.frombuffer(b"".join(t.column("summary").to_pylist()), "<f8").reshape(len(raw), -1)
        size, k = np.diff(_cuts(dim)).astype(float), told.shape[1] // 2
        mean, dev = told[:, :k], told[:, k:]
        #: For each level, as sides of a product: (lengths times means, deviations) and (means, deviations).
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore", invalid="ignore"):
            #: What doubles may have lost: 1e-9 of the norms' product.
            loss = np.sqrt((self.x * self.x).sum(1, keepdims=True)) * 1e-9**0.5
            self.tame = bool(np.isfinite(loss * loss).all())
            while True:
                self.levels.insert(0, (np.concatenate([mean * size, dev, loss], 1), np.concatenate([mean, dev, loss], 1)))
                if len(size) == 1:
                    break
                pairs = np.arange(0, len(size), 2)
                total = np.add.reduceat(size, pairs)
                joint = np.add.reduceat(mean * size, pairs, 1) / total
                apart = np.repeat(joint, np.diff([*pairs, len(size)]), 1) - mean
                dev = np.sqrt(np.add.reduceat(dev * dev + size * apart * apart, pairs, 1))
                size, mean = total, joint

    def __len__(self) -> int:
        return len(self.id)


def products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows: of all rows i with all rows j where i is a column and j a row, else one by one."""
    if i.ndim == 2:
        return x[i[:, 0]] @ y[j[0]].T
    step = max(1, _AT_ONCE // x.shape[1])
    return np.concatenate([*(np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) for k in range(0, len(i), step)), np.zeros(0)])


def bounds(a: Block, i: np.ndarray, b: Block, j: np.ndarray, level: int, least: bool = False) -> np.ndarray:
    """The greatest (or the least) score that pairs can have; see products for i and j.

    A segment's part of the score is its length times the means' product, give or take the deviations' product.
    """
    left, right = a.levels[level][0], b.levels[level][1]
    if least:
        left = np.concatenate([left[:, : left.shape[1] // 2], -left[:, left.shape[1] // 2 :]], 1)
    return products(left, i, right, j) + (-1e-6 if least else 1e-6)


def exact(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs; what a long can't hold is its nearest end."""
    if a.x.shape[1] * a.most * b.most < 2**53:  # doubles are exact
        return products(a.x, i, b.x, j).astype(np.int64)
    pairs = np.broadcast_arrays(i, j)
    told = [max(_LONG.min, min(_LONG.max, sum(int(p) * int(q) for p, q in zip(a.x[k], b.x[m])))) for k, m in zip(*(x.ravel().tolist() for x in pairs))]
    return np.array(told, np.int64).reshape(pairs[0].shape)


class Best:
    """The first k (score, id) of each of n slots: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.size = np.full((n, k), _LONG.min), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def floor(self) -> np.ndarray:
        """The score that a newcomer must have at least."""
        k = self.score.shape[1]
        return np.where(self.size < k, _LONG.min, self.score[:, -1])

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        k = self.score.shape[1]
        known = np.unique(slot)
        held = np.arange(k) < self.size[known][:, None]
        slot, score, ids = np.concatenate([slot, np.repeat(known, k)[held.ravel()]]), np.concatenate([score, self.score[known][held]]), np.concatenate([ids, self.id[known][held]])
        order = np.lexsort((ids, -np.maximum(score, -_LONG.max), slot))  # the least long has no negative
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff([*first, len(slot)]))
        ok = place < k
        self.score[slot[ok], place[ok]], self.id[slot[ok], place[ok]] = score[ok], ids[ok]
        self.size[known] = np.bincount(slot[ok], minlength=len(self.size))[known]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(np.arange(self.score.shape[1]) < self.size[:, None])
        return slot, self.score[slot, place], self.id[slot, place]


#: Pairs of a tile are taken one by one once fewer than one in so many are left.
SPARSE = 16


def scored(a: Block, i: np.ndarray, b: Block, j: np.ndarray, least: np.ndarray, most: np.ndarray | None = None, other: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, scores) of the pairs of i and j whose bounds let their score lie from least to most (one for
    each row of a), after all levels. With ``other`` the labels must differ, and else the ids.

    Bounds of a tile are products of its summaries until few of its pairs are left; these go on one by one.
    """
    ok = a.label[i][:, None] != b.label[j] if other else a.id[i][:, None] != b.id[j]
    at, over = i[:, None], j[None, :]  # all pairs, or those that are left
    for level in range(len(a.levels)) if a.tame and b.tame else ():
        if at.ndim == 2 and ok.sum() * SPARSE < ok.size:
            p, q = np.nonzero(ok)
            at, over, ok = i[p], j[q], np.ones(len(p), bool)
        low = least[at]
        ok &= bounds(a, at, b, over, level) >= low
        if most is not None:
            ok &= bounds(a, at, b, over, level, least=True) <= most[at]
        if at.ndim == 1:
            at, over, ok = at[ok], over[ok], np.ones(int(ok.sum()), bool)
    if at.ndim == 2 and ok.sum() * SPARSE < ok.size:
        p, q = np.nonzero(ok)
        at, over, ok = i[p], j[q], np.ones(len(p), bool)
    if at.ndim == 1:
        return at, over, exact(a, at, b, over)
    p, q = np.nonzero(ok)
    return i[p], j[q], exact(a, at, b, over)[p, q]


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, _AT_ONCE // max(1, len(b)))
    for k in range(0, len(a), step):
        yield a[k : k + step], b


class Positives:
    """The best other rows of each anchor's own label."""

    columns = ["anchor_id", "vec_id", "score"]
    schema = "anchor_id long, vec_id long, score long"

    def __init__(self, t: pa.Table, k: int, *_: int):
        self.anchors = Block(t)
        self.best = Best(len(self.anchors), k)
        self.of = {label: np.flatnonzero(self.anchors.label == label) for label in np.unique(self.anchors.label).tolist()}

    def meet(self, rows: Block) -> None:
        for label in np.unique(rows.label).tolist():
            if label in self.of:
                for i, j in _tiles(self.of[label], np.flatnonzero(rows.label == label)):
                    floor = self.best.floor()
                    i, j, score = scored(self.anchors, i, rows, j, floor)
                    some = score >= floor[i]
                    self.best.add(i[some], score[some], rows.id[j[some]])

    def told(self) -> list[np.ndarray]:
        slot, score, ids = self.best.rows()
        return [self.anchors.id[slot], ids, score]


class Negatives:
    """For each anchor and positive the best rows of other labels in the positive's window."""

    columns = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]
    schema = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"

    def __init__(self, t: pa.Table, k: int, low: int, high: int):
        self.anchors = Block(t)
        ids, scores = t.column("positives").to_pylist(), t.column("scores").to_pylist()
        self.each = max(map(len, ids))
        shape = (len(ids), self.each)
        self.positive, self.score = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        #: Windows; an empty one where there are fewer positives.
        self.low, self.high = np.full(shape, _LONG.max), np.full(shape, _LONG.min)
        for i, (own, s) in enumerate(zip(ids, scores)):
            self.positive[i, : len(own)], self.score[i, : len(own)] = own, s
            self.low[i, : len(own)] = [max(_LONG.min, -(-low * x // 100)) for x in s]  # in Python's integers
            self.high[i, : len(own)] = [min(_LONG.max, high * x // 100) for x in s]
        self.low = np.where(self.low > self.high, _LONG.max, self.low)
        self.best = Best(shape[0] * self.each, k)

    def meet(self, rows: Block) -> None:
        most = self.high.max(1).astype(float)
        for i, j in _tiles(np.flatnonzero((self.low <= self.high).any(1)), np.arange(len(rows))):
            floor = np.maximum(self.best.floor().reshape(self.low.shape), self.low)
            i, j, score = scored(self.anchors, i, rows, j, np.where(self.low <= self.high, floor, _LONG.max).min(1).astype(float), most, other=True)
            for k in range(self.each):
                ok = (score >= floor[i, k]) & (score <= self.high[i, k])
                self.best.add(i[ok] * self.each + k, score[ok], rows.id[j[ok]])

    def told(self) -> list[np.ndarray]:
        slot, score, ids = self.best.rows()
        i, k = slot // self.each, slot % self.each
        return [self.anchors.id[i], self.positive[i, k], self.score[i, k], ids, score]


def _searched(search: type, *options: int):
    """Rows come sorted by cell, length and kind: anchors (0), then rows (1), which stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, found = None, None

        def over() -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found.told()], search.columns)

        for (cell, dim, kind), batch in runs_of(batches, "cell", "dim", "kind"):
            if (cell, dim) != at:
                yield from over()
                at, found, held = (cell, dim), None, []
            if kind == 0:
                held.append(batch)
                continue
            if held:
                found, held = search(pa.Table.from_batches(held), *options), []
            if found:
                found.meet(Block(batch))
        yield from over()

    return run


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), as the contract of op12 has them.

    ``anchors`` is a condition on vec_id. A row whose id, label or vector is null, whose vector is empty or has a null
    or non-finite component (before or after scaling) takes no part. Vectors of unequal lengths have no score. Rows that
    repeat an id are one row, that of the smallest label, then vector. Equal scores go by the smaller id; an anchor
    without positives, or a positive without negatives in its window, gives no rows. A score that a long can't hold
    counts as its nearest end. Other columns are not read. An empty table gives no rows.

    Anchors and rows are dealt to a grid of cells: a cell's anchors (some 20,000) lie in memory, its rows stream past
    them in Arrow batches, so that a row moves once for each group of anchors, twice (positives, then negatives in
    their windows). A cell bounds scores by the stored summaries of segments, from one segment to eight, keeps what the
    bounds leave over, scores that exactly and gives its best few of each anchor; those are merged by anchor.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), vectors[vec_col].cast("array<double>").alias("v"))
    told = packed(rows.where("vec_id is not null and label is not null and v is not null"), scale)
    one = checkpoint(told.groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim", "summary")).alias("row")).select("vec_id", "row.*"))
    chosen = one.where(anchors)
    n, m = one.count(), chosen.count()
    across = max(1, math.ceil(m / ANCHORS))
    down = max(1, math.ceil(n / ROWS), math.ceil(2 * spark.sparkContext.defaultParallelism / across))

    def grid(chosen: DataFrame, search: type, *options: int) -> DataFrame:
        extra = {c: F.lit(None).cast("array<long>") for c in chosen.columns if c not in one.columns}
        own = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(across))  # the anchor's group
        left = chosen.withColumns({"kind": F.lit(0), "k": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))}).withColumn("cell", F.col("k") * across + own)
        own = F.pmod(F.xxhash64("vec_id"), F.lit(down)) * across
        right = one.withColumns({"kind": F.lit(1), "k": F.explode(F.sequence(F.lit(0), F.lit(across - 1))), **extra}).withColumn("cell", F.col("k") + own)
        dealt = left.unionByName(right).repartitionById(across * down, F.col("cell").cast("int"))
        return dealt.sortWithinPartitions("cell", "dim", "kind").mapInArrow(_searched(search, *options), search.schema)

    found = grid(chosen, Positives, n_positives)
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.greatest("score", F.lit(-_LONG.max))).alias("less"), "vec_id", "score"))), 1, n_positives)
    best = found.groupBy("anchor_id").agg(first.alias("best")).select(F.col("anchor_id").alias("vec_id"), F.col("best.vec_id").alias("positives"), F.col("best.score").alias("scores"))
    found = grid(checkpoint(chosen.join(best, "vec_id")), Negatives, n_negatives, low, high)
    few = found.groupBy("anchor_id", "positive_id", "positive_score").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.greatest("score", F.lit(-_LONG.max))).alias("less"), "vec_id", "score"))), 1, n_negatives).alias("best"))
    out = few.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("place", "own"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("own.vec_id").alias("negative_id"), "positive_score", F.col("own.score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.l = b.l AS alike, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) QUALIFY row_number() OVER w <= 3
"""
