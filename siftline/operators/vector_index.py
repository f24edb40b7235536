"""An inverted-list index of vectors: cells around trained centroids, searched a few cells a query and more where a filter
leaves too little, with exact scores at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import kept
from .retrieval import VECTOR_K, _unit_rows, by_cell, rank, vector_topk

#: Vectors that centroids are trained on, at most; rounds of training.
SAMPLE, ROUNDS = 100_000, 8
#: Bytes of centroids, at most: they are broadcast.
CENTROID_BYTES = 64 << 20
#: Vectors of a cell that one task searches; larger cells are split.
PIECE = 100_000
#: Vectors whose neighbours the exact search finds, to choose the number of cells a query probes.
JUDGES, RECALL = 64, 0.95


def _nearest(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The k nearest cells of each row, nearest first, equal ones in order of cell."""
    out = np.empty((len(x), k), np.int64)
    step = max(1, (16 << 20) // max(1, 8 * len(centroids)))
    for a in range(0, len(x), step):
        score = x[a : a + step] @ centroids.T
        out[a : a + step] = np.argsort(-score, axis=1, kind="stable")[:, :k] if k > 1 else score.argmax(1)[:, None]
    return out


def _train(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of length one by k-means on the sphere, begun at evenly spaced rows; an empty cell takes the row that fits worst."""
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centroids, 1)[:, 0]
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        total[empty] = x[np.argsort((x * centroids[own]).sum(1))[: len(empty)]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centroids)
    return centroids


class VectorIndex:
    """vectors: id, v and any columns to filter by. Every vector that can match (see retrieval.vector_topk) lies in a cell.

    The centroids are trained on ``sample`` vectors at most, taken by a hash of their ids; there are as many as the square
    root of the number of vectors, as far as CENTROID_BYTES allow. ``rows`` is the index as a table: cell, piece and
    the vector's columns; ``counts`` says how many of a cell's vectors have which value of ``tag``.
    ``probes`` is the least number of cells, doubled from one on, in which JUDGES vectors find RECALL of their k nearest.
    """

    def __init__(self, vectors: DataFrame, tag: str | None = None, cells: int | None = None, sample: int = SAMPLE, k: int = VECTOR_K, probes: int | None = None):
        self.tag, self.spark = tag, vectors.sparkSession
        source = vectors.where("id is not null and v is not null").withColumn("v", F.col("v").cast("array<double>"))
        n, self.width = source.agg(F.count("*"), F.max(F.size("v"))).first()
        self.cells = cells or max(1, min(math.isqrt(n), CENTROID_BYTES // (8 * max(self.width or 1, 1))))
        share = min(1.0, sample / max(1, n))
        got = source.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30)).orderBy("id").select("v").limit(2 * sample).toArrow()
        _, x = _unit_rows(got.column("v").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64())), self.width)
        self.cells = min(self.cells, max(1, len(x)))
        self.centroids = self.spark.sparkContext.broadcast(_train(x, self.cells) if len(x) else np.zeros((1, self.width or 1)))
        placed = self._placed(source.select("id", "v"), "id", 1).select("id", F.col("cells")[0].alias("cell"))
        self.rows = kept(source.join(placed, "id"))
        by = ["cell", *([tag] if tag else [])]
        self.counts = kept(self.rows.groupBy(*by).agg(F.count("*").alias("n")))
        self.pieces = kept(self.rows.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")))
        self.probes = probes or self._judged(source, k)

    def _placed(self, vectors: DataFrame, name: str, k: int) -> DataFrame:
        """Rows (name, cells): the k nearest cells of each vector that can match."""
        centroids, width = self.centroids, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = _unit_rows(batch.column("v"), width)
                cells = _nearest(x, centroids.value, k)
                yield pa.RecordBatch.from_arrays([batch.column(name).take(pa.array(at)), pa.array(list(cells), pa.list_(pa.int64()))], [name, "cells"])

        return vectors.select(name, "v").mapInArrow(run, f"{name} long, cells array<long>")

    def _judged(self, source: DataFrame, k: int) -> int:
        n = self.rows.count()
        asked = kept(source.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < (JUDGES / max(1, n)) * (1 << 30)).select(F.col("id").alias("query_id"), "v"))
        true = kept(vector_topk(asked, source, k).select("query_id", "id"))
        total = true.count()
        own = self.rows.select("id", F.col("cell").alias("own"))
        order = self._placed(asked, "query_id", self.cells)
        at = true.join(order, "query_id").join(own, "id").select(F.array_position("cells", F.col("own")).alias("at")).groupBy("at").count().orderBy("at").collect()
        found, last = 0, 1
        for r in at:
            found, last = found + r["count"], r["at"]
            if found >= RECALL * total:
                break
        return min(self.cells, 1 << max(0, math.ceil(math.log2(last))))

    def plan(self, queries: DataFrame, k: int = VECTOR_K, where: Column | None = None) -> DataFrame:
        """Rows (query_id, cell): the cells each query looks at, widened until k vectors in them pass the filter.

        What passes is read from counts, not from vectors; with ``where`` (over the index's columns) cells are counted anew.
        """
        counts = self.counts if where is None else self.rows.where(where).groupBy("cell", *([self.tag] if self.tag else [])).agg(F.count("*").alias("n"))
        on = ["cell", *([self.tag] if self.tag else [])]
        todo, probes, out = queries.where("query_id is not null and v is not null"), self.probes, None
        while True:
            near = self._placed(todo, "query_id", probes).select("query_id", F.explode("cells").alias("cell"))
            if self.tag:
                near = near.join(todo.select("query_id", self.tag), "query_id")
            near = kept(near)
            have = near.join(counts, on).groupBy("query_id").agg(F.sum("n").alias("n")).where(F.col("n") > k)  # one may be the query itself
            done = near if probes >= self.cells else near.join(have, "query_id", "left_semi")
            out = done.select("query_id", "cell") if out is None else out.union(done.select("query_id", "cell"))
            if probes >= self.cells:
                return out
            todo = kept(todo.join(have, "query_id", "left_anti"))
            if todo.isEmpty():
                return out
            probes = min(self.cells, 4 * probes)

    def search(self, queries: DataFrame, k: int = VECTOR_K, where: Column | None = None, digits: int = 6) -> DataFrame:
        """Rows (query_id, id, score, rank) as retrieval.vector_topk has them, from the cells that ``plan`` names.

        queries: query_id, v and the tag's column, which must be equal, if the index has one.
        """
        more = [self.tag] if self.tag else []
        near = self.plan(queries, k, where)
        piece = lambda i: F.shiftleft("cell", 20) + i
        asked = near.join(queries.select("query_id", F.col("v").cast("array<double>").alias("v"), *more), "query_id").join(self.pieces, "cell")
        asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(piece(F.col("piece").cast("long")).alias("cell"), "query_id", "v", *more)
        rows = (self.rows if where is None else self.rows.where(where)).join(near.select("cell").distinct(), "cell", "left_semi").join(self.pieces, "cell")
        rows = rows.select(piece(F.pmod(F.xxhash64("id"), F.col("pieces"))).alias("cell"), "id", "v", *more)
        return rank(by_cell(asked, rows, k, self.tag, digits, self.width), ["query_id"], [F.desc("score"), F.asc("id")], k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of true (query_id, id) rows that are found."""
    total = true.count()
    return found.select("query_id", "id").join(true.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / total if total else 1.0
