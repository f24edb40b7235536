"""An embedder that needs no model: words and their beginnings hashed into 1024 places."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import BLOCK_BYTES, FOUND, VECTOR_K, Nearest, _parts, rank, vector_topk

DIM = 1024


@lru_cache(200_000)
def place(piece: str) -> int:
    return int(hashlib.md5(piece.encode()).hexdigest()[-3:], 16) % DIM


def hashed(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that have words, their counts): see hash_embed. Pieces are looked up once for each distinct word."""
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    words = [w or "" for w in flat.dictionary.to_pylist()]
    known = {p: i for i, p in enumerate(dict.fromkeys([*words, *(w[:4] for w in words)]))}
    whole, begun = (np.fromiter((known[p] for p in ps), np.int64, len(words)) for ps in (words, (w[:4] for w in words)))
    code, row = flat.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(size)), size)
    pieces = np.unique(np.concatenate([row * len(known) + whole[code], row * len(known) + begun[code]])) if len(code) else np.zeros(0, np.int64)
    row, piece = np.divmod(pieces, max(1, len(known)))
    at = np.fromiter(map(place, known), np.int64, len(known))
    some = np.flatnonzero(size)
    counts = np.bincount(np.searchsorted(some, row) * DIM + at[piece], minlength=len(some) * DIM) if len(row) else np.zeros(0)
    return some, counts.reshape(len(some), DIM).astype(float)


def hash_embed(docs: DataFrame, tokens: Column) -> DataFrame:
    """Rows (id, v): each distinct word and each word's first four letters add 1 at md5 mod 1024. No words: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                some, v = hashed(part.column("t"))
                none = np.ones(part.num_rows, bool)
                none[some] = False
                ends = np.append(0, np.cumsum(np.where(none, 0, DIM))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()), mask=pa.array(none))], ["id", "v"])

    return docs.select("id", tokens.alias("t")).mapInArrow(run, "id long, v array<double>")


def hash_topk(queries: DataFrame, docs: DataFrame, k: int = VECTOR_K, digits: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (query_id, id, score, rank): vector_topk of hash_embed's vectors, which are made where they are compared.

    queries: query_id, tokens; docs: id, tokens. Ids of queries and documents are of two kinds: equal ones are no hit of
    their own. Only words cross from Spark to a task; queries of more than ``block_bytes`` of vectors go by way of
    hash_embed and vector_topk.
    """
    asked = queries.where("query_id is not null").select((-1 - F.col("query_id")).alias("id"), "tokens")
    source = docs.where("id is not null").select("id", "tokens")
    own = hash_embed(asked, F.col("tokens")).where("v is not null").withColumnRenamed("id", "query_id")
    if queries.count() * DIM * 8 > block_bytes:
        out = vector_topk(own, hash_embed(source, F.col("tokens")), k, digits=digits, block_bytes=block_bytes)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(own.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Nearest(shared.value, k, None, digits, DIM)
            for batch in batches:
                for part in _parts(batch, ("tokens",)):
                    some, x = hashed(part.column("tokens"))
                    found.score(part.column("id").to_numpy()[some], x / np.linalg.norm(x, axis=1, keepdims=True))
            yield found.told()

        out = rank(source.mapInArrow(run, FOUND), ["query_id"], [F.desc("score"), F.asc("id")], k)
    return out.withColumn("query_id", -1 - F.col("query_id"))


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 64) -> DataFrame:
    """Rows (id, v, error) by a model given as a function; a batch that fails is tried again text by text."""

    def checked(v: list[float]) -> list[float]:
        x = np.array(v, float)
        if x.shape != (dim,) or not np.isfinite(x).all():
            raise ValueError(f"not {dim} finite numbers")
        return (x / (np.linalg.norm(x) or 1.0)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                texts = [t or "" for t in part.column("text").to_pylist()]
                try:
                    got = [(checked(v), None) for v in model(texts)]
                except Exception:
                    got = []
                    for t in texts:
                        try:
                            got.append((checked(model([t])[0]), None))
                        except Exception as e:
                            got.append((None, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.string())], ["id", "v", "error"])

    return rows.select("id", "text").mapInArrow(run, "id long, v array<double>, error string")


def embed_once(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 64) -> DataFrame:
    """embed where each distinct text goes to the model once, however many rows ask for it; a null text counts as empty."""
    keyed = rows.select("id", F.coalesce("text", F.lit("")).alias("text"))
    each = keyed.groupBy("text").agg(F.min("id").alias("id"))
    told = embed(each, model, dim, batch).join(each, "id").select(F.concat("text", F.lit("")).alias("text"), "v", "error")
    return keyed.join(told, "text").select("id", "v", "error")


def unit(v: Column) -> Column:
    """The vector at length one; null if it is empty or a component is null or not finite. However long it is."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    scaled = F.transform(v, lambda x: x / F.when(most == 0, 1.0).otherwise(most))
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size(v) == 0)
    return F.when(~bad, F.transform(scaled, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)))
