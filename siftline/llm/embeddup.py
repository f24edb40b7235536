"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anew, checkpoint, whole_groups
from .components import connected_components

THRESHOLD = 0.9
RECALL = 0.9995
#: Vectors of a bucket that one task compares with each other, or with as many others; cosines that it has at a time.
BLOCK, AT_ONCE = 2048, 2 << 20
#: Vectors of a cell from which on those that an earlier table has compared are left out as whole groups.
CROWD = 256


def tables(bits: int, threshold: float, recall: float) -> int:
    """Tables so that a pair at the threshold shares a bucket with the target recall."""
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _planes(dim: int, n: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of doubles) of the vectors that can link, for each length: all components finite, not all zero."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)  # null components are NaN
    first = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        x = flat[first[at][:, None] + np.arange(n)]
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        yield at[ok], x[ok]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(unit: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of rows, one column for each table."""
    return (unit @ planes > 0).reshape(len(unit), -1, bits) @ (1 << np.arange(bits))


def sign(vectors: DataFrame, bits: int, n_tables: int, seed: int = 0) -> DataFrame:
    """vectors: vec_id, v array<double>. Rows (vec_id, mark, v binary, keys); mark is null where a vector can't link.

    v: 4 and the vector as packed singles if they hold it exactly, else 8 and doubles; keys: its bucket in each table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            marks, packed, keys = [None] * n, [None] * n, [None] * n
            for at, x in _matrices(batch.column("v")):
                if x.shape[1] not in planes:
                    planes[x.shape[1]] = _planes(x.shape[1], bits * n_tables, seed)
                own = _keys(_unit(x), planes[x.shape[1]], bits)
                x = x + 0.0  # no negative zero
                single = (x.astype("<f4") == x).all(1)
                for i, row, small, k in zip(at.tolist(), x, single.tolist(), own):
                    marks[i], keys[i] = xxhash.xxh3_128_digest(row.tobytes()), k
                    packed[i] = b"\x04" + row.astype("<f4").tobytes() if small else b"\x08" + row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(marks, pa.binary()), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["vec_id", "mark", "v", "keys"])

    return vectors.mapInArrow(run, "vec_id long, mark binary, v binary, keys array<long>")


def _opened(packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each length of packed vectors."""
    kind = np.array([len(v) * 16 + v[0] for v in packed])
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in np.unique(kind).tolist():
        at = np.flatnonzero(kind == k)
        raw = np.frombuffer(b"".join([packed[i] for i in at]), np.uint8).reshape(len(at), -1)[:, 1:]
        x = np.ascontiguousarray(raw).view(f"<f{k % 16}").astype(float)
        found.setdefault(x.shape[1], []).append((at, x))
    for parts in found.values():
        at, x = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(at)
        yield at[order], _unit(x[order])


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that links (i, j) reach from each of n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float, bits: int, n_tables: int, seed: int = 0):
    """Rows (cls, n, null, null): how many ids a class links with; (null, 0, a, b): links that hold classes together.

    Rows come sorted by cell, which is a bucket's block or pair of blocks. A pair counts in the first table that it shares.
    """
    planes: dict[int, np.ndarray] = {}

    def pairs(t: pa.Table) -> pa.RecordBatch:
        cell, table, key, x, y, block, cls, weight = (t.column(c).to_numpy() for c in ("cell", "t", "k", "x", "y", "block", "cls", "copies"))
        n, links = np.zeros(len(cell)), []
        for at, unit in _opened(t.column("v").to_pylist()):  # vectors of unequal length link with nothing
            own = cell[at]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2:
                    continue
                p = at[a:b]
                first = int(table[p[0]])
                width = unit.shape[1]
                if first and width not in planes:
                    planes[width] = _planes(width, bits * n_tables, seed)
                own, keys, ends = unit[a:b], None, np.arange(b - a) + 1
                if first and b - a > CROWD:
                    # pairs that share a bucket of an earlier table have been met there: those of the table that most
                    # share are left out before any cosine is taken
                    keys = _keys(own, planes[width][:, : bits * first], bits)
                    sizes = [np.unique(column, return_inverse=True, return_counts=True)[1:] for column in keys.T]
                    group, count = max(sizes, key=lambda x: (x[1] ** 2).sum())
                    order = np.argsort(group, kind="stable")
                    p, own, keys, ends = p[order], own[order], keys[order], np.cumsum(count)[group[order]]
                step, k, held = max(1, AT_ONCE // (b - a)), 0, []
                while k < b - a:
                    end = int(ends[k])  # rows of one group see all rows after it; without groups, rows see all after them
                    hi = min(k + step, end if keys is not None else b - a)
                    begin = end if keys is not None else k
                    i, j = np.nonzero(own[k:hi] @ own[begin:].T >= threshold)
                    i, j = i + k, j + begin
                    k = hi
                    u, w = p[i], p[j]
                    # a cell is a hash, which two buckets may share; a pair of blocks compares across only
                    ok = (i < j) & (table[u] == table[w]) & (key[u] == key[w]) & (x[u] == x[w]) & (y[u] == y[w]) & ((x[u] == y[u]) | (block[u] != block[w]))
                    i, j = i[ok], j[ok]
                    if len(i) and first:
                        if keys is None:
                            some = np.unique(np.concatenate([i, j]))
                            told = np.zeros((b - a, first), np.int64)
                            told[some] = _keys(own[some], planes[width][:, : bits * first], bits)
                        else:
                            told = keys
                        new = ~(told[i] == told[j]).any(1)
                        i, j = i[new], j[new]
                    if len(i):
                        n[p] += np.bincount(i, weight[p[j]], b - a) + np.bincount(j, weight[p[i]], b - a)
                        root = _roots(i, j, b - a)
                        more = np.flatnonzero(root != np.arange(b - a))
                        held.append((root[more], more))
                if held:
                    root = _roots(*(np.concatenate([h[side] for h in held]) for side in (0, 1)), b - a)
                    more = np.flatnonzero(root != np.arange(b - a))
                    links += zip(cls[p[root[more]]].tolist(), cls[p[more]].tolist())
        some = np.flatnonzero(n)
        out = [*zip(cls[some].tolist(), n[some].astype(int).tolist(), [None] * len(some), [None] * len(some)), *((None, 0, a, b) for a, b in links)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["cls", "n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell"):
            yield pairs(t)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, bits: int | None = None) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors.

    Vectors link if their cosine in double precision is threshold or more. Null, empty and zero vectors and
    those with null or non-finite components link with nothing, as do vectors of unequal lengths and null ids
    (whose component is null; they are kept). Equal vectors are one class with a number of ids, so copies are
    never paired; rows that repeat an id and its vector count once. Rows that repeat an id with other vectors
    each have the links and the component of their own vector. An empty table gives no rows, other columns are not
    read. The number of hash bits follows the number of rows (about 128 vectors a bucket), the number of tables
    the recall at the threshold. A bucket is compared in pairs of blocks; a task returns counts and a spanning
    forest, not its pairs.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    bits = bits or max(4, math.ceil(math.log2(max(1, rows.count() / 128))))
    n_tables = tables(bits, threshold, recall)
    signed = checkpoint(sign(rows, bits, n_tables))
    has = signed.where("mark is not null and vec_id is not null")
    copies = has.select("mark", "vec_id").distinct().groupBy("mark").agg(F.count("*").alias("copies"), F.min("vec_id").alias("id"))
    one = has.groupBy("mark").agg(F.first("v").alias("v"), F.first("keys").alias("keys"))
    # the numbers stand still once they are written
    classes = checkpoint(copies.join(one, "mark").withColumn("cls", F.monotonically_increasing_id()))
    buckets = classes.select("cls", F.posexplode("keys").alias("t", "k"))
    sizes = buckets.groupBy("t", "k").count().where("count > 1")
    sizes = sizes.select("t", anew("k"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    met = buckets.join(sizes, ["t", "k"]).join(classes.select("cls", "copies", "v"), "cls")
    dealt = met.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("block", "other"), F.greatest("block", "other")
    cells = dealt.select(F.xxhash64("t", "k", x, y).alias("cell"), "t", "k", x.alias("x"), y.alias("y"), "block", "cls", "copies", "v")
    found = checkpoint(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(threshold, bits, n_tables), "cls long, n long, a long, b long"))
    links = found.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("a is not null")).select(F.col("id").alias("cls"), "root")
    told = classes.select("mark", "id", "copies", "cls").join(links, "cls", "left").join(roots, "cls", "left").select("mark", "id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    least = told.groupBy("root").agg(F.min("id").alias("component")).select(anew("root"), "component")
    out = signed.select("vec_id", "mark").join(told.join(least, "root").select("mark", "n_links", "component"), "mark", "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
