"""Small helpers the operators share: checkpoints, bounded Arrow slices, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task works on at a time (one longer text is taken alone).
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and all runs in one process, as in tests."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if told is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="siftline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told)
    return told


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Stash:
    """Tables of one iteration in the shared folder, as Parquet: what is read back has neither lineage nor the
    constraints that checkpoint() hands on, which the optimizer would combine anew in every round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/siftline-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int | None = None) -> None:
        """Delete all tables, or the n-th one."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root if n is None else f"{self.root}/{n}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def anew(name: str) -> Column:
    """A long column's values without what Spark knows of their partitioning.

    A join on it deals both sides out anew, which lets adaptive execution split a hot key's rows.
    """
    return F.col(name).bitwiseXOR(F.lit(0).cast("long")).alias(name)


def anew_text(name: str) -> Column:
    """The same of a string column."""
    return F.concat(F.col(name), F.lit("")).alias(name)


def runs_of(batches: Iterable[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """(values, rows) of stretches of each batch that have the same integers in these columns."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in by], 1)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]])) if len(keys) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, under fixed names; other columns of the input can't clash with theirs."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def crc_mod_py(doc_id: int | None, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches again, each of at most ``size`` bytes of text or of a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def whole_groups(batches: Iterable[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Rows sorted by a column as tables that end where its value changes: small groups come together, none is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        value = batch.column(by).to_numpy()
        if held and len(value) and held[-1].column(by)[-1].as_py() != value[0]:
            yield pa.Table.from_batches(held)
            held = []
        # all before the last value is whole
        cut = int(np.searchsorted(value, value[-1], side="left")) if len(value) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        if len(value):
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 of each text; null is the empty text."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered up to a bounded number of words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


#: Bytes that word_hashes works on at a time.
_SPAN = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; a number for each byte, alike for A-Z and a-z; blanks."""
    up, down = np.full(_SPAN + 1, _BASE, np.uint64), np.full(_SPAN + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    low = np.arange(256)
    low[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down), mix(low.astype(np.uint64) + np.uint64(1) << np.uint64(20)) | np.uint64(1), blank


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between blanks of all texts in a row, A-Z lower-cased, and how many words each text has.

    A word's hash is a polynomial of its bytes, taken from running sums over many words at once.
    """
    up, down, number, blank = _tables()
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    out, begins, lo, n = [], [], 0, len(data)
    while lo < n:
        part = data[lo : lo + _SPAN]
        gaps = np.flatnonzero(blank[part])
        if not len(gaps):  # a word longer than what is worked on at a time
            end = lo + _SPAN
            while not blank[data[end : end + _SPAN]].any():
                end += _SPAN
            end += int(np.argmax(blank[data[end : end + _SPAN]]))
            total = 0
            for at in range(lo, end, _SPAN):
                own = data[at : min(end, at + _SPAN)]
                with np.errstate(over="ignore"):
                    total += int((number[own] * up[: len(own)]).sum(dtype=np.uint64)) * pow(_BASE, at - lo, 1 << 64)
            out.append(np.array([total % (1 << 64)], np.uint64))
            begins.append(np.array([lo]))
            lo = end
            continue
        part = part[: gaps[-1] + 1]
        # words are what lies between two blanks that aren't neighbours
        ends, starts = gaps, np.concatenate([[0], gaps[:-1] + 1])
        some = ends > starts
        starts, ends = starts[some], ends[some]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(number[part] * up[: len(part)], out=sums[1:])
            out.append((sums[ends] - sums[starts]) * down[starts])
        begins.append(starts + lo)
        lo += len(part)
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    begin = np.concatenate([*begins, np.zeros(0, np.int64)])
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.diff(np.searchsorted(begin, firsts))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up, self.parts = list(range(n)), n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart."""
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
            self.parts -= 1
        return i != j
