"""N-gram language model of a corpus, and scores of its texts by a weighted backoff automaton.

Smoothing: P(w | h) = (c(h w) + K * P(w | h')) / (c(h) + K), h' being h without its first word, P(w) the
add-one unigram share, and K a number for each length of h. So an n-gram that was seen is an arc with its own
log-probability, a state's failure arc weighs log10(K / (c(h) + K)), and all words' probabilities after any
history add up to one. A text begins in the empty history and ends in one end token.

At scale the model is never in one place. Tasks pack texts into blocks of a bounded size. A block sends its
distinct n-grams (sorted hashes, as differences) to the cells of their leading bits; a cell adds up the training
counts of all blocks and answers each block in the order it asked; a block then builds the automaton of its own
n-grams, and many of its texts run through it at once, from left to right. A block talks to at most 2**FAN cells:
where there are more, blocks are put together by regions, each of which asks on for all of its blocks (`answers`),
so that messages grow in proportion to the texts on every level, and levels with the logarithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, distinct, id_and_text, mix, slices, texts_of, word_hashes

ORDER = 3
#: Weight of the lower order, in tokens, by the length of the history; chosen on the held-out texts of sf0.1.
K = (6400.0, 5.0)
#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
#: n-grams that a cell gets from all blocks, roughly; bytes of text that bring one distinct n-gram of one order.
CELL_GRAMS, GRAM_BYTES = 1 << 21, 10
#: A block sends to at most 2**FAN cells, a region unites at most REGION blocks.
FAN, REGION = 12, 1024
#: Tokens that a lane of the automaton's traversal covers.
LANE = 512
#: The end token's hash; no word has it but by chance.
END = np.uint64(0x5EED0FE4D0FE4D01)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words between blanks, A-Z lower-cased, each text with its end; tokens of each text."""
    words, size = word_hashes(texts)
    ends = np.cumsum(size + 1) - 1
    out = np.empty(len(words) + len(texts), np.uint64)
    plain = np.ones(len(out), bool)
    plain[ends] = False
    out[ends], out[plain] = END, words
    return out, size + 1


def gram_hashes(words: np.ndarray, order: int) -> list[np.ndarray]:
    """By n-1: the hash of the n words that begin at each place."""
    out = [mix(words)]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            out.append(mix(out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :] + np.uint64(n)))
    return out


class Keys:
    """Keys of n-grams: leading bits of their hashes, then n-1. The bits follow the corpus, up to 58.

    With m distinct n-grams of one order and b bits, m * m / 2 ** (b + 1) pairs of them are expected to share a key, and
    then count as one: with GRAM_BYTES bytes of text for each, under one pair at 10 MB, some 30 at 0.5 GB, some thousands
    at 30 GB, and at 100 TB one n-gram in some hundred. Counts of words (n_known, base_score), of which there are far
    fewer than of longer n-grams, are exact but for that. More bits would make messages longer than the disk allows."""

    def __init__(self, size: int, order: int):
        self.order, self.tag = order, max(1, (order - 1).bit_length())
        self.width = min(58, max(44, int(size).bit_length() + 18)) + self.tag
        self.cells = int(max(0, np.ceil(np.log2(max(1, size * order / GRAM_BYTES / CELL_GRAMS)))))

    def __call__(self, words: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """By n-1: keys of the n-grams that begin at each place; _NONE for those that would reach over a text's end."""
        owner = np.repeat(np.arange(len(size)), size)
        out = []
        for n, h in enumerate(gram_hashes(words, self.order)):
            key = h >> np.uint64(64 - self.width + self.tag) << np.uint64(self.tag) | np.uint64(n)
            key[owner[n:] != owner[: len(owner) - n]] = _NONE
            out.append(key)
        return out


_NONE = np.uint64(1 << 62)  # above all keys


class Wire:
    """Sorted distinct keys and their counts as bytes: differences in byte planes, of which only the top one compresses."""

    def __init__(self):
        self.squeeze, self.expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

    def counts(self, n: np.ndarray) -> bytes:
        """A byte for each count, and those of 255 and more once again in full."""
        return self.squeeze(np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes())

    def told(self, b: bytes, size: int) -> np.ndarray:
        raw = self.expand(b)
        n = np.frombuffer(raw, np.uint8, size).astype(np.int64)
        n[n == 255] = np.frombuffer(raw, "<u8", offset=size)
        return n

    def keys(self, keys: np.ndarray, base: int) -> bytes:
        gap = np.diff(keys, prepend=np.uint64(base))
        w = max(1, -(-int(gap.max(initial=0)).bit_length() // 8))
        planes = np.ascontiguousarray(gap.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T)
        return planes[: w - 1].tobytes() + self.squeeze(planes[w - 1].tobytes()) + bytes([w])

    def known(self, b: bytes, size: int, base: int) -> np.ndarray:
        w, cut = b[-1], size * (b[-1] - 1)
        gap = np.zeros((size, 8), np.uint8)
        gap[:, : w - 1] = np.frombuffer(b, np.uint8, cut).reshape(w - 1, size).T
        gap[:, w - 1] = np.frombuffer(self.expand(b[cut:-1]), np.uint8)
        return np.cumsum(gap.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)


def _parts(keys: np.ndarray, low: int) -> list[tuple[int, int, int]]:
    """Stretches (cell, begin, end) of sorted keys that agree in all but the ``low`` last bits."""
    top = (keys >> np.uint64(low)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(top)) + 1
    return [(int(top[a]), int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(keys)]) if b > a]


_ASK = "asker long, cell long, size long, keys binary, counts binary"
_TOLD = "asker long, cell long, size long, counts binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [f for f, _ in fields])


def _united(batches: Iterator[pa.RecordBatch], low: int, wire: Wire) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray, np.ndarray]:
    """What each asker asked (asker, cell, where its keys stand), all keys, and their summed counts."""
    rows = [r for b in batches for r in b.to_pylist()]
    asked = [wire.known(r["keys"], r["size"], r["cell"] << low) for r in rows]
    keys = distinct(np.concatenate(asked))
    sums, where = np.zeros(len(keys), np.int64), []
    for i, r in enumerate(rows):
        at, asked[i] = np.searchsorted(keys, asked[i]).astype(np.int32), None
        sums[at] += wire.told(r["counts"], len(at))
        where.append((r["asker"], r["cell"], at))
    return where, keys, sums


def answers(asks: DataFrame, askers: int, bits: int, keys: Keys) -> DataFrame:
    """Rows (asker, cell, size, counts): to each row of asks the summed counts of its keys, in their order.

    bits: leading bits that a cell of asks stands for.
    """
    low = keys.width - bits

    def answer(key: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wire = Wire()
        where, _, sums = _united(batches, low, wire)
        for i in range(0, len(where), 256):
            yield _batch(_TOLD, [(a, c, len(at), wire.counts(sums[at])) for a, c, at in where[i : i + 256]])

    if bits >= keys.cells:
        return asks.groupBy("cell").applyInArrow(answer, _TOLD)
    more, regions = min(FAN, keys.cells - bits), -(-askers // REGION)
    dealt = asks.withColumn("region", F.pmod(F.xxhash64("asker"), F.lit(regions)))

    def ask_on(key: tuple[pa.Scalar, pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wire = Wire()
        _, own, sums = _united(batches, low, wire)
        yield _batch(_ASK, [(key[0].as_py(), c, b - a, wire.keys(own[a:b], c << low - more), wire.counts(sums[a:b])) for c, a, b in _parts(own, low - more)])

    def pass_on(key: tuple[pa.Scalar, pa.Scalar], left: pa.Table, right: pa.Table) -> pa.Table:
        wire = Wire()
        where, own, _ = _united(left.to_batches(), low, wire)
        told = sorted(((r["cell"], r["size"], r["counts"]) for r in right.to_pylist()))
        sums = np.concatenate([wire.told(c, n) for _, n, c in told])
        return pa.Table.from_batches([_batch(_TOLD, [(a, c, len(at), wire.counts(sums[at])) for a, c, at in where])])

    got = answers(dealt.groupBy("region", "cell").applyInArrow(ask_on, _ASK), regions, bits + more, keys)
    up = got.select(F.col("asker").alias("region"), F.shiftright("cell", more).alias("over"), "cell", "size", "counts")
    return dealt.groupBy("region", "cell").cogroup(up.groupBy("region", "over")).applyInArrow(pass_on, _TOLD)


class Arcs:
    """A hash table of arcs, (state, word) to a log10 probability and the next state, read for many at once."""

    def __init__(self, keys: np.ndarray, log: np.ndarray, to: np.ndarray):
        self.log, self.to = log, to
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.table, self.at = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = keys[left[free]]
            in_ = self.table[slot] == keys[left]
            self.at[slot[in_]] = left[in_]
            left, slot = left[~in_], slot[~in_] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each arc is, -1 for none."""
        out, live, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(live):
            got = self.table[slot]
            hit = got == keys
            out[live[hit]] = self.at[slot[hit]]
            on = ~hit & (got >= 0)
            live, keys, slot = live[on], keys[on], slot[on] + 1 & (1 << self.bits) - 1
        return out


class Automaton:
    """States are histories (0: the empty one). Words are numbers; the empty history has an arc for each of them."""

    def __init__(self, grams: list[np.ndarray], counts: np.ndarray, k: tuple[float, ...], total: int, types: int):
        """grams, by n-1: a number for the n-gram at each place of the texts, -1 for none; counts: training counts by number."""
        self.order, self.words, floor = len(grams), len(counts), total + types + 1  # N + 1 * (V + 1)
        self.known = counts
        state, p = np.zeros(len(counts), np.int64), np.zeros(len(counts))
        log, fall, fail, arcs = [np.zeros(1)], [np.zeros(1, np.int64)], 1, []
        place = np.zeros(len(counts), np.int32)
        for n, gram in enumerate(grams, 1):
            place[gram[gram >= 0]] = np.flatnonzero(gram >= 0)
            own = np.zeros(len(counts), bool)
            own[gram[gram >= 0]] = True
            own = np.flatnonzero(own & (counts > 0))
            at = place[own]
            if n == 1:
                p[own] = (counts[own] + 1) / floor
            else:
                history, rest = grams[n - 2][at], grams[n - 2][at + 1]
                p[own] = (counts[own] + k[n - 2] * p[rest]) / (counts[history] + k[n - 2])
            if n < self.order:
                state[own] = np.arange(fail, fail + len(own))
                fail += len(own)
                log.append(np.log10(k[n - 1] / (counts[own] + k[n - 1])))
                # what a history falls back to is itself without its first word
                fall.append(state[rest] if n > 1 else np.zeros(len(own), np.int64))
            if n > 1:
                arcs.append((state[history] * self.words + grams[0][at + n - 1].astype(np.int64), np.log10(p[own]), state[own] if n < self.order else state[rest]))
        self.weight, self.fall = np.concatenate(log), np.concatenate(fall)
        self.root, self.first = np.log10((counts + 1) / floor), state if self.order > 1 else np.zeros(len(counts), np.int64)
        self.arcs = Arcs(*map(np.concatenate, zip(*arcs))) if arcs else Arcs(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of a word in each state, failure arcs included, and the states that follow."""
        total, state = np.zeros(len(state)), state.copy()
        arc, open_ = np.full(len(state), -1, np.int64), np.flatnonzero(state)
        while len(open_):
            found = self.arcs.find(state[open_] * self.words + word[open_])
            arc[open_] = found
            open_ = open_[found < 0]
            total[open_] += self.weight[state[open_]]
            state[open_] = self.fall[state[open_]]
            open_ = open_[state[open_] > 0]
        by = arc >= 0
        total += np.where(by, self.arcs.log[arc] if len(self.arcs.log) else 0.0, self.root[word])
        return total, np.where(by, self.arcs.to[arc] if len(self.arcs.to) else 0, self.first[word])

    def score(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 probability of each text; words: those of all texts in a row, size: how many each has.

        A text runs in lanes of LANE words, side by side. A lane begins order-1 words earlier without counting them:
        they lead from the empty history to the state that the lane before ends in.
        """
        first = np.cumsum(size) - size
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        begin = first[text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(begin + LANE, first[text] + size[text])
        start = np.maximum(begin - self.order + 1, first[text])
        by = np.argsort(start - end, kind="stable")  # the longest first, so that those still running stand in front
        begin, start, length = begin[by], start[by], (end - start)[by]
        state, total = np.zeros(len(by), np.int64), np.zeros(len(by))
        for t in range(length.max(initial=0)):
            m = int(np.searchsorted(-length, -t))
            got, state[:m] = self.step(state[:m], words[start[:m] + t].astype(np.int64))
            total[:m] += np.where(start[:m] + t >= begin[:m], got, 0.0)
        return np.bincount(text[by], weights=total, minlength=len(size))


def numbered(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams at each place by the place of their keys among all distinct ones (-1: none), and those sorted."""
    flat = np.concatenate(keys)
    by = np.argsort(flat)
    flat = flat[by]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    at = np.empty(len(flat), np.int32)
    at[by] = np.cumsum(new, dtype=np.int32) - 1
    own = flat[new]
    if len(own) and own[-1] == _NONE:
        at[at == len(own) - 1] = -1
        own = own[:-1]
    return np.split(at, np.cumsum([len(k) for k in keys[:-1]])), own


def corpus_size(rows: DataFrame) -> tuple[int, int, int]:
    """Training tokens, distinct ones (train: boolean column), and bytes of all texts, counted over all rows."""
    bits = 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0

        def out() -> pa.RecordBatch:
            keys = distinct(np.concatenate([*held, np.zeros(0, np.uint64)]))
            parts = _parts(keys, 64 - bits)
            return pa.RecordBatch.from_arrays([pa.array([-1, *(c for c, _, _ in parts)], pa.int32()), pa.array([n, *(0 for _ in parts)], pa.int64()), pa.array([size, *(0 for _ in parts)], pa.int64()), pa.array([b"", *(keys[a:b].tobytes() for _, a, b in parts)], pa.binary())], ["cell", "n", "size", "keys"])

        for batch in slices(batches):
            texts = texts_of(batch)
            size += sum(map(len, texts))
            words, _ = tokens([t for t, x in zip(texts, batch.column("train").to_pylist()) if x])
            n += len(words)
            held.append(distinct(words))
            if sum(map(len, held)) > 2_000_000:
                held = [distinct(np.concatenate(held))]
                if len(held[0]) > 1_000_000:
                    yield out()
                    held, n, size = [], 0, 0
        yield out()

    def types(key: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, keys = 0, 0, np.zeros(0, np.uint64)
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            size += sum(batch.column("size").to_pylist())
            keys = distinct(np.concatenate([keys, *(np.frombuffer(b, np.uint64) for b in batch.column("keys").to_pylist())]))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, len(keys), size)], ["n", "v", "size"])

    parts = rows.select("text", "train").mapInArrow(run, "cell int, n long, size long, keys binary")
    # the row of cell -1 holds token totals, one for each task and million types
    return tuple(int(x or 0) for x in parts.groupBy("cell").applyInArrow(types, "n long, v long, size long").agg(F.sum("n"), F.sum("v"), F.sum("size")).first())


_BLOCK = "block long, ids array<long>, train array<boolean>, sizes array<long>, texts binary"


def pack(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Rows (doc_id, text, train) in blocks of about so many bytes of text, or of one longer text. Call once and keep: a
    block's number is its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=4).compress
        ids, train, texts, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([squeeze(b"".join(texts))], pa.binary())], ["block", "ids", "train", "sizes", "texts"])

        for batch in slices(batches, size=min(block_bytes, 1 << 20)):
            own = texts_of(batch)
            more = sum(map(len, own))
            if held and held + more > block_bytes:
                yield out()
                number, ids, train, texts, held = number + 1, [], [], [], 0
            ids += batch.column("doc_id").to_pylist()
            train += batch.column("train").to_pylist()
            texts += own
            held += more
        if ids:
            yield out()

    return rows.select("doc_id", "text", "train").mapInArrow(run, _BLOCK)


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's tokens, tokens of each text, and which texts teach."""
    data, ends = zstandard.ZstdDecompressor().decompress(row["texts"]), np.cumsum(row["sizes"]).tolist()
    words, size = tokens([data[a:b] for a, b in zip([0, *ends], ends)])
    return words, size, np.array(row["train"], bool)


def score_texts(docs: DataFrame, held_out: Callable, order: int = ORDER, k: float | tuple[float, ...] = K, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    held_out(column of ids) says which rows teach nothing. Null texts are empty: one end token. base_score is
    the add-one unigram log10 probability, score the model's; k is one number or one for each length of a history
    from 1 on. Repeated rows score alike (and are counted as often as they stand there, if they teach). With nothing
    learned every token has probability 1. An empty table gives no rows; other columns of docs are not read.
    """
    weights = (float(k),) * (order - 1) if isinstance(k, (int, float)) else tuple(k)
    if len(weights) < order - 1:
        raise ValueError(f"order {order} needs {order - 1} weights")
    rows = id_and_text(docs, id_col, text_col).withColumn("train", ~held_out(F.col("doc_id")))
    total, types, size = corpus_size(rows)
    keys = Keys(size, order)
    blocks = checkpoint(pack(rows, block_bytes))
    fan = min(FAN, keys.cells)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wire, low = Wire(), keys.width - fan
        for row in (r for b in batches for r in b.to_pylist()):
            words, size, train = _open(row)
            teaches = np.repeat(train, size).astype(np.uint64)
            flat = np.concatenate([x[ok] << np.uint64(1) | teaches[: len(x)][ok] for x in keys(words, size) for ok in [x != _NONE]])
            flat.sort()
            own, teach = flat >> np.uint64(1), flat & np.uint64(1)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            own, count = own[starts], np.add.reduceat(teach, starts)
            parts = _parts(own, low)
            for i in range(0, len(parts), 256):
                yield _batch(_ASK, [(row["block"], c, b - a, wire.keys(own[a:b], c << low), wire.counts(count[a:b])) for c, a, b in parts[i : i + 256]])

    def run(key: tuple[pa.Scalar], left: pa.Table, right: pa.Table) -> pa.Table:
        row, wire = left.to_pylist()[0], Wire()
        words, size, train = _open(row)
        grams, _ = numbered(keys(words, size))
        del words
        told = sorted((r["cell"], r["size"], r["counts"]) for r in right.to_pylist())
        counts = np.concatenate([wire.told(c, n) for _, n, c in told])
        made = Automaton(grams, counts, weights, total, types)
        first = np.cumsum(size) - size
        base = np.add.reduceat(made.root[grams[0]], first)
        known = np.add.reduceat((counts[grams[0]] > 0).astype(np.int64), first)
        score = made.score(grams[0], size)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "train": pa.array(train), "n_tokens": pa.array(size.astype(np.int64)), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})

    told = answers(blocks.mapInArrow(ask, _ASK), blocks.count(), fan, keys)
    out = blocks.groupBy("block").cogroup(told.groupBy("asker")).applyInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), lambda c: crc_mod(c, 7) == 2)
