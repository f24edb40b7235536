"""Spelling variants: k-d trees over letter counts, box-pruned searches within one edit, letters compared in order."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, anew_text, checkpoint, id_and_text, runs_of, slices, texts_of

MIN_CHARS = 7
MIN_COUNT = 2
#: A form is this many times as frequent as the word.
TIMES = 10
#: One (document, run) in so many loses a code point.
NOISE = 31
#: Letters a-z and U+00C0 to U+00FF, numbered 0 to 89.
LETTERS = 90
#: Words of one leaf of the shared tree, with their letter counts, take about so many bytes.
LEAF_BYTES = 4 << 20
#: Words that a leaf of the shared tree is fitted on, taken by their hash; words of a leaf of a task's own tree.
SAMPLE, BUCKET = 64, 48
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Letters that are compared at a time.
_AT_ONCE = 4 << 20

_PLAIN = re.compile(rb"[a-z]{%d,}" % MIN_CHARS)
_WIDE = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_CHARS)
#: Texts longer than this are not turned into a list of words at once.
_LONG = 1 << 20


def runs_in(text: bytes) -> Counter[bytes]:
    """Maximal runs of MIN_CHARS letters or more with A-Z lower-cased, and how often each occurs."""
    low = text.lower()  # of bytes: A-Z only
    if low.isascii():
        return Counter(_PLAIN.findall(low) if len(low) < _LONG else (m[0] for m in _PLAIN.finditer(low)))
    wide = low.decode(errors="replace")
    return Counter(w.encode() for w in (_WIDE.findall(wide) if len(low) < _LONG else (m[0] for m in _WIDE.finditer(wide))))


def count_words(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """docs: doc_id, text. Rows (word, n) of all words with MIN_COUNT occurrences or more.

    Where ``noise`` divides the crc32 of '<doc_id>:<run>', the run loses the code point at crc32 modulo its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                begun = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in runs_in(text).items():
                    h = zlib.crc32(word, begun)
                    if h % noise == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        if len(letters) == MIN_CHARS:
                            continue
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    return np.where(codes < 128, codes - 97, codes - 0xC0 + 26).astype(np.uint8)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """How often each letter stands in each row."""
    n, length = letters.shape
    out = np.zeros((n, LETTERS), np.int16 if length < 1 << 15 else np.int32)
    step = max(1, _AT_ONCE // (LETTERS + length))
    for at in range(0, n, step):
        own = letters[at : at + step]
        out[at : at + step] = np.bincount((np.arange(len(own))[:, None] * LETTERS + own).ravel(), minlength=len(own) * LETTERS).reshape(-1, LETTERS)
    return out


class Tree:
    """A k-d tree over letter counts: each node parts its points by one letter's count, as evenly as it can."""

    def __init__(self, points: np.ndarray, bucket: int):
        #: (letter, count, left, right) of each node: left has counts up to it; a leaf has letter -1 and its number.
        self.nodes: list[tuple[int, int, int, int]] = []
        #: Places of each leaf's points.
        self.leaves: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), bucket)

    def _grow(self, points: np.ndarray, at: np.ndarray, bucket: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, len(self.leaves), 0, 0))
        if len(at) > bucket:
            seen = points[at[:: max(1, len(at) // 512)]]
            middle = np.partition(seen, len(seen) // 2, axis=0)[len(seen) // 2]
            best = (0, 0, 0)
            for cut in (middle, middle - 1):
                left = (seen <= cut).sum(0)
                even = np.minimum(left, len(seen) - left)
                letter = int(even.argmax())
                best = max(best, (int(even[letter]), letter, int(cut[letter])))
            even, letter, cut = best
            low = points[at, letter] <= cut
            if even and low.any() and not low.all():
                left = self._grow(points, at[low], bucket)
                right = self._grow(points, at[~low], bucket)
                self.nodes[me] = (letter, cut, left, right)
                return me
        self.leaves.append(at)
        return me

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf each point falls into."""
        return self._walk(points, 0, 0, alone=True)[1]

    def reach(self, points: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, leaves): the leaves whose boxes hold counts of at most ``up`` letters more and ``down`` letters fewer."""
        return self._walk(points, up, down)

    def _walk(self, points: np.ndarray, up: int, down: int, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        zero = np.zeros(len(points), np.int32)
        stack = [(0, np.arange(len(points)), zero, zero, {})]
        places, leaves = [], []
        while stack:
            node, at, more, fewer, box = stack.pop()
            letter, cut, left, right = self.nodes[node]
            if not len(at):
                continue
            if letter < 0:
                places.append(at)
                leaves.append(np.full(len(at), cut))
                continue
            x = points[at, letter].astype(np.int32)
            low, high = box.get(letter, (-1, 1 << 30))
            if alone:
                ok = x <= cut
                stack += [(left, at[ok], more, fewer, box), (right, at[~ok], more, fewer, box)]
                continue
            # distances to the halves' boxes: this letter's part is taken out and put in anew
            d = fewer - np.maximum(0, x - high) + np.maximum(0, x - cut)
            ok = d <= down
            stack.append((left, at[ok], more[ok], d[ok], box | {letter: (low, cut)}))
            u = more - np.maximum(0, low - x) + np.maximum(0, cut + 1 - x)
            ok = u <= up
            stack.append((right, at[ok], u[ok], fewer[ok], box | {letter: (cut + 1, high)}))
        at, leaf = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (places, leaves))
        if alone:
            leaf[at] = leaf.copy()
        return at, leaf


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each word of a and each of b, of one length, whether just one letter differs."""
    return (a[:, None, :] != b[None, :, :]).sum(2, dtype=np.int32) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each word of a and each of b, one letter longer, whether b is a with one letter put in."""
    length = a.shape[1]
    first = np.logical_and.accumulate(a[:, None, :] == b[None, :, :length], axis=2).sum(2, dtype=np.int32)
    last = np.logical_and.accumulate((a[:, None, :] == b[None, :, 1:])[:, :, ::-1], axis=2).sum(2, dtype=np.int32)
    return first + last >= length


class Leaf:
    """The words of one leaf of a length's shared tree, with a tree of their own."""

    def __init__(self, words: list[str], n: np.ndarray):
        order = sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i]))  # the first of several is the best form
        self.words, self.n = [words[i] for i in order], n[order]
        self.letters = letters_of(self.words)
        self.counts = counts_of(self.letters)
        self.tree = Tree(self.counts, BUCKET)
        self.boxes = [(self.counts[at].min(0), self.counts[at].max(0)) for at in self.tree.leaves]

    def pairs(self, letters: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of the asked words, places of own words) within one replaced letter or, of shorter words, one put in."""
        longer = self.letters.shape[1] - letters.shape[1]
        up, down, alike = 1, 1 - longer, inserted if longer else replaced
        at, leaf = self.tree.reach(counts, up, down)
        order = np.argsort(leaf, kind="stable")
        at, leaf = at[order], leaf[order]
        cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            own, (low, high) = self.tree.leaves[leaf[a]], self.boxes[leaf[a]]
            asked = at[a:b]
            x = counts[asked].astype(np.int32)
            more, fewer = np.maximum(0, low - x).sum(1), np.maximum(0, x - high).sum(1)
            # a box that is one point is at its exact distance
            asked = asked[(more == up) & (fewer == down) if (low == high).all() else (more <= up) & (fewer <= down)]
            step = max(1, _AT_ONCE // (len(own) * letters.shape[1]))
            for k in range(0, len(asked), step):
                i, j = np.nonzero(alike(letters[asked[k : k + step]], self.letters[own]))
                yield asked[k : k + step][i], own[j]

    def near(self, words: list[str], n: np.ndarray, itself: bool = False) -> pa.RecordBatch:
        """Rows (word, n_near, best_n, best): of each asked word its near words here, of each word here its near asked words."""
        length, own = len(words[0]), len(self.words[0])
        letters = self.letters if itself else letters_of(words)
        found = list(self.pairs(letters, self.counts if itself else counts_of(letters)))
        i, j = (np.concatenate([*(f[k] for f in found), np.zeros(0, np.int64)]) for k in (0, 1))
        rows = _told(i, j, words, self.words, self.n)
        if own > length:  # replaced letters are found from both words
            order = np.array(sorted(range(len(words)), key=lambda k: (-int(n[k]), words[k])))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            rows += _told(j, place[i], self.words, [words[k] for k in order], n[order])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], ["word", "n_near", "best_n", "best"])


def _told(i: np.ndarray, j: np.ndarray, words: list[str], others: list[str], n: np.ndarray) -> list[tuple[str, int, int, str]]:
    """Near words counted for each i, with the first j."""
    count, best = np.bincount(i, minlength=len(words)), np.full(len(words), len(others))
    np.minimum.at(best, i, j)
    return [(words[k], int(count[k]), int(n[best[k]]), others[best[k]]) for k in np.flatnonzero(count).tolist()]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell and kind: a leaf's own words (0), then the words that ask there (1)."""
    held: list[pa.RecordBatch] = []
    cell, leaf = None, None

    def opened() -> Iterator[pa.RecordBatch]:
        nonlocal held, leaf
        if held:
            t = pa.Table.from_batches(held)
            leaf, held = Leaf(t.column("word").to_pylist(), t.column("n").to_numpy()), []
            yield leaf.near(leaf.words, leaf.n, itself=True)

    for (own, kind), batch in runs_of(batches, "cell", "kind"):
        if own != cell:
            yield from opened()
            cell, leaf = own, None
        if kind == 0:
            held.append(batch)
            continue
        yield from opened()
        if leaf:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for length in {len(w) for w in words}:
                some = [k for k, w in enumerate(words) if len(w) == length]
                yield leaf.near([words[k] for k in some], n[some])
    yield from opened()


def _routed(trees: dict[int, Tree]):
    """Each word goes to the leaf that it falls into, and asks in the leaves that its edits can fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            size = np.array([len(w) for w in words])
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                counts = counts_of(letters_of([words[k] for k in at])) if {length, length + 1} & set(trees) else None
                none = np.zeros(len(at), np.int64)
                home = trees[length].leaf_of(counts) if length in trees else none
                parts = [(np.arange(len(at)), home, length, 0)]
                if length in trees:
                    who, leaf = trees[length].reach(counts, 1, 1)
                    away = leaf != home[who]
                    parts.append((who[away], leaf[away], length, 1))
                who, leaf = trees[length + 1].reach(counts, 1, 0) if length + 1 in trees else (np.arange(len(at)), none)
                parts.append((who, leaf, length + 1, 1))
                for who, leaf, to, kind in parts:
                    for k in range(0, len(who), 10_000):
                        some = at[who[k : k + 10_000]]
                        cells = (to << 32) + leaf[k : k + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.full(len(some), kind), pa.int32()), batch.column("word").take(pa.array(some)), pa.array(n[some])], ["cell", "kind", "word", "n"])

    return run


def shared_trees(words: DataFrame, leaf_bytes: int = LEAF_BYTES) -> dict[int, Tree]:
    """A tree for each length whose words take more than leaf_bytes; it is fitted on SAMPLE words a leaf, taken by their hash.

    A word in some thousand comes to the driver, with lengths that have as many words; every word is searched.
    """
    room = F.greatest(F.lit(1), F.floor(leaf_bytes / (F.col("length") + 2 * LETTERS)))
    sizes = words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > room).select("length", (F.col("count") / room).alias("leaves"), (SAMPLE / room).alias("share"))
    seen = words.select("word", F.length("word").alias("length")).join(F.broadcast(sizes), "length").where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    by: dict[int, list[str]] = defaultdict(list)
    for word, in seen.select("word").toLocalIterator():
        by[len(word)].append(word)
    out = {length: Tree(counts_of(letters_of(sorted(own))), SAMPLE) for length, own in by.items()}
    for tree in out.values():
        tree.leaves = []  # of the sample
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf_bytes: int = LEAF_BYTES, noise: int = NOISE) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): of each frequent word the more frequent spelling that it is a variant of.

    Words, near words, forms and roots are those of the contract of op13. Null texts have no words, repeated rows count
    as often as they come, a null id counts as no digits before the colon; of near words equally frequent the first in
    code-point order is the form. Other columns are not read. An empty table, or one without frequent words, gives no rows.

    The words of a length lie in leaves of a k-d tree over their letter counts (one leaf up to leaf_bytes). A word asks
    in the leaves of its own length whose boxes one letter more and one fewer can reach, and in those of the next length
    one letter more can reach; a leaf's words have a tree of their own, whose buckets are pruned by their boxes before
    letters are compared in order. No pair leaves a task, only a word's count and best near word there.
    """
    words = checkpoint(count_words(id_and_text(docs, id_col, text_col), noise))
    routed = words.mapInArrow(_routed(shared_trees(words, leaf_bytes)), "cell long, kind int, word string, n long")
    found = routed.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_search, "word string, n_near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    form = F.when(-F.col("first.less") >= TIMES * F.col("n"), F.col("first.best"))
    stash = Stash(words.sparkSession)
    told = stash(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("first.less")).alias("form_n")))
    # a form is ten times as frequent, so ways are short and have no loops; each round doubles what is gone of them
    way = stash(told.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = way.join(way.select(F.col("word").alias("root"), F.col("root").alias("later")), "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("went"))
        on = stash(on)
        way = on.select("word", "root")
        if on.where("went").isEmpty():
            break
    out = checkpoint(told.join(way.select(anew_text("word"), "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    stash.drop()
    return out


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
