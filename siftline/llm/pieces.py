"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice of a normalised text has a node at each character boundary and an arc for each piece. Going left
to right, each node keeps one backpointer, and only the nodes that a later piece can start from (as many as
the longest piece has characters) are alive; as soon as the paths back from all of them meet in one boundary,
the ids before it are final and leave the window.

Unigram models take the arc of the best summed score. BPE models take the arc that agrees with the merge
order: the one piece that forms, with the piece its start node ends in, a pair that merging the two pieces'
characters gives back. (A sequence is the merge result exactly if each neighbouring pair is, so one such arc
exists at each node.) Best summed scores would give other ids than the library for a BPE model.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, slices

_MEMO = 400_000
#: Runs without a space longer than this aren't remembered.
_LONG = 64
_WORD = re.compile("▁*[^▁]+|▁+")
_SPACE = "▁"
_START, _UNK = -1, -2
_loaded: dict[bytes, "Pieces"] = {}


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: (number, integer or bytes)."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (buf[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if buf[i - 1] < 128:
                return n, i

    i = 0
    while i < len(buf):
        key, i = varint(i)
        if key & 7 == 0:
            v, i = varint(i)
        else:
            size, i = varint(i) if key & 7 == 2 else (4 if key & 7 == 5 else 8, i)
            v, i = buf[i : i + size], i + size
        yield key >> 3, v


class _Words(dict):
    """A word without the space sign in front of it to its packed ids. Two bounded generations."""

    def __init__(self, model: "Pieces"):
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.model.packed(_SPACE + word)
        if len(word) <= _LONG:
            if len(self) >= _MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class Pieces:
    """A model: normaliser and vocabulary from the library, the lattice search here."""

    def __init__(self, model: bytes):
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        top = list(_fields(model))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        rule = dict(_fields(next((v for k, v in top if k == 3), b"")))
        self.bpe = {1: False, 2: True}.get(trainer.get(3, 1))
        if self.bpe is None:
            raise ValueError("only unigram and BPE models have a lattice")
        self.dummy = bool(rule.get(3, 1))
        n = sp.get_piece_size()
        kinds = [dict(_fields(v)).get(3, 1) for k, v in top if k == 1]
        if 4 in kinds:
            raise ValueError("user-defined pieces are not supported")
        self.ids = {sp.id_to_piece(i): i for i in range(n) if kinds[i] == 1}
        self.score = [sp.get_score(i) for i in range(n)]
        #: every beginning of a piece, with the piece's id or -1
        self.starts = {p[:i]: -1 for p in self.ids for i in range(1, len(p))} | self.ids
        self.longest = max(map(len, self.ids), default=1)
        byte = {sp.id_to_piece(i): i for i in range(n) if kinds[i] == 6}
        self.bytes = [byte.get(f"<0x{b:02X}>") for b in range(256)] if byte else None
        self.unk, self.unk_score = sp.unk_id(), min(self.score, default=0.0) - 10
        #: no piece goes on over the start of a word, so such places are boundaries of any segmentation
        self.by_words = not any(_SPACE in p.lstrip(_SPACE) for p in self.ids)
        self.out = [b"" if kinds[i] == 3 else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if kinds[i] == 6 else " ⁇ ".encode() if kinds[i] == 2 else sp.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(n)]
        self.pairs: dict[int, dict[int, bool]] = {}
        self.memo = _Words(self)
        self.widest = 0

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the pair of the best score first, the leftmost of equals."""
        parts, ids, score = list(text), self.ids, self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, before: int, piece: int) -> bool:
        row = self.pairs.setdefault(before, {})
        known = row.get(piece)
        if known is None:
            if len(row) > 30_000:
                row.clear()
            p = self.sp.id_to_piece(piece)
            known = row[piece] = self.merged(p) == [p] if before < 0 else self.merged((q := self.sp.id_to_piece(before)) + p) == [q, p]
        return known

    def search(self, text: str) -> Iterator[int]:
        """Ids of a normalised text, or of a stretch between places where all paths have converged, as they become final.

        The window is back, last and total, from ``base`` on: what lies before is committed. Backpointers of the last
        ``longest`` places are followed until one place is left, and all up to it goes out.
        """
        longest, bpe, score, fits = self.longest, self.bpe, self.score, self._fits
        get = self.starts.get
        n = len(text)
        base, back, last, total = 0, [0], [_START], [0.0]
        for start in range(n):
            at = start - base
            if at >= 4 * longest and not start % longest:
                alive = set(range(start - longest + 1, start + 1))
                while len(alive) > 1:
                    far = max(alive)
                    alive.discard(far)
                    alive.add(back[far - base])
                meet = alive.pop()
                self.widest = max(self.widest, at)
                if meet > base:
                    yield from self._path(text, base, meet, back, last)
                    cut = meet - base
                    del back[:cut], last[:cut], total[:cut]
                    base = meet
                    at = start - base
            before, sum_, size = last[at], total[at], len(back)
            for end in range(start + 1, min(n, start + longest) + 1):
                k = get(text[start:end])
                if k is None or k < 0:  # no piece begins so, or longer ones only
                    if end == start + 1:
                        s = sum_ + self.unk_score
                        if end - base == size:
                            back.append(start)
                            last.append(_UNK)
                            total.append(s)
                            size += 1
                        elif last[at + 1] is None or not bpe and s > total[at + 1]:
                            back[at + 1], last[at + 1], total[at + 1] = start, _UNK, s
                    if k is None:
                        break
                    continue
                to = end - base
                while size <= to:
                    back.append(0)
                    last.append(None)
                    total.append(0.0)
                    size += 1
                if bpe:
                    if last[to] is None:
                        if fits(before, k):
                            back[to], last[to] = start, k
                else:
                    s = sum_ + score[k]
                    if last[to] is None or s > total[to]:
                        back[to], last[to], total[to] = start, k, s
        yield from self._path(text, base, n, back, last)

    def _path(self, text: str, base: int, end: int, back: list[int], last: list[int]) -> list[int]:
        out: list[int] = []
        while end > base:
            start, piece = back[end - base], last[end - base]
            if piece != _UNK:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(text[start:end].encode()))
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
            end = start
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian 32-bit integers; the empty text has none.

        No piece reaches over the start of a word, so all paths converge there and the search commits: a stretch of text
        is a word. Stretches that have been committed before are remembered, up to a bound.
        """
        norm = self.sp.normalize(text)
        if not self.by_words:
            return np.fromiter(self.search(norm), "<i4").tobytes()
        if norm[:1] == _SPACE and _SPACE * 2 not in norm and norm[-1:] != _SPACE:
            return b"".join(map(self.memo.__getitem__, norm[1:].split(_SPACE)))
        return b"".join([self.memo[w[1:]] if w[:1] == _SPACE else self.packed(w) for w in _WORD.findall(norm)])

    def packed(self, text: str) -> bytes:
        ids = list(self.search(text))
        return struct.pack(f"<{len(ids)}i", *ids)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, without the space that normalising puts in front."""
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (raw[1:] if self.dummy and raw[:1] == b" " else raw).decode("utf-8", "replace")


def _model(shared) -> Pieces:
    if shared.value not in _loaded:
        _loaded.clear()
        _loaded[shared.value] = Pieces(shared.value)
    return _loaded[shared.value]


def _share(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>) for each row of docs; a null or empty text has no ids. No begin or end ids."""
    shared = _share(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists([model.encode(t or "") for t in batch.column("text").to_pylist()])], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, text) for each row of coded; null or no ids give the empty text."""
    shared = _share(coded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.decode(np.array(x or [], "<i4").tobytes()) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(coded[id_col].cast("long").alias("doc_id"), coded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: rows (doc_id, n_pieces, ids_sha256, decoded_sha256, round_trip).

    ids_sha256 is over the ids as little-endian 32-bit integers. round_trip says whether decoding gave the
    text back (null counts as empty); a text that itself has the model's space sign U+2581 comes back with
    plain spaces. Repeated rows give equal rows; an empty table gives none, and other columns are not read.
    """
    shared = _share(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = model.encode(text or "")
                back = model.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == (text or "")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_())))], ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
