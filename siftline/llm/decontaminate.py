"""Benchmark decontamination: one automaton over the windows of all items, one scan over each text.

Words are mapped to single code points (words that no item has, to one stop sign), so a window of ten words
is a string of ten characters, and the automaton has at most ten states for each window.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, slices, texts_of

WINDOW = 10
#: Bytes of item texts in one automaton; a larger benchmark is dealt into several, each with a scan of its own.
BLOCK_BYTES = 4 << 20

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STOP = "\x01"
_built: dict[str, tuple] = {}


def words(text: bytes) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(_CLEAN).split()


def _sign(i: int) -> str:
    return chr(i + 2 if i + 2 < 0xD800 else i + 2 + 0x800)


def pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """Rows (item, text): items cut into pieces of about ``most`` bytes that have all their windows, and no others.

    A piece repeats the last window - 1 words of the one before. An item of ``most`` bytes or fewer is one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=most):
            out = []
            for item, text in zip(batch.column("item").to_pylist(), texts_of(batch)):
                if len(text) <= most:
                    out.append((item, text))
                    continue
                held, size = [], 0
                for w in words(text):
                    if size + len(w) + 1 > most and len(held) >= window:
                        out.append((item, b" ".join(held)))
                        held = held[len(held) - window + 1 :]
                        size = sum(map(len, held)) + len(held)
                    held.append(w)
                    size += len(w) + 1
                # fewer words than a window are one only if they are all the item has
                if len(held) >= window or not out or out[-1][0] != item:
                    out.append((item, b" ".join(held)))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([t for _, t in out], pa.binary())], ["item", "text"])

    return items.mapInArrow(run, "item string, text binary")


def build(items: list[tuple[str, bytes]], window: int = WINDOW) -> tuple:
    """(word to sign, automaton or None): a pattern's value is (its length, the items that have it)."""
    signs: dict[bytes, str] = {}
    owners: dict[str, set[str]] = {}
    for item, text in items:
        coded = "".join([signs.get(w) or signs.setdefault(w, _sign(len(signs))) for w in words(text)])
        for i in range(max(1, len(coded) - window + 1) if coded else 0):
            owners.setdefault(coded[i : i + window], set()).add(item)
    if not owners:
        return signs, None
    automaton = ahocorasick.Automaton()
    for pattern, who in owners.items():
        automaton.add_word(pattern, (len(pattern), tuple(sorted(who))))
    automaton.make_automaton()
    return signs, automaton


def scan(text: bytes, built: tuple) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit spans as word positions [start, end) in order and apart, and the items found."""
    signs, automaton = built
    found = words(text)
    if automaton is None or not found:
        return len(found), [], set()
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    get = signs.get
    for end, (n, who) in automaton.iter("".join([get(w, _STOP) for w in found])):
        items.update(who)
        start, end = end - n + 1, end + 1
        while spans and start <= spans[-1][1]:
            last = spans.pop()
            start, end = min(start, last[0]), max(end, last[1])
        spans.append((start, end))
    return len(found), spans, items


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as UTF-8 byte spans of the original text."""
    cleaned, out, at, i = text.translate(_CLEAN), [], 0, 0
    where: list[tuple[int, int]] = []
    for w in cleaned.split():
        at = cleaned.index(w, at)
        where.append((at, at + len(w)))
        at += len(w)
    for a, b in spans:
        out.append((where[a][0], where[b - 1][1]))
    return out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, n_words, spans, items) for each row of docs, and with ``carry`` its text and a struct ``row`` of those columns.

    spans: hit stretches as structs (start, end) of word positions; items: ids of the items found, as strings
    in order. Null or empty texts have no words; items without words match nothing; repeated items count once
    by id; an item with a null id is left out. Repeated rows are scanned alike, an empty table gives no rows.
    The items of one automaton have a bounded number of bytes: where the benchmark has more, its items (long ones in
    pieces) are dealt into blocks, which are scanned for one after the other, with what was found kept in between.
    """
    items = benchmark.select(benchmark[item_id].cast("string").alias("item"), benchmark[item_text].cast("string").alias("text")).where("item is not null and text is not null")
    items = pieces(items, window, max(1, block_bytes // 8))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # pieces are dealt by a hash, so half a block's room is left for its chance of more
    blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    items = checkpoint(items) if blocks > 1 else items
    out = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"), (F.struct(*(docs[c] for c in carry)) if carry else F.struct(F.lit(0).alias("none"))).alias("row"))
    schema = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    schema = T.StructType([*T.StructType.fromDDL(schema).fields, out.schema["row"]])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect() if blocks > 1 else items.collect()
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["item"], bytes(r["text"])) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=k == blocks - 1) -> Iterator[pa.RecordBatch]:
            name, own = shared.value
            if name not in _built:
                _built.clear()
                _built[name] = build(own, window)
            built = _built[name]
            for batch in slices(batches):
                counts, spans, who = [], [], []
                for text, old, had in zip(texts_of(batch), batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                    n, new, found = scan(text, built)
                    counts.append(n)
                    spans.append(merge([*((s["start"], s["end"]) for s in old), *new]) if old else new)
                    who.append(sorted({*had, *found}))
                text = pa.nulls(batch.num_rows, pa.string()) if last and carry is None else batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array(counts, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span), pa.array(who, pa.list_(pa.string())), batch.column("row")], ["doc_id", "text", "n_words", "spans", "items", "row"])

        out = out.mapInArrow(run, schema)
        if k < blocks - 1:  # so that the driver and the tasks hold one block at a time
            out = checkpoint(out)
            shared.unpersist()
    return out.drop("text", "row") if carry is None else out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(found: DataFrame) -> DataFrame:
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP6_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w),10) n, array_to_string(w[i:i+9],' ') g FROM (SELECT item, w, unnest(range(1, greatest(len(w)-9,1)+1)) i FROM b WHERE len(w)>0)),
d AS (SELECT doc_id, row_number() OVER () r, coalesce(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), CAST([] AS VARCHAR[])) w FROM documents),
g AS (SELECT r, n, i, array_to_string(w[i:i+n-1],' ') g FROM (SELECT r, w, n, unnest(range(1, len(w)-n+2)) i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w)>=n)),
m AS (SELECT DISTINCT g.r, g.i, g.n, win.item FROM g JOIN win ON g.n=win.n AND g.g=win.g),
h AS (SELECT r, count(DISTINCT p) n_hit FROM (SELECT r, unnest(range(i, i+n)) p FROM (SELECT DISTINCT r,i,n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit,0) AS BIGINT) n_hit, CAST(coalesce(n_items,0) AS BIGINT) n_items, sha256(coalesce(s,'')) items_sha256, coalesce(n_hit,0)>0 contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
