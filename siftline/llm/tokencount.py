"""Token counts of whole texts, with huge texts encoded in overlapping chunks that are spliced again.

Chunks of a huge text start on a fixed grid and run past the next start. In the stretch that two chunks share,
a place where both begin a new pre-token is a proven splice: the first chunk is in step with the whole text
there, and what follows depends only on the text from there on. Where no such place is found the first
chunk's overlap is widened.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, slices

LIMIT = 1024
HUGE = 32_768
CHUNK, OVERLAP = 16_384, 256
#: The end of a chunk in which its pre-tokens may differ from the whole text's.
_TAIL = 32
_MEMO = 400_000
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD_SPACE = re.compile(r"[^\S \n]")
_loaded: dict[str, Counter] = {}


class Counter:
    """Counts with one byte-level tokenizer, given as the text of its .json file."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        rule = json.loads(spec)
        self.special = [t["content"] for t in rule.get("added_tokens") or []]
        if isinstance(rule.get("post_processor"), dict) and "trim_offsets" in rule["post_processor"]:
            rule["post_processor"]["trim_offsets"] = False  # offsets that cover the text; ids stay the same
        pre = rule.get("pre_tokenizer") or {}
        # the cut into units below is proven for this pre-tokenizer only
        self.by_units = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not rule.get("normalizer")
        self.tokenizer = Tokenizer.from_str(json.dumps(rule))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def plain(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, text: str) -> tuple[list[int], list[int]]:
        """Where pre-tokens begin, and how many tokens stand before each; then the whole length and count."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        at, before, last = [], [], object()
        for i, (word, (a, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if word is None or word != last:
                at.append(a)
                before.append(i)
            last = word
        return [*at, len(text)], [*before, len(e)]

    def huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        total, start, begin = 0, 0, 0  # begin: the proven place from which this chunk counts
        at, before = self.starts(text[: chunk + overlap])
        while True:
            end, wide = start + at[-1], overlap
            if end >= len(text):
                return total + before[-1] - before[at.index(begin - start)]
            nxt = start + chunk
            at2, before2 = self.starts(text[nxt : nxt + chunk + overlap])
            while True:
                theirs = {nxt + a for a in at2[1:-1]}
                place = next((start + a for a in at if start + a in theirs and begin < start + a < end - _TAIL), None)
                if place is not None or end >= len(text):
                    break
                wide *= 4
                at, before = self.starts(text[start : nxt + wide])
                end = start + at[-1]
                if nxt + at2[-1] < end:
                    at2, before2 = self.starts(text[nxt : nxt + wide + chunk])
            if place is None:
                return total + before[-1] - before[at.index(begin - start)]
            total += before[at.index(place - start)] - before[at.index(begin - start)]
            start, begin, at, before = nxt, place, at2, before2

    def counts(self, texts: list[str]) -> list[int]:
        out, todo = [0] * len(texts), []
        for i, t in enumerate(texts):
            if len(t) > HUGE:
                out[i] = self.huge(t)
            elif not self.by_units or _ODD_SPACE.search(t) or any(s in t for s in self.special):
                out[i] = self.plain([t])[0]
            else:
                # a pre-token never ends in, or goes on over, white space after another character: texts
                # fall apart there, and the units' counts add up
                todo.append((i, _UNIT.findall(t)))
        if len(self.memo) > _MEMO:  # two bounded generations
            self.old, self.memo = self.memo, {}
        new = {u for _, units in todo for u in units} - self.memo.keys()
        known = new & self.old.keys()
        self.memo.update((u, self.old[u]) for u in known)
        new = list(new - known)
        self.memo.update(zip(new, self.plain(new)))
        for i, units in todo:
            out[i] = sum(map(self.memo.__getitem__, units))
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for each row of docs, as the tokenizers library counts.

    Null texts are empty: no bytes, no tokens. Special strings inside texts are handled as the library's
    default. Repeated rows count alike; an empty table gives no rows, and other columns are not read. The tokenizer file is read once on the driver and broadcast (its size
    is the vocabulary's, not the data's).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = Counter(shared.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = _loaded[tokenizer_path].counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
