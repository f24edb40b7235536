"""Chunks of documents: paragraphs natively, and packing to token targets in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, MOST, OVERLAP, LEAST = 500, 700, 80, 30
PER_TOKEN = 2.3
_SENTENCE = re.compile(r"(?<=[.!?।])\s+")


def size_of(chars: int) -> int:
    """Tokens of so many characters."""
    return max(1, int(chars / PER_TOKEN)) if chars > 0 else 0


def tokens(text: str) -> int:
    return size_of(len(text))


def signature(target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST, excluded: str | None = None) -> str:
    """A name for the settings: chunks of other settings are other chunks, as are those of records that another pattern
    of titles (``excluded``) leaves out."""
    return f"t{target}-m{most}-o{overlap}-n{least}" + (f"|x={excluded}" if excluded is not None else "")


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """Rows (id, chunk_index, content) for each line of text that isn't blank, renumbered from 0."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return docs.select("id", F.posexplode(F.transform(lines, lambda x: F.trim(x))).alias("chunk_index", "content"))


def atoms(text: str, most: int) -> Iterator[str]:
    """Paragraphs; sentences of those that are too long; runs of words of sentences that are."""
    for paragraph in filter(None, map(str.strip, text.split("\n"))):
        if tokens(paragraph) <= most:
            yield paragraph
            continue
        for sentence in _SENTENCE.split(paragraph):
            if tokens(sentence) <= most:
                yield sentence
                continue
            run: list[str] = []
            size = 0
            for word in sentence.split():
                for piece in [word[i : i + 2 * most] for i in range(0, len(word), 2 * most)]:
                    # whole characters add up; tokens of single words are rounded down
                    if run and int((size + len(piece)) / PER_TOKEN) > most:
                        yield " ".join(run)
                        run, size = [], 0
                    run.append(piece)
                    size += len(piece) + 1
            if run:
                yield " ".join(run)


def pack(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of about target and at most ``most`` tokens; each begins with the end of the one before if that fits."""
    if tokens(text) <= most:
        return [text.strip()] if text.strip() else []
    out: list[list[str]] = []
    run: list[str] = []
    chars = 0  # of the run's text
    for atom in atoms(text, most - overlap):
        if run and size_of(chars + 1 + len(atom)) > target:
            out.append(run)
            words, n = run[-1].split(), 0
            at = len(words)
            while at and size_of(len(words[at - 1]) + 1 + n) <= overlap:
                at -= 1
                n += len(words[at]) + (1 if n else 0)
            run, chars = ([" ".join(words[at:])], n) if n and size_of(n + 1 + len(atom)) <= most else ([], 0)
        chars += len(atom) + (1 if run else 0)
        run.append(atom)
    if run:
        if out and tokens("\n".join(run)) < least and tokens("\n".join(out[-1] + run[-1:])) <= most:
            out[-1].append(run[-1])
        else:
            out.append(run)
    return ["\n".join(c) for c in out]


# Words of contexts, lines that are no headings, and how a numbered provision begins.
APPENDIX, BODY_TEXT, TOPIC = "অংশ: তফসিল/সংযুক্তি", "অংশ: মূল পাঠ", "প্রসঙ্গ"
QNA, CATEGORY, KEYWORD, QUESTION, ANSWER = "সরকারি প্রশ্নোত্তর", "বিষয়শ্রেণি", "মূলশব্দ", "প্রশ্ন", "উত্তর"
BLOG, AUTHOR, DATE, FORUM, TALK, PART = "ব্লগ", "লেখক", "তারিখ", "ফোরাম", "ফোরাম আলোচনা", "অংশ"
NOISE = {"আদেশক্রমে", "বিতরণ", "অনুলিপি", "সূচিপত্র", "সংযুক্তি"}
PROVISION = re.compile(r"\s*([০-৯]{1,4}[ক-হ]?)\s*।\s*(\S.*)")
PROVISIONS = 3
# How lines begin and end that are no headings, and their length.
ITEM, OPENS, SIGNED, ENDS = "- ", tuple("([“\""), ("স্বা/-", "স্বাঃ", "মোঃ", "(মোঃ"), (":-", *"।.,;—\"”)")
HEADING_CHARS = (4, 80)
_CAPTION_END = re.compile(r"\s*[ঃ:]|\s*[-–—]\s*\(|\s+\(")


def is_numbered(s: str) -> bool:
    """A line that begins with a number and its mark, or holds nothing but numbers."""
    digits = s.lstrip("০১২৩৪৫৬৭৮৯0123456789")
    return digits != s and digits.lstrip()[:1] in ("।", ".", ")") and digits.lstrip() != "" or not s.strip("০১২৩৪৫৬৭৮৯0123456789().- \t")


def is_heading(line: str) -> bool:
    """A short line that is no list item, table row, number, signature or sentence."""
    s = line.strip()
    least, most = HEADING_CHARS
    if not least <= len(s) <= most or s in NOISE:
        return False
    item, row = s.startswith(ITEM), " | " in s
    quoted, signature, sentence = s.startswith(OPENS), s.startswith(SIGNED), s.endswith(ENDS)
    return not (item or row or quoted or signature or sentence or is_numbered(s))


def long_text(text: str, room: int, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str, str | None, list[str]]]:
    """(content, heading, provisions) of a text without units, in chunks of at most ``room`` tokens.

    With three numbered provisions or more, runs of whole provisions make up chunks up to the target, named by the one
    they begin with; one that is too large is cut, and each part has its name. Else the text is packed, and each chunk
    is named by the last heading at or before its first line.
    """
    lines = [x for x in text.split("\n") if x.strip()]
    opens = [PROVISION.match(x) for x in lines]
    headings = [None, *accumulate((x if is_heading(x) else None for x in lines), lambda a, b: b or a)]
    if sum(map(bool, opens)) < PROVISIONS:
        out, at = [], 0
        for part in pack("\n".join(lines), min(target, room), room, min(overlap, room // 4), least):
            first = part.split("\n", 1)[0]
            at = next((i for i in range(at, len(lines)) if lines[i].strip() == first.strip()), at)
            heading = headings[at + 1]
            out.append((part, None if heading == first else heading, []))
        return out
    starts = [0, *(i for i, m in enumerate(opens) if m and i), len(lines)]
    sized = []  # (text, heading, number, tokens) of each provision and of what stands before the first
    for a, b in zip(starts, starts[1:]):
        m = opens[a]
        name = f"{m[1]}। {_CAPTION_END.split(m[2], maxsplit=1)[0].strip()[:70]}".strip() if m else headings[b]
        body = "\n".join(lines[a:b])
        sized.append((body, name, [m[1]] if m else [], tokens(body)))
    out, used = [], 0
    for body, name, number, n in sized:
        if n > room:
            out += [(part, name, number) for part in pack(body, min(target, room), room, 0, least)]
            used = room + 1
        elif out and used + n <= min(target, room):
            out[-1] = (f"{out[-1][0]}\n{body}", out[-1][1], out[-1][2] + number)
            used += n
        else:
            out.append((body, name, number))
            used = n
    return out


def _chunks(row: dict, target: int, most: int, overlap: int, least: int) -> Iterator[tuple[str, str, dict]]:
    """(context, content, {part, heading, provisions}) of a document that is no tree, by its type."""
    kind, title, text = row["source_type"], row["title"] or "", row["body"] or ""
    room = lambda context: max(2 * least, most - tokens("\n".join(context)))
    packed = lambda context, t: pack(t, min(target, room(context)), room(context), min(overlap, room(context) // 4), least)
    if kind == "ebook":
        context = [f"দলিলের নাম: {title}", APPENDIX if row["role"] == "appendix" else BODY_TEXT]
        for k, (part, heading, provisions) in enumerate(long_text(text, max(2 * least, room(context) - 30), target, overlap, least), 1):
            yield "\n".join([*context, *([f"{TOPIC}: {heading}"] if heading else [])]), part, {"part": k, "heading": heading, "provisions": provisions}
        return
    if kind.startswith("qna"):
        context = [QNA, *(f"{label}: {row[c]}" for label, c in ((CATEGORY, "category"), (KEYWORD, "keyword")) if row[c])]
        if tokens(text) <= room(context):
            parts = [text] if text.strip() else []
        else:
            context = [*context, f"{QUESTION}: {title}"]
            parts = [f"{ANSWER} ({PART} {k}): {p}" for k, p in enumerate(packed(context, text.split(f"\n{ANSWER}: ", 1)[-1]), 1)]
    else:
        context = [f"{BLOG}: {title}", *([f"{AUTHOR}: {row['author']}"] if row["author"] else []), *([f"{DATE}: {row['publication_date']}"] if row["publication_date"] else [])] if kind == "blog" else [f"{TALK} ({row['group_name'] or ''}): {title}"] if kind == "topic" else [f"{FORUM}: {title}"]
        parts = packed(context, text)
    for k, part in enumerate(parts, 1):
        yield "\n".join(context), part, {"part": k, "heading": None, "provisions": []}


_PLAIN = ["source_type", "source_id", "title", "body", "role", "category", "keyword", "author", "publication_date", "group_name"]


def chunk_documents(docs: DataFrame, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Rows (source_type, source_id, chunk_index, context, content, part, heading, provisions, token_count, content_hash)
    of documents that are no trees: long texts of books, questions with answers, blogs, forums and topics.

    docs: source_type, source_id, title, body, and any of role, category, keyword, author, publication_date, group_name
    (what is missing is null). An unknown type is an error; blank bodies give no chunk; other columns are not read.
    """
    rows = docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in _PLAIN))
    kinds = ("ebook", "qna", "qna_type1", "qna_type2", "blog", "forum", "topic")
    rows = rows.withColumn("source_type", F.when(F.col("source_type").isin(*kinds), F.col("source_type")).otherwise(F.raise_error(F.concat(F.lit("unknown source type "), F.coalesce("source_type", F.lit("null"))))))
    out_kind = pa.schema([("source_type", pa.string()), ("source_id", pa.string()), ("chunk_index", pa.int32()), ("context", pa.string()), ("content", pa.string()), ("part", pa.int32()), ("heading", pa.string()), ("provisions", pa.list_(pa.string())), ("token_count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for i, (context, content, more) in enumerate(_chunks(row, target, most, overlap, least)):
                    out.append({"source_type": row["source_type"], "source_id": row["source_id"], "chunk_index": i, "context": context, "content": content, "token_count": tokens(context) + tokens(content)} | more)
            yield pa.RecordBatch.from_pylist(out, schema=out_kind)

    out = rows.mapInArrow(run, "source_type string, source_id string, chunk_index int, context string, content string, part int, heading string, provisions array<string>, token_count long")
    return out.withColumn("content_hash", F.sha2(F.concat_ws("\u001f", "context", "content"), 256))


def chunk(docs: DataFrame, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Rows (id, chunk_index, content, token_count, content_hash) of docs (id, text); blank texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, c, tokens(c)) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) for k, c in enumerate(pack(t or "", target, most, overlap, least))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int64()))], ["id", "chunk_index", "content", "token_count"])

    out = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, chunk_index int, content string, token_count long")
    return out.withColumn("content_hash", F.sha2("content", 256))
