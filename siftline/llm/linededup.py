"""Line dedup in DataFrame functions only: explode, hash, count documents, drop, put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anew

MIN_DOCS = 10
MIN_CHARS = 1
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is; pure ASCII takes the fast function."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, _UP, _LOW))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, text, n_lines, n_dropped): each text without the lines that min_docs documents or more have.

    With ``carry`` a struct ``row`` of those columns of docs comes along.

    A line's key is the line stripped of blanks and lower-cased (ASCII). Keys are counted by two independent
    64-bit hashes over distinct ids (a null id is no document), a key shorter than min_chars is never dropped.
    Null and empty texts are one empty line. Repeated rows keep one row each; an id with several texts has
    each of them treated alone but counts as one document. An empty table gives no rows.

    Only hashes and positions are shuffled for the count; the texts move once, as lines, to meet the positions of
    those that go. Distinct counts are aggregated before each shuffle, so a line in every document is no hot key.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *([F.struct(*(docs[c] for c in carry)).alias("row")] if carry else []))
    # the lines are a column below the joins: above them each use would split the text anew
    rows = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.split("text", "\n").alias("parts"), *(["row"] if carry else []))
    lines = rows.select("doc_id", "mark", F.posexplode("parts").alias("pos", "line")).select("doc_id", "mark", "pos", F.btrim(ascii_lower(F.col("line")), F.lit(_BLANK)).alias("key"))
    lines = lines.where(F.length("key") >= min_chars).select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    common = lines.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") >= min_docs).select(anew("h1"), anew("h2"))
    gone = lines.join(common, ["h1", "h2"]).groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "gone")
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    left = F.array_except(F.sequence(F.lit(1), F.size("parts")), F.transform("gone", lambda i: i + 1))
    kept = F.when(F.col("gone").isNull(), F.col("parts")).otherwise(F.transform(left, lambda i: F.element_at("parts", i)))
    return met.select("doc_id", F.array_join(kept, "\n").alias("text"), F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), *(["row"] if carry else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () r, string_split(coalesce(text,''), chr(10)) ls FROM documents),
l AS (SELECT doc_id, r, pos, ls[pos] line, translate(trim(ls[pos], concat(' ',chr(9),chr(10),chr(11),chr(12),chr(13))),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') k
      FROM (SELECT doc_id, r, ls, unnest(range(1, len(ls)+1)) pos FROM d)),
c AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) t, count(*) n FROM l WHERE k NOT IN (SELECT k FROM c) GROUP BY r)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) n_lines, CAST(len(ls) - coalesce(n,0) AS BIGINT) n_dropped, sha256(coalesce(t,'')) kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
