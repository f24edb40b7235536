"""Exact dedup in DataFrame functions only: group by a 128-bit content hash and the bytes themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint


def md5_bytes(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, h, text_sha256), one for each row of docs: which id stays of its equal texts.

    Texts are equal if their bytes are; a null text counts as empty, and empty texts are equal with each other. The
    largest id of a group stays. Rows that repeat both id and text share their fate and each count for group_size; an
    id of several texts is treated text by text. A null id never stays where another id has the text; a group of null
    ids only keeps them all, with keep_id null. Other columns are not read. An empty table gives no rows.

    Rows are counted by hash and text before the shuffle, so that a text moves once for each task that meets it,
    however many copies it has, and two texts of one hash are two groups. What comes back is one row for each hash
    that occurs more than once; the rows meet it by their hashes only, in a join that adaptive execution can split.
    Hashes of several texts, should there be any, are told apart by a second join on hash and text.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", digest(F.col("text")).alias("h"), "text")
    classes = rows.groupBy("h", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    by_hash = classes.groupBy("h").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.max("keep_id").alias("keep_id"))
    many = checkpoint(by_hash.where("n > 1 or texts > 1"))
    # the empty addition hides how the written table is dealt out, so that both sides of the join are dealt anew
    anew = F.concat(F.col("h"), F.lit(b"")).alias("h")
    told = rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256")).join(many.select(anew, "texts", "n", "keep_id"), "h", "left")
    out = told.where("texts is null or texts = 1").select("doc_id", F.when(F.col("texts") == 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "h", "text_sha256")
    mixed = many.where("texts > 1")
    if not mixed.isEmpty():
        apart = rows.join(mixed.select(anew), "h", "left_semi")
        own = apart.groupBy("h", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).select(anew, "text", "group_size", "keep_id")
        out = out.union(apart.join(own, ["h", "text"]).select("doc_id", "keep_id", "group_size", "h", F.sha2("text", 256)))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "h", "text_sha256")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER w keep_id, count(*) OVER w group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w kept, sha256(coalesce(text,'')) text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text,''))
"""
