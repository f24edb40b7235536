"""A training corpus from raw documents in five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, langid, linededup, minhash, pieces
from siftline.llm.common import Stash, crc_mod

#: Documents whose best language is less like them than this are rejected, as are those without letters.
MIN_LANGUAGE_SCORE = 0.1
#: A text of so many effective trigrams can reach a cosine near 1, one of a z-th part of them sqrt(z).
REACH = 128
#: Clean texts of sf0.1 with scores under 0.15 fall short of that by up to 0.32.
SPREAD = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised or that are too short to tell; `lang` stays as given.

    Null and empty texts and those without a letter go. Repeated rows share a fate; an empty table, or one without
    labels, gives no rows.
    """
    model = langid.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    rest = [c for c in docs.columns if c != "text"]
    told = langid.predict(docs.select("text", F.struct(*rest).alias("row")), model)
    least = F.least(F.lit(MIN_LANGUAGE_SCORE), F.sqrt(F.col("trigrams") / REACH) - SPREAD)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("text", "row.*").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more share; n_chars follows the text.

    Null texts become empty ones. Each row stays, also repeated ones and those left without a line; an id of several
    texts counts as one document. An empty table gives no rows.
    """
    out = linededup.drop_common_lines(docs, carry=[c for c in docs.columns if c not in ("text", "n_chars")])
    return out.select("row.*", "text", F.length("text").cast("long").alias("n_chars")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id (with all rows of that id).

    Rows with a null id, and null, empty and blank texts, are no copies and stay. An empty table gives no rows.
    """
    copies = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none. Repeated rows share a fate; an empty table gives no rows.
    """
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=[c for c in docs.columns if c != "text"])
    return found.where(F.size("spans") == 0).select("text", "row.*").select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_pieces, ids_sha256, decoded_sha256, round_trip) of what is left.

    A null or empty text has no pieces. Repeated rows give equal rows; an empty table gives none.
    """
    import public_tokenizers

    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: Language identification and sentence pieces can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table goes to the shared folder and is read by the next.

    A table goes when the one after it is written; the last one stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Stash(spark)
    for i, (_, stage) in enumerate(STAGES[:-1], 1):
        docs = tables(stage(spark, docs, sf_dir))
        tables.drop(i - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
