"""Incremental sync of a snapshot with the stored state: classify, keep vectors, retire, guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DELETE_FRACTION, GUARD_FROM = 0.3, 10


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key, the last in order (nulls come first); with the number of rows that gave way.

    Each task keeps one row and a count of a key before the shuffle.
    """
    last = rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*rows.columns), F.struct(order)).alias("_r"), (F.count("*") - 1).alias("duplicates"))
    return last.select("_r.*", "duplicates")


def diff(old: DataFrame, new: DataFrame, key: str = "id", force: bool = False) -> DataFrame:
    """Rows (id, status) of a full outer join: created, updated, unchanged, missing. old: id, hash, deleted."""
    o = old.select(F.col(key).alias("k"), F.col("hash").alias("was"), F.col("deleted"))
    n = new.select(F.col(key).alias("k"), F.col("hash").alias("is_"))
    same = (F.col("was") == F.col("is_")) & ~F.col("deleted") & F.lit(not force)
    status = F.when(F.col("is_").isNull(), F.when(F.col("deleted"), "gone").otherwise("missing")).when(F.col("was").isNull(), "created").when(same, "unchanged").otherwise("updated")
    return o.join(n, "k", "full_outer").select(F.col("k").alias(key), status.alias("status"))


def delete_guard(changes: DataFrame, live: Column, group: str, limit: float = MAX_DELETE_FRACTION, least: int = GUARD_FROM) -> DataFrame:
    """Per group how many rows are missing of those alive, and whether deleting them is refused."""
    a = changes.groupBy(group).agg(F.count_if(live).alias("live"), F.count_if(F.col("status") == "missing").alias("missing"))
    return a.withColumn("refused", (F.col("live") >= least) & (F.col("missing") > limit * F.col("live")))


def reuse_vectors(chunks: DataFrame, old: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """New chunks with the vector that an old chunk of equal keys has for this model, if any."""
    kept = old.where((F.col("model") == model) & F.col("v").isNotNull()).groupBy(*keys).agg(F.min_by("v", "id").alias("v"))
    return chunks.join(kept, keys, "left")


def pending(rows: DataFrame, model: str) -> DataFrame:
    """What must be embedded: no vector, or another model's; a vector of an unknown model is left alone."""
    return rows.where(F.col("v").isNull() | (F.col("model") != model))


def run_status(results: DataFrame) -> DataFrame:
    """Per run: failed if no fetch worked, partial if anything went wrong, else succeeded."""
    a = results.groupBy("run").agg(F.count_if("fetched").alias("ok"), F.sum("errors").alias("errors"), F.count("*").alias("n"))
    return a.select("run", F.when(F.col("ok") == 0, "failed").when((F.col("errors") > 0) | (F.col("ok") < F.col("n")), "partial").otherwise("succeeded").alias("status"))


def with_ids(rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows that have an id, rows that don't, which are errors)."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    return rows.where(~blank), rows.where(blank).withColumn("errors", F.lit(f"{key}: required"))


def upsert_sources(old: DataFrame, new: DataFrame, run: str, now: Column, fetched: list[str], force: bool = False, allow_large: bool = False, limit: float = MAX_DELETE_FRACTION, least: int = GUARD_FROM) -> tuple[DataFrame, DataFrame]:
    """(the next version of the sources, one row of status for each key).

    old: source_type, id, hash, record, deleted, last_seen, last_run_id; new: source_type, id, hash, record, errors
    (null: none). Rows of new are one for each key (see last_wins). Of a type that wasn't fetched nothing changes. A
    record with errors stays as it was, and is present. What is gone from a fetched type is marked deleted, unless those
    are more than ``limit`` of its live rows and there are ``least`` of them or more (refused), or ``allow_large`` says so.
    What is seen again is live again; what is unchanged is only touched.
    """
    o = old.select("source_type", "id", *(F.col(c).alias(f"o_{c}") for c in ("hash", "record", "deleted", "last_seen", "last_run_id")), F.lit(True).alias("had"))
    n = new.where(F.col("source_type").isin(*fetched)).select("source_type", "id", F.col("hash").alias("n_hash"), F.col("record").alias("n_record"), F.col("errors").alias("n_errors"), F.lit(True).alias("has"))
    both = o.join(n, ["source_type", "id"], "full_outer")
    had, has, failed = F.col("had").isNotNull(), F.col("has").isNotNull(), F.col("n_errors").isNotNull()
    same = (F.col("o_hash") == F.col("n_hash")) & ~F.col("o_deleted") & F.lit(not force)
    status = F.when(~F.col("source_type").isin(*fetched), "not fetched").when(failed, "error").when(~has, F.when(F.col("o_deleted"), "gone").otherwise("missing")).when(~had, "created").when(same, "unchanged").otherwise("updated")
    told = both.withColumn("status", status)
    guard = told.groupBy("source_type").agg(F.count_if(had & ~F.col("o_deleted")).alias("live"), F.count_if(F.col("status") == "missing").alias("missing"))
    guard = guard.select("source_type", ((F.col("live") >= least) & (F.col("missing") > limit * F.col("live")) & F.lit(not allow_large)).alias("refused"))
    told = told.join(guard, "source_type").withColumn("status", F.when((F.col("status") == "missing") & ~F.col("refused"), "deleted").when(F.col("status") == "missing", "refused").otherwise(F.col("status")))
    written, seen = F.col("status").isin("created", "updated"), F.col("status").isin("created", "updated", "unchanged", "error")
    pick = lambda c: F.when(written, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    kept = told.where(had | written)
    table = kept.select("source_type", "id", pick("hash"), pick("record"), F.when(F.col("status") == "deleted", True).when(written, False).otherwise(F.col("o_deleted")).alias("deleted"), F.when(seen, now).otherwise(F.col("o_last_seen")).alias("last_seen"), F.when(seen | (F.col("status") == "deleted"), F.lit(run)).otherwise(F.col("o_last_run_id")).alias("last_run_id"))
    return table, told.select("source_type", "id", "status", F.col("n_errors").alias("errors"))


def document_hash(docs: DataFrame, chunks: DataFrame, fields: list[str], version: str) -> DataFrame:
    """docs (document_id, ...) with content_hash: over the version, the fields and the chunks' hashes in their order.

    chunks: document_id, chunk_index, content_hash. A document's chunk hashes are put together in one row.
    """
    own = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content_hash"))).alias("c"))
    parts = [F.lit(version), *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields), F.coalesce(F.array_join(F.transform("c", lambda x: x["content_hash"]), "\u001f"), F.lit(""))]
    return docs.join(own, "document_id", "left").withColumn("content_hash", F.sha2(F.concat_ws("\u001f", *parts), 256)).drop("c")


def upsert_documents(old: DataFrame, new: DataFrame, changed: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the next version of the documents, rows (document_id, status)).

    old: document_id, source_type, source_id, content_hash, is_active and others; new: the same without is_active, of the
    sources in changed (source_type, source_id) only. Equal and active documents stay as they are; those that a changed
    source gives no more are retired: they stay, inactive.
    """
    cols = [c for c in old.columns if c not in ("document_id", "is_active")]
    n = new.select("document_id", *(F.col(c).alias(f"n_{c}") for c in cols), F.lit(True).alias("has"))
    ours = old.join(changed.select("source_type", "source_id").distinct().withColumn("touched", F.lit(True)), ["source_type", "source_id"], "left")
    both = ours.withColumn("had", F.lit(True)).join(n, "document_id", "full_outer")
    has, had = F.col("has").isNotNull(), F.col("had").isNotNull()
    same = had & (F.col("content_hash") == F.col("n_content_hash")) & F.col("is_active") & F.lit(not force)
    status = F.when(has, F.when(same, "unchanged").when(had, "updated").otherwise("created")).when(F.col("touched") & F.col("is_active"), "retired").otherwise("kept")
    told = both.withColumn("status", status)
    written = F.col("status").isin("created", "updated")
    table = told.select("document_id", *(F.when(written, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in cols), F.when(F.col("status") == "retired", False).when(written, True).otherwise(F.col("is_active")).alias("is_active"))
    return table, told.select("document_id", "status")


def rewrite_chunks(old: DataFrame, new: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """The next version of the chunks: those of updated and retired documents go, new ones of created and updated come,
    with the vector that an old chunk of the same document and content has for this model.

    old, new: document_id, chunk_index, content_hash, others; old with v and model. documents: document_id, status.
    """
    gone = documents.where(F.col("status").isin("updated", "retired")).select("document_id")
    come = documents.where(F.col("status").isin("created", "updated")).select("document_id")
    stays = old.join(gone, "document_id", "left_anti")
    known = old.where((F.col("model") == model) & F.col("v").isNotNull()).groupBy("document_id", "content_hash").agg(F.min_by("v", "chunk_index").alias("v"))
    fresh = new.join(come, "document_id", "left_semi").join(known, ["document_id", "content_hash"], "left").withColumn("model", F.when(F.col("v").isNotNull(), model))
    return stays.unionByName(fresh.select(*stays.columns))


def run_row(changes: DataFrame, run: str, started: Column, finished: Column, fetched: list[str], failed: list[str]) -> DataFrame:
    """One row of bookkeeping: how many of each status, whether anything changed, and the run's status."""
    kinds = ("created", "updated", "unchanged", "deleted", "refused", "error")
    a = changes.agg(*(F.count_if(F.col("status") == k).alias(k) for k in kinds))
    changed = F.col("created") + F.col("updated") + F.col("deleted") > 0
    trouble = (F.col("error") + F.col("refused") > 0) | F.lit(bool(failed))
    status = F.when(F.lit(not fetched), "failed").when(trouble, "partial").otherwise("succeeded")
    return a.select(F.lit(run).alias("run"), started.alias("started"), finished.alias("finished"), *kinds, changed.alias("changed"), status.alias("status"))


def pending_since(rows: DataFrame, model: str, start: Column) -> DataFrame:
    """What a full pass embeds: no time of its vector, one before the start, or another model's."""
    return rows.where(F.col("embedded_at").isNull() | (F.col("embedded_at") < start) | (F.col("model") != model))
