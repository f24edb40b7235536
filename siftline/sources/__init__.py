"""Readers and writers of snapshots, question sets, versioned tables and whole indexes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lexical_text
from .commits import CommitLog, Conflict, Files, Snapshot


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON array or of an object's ``results``; what doesn't fit the schema is in _corrupt_record.

    A missing file is an error, as is one that holds an object without ``results`` (`{"detail": ...}` is no record). An
    empty array gives no rows. Of each file only the first characters are read before the query runs.
    """
    whole = T.StructType([*schema.fields, T.StructField("results", T.ArrayType(schema)), T.StructField("_corrupt_record", T.StringType())])
    files = Files(spark, path)
    names = [n for n in files.names(path) if not n.startswith(("_", "."))] if files.exists(path) else []
    head = lambda n: files.head(path if files.is_file(path) else f"{path.rstrip('/')}/{n}").lstrip("\ufeff \t\r\n")
    objects = [n for n in names if head(n)[:1] == "{"]
    rows = spark.read.schema(whole).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.select("*", (F.col("_metadata.file_name").isin(objects) if objects else F.lit(False)).alias("_object"))
    name = schema.fields[0].name
    bad = F.col("_object") & F.col("_corrupt_record").isNull()
    first = F.when(bad, F.raise_error(F.lit(f"{path}: neither records nor an object with results"))).otherwise(F.col(f"`{name}`"))
    own = rows.where("results is null").withColumn(name, first.cast(schema.fields[0].dataType)).drop("results", "_object")
    inner = rows.select(F.explode("results").alias("r")).select("r.*", F.lit(None).cast("string").alias("_corrupt_record"))
    return own.unionByName(inner)


def write_snapshot(df: DataFrame, path: str) -> None:
    """JSON arrays, one file for each partition; read_snapshot reads the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            for x in batch.column("j").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first else ",") + x])], ["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["]" if not first else "[]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("j")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question sets as JSON lines, empty and `//` lines skipped: id, question, expected_source_ids, expected_answer, tags.

    A question without an id is `ex` and its place among the questions. A line that isn't a question with its expected
    ids is an error. Sets are files that people keep: one task numbers them.
    """
    schema = "id string, question string, expected_source_ids array<string>, expected_answer string, tags array<string>"
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(//.*)?$")).withColumn("line", F.monotonically_increasing_id())
    rows = lines.select("value", "line", F.from_json("value", schema).alias("r"))
    bad = F.col("r.question").isNull() | F.col("r.expected_source_ids").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a question: "), F.substring("value", 1, 80)))).otherwise(F.col("r.question"))
    place = F.row_number().over(Window.orderBy("line")) - 1
    return rows.select(F.coalesce("r.id", F.concat(F.lit("ex"), place.cast("string"))).alias("id"), checked.alias("question"), "r.expected_source_ids", "r.expected_answer", "r.tags")


def write_questions(rows: DataFrame, path: str) -> None:
    """Question sets as JSON lines."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """One suggestion for each form as questions are normalised (digits, spelling variants, punctuation), the one that
    stands first; empty and `#` lines and those without a word are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$")).withColumn("line", F.monotonically_increasing_id())
    form = lexical_text(F.col("value"))
    return lines.select("value", "line", form.alias("form")).where("form <> ''").groupBy("form").agg(F.min_by("value", "line").alias("question"), F.min("line").alias("line"))


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> dict:
    """A run's rows as JSON lines in path/rows and its summary (one row) in path/summary; the summary is returned."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")
    return summary.first().asDict(True)


def fingerprint(df: DataFrame) -> dict:
    """Rows and two sums of row hashes: the same for the same rows in any order, repeats counted, nulls told by their column."""
    cols = [F.struct(F.lit(i), F.col(f"`{c}`").isNull(), F.to_json(F.struct(F.col(f"`{c}`").alias("x")))) for i, c in enumerate(sorted(df.columns))]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(name) for seed, name in ((1, "mark"), (2, "mark2"))]
    return df.agg(F.count("*").alias("rows"), *sums).first().asDict()


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


class VersionedTables:
    """Tables of a commit log by their names, for writers of one table at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), CommitLog(spark, root)

    def version(self, name: str) -> int:
        """The version that last wrote the table; 0 where none has."""
        return self.log.snapshot().tables.get(name, {"since": 0})["since"]

    def read(self, name: str) -> DataFrame:
        return self.log.snapshot().read(name)

    def publish(self, name: str, df: DataFrame, since: int | None = None) -> int:
        """Write the table anew: readers see the old or the new one whole.

        Nothing is written over what the caller has not seen: if another has written the table since version ``since``
        (none told: since the call), that is a Conflict. Versions never go back.
        """
        base = self.log.snapshot()
        if since is not None and base.tables.get(name, {"since": 0})["since"] != since:
            raise Conflict(f"{name} is not of version {since}")
        return self.log.commit(base, {name: df}).version

    def manifest(self, name: str, key: str) -> str:
        """Row count, distinct keys and a fingerprint that doesn't depend on order, as JSON; of one snapshot."""
        snapshot = self.log.snapshot()
        df = snapshot.read(name)
        keys = df.agg(F.countDistinct(key)).first()[0]
        return json.dumps(fingerprint(df) | {"keys": keys, "version": snapshot.tables[name]["since"]}, sort_keys=True)

    def check_import(self, name: str, key: str, manifest: str) -> None:
        """An error if the table isn't what the manifest says."""
        told, is_ = json.loads(manifest), json.loads(self.manifest(name, key))
        wrong = [k for k in ("rows", "mark", "mark2", "keys") if told[k] != is_[k]]
        if wrong:
            raise ValueError(f"{name}: {', '.join(wrong)} differ from the manifest")


FORMAT = 1


def export_index(spark: SparkSession, tables: dict[str, DataFrame], path: str, about: dict, pending: DataFrame | None = None) -> dict:
    """Write tables and a manifest (row counts, fingerprints, columns, ``about``: dim, model, pipeline, signature) to a
    folder that appears whole or not at all. Refused while any row is pending; run ids of this place are left out."""
    if pending is not None and not pending.isEmpty():
        raise ValueError("some chunks have no vector of this model yet")
    files, partial = Files(spark, path), f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}"
    manifest = {"format": FORMAT, "about": about, "tables": {}}
    for name, df in tables.items():
        if "last_run_id" in df.columns:
            df = df.withColumn("last_run_id", F.lit(None).cast(df.schema["last_run_id"].dataType))
        df.write.parquet(f"{partial}/{name}")
        # the fingerprint is of what was written
        manifest["tables"][name] = fingerprint(spark.read.parquet(f"{partial}/{name}")) | {"columns": sorted(df.columns)}
    files.write(f"{partial}/manifest.json", json.dumps(manifest, sort_keys=True))
    files.rename(partial, path)
    return manifest


def export_snapshot(snapshot: Snapshot, names: list[str], path: str, about: dict, pending: DataFrame | None = None) -> dict:
    """export_index of tables as they all were at one commit, whatever is committed meanwhile."""
    return export_index(snapshot.log.spark, {n: snapshot.read(n) for n in names}, path, about | {"version": snapshot.version}, pending)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))


def check_compatibility(manifest: dict, about: dict, other_model: bool = False) -> list[str]:
    """Warnings; an error for another format or dimension, and for another model unless that is allowed."""
    told = manifest["about"]
    if manifest["format"] != FORMAT:
        raise ValueError(f"format {manifest['format']}, not {FORMAT}")
    if told.get("dim") != about.get("dim"):
        raise ValueError(f"vectors of {told.get('dim')}, not {about.get('dim')}")
    if told.get("model") != about.get("model") and not other_model:
        raise ValueError(f"vectors of model {told.get('model')}, not {about.get('model')}")
    return [f"{k} {told.get(k)}, not {about.get(k)}" for k in ("model", "pipeline", "signature") if told.get(k) != about.get(k)]


def import_index(spark: SparkSession, path: str, into: VersionedTables, schemas: dict[str, T.StructType], about: dict, force: bool = False, other_model: bool = False) -> tuple[dict, list[str]]:
    """Publish an exported index's tables in one commit, all checked before: names, fingerprints, columns.

    Columns that the export lacks are null. Tables that have rows are replaced only with ``force``. Returns the manifest
    and warnings; what was done is a row of the table `imports`, in the same commit. If another commit has written one of
    the tables meanwhile, that is a Conflict and nothing is imported.
    """
    manifest = read_manifest(spark, path)
    warnings = check_compatibility(manifest, about, other_model)
    if set(manifest["tables"]) != set(schemas):
        raise ValueError(f"tables {sorted(manifest['tables'])}, not {sorted(schemas)}")
    read, base = {}, into.log.snapshot()
    for name, told in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if extra := set(df.columns) - set(schemas[name].names):
            raise ValueError(f"{name}: unknown columns {sorted(extra)}")
        if bad := [k for k, v in fingerprint(df).items() if told[k] != v]:
            raise ValueError(f"{name}: {', '.join(bad)} differ from the manifest")
        if not force and name in base and not is_empty(base.read(name)):
            raise ValueError(f"{name} has rows")
        read[name] = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas[name]))
    row = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(path).alias("path"), F.lit(json.dumps(manifest, sort_keys=True)).alias("manifest"), F.lit("; ".join(warnings)).alias("warnings"))
    into.log.commit(base, read | {"imports": row.unionByName(base.read("imports")) if "imports" in base else row})
    return manifest, warnings
