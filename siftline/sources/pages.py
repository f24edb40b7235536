"""Snapshots of many pages: each is an object with results and the name of the next; all pages are read side by side."""

from __future__ import annotations

from posixpath import dirname
from urllib.parse import unquote, urljoin, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_PAGES = 1_000


class SnapshotError(ValueError):
    """A snapshot whose pages are not what they should be."""


def plan(spark: SparkSession, first: str, most: int = MOST_PAGES) -> list[str]:
    """Paths of a snapshot's pages from the first on, by their ``next``.

    One pass reads, for all JSON files beside the first, what each says of itself: a row a page comes to the driver.
    It is an error if a page leads to another folder or host, to one that is missing or has been, to more than ``most``;
    if a page has no list of results or one with rows that are no objects; and if the first page's count, where it has
    one, isn't the number of rows.
    """
    folder = dirname(first)
    shape = "count long, next string, results array<variant>"
    rows = spark.read.schema(shape).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*.json")
    odd = F.size(F.filter("results", lambda r: ~F.coalesce(F.schema_of_variant(r).startswith("OBJECT"), F.lit(False))))
    told = rows.select(F.col("_metadata.file_path").alias("path"), "count", "next", F.col("results").isNull().alias("none"), F.coalesce(F.size("results"), F.lit(0)).alias("n"), F.coalesce(odd, F.lit(0)).alias("odd"))
    # a page is one object: a file of several rows is an array and no page
    pages = told.groupBy("path").agg(F.first("count").alias("count"), F.first("next").alias("next"), (F.bool_or("none") | (F.count("*") > 1)).alias("none"), F.sum("n").alias("n"), F.sum("odd").alias("odd"))
    known = {urlparse(unquote(r["path"])).path: r for r in pages.collect()}
    base, at, out, total = urlparse(first), urlparse(first).path, [], 0
    while True:
        if len(out) == most:
            raise SnapshotError(f"more than {most} pages")
        page = known.get(at)
        if page is None:
            raise SnapshotError(f"page {len(out) + 1} is missing: {at}")
        if page["none"]:
            raise SnapshotError(f"malformed page {len(out) + 1}: {at}")
        if page["odd"]:
            raise SnapshotError(f"{page['odd']} rows of page {len(out) + 1} are no objects: {at}")
        out.append(page["path"])
        total += page["n"]
        if not page["next"]:
            break
        to = urlparse(urljoin(f"{base.scheme or 'file'}://{base.netloc}{at}", page["next"]))
        if (to.scheme, to.netloc, dirname(unquote(to.path))) != (base.scheme or "file", base.netloc, dirname(base.path)):
            raise SnapshotError(f"page {len(out)} leads elsewhere: {page['next']}")
        at = unquote(to.path)
        if any(urlparse(unquote(p)).path == at for p in out):
            raise SnapshotError(f"page {len(out)} leads back to {at}")
    count = known[base.path]["count"]
    if count is not None and count != total:
        raise SnapshotError(f"{count} rows announced, {total} found")
    return out


def read_pages(spark: SparkSession, first: str, schema: T.StructType, most: int = MOST_PAGES) -> DataFrame:
    """The records of all pages of a snapshot (see plan), with page, the page's number; pages are read in parallel.

    A field of another type than the schema's is null, as is one that is absent; validate.errors tells them apart.
    """
    paths = plan(spark, first, most)
    whole = T.StructType([T.StructField("results", T.ArrayType(schema))])
    rows = spark.read.schema(whole).option("multiLine", True).json(paths)
    number = F.array_position(F.array(*map(F.lit, paths)), F.col("_metadata.file_path")).cast("int")
    return rows.select(number.alias("page"), F.explode("results").alias("r")).select("r.*", "page")
