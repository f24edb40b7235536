"""Retrieval quality: hit, recall and precision at k, reciprocal rank, and their means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query of expected (query_id, n_expected): ranked holds query_id, rank, relevant. Precision divides by k."""
    hits = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), *[F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"n{k}") for k in ks])
    out = expected.join(hits, "query_id", "left")
    n = lambda k: F.coalesce(f"n{k}", F.lit(0))
    cols = [("mrr", F.coalesce(1.0 / F.col("first"), F.lit(0.0)))]
    for k in ks:
        cols += [(f"hit_at_{k}", (n(k) > 0).cast("int")), (f"recall_at_{k}", F.when(F.col("n_expected") > 0, n(k) / F.col("n_expected")).otherwise(0.0)), (f"precision_at_{k}", n(k) / F.lit(k))]
    return out.select("query_id", *[c.alias(name) if name.startswith("hit") else F.round(c, 6).alias(name) for name, c in cols])


def summary(metrics: DataFrame, tags: str | None = None) -> DataFrame:
    """Means over queries, for each tag with ``tags`` (an array; none counts as `untagged`)."""
    cols = [c for c in metrics.columns if c == "mrr" or "_at_" in c]
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in cols]]
    if not tags:
        return metrics.agg(*aggs)
    some = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.col(tags)).otherwise(F.array(F.lit("untagged")))
    return metrics.withColumn("tag", F.explode(some)).groupBy("tag").agg(*aggs)


def sample(rows: DataFrame, by: str, key: str, n: int, seed: str = "s1") -> DataFrame:
    """n rows of each kind in the order of md5(seed, key): the same rows in any engine."""
    from pyspark.sql import Window

    mark = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(mark, key))).where(F.col("n") <= n)


def relevance_keys(passages: DataFrame) -> Column:
    """All `type:id` keys that a passage counts for: its document, itself, what it stands in and what it covers.

    passages: doc_source_type, doc_source_id, source_type, source_id, path (array of type, id), covers (array of ids).
    """
    key = lambda kind, i: F.concat(kind, F.lit(":"), i)
    own = F.array(key(F.col("doc_source_type"), F.col("doc_source_id")), key(F.col("source_type"), F.col("source_id")))
    path = F.transform("path", lambda u: key(u["type"], u["id"]))
    covers = F.transform("covers", lambda c: key(F.col("source_type"), c))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(own, F.coalesce(path, none), F.coalesce(covers, none))))


#: Values that may come to the driver once ranges of values have been narrowed; what the sketch of a range is off by.
FEW, ACCURACY = 50_000, 5_000


def order_statistics(rows: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at some ranks (from 0) of a column's numbers in order; nulls and NaN have no rank.

    Each pass sketches the range that still holds the ranks, counts what lies below, at and between the sketch's bounds,
    and goes on between them; equal values are counted, not sorted. The last range, of ``FEW`` values at most, comes to
    the driver as values with counts. No task holds the column.
    """
    v = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    found: dict[int, float] = {}

    def inside(part: DataFrame, below: int, n: int, left: list[int]) -> None:
        if n <= FEW:
            for r in part.groupBy("v").count().orderBy("v").collect():
                found.update({k: r["v"] for k in left if below <= k < below + r["count"]})
                below += r["count"]
            return
        slack = 2 / ACCURACY
        at = [max(0.0, (left[0] - below) / n - slack), min(1.0, (left[-1] - below + 1) / n + slack)]
        low, high = part.agg(F.percentile_approx("v", at, ACCURACY)).first()[0]
        under, lows, between, highs = part.agg(*(F.count_if(c) for c in (F.col("v") < low, F.col("v") == low, (F.col("v") > low) & (F.col("v") < high), F.col("v") == high))).first()
        ends, values = [], [None, low, None, high, None]
        for size in (under, lows, between, highs if high > low else 0):
            ends.append(below)
            below += size
        ends += [below, None]
        parts = [part.where(F.col("v") < low), None, part.where((F.col("v") > low) & (F.col("v") < high)), None, part.where(F.col("v") > high)]
        for k in range(5):
            stop = ends[k + 1]
            own = [r for r in left if r >= ends[k] and (stop is None or r < stop)]
            if values[k] is not None:
                found.update({r: values[k] for r in own})
            elif own:
                inside(parts[k], ends[k], (stop if stop is not None else total) - ends[k], own)

    total = v.count()
    left = sorted({r for r in ranks if 0 <= r < total})
    if left:
        inside(v, 0, total, left)
    return found


def quantile(rows: DataFrame, column: str, q: float = 0.5) -> float | None:
    """The exact quantile, between two values in proportion; None without numbers."""
    n = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return None
    at = q * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    got = order_statistics(rows, column, [low, high])
    return got[low] + (at - low) * (got[high] - got[low]) if high > low else got[low]


def run_summary(rows: DataFrame) -> DataFrame:
    """A run in one row. rows: mrr, *_at_k, seconds, answerable, sufficient, and if answers were made cited_precision,
    cited_hit, refused, grounded (null where no answer came) and error (null: none). The median of seconds is found when
    this is called (see order_statistics)."""
    means = [c for c in rows.columns if c == "mrr" or "_at_" in c or c in ("cited_precision", "cited_hit", "grounded")]
    rate = lambda of, where: F.round(F.try_divide(F.count_if(of & where), F.count_if(where)), 4)
    can = F.col("answerable")
    median = quantile(rows, "seconds")
    out = [F.count("*").alias("n"), *(F.round(F.avg(F.when(can, F.col(c).cast("double"))), 4).alias(c) for c in means), F.lit(None if median is None else round(median, 4)).cast("double").alias("p50_seconds"), rate(F.col("sufficient"), can).alias("gate_pass_rate"), rate(~F.col("sufficient"), ~can).alias("gate_refusal_rate")]
    if "refused" in rows.columns:
        told = F.col("refused").isNotNull()
        out += [rate(F.col("refused"), ~can & told).alias("refusal_rate"), rate(F.col("refused"), can & told).alias("false_refusal_rate")]
    if "error" in rows.columns:
        out.append(F.count("error").alias("errors"))
    return rows.agg(*out)


def self_retrieval_set(documents: DataFrame, chunks: DataFrame, each: int = 40, seed: str = "q1") -> DataFrame:
    """Questions that documents answer themselves: rows (id, tag, question, expected_id).

    documents: source_type, source_id, title; chunks: source_type, source_id, section_number, section_heading, title,
    doc_id, word (what a section is called), chunk_index. At most ``each`` of a kind in an order by hash: questions by
    their own title, for each of their types; sections by number, and the same ones by heading, which asks for the book.
    Rows with a null title, number or heading have no part; a section of several chunks is one.
    """
    bn = lambda c: F.translate(c, "0123456789", "০১২৩৪৫৬৭৮৯")
    asked = documents.where(F.col("source_type").isin("qna_type1", "qna_type2") & F.col("title").isNotNull() & F.col("source_id").isNotNull())
    out = None
    for kind in ("qna_type1", "qna_type2"):
        own = asked.where(F.col("source_type") == kind).orderBy(F.md5(F.concat(F.lit(seed), "source_id")), "source_id").limit(each)
        own = own.select(F.concat(F.lit(f"self-{kind}-"), "source_id").alias("id"), F.lit(f"self_{kind}").alias("tag"), F.col("title").alias("question"), F.concat(F.lit(f"{kind}:"), "source_id").alias("expected_id"))
        out = own if out is None else out.unionByName(own)
    named = chunks.where((F.col("source_type") == "section") & F.col("section_number").isNotNull() & F.col("section_heading").isNotNull() & F.col("title").isNotNull())
    first = named.groupBy("source_id").agg(F.min_by(F.struct("section_number", "section_heading", "title", "doc_id", "word"), "chunk_index").alias("r")).select("source_id", "r.*")
    first = first.orderBy(F.md5(F.concat(F.lit(seed), "source_id")), "source_id").limit(each)
    number = first.select(F.concat(F.lit("self-section-"), "source_id").alias("id"), F.lit("self_section_by_number").alias("tag"), F.concat("title", F.lit(" এর "), "word", F.lit(" "), bn(F.col("section_number")), F.lit(" এ কী বলা হয়েছে?")).alias("question"), F.concat(F.lit("section:"), "source_id").alias("expected_id"))
    heading = first.select(F.concat(F.lit("self-heading-"), "source_id").alias("id"), F.lit("self_section_heading_to_act").alias("tag"), F.trim(F.regexp_replace("section_heading", "।+$", "")).alias("question"), F.concat(F.lit("ebook:"), F.col("doc_id").cast("string")).alias("expected_id"))
    return out.unionByName(number).unionByName(heading)


def hierarchy_set(chunks: DataFrame, each: int = 40, seed: str = "h1") -> DataFrame:
    """Questions that name a place in a document: rows (id, tag, question, expected_id).

    chunks: title, source_type (section or subsection), source_id, section_id, section_number, section_heading, word (what
    a section is called), subsection_numbers, covers, content, chunk_index. At most ``each`` of a kind, in an order by
    hash: sections by number, others by heading, subsections by number (of a chunk that covers several, each), and
    sections' first 22 words where they have 30.
    """
    numbered = chunks.where(F.col("section_id").isNotNull() & F.col("section_number").rlike("^[0-9]+$"))
    first = numbered.groupBy("section_id").agg(F.min_by(F.struct("title", "word", "section_number", "section_heading"), F.struct("chunk_index", "source_id")).alias("r")).select("section_id", "r.*")
    bn = lambda c: F.translate(c, "0123456789", "০১২৩৪৫৬৭৮৯")
    pool = first.withColumn("h", F.md5(F.concat(F.lit(seed), "section_id")))
    sections = pool.orderBy("h").limit(each)
    of = lambda df, tag, key, kind, q: df.select(F.concat(F.lit(f"{tag}-"), key).alias("id"), F.lit(tag).alias("tag"), q.alias("question"), F.concat(F.lit(f"{kind}:"), key).alias("expected_id"))
    by_number = of(sections, "h_section_by_number", F.col("section_id"), "section", F.concat("title", F.lit(" এর "), "word", F.lit(" "), bn(F.col("section_number")), F.lit(" এ কী বলা হয়েছে?")))
    headed = pool.join(sections.select("section_id"), "section_id", "left_anti").where(F.coalesce("section_heading", F.lit("")) != "").orderBy("h").limit(each)
    by_heading = of(headed, "h_section_by_heading", F.col("section_id"), "section", F.concat("title", F.lit(" - "), F.trim(F.regexp_replace("section_heading", "।+$", "")), F.lit(" সম্পর্কে কী বলা আছে")))
    subs = numbered.where("source_type = 'subsection'")
    pairs = F.when(F.size("subsection_numbers") == 1, F.array(F.struct(F.col("subsection_numbers")[0].alias("n"), F.col("source_id").alias("i")))).when((F.size("subsection_numbers") > 0) & (F.size("subsection_numbers") == F.size("covers")), F.transform(F.arrays_zip("subsection_numbers", "covers"), lambda z: F.struct(z["subsection_numbers"].alias("n"), z["covers"].alias("i"))))
    subs = subs.select("title", "word", "section_number", F.explode(pairs).alias("p")).select("title", "word", "section_number", "p.n", "p.i").dropDuplicates(["i"]).orderBy(F.md5(F.concat(F.lit(seed), "i")), "i").limit(each)
    by_sub = of(subs, "h_subsection_by_number", F.col("i"), "subsection", F.concat("title", F.lit(" এর "), "word", F.lit(" "), bn(F.col("section_number")), F.lit(" এর উপ-"), "word", F.lit(" "), F.regexp_replace("n", "^[()]+|[()]+$", "")))
    words = F.regexp_extract_all("content", F.lit(r"(\S+)"), F.lit(1))
    passages = numbered.where((F.col("source_type") == "section") & (F.size(words) >= 30)).orderBy(F.md5(F.concat(F.lit(seed), "source_id")), "source_id", "chunk_index").limit(each)
    passage = of(passages, "h_passage", F.col("source_id"), "section", F.array_join(F.slice(words, 1, 22), " "))
    return by_number.unionByName(by_heading).unionByName(by_sub).unionByName(passage)
