"""Rate limits of a table and of a stream."""

from pyspark.sql import functions as F

from siftline.streaming import rate_limit_stream, rate_limits

SF = "/root/testdata/sf0.001"


def test_limits_of_a_table(spark):
    rows = [(1, "a", "2024-01-01 00:00:58"), (2, "a", "2024-01-01 00:00:59"), (3, "a", "2024-01-01 00:00:59"), (4, "a", "2024-01-01 00:01:00"), (5, "b", "2024-01-01 00:00:00"), (6, None, "2024-01-01 00:00:00"), (7, "a", None)]
    e = spark.createDataFrame(rows, "event_id long, user_id string, ts string").withColumns({"ts": F.to_timestamp("ts"), "_w": F.lit(1)})
    got = {r["event_id"]: (r["count"], r["allowed"], r["reset"]) for r in rate_limits(e.drop("_w"), 2).collect()}
    assert got == {1: (1, True, 2), 2: (2, True, 1), 3: (3, False, 1), 4: (1, True, 60), 5: (1, True, 60)}
    assert rate_limits(e.drop("_w").where("false"), 2).count() == 0


def test_one_busy_key(spark):
    e = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.timestamp_millis(F.col("id") * 7).alias("ts"))
    got = rate_limits(e, 1000).groupBy("allowed").count().collect()
    assert {r["allowed"]: r["count"] for r in got} == {True: 3000, False: 17_000}


def test_stream_equals_table(spark, tmp_path):
    """Events land day by day; hits, refusals and resets are those of the whole table, and counts of past windows go."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", (F.col("user_id") % 3).alias("user_id"), "ts").where("ts < '2024-01-07'")
    for day in range(1, 7):
        e.where(F.dayofmonth("ts") == day).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={day}"))
    landed = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = rate_limit_stream(landed, 2, 3600, late="1 hour")
    query = out.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update")
    query = query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("id", "count", "allowed", "reset").collect()))
    want = sorted(map(tuple, rate_limits(e, 2, 3600).select("event_id", "count", "allowed", "reset").collect()))
    assert got == want and any(not r[2] for r in want)
    windows = e.select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("w")).distinct().count()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < windows / 4
