"""Queries that change tables in place and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.base import Tables, query
from tessella.plans.fundamentals import BASE_DELTA, _base_delta
from tessella.sources import keyed
from tessella.sources.shared import new_folder
from tessella.streaming import events as e


@query("SELECT user_id, ts::DATE AS day, count(*) AS n, max(ts) AS last, count(DISTINCT event_id % 4)::INT AS version FROM events GROUP BY ALL")
def stream_daily_upserts(t: Tables):
    """Counters of users' days, put by a stream of four batches into a table that is swapped after each."""
    at = new_folder(t.spark, "daily")
    t.events.withColumn("part", F.col("event_id") % 4).repartition("part").write.partitionBy("part").parquet(f"{at}/feed")
    rows = t.spark.readStream.schema(f"{e.SCHEMA}, part long").option("maxFilesPerTrigger", 1).parquet(f"{at}/feed")
    table = keyed.KeyedTable(t.spark, f"{at}/table", ["user_id", "day"], 16)

    def counted(batch):
        return batch.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))

    add = {"n": lambda old, new: F.coalesce(old, F.lit(0)) + new, "last": F.greatest}
    keyed.upsert_stream(rows, table, counted, f"{at}/log", merge=add)
    return table.read()


@query(BASE_DELTA + " SELECT o_orderkey, o_custkey, o_totalprice FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM d) UNION ALL SELECT * FROM d")
def replace_children_table(t: Tables):
    """Orders of customers that have new ones replaced, partition by partition."""
    base, delta = _base_delta(t)
    keyed.write_children(base, at := new_folder(t.spark, "children"), "o_custkey", 16)
    keyed.replace_children(delta, at, "o_custkey", 16)
    return t.spark.read.parquet(at).drop("_bucket")


@query(BASE_DELTA + " SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM b UNION ALL SELECT * FROM d WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b))")
def append_skip_duplicates(t: Tables):
    """New orders appended where their key is not there, twice: the second time nothing comes."""
    base, delta = _base_delta(t)
    keyed.write_children(base, at := new_folder(t.spark, "appended"), "o_orderkey", 16)
    for _ in range(2):
        keyed.append_missing(delta, at, ["o_orderkey"], [F.desc("o_totalprice"), F.col("o_custkey")], 16)
    return t.spark.read.parquet(at).drop("_bucket")
