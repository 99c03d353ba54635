"""Tables changed in place: what is touched, and what a broken run leaves."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessella.sources import keyed


class Killed(Exception):
    pass


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_batches_that_break_or_run_twice(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path), ["k"], 8)
    add = {"n": lambda old, new: F.coalesce(old, F.lit(0)) + new}
    delta = lambda *rows: spark.createDataFrame(rows, "k long, n long")
    assert table.read() is None
    assert table.upsert(delta((1, 5), (2, 7)), 0, merge=add)

    def die():
        raise Killed

    with pytest.raises(Killed):
        table.upsert(delta((1, 1), (3, 1)), 1, merge=add, before_swap=die)
    assert rows_of(table) == [(1, 5, 1), (2, 7, 1)]  # readers see the last finished change
    assert table.upsert(delta((1, 1), (3, 1)), 1, merge=add)
    assert not table.upsert(delta((1, 1), (3, 1)), 1, merge=add)
    assert not table.upsert(delta((1, 100)), 0, merge=add)
    assert rows_of(table) == [(1, 6, 2), (2, 7, 1), (3, 1, 1)]
    assert table.upsert(delta((2, 1), (2, 9)), 2, order=[F.desc("n")])
    assert rows_of(table) == [(1, 6, 2), (2, 9, 2), (3, 1, 1)]
    assert table.upsert(delta(), 3) and len(rows_of(table)) == 3


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path), ["k"], 8)
    table.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("n")), 0)
    before = table.manifest()["folders"]
    table.upsert(spark.createDataFrame([(5, 1)], "k long, n int"), 1)
    after = table.manifest()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 100 and table.read().filter("n = 1").collect()[0].version == 2


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_replaced_children_leave_other_partitions_alone(spark, tmp_path):
    at = f"{tmp_path}/children"
    base = spark.range(300).select((F.col("id") % 50).alias("parent"), F.col("id").alias("child"))
    keyed.write_children(base, at, "parent", 16)
    before = files(at)
    keyed.replace_children(spark.createDataFrame([(7, 1000), (7, 1001), (99, 1002)], "parent long, child long"), at, "parent", 16)
    after = files(at)
    changed = {os.path.dirname(p) for p in set(before) ^ set(after)}
    assert 1 <= len(changed) <= 2 and all(before[p] == after[p] for p in before if p in after)
    want = {(p, c) for c in range(300) for p in [c % 50] if p != 7} | {(7, 1000), (7, 1001), (99, 1002)}
    assert {(r.parent, r.child) for r in spark.read.parquet(at).collect()} == want


def test_rows_are_appended_once(spark, tmp_path):
    at = f"{tmp_path}/rows"
    keyed.write_children(spark.createDataFrame([(1, "a")], "k long, v string"), at, "k", 4)
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c"), (3, "e")], "k long, v string")
    before = files(at)
    for _ in range(2):
        keyed.append_missing(new, at, ["k"], [F.col("v")], 4)
    assert sorted((r.k, r.v) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert before.items() <= files(at).items()
