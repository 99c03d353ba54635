"""Plans of the whole job against brute force."""

import re

from tessella.plans import knowledge, registry


def test_overlap_in_every_language_at_seven_tenths(spark, tmp_path):
    passage = "alpha bravo carbon delta echo foxtrot golf hotel india juliet"
    words = passage.split()
    docs = [(k, f"before {passage} after", lang) for k, lang in enumerate(("en", "de", None))]
    docs += [(10 + n, " ".join(words[:n]), "fr") for n in range(5, 11)] + [(20, None, "en"), (21, "", None)]
    items = [(1, passage), (2, "kilo lima mike"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = lambda x: {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", (x or "").lower())) if len(w) >= 3}
    want = {(i, d, round(len(own(a) & own(b)) / len(own(a)), 6)) for i, a in items for d, b, _ in docs if own(a) and 10 * len(own(a) & own(b)) >= 7 * len(own(a))}
    got = registry.QUERIES["word_overlap_ratio"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == 7


def test_upper_median_orders_one_slice(spark, tmp_path):
    groups = {"a": [float(k * k % 997) for k in range(500)], "b": [2.5] * 7, "c": [3.0, 1.0], "d": [-1.0, 4.0, 4.0]}
    spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    df = registry.QUERIES["upper_median"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {(k, len(v), sorted(v)[len(v) // 2]) for k, v in groups.items()}
    assert "part" in df._jdf.queryExecution().optimizedPlan().toString()


def test_largest_items_of_orders_that_stand_twice(spark, tmp_path, monkeypatch):
    """Each customer of a key has the three largest, the same item counts once, and tasks follow the number of items."""
    monkeypatch.setattr(knowledge, "ITEMS_A_TASK", 2)
    orders = [(1, 10), (1, 11), (1, 11), (2, 20), (3, 30)]
    items = [(1, 5, 2.0), (1, 5, 2.0), (1, 6, 2.0), (1, 7, 9.0), (1, 8, 1.0), (2, 4, 3.0), (9, 1, 1.0), (2, 4, 3.0), (2, 4, 5.0), (9, 1, 1.0), (9, 1, 2.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["nested_children"](spark, str(tmp_path))
    first = ["7:9", "5:2", "6:2"]
    assert sorted(map(tuple, found.collect())) == [(1, 10, first), (1, 11, first), (2, 20, ["4:5", "4:3"])]
    assert "o_orderkey" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 6), REPARTITION_BY_NUM" in plan
