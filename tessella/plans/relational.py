"""Relational queries beyond the domains: grouping sets, set operations, as-of joins, totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.plans.base import Tables, query


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DECIMAL(28, 2) AS total, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rollup_cube(t: Tables):
    rows = t.orders.cube("o_orderstatus", "o_orderpriority")
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"), F.grouping_id().alias("level"))


@query("""(SELECT 'both' AS side, o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) UNION ALL (SELECT 'only' AS side, o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))""")
def set_intersect_except(t: Tables):
    f, p = (t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in "FP")
    return f.intersect(p).select(F.lit("both").alias("side"), "o_custkey").unionByName(f.subtract(p).select(F.lit("only").alias("side"), "o_custkey"))


@query("SELECT e.event_id, max(p.ts) AS prev_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts <= e.ts GROUP BY e.event_id")
def asof_previous(t: Tables):
    """The user's last purchase up to each click: one pass over the two kinds in order, not a join of all pairs."""
    rows = t.events.filter(F.col("event_type").isin("click", "purchase"))
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("prev_purchase", F.max(bought).over(w)).filter("event_type = 'click'").select("event_id", "prev_purchase")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(coalesce(l_quantity, 0)::DECIMAL(18, 2))::DECIMAL(28, 2) AS quantity, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DECIMAL(28, 4) AS revenue, min(l_shipdate) AS first_ship FROM lineitem GROUP BY ALL")
def value_totals(t: Tables):
    c = F.col
    revenue = (c("l_extendedprice") * (1 - c("l_discount"))).cast("decimal(18,4)")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.coalesce("l_quantity", F.lit(0)).cast("decimal(18,2)")).cast("decimal(28,2)").alias("quantity"), F.sum(revenue).cast("decimal(28,4)").alias("revenue"), F.min("l_shipdate").alias("first_ship"))
