"""Logical tables over the given ones, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.portfolio import with_weights
from tessella.operators.relational import top_k
from tessella.sources.shared import written

HOLDING = """
holding AS (
  SELECT l_suppkey % 3 AS holder_id, l_partkey AS security_id, year(l_shipdate)::INT AS period_year, quarter(l_shipdate)::INT AS period_quarter,
         (year(l_shipdate) * 4 + quarter(l_shipdate))::INT AS q, sum(l_quantity)::BIGINT AS shares, round(sum(l_extendedprice::DECIMAL(18, 2)))::BIGINT AS value_usd
  FROM lineitem GROUP BY ALL),
weight AS (SELECT *, (value_usd::HUGEINT * 10000 // sum(value_usd) OVER (PARTITION BY holder_id, q))::DOUBLE / 100 AS pct FROM holding)"""

COMPANY = """
company AS (SELECT p_partkey AS security_id, p_brand || '/' || p_type AS company_key, p_type AS sector, p_name AS ticker FROM part)"""

FINANCIAL = """
financial AS (
  SELECT c_nationkey AS entity_id, year(o_orderdate)::INT AS fy, o_orderpriority AS line_item, sum(o_totalprice::DECIMAL(18, 2))::DECIMAL(28, 2) AS value
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""

CHUNK = r"""
chunk AS (
  SELECT doc_id * 4294967296 + ord AS chunk_id, doc_id, ord, 1965 + doc_id % 61 AS year, source, lang, content
  FROM (SELECT doc_id, source, lang, unnest(regexp_split_to_array(text, '\n+')) AS content, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) AS ord FROM documents))"""


def _ordinal(at) -> Column:
    return F.year(at) * 4 + F.quarter(at)


def holding(t, latest: int | None = None, upto: int | None = None) -> DataFrame:
    """holder_id, security_id, period_year, period_quarter, q (their ordinal), shares, value_usd.

    latest: only each holder's so many latest quarters (of those up to an ordinal). They are found from the distinct pairs of
    holder and quarter first, so nothing else is rolled up.
    """
    at = F.col("l_shipdate")
    lines = t.lineitem
    if latest is not None:
        pairs = lines.select((F.col("l_suppkey") % 3).alias("h"), _ordinal(at).alias("own_q")).distinct()
        pairs = pairs if upto is None else pairs.filter(F.col("own_q") <= upto)
        # written, so that Spark knows how few they are before it plans the join with all lines
        kept = written(top_k(pairs, ["h"], [F.desc("own_q")], latest), "quarters")
        lines = lines.join(kept, (F.col("l_suppkey") % 3 == F.col("h")) & (_ordinal(at) == F.col("own_q")))
    rows = lines.select((F.col("l_suppkey") % 3).alias("holder_id"), F.col("l_partkey").alias("security_id"), F.year(at).alias("period_year"), F.quarter(at).alias("period_quarter"), "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    out = rows.groupBy("holder_id", "security_id", "period_year", "period_quarter").agg(F.sum("l_quantity").cast("long").alias("shares"), F.round(F.sum("price")).cast("long").alias("value_usd"))
    return out.withColumn("q", F.col("period_year") * 4 + F.col("period_quarter"))


def weight(t, latest: int | None = None, upto: int | None = None) -> DataFrame:
    """holding with pct of its holder's quarter."""
    return with_weights(holding(t, latest, upto), ["holder_id", "q"])


def company(t) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("security_id"), F.concat_ws("/", "p_brand", "p_type").alias("company_key"), F.col("p_type").alias("sector"), F.col("p_name").alias("ticker"))


def financial(t) -> DataFrame:
    """entity_id, fy, line_item, value: an order's total by nation of the customer, year and priority."""
    rows = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    value = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("value")
    return rows.groupBy(F.col("c_nationkey").alias("entity_id"), F.year("o_orderdate").alias("fy"), F.col("o_orderpriority").alias("line_item")).agg(value)


def chunk(t) -> DataFrame:
    """chunk_id, doc_id, ord (from 1), year, source, lang, content: a row for each paragraph."""
    rows = t.documents.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n+")).alias("pos", "content"))
    return rows.select((F.col("doc_id") * F.lit(2**32) + F.col("pos") + 1).alias("chunk_id"), "doc_id", (F.col("pos") + 1).cast("long").alias("ord"), (1965 + F.col("doc_id") % 61).alias("year"), "source", "lang", "content")
