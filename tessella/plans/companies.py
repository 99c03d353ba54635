"""Queries that resolve identifiers, discover tickers and assemble snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import companies as c
from tessella.operators import portfolio as p
from tessella.plans.base import Tables, query
from tessella.plans.portfolio import _events, ev
from tessella.sources.shared import written

ENTITY = """
o AS (SELECT o_custkey, count(*) AS financials FROM orders GROUP BY o_custkey),
entity AS (SELECT c_custkey AS entity_id, CASE c_nationkey % 5 WHEN 0 THEN 'master' WHEN 1 THEN 'tribe' ELSE 'company' END AS type, 'T' || chr(65 + (c_custkey % 7)::INT) || '-' || chr(65 + c_nationkey::INT) AS ticker,
  CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 11)::VARCHAR END AS cik, financials, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS holdings, c_custkey * 37 % 101 AS updated FROM customer LEFT JOIN o ON o_custkey = c_custkey),
security AS (SELECT p_partkey AS security_id, 'S' || chr(65 + (p_partkey % 26)::INT) || chr(65 + (p_partkey % 11)::INT) AS ticker, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 150 + 1 END AS company_id, p_partkey * 53 % 89 AS updated FROM part),
asked AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'CIK 000' || (s_suppkey * 11)::VARCHAR WHEN 1 THEN ' t' || chr(97 + (s_suppkey % 7)::INT) || '-' || chr(65 + (s_suppkey % 25)::INT) WHEN 2 THEN 's' || chr(97 + (s_suppkey % 26)::INT) || chr(97 + (s_suppkey % 11)::INT) ELSE 'none' END AS identifier FROM supplier)"""


def _letter(n, base: int = 65):
    return F.char(F.lit(base) + n)


def _entities(t: Tables):
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("financials"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.join(orders, "c_custkey", "left").select(
        k.alias("entity_id"), F.when(n % 5 == 0, "master").when(n % 5 == 1, "tribe").otherwise("company").alias("type"), F.concat(F.lit("T"), _letter(k % 7), F.lit("-"), _letter(n)).alias("ticker"),
        F.when(k % 3 == 0, (k * 11).cast("string")).alias("cik"), "financials", (F.col("c_acctbal") > 0).cast("int").alias("holdings"), (k * 37 % 101).alias("updated"))


def _securities(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(k.alias("security_id"), F.concat(F.lit("S"), _letter(k % 26), _letter(k % 11)).alias("ticker"), F.when(k % 4 > 0, k % 150 + 1).alias("company_id"), (k * 53 % 89).alias("updated"))


@query(f"""WITH {ENTITY}, a AS (SELECT identifier, nullif(ltrim(regexp_replace(identifier, '[^0-9]', '', 'g'), '0'), '') AS cik, upper(trim(identifier)) AS ticker FROM asked),
best AS (SELECT upper(ticker) AS ticker, entity_id FROM entity WHERE type IN ('company', 'master') QUALIFY row_number() OVER (PARTITION BY upper(ticker) ORDER BY CASE WHEN type = 'master' THEN 120 ELSE 0 END + CASE WHEN cik IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN financials > 0 THEN 50 ELSE 0 END + CASE WHEN holdings > 0 THEN 30 ELSE 0 END DESC, updated DESC, entity_id) = 1),
latest AS (SELECT ticker, company_id FROM security QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY updated DESC, security_id DESC) = 1)
SELECT a.identifier, coalesce(e.entity_id, b.entity_id, l.company_id) AS entity_id, CASE WHEN e.entity_id IS NOT NULL THEN 'cik' WHEN b.entity_id IS NOT NULL THEN 'ticker' WHEN l.company_id IS NOT NULL THEN 'security' END AS way
FROM a LEFT JOIN entity e ON e.cik = a.cik LEFT JOIN best b ON b.ticker = a.ticker LEFT JOIN latest l ON l.ticker = a.ticker""")
def company_resolve(t: Tables):
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("CIK 000"), (k * 11).cast("string"))).when(k % 4 == 1, F.concat(F.lit(" t"), _letter(k % 7, 97), F.lit("-"), _letter(k % 25)))
    name = name.when(k % 4 == 2, F.concat(F.lit("s"), _letter(k % 26, 97), _letter(k % 11, 97))).otherwise("none")
    return c.resolve(t.supplier.select(name.alias("identifier")), _entities(t), _securities(t))


@query(f"""WITH {ENTITY}, h AS (SELECT l_orderkey * 10 + l_linenumber AS h, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN ' ' || s.ticker ELSE s.ticker || CASE WHEN l_partkey % 7 = 0 THEN '/' ELSE '' END END AS a, CASE WHEN l_partkey % 10 = 0 THEN e.ticker END AS b, p_name AS issuer, p_partkey::VARCHAR AS cusip
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN security s ON s.security_id = l_partkey LEFT JOIN entity e ON e.entity_id = s.company_id),
x AS (SELECT *, upper(trim(coalesce(a, b, ''))) AS t FROM h)
SELECT DISTINCT 'ticker' AS kind, t AS value, NULL::VARCHAR AS cusip FROM x WHERE t <> '' AND NOT regexp_matches(t, '[^A-Z0-9.\\-]')
UNION ALL SELECT 'unresolved', issuer, cusip FROM x WHERE t = '' QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY h DESC) = 1""")
def ticker_discovery(t: Tables):
    k = F.col("security_id")
    s = _securities(t).join(_entities(t).select(F.col("entity_id").alias("company_id"), F.col("ticker").alias("of_company")), "company_id", "left")
    own = F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat(F.lit(" "), "ticker")).otherwise(F.concat("ticker", F.when(k % 7 == 0, "/").otherwise("")))
    s = s.select("security_id", own.alias("a"), F.when(k % 10 == 0, F.col("of_company")).alias("b")).join(t.part.select(F.col("p_partkey").alias("security_id"), F.col("p_name").alias("issuer")), "security_id")
    rows = t.lineitem.select(F.col("l_partkey").alias("security_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("h")).join(s, "security_id")
    return c.tickers_held(rows.withColumn("cusip", F.col("security_id").cast("string")), ["a", "b"], "issuer", "cusip", "h")


@query(ev("SELECT 'home' AS key, 8::BIGINT AS version, 'events' AS source, 1::INT AS nth, company_key, score FROM (SELECT company_key, score FROM first_buy ORDER BY score DESC, company_key LIMIT 1) UNION ALL SELECT 'none', 1, 'defaults', 1, 'BRK', 0.0"))
def signal_snapshot(t: Tables):
    """The first card as the next version of a snapshot, and the defaults where there are no events."""
    cards = written(p.signal_pick(written(_events(t), "events"), 1), "cards")
    before = t.spark.createDataFrame([("home", 3), ("home", 7), ("other", 9)], "key string, version long")
    both = c.snapshot(cards, before, "home", []).unionByName(c.snapshot(cards.filter("nth > 9"), before, "none", [("first_buy", "BRK", 0.0)]))
    return both.select("key", "version", "source", F.explode("payload").alias("x")).select("key", "version", "source", "x.nth", "x.company_key", "x.score")
