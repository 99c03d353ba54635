"""Queries of the portfolio domain over the holding adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import portfolio as p
from tessella.operators.relational import keep_max, latest_ordinals, top_k
from tessella.plans.base import Tables, query
from tessella.sources.adapters import COMPANY, HOLDING, company, holding, weight
from tessella.sources.shared import written

TWO = """
quarters AS (SELECT holder_id, q, row_number() OVER (PARTITION BY holder_id ORDER BY q DESC) AS nth FROM (SELECT DISTINCT holder_id, q FROM holding)),
two AS (SELECT w.*, quarters.nth FROM weight w JOIN quarters USING (holder_id, q) WHERE nth <= 2)"""

CHANGES = """
changes AS (
  SELECT coalesce(n.holder_id, b.holder_id) AS holder_id, coalesce(n.security_id, b.security_id) AS security_id,
         coalesce(n.pct, 0) AS now_pct, coalesce(b.pct, 0) AS prev_pct, round(coalesce(n.pct, 0) - coalesce(b.pct, 0), 4) AS delta,
         CASE WHEN b.pct IS NULL THEN 'new' WHEN n.pct IS NULL THEN 'exit' WHEN round(n.pct - b.pct, 4) > 0.08 THEN 'add' WHEN round(n.pct - b.pct, 4) < -0.08 THEN 'trim' ELSE 'unchanged' END AS kind
  FROM (SELECT * FROM two WHERE nth = 1) n FULL JOIN (SELECT * FROM two WHERE nth = 2) b ON n.holder_id = b.holder_id AND n.security_id = b.security_id)"""

TOP = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY holder_id, kind ORDER BY abs(delta) DESC, security_id) AS nth FROM changes WHERE kind <> 'unchanged')"""

EVENTS = """
byc AS (SELECT two.*, c.company_key FROM two JOIN company c USING (security_id)),
base AS (SELECT *, row_number() OVER (PARTITION BY holder_id, company_key ORDER BY pct ASC NULLS FIRST, security_id DESC) AS k FROM byc WHERE nth = 2),
latest AS (SELECT n.holder_id, n.company_key, n.security_id, n.pct AS now_pct, b.pct AS prev_pct, round(n.pct - b.pct, 4) AS delta FROM byc n LEFT JOIN base b ON b.k = 1 AND b.holder_id = n.holder_id AND b.company_key = n.company_key WHERE n.nth = 1),
events_ AS (
  SELECT holder_id, company_key, security_id, CASE WHEN prev_pct IS NULL THEN 'new' WHEN delta > 0 THEN 'add' ELSE 'trim' END AS kind, now_pct, prev_pct, delta FROM latest WHERE prev_pct IS NULL OR abs(delta) >= 0.08
  UNION ALL SELECT holder_id, company_key, security_id, 'exit', 0.0, pct, NULL FROM base WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.holder_id = base.holder_id AND l.company_key = base.company_key)),
ev AS (SELECT *, CASE WHEN kind IN ('new', 'add') THEN 'positive' ELSE 'negative' END AS direction, abs(coalesce(delta, now_pct)) AS mag, round(abs(coalesce(delta, now_pct)) + now_pct, 4) AS score_ FROM events_),
col AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_key, holder_id ORDER BY score_ DESC, company_key, security_id, kind) AS k FROM ev) WHERE k = 1),
sided AS (SELECT company_key, count(*) FILTER (direction = 'positive') AS pos, count(*) FILTER (direction = 'negative') AS neg, sum(mag) AS size FROM col GROUP BY company_key),
sided2 AS (SELECT sided.*, a.all_size FROM sided JOIN (SELECT company_key, sum(mag) AS all_size FROM ev GROUP BY company_key) a USING (company_key)),
first_buy AS (
  SELECT company_key, max_by(holder_id, now_pct * 1000000000 - holder_id) AS holder_id, round(max(now_pct) + count(*) - 1, 4) AS score, count(*) AS holders
  FROM (SELECT *, row_number() OVER (PARTITION BY company_key, holder_id ORDER BY score_ DESC, company_key, security_id, kind) AS k FROM ev WHERE kind = 'new') WHERE k = 1 GROUP BY company_key),
consensus AS (SELECT company_key, CASE WHEN pos > 0 THEN 'positive' ELSE 'negative' END AS side, pos + neg AS holders, round(10 * (pos + neg) + size, 4) AS score FROM sided WHERE pos >= 2 AND neg = 0 OR neg >= 2 AND pos = 0),
divergence AS (SELECT company_key, pos, neg, round(10 * (pos + neg) + all_size, 4) AS score FROM sided2 WHERE pos > 0 AND neg > 0),
adds AS (SELECT holder_id, company_key, kind, round(abs(delta) + now_pct, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY holder_id ORDER BY score_ DESC, company_key, security_id, kind) AS k FROM ev WHERE kind = 'add') WHERE k = 1),
trims AS (SELECT holder_id, company_key, kind, round(CASE WHEN kind = 'exit' THEN prev_pct ELSE abs(delta) END, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY holder_id ORDER BY score_ DESC, company_key, security_id, kind) AS k FROM ev WHERE direction = 'negative') WHERE k = 1),
fallback AS (SELECT company_key, holder_id, kind, score_ AS score FROM (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY score_ DESC, holder_id, security_id, kind) AS k FROM ev) WHERE k = 1)"""


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


@query(sql(HOLDING, select="SELECT security_id, q, sum(value_usd)::BIGINT AS value_usd, sum(shares)::BIGINT AS shares, min(holder_id) AS first_holder FROM holding GROUP BY security_id, q"))
def holdings_rollup(t: Tables):
    """Rows of a security in a quarter together; other columns from the first row, by holder."""
    return holding(t).groupBy("security_id", "q").agg(F.sum("value_usd").alias("value_usd"), F.sum("shares").alias("shares"), F.min_by("holder_id", "holder_id").alias("first_holder"))


@query(sql(HOLDING, select="SELECT holder_id, security_id, q, value_usd, pct FROM weight"))
def portfolio_weights(t: Tables):
    return weight(t).select("holder_id", "security_id", "q", "value_usd", "pct")


@query(sql(HOLDING, select="SELECT *, rank() OVER (PARTITION BY holder_id ORDER BY period_year DESC, period_quarter DESC)::INT AS nth FROM (SELECT holder_id, period_year, period_quarter, count(*) AS positions FROM holding GROUP BY ALL)"))
def available_quarters(t: Tables):
    rows = holding(t).groupBy("holder_id", "period_year", "period_quarter").agg(F.count("*").alias("positions"))
    return top_k(rows, ["holder_id"], [F.desc("period_year"), F.desc("period_quarter")], 2**31 - 1, rank="nth")


@query(sql(HOLDING, TWO, CHANGES, select="SELECT holder_id, security_id, kind, now_pct, prev_pct, delta FROM changes"))
def change_set_latest(t: Tables):
    return p.change_sets(weight(t, latest=2))


@query(sql(HOLDING, TWO, CHANGES, TOP, select="SELECT holder_id, kind, nth::INT AS nth, security_id, now_pct, prev_pct, delta FROM ranked WHERE nth <= 5"))
def change_set_topk(t: Tables):
    return p.top_changes(p.change_sets(weight(t, latest=2))).select("holder_id", "kind", "nth", "security_id", "now_pct", "prev_pct", "delta")


@query(sql(HOLDING, TWO, CHANGES, TOP, select="""
SELECT holder_id, count(*) FILTER (kind = 'new') AS new_n, count(*) FILTER (kind = 'add') AS add_n, count(*) FILTER (kind = 'trim') AS trim_n, count(*) FILTER (kind = 'exit') AS exit_n,
       count(*) AS changed, (SELECT round(sum(pct), 2) FROM (SELECT pct FROM two WHERE two.holder_id = r.holder_id AND two.nth = 1 ORDER BY pct DESC LIMIT 5)) AS top5_pct
FROM ranked r WHERE nth <= 5 GROUP BY holder_id"""))
def change_set_summary(t: Tables):
    """Counts of changes after each kind is cut to five, and the five largest positions' share."""
    w = weight(t, latest=2)
    cut = p.top_changes(p.change_sets(w))
    counts = cut.groupBy("holder_id").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_n") for k in ("new", "add", "trim", "exit")), F.count("*").alias("changed"))
    latest = latest_ordinals(w, ["holder_id"], "q", 1)
    top = top_k(latest, ["holder_id"], [F.desc("pct"), F.col("security_id")], 5).groupBy("holder_id").agg(F.round(F.sum("pct"), 2).alias("top5_pct"))
    return counts.join(top, "holder_id")


@query(sql(HOLDING, COMPANY, TWO, CHANGES, TOP, """
five AS (SELECT holder_id, round(sum(pct), 2) AS top5 FROM (SELECT *, row_number() OVER (PARTITION BY holder_id ORDER BY pct DESC, security_id) AS k FROM two WHERE nth = 1) WHERE k <= 5 GROUP BY holder_id),
cut AS (SELECT * FROM ranked WHERE nth <= 5), n AS (SELECT holder_id, count(*) AS changed FROM cut GROUP BY holder_id)""", select="""
SELECT f.holder_id, 0 AS place, 'summary' AS kind, 0 AS nth, NULL AS ticker, '前五大持仓合计 ' || printf('%.2f', top5) || '%，组合集中度' || CASE WHEN top5 >= 60 THEN '较高' ELSE '中等' END || CASE WHEN changed > 0 THEN '，本季' || changed::VARCHAR || '笔变动' ELSE '' END AS detail, '组合概况' AS label FROM five f LEFT JOIN n USING (holder_id)
UNION ALL SELECT holder_id, CASE kind WHEN 'new' THEN 1 WHEN 'add' THEN 2 WHEN 'trim' THEN 3 ELSE 4 END, kind, nth::INT, ticker, ticker || CASE kind WHEN 'new' THEN ' 仓位 ' || printf('%.2f', now_pct) || '%' WHEN 'exit' THEN ' 上季仓位 ' || printf('%.2f', prev_pct) || '%' ELSE CASE kind WHEN 'add' THEN ' +' ELSE ' ' END || printf('%.2f', delta) || 'pp → ' || printf('%.2f', now_pct) || '%' END,
  CASE kind WHEN 'new' THEN '新进' WHEN 'add' THEN '增持' WHEN 'trim' THEN '减持' ELSE '清仓' END FROM cut JOIN company USING (security_id) WHERE nth <= 4"""))
def insight_items(t: Tables):
    """What a holder's report says of its latest quarter: a summary and four changes of each kind."""
    w = weight(t, latest=2)
    cut = p.top_changes(p.change_sets(w))
    latest = latest_ordinals(w, ["holder_id"], "q", 1)
    return p.insight_items(cut, latest, company(t).select("security_id", "ticker")).select("holder_id", "place", "kind", "nth", "ticker", "detail", "label")


@query(sql(HOLDING, TWO, select="""
SELECT n.holder_id, n.security_id, n.shares, b.shares AS prev_shares, round(CASE WHEN b.shares > 0 THEN (n.shares - b.shares) / b.shares * 100 END, 6) AS delta_pct,
       CASE WHEN b.shares IS NULL THEN 'New' WHEN b.shares <= 0 OR abs((n.shares - b.shares) / b.shares * 100) < 1 THEN 'Unchanged' WHEN n.shares > b.shares THEN 'Added' ELSE 'Reduced' END AS activity
FROM (SELECT * FROM two WHERE nth = 1) n LEFT JOIN (SELECT * FROM two WHERE nth = 2) b USING (holder_id, security_id)"""))
def holding_activity(t: Tables):
    two = latest_ordinals(holding(t, latest=2), ["holder_id"], "q")
    prev = two.filter("nth = 2").select("holder_id", "security_id", F.col("shares").alias("prev_shares"))
    out = two.filter("nth = 1").join(prev, ["holder_id", "security_id"], "left")
    pct = p.share_delta_pct(F.col("prev_shares"), F.col("shares"))
    return out.select("holder_id", "security_id", "shares", "prev_shares", F.round(pct, 6).alias("delta_pct"), p.activity(F.lit(True), F.col("prev_shares").isNotNull(), pct).alias("activity"))


@query(sql(HOLDING, TWO, select="SELECT holder_id, security_id, pct, value_usd FROM two b WHERE nth = 2 AND NOT EXISTS (SELECT 1 FROM two n WHERE n.nth = 1 AND n.holder_id = b.holder_id AND n.security_id = b.security_id)"))
def exits_anti(t: Tables):
    two = latest_ordinals(weight(t, latest=2), ["holder_id"], "q")
    return two.filter("nth = 2").join(two.filter("nth = 1"), ["holder_id", "security_id"], "left_anti").select("holder_id", "security_id", "pct", "value_usd")


@query("""
SELECT l_partkey AS security_id, max(l_extendedprice) AS value_usd,
       max_by(l_orderkey, (l_extendedprice * 100)::BIGINT::HUGEINT * 1000000000000 + l_orderkey) AS last_wins, max_by(l_orderkey, (l_extendedprice * 100)::BIGINT::HUGEINT * 1000000000000 - l_orderkey) AS first_wins
FROM lineitem GROUP BY l_partkey""")
def holding_dedupe_keep_max(t: Tables):
    """The row of the largest value of each key; of equal ones the last, and the first, by order key."""
    rows = t.lineitem.select(F.col("l_partkey").alias("security_id"), F.col("l_extendedprice").alias("value_usd"), "l_orderkey")
    last = keep_max(rows, ["security_id"], "value_usd", [F.desc("l_orderkey")]).withColumnRenamed("l_orderkey", "last_wins")
    first = keep_max(rows, ["security_id"], "value_usd", [F.asc("l_orderkey")]).select("security_id", F.col("l_orderkey").alias("first_wins"))
    return last.join(first, "security_id")


@query(sql(HOLDING, COMPANY, TWO, """
sums AS (SELECT holder_id, company_key, round(sum(greatest(coalesce(pct, 0), 0)), 2) AS pct, string_agg(DISTINCT ticker, ', ' ORDER BY ticker) AS tickers FROM two JOIN company USING (security_id) WHERE nth = 1 GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY holder_id ORDER BY pct DESC, company_key) AS k FROM sums) WHERE k <= 10)""", select="""
SELECT holder_id, company_key, pct, tickers FROM top UNION ALL SELECT holder_id, 'Others', round(greatest(0, 100 - sum(pct)), 2), '' FROM top GROUP BY holder_id"""))
def company_weight_rollup_others(t: Tables):
    latest = latest_ordinals(weight(t, latest=1), ["holder_id"], "q", 1).join(company(t), "security_id")
    return p.company_rollup(latest, ["holder_id"])


@query(sql(HOLDING, """
last AS (SELECT holder_id, q FROM (SELECT holder_id, q, row_number() OVER (PARTITION BY holder_id ORDER BY q DESC) AS k FROM (SELECT DISTINCT holder_id, q FROM holding)) WHERE k <= 8),
r AS (SELECT w.*, row_number() OVER (PARTITION BY holder_id, q ORDER BY pct DESC, security_id) AS rn FROM weight w JOIN last USING (holder_id, q))""", select="""
SELECT holder_id, q, count(*) AS positions, round(sum(pct) FILTER (rn <= 5), 2) AS top5, round(sum(pct) FILTER (rn <= 10), 2) AS top10 FROM r GROUP BY holder_id, q"""))
def concentration_trend(t: Tables):
    """Positions and the shares of the five and ten largest, of the last eight quarters."""
    rows = latest_ordinals(weight(t, latest=8), ["holder_id"], "q", 8).drop("nth")
    counts = rows.groupBy("holder_id", "q").agg(F.count("*").alias("positions"))
    top = top_k(rows, ["holder_id", "q"], [F.desc("pct"), F.col("security_id")], 10, rank="rn")
    sums = top.groupBy("holder_id", "q").agg(F.round(F.sum(F.when(F.col("rn") <= 5, F.col("pct"))), 2).alias("top5"), F.round(F.sum("pct"), 2).alias("top10"))
    return counts.join(sums, ["holder_id", "q"])


@query(sql(HOLDING, COMPANY, TWO, select="SELECT holder_id, coalesce(nullif(sector, ''), 'unknown') AS sector, round(sum(pct), 1) AS pct, count(*) AS positions FROM two JOIN company USING (security_id) WHERE nth = 1 GROUP BY ALL"))
def sector_breakdown(t: Tables):
    latest = latest_ordinals(weight(t, latest=1), ["holder_id"], "q", 1).join(company(t), "security_id", "left")
    sector = F.coalesce(F.nullif("sector", F.lit("")), F.lit("unknown"))
    return latest.groupBy("holder_id", sector.alias("sector")).agg(F.round(F.sum("pct"), 1).alias("pct"), F.count("*").alias("positions"))


@query(sql(HOLDING, COMPANY, """
byq AS (SELECT company_key, holder_id, q, sum(shares)::BIGINT AS shares, sum(value_usd)::BIGINT AS value_usd FROM holding JOIN company USING (security_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY company_key, holder_id ORDER BY q DESC) AS k FROM byq),
j AS (SELECT n.company_key, n.holder_id, n.q, n.shares, n.value_usd, b.shares AS prev_shares FROM r n LEFT JOIN r b ON b.k = 2 AND b.company_key = n.company_key AND b.holder_id = n.holder_id WHERE n.k = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY value_usd DESC, holder_id) AS nth FROM j)""", select="""
SELECT company_key, holder_id, q, shares, value_usd, prev_shares, CASE WHEN prev_shares IS NULL THEN 'New' WHEN prev_shares <= 0 OR abs((shares - prev_shares) / prev_shares * 100) < 1 THEN 'Unchanged' WHEN shares > prev_shares THEN 'Added' ELSE 'Reduced' END AS activity FROM o WHERE nth <= 20"""))
def recent_holders(t: Tables):
    """Each company's holders with their two latest quarters, by value, twenty at most."""
    rows = holding(t).join(company(t).select("security_id", "company_key"), "security_id").groupBy("company_key", "holder_id", "q").agg(F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd"))
    two = top_k(rows, ["company_key", "holder_id"], [F.desc("q")], 2, rank="k")
    prev = two.filter("k = 2").select("company_key", "holder_id", F.col("shares").alias("prev_shares"))
    out = two.filter("k = 1").drop("k").join(prev, ["company_key", "holder_id"], "left")
    pct = p.share_delta_pct(F.col("prev_shares"), F.col("shares"))
    out = out.withColumn("activity", p.activity(F.lit(True), F.col("prev_shares").isNotNull(), pct))
    return top_k(out, ["company_key"], [F.desc("value_usd"), F.col("holder_id")], 20).select("company_key", "holder_id", "q", "shares", "value_usd", "prev_shares", "activity")


@query(sql(HOLDING, COMPANY, select="""
SELECT holder_id, company_key, last_q, last_value, last_q < max(last_q) OVER (PARTITION BY holder_id) AS sold_out
FROM (SELECT holder_id, company_key, max(q) AS last_q, (sum(value_usd) FILTER (q = mq))::BIGINT AS last_value FROM (SELECT h.*, c.company_key, max(q) OVER (PARTITION BY holder_id, company_key) AS mq FROM holding h JOIN company c USING (security_id)) GROUP BY ALL)"""))
def sold_out_last_held(t: Tables):
    """The last quarter in which a holder held a company; sold out where it is not the holder's latest."""
    rows = holding(t).join(company(t).select("security_id", "company_key"), "security_id").groupBy("holder_id", "company_key", "q").agg(F.sum("value_usd").alias("last_value"))
    last = top_k(rows, ["holder_id", "company_key"], [F.desc("q")]).withColumnRenamed("q", "last_q")
    latest = rows.groupBy("holder_id").agg(F.max("q").alias("_latest"))
    return last.join(latest, "holder_id").select("holder_id", "company_key", "last_q", "last_value", (F.col("last_q") < F.col("_latest")).alias("sold_out"))


def _events(t: Tables):
    return p.master_events(weight(t, latest=2).join(company(t).select("security_id", "company_key"), "security_id"))


def ev(select: str) -> str:
    return sql(HOLDING, COMPANY, TWO, EVENTS, select=select)


@query(ev("SELECT holder_id, company_key, security_id, kind, direction, now_pct, prev_pct, delta FROM ev"))
def master_events(t: Tables):
    return _events(t)


@query(ev("SELECT company_key, holder_id, score, holders FROM first_buy"))
def first_buy_cards(t: Tables):
    return p.first_buy(_events(t))


@query(ev("SELECT * FROM consensus"))
def consensus_cards(t: Tables):
    return p.consensus(_events(t))


@query(ev("SELECT * FROM divergence"))
def divergence_cards(t: Tables):
    return p.divergence(_events(t))


@query(ev("SELECT * FROM adds UNION ALL SELECT * FROM trims"))
def add_trim_cards(t: Tables):
    events = written(_events(t), "events")
    return p.add_cards(events).unionByName(p.trim_cards(events))


@query(ev("SELECT * FROM fallback"))
def fallback_cards(t: Tables):
    return p.fallback_cards(_events(t))


@query(ev("""
, pool AS (
  SELECT 0 AS place, 'first_buy' AS bucket, company_key, score FROM first_buy UNION ALL SELECT 1, 'divergence', company_key, score FROM divergence UNION ALL SELECT 2, 'consensus', company_key, score FROM consensus
  UNION ALL SELECT 3, 'add', company_key, score FROM adds UNION ALL SELECT 4, 'trim', company_key, score FROM trims UNION ALL SELECT 5, 'fallback', company_key, score FROM fallback),
heads AS (SELECT place, bucket, company_key, score FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, company_key) AS k FROM (SELECT place, bucket, company_key, max(score) AS score FROM pool GROUP BY ALL)) WHERE k <= 6),
s0 AS (SELECT * FROM heads WHERE place = 0 ORDER BY score DESC, company_key LIMIT 1),
s1 AS (FROM s0 UNION ALL (SELECT * FROM heads WHERE place = 1 AND company_key NOT IN (SELECT company_key FROM s0) ORDER BY score DESC, company_key LIMIT 1)),
s2 AS (FROM s1 UNION ALL (SELECT * FROM heads WHERE place = 2 AND company_key NOT IN (SELECT company_key FROM s1) ORDER BY score DESC, company_key LIMIT 1)),
s3 AS (FROM s2 UNION ALL (SELECT * FROM heads WHERE place = 3 AND company_key NOT IN (SELECT company_key FROM s2) ORDER BY score DESC, company_key LIMIT 1)),
s4 AS (FROM s3 UNION ALL (SELECT * FROM heads WHERE place = 4 AND company_key NOT IN (SELECT company_key FROM s3) ORDER BY score DESC, company_key LIMIT 1)),
s5 AS (FROM s4 UNION ALL (SELECT * FROM heads WHERE place = 5 AND company_key NOT IN (SELECT company_key FROM s4) ORDER BY score DESC, company_key LIMIT 1))
SELECT row_number() OVER (ORDER BY place)::INT AS nth, bucket, company_key, score FROM s5 QUALIFY nth <= 3""").replace("\n\n, pool", ",\npool"))
def signal_pick(t: Tables):
    """Six pools read the events, which are written once."""
    return p.signal_pick(written(_events(t), "events"))


@query(sql(HOLDING, COMPANY, TWO, select="""
SELECT holder_id, security_id, company_key, sector, s_name AS holder_name, value_usd, pct, k::INT AS nth FROM (
  SELECT two.*, c.company_key, c.sector, s.s_name, row_number() OVER (PARTITION BY holder_id ORDER BY pct DESC, security_id) AS k
  FROM two LEFT JOIN company c USING (security_id) LEFT JOIN supplier s ON s.s_suppkey = holder_id WHERE two.nth = 1) WHERE k <= 10"""))
def master_snapshot_join(t: Tables):
    """The ten largest positions of each holder's latest quarter with company, sector and holder's name; tables without a match give nulls."""
    top = top_k(latest_ordinals(weight(t, latest=1), ["holder_id"], "q", 1).drop("nth"), ["holder_id"], [F.desc("pct"), F.col("security_id")], 10, rank="nth")
    named = top.join(company(t), "security_id", "left").join(t.supplier.select(F.col("s_suppkey").alias("holder_id"), F.col("s_name").alias("holder_name")), "holder_id", "left")
    return named.select("holder_id", "security_id", "company_key", "sector", "holder_name", "value_usd", "pct", "nth")


@query(sql(HOLDING, """
target AS (SELECT 8000 AS q),
base AS (SELECT holder_id, max(q) AS q FROM holding WHERE q < (SELECT q FROM target) GROUP BY holder_id),
n AS (SELECT * FROM weight WHERE q = (SELECT q FROM target)), b AS (SELECT w.* FROM weight w JOIN base USING (holder_id, q)),
c AS (SELECT coalesce(n.holder_id, b.holder_id) AS holder_id, coalesce(n.security_id, b.security_id) AS security_id, round(coalesce(n.pct, 0) - coalesce(b.pct, 0), 4) AS delta,
  CASE WHEN b.pct IS NULL THEN 'new' WHEN n.pct IS NULL THEN 'exit' WHEN round(n.pct - b.pct, 4) > 0.08 THEN 'add' WHEN round(n.pct - b.pct, 4) < -0.08 THEN 'trim' ELSE 'unchanged' END AS kind
  FROM n FULL JOIN b ON n.holder_id = b.holder_id AND n.security_id = b.security_id)""", select="""
SELECT holder_id, kind, nth::INT AS nth, security_id, delta FROM (SELECT *, row_number() OVER (PARTITION BY holder_id, kind ORDER BY abs(delta) DESC, security_id) AS nth FROM c WHERE kind <> 'unchanged') WHERE nth <= 7"""))
def change_set_script_variant(t: Tables):
    """A given quarter (1999 Q4, ordinal 8000) against the one that the holder had before, seven changes of each kind. Of a
    holder without that quarter all earlier positions are exits."""
    return p.top_changes(p.change_sets(weight(t, latest=2, upto=8000), target=8000), 7).select("holder_id", "kind", "nth", "security_id", "delta")
