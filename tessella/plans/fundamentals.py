"""Queries of the fundamentals and entity domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import identifiers as ids
from tessella.functions import numbers as num
from tessella.operators import fundamentals as f
from tessella.operators.relational import replace_children, semi_any, top_k, upsert
from tessella.plans.base import Tables, query
from tessella.sources.adapters import FINANCIAL, financial

ITEMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
COLUMNS = ["1_urgent", "2_high", "3_medium", "4_not_specified", "5_low"]
PIVOT = FINANCIAL + """,
wide AS (SELECT entity_id, fy, """ + ", ".join(f"max(value) FILTER (line_item = '{i}') AS \"{c}\"" for i, c in zip(ITEMS, COLUMNS, strict=True)) + " FROM financial GROUP BY ALL)"
SPARSE = """
sparse AS (SELECT o_custkey AS entity_id, year(o_orderdate)::INT AS fy, sum(o_totalprice::DECIMAL(18, 2))::DECIMAL(28, 2) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)"""


def sparse(t: Tables):
    """A customer's urgent orders by year, with gaps."""
    rows = t.orders.filter("o_orderpriority = '1-URGENT'")
    return rows.groupBy(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("fy")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("value"))


@query("WITH" + PIVOT + " SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY fy DESC) <= 5")
def financial_pivot(t: Tables):
    return f.pivot_facts(financial(t), ITEMS, 5)


@query("WITH" + PIVOT + """ SELECT w.entity_id, w.fy, round((w."1_urgent" / w."2_high")::DOUBLE, 6) AS margin, round((w."3_medium" / (w."4_not_specified" + w."5_low"))::DOUBLE, 6) AS leverage,
round(((w."1_urgent" - b."1_urgent") / b."1_urgent")::DOUBLE, 6) AS yoy FROM (SELECT entity_id, fy, COLUMNS(* EXCLUDE (entity_id, fy))::DOUBLE FROM wide) w LEFT JOIN (SELECT entity_id, fy, "1_urgent"::DOUBLE AS "1_urgent" FROM wide) b ON b.entity_id = w.entity_id AND b.fy = w.fy - 1""")
def kpi_ratios(t: Tables):
    wide = f.yoy(f.pivot_facts(financial(t), ITEMS), "1_urgent")
    c = F.col
    return wide.select("entity_id", "fy", F.round(num.ratio(c("1_urgent"), c("2_high")), 6).alias("margin"), F.round(num.ratio(c("3_medium"), c("4_not_specified").cast("double") + c("5_low").cast("double")), 6).alias("leverage"), "yoy")


@query("WITH" + SPARSE + """, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY fy DESC) AS k FROM sparse),
e AS (SELECT entity_id, max(value) FILTER (k = 1) AS v1, max(value) FILTER (k = 3) AS v3, max(fy) FILTER (k = 1) AS f1, max(fy) FILTER (k = 3) AS f3 FROM r WHERE k <= 3 GROUP BY entity_id)
SELECT entity_id, round(pow(v1::DOUBLE / v3::DOUBLE, 1.0 / 2) - 1, 6) AS cagr, round(pow(v1::DOUBLE / v3::DOUBLE, 1.0 / (f1 - f3)) - 1, 6) AS span_cagr FROM e""")
def revenue_cagr(t: Tables):
    return f.growth(sparse(t), "value", 3)


@query("WITH" + SPARSE + ", g AS (SELECT entity_id, unnest(range(max(fy) - 4, max(fy) + 1))::INT AS fy FROM sparse GROUP BY entity_id) SELECT g.entity_id, g.fy, s.value FROM g LEFT JOIN sparse s USING (entity_id, fy)")
def yoy_grid(t: Tables):
    return f.year_grid(sparse(t), "value")


@query("WITH" + PIVOT + """ SELECT entity_id, fy, CASE WHEN p IS NULL OR v IS NULL THEN NULL WHEN v - p > abs(p) * 0.03 THEN 'up' WHEN p - v > abs(p) * 0.03 THEN 'down' ELSE 'flat' END AS trend
FROM (SELECT entity_id, fy, "1_urgent"::DOUBLE AS v, lag("1_urgent"::DOUBLE) OVER (PARTITION BY entity_id ORDER BY fy) AS p, row_number() OVER (PARTITION BY entity_id ORDER BY fy DESC) AS k FROM wide) WHERE k <= 7""")
def metric_trend(t: Tables):
    from pyspark.sql import Window

    v = F.col("1_urgent").cast("double")
    rows = f.pivot_facts(financial(t), ITEMS).withColumn("p", F.lag(v).over(Window.partitionBy("entity_id").orderBy("fy")))
    return top_k(rows, ["entity_id"], [F.desc("fy")], 7).select("entity_id", "fy", num.trend(v, F.col("p")).alias("trend"))


@query("WITH" + SPARSE + """ SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS bucket, count(*) AS entities
FROM (SELECT c_custkey, count(DISTINCT fy) AS n FROM customer LEFT JOIN sparse ON entity_id = c_custkey GROUP BY c_custkey) GROUP BY bucket""")
def fy_coverage_buckets(t: Tables):
    """Entities by their number of years, those without any too."""
    n = sparse(t).groupBy("entity_id").agg(F.count("*").alias("n"))  # a row for each year
    rows = t.customer.select(F.col("c_custkey").alias("entity_id")).join(n, "entity_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.groupBy(F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 4, "3-4").otherwise("5+").alias("bucket")).agg(F.count("*").alias("entities"))


@query("WITH" + SPARSE + """, a AS (SELECT c_custkey AS entity_id, coalesce(list_sort(list(DISTINCT fy) FILTER (fy BETWEEN 1997 AND 2001)), []) AS available, min(fy) AS first FROM customer LEFT JOIN sparse ON entity_id = c_custkey GROUP BY c_custkey),
m AS (SELECT *, list_filter([1997, 1998, 1999, 2000, 2001], lambda y: NOT list_contains(available, y)) AS missing FROM a)
SELECT entity_id, available, missing, CASE WHEN len(missing) = 0 THEN 'ok' WHEN first IS NULL THEN 'no-data' WHEN len(list_filter(missing, lambda y: y >= first)) = 0 THEN 'short-history' ELSE 'missing' END AS status FROM m""")
def coverage_audit(t: Tables):
    return f.coverage(sparse(t), t.customer.select(F.col("c_custkey").alias("entity_id")), 2001)


@query("""WITH r AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 END AS tag FROM orders),
m AS (SELECT *, min(tag) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS best FROM r WHERE tag IS NOT NULL)
SELECT o_custkey AS entity_id, year(o_orderdate)::INT AS fy, o_orderpriority AS tag, o_orderkey, o_totalprice FROM m WHERE tag = best QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def fact_tag_priority(t: Tables):
    """The last filed fact of the first tag that has any, by entity and year."""
    rows = t.orders.select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("fy"), F.col("o_orderpriority").alias("tag"), "o_orderkey", "o_totalprice", "o_orderdate")
    rank = F.when(F.col("tag") == "1-URGENT", 0).when(F.col("tag") == "2-HIGH", 1).when(F.col("tag") == "5-LOW", 2)
    return f.best_fact(rows, ["entity_id", "fy"], rank, [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("""SELECT c_custkey, coalesce(s.s_name, n.n_name, c_name) AS name, CASE WHEN s.s_name IS NOT NULL THEN 0 WHEN n.n_name IS NOT NULL THEN 1 ELSE 2 END AS name_source
FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON n_nationkey = c_nationkey""")
def entity_resolution_cascade(t: Tables):
    """A customer's name from suppliers by key, else nations by key, else its own."""
    cascade = [(F.col("c_custkey"), t.supplier, "s_suppkey", "s_name"), (F.col("c_nationkey"), t.nation.filter("n_nationkey < 20"), "n_nationkey", "n_name")]
    return f.resolve(t.customer, cascade, F.col("c_name"), "name").select("c_custkey", "name", "name_source")


@query("""WITH e AS (SELECT p_partkey AS entity_id, p_name AS ticker, p_size, (CASE WHEN p_type = 'ECONOMY' THEN 120 ELSE 0 END + CASE WHEN p_brand < 'Brand#2' THEN 100 ELSE 0 END + p_size) AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, entity_id) AS nth FROM e)
SELECT r.ticker, r.entity_id, k.entity_id AS keep_id, r.nth::INT AS nth, concat_ws(',', CASE WHEN r.p_size > 40 THEN 'large' END, CASE WHEN r.score >= 100 THEN 'curated' END) AS blockers FROM r JOIN r k ON k.ticker = r.ticker AND k.nth = 1 WHERE r.nth > 1""")
def duplicate_entity_plan(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("ticker"), "p_size", "p_type", "p_brand")
    score = F.when(F.col("p_type") == "ECONOMY", 120).otherwise(0) + F.when(F.col("p_brand") < "Brand#2", 100).otherwise(0) + F.col("p_size")
    return f.duplicate_plan(rows, "ticker", score, {"large": F.col("p_size") > 40, "curated": score >= 100})


BASE_DELTA = "WITH b AS (SELECT * FROM orders WHERE o_orderdate < '2001-01-01'), d AS (SELECT o_orderkey + 700 AS o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= '2001-01-01')"


def _base_delta(t: Tables):
    cut = F.lit("2001-01-01").cast("timestamp_ntz")
    base = t.orders.filter(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey", "o_totalprice")
    delta = t.orders.filter(F.col("o_orderdate") >= cut).select((F.col("o_orderkey") + 700).alias("o_orderkey"), "o_custkey", "o_totalprice")
    return base, delta


@query(BASE_DELTA + """ SELECT o_orderkey, o_custkey, o_totalprice, 1 AS version FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)
UNION ALL SELECT d.o_orderkey, d.o_custkey, d.o_totalprice, CASE WHEN b.o_orderkey IS NULL THEN 1 ELSE 2 END FROM d LEFT JOIN b USING (o_orderkey)""")
def upsert_merge(t: Tables):
    base, delta = _base_delta(t)
    return upsert(base.withColumn("version", F.lit(1)), delta, ["o_orderkey"], "version")


@query(BASE_DELTA + " SELECT d.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'create' ELSE 'update' END AS action FROM d LEFT JOIN b USING (o_orderkey)")
def create_vs_update_split(t: Tables):
    base, delta = _base_delta(t)
    known = base.select("o_orderkey", F.lit("update").alias("action"))
    return delta.join(known, "o_orderkey", "left").select("o_orderkey", F.coalesce("action", F.lit("create")).alias("action"))


@query(BASE_DELTA + " SELECT o_orderkey, o_custkey, o_totalprice FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM d) UNION ALL SELECT * FROM d")
def replace_by_parent(t: Tables):
    base, delta = _base_delta(t)
    return replace_children(base, delta, "o_custkey")


@query("""SELECT 'orders without customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT 'lineitem without part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1) UNION ALL SELECT 'lineitem without orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def orphan_check(t: Tables):
    def orphans(rule, rows, key, parents, theirs):
        return rows.join(parents.select(F.col(theirs).alias(key)), key, "left_anti").agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))

    out = orphans("orders without customer", t.orders, "o_custkey", t.customer.filter("c_acctbal >= 0"), "c_custkey")
    out = out.unionByName(orphans("lineitem without part", t.lineitem, "l_partkey", t.part.filter("p_size > 1"), "p_partkey"))
    return out.unionByName(orphans("lineitem without orders", t.lineitem, "l_orderkey", t.orders, "o_orderkey"))


@query("""SELECT count(*) AS customers, count(*) FILTER (c_acctbal < 0) AS in_debt, count(*) FILTER (trim(c_mktsegment) = '') AS no_segment, count(*) FILTER (n = 0) AS no_orders, coalesce(sum(n), 0)::BIGINT AS orders
FROM (SELECT c.*, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer c)""")
def integrity_counts(t: Tables):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = t.customer.join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.count_if(F.trim("c_mktsegment") == "").alias("no_segment"), F.count_if(F.col("n").isNull()).alias("no_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


@query("""WITH h AS (SELECT c_custkey, c_name, 1 AS pri FROM customer WHERE upper(c_name) = upper('customer#000000042') UNION ALL SELECT c_custkey, c_name, 2 FROM customer WHERE c_custkey = 17 UNION ALL SELECT c_custkey, c_name, 3 FROM customer WHERE contains(lower(c_name), '0001'))
SELECT c_custkey, c_name, min(pri)::INT AS pri FROM h GROUP BY ALL ORDER BY pri, c_custkey LIMIT 20""")
def name_search(t: Tables):
    """By exact name regardless of case, then key, then part of the name; twenty at most."""
    c = t.customer.select("c_custkey", "c_name")
    name = F.col("c_name")
    pri = F.when(F.upper(name) == "CUSTOMER#000000042", 1).when(F.col("c_custkey") == 17, 2).when(F.lower(name).contains("0001"), 3)
    return c.withColumn("pri", pri).filter("pri is not null").orderBy("pri", "c_custkey").limit(20)


@query("SELECT p_partkey, count(*) OVER w AS family, min(p_partkey) OVER w AS head FROM part WINDOW w AS (PARTITION BY upper(trim(p_name)))")
def family_self_join(t: Tables):
    """How many parts share a part's normalised name, and the first of them: an aggregate joined back, not a self-join of all pairs."""
    rows = t.part.select("p_partkey", ids.ticker(F.col("p_name")).alias("name"))
    return rows.join(rows.groupBy("name").agg(F.count("*").alias("family"), F.min("p_partkey").alias("head")), "name").select("p_partkey", "family", "head")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)""")
def disjunctive_semi_join(t: Tables):
    keys = [("o_custkey", t.customer.filter("c_acctbal > 9000"), "c_custkey"), ("o_orderkey", t.lineitem.filter("l_quantity >= 50"), "l_orderkey")]
    return semi_any(t.orders.select("o_orderkey", "o_custkey"), keys, "o_orderkey").select("o_orderkey")


@query("""SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1996 + c_nationkey % 5 AND o_orderstatus <> 'P'""")
def facts_contexts_join(t: Tables):
    """An equi-join with a residual condition on the two sides' periods."""
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.year("o_orderdate") == 1996 + F.col("c_nationkey") % 5)
    return t.orders.filter("o_orderstatus != 'P'").join(t.customer, on).select("o_orderkey", "c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, CASE WHEN n.n_nationkey IS NOT NULL AND c_nationkey < 20 THEN 'link' ELSE 'convert' END AS action FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def legacy_conversion_plan(t: Tables):
    """Customers without large orders: linked where a nation is known, else converted."""
    large = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    rows = t.customer.join(large, "c_custkey", "left_anti").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("c_custkey", F.when(F.col("n_nationkey").isNotNull() & (F.col("c_nationkey") < 20), "link").otherwise("convert").alias("action"))


@query("""WITH d AS (SELECT p_name AS key, p_brand AS label, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS k FROM part), old AS (SELECT p_name AS key, p_brand AS label, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_size > 10)
SELECT coalesce(d.key, old.key) AS key, d.label, CASE WHEN old.key IS NULL THEN 'create' WHEN d.label IS DISTINCT FROM old.label THEN 'update' ELSE 'same' END AS action FROM (FROM d WHERE k = 1) d LEFT JOIN (FROM old WHERE k = 1) old ON old.key = d.key""")
def dictionary_sync(t: Tables):
    """What putting the last label of each name into a dictionary of first labels would do."""
    new = top_k(t.part, ["p_name"], [F.desc("p_partkey")]).select(F.col("p_name").alias("key"), F.col("p_brand").alias("label"))
    old = top_k(t.part.filter("p_size > 10"), ["p_name"], [F.asc("p_partkey")]).select(F.col("p_name").alias("key"), F.col("p_brand").alias("old"), F.lit(True).alias("known"))
    both = new.join(old, "key", "left")
    return both.select("key", "label", F.when(F.col("known").isNull(), "create").when(~F.col("label").eqNullSafe(F.col("old")), "update").otherwise("same").alias("action"))


@query(r"""WITH x AS (SELECT c_custkey AS k, c_name AS raw FROM customer)
SELECT k, upper(trim(raw)) AS ticker, nullif(ltrim(regexp_replace(raw, '\D', '', 'g'), '0'), '') AS cik, lpad(nullif(ltrim(regexp_replace(raw, '\D', '', 'g'), '0'), ''), 10, '0') AS cik10, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS cusip,
trim(regexp_replace(regexp_replace(raw || ' Holdings Inc.', '(?i)\b(INC|CORP|CORPORATION|CO|COMPANY|HOLDINGS|HLDGS|GROUP|PLC|LTD|LLC|CL A|CL B|COM|SER [A-Z])\b\.?', '', 'g'), '\s+', ' ', 'g')) AS name FROM x""")
def identifier_normalise(t: Tables):
    raw = F.col("c_name")
    return t.customer.select(F.col("c_custkey").alias("k"), ids.ticker(raw).alias("ticker"), ids.cik(raw).alias("cik"), ids.cik10(raw).alias("cik10"), ids.cusip(raw).alias("cusip"), ids.english_name(F.concat(raw, F.lit(" Holdings Inc."))).alias("name"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)\b(oil|gas|petroleum|pipeline|drilling|exploration|energy)\b') THEN 'Energy' WHEN regexp_matches(p_name, '(?i)\b(mining|chemical|steel|metal|forest|paper|lumber|glass|cement)\b') THEN 'Materials'
WHEN code BETWEEN 1000 AND 1299 THEN 'Materials' WHEN code BETWEEN 1300 AND 1399 THEN 'Energy' WHEN code BETWEEN 4900 AND 4999 THEN 'Utilities' WHEN code BETWEEN 6000 AND 6799 THEN 'Financials' WHEN code BETWEEN 7370 AND 7379 THEN 'Technology' WHEN code BETWEEN 8000 AND 8099 THEN 'Health Care' END AS sector
FROM (SELECT *, p_partkey * 37 % 9000 AS code FROM part)""")
def sector_rules(t: Tables):
    return t.part.select("p_partkey", ids.sector((F.col("p_partkey") * 37 % 9000).cast("string"), F.col("p_name")).alias("sector"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_quantity > 0 THEN floor(l_extendedprice * 100 / l_quantity + 0.5) / 100 END AS price,
CASE WHEN l_extendedprice >= 1e3 THEN printf('%.1f', round(l_extendedprice / 1e3, 1)) || 'K' ELSE floor(l_extendedprice)::BIGINT::VARCHAR END AS compact, CASE WHEN l_discount > 0 THEN '+' ELSE '' END || printf('%.2f', round(l_discount, 2)) || '%' AS change FROM lineitem""")
def display_formats(t: Tables):
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", num.price(c("l_extendedprice"), c("l_quantity")).alias("price"), num.compact(c("l_extendedprice")).alias("compact"), num.signed_pct(c("l_discount")).alias("change"))


@query("""SELECT q::INT AS q, ((q - 1) // 4)::VARCHAR || 'Q' || ((q - 1) % 4 + 1)::VARCHAR AS name, count(o_orderkey) AS orders FROM range(7996, 8008) r(q) LEFT JOIN orders ON year(o_orderdate) * 4 + quarter(o_orderdate) = q GROUP BY q""")
def quarter_range(t: Tables):
    """The quarters 1998Q4 to 2001Q3 with their orders, those without any too."""
    span = t.spark.range(1).select(F.explode(F.sequence(num.quarter_of(F.lit("1998Q4")), num.quarter_of(F.lit("2001-q3")))).alias("q"))
    n = t.orders.groupBy(num.quarter_ordinal(F.col("o_orderdate")).alias("q")).agg(F.count("*").alias("orders"))
    return span.join(n, "q", "left").select("q", num.quarter_name(F.col("q")).alias("name"), F.coalesce("orders", F.lit(0)).alias("orders"))
