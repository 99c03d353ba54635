"""Queries of integrity: reports with samples, references, blockers of clean-ups, facts chosen from two sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import numbers as num
from tessella.functions import text as tx
from tessella.operators import integrity
from tessella.operators import retrieval as r
from tessella.plans.base import Tables, query
from tessella.sources.shared import new_folder

SECURITIES = """s AS (SELECT p_partkey AS id, p_brand AS issuer, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS ticker, CASE WHEN p_size % 5 > 0 THEN p_type END AS company, coalesce(n, 0) AS holdings
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY l_partkey) ON l_partkey = p_partkey)"""


def _securities(t: Tables):
    n = t.lineitem.filter("l_discount > 0.05").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    own = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("issuer"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).alias("ticker"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("company"))
    return own.join(n, "id", "left").select("id", "issuer", "ticker", "company", F.coalesce("n", F.lit(0)).alias("holdings"))


REPORT = "total long, no_ticker long, no_company long, holdings_no_company long, holdings_no_ticker long, samples array<struct<id: long, issuer: string, ticker: string, company: string, holdings: long>>"


@query(f"""WITH {SECURITIES}, x AS (SELECT * FROM s WHERE holdings > 0 AND (ticker IS NULL OR company IS NULL) ORDER BY md5(id::VARCHAR), id LIMIT 30)
SELECT count(*) AS total, count(*) FILTER (ticker IS NULL) AS no_ticker, count(*) FILTER (company IS NULL) AS no_company, count(*) FILTER (holdings > 0 AND company IS NULL) AS holdings_no_company, count(*) FILTER (holdings > 0 AND ticker IS NULL) AS holdings_no_ticker,
  (SELECT string_agg(id::VARCHAR || ' ' || issuer || ' ' || coalesce(ticker, '-') || ' ' || coalesce(company, '-') || ' ' || holdings::VARCHAR, ',' ORDER BY md5(id::VARCHAR), id) FROM x) AS samples FROM s""")
def integrity_report(t: Tables):
    """Securities without what they need, with thirty samples: one pass, written as a report of JSON and read again."""
    c, held = F.col, F.col("holdings") > 0
    no_ticker, no_company = c("ticker").isNull(), c("company").isNull()
    counts = {"no_ticker": no_ticker, "no_company": no_company, "holdings_no_company": held & no_company, "holdings_no_ticker": held & no_ticker}
    found = integrity.report(_securities(t), counts, held & (no_ticker | no_company), {n: c(n) for n in ("id", "issuer", "ticker", "company", "holdings")}, c("id"))
    integrity.write_report(t.spark, found, at := new_folder(t.spark, "report"))
    rows = t.spark.read.schema(REPORT).json(at)
    line = lambda x: F.concat_ws(" ", x["id"].cast("string"), x["issuer"], F.coalesce(x["ticker"], F.lit("-")), F.coalesce(x["company"], F.lit("-")), x["holdings"].cast("string"))
    return rows.withColumn("samples", F.array_join(F.transform("samples", line), ","))


@query("""SELECT p_brand || '/' || p_type AS company, min(p_name) AS name, count(*) AS refs, p_brand || '/' || p_type IN (SELECT p_brand || '/' || p_type FROM part WHERE p_size > 45) AS present
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1""")
def company_references(t: Tables):
    """How often holdings refer to each company, and whether it has large parts."""
    company = F.concat_ws("/", "p_brand", "p_type").alias("company")
    # lines are counted by part before names are looked up
    n = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("n"))
    lines = n.join(t.part.select("p_partkey", company, "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    return integrity.reference_counts(lines, "company", F.col("p_name"), F.col("n"), t.part.filter("p_size > 45").select(company))


@query("""WITH e AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS keep_id FROM part),
f AS (SELECT DISTINCT l_partkey AS entity, year(l_shipdate)::INT AS period, l_returnflag AS kind, l_linestatus AS item FROM lineitem),
m AS (SELECT e.id AS drop_id, e.keep_id, f.period, f.kind, f.item, EXISTS (SELECT 1 FROM f k WHERE k.entity = e.keep_id AND k.period = f.period AND k.kind = f.kind AND k.item = f.item) AS had FROM e JOIN f ON f.entity = e.id WHERE e.id <> e.keep_id)
SELECT e.id AS drop_id, e.keep_id, count(*) FILTER (had) AS duplicates, count(*) FILTER (NOT had) AS n_blockers, coalesce(string_agg(period::VARCHAR || ' ' || kind || ' ' || item, ',' ORDER BY period::VARCHAR || ' ' || kind || ' ' || item) FILTER (NOT had), '') AS blockers
FROM e LEFT JOIN m ON m.drop_id = e.id WHERE e.id <> e.keep_id GROUP BY ALL""")
def duplicate_blockers(t: Tables):
    """Facts of parts that are to be dropped for another one of their company, by period, kind and item: had by the other one, or in the way."""
    best = t.part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("keep_id"))
    pairs = t.part.select(F.col("p_partkey").alias("drop_id"), "p_brand", "p_type").join(best, ["p_brand", "p_type"]).filter("drop_id != keep_id").select("drop_id", "keep_id")
    facts = t.lineitem.select(F.col("l_partkey").alias("entity"), F.year("l_shipdate").alias("period"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("item"))
    found = integrity.duplicate_rows(facts, pairs, "entity", ["period", "kind", "item"], F.concat_ws(" ", F.col("period").cast("string"), "kind", "item"))
    return found.select("drop_id", "keep_id", "duplicates", F.size("blockers").cast("long").alias("n_blockers"), F.array_join("blockers", ",").alias("blockers"))


TAGS, UNITS = ["1-URGENT", "3-MEDIUM", "5-LOW"], ["USD", "USD/SHARES"]


@query("""WITH o AS (SELECT o_custkey % 60 AS entity, year(o_orderdate)::INT AS fy, o_orderstatus AS item, o_orderkey, o_orderpriority AS tag, o_totalprice AS value, o_orderdate::DATE AS filed,
  CASE o_orderkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD/shares' END AS unit FROM orders),
t AS (SELECT *, CASE tag WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 2 END AS r FROM o),
a AS (SELECT entity, fy, item, value, 'USD' AS unit, 'feed' AS source, row_number() OVER (PARTITION BY entity, fy, item ORDER BY r, filed DESC, value DESC) AS nth FROM t WHERE o_orderkey % 3 = 0 AND r IS NOT NULL AND upper(unit) = 'USD'),
b AS (SELECT entity, fy, item, value, coalesce(unit, 'USD') AS unit, 'inline' AS source, row_number() OVER (PARTITION BY entity, fy, item ORDER BY CASE WHEN upper(unit) IN ('USD', 'USD/SHARES') THEN 0 ELSE 1 END, o_orderkey) AS nth FROM t WHERE o_orderkey % 3 = 1 AND r IS NOT NULL)
SELECT w.entity, w.fy, w.item, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN a.unit ELSE b.unit END AS unit, CASE WHEN a.value IS NOT NULL THEN 'feed' WHEN b.value IS NOT NULL THEN 'inline' ELSE 'missing' END AS source
FROM (SELECT DISTINCT entity, fy, item FROM o) w LEFT JOIN (FROM a WHERE nth = 1) a USING (entity, fy, item) LEFT JOIN (FROM b WHERE nth = 1) b USING (entity, fy, item)""")
def annual_fact_choice(t: Tables):
    """Each entity's annual facts from a feed by tag and date, and where it has none, from tagged documents by unit and place."""
    unit = F.when(F.col("o_orderkey") % 4 == 0, "usd").when(F.col("o_orderkey") % 4 == 1, "EUR").when(F.col("o_orderkey") % 4 == 2, "USD/shares")
    rows = t.orders.select((F.col("o_custkey") % 60).alias("entity"), F.year("o_orderdate").alias("fy"), F.col("o_orderstatus").alias("item"), F.col("o_orderpriority").alias("tag"), unit.alias("unit"), F.col("o_totalprice").alias("value"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderkey").alias("pos"))
    return integrity.chosen_facts(rows.filter("pos % 3 = 0"), rows.filter("pos % 3 = 1"), rows, ["entity", "fy", "item"], TAGS, UNITS)


@query("""SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 3 > 0 THEN o.o_custkey ELSE c.c_custkey END AS security_id, o.o_orderkey % 3 > 0 AS had, o.o_orderkey % 3 = 0 AND c.c_custkey IS NOT NULL AS filled
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0""")
def link_backfill(t: Tables):
    """Orders with their customer's id where it is there, or filled in from those in credit, and which way it came."""
    orders = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("own"))
    links = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("found"))
    return integrity.backfilled(orders, links, "o_custkey", "own", "found").select("o_orderkey", F.col("own").alias("security_id"), "had", "filled")


@query("""SELECT count(*) AS total, count(*) FILTER (o.o_orderkey % 3 > 0) AS had, count(*) FILTER (o.o_orderkey % 3 = 0 AND c.c_custkey IS NOT NULL) AS filled, count(*) FILTER (o.o_orderkey % 3 = 0 AND c.c_custkey IS NULL) AS missing
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0""")
def link_coverage(t: Tables):
    """How many links were there, were filled in, and are missing."""
    rows = link_backfill(t)
    return rows.agg(F.count("*").alias("total"), F.count_if("had").alias("had"), F.count_if("filled").alias("filled"), F.count_if(F.col("security_id").isNull()).alias("missing"))


_WORD = "(?i)(^|[^A-Za-z0-9_])({})($|[^A-Za-z0-9_])"
RULES = [(_WORD.format(words), code) for words, code in (("disgusting|scum", "RUDE"), ("the|of", "EN"), ("und|der|die", "DE"), ("les|des|une", "FR"), ("los|las|una", "ES"))]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{v}'" for p, v in RULES) + " END AS code FROM documents")
def ordered_match(t: Tables):
    """The first rule, in order, that each document matches."""
    return t.documents.select("doc_id", tx.first_match(F.col("text"), RULES).alias("code"))


KNOWN, DEFAULT = ("src0", "src1", "src2", "src3"), ("src0",)


@query("SELECT 'some' AS way, source, count(*) AS n FROM documents WHERE source IN ('src2', 'src1') GROUP BY source UNION ALL SELECT 'none', source, count(*) FROM documents WHERE source = 'src0' GROUP BY source")
def allow_list(t: Tables):
    """Documents of the kinds that an override allows, and of the default ones where it names none that is known."""
    ways = [("some", " SRC2,nope, src1,src2"), ("none", "nope,,")]
    parts = [t.documents.filter(F.col("source").isin(*r.allowed(x, KNOWN, DEFAULT))).groupBy("source").agg(F.count("*").alias("n")).select(F.lit(way).alias("way"), "source", "n") for way, x in ways]
    return parts[0].unionByName(parts[1])


@query("""SELECT c_nationkey, CASE WHEN abs(v) >= 1000 THEN printf('%.0f', round(v, 0)) WHEN abs(v) >= 10 THEN printf('%.1f', round(v, 1)) ELSE printf('%.2f', round(v, 2)) END || '亿' AS amount
FROM (SELECT c_nationkey, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE * (1 + c_nationkey % 3 * 40) / 1e8 AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)""")
def amounts_in_yi(t: Tables):
    """Nations' orders in units of 10**8."""
    rows = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    n = rows.groupBy("c_nationkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("n"))
    return n.select("c_nationkey", num.yi(F.col("n") * (1 + F.col("c_nationkey") % 3 * 40)).alias("amount"))


_MARKED = r"""list_transform(string_split_regex(text, '\n+'), lambda x, i: CASE i % 6 WHEN 1 THEN '# Title ' || i::VARCHAR || ' 标题' WHEN 2 THEN '中文' || i::VARCHAR WHEN 4 THEN '| 表 | ' || i::VARCHAR || ' |' || chr(10) || '| a | b |' ELSE x END)"""


@query(rf"""WITH t AS (SELECT doc_id, array_to_string({_MARKED}, chr(10)) AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
k AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l),
m AS (SELECT *, starts_with(s, '|') OR regexp_matches(s, '^---[\s|:]+') AS tab, NOT regexp_matches(s, '[\x{{4e00}}-\x{{9fff}}]') AS en FROM k),
n AS (SELECT *, tab AND NOT coalesce(lag(tab) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
o AS (SELECT *, last_value(CASE WHEN opens THEN en END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS target FROM n),
p AS (SELECT doc_id, i, CASE WHEN tab THEN CASE WHEN target THEN line END WHEN s = '' THEN line WHEN starts_with(s, '#') THEN regexp_replace(regexp_replace(s, '[\x{{4e00}}-\x{{9fff}}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}]+', '', 'g'), '^\s+|\s+$', '', 'g') WHEN en THEN line END AS kept FROM o)
SELECT doc_id, coalesce(regexp_replace(regexp_replace(string_agg(kept, chr(10) ORDER BY i), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS text FROM p GROUP BY doc_id""")
def english_lines(t: Tables):
    """Documents between Chinese lines, headings and tables, without what is Chinese."""

    def marked(x, k):
        i = k + 1
        n = i.cast("string")
        return F.when(i % 6 == 1, F.concat(F.lit("# Title "), n, F.lit(" 标题"))).when(i % 6 == 2, F.concat(F.lit("中文"), n)).when(i % 6 == 4, F.concat(F.lit("| 表 | "), n, F.lit(" |\n| a | b |"))).otherwise(x)

    text = F.array_join(F.transform(F.split("text", "\n+"), marked), "\n")
    return t.documents.select("doc_id", tx.only_language(text, False).alias("text"))
