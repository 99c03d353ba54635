"""Feeds of JSON, HTML and XML that are written from the tables and read again; the SQL says what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import identifiers as ids
from tessella.functions import numbers as num
from tessella.operators import transcripts
from tessella.plans.base import Tables, query
from tessella.sources import filing_pages, readers
from tessella.sources.shared import new_folder

FORMS = ("10-K", "10-K/A", "20-F", "13F-HR", "8-K")


def _field(name: str):
    return lambda row: row[name]


def _filing_feed(t: Tables):
    """id and a JSON object of parallel arrays for each customer: a filing for each order, in order of its key."""
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    one = F.struct("o_orderkey", form.alias("form"), day.alias("day"), F.concat(F.lit("A-"), (F.col("o_orderkey") % 9).cast("string")).alias("acc"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("doc"))
    all_ = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    names = {"form": "form", "filingDate": "day", "accessionNumber": "acc", "reportDate": "day", "primaryDocument": "doc"}
    return all_.select("id", F.to_json(F.struct(*(F.transform("x", _field(c)).alias(n) for n, c in names.items()))).alias("json"))


def _filing_sql(forms: tuple[str, ...]) -> str:
    return f"""SELECT o_custkey AS id, form, day AS filing_date, acc, 'd' || o_orderkey::VARCHAR || '.htm' AS document FROM (
  SELECT *, ['10-K', '10-K/A', '20-F', '13F-HR', '8-K'][o_orderkey % 5 + 1] AS form, strftime(o_orderdate, '%Y-%m-%d') AS day, 'A-' || (o_orderkey % 9)::VARCHAR AS acc FROM orders) WHERE form IN {forms} QUALIFY row_number() OVER (PARTITION BY o_custkey, acc ORDER BY o_orderkey DESC) = 1"""


def _filings(t: Tables, forms: tuple[str, ...]):
    found = readers.filings(_filing_feed(t), "json", forms)
    return found.select("id", "form", F.col("filingDate").alias("filing_date"), F.col("accessionNumber").alias("acc"), F.col("primaryDocument").alias("document"))


@query(_filing_sql(("10-K", "10-K/A", "20-F")))
def annual_filings(t: Tables):
    """Annual filings of each customer's feed, one for each accession number, the last."""
    return _filings(t, ("10-K", "10-K/A", "20-F"))


@query(_filing_sql(("13F-HR", "13F-HR/A")))
def holdings_filings(t: Tables):
    return _filings(t, ("13F-HR", "13F-HR/A"))


@query("""SELECT c_nationkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'us-gaap' ELSE 'ifrs' END AS taxonomy, o_orderpriority AS tag, CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS unit,
  strftime(o_orderdate, '%Y-%m-%d') AS "end", o_totalprice::DOUBLE AS val, year(o_orderdate)::INT AS fy FROM orders JOIN customer ON c_custkey = o_custkey""")
def company_facts_feed(t: Tables):
    """Facts of nations' nested JSON, by taxonomy, tag and unit."""
    rows = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("id")), F.col("c_custkey") == F.col("o_custkey"))
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    fact = F.struct(day.alias("end"), day.alias("filed"), F.col("o_totalprice").cast("double").alias("val"), F.lit("10-K").alias("form"), F.lit("FY").alias("fp"), F.year("o_orderdate").alias("fy"))
    rows = rows.select("id", F.when(k % 2 == 0, "us-gaap").otherwise("ifrs").alias("taxonomy"), F.col("o_orderpriority").alias("tag"), F.when(k % 3 == 0, "EUR").otherwise("USD").alias("unit"), fact.alias("fact"))
    nest = lambda df, by, key, value: df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    units = nest(rows.groupBy("id", "taxonomy", "tag", "unit").agg(F.collect_list("fact").alias("f")), ["id", "taxonomy", "tag"], "unit", "f")
    tags = nest(units.withColumn("u", F.struct(F.col("m").alias("units"))), ["id", "taxonomy"], "tag", "u")
    feed = nest(tags, ["id"], "taxonomy", "m").select("id", F.to_json(F.struct(F.col("m").alias("facts"))).alias("json"))
    return readers.company_facts(feed, "json").select("id", "taxonomy", "tag", "unit", "end", "val", "fy")


@query("SELECT DISTINCT upper(p_name) AS ticker, p_partkey AS cik, p_brand AS title FROM part")
def ticker_feed(t: Tables):
    """An object of objects for each brand, as a dictionary of tickers."""
    one = F.struct(F.col("p_partkey").alias("cik_str"), F.col("p_name").alias("ticker"), F.col("p_brand").alias("title"))
    feed = t.part.groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), one)))).alias("json"))
    return readers.ticker_dictionary(feed, "json")


@query("""SELECT event_id AS id, 'us:' || event_type AS name, 'c' || (event_id % 2)::VARCHAR AS context, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y') || '-01-01' END AS "start", CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y') || '-12-31' END AS "end",
  CASE WHEN event_id % 2 = 1 THEN strftime(ts, '%Y-%m-%d') END AS instant, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * user_id * 1000)::DOUBLE END AS value FROM events""")
def inline_facts_feed(t: Tables):
    """Tagged numbers of documents with their contexts' periods."""
    e, day, year = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy")
    period = F.when(e % 2 == 0, F.concat(F.lit("<xbrli:startDate>"), year, F.lit("-01-01</xbrli:startDate><xbrli:endDate> "), year, F.lit("-12-31 </xbrli:endDate>"))).otherwise(F.concat(F.lit("<xbrli:instant>"), day, F.lit("</xbrli:instant>")))
    text = F.when(e % 7 == 0, "—").when(e % 2 == 0, F.concat(F.lit("<b>"), F.col("user_id").cast("string"), F.lit("</b>"))).otherwise(F.format_string("%,d", "user_id"))
    html = F.concat(
        F.lit('<html><xbrli:context id="c'), (e % 2).cast("string"), F.lit('">\n<xbrli:period>'), period, F.lit('</xbrli:period></xbrli:context><p>x <ix:nonFraction name="us:'), F.col("event_type"),
        F.lit('" contextRef="c'), (e % 2).cast("string"), F.lit('" unitRef="usd" scale="3"'), F.when(e % 3 == 0, ' sign="-"').otherwise(""), F.lit(">"), text, F.lit("</ix:nonFraction></p></html>"),
    )
    facts = readers.inline_facts(t.events.select(e.alias("id"), html.alias("html")), "html")
    return facts.select("id", "name", "context", "start", "end", "instant", (num.inline_number(F.col("text"), F.col("sign"), F.col("scale")) + 0.0).alias("value"))  # no negative zero


@query("SELECT p_partkey % 100 AS cusip, min('N ' || p_name) AS issuer, sum(p_size)::BIGINT AS value, sum(p_partkey)::BIGINT AS shares FROM part WHERE p_partkey % 11 > 0 GROUP BY 1")
def information_table(t: Tables):
    """Positions of information tables in XML files with a namespace, a security's rows together; rows without a number are left out."""
    k = F.col("p_partkey")
    tag = lambda n, c: F.concat(F.lit(f"<ns1:{n}>"), c, F.lit(f"</ns1:{n}>"))
    cusip = F.when(k % 11 == 0, " ").otherwise((k % 100).cast("string"))
    row = F.concat(F.lit('<ns1:infoTable xmlns:ns1="urn:x">'), tag("nameOfIssuer", F.concat(F.lit("N "), "p_name")), tag("cusip", cusip), tag("value", F.col("p_size").cast("string")), F.lit("<ns1:shrsOrPrnAmt>"), tag("sshPrnamt", k.cast("string")), F.lit("</ns1:shrsOrPrnAmt></ns1:infoTable>"))
    t.part.select(row.alias("value")).write.text(at := new_folder(t.spark, "feed"))
    found = readers.holdings_xml(t.spark, at).filter(F.trim("cusip") != "")
    return found.groupBy(F.col("cusip").cast("long").alias("cusip")).agg(F.min("nameOfIssuer").alias("issuer"), F.sum("value").alias("value"), F.sum("shares").alias("shares"))


@query(r"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN chr(65 + (s_suppkey % 26)::INT) WHEN 2 THEN chr(65 + (s_suppkey % 5)::INT) END AS share_class, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey * 10.0::DOUBLE WHEN 1 THEN s_suppkey * 0.01::DOUBLE END AS assets,
  'DELTA AIRLINES ' || chr(70 + (s_suppkey % 20)::INT) || chr(65 + (s_suppkey % 7)::INT) AS match_key FROM supplier""")
def issuer_titles(t: Tables):
    """Share classes, amounts and matching keys from how filings write them."""
    k = F.col("s_suppkey")
    a, b = F.char(65 + k % 26), F.char(65 + k % 7)
    title = F.when(k % 4 == 0, F.concat(F.lit("COM CLASSIC "), a)).when(k % 4 == 1, F.concat(F.lit("class "), a)).when(k % 4 == 2, F.concat(F.lit("CL "), F.char(65 + k % 5))).otherwise("ORD")
    amount = F.when(k % 3 == 0, F.concat(F.lit("$"), k.cast("string"), F.lit("B"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(" M of assets"))).otherwise("unknown")
    name = F.concat(F.when(k % 2 == 0, "Delta Airls ").otherwise("DELTA AIRLS  "), F.char(70 + k % 20), b, F.when(k % 2 == 0, " Inc Del").otherwise(" Corp. NEW"))
    return t.supplier.select("s_suppkey", ids.share_class(title).alias("share_class"), num.assets_in_yi(amount).alias("assets"), ids.issuer_match_key(name).alias("match_key"))


ANNUAL = ("10-K", "10-K/A", "20-F", "20-F/A")


@query("""WITH f AS (SELECT c_nationkey AS id, o_orderkey, ['10-K', '10-K/A', '20-F', '13F-HR', '8-K'][o_orderkey % 5 + 1] AS form, strftime(o_orderdate, '%Y-%m-%d') AS report_date, 'A-' || (o_orderkey % 97)::VARCHAR AS accession FROM orders JOIN customer ON c_custkey = o_custkey),
l AS (SELECT * FROM f WHERE form IN ('10-K', '10-K/A', '20-F', '20-F/A') QUALIFY row_number() OVER (PARTITION BY id, accession ORDER BY o_orderkey DESC) = 1)
SELECT id, form, accession, report_date, 'd' || o_orderkey::VARCHAR AS document, (row_number() OVER (PARTITION BY id ORDER BY report_date DESC, accession))::INT AS nth FROM l""")
def paged_annual_filings(t: Tables):
    """Annual filings of nations' feeds of a page of recent filings and pages of a hundred older ones, newest report first."""
    rows = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("id")), F.col("c_custkey") == F.col("o_custkey"))
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    one = F.struct("o_orderkey", form.alias("form"), day.alias("day"), F.concat(F.lit("A-"), (F.col("o_orderkey") % 97).cast("string")).alias("acc"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("doc"))
    paged = rows.groupBy("id", F.floor(F.col("o_orderkey") / 600).cast("int").alias("page")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    names = {"form": "form", "filingDate": "day", "accessionNumber": "acc", "reportDate": "day", "primaryDocument": "doc"}
    feed = paged.select(F.to_json(F.struct("id", "page", *(F.transform("x", _field(c)).alias(n) for n, c in names.items()))).alias("value"))
    feed.write.option("maxRecordsPerFile", 10_000).text(at := new_folder(t.spark, "pages"))  # a page is a few filings: many stand in a file
    found = filing_pages.newest(filing_pages.filing_pages(t.spark, at), ANNUAL)
    return found.select("id", "form", "accession", "report_date", "document", "nth")


MEETING = r"^\s*(?:19|20)\d{2}\s+MEETING\s+\(\d{2}:\d{2}:\d{2}\)\s*$"


@query(rf"""WITH p AS (SELECT conv_id % 12 AS key, conv_id, turn, CASE WHEN turn % 3 = 0 THEN chr(10) || (1986 + (conv_id + turn) % 9)::VARCHAR || ' MEETING (01:02:' || lpad((turn % 60)::VARCHAR, 2, '0') || ')' || chr(10) ELSE '' END || CASE WHEN role = 'assistant' THEN 'WB: ' ELSE '' END || text || CASE WHEN turn % 5 = 2 THEN chr(10) || 'ON ' || upper(role) || ' ' || turn::VARCHAR ELSE '' END AS text FROM conversations),
l AS (SELECT key, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{MEETING}') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY conv_id, turn, pos) AS section FROM l),
g AS (SELECT key, section, list(rtrim(line, ' ') ORDER BY conv_id, turn, pos) AS ls FROM s WHERE section > 0 GROUP BY key, section),
b AS (SELECT key, section, trim(ls[1]) AS header, list_filter(ls[2:], lambda x: x <> '') AS body FROM g),
d AS (SELECT *, trim(body[-1]) AS z FROM b WHERE len(list_filter(body, lambda x: regexp_matches(x, '(?i)\b(WB|CM)\s*:'))) > 0),
c AS (SELECT key, section, regexp_extract(header, '\d+', 0)::INT AS year, header, body, CASE WHEN length(z) > 3 AND length(z) < 50 AND z = upper(z) AND NOT contains(z, ':') THEN z END AS topic FROM d)
SELECT key, year, header, topic, array_to_string(CASE WHEN topic IS NULL THEN body ELSE body[:len(body) - 1] END, chr(10)) AS content, (row_number() OVER (PARTITION BY key, year ORDER BY section))::INT AS nth FROM c""")
def transcript_sections(t: Tables):
    """Conversations in a dozen long texts, cut into meetings, those with dialogue, by year."""
    turn, text = F.col("turn"), F.col("text")
    head = F.concat(F.lit("\n"), (1986 + (F.col("conv_id") + turn) % 9).cast("string"), F.lit(" MEETING (01:02:"), F.lpad((turn % 60).cast("string"), 2, "0"), F.lit(")\n"))
    tail = F.concat(F.lit("\nON "), F.upper("role"), F.lit(" "), turn.cast("string"))
    whole = F.concat(F.when(turn % 3 == 0, head).otherwise(""), F.when(F.col("role") == "assistant", "WB: ").otherwise(""), text, F.when(turn % 5 == 2, tail).otherwise(""))
    parts = t.conversations.select((F.col("conv_id") % 12).alias("key"), F.struct("conv_id", "turn").alias("part"), whole.alias("text"))
    return transcripts.sections(parts, MEETING, r"\d+", r"(?i)\b(WB|CM)\s*:")
