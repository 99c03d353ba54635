"""Queries of the graph, text and quality domain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import chunking, graph
from tessella.operators.relational import top_k
from tessella.plans.base import Tables, query
from tessella.sources import readers
from tessella.sources.shared import written

MENTION = "mention AS (SELECT doc_id, 1965 + doc_id % 61 AS year, source, concept FROM (SELECT d.*, c.concept FROM documents d, (SELECT concept, unnest(words) AS word FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in graph.CONCEPTS.items()) + ") v(concept, words)) c WHERE contains(lower(d.text), c.word)) GROUP BY ALL)"


def _mentions(t: Tables):
    rows = t.documents.select("doc_id", (1965 + F.col("doc_id") % 61).alias("year"), "source", "text")
    return graph.mentions(rows, "text").drop("text")


@query(f"WITH {MENTION} SELECT * FROM mention")
def mention_extraction(t: Tables):
    return _mentions(t)


@query(f"WITH {MENTION} SELECT DISTINCT doc_id AS src, concept AS name, year FROM mention WHERE (contains(concept, 'licen') OR contains(concept, 'rare')) AND year >= 1980 ORDER BY year DESC, src, name LIMIT 20")
def graph_one_hop(t: Tables):
    edges = _mentions(t).select(F.col("doc_id").alias("src"), F.col("concept").alias("dst"), "year")
    nodes = t.spark.createDataFrame([(c, c) for c in graph.CONCEPTS], "id string, name string")
    return graph.one_hop(edges, nodes, ["licen", "rare"], 1980, None, 20)


@query("""SELECT DISTINCT r_name AS hit, n_name AS via FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION SELECT r_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def graph_two_hop_union(t: Tables):
    """Regions reached over nations from customers and from suppliers, each once."""
    up = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("hit"), F.col("n_name").alias("via"))
    a = t.customer.select(F.col("c_nationkey").alias("n_nationkey")).distinct().join(up, "n_nationkey")
    b = t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct().join(up, "n_nationkey")
    return a.unionByName(b).select("hit", "via").distinct()


@query("SELECT n_name, count(c_custkey) AS customers, coalesce(sum(c_acctbal::DECIMAL(18,2)), 0)::DECIMAL(28,2) AS balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 9000 GROUP BY n_name")
def optional_match(t: Tables):
    """The condition belongs to the optional side, so nations without a match stay."""
    on = t.customer.filter("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("b"))
    return t.nation.join(on, "n_nationkey", "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.coalesce(F.sum("b"), F.lit(0)).cast("decimal(28,2)").alias("balance"))


@query(f"WITH {MENTION} SELECT source, concept, min(year) AS first_year, max(year) AS last_year, count(*) AS mentions FROM mention GROUP BY source, concept")
def holds_view_minmax(t: Tables):
    return _mentions(t).groupBy("source", "concept").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("mentions"))


@query(f"WITH {MENTION} SELECT source, concept, doc_id, first_year, last_year FROM (SELECT *, min(year) OVER w AS first_year, max(year) OVER w AS last_year, row_number() OVER (PARTITION BY source, concept ORDER BY year DESC, doc_id DESC) AS k FROM (SELECT * FROM mention WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WINDOW w AS (PARTITION BY source, concept)) WHERE k = 1")
def triplet_merge(t: Tables):
    """Edges of documents not worked on yet, merged by key: the last one's document and the years' range."""
    new = _mentions(t).join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return graph.merge(new, ["source", "concept"], [F.desc("year"), F.desc("doc_id")], "year").select("source", "concept", "doc_id", "first_year", "last_year")


@query("SELECT source, count(*) AS total, count(l.doc_id) AS done, CASE WHEN count(l.doc_id) = 0 THEN 'open' WHEN count(l.doc_id) = count(*) THEN 'done' ELSE 'partial' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source")
def progress_report(t: Tables):
    done = t.labels.select("doc_id").distinct().withColumn("d", F.lit(1))
    n = t.documents.select("doc_id", "source").join(done, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("d").alias("done"))
    return n.withColumn("status", F.when(F.col("done") == 0, "open").when(F.col("done") == F.col("total"), "done").otherwise("partial"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS text, count(*) AS parts FROM conversations GROUP BY conv_id")
def ordered_concat(t: Tables):
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("turn", "text")))).alias("p"), F.count("*").alias("parts"))
    return rows.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n---\n\n").alias("text"), "parts")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, list_filter(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda h: ends_with(lower(h), 'e'))[1] AS first_link, len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS links FROM pages""")
def html_title_href(t: Tables):
    html = F.col("html")
    return t.pages.select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.get(readers.links(html, "e"), F.lit(0)).alias("first_link"), F.size(readers.links(html, "")).cast("long").alias("links"))


@query("SELECT conv_id, count(*) AS turns, bool_and(turn = k) AS contiguous, count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (role NOT IN ('user', 'assistant', 'system')) AS bad_role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) GROUP BY conv_id")
def section_order_check(t: Tables):
    """Whether turns are 0, 1, 2, ...: as many distinct ones as rows, from 0 to one less. No order within groups is needed."""
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"), F.count_if(F.trim("text") == "").alias("blank"), F.count_if(~F.col("role").isin("user", "assistant", "system")).alias("bad_role"))
    return c.select("conv_id", "turns", ((F.col("lo") == 0) & (F.col("hi") == F.col("turns") - 1) & (F.col("n") == F.col("turns"))).alias("contiguous"), "blank", "bad_role")


@query(r"""WITH i AS (SELECT item_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: len(x) >= 3)) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: len(x) >= 3)) AS w FROM documents),
x AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(w) AS w FROM i) a JOIN (SELECT doc_id, unnest(w) AS w FROM d) b USING (w) GROUP BY ALL)
SELECT item_id, doc_id, round(n / len(i.w)::DOUBLE, 6) AS share FROM x JOIN i USING (item_id) WHERE 10 * n >= 7 * len(i.w)""")
def word_overlap_ratio(t: Tables):
    """Pairs of a benchmark item and a document of any language that holds 70 % of its distinct words.

    Such a document holds one of the item's rarest words, as many as may be missing and one: only these make candidates.
    """
    own = lambda c: F.array_distinct(tx.words(F.col(c)))
    items = t.benchmark.select("item_id", own("text").alias("iw"))
    places = written(items.select("item_id", F.size("iw").alias("m"), F.explode("iw").alias("w")), "item-words")
    # texts are split once: of their words those of some item are kept
    held = written(t.documents.select("doc_id", F.explode(own("text")).alias("w")).join(places.select("w").distinct(), "w"), "overlap-words")
    counts = held.groupBy("w").agg(F.count("*").alias("df"))
    # a word that no document has comes first
    ranked = top_k(places.join(counts, "w", "left").withColumn("df", F.coalesce("df", F.lit(0))), ["item_id"], [F.col("df"), F.col("w")], 2**31 - 1, rank="nth")
    rare = ranked.filter(F.col("nth") <= F.col("m") - F.ceil(F.col("m") * 7 / 10) + 1).select("item_id", "w")
    met = held.join(rare, "w").select("item_id", "doc_id").distinct()
    both = met.join(held, "doc_id").join(places, ["item_id", "w"]).groupBy("item_id", "doc_id").agg(F.count("*").alias("n"), F.max("m").alias("m"))
    return both.filter(10 * F.col("n") >= 7 * F.col("m")).select("item_id", "doc_id", F.round(F.col("n") / F.col("m"), 6).alias("share"))


@query(r"""SELECT page_id, len(p) AS body, round(len(p) / len(html)::DOUBLE, 6) AS coverage, regexp_matches(p, '\$[0-9,]+') OR regexp_matches(p, '\.{3,}') AS table_like FROM (SELECT page_id, html, regexp_replace(html, '<[^>]+>', '', 'g') AS p FROM pages)""")
def parse_coverage(t: Tables):
    p = F.regexp_replace("html", "<[^>]+>", "")
    return t.pages.select("page_id", F.length(p).cast("long").alias("body"), F.round(F.length(p) / F.length("html"), 6).alias("coverage"), (p.rlike(r"\$[0-9,]+") | p.rlike(r"\.{3,}")).alias("table_like"))


@query("SELECT source, lang, count(*) AS n, min(1965 + doc_id % 61) AS first_year, max(1965 + doc_id % 61) AS last_year, count(DISTINCT 1965 + doc_id % 61) AS years, min(1965 + doc_id % 61)::VARCHAR || '-' || max(1965 + doc_id % 61)::VARCHAR AS span FROM documents GROUP BY source, lang")
def material_counts(t: Tables):
    y = 1965 + F.col("doc_id") % 61
    c = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.count_distinct(y).alias("years"))
    return c.withColumn("span", F.concat_ws("-", "first_year", "last_year"))


_PIECES = """flatten(list_transform(string_split_regex(text, '\\n+'), lambda x, i: [
  CASE WHEN i % 7 = 1 THEN '## Part ' || i::VARCHAR || ' 部分' WHEN i % 7 = 4 THEN '#### Sub ' || i::VARCHAR WHEN i % 7 = 6 THEN '### 小节 ' || i::VARCHAR ELSE '' END, x, CASE WHEN i % 4 = 0 THEN 'February 25, 1985' ELSE '' END,
  CASE WHEN i % 3 = 0 THEN '中文第' || i::VARCHAR || '段' ELSE '' END, CASE WHEN i % 5 = 0 THEN '| a | ' || i::VARCHAR || ' |' || chr(10) || '| b | c |' ELSE '' END]))"""


def _skipped() -> str:
    return " OR ".join(f"regexp_matches(para, '{p}')" for p in tx._SKIPPED)


@query(f"""WITH e AS (SELECT doc_id, unnest({_PIECES}) AS raw, generate_subscripts({_PIECES}, 1) AS pos FROM documents),
p AS (SELECT doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS para FROM e WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> ''),
h AS (SELECT *, trim(split_part(para, chr(10), 1)) AS line FROM p),
l AS (SELECT *, length(regexp_extract(line, '^(#{{1,4}})\\s+(.+)$', 1)) AS level, regexp_extract(line, '^(#{{1,4}})\\s+(.+)$', 2) AS head, regexp_matches(para, '[\\x{{4e00}}-\\x{{9fff}}]') AS cjk FROM h),
k AS (SELECT *, CASE WHEN level > 0 THEN 'heading' WHEN len(list_filter(string_split(para, chr(10)), lambda x: contains(x, '|'))) > 1 THEN 'table'
  WHEN NOT cjk AND para = upper(para) AND regexp_matches(para, '[A-Z]{{2}}') AND NOT contains(para, '|') OR {_skipped()} THEN 'skip' WHEN cjk THEN 'zh' ELSE 'en' END AS kind FROM l),
n AS (SELECT *, CASE WHEN level > 0 THEN nullif(trim(regexp_extract(head, '^[^\\x{{4e00}}-\\x{{9fff}}]*', 0)), '') END AS en, CASE WHEN level > 0 THEN nullif(trim(regexp_extract(head, '[\\x{{4e00}}-\\x{{9fff}}].*$', 0)), '') END AS zh FROM k WHERE kind <> 'skip'),
u AS (SELECT *, last_value(CASE WHEN level BETWEEN 1 AND 2 THEN pos END IGNORE NULLS) OVER w AS up, last_value(CASE WHEN level > 0 THEN pos END IGNORE NULLS) OVER w AS at, lead(kind) OVER w AS next_kind, lead(para) OVER w AS next_para FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT u.*, s.level AS s_level, s.en AS s_en, s.zh AS s_zh, a.en AS a_en, a.zh AS a_zh FROM u LEFT JOIN n s ON s.doc_id = u.doc_id AND s.pos = u.at LEFT JOIN n a ON a.doc_id = u.doc_id AND a.pos = u.up)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INT AS ord, CASE WHEN s_level <= 2 THEN s_en WHEN s_level > 2 THEN CASE WHEN a_en IS NOT NULL AND s_en IS NOT NULL THEN a_en || ' > ' || s_en ELSE coalesce(s_en, a_en) END END AS title,
  CASE WHEN s_level <= 2 THEN s_zh WHEN s_level > 2 THEN CASE WHEN a_zh IS NOT NULL AND s_zh IS NOT NULL THEN a_zh || ' > ' || s_zh ELSE coalesce(s_zh, a_zh) END END AS title_zh,
  para AS content_en, CASE WHEN kind = 'en' AND next_kind = 'zh' THEN next_para END AS content_zh, kind = 'table' AS is_table FROM t WHERE kind = 'table' OR kind = 'en' AND length(para) >= 20""")
def bilingual_chunker(t: Tables):
    """Chunks of documents as markdown with headings, tables, dates and Chinese paragraphs between their own."""
    n = lambda i: i.cast("string")

    def pieces(x, k):
        i = k + 1
        head = F.when(i % 7 == 1, F.concat(F.lit("## Part "), n(i), F.lit(" 部分"))).when(i % 7 == 4, F.concat(F.lit("#### Sub "), n(i))).when(i % 7 == 6, F.concat(F.lit("### 小节 "), n(i))).otherwise("")
        zh = F.when(i % 3 == 0, F.concat(F.lit("中文第"), n(i), F.lit("段"))).otherwise("")
        table = F.when(i % 5 == 0, F.concat(F.lit("| a | "), n(i), F.lit(" |\n| b | c |"))).otherwise("")
        return F.array(head, x, F.when(i % 4 == 0, "February 25, 1985").otherwise(""), zh, table)

    text = F.array_join(F.flatten(F.transform(F.split("text", "\n+"), pieces)), "\n\n")
    return chunking.chunks(t.documents.select("doc_id", text.alias("text")), "doc_id")


#: Items that one task puts in order (about).
ITEMS_A_TASK = 1 << 20


@query("""SELECT o_orderkey, o_custkey, list(l_partkey::VARCHAR || ':' || l_quantity::BIGINT::VARCHAR ORDER BY l_quantity DESC, l_partkey)[1:3] AS top FROM (SELECT DISTINCT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey, o_custkey""")
def nested_children(t: Tables):
    """All orders with their three largest items as a nested list; the three are chosen before they are put together. A task sorts
    about a million items, however large the tables are."""
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.lineitem.count() // ITEMS_A_TASK))
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity").repartition(parts, "o_orderkey")
    # the same item again has the same rank
    largest = items.withColumn("k", F.dense_rank().over(Window.partitionBy("o_orderkey").orderBy(F.desc("l_quantity"), "l_partkey"))).filter("k <= 3")
    item = F.concat_ws(":", "l_partkey", F.col("l_quantity").cast("long"))
    lists = largest.groupBy("o_orderkey").agg(F.array_compact(F.array(*(F.max(F.when(F.col("k") == k, item)) for k in (1, 2, 3)))).alias("top"))
    orders = t.orders.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey").distinct()
    return orders.join(lists, "o_orderkey").select("o_orderkey", "o_custkey", "top")
