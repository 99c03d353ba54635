"""Queries of the retrieval domain over documents, their paragraphs and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.vectors import cosine
from tessella.operators import retrieval as r
from tessella.operators.relational import top_k
from tessella.plans.base import Tables, query
from tessella.sources.adapters import CHUNK, chunk

#: The vector that queries ask for.
QUERY_ID = 7

DOCS = "docs AS (SELECT doc_id AS id, 1965 + doc_id % 61 AS year, source, lang, text FROM documents)"
VECS = f"""
vec AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_ID})), 6) AS score FROM embeddings),
knn AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM vec QUALIFY rank <= 10)"""
KEY = """
kw AS (SELECT id, year, round((len(regexp_extract_all(lower(text), 'that')) + len(regexp_extract_all(lower(text), 'with'))) / sqrt(len(text)::DOUBLE), 6) AS score FROM docs
  WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])that($|[^A-Za-z0-9_])') AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])with($|[^A-Za-z0-9_])')),
kwr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM kw QUALIFY rank <= 20)"""


def fused(w: tuple[float, float], limit: int, kw: str = "kwr") -> str:
    return f"""
fused AS (SELECT *, row_number() OVER (ORDER BY score DESC, k NULLS LAST, s NULLS LAST, id)::INT AS rank FROM (
  SELECT coalesce(a.id, b.id) AS id, a.rank AS k, b.rank AS s, round(coalesce({w[0]}::DOUBLE / (50 + a.rank), 0) + coalesce({w[1]}::DOUBLE / (50 + b.rank), 0), 9) AS score,
         CASE WHEN a.id IS NULL THEN 'semantic' WHEN b.id IS NULL THEN 'keyword' ELSE 'both' END AS retrieval FROM {kw} a FULL JOIN knn b ON a.id = b.id) QUALIFY rank <= {limit})"""


def docs(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), (1965 + F.col("doc_id") % 61).alias("year"), "source", "lang", "text")


def _knn(t: Tables, k: int = 10):
    """The query's vector is one row: it is broadcast to the scan of the others."""
    q = F.broadcast(t.embeddings.filter(F.col("vec_id") == QUERY_ID).select(F.col("embedding").alias("q")).limit(1))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding").crossJoin(q)
    return r.knn(rows, F.col("q"), k).drop("q")


def _keywords(t: Tables, limit: int = 20):
    hits = r.keyword_hits(docs(t), "text", ["that", "with"]).select("id", "year", "score")
    return r.ranked(hits, limit, F.desc("score"), F.col("id"))


@query("WITH" + VECS + " SELECT id, score, rank FROM knn")
def knn_cosine(t: Tables):
    return _knn(t).select("id", "score", "rank")


@query("WITH" + VECS + " SELECT id, score, rank FROM knn WHERE rank <= 4 OR score >= greatest(0.2, (SELECT max(score) FROM knn) - 0.12)")
def semantic_floor(t: Tables):
    return r.score_floor(_knn(t)).select("id", "score", "rank")


@query("SELECT doc_id, contains(lower(text), 'tionat') AS a, contains(lower(text), 'lyor') AS b FROM documents WHERE contains(lower(text), 'tionat') OR contains(lower(text), 'lyor')")
def keyword_contains(t: Tables):
    low = F.lower("text")
    return t.documents.filter(low.contains("tionat") | low.contains("lyor")).select("doc_id", low.contains("tionat").alias("a"), low.contains("lyor").alias("b"))


@query(f"WITH {DOCS}, {KEY} SELECT id, year, score FROM kw")
def keyword_token_and(t: Tables):
    return r.keyword_hits(docs(t), "text", ["that", "with"]).select("id", "year", "score")


@query("WITH" + CHUNK + " SELECT chunk_id, year, content FROM (SELECT * FROM chunk WHERE content LIKE '%tion%' AND year >= 1970 QUALIFY row_number() OVER (PARTITION BY year ORDER BY chunk_id) = 1) ORDER BY year LIMIT 20")
def like_first_per_year(t: Tables):
    hits = r.in_years(chunk(t).filter(F.col("content").like("%tion%")), 1970, None)
    return r.first_per_year(hits, 20, F.col("chunk_id")).select("chunk_id", "year", "content")


@query("WITH" + CHUNK + " SELECT chunk_id FROM (SELECT * FROM chunk WHERE contains(content, 'tion') ORDER BY chunk_id LIMIT 50) WHERE regexp_matches(content, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])')")
def keyword_then_filter(t: Tables):
    """The limit comes before the strict filter, so fewer hits than the limit may stay."""
    hits = chunk(t).filter(F.col("content").contains("tion")).orderBy("chunk_id").limit(50)
    return hits.filter(tx.has_token(F.col("content"), "the")).select("chunk_id")


@query(f"WITH {DOCS}, {KEY}, {VECS}, {fused((0.7, 0.3), 7)} SELECT id, score, retrieval, rank FROM fused")
def rrf_fusion(t: Tables):
    return r.fuse(_keywords(t), _knn(t), r.WEIGHTS["fact"], 7)


@query(f"""WITH {DOCS}, {KEY}, kwy AS (SELECT *, row_number() OVER (ORDER BY year, id)::INT AS rank FROM (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY year ORDER BY score DESC, id) = 1) QUALIFY rank <= 26), {VECS}, {fused((0.6, 0.4), 18, 'kwy')}
SELECT id, 1965 + id % 61 AS year, score FROM fused QUALIFY row_number() OVER (PARTITION BY 1965 + id % 61 ORDER BY rank) = 1""")
def rrf_timeline(t: Tables):
    """Keyword hits by year, fused, the first of each year."""
    hits = r.keyword_hits(docs(t), "text", ["that", "with"]).select("id", "year", "score")
    own = top_k(hits, ["year"], [F.desc("score"), F.col("id")])
    both = r.fuse(r.ranked(own, 26, F.col("year"), F.col("id")), _knn(t), r.WEIGHTS["timeline"], 18)
    return top_k(both.withColumn("year", 1965 + F.col("id") % 61), ["year"], [F.col("rank")]).select("id", "year", "score")


@query(f"""WITH {DOCS}, h AS (SELECT id, text, 1.0::DOUBLE AS score FROM docs WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])that($|[^A-Za-z0-9_])') ORDER BY id LIMIT 5),
x AS (SELECT id, text, round(len(text)::DOUBLE / 1000, 3) AS score FROM docs WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])avec($|[^A-Za-z0-9_])') AND NOT EXISTS (SELECT 1 FROM h WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])avec($|[^A-Za-z0-9_])')) ORDER BY score DESC, id LIMIT 8)
SELECT id, max(score) AS score FROM (FROM h UNION ALL FROM x) GROUP BY id""")
def compare_coverage(t: Tables):
    d = docs(t)
    hits = d.filter(tx.has_token(F.col("text"), "that")).orderBy("id").limit(5).select("id", "text", F.lit(1.0).alias("score"))
    extra = d.select("id", "text", F.round(F.length("text").cast("double") / 1000, 3).alias("score"))
    return r.cover_missing(hits, extra, "text", ("that", "avec")).select("id", "score")


@query("WITH" + CHUNK + r""", s AS (SELECT chunk_id, trim(s) AS s, i FROM (SELECT chunk_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT chunk_id, string_split_regex(regexp_replace(trim(content), '([.!?])\s+', '\1' || chr(1), 'g'), '[' || chr(1) || '\n]+') AS p FROM chunk)) WHERE len(trim(s)) > 20),
w AS (SELECT *, list_filter(string_split_regex(regexp_replace(lower(s), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: len(x) >= 3) AS ws FROM s),
b AS (SELECT chunk_id, s FROM w QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda x: x IN ('that', 'with'))) / sqrt(len(ws)::DOUBLE), 9) ELSE -1 END DESC, i) = 1)
SELECT c.chunk_id, CASE WHEN b.s IS NULL THEN trim(substr(trim(c.content), 1, 180)) || CASE WHEN len(trim(c.content)) > 180 THEN '…' ELSE '' END WHEN len(b.s) > 220 THEN trim(substr(b.s, 1, 220)) || '…' ELSE b.s END AS excerpt FROM chunk c LEFT JOIN b USING (chunk_id)""")
def evidence_excerpt(t: Tables):
    return chunk(t).select("chunk_id", tx.excerpt("that with", F.col("content")).alias("excerpt"))


@query("WITH" + CHUNK + " SELECT source, count(*) AS hits, count(DISTINCT year) AS years, min(year) AS first_year, max(year) AS last_year, list_sort(list(DISTINCT year)) AS covered, count(*) >= 3 AS sufficient FROM chunk WHERE contains(content, 'tion') GROUP BY source")
def evidence_plan(t: Tables):
    hits = chunk(t).filter(F.col("content").contains("tion"))
    years = F.array_sort(F.collect_set("year"))
    return hits.groupBy("source").agg(F.count("*").alias("hits"), F.size(years).cast("long").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), years.alias("covered"), (F.count("*") >= 3).alias("sufficient"))


@query("SELECT page_id, list_min(list_transform(y, lambda x: x::INT)) AS year_from, list_max(list_transform(y, lambda x: x::INT)) AS year_to FROM (SELECT page_id, regexp_extract_all(html, '(?:19|20)[0-9]{2}') AS y FROM pages)")
def year_extraction(t: Tables):
    return t.pages.select("page_id", tx.year_range(F.col("html")).alias("y")).select("page_id", "y.*")


QUESTIONS = [(1, "When did Apple first appear in 2016?"), (2, "护城河的变化"), (3, "Compare GEICO vs Progressive, 1999 to 2021"), (4, "why moat"), (5, "latest view on float"), (6, "Letters of 1988"), (7, ""), (8, "12019 and 2003"), (9, "你好")]


@query("WITH" + CHUNK + " SELECT chunk_id, ord, content, (SELECT ceil(count(*) / 10)::BIGINT FROM chunk WHERE source = 'src3') AS total_pages FROM (SELECT * FROM chunk WHERE source = 'src3' ORDER BY chunk_id LIMIT 10 OFFSET 10)")
def document_page(t: Tables):
    return r.page(chunk(t).filter("source = 'src3'").select("chunk_id", "ord", "content"), 2, 10, F.col("chunk_id"))


@query(f"""WITH {DOCS}, {KEY}, {VECS} SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS "both", count(*) FILTER (b.id IS NULL) AS only_a, count(*) FILTER (a.id IS NULL) AS only_b FROM (SELECT id FROM kwr) a FULL JOIN (SELECT id FROM knn) b ON a.id = b.id""")
def retrieval_overlap(t: Tables):
    return r.overlap(_keywords(t), _knn(t), "id")


@query(f"""WITH {DOCS} SELECT id, year, source, row_number() OVER (ORDER BY year DESC, id)::INT AS rank FROM docs WHERE year BETWEEN 1990 AND 2000 AND source IN ('src1', 'src2', 'src3') QUALIFY rank <= 25""")
def range_filtered_rank(t: Tables):
    rows = r.in_years(docs(t), 1990, 2000).filter(F.col("source").isin("src1", "src2", "src3")).select("id", "year", "source")
    return r.ranked(rows, 25, F.desc("year"), F.col("id"))


@query("""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9.&''-]*')) AS x FROM documents)
SELECT doc_id, list_aggregate(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9.&''-]*'), lambda w: regexp_replace(w, '[^A-Za-z0-9]+$', '')), lambda w: len(w) >= 2 AND lower(w) NOT IN ('the','and','for','with','what','when','which','who','whom','where','why','how','did','does','have','has','about','into','from','that','this','your','you','will','were','been','over','time','first','earliest','latest','mention','mentioned'))), 'count') AS tokens FROM documents""")
def derived_tokens(t: Tables):
    """How many distinct tokens each document is indexed by."""
    return t.documents.select("doc_id", F.size(tx.ascii_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("WITH" + CHUNK + " SELECT chunk_id, CASE WHEN len(l) > 140 THEN trim(substr(l, 1, 140)) || '…' ELSE l END AS line FROM (SELECT chunk_id, trim(content) AS l FROM chunk)")
def excerpt_first_line(t: Tables):
    return chunk(t).select("chunk_id", tx.first_line(F.col("content")).alias("line"))


@query("WITH" + CHUNK + r""" SELECT chunk_id, regexp_matches(content, '[\x{4e00}-\x{9fff}]') AS cjk, len(content) > 80 AND NOT starts_with(content, '|') AS good, trim(content) = upper(trim(content)) AND regexp_matches(content, '[A-Z]{2}') AND NOT contains(content, '|') AND NOT regexp_matches(content, '[\x{4e00}-\x{9fff}]') OR regexp_matches(trim(content), '^Chairman\b') AS skipped FROM chunk""")
def paragraph_classify(t: Tables):
    c = F.col("content")
    return chunk(t).select("chunk_id", tx.is_cjk(c).alias("cjk"), ((F.length(c) > 80) & ~c.startswith("|")).alias("good"), tx.is_skippable(c).alias("skipped"))


@query("""WITH e AS (SELECT CASE quality WHEN 1 THEN 'fact' ELSE 'method' END AS type, n_chars % 12 AS hits, n_chars::DOUBLE AS ms FROM labels JOIN documents USING (doc_id))
SELECT type, count(*) AS total, round(avg(hits), 4) AS avg_hits, round(avg(ms), 2) AS avg_ms, count(*) FILTER (hits = 0) AS zero_hits, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 4) AS success FROM e GROUP BY type""")
def eval_summary(t: Tables):
    return _evals(t).groupBy("type").agg(F.count("*").alias("total"), F.round(F.avg("hits"), 4).alias("avg_hits"), F.round(F.avg("ms"), 2).alias("avg_ms"), F.count_if(F.col("hits") == 0).alias("zero_hits"), F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 4).alias("success"))


def _evals(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "fact").otherwise("method").alias("type"), (F.col("n_chars") % 12).alias("hits"), F.col("n_chars").cast("double").alias("ms"))


@query("""WITH e AS (SELECT doc_id % 2 AS run, CASE quality WHEN 1 THEN 'fact' ELSE 'method' END AS type, n_chars % 12 AS hits FROM labels JOIN documents USING (doc_id)),
s AS (SELECT type, avg(hits) FILTER (run = 0) AS base, avg(hits) FILTER (run = 1) AS cand FROM e GROUP BY type)
SELECT type, round(cand - base, 4) AS delta, round(CASE WHEN base = 0 THEN CASE WHEN cand = 0 THEN 0 ELSE 999 END ELSE (cand - base) / base * 100 END, 2) AS pct, type <> 'fact' OR cand >= base AS pass FROM s""")
def eval_compare(t: Tables):
    """Hits of two runs by type, their difference, and whether the second may replace the first."""
    mean = lambda k: F.avg(F.when(F.col("doc_id") % 2 == k, F.col("hits")))
    s = _evals(t).groupBy("type").agg(mean(0).alias("base"), mean(1).alias("cand"))
    d = F.col("cand") - F.col("base")
    pct = F.when(F.col("base") == 0, F.when(F.col("cand") == 0, 0.0).otherwise(999.0)).otherwise(d / F.col("base") * 100)
    return s.select("type", F.round(d, 4).alias("delta"), F.round(pct, 2).alias("pct"), ((F.col("type") != "fact") | (F.col("cand") >= F.col("base"))).alias("pass"))


@query(f"""WITH {DOCS}, w AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM docs)),
h AS (SELECT id, p, max(CASE WHEN w = 'that' THEN p END) OVER o AS a, max(CASE WHEN w = 'with' THEN p END) OVER o AS b, max(CASE WHEN w = 'this' THEN p END) OVER o AS c FROM w WHERE w IN ('that', 'with', 'this') WINDOW o AS (PARTITION BY id ORDER BY p)),
x AS (SELECT id, least(a, b, c) AS s, min(p) AS p FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY ALL)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM (SELECT id, round(sum(3.0::DOUBLE / (p - s + 1)), 6) AS score FROM x GROUP BY id) QUALIFY rank <= 20""")
def cover_density_rank(t: Tables):
    """The best documents by how densely they hold the terms (shorter stretches that hold all count more)."""
    from tessella.operators.ranking import cover_density

    return r.ranked(cover_density(docs(t), "text", ["that", "with", "this"]).select("id", "score").filter("score > 0"), 20, F.desc("score"), F.col("id"))


@query("""SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.label""")
def label_similarity(t: Tables):
    """Each vector's cosine with the one whose id is its label."""
    head = t.embeddings.filter(F.col("vec_id") == F.col("label")).select("label", F.col("embedding").alias("head"))
    return t.embeddings.join(head, "label").select(F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("head")), 6).alias("score"))
