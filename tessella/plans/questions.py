"""Queries about questions: what they ask for, their keywords and plans, full text queries and what is done without hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import plans_of_models as pm
from tessella.operators import retrieval as r
from tessella.plans.base import Tables, query
from tessella.plans.retrieval import DOCS, QUESTIONS, docs

ASKED = "asked AS (SELECT conv_id, turn, [" + ", ".join(f"'{s}'" for _, s in QUESTIONS) + f"][(conv_id * 7 + turn) % {len(QUESTIONS)} + 1] || ' ' || text AS question FROM conversations)"
ROW = "json_object('task_type', CASE event_id % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'fact' ELSE event_type END"


def asked(t: Tables):
    """A question for each turn of a conversation: one of the given ones and the whole turn."""
    which = F.element_at(F.array(*(F.lit(s) for _, s in QUESTIONS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(QUESTIONS) + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", F.concat(which, F.lit(" "), "text").alias("question"))


@query(f"""WITH {ASKED} SELECT conv_id, turn, regexp_matches(question, '{tx.TEMPORAL}') AS temporal, regexp_matches(question, '{tx.MENTION}') AS mention, regexp_matches(question, '{tx.COMPARE}') AS compare, regexp_matches(question, '{tx.METHOD}') AS method,
  len(trim(question)) <= 12 AND regexp_matches(trim(question), '{tx.CHAT_START}') OR regexp_matches(trim(question), '{tx.CHAT}') AS chat FROM asked""")
def question_classes(t: Tables):
    return asked(t).select("conv_id", "turn", *(c.alias(n) for n, c in tx.question_classes(F.col("question")).items()))


@query(f"""WITH {ASKED}, c AS (SELECT conv_id, turn, regexp_matches(question, '{tx.COMPARE}') AS compare, regexp_matches(question, '{tx.TEMPORAL}') AS timeline, regexp_matches(question, '{tx.METHOD}') AS method FROM asked)
SELECT conv_id, turn, CASE WHEN compare THEN 'compare' WHEN timeline THEN 'timeline' WHEN method THEN 'opinion' ELSE 'fact' END AS intent, CASE WHEN compare THEN 'compare' WHEN timeline THEN 'timeline' ELSE 'concise' END AS answer_mode FROM c""")
def question_intent(t: Tables):
    of = tx.question_classes(F.col("question"))
    what, mode = tx.intent(F.when(of["method"], "method").otherwise("fact"), of["temporal"], of["compare"])
    return asked(t).select("conv_id", "turn", what.alias("intent"), mode.alias("answer_mode"))


@query(f"""WITH {ASKED}, y AS (SELECT *, regexp_extract_all(question, '(?:19|20)[0-9]{{2}}')::INT[] AS ys FROM asked) SELECT conv_id, turn, list_min(ys) AS year_from, list_max(ys) AS year_to,
CASE WHEN regexp_matches(question, '{tx.EARLIEST}') THEN 'earliest' WHEN regexp_matches(question, '{tx.LATEST}') THEN 'latest' WHEN regexp_matches(question, '{tx.EVOLUTION}') THEN 'evolution'
WHEN list_min(ys) <> list_max(ys) THEN 'range' WHEN len(ys) > 0 THEN 'point' ELSE 'none' END AS mode FROM y""")
def temporal_mode(t: Tables):
    rows = asked(t).select("conv_id", "turn", "question", tx.year_range(F.col("question")).alias("y")).select("conv_id", "turn", "question", "y.*")
    return rows.select("conv_id", "turn", "year_from", "year_to", tx.temporal_mode(F.col("question"), F.col("year_from"), F.col("year_to")).alias("mode"))


@query(f"""WITH {ASKED} SELECT conv_id, turn, regexp_matches(question, '{tx.TEMPORAL}') AS timeline, regexp_matches(question, '{tx.COMPARE}') AS compare, CASE WHEN regexp_matches(question, '{tx.METHOD}') THEN 'method' ELSE 'fact' END AS task FROM asked""")
def planner_rules(t: Tables):
    c = F.col("question")
    return asked(t).select("conv_id", "turn", c.rlike(tx.TEMPORAL).alias("timeline"), c.rlike(tx.COMPARE).alias("compare"), F.when(c.rlike(tx.METHOD), "method").otherwise("fact").alias("task"))


def _topics() -> str:
    return ", ".join("CASE WHEN " + " OR ".join(f"contains(q, '{w}')" for w in names) + " THEN [" + ", ".join(f"'{k}'" for k in kept) + "] ELSE [] END" for names, kept in tx.TOPICS)


@query(f"""WITH {ASKED}, l AS (SELECT conv_id, turn, lower(question) AS q FROM asked), k AS (SELECT conv_id, turn, flatten([{_topics()}]) AS topics,
  list_filter(list_transform(string_split_regex(q, '[\\s，。！？、,.!?]+'), lambda w: trim(w)), lambda w: len(w) >= 2 AND NOT regexp_matches(w, '^(19|20)[0-9]{{2}}$') AND w NOT IN ('变化', '怎么', '怎么看')) AS tokens FROM l)
SELECT conv_id, turn, array_to_string((CASE WHEN len(topics) > 0 THEN list_filter(topics, lambda x, i: list_position(topics, x) = i) ELSE list_filter(tokens, lambda x, i: list_position(tokens, x) = i) END)[1:8], '/') AS keywords FROM k""")
def question_keywords(t: Tables):
    return asked(t).select("conv_id", "turn", F.array_join(tx.question_keywords(F.col("question")), "/").alias("keywords"))


REPLY = """reply AS (SELECT event_id, CASE event_id % 5 WHEN 3 THEN 'no plan: ' || event_type WHEN 4 THEN '{"task_type": ' ELSE CASE event_id % 3 WHEN 0 THEN 'Here: ```json' || chr(10) ELSE '' END
  || '{"task_type": "' || CASE event_id % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'fact' ELSE event_type END || '", "needs_retrieval": ' || CASE event_id % 7 WHEN 0 THEN 'false' WHEN 1 THEN '"no"' ELSE 'true' END
  || ', "temporal_mode": "' || CASE event_id % 6 WHEN 0 THEN 'range' WHEN 1 THEN 'latest' ELSE 'often' END || '", "year_from": ' || CASE event_id % 8 WHEN 0 THEN '"1999"' ELSE (1880 + event_id % 240)::VARCHAR END || ', "year_to": ' || (1890 + event_id % 170)::VARCHAR
  || ', "entities": [" a ", "", "' || event_type || '"], "keyword_query": "' || CASE event_id % 9 WHEN 0 THEN ' ' ELSE 'over time ' || event_type END || '", "confidence": ' || CASE event_id % 10 WHEN 0 THEN '1.5' ELSE '0.5' END || '}' || CASE event_id % 3 WHEN 0 THEN chr(10) || '```' ELSE '' END END AS reply,
  CASE event_id % 2 WHEN 0 THEN 'why ' ELSE 'latest of 1990 ' END || event_type AS question FROM events)"""


def replies(t: Tables):
    """What a model might have answered: JSON, fenced or not, with wrong values, cut short, or none."""
    e, kind = F.col("event_id"), F.col("event_type")
    pick = lambda m, by, rest: F.concat(F.coalesce(*(F.when(e % m == k, v) for k, v in by.items()), rest))
    body = F.concat(
        F.lit('{"task_type": "'), pick(4, {0: F.lit("method"), 1: F.lit("fact")}, kind), F.lit('", "needs_retrieval": '), pick(7, {0: F.lit("false"), 1: F.lit('"no"')}, F.lit("true")),
        F.lit(', "temporal_mode": "'), pick(6, {0: F.lit("range"), 1: F.lit("latest")}, F.lit("often")), F.lit('", "year_from": '), pick(8, {0: F.lit('"1999"')}, (1880 + e % 240).cast("string")), F.lit(', "year_to": '), (1890 + e % 170).cast("string"),
        F.lit(', "entities": [" a ", "", "'), kind, F.lit('"], "keyword_query": "'), pick(9, {0: F.lit(" ")}, F.concat(F.lit("over time "), kind)), F.lit('", "confidence": '), pick(10, {0: F.lit("1.5")}, F.lit("0.5")), F.lit("}"),
    )
    fenced = F.when(e % 3 == 0, F.concat(F.lit("Here: ```json\n"), body, F.lit("\n```"))).otherwise(body)
    reply = F.when(e % 5 == 3, F.concat(F.lit("no plan: "), kind)).when(e % 5 == 4, F.lit('{"task_type": ')).otherwise(fenced)
    return t.events.select("event_id", reply.alias("reply"), F.concat(F.when(e % 2 == 0, "why ").otherwise("latest of 1990 "), kind).alias("question"))


@query(f"""WITH {REPLY}, j AS (SELECT event_id, question, CASE WHEN json_valid(reply) THEN reply::JSON WHEN json_valid(regexp_extract(reply, '(?s)\\{{.*\\}}')) THEN regexp_extract(reply, '(?s)\\{{.*\\}}')::JSON END AS j, regexp_extract_all(question, '(?:19|20)[0-9]{{2}}')::INT[] AS ys FROM reply),
f AS (SELECT *, CASE WHEN regexp_matches(question, '{tx.METHOD}') THEN 'method' ELSE 'fact' END AS task, CASE WHEN regexp_matches(question, '{tx.EARLIEST}') THEN 'earliest' WHEN regexp_matches(question, '{tx.LATEST}') THEN 'latest' WHEN len(ys) > 0 THEN 'point' ELSE 'none' END AS mode,
  CASE WHEN json_type(j, '$.year_from') IN ('UBIGINT', 'BIGINT') THEN (j->>'$.year_from')::INT ELSE list_min(ys) END AS yf, CASE WHEN json_type(j, '$.year_to') IN ('UBIGINT', 'BIGINT') THEN (j->>'$.year_to')::INT ELSE list_max(ys) END AS yt FROM j),
y AS (SELECT *, CASE WHEN yf BETWEEN 1900 AND 2100 THEN yf END AS a, CASE WHEN yt BETWEEN 1900 AND 2100 THEN yt END AS b FROM f),
p AS (SELECT event_id, CASE WHEN j->>'$.task_type' IN ('fact', 'method') THEN j->>'$.task_type' ELSE task END AS task, CASE WHEN json_type(j, '$.needs_retrieval') = 'BOOLEAN' THEN (j->>'$.needs_retrieval')::BOOLEAN ELSE true END AS needs_retrieval,
  CASE WHEN j->>'$.temporal_mode' IN ('none', 'point', 'range', 'earliest', 'latest', 'evolution') THEN j->>'$.temporal_mode' ELSE mode END AS temporal_mode,
  CASE WHEN a > b THEN b ELSE a END AS year_from, CASE WHEN a > b THEN a ELSE b END AS year_to,
  CASE WHEN j IS NULL THEN '' ELSE array_to_string(list_filter(list_transform((j->'$.entities')::VARCHAR[], lambda x: trim(x)), lambda x: len(x) > 0)[1:8], '/') END AS entities,
  coalesce(nullif(trim(j->>'$.keyword_query'), ''), question) AS keywords, CASE WHEN (j->>'$.confidence')::DOUBLE BETWEEN 0 AND 1 THEN (j->>'$.confidence')::DOUBLE ELSE 0.55 END AS confidence FROM y)
SELECT *, temporal_mode <> 'none' OR regexp_matches(keywords, '{tx.TEMPORAL}') AS timeline, regexp_matches(keywords, '{tx.COMPARE}') AS compare FROM p""")
def lenient_plan(t: Tables):
    plan = pm.lenient_plan(replies(t), "reply", "question")
    return plan.select("event_id", "task", "needs_retrieval", "temporal_mode", "year_from", "year_to", F.array_join("entities", "/").alias("entities"), "keywords", "confidence", "timeline", "compare")


WEB = [(1, "that with"), (2, '"of the" -with'), (3, "avec or und"), (4, "the OR les that"), (5, '-"of the" nichtda'), (6, "or"), (7, '"in the" or "dans les" -"to the"')]


def _sql_holds(term: str) -> str:
    return "regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])" + "[^A-Za-z0-9_]+".join(term.split()) + "($|[^A-Za-z0-9_])')"


def _web_sql(text: str) -> str:
    q = r.web_query(text)
    parts = ["(" + " OR ".join(map(_sql_holds, clause)) + ")" for clause in q.clauses] + [f"NOT {_sql_holds(x)}" for x in q.without]
    return " AND ".join(parts) if q.clauses else "false"


@query("SELECT n, count(*) AS hits, min(doc_id) AS first_id, sum(doc_id)::BIGINT AS ids FROM (" + " UNION ALL ".join(f"SELECT {n} AS n, doc_id FROM documents WHERE {_web_sql(text)}" for n, text in WEB) + ") GROUP BY n")
def web_search(t: Tables):
    """How many documents match each of some full text queries with alternatives, phrases and exclusions: one scan for all."""
    flags = F.filter(F.array(*(F.when(r.web_match(F.col("text"), r.web_query(text)), F.lit(n)) for n, text in WEB)), lambda x: x.isNotNull())
    found = t.documents.select("doc_id", F.explode(flags).alias("n"))
    return found.groupBy("n").agg(F.count("*").alias("hits"), F.min("doc_id").alias("first_id"), F.sum("doc_id").alias("ids"))


def _score(tokens: list[str]) -> str:
    return "round((" + " + ".join(f"len(regexp_extract_all(lower(text), '{w}'))" for w in tokens) + ") / sqrt(len(text)::DOUBLE), 6)"


@query(f"""WITH {DOCS}, a AS (SELECT id, year, 0.1::DOUBLE AS score, text FROM docs WHERE contains(text, 'of the') QUALIFY row_number() OVER (PARTITION BY year ORDER BY id) = 1 ORDER BY year LIMIT 26)
SELECT 'plain' AS way, id, year, score FROM a WHERE {_sql_holds('that')}
UNION ALL FROM (SELECT 'asked', id, year, {_score(['avec', 'zzzq'])} AS score FROM docs WHERE {_sql_holds('avec')} OR {_sql_holds('zzzq')} QUALIFY row_number() OVER (PARTITION BY year ORDER BY score DESC, id) = 1 ORDER BY year LIMIT 26)""")
def timeline_driver(t: Tables):
    """The three ways of a timeline's keyword search: its first alternative as it stands, the full text query where that gives
    nothing, and nothing for several strict tokens."""
    d = docs(t)
    ways = [("plain", "of the | with", ["that"]), ("asked", "zzzq or avec", []), ("none", "zzzq or avec", ["avec", "und"])]
    out = [r.timeline_hits(d, "text", words, strict, 26).select(F.lit(way).alias("way"), "id", "year", "score") for way, words, strict in ways]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH {DOCS} SELECT 'raw' AS asked, id, score, 'keyword' AS retrieval, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM (SELECT id, {_score(['for', 'was'])} AS score FROM docs WHERE {_sql_holds('was')} AND {_sql_holds('for')}) QUALIFY rank <= 10""")
def search_without_hits(t: Tables):
    """A question whose words are too short to be keywords: the raw question is asked instead, and one that nothing answers gives nothing."""
    rows = docs(t)
    raw = r.search(rows, "was for", text="text").withColumn("asked", F.lit("raw"))
    none = r.search(rows, "zzzq for was", text="text").withColumn("asked", F.lit("none"))
    return raw.unionByName(none).select("asked", "id", "score", "retrieval", "rank")


def _anchor_sql(keywords: str, question: str) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches({question}, '{p}') AND NOT contains(lower({keywords}), '{a.lower()}') THEN '{a}' END" for p, a in tx.ANCHORS)
    return f"array_to_string(list_filter([{found}, trim({keywords})], lambda x: x IS NOT NULL), ' | ')"


ANCHORED = f"""{ASKED}, n AS (SELECT conv_id, turn, question, regexp_replace(regexp_replace(question, '{tx.GLOSSARY[0][0]}', '{tx.GLOSSARY[0][1]}', 'g'), '{tx.GLOSSARY[1][0]}', '{tx.GLOSSARY[1][1]}', 'g') AS named FROM asked),
k AS (SELECT *, {_anchor_sql("named", "question")} AS keywords FROM n)"""


@query(f"WITH {ANCHORED} SELECT conv_id, turn, keywords FROM k")
def question_anchors(t: Tables):
    """Questions with glossary names, behind the anchors of their words."""
    return asked(t).select("conv_id", "turn", tx.anchored(tx.glossary(F.col("question")), F.col("question")).alias("keywords"))


def _tokens_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    return f"list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9.&''-]*'), lambda w: regexp_replace(w, '[^A-Za-z0-9]+$', '')), lambda w: len(w) >= 2 AND lower(w) NOT IN ({stop}))"


@query(f"""WITH {ANCHORED}, l AS (SELECT conv_id, turn, list_concat({_tokens_sql("trim(split_part(keywords, '|', 1))")}, list_filter({_tokens_sql("question")}, lambda w: upper(w) = w OR len(w) >= 4)) AS x FROM k)
SELECT conv_id, turn, array_to_string(list_filter(x, lambda w, i: list_position(x, w) = i)[1:8], ' ') AS tokens FROM l""")
def question_strict_tokens(t: Tables):
    """The tokens that a hit of each question has to have."""
    keywords = tx.anchored(tx.glossary(F.col("question")), F.col("question"))
    return asked(t).select("conv_id", "turn", F.array_join(tx.strict_tokens(keywords, F.col("question")), " ").alias("tokens"))


@query(f"""WITH {DOCS}, a AS (SELECT id, year FROM docs WHERE contains(text, 'of the') QUALIFY row_number() OVER (PARTITION BY year ORDER BY id) = 1 ORDER BY year LIMIT 26),
r AS (SELECT id, year, row_number() OVER (ORDER BY year, id) AS k FROM a),
f AS (SELECT id, year, round(0.6::DOUBLE / (50 + k), 9) AS score, row_number() OVER (ORDER BY k) AS pos FROM r QUALIFY pos <= 18)
SELECT way, id, year, score, retrieval, rank FROM (SELECT 'asc' AS way, id, year, score, 'keyword' AS retrieval, (row_number() OVER (ORDER BY year, score DESC, pos))::INT AS rank FROM f
UNION ALL SELECT 'desc', id, year, score, 'keyword', (row_number() OVER (ORDER BY year DESC, score DESC, pos))::INT FROM f)""")
def search_orders(t: Tables):
    """A timeline of the earliest hits of each year, in its own order and the other way round."""
    p = r.Plan("fact", timeline=True, keywords="of the | with")
    rows = docs(t)
    found = [r.search(rows, "over time", asked=p, text="text", order=o).withColumn("way", F.lit(w)) for w, o in (("asc", None), ("desc", "desc"))]
    return found[0].unionByName(found[1]).select("way", "id", "year", "score", "retrieval", "rank")


@query(f"""WITH {DOCS}, k AS (SELECT id, year, text, round((len(regexp_extract_all(lower(text), 'avec')) + len(regexp_extract_all(lower(text), 'dans'))) / sqrt(len(text)::DOUBLE), 6) AS s FROM docs WHERE {_sql_holds('dans')} OR {_sql_holds('avec')})
SELECT id, year, substr(text, 1, 600) AS excerpt, 'keyword' AS retrieval, (row_number() OVER (ORDER BY s DESC, id))::INT AS rank FROM k QUALIFY rank <= 5""")
def search_tool(t: Tables):
    """Five hits for either of two alternatives, as tools are given them."""
    p = r.Plan("fact", keywords="dans | avec")
    return r.search_tool(docs(t), "avec", limit=5, text="text", asked=p)


@query("""WITH s AS (SELECT source, max(1965 + doc_id % 61) AS year FROM documents GROUP BY source), one AS (SELECT source FROM s ORDER BY year DESC, source LIMIT 1), c AS (SELECT doc_id, source, lang FROM documents WHERE source IN (SELECT source FROM one))
SELECT doc_id AS ord, source, lang, (SELECT ceil(count(*) / 10)::BIGINT FROM c) AS total_pages FROM c ORDER BY doc_id LIMIT 10""")
def document_tool(t: Tables):
    """The first page of the source with the latest document."""
    sources = t.documents.groupBy("source").agg(F.max(1965 + F.col("doc_id") % 61).alias("year"))
    return r.document_tool(t.documents.select(F.col("doc_id").alias("ord"), "source", "lang"), sources)
