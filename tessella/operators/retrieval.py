"""Hybrid retrieval: keyword and vector hits, rank fusion, and what follows.

Hits are DataFrames (id, year, score, ...) with a rank column. Steps stay one lazy plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.vectors import cosine
from tessella.operators import plans_of_models
from tessella.operators.graph import one_hop
from tessella.operators.relational import top_k

RRF_K = 50
#: keyword and semantic weights by kind of question
WEIGHTS = {"compare": (0.5, 0.5), "timeline": (0.6, 0.4), "method": (0.45, 0.55), "fact": (0.7, 0.3)}


@dataclass(frozen=True)
class Plan:
    """What a question asks for."""

    task: str = "fact"
    timeline: bool = False
    compare: bool = False
    temporal_mode: str = "none"
    year_from: int | None = None
    year_to: int | None = None
    keywords: str = ""
    entities: tuple[str, ...] = field(default_factory=tuple)
    confidence: float = 0.55
    needs_retrieval: bool = True

    @property
    def order(self) -> str:
        return "asc" if self.timeline else "relevance"

    @property
    def kind(self) -> str:
        return "compare" if self.compare else "timeline" if self.timeline else self.task

    @property
    def budgets(self) -> tuple[int, int, int]:
        """Keyword hits, semantic hits, and fused ones."""
        keyword = (20 if self.task == "fact" else 16) + (6 if self.timeline else 0)
        semantic = 10 + ((6 if self.task == "fact" else 4) if self.timeline else 0)
        return keyword, semantic, 18 if self.timeline else 7


def named(question: str) -> str:
    """A question with the names that the glossary's words stand for."""
    for pattern, name in tx.GLOSSARY:
        question = re.sub(pattern, name, question)
    return question


def plan(question: str) -> Plan:
    """The rules' plan of a question; a plan from elsewhere can be passed in its stead."""
    text = named(question)
    years = sorted(int(y) for y in re.findall(r"(?:19|20)\d{2}", text))
    has = lambda p: re.search(p, text) is not None
    low, high = (years[0], years[-1]) if years else (None, None)
    mode = "earliest" if has(tx.EARLIEST) else "latest" if has(tx.LATEST) else "evolution" if has(tx.EVOLUTION) else "none" if not years else "range" if low != high else "point"
    return Plan("method" if has(tx.METHOD) else "fact", has(tx.TEMPORAL), has(tx.COMPARE), mode, low, high, text)


def is_plain(question: str) -> bool:
    """Whether the rules are enough: small talk, and questions of fifteen characters at most."""
    short = question.strip()
    return len(short) <= 15 or bool(re.search(tx.CHAT, short)) or len(short) <= 12 and bool(re.search(tx.CHAT_START, short))


def understood(spark: SparkSession, question: str, model: Callable[[str], str] | None = None) -> Plan:
    """The plan of a question: the rules' where they are enough or there is no model, else what the model (a function from the
    question to a reply) says, as far as its reply can be used."""
    if model is None or is_plain(question):
        return replace(plan(question), confidence=0.9)
    asked = named(question)
    rows = spark.createDataFrame([(model(asked), asked)], "reply string, question string")
    r = plans_of_models.lenient_plan(rows, "reply", "question").first()
    return Plan(r.task, r.timeline, r.compare, r.temporal_mode, r.year_from, r.year_to, r.keywords, tuple(r.entities), r.confidence, r.needs_retrieval)


def anchored(keywords: str, question: str) -> str:
    """Keywords behind the anchors that the question's words stand for and the keywords lack, as alternatives."""
    base = keywords.strip()
    found = [a for p, a in tx.ANCHORS if re.search(p, question) and a.lower() not in base.lower()] if base else []
    return " | ".join([*found, base])


def ascii_tokens(text: str) -> list[str]:
    """Distinct Latin tokens of two characters at least, in order, without stop words."""
    found = (re.sub(r"[^A-Za-z0-9]+$", "", t) for t in re.findall(r"[A-Za-z][A-Za-z0-9.&'-]*", text))
    return list(dict.fromkeys(t for t in found if len(t) >= 2 and t.lower() not in tx.STOP_WORDS))


def strict_tokens(keywords: str, question: str, entities: tuple[str, ...] = (), most: int = 8) -> list[str]:
    """Tokens that a hit has to have: those of the entities, of the keywords' first alternative, and the question's that are long
    or in capitals."""
    own = [t for t in ascii_tokens(question) if t.upper() == t or len(t) >= 4]
    of_entities = [t for e in entities for t in ascii_tokens(e)]
    return list(dict.fromkeys([*of_entities, *ascii_tokens(keywords.split("|")[0].strip()), *own]))[:most]


def allowed(override: str | None, known: tuple[str, ...], default: tuple[str, ...]) -> list[str]:
    """The kinds that may be searched: those of a comma-separated override that are known, regardless of case and blanks, each once;
    the default where it names none."""
    by_name = {k.lower(): k for k in known}
    named = [by_name[x] for x in (part.strip().lower() for part in (override or "").split(",")) if x in by_name]
    return list(dict.fromkeys(named)) or list(default)


def in_years(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows of the years from low to high, both inside; None is open. Nothing is added to the plan for an open end."""
    if low is not None:
        df = df.filter(F.col("year") >= low)
    return df if high is None else df.filter(F.col("year") <= high)


def ranked(hits: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first hits in order, with rank from 1. The limit comes first, so the one task that ranks holds so many rows."""
    return hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def keyword_hits(rows: DataFrame, text: str, tokens: list[str]) -> DataFrame:
    """Rows that hold all tokens, scored by how often they do for their length."""
    c = F.col(text)
    n = sum((F.regexp_count(F.lower(c), F.lit(re.escape(t.lower()))) for t in tokens), F.lit(0))
    return rows.filter(tx.has_all(c, tokens)).withColumn("score", F.round(n / F.sqrt(F.length(c).cast("double")), 6))


@dataclass(frozen=True)
class WebQuery:
    """A full text query: every clause has to match, and one of its alternatives does; no phrase of `without` may."""

    clauses: tuple[tuple[str, ...], ...]
    without: tuple[str, ...] = ()


def web_query(query: str) -> WebQuery:
    """Words and "phrases in quotes"; `or` between two of them makes alternatives, a minus before one excludes it. Other
    punctuation is ignored."""
    clauses, without, either = [], [], False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        term = " ".join(re.findall(r"\w+", phrase or word.lstrip("-"))).lower()
        minus = minus or ("-" if word.startswith("-") else "")
        if not phrase and term == "or" and not minus:
            either = bool(clauses)
        elif term and minus:
            without.append(term)
        elif term and either:
            clauses[-1].append(term)
            either = False
        elif term:
            clauses.append([term])
    return WebQuery(tuple(map(tuple, clauses)), tuple(without))


def _holds(c: Column, term: str) -> Column:
    return c.rlike(r"(?i)(?<![A-Za-z0-9_])" + r"[^A-Za-z0-9_]+".join(map(re.escape, term.split())) + r"(?![A-Za-z0-9_])")


def web_match(c: Column, query: WebQuery) -> Column:
    """Whether a text matches. A query without clauses matches nothing."""
    if not query.clauses:
        return F.lit(False)
    out = F.lit(True)
    for alternatives in query.clauses:
        out = out & reduce(lambda x, y: x | y, (_holds(c, t) for t in alternatives))
    for term in query.without:
        out = out & ~_holds(c, term)
    return out


def web_hits(rows: DataFrame, text: str, query: WebQuery) -> DataFrame:
    """Rows that match, scored by how often they hold the words of the clauses for their length."""
    c = F.col(text)
    tokens = sorted({w for clause in query.clauses for term in clause for w in term.split()})
    n = sum((F.regexp_count(F.lower(c), F.lit(re.escape(t))) for t in tokens), F.lit(0))
    return rows.filter(web_match(c, query)).withColumn("score", F.round(n / F.sqrt(F.length(c).cast("double")), 6))


def timeline_hits(rows: DataFrame, text: str, keywords: str, strict: list[str], limit: int, key: str = "id") -> DataFrame:
    """key, year, score: one hit of each year, the earliest years first. Texts that hold the keywords' first alternative as it
    stands and all strict tokens come first; without any of them, several strict tokens give nothing, else the full
    text query is asked. The strict tokens are looked for after the limit. One plan: the second source is read only where the
    first is empty."""
    c = F.col(text)
    term = keywords.split("|")[0].strip()
    plain = first_per_year(rows.filter(c.contains(term)).withColumn("score", F.lit(0.1)), limit, F.col(key)) if term else rows.filter("false").withColumn("score", F.lit(0.1))
    plain = plain.filter(tx.has_all(c, strict)).select(key, "year", "score")
    if len(strict) > 1:
        return plain
    asked = first_per_year(web_hits(rows, text, web_query(keywords)), limit, F.desc("score"), F.col(key))
    return otherwise(plain, asked.filter(tx.has_all(c, strict)).select(key, "year", "score"))


def otherwise(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of the first, or of the second if the first has none."""
    found = first.limit(1).agg(F.count("*").alias("_found"))
    return first.unionByName(second.join(F.broadcast(found), F.col("_found") == 0).drop("_found"))  # one row


def first_per_year(hits: DataFrame, limit: int, *order: Column) -> DataFrame:
    """One hit for each year, of the earliest years."""
    return top_k(hits, ["year"], list(order)).orderBy("year").limit(limit)


def knn(vectors: DataFrame, query: Column, k: int, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The k nearest by cosine, exactly; rows without a vector are left out."""
    scored = vectors.withColumn("score", F.round(cosine(F.col(vector), query), 6)).filter("score is not null").drop(vector)
    return ranked(scored, k, F.desc("score"), F.col(key))


def score_floor(hits: DataFrame, keep: int = 4, floor: float = 0.2, window: float = 0.12) -> DataFrame:
    """The first `keep` hits, and others whose score is floor at least and within window of the best."""
    best = hits.agg(F.max("score").alias("_best"))
    return hits.crossJoin(F.broadcast(best)).filter((F.col("rank") <= keep) | (F.col("score") >= F.greatest(F.lit(floor), F.col("_best") - window))).drop("_best")


def fuse(keyword: DataFrame, semantic: DataFrame, weights: tuple[float, float], limit: int, key: str = "id") -> DataFrame:
    """key, score, retrieval, rank: weighted reciprocal-rank fusion. Of equal scores the keyword list's order stands first."""
    a = keyword.select(F.col(key), F.col("rank").alias("k"))
    b = semantic.select(F.col(key), F.col("rank").alias("s"))
    part = lambda c, w: F.coalesce(F.lit(w) / (RRF_K + F.col(c)), F.lit(0.0))
    both = a.join(b, key, "full").withColumn("score", F.round(part("k", weights[0]) + part("s", weights[1]), 9))
    name = F.when(F.col("k").isNull(), "semantic").when(F.col("s").isNull(), "keyword").otherwise("both")
    order = [F.desc("score"), F.col("k").asc_nulls_last(), F.col("s").asc_nulls_last(), F.col(key)]
    return ranked(both.withColumn("retrieval", name), limit, *order).select(key, "score", "retrieval", "rank")


def cover_missing(hits: DataFrame, extra: DataFrame, text: str, entities: tuple[str, str], most: int = 8, key: str = "id") -> DataFrame:
    """hits with keyword hits for one entity that none of them has: the first of the two that is missing. Of repeated keys the larger score stays."""
    left, right = (tx.has_token(F.col(text), e) for e in entities)
    flags = hits.agg(F.coalesce(F.max(left), F.lit(False)).alias("_l"), F.coalesce(F.max(right), F.lit(False)).alias("_r"))
    found = extra.crossJoin(F.broadcast(flags)).filter(F.when(~F.col("_l"), left).when(~F.col("_r"), right).otherwise(False)).drop("_l", "_r")
    found = found.orderBy(F.desc("score"), key).limit(most)
    both = hits.select(key, text, "score").unionByName(found.select(key, text, "score"))
    return top_k(both, [key], [F.desc("score"), F.col(text)])


def page(rows: DataFrame, number: int, size: int = 10, *order: Column) -> DataFrame:
    """Page `number` (from 1) in order, with total_pages."""
    total = rows.agg(F.ceil(F.count("*") / size).alias("total_pages"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """both, only_a, only_b of two sets of keys."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    j = x.join(y, key, "full")
    return j.agg(F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


class Cache:
    """The last results of questions on the driver, by normalised question: the oldest one used goes at capacity."""

    def __init__(self, capacity: int = 100, seconds: float = 300):
        self.capacity, self.seconds, self.held = capacity, seconds, {}

    @staticmethod
    def key(question: str) -> str:
        return " ".join(question.lower().split())

    def get(self, question: str, now: float):
        hit = self.held.pop(k := self.key(question), None)
        if hit is None or now - hit[0] > self.seconds:
            return None
        self.held[k] = hit
        return hit[1]

    def put(self, question: str, value, now: float) -> None:
        k = self.key(question)
        self.held.pop(k, None)
        if len(self.held) >= self.capacity:
            self.held.pop(next(iter(self.held)))
        self.held[k] = now, value


def any_hits(rows: DataFrame, text: str, alternatives: list[list[str]]) -> DataFrame:
    """Rows that hold all tokens of an alternative, scored by how often they hold any for their length."""
    c = F.col(text)
    alternatives = [a for a in alternatives if a]
    if not alternatives:
        return rows.filter("false").withColumn("score", F.lit(0.0))
    tokens = sorted({t.lower() for a in alternatives for t in a})
    n = sum((F.regexp_count(F.lower(c), F.lit(re.escape(t))) for t in tokens), F.lit(0))
    return rows.filter(reduce(lambda x, y: x | y, (tx.has_all(c, a) for a in alternatives))).withColumn("score", F.round(n / F.sqrt(F.length(c).cast("double")), 6))


def in_order(hits: DataFrame, order: str, distinct_years: bool, key: str = "id") -> DataFrame:
    """A few ranked hits, by year up ('asc') or down ('desc') with the larger score first, or as they are ('relevance'), ranked anew.
    distinct_years: of each year the one that stood first."""
    own = top_k(hits, ["year"], [F.col("rank")]) if distinct_years else hits
    by = {"asc": [F.col("year"), F.desc("score")], "desc": [F.desc("year"), F.desc("score")], "relevance": []}[order]
    return own.withColumnRenamed("rank", "_at").withColumn("rank", F.row_number().over(Window.orderBy(*by, "_at"))).drop("_at")


def search(rows: DataFrame, question: str, query_vector: list[float] | None = None, asked: Plan | None = None, text: str = "content", key: str = "id", limit: int | None = None, model: Callable[[str], str] | None = None, order: str | None = None) -> DataFrame:
    """key, year, score, retrieval, rank: hits of a question in rows (key, year, text, embedding).

    The question's plan is asked, or the model's, or the rules'. Keywords get the anchors of the question's words as alternatives. A
    timeline takes one hit of each year, the earliest first, and where the question is whether something is mentioned, a hit has
    to have its strict tokens. Where neither keywords nor vectors hit, the question's own words are a full text query of ten
    hits. A comparison of two entities gets hits of the one that is missing. order: of the result, the plan's if None.
    A plan that needs no retrieval gives no rows.
    """
    p = asked or understood(rows.sparkSession, question, model)
    keyword_n, semantic_n, fused_n = p.budgets
    own = in_years(rows, p.year_from, p.year_to) if p.needs_retrieval else rows.filter("false")
    keywords = anchored(p.keywords, question)
    bare = own.drop("embedding")
    if p.timeline:
        strict = strict_tokens(keywords, question, p.entities) if re.search(tx.MENTION, question) else []
        hits = timeline_hits(bare, text, keywords, strict, keyword_n, key)
        keyword = ranked(hits, keyword_n, F.col("year"), F.desc("score"), F.col(key))
    else:
        tokens = [[t for t in ascii_tokens(part) if len(t) >= 4][:8] for part in keywords.split("|")]
        keyword = ranked(any_hits(bare, text, tokens), keyword_n, F.desc("score"), F.col(key))
    keyword = keyword.select(key, "score", "rank")
    if query_vector is None:
        semantic = keyword.filter("false")
    else:
        semantic = score_floor(knn(own.drop(text), F.lit(query_vector), semantic_n, key=key))
    most = min(max(limit or fused_n, 1), 20)
    fused = fuse(keyword, semantic, WEIGHTS[p.kind], most, key)
    raw = ranked(web_hits(bare, text, web_query(question)), 10, F.desc("score"), F.col(key))
    found = otherwise(fused, raw.select(key, "score", F.lit("keyword").alias("retrieval"), "rank"))
    if p.compare and len(p.entities) > 1:
        pair = (p.entities[0], p.entities[1])
        with_text = found.join(bare.select(key, text), key)
        extra = any_hits(bare, text, [[w for w in e.split() if len(w) >= 3] for e in pair]).select(key, text, "score")
        scores = cover_missing(with_text, extra, text, pair, key=key).select(key, "score")
        both = scores.join(found.select(key, "retrieval", F.col("rank").alias("_r")), key, "left")
        last = both.withColumn("retrieval", F.coalesce("retrieval", F.lit("keyword")))
        found = ranked(last, 20 + 8, F.col("_r").asc_nulls_last(), F.desc("score"), F.col(key)).drop("_r")
    years = bare.select(key, "year") if "year" in bare.columns else bare.select(key, F.lit(None).cast("int").alias("year"))
    return in_order(found.join(years, key), order or p.order, p.timeline, key).select(key, "year", "score", "retrieval", "rank")


def search_tool(rows: DataFrame, question: str, year_from: int | None = None, year_to: int | None = None, limit: int = 7, text: str = "content", key: str = "id", **how) -> DataFrame:
    """key, year, excerpt (600 characters), retrieval, rank of a question's hits in a range of years, as tools are given them."""
    hits = in_years(search(rows, question, text=text, key=key, **how), year_from, year_to)
    hits = hits.orderBy("rank").limit(min(max(limit, 1), 20))
    return hits.join(rows.select(key, F.substring(text, 1, 600).alias("excerpt")), key).select(key, "year", "excerpt", "retrieval", "rank")


def document_tool(chunks: DataFrame, sources: DataFrame, source: str | None = None, year: int | None = None, number: int = 1, size: int = 10) -> DataFrame:
    """Page `number` of a source's chunks (source, ord, ...) with total_pages: of the source that is named, or of the latest one of a
    year (of all years if None). sources: (source, year)."""
    found = sources if source is None else sources.filter(F.col("source") == source)
    if source is None and year is not None:
        found = found.filter(F.col("year") == year)
    one = found.orderBy(F.desc("year"), "source").limit(1).select("source")
    return page(chunks.join(F.broadcast(one), "source", "left_semi"), number, size, F.col("ord"))


def graph_tool(edges: DataFrame, nodes: DataFrame, entity: str, year_from: int | None = None, year_to: int | None = None, limit: int = 12) -> DataFrame:
    """The relations of an entity, latest first."""
    return one_hop(edges, nodes, [entity.lower()], year_from, year_to, limit)
