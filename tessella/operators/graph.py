"""Mentions and graph patterns over two tables: nodes (label, id, ...) and edges (src, rel, dst, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.relational import top_k

# Fixed values of this library: concepts and the words that mention them.
CONCEPTS = {"insult": ["idiot", "moron", "clown"], "license": ["license", "licence"], "article": [" the ", " der ", " la "], "linking": [" and ", " und ", " et ", " con "], "rare": ["tionat", "lyor", "stre"]}


def mentions(rows: DataFrame, text: str, concepts: dict[str, list[str]] = CONCEPTS) -> DataFrame:
    """rows with concept: a row for each concept of which any word stands in the text, case aside. The dictionary is a
    literal that each row is compared with: no join, and a concept comes once for a row."""
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*(F.when(_any(low, words), F.lit(name)) for name, words in concepts.items())))
    return rows.withColumn("concept", F.explode(found))


def _any(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def merge(edges: DataFrame, keys: list[str], order: list[Column], minmax: str | None = None) -> DataFrame:
    """One edge for each key: the last in order; with minmax also that column's least and largest value as first_ and last_."""
    last = top_k(edges, keys, order)
    if minmax is None:
        return last
    ends = edges.groupBy(*keys).agg(F.min(minmax).alias(f"first_{minmax}"), F.max(minmax).alias(f"last_{minmax}"))
    return last.join(ends, keys)


def one_hop(edges: DataFrame, nodes: DataFrame, names: list[str], low: int | None, high: int | None, limit: int) -> DataFrame:
    """Distinct (src, name, year) of edges to nodes whose name holds one of the given (six at most), latest first."""
    names = names[:6]
    own = nodes.filter(_any(F.lower("name"), names)).select(F.col("id").alias("dst"), "name")
    found = edges.join(own, "dst").select("src", "name", "year").distinct()
    if low is not None:
        found = found.filter(F.col("year") >= low)
    if high is not None:
        found = found.filter(F.col("year") <= high)
    return found.orderBy(F.desc_nulls_last("year"), "src", "name").limit(min(max(limit, 1), 20))
