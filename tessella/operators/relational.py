"""Relational helpers: every window has a total order, and top-k filters stand right above their window, so Spark cuts
groups before it shuffles them (WindowGroupLimit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each group, with their rank if a name for it is given."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_max(df: DataFrame, by: list[str], value: str, ties: list[Column]) -> DataFrame:
    """One row for each key: the largest value (null counts as 0), then by ties."""
    return top_k(df, by, [F.coalesce(F.col(value), F.lit(0)).desc(), *ties])


def latest_ordinals(df: DataFrame, by: list[str], ordinal: str, n: int = 2) -> DataFrame:
    """Rows of the n latest values of ordinal in each group, with nth (1: the latest). A dense rank over the distinct
    values, which are aggregated first, so no group's rows are ordered."""
    values = df.filter(F.col(ordinal).isNotNull()).select(*by, ordinal).distinct()
    last = top_k(values, by, [F.col(ordinal).desc()], n, rank="nth")
    return df.join(last, [*by, ordinal])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """base with delta's rows put in its place by key; version counts how often a key was put."""
    old = base.select(*keys, F.lit(True).alias("_old"), *([F.col(version).alias("_v")] if version else []))
    new = delta.join(old, keys, "left")
    if version:
        new = new.withColumn(version, F.coalesce("_v", F.lit(0)) + 1)
    kept = base.join(delta.select(*keys), keys, "left_anti")
    return kept.unionByName(new.select(kept.columns))


def replace_children(base: DataFrame, delta: DataFrame, parent: str) -> DataFrame:
    """base without the children of any parent that delta names, and delta's."""
    return base.join(delta.select(parent).distinct(), parent, "left_anti").unionByName(delta)


def semi_any(df: DataFrame, keys: list[tuple[str, DataFrame, str]], unique: str) -> DataFrame:
    """Rows for which any of the keys (column, other, other's column) is found: a semi-join for each and a union, instead of a join on a disjunction."""
    parts = [df.join(other.select(F.col(theirs).alias(ours)).distinct(), ours, "left_semi").select(df.columns) for ours, other, theirs in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([unique])
