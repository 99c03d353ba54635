"""Company fundamentals: selection of facts, pivots, ratios, coverage and resolution of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import cagr, ratio
from tessella.operators.relational import top_k


def pivot_facts(facts: DataFrame, items: list[str], years: int | None = None) -> DataFrame:
    """entity_id, fy and a column for each item: the best value of each cell, null ones aside. The items are given, so
    Spark need not look for them first; years keeps so many of each entity's latest."""
    cells = facts.filter(F.col("value").isNotNull() & F.col("line_item").isin(items))
    aggs = [F.max(F.when(F.col("line_item") == i, F.col("value"))).alias(i.lower().replace("-", "_").replace(" ", "_")) for i in items]
    wide = cells.groupBy("entity_id", "fy").agg(*aggs)
    return wide if years is None else top_k(wide, ["entity_id"], [F.desc("fy")], years)


def yoy(rows: DataFrame, value: str) -> DataFrame:
    """rows with prev, of the calendar year before, and yoy."""
    prev = rows.select("entity_id", (F.col("fy") + 1).alias("fy"), F.col(value).alias("prev"))
    out = rows.join(prev, ["entity_id", "fy"], "left")
    return out.withColumn("yoy", F.round(ratio(F.col(value) - F.col("prev"), F.abs("prev")), 6))


def growth(rows: DataFrame, value: str, available: int = 5) -> DataFrame:
    """entity_id, cagr, span_cagr: from the n-th latest available year to the latest, with exponent n - 1, and with the years' true distance."""
    last = top_k(rows.filter(F.col(value).isNotNull()), ["entity_id"], [F.desc("fy")], available, rank="nth")
    ends = last.groupBy("entity_id").agg(*(F.max(F.when(F.col("nth") == n, F.col(c))).alias(f"{c}_{n}") for n in (1, available) for c in ("fy", value)))
    end, start = F.col(f"{value}_1"), F.col(f"{value}_{available}")
    span = F.col("fy_1") - F.col(f"fy_{available}")
    true = F.when((start > 0) & (end > 0) & (span > 0), F.pow(end.cast("double") / start.cast("double"), F.lit(1.0) / span) - 1)
    return ends.select("entity_id", F.round(cagr(end, start, available - 1), 6).alias("cagr"), F.round(true, 6).alias("span_cagr"))


def year_grid(rows: DataFrame, value: str, years: int = 5) -> DataFrame:
    """entity_id, fy, value: a row for each of the years up to the latest, null where there is none."""
    own = rows.groupBy("entity_id").agg(F.max("fy").alias("last"))
    grid = own.select("entity_id", F.explode(F.sequence(F.col("last") - years + 1, F.col("last"))).alias("fy"))
    return grid.join(rows.select("entity_id", "fy", value), ["entity_id", "fy"], "left")


def coverage(rows: DataFrame, entities: DataFrame, last_year: int, years: int = 5) -> DataFrame:
    """entity_id, available, missing, status of every entity over the years up to last_year: ok, short-history (none
    before its first), missing or no-data."""
    window = F.sequence(F.lit(last_year - years + 1), F.lit(last_year))
    have = rows.filter(F.col("fy").between(last_year - years + 1, last_year)).groupBy("entity_id").agg(F.array_sort(F.collect_set("fy")).alias("available"))
    first = rows.groupBy("entity_id").agg(F.min("fy").alias("first"))
    out = entities.join(have, "entity_id", "left").join(first, "entity_id", "left")
    out = out.withColumn("available", F.coalesce("available", F.array().cast("array<int>"))).withColumn("missing", F.array_except(window, "available"))
    after_first = F.filter("missing", lambda y: y >= F.col("first"))
    status = F.when(F.size("missing") == 0, "ok").when(F.col("first").isNull(), "no-data").when(F.size(after_first) == 0, "short-history").otherwise("missing")
    return out.select("entity_id", "available", "missing", status.alias("status"))


def best_fact(facts: DataFrame, by: list[str], tag_rank: Column, order: list[Column]) -> DataFrame:
    """Of each group the first row, in order, of the first tag that has any."""
    ranked = facts.withColumn("_tag", tag_rank).filter("_tag is not null")
    least = ranked.groupBy(*by).agg(F.min("_tag").alias("_tag"))
    return top_k(ranked.join(least, [*by, "_tag"]), by, order).drop("_tag")


def resolve(rows: DataFrame, cascade: list[tuple[Column, DataFrame, str, str]], default: Column, name: str) -> DataFrame:
    """rows with name and name_source: the value of the first dictionary (key of rows, dictionary, its key, its value) that
    has the row's key, else the default. Spark's own size check decides which dictionaries are broadcast."""
    out, found = rows, []
    for n, (key, dictionary, theirs, value) in enumerate(cascade):
        own = dictionary.select(F.col(theirs).alias(f"_k{n}"), F.col(value).alias(f"_v{n}")).dropDuplicates([f"_k{n}"])
        out = out.join(own, key == F.col(f"_k{n}"), "left")
        found.append(F.col(f"_v{n}"))
    source = F.coalesce(*(F.when(v.isNotNull(), F.lit(n)) for n, v in enumerate(found)), F.lit(len(found)))
    out = out.withColumn(name, F.coalesce(*found, default)).withColumn(f"{name}_source", source)
    return out.drop(*(f"{c}{n}" for n in range(len(cascade)) for c in ("_k", "_v")))


def duplicate_plan(entities: DataFrame, key: str, score: Column, blockers: dict[str, Column]) -> DataFrame:
    """key, entity_id, keep_id, nth, blockers of all but the best entity of each key: what merging would do, and what
    speaks against it."""
    ranked = entities.withColumn("_s", score).withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_s"), "entity_id")))
    best = ranked.filter("nth = 1").select(key, F.col("entity_id").alias("keep_id"))
    against = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in blockers.items())))
    return ranked.filter("nth > 1").join(best, key).select(key, "entity_id", "keep_id", "nth", F.array_join(against, ",").alias("blockers"))
