"""Integrity reports: counts and a bounded sample from one pass, references and duplicates that block a clean-up, choice of facts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def report(rows: DataFrame, counts: dict[str, Column], bad: Column, sample: dict[str, Column], by: Column, most: int = 30) -> dict:
    """total, the counts by name, and up to `most` samples of bad rows, those first whose `by` has the smallest digest: one pass
    over rows, of which the driver gets the counts and the samples only."""
    seen = Observation()
    observed = rows.observe(seen, F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    found = observed.filter(bad).select(F.md5(by.cast("string")).alias("_at"), by.alias("_by"), F.struct(*(c.alias(n) for n, c in sample.items())).alias("s"))
    samples = [r.s.asDict() for r in found.orderBy("_at", "_by").limit(most).collect()]
    return {**{k: seen.get[k] for k in ("total", *counts)}, "samples": samples}


def write_report(spark, found: dict, path: str) -> None:
    """A report as one file of JSON."""
    spark.createDataFrame([(json.dumps(found, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)


def reference_counts(references: DataFrame, key: str, name: Column, n: Column, present: DataFrame) -> DataFrame:
    """key, name, refs, present: how often each company is referred to (n times by a row), and whether `present` (a table with the
    key) has it. References are summed before they are joined."""
    refs = references.groupBy(key).agg(F.min(name).alias("name"), F.sum(n).alias("refs"))
    there = present.select(key).distinct().withColumn("_there", F.lit(True))
    return refs.join(there, key, "left").select(key, "name", "refs", F.coalesce("_there", F.lit(False)).alias("present"))


def duplicate_rows(rows: DataFrame, pairs: DataFrame, entity: str, cells: list[str], text: Column) -> DataFrame:
    """drop_id, keep_id, duplicates, blockers: of each pair of entities the rows of the one to drop whose cells the other one has,
    and the texts, in order, of those that it lacks and that therefore block the clean-up."""
    mine = rows.select(F.col(entity).alias("drop_id"), *cells).distinct().join(pairs, "drop_id")
    theirs = rows.select(F.col(entity).alias("keep_id"), *cells).distinct().withColumn("_had", F.lit(True))
    # cells may be null, as keys of a lookup they are equal then
    same = [mine["keep_id"] == theirs["keep_id"], *(mine[c].eqNullSafe(theirs[c]) for c in cells)]
    both = mine.join(theirs, same, "left").select(mine["drop_id"], mine["keep_id"], *(mine[c] for c in cells), "_had")
    found = both.groupBy("drop_id", "keep_id").agg(F.count_if(F.col("_had").isNotNull()).alias("duplicates"), F.array_sort(F.collect_list(F.when(F.col("_had").isNull(), text))).alias("blockers"))
    out = pairs.join(found, ["drop_id", "keep_id"], "left")
    return out.select("drop_id", "keep_id", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("blockers", F.array().cast("array<string>")).alias("blockers"))


def backfilled(rows: DataFrame, links: DataFrame, key: str, own: str, found: str) -> DataFrame:
    """rows with `own` filled in from links (key, found; one for each key) where it is null, and whether it was there (had) or came
    from a link (filled)."""
    both = rows.join(links, key, "left")
    had = F.col(own).isNotNull()
    return both.withColumns({"had": had, "filled": ~had & F.col(found).isNotNull(), own: F.coalesce(own, found)}).drop(found)


def rank_in(c: Column, values: list[str], otherwise: int | None = None) -> Column:
    """The place of c among values, from 0; otherwise (null: none) for any other."""
    out = F.lit(otherwise).cast("int") if otherwise is not None else F.lit(None).cast("int")
    for k, v in reversed(list(enumerate(values))):
        out = F.when(c == v, k).otherwise(out)
    return out


def chosen_facts(feed: DataFrame, inline: DataFrame, wanted: DataFrame, cell: list[str], tags: list[str], units: list[str]) -> DataFrame:
    """cell, value, unit, source ('feed', 'inline' or 'missing') for each wanted cell.

    feed (cell, tag, unit, value, filed): the last filed fact of the first tag that has any, in the first unit. inline (cell,
    tag, unit, value, pos): where the feed has none, the first fact in a preferred unit, else the first one. All candidates are one
    stream that is reduced by one order of tag, unit, date and place, without a window and without a join for each source.
    """
    of = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    none = F.lit(0).cast("long")
    a = feed.withColumn("t", rank_in(F.col("tag"), tags)).withColumn("u", rank_in(F.upper("unit"), units, len(units))).filter("t is not null and value is not null and u = 0")
    a = a.select(*cell, of(source=F.lit(0), t=F.col("t"), u=none, at=-F.unix_date("filed").cast("long"), pos=none).alias("by"), of(value=F.col("value"), unit=F.lit(units[0]), source=F.lit("feed")).alias("x"))
    b = inline.withColumn("t", rank_in(F.col("tag"), tags)).filter("t is not null and value is not null")
    preferred = F.when(F.upper("unit").isin(*units), 0).otherwise(1).cast("long")
    b = b.select(*cell, of(source=F.lit(1), t=F.lit(0), u=preferred, at=none, pos=F.col("pos").cast("long")).alias("by"), of(value=F.col("value"), unit=F.coalesce("unit", F.lit(units[0])), source=F.lit("inline")).alias("x"))
    # equal dates of one tag: the larger value, so that the order of rows does not show
    best = a.unionByName(b).groupBy(*cell).agg(F.min_by("x", F.struct("by", (-F.col("x.value")).alias("v"))).alias("x"))
    out = wanted.select(*cell).distinct().join(best, cell, "left")
    return out.select(*cell, "x.value", "x.unit", F.coalesce("x.source", F.lit("missing")).alias("source"))
