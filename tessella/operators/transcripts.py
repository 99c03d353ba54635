"""Long texts cut into sections at header lines, though one text is many parts in many tasks.

What a part's lines do to the section that a line stands in is a number of headers: parts are summed up by themselves, the sums are
added along each text, and every line then finds its section from its part's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(parts: DataFrame, header: str, key: str = "key", part: str = "part", text: str = "text") -> DataFrame:
    """key, part, pos, line, section: from 1 on, 0 ahead of a text's first header. parts (key, part, text) hold whole lines."""
    each = parts.select(F.col(key).alias("key"), F.col(part).alias("part"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("head", F.col("line").rlike(header).cast("long"))
    sums = each.groupBy("key", "part").agg(F.sum("head").alias("heads"))
    ahead = F.coalesce(F.sum("heads").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("key", "part", ahead.alias("ahead"))
    within = F.sum("head").over(Window.partitionBy("key", "part").orderBy("pos"))
    return each.withColumn("within", within).join(starts, ["key", "part"]).select("key", "part", "pos", "line", (F.col("ahead") + F.col("within")).alias("section"))


def topic_of(line: Column) -> Column:
    """A short last line in capitals is a section's topic."""
    t = F.trim(line)
    return F.when((F.length(t) > 3) & (F.length(t) < 50) & (t == F.upper(t)) & ~t.contains(":"), t)


def sections(parts: DataFrame, header: str, year: str, must: str, key: str = "key", part: str = "part", text: str = "text") -> DataFrame:
    """key, year, nth, header, topic, content: the sections of each text that have a line like `must`, numbered within their year in
    order. header: what a header line is like; year: what of it is the year."""
    own = lines(parts, header, key, part, text).filter("section > 0")
    all_ = own.groupBy("key", "section").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))).alias("ls"))
    body = F.filter(F.transform(F.slice(F.col("ls.line"), F.lit(2), F.size("ls")), lambda x: F.rtrim(x)), lambda x: x != "")
    rows = all_.select("key", "section", F.trim(F.col("ls.line")[0]).alias("header"), body.alias("body")).filter(F.exists("body", lambda x: x.rlike(must)))
    topic = topic_of(F.get("body", F.size("body") - 1))
    content = F.array_join(F.when(topic.isNotNull(), F.slice("body", F.lit(1), F.size("body") - 1)).otherwise(F.col("body")), "\n")
    out = rows.select("key", "section", F.regexp_extract("header", year, 0).cast("int").alias("year"), "header", topic.alias("topic"), content.alias("content"))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("key", "year").orderBy("section"))).drop("section")
