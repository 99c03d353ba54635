"""Bilingual chunks of markdown documents: paragraphs under heading paths, an English one paired with the Chinese one after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as tx


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, para: texts at blank lines, rules taken out."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"(?m)^---[ \t]*$", ""), r"\n[ \t]+(?=\n)", "\n")
    parts = F.filter(F.transform(F.split(plain, r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select(key, F.posexplode(parts).alias("pos", "para"))


def chunks(docs: DataFrame, key: str = "id", text: str = "text", least: int = 20) -> DataFrame:
    """key, ord, title, title_zh, content_en, content_zh, is_table for each row of docs.

    A heading of level 1 or 2 opens a section, of 3 or 4 a part of it ('section > part'). A table is a chunk of its own.
    An English paragraph of `least` characters at least is a chunk, with the Chinese paragraph that follows it; dates, signatures and letterheads
    between them count as not there. Chinese paragraphs without an English one before are left out, and so are null texts.
    """
    rows = paragraphs(docs, key, text)
    first = F.trim(F.split_part("para", F.lit("\n"), F.lit(1)))
    level = F.length(F.regexp_extract(first, r"^(#{1,4})\s+(.+)$", 1))
    parts = tx.heading_parts(F.regexp_extract(first, r"^(#{1,4})\s+(.+)$", 2))
    kind = F.when(level > 0, "heading").when(tx.is_table(F.col("para")), "table").when(tx.is_skippable(F.col("para")), "skip").when(tx.is_cjk(F.col("para")), "zh").otherwise("en")
    rows = rows.withColumns({"kind": kind, "level": level, "h": F.when(level > 0, parts)}).filter("kind != 'skip'")
    upto = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("parent", F.last(F.when(F.col("level").between(1, 2), F.col("h")), ignorenulls=True).over(upto))

    def path(lang: str):
        own, up = F.col(f"h.{lang}"), F.col(f"parent.{lang}")
        sub = F.when(up.isNotNull() & own.isNotNull(), F.concat_ws(" > ", up, own)).otherwise(F.coalesce(own, up))
        return F.when(F.col("kind") == "heading", F.struct(F.when(F.col("level") <= 2, own).otherwise(sub).alias("v")))

    for lang in ("en", "zh"):
        rows = rows.withColumn(f"title_{lang}", F.last(path(lang), ignorenulls=True).over(upto)["v"])
    follows = F.lead("kind").over(upto) == "zh"
    rows = rows.withColumn("content_zh", F.when((F.col("kind") == "en") & follows, F.lead("para").over(upto)))
    kept = rows.filter((F.col("kind") == "table") | (F.col("kind") == "en") & (F.length("para") >= least))
    return kept.select(key, F.row_number().over(upto).alias("ord"), F.col("title_en").alias("title"), "title_zh", F.col("para").alias("content_en"), "content_zh", (F.col("kind") == "table").alias("is_table"))
