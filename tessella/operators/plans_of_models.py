"""Plans that a language model has written as JSON, taken leniently: what is missing or wrong is taken from the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as tx

TASKS, MODES = ("fact", "method"), ("none", "point", "range", "earliest", "latest", "evolution")


def json_block(c: Column) -> Column:
    """A text as a variant, or its part from the first brace to the last one; null if neither is JSON."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))


def lenient_plan(rows: DataFrame, reply: str, question: str) -> DataFrame:
    """rows with task, needs_retrieval, temporal_mode, year_from, year_to, entities, keywords, confidence, timeline, compare.

    Values of a wrong type or outside of what is allowed are replaced by what the question's own words say; years outside
    of 1900 to 2100 are dropped and put in order; eight entities are kept.
    """
    asked = F.col(question)
    rows = rows.withColumn("_j", json_block(F.col(reply))).withColumn("_y", tx.year_range(asked))

    def value(name: str, type_: str, types: tuple[str, ...]) -> Column:
        own = F.schema_of_variant(F.try_variant_get("_j", f"$.{name}", "variant"))
        return F.when(own.isin(*types), F.try_variant_get("_j", f"$.{name}", type_))

    def one_of(name: str, allowed: tuple[str, ...], rule: Column) -> Column:
        own = value(name, "string", ("STRING",))
        return F.when(own.isin(*allowed), own).otherwise(rule)

    def year(name: str) -> Column:
        y = F.coalesce(value(name, "int", ("BIGINT",)), F.col(f"_y.{name}"))
        return F.when(y.between(1900, 2100), y)

    rows = rows.withColumns({"_a": year("year_from"), "_b": year("year_to")})
    low, high = F.col("_a"), F.col("_b")
    mode = tx.temporal_mode(asked, F.col("_y.year_from"), F.col("_y.year_to"))
    entities = F.transform(F.try_variant_get("_j", "$.entities", "array<string>"), lambda x: F.trim(x))
    number = value("confidence", "double", ("BIGINT", "DOUBLE", "DECIMAL(1,1)", "DECIMAL(2,1)"))
    words = F.nullif(F.trim(F.try_variant_get("_j", "$.keyword_query", "string")), F.lit(""))
    rows = rows.withColumns({
        "task": one_of("task_type", TASKS, F.when(asked.rlike(tx.METHOD), "method").otherwise("fact")),
        "needs_retrieval": F.coalesce(value("needs_retrieval", "boolean", ("BOOLEAN",)), F.lit(True)),
        "temporal_mode": one_of("temporal_mode", MODES, mode),
        "year_from": F.when(low > high, high).otherwise(low),
        "year_to": F.when(low > high, low).otherwise(high),
        "entities": F.coalesce(F.slice(F.filter(entities, lambda x: F.length(x) > 0), 1, 8), F.array().cast("array<string>")),
        "keywords": F.coalesce(words, asked),
        "confidence": F.when(number.between(0, 1), number).otherwise(0.55),
    })
    timeline = (F.col("temporal_mode") != "none") | F.col("keywords").rlike(tx.TEMPORAL)
    return rows.withColumns({"timeline": timeline, "compare": F.col("keywords").rlike(tx.COMPARE)}).drop("_j", "_y", "_a", "_b")
