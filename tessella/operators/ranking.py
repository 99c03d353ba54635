"""Cover-density ranking: stretches of text that hold all terms, shorter ones weighing more (Clarke, Cormack, Tudhope 1999).

Positions are arrays inside a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cover_density(rows: DataFrame, text: str, terms: list[str], full: float = 1.0) -> DataFrame:
    """rows with score: the sum over minimal stretches that hold all terms (none holds another) of terms / words in it.

    A stretch ends where a term stands and starts at the least of the other terms' last places before. Of stretches
    with one start, the first ends soonest, so it alone is minimal.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z0-9]+"), F.lit(0))
    out = rows.withColumn("_words", words)
    out = out.withColumn("_at", F.array_compact(F.transform("_words", lambda w, i: F.when(w.isin(terms), F.struct(i.alias("i"), w.alias("w"))))))
    none = F.array(*(F.lit(-1) for _ in terms))
    start = F.struct(none.alias("last"), F.lit(-1).alias("from"), F.lit(0.0).cast("double").alias("score"))

    def step(acc, x):
        last = F.array(*(F.when(x["w"] == t, x["i"]).otherwise(F.get(acc["last"], F.lit(k))) for k, t in enumerate(terms)))
        begin = F.array_min(last)
        new = (begin >= 0) & (begin > acc["from"])
        gain = F.when(new, F.lit(full) * len(terms) / (x["i"] - begin + 1)).otherwise(0.0)
        return F.struct(last.alias("last"), F.when(new, begin).otherwise(acc["from"]).alias("from"), (acc["score"] + gain).alias("score"))

    total = F.aggregate("_at", start, step, lambda acc: acc["score"])
    return out.withColumn("score", F.round(total, 6)).drop("_words", "_at")
