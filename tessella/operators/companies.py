"""Companies by identifiers, and what holdings say of tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import identifiers as ids
from tessella.operators.relational import top_k


def quality(type_: Column, cik: Column, financials: Column, holdings: Column) -> Column:
    """How good an entity is as the one of its ticker."""
    of = lambda c, points: F.when(c, points).otherwise(0)
    return of(type_ == "master", 120) + of(F.coalesce(cik, F.lit("")) != "", 100) + of(F.coalesce(financials, F.lit(0)) > 0, 50) + of(F.coalesce(holdings, F.lit(0)) > 0, 30)


def resolve(asked: DataFrame, entities: DataFrame, securities: DataFrame, name: str = "identifier") -> DataFrame:
    """name, entity_id, way for each different identifier: by the digits of a registration number, else the best company or
    master of the ticker, else the company of the latest security of that ticker; null where none is found.

    entities: entity_id, type, ticker, cik, financials, holdings, updated. securities: ticker, company_id, updated,
    security_id. Of equally good entities the latest one counts, then the smallest id.
    """
    asked = asked.select(name).distinct().withColumns({"_cik": ids.cik(F.col(name)), "_ticker": F.upper(ids.ticker(F.col(name)))})
    by_cik = entities.filter("cik is not null").select(F.col("cik").alias("_cik"), F.col("entity_id").alias("_by_cik"))
    score = quality(F.col("type"), F.col("cik"), F.col("financials"), F.col("holdings"))
    named = entities.filter(F.col("type").isin("company", "master") & F.col("ticker").isNotNull()).withColumn("_ticker", F.upper("ticker")).withColumn("_score", score)
    best = top_k(named, ["_ticker"], [F.desc("_score"), F.desc("updated"), F.col("entity_id")]).select("_ticker", F.col("entity_id").alias("_by_ticker"))
    traded = securities.filter("ticker is not null").withColumn("_ticker", F.upper("ticker"))
    latest = top_k(traded, ["_ticker"], [F.desc("updated"), F.desc("security_id")]).select("_ticker", F.col("company_id").alias("_by_security"))
    found = asked.join(by_cik, "_cik", "left").join(best, "_ticker", "left").join(latest, "_ticker", "left")
    way = F.when(F.col("_by_cik").isNotNull(), "cik").when(F.col("_by_ticker").isNotNull(), "ticker").when(F.col("_by_security").isNotNull(), "security")
    return found.select(name, F.coalesce("_by_cik", "_by_ticker", "_by_security").alias("entity_id"), way.alias("way"))


def tickers_held(rows: DataFrame, tickers: list[str], issuer: str, cusip: str, order: str) -> DataFrame:
    """kind, value, cusip: the different tickers of holdings, the first of some columns that is not null, trimmed and in
    capitals, and issuers without one with the cusip of their last row. Tickers with other characters are left out."""
    ticker = F.upper(F.trim(F.coalesce(*(F.col(c) for c in tickers), F.lit(""))))
    rows = rows.withColumn("_t", ticker)
    good = rows.filter((F.col("_t") != "") & ~F.col("_t").rlike(r"[^A-Z0-9.\-]")).select(F.lit("ticker").alias("kind"), F.col("_t").alias("value"), F.lit(None).cast("string").alias("cusip")).distinct()
    name = F.coalesce(F.nullif(F.trim(F.col(issuer)), F.lit("")), F.lit("UNKNOWN_ISSUER"))
    lost = top_k(rows.filter("_t = ''").withColumn("value", name), ["value"], [F.desc(order)]).select(F.lit("unresolved").alias("kind"), "value", F.col(cusip).alias("cusip"))
    return good.unionByName(lost)


def snapshot(cards: DataFrame, before: DataFrame, key: str, defaults: list[tuple[str, str, float]]) -> DataFrame:
    """key, version, source, payload: the cards (nth, bucket, company_key, score) as one nested value, the version one more than
    the key's last in `before` (key, version). Without cards the defaults (bucket, company_key, score) stand."""
    card = F.struct("nth", "bucket", "company_key", "score")
    own = cards.agg(F.array_sort(F.collect_list(card)).alias("own"))
    fixed = F.array(*(F.struct(F.lit(k).cast("int").alias("nth"), F.lit(b).alias("bucket"), F.lit(c).alias("company_key"), F.lit(float(s)).alias("score")) for k, (b, c, s) in enumerate(defaults, 1)))
    last = before.filter(F.col("key") == key).agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))
    both = own.join(F.broadcast(last))  # one row each
    empty = F.size("own") == 0
    return both.select(F.lit(key).alias("key"), (F.col("last") + 1).alias("version"), F.when(empty, "defaults").otherwise("events").alias("source"), F.when(empty, fixed).otherwise(F.col("own")).alias("payload"))
