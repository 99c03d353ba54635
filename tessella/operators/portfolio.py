"""Holdings of many holders over quarters: weights, change sets and cross-holder signals.

All holders are worked on at once. A change set is one full outer join of the two latest quarters of each holder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.relational import latest_ordinals, top_k

KINDS = ("new", "add", "trim", "unchanged", "exit")


def with_weights(rows: DataFrame, by: list[str], value: str = "value_usd") -> DataFrame:
    """pct: the value's share of its group in percent, cut (not rounded) to two places; 0 where the total is 0. The total is
    an aggregate of its own, joined back: a window would bring a large group into one task."""
    total = rows.groupBy(*by).agg(F.sum(value).cast("decimal(38,0)").alias("_total"))
    pct = F.when(F.col("_total") == 0, F.lit(0.0)).otherwise(F.expr(f"(cast({value} as decimal(28,0)) * 10000) div _total").cast("double") / 100)
    return rows.join(total, by).withColumn("pct", pct).drop("_total")


def change_sets(rows: DataFrame, key: str = "security_id", threshold: float = 0.08, inclusive: bool = False, target: int | None = None) -> DataFrame:
    """holder_id, key, kind, now_pct, prev_pct, delta: the latest quarter of each holder, or the target one, against the one
    before it that the holder has. Null percentages count as 0. The threshold is on the difference in percentage points, itself outside
    of add and trim unless inclusive."""
    if target is None:
        two = latest_ordinals(rows, ["holder_id"], "q")
    else:
        before = latest_ordinals(rows.filter(F.col("q") < target), ["holder_id"], "q", 1).withColumn("nth", F.lit(2))
        two = rows.filter(F.col("q") == target).withColumn("nth", F.lit(1)).unionByName(before)
    side = lambda n, name: two.filter(F.col("nth") == n).select("holder_id", key, F.coalesce("pct", F.lit(0.0)).alias(name))
    both = side(1, "now_pct").join(side(2, "prev_pct"), ["holder_id", key], "full")
    delta = F.round(F.coalesce("now_pct", F.lit(0.0)) - F.coalesce("prev_pct", F.lit(0.0)), 4)
    both = both.withColumn("delta", delta)
    above, below = (delta >= threshold, delta <= -threshold) if inclusive else (delta > threshold, delta < -threshold)
    kind = F.when(F.col("prev_pct").isNull(), "new").when(F.col("now_pct").isNull(), "exit").when(above, "add").when(below, "trim").otherwise("unchanged")
    return both.select("holder_id", key, kind.alias("kind"), F.coalesce("now_pct", F.lit(0.0)).alias("now_pct"), F.coalesce("prev_pct", F.lit(0.0)).alias("prev_pct"), "delta")


def change_order(key: str) -> list[Column]:
    """Largest changes first: exits by what they were, others by their difference."""
    return [F.abs("delta").desc(), F.col(key)]


def top_changes(changes: DataFrame, k: int = 5, key: str = "security_id") -> DataFrame:
    """The k largest changes of each kind and holder, unchanged ones aside, with nth."""
    return top_k(changes.filter("kind != 'unchanged'"), ["holder_id", "kind"], change_order(key), k, rank="nth")


# What kinds of changes are called.
LABELS = {"summary": "组合概况", "new": "新进", "add": "增持", "trim": "减持", "exit": "清仓"}


def insight_items(cut: DataFrame, latest: DataFrame, names: DataFrame, most: int = 4) -> DataFrame:
    """holder_id, place, kind, label, ticker, detail: a summary of each holder's latest quarter, then `most` changes of each kind.

    cut: changes cut to a few of each kind (top_changes), which the summary counts. latest: the quarter's rows. names: (security_id,
    ticker)."""
    five = top_k(latest, ["holder_id"], [F.coalesce("pct", F.lit(0.0)).desc(), F.col("security_id")], 5).groupBy("holder_id").agg(F.round(F.sum("pct"), 2).alias("top5"))
    changed = cut.groupBy("holder_id").agg(F.count("*").alias("changed"))
    two = lambda c: F.format_string("%.2f", c)
    summary = five.join(changed, "holder_id", "left").select(
        "holder_id", F.lit(0).alias("place"), F.lit("summary").alias("kind"), F.lit(0).alias("nth"), F.lit(None).cast("string").alias("ticker"),
        F.concat(F.lit("前五大持仓合计 "), two(F.col("top5")), F.lit("%，组合集中度"), F.when(F.col("top5") >= 60, "较高").otherwise("中等"), F.when(F.col("changed") > 0, F.concat(F.lit("，本季"), F.col("changed").cast("string"), F.lit("笔变动"))).otherwise("")).alias("detail"),
    )
    kind, now = F.col("kind"), two(F.col("now_pct"))
    moved = F.concat(F.col("ticker"), F.when(kind == "add", " +").otherwise(" "), two(F.col("delta")), F.lit("pp → "), now, F.lit("%"))
    detail = F.when(kind == "new", F.concat("ticker", F.lit(" 仓位 "), now, F.lit("%"))).when(kind == "exit", F.concat("ticker", F.lit(" 上季仓位 "), two(F.col("prev_pct")), F.lit("%"))).otherwise(moved)
    place = F.when(kind == "new", 1).when(kind == "add", 2).when(kind == "trim", 3).otherwise(4)
    rows = cut.filter(F.col("nth") <= most).join(names, "security_id", "left").withColumn("ticker", F.coalesce("ticker", F.col("security_id").cast("string")))
    items = summary.unionByName(rows.select("holder_id", place.alias("place"), "kind", "nth", "ticker", detail.alias("detail")))
    return items.withColumn("label", F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("kind")))


def share_delta_pct(prev: Column, now: Column) -> Column:
    """Change of shares in percent; null unless there were some before."""
    return F.when(prev > 0, (now - prev) / prev * 100)


def activity(comparable: Column, has_prev: Column, delta_pct: Column, unchanged_pct: float = 1.0) -> Column:
    small = delta_pct.isNull() | (F.abs(delta_pct) < unchanged_pct)
    return F.when(~comparable, "Unchanged").when(~has_prev, "New").when(small, "Unchanged").when(delta_pct > 0, "Added").otherwise("Reduced")


def company_rollup(rows: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """by, company_key, pct, tickers: weights of a company's securities together, the k largest and a row 'Others' that
    holds what they leave of 100."""
    sums = rows.groupBy(*by, "company_key").agg(F.round(F.sum(F.greatest(F.coalesce("pct", F.lit(0.0)), F.lit(0.0))), 2).alias("pct"), F.array_join(F.array_sort(F.collect_set("ticker")), ", ").alias("tickers"))
    top = top_k(sums, by, [F.col("pct").desc(), F.col("company_key")], k)
    rest = top.groupBy(*by).agg(F.round(F.greatest(F.lit(0.0), 100 - F.sum("pct")), 2).alias("pct"))
    return top.unionByName(rest.select(*by, F.lit("Others").alias("company_key"), "pct", F.lit("").alias("tickers")))


def master_events(rows: DataFrame, threshold: float = 0.08) -> DataFrame:
    """holder_id, company_key, security_id, kind, direction, now_pct, prev_pct, delta: changes by company.

    rows have company_key. A company's securities in the base quarter count by one: the last in order of weight, null
    first, and id. Latest rows are not collapsed. The threshold is inside add and trim. delta is null for new and exit.
    """
    two = latest_ordinals(rows, ["holder_id"], "q")
    base = two.filter("nth = 2")
    one = top_k(base, ["holder_id", "company_key"], [F.col("pct").asc(), F.col("security_id").desc()])
    prev = one.select("holder_id", "company_key", F.col("pct").alias("prev_pct"))
    latest = two.filter("nth = 1")
    now = latest.join(prev, ["holder_id", "company_key"], "left")
    delta = F.round(F.col("pct") - F.col("prev_pct"), 4)
    kind = F.when(F.col("prev_pct").isNull(), "new").when(delta >= threshold, "add").when(delta <= -threshold, "trim")
    now = now.withColumn("kind", kind).filter("kind is not null")
    now = now.select("holder_id", "company_key", "security_id", "kind", F.col("pct").alias("now_pct"), "prev_pct", delta.alias("delta"))
    gone = base.join(latest.select("holder_id", "company_key").distinct(), ["holder_id", "company_key"], "left_anti")
    gone = gone.select("holder_id", "company_key", "security_id", F.lit("exit").alias("kind"), F.lit(0.0).alias("now_pct"), F.col("pct").alias("prev_pct"), F.lit(None).cast("double").alias("delta"))
    both = now.unionByName(gone)
    return both.withColumn("direction", F.when(F.col("kind").isin("new", "add"), "positive").otherwise("negative"))


def magnitude() -> Column:
    return F.abs(F.coalesce("delta", "now_pct"))


def collapse(events: DataFrame, scope: list[str]) -> DataFrame:
    """The strongest event of each holder within a scope; ties by company and security."""
    order = [F.round(magnitude() + F.col("now_pct"), 4).desc(), F.col("company_key"), F.col("security_id"), F.col("kind")]
    return top_k(events, [*scope, "holder_id"], order)


def first_buy(events: DataFrame) -> DataFrame:
    """company_key, holder_id (the strongest buyer), score, holders: of companies that holders bought newly."""
    own = collapse(events.filter("kind = 'new'"), ["company_key"])
    best = F.max_by("holder_id", F.struct("now_pct", -F.col("holder_id")))
    return own.groupBy("company_key").agg(best.alias("holder_id"), F.round(F.max("now_pct") + F.count("*") - 1, 4).alias("score"), F.count("*").alias("holders"))


def sided(events: DataFrame) -> DataFrame:
    """company_key, pos, neg (holders by direction of their strongest event), size (sum of its magnitudes), all_size (of all events)."""
    own = collapse(events, ["company_key"]).groupBy("company_key").agg(
        F.count_if(F.col("direction") == "positive").alias("pos"), F.count_if(F.col("direction") == "negative").alias("neg"), F.sum(magnitude()).alias("size"))
    return own.join(events.groupBy("company_key").agg(F.sum(magnitude()).alias("all_size")), "company_key")


def consensus(events: DataFrame) -> DataFrame:
    """Companies that two holders at least moved to one side, and none to the other."""
    one = sided(events).filter("(pos >= 2 and neg = 0) or (neg >= 2 and pos = 0)")
    n = F.col("pos") + F.col("neg")
    return one.select("company_key", F.when(F.col("pos") > 0, "positive").otherwise("negative").alias("side"), n.alias("holders"), F.round(10 * n + F.col("size"), 4).alias("score"))


def divergence(events: DataFrame) -> DataFrame:
    """Companies on which holders moved to both sides."""
    both = sided(events).filter("pos > 0 and neg > 0")
    return both.select("company_key", "pos", "neg", F.round(10 * (F.col("pos") + F.col("neg")) + F.col("all_size"), 4).alias("score"))


def add_cards(events: DataFrame) -> DataFrame:
    """Each holder's strongest addition."""
    own = collapse(events.filter("kind = 'add'"), [])
    return own.select("holder_id", "company_key", "kind", F.round(F.abs("delta") + F.col("now_pct"), 4).alias("score"))


def trim_cards(events: DataFrame) -> DataFrame:
    """Each holder's strongest reduction or exit. An exit has magnitude 0, so any reduction stands before it."""
    own = collapse(events.filter("direction = 'negative'"), [])
    return own.select("holder_id", "company_key", "kind", F.round(F.when(F.col("kind") == "exit", F.col("prev_pct")).otherwise(F.abs("delta")), 4).alias("score"))


def fallback_cards(events: DataFrame) -> DataFrame:
    """The strongest event of each company."""
    order = [F.round(magnitude() + F.col("now_pct"), 4).desc(), F.col("holder_id"), F.col("security_id"), F.col("kind")]
    return top_k(events, ["company_key"], order).select("company_key", "holder_id", "kind", F.round(magnitude() + F.col("now_pct"), 4).alias("score"))


def signal_pick(events: DataFrame, k: int = 3) -> DataFrame:
    """nth, bucket, company_key, score: one card from each of six pools in order, none of a company that an earlier one has.

    Pools are cut to their six best companies first: of six, five at most are taken before.
    """
    pools = [("first_buy", first_buy(events)), ("divergence", divergence(events)), ("consensus", consensus(events)), ("add", add_cards(events)), ("trim", trim_cards(events)), ("fallback", fallback_cards(events))]
    heads = None
    for n, (bucket, pool) in enumerate(pools):
        best = pool.groupBy("company_key").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "company_key").limit(len(pools))
        best = best.select(F.lit(n).alias("at"), F.lit(bucket).alias("bucket"), "company_key", "score")
        heads = best if heads is None else heads.unionByName(best)
    cards = heads.orderBy("at", F.desc("score"), "company_key").agg(F.array_sort(F.collect_list(F.struct("at", -F.col("score"), "company_key", "bucket", "score"))).alias("cards"))
    start = F.array().cast("array<struct<at int, bucket string, company_key string, score double>>")
    taken = F.aggregate("cards", start, lambda acc, c: F.when(F.exists(acc, lambda x: (x["at"] == c["at"]) | (x["company_key"] == c["company_key"])), acc).otherwise(F.array_append(acc, F.struct(c["at"].alias("at"), c["bucket"].alias("bucket"), c["company_key"].alias("company_key"), c["score"].alias("score")))))
    return cards.select(F.posexplode(F.slice(taken, 1, k)).alias("nth", "c")).select((F.col("nth") + 1).alias("nth"), "c.bucket", "c.company_key", "c.score")


