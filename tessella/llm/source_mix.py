"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import NON_SPACE, written

#: Sources in code point order, null last, take these weights in turn.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is repeated more often than this.
MAX_REPEATS = 3


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a digest of the seed and the id: reruns and lost tasks get it again."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def running_sums(rows: DataFrame, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """rows with the sum of each column over all rows that stand before it in a total order, under the new names given.

    Rows are dealt out by ranges of the order; one task sees one range, and one row of sums for each range.
    """
    placed = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    sums = placed.groupBy("_part").agg(*(F.sum(c).alias(n) for c, n in columns.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in columns.values()))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(ahead), "_part")  # a row for each partition
    return out.select(*rows.columns, *((F.col(f"_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(n) for c, n in columns.items()))


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """source, source_size, n_docs, target: a row for each source.

    All sizes together are shared by weight; a source stops at max_repeats times its size, and the excess goes to the
    others by weight until none is above. With sources ordered by cap / weight, the level at which the rest share what
    the capped ones leave rises while caps bind and falls after, so its largest value is the final one.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.lit(1).alias("one"))
    named = running_sums(sums, [F.col("source").asc_nulls_last()], {"one": "nth"})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    named = named.select("source", "source_size", "n_docs", w.alias("w"), (F.col("source_size") * max_repeats).alias("cap"))
    at = running_sums(named, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], {"cap": "caps", "w": "ws"})
    at = written(at, "mix-levels")
    every, all_w = at.agg(F.sum("source_size"), F.sum("w")).first()
    level = at.agg(F.max((F.lit(every) - F.col("caps")) / (F.lit(all_w) - F.col("ws")))).first()[0]
    return at.select("source", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level).cast("double")).alias("target"))


def class_shares(sized: DataFrame, sources: DataFrame, max_repeats: int) -> DataFrame:
    """source, class, words, copies (certain ones), share (inclusion probability beside them): a row for each source and class.

    A document's class is the whole logarithm of its size. Its expected copies are in proportion to 1 + class, so long
    documents are likelier than short ones, max_repeats at most; a source's classes reach its target in all. The level is found
    as that of sources is, among a source's classes, of which there are 64 at most.
    """
    classes = sized.groupBy("source", "class").agg(F.sum("size").alias("words"))
    rows = classes.join(sources.select(F.col("source").alias("src"), "target"), F.col("source").eqNullSafe(F.col("src")))
    own = Window.partitionBy("source").orderBy(F.desc("class"))
    before, rest = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(0, Window.unboundedFollowing)
    caps = F.coalesce(F.sum(F.col("words") * max_repeats).over(before), F.lit(0))
    rows = rows.withColumn("level", F.try_divide(F.col("target") - caps, F.sum(F.col("words") * (F.col("class") + 1)).over(rest).cast("double")))
    level = F.coalesce(F.max("level").over(Window.partitionBy("source")), F.lit(0.0))
    rows = rows.withColumn("expected", F.least(F.lit(float(max_repeats)), (F.col("class") + 1) * level))
    copies = F.floor("expected")
    return rows.select("source", "class", "words", copies.alias("copies"), (F.col("expected") - copies).alias("share"))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, class, u, row): row holds all columns of docs."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NON_SPACE)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), uniform(F.col("doc_id"), seed).alias("u"), F.struct("*").alias("row"))
    return rows.withColumn("class", F.length(F.bin(F.col("size") + 1)) - 1)


def _odds(share: Column) -> Column:
    """What documents are ranked by; null where no sample is drawn."""
    return F.when((share > 0) & (share < 1), (F.col("u") / (1 - F.col("u"))) / (share / (1 - share)))


def _taken(me: Column, rounds: Column) -> Column:
    """Whether a document (q, doc_id, size) is in the sample of one of the rounds."""

    def within(r: Column) -> Column:
        return (r["start"].isNull() | (me >= r["start"])) & (r["end"].isNull() | (me < r["end"])) & (me["size"] <= r["room"])

    return me["q"].isNotNull() & F.coalesce(F.exists(rounds, within), F.lit(False))


def _round(drawn: DataFrame, opened: DataFrame) -> DataFrame:
    """opened (src, start, room) with end and gap: of each source's documents from start on that are no larger than
    room, the first at which the sum is above room, null if there is none, and what those before it leave of room."""
    mine = opened.withColumnRenamed("src", "own")
    rows = drawn.join(mine, F.col("src").eqNullSafe(F.col("own"))).filter((F.col("start").isNull() | (F.col("me") >= F.col("start"))) & (F.col("size") <= F.col("room")))
    sums = rows.groupBy("src", "slice", "room").agg(F.sum("size").alias("in_slice"))
    ahead = F.coalesce(F.sum("in_slice").over(Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = written(sums.withColumn("ahead", ahead), "mix-slices")
    last = sums.filter("ahead <= room and ahead + in_slice > room").groupBy("src").agg(F.min(F.struct("slice", "ahead")).alias("x")).select("src", "x.slice", "x.ahead").toDF("at_src", "at_slice", "ahead")
    inner = Window.partitionBy("src").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.join(last, F.col("src").eqNullSafe(F.col("at_src")) & (F.col("slice") == F.col("at_slice")))
    here = here.withColumn("upto", F.col("ahead") + F.sum("size").over(inner))
    over = F.col("upto") > F.col("room")
    # sizes are not negative, so the running sum stays above once it is
    ends = here.groupBy("src").agg(F.min(F.when(over, F.col("me"))).alias("end"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.max("ahead")).alias("got"))
    totals = sums.groupBy("src").agg(F.sum("in_slice").alias("all"))
    out = opened.join(ends.withColumnRenamed("src", "end_src"), F.col("src").eqNullSafe(F.col("end_src")), "left").join(totals.withColumnRenamed("src", "all_src"), F.col("src").eqNullSafe(F.col("all_src")), "left")
    return out.select("src", "start", "room", "end", (F.col("room") - F.coalesce("got", "all", F.lit(0))).alias("gap"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """A row for each source: source, source_size, target, classes (map from class to copies and share), rounds, fill.

    What is left of a target beside the certain copies is a fixed-size sample, the size counted in words: documents are
    ranked by the odds of a uniform number divided by the odds of their inclusion, which differ by their class, and taken
    in this order where they fit; those that do not are passed over. Each round takes the documents from `start` up to
    `end`, the first that does not fit, of those no larger than the `room` it began with; rounds go on until none fits. Then
    `fill`, that one of the source's other documents, is added whose size comes nearest to the gap, if it lessens it. A hot
    source is never in one task: ranks are summed over about sqrt(n) slices of each source first, and only the slice in
    which the room is used up is ordered.
    """
    sized = written(_sized(docs, seed).drop("row"), "mix-sizes")
    sources = written(source_targets(sized, weights, max_repeats), "mix-sources")
    classes = written(class_shares(sized, sources, max_repeats), "mix-classes")
    entry = F.struct("class", F.struct("copies", "share"))
    by_source = classes.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("copies") * F.col("words")).alias("certain"), F.map_from_entries(F.collect_list(entry)).alias("classes"))
    sources = written(sources.join(by_source, F.col("source").eqNullSafe(F.col("of"))).withColumnRenamed("source", "src").withColumn("rest", F.col("target") - F.col("certain")).drop("of", "certain"), "mix-shares")
    rows = sized.join(sources.select("src", "classes", "n_docs"), F.col("source").eqNullSafe(F.col("src"))).withColumn("q", _odds(F.col("classes")[F.col("class")]["share"]))
    # about a source's sqrt(n) slices in the order of q: a class's documents rank alike, so slices are those of the odds' rank
    slices = F.floor(F.col("q") / (1 + F.col("q")) * F.ceil(F.sqrt("n_docs")))
    drawn = rows.filter("q is not null").select("src", "doc_id", "size", "q", slices.alias("slice"), F.struct("q", "doc_id", "size").alias("me"))

    opened = sources.filter("rest >= 1").select("src", F.lit(None).cast(drawn.schema["me"].dataType).alias("start"), F.col("rest").alias("room"))
    done = []
    while not opened.isEmpty():
        done.append(written(_round(drawn, opened), "mix-round").withColumn("nth", F.lit(len(done))))
        opened = done[-1].filter("end is not null and gap >= 1").select("src", F.col("end").alias("start"), F.col("gap").alias("room"))
    if not done:
        done = [_round(drawn, opened).withColumn("nth", F.lit(0))]
    rounds = done[0]
    for more in done[1:]:
        rounds = rounds.unionByName(more)
    rounds = rounds.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("nth", "start", "end", "room"))).alias("rounds"), F.max_by("gap", "nth").alias("gap"))
    rounds = written(rounds.withColumnRenamed("src", "round_src"), "mix-rounds")
    past = drawn.join(rounds, F.col("src").eqNullSafe(F.col("round_src"))).filter(~_taken(F.col("me"), F.col("rounds")))
    fill = past.groupBy("src", "gap").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), "q", "doc_id", "size")).alias("f"))
    fill = fill.filter("f.miss < gap").select(F.col("src").alias("fill_src"), F.struct("f.q", "f.doc_id", "f.size").alias("fill"))
    plan = sources.join(rounds, F.col("src").eqNullSafe(F.col("round_src")), "left").join(fill, F.col("src").eqNullSafe(F.col("fill_src")), "left")
    return written(plan.select(F.col("src").alias("source"), "source_size", "target", "classes", "rounds", "fill"), "mix-plan")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies: how often the mix takes each row.

    mix_size is the number of words (null text: 0). Each document gets the whole copies that are certain for its source and
    class of size, and one more if the plan's sample has it. Documents are not shuffled: the plan has a row for each
    source. A null source is a source; repeated rows count each, and are all taken or none; a null doc_id draws the
    number of the empty string; an empty table gives no rows; columns of the new names are replaced, no other name clashes.
    """
    plan = mix_plan(docs, weights, max_repeats, seed).select(F.struct("*").alias("plan"))
    rows = _sized(docs, seed).join(plan, F.col("source").eqNullSafe(F.col("plan.source")))
    odds = F.col("plan.classes")[F.col("class")]
    me = F.struct(_odds(odds["share"]).alias("q"), "doc_id", "size")
    sampled = _taken(me, F.col("plan.rounds")) | (me["q"].isNotNull() & F.coalesce(me.eqNullSafe(F.col("plan.fill")), F.lit(False)))
    copies = odds["copies"] + F.coalesce(sampled, F.lit(False)).cast("long")
    new = {"mix_size": F.col("size"), "mix_source_size": F.col("plan.source_size"), "mix_target": F.col("plan.target"), "mix_copies": copies}
    rows = rows.select("row", F.struct(*(c.alias(n) for n, c in new.items())).alias("new"))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in new), "new.*")


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken)


OP8_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, w * max(level) OVER ()) AS target FROM levels),
classes AS (SELECT source, length(bin(size + 1)) - 1 AS class, sum(size)::BIGINT AS words FROM sized GROUP BY source, class),
class_levels AS (
  SELECT c.source, c.class, c.words, t.target,
         CASE WHEN sum(words * (class + 1)) OVER rest = 0 THEN NULL
              ELSE (t.target - coalesce(sum(words * 3) OVER ahead, 0)) / (sum(words * (class + 1)) OVER rest)::DOUBLE END AS level
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
  WINDOW ahead AS (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
expected AS (SELECT *, least(3.0::DOUBLE, (class + 1) * coalesce(max(level) OVER (PARTITION BY source), 0)) AS expected FROM class_levels),
shares AS (SELECT source, class, words, target, floor(expected)::BIGINT AS copies, expected - floor(expected) AS share FROM expected),
rests AS (SELECT source, any_value(target) - sum(copies * words)::BIGINT AS rest FROM shares GROUP BY source),
docs AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, h.copies,
         CASE WHEN h.share > 0 AND h.share < 1 THEN (s.u / (1 - s.u)) / (h.share / (1 - h.share)) END AS q
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
  JOIN shares h ON s.source IS NOT DISTINCT FROM h.source AND h.class = length(bin(s.size + 1)) - 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q, doc_id, size) AS nth FROM docs WHERE q IS NOT NULL),
walk AS (  -- one document of each source at a time: it is taken if it fits
  SELECT source, 0::BIGINT AS nth, rest AS room, false AS took FROM rests WHERE rest >= 1
  UNION ALL
  SELECT w.source, r.nth, CASE WHEN r.size <= w.room THEN w.room - r.size ELSE w.room END, r.size <= w.room
  FROM walk w JOIN ranked r ON r.source IS NOT DISTINCT FROM w.source AND r.nth = w.nth + 1),
gaps AS (SELECT source, min(room) AS gap FROM walk GROUP BY source),
fills AS (
  SELECT r.source, r.nth, row_number() OVER (PARTITION BY r.source ORDER BY abs(g.gap - r.size), r.q, r.doc_id, r.size) AS place, abs(g.gap - r.size) < g.gap AS good
  FROM ranked r JOIN walk w ON w.source IS NOT DISTINCT FROM r.source AND w.nth = r.nth AND NOT w.took JOIN gaps g ON g.source IS NOT DISTINCT FROM r.source),
taken AS (
  SELECT r.doc_id, r.source FROM ranked r JOIN walk w ON w.source IS NOT DISTINCT FROM r.source AND w.nth = r.nth WHERE w.took
  UNION ALL SELECT r.doc_id, r.source FROM ranked r JOIN fills f ON f.source IS NOT DISTINCT FROM r.source AND f.nth = r.nth WHERE f.place = 1 AND f.good)
SELECT d.doc_id, d.size, d.source_size, d.target, d.size * (d.copies + (t.doc_id IS NOT NULL)::BIGINT) AS taken
FROM docs d LEFT JOIN taken t ON d.doc_id = t.doc_id
"""
