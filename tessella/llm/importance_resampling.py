"""Importance resampling towards a target distribution: hashed n-gram features, counted by DuckDB within each partition.

Each task runs DuckDB over its texts: SQL splits and unnests the words, windows make the n-grams, a registered zlib CRC
function gives their buckets, and every text becomes one row of its buckets and counts. The same pass sums the task's
buckets, so that what has to be merged is one row a task. Spark writes these rows to Parquet, merges the tasks' sums, and
scores the texts from their own rows: no text is read twice and no row of a text is shuffled. A draw without replacement adds a
Gumbel number to each weight and takes the highest; ranks come from ranges of the scores, each ordered by itself.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, UPPER, table, texts, written

#: Characters that DuckDB takes at once; longer texts are cut between words and their pieces' counts added.
CHARS = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_WORD = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Features:
    """Runs of 1 to n words, hashed into buckets."""

    n: int = 1
    buckets: int = 10_000


def features_sql(f: Features) -> str:
    """(nth, bucket, n) of a table pieces (nth, skip, text); bucket -1 has the number of words. The first `skip` words of a
    piece stand in the piece before it too, so n-grams that end in them are not counted again."""
    grams = ["SELECT nth, word AS gram FROM words WHERE pos > skip"]
    for k in range(2, f.n + 1):
        run = " || ' ' || ".join(f"lag(word, {j}) OVER w" if j else "word" for j in reversed(range(k)))
        grams.append(f"SELECT nth, gram FROM (SELECT nth, pos, skip, {run} AS gram FROM words WINDOW w AS (PARTITION BY nth ORDER BY pos)) WHERE gram IS NOT NULL AND pos > skip")
    return f"""
        WITH lists AS (SELECT nth, skip, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM pieces),
        words AS (SELECT nth, skip, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists),
        counted AS (SELECT nth, gram, count(*) AS n FROM ({" UNION ALL ".join(grams)}) GROUP BY nth, gram),
        hashed AS (SELECT gram, crc(gram) % {f.buckets} AS bucket FROM (SELECT DISTINCT gram FROM counted))
        SELECT nth, bucket::INTEGER AS bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (gram) GROUP BY nth, bucket
        UNION ALL SELECT nth, -1, len(ws) - skip FROM lists ORDER BY nth, bucket"""


def pieces(text: str, n: int, chars: int = CHARS) -> Iterator[tuple[int, str]]:
    """(skip, piece) of a text: it is cut between words, and each piece begins with the n - 1 words before it."""
    at, tail = 0, []
    while at < len(text) or not at:
        found = _NO_WORD.search(text, at + chars) if at + chars < len(text) else None
        end = found.start() + 1 if found else len(text)
        own = text[at:end]
        yield len(tail), " ".join([*tail, own]) if tail else own
        at = max(end, 1)
        if n > 1 and end < len(text):
            tail = [*tail, *_WORD.findall(own)][-(n - 1) :]


def _chunks(batch: list[str], n: int) -> Iterator[list[tuple[int, int, str]]]:
    """(number of the text, skip, piece), about CHARS characters at a time."""
    part, held = [], 0
    for nth, text in enumerate(batch):
        for skip, piece in pieces(text, n):
            part.append((nth, skip, piece))
            held += len(piece)
            if held >= CHARS:
                yield part
                part, held = [], 0
    if part:
        yield part


ROWS = "summed boolean, doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


def bucket_rows(docs: DataFrame, f: Features) -> DataFrame:
    """ROWS: a row for each row of docs with its words, features and buckets, and for each task one (summed) of all its buckets."""
    sql = features_sql(f)
    names = ["summed", "doc_id", "n_words", "n_features", "buckets", "counts"]

    def counted(con, batch: list[str]) -> tuple[np.ndarray, ...]:
        """Number of the text, bucket and count, ordered by the first two; bucket -1 has the number of words."""
        parts = []
        for chunk in _chunks(batch, f.n):
            nth, skip, text = zip(*chunk, strict=True)
            con.register("pieces", pa.table({"nth": pa.array(nth, pa.int64()), "skip": pa.array(skip, pa.int64()), "text": pa.array(text, pa.string())}))
            found = con.execute(sql).fetchnumpy()
            con.unregister("pieces")
            parts.append([np.asarray(found[c]).astype(np.int64) for c in ("nth", "bucket", "n")])
        nth, bucket, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((bucket, nth))  # pieces of one text may repeat its buckets
        nth, bucket, n = nth[order], bucket[order], n[order]
        start = np.flatnonzero(np.r_[True, (nth[1:] != nth[:-1]) | (bucket[1:] != bucket[:-1])])
        return nth[start], bucket[start], np.add.reduceat(n, start)

    def arrays(offsets: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (pa.array(bucket, pa.int32()), pa.array(n, pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        con.create_function("crc", lambda word: zlib.crc32(word.encode()), ["VARCHAR"], "UINTEGER")
        sums = np.zeros(f.buckets, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            nth, bucket, n = counted(con, batch.column("text").to_pylist())
            own = bucket >= 0
            words = n[~own]
            sums += np.bincount(bucket[own], n[own], f.buckets).astype(np.int64)
            offsets = np.searchsorted(nth[own], np.arange(len(batch) + 1))
            total = np.r_[0, np.cumsum(n[own])][offsets]
            columns = [pa.array(np.zeros(len(batch), bool)), batch.column("doc_id"), pa.array(words), pa.array(np.diff(total)), *arrays(offsets, bucket[own], n[own])]
            yield pa.RecordBatch.from_arrays(columns, names)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([None], pa.int64()), pa.array([0]), pa.array([int(sums.sum())]), *arrays(np.array([0, len(at)]), at, sums[at])], names)

    return texts(docs).mapInArrow(run, ROWS)


def _merged(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name) of all tasks."""
    pairs = rows.filter("summed").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Each bucket's gain: the log ratio of its share of the target's features and of the corpus's, both with one added for each
    bucket, in thousandths, rounded down. As many numbers as buckets, so they may be on the driver."""
    both = _merged(corpus, "s").join(_merged(target, "t"), "bucket", "full").na.fill(0).collect()
    s, t = {r.bucket: r.s for r in both}, {r.bucket: r.t for r in both}
    big_s, big_t = (float(sum(x.values()) + buckets) for x in (s, t))
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * big_s / ((s.get(b, 0) + 1.0) * big_t))) for b in range(buckets)]


def gumbel(doc_id: Column, seed: str) -> Column:
    """A Gumbel number in thousandths, by 32 bits of a digest of seed and id; a null id is an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, f: Features = Features(), least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs. target: a table with a column text.

    Of the rows with least_words words at least, percent in a hundred (rounded down) with the highest scores are drawn and
    ranked from 1, ties to the smaller doc_id, null ones last, then by weight and features; all others have no rank. Null and
    empty texts have no features and a weight of 0; repeated rows are each ranked; texts of any length are counted whole; an empty
    table gives no rows, an empty target prefers rare features; other columns are not looked at.
    """
    corpus = written(bucket_rows(docs, f), "resample-buckets")
    wanted = written(bucket_rows(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), f), "resample-target")
    by_bucket = F.split(F.lit(",".join(map(str, gains(corpus, wanted, f.buckets)))), ",").cast("array<long>")
    parts = F.zip_with("buckets", "counts", lambda b, n: F.get(by_bucket, b) * n)
    weight = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = corpus.filter("not summed").select("doc_id", "n_words", "n_features", weight.alias("weight"))
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    ranges = rows.filter(F.col("n_words") >= least_words).repartitionByRange(*order)
    ranges = written(ranges.withColumn("part", F.spark_partition_id()), "resample-ranges")  # written, so that ranges stay as they are
    sizes = sorted((r.part, r.n) for r in ranges.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts = np.r_[0, np.cumsum([n for _, n in sizes])]
    drawn = percent * int(starts[-1]) // 100
    # a row for each range: as many as the shuffle has partitions
    ahead = ranges.sparkSession.createDataFrame([(p, int(a)) for (p, _), a in zip(sizes, starts[:-1], strict=True)], "at int, ahead long")
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranges.join(F.broadcast(ahead), F.col("part") == F.col("at")).withColumn("rank", rank.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score"]
    rest = rows.filter(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, "rank").unionByName(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, f=Features(1, 10_000), least_words=20, seed="2024")


OP13_SQL = rf"""
WITH tab AS (  -- the table of CRC-32
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS word FROM docs),
aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS word FROM benchmark),
raw AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM (SELECT word FROM words UNION ALL SELECT word FROM aims))),
bytes AS (SELECT word, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, (2 * k + 1)::BIGINT, 2))::BIGINT) AS b FROM raw),
hashed AS (SELECT word, xor(4294967295, list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::BIGINT AS big_s, coalesce((SELECT sum(t) FROM t), 0)::BIGINT AS big_t),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), sums),
weights AS (SELECT rid, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (rid)),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranked) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (rid)
"""
