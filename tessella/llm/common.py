"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row is held out when crc32 of its doc_id as text leaves this remainder.
FOLDS, HELD_OUT = 3, 1

#: Words are runs without ASCII white space.
NON_SPACE = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, *more): a null text reads as empty; no other column is looked at, so none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def held_out(c: Column) -> Column:
    """True for the held-out fold. A null id is never held out."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master, where it may be unset, one made here."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("tessella.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[\d*]+(,\d+)?\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("tessella.shared.dir", found)
    return found.rstrip("/")


#: Rows that a task hands to Python at once: whole texts are long, and 10,000 of them are held several times over by both sides.
BATCH_ROWS, BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


#: With it, a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def small_batches(spark: SparkSession):
    """While it lasts, batches between Spark and Python have BATCH_ROWS rows at most; fewer where the session says so."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(BATCH_ROWS if int(before) <= 0 else min(BATCH_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@contextmanager
def shuffles_cleared(spark: SparkSession):
    """While it lasts, a query that ends takes its shuffle files with it: for plans that run once, as those that are written."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there, lost executors recompute
    nothing above it, and Spark knows the size of what it reads, so its own size check decides on broadcasts. What a caller
    does not forget() is left to the folder's owner to clear."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark), shuffles_cleared(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes the files of a written table behind its last read: tables made from it have to be written themselves."""
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Words of 64 bits of a bitmap at least and at most: 16 MB, whatever the input.
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 21


def _in_bitmap(rows: DataFrame, ids: DataFrame, key: str, mark: str) -> DataFrame:
    """rows with column `mark`: whether a row's key may be among ids' keys.

    One bit stands for each hash. The bitmap follows the number of ids up to MOST_WORDS rows, so it is broadcast; where
    ids are so many that it fills up, more rows may be among them and the join that follows reads more.
    """
    own = mark.removesuffix("maybe")
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << max(0, (ids.count() // 4).bit_length())))

    def word(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(words))

    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c, F.lit("bit")), F.lit(64)).cast("int")

    bits = ids.select(word(F.col(key)).alias(f"{own}w"), F.shiftleft(F.lit(1).cast("long"), 0).alias("one"), bit(F.col(key)).alias("b"))
    bits = bits.select(f"{own}w", F.expr("shiftleft(one, b)").alias("m")).groupBy(f"{own}w").agg(F.bit_or("m").alias(f"{own}m"))
    out = rows.join(F.broadcast(bits), word(rows[key]) == bits[f"{own}w"], "left")
    return out.withColumn(mark, F.coalesce(F.getbit(F.col(f"{own}m"), bit(rows[key])) == 1, F.lit(False))).drop(f"{own}m", f"{own}w")


def _mark() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}maybe"


def maybe_among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among ids' keys: no row of ids is lost, few others stay while ids are few. ids is counted
    first, so it should be a written table."""
    return _in_bitmap(rows, ids, key, mark := _mark()).filter(F.col(mark)).drop(mark)


def split_by(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is not among ids' keys for certain, and the others."""
    marked = _in_bitmap(rows, ids, key, mark := _mark())
    return marked.filter(~F.col(mark)).drop(mark), marked.filter(F.col(mark)).drop(mark)


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not among ids' keys (a null key never is). Only rows that may be are shuffled."""
    others, rest = split_by(rows, ids, key)
    rest = rest.join(ids.select(key).distinct(), key, "left_anti")
    return others.unionByName(rest.select(rows.columns))


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that name a row by its doc_id and its text, so rows of one doc_id with different texts are told apart."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))
