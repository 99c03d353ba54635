"""Tables that are changed in place, in buckets by key: upserts from streams, children replaced by parent, rows appended once.

A change reads and writes the buckets that it touches and no others. KeyedTable swaps a manifest when all files of a change are
there, so readers see it whole or not at all, and names the batch that it came from, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.relational import top_k
from tessella.sources.shared import written


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at, jvm


@dataclass(frozen=True)
class KeyedTable:
    """A table at a path whose rows have unique keys. Each bucket is one folder of files; the manifest says which, and which batch
    was the last one."""

    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int = 64

    def manifest(self) -> dict:
        files, at, _ = _files(self.spark, f"{self.path}/manifest.json")
        if not files.exists(at):
            return {"batch": -1, "schema": None, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).first().value)

    def _swap(self, manifest: dict) -> None:
        files, at, jvm = _files(self.spark, f"{self.path}/manifest-{uuid.uuid4().hex}.tmp")
        out = files.create(at)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(at, jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json"), options)

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        by_folder: dict[str, list[int]] = {}
        for b, folder in manifest["folders"].items():
            if only is None or int(b) in only:
                by_folder.setdefault(folder, []).append(int(b))
        out = None
        for folder, own in sorted(by_folder.items()):
            rows = self.spark.read.schema(f"{manifest['schema']}, _bucket int").parquet(f"{self.path}/{folder}").filter(F.col("_bucket").isin(own)).drop("_bucket")
            out = rows if out is None else out.unionByName(rows)
        return out

    def read(self) -> DataFrame | None:
        """The rows after the last change that was finished; None before the first."""
        return self._rows(self.manifest())

    def upsert(self, delta: DataFrame, batch: int, order: list[Column] | None = None, merge: dict[str, Callable[[Column, Column], Column]] | None = None, before_swap: Callable[[], None] = lambda: None) -> bool:
        """Puts delta's rows in their keys' places, and returns whether anything was done: a batch that the manifest has is passed over.

        Of rows with one key the first by order stays (keys are unique without). merge: how a column comes from the old value (null
        for a new key) and the new one. version counts how often a key was put. before_swap runs when all files are written."""
        held = self.manifest()
        if batch <= held["batch"]:
            return False
        delta = delta if order is None else top_k(delta, self.keys, order)
        delta = written(delta.withColumn("_bucket", bucket(self.keys, self.buckets)), "upsert-delta")
        touched = [r._bucket for r in delta.select("_bucket").distinct().collect()]  # as many as buckets at most
        old = self._rows(held, touched)
        names = [c for c in delta.columns if c != "_bucket"]
        if old is None:
            new = delta.select(*(merge[c](F.lit(None).cast(delta.schema[c].dataType), F.col(c)).alias(c) if merge and c in merge else c for c in names), F.lit(1).alias("version"), "_bucket")
        else:
            was = old.select(*self.keys, F.struct(*old.columns).alias("_old"))
            both = was.join(delta.select(*self.keys, F.struct(*names).alias("_new")), self.keys, "full")

            def value(c: str) -> Column:
                put = merge[c](F.col(f"_old.{c}"), F.col(f"_new.{c}")) if merge and c in merge else F.col(f"_new.{c}")
                return F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(put).alias(c)

            version = F.coalesce("_old.version", F.lit(0)) + F.col("_new").isNotNull().cast("int")
            new = both.select(*map(value, names), version.alias("version")).withColumn("_bucket", bucket(self.keys, self.buckets))
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        before_swap()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.drop("_bucket").schema)
        self._swap({"batch": batch, "schema": schema, "folders": held["folders"] | {str(b): folder for b in touched}})
        return True


def upsert_stream(rows: DataFrame, table: KeyedTable, prepare: Callable[[DataFrame], DataFrame], log: str, **how) -> None:
    """Upserts each batch of a stream, prepared, until the stream's input is used up."""
    rows.writeStream.foreachBatch(lambda batch, n: table.upsert(prepare(batch), n, **how) and None).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def write_children(rows: DataFrame, path: str, parent: str, buckets: int = 64) -> None:
    """A table of children, partitioned by a bucket of their parent."""
    rows.withColumn("_bucket", bucket([parent], buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)


def _touched(spark: SparkSession, path: str, keyed: DataFrame) -> DataFrame:
    own = [r._bucket for r in keyed.select("_bucket").distinct().collect()]  # as many as buckets at most
    return spark.read.parquet(path).filter(F.col("_bucket").isin(own))


def replace_children(delta: DataFrame, path: str, parent: str, buckets: int = 64) -> None:
    """Children of any parent that delta names go, and delta's come: only partitions that hold such parents are written anew. The new
    partitions are written aside before any old one is replaced."""
    spark = delta.sparkSession
    new = written(delta.withColumn("_bucket", bucket([parent], buckets)), "replace-delta")
    rest = _touched(spark, path, new).join(new.select(parent).distinct(), parent, "left_anti")
    whole = written(rest.unionByName(new), "replace-whole")
    whole.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def append_missing(rows: DataFrame, path: str, keys: list[str], order: list[Column], buckets: int = 64) -> None:
    """Appends rows whose key the table (partitioned by a bucket of its keys) does not have, the first of each key by order."""
    spark = rows.sparkSession
    new = written(top_k(rows, keys, order).withColumn("_bucket", bucket(keys, buckets)), "append-new")
    missing = new.join(_touched(spark, path, new).select(*keys), keys, "left_anti")
    written(missing, "append-missing").repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(path)
