"""Exact dedup with a log-structured merge index of text digests.

Every task fills memtables with (digest, kept id, rows) and flushes each as sorted runs, one for each range of the
digest space and with a Bloom filter of as many bits as its entries need. A hot text is one entry of a memtable, however
many rows hold it. Compaction merges the smallest two runs of a range until one is left: digests that the other run's
filter does not know pass as they are, the others are merged. Digests
that hold several rows are hits, and every hit's texts are compared byte by byte; rows of a digest under which
texts differ are grouped anew by the texts themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import maybe_among, row_id, split_by, texts, written

NULL_ID = {"largest": -(2**63), "smallest": 2**63 - 1}
WIDTH = 32


class Filter:
    """A Bloom filter over digests; filters of equal size can be joined."""

    def __init__(self, bits: int, raw: bytes | None = None):
        self.set = np.zeros(bits >> 3, np.uint8) if raw is None else np.frombuffer(raw, np.uint8).copy()
        self.mask = np.uint64(bits - 1)

    def _at(self, digests: np.ndarray) -> Iterator[np.ndarray]:
        words = digests.view(">u8").reshape(len(digests), -1).astype(np.uint64)
        for k in range(3):  # a digest's parts are independent hashes
            yield words[:, -1 - k % words.shape[1]] >> np.uint64(7 * (k // words.shape[1])) & self.mask

    def add(self, digests: np.ndarray) -> None:
        for at in self._at(digests):
            np.bitwise_or.at(self.set, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def knows(self, digests: np.ndarray) -> np.ndarray:
        out = np.ones(len(digests), bool)
        for at in self._at(digests):
            out &= (self.set[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def bits_for(entries: int) -> int:
    """Eight bits an entry at least, in powers of two."""
    return max(64, 1 << (8 * int(entries) - 1).bit_length())


def _merged(digests: np.ndarray, ids: np.ndarray, rows: np.ndarray, largest: bool) -> tuple[np.ndarray, ...]:
    """Sorted digests without repeats; of a digest's entries the ids' extreme and the rows' sum."""
    order = np.lexsort(np.ascontiguousarray(digests).view(">u8").T[::-1])
    digests, ids, rows = digests[order], ids[order], rows[order]
    start = np.flatnonzero(np.r_[True, (digests[1:] != digests[:-1]).any(1)])
    return digests[start], (np.maximum if largest else np.minimum).reduceat(ids, start), np.add.reduceat(rows, start)


RUNS = "range_id int, run string, digests binary, ids binary, n_rows binary, filter binary"


def flush_runs(digests: DataFrame, ranges: int, keep: str, memtable_rows: int = 200_000) -> DataFrame:
    """digests (doc_id, digest) to sorted runs: one row for each flushed memtable and range of the digest space."""
    largest, null_id = keep == "largest", NULL_ID[keep]

    def flush(parts: list[pd.DataFrame], run: str) -> Iterator[dict]:
        table = pd.concat(parts)
        d = np.frombuffer(b"".join(table.digest), np.uint8).reshape(-1, WIDTH)
        d, ids, rows = _merged(d, table.doc_id.to_numpy(np.int64), np.ones(len(table), np.int64), largest)
        at = d[:, :4].copy().view(">u4").ravel().astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)
        for start, end in zip(s := np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), [*s[1:], len(at)], strict=True):
            f = Filter(bits_for(end - start))
            f.add(d[start:end].copy())
            yield {"range_id": int(at[start]), "run": run, "digests": d[start:end].tobytes(), "ids": ids[start:end].tobytes(), "n_rows": rows[start:end].tobytes(), "filter": f.set.tobytes()}

    def memtables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts, held, n = [], 0, 0
        for batch in batches:
            parts.append(batch)
            held += len(batch)
            if held >= memtable_rows:
                yield pd.DataFrame(flush(parts, f"{TaskContext.get().partitionId()}-{n}"))
                parts, held, n = [], 0, n + 1
        if held:
            yield pd.DataFrame(flush(parts, f"{TaskContext.get().partitionId()}-{n}"))

    rows = digests.select(F.coalesce("doc_id", F.lit(null_id)).alias("doc_id"), "digest")
    return rows.mapInPandas(memtables, RUNS)


def _compacted(runs: list[tuple], largest: bool) -> tuple[np.ndarray, ...]:
    """One run of several: the smallest two are merged until one is left. What the other's filter does not know passes as
    it is."""
    runs = [(*r, i) for i, r in enumerate(runs)]
    heap = [(len(r[0]), r[-1]) for r in runs]
    held, n = {r[-1]: r[:-1] for r in runs}, len(runs)
    heapq.heapify(heap)
    while len(heap) > 1:
        (*a, fa), (*b, fb) = (held.pop(heapq.heappop(heap)[1]) for _ in range(2))
        known = fb.knows(a[0].copy()), fa.knows(b[0].copy())
        parts = [[x[~k] for x in run] for run, k in zip((a, b), known, strict=True)]
        if known[0].any() or known[1].any():
            parts.append(_merged(*(np.concatenate([x[known[0]], y[known[1]]]) for x, y in zip(a, b, strict=True)), largest))
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        f = Filter(bits_for(len(merged[0])))
        f.add(merged[0].copy())
        held[n] = (*merged, f)
        heapq.heappush(heap, (len(merged[0]), n))
        n += 1
    return held[heap[0][1]][:3]


def compact(runs: DataFrame, keep: str) -> DataFrame:
    """Merges the runs of each range to (digest, keep_id, group_size, hit). hit: another row holds the digest."""
    largest, null_id = keep == "largest", NULL_ID[keep]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        each = []
        for r in group.sort_values("run").itertuples():
            d = np.frombuffer(r.digests, np.uint8).reshape(-1, WIDTH)
            each.append((d, np.frombuffer(r.ids, np.int64), np.frombuffer(r.n_rows, np.int64), Filter(len(r.filter) * 8, r.filter)))
        d, ids, rows = _compacted(each, largest)
        return pd.DataFrame({"digest": [x.tobytes() for x in d], "keep_id": pd.Series(ids).astype("Int64").mask(ids == null_id), "group_size": rows, "hit": rows > 1})

    return runs.groupBy("range_id").applyInPandas(merge, "digest binary, keep_id long, group_size long, hit boolean")


def exact_dedup(docs: DataFrame, keep: str = "smallest", digest=None, range_rows: int = 500_000, memtable_rows: int = 200_000) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, row_id (64 bits of doc_id and text).

    Rows whose texts are identical form a group; a null text counts as empty. The row with the smallest (largest)
    doc_id stays. Repeated rows with one doc_id count each in group_size and share their flag. A null doc_id is
    kept only where its whole group has none; keep_id is null then. An empty table gives no rows. Other columns
    of docs are not looked at. digest: a function from the text's column to 32 bytes, SHA-256 if None.

    A range of the digest space has range_rows rows about. Rows whose digest no other row has are not shuffled.
    """
    sha = F.sha2("text", 256)
    rows = texts(docs).withColumn("row_id", row_id()).withColumn("text_sha256", sha).withColumn("digest", F.unhex("text_sha256") if digest is None else digest(F.col("text")))
    ids = rows.select("doc_id", "digest")
    ranges = max(32, -(-docs.count() // range_rows))
    index = written(compact(flush_runs(ids, ranges, keep, memtable_rows), keep), "dedup-index")
    hits = written(index.filter("hit").drop("hit"), "dedup-hits")
    names = ["doc_id", "row_id", "text_sha256", "digest"]
    lone, met = split_by(rows.select(names), hits, "digest")
    # byte by byte: texts of a digest are as one only if the least is the greatest; a hot digest is a row for each task
    ends = maybe_among(rows.select("digest", "text"), hits, "digest").groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.count("*").alias("n"))
    differing = written(ends.filter("n > 1 and lo != hi").select("digest"), "dedup-differing")
    met = met.join(hits, "digest", "left")
    met = met.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    if not differing.isEmpty():
        best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
        apart = rows.join(differing, "digest", "left_semi")
        groups = apart.groupBy("digest", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        met = met.join(differing, "digest", "left_anti").unionByName(apart.join(groups, ["digest", "text"]).drop("text"))
    out = met.unionByName(lone.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "row_id")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest").drop("row_id")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
