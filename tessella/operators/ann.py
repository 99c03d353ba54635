"""Approximate nearest neighbours by cosine: an inverted file of product-quantised residuals.

Every vector belongs to the list of its nearest centroid; what is left of it is a byte for each of its parts, the nearest code
of that part. Centroids and codes are fitted on a bounded sample. The index is a table partitioned by list, so that a search
reads only the lists it probes. Queries meet a list block by block; what each block finds by its codes is cut to `refine` for
each query before and after it is shuffled, and these are ranked by their exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import cosine
from tessella.operators.relational import top_k
from tessella.sources.shared import written

#: Rows of a list, and queries, that meet in one task at most (about).
BLOCK_ROWS, BLOCK_QUERIES = 50_000, 4_096
#: Scores that a task has in memory at a time, and rows of probed lists that it puts out at a time.
CELLS, PROBED_ROWS = 1 << 22, 1 << 15
#: Lists at most, whatever the table's size: their sizes and centroids fit a driver.
MOST_LISTS = 1 << 16


@dataclass(frozen=True)
class IvfPq:
    """lists: None for the square root of the rows. parts: of a vector, a byte each. sample: vectors that centroids and codes are
    fitted on at most, taken by a hash of their ids. codes: for each part. target: of the sample's neighbours that a search with
    the index's own number of probes is to find in the lists it reads; few for vectors in clusters, most for vectors without any."""

    lists: int | None = None
    parts: int = 32
    codes: int = 256
    sample: int = 50_000
    steps: int = 15
    target: float = 0.98


@dataclass(frozen=True)
class Index:
    """rows: (id, codes, list), partitioned by list. centroids: (lists, dimensions). codebooks: (parts, codes, dimensions of a part).
    probes: as many lists as hold `target` of the nearest neighbours within the sample."""

    rows: DataFrame
    centroids: np.ndarray
    codebooks: np.ndarray
    probes: int


def _units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one: a missing, empty or zero vector, or one with a missing number, has none."""
    good = np.array([v is not None and len(v) > 0 and bool(np.isfinite(n := np.linalg.norm(np.asarray(v, float)))) and n > 0 for v in vectors], bool)
    rows = [np.asarray(v, np.float32) for v, g in zip(vectors, good, strict=True) if g]
    x = np.stack(rows) if rows else np.zeros((0, 0), np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x, good


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, min(4096, CELLS // len(centres)))
    out = [((centres**2).sum(1) - 2 * x[at : at + step] @ centres.T).argmin(1) for at in range(0, len(x), step)]
    return np.concatenate(out) if out else np.zeros(0, int)


def _centres(x: np.ndarray, k: int, steps: int, seed: int = 0) -> np.ndarray:
    """k-means from k of the points; a centre without points stays where it is."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(steps):
        of = _nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        sums = np.stack([np.bincount(of, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres.astype(np.float32)


def _probes(x: np.ndarray, centroids: np.ndarray, target: float, queries: int = 500, k: int = 10) -> int:
    """The fewest lists, nearest first, that hold `target` of the k nearest neighbours of the sample's first vectors."""
    of, q = _nearest(x, centroids), x[:queries]
    near = np.argsort(-(q @ x.T) + 4 * np.eye(len(q), len(x)), 1)[:, :k]  # not itself
    order = np.argsort((centroids**2).sum(1) - 2 * q @ centroids.T, 1, kind="stable")
    places = np.sort(np.argsort(order, 1)[np.arange(len(q))[:, None], of[near]].ravel())
    return int(places[min(len(places) - 1, math.ceil(target * len(places)))]) + 1


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, dimensions of a part); the last part is filled up with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width).transpose(1, 0, 2)


def build(vectors: DataFrame, spec: IvfPq = IvfPq(), key: str = "id", vector: str = "embedding") -> Index:
    """Indexes every row of vectors that has a direction; others (null, zero) are in no list. All vectors have one length; without
    any the index is empty. A list that holds most rows is written by several tasks."""
    sample = vectors.filter(F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("at")).orderBy("at").limit(spec.sample).toPandas()
    x, _ = _units(sample[vector])
    if not len(x):
        x = np.zeros((1, 1), np.float32)
    lists = spec.lists or max(1, min(MOST_LISTS, math.isqrt(vectors.count())))
    centroids = _centres(x, lists, spec.steps)
    rest = _parts(x - centroids[_nearest(x, centroids)], spec.parts)
    fitted = [_centres(p, spec.codes, spec.steps, k) for k, p in enumerate(rest)]
    codebooks = np.stack(fitted)
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, codebooks))  # of a size that the spec bounds

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, codebooks = shared.value
        for batch in batches:
            x, good = _units(batch[vector])
            if not len(x):
                continue
            of = _nearest(x, centroids)
            codes = np.stack([_nearest(p, c) for p, c in zip(_parts(x - centroids[of], len(codebooks)), codebooks, strict=True)], 1).astype(np.uint8)
            yield pd.DataFrame({"id": batch.id[good].to_numpy(), "codes": [c.tobytes() for c in codes], "list": of.astype(np.int32)})

    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), vector).mapInPandas(assign, f"id {kind}, codes binary, list int")
    return Index(written(rows.hint("rebalance", "list"), "ann-index", ("list",)), centroids, codebooks, _probes(x, centroids, spec.target))


def _first(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest scores, equal ones by id."""
    if len(scores) <= most:
        return np.arange(len(scores))
    at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    return at[np.lexsort((ids[at], -scores[at]))[:most]]


def _meet(rows: DataFrame, queries: DataFrame, score: Callable[[pd.DataFrame], Callable[[pd.DataFrame], np.ndarray]], most: int) -> DataFrame:
    """(qid, id, score): of rows (id, list, ...) and queries (qid, list, ...) of one list the `most` best of each query, by blocks of
    both. score(rows)(queries) gives a row of scores for each query; it is asked for CELLS scores at a time."""
    n = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    m = queries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("groups"))
    sizes = n.join(m, "list")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    again = lambda: sizes.toDF(*sizes.columns)  # noqa: E731  columns of its own for each side
    mine = rows.join(again(), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("group", every("groups"))
    theirs = queries.join(again(), "list").withColumn("group", F.pmod(F.xxhash64("qid"), F.col("groups"))).withColumn("block", every("blocks"))

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame(columns=["qid", "id", "score"], dtype=object)
        scored, ids, step = score(own), own.id.to_numpy(), max(1, CELLS // len(own))
        rows_of, tops, kept = [], [], []
        for at in range(0, len(asked), step):
            for k, s in enumerate(scored(asked.iloc[at : at + step]), at):
                tops.append(top := _first(s, ids, most))
                kept.append(s[top].astype(float))
                rows_of.append(np.full(len(top), k))
        return pd.DataFrame({"qid": asked.qid.to_numpy()[np.concatenate(rows_of)], "id": ids[np.concatenate(tops)], "score": np.concatenate(kept)})

    keys, kinds = ["list", "block", "group"], {c: d.schema[c].dataType.simpleString() for c, d in (("id", rows), ("qid", queries))}
    found = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(best, f"qid {kinds['qid']}, id {kinds['id']}, score double")
    return top_k(found, ["qid"], [F.desc("score"), F.col("id")], most)


def probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(qid, vector, list): the lists whose centroids are nearest to each query (qid, vector)."""
    centroids = index.centroids

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, good = _units(batch.vector)
            qids, step = batch.qid[good].to_numpy(), max(1, PROBED_ROWS // min(probes, len(centroids)))
            for start in range(0, len(x), step):
                far = (centroids**2).sum(1) - 2 * x[start : start + step] @ centroids.T
                near = np.argsort(far, 1, kind="stable")[:, :probes].astype(np.int32)
                at = start + np.repeat(np.arange(len(near)), near.shape[1])
                yield pd.DataFrame({"qid": qids[at], "vector": [x[k] for k in at], "list": near.ravel()})

    return queries.mapInPandas(choose, f"qid {queries.schema['qid'].dataType.simpleString()}, vector array<float>, list int")


def near(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, refine: int = 10, key: str = "id", vector: str = "embedding") -> DataFrame:
    """qid, id, score, rank: for each query (qid, vector) its k nearest rows by cosine, of refine * k candidates from `probes` lists (the
    index's own number if None).
    Equal scores (of six digits) go by id. A query without a direction has no rows."""
    asked = written(probed(index, queries, probes or index.probes), "ann-queries")
    wanted = [r.list for r in asked.select("list").distinct().collect()]  # as many as lists at most
    rows = index.rows.filter(F.col("list").isin(wanted))
    centroids, codebooks = index.centroids, index.codebooks

    def score(own: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
        codes, centre = np.frombuffer(b"".join(own.codes), np.uint8).reshape(len(own), -1), centroids[own.list.iloc[0]]

        def of(asked: pd.DataFrame) -> np.ndarray:
            q = np.stack(asked.vector.to_numpy())
            tables = np.einsum("pqw,pcw->qpc", _parts(q, len(codebooks)), codebooks)
            out = np.repeat((q @ centre)[:, None], len(own), 1)
            for p in range(codes.shape[1]):
                out += tables[:, p, codes[:, p]]
            return out

        return of

    found = written(_meet(rows, asked, score, k * refine).select("qid", "id"), "ann-candidates")
    exact = found.join(vectors.select(F.col(key).alias("id"), F.col(vector).alias("_v")), "id").join(queries, "qid")
    scored = exact.select("qid", "id", F.round(cosine(F.col("_v"), F.col("vector")), 6).alias("score")).dropDuplicates(["qid", "id"])
    return top_k(scored, ["qid"], [F.desc("score"), F.col("id")], k, rank="rank")


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The same from all rows: what recall is measured against."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(0).alias("list"))

    def score(own: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
        x = np.stack([np.asarray(v, np.float64) for v in own.v])
        lengths = np.linalg.norm(x, axis=1)

        def of(asked: pd.DataFrame) -> np.ndarray:
            q = np.stack([np.asarray(v, np.float64) for v in asked.vector])
            length = np.linalg.norm(q, axis=1)[:, None] * lengths[None]
            return np.where(length > 0, np.round((q @ x.T) / np.where(length > 0, length, 1), 6), -np.inf)

        return of

    found = _meet(rows, queries.filter("vector is not null").withColumn("list", F.lit(0)), score, k).filter("score > -2")
    return top_k(found, ["qid"], [F.desc("score"), F.col("id")], k, rank="rank")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """queries, recall: the share of the truth's rows whose score found reaches at the same rank."""
    both = truth.join(found.select("qid", F.col("score").alias("got"), "rank"), ["qid", "rank"], "left")
    hit = F.avg(F.when(F.col("got") >= F.col("score"), 1.0).otherwise(0.0))
    return both.agg(F.count_distinct("qid").alias("queries"), hit.alias("recall"))
