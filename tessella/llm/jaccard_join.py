"""N-gram Jaccard join with prefix filters under several global orders.

1. Texts with equal shingle sets are one class; a class is one row from here on.
2. A set that is linked to another lacks at most n - ceil(t * n) of its shingles there. So of its shingles in a fixed part
   of the hash space all but so many stand in another class too; classes for which that is not so are linked with nothing.
   Chunks of documents count what they share among themselves and send each shingle once, so that a frequent shingle
   is never more rows than there are chunks.
3. Exact frequencies of the remaining classes' shingles give the global orders: rare ones first, within a level of
   frequency by each order's own hash. A set's index prefix meets the probe prefix of every larger set it is linked to,
   under every order.
4. Under each order classes are lined up by their first shared shingle and sizes, and neighbours are verified. That links
   most of a group of near copies by about as many pairs as it has classes. Pairs that are left, of classes that are not yet
   connected, are those whose prefixes meet under the first order and whose signatures allow it, then those that meet under
   the others too; they are verified by the exact size of the intersection. Pairs that are connected already are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import maybe_among, row_id, texts, written
from tessella.llm.components import components
from tessella.llm.hashes import MULTIPLIERS, NOT_SPACE, mixed, word_hashes
from tessella.llm.token_counts import _chunks

#: Global orders of shingles.
ORDERS = 3
#: Characters whose shingles a task makes at once: where what texts share is counted, and where it is not.
CHARS, OWN_CHARS = 1_000_000, 250_000
#: Classes in one line of neighbours at most; longer lines are cut at random.
LINE = 4096
#: Longs of a signature. Each shingle turns one of its bits over, so sets differ in as many shingles at least as their
#: signatures do in bits.
SIGNS = 8
#: Stand for any two classes where a chunk has several with a shingle.
LOW, HIGH = -(2**63), 2**63 - 1
#: Frequent shingles that a task remembers to have marked, 16 MB of them.
MARKED = 1 << 21


def shingle_sets(batch: list[str], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes. A-Z is lower-cased, words are runs without ASCII white space;
    fewer words than a shingle has make one of them all; no words, no shingle."""
    hashes, first = word_hashes(batch, NOT_SPACE)
    out = []
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled = mixed(rolled + hashes[k : k + len(rolled)] * MULTIPLIERS[k % 3] + np.uint64(k))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in hashes[a:b]:
                h = mixed(h * MULTIPLIERS[1] + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@dataclass(frozen=True)
class Join:
    """words a shingle; percent: of the union that the intersection has to reach."""

    words: int = 5
    percent: int = 80

    def missing(self, n):
        """Shingles of a set of n that a set it is linked to may lack."""
        return n - -(-self.percent * n // 100)

    @property
    def part(self) -> float:
        """The part of the hash space in which shared shingles are counted: twice what may be missing."""
        return min(1.0, 2 * (100 - self.percent) / 100)

    def probe(self, n: Column) -> Column:
        """How many of a set's first shingles meet the index prefix of every smaller set it is linked to."""
        return n - F.ceil(n * self.percent / 100) + 1

    def index(self, n: Column) -> Column:
        return n - F.ceil(n * (2 * self.percent) / (100 + self.percent)) + 1

    def linked(self, both: Column, a: Column, b: Column) -> Column:
        return 100 * both >= self.percent * (a + b - both)

    def unlike(self, a: Column, b: Column) -> Column:
        """Whether signatures differ in more bits than linked sets of these structs (n, signs) have unlike shingles."""
        bits = sum((F.bit_count(F.get(a["signs"], k).bitwiseXOR(F.get(b["signs"], k))) for k in range(SIGNS)), F.lit(0))
        return bits * (100 + self.percent) > (a["n"] + b["n"]) * (100 - self.percent)

    def sizes(self, a: Column, b: Column) -> Column:
        """Whether sizes allow a link; a is the smaller one."""
        return 100 * a >= self.percent * b


def _node(own: np.ndarray, by: np.uint64 = np.uint64(1)) -> int:
    """64 bits for a set."""
    return int(mixed(own * by).sum(dtype=np.uint64).astype(np.int64)) if len(own) else 0


def _check(own: np.ndarray) -> int:
    return _node(own, MULTIPLIERS[2])


def _signs(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((own & np.uint64(64 * SIGNS - 1)).astype(np.int64), minlength=64 * SIGNS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _parts(batch: pd.DataFrame, words: int, chars: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """A batch in chunks of so many characters with their texts' shingle sets."""
    at = 0
    for part in _chunks(batch.text.tolist(), chars):
        yield batch.iloc[at : at + len(part)], shingle_sets(part, words)
        at += len(part)


def described(rows: DataFrame, join: Join) -> DataFrame:
    """(doc_id, row_id, n, node, check) of each row: its set's size and two hashes of 64 bits."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, sets in _parts(batch, join.words, OWN_CHARS):
                yield own[["doc_id", "known", "row_id"]].assign(n=[len(s) for s in sets], node=[_node(s) for s in sets], check=[_check(s) for s in sets])

    plain = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "row_id", "text")
    out = plain.mapInPandas(describe, "doc_id long, known boolean, row_id long, n long, node long, check long")
    return out.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "row_id", "n", "node", "check")


def sharing(rows: DataFrame, join: Join) -> DataFrame:
    """(node) of the sets that may be linked to another one, by the shingles they share in a part of the hash space."""
    limit = np.uint64(min(2**64 - 1, int(join.part * 2**64)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marked = np.zeros(0, np.int64)
        for batch in batches:
            for _, sets in _parts(batch, join.words, CHARS):
                sets = {_node(s): s for s in sets if len(s)}
                if not sets:
                    continue
                nodes = np.array(list(sets), np.int64)
                own = [s[: np.searchsorted(s, limit)] for s in sets.values()]
                need = np.array([len(o) - join.missing(len(s)) for o, s in zip(own, sets.values(), strict=True)])
                who, keys = np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate(own)
                order = np.argsort(keys, kind="stable")
                who, keys = who[order], keys[order]
                start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
                times = np.diff(np.r_[start, len(keys)])
                alone, several = start[times == 1], keys[start[times > 1]].view(np.int64)
                # a task marks a frequent shingle once, so that a hot one has two rows for each task
                several = several[~np.isin(several, marked, assume_unique=True)]
                marked = np.union1d(marked, several) if len(marked) < MARKED else several
                met = np.bincount(who[np.repeat(times > 1, times)], minlength=len(own)) if len(keys) else np.zeros(len(own), int)
                yield pd.DataFrame({"key": keys[alone].view(np.int64), "node": nodes[who[alone]], "more": np.int32(1), "sums": False})
                for mark in (LOW, HIGH):
                    yield pd.DataFrame({"key": several, "node": np.full(len(several), mark), "more": np.int32(0), "sums": False})
                yield pd.DataFrame({"key": nodes, "node": nodes, "more": (met - need).astype(np.int32), "sums": True})

    found = rows.select("text").mapInPandas(count, "key long, node long, more int, sums boolean")
    w = Window.partitionBy("key")
    shared = found.withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w)).filter("sums or (lo != hi and more > 0)")
    return shared.groupBy("node").agg(F.sum("more").alias("more")).filter("more >= 0").select("node")


def shared_sets(rows: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """(cid, n, signs, held): classes' shingles that several classes have, as structs of level and key, and the signatures
    of their whole sets. classes: (cid, row_id, n, node, check)."""

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, sets in _parts(batch, join.words, OWN_CHARS):
                # another row may have the row_id of a class's text
                right = [(_node(s), _check(s)) == (a, b) for s, a, b in zip(sets, own.node, own.check, strict=True)]
                yield pd.DataFrame({"cid": own.cid[right], "n": own.n[right], "signs": [_signs(s) for s, r in zip(sets, right, strict=True) if r], "keys": [s.view(np.int64) for s, r in zip(sets, right, strict=True) if r]})

    chosen = maybe_among(rows.select("row_id", "text"), classes, "row_id").join(classes, "row_id")
    sets = written(chosen.select("cid", "n", "node", "check", "text").mapInPandas(sets_of, "cid long, n long, signs array<long>, keys array<long>"), "jaccard-sets")
    each = sets.select("cid", "n", F.explode("keys").alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key", F.floor(F.log2("times")).cast("int").alias("level"))
    held = each.join(counts, "key").groupBy("cid", "n").agg(F.collect_set(F.struct("level", "key")).alias("held"))
    # a row that repeats gives its shingles twice, so some of them may stand in one class only
    held = held.filter(F.size("held") >= F.ceil(F.col("n") * join.percent / 100))
    return held.join(sets.groupBy("cid").agg(F.first("signs").alias("signs")), "cid")


def _first(join: Join, order: int, most: Column) -> Column:
    """A set's first keys under an order, as many as `most` leaves beside those that no other class has."""
    ranked = F.array_sort(F.transform("held", lambda h: F.struct(h["level"].alias("level"), F.xxhash64(h["key"], F.lit(order)).alias("by"), h["key"].alias("key"))))
    left = F.greatest(F.lit(0), most - (F.col("n") - F.size("held"))).cast("int")
    return F.transform(F.slice(ranked, F.lit(1), left), lambda r: r["key"])


def _neighbours(sets: DataFrame, join: Join, order: int) -> DataFrame:
    """Edges (u, v) between linked neighbours in lines of classes with the same first key under an order."""
    first = sets.withColumn("at", F.get(f"probe{order}", F.lit(0))).filter("at is not null").select("cid", "n", "at", "keys")
    lines = first.groupBy("at").agg(F.count("*").alias("m")).filter("m > 1")
    # a long line is cut into parts, which other orders join again
    placed = first.join(lines, "at").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(order)), F.ceil(F.col("m") / LINE)))
    w = Window.partitionBy("at", "part").orderBy("n", F.xxhash64("cid", F.lit(-order)), "cid")
    edges = []
    for back in (1, 2):
        before = F.lag(F.struct("cid", "n", "keys"), back).over(w).alias(f"b{back}")
        edges.append(before)
    beside = placed.select("cid", "n", "keys", *edges)
    both = [F.when(join.sizes(F.col(f"b{k}.n"), F.col("n")) & join.linked(F.size(F.array_intersect("keys", f"b{k}.keys")), F.col("n"), F.col(f"b{k}.n")), F.col(f"b{k}.cid")) for k in (1, 2)]
    return beside.select(F.col("cid").alias("u"), F.explode(F.array_compact(F.array(*both))).alias("v"))


def _remaining(sets: DataFrame, labels: DataFrame, join: Join) -> DataFrame:
    """Edges (u, v) between linked classes with different labels (cid, label; a class without one is its own)."""
    named = sets.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("component", "cid"))
    posted = named.select("cid", "n", "signs", "keys", "label", F.posexplode("probe0").alias("place", "key"), F.size("index0").alias("indexed"), (F.col("n") - F.size("keys")).alias("alone"))
    # left: the set's shingles from the key on; those that no other class has stand before all others
    left = F.col("n") - F.col("alone") - F.col("place")
    posted = written(posted.select("cid", F.struct("n", "signs").alias("set"), "label", "key", (F.col("place") < F.col("indexed")).alias("early"), left.alias("left")), "jaccard-postings")
    sizes = posted.groupBy("key", "label").agg(F.count("*").alias("m"))
    tops = sizes.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    open_ = written(posted.join(tops.select("key", "top"), "key"), "jaccard-open")
    a = open_.filter("label != top").select("key", *(F.col(c).alias(f"{c}_a") for c in ("cid", "set", "label", "early", "left")))
    b = open_.select("key", "top", *(F.col(c).alias(f"{c}_b") for c in ("cid", "set", "label", "early", "left")))
    n_a, n_b = F.col("set_a.n"), F.col("set_b.n")
    smaller = (n_a < n_b) | ((n_a == n_b) & (F.col("cid_a") < F.col("cid_b")))
    # of two classes outside the largest one each finds the other: one of them is enough
    once = (F.col("label_b") == F.col("top")) | (F.col("cid_a") < F.col("cid_b"))
    fits = F.when(smaller, join.sizes(n_a, n_b) & F.col("early_a")).otherwise(join.sizes(n_b, n_a) & F.col("early_b"))
    # from the first key that both sets have on, they share no more than either has left
    within = join.linked(F.least("left_a", "left_b"), n_a, n_b)
    met = a.join(b, (a["key"] == b["key"]) & (F.col("label_a") != F.col("label_b")) & once & fits & within & ~join.unlike(F.col("set_a"), F.col("set_b")))
    pairs = met.select(F.when(smaller, F.col("cid_a")).otherwise(F.col("cid_b")).alias("u"), F.when(smaller, F.col("cid_b")).otherwise(F.col("cid_a")).alias("v")).distinct()
    orders = range(1, ORDERS)
    u = sets.select(F.col("cid").alias("u"), *(f"index{k}" for k in orders))
    v = sets.select(F.col("cid").alias("v"), *(f"probe{k}" for k in orders))
    meet = reduce(lambda x, y: x & y, (F.arrays_overlap(f"index{k}", f"probe{k}") for k in orders))
    pairs = written(pairs.join(u, "u").join(v, "v").filter(meet).select("u", "v"), "jaccard-pairs")
    u, v = (sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"keys{x}")) for x in "uv")
    known = pairs.join(u, "u").join(v, "v")
    return known.filter(join.linked(F.size(F.array_intersect("keysu", "keysv")), F.col("nu"), F.col("nv"))).select("u", "v")


def jaccard_classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, row_id (64 bits of doc_id and text), n_shingles, class_id, component_id for each row of docs.

    Rows with equal shingle sets have one class_id, its smallest doc_id; component_id is the smallest doc_id that links
    reach, the row's own included. A row without words (a null text counts as empty) is linked with nothing: its component
    is its doc_id. A row without doc_id shares the class of rows with equal sets and their links, and has null where none
    has an id. Repeated rows share a class; long texts are taken whole; other columns are not looked at; an empty table
    gives no rows.
    """
    rows = texts(docs).withColumn("row_id", row_id())
    found = written(described(rows, join), "jaccard-rows")
    sized = found.filter("n > 0")
    classes = sized.groupBy("node", "check").agg(F.min("n").alias("n"), F.min("row_id").alias("row_id"), F.min("doc_id").alias("class_id"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    nodes = written(sharing(rows, join), "jaccard-sharing")
    chosen = written(classes.join(nodes, "node", "left_semi").select("cid", "row_id", "n", "node", "check"), "jaccard-chosen")
    sets = shared_sets(rows, chosen, join)
    firsts = [_first(join, k, f(F.col("n"))).alias(f"{name}{k}") for k in range(ORDERS) for name, f in (("probe", join.probe), ("index", join.index))]
    sets = written(sets.select("cid", "n", "signs", F.transform("held", lambda h: h["key"]).alias("keys"), *firsts).filter("size(probe0) > 0"), "jaccard-sets")

    edges = written(reduce(DataFrame.unionByName, (_neighbours(sets, join, k) for k in range(ORDERS))), "jaccard-edges")
    labels = written(components(edges, "jaccard-labels"), "jaccard-labels")
    more = written(_remaining(sets, labels, join), "jaccard-edges")
    # links between components join their labels
    name = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"l{x}"))
    across = more.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    joined = written(components(across, "jaccard-joined"), "jaccard-joined").toDF("label", "joined")
    ends = classes.select("cid", "node", "check", "class_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    ends = ends.withColumn("label", F.coalesce("component", "cid")).join(joined, "label", "left").withColumn("joined", F.coalesce("joined", "label"))

    # the smallest doc_id of each component
    smallest = ends.groupBy("joined").agg(F.min("class_id").alias("component_id"))
    named = written(ends.join(smallest, "joined").select("node", "check", "class_id", "component_id"), "jaccard-named")
    out = sized.join(named, ["node", "check"], "left").select("doc_id", "row_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    lone = found.filter("n = 0").select("doc_id", "row_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return out.unionByName(lone)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), Join(words=3, percent=90))
    return found.select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
