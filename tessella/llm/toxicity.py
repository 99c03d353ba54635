"""Toxicity by class-conditional Kneser-Ney models of words given the word before.

Each class (toxic, ordinary) has counts of pairs of words. A class's estimate of a word is its number of left contexts,
discounted, and what discounting frees goes to the counts that both classes share. Its estimate of a word given the one before
interpolates between that and its discounted counts of the pair, to which the shared counts of the pair are added `prior` times.
How much the pairs of a first word weigh is a matter of its shared counts, so it is the same in both classes: a pair that stands
once in all has no count left after discounting in either class, and its ratio is exactly its word's. So an expression that is rare
in both classes has nearly the same estimates, and only pairs that stand twice need a place in the table. Both estimates are
distributions.

A toxic text is a mixture: most of its words are ordinary ones and a share of them comes from the toxic model. Its
log-likelihood less that of the ordinary model, over all words and divided by their number, is what a score grows with.

What a word or a pair adds is a table in files. The part of the most frequent ones, of fixed size, is in memory; other
words and pairs of a text are looked up in the table if they may stand in it. Both are dealt by key to buckets, and what a task
asks of a bucket is one row of arrays, and so is the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import MOST_WORDS, forget, held_out, maybe_among, row_id, table, texts, written
from tessella.llm.hashes import LETTERS, word_hashes
from tessella.llm.token_counts import _chunks

#: Characters that a task takes at once.
CHARS = 500_000
#: So many of the most frequent words and pairs are in memory at most: 8 MB. LEVELS: of counts between one and its double.
HEAD, LEVELS = 1 << 19, 8
#: What a task holds until it asks, and what a bucket is asked, about. TEXTS: of one answer at most, about. BUCKETS: at least.
HELD, ASKED, TEXTS, BUCKETS = 1_000_000, 1_000_000, 20_000, 8
#: Stands for the word before a text's first one. TURN: bits by which a left word's hash is turned in a pair's key.
START, TURN = np.uint64(0x9E3779B97F4A7C15), 17


@dataclass(frozen=True)
class Smoothing:
    """word_discount, pair_discount: taken from counts of contexts and of pairs. prior: pairs that a class has from the shared
    counts before its own. floor: added to a first word's count, so that a rare one's pairs weigh less. share: of a toxic
    text's words that come from the toxic model. pad: words added to a text's length."""

    word_discount: float = 0.75
    pair_discount: float = 1.0
    prior: float = 1000.0
    floor: float = 20.0
    share: float = 0.005
    pad: int = 30


@dataclass(frozen=True)
class ToxicModel:
    """parts: (key, part), a Parquet table of what words and pairs add to a text's sum beside `base`, which each word adds;
    None without labels of both kinds. head: keys and parts of the most frequent ones. maybe: a bitmap of the keys that
    are not in head. slope, offset: from the inverse hyperbolic sine of a text's mean by SCALE to the log odds of label 1."""

    parts: DataFrame | None
    base: float = 0.0
    head: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0))
    maybe: np.ndarray | None = None
    asks: float = 0.0
    smoothing: Smoothing = Smoothing()
    slope: float = 0.0
    offset: float = -math.inf


SCALE = 1e-3


def words_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of all texts in lower case: the number of its text, its hash, the hash of the one before it (START where
    the text starts) and the key of both. Words are runs of ASCII letters and of whatever is not ASCII."""
    words, first = word_hashes([t.lower() for t in batch], LETTERS)
    left = np.r_[START, words[:-1]] if len(words) else words
    left[first[:-1][first[:-1] < len(words)]] = START
    return np.repeat(np.arange(len(batch)), np.diff(first)), words, left, words ^ (left << np.uint64(TURN) | left >> np.uint64(64 - TURN))


def pair_key(word: Column, left: Column) -> Column:
    """The same key of two hashes."""
    return word.bitwiseXOR(F.shiftleft(left, TURN).bitwiseOR(F.shiftrightunsigned(left, 64 - TURN)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, row_id, toxic (0 or 1), text of rows outside the held-out fold, one of each text and label. A document's
    largest label counts; rows without a label are none."""
    toxic = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    toxic = toxic.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    rows = texts(docs).withColumn("row_id", row_id())
    # labels grow with the documents, so the plan is the same at every size
    named = rows.select("doc_id", "row_id", F.xxhash64("text").alias("same")).join(toxic.hint("merge"), "doc_id")
    once = written(named.groupBy("same", "toxic").agg(F.min("row_id").alias("row_id")).select("row_id", "toxic"), "toxicity-labels")
    return maybe_among(rows, once, "row_id").join(once.hint("merge"), "row_id").dropDuplicates(["row_id"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """(w, l, t, o) from rows (toxic, text): how often word w stands after word l in toxic and in ordinary texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for part in _chunks(batch.text.tolist(), CHARS):
                who, words, left, pairs = words_of(part)
                toxic = batch.toxic.to_numpy()[at : at + len(part)][who]
                at += len(part)
                keys, first, place = np.unique(pairs, return_index=True, return_inverse=True)
                t, every = (x.astype(np.int32) for x in (np.bincount(place, toxic, len(keys)), np.bincount(place, minlength=len(keys))))
                yield pd.DataFrame({"w": words[first].view(np.int64), "l": left[first].view(np.int64), "t": t, "o": every - t})

    counted = rows.select("toxic", "text").mapInPandas(count, "w long, l long, t int, o int")
    return counted.groupBy("w", "l").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _share_of(n: str, sums: dict, s: Smoothing, shared: Column) -> Column:
    """A class's estimate of a word from its number of contexts."""
    return (F.greatest(F.col(n) - s.word_discount, F.lit(0.0)) + F.lit(sums[f"free_{n}"]) * shared) / F.lit(sums[n])


def _adds(ratio: Column, share: float) -> Column:
    return F.log(1 - share + share * F.exp(ratio))


def model_parts(pairs: DataFrame, s: Smoothing) -> tuple[DataFrame | None, float, DataFrame | None]:
    """(key, n, part) of pairs, the base, and (key, n, part) of words from pairs' counts."""
    stats = pairs.groupBy("w").agg(F.count_if(F.col("t") > 0).alias("n_t"), F.count_if(F.col("o") > 0).alias("n_o"), F.count("*").alias("n"))
    stats = written(stats, "toxicity-words")
    frees = [F.sum(F.least(F.col(c).cast("double"), F.lit(s.word_discount))).alias(f"free_{c}") for c in ("n_t", "n_o")]
    sums = stats.agg(*(F.sum(c).cast("double").alias(c) for c in ("n_t", "n_o", "n")), F.count("*").alias("words"), *frees).first().asDict()
    if not sums["n_t"] or not sums["n_o"]:
        return None, 0.0, None
    unseen = math.log(sums["free_n_t"] / sums["n_t"]) - math.log(sums["free_n_o"] / sums["n_o"])
    base = math.log(1 - s.share + s.share * math.exp(unseen))
    shared = (F.col("n") + 0.5) / F.lit(sums["n"] + 0.5 * sums["words"] + 1)
    stats = stats.select("w", "n", shared.alias("ps"), *(_share_of(c, sums, s, shared).alias(p) for c, p in (("n_t", "p_t"), ("n_o", "p_o"))))
    own = F.log(F.col("p_t") / F.col("p_o"))
    words = written(stats.select(F.col("w").alias("key"), "n", (_adds(own, s.share) - base).alias("part")), "toxicity-parts-of-words")

    d = s.pair_discount
    over = lambda c: F.greatest(c - d, F.lit(0.0))  # noqa: E731  what discounting leaves of a count
    t, o = F.col("t"), F.col("o")
    met = pairs.filter(t + o > d).join(stats.drop("n"), "w")
    lefts = pairs.groupBy("l").agg(F.sum(t + o).alias("c"), F.sum(over(t + o)).alias("r"), F.sum(over(t)).alias("r_t"), F.sum(over(o)).alias("r_o")).filter("r > 0")
    met = met.join(lefts, "l")
    weight = F.col("r") / (F.col("c") + s.floor)
    shared_pair = over(t + o) / F.col("r")

    def given(c: str) -> Column:
        own = (over(F.col(c)) + s.prior * shared_pair) / (F.col(f"r_{c}") + s.prior)
        return weight * own + (1 - weight) * F.col(f"p_{c}")

    added = _adds(F.log(given("t") / given("o")), s.share) - _adds(own, s.share)
    return met.select(pair_key(F.col("w"), F.col("l")).alias("key"), (t + o).alias("n"), added.alias("part")), base, words


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each hash of a key, in MOST_WORDS words at most whatever the input."""
    n = min(MOST_WORDS, 1 << max(6, (keys.count() // 4).bit_length()))
    at, bit = F.col("key").bitwiseAND(n - 1), F.shiftrightunsigned("key", 58).cast("int")
    bits = keys.select(at.alias("at"), F.lit(1).cast("long").alias("one"), bit.alias("bit"))
    found = bits.groupBy("at").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("m")).toArrow()
    out = np.zeros(n, np.uint64)
    for part in found.to_batches():
        out[part["at"].to_numpy()] = part["m"].to_numpy().view(np.uint64)
    return out


def _maybe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word = bitmap[(keys & np.uint64(len(bitmap) - 1)).astype(np.int64)]
    return (word >> (keys >> np.uint64(58)) & np.uint64(1)).astype(bool)


def fit(docs: DataFrame, labels: DataFrame, smoothing: Smoothing = Smoothing(), fit_rows: int = 20_000) -> ToxicModel:
    """Learns from the labelled rows outside the held-out fold.

    An eighth of these rows, by a hash, is not counted: the two numbers that turn means into odds are fitted to fit_rows of
    them at most. Counts cover all others, so the model grows with them; it stays in files. Without labels of both kinds
    among the counted rows the model is empty and all texts score 0. Of equal texts with one label one is counted; null ids
    and null labels are none; null texts count as empty.
    """
    rows = labelled(docs, labels).withColumn("nth", F.pmod(F.xxhash64("row_id", F.lit("fit")), F.lit(8 * 10**6)))
    pairs = written(pair_counts(rows.filter(F.col("nth") >= 10**6)), "toxicity-pairs")
    of_pairs, base, words = model_parts(pairs, smoothing)
    if words is None:
        return ToxicModel(None)
    every = written(words.unionByName(of_pairs).withColumn("level", F.floor(LEVELS * F.log2("n")).cast("int")), "toxicity-parts")
    forget(pairs)
    forget(words)
    # whole levels of counts, the highest first, while so many fit: no task or driver gets more than it keeps
    least, held, places = None, 0, 0
    for r in sorted(every.groupBy("level").agg(F.count("*").alias("n"), F.sum("n").alias("places")).collect(), reverse=True):
        held += r.n
        if held <= HEAD:
            least = r.level
        else:
            places += r.places
    top = every.filter(F.col("level") >= least if least is not None else F.lit(False)).select("key", "part").toArrow()
    head_keys, head_parts = (top[c].to_numpy() for c in ("key", "part"))
    parts = every.filter(F.col("level") < least if least is not None else F.lit(True)).select("key", "part")
    keys = head_keys.view(np.uint64)
    order = np.argsort(keys)
    fitted = rows.filter(F.col("nth") < 10**6)
    n = fitted.count()
    model = ToxicModel(parts, base, (keys[order], head_parts[order]), _bitmap(parts), places / max(1, 7 * n), smoothing)
    share = min(1.0, fit_rows / max(1, n))
    means = _means(fitted.filter(F.col("nth") < share * 10**6), model, "toxic", n=round(share * n)).select("toxic", "mean").toPandas()
    slope, offset = _logistic(np.arcsinh(means["mean"].to_numpy(float) / SCALE), means.toxic.to_numpy(float))
    return replace(model, slope=slope, offset=offset)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the log odds of y, by Newton's method with a slight pull to 0."""
    a = np.stack([x - x.mean() if len(x) else x, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
    slope = max(0.0, float(w[0]))
    return slope, float(w[1] - slope * x.mean()) if len(x) else 0.0


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32, their lowest bytes first, so that a shuffle's compression leaves little else of small ones."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def _asked(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> pd.DataFrame:
    """(bucket, rid, keys, rids, times): a row for each bucket that is asked, of arrays in the order of rows' numbers; rid is the first
    of these, rids are differences. held: rows' numbers, keys, times."""
    rids, keys, times = (np.concatenate(x) for x in zip(*held, strict=True))
    own = keys.view(np.int64) % buckets
    order = np.lexsort((rids, own))
    rids, keys, times, own = rids[order], keys[order], times[order], own[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    cut = [slice(a, b) for a, b in zip(start, np.r_[start[1:], len(own)], strict=True)]
    return pd.DataFrame({"bucket": own[start], "rid": rids[start], "keys": [keys[c].tobytes() for c in cut], "rids": [_planes(np.diff(rids[c], prepend=rids[c.start])) for c in cut], "times": [_planes(times[c]) for c in cut]})


def _answers(own: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """Each row of own (rid, keys, rids, times) as (rid, rids, sums): what the table (key, part) adds to each text it asks for."""
    table = table.sort_values("key")
    keys, parts = table.key.to_numpy(), table.part.to_numpy()
    out = []
    for first, sought, steps, times in zip(own.rid, own["keys"], own.rids, own.times, strict=True):
        sought = np.frombuffer(sought, np.int64)
        place = np.searchsorted(keys[:-1], sought)
        met = keys[place] == sought if len(keys) else np.zeros(len(sought), bool)
        rids, whose = np.unique(np.cumsum(_of_planes(steps))[met], return_inverse=True)
        sums = np.bincount(whose, _of_planes(times)[met] * parts[place[met]], len(rids))
        out.append((first, _planes(np.diff(rids, prepend=0)), sums.tobytes()))
    return pd.DataFrame(out, columns=["rid", "rids", "sums"])


def _means(rows: DataFrame, model: ToxicModel, *more: str, n: int | None = None) -> DataFrame:
    """(doc_id, row_id, *more, mean) for each of n rows (counted here if not given): the mean of what its words add.

    One pass gives a row for each text with what is known in memory, and for each bucket of the table a row of arrays: the words and
    pairs that may stand in it, how often they stand in a text, and the text's number in that pass and nothing else of it. Texts that
    ask together (`lead`) get their answers together.
    """
    head, bitmap = (rows.sparkSession.sparkContext.broadcast(x) for x in (model.head, model.maybe))
    base, pad, by = model.base, model.smoothing.pad, ["doc_id", "row_id", *more]
    buckets = max(BUCKETS, round(model.asks * (rows.count() if n is None else n) / ASKED))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, parts = head.value
        lead, held, waiting, met_texts = None, [], 0, 0
        none = {"whole": False, "known": False, "n": 0, "total": 0.0, **dict.fromkeys(by, 0)}
        for batch in batches:
            at = 0
            for part in _chunks(batch.text.tolist(), CHARS):
                own = batch.iloc[at : at + len(part)].drop(columns="text")
                at += len(part)
                lead = own.rid.iloc[0] if lead is None else lead
                who, words, _, pairs = words_of(part)
                n = np.bincount(who, minlength=len(part))
                asked, sought = np.r_[who, who], np.r_[words, pairs]
                place = np.searchsorted(keys[:-1], sought)
                known = keys[place] == sought if len(keys) else np.zeros(len(sought), bool)
                total = np.bincount(asked[known], parts[place[known]], len(part)) + n * base
                yield own.assign(whole=True, n=n, total=total, lead=lead, bucket=own.rid % buckets, keys=None, rids=None, times=None)
                met = ~known & _maybe(bitmap.value, sought)
                asked, sought = asked[met], sought[met]
                order = np.lexsort((sought, asked))
                asked, sought = asked[order], sought[order]
                start = np.flatnonzero(np.r_[True, (asked[1:] != asked[:-1]) | (sought[1:] != sought[:-1])]) if len(asked) else np.zeros(0, int)
                if len(start):
                    held.append((own.rid.to_numpy()[asked[start]], sought[start], np.diff(np.r_[start, len(asked)])))
                waiting, met_texts = waiting + len(start), met_texts + len(part)
                if waiting > HELD or met_texts > TEXTS:
                    if held:
                        yield _asked(held, buckets).assign(lead=lead, **none)
                    lead, held, waiting, met_texts = None, [], 0, 0
        if held:
            yield _asked(held, buckets).assign(lead=lead, **none)

    def answers(_, own: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        asks = own[~own.whole].reset_index(drop=True)
        return pd.concat([own[own.whole].assign(sums=None)[kept], asks.assign(**_answers(asks, table))[kept]])

    def added(own: pd.DataFrame) -> pd.DataFrame:
        answers, own = own[~own.whole], own[own.whole].sort_values("rid")
        total = own.total.to_numpy(copy=True)
        # in the order of buckets' first texts, so that the order in which answers come does not show
        for first, steps, sums in sorted(zip(answers.rid, answers.rids, answers.sums, strict=True)):
            total[np.searchsorted(own.rid.to_numpy(), first + np.cumsum(_of_planes(steps)))] += np.frombuffer(sums, float)
        return own.assign(mean=total / (own.n + pad))[[*by, "known", "mean"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema) + ", known boolean"
    each = f"rid long, {kinds}, whole boolean, n long, total double, lead long"
    kept = ["rid", *by, "known", "whole", "n", "total", "lead", "rids", "sums"]
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), *by[1:], F.col("doc_id").isNotNull().alias("known"), "text")
    found = rows.mapInPandas(sums, f"{each}, bucket long, keys binary, rids binary, times binary")
    parts = model.parts.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    met = found.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInPandas(answers, f"{each}, rids binary, sums binary")
    out = met.groupBy("lead").applyInPandas(added, f"{kinds}, mean double")
    # rounded, so that the order in which parts are added up does not show
    return out.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), *by[1:], F.round("mean", 12).alias("mean"))


def scores(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, row_id, score (0 to 1) for each row of docs. A null text counts as empty and scores as a text without any
    evidence does."""
    rows = texts(docs).withColumn("row_id", row_id())
    if model.parts is None:
        return rows.select("doc_id", "row_id", F.lit(0.0).alias("score"))
    odds = F.lit(model.slope) * F.asinh(F.col("mean") / SCALE) + F.lit(model.offset)
    return _means(rows, model).select("doc_id", "row_id", (1 / (1 + F.exp(-odds))).alias("score"))


def toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold, else 0) for each row of docs.

    Repeated rows repeat; equal texts have equal scores; long texts are scored whole; other columns are not looked at; an
    empty table gives no rows.
    """
    return scores(docs, model).select("doc_id", "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
