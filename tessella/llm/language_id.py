"""Language identification by rank-order profiles of n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import held_out, table, texts
from tessella.llm.token_counts import _chunks

#: N-grams of 1 to 3 characters; a key has 21 bits for each.
ORDERS, BITS = 3, 21
#: The most frequent n-grams of a text or language that are compared.
PROFILE = 300


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """Keys of all n-grams of a text's letters in lower case. Any run of other characters is one space, which stands
    at word ends; no n-gram reaches across it."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # a letter, or what follows one
    c = np.where(letter, c, 32)[kept].astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.uint64)
    c = np.r_[np.uint64(32), c]
    space = c == 32
    two = c[:-1] << np.uint64(BITS) | c[1:]
    three = (two[:-1] << np.uint64(BITS) | c[2:])[~space[1:-1]]
    return np.concatenate([c[~space], two, three])


def ranked(keys: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys, most frequent first; ties go by key."""
    own, n = np.unique(keys, return_counts=True)
    return own[np.argsort(-n, kind="stable")[:most]]


def learn(docs: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's profile, from all rows outside the held-out fold that have text and lang."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                for part in _chunks(own.text.tolist(), 2_000_000):
                    keys, n = np.unique(np.concatenate([grams(t) for t in part]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n})

    sums = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("nth", nth).filter(F.col("nth") <= most).toPandas().sort_values(["lang", "nth"])
    return {lang: own.gram.to_numpy(np.uint64) for lang, own in top.groupby("lang")}


def language_id(docs: DataFrame, profiles: dict[str, np.ndarray], most: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for each row of docs, from its text alone.

    A document's distance to a language is the sum, over its own most frequent n-grams, of how many places each is out
    of place in the language's profile, at most `most` for one that is not in it. The nearest language is predicted, of
    equally near ones the first by name; score is the second distance's share in the two smallest (1 with one language).
    `und` with score 0 stands for a null text, one without letters, and where no language was learned. Repeated rows
    repeat; other columns are not looked at; an empty table gives no rows.
    """
    names, tables = sorted(profiles), {}
    for lang in names:
        order = np.argsort(profiles[lang])
        tables[lang] = profiles[lang][order], order

    def distance(own: np.ndarray, lang: str) -> int:
        keys, place = tables[lang]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return int(np.where(keys[at] == own, np.abs(place[at] - np.arange(len(own))), most).sum())

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                own = ranked(grams(text), most)
                if not len(own) or not names:
                    out.append(("und", 0.0))
                    continue
                near = sorted((distance(own, lang), lang) for lang in names)
                both = near[0][0] + near[1][0] if len(near) > 1 else 0
                out.append((near[0][1], near[1][0] / both if both else 1.0 if len(near) == 1 else 0.5))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return texts(docs).select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
