"""Ranked lexical search by block-max WAND over segments of compressed posting blocks.

An index is a Parquet table. Each task turns its documents into segments; of each term a segment holds blocks of BLOCK
postings: gaps of local document numbers and counts, packed to the fewest bytes that a block needs, and for each block its
first and last document and the largest impact of its postings. A segment is bounded by documents and characters, so no
word, however frequent, and no text, however long, makes more than one segment's worth of work; documents are not shuffled.

A search meets a segment with a block of items. Shallow moves over all heads of an item's lists give each document the sum
of the largest impacts of the blocks it may stand in. Windows of documents are taken from the highest of these bounds
downwards; the k-th best score so far is the threshold, and windows under it are left without decompression. In a window
lists are opened from the heaviest down: a document's bound gives way to what it really has, and the blocks of later lists
are decompressed only where a document is left that may still reach the threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import maybe_among, table, texts, written

#: Postings of a block; documents and characters of a segment at most (a longer text is a segment of its own); characters
#: that are split at once; documents of a window; items that meet a segment together.
BLOCK, SEGMENT_DOCS, SEGMENT_CHARS, PIECE, WINDOW, ITEMS = 128, 32_768, 16_000_000, 1 << 20, 128, 256

#: What an impact is in units of: 1000 * tf / (tf + 12 * m / 1000) by 64-bit integers.
UNIT = 1_000_000_000

#: Upper-case ASCII letters become lower-case ones, bytes that stand in no term become blanks.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("impact", "<i8"), ("at", "<u4"), ("n", "<u2"), ("gap_bytes", "u1"), ("tf_bytes", "u1")])


def term_counts(text: str) -> Counter:
    """How often each term (as UTF-8) stands in the text; long texts are split piece by piece."""
    raw = text.encode("utf-8", "replace").translate(_LOWER)
    out, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def corpus_lengths(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and the number of all their terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [term_counts(t).total() for t in batch.text]
            yield pd.DataFrame({"some": [sum(x > 0 for x in n)], "terms": [sum(n)]})

    counted = texts(docs).select("text").mapInPandas(count, "some long, terms long").agg(F.sum("some"), F.sum("terms")).first()
    return counted[0] or 0, counted[1] or 0


def length_norms(n: np.ndarray, some: int, terms: int) -> np.ndarray:
    """Each document's m: 75 and a quarter of its length by the mean length in percent, by integers."""
    if len(n) and 25 * int(n.max()) * some >= 2**63:
        return np.array([75 + 25 * int(x) * some // terms for x in n], np.int64)
    return 75 + 25 * n * some // max(1, terms)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tf // (1000 * tf + 12 * m)


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def _byte_width(most: np.ndarray) -> np.ndarray:
    return np.select([most < 1 << 8, most < 1 << 16], [1, 2], 4)


def _packed(values: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Writes each value's low bytes, width of them, from its place on."""
    for b in range(4):
        own = width > b
        out[at[own] + b] = values[own] >> 8 * b & 255


def _compressed(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each list begins among the postings (ordered by term and document), where its heads begin, all heads, and all data."""
    lists = _starts(term)
    lengths = np.diff(np.r_[lists, len(term)])
    nth = np.arange(len(term), dtype=np.int32) - np.repeat(lists, lengths).astype(np.int32)
    blocks = np.flatnonzero(nth % BLOCK == 0)
    n = np.diff(np.r_[blocks, len(term)])
    gap = np.diff(doc, prepend=doc[:1])
    gap[blocks] = 0
    heads = np.zeros(len(blocks), HEAD)
    heads["first"], heads["last"], heads["n"] = doc[blocks], doc[blocks + n - 1], n
    heads["impact"] = np.maximum.reduceat(impacts(tf.astype(np.int64), norms[doc]), blocks)
    heads["gap_bytes"], heads["tf_bytes"] = _byte_width(np.maximum.reduceat(gap, blocks)), _byte_width(np.maximum.reduceat(tf, blocks))
    block_at = np.r_[0, np.cumsum(n * (heads["gap_bytes"].astype(np.int64) + heads["tf_bytes"]))]
    of_list = np.searchsorted(blocks, np.r_[lists, len(term)])
    heads["at"] = block_at[:-1] - np.repeat(block_at[of_list[:-1]], np.diff(of_list))
    data, inside = np.zeros(block_at[-1], np.uint8), nth % BLOCK
    gap_width, tf_width = (np.repeat(heads[c], n) for c in ("gap_bytes", "tf_bytes"))
    start = np.repeat(block_at[:-1], n)
    _packed(gap, gap_width, start + inside * gap_width.astype(np.int32), data)
    start += np.repeat(n * heads["gap_bytes"], n)
    _packed(tf, tf_width, start + inside * tf_width.astype(np.int32), data)
    return lists, of_list, heads, data


def segment_rows(ids: np.ndarray, known: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], terms: list[bytes], norms: np.ndarray, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """The rows of one segment: the header (ids and norms) first, then each term's heads and data by term, a few at a time.
    counts: for each document the numbers of its terms and how often each stands in it."""
    order = np.lexsort((ids, ~known))  # local numbers follow doc_id, unknown ones last
    norms, known = norms[order], known[order]
    yield pd.DataFrame({"term": [None], "n_docs": len(ids), "heads": [ids[order].tobytes()], "data": [norms.tobytes() + known.tobytes()]})
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(counts[k][0]) for k in order])
    term, tf = (np.concatenate([counts[k][c] for k in order]) for c in (0, 1))
    by = np.argsort(term, kind="stable")
    term, tf, doc = term[by], tf[by], doc[by]
    lists, of_list, heads, data = _compressed(term, doc, tf, norms)
    numbers, lengths = term[lists], np.diff(np.r_[lists, len(term)])
    sizes = heads["n"].astype(np.int64) * (heads["gap_bytes"].astype(np.int64) + heads["tf_bytes"])
    data_at = np.r_[0, np.cumsum(np.add.reduceat(sizes, of_list[:-1]))]
    raw_heads, raw = heads.tobytes(), data.tobytes()
    by_name = sorted(range(len(lists)), key=lambda k: terms[numbers[k]])
    for at in range(0, len(by_name), rows):
        some = by_name[at : at + rows]
        yield pd.DataFrame({
            "term": [terms[numbers[k]] for k in some],
            "n_docs": lengths[some],
            "heads": [raw_heads[of_list[k] * HEAD.itemsize : of_list[k + 1] * HEAD.itemsize] for k in some],
            "data": [raw[data_at[k] : data_at[k + 1]] for k in some],
        })


INDEX = "segment string, term binary, n_docs int, heads binary, data binary"


@dataclass(frozen=True)
class Index:
    """postings: a written table of INDEX. some, terms: documents with a term, and terms of all documents."""

    postings: DataFrame
    some: int
    terms: int


def build_index(docs: DataFrame, segment_docs: int = SEGMENT_DOCS, segment_chars: int = SEGMENT_CHARS) -> Index:
    """An index of every term of every row of docs. Null texts and texts without a term are not in it; repeated rows are each
    in it; a null doc_id is kept as null; other columns are not looked at; an empty table gives an empty index."""
    some, terms = corpus_lengths(docs)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held, numbers, chars, n_segments = [], {}, 0, 0

        def flush() -> Iterator[pd.DataFrame]:
            lengths = np.array([c[1].sum() for _, _, c in held], np.int64)
            ids, known = np.array([i for i, _, _ in held], np.int64), np.array([k for _, k, _ in held], bool)
            for part in segment_rows(ids, known, [c for _, _, c in held], list(numbers), length_norms(lengths, some, terms)):
                part.insert(0, "segment", f"{TaskContext.get().partitionId()}-{n_segments}")
                yield part

        for batch in batches:
            for i, k, text in zip(batch.doc_id, batch.known, batch.text, strict=True):
                if held and (len(held) >= segment_docs or chars + len(text) > segment_chars):
                    yield from flush()
                    held, numbers, chars, n_segments = [], {}, 0, n_segments + 1
                if counts := term_counts(text):
                    own = np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), np.int32, len(counts))
                    held.append((i, k, (own, np.fromiter(counts.values(), np.uint32, len(counts)))))
                    chars += len(text)
        if held:
            yield from flush()

    rows = texts(docs).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    return Index(written(rows.mapInPandas(segments, INDEX), "search-index"), some, terms)


class Postings:
    """One term's list in a segment; blocks are decompressed when asked for and then kept."""

    def __init__(self, heads: bytes, data: bytes, norms: np.ndarray):
        h = np.frombuffer(heads, HEAD)
        self.heads, self.data, self.norms = h, data, norms
        self.first, self.last, self.impact = h["first"].astype(np.int64), h["last"].astype(np.int64), h["impact"].astype(np.int64)
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _open(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        if j not in self.opened:
            h = self.heads[j]
            at, n, gap, tf = int(h["at"]), int(h["n"]), int(h["gap_bytes"]), int(h["tf_bytes"])
            doc = int(h["first"]) + np.cumsum(np.frombuffer(self.data, f"<u{gap}", n, at).astype(np.int64))
            self.opened[j] = doc, impacts(np.frombuffer(self.data, f"<u{tf}", n, at + n * gap).astype(np.int64), self.norms[doc])
        return self.opened[j]

    def largest(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the block it may stand in (or the number of blocks), and that block's largest impact."""
        j = np.searchsorted(self.last, docs)
        inside = j < len(self.last)
        inside[inside] = self.first[j[inside]] <= docs[inside]
        return np.where(inside, j, len(self.last)), np.where(inside, np.r_[self.impact, 0][np.minimum(j, len(self.last))], 0)

    def impacts_of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """What each of the ascending documents has, from the blocks they may stand in."""
        out = np.zeros(len(docs), np.int64)
        wanted = np.unique(blocks)
        opened = [self._open(int(j)) for j in wanted if j < len(self.last)]
        if opened:
            own, impact = (np.concatenate(x) for x in zip(*opened, strict=True))
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            out = np.where(own[at] == docs, impact[at], 0)
        return out


def best(lists: list[tuple[Postings, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The local numbers and scores of the k best documents of a segment, equal scores by smaller number. lists: each with
    its weight, which counts how often the item holds the term."""
    bound = np.zeros(n_docs + 1, np.int64)
    for p, w in lists:
        bound[p.first] += w * p.impact
        bound[p.last + 1] -= w * p.impact
    bound = np.cumsum(bound[:-1])
    heavy_first = sorted(lists, key=lambda x: -x[1] * int(x[0].impact.max()))
    windows = np.maximum.reduceat(bound, np.arange(0, n_docs, WINDOW))
    order = np.argsort(-windows, kind="stable")
    found, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    at, take = 0, max(1, len(order) // 32)
    while at < len(order) and windows[order[at]] >= threshold:
        some = np.sort(order[at : at + take])
        live = (some[:, None] * WINDOW + np.arange(WINDOW)).ravel()
        live = live[live < n_docs]
        live = live[bound[live] >= threshold]
        score = bound[live]
        for p, w in heavy_first:
            blocks, most = p.largest(live)
            score = score + w * (p.impacts_of(live, blocks) - most)
            stays = score >= threshold
            live, score = live[stays], score[stays]
            if not len(live):
                break
        found, scores = np.r_[found, live], np.r_[scores, score]
        top = np.lexsort((found, -scores))[:k]
        found, scores = found[top], scores[top]
        if len(found) == k:
            threshold = max(1, int(scores[-1]))
        at, take = at + take, take * 8
    return found, scores


def _query_terms(queries: DataFrame) -> DataFrame:
    """(item, block, term, times) from queries (item, block, text)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, block, text in zip(batch["item"], batch["block"], batch["text"], strict=True):
                counts = term_counts(text)
                yield pd.DataFrame({"item": item, "block": block, "term": list(counts), "times": list(counts.values())})

    return queries.mapInPandas(split, "item long, block int, term binary, times long")


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items (item_id, text) its k best documents with a score above 0, equal
    scores by smaller doc_id, null ones last.

    A null text and one without a term found anywhere have no rows; repeated items have each their rows; an empty table of
    items gives none. Items meet each segment in blocks of ITEMS or so; only lists of their terms are read.
    """
    spark = items.sparkSession
    numbered = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("item"))
    numbered = written(numbered, "search-items")
    n_blocks = max(1, -(-numbered.count() // ITEMS))
    asked = written(_query_terms(numbered.select("item", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int").alias("block"), "text")), "search-terms")
    terms = written(asked.select("term").distinct(), "search-words")
    lists = maybe_among(index.postings.filter("term is not null"), terms, "term")
    df = lists.select("term", "n_docs").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.some) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = written(df.select("term", weight.alias("w")), "search-weights")
    own = F.collect_list(F.struct("item", (F.col("w") * F.col("times")).alias("w"))).alias("wanted")
    wanted = asked.join(weights, "term").groupBy("term", "block").agg(own).withColumn("asked", F.struct(F.col("wanted.item").alias("item"), F.col("wanted.w").alias("w")))
    postings = lists.join(wanted.select("term", "block", "asked"), "term").select("segment", "block", "heads", "data", "asked")
    # a segment's header goes to each block of items
    none = F.lit(None).cast(wanted.schema["asked"].dataType)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    headers = index.postings.filter("term is null").select("segment", blocks, "heads", "data", none.alias("asked"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group.asked.isna()].iloc[0]
        ids = np.frombuffer(head["heads"], np.int64)
        norms, known = np.frombuffer(head["data"], np.int64, len(ids)), np.frombuffer(head["data"], bool, len(ids), 8 * len(ids))
        of: dict[int, list[tuple[Postings, int]]] = {}
        for r in group[group.asked.notna()].itertuples():
            p = Postings(r.heads, r.data, norms)
            for item, w in zip(r.asked["item"], r.asked["w"], strict=True):
                if w > 0:
                    of.setdefault(int(item), []).append((p, int(w)))
        found = [(item, *best(own, len(ids), k)) for item, own in of.items()]
        docs, scores = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in found)]) for c in (1, 2))
        items = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
        return pd.DataFrame({"item": items, "doc_id": pd.Series(ids[docs], dtype="Int64").mask(~known[docs]), "score": scores})

    found = postings.unionByName(headers).groupBy("segment", "block").applyInPandas(meet, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


OP12_SQL = r"""
WITH words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)),
asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, item_id, coalesce(text, '') AS text FROM benchmark))
  GROUP BY ALL),
docs AS (SELECT rid, doc_id, count(*) AS n FROM words GROUP BY ALL),
sums AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
norms AS (SELECT rid, doc_id, 75 + (25 * n * big_n) // big_l AS m FROM docs, sums),
counts AS (SELECT rid, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sums GROUP BY term),
scores AS (
  SELECT item, item_id, rid, sum(w * times * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (rid) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
  FROM scores JOIN norms USING (rid) WHERE score > 0)
WHERE rank <= 20
"""
