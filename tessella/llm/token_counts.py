"""Token counts of a byte-level BPE vocabulary by dynamic programming over prefixes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import texts
from tessella.llm.pieces import Pieces

#: White_Space of Unicode. The published pattern of byte-level BPE, with this class for its \s.
SPACE = r"\t-\r\x20\x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Words whose counts a Python worker remembers.
REMEMBERED = 400_000
_remembered: dict[str, tuple[dict[str, int], dict[str, bytes]]] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes for themselves,
    the others in order from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Counter:
    """Counts of words (bytes) and of texts, by the vocabulary in a tokenizer's JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.name = path
        vocab, byte = spec["model"]["vocab"], _byte_chars()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        rows = [(vocab[a], vocab[b], vocab[a + b], k) for k, (a, b) in enumerate(merges)]
        special = {t["content"] for t in spec["added_tokens"]}
        symbols = {i: tuple(byte[c] for c in t) for t, i in vocab.items() if t not in special}
        self.pieces = Pieces(symbols, max(vocab.values()) + 1, tuple(np.array(rows).T))
        assert len(special) <= 1, "one special token at most"
        self.special = max(special, default=None)
        self.special_bytes = len((self.special or "").encode())
        self._compiled = None

    @staticmethod
    def codes(words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(words), np.uint8)

    def words(self, text: str) -> list[str | None]:
        """The words within which bytes are merged; None stands for a special token."""
        if self._compiled is None:
            self._compiled = regex.compile(PATTERN).findall
        find = self._compiled
        if self.special is None or self.special not in text:
            return find(text)
        out: list[str | None] = []
        for k, part in enumerate(text.split(self.special)):
            out += [None] * bool(k)
            out += find(part)
        return out

    def learn(self, words: set[str]) -> tuple[dict[str, int], dict[str, bytes | np.ndarray]]:
        """The counts of words and of all their prefixes, new ones all at once. Words are remembered between chunks but for
        long ones, so that what is kept is bounded in bytes."""
        counts, prefixes = _remembered.setdefault(self.name, ({}, {}))
        if new := [w for w in words if w is not None and w not in counts]:
            if len(counts) + len(new) > REMEMBERED:
                counts.clear()
                prefixes.clear()
                new = list(words - {None})
            found = dict(zip(new, self.pieces.prefixes_of([w.encode() for w in new], self.codes), strict=True))
            short = {w: p for w, p in found.items() if len(p) <= 256}
            prefixes.update((w, p.astype(np.uint8).tobytes()) for w, p in short.items())
            counts.update((w, int(p[-1])) for w, p in short.items())
            if len(short) < len(found):
                long = {w: p for w, p in found.items() if w not in short}
                return counts | {w: int(p[-1]) for w, p in long.items()} | {None: 1}, prefixes | long
        counts[None] = 1
        return counts, prefixes

    def __getstate__(self):
        return self.__dict__ | {"_compiled": None}


def _chunks(items: list[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters: memory stays bounded with long texts."""
    part, held = [], 0
    for x in items:
        part.append(x)
        held += len(x)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def _counted(counter: Counter, items: list[str], limit: int) -> list[tuple[int, int]]:
    """(n_tokens, cut) of each text."""
    split = [counter.words(t) for t in items]
    counts, prefixes = counter.learn(set().union(*split))
    out = []
    for words in split:
        upto = list(accumulate(map(counts.__getitem__, words)))
        n = upto[-1] if upto else 0
        if n <= limit:
            out.append((n, -1))
            continue
        at = int(np.searchsorted(upto, limit, "right"))
        before = sum(len(w.encode()) if w is not None else counter.special_bytes for w in words[:at])
        left = limit - (upto[at - 1] if at else 0)
        out.append((n, before + (_longest(words[at].encode(), _counts(prefixes[words[at]]), left) if words[at] is not None else 0)))
    return out


def _counts(kept: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(kept, np.uint8).astype(np.int64) if isinstance(kept, bytes) else kept.astype(np.int64)


def _longest(word: bytes, counts: np.ndarray, left: int) -> int:
    """Bytes of a word's longest prefix of whole characters that takes so many tokens at most, by the counts of its prefixes."""
    return max(j for j in np.flatnonzero(counts <= left).tolist() if j == len(word) or word[j] & 0xC0 != 0x80)


def token_counts(text: Column, path: str | None = None, limit: int = 1024) -> Column:
    """struct<n_tokens long, cut long> of a text column, null counting as empty.

    n_tokens: tokens of the whole text, without added ones; special tokens' strings inside the text are one token
    each. cut: bytes of the longest prefix of whole characters that takes at most limit tokens; -1 if all fit. The count of
    every prefix of a word is kept while it is encoded, so the cut is looked up and nothing is encoded again. Empty texts
    have 0 tokens, equal texts equal values, and no other column is looked at.
    """
    counter = Counter(path or default_path())

    @F.pandas_udf("n_tokens long, cut long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for part in _chunks(batch.fillna("").tolist()) for r in _counted(counter, part, limit)]
            yield pd.DataFrame(rows, columns=["n_tokens", "cut"])

    return count(text)


def prefix_counts(text: Column, path: str | None = None) -> Column:
    """array<int> (null counts as empty): for each prefix of the text in bytes, the tokens of the words before its last word and of the part
    of that word. Element n + 1 answers how many tokens the first n bytes take, without another encoding."""
    counter = Counter(path or default_path())

    @F.pandas_udf("array<int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch.fillna(""):
                words = counter.words(t)
                own = sorted({w for w in words if w})
                table = counter.learn(set(own))[1]
                parts, n = [np.zeros(1, np.int64)], 0
                for w in words:
                    c = _counts(table[w])[1:] if w is not None else np.ones(counter.special_bytes, np.int64)
                    parts.append(c + n)
                    n += int(c[-1])
                out.append(np.concatenate(parts))
            yield pd.Series(out)

    return count(text)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    rows = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_counts(F.col("text")).alias("t"))
    return rows.select("doc_id", "n_bytes", "t.n_tokens", (F.col("t.n_tokens") > 1024).alias("over_limit"), F.when(F.col("t.cut") >= 0, F.col("t.cut")).alias("cut_bytes"))
