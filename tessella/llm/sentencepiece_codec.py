"""SentencePiece encoding and decoding in batches.

A text is split where no piece reaches across: before runs of the space mark, around line breaks and around characters
that the vocabulary lacks. Each worker encodes words it has not seen yet, all of one length together (see
pieces.py: the Viterbi search over substring hashes that probe the sorted pieces), and joins the ids of a text's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import texts
from tessella.llm.pieces import Pieces, merge
from tessella.llm.token_counts import _chunks

SPACE = "▁"
NORMAL, BYTE, UNIGRAM, BPE = 1, 6, 1, 2

#: Words whose ids a Python worker remembers.
REMEMBERED, LONGEST = 400_000, 256
_remembered: dict[str, dict[str, bytes]] = {}
#: Bytes of text that encoded() takes at once.
PART = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Ids of texts and texts of ids, by a SentencePiece model with byte fallback, identity normalisation and a
    space put before a text. model: the file's bytes. Ids are 16 bits wide, so up to 65,536 pieces."""

    def __init__(self, model: bytes, name: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        rules, self.kind = spec.normalizer_spec, spec.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE) or rules.name != "identity" or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE or unigram model with identity normalisation, a dummy prefix and byte fallback is needed")
        texts_, kinds = [p.piece for p in spec.pieces], [p.type for p in spec.pieces]
        self.name, self.size = f"{name}/{self.kind}", len(texts_)
        normal = {t: i for i, (t, k) in enumerate(zip(texts_, kinds, strict=True)) if k == NORMAL}
        if any(SPACE in t.lstrip(SPACE) or "\n" in t for t in normal):
            raise ValueError("pieces that reach across words are not supported")
        self.byte_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(texts_, kinds, strict=True)) if k == BYTE}
        self.known = {t for t in normal if len(t) == 1}
        scores = np.array([p.score for p in spec.pieces], np.float32)
        merges = None
        if self.kind == BPE:
            order = sorted(set(scores[list(normal.values())].tolist()), reverse=True)
            rank = {s: k for k, s in enumerate(order)}
            rows = [(normal[t[:k]], normal[t[k:]], i, rank[float(scores[i])]) for t, i in normal.items() for k in range(1, len(t)) if t[:k] in normal and t[k:] in normal]
            # runs of spaces tie with each other: they are merged apart, as they rank below all else
            self.run_pairs = {(a, b): (r, m) for a, b, m, r in rows if not texts_[m].strip(SPACE)}
            if self.run_pairs and min(r for r, _ in self.run_pairs.values()) <= max(rank[float(scores[i])] for t, i in normal.items() if t.strip(SPACE)):
                raise ValueError("runs of spaces have to rank below all other pieces")
            merges = tuple(np.array(rows).T)
        usable = {i: tuple(map(ord, t)) for t, i in normal.items() if self.kind == UNIGRAM or t.strip(SPACE) or len(t) == 1}
        self.space = normal.get(SPACE)
        self.pieces = Pieces(usable, self.size, merges, scores if self.kind == UNIGRAM else None)
        self.shown = [t.encode() if k == NORMAL else bytes([int(t[3:5], 16)]) if k == BYTE else b"" for t, k in zip(texts_, kinds, strict=True)]
        self.shown = [t.replace(SPACE.encode(), b" ") for t in self.shown]
        self._compiled = None

    @classmethod
    def load(cls, path: str | None = None) -> Codec:
        path = path or default_path()
        with open(path, "rb") as f:
            return cls(f.read(), path)

    def __getstate__(self):
        return self.__dict__ | {"_compiled": None}

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)

    def words(self, text: str) -> list[str]:
        return re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", SPACE + text.replace(" ", SPACE)) if text else []

    def _run(self, n: int) -> list[int]:
        return merge([self.space] * n, self.run_pairs)[0] if n else []

    def _parts(self, word: str) -> list[str | list[int]]:
        """A word as strings of known characters, and ids of bytes between them."""
        if self._compiled is None:
            self._compiled = re.compile("[" + "".join(map(re.escape, sorted(self.known))) + "]+|.", re.DOTALL).findall
        found = self._compiled(word)
        return [p if p[0] in self.known else [self.byte_ids[b] for b in p.encode()] for p in found]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words as 16-bit numbers, new ones encoded all at once. Words are remembered between chunks but for long
        ones, so that what is kept is bounded in bytes; where they get too many, those of the chunk at hand stay. Most words have
        nothing but known characters and one space mark at most: their ids are cut out of the search's bytes."""
        known = _remembered.setdefault(self.name, {})
        new = [w for w in words if w not in known]
        if len(known) + len(new) > REMEMBERED:
            still = {w: known[w] for w in words if w in known}
            known.clear()
            known.update(still)
        split, long = [], {}
        if strange := set("".join(new)) - self.known:
            strange = re.compile("[" + "".join(map(re.escape, sorted(strange))) + "]").search
        plain = [w for w in new if w != SPACE and not w.startswith(SPACE * 2) and not (strange and strange(w))]
        if plain:
            for w, ids in zip(plain, self.pieces.bytes_of(plain, self.codes, np.uint16), strict=True):
                (known if len(w) <= LONGEST else long)[w] = ids
            new = [w for w in new if w not in known and w not in long]
        for w in new:
            body = w.lstrip(SPACE)
            run = len(w) - len(body)
            if self.kind == BPE and run > 1 or run and not body:
                split.append((run - bool(body), self._parts(SPACE * bool(body) + body)))
            else:
                split.append((0, self._parts(w)))
        own = list({p for _, parts in split for p in parts if isinstance(p, str)})
        ids = dict(zip(own, (x.tolist() for x in self.pieces.ids_of(own, self.codes)), strict=True))
        for w, (run, parts) in zip(new, split, strict=True):
            flat = [i for p in parts for i in (ids[p] if isinstance(p, str) else p)]
            if run and self.kind == UNIGRAM:
                flat = self.pieces.ids_of([w], self.codes)[0].tolist()
            elif run:
                free = flat[:1] == [self.space]  # nothing took the last space: it merges with the others
                flat = self._run(run + free) + flat[free:]
            (known if len(w) <= LONGEST else long)[w] = np.array(flat, np.uint16).tobytes()
        return known | long if long else known

    def encode(self, items: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in items]
        known = self.learn(set().union(*split))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint16) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that are no UTF-8 become replacement characters; the space put before it goes."""
        out = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def encode(text: Column, path: str | None = None) -> Column:
    """array<int>: the ids that the model's library gives, without added ones. Null counts as empty; empty: no ids. Long texts
    are encoded whole, equal texts have equal ids, and no other column is looked at."""
    codec = Codec.load(path)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x.astype(np.int32) for part in _chunks(batch.fillna("").tolist()) for x in codec.encode(part)], dtype=object)

    return run(text)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens and token_ids in place of text; columns of these names are replaced. A null text counts as empty: no
    ids. Repeated rows repeat; an empty table gives no rows. A batch stays in Arrow and its texts are taken in parts of about
    PART bytes, each of whose ids is handed on, so that memory stays bounded however many tokens a batch has."""
    codec = Codec.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, text = batch.columns
            held = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART
            starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]).tolist() if len(held) else []
            for start, end in zip(starts, [*starts[1:], len(held)]):
                ids = codec.encode([x or "" for x in text.slice(start, end - start).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(x.slice(start, end - start) for x in others), pa.array(np.diff(ends)), lists], names)

    others = [f for f in docs.schema.fields if f.name not in ("text", "n_tokens", "token_ids")]
    names = [*(f.name for f in others), "n_tokens", "token_ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_tokens int", "token_ids array<int>"])
    return docs.select(*(f"`{f.name}`" for f in others), "text").mapInArrow(run, schema)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids; null for null."""
    codec = Codec.load(path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else codec.decode(np.asarray(x)) for x in batch], dtype=object)

    return run(ids)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as 32-bit little-endian numbers), decoded_equal: of whole texts."""
    import zlib

    codec = Codec.load()

    @F.pandas_udf("n_tokens long, ids_crc32 long, decoded_equal boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for part in _chunks(batch.tolist()):
                for text, ids in zip(part, codec.encode(part), strict=True):
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), codec.decode(ids) == text))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_crc32", "decoded_equal"])

    rows = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", both("text").alias("t")).select("doc_id", "t.*")
