"""Secret scans by zstandard novelty: how many bytes a string adds to the compressed code around it.

Assignments, access keys and hexadecimal runs are found by their patterns. Beyond these, a candidate is a run of key
characters after a sensitive word on its line. It is measured against what is around it: the text beside it is compressed
with and without the candidate, both primed with a dictionary of the corpus' identifiers, and the difference is the
candidate's marginal size. Names that the corpus or the text beside it knows cost few bytes; a string that costs nearly a
byte a character is nothing that could be copied from there, and is reported as novel.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import forget, table, texts, written

#: Fixed patterns of the base kinds, in the order in which spans with one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_VALUE = 6

SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)?\b|secret|token|key|auth|credential|bearer|private|signature|session|cookie", re.IGNORECASE | re.ASCII)
#: No assignment stands in a text without one of these.
NAMES = ("passw", "secret", "token", "apikey", "api_key")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{5,}")
#: Placeholders and sequences that are no secrets, ahead of the corpus' identifiers.
PLACEHOLDERS = "0123456789 0000000000 1111111111 xxxxxxxxxxxx ............ ------------ ============ ____________ abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ changeme example placeholder undefined password secret token api_key"
#: Characters of texts whose words are counted together.
CHARS = 2_000_000
#: Levels of counts between a count and its double: few in all, so they may be on the driver.
LEVELS = 8


@dataclass(frozen=True)
class Novelty:
    """least_chars: of a candidate. reach: so many characters before it, on its line, may hold the sensitive word. around:
    characters of surrounding text on either side. least_ratio: marginal bytes for each of the candidate's bytes from which
    it is reported. dictionary_bytes: of identifiers that prime the compressor, the most widely used first; level: of
    compression."""

    least_chars: int = 16
    reach: int = 48
    around: int = 256
    least_ratio: float = 0.75
    dictionary_bytes: int = 1 << 16
    level: int = 9


def identifier_dictionary(docs: DataFrame, novelty: Novelty = Novelty()) -> bytes:
    """The identifiers (six characters or more) that most rows of docs use, the most used last, where they are the cheapest to
    refer to. All rows are counted; what is kept is bounded by dictionary_bytes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, held = Counter(), 0
            for k, t in enumerate(batch.text, 1):
                found.update(set(IDENTIFIER.findall(t)))
                held += len(t)
                if found and (held >= CHARS or k == len(batch)):  # a frame without rows has no strings to be taken for
                    yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                    found, held = Counter(), 0

    found = texts(docs).select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # of a word in one text only no other text can be made up
    counted = written(found.filter("n > 1 and length(word) <= 256").withColumn("level", F.floor(LEVELS * F.log2("n")).cast("int")), "secret-words")
    # a word and its blank take seven bytes at least; whole levels of counts are taken while that many words fit
    most, least, held = novelty.dictionary_bytes // 7, None, 0
    for r in sorted(counted.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r.n
        if held > most:
            break
        least = r.level
    top = sorted(counted.filter(F.col("level") >= least).collect(), key=lambda r: (-r.n, r.word)) if least is not None else []
    forget(counted)
    words, room = [], novelty.dictionary_bytes - len(PLACEHOLDERS) - 1
    for r in top:
        room -= len(r.word) + 1
        if room < 0:
            break
        words.append(r.word)
    return " ".join([PLACEHOLDERS, *reversed(words)]).encode()


class Scanner:
    """Finds the spans of one text after another."""

    def __init__(self, dictionary: bytes, novelty: Novelty = Novelty()):
        import zstandard

        self.novelty = novelty
        self.run = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % novelty.least_chars)
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=novelty.level)
        self.compressor = zstandard.ZstdCompressor(level=novelty.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def marginal(self, text: str, start: int, end: int) -> tuple[int, float]:
        """Bytes that text[start:end] adds to what is around it, and these by its own bytes. Other places where the same string
        stands are no surroundings: a secret that is written twice is as new."""
        own = text[start:end].encode()
        before, after = (text[a:b].encode().replace(own, b"") for a, b in ((max(0, start - self.novelty.around), start), (end, end + self.novelty.around)))
        added = len(self.compressor.compress(before + own + after)) - len(self.compressor.compress(before + after))
        return added, added / max(1, len(own))

    def base(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, kind, end, where the value begins) of the base kinds."""
        lower = text.lower()
        named = ASSIGN.finditer(text) if any(n in lower for n in NAMES) else ()
        out = [(m.start(), 0, m.end(), m.start(2)) for m in named if m.end(2) - m.start(2) >= LEAST_VALUE]
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            out += [(m.start(), kind, m.end(), m.start()) for m in pattern.finditer(text)]
        return sorted(out)

    def candidates(self, text: str) -> Iterator[tuple[int, int]]:
        """Runs of key characters after a sensitive word: it stands in the `reach` characters before, on the same line, or
        ahead of an equals sign in the run itself, whose value is then the candidate."""
        for m in self.run.finditer(text):
            start, end = m.span()
            value = start + m[0].rstrip("=").rfind("=") + 1
            if end - value >= self.novelty.least_chars:
                ahead = text[max(0, start - self.novelty.reach) : value]
                if SENSITIVE.search(ahead[ahead.rfind("\n") + 1 :]):
                    yield value, end

    def spans(self, text: str) -> list[dict]:
        """kind, start, end (code points), added_bytes and novelty of all spans, by start and kind."""
        base = self.base(text)
        out = []
        for start, kind, end, value in base:
            added, ratio = self.marginal(text, value, end)
            out.append((start, kind, end, added, ratio))
        ends, at, covered = [(s, e) for s, _, e, _ in base], 0, 0
        for start, end in self.candidates(text):
            while at < len(ends) and ends[at][0] < end:
                covered = max(covered, ends[at][1])
                at += 1
            if covered > start:
                continue
            added, ratio = self.marginal(text, start, end)
            if ratio >= self.novelty.least_ratio:
                out.append((start, 3, end, added, ratio))
        return [{"kind": KINDS[k], "start": s, "end": e, "added_bytes": a, "novelty": r} for s, k, e, a, r in sorted(out)]


SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, added_bytes: long, novelty: double>>"


def secret_spans(docs: DataFrame, novelty: Novelty = Novelty(), dictionary: bytes | None = None) -> DataFrame:
    """SPANS for each row of docs. dictionary: what primes the compressor; the identifiers of docs if None.

    A null text counts as empty and has no spans; repeated rows repeat; null ids stay null; texts are scanned whole, however
    long, and only the surroundings of candidates are compressed; an empty table gives no rows; other columns are not looked
    at. No row is shuffled.
    """
    primed = identifier_dictionary(docs, novelty) if dictionary is None else dictionary

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(primed, novelty)
        for batch in batches:
            found = pd.DataFrame({"doc_id": batch.doc_id.astype("Int64").mask(~batch.known), "spans": [scanner.spans(t) for t in batch.text]})
            yield found

    rows = texts(docs).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    return rows.mapInPandas(scan, SPANS)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n_of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", n_of("assign"), n_of("access"), n_of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n_of("novel"))
