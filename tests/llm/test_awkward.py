"""Awkward rows, computed and compared: nulls, empty and very long texts, ties, repeated rows, clashing names, empty tables."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mpeg_media, sentencepiece_codec, source_mix, token_counts, toxicity

LONG = "x " * 30_000
WIDE = "日本語テキスト" * 15_000
SAME = "same text here and more"
ROWS = [(1, None, None, "en"), (2, "", "b", None), (3, SAME, "a", "en"), (4, SAME, "a", "en"), (None, SAME, "a", "en"), (5, LONG, "b", "de"), (3, SAME, "a", "en"), (6, WIDE, "c", "ja"), (None, None, "a", None)]
#: Names that the operators use themselves, or might.
CLASHING = ("_p", "_k", "_src", "_w", "_m", "_maybe", "score", "n_tokens", "row_id", "row", "cid", "node", "key", "n", "u", "plan", "class", "size", "word", "digest", "_row", "mean", "line", "a", "b", "place")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string").withColumns({c: F.lit("mine") for c in CLASHING})


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def expected(f):
    return Counter((i, *f(t or "")) for i, t, _, _ in ROWS)


def test_pieces_and_counts(awkward):
    import sentencepiece
    from tokenizers import Tokenizer

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    out = sentencepiece_codec.encoded(awkward.select("doc_id", "text", "n_tokens"))
    assert out.columns == ["doc_id", "n_tokens", "token_ids"]
    # nulls among whole numbers come back as floating ones from pandas, so ids are compared as numbers
    got = Counter((None if r.doc_id is None else int(r.doc_id), r.n_tokens, tuple(r.token_ids)) for r in out.filter("doc_id is not null").collect())
    assert got == Counter((i, len(x), tuple(x)) for i, t, _, _ in ROWS if i for x in [lib.encode(t or "")])
    tokens = Tokenizer.from_file(token_counts.default_path())
    got = rows_of(awkward.select("doc_id", token_counts.token_counts(F.col("text")).alias("t")).select("doc_id", "t.n_tokens"), "doc_id", "n_tokens")
    assert got == expected(lambda t: (len(tokens.encode(t, add_special_tokens=False).ids),))


def test_media(awkward):
    read = awkward.select("doc_id", mpeg_media.read(mpeg_media.store(F.col("text"))).alias("m"))
    names = read.select("m.*").columns
    assert "payload_sha256" in names
    padded = lambda t: t.encode() + b"\xff" * (max(1, -(-len(t.encode()) // 576)) * 576 - len(t.encode()))
    assert rows_of(read.select("doc_id", "m.payload_sha256"), "doc_id", "payload_sha256") == expected(lambda t: (hashlib.sha256(padded(t)).hexdigest(),))


def test_licences(awkward):
    got = rows_of(license_scan.license_scan(awkward), "doc_id", "n_words", "n_base", "first_word", "labels", "score")
    words = lambda t: len(t.split()) if t != WIDE else 1
    assert got == expected(lambda t: (words(t), 0, None, "", 0.0))


def test_jaccard(awkward):
    got = rows_of(jaccard_join.jaccard_classes(awkward), "doc_id", "n_shingles", "component_id")
    assert got == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 1, 3): 2, (4, 1, 3): 1, (None, 1, 3): 1, (5, 1, 5): 1, (6, 1, 6): 1, (None, 0, None): 1})


def test_languages(awkward):
    got = language_id.language_id(awkward, language_id.learn(awkward)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in ROWS)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is not None}
    assert by[1] == by[2] == ("und", 0.0) and by[3] == by[4]
    odd = awkward.limit(1).select(F.explode(F.array(F.lit("½ ²"), F.lit("Ⅷ 123 _"), F.lit("a½"))).alias("text"), F.lit(1).alias("doc_id"))
    assert [r.lang_pred for r in language_id.language_id(odd, language_id.learn(awkward)).collect()].count("und") == 2


def test_lines(spark, awkward):
    drop = Counter((r.doc_id, r.line_no, r["drop"]) for r in line_dedup.flagged_lines(awkward).collect())
    # null ids come first, so the same line stands first without one
    assert drop == Counter({(None, 0, None): 1, (3, 0, "exact"): 2, (4, 0, "exact"): 1, (5, 0, None): 1, (6, 0, None): 1})
    kept = rows_of(line_dedup.line_dedup(awkward), "doc_id", "text")
    assert kept[(5, LONG)] == kept[(6, WIDE)] == kept[(1, "")] == 1 and kept[(3, "")] == 2 and kept[(None, SAME)] == 1


def test_mix(awkward):
    mixed = source_mix.mix_sources(awkward)
    assert mixed.columns[: len(awkward.columns)] == awkward.columns and mixed.filter("u = 'mine' and _p = 'mine' and row = 'mine'").count() == len(ROWS)
    words = lambda t: len((t or "").split())
    sizes = {s: sum(words(t) for _, t, x, _ in ROWS if x == s) for s in (None, "a", "b", "c")}
    got = rows_of(mixed, "doc_id", "mix_size", "mix_source_size")
    assert got == Counter((i, words(t), sizes[s]) for i, t, s, _ in ROWS)
    assert all(0 <= r.mix_copies <= 3 for r in mixed.collect())


def test_copies(awkward):
    got = rows_of(exact_dedup.exact_dedup(awkward, "largest"), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    group = {"": (2, 3), SAME: (4, 4), LONG: (5, 1), WIDE: (6, 1)}
    assert got == Counter((i, group[t or ""][0], group[t or ""][1], i == group[t or ""][0], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in ROWS)


def test_toxic_scores(spark, awkward):
    docs = awkward.unionByName(spark.createDataFrame([(k, f"plain words {k} " + ("vile scum" if k % 2 else "kind soul") + " here", "s", "en") for k in range(10, 80)], "doc_id long, text string, source string, lang string").withColumns({c: F.lit("mine") for c in CLASHING}))
    labels = spark.createDataFrame([(k, k % 2) for k in range(10, 80)] + [(None, 1), (11, None), (11, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity(awkward, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert by[1] == by[2] and by[3] == by[4]
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.toxicity(awkward, none).collect()} == {0.0}


def test_stages(spark, awkward):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, "/root/testdata/sf0.001")
        if name != "SentencePiece encoding":
            assert out.columns == awkward.columns, name
            assert out.filter("_p != 'mine' or row_id != 'mine' or row != 'mine'").count() == 0
        assert stage(spark, awkward.filter("false"), "/root/testdata/sf0.001").count() == 0, name
    once = rows_of(corpus_pipeline.drop_copies(spark, awkward, ""), "doc_id", "text")
    assert once == Counter({(2, ""): 1, (4, SAME): 1, (5, LONG): 1, (6, WIDE): 1})
    near = rows_of(corpus_pipeline.drop_near_copies(spark, awkward, ""), "doc_id", "text")
    assert near == Counter({(1, None): 1, (2, ""): 1, (3, SAME): 2, (5, LONG): 1, (6, WIDE): 1, (None, None): 1})


def test_empty_tables(spark, awkward):
    none = awkward.filter("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for name, out in {
        "copies": exact_dedup.exact_dedup(none), "mix": source_mix.mix_sources(none), "scan": license_scan.license_scan(none), "jaccard": jaccard_join.jaccard_classes(none),
        "lines": line_dedup.line_dedup(none), "flags": line_dedup.flagged_lines(none), "language": language_id.language_id(none, language_id.learn(none)),
        "toxicity": toxicity.toxicity(none, toxicity.fit(none, labels)), "pieces": sentencepiece_codec.encoded(none.select("doc_id", "text")),
    }.items():
        assert out.collect() == [], name


@pytest.mark.parametrize("text", ["a" * 40_000, "ab" * 20_000, "字符" * 20_000, "-" * 30_000 + "x", "x " + "é" * 9_000 + " y", "zq" * 700 + " " + "ha" * 4_000], ids=lambda t: t[:3])
def test_words_of_any_length_as_the_libraries_give_them(text):
    """Runs that no place cuts too: a million characters take seconds, not minutes."""
    import sentencepiece
    import tokenizers

    codec = sentencepiece_codec.Codec.load()
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    assert codec.encode([text])[0].tolist() == library.encode(text)
    counter = token_counts.Counter(token_counts.default_path())
    words = counter.words(text)
    counts, prefixes = counter.learn(set(words))
    assert sum(counts[w] for w in words) == len(tokenizers.Tokenizer.from_file(token_counts.default_path()).encode(text, add_special_tokens=False).ids)
    longest = max(words, key=len)
    table = token_counts._counts(prefixes[longest])
    for n in (1, 700, 1024, 1025, 2000, len(longest.encode())):
        part = longest.encode()[:n]
        if len(part) == n:
            assert table[n] == counter.pieces.prefixes_of([part], counter.codes)[0][-1]
