"""The learned models against brute force, and queries against the libraries on a whole table."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import language_id, registry, sentencepiece_codec, token_counts, toxicity
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def pairs_of(text):
    w = WORD.findall(text.lower())
    return list(zip([None, *w], w))


def brute_model(learned, s):
    """word(k, w), given(k, l, w) of the classes (0: toxic) and all words, from (text, toxic) rows, by the formulas of interpolated
    absolute discounting."""
    counts = Counter(), Counter()
    for text, toxic in learned:
        counts[0 if toxic else 1].update(pairs_of(text))
    both = counts[0] + counts[1]
    contexts = [Counter(w for _, w in c) for c in (*counts, both)]
    total = [sum(c.values()) for c in contexts]
    free = [sum(min(v, s.word_discount) for v in c.values()) for c in contexts]
    rest = lambda n: max(n - s.pair_discount, 0.0)
    lefts = {left for left, _ in both}
    after = {left: [(w, n) for (x, w), n in both.items() if x == left] for left in lefts}
    kept = [{left: sum(rest(c[left, w]) for w, _ in after[left]) for left in lefts} for c in (*counts, both)]

    def word(k, w):
        shared = (contexts[2][w] + 0.5) / (total[2] + 0.5 * len(contexts[2]) + 1)
        return (max(contexts[k][w] - s.word_discount, 0.0) + free[k] * shared) / total[k]

    def given(k, left, w):
        if not kept[2].get(left):
            return word(k, w)
        weight = kept[2][left] / (sum(n for _, n in after[left]) + s.floor)
        pair = (rest(counts[k][left, w]) + s.prior * rest(both[left, w]) / kept[2][left]) / (kept[k][left] + s.prior)
        return weight * pair + (1 - weight) * word(k, w)

    return word, given, list(contexts[2]), lefts


def brute_means(learned, texts, s):
    """Mean log ratio of the mixture by text."""
    _, given, _, _ = brute_model(learned, s)
    out = {}
    for text in texts:
        own = pairs_of(text)
        out[text] = sum(math.log(1 - s.share + s.share * given(0, *x) / given(1, *x)) for x in own) / (len(own) + s.pad)
    return out


def test_estimates_are_distributions():
    rng = random.Random(6)
    learned = [(" ".join(rng.choices("abcdefghij", k=40)) + " vile" * (k % 3), int(k % 3 == 0)) for k in range(60)]
    word, given, words, lefts = brute_model(learned, toxicity.Smoothing())
    for k in range(2):
        unseen = 1 - sum(word(k, w) for w in words)
        assert 0 <= unseen < 0.01
        for left in lefts:
            assert abs(sum(given(k, left, w) for w in words) + unseen - 1) < 0.01


@pytest.mark.parametrize("head", [1 << 19, 5])
def test_toxic_means_against_brute_force(spark, monkeypatch, head):
    """With five words in memory, all others are joined."""
    monkeypatch.setattr(toxicity, "HEAD", head)
    rng, common = random.Random(2), [a + b for a in "bcdfg" for b in ("aa", "ee", "oo", "é")]
    docs = []
    for k in range(150):
        words = rng.choices(common, k=rng.randint(1, 60))
        if k % 3 == 0:
            words += rng.choice((["vile", "scum"], ["you", "fool", "you"]))
        docs.append((k, " ".join(words) + ("!" if k % 2 else "")))
    docs += [(200, docs[0][1]), (201, None)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in docs], "doc_id long, toxic int")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(rows, labels)
    learned = toxicity.labelled(rows, labels).filter(F.pmod(F.xxhash64("row_id", F.lit("fit")), F.lit(8 * 10**6)) >= 10**6).select("text", "toxic").collect()
    assert len(learned) < len(docs)
    new = {t or "" for _, t in docs} | {"vile", "scum vile", "unseen words only", "fool you fool"}
    want = brute_means([tuple(r) for r in learned], new, model.smoothing)
    asked = spark.createDataFrame(list(enumerate(sorted(new))), "doc_id long, text string")
    got = toxicity._means(toxicity.texts(asked).withColumn("row_id", toxicity.row_id()), model).join(asked, "doc_id").collect()
    assert len(got) == len(new)
    for r in got:
        assert abs(r["mean"] - want[r.text]) < 1e-9, r
    assert len({round(x, 9) for x in want.values()}) > 0.9 * len(want)


def test_what_texts_ask_of_the_table_is_rows_of_arrays(spark, monkeypatch):
    """With a few words in memory, rows that go to the table and back do not grow with the words of texts, nor sums with the way
    texts are cut."""
    monkeypatch.setattr(toxicity, "HEAD", 5)
    rng, common = random.Random(3), [a + b for a in "bcdfghjklm" for b in ("aa", "ee", "oo", "uu", "ii")]
    docs = [(k, " ".join(rng.choices(common, k=300) + (["vile", "scum"] if k % 3 == 0 else []))) for k in range(90)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(rows, spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in docs], "doc_id long, toxic int"))
    asked = toxicity.texts(rows).withColumn("row_id", toxicity.row_id()).coalesce(1)
    plain = toxicity._means(asked, model)
    whole = sorted(tuple(r) for r in plain.collect())
    made = {}
    walk = [plain._jdf.queryExecution().executedPlan().finalPhysicalPlan()]
    while walk:
        node = walk.pop()
        if node.nodeName() in ("MapInPandas", "FlatMapCoGroupsInPandas"):
            made[node.nodeName()] = node.metrics().apply("pythonNumRowsReceived").value()
        walk += [node.children().apply(k) for k in range(node.children().size())] + ([node.plan()] if node.nodeName() == "ShuffleQueryStage" else [])
    assert len(made) == 2 and all(len(docs) < x <= len(docs) + toxicity.BUCKETS for x in made.values()), made
    for name, most in (("HELD", 50), ("TEXTS", 3), ("CHARS", 500)):
        monkeypatch.setattr(toxicity, name, most)
    cut = sorted(tuple(r) for r in toxicity._means(asked, model).collect())
    assert [r[:2] for r in cut] == [r[:2] for r in whole] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(cut, whole, strict=True))


def test_languages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()

    def grams(text):
        letters = re.sub(r"[^\W\d_]+", lambda m: m[0], text.lower())
        runs = "".join(c if c.isalpha() else " " for c in letters).split()
        return Counter(g for w in runs for n in (1, 2, 3) for p in [f" {w} "] for g in (p[i : i + n] for i in range(len(p) - n + 1)) if g != " ")

    def order(counts):
        key = lambda g: [0] * (3 - len(g)) + [ord(c) for c in g]
        return sorted(counts, key=lambda g: (-counts[g], key(g)))[: language_id.PROFILE]

    sums = {}
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            sums.setdefault(r.lang, Counter()).update(grams(r.text))
    places = {lang: {g: k for k, g in enumerate(order(c))} for lang, c in sums.items()}
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in registry.QUERIES["op6_language_id"](spark, DATA).collect()}
    for r in docs:
        own = order(grams(r.text or ""))
        near = sorted((sum(abs(k - at[g]) if g in at else language_id.PROFILE for k, g in enumerate(own)), lang) for lang, at in places.items())
        both = near[0][0] + near[1][0]
        assert got[r.doc_id] == ((near[0][1], round(near[1][0] / both if both else 0.5, 9)) if own else ("und", 0.0)), r.doc_id


def test_queries_against_the_libraries(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    ids = {k: lib.encode(t) for k, t in texts.items()}
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in registry.QUERIES["op1_sentencepiece"](spark, DATA).collect()} == {k: (len(x), crc(x)) for k, x in ids.items()}
    tokens = Tokenizer.from_file(token_counts.default_path())
    n = {k: len(tokens.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.QUERIES["op2_token_counts"](spark, DATA).collect()}
    assert got == {k: (len(t.encode()), n[k], n[k] > 1024) for k, t in texts.items()}
    payload = {k: t.encode() + b"\xff" * (max(1, -(-len(t.encode()) // 576)) * 576 - len(t.encode())) for k, t in texts.items()}
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.tail_crc32) for r in registry.QUERIES["op4_mpeg_media"](spark, DATA).collect()}
    assert got == {k: (len(t.encode()), len(payload[k]), zlib.crc32(payload[k][-32:])) for k, t in texts.items()}


def test_toxicity_query_against_brute_force(spark):
    """The registered result: each score from brute-force means and the two numbers that turn means into odds."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    learned = toxicity.labelled(docs, labels).filter(F.pmod(F.xxhash64("row_id", F.lit("fit")), F.lit(8 * 10**6)) >= 10**6).select("text", "toxic").collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    means = brute_means([tuple(r) for r in learned], set(texts.values()), model.smoothing)
    got = registry.QUERIES["op10_toxicity"](spark, DATA).collect()
    assert len(got) == len(texts) and {r.predicted for r in got} == {0, 1}
    for r in got:
        want = 1 / (1 + math.exp(-(model.slope * math.asinh(means[texts[r.doc_id]] / toxicity.SCALE) + model.offset)))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_only_odd_words_are_taken_apart(monkeypatch):
    """Words of known characters go to the search at once, and those at hand outlast a clearing of what is remembered."""
    import sentencepiece

    texts = ["the cat sat on the mat", "náive  two   gaps \n x", "漢字 \U0001f600the", "", " ", "a" * 300 + " the"]
    lib, codec, apart, searched = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path()), sentencepiece_codec.Codec.load(), [], []
    parts, search = codec._parts, codec.pieces.bytes_of
    monkeypatch.setattr(sentencepiece_codec, "_remembered", {})
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 10)
    monkeypatch.setattr(codec, "_parts", lambda w: apart.append(w) or parts(w))
    monkeypatch.setattr(codec.pieces, "bytes_of", lambda words, *more: searched.extend(words) or search(words, *more))
    assert [x.tolist() for x in codec.encode(texts[:1])] == [lib.encode(texts[0])] and apart == []
    assert [x.tolist() for x in codec.encode(texts)] == [lib.encode(t) for t in texts]
    assert "▁cat" not in apart and searched.count("▁cat") == searched.count("▁the") == 1


def test_encoded_keeps_large_ids_beside_nulls(spark):
    rows = [(2**60 + 1, "one two"), (None, None), (7, "")]
    got = sentencepiece_codec.encoded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    codec = sentencepiece_codec.Codec.load()
    assert [(r.doc_id, r.n_tokens, r.token_ids) for r in got] == [(i, len(x), x) for (i, _), x in zip(rows, (x.tolist() for x in codec.encode([t or "" for _, t in rows])))]
