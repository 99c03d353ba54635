"""The subpackage's operators against SQL, libraries and brute force, and on awkward rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import common, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mpeg_media, registry, sentencepiece_codec, source_mix, token_counts, toxicity
from tests.conftest import DATA

AWKWARD = [(1, None, None, "en", 7), (2, "", "b", None, 7), (3, "same text here and more", "a", "en", 7), (4, "same text here and more", "a", "en", None), (None, "same text here and more", "a", "en", 7), (5, "x " * 30_000, "b", "de", 7), (3, "same text here and more", "a", "en", 7)]
COLUMNS = "doc_id long, text string, source string, lang string, score int"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, COLUMNS)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


def test_operators_take_awkward_and_empty_rows(spark, awkward):
    labels = spark.createDataFrame([(3, 1, 1), (5, 1, 0), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    run = {
        "dedup": exact_dedup.exact_dedup,
        "mix": source_mix.mix_sources,
        "scan": license_scan.license_scan,
        "jaccard": jaccard_join.jaccard_classes,
        "lines": line_dedup.line_dedup,
        "language": lambda d: language_id.language_id(d, language_id.learn(d)),
        "toxicity": lambda d: toxicity.toxicity(d, toxicity.fit(d, labels)),
        "tokens": lambda d: d.select("doc_id", token_counts.token_counts(F.col("text"))),
        "pieces": lambda d: d.select("doc_id", sentencepiece_codec.encode(F.col("text"))),
        "media": lambda d: d.select("doc_id", mpeg_media.read(mpeg_media.store(F.col("text")))),
    }
    for name, f in run.items():
        assert f(awkward).count() == len(AWKWARD), name
        assert f(awkward.filter("false")).count() == 0, name
    got = {(r.doc_id, r.kept, r.group_size) for r in exact_dedup.exact_dedup(awkward, "largest").collect()}
    assert got == {(1, False, 2), (2, True, 2), (3, False, 4), (4, True, 4), (None, False, 4), (5, True, 1)}


def test_dedup_tells_colliding_digests_apart(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate("abacab")], "doc_id long, text string")
    same = exact_dedup.exact_dedup(rows, "smallest", digest=lambda c: F.unhex(F.sha2(F.lit("x"), 256)))
    assert {(r.doc_id, r.keep_id) for r in same.collect()} == {(0, 0), (2, 0), (4, 0), (1, 1), (5, 1), (3, 3)}


def test_token_counts_are_the_librarys():
    from tokenizers import Tokenizer

    path = token_counts.default_path()
    lib, own = Tokenizer.from_file(path), token_counts.Counter(path)
    texts = ["", "don't I'll  x   y\n\n z", "<|endoftext|> a<|endoftext|>", "日本語 ½Ⅷ ² \x1c a\x85b", "a" * 3000, " " * 300 + "x", "\t\r\n", "😀" * 50]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    got = token_counts._counted(own, texts, 20)
    assert [n for n, _ in got] == list(map(len, want))
    for t, w, (_, cut) in zip(texts, want, got, strict=True):
        assert (cut < 0) == (len(w) <= 20)
        if cut >= 0:  # the longest prefix of whole characters that the budget allows, each word's part encoded by itself
            size, words = 0, own.words(t)
            at = next(k for k in range(len(words) + 1) if sum(len(lib.encode(x or "<|endoftext|>", add_special_tokens=False).ids) for x in words[: k + 1]) > 20)
            n = sum(len(lib.encode(x or "<|endoftext|>", add_special_tokens=False).ids) for x in words[:at])
            before = sum(len((x or "<|endoftext|>").encode()) for x in words[:at])
            takes = [len(lib.encode((words[at] or "")[:j], add_special_tokens=False).ids) for j in range(len(words[at] or "") + 1)]
            size = max(j for j, x in enumerate(takes) if n + x <= 20)
            assert cut == before + len((words[at] or "")[:size].encode())


def test_counts_of_prefixes(spark):
    text = "Hello wonderful prefixes"
    got = spark.createDataFrame([(text,)], "t string").select(token_counts.prefix_counts(F.col("t")).alias("p")).first().p
    own = token_counts.Counter(token_counts.default_path())
    assert got == [sum(own.learn(set(own.words(text[:k])))[0][w] for w in own.words(text[:k])) for k in range(len(text) + 1)]


@pytest.mark.parametrize("unigram", [False, True])
def test_pieces_are_the_librarys(unigram):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(sentencepiece_codec.default_path(), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if unigram:
        model.trainer_spec.model_type = 1
        for p in model.pieces:
            p.score = max(p.score, -40000.0)
    raw = model.SerializeToString()
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepiece_codec.Codec(raw, f"test{unigram}")
    texts = [" a  b", "", "don't   x    y\n\n z", "日本語 ½Ⅷ ²", "a" * 500, " " * 40 + "x", "\t\r\n", "<s>x</s><0x0A>", "a\x00b", "Straße naïve été"]
    got = own.encode(texts)
    assert [g.tolist() for g in got] == lib.encode(texts)
    assert [own.decode(g) for g in got] == texts


def test_media_round_trip_and_lost_bytes():
    for data in (b"", b"abc", bytes(range(256)) * 40, b"\xff\xfb" * 3000):
        stream = mpeg_media.write_stream(data)
        s = mpeg_media.read_stream(stream)
        n = max(1, -(-len(data) // 576))
        assert s.payload == data + b"\xff" * (n * 576 - len(data))
        assert (len(s.offsets), s.table, s.table_frames, s.crc_bad, s.payload_bad, s.resyncs) == (n, "Xing", n, 0, 0, 0)
        assert s.micros == n * 24_000 and s.tags["TXXX:payload"] == str(len(data))
    broken = mpeg_media.read_stream(stream[:200] + b"junk\xff\xfb" + stream[200:])
    assert broken.resyncs == 1 and broken.skipped > 0
    assert mpeg_media.read_stream(b"no audio at all").offsets == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, x, k):
    x = list(x)
    for _ in range(k):
        at = rng.randint(0, len(x))
        x[at : at + rng.randint(0, 1)] = rng.choice(([], [rng.choice("abx😀")]))
    return "".join(x)


def test_banded_distance_against_brute_force(spark):
    rng = random.Random(8)
    pairs = [("", ""), ("a", ""), ("ab", "ba"), ("abc", "bcd"), ("日本語", "日本")]
    for n in [*range(1, 12), 40, 90]:
        for _ in range(25):
            x = "".join(rng.choice("abé😀") for _ in range(n))
            pairs.append((x, edited(rng, x, rng.randint(0, 4))))
    rows = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        for r in rows.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            want = distance(r.a, r.b)
            assert r.d == want if want <= k else r.d > k, (r, want, k)


@pytest.mark.parametrize("hot", [64, 2])
def test_lines_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup.near_lines, "__defaults__", (line_dedup.BANDS, hot))
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefg é日") for _ in range(rng.randint(4, 40))) for _ in range(24)]
    docs = [(i, "\n".join(edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(1, 6)))) for i in range(90)] + [(190, None), (191, "\n\n"), (192, "short\nshort\nshoot\nab\nac")]
    places = [(i, k, line) for i, t in docs for k, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    first = {}
    for i, k, line in places:
        first.setdefault(line, (i, k))
    allowed = lambda n: 2 if n >= 20 else 1 if n >= 5 else 0
    near = {a: any(first[b] < first[a] and abs(len(a) - len(b)) <= 2 and distance(a, b) <= allowed(min(len(a), len(b))) for b in first) for a in first}
    assert sum(near.values()) > 20
    want = {(i, k): "exact" if first[line] != (i, k) else "near" if near[line] else None for i, k, line in places}
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.line_no): r["drop"] for r in line_dedup.flagged_lines(rows).collect()} == want


def components_by_hand(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def near_texts(seed=5):
    rng, words, out = random.Random(seed), [f"w{i}" for i in range(300)], []
    for size, n in ((60, 20), (100, 12), (30, 3), (80, 9)):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(n):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(size)] = rng.choice(words)
            out.append(" ".join(x))
    out += ["a", "a b", "A  b", "", None, "a b c", "x y"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("words", "percent", "line"), [(3, 90, 4096), (3, 90, 3), (5, 80, 4096), (5, 80, 2), (2, 50, 2)])
def test_jaccard_against_brute_force(spark, monkeypatch, words, percent, line):
    """Short lines of neighbours leave many links to the pairs that remain."""
    monkeypatch.setattr(jaccard_join, "LINE", line)
    texts = near_texts(words * percent)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(rows, jaccard_join.Join(words, percent)).collect()}
    assert got == components_by_hand(texts, words, percent)


def test_jaccard_of_more_classes_than_one_line_on_a_shingle(spark, monkeypatch):
    """90 texts that have most of their words in common, of which some are linked: classes of one shingle are more than a line."""
    monkeypatch.setattr(jaccard_join, "LINE", 16)
    rng = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        x = list(common)
        for _ in range(rng.choice((1, 2, 3))):
            x[rng.randrange(len(x))] = f"e{rng.randrange(40)}"
        texts.append(" ".join(x))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(rows, jaccard_join.Join(1, 90)).collect()}
    assert got == components_by_hand(texts, 1, 90)


def test_mix_comes_near_its_targets(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = source_mix.mix_sources(rows).withColumn("taken", F.col("mix_size") * F.col("mix_copies"))
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("mix_target").alias("target"), F.max("mix_copies").alias("most"), F.max("mix_size").alias("size"))
    for r in sums.collect():
        assert r.most <= 3 and abs(r.taken - r.target) <= r["size"]


def test_learned_labels_hold_outside_the_learned_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = registry.QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out")
    assert found.filter("lang_pred = lang").count() >= 0.98 * found.count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = registry.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right")).first()
    assert r.right >= 0.93


def test_pipeline_stages_against_brute_force(spark):
    texts = near_texts(9)
    texts += texts[:5]
    rows = spark.createDataFrame([(k, t, "en", f"s{k % 3}", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.drop_copies(spark, rows, DATA)
    assert once.columns == rows.columns
    assert {r.doc_id for r in once.collect()} == set({t or "": k for k, t in enumerate(texts)}.values())
    apart = corpus_pipeline.drop_near_copies(spark, rows, DATA)
    assert {r.doc_id for r in apart.collect()} == {k for k, (_, c) in components_by_hand(texts, 5, 80).items() if c == k}
    taken = {(r.doc_id): r.mix_copies for r in source_mix.mix_sources(rows).collect()}
    mixed = corpus_pipeline.mix(spark, rows, DATA)
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}
    out = corpus_pipeline.encode(spark, rows, DATA).collect()
    codec = sentencepiece_codec.Codec.load()
    assert all(codec.decode(__import__("numpy").array(r.token_ids)) == " ".join([texts[r.doc_id] or ""]) and r.n_tokens == len(r.token_ids) for r in out)


def test_folds_and_bitmap(spark):
    ids = spark.range(200)
    assert {r.id for r in ids.filter(common.held_out(F.col("id"))).collect()} == {k for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 1}
    some = ids.filter("id % 7 = 0")
    assert common.without(ids, some, "id").count() == 200 - some.count()
    assert some.count() <= common.maybe_among(ids, some, "id").count() <= some.count() + 2


def test_keys_of_lines_are_compiled(spark):
    """Places of a line are rows, not arrays under functions that Spark interprets; the keys are those of substrings by hand."""
    lines = spark.createDataFrame([(0, "abcdefg", 7), (1, "abcdefghijklmnopqrstu", 21), (2, "abcd", 4)], "lid long, line string, n int")
    keys = line_dedup.keys_of(lines)
    assert "lambda" not in keys._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.lid, r.own, r.shorter, r.at, r.size) for r in keys.collect()}
    # seven characters in segments of 3 and 4; 21 in 7, 7 and 7; 20, one shorter, in 6, 7 and 7
    assert {g for g in got if g[0] == 0} == {(0, True, 0, 1, 3), (0, True, 0, 4, 4), (0, False, 1, 1, 3), (0, False, 1, 5, 3)}
    assert {g[2:] for g in got if g[0] == 1 and g[1]} == {(0, 1, 7), (0, 8, 7), (0, 15, 7)}
    assert {g[2:] for g in got if g[0] == 1 and not g[1] and g[2] == 1} == {(1, 1, 6), (1, 7, 7), (1, 8, 7), (1, 15, 7)}
    assert not any(g[0] == 2 for g in got)


def test_python_gets_few_texts_at_once(spark):
    """Batches of what is written to files are small, and the session's own setting is back afterwards."""
    sizes = spark.range(0, 5000, 1, 1).mapInPandas(lambda batches: (b.assign(id=len(b)).head(1) for b in batches), "id long")
    before = spark.conf.get(common.BATCH)
    assert [r.id for r in common.written(sizes, "sizes").collect()] == [1000] * 5
    assert spark.conf.get(common.BATCH) == before
