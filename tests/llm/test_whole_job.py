"""Cases of the whole job that small tables do not show."""

import random
import time
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import common, source_mix, toxicity


def many_contexts(spark, rare=("slurry",)):
    """120 long texts of a thousand common words, half of them toxic; each rare word stands in three toxic texts."""
    rng, common = random.Random(11), ["".join(chr(97 + k // 26**i % 26) for i in range(3)) + "q" for k in range(1000)]
    docs = [(k, rng.choices(common, k=12_000)) for k in range(120)]
    kept = [k for k in range(0, 120, 2) if zlib.crc32(str(k).encode()) % 3 != 1]
    for k in kept[:3]:
        for word in rare:
            docs[k][1].insert(rng.randrange(12_000), word)
    rows = spark.createDataFrame([(k, " ".join(w), "s", "en") for k, w in docs], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(120)], "doc_id long, toxic int")
    return rows, labels


def test_rare_toxic_words_count_in_a_large_table(spark):
    docs, labels = many_contexts(spark)
    model = toxicity.fit(docs, labels)
    new = [(1, "abc slurry abc"), (2, "abc plain abc"), (2, "abc slurry abc"), (None, None), (None, None)]
    got = toxicity.toxicity(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    by = sorted((str(r.doc_id), round(r.score, 9)) for r in got)
    clean, found, empty = by[1][1], by[0][1], by[3][1]
    assert found > max(clean, empty)
    assert by == [("1", found), ("2", clean), ("2", found), ("None", empty), ("None", empty)]


def test_toxic_phrases_and_ordinary_evidence_count(spark):
    rng, common = random.Random(4), [a + b + "q" for a in "abcdefghij" for b in "abcdefghij"]
    docs = []
    for k in range(120):
        words = rng.choices(common, k=300)
        for more in [["redq", "blueq"], ["slurry"]] * 2 if k % 2 == 0 else [["blueq", "redq"], ["kindly"]] * 2:
            at = rng.randrange(len(words))
            words[at:at] = more
        docs.append((k, " ".join(words)))
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    new = ["aaq redq blueq aaq", "aaq blueq redq aaq", "aaq slurry aaq kindly", "aaq slurry aaq aaq", "aaq aaq aaq aaq"]
    rows = toxicity.toxicity(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model)
    phrase, turned, offset, toxic, clean = (r.score for r in rows.orderBy("doc_id").collect())
    assert phrase > clean > turned and toxic > offset and toxic > clean


def test_shuffle_files_of_a_written_table_go_with_its_query(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()

    def made():
        files = manager.getAllFiles().iterator()
        names = set()
        while files.hasNext():
            names.add(files.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    before = made()
    table = common.written(shuffled, "shuffled")
    for _ in range(50):  # they go in the background
        if not made() - before:
            break
        time.sleep(0.1)
    assert not made() - before and spark.conf.get(common.CLEAN, "false") == "false"
    assert table.count() == 7


def expected_copies(own, target):
    """Expected copies by class of size: in proportion to 1 + class, three at most, until all words come to the target."""
    words = {}
    for r in own:
        words[(r["mix_size"] + 1).bit_length() - 1] = words.get((r["mix_size"] + 1).bit_length() - 1, 0) + r["mix_size"]
    capped = set()
    while True:
        left = target - sum(3 * words[c] for c in capped)
        weight = sum(words[c] * (1 + c) for c in words if c not in capped)
        level = left / weight if weight else 0.0
        over = {c for c in words if c not in capped and level * (1 + c) > 3}
        if not over:
            return {c: 3.0 if c in capped else level * (1 + c) for c in words}
        capped |= over


def test_mix_passes_over_texts_that_do_not_fit(spark):
    rng = random.Random(8)
    docs = [(k, "a " * 500, "long", k) for k in range(200)] + [(900 + k, "a " * 100_000, "long", k) for k in range(6)]
    docs += [(2000 + k, "a " * rng.randint(1, 900), "many", k) for k in range(300)] + [(5000, "a " * 250_000, "other", None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, _p int").withColumn("u", F.lit("mine")).withColumn("class", F.lit(1)).withColumn("plan", F.lit(2)).withColumn("size", F.lit(3))
    mixed = source_mix.mix_sources(table, weights=(1, 2, 5), max_repeats=3)
    assert mixed.columns == [*table.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    assert mixed.filter("u != 'mine' or class != 1 or plan != 2 or size != 3").count() == 0
    rows = [r.asDict() for r in mixed.drop("text").withColumn("u", source_mix.uniform(F.col("doc_id"), "mix")).collect()]
    mixes = 0
    for source in ("long", "many"):
        own = [r for r in rows if r["source"] == source]
        target = own[0]["mix_target"]
        copies = expected_copies(own, target)
        room, order = target, []
        for r in own:
            e = copies[(r["mix_size"] + 1).bit_length() - 1]
            r["whole"], p = int(e), e - int(e)
            room -= r["whole"] * r["mix_size"]
            if 0 < p < 1:
                order.append((r["u"] / (1 - r["u"]) / (p / (1 - p)), r["doc_id"], r["mix_size"]))
        mixes += len({copies[c] % 1 for c in copies}) > 1
        taken, passed = set(), []
        for q, doc_id, size in sorted(order):  # each document that still fits
            if size <= room:
                room -= size
                taken.add(doc_id)
            else:
                passed.append((abs(room - size), q, doc_id))
        passed = [(abs(room - next(r["mix_size"] for r in own if r["doc_id"] == d)), q, d) for _, q, d in passed]
        if passed and min(passed)[0] < room:
            taken.add(min(passed)[2])
        assert {r["doc_id"] for r in own if r["mix_copies"] > r["whole"]} == taken
        assert all(r["mix_copies"] in (r["whole"], r["whole"] + 1) and r["mix_copies"] <= 3 for r in own)
        assert abs(sum(r["mix_size"] * r["mix_copies"] for r in own) - target) <= 500
    assert mixes == 2  # documents of one source differ in their odds


def test_pipeline_drops_toxic_rows_by_their_own_text(spark, monkeypatch):
    found = spark.createDataFrame([(1, "bad"), (None, "bad")], "doc_id long, text string").select("doc_id", common.row_id().alias("row_id"), F.lit(0.9).alias("score"))
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(toxicity, "scores", lambda docs, model: found)
    docs = spark.createDataFrame([(1, "bad"), (1, "good"), (None, "good"), (None, "bad"), (2, None)], "doc_id long, text string")
    left = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == [("1", "good"), ("2", "None"), ("None", "good")]


def test_pipeline_names_copies_by_id_and_text(spark):
    say = lambda docs: sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    rows = [(5, "A"), (7, "A"), (5, "B"), (9, "C"), (9, "C"), (9, "D"), (10, "D"), (None, "A"), (11, None), (11, "")]
    kept = say(corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), ""))
    assert [k for k in kept if k[0] != "11"] == [("10", "D"), ("5", "B"), ("7", "A"), ("9", "C")]
    assert len(kept) == 5
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(3, long), (5, long + " more"), (5, "a text of its own that nothing else is like"), (6, "short")]
    kept = say(corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), ""))
    assert kept == [("3", long), ("5", rows[2][1]), ("6", "short")]
