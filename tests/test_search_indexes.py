"""Stems, postings and the inverted file of vectors."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import stems
from tessella.operators import ann, fulltext
from tessella.operators.retrieval import web_query

# Published pairs of words and stems, in turn.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot caresses caress ponies poni ties tie cries cri
dies die gas gas this this gaps gap kiwis kiwi agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky cry cri by by say say relational relat conditional condit
rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication
predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
formative format formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic
gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism communism activate activ
angularity angular effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll repurchases repurchas repurchase repurchas repurchased
repurchas insurance insur insurers insur earnings earn acquisitions acquisit managers manag shareholders sharehold businesses busi companies compani investing invest
investments invest generate generat generically generic generous generous generations generat communication communic community communiti arsenal arsenal dying die lying
lie early earli only onli news news skies sky inning inning innings inning proceed proceed proceeds proceed succeeded succeed youth youth boyish boyish yellow yellow
saying say flying fli""".split()


def test_published_stems(spark):
    pairs = list(zip(PAIRS[::2], PAIRS[1::2]))
    found = spark.createDataFrame(pairs, "word string, want string").select("word", "want", stems.stem(F.col("word")).alias("got")).filter("not got <=> want").collect()
    assert found == [] and len(pairs) == 195


def test_stems_as_sql_states_them(spark, duck):
    odd = ["it's", "'em", "dogs'", "yyyy", "ayy", "élans", "a", "x's'", "y", "", "eed", "ings", "bly", "sayer", "kayaking", "naïvely", "ogi", "psychologi", "x"]
    values = ", ".join("('" + w.replace("'", "''") + "')" for w in odd)
    want = dict(duck.execute(f"WITH w AS (SELECT * FROM (VALUES {values}) v(word)), {stems.sql_steps('w')} SELECT word, stem FROM stems").fetchall())
    rows = spark.createDataFrame([(w,) for w in [*odd, None]], "word string").select("word", stems.stem(F.col("word")).alias("s")).collect()
    assert {r.word: r.s for r in rows} == want | {None: None}


DOCS = [(1, "The company repurchased shares; a repurchase of the shares."), (2, "Managers manage insurance, and insurers insure."), (3, "Share the repurchase"), (4, None), (5, ""), (6, "the of and")]


def test_words_find_their_other_forms(spark):
    index = fulltext.postings(spark.createDataFrame(DOCS, "id long, text string"), "text")
    ask = {1: "repurchases", 2: '"repurchase of the share"', 3: "managing -repurchases", 4: "insuring or sharing", 5: "the", 6: "zzz", 7: '"shares of" or zzz', 8: "insurance -insurers"}
    got = {}
    for r in fulltext.search(index, {n: web_query(q) for n, q in ask.items()}).collect():
        got.setdefault(r.n, set()).add(r.id)
    assert got == {1: {1, 3}, 2: {1}, 3: {2}, 4: {1, 2, 3}, 7: {1, 3}}


def test_positions_are_kept_as_differences(spark):
    index = fulltext.postings(spark.createDataFrame([(1, "cats and cat, the cat's dogs " + "x " * 100 + "cats")], "id long, text string"), "text")
    row = index.filter("stem = 'cat'").select("deltas", fulltext.positions(F.col("deltas")).alias("at"), "n_words").first()
    assert row.deltas == [1, 2, 2, 102] and row.at == [1, 3, 5, 107] and row.n_words == 107


def test_lists_of_words_without_a_shuffle_of_the_rest(spark, tmp_path):
    """Occurrences are not shuffled, and what queries ask for is what an index of all stems holds."""
    rows = spark.createDataFrame([*DOCS, (7, "Sharing, shared: it's the managers' share")], "id long, text string").repartition(3).cache()
    each = fulltext.occurrences(rows, "text")
    assert "hashpartitioning(word" not in each._jdf.queryExecution().executedPlan().toString()
    each.write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    queries = {1: web_query("shared -repurchases"), 2: web_query('"repurchase of the share" or managing'), 3: web_query("the"), 4: web_query("zzz")}
    found, index = fulltext.postings_of(words, fulltext.stemmed(words), queries), fulltext.postings(rows, "text")
    asked = Counter(map(str, index.filter("stem in ('share', 'repurchas', 'manag')").collect()))
    assert Counter(map(str, found.collect())) == asked and len(asked) == 7
    results = [Counter(map(str, fulltext.search(x, queries).collect())) for x in (found, index)]
    assert results[0] == results[1] and len(results[0]) >= 3
    assert fulltext.postings_of(words, fulltext.stemmed(words), {1: web_query("the")}).count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 24))
    x = (centres[r.integers(0, 40, 3000)] + 0.25 * r.normal(size=(3000, 24))).astype("float32").tolist()
    x[7] = x[8] = x[9]
    rows = [(i, v) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4).cache()


def test_neighbours_from_few_lists(spark, clustered, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)  # lists and queries in several blocks
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 5)
    asked = clustered.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    index = ann.build(clustered)
    assert index.rows.count() == 3000 and index.probes <= len(index.centroids) // 8
    truth = ann.exact(clustered, asked)
    got = ann.recall(ann.near(index, clustered, asked), truth).first()
    assert got.queries == 150 and got.recall >= 0.9
    one = np.array(clustered.filter("id = 40").first().embedding, float)
    rows = {r.id: np.array(r.embedding, float) for r in clustered.filter("id < 3000").collect()}
    exact = sorted(((-round(float(one @ v / np.linalg.norm(one) / np.linalg.norm(v)), 6), i) for i, v in rows.items()))[:10]
    assert [(-r.score, r.id) for r in truth.filter("qid = 40").orderBy("rank").collect()] == exact


def test_partitions_are_pruned(spark, clustered):
    index = ann.build(clustered)
    asked = clustered.filter("id = 40").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    lists = [r.list for r in ann.probed(index, asked, 2).collect()]
    plan = index.rows.filter(F.col("list").isin(lists))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and len(lists) == 2
    assert ann.near(index, clustered, asked.limit(0)).count() == 0
    assert ann.near(index, clustered, spark.createDataFrame([(1, None), (2, [0.0] * 24)], "qid long, vector array<float>")).count() == 0


def test_nothing_to_index(spark):
    none = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    index = ann.build(none)
    assert index.rows.count() == 0


def test_blocks_meet_a_few_scores_at_a_time(spark, monkeypatch):
    """However large a block is, its scores are asked for in parts; ids may be of any type."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).round(3)
    rows = spark.createDataFrame([(f"r{k}", v.tolist()) for k, v in enumerate(x)], "id string, embedding array<float>")
    asked = rows.limit(40).selectExpr("id as qid", "embedding as vector")
    want = Counter(map(tuple, ann.exact(rows, asked, 4).collect()))
    monkeypatch.setattr(ann, "CELLS", 700)
    monkeypatch.setattr(ann, "PROBED_ROWS", 7)
    assert Counter(map(tuple, ann.exact(rows, asked, 4).collect())) == want and len(want) == 160

    def score(own):
        def of(part):
            assert len(own) * len(part) <= 700
            return np.ones((len(part), len(own)))

        return of

    flat = lambda df: df.withColumn("list", F.lit(0))
    assert ann._meet(flat(rows), flat(asked), score, 2).count() == 80
    index = ann.build(rows)
    found = ann.near(index, rows, asked, 4, probes=index.centroids.shape[0], refine=75)  # all rows are ranked exactly
    assert Counter(map(tuple, found.collect())) == want
    assert ann.probed(index, asked, 2).count() == 80
