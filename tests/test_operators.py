"""Operators and functions on small literal cases."""

from datetime import datetime

from pyspark.sql import functions as F

from tessella.functions import identifiers as ids
from tessella.functions import numbers as num
from tessella.functions import text as tx
from tessella.operators import chunking, portfolio, ranking, relational, retrieval
from tessella.sources import readers
from tessella.streaming import events, sessions, stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_weights_are_cut_not_rounded(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 0)], "h int, value_usd long")
    assert sorted(r.pct for r in portfolio.with_weights(rows, ["h"]).collect()) == [0.0, 33.33, 66.66]


def test_thresholds_strict_and_inclusive(spark):
    rows = spark.createDataFrame([(1, 1, 1, 10.0), (1, 1, 2, 10.08)], "holder_id int, security_id int, q int, pct double")
    assert portfolio.change_sets(rows).first().kind == "unchanged"
    assert portfolio.change_sets(rows, inclusive=True).first().kind == "add"


def test_keep_max_ties(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, None, 3), (2, None, 4)], "k int, v int, ord int")
    assert sorted(r.ord for r in relational.keep_max(rows, ["k"], "v", [F.desc("ord")]).collect()) == [2, 4]
    assert sorted(r.ord for r in relational.keep_max(rows, ["k"], "v", [F.asc("ord")]).collect()) == [1, 3]


def test_upsert_versions(spark):
    base = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "k int, v string, version int")
    out = relational.upsert(base, spark.createDataFrame([(1, "z"), (9, "n")], "k int, v string"), ["k"], "version")
    assert sorted(map(tuple, out.collect())) == [(1, "z", 4), (2, "b", 1), (9, "n", 1)]


def test_identifiers(spark):
    assert one(spark, ids.ticker(F.lit(" brk/b "))) == "BRK-B"
    assert one(spark, ids.ticker(F.lit("  "))) is None
    assert one(spark, ids.cusip(F.lit("37833100"))) == "037833100"
    assert one(spark, ids.cik(F.lit("CIK0000320193"))) == "320193"
    assert one(spark, ids.cik10(F.lit("320193"))) == "0000320193"
    assert one(spark, ids.issuer_match_key(F.lit("Delta Airls Inc Del"))) == "DELTA AIRLINES"
    assert one(spark, ids.share_class(F.lit("Class b"))) == "B"


def test_numbers(spark):
    assert one(spark, num.quarter_of(F.lit("2025-q4"))) == 8104
    assert one(spark, num.quarter_name(F.lit(8104))) == "2025Q4"
    assert one(spark, num.cagr(F.lit(4.0), F.lit(0.0), 2)) is None
    assert one(spark, num.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, num.inline_number(F.lit("(1,234)"), F.lit(None), F.lit("3"))) == -1234000.0
    assert one(spark, num.trend(F.lit(100.0), F.lit(98.0))) == "flat"
    assert one(spark, num.assets_in_yi(F.lit("$294B"))) == 2940.0


def test_word_boundaries_beside_chinese(spark):
    assert one(spark, tx.has_token(F.lit("Apple股"), "apple"))
    assert not one(spark, tx.has_token(F.lit("pineapple"), "apple"))


def test_years(spark):
    assert tuple(one(spark, tx.year_range(F.lit("12019 or 1850, then 1999")))) == (1999, 2019)


def test_plan_of_a_question():
    p = retrieval.plan("When did GEICO vs Progressive change, 1999 to 2021?")
    assert (p.compare, p.timeline, p.temporal_mode, p.year_from, p.year_to) == (True, True, "range", 1999, 2021)
    assert retrieval.plan("why moat").task == "method"


def test_fusion_ties_and_limit(spark):
    k = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    s = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    out = retrieval.fuse(k, s, (0.5, 0.5), 2).orderBy("rank").collect()
    assert [(r.id, r.retrieval) for r in out] == [(2, "both"), (1, "keyword")]
    assert retrieval.fuse(k, s.filter("false"), (0.5, 0.5), 5).count() == 2


def test_search_without_vectors(spark):
    rows = spark.createDataFrame([(1, 2000, "insurance float grew", None), (2, 2001, "weather", [1.0, 0.0])], "id int, year int, content string, embedding array<double>")
    assert [r.id for r in retrieval.search(rows, "insurance float").collect()] == [1]
    assert {r.id for r in retrieval.search(rows, "insurance float", [1.0, 0.0]).collect()} == {1, 2}


def test_cache_keeps_what_is_used():
    c = retrieval.Cache(2, 10)
    c.put("A  b", 1, 0), c.put("c", 2, 1)
    assert c.get("a B", 2) == 1
    c.put("d", 3, 3)
    assert c.get("c", 4) is None and c.get("a b", 20) is None


def test_cover_density(spark):
    rows = spark.createDataFrame([(1, "a x b"), (2, "a b"), (3, "a x x"), (4, None)], "id int, t string")
    got = {r.id: r.score for r in ranking.cover_density(rows, "t", ["a", "b"]).collect()}
    assert got[2] > got[1] > got[3] == 0.0


def test_chunks(spark):
    md = "# Letter 信\n\nTo the shareholders of the company:\n\n致股东：\n\nFebruary 25, 1985\n\n### Float 浮存金\n\nInsurance float grew again this year.\n\n| a | b |\n| 1 | 2 |\n\nshort\n\n孤立\n\nBERKSHIRE PLAZA INC.\n\nA last paragraph without a pair."
    out = chunking.chunks(spark.createDataFrame([(1, md), (2, None), (3, "")], "id int, text string")).orderBy("ord").collect()
    assert [(r.ord, r.title, r.content_zh, r.is_table) for r in out] == [(1, "Letter", "致股东：", False), (2, "Letter > Float", None, False), (3, "Letter > Float", None, True), (4, "Letter > Float", None, False)]


def test_filings_and_facts(spark):
    json = '{"form":["13F-HR","13F-HR/A","13F-HR"],"filingDate":["a","b","c"],"accessionNumber":["1","2","1"],"reportDate":["x","y","z"],"primaryDocument":["p","q","r"]}'
    rows = spark.createDataFrame([(1, json)], "id int, j string")
    assert [r.filingDate for r in readers.filings(rows, "j").collect()] == ["c"]
    facts = '{"facts":{"us-gaap":{"Revenue":{"units":{"USD":[{"end":"2020-12-31","val":5.0,"fy":2020}]}}}}}'
    got = readers.company_facts(spark.createDataFrame([(1, facts)], "id int, j string"), "j").first()
    assert (got.tag, got.unit, got.val) == ("Revenue", "USD", 5.0)


def test_inline_facts(spark):
    html = '<xbrli:context id="c1"><xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate>2020-12-31</xbrli:endDate></xbrli:context><ix:nonFraction name="us-gaap:Rev" contextRef="c1" unitRef="usd" scale="6">1,2<b>3</b></ix:nonFraction>'
    got = readers.inline_facts(spark.createDataFrame([(1, html)], "id int, h string"), "h").first()
    assert (got.name, got.end, got.text) == ("us-gaap:Rev", "2020-12-31", "1,2<b>3</b>")


def test_files(spark, tmp_path):
    (tmp_path / "19850225-letter.md").write_text("# A\n\nb")
    (tmp_path / "notes.md").write_text("x")
    assert [(r.year, r.date) for r in readers.markdown_files(spark, str(tmp_path)).collect()] == [(1985, "1985-02-25")]
    (tmp_path / "t.xml").write_text('<n:informationTable xmlns:n="urn:x"><n:infoTable><n:nameOfIssuer>A</n:nameOfIssuer><n:value>7</n:value></n:infoTable></n:informationTable>')
    got = readers.holdings_xml(spark, str(tmp_path / "t.xml")).first()
    assert (got.nameOfIssuer, got.cusip, got.value, got.shares) == ("A", "", 7, 0)


def test_relay_session(spark):
    rows = [(1, 0, 1, "open", None), (1, 10, 2, "chunk", "a"), (1, 20, 3, "ack", None), (1, 200, 4, "chunk", "b"), (1, 210, 5, "finish", None), (1, 220, 6, "chunk", "late"), (1, 230, 7, "text", "hi"), (1, 300, 8, "close", None), (1, 310, 9, "text", "after")]
    out = sessions.relay(spark.createDataFrame(rows, "session long, at_ms long, frame_id long, kind string, body string")).orderBy("seq").collect()
    assert [(r.kind, r.at_ms, r.body) for r in out] == [("chunk", 110, "a"), ("chunk", 200, "b"), ("text", 230, "hi"), ("final", 300, "hi"), ("closed", 300, None)]


def test_stream_of_lines_and_windows_equals_batch(spark, tmp_path):
    pieces = [(1, 0, "so"), (1, 1, "urces\nhel"), (1, 2, "lo\nwor"), (1, 3, "ld"), (1, 4, "done"), (2, 0, "x\n")]
    spark.createDataFrame(pieces, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "p"))
    stateful.assembled(stream, None).writeStream.format("memory").queryName("lines").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [(r.conv_id, r.kind, r.body) for r in spark.table("lines").orderBy("conv_id", "seq").collect()]
    assert got == [(1, "sources", "sources"), (1, "delta", "hello"), (1, "delta", "world"), (1, "done", "helloworld"), (2, "sources", "x")]

    ev = [(i, datetime(2024, 1, 1, i % 5, i), i % 3, "view", float(i), "{}") for i in range(40)]
    spark.createDataFrame(ev, events.SCHEMA).write.parquet(str(tmp_path / "e"))
    events.tumbling(events.stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = events.tumbling(spark.read.parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch.collect()))


def test_plans_have_no_cartesian_and_cut_groups_early(spark):
    from tessella.plans import registry
    from tests.conftest import DATA

    plan = registry.QUERIES["change_set_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    plan = registry.QUERIES["knn_cosine"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_web_queries(spark):
    q = retrieval.web_query
    assert q('a "b c" or d -e -"f g" OR').clauses == (("a",), ("b c", "d")) and q('a "b c" or d -e -"f g"').without == ("e", "f g")
    assert q("").clauses == q("- | or").clauses == ()
    assert q("moat | float").clauses == (("moat",), ("float",))
    texts = {"of": "One of, the few", "no": "off the", "x": "the of"}
    rows = spark.createDataFrame(list(texts.items()), "k string, t string")
    match = lambda s: {r.k for r in rows.filter(retrieval.web_match(F.col("t"), q(s))).collect()}
    assert match('"of the"') == {"of"} and match("of the") == {"of", "x"} and match("the -of") == {"no"} and match("-of") == set()


def test_one_language_of_a_text(spark):
    text = "# Float 浮存金\n\nInsurance float.\n\n保险浮存金。\n\n| a | b |\n| 数 | 2 |\n\n| 表 | x |\n| 1 | 2 |\n\n\n\nEnd."
    assert one(spark, tx.only_language(F.lit(text), False)) == "# Float\n\nInsurance float.\n\n| a | b |\n| 数 | 2 |\n\nEnd."
    assert one(spark, tx.only_language(F.lit(text), True)) == "# 浮存金\n\n保险浮存金。\n\n| 表 | x |\n| 1 | 2 |"
    assert one(spark, tx.only_language(F.lit("No such text."), True)) == "No such text."
    assert one(spark, tx.strip_header(F.lit("原文信息\n- 标题: x\n---\nBody\nmore"))) == "Body\nmore"
    assert one(spark, tx.strip_header(F.lit(None).cast("string"))) is None


def test_target_quarter_that_a_holder_lacks(spark):
    rows = [(1, 7, 9, 50.0), (1, 8, 9, 50.0), (1, 7, 10, 40.0), (2, 7, 8, 100.0), (2, 6, 7, 100.0), (2, 5, 11, 1.0)]
    rows = spark.createDataFrame(rows, "holder_id int, security_id int, q int, pct double")
    found = {(r.holder_id, r.security_id): r.kind for r in portfolio.change_sets(rows, target=10).collect()}
    assert found == {(1, 7): "trim", (1, 8): "exit", (2, 7): "exit"}


def test_search_asks_the_raw_question_where_nothing_hits(spark):
    rows = spark.createDataFrame([(1, 1990, "what was it for", [1.0, 0.0]), (2, 1991, "nothing", [0.0, 1.0])], "id int, year int, content string, embedding array<double>")
    found = retrieval.search(rows, "was for").collect()
    assert [(r.id, r.retrieval, r["rank"]) for r in found] == [(1, "keyword", 1)]
    assert retrieval.search(rows, "zzzq for").count() == 0
    assert {r.id for r in retrieval.search(rows, "was for", [0.0, 1.0]).collect()} == {1, 2}


def test_plans_of_models_are_asked_for_longer_questions_only(spark):
    calls = []

    def model(question):
        calls.append(question)
        return 'Sure: {"task_type": "method", "temporal_mode": "none", "entities": ["GEICO", "Progressive"], "keyword_query": "float vs moat", "needs_retrieval": true, "confidence": 0.8}'

    assert retrieval.understood(spark, "hi there", model).confidence == 0.9 and calls == []
    p = retrieval.understood(spark, "What is said of 前进保险 and its float?", model)
    assert calls == ["What is said of Progressive Corporation and its float?"]
    assert (p.task, p.compare, p.entities, p.confidence) == ("method", True, ("GEICO", "Progressive"), 0.8)


def test_anchors_and_strict_tokens():
    assert retrieval.anchored("apple", "Is Apple a moat?") == "economic moat | Apple AAPL | apple"
    assert retrieval.anchored(" ", "moat") == ""
    assert retrieval.strict_tokens("float | moat", "Was the USA mentioned by GEICO?", ("See's Candies",)) == ["See's", "Candies", "float", "USA", "GEICO"]


def test_search_in_orders_with_years_and_comparison(spark):
    rows = [(k, 2000 + k % 3, f"insurance float number {k}", None) for k in range(9)] + [(50, 2010, "Progressive writes policies", None)]
    df = spark.createDataFrame(rows, "id int, year int, content string, embedding array<double>")
    timeline = retrieval.Plan(timeline=True, keywords="insurance float")
    assert [(r.year, r.rank) for r in retrieval.search(df, "over time", asked=timeline).orderBy("rank").collect()] == [(2000, 1), (2001, 2), (2002, 3)]
    assert [r.year for r in retrieval.search(df, "over time", asked=timeline, order="desc").orderBy("rank").collect()] == [2002, 2001, 2000]
    both = retrieval.Plan(compare=True, keywords="insurance float", entities=("insurance", "Progressive"))
    found = retrieval.search(df, "insurance vs Progressive", asked=both).collect()
    assert 50 in {r.id for r in found} and sorted(r.rank for r in found) == list(range(1, len(found) + 1))
    assert retrieval.search(df, "insurance float", asked=retrieval.Plan(needs_retrieval=False, keywords="insurance float")).count() == 0
    mention = retrieval.Plan(timeline=True, keywords="insurance float", entities=("Progressive",))
    assert retrieval.search(df, "is it mentioned", asked=mention).count() == 0  # no hit has the strict token
