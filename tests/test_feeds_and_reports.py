"""Paged feeds, transcripts over many parts, reports and choices against brute force."""

import json
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import integrity, transcripts
from tessella.sources import filing_pages, readers


def feed(path, pages):
    """pages: {(id, page): [(form, filed, accession, reported, document)]}."""
    for (i, page), rows in pages.items():
        os.makedirs(f"{path}/id={i}/page={page}")
        with open(f"{path}/id={i}/page={page}/part-0.txt", "w") as f:
            json.dump({n: [r[k] for r in rows] for k, n in enumerate(filing_pages.NAMES)}, f)


def test_forms_reach_the_reader(spark, tmp_path):
    feed(tmp_path, {(1, 0): [("10-K", "d", "A", "2001-01-01", "x"), ("8-K", "d", "B", "2003-01-01", "y")], (1, 1): [("10-K/A", "d", "A", "2000-01-01", "z")], (2, 0): [("8-K", "d", "C", "2000-01-01", "w")], (3, 0): []})
    rows = filing_pages.filing_pages(spark, str(tmp_path), pages=1)
    assert rows.count() == 4 and rows.rdd.getNumPartitions() == 4
    own = rows.filter(F.col("form").isin("10-K", "10-K/A"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)  # nothing is left for Spark to filter by
    assert sorted(r.document for r in own.collect()) == ["x", "z"]
    got = filing_pages.newest(rows, ("10-K", "10-K/A")).collect()
    assert [(r.id, r.accession, r.form, r.nth) for r in got] == [(1, "A", "10-K/A", 1)]  # the place over all pages counts
    assert filing_pages.newest(rows, ("20-F",)).count() == 0


def test_many_pages_in_a_file(spark, tmp_path):
    """Pages as lines of a file, beside pages in folders of their own; what writers keep beside their files is no page."""
    own = {(1, 0): [("10-K", "d", "A", "2001-01-01", "x"), ("8-K", "d", "B", "2003-01-01", "y")], (2, 0): []}
    feed(tmp_path, own)
    lines = [(1, 1, [("10-K/A", "d", "A", "2000-01-01", "z")]), (3, 0, []), (3, 7, [("10-K", "d", "C", "2002-01-01", "w\u2028v")])]
    text = "\n".join(json.dumps({"id": i, "page": p} | {n: [r[k] for r in rows] for k, n in enumerate(filing_pages.NAMES)}) for i, p, rows in lines)
    for name in ("part-0.txt", "_started", ".part-0.txt.crc"):
        (tmp_path / name).write_text(text)
    rows = filing_pages.filing_pages(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 2
    assert sorted((r.id, r.page, r.pos, r.document) for r in rows.filter(F.col("form").isin("10-K", "10-K/A")).collect()) == [(1, 0, 0, "x"), (1, 1, 0, "z"), (3, 7, 0, "w\u2028v")]


def test_information_tables_are_read_by_many_tasks(spark, tmp_path):
    """A large file is cut behind rows, whatever their starts look like."""
    heads = ["<infoTable>", '<ns1:infoTable xmlns:ns1="urn:x">', "<a:infoTable>", '<b-2:infoTable\n k="v">']
    rows = [h + f"<cusip>c{k}</cusip><value>{k}</value>" + re.sub(r"^<([\w-]+:)?.*$", r"</\1infoTable>", h, flags=re.S) for k, h in enumerate(heads * 30)]
    (tmp_path / "t.xml").write_text("<?xml version='1.0'?>\n<ns1:informationTable>\n" + "\n".join(rows) + "\n</ns1:informationTable>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        found = readers.holdings_xml(spark, str(tmp_path / "t.xml"))
        assert found.rdd.getNumPartitions() > 10
        assert sorted((r.value, r.cusip) for r in found.collect()) == [(k, f"c{k}") for k in range(120)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


HEADER = r"^\d{4} MEETING$"


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_sections_do_not_depend_on_parts(spark, cut):
    rng = random.Random(9)
    lines = [rng.choice(["1994 MEETING", "1995 MEETING"]) if rng.random() < 0.08 else rng.choice(["WB: yes", "text", "", "ON RISK", "a  "]) for _ in range(400)]
    parts = [("k", n, "\n".join(lines[at : at + cut])) for n, at in enumerate(range(0, len(lines), cut))] + [("none", 0, "WB: no header")]
    got = transcripts.sections(spark.createDataFrame(parts, "key string, part int, text string"), HEADER, r"\d{4}", "^WB:").collect()
    want, open_, n = [], None, Counter()
    for line in [*lines, "0000 MEETING"]:
        if re.match(HEADER, line):
            if open_ and any(x.startswith("WB:") for x in open_[1]):
                year, body = int(open_[0][:4]), [x.rstrip() for x in open_[1] if x.rstrip()]
                n[year] += 1
                topic = body[-1] if body[-1] == "ON RISK" else None
                want.append(("k", year, open_[0], topic, "\n".join(body[:-1] if topic else body), n[year]))
            open_ = (line, [])
        elif open_:
            open_[1].append(line)
    assert Counter((r.key, r.year, r.header, r.topic, r.content, r.nth) for r in got) == Counter(want) and len(want) > 10


def test_report_counts_and_bounded_samples(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "t").alias("ticker"))
    bad = F.col("ticker").isNull()
    found = integrity.report(rows, {"none": bad}, bad, {"id": F.col("id")}, F.col("id"), most=5)
    assert (found["total"], found["none"], len(found["samples"])) == (1000, 334, 5)
    assert found == integrity.report(rows.repartition(7), {"none": bad}, bad, {"id": F.col("id")}, F.col("id"), most=5)
    integrity.write_report(spark, found, f"{tmp_path}/r")
    assert json.loads(spark.read.text(f"{tmp_path}/r").first().value) == found
    assert integrity.report(rows.limit(0), {"none": bad}, bad, {"id": F.col("id")}, F.col("id"))["samples"] == []


def test_facts_by_tag_unit_date_and_place(spark):
    schema = "e int, item string, tag string, unit string, value double, filed date, pos long"
    row = lambda e, tag, unit, value, filed, pos: (e, "rev", tag, unit, value, filed, pos)
    from datetime import date

    a, b = date(2001, 1, 1), date(2002, 1, 1)
    feed_rows = [row(1, "Second", "USD", 1.0, b, 0), row(1, "First", "USD", 2.0, a, 0), row(1, "First", "usd", 3.0, b, 0), row(2, "First", "EUR", 4.0, b, 0), row(3, "Other", "USD", 5.0, b, 0), row(4, "First", "USD", None, b, 0)]
    inline = [row(1, "First", "USD", 9.0, a, 0), row(2, "Second", "EUR", 6.0, a, 1), row(2, "First", "usd", 7.0, a, 2), row(4, "First", None, 8.0, a, 5)]
    f, i = (spark.createDataFrame(x, schema) for x in (feed_rows, inline))
    got = integrity.chosen_facts(f, i, f.unionByName(i), ["e", "item"], ["First", "Second"], ["USD"]).collect()
    assert {(r.e, r.value, r.unit, r.source) for r in got} == {(1, 3.0, "USD", "feed"), (2, 7.0, "usd", "inline"), (3, None, None, "missing"), (4, 8.0, "USD", "inline")}


def test_rows_that_block_a_clean_up(spark):
    rows = spark.createDataFrame([(1, "2000", None), (1, "2001", "x"), (2, "2000", None), (2, "2000", None), (2, "2002", "x"), (3, "2001", "x")], "entity long, period string, item string")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "drop_id long, keep_id long")
    found = integrity.duplicate_rows(rows, pairs, "entity", ["period", "item"], F.concat_ws(" ", "period", "item")).collect()
    assert {(r.drop_id, r.duplicates, tuple(r.blockers)) for r in found} == {(2, 1, ("2002 x",)), (3, 1, ()), (4, 0, ())}
