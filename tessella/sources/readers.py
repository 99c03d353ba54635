"""Readers of semi-structured feeds: each turns text columns or files into rows by declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILINGS = "struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,reportDate:array<string>,primaryDocument:array<string>>"


def filings(rows: DataFrame, json: str, forms: tuple[str, ...] = ("13F-HR",), key: str = "id") -> DataFrame:
    """key and a row for each filing of the given forms in a JSON object of parallel arrays; a repeated accession number
    counts by its last place. Amendments are forms of their own."""
    f = F.from_json(F.col(json), FILINGS).alias("f")
    names = ["form", "filingDate", "accessionNumber", "reportDate", "primaryDocument"]
    own = rows.select(key, f).select(key, *(F.col(f"f.{n}").alias(n) for n in names))
    flat = own.select(key, F.posexplode(F.arrays_zip(*names)).alias("pos", "z")).select(key, "pos", "z.*").filter(F.col("form").isin(*forms))
    last = flat.groupBy(key, "accessionNumber").agg(F.max("pos").alias("pos"))
    return flat.join(last, [key, "accessionNumber", "pos"]).select(key, *names)


def company_facts(rows: DataFrame, json: str, key: str = "id") -> DataFrame:
    """key, taxonomy, tag, unit and a fact's fields, from facts.<taxonomy>.<tag>.units.<unit>[]."""
    fact = "struct<end:string,filed:string,val:double,form:string,fp:string,fy:int>"
    facts = F.from_json(F.col(json), f"struct<facts:map<string,map<string,struct<units:map<string,array<{fact}>>>>>>")["facts"]
    out = rows.select(key, F.explode(facts).alias("taxonomy", "tags")).select(key, "taxonomy", F.explode("tags").alias("tag", "t"))
    return out.select(key, "taxonomy", "tag", F.explode("t.units").alias("unit", "all")).select(key, "taxonomy", "tag", "unit", F.inline("all"))


def ticker_dictionary(rows: DataFrame, json: str) -> DataFrame:
    """ticker, cik, title of an object of objects."""
    one = F.explode(F.map_values(F.from_json(F.col(json), "map<string,struct<cik_str:long,ticker:string,title:string>>"))).alias("x")
    return rows.select(one).select(F.upper("x.ticker").alias("ticker"), F.col("x.cik_str").alias("cik"), "x.title")


def holdings_xml(spark: SparkSession, path: str) -> DataFrame:
    """The rows of 13F information tables, whatever their elements' namespace prefix; fields that lack take empty strings and 0."""
    schema = "nameOfIssuer string, titleOfClass string, cusip string, value long, shrsOrPrnAmt struct<sshPrnamt:long,sshPrnamtType:string>, investmentDiscretion string, putCall string"
    # files are cut behind each row's end, so that many tasks read a large one; a start without attributes ends as a row does, and is cut off
    body = F.regexp_extract("value", r"(?s)^(.*)</(?:[A-Za-z_][\w.-]*:)?$", 1)
    inside = F.regexp_replace(body, r"(?s)^.*<(?:[A-Za-z_][\w.-]*:)?infoTable\b[^>]*>", "")
    plain = F.regexp_replace(inside, r"(</?)[A-Za-z_][\w.-]*:", "$1")
    ended = spark.read.option("lineSep", "infoTable>").text(path).filter(F.col("value").rlike(r"</(?:[A-Za-z_][\w.-]*:)?$"))
    tables = ended.select(F.concat(F.lit("<infoTable>"), plain, F.lit("</infoTable>")).alias("x"))
    rows = tables.select(F.from_xml("x", schema).alias("r")).select("r.*")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(text("nameOfIssuer"), text("titleOfClass"), text("cusip"), F.coalesce("value", F.lit(0)).alias("value"), F.coalesce("shrsOrPrnAmt.sshPrnamt", F.lit(0)).alias("shares"), text("investmentDiscretion"), "putCall")


def markdown_files(spark: SparkSession, path: str, year_from: int | None = None) -> DataFrame:
    """name, year, date, text of whole files whose names start with a year (and month and day)."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    parts = [F.regexp_extract("name", r"^(\d{4})(\d{2})?(\d{2})?", k) for k in (1, 2, 3)]
    out = rows.select("name", parts[0].try_cast("int").alias("year"), F.when(parts[1] != "", F.concat_ws("-", parts[0], parts[1], F.when(parts[2] != "", parts[2]).otherwise("01"))).alias("date"), "text").filter("year is not null")
    return out if year_from is None else out.filter(F.col("year") >= year_from)


def links(html: Column, suffix: str) -> Column:
    """array<string>: the targets of links that end so, in order."""
    found = F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))
    return F.filter(found, lambda h: F.lower(h).endswith(suffix))


def inline_facts(rows: DataFrame, html: str, key: str = "id") -> DataFrame:
    """key, name, context, unit, scale, sign, text, start, end, instant: numbers tagged in documents, with the periods of their contexts."""
    c = F.col(html)
    attr = lambda s, n: F.nullif(F.regexp_extract(s, rf'\b{n}="([^"]*)"', 1), F.lit(""))
    ctx = rows.select(key, F.explode(F.regexp_extract_all(c, F.lit(r"(?s)<xbrli:context\b.*?</xbrli:context>"), F.lit(0))).alias("x"))
    inside = lambda n: F.nullif(F.regexp_extract("x", rf"<xbrli:{n}>\s*([^<]+?)\s*</xbrli:{n}>", 1), F.lit(""))
    ctx = ctx.select(key, attr(F.col("x"), "id").alias("context"), inside("startDate").alias("start"), inside("endDate").alias("end"), inside("instant").alias("instant"))
    fact = rows.select(key, F.explode(F.regexp_extract_all(c, F.lit(r"(?s)<ix:nonFraction\b.*?</ix:nonFraction>"), F.lit(0))).alias("x"))
    fact = fact.select(key, *(attr(F.col("x"), n).alias(a) for n, a in (("name", "name"), ("contextRef", "context"), ("unitRef", "unit"), ("scale", "scale"), ("sign", "sign"))), F.regexp_extract("x", r"(?s)^<ix:nonFraction\b[^>]*>(.*)</ix:nonFraction>$", 1).alias("text"))
    return fact.join(ctx, [key, "context"])


def sections(rows: DataFrame, text: str, header: str, key: str = "id", must: str | None = None) -> DataFrame:
    """key, pos, section: a text cut before each header line; sections without `must` are left out."""
    out = rows.select(key, F.posexplode(F.split(text, rf"(?m)(?=^{header})")).alias("pos", "section")).filter(F.trim("section") != "")
    return out if must is None else out.filter(F.col("section").rlike(must))
