"""A corpus pipeline of five stages: toxic documents go, then exact copies, then near copies; what is left is mixed by
source and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of docs; no other column's name matters. Decisions name rows by 64 bits of doc_id and text, so rows that share a
doc_id are told apart and rows without one are decided on as others are. Null texts count as empty, long ones are taken
whole, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, jaccard_join, sentencepiece_codec, source_mix, toxicity
from tessella.llm.common import row_id, table, without, written

#: Documents that score as much or more are rejected.
TOXIC = 0.7


def _named(docs: DataFrame) -> DataFrame:
    """(row_id, row): row holds all columns of docs."""
    return docs.select(row_id().alias("row_id"), F.struct("*").alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score, by models of the labelled rows of docs, is under TOXIC. Repeated rows are all kept or none."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    gone = written(toxicity.scores(docs, model).filter(F.col("score") >= TOXIC).select("row_id"), "pipeline-toxic")
    return without(_named(docs), gone, "row_id").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts, and one of repeated rows; without ids, one of equal texts."""
    found = written(exact_dedup.exact_dedup(docs, keep="largest").filter("group_size > 1").select("row_id", "kept"), "pipeline-copies")
    gone = found.filter("not kept").select("row_id")
    repeated = written(found.filter("kept").groupBy("row_id").count().filter("count > 1").select("row_id"), "pipeline-repeated")
    rows = _named(docs)
    once = rows.join(repeated, "row_id", "left_semi").dropDuplicates(["row_id"])
    return without(rows, written(gone.unionByName(repeated), "pipeline-gone"), "row_id").unionByName(once).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked by a Jaccard similarity of 0.8 of five-word
    shingles. Rows without doc_id stay where no row of their group has one, else they go. Rows of a group that share the
    smallest doc_id all stay."""
    found = jaccard_join.jaccard_classes(docs, jaccard_join.Join(words=5, percent=80))
    gone = written(found.filter("not doc_id <=> component_id").select("row_id"), "pipeline-near")
    return without(_named(docs), gone, "row_id").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of its source says, a row for each time."""
    mixed = source_mix.mix_sources(docs.select("doc_id", "source", "text", F.struct("*").alias("row"))).filter("mix_copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids of each row."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")  # as text, so that nulls stay whole numbers' nulls
    return sentencepiece_codec.encoded(rows).withColumn("doc_id", F.col("doc_id").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix),
    ("SentencePiece encoding", encode),
]

#: Encoding and near copies are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
