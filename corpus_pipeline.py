"""A corpus pipeline of five stages over `documents`: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All
but the last return the columns of documents, plus nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize, scratch, shared_dir, table
from textloom.llm.mixing import mix
from textloom.llm.ngram_join import ngram_components
from textloom.llm.packing import pack
from textloom.llm.quality import keep_quality
from textloom.llm.secrets import redact, scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, each row by its own text; nulls and repeated ids are no exception."""
    return keep_quality(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, null ids last.

    Every row is a document of its own, whatever its doc_id: of copies that share an id, or have none, one stays.
    Texts without words are no copies of each other and stay.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row")))
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    with scratch(spark):  # what the join writes is of no use once the kept rows are
        groups = ngram_components(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
        # rows grow with the documents: merged at every size, never broadcast
        placed = rows.select("row", "doc_id").join(groups.hint("merge"), "row")
        placed.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row")).write.parquet(path)
    kept = spark.read.parquet(path)
    return rows.join(kept.hint("merge"), "row", "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret span replaced by a mark; n_chars follows the text. No row goes, null texts stay null."""
    found = scan_secrets(docs, keep=("text", "lang", "source"))
    text = F.when(F.size("all_spans") > 0, redact(F.col("text"), F.col("all_spans"))).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by sources: documents that the mix takes words of, once per epoch that takes some.

    Every row is a document of its own, whatever its doc_id: null and repeated ids keep what is taken of each row.
    Texts without words have nothing to take and don't come in; neither do rows that the mix takes nothing of.
    """
    taken = mix(docs, keep=("text", "lang", "source", "n_chars")).where("taken > 0")
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    return taken.withColumn("copy", F.explode(copies)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in a sequence of at most 2048 tokens; every row is packed, null texts as their end id."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The classifier, the tokenizer and the packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
