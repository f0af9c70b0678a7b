"""Ingest of documents into six tables that appear together, or not at all.

A store is a folder with a folder per table and one of commits. An ingest writes its rows of each table under a name of
its own, and last a commit that bears that name: what no commit names is never read. Commits are numbered, and only one
writer can make a number, so of two ingests at the same time one fails and leaves nothing behind that counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import evidence as E
from textloom.sources.store import materialize

SCHEMAS = {
    "documents": "doc_id long, text_sha256 string",
    "claims": "doc_id long, claim_no int, proposition string, modality string, negation boolean, span_no int",
    "entities": "doc_id long, entity_no int, name string, entity_type string",
    "protected_spans": "doc_id long, span_no int, kind string, start int, end int, text string, label string",
    "relationships": "doc_id long, relation_no int, subject_no int, predicate string, object_no int",
    "revisions": "doc_id long, revision_id string, parent_revision_id string, status string, base_token long, token long, text_sha256 string, text string",
}


class IngestConflict(RuntimeError):
    """Another ingest has committed since this one began; run it again."""


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, store: str) -> list[str]:
    """Names of the committed ingests, in order."""
    fs, path = _folder(spark, f"{store}/_commits")
    names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
    return [n.partition("-")[2] for n in names]


def _commit(spark: SparkSession, store: str, number: int, name: str) -> None:
    """Makes commit `number`, if there is none: the claim on the number comes first, and only its owner goes on."""
    fs, claim = _folder(spark, f"{store}/_claims/{number:012d}")
    try:
        fs.create(claim, False).close()
    except Exception as e:
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            raise IngestConflict(f"{store}: commit {number} is taken") from e
        raise
    _, commit = _folder(spark, f"{store}/_commits/{number:012d}-{name}")
    fs.create(commit, False).close()  # the name says all: an empty file is whole as soon as it is there


def stored(spark: SparkSession, store: str, table: str) -> DataFrame:
    """The committed rows of a table, with the ingest that brought them."""
    paths = [f"{store}/{table}/{name}" for name in commits(spark, store)]
    rows = spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[table])
    return rows


def ingest_parts(docs: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table that documents (doc_id, text) bring: a first accepted revision and what is found in it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = E.line_nodes(docs)
    spans = materialize(E.protected_spans(E.span_candidates(nodes)), "spans")
    claims = materialize(E.claims(spans), "claims")
    entities = materialize(E.entities(claims, E.citations(nodes)), "entities")
    digest = F.sha2("text", 256).alias("text_sha256")
    first = (F.lit("rev-1").alias("revision_id"), F.lit(None).cast("string").alias("parent_revision_id"), F.lit("accepted").alias("status"), F.lit(0).cast("long").alias("base_token"), F.lit(1).cast("long").alias("token"))
    return {
        "documents": docs.select("doc_id", digest), "claims": claims, "entities": entities, "protected_spans": spans,
        "relationships": E.relationships(claims, entities), "revisions": docs.select("doc_id", *first, digest, "text"),
    }


def ingest(docs: DataFrame, store: str, parts=ingest_parts) -> DataFrame:
    """Ingests the documents (doc_id, text) that no commit has yet: table, n of the rows it wrote.

    Which documents are new is an anti join on doc_id with what is committed; of rows that share a doc_id the one with the
    smallest text counts, rows without one or without a text are left out. All six tables are written before the commit:
    an ingest that fails leaves rows that nobody reads, and running it again ingests what is missing. Nothing new, nothing committed. Of
    two ingests at once one raises IngestConflict. parts gives a table's rows for the new documents.
    """
    spark = docs.sparkSession
    done = commits(spark, store)
    known = stored(spark, store, "documents").select("doc_id")
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("text").alias("text"))
    new = materialize(rows.join(known, "doc_id", "left_anti"), "new")
    if new.isEmpty():
        return spark.createDataFrame([(t, 0) for t in SCHEMAS], "table string, n long")
    name = uuid.uuid4().hex
    for table, own in parts(new).items():
        own.select([c.split()[0] for c in SCHEMAS[table].split(", ")]).write.mode("overwrite").parquet(f"{store}/{table}/{name}")
    _commit(spark, store, len(done), name)
    counted = None
    for table, schema in SCHEMAS.items():
        n = spark.read.schema(schema).parquet(f"{store}/{table}/{name}").agg(F.count("*").alias("n")).select(F.lit(table).alias("table"), "n")
        counted = n if counted is None else counted.unionByName(n)
    return counted


def status(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, accepted_revision, content_persisted of every committed document."""
    revisions = stored(spark, store, "revisions").where("status = 'accepted'").groupBy("doc_id").agg(F.max_by("revision_id", "token").alias("accepted_revision"), F.bool_or(F.col("text").isNotNull()).alias("content_persisted"))
    return stored(spark, store, "documents").select("doc_id").join(revisions, "doc_id", "left").withColumn("content_persisted", F.coalesce("content_persisted", F.lit(False)))
