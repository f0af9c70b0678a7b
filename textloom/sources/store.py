"""Tables and text files in the folder that all executors share, and sinks that refuse to write over their inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Where the session names none, a folder is made for it on a local master (tests on one machine); on a cluster that
    is an error, as executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables of the innermost open scope, which are to be deleted; each thread and task has scopes of its own.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def written(df: DataFrame, name: str) -> str:
    """Writes df as a table in the shared folder and returns its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread writes inside, when it ends: nothing that reads them may be used later."""
    own: list[str] = []
    outer = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        for path in own:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns what reads it: lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def write_clean(docs: DataFrame, path: str, inputs: tuple[str, ...] = ()) -> None:
    """Writes doc_id and the cleaned text of every document; an input's path or an existing one is an error."""
    from textloom.operators.scrub import scrubbed  # here, as workers that only write tables need no such operators

    plain = lambda p: p.removeprefix("file://").removeprefix("file:").rstrip("/")
    if plain(path) in map(plain, inputs):
        raise ValueError(f"the output must not be an input: {path}")
    scrubbed(docs.select("doc_id", "text")).select("doc_id", F.col("cleaned").alias("text")).write.mode("errorifexists").parquet(path)


def write_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Adds the rows of one run to a report table that is partitioned by run."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The rows of one run, from its partition alone; a run that was never written is an error."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path).where(F.col("run_id").cast("string") == run_id)
    if rows.isEmpty():
        raise ValueError(f"no such run: {run_id}")
    return rows
