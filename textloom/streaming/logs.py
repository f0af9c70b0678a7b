"""Append-only logs as streams. Every job ends in foreachBatch or an append sink and equals its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from textloom.operators.ledger import JUDGED, heads, judge, latest_decisions
from textloom.operators.scoring import scores


def _sink(stream: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], mode: str, checkpoint: str, after: Callable[[SparkSession, int], None] | None = None) -> StreamingQuery:
    """Writes what work makes of each batch to path/batch=<n>, then calls after; a batch that runs again overwrites its own rows only."""

    def write(batch: DataFrame, n: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if after is not None:
            after(batch.sparkSession, n)

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(docs: DataFrame, stored: str, checkpoint: str, ts: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Scores arriving documents (doc_id, text), each distinct text once: text_sha256, score, label under stored/batch=<n>.

    Which texts came before is the query's own state (a hash each, dealt over the executors), so a batch costs what it
    brings, not what is stored. A store goes with one checkpoint. Null texts count as one text.

    Without ts the state keeps every hash for good. With ts, a column of event times, a hash is kept until the watermark,
    the latest event time less `late`, has passed its first time by `late`: copies until then aren't scored
    again, a later copy is scored once more (readers that want one row take any: its score is the same), and a document that
    arrives with a time before the watermark isn't scored; the query's progress counts those (numRowsDroppedByWatermark).
    """
    first = docs.select(F.sha2("text", 256).alias("text_sha256"), "text", *([ts] if ts else []))
    if ts:
        first = first.withWatermark(ts, late).dropDuplicatesWithinWatermark(["text_sha256"]).drop(ts)
    else:
        first = first.dropDuplicates(["text_sha256"])
    # the hash stands for the document: ids may repeat
    work = lambda batch: scores(batch.withColumnRenamed("text_sha256", "doc_id")).withColumnRenamed("doc_id", "text_sha256")
    return _sink(first, stored, work, "append", checkpoint)


_DECIDED = "package_id long, span_id long, seq long, class string"


def _parts(spark: SparkSession, state: str) -> tuple[int, dict[str, int]]:
    """The last whole snapshot's number (-1: none) and the state's folders with theirs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    found = {n: int(n.partition("=")[2]) for n in names if n.partition("=")[0] in ("batch", "snapshot")}
    # Spark writes _SUCCESS last: a snapshot without it was never finished
    whole = [k for n, k in found.items() if n.startswith("snapshot") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{n}/_SUCCESS"))]
    return max(whole, default=-1), found


def _latest(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """Per span the last known decision, from the last snapshot and the batches after it (up to and with `before`)."""
    base, found = _parts(spark, state)
    paths = [f"{state}/{n}" for n, k in found.items() if (n == f"snapshot={base}") or (n.startswith("batch") and k > base and (before is None or k <= before))]
    rows = spark.read.schema(_DECIDED).parquet(*paths) if paths else spark.createDataFrame([], _DECIDED)
    return rows.groupBy("package_id", "span_id").agg(F.max(F.struct("seq", "class")).alias("last")).select("package_id", "span_id", "last.*")


def decision_stream(decisions: DataFrame, state: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Keeps the log's latest decision per span; order of arrival doesn't matter, seq does.

    The latest ones are the query's own state. Each batch writes only the spans that it touched to state/batch=<n>. Every
    `every` batches the last snapshot and the batches after it become state/snapshot=<n>, which readers take from the
    moment it is whole; what the snapshot before it covers is then deleted. A reader reads one snapshot and fewer than
    `every` batches, however long the stream runs. A snapshot costs as much as there are spans.
    """
    known = decisions.where("class <> 'UNKNOWN'").groupBy("package_id", "span_id")
    last = known.agg(F.max(F.struct(F.col("seq").cast("long").alias("seq"), "class")).alias("last")).select("package_id", "span_id", "last.*")

    def compact(spark: SparkSession, n: int) -> None:
        if (n + 1) % every:
            return
        before, _ = _parts(spark, state)
        if before < n:
            _latest(spark, state, n).write.mode("overwrite").parquet(f"{state}/snapshot={n}")
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(state).getFileSystem(spark._jsc.hadoopConfiguration())
        # one generation stays for readers that have begun
        for name, k in _parts(spark, state)[1].items():
            if k < before or (name.startswith("batch") and k == before):
                fs.delete(path(f"{state}/{name}"), True)

    return _sink(last, state, lambda batch: batch, "update", checkpoint, compact)


def final_decisions(spark: SparkSession, state: str) -> DataFrame:
    """What the decisions of all batches so far come to."""
    return latest_decisions(_latest(spark, state))


class _Acceptance(StatefulProcessor):
    """One document's head; its proposals are judged in order of seq within a batch."""

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", "token long, revision_id string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        for token, own in zip(initialState.token, initialState.revision_id):
            self.head.update((int(token), own))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        none = lambda x: None if pd.isna(x) else x
        whole = pd.concat(list(rows)).sort_values(["seq", "revision_id", "base_token", "parent_revision_id"], na_position="first")
        head, out = self.head.get() if self.head.exists() else None, []
        for seq, base, parent, own in zip(whole.seq, whole.base_token, whole.parent_revision_id, whole.revision_id):
            base = None if pd.isna(base) else int(base)
            state, head = judge(head, base, none(parent), none(own))
            new = state == "accepted"
            out.append((none(key[0]), none(seq), base, state, head[0] if new else None, head[1] if new else None))
        if head is not None:
            self.head.update(head)
        yield pd.DataFrame(out, columns=["document_id", "seq", "base_token", "state", "token", "revision_id"]).astype({c: "Int64" for c in ("document_id", "seq", "base_token", "token")})

    def close(self) -> None:
        pass


def acceptance_stream(proposals: DataFrame, revisions: DataFrame | None = None) -> DataFrame:
    """accept_proposals() of a stream: what arrives in a later batch comes after what an earlier one brought.

    State is each document's head: from the stored revisions, when the query first starts, and from accepted proposals.
    A log whose batches come in order of seq gives what the batch job gives. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass). A batch holds one document's proposals of that batch at once.
    """
    rows = proposals.select(F.col("document_id").cast("long").alias("document_id"), F.col("seq").cast("long").alias("seq"), F.col("base_token").cast("long").alias("base_token"), "parent_revision_id", "revision_id")
    start = heads(revisions).select(F.col("document_id").cast("long").alias("document_id"), "token", "revision_id").groupBy("document_id") if revisions is not None else None
    return rows.groupBy("document_id").transformWithStateInPandas(_Acceptance(), JUDGED, "Append", "None", initialState=start)


def window_means(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean score per tumbling window of a stream or a table (ts, value)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w")).agg(F.avg(F.col("value") / 500).alias("mean_score"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "mean_score", "n")


def window_drift(means: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Windows whose mean is over threshold away from the window before."""
    delta = F.abs(F.col("mean_score") - F.lag("mean_score").over(Window.orderBy("start")))  # one row per window
    return means.withColumn("delta", delta).where("delta IS NOT NULL").withColumn("drifted", F.col("delta") > threshold)
