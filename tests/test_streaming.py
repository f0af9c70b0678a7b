"""Streams give what their batch twins give."""

import os
import tempfile
from datetime import datetime

from conftest import DATA

from textloom.operators.ledger import JUDGED, accept_proposals, latest_decisions
from textloom.operators.scoring import scores
from textloom.streaming import logs


def parts(spark, rows, schema, n):
    """A folder of n files and a stream over it, one file a batch."""
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_scores_of_distinct_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    docs += [(1000 + i, t) for i, t in docs[:20]]
    stream = parts(spark, docs, "doc_id long, text string", 3)
    stored, check = (tempfile.mkdtemp(prefix="spark-stream-") + "/t" for _ in range(2))
    logs.score_stream(stream, stored, check).awaitTermination()
    got = {r.text_sha256: round(r.score, 9) for r in spark.read.parquet(stored).collect()}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.h: round(r.score, 9) for r in scores(df).join(df.selectExpr("doc_id", "sha2(text, 256) AS h"), "doc_id").collect()}
    assert got == want and spark.read.parquet(stored).count() == len(want)


def test_latest_decisions_out_of_order(spark):
    names = ["AUTHENTIC", "EXCLUDE", "USER_REVISION", "QUOTED", "UNKNOWN"]
    rows = [(i % 7, i, s, names[(i + s) % 5]) for s in (2, 0, 1) for i in range(40)]
    stream = parts(spark, rows, "package_id long, span_id long, seq int, class string", 3)
    state, check = (tempfile.mkdtemp(prefix="spark-stream-") + "/t" for _ in range(2))
    logs.decision_stream(stream, state, check).awaitTermination()
    want = latest_decisions(spark.createDataFrame(rows, "package_id long, span_id long, seq int, class string"))
    assert sorted(logs.final_decisions(spark, state).collect()) == sorted(want.collect())


def test_later_runs_go_on_from_their_state(spark):
    """New files after a run: texts scored before aren't scored again, though their ids repeat; only touched spans are written."""
    root = tempfile.mkdtemp(prefix="spark-stream-")
    put = lambda rows, schema, to: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/{to}")
    docs = ([(1, "One text. It is here."), (1, "Another text. It is there."), (2, None)], [(3, "One text. It is here."), (1, "A third text. We saw it."), (None, None)])
    log = ([(1, 1, 5, "AUTHENTIC"), (1, 2, 1, "EXCLUDE"), (1, 2, 1, "QUOTED")], [(1, 1, 4, "EXCLUDE"), (2, 1, 1, "UNKNOWN"), (2, 2, 1, "EXCLUDE")])
    for some, lines in zip(docs, log):
        put(some, "doc_id long, text string", "docs")
        put(lines, "package_id long, span_id long, seq int, class string", "log")
        read = lambda schema, at: spark.readStream.schema(schema).parquet(f"{root}/{at}")
        logs.score_stream(read("doc_id long, text string", "docs"), f"{root}/stored", f"{root}/c1").awaitTermination()
        logs.decision_stream(read("package_id long, span_id long, seq int, class string", "log"), f"{root}/state", f"{root}/c2").awaitTermination()
    stored = spark.read.parquet(f"{root}/stored")
    assert stored.count() == 4 and stored.select("text_sha256").distinct().count() == 4 and stored.where("batch = 1").count() == 1
    assert sorted(map(tuple, logs.final_decisions(spark, f"{root}/state").collect())) == [(1, 1, "AUTHENTIC", True), (1, 2, "QUOTED", True), (2, 2, "EXCLUDE", False)]
    assert not spark.read.parquet(f"{root}/state").where("batch = 1 AND span_id = 2 AND package_id = 1").count()


PROPOSED = "document_id long, seq long, base_token long, parent_revision_id string, revision_id string"
STORED = "document_id long, token long, revision_id string"


def competing():
    """Stored revisions, and a log where two compete for each head, parents are wrong, documents are new and ids given."""
    stored = [(d, t, f"rev-{t}") for d in (1, 2, 3) for t in range(1, 9 + d)]
    log = []
    for d in (1, 2, 3, 4, 5):
        base = {4: 0, 5: 3}.get(d, 8 + d)
        for s in range(8):
            at = base + s // 2
            parent = None if at == 0 else "other" if (d + s) % 7 == 3 else f"rev-{at}"
            log.append((d, s, at, parent, f"own-{s}" if (d, s) == (2, 4) else None))
    return stored, sorted(log, key=lambda r: (r[1], r[0])) + [(None, 1, 0, None, None), (1, 9, None, None, None)]


def test_one_proposal_wins_a_head(spark):
    revisions = spark.createDataFrame([(1, 1, "rev-1"), (1, 2, "rev-2")], STORED)
    rows = [(1, 1, 2, "rev-2", "a"), (1, 2, 2, "rev-2", "b"), (1, 3, 3, "rev-3", "c"), (1, 4, 3, "a", "d"), (9, 1, 0, None, None), (9, 2, 0, None, None), (8, 1, 0, "rev-0", None), (8, 2, 3, None, None)]
    got = sorted((r.document_id, r.seq, r.state, r.token, r.revision_id) for r in accept_proposals(revisions, spark.createDataFrame(rows, PROPOSED)).collect())
    assert got == [
        (1, 1, "accepted", 3, "a"), (1, 2, "stale", None, None), (1, 3, "stale_parent", None, None), (1, 4, "accepted", 4, "d"),
        (8, 1, "unknown_document", None, None), (8, 2, "unknown_document", None, None), (9, 1, "accepted", 1, "rev-1"), (9, 2, "stale", None, None),
    ]
    assert accept_proposals(revisions.limit(0), spark.createDataFrame([], PROPOSED)).count() == 0


def test_acceptance_stream_equals_the_batch(spark):
    stored, log = competing()
    revisions = spark.createDataFrame(stored, STORED)
    want = sorted(map(str, accept_proposals(revisions, spark.createDataFrame(log, PROPOSED)).collect()))
    folder, check = tempfile.mkdtemp(prefix="spark-stream-"), tempfile.mkdtemp(prefix="spark-stream-")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (log[:17], log[17:]):  # the second run goes on from the first one's heads
            spark.createDataFrame(part, PROPOSED).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(PROPOSED).parquet(folder)
            sink = logs.acceptance_stream(stream, revisions).writeStream.outputMode("append").format("parquet").option("path", f"{check}/out").option("checkpointLocation", f"{check}/c")
            sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(str, spark.read.schema(JUDGED).parquet(f"{check}/out").collect())) == want
    states = [r.state for r in spark.read.parquet(f"{check}/out").collect()]
    assert {"accepted", "stale", "stale_parent", "unknown_document"} <= set(states)


def test_state_of_scored_texts_shrinks_and_late_copies_follow_the_rule(spark):
    root = tempfile.mkdtemp(prefix="spark-stream-")
    schema = "doc_id long, text string, ts timestamp"
    day = lambda d: datetime(2024, 1, d)
    # the first text once, again within a day, and a copy long after; a document of the first day that arrives on the last
    batches = [[(1, "One text.", day(1))] + [(10 + k, f"Text number {k}.", day(1)) for k in range(50)], [(2, "One text.", day(1)), (3, "Another one.", day(9))], [(4, "A third.", day(20))], [(5, "One text.", day(21)), (6, "Too late.", day(1))]]
    rows, states, dropped = [], [], 0
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/docs")
        query = logs.score_stream(spark.readStream.schema(schema).parquet(f"{root}/docs"), f"{root}/stored", f"{root}/c", ts="ts")
        query.awaitTermination()
        progress = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        states.append(progress[-1]["numRowsTotal"])
        dropped += sum(p["numRowsDroppedByWatermark"] for p in progress)
        rows.append(spark.read.parquet(f"{root}/stored").count())
    assert rows == [51, 52, 53, 54]  # the copy within the day isn't scored, the one long after is
    assert states[0] == 51 and states[-1] <= 3 and dropped == 1


def test_readers_of_decisions_read_one_snapshot_and_few_batches(spark):
    names = ["AUTHENTIC", "EXCLUDE", "USER_REVISION", "QUOTED", "UNKNOWN"]
    rows = [(i % 7, i, 3_000_000_000 + s, names[(i + s) % 5]) for s in (2, 0, 1, 5, 4, 3, 6) for i in range(20)]
    schema = "package_id long, span_id long, seq long, class string"
    stream = parts(spark, rows, schema, 7)
    state, check = (tempfile.mkdtemp(prefix="spark-stream-") + "/t" for _ in range(2))
    logs.decision_stream(stream, state, check, every=2).awaitTermination()
    left = sorted(n for n in os.listdir(state) if not n.startswith("."))
    assert left == ["batch=4", "batch=5", "batch=6", "snapshot=3", "snapshot=5"]
    want = sorted(latest_decisions(spark.createDataFrame(rows, schema)).collect())
    assert sorted(logs.final_decisions(spark, state).collect()) == want
    os.remove(f"{state}/snapshot=5/_SUCCESS")  # as if it had been cut short: the one before it and its batches count
    assert sorted(logs.final_decisions(spark, state).collect()) == want
    assert logs.final_decisions(spark, f"{state}-none").count() == 0


def test_window_means(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/event[s].parquet")
    query = logs.window_means(stream).writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp()).start()
    query.awaitTermination()
    near = lambda df: sorted((r.start, r.n, round(r.mean_score, 9)) for r in df.collect())
    assert near(spark.table("means")) == near(logs.window_means(events))
    assert logs.window_drift(logs.window_means(events)).count() > 0
