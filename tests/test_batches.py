"""What runs in Python takes a batch's texts a few at a time."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.operators import scoring
from textloom.sources import markup


def test_rows_are_handed_on_before_a_batch_ends():
    run = markup._rows(lambda t: [(k, t) for k in range(1000)] if t else [], "doc_id long, k int, text string")
    texts = [None if k == 7 else "" if k == 8 else f"t{k}" for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = list(run(iter([batch])))
    assert max(x.num_rows for x in out) < 6000 and len(out) > 10
    assert [r for x in out for r in x.to_pylist()] == [{"doc_id": i, "k": k, "text": t} for i, t in enumerate(texts) if t for k in range(1000)]
    assert list(run(iter([]))) == [] and list(run(iter([batch.slice(7, 2)]))) == []


def test_scorers_get_a_few_texts_at_a_time(spark):
    def longest(texts: pd.Series) -> pd.Series:  # shows how many came together
        return pd.Series([None if t is None else float(len(texts)) for t in texts])

    docs = spark.createDataFrame([(k, None if k == 3 else "x") for k in range(1000)], "doc_id long, text string").coalesce(1)
    scoring.register_scorer(spark, "came_together", longest)
    for scores in (scoring.hooked(longest)(docs), scoring.scorer_of("came_together")(docs)):
        got = {r.doc_id: r.score for r in scores.collect()}
        assert len(got) == 1000 and got[3] is None and max(v for v in got.values() if v is not None) <= 256
    assert docs.limit(0).select(F.call_udf("came_together", "text")).collect() == []
