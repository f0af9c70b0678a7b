"""Numbers as text: rounded by their binary value, halves to even."""

import random

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import profiles as P


def test_decimals_round_as_their_binary_value_does(spark):
    rng = random.Random(3)
    values = [k / n for n in (1, 3, 7, 32, 64, 96, 160, 320, 800, 1024) for k in range(n + 1)] + [rng.random() * 10 ** rng.randint(-5, 4) for _ in range(3000)] + [k / 20000 for k in range(1, 20000, 2)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", *[T.decimals(F.col("v"), d).alias(f"d{d}") for d in (1, 2, 4)]).collect()
    assert [r for r in got if (r.d1, r.d2, r.d4) != (f"{r.v:.1f}", f"{r.v:.2f}", f"{r.v:.4f}")] == []


def test_contraction_share_of_one_in_32(spark):
    docs = spark.createDataFrame([(1, "we don't " + "go " * 30)], "doc_id long, text string")
    got = {r.kind: r.evidence for r in P.invariants(docs).collect()}
    assert got["contraction_policy"] == "0.0312"
