"""Interval joins against all pairs, and at sizes where all pairs would not end."""

import random
import time

import pytest

from textloom.operators import lexical as X
from textloom.operators import workflow as W
from textloom.operators.intervals import contained, overlapping, sums_before


@pytest.mark.parametrize("width", [1, 7, 256])
def test_pairs_equal_all_pairs(spark, width):
    rng = random.Random(width)
    some = lambda n: [(rng.randrange(3), k, a, a + rng.choice((0, 0, 1, 2, 9, 400))) for k in range(n) for a in [rng.randrange(900)]]
    left, right = some(60), some(50) + [(None, 1, 5, 9), (1, 77, None, 9)]
    a = spark.createDataFrame(left, "doc_id int, i int, start int, end int")
    b = spark.createDataFrame(right, "doc_id int, j int, s int, e int")
    got = sorted((r.i, r.j) for r in overlapping(a, b, width=width).collect())
    known = [r for r in right if None not in r]
    assert got == sorted((x[1], y[1]) for x in left for y in known if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    got = sorted((r.i, r.j) for r in contained(a, b, width=width).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in known if x[0] == y[0] and y[2] <= x[2] and x[3] <= y[3])
    summed = {r.i: r.sum for r in sums_before(a, b.where("s IS NOT NULL").withColumn("value", b.e - b.s), place="s").collect()}
    assert summed == {x[1]: sum(y[3] - y[2] for y in known if y[0] == x[0] and y[2] <= x[2]) for x in left}


def test_one_large_document_takes_seconds(spark):
    """20,000 tokens, 5,000 spans and 5,000 changes of one document: all pairs would be 10^8 and 2.5 * 10^7."""
    tokens = spark.range(20_000).selectExpr("1L AS doc_id", "int(id) AS tok_no", "id * 6 AS offset")
    spans = spark.range(5_000).selectExpr("1L AS doc_id", "int(id) AS span_no", "id * 24 AS start", "id * 24 + 7 AS end")
    changes = spark.range(5_000).selectExpr("1L AS doc_id", "id * 24 + 10 AS offset", "5L AS length", "'longer' AS target")
    X.covered(tokens, spans).count()  # plans and code are warm
    began = time.perf_counter()
    assert X.covered(tokens, spans).count() == 10_000  # offsets 0 and 6 of every 24
    moved = X.rebase(spans, changes)
    assert moved.where("overlap").count() == 0 and moved.where("span_no = 4999").first().start == 4999 * 24 + 4999
    nodes = spans.selectExpr("doc_id", "'paragraph' AS node_type", "start", "start + 15 AS end")
    assert W.node_safe(changes, nodes).where("safe").count() == 5_000
    assert time.perf_counter() - began < 30


def test_rebase_counts_changes_that_end_where_a_span_begins(spark):
    spans = spark.createDataFrame([(1, 1, 10, 15), (1, 2, 20, 22), (2, 1, 0, 3)], "doc_id long, span_no int, start int, end int")
    changes = spark.createDataFrame([(1, 5, 5, "abc"), (1, 21, 1, "xyz")], "doc_id long, offset long, length long, target string")
    got = {(r.doc_id, r.span_no): (r.start, r.end, r.overlap) for r in X.rebase(spans, changes).collect()}
    assert got == {(1, 1): (8, 13, False), (1, 2): (18, 20, True), (2, 1): (0, 3, False)}


def test_capsules_keep_lists_with_the_document(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes = one([(1, 1, "Head", "x"), (1, 2, "Body", "ai_assisted"), (2, 1, "Only", "ai_assisted")], "doc_id long, node_no int, text string, authorship_class string")
    claims = one([(1, k, f"c{k}") for k in range(1, 61)], "doc_id long, claim_no int, proposition string")
    spans = one([(1, 2, "date", "2024", "EXCLUDED"), (1, 1, "number", "5 kg", "KEPT")], "doc_id long, span_no int, kind string, text string, status string")
    citations = one([(1, 2, "[2]"), (1, 1, "[1]")], "doc_id long, citation_no int, text string")
    entities = one([(1, 1, "Anna Miller")], "doc_id long, entity_no int, name string")
    style = [(1, "prohibited_phrases", "no way| at all |no way|")] + [(1, f"k{k:02d}", "v") for k in range(30)]
    documents = W.capsules(nodes, claims, citations, spans, entities, one(style, "doc_id long, kind string, value string"), one([(1, "t", "v")], "doc_id long, name string, value string"))
    got = {r.doc_id: r for r in documents.collect()}
    assert len(got[1].claims) == 50 and len(got[1].open_loops) == 60 and got[1].claims[:2] == ["c1", "c2"] and len(got[1].invariants) == 20
    assert got[1].prohibited == ["no way", "at all"] and got[1].untrusted == ["ai_assisted:2", "excluded_span:2"] and got[1].citations == ["[1]", "[2]"]
    assert got[2].untrusted == ["ai_assisted:1"] and not got[2].claims
    contexts = nodes.selectExpr("doc_id", "node_no", "'' AS before", "'' AS after", "string(null) AS heading", "text AS first")
    ids = lambda docs: {(r.doc_id, r.node_no): r.capsule_id for r in W.capsule_blocks(contexts, nodes, docs).collect()}
    before, after = ids(documents), ids(W.capsules(nodes, claims.where("claim_no < 60"), citations, spans, entities, one(style, "doc_id long, kind string, value string"), one([(1, "t", "v")], "doc_id long, name string, value string")))
    assert len(set(before.values())) == 3 and before[1, 1] != after[1, 1] and before[2, 1] == after[2, 1]
