"""Steps that read a text once, count before they compare, and look at few lines give what the long ways give."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import evidence as E
from textloom.operators import metrics as M
from textloom.operators import profiles as P

TEXTS = ["It's so. I don't — however, we were asked!\n\n \nIt's so [1, 2].", "", None, " \n\t ", "one", "a b a b. A b\x0b a", "İ said K's “so”? (Smith, 2020) 'so' it ' s", "x.  ", "x \x85", "...  . a.b ! c"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stripping_and_counting_sentences(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("a.!? \n\t\x0b\x85 ") for _ in range(rng.randrange(12))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    space = " \t\n\x0b\f\r"
    got = d.select("text", T.strip(F.col("text")).alias("s"), T.sentences(F.col("text")).alias("xs"), F.size(T.sentences(F.col("text"))).alias("n"), T.sentence_count(T.strip(F.col("text"))).alias("k")).where("text IS NOT NULL")
    for r in got.collect():
        assert r.s == r.text.strip(space)  # no sign that a regular expression's end of text passes over
        assert all(x == x.strip(space) != "" for x in r.xs)
        assert r.n == (r.k if r.s else 0)


@pytest.mark.parametrize("way", ["hashed", "long", "one hash", "some hashes"])
def test_top_pairs_are_the_most_frequent_ones(spark, monkeypatch, way):
    rng = random.Random(5)
    texts = [[rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 60))] for _ in range(80)]
    if way == "long":
        monkeypatch.setattr(M, "_PLACE", 4)
    if way == "one hash":
        monkeypatch.setattr(M.F, "xxhash64", lambda *c: F.lit(-(1 << 40)).cast("long"))
    if way == "some hashes":  # pairs of equal first words are taken for one
        monkeypatch.setattr(M.F, "xxhash64", lambda a, b: F.shiftleft(F.ascii(a).cast("long"), 30))
    d = spark.createDataFrame([(k, w) for k, w in enumerate(texts)] + [(900, None)], "doc_id long, w array<string>")
    got = {r.doc_id: r.x for r in M.with_top_pairs(d, "w", "x").collect()}
    assert len(got) == 81 and not got[900]
    for k, w in enumerate(texts):
        assert [tuple(x) for x in got[k]] == Counter(map(" ".join, zip(w, w[1:]))).most_common(3)


def test_style_is_invariants_and_tendencies_from_one_reading(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    own = P.style(d)
    assert rows(own.select("doc_id", F.inline("invariants"))) == rows(P.invariants(d))
    assert rows(own.select("doc_id", F.inline("tendencies"))) == rows(P.tendencies(d))
    assert plan(own).count("(?<=[.!?])") == plan(P.tendencies(d)).count("(?<=[.!?])")
    some = P.invariants(d, P.COMPARED)
    assert rows(some) == rows(P.invariants(d).where(F.col("kind").isin(*P.COMPARED)))


def test_violations_of_versions_need_compared_kinds_only(spark):
    from __spark_entry__ import queries

    got = plan(queries()["j11_violations"](spark, "/root/testdata/sf0.001"))
    assert "bracket_numbers" not in got and "not_extractable" not in got


def test_lines_without_spans_are_left_out_first(spark, monkeypatch):
    texts = ['He said "it was a very long day" and', "“it was a very long night”", "10.1234/ab.c.", "see [3, 4]", "(Smith, 2020a)", "https://a.example/x", "5 kg", "3 March 2020", "plain", "", "٣ kg", "2020-01-02"]
    nodes = spark.createDataFrame([(k, 1, i * 100, i * 100 + len(t), t) for k, i, t in [(i % 3, i, t) for i, t in enumerate(texts)]], "doc_id long, node_no int, start int, end int, text string")
    got = E.span_candidates(nodes)
    assert {r.kind for r in got.collect()} == {"quotation", "citation", "number", "date"}
    assert "RLIKE(text" in plan(got).split("Filter", 1)[1].split("\n")[0]
    cited = E.citations(nodes)
    typed = nodes.withColumn("node_type", F.when(F.col("start") == 800, "quotation").otherwise("paragraph"))
    assert rows(E.span_candidates(typed)) == sorted(rows(got) + [(2, "quotation", "plain", "", 800, 805)], key=repr)
    monkeypatch.setattr(E, "_TELLING", "")  # every line is searched
    monkeypatch.setattr(E, "_CITING", "")
    assert rows(got) == rows(E.span_candidates(nodes)) and rows(cited) == rows(E.citations(nodes)) and len(rows(cited)) == 4


def test_categories_with_all_anchors_are_settled_by_counting(spark, monkeypatch):
    source = [(1, 1, "number", "5"), (1, 2, "number", "5"), (1, 3, "date", "2020-01-02"), (2, 1, "number", "7"), (3, 1, "number", "123456")]
    candidate = [(1, 1, "number", "6"), (1, 2, "number", "5"), (1, 3, "number", "5"), (1, 4, "date", "2020-01-02"), (3, 1, "number", "123457"), (4, 1, "quote", "new")]
    seen = []
    similar = E.similar_texts
    monkeypatch.setattr(E, "similar_texts", lambda s, c: seen.append((s.count(), c.count())) or similar(s, c))
    frame = lambda x: spark.createDataFrame(x, "doc_id long, seq int, category string, text string")
    got = rows(E.fact_diff(frame(source), frame(candidate)))
    assert seen == [(1, 1)]  # document 3 alone
    assert got == [(1, 3, 4, 0, 1, 0, 1.0), (2, 1, 0, 1, 0, 0, 0.0), (3, 1, 1, 0, 0, 1, 1.0), (4, 0, 1, 0, 1, 0, 1.0)]


def test_groups_that_run_over_batches_are_matched_whole():
    listed = [(1, "x", 0, 1, "ab", None), (1, "x", 0, 2, "ac", None), (1, "x", 1, 1, "ac", 0.75), (1, "x", 1, 1, "ab", 0.75), (1, "x", 1, 4, "ab", 1.0), (1, "x", 1, 4, "ac", 0.95), (1, "x", 1, 5, "ab", 1.0), (1, "y", 0, 1, "q", None), (2, "y", 0, 1, "q", None), (2, "y", 1, 1, "q", 1.0)]
    names = ["doc_id", "category", "side", "seq", "text", "ratio"]
    for size in (1, 2, 3, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in listed[i : i + size]], schema=pa.schema([("doc_id", pa.int64()), ("category", pa.string()), ("side", pa.int32()), ("seq", pa.int32()), ("text", pa.string()), ("ratio", pa.float64())])) for i in range(0, len(listed), size)]
        out = [tuple(r.values()) for b in E._matched(iter(batches)) for r in b.to_pylist()]
        assert out == [(1, 2, 1), (2, 1, 0)]
    assert list(E._matched(iter([]))) == []


def test_anchor_items_are_the_anchors_of_a_category_in_order(spark):
    from pyspark.sql import Window

    texts = [*TEXTS, 'Anna Miller paid $1,000 and 5% on 2024-01-02, or May 3, 2020 (1/2/24): "so it is" [1] "it was" (Smith, 2020) New Old Person, "" 7', "Bob Stone", '"abc', "[x (y", "May 3, 2020"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nth = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("seq"))
    want = rows(E.anchors(d).select("doc_id", nth.alias("seq"), "category", "text"))
    got = E.anchor_items(d)
    assert rows(got) == want and {r[2] for r in want} == {k for k, _ in E.ANCHORS} and "Window" not in plan(got)
    after = d.withColumn("text", F.replace("text", F.lit("[1]"), F.lit("[2]")))
    assert [tuple(r) for r in E.revalidated(d, after).where("NOT ok").collect()] == [(len(TEXTS), False, "fact_anchor_drift:omissions=2,additions=2,contradictions=0;citation_drift:expected=2,current=2")]


def test_blocks_with_their_texts_are_not_dealt_out_again(spark, monkeypatch):
    from textloom.operators import review as R
    from textloom.operators import workflow as W
    from textloom.plans import steps

    texts = ["a\nb\n\n# c\nd", "", "one", "x\n \ny\nx"]
    nodes = E.line_nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("node_type", F.lit("paragraph"))
    documents = nodes.select("doc_id").distinct().select("doc_id", *[F.array(F.lit(c)).alias(c) for c in W.CAPSULE_LISTS])
    held = W.capsule_blocks(R.block_contexts(nodes, keep=("text",)), nodes, documents)
    assert rows(held) == rows(W.capsule_blocks(R.block_contexts(nodes), nodes, documents)) and held.count() == 8
    seen = []
    monkeypatch.setattr(W, "capsule_blocks", lambda contexts, *x: seen.append(contexts.columns) or held)
    monkeypatch.setattr(steps, "_capsules", lambda d: (nodes, documents))
    steps._block_capsules(nodes)
    assert "text" in seen[0]
