"""Ingest that appears whole or not at all, and pages' metadata."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textloom.sources import ingest as I
from textloom.sources import markup as M

DOCS = [(1, 'Anna Miller met Bob Stone. "A quotation of twenty characters" was said on 2024-01-02 (Smith, 2020).'), (2, "It costs $ 5 kg."), (3, None), (None, "no id"), (2, "It is another text of the same id.")]


def rows(spark, store):
    return {t: sorted(map(str, I.stored(spark, store, t).collect())) for t in I.SCHEMAS}


def test_an_ingest_that_fails_half_way_runs_again(spark):
    store = tempfile.mkdtemp(prefix="spark-ingest-") + "/store"
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")

    def breaks(new):
        parts = I.ingest_parts(new)
        return parts | {"revisions": parts["revisions"].withColumn("token", F.expr("raise_error('lost')"))}  # the last table

    with pytest.raises(Exception, match="lost"):
        I.ingest(docs, store, breaks)
    assert I.commits(spark, store) == [] and all(not r for r in rows(spark, store).values())
    assert os.listdir(f"{store}/claims")  # its files are there, and count for nothing
    counts = dict(I.ingest(docs, store).collect())
    assert counts["documents"] == counts["revisions"] == 2 and counts["claims"] == counts["protected_spans"] > 0
    before = rows(spark, store)
    assert {t: len(r) for t, r in before.items()} == counts
    assert set(dict(I.ingest(docs, store).collect()).values()) == {0} and rows(spark, store) == before and len(I.commits(spark, store)) == 1
    more = docs.unionByName(spark.createDataFrame([(9, "One more.")], "doc_id long, text string"))
    assert dict(I.ingest(more, store).collect())["documents"] == 1 and len(I.commits(spark, store)) == 2
    assert sorted(map(tuple, I.status(spark, store).collect())) == [(1, "rev-1", True), (2, "rev-1", True), (9, "rev-1", True)]


def test_of_two_ingests_at_once_one_fails(spark):
    store = tempfile.mkdtemp(prefix="spark-ingest-") + "/store"
    docs = spark.createDataFrame(DOCS[:2], "doc_id long, text string")

    def slow(new):
        I.ingest(docs, store)  # another one commits meanwhile
        return I.ingest_parts(new)

    with pytest.raises(I.IngestConflict):
        I.ingest(docs, store, slow)
    assert I.stored(spark, store, "documents").count() == 2 and len(I.commits(spark, store)) == 1


def test_metadata_in_any_order_and_quotes(spark):
    html = """<html><head><title> A &amp; B </title><meta content='x "y"' name='one'><META NAME=two CONTENT=2><meta name="three"
     data-x="1" content="3 &lt; 4"><meta charset="utf-8"><meta name="none"></head><body><!-- a
 note --><script>var s = '<meta name="four" content="4">';</script><p>text <img src="https://x.example.org/i.png"> more</p></body>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<title>open <p>x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.kind, r.key, r.value) for r in M.page_metadata(pages).collect())
    assert got == [(1, "comment", "comment", "a\n note"), (1, "meta", "one", 'x "y"'), (1, "meta", "three", "3 < 4"), (1, "meta", "two", "2"), (1, "title", "title", "A & B"), (3, "title", "title", "open")]
    image = M.html_nodes(pages).where("node_type = 'image_placeholder'").collect()
    assert [(r.doc_id, html[r.start : r.end]) for r in image] == [(1, '<img src="https://x.example.org/i.png">')]


def test_scratch_deletes_what_its_own_thread_wrote(spark):
    from concurrent.futures import ThreadPoolExecutor

    from textloom.sources.store import materialize, scratch, written

    with ThreadPoolExecutor(1) as other, scratch(spark):
        kept = other.submit(lambda: materialize(spark.range(3).toDF("x"), "other")).result()
        gone = written(spark.range(2).toDF("x"), "own")
        with scratch(spark):
            inner = written(spark.range(1).toDF("x"), "inner")
        assert spark.read.parquet(gone).count() == 2 and not os.path.exists(inner.removeprefix("file://"))
    assert kept.count() == 3 and not os.path.exists(gone.removeprefix("file://"))


def test_depth_by_walking_equals_the_parser(spark):
    from conftest import DATA

    deep = "<ul><li>" * 20 + "x"
    pages = spark.read.parquet(f"{DATA}/pages.parquet").selectExpr("page_id AS doc_id", "html AS text").unionByName(spark.createDataFrame([(-1, deep), (-2, "<ul><li>a<ul><li>b</ul></ul>"), (-3, "")], "doc_id long, text string"))
    nodes = M.html_nodes(pages)
    parsed = {r.doc_id: r.depth for r in nodes.groupBy("doc_id").agg({"depth": "max"}).withColumnRenamed("max(depth)", "depth").collect()}
    walked = {r.doc_id: (r.depth, r.too_deep) for r in M.tree_depth(nodes).collect()}
    assert walked == {i: (min(d, 33), d > 32) for i, d in parsed.items()} and parsed[-1] == 40 and -3 not in walked
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_manifest_and_its_files(spark):
    import json

    from textloom.sources.files import corpus_manifest

    root = tempfile.mkdtemp(prefix="spark-corpus-")
    os.mkdir(f"{root}/texts")
    files = {"texts/a.txt": b"One text.", "b.txt": b"\xef\xbb\xbfmarked", "c.txt": b"", "d.txt": b" \n ", "e.txt": b"\xff\xfe\x00bad", "f.txt": "Ärger".encode()}
    for name, body in files.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(body)
    entries = [("s1", "one", "texts/a.txt"), ("s2", "one", "b.txt"), ("s3", "two", "c.txt"), ("s4", "two", "d.txt"), ("s5", "odd", "f.txt"), ("s6", "one", "none.txt"), ("s7", "one", "f.txt"), ("s7", "two", "f.txt"), ("", "one", "f.txt"), ("s8", "two", "f.txt"), ("s9", "one", "")]

    def put(version, rows):
        with open(f"{root}/corpus-manifest.json", "w") as f:
            json.dump({"schema_version": version, "samples": [dict(zip(("sample_id", "group", "file"), r)) for r in rows]}, f)
        return corpus_manifest(spark, root, ("one", "two"))

    samples, problems = put(1, entries)
    assert sorted(map(tuple, samples.collect())) == [("s1", "one", "One text."), ("s8", "two", "Ärger")]
    assert sorted(map(tuple, problems.collect())) == [("", "sample_id"), ("s2", "bom"), ("s3", "missing"), ("s4", "blank"), ("s5", "group"), ("s6", "missing"), ("s7", "repeated"), ("s9", "file")]
    samples, problems = put(2, entries[:1])
    assert samples.count() == 0 and [tuple(r) for r in problems.collect()] == [("", "schema_version")]
    assert [tuple(r) for r in put(1, [])[1].collect()] == [("", "samples")]


def test_title_entities_with_and_without_their_semicolon(spark):
    pages = spark.createDataFrame([(1, "<title>a&amp;b &lt c&#65; &#66 &amp</title>"), (2, "<title>x &nbsp"), (3, "<title>5 < 6 &gt</title>")], "doc_id long, text string")
    got = lambda bare: [r.value for r in M.page_metadata(pages, bare).orderBy("doc_id").collect()]
    assert got(False) == ["a&b &lt cA &#66 &amp", "x &nbsp", "5 < 6 &gt"]
    assert got(True) == ["a&b < cA B &", "x", "5 < 6 >"]
