"""Operators on hand-made rows with known results."""

from pyspark.sql import functions as F

from textloom.operators import evidence, ledger, lexical, metrics, profiles, review, scrub, workflow
from textloom.operators.review import repair_decisions
from textloom.sources import files, markup


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_sentence_figures(spark):
    r = one(metrics.syntax(texts(spark, "One two three. Four five! Six? seven eight nine ten")))
    assert (r.n, r.minimum, r.maximum, r.mean, r.median, r.fragments) == (4, 1.0, 4.0, 2.5, 2.5, 2)
    r = one(metrics.syntax(texts(spark, "")))
    assert (r.n, r["mean"], r.stdev, r.p90) == (0, 0.0, 0.0, 0.0)


def test_mattr_is_the_mean_over_windows(spark):
    words = [f"w{(k * k) % 37}" for k in range(150)]
    want = sum(len(set(words[i : i + 100])) / 100 for i in range(51)) / 51
    assert abs(one(metrics.mattr(texts(spark, " ".join(words)))).mattr - want) < 1e-9
    assert one(metrics.mattr(texts(spark, "a b a c"))).mattr == 0.75


def test_conventions(spark):
    t = texts(spark, "a — b – c", "don't", "it’s “so”", "plain", None)
    assert [(r.dash, r.quote, r.apostrophe) for r in metrics.conventions(t).orderBy("doc_id").collect()][:4] == [("mixed", "none", "none"), ("none", "none", "straight"), ("none", "mixed", "curly"), ("none", "none", "none")]


def test_scrub_steps(spark):
    t = '﻿[Model: x] ```a"request_id": "1"  \r\nb\n\n\n\nc'
    r = one(scrub.scrubbed(texts(spark, t)))
    assert r.cleaned == " ```a\nb\n\nc\n"
    assert r.categories == ["bom", "model_tag", "telemetry", "crlf", "trailing_ws", "blank_lines"] and r.modifications == 6
    assert one(scrub.scrubbed(texts(spark, '{"text": "a\\nb"}'))).cleaned == "a\nb\n"
    assert one(scrub.scrubbed(texts(spark, "```py\nx = 1\n```"))).cleaned == "x = 1\n"


def test_line_ends_and_hosts(spark):
    t = texts(spark, "a\r\nb", "a\nb", "a\rb", "a\r\nb\nc", "a")
    assert [r[0] for r in t.orderBy("doc_id").select(scrub.line_ending(F.col("text"))).collect()] == ["crlf", "lf", "cr", "mixed", "none"]
    urls = texts(spark, "HTTPS://u:p@Host.example:8443/x?y", "no scheme", "http:///x")
    assert [r[0] for r in urls.orderBy("doc_id").select(scrub.host_only(F.col("text"))).collect()] == ["https://host.example", "remote_resource", "remote_resource"]


def test_anchor_offsets_are_exact(spark):
    t = 'é😀 paid $1,234 on 2024-01-05 to Anna Miller, "three words here" (Smith, 2020) [1, 2]'
    rows = evidence.anchors(texts(spark, t)).collect()
    for r in rows:
        at = r.position + (r.category == "quote")
        assert t[at : at + len(r.text)] == r.text
    assert {r.category for r in rows} == {"number", "date", "entity", "quote", "citation"}


def test_greedy_diff_takes_the_best_free_candidate(spark):
    schema = "doc_id long, seq int, category string, text string"
    s = spark.createDataFrame([(1, 1, "entity", "Anna Miller"), (1, 2, "number", "10"), (2, 1, "number", "5")], schema)
    c = spark.createDataFrame([(1, 1, "entity", "Anna Millers"), (1, 2, "entity", "Anna Miller"), (1, 3, "number", "77")], schema)
    got = {r.doc_id: r for r in evidence.fact_diff(s, c).collect()}
    assert (got[1].omissions, got[1].additions, got[1].contradictions, got[1].preservation) == (1, 2, 0, 0.5)
    assert (got[2].omissions, got[2].n_candidate) == (1, 0)


def test_protected_spans_are_greedy(spark):
    rows = [(1, "a", "", "", 0, 10), (1, "b", "", "", 5, 20), (1, "b", "", "", 10, 12), (1, "a", "", "", 0, 10)]
    df = spark.createDataFrame([(d, k, t, lab, s, e) for d, k, t, lab, s, e in rows], "doc_id long, kind string, text string, label string, start int, end int")
    assert [(r.start, r.end) for r in evidence.protected_spans(df).orderBy("span_no").collect()] == [(0, 10), (10, 12)]


def test_proposals(spark):
    docs = texts(spark, "We UTILIZE it, utilizing tools; utilized. He will use utilize now. Purchase a car")
    spans = spark.createDataFrame([(0, 3, 10)], "doc_id long, start int, end int")
    got = {r.surface: (r.target, r.status) for r in lexical.propose(docs, lexical.rules(spark), spans).collect()}
    assert got["UTILIZE"][1] == "protected_span" and got["utilizing"] == ("using", "safe") and got["utilized"] == ("used", "safe")
    assert got["utilize"][1] == "collocation" and got["Purchase"] == ("Buy", "proposed")


def test_stores_and_envelopes(spark):
    store = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], "id string, content string")
    assert [r.id for r in ledger.store_conflicts(store).collect()] == ["x"] and ledger.integrity_violations(store).count() == 3
    key = F.lit("0123456789abcdef")
    df = texts(spark, "geheim é" * 40, "").select(ledger.encrypted(F.col("text"), key).alias("c"), "text")
    assert all(r.ok for r in df.select((ledger.decrypted(F.col("c"), key) == F.col("text")).alias("ok")).collect())
    assert one(texts(spark, "encv1:local:AAAA").select(ledger.decrypted(F.col("text"), key).alias("x"))).x is None


def test_repair_gate(spark):
    rows = [(1, 0, 0, 0.9, 0, 0, 0), (2, 0, 0, 0.9, 1, 0, 0), (3, 0, 0, 0.9, 0, 1, 0), (4, 3, 0, 0.2, 0, 1, 0), (5, 0, 11, 1.0, 0, 0, 0), (6, 3, 0, 1.0, 0, 0, 0), (7, 1, 10, 0.84, 0, 0, 0), (8, 1, 0, 0.85, 2, 0, 0)]
    df = spark.createDataFrame(rows, "pair_id int, attempt int, modifications int, preservation double, omissions int, contradictions int, additions int")
    assert [r.decision for r in repair_decisions(df).orderBy("pair_id").collect()] == ["accept", "accept", "repair", "fail", "fail", "fail", "repair", "repair"]


def test_workflow_states(spark):
    steps = ["observed", "triaged", "researched", "verified", "proposed", "policy_reviewed", "approved", "quarantined", "validated", "release_approved"]
    rows = [(1, k, s) for k, s in enumerate(steps)] + [(2, 0, "observed"), (2, 1, "denied"), (2, 2, "triaged"), (3, 0, "release_approved"), (3, 1, "denied"), (4, 0, "observed"), (4, 1, "researched"), (5, 0, "approved"), (5, 1, "denied")]
    bad = ledger.illegal_transitions(spark.createDataFrame(rows, "item_id int, seq int, status string"))
    assert sorted((r.item_id, r.seq) for r in bad.collect()) == [(2, 2), (3, 1), (4, 1)]


def test_json_without_text(spark):
    values = ['{"score": 1}', '{"raw_text": 1}', '{"a": [{"myPrompt": 1}]}', '{"a": "b c"}', '{"a": "' + "x" * 65 + '"}', '{"a": ["' + "x" * 64 + '"]}', '{"a": "b\\tc"}', '{"SOURCE": null}', "no json", None, '["ok", 1, true]', '{"a": "b:c"}', '{"k\\"ey": "v"}']
    got = [r[0] for r in texts(spark, *values).orderBy("doc_id").select(workflow.text_free(F.col("text"))).collect()]
    assert got == [True, False, False, False, False, True, False, False, False, True, True, True, True]


def test_invariants_and_tendencies(spark):
    t = "However, I can't stop. We don't know (Smith, 2019) or [1, 2]; we don't know.\n\nThus it ends."
    got = {r.kind: (r.value, r.status, r.evidence) for r in profiles.invariants(texts(spark, t)).collect()}
    assert len(got) == 10 and got["citation_presentation"][0] == "bracket_numbers=1,author_year=1" and got["heading_capitalization"] == ("", "unknown", "not_extractable_from_plain_text")
    assert got["preferred_terminology"] == ("we don't|don't know|however i", "pass", "counts=2,2,1") and got["paragraph_range"] == ("1..2", "pass", "paragraphs=2")
    assert got["contraction_policy"][0] == "contractions_present" and got["person_policy"][0] == "first_plural=present|first_singular=present|second_person=absent|third_person=present"
    got = {r.name: (r.value, r.strength) for r in profiles.tendencies(texts(spark, t)).collect()}
    assert got["top_transition"] == ("however", "strong") and got["sentence_length_band"][0] == "short" and set(got) == {"sentence_length_band", "top_transition", "punctuation_density", "lexical_richness"}
    assert {r.name: r.value for r in profiles.tendencies(texts(spark, "")).collect()}["top_transition"] == "none"


def test_claim_diff_matches_exactly_before_it_contradicts(spark):
    schema = "doc_id long, claim_no int, proposition string, negation boolean"
    s = spark.createDataFrame([(1, 1, "rose 5 percent", False), (1, 2, "rose 7 percent", False), (1, 3, "it is so", False), (1, 4, "gone", False)], schema)
    c = spark.createDataFrame([(1, 1, "rose 7 percent", False), (1, 2, "rose 9 percent", False), (1, 3, "it is not so", True), (1, 4, "new", False)], schema)
    assert sorted((r.source_no, r.candidate_no) for r in evidence.contradicted_pairs(s, c).collect()) == [(1, 2), (3, 3)]
    r = one(evidence.claim_diff(s, c))
    assert (r.preserved, r.omitted, r.added, r.contradicted, r.coverage) == (1, 1, 1, 2, "known")


def test_facts_and_citations_are_revalidated(spark):
    before = texts(spark, "Paid 10 [1] and [2].", "Paid 10 [1] and [2].", "plain")
    after = texts(spark, "Paid 10 [1] and [2].", "Paid 11 [2] and [1].", "plain")
    got = {r.doc_id: (r.ok, r.findings) for r in evidence.revalidated(before, after).collect()}
    assert got[0] == (True, "") and got[2] == (True, "") and not got[1][0] and "citation_drift:expected=2,current=2" in got[1][1]


def test_phrases_go_longest_first(spark):
    docs = texts(spark, "In order to use it, In  order to; we use it in order")
    rules = spark.createDataFrame([(s,) for s in ("in order to", "in order", "use it", "order to use")], "source string")
    got = sorted((r.offset, r.source, r.token) for r in lexical.phrases(docs, rules).collect())
    assert got == [(3, "order to use", "order to use"), (37, "use it", "use it"), (44, "in order", "in order")]


def test_gates_of_a_finalization(spark):
    bases = spark.createDataFrame([(k, "a", t, 2) for k, t in enumerate(["We utilize it.", "We utilize it.", "# We utilize it", "We utilize 5 kg."])], "doc_id long, source string, text string, base_token int")
    changes = spark.createDataFrame([(k, 3 + 2 * (k == 2), 7, "utilize", "use") for k in range(4)], "doc_id long, offset long, length long, surface string, target string")
    decisions = changes.select("doc_id", "offset").withColumn("accepted", F.lit(True))
    decisions = decisions.unionByName(decisions.where("doc_id = 1"))
    nodes = evidence.line_nodes(bases).withColumn("node_type", F.when(F.col("doc_id") == 2, "heading").otherwise("paragraph"))
    spans = spark.createDataFrame([(3, 1, 11, 15, "5 kg")], "doc_id long, span_no int, start int, end int, text string")
    revisions = spark.createDataFrame([(k, 3 if k == 3 else 2, "accepted") for k in range(4)], "document_id long, token int, status string")
    got = {(r.doc_id, r.gate) for r in workflow.finalized(bases, changes, decisions, nodes, spans, revisions).where("NOT passed").collect()}
    assert got == {(1, "review"), (1, "accepted"), (2, "node_safe"), (2, "structure"), (2, "accepted"), (3, "revision"), (3, "accepted")}


def test_profiles_of_voices_and_their_coverage(spark):
    schema = "package_id long, span_no int, text string, class string, resolved boolean, words long, unsupported string"
    rows = [(1, 2, "second", "user_revision", True, 1, None), (1, 1, "first", "authentic_user_prose", True, 1, None), (1, 3, "quoted", "quotation", True, 1, None), (2, 1, "open", "unknown", False, 1, "style"), (3, 1, "mine", "authentic_user_prose", True, 1, None)]
    spans = spark.createDataFrame(rows, schema)
    assert {r.package_id: r.text for r in review.voice_texts(spans).collect()} == {1: "first\n\nsecond", 3: "mine"}
    got = {r.package_id: r for r in review.coverage(spans, 2).collect()}
    assert [got[k].status for k in (1, 2, 3)] == ["complete", "human_review_required", "partial"] and got[2].features == "style" and got[2].structure_coverage == 0.0
    packages = review.coverage(spans, 2)
    both = lambda ids, least: one(review.profile_coverage(packages.where(F.col("package_id").isin(*ids)).withColumn("profile", F.lit("p")), least))
    assert both((1, 3), 3).status == "complete" and both((1, 3), 9).status == "partial" and both((1, 2), 2).status == "human_review_required" and both((1,), 9).status == "partial"
    docs = spark.createDataFrame([(1, "s", "A b c. D e."), (2, "s", "F g h i j k. L.")], "doc_id long, source string, text string")
    p = one(profiles.profiles(docs))
    assert (p.words, p.sentences, p.sentence_mean, p.sentence_range, p.paragraph_range, p.terms) == (12, 4, 3.0, "1.3..5.1", "2..2", "a b|b c|c d")


def test_markdown_places_and_links(spark):
    md = "# Head\none\ntwo [x](http://e.org) end\n\n```\ncode\n```\nTitle\n====="
    rows = markup.markdown_nodes(texts(spark, md)).orderBy("node_no").collect()
    assert [(r.node_type, md[r.start : r.end]) for r in rows] == [("heading", "# Head"), ("paragraph", "one\ntwo [x](http://e.org) end"), ("hyperlink", "one\ntwo [x](http://e.org) end"), ("code_block", "```\ncode\n```"), ("heading", "Title\n=====")]
    page = '<p onclick="a()">x</p><script src="//h.org/a">1</script><a href="JavaScript:1">b</a><style></style><img src="data:x">'
    assert [(r.code.split(".")[1], r.evidence) for r in markup.page_findings(texts(spark, page)).orderBy("offset", "code").collect()] == [("event_handler", "html_event_handler"), ("html_script", "html_script"), ("remote_resource", "remote_resource"), ("javascript_link", "javascript_link"), ("feature", "style_element"), ("data_uri", "data_uri")]
    html = "<ul><li>a<li>b</ul>loose"
    assert [(r.node_type, html[r.start : r.end]) for r in markup.html_nodes(texts(spark, html)).orderBy("node_no").collect()] == [("list", "<ul><li>a<li>b</ul>"), ("list_item", "<li>a"), ("list_item", "<li>b"), ("paragraph", "loose")]


def test_audits_and_forms(spark):
    files_ = spark.createDataFrame([("/o/a.MD", "# T\nx\n", "T", ["x", "T"], ["# T  x"]), ("/o/b.txt", "a\n\n", None, None, None), ("/o/c", "e\u0301\x07", None, None, None)], "path string, text string, title string, sections array<string>, claims array<string>")
    got = sorted((r.path, r.code, r.evidence) for r in scrub.artefact_audit(files_).collect())
    assert got == [("/o/a.MD", "audit.content.missing", "section_index=1"), ("/o/b.txt", "audit.trailing_newline.extra", "tail_extra"), ("/o/c", "audit.format.unknown", "ext="), ("/o/c", "audit.unicode.control_chars", "first_offset=2"), ("/o/c", "audit.unicode.not_nfc", "normalization=nfc")]
    forms = texts(spark, "plain", "é", "e\u0301", "ﬁ")
    assert [r[0] for r in forms.orderBy("doc_id").select(scrub.normal_form(F.col("text"))).collect()] == ["nfc", "nfc", "nfd", "nfc"]


def test_sinks_and_observed_counts(spark):
    import pytest

    from textloom.sources import store

    path = store.new_path(spark, "clean")
    store.write_clean(texts(spark, "a  \n\n\n\nb", None), path, ("file:///in/x",))
    assert {r.doc_id: r.text for r in spark.read.parquet(path).collect()}[0] == "a\n\nb\n"
    with pytest.raises(ValueError):
        store.write_clean(texts(spark, "a"), "/in/x", ("file:///in/x/",))
    with pytest.raises(Exception, match="(?i)exists"):
        store.write_clean(texts(spark, "a"), path)
    runs = store.new_path(spark, "runs")
    store.write_run(texts(spark, "a"), runs, "r1")
    assert store.read_run(spark, runs, "r1").count() == 1
    with pytest.raises(ValueError):
        store.read_run(spark, runs, "r2")
    with store.scratch(spark):
        held = store.written(texts(spark, "a"), "gone")
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(held)


def test_numbers_with_one_digit_and_long_texts(spark):
    from textloom.functions import text as T

    values = [0.0, 0.15, 0.95, 0.35, 0.05, 0.25, 0.75, 2.35, 12.25, 12.35, 5.85, 9.96, 3.0, 100.05]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "k int, v double").orderBy("k").select(T.tenths(F.col("v"))).collect()]
    assert got == [f"{v:.1f}" for v in values]
    t = "\n".join(f"line {k}" for k in range(3000))
    rows = evidence.line_nodes(texts(spark, t)).collect()
    assert len(rows) == 3000 and all(t[r.start : r.end] == r.text for r in rows)
    xs = ["b", "a", "b", "c", "a", "b"]
    assert [tuple(x) for x in one(spark.createDataFrame([(xs,)], "x array<string>").select(T.runs(F.col("x")).alias("r"))).r] == [("a", 2, 1), ("b", 3, 0), ("c", 1, 3)]


def test_files_and_markup(spark):
    rows = [("/a/x.MD", bytearray(b"# t")), ("/a/x.pdf", bytearray(b"plain")), ("/a/b.txt", bytearray(b"\xff\xfea\x00")), ("/a/e.txt", bytearray(b"")), ("/a/i.txt", bytearray(b"\xc3\x28"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in files.identity(df).collect()}
    assert got["/a/x.MD"].route == "markdown" and not got["/a/x.MD"].mismatch and got["/a/x.pdf"].mismatch and got["/a/i.txt"].magic == "unknown"
    assert [r.status for r in files.decoded(df).collect()] == ["ok", "ok", "unsupported_encoding", "empty", "invalid_utf8"]
    page = "<html><head><title>t</title><style>x</style></head><body><h1>Hi <b>you</b></h1><p>one<p>two<script>bad()</script><ul><li>a<li>b</ul>loose</body>"
    assert [(r.node_type, r.text) for r in markup.html_nodes(texts(spark, page)).orderBy("node_no").collect()] == [("heading", "Hi you"), ("paragraph", "one"), ("paragraph", "two"), ("list", ""), ("list_item", "a"), ("list_item", "b"), ("paragraph", "loose")]
    md = "---\na: 1\n---\n# Head\ntext\nmore\n\n- item\n> quote\n| a | b |\n|---|---|\n```\ncode\n```\nTitle\n====="
    assert [r.node_type for r in markup.markdown_nodes(texts(spark, md)).orderBy("node_no").collect()] == ["front_matter", "heading", "paragraph", "list_item", "quotation", "table_row", "table_cell", "table_cell", "code_block", "heading"]


def test_entry_module_stands_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['textloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
