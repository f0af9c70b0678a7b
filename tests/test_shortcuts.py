"""Shortcuts give what the long ways give, and don't do their work."""

from pyspark.sql import functions as F

from textloom.operators import evidence as E
from textloom.operators import lexical as X
from textloom.operators import metrics as M
from textloom.operators import profiles as P
from textloom.sources import store

RULE = "rule_id string, source string, target string, sense string, confidence double, precedence string"
TEXTS = ["We (utilize) it;\tUTILIZE!\n utilizing  it.", "\xa0utilize İstanbul utilize", "", None, "no rule", "a utilize b commence c", "--utilize--", "utilize"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_proposals_within_the_row_are_those_of_the_join(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    spans = spark.createDataFrame([(5, 1, 0, 4)], "doc_id long, span_no int, start int, end int")
    seen = []
    monkeypatch.setattr(X, "materialize", lambda df, name: seen.append(plan(df)) or store.materialize(df, name))
    few = rows(X.propose(docs, X.rules(spark), spans))
    assert "Window" not in seen[0]
    monkeypatch.setattr(X, "FEW_FORMS", 0)
    assert few == rows(X.propose(docs, X.rules(spark), spans))
    assert [r[:4] for r in few] == [(0, 17, 7, "UTILIZE"), (0, 27, 9, "utilizing"), (0, 4, 7, "utilize"), (1, 18, 7, "utilize"), (5, 12, 8, "commence"), (5, 2, 7, "utilize"), (6, 2, 7, "utilize"), (7, 0, 7, "utilize")]
    # windows and places are those of all tokens
    tokens = {(r.doc_id, r.offset): (r.token, r.left_window, r.right_window) for r in X.contexts(docs).collect()}
    forms = X._forms(X.rules(spark))
    at = X.contexts_at(X._with_places(docs, forms, [r.form for r in forms.collect()])).collect()
    assert len(at) == 8 and all(tokens[r.doc_id, r.offset] == (r.token, r.left_window, r.right_window) for r in at)


def test_equal_texts_are_not_revalidated(spark, monkeypatch):
    before = spark.createDataFrame([(k, f"Paid {k} [1].") for k in range(6)] + [(6, None), (7, "gone 5 kg")], "doc_id long, text string")
    after = spark.createDataFrame([(k, f"Paid {k + (k == 3)} [1].") for k in range(6)] + [(6, None)], "doc_id long, text string")
    sizes = []

    def counted(df, name):
        out = store.materialize(df, name)
        sizes.append((name, out.select("doc_id").distinct().count()))
        return out

    monkeypatch.setattr(E, "materialize", counted)
    assert {r.doc_id for r in E.revalidated(before, after).where("NOT ok").collect()} == {3, 7}
    assert ("anchors", 2) in sizes and max(n for k, n in sizes if k == "anchors") == 2


def test_compared_conventions_are_those_of_the_profiles(spark):
    voice = ["I don't — we “do”.", "You 'll see - it", "", None, "He said \"so\" – 'x' our don't", "plain words"]
    docs = spark.createDataFrame([(k, "abc"[k % 3], t) for k, t in enumerate(voice)], "doc_id long, source string, text string")
    light, full = P.compared_conventions(docs), P.profiles(docs)
    assert rows(light) == rows(full.select("source", *P.COMPARED)) and "Generate" not in plan(light)
    texts = docs.withColumn("source", docs.source)
    assert rows(P.violating(texts, light)) == rows(P.compare(texts, full).where("violations <> ''").select("doc_id"))


def test_common_phrases_are_counted_outside_of_sorted_arrays(spark):
    texts = ["a b. A b c, a b", None, "", "one", "x y x y x", "d'é don't x", "c d a b c d a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = M.common_phrases(docs, 3)
    assert "ArrowEvalPython" in plan(got) and "Exchange" not in plan(got)
    assert rows(got) == sorted([
        (0, 1, "a b", 3), (0, 2, "b a", 1), (0, 3, "b c", 1), (4, 1, "x y", 2), (4, 2, "y x", 2), (4, 3, "x y x", 2), (5, 1, "d don't", 1), (5, 2, "don't x", 1), (5, 3, "d don't x", 1),
        (6, 1, "c d", 2), (6, 2, "d a", 2), (6, 3, "a b", 2),
    ], key=repr)
    assert rows(M.terminology(docs)) == [(0, "a b|b a|b c", "3,1,1"), (4, "x y|y x", "2,2"), (5, "d don't|don't x", "1,1"), (6, "c d|d a|a b", "2,2,2")]


def test_drift_is_counted_without_places(spark):
    before = ['Paid 5, 5 and $1,000 on 2024-01-02 "as it were" [1].', None, "", "Anna Miller 7%", "same 3 (Smith, 2020)", 'gone "abc" 9']
    after = ['Paid 5 and $1,000 on 2024-01-03 "As It Were" [1] [2].', "new 4", "5", None, "same 3 (Smith, 2020)", ""]
    docs = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    low = lambda df: df.withColumn("text", F.lower("text"))
    bare = [low(E.anchor_texts(docs(x))) for x in (before, after)]
    full = [low(E.anchors(docs(x))) for x in (before, after)]
    assert [rows(x) for x in bare] == [rows(x.select("doc_id", "category", "text")) for x in full]
    state = E.exact_diff(*full, ["doc_id", "category", "text"]).groupBy("doc_id").agg(*[F.count_if(F.col("state") == k).alias(k) for k in ("preserved", "omitted", "added")])
    got = E.exact_drift(*bare)
    assert rows(got) == rows(state) and "Window" not in plan(got)


def test_a_bundle_cuts_a_text_into_words_once(spark):
    texts = ["It's “so” 'fine'. I ABC Abc 4X don't — however, we were asked!", None, "", "ʼquoted' a-b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = M.bundle(docs)
    assert plan(own).count("regexp_extract_all(lower(text") == 1
    parts = M.conventions(docs).join(M.capitalization(docs), "doc_id").join(M.register(docs).select("doc_id", "formality", "hedges", "boosters"), "doc_id").join(M.pronouns(docs), "doc_id")
    assert rows(own.select(*parts.columns)) == rows(parts)
