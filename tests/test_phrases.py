"""Phrases of any length against a search by regular expressions, gazetteer terms, and changes that don't fit."""

import hashlib
import random
import re
import time

from textloom.operators import lexical as X
from textloom.operators import review as R

RULE = "rule_id string, source string, target string, sense string, confidence double, precedence string"


def ruled(spark, sources):
    return spark.createDataFrame([(f"r{i}", s, "x", "general", 0.95, "user_preference") for i, s in enumerate(sources)], RULE)


def searched(text, sources):
    """(source, token, offset) by the rule's definition."""
    out, taken = [], []
    for source in sorted({s for s in sources if " " in s}, key=lambda s: (-len(s), s)):
        for m in re.finditer(rf"(?<!\w){re.escape(source)}(?!\w)", text, re.IGNORECASE):
            if not any(m.start() < e and s < m.end() for s, e in taken):
                taken.append(m.span())
                out.append((source, m.group(0), m.start(), text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 40]))
    return sorted(out)


def hits(spark, texts, sources):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [[] for _ in texts]
    for r in X.phrases(docs, ruled(spark, sources)).collect():
        out[r.doc_id].append((r.source, r.token, r.offset, r.left_window, r.right_window))
    return [sorted(x) for x in out]


SOURCES = ["at the end of the day", "in order to", "and so on.", "the end of the day after tomorrow or never", "a  b", "a a", "order to win", "(as it were)", "word", "c. d", "for all practical intents and purposes that one could think of here and now"]
TEXTS = [
    None, "", "At the end of the day, and SO on. And so on.x", "İİİ we go in order to win", "at the end of the day after tomorrow or never", "a a a a; a  b a b", "x(as it were) (as it were) (as it were)y",
    "for all practical intents and purposes that one could think of here and now.", "ıſ c. d C. D. in\norder to", "ßß İn order to ﬁ", "begin in order to", "in order to" * 3, "ın order to, Kin order to",
]


def test_phrases_by_hand(spark):
    got = hits(spark, TEXTS, SOURCES)
    assert got == [searched(t or "", SOURCES) for t in TEXTS]
    assert [(s, t, o) for s, t, o, *_ in got[3]] == [("order to win", "order to win", 13)] and [s for s, *_ in got[7]] == [SOURCES[-1]]
    assert [(s, t) for s, t, *_ in got[2]] == [("and so on.", "and SO on."), ("at the end of the day", "At the end of the day")]


def test_phrases_of_random_texts(spark):
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice(["a", "b", "A", " ", " ", ".", "-", "é"]) for _ in range(n))
    sources = sorted({piece(rng.randrange(2, 9)) for _ in range(60)})
    texts = [piece(rng.randrange(0, 120)) for _ in range(60)]
    assert hits(spark, texts, sources) == [searched(t, sources) for t in texts]


def test_rules_without_blanks_and_no_rules(spark):
    assert hits(spark, ["a b"], ["word"]) == [[]] and hits(spark, ["a b"], []) == [[]]


def test_a_row_of_many_hits_takes_seconds(spark):
    text = "we go in order to win; " * 12_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    X.phrases(docs.limit(0), ruled(spark, SOURCES)).count()
    began = time.perf_counter()
    assert X.phrases(docs, ruled(spark, SOURCES)).count() == 12_000
    assert time.perf_counter() - began < 20


def test_rules_of_many_words_make_proposals(spark):
    docs = spark.createDataFrame([(1, "Well, at the end of the day we utilize it and so on.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, start int, end int")
    got = {r.surface: r.status for r in X.propose(docs, ruled(spark, ["at the end of the day", "and so on.", "day"]), none).collect()}
    assert got == {"at the end of the day": "safe", "and so on.": "safe"}


def test_gazetteer_terms_of_many_words(spark):
    docs = spark.createDataFrame([(1, "An act of good-faith; an ACT of good faith, an act of good"), (2, None), (3, "faith")], "doc_id long, text string")
    terms = spark.createDataFrame([("a", "an act of good faith"), ("a", "act of good"), ("b", "faith"), ("b", "--"), ("c", "an act of good faith an act of good faith an act of good")], "domain string, term string")
    got = {(r.doc_id, r.domain, r.term): r.n for r in R.gazetteer_hits(docs, terms).collect()}
    assert got == {(1, "a", "an act of good faith"): 2, (1, "a", "act of good"): 3, (1, "b", "faith"): 2, (1, "c", "an act of good faith an act of good faith an act of good"): 1, (3, "b", "faith"): 1}


def test_changes_that_do_not_fit_leave_the_text_and_say_so(spark):
    docs = [(1, "one two three"), (2, "one two three"), (3, "one two"), (4, "one"), (5, "one two"), (6, None), (7, "one")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    changes = [
        (1, 0, 3, "one", "1", sha(docs[0][1])), (1, 8, 5, "three", "3", sha(docs[0][1])), (2, 0, 3, "one", "1", sha(docs[1][1])), (2, 4, 3, "TWO", "2", sha(docs[1][1])),
        (3, 0, 3, "one", "1", sha(docs[2][1])), (3, 2, 3, "e t", "x", sha(docs[2][1])), (4, 1, 9, "ne", "x", sha("one")), (5, 0, 3, "one", "1", sha("another text")),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    c = spark.createDataFrame(changes, "doc_id long, offset long, length long, surface string, target string, document_hash string")
    got = {r.doc_id: (r.text, r.problem) for r in X.apply_changes(d, c).collect()}
    assert got == {1: ("1 two 3", None), 2: (docs[1][1], "surface:4"), 3: ("one two", "overlap:2"), 4: ("one", "outside:1"), 5: ("one two", "document_hash"), 6: (None, None), 7: ("one", None)}
    assert X.apply_changes(d, c.drop("document_hash")).where("doc_id = 5").first().text == "1 two"


def test_lines_are_the_line_nodes_without_places(spark):
    from textloom.operators import evidence as E

    docs = spark.createDataFrame([(1, "a\n\n \t\x0b\f\r\n b \r\n \nc"), (2, ""), (3, None), (4, "\n"), (5, "x")], "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "node_no", "text").collect()))
    assert rows(E.lines(docs)) == rows(E.line_nodes(docs)) and len(rows(E.lines(docs))) == 5


def test_profile_items_are_added_up_by_hash_and_keep_first_places(spark):
    from textloom.operators import profiles as P

    docs = spark.createDataFrame([(5, "s", "c d. a b"), (-2, "s", "x y a b. C D! p q"), (None, "t", "m n"), (-9, "t", "k l")], "doc_id long, source string, text string")
    plan = P.profile_items(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    got = {r.source: r for r in P.profiles(docs).collect()}
    assert got["s"].terms == "a b|c d|x y" and got["t"].terms == "m n|k l"
    assert (got["s"].words, got["s"].letters, got["s"].sentences, got["s"].length, got["s"].squares) == (12, 12, 5, 12, 32)


def test_few_phrases_are_found_without_a_shuffle_as_by_the_join(spark, monkeypatch):
    from textloom.operators import lexical as X

    docs = spark.createDataFrame([(1, "Is it used? it used, is it used"), (2, "used it"), (3, None), (4, "")], "doc_id long, text string")
    rules = ruled(spark, ["is it used", "it used", "it  used"])
    found = X.phrases(docs, rules)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(X, "FEW_PHRASES", 0)
    assert rows == sorted(map(tuple, X.phrases(docs, rules).collect())) and len(rows) == 3
