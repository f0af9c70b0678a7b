"""Spelling variants: words one edit apart, found by walking a trie that is kept as tables.

The trie has a node where words part and an edge, with its letters, to where they part again or a word ends. It is kept
twice, over words and over reversed words: an edit in a word's second half leaves its first half as it is, and an edit
in its first half leaves its second half, so walks start deep in one of the two, where few words share a node. States
(word, position, node, edits) are joined with the edge table level by level; those with one edit that reach the end of
word and trie together are neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, least_length: int = 5, least_n: int = 3, every: int = 97) -> DataFrame:
    """word, n: words of at least least_length code points that occur at least least_n times.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where `every` divides the crc32 of
    "<doc_id>:<word>" = h, the code point h % length (from 0) is left out. A null doc_id counts as an empty one; null and empty
    texts have no words.
    """
    text = F.col("text").cast("string")
    # lower() is fast and changes A-Z alone where there is nothing else that has a small form or is one of another letter
    low = F.when(text.rlike(r"[\x{80}-\x{DE}\x{100}-\x{10FFFF}]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _directed(words: DataFrame) -> DataFrame:
    """Both readings of every word: word, n, r (the word as read), back, len, from (where the part that may be edited starts)."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    readings = F.array(
        F.struct(F.col("word").alias("r"), F.lit(False).alias("back"), half.alias("from")),
        F.struct(F.reverse("word").alias("r"), F.lit(True).alias("back"), (size - half).alias("from")),
    )
    return words.select("word", "n", size.alias("len"), F.inline(readings))


def _node(r: Column, p: Column, back: Column) -> Column:
    """A node's name: a hash of what is read up to it. Should two share one, the walks find too much, which is dropped at the end."""
    return F.xxhash64(back, F.substring(r, F.lit(1), p))


def _paths(words: DataFrame) -> DataFrame:
    """Per word and reading: ps, the positions of the nodes on its path where words part (or one ends), ascending.

    Positions before the half are left out, but one: of words up to one letter longer or shorter, no walk comes there.
    """
    read = _directed(words)
    places = F.sequence(F.col("from") - 1, F.col("len"))
    # the texts stay with the words: rows of nodes carry names only
    steps = read.select("word", "back", F.explode(F.transform(places, lambda p: F.struct(p.alias("p"), _node(F.col("r"), p, F.col("back")).alias("node"), F.substring(F.col("r"), p + 1, F.lit(1)).alias("next")))).alias("x"))
    steps = steps.select("word", "back", "x.*")
    parting = steps.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b")).where("a <> b").select("node")
    held = steps.select("word", "back", "p", "node").join(parting, "node", "left_semi")
    ps = held.groupBy("word", "back").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return read.join(ps, ["word", "back"])


def _edges(paths: DataFrame) -> DataFrame:
    """node, label, child, word, n, lo, hi: an edge from a node to the next where words part, or to a word's end.

    child is null at an end, word and n are null elsewhere; lo and hi are the lengths of the words beyond.
    """
    r, ps = F.col("r"), F.col("ps")

    def edge(p: Column, i: Column) -> Column:
        to = F.get(ps, i + 1)
        last = to.isNull()
        return F.struct(
            _node(r, p, F.col("back")).alias("node"), F.substring(r, p + 1, F.coalesce(to, F.col("len")) - p).alias("label"),
            F.when(~last, _node(r, to, F.col("back"))).alias("child"), F.when(last, F.col("word")).alias("target"), F.when(last, F.col("n")).alias("target_n"),
        )

    rows = paths.select("len", F.inline(F.transform(ps, edge)))
    return rows.groupBy("node", "label", "child", "target", "target_n").agg(F.min("len").alias("lo"), F.max("len").alias("hi"))


def _read(back: Column, word: Column) -> Column:
    return F.when(back, F.reverse(word)).otherwise(word)


def _first_edits(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """States with one edit, of which the edge after it is walked: word, n, back, p, size (of the word that is sought), child, target, target_n.

    A letter is replaced where the trie has another one, and left out, of equal ones in a row the last, where the trie
    goes on with the next. A letter that is put in is one left out of the other word.
    """
    starts = paths.select("word", "n", "back", "r", "len", F.explode(F.filter("ps", lambda p: p >= F.col("from"))).alias("p"))
    starts = starts.withColumn("node", _node(F.col("r"), F.col("p"), F.col("back")))
    r, p, label, m, end = F.col("r"), F.col("p"), F.col("label"), F.length("label"), F.col("target").isNotNull()
    here, after = F.substring(r, p + 1, F.lit(1)), F.substring(r, p + 2, F.lit(1))
    within = lambda size: (F.col("lo") <= size) & (size <= F.col("hi"))
    replaced = (p < F.col("len")) & (m > 0) & (F.substring(label, 1, 1) != here) & (F.substring(label, F.lit(2), m) == F.substring(r, p + 2, m - 1)) & (~end | (m == F.col("len") - p)) & within(F.col("len"))
    left_out = (p < F.col("len")) & (here != after) & (label == F.substring(r, p + 2, m)) & (~end | (m == F.col("len") - p - 1)) & within(F.col("len") - 1) & ((m > 0) | end)
    met = starts.alias("s").join(edges.alias("e"), (F.col("s.node") == F.col("e.node")) & (replaced | left_out))
    ways = F.filter(F.array(
        F.struct(replaced.alias("ok"), (p + m).alias("to"), F.col("len").alias("size")), F.struct(left_out.alias("ok"), (p + 1 + m).alias("to"), (F.col("len") - 1).alias("size")),
    ), lambda x: x["ok"])
    return met.select("word", "n", "back", F.explode(ways).alias("x"), "child", "target", "target_n").select("word", "n", "back", F.col("x.to").alias("p"), F.col("x.size").alias("size"), "child", "target", "target_n")


def _walked(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one edge further: with their edit made, only the edge that the word itself names is left."""
    r, p, m = F.col("r"), F.col("p"), F.length("label")
    rows = states.select("word", "n", "back", "p", "size", F.col("child").alias("node"), _read(F.col("back"), F.col("word")).alias("r"))
    fits = (F.col("label") == F.substring(r, p + 1, m)) & (F.col("target").isNull() | (m == F.length(r) - p)) & F.col("size").between(F.col("lo"), F.col("hi"))
    met = rows.alias("s").join(edges.alias("e"), (F.col("s.node") == F.col("e.node")) & fits)
    return met.select("word", "n", "back", (p + m).alias("p"), "size", "child", "target", "target_n")


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n of all ordered pairs of words (word, n) that are one inserted, deleted or replaced code point apart.

    Words are distinct. Each level is a table in the shared folder; there are as many as nodes follow each other on
    a path after an edit. An empty table gives no rows.
    """
    paths = materialize(_paths(words), "paths")
    edges = materialize(_edges(paths), "edges")
    states, found = materialize(_first_edits(paths, edges), "states"), []
    while True:
        found.append(states.where("target IS NOT NULL"))
        ahead = states.where("target IS NULL")
        if ahead.isEmpty():
            break
        states = materialize(_walked(ahead, edges), "states")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.where(F.levenshtein("word", "target") == 1)  # what shared a node's name only
    both = F.array(F.struct("word", F.col("target").alias("near"), F.col("target_n").alias("near_n")), F.struct(F.col("target").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words (word, form): the end of the chain of forms, whose length halves each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, ratio: int = 2, every: int = 97) -> DataFrame:
    """Per word of word_counts(): word, form, root, n, n_near, form_n.

    n_near: how many words are one edit apart. form: the most frequent of them, of ties the first in code-point order,
    if it has at least `ratio` times the word's n, else null, as form_n, its n, then is. root: where the chain of forms ends,
    the word itself without one; ratio must be over 1, so that chains end. Repeated rows count as often as they
    occur. Other columns are ignored; an empty table gives no rows. Builds and leaves tables in the shared folder.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = materialize(word_counts(docs, least_length, least_n, every), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("b"))
    rows = words.join(best, "word", "left")
    taken = -F.col("b.o") >= ratio * F.col("n")
    rows = materialize(rows.select("word", F.when(taken, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("b.o")).alias("form_n")), "variants")
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
