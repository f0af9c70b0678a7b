"""Style metrics per document. Inputs are (doc_id, text, ...); what needs no regrouping stays in the row."""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T

MATTR_WINDOW = 100
#: Alternation takes the first phrase in the list; no letter or digit may follow.
TRANSITION = r"(?U)^(" + "|".join(L.TRANSITIONS) + r")(?![\p{L}\p{N}])"
INITIAL, ALL_CAPS, TITLE_CASE = "^[^a-zA-Z]*[A-Z]", "^[A-Z0-9'][A-Z0-9']+$", "^[A-Z](?=[^A-Z]*[a-z])[^A-Z]+$"


def tokens(docs: DataFrame) -> DataFrame:
    """One row per word: doc_id, pos, word."""
    return docs.select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    """One row per sentence: doc_id, sent_no, sentence, n_words, n_clauses."""
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))
    s = F.col("sentence")
    return rows.withColumns({"n_words": F.size(T.words(s)).cast("long"), "n_clauses": F.size(T.clauses(s)).cast("long")})


def lexical(docs: DataFrame) -> DataFrame:
    """Word count, mean length, distinct words, type-token ratio, function words and contractions, all in the row."""
    w = F.col("w")
    n = F.size(w)
    rows = docs.select("doc_id", T.words(F.col("text")).alias("w"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("word_count"),
        T.ratio(F.length(F.array_join(w, "")), n).alias("avg_word_length"),
        F.size(F.array_distinct(w)).cast("long").alias("unique_words"),
        T.ratio(F.size(F.array_distinct(w)), n).alias("type_token_ratio"),
        T.ratio(T.counted(w, L.FUNCTION_WORDS), n).alias("function_word_ratio"),
        T.ratio(F.size(F.filter(w, lambda x: x.contains("'"))), n).alias("contraction_frequency"),
    )


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.inline(T.runs(T.words(F.col("text"))))).select("doc_id", F.col("value").alias("word"), F.col("n").cast("long").alias("n"))


def function_words(docs: DataFrame) -> DataFrame:
    """Counts of the function words that occur."""
    return word_counts(docs).where(F.col("word").isin(*L.FUNCTION_WORDS))


def contractions(docs: DataFrame) -> DataFrame:
    """Counts of the words with an apostrophe."""
    return word_counts(docs).where(F.col("word").contains("'"))


def once(w: Column) -> Column:
    """How many values of an array of strings occur once: sorted, they differ from both neighbours."""
    return T.bound(F.sort_array(w), lambda s: F.size(F.filter(F.transform(s, lambda x, i: ~x.eqNullSafe(F.get(s, i - 1)) & ~x.eqNullSafe(F.get(s, i + 1))), lambda x: x)))


def hapax(docs: DataFrame) -> DataFrame:
    """Share of words that occur once in their document."""
    rows = docs.select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", (once(F.col("w")) / F.size("w")).alias("hapax_ratio"))


def moving_types(w: Column, window: int = MATTR_WINDOW) -> Column:
    """Moving-average type-token ratio of an array of words; null without words.

    Each word counts in the windows where it is its type's first. Sorted by word and place, the one before in the array
    is the type's one before in the text, so one sort and one pass do.
    """

    def windows(p: Column) -> Column:
        last = F.size(p) - window  # where the last window starts

        def starts(x: Column, i: Column) -> Column:
            before = F.get(p, i - 1)
            after = F.when(before["value"] == x["value"], before["at"] + 1).otherwise(0)  # earlier windows hold the type already
            alone = F.when(after == 0, 1).otherwise(0)
            held = F.least(x["at"], last) - F.greatest(x["at"] - (window - 1), after) + 1
            return F.when(last <= 0, alone).otherwise(F.greatest(held, F.lit(0)))

        total = F.aggregate(F.transform(p, starts), F.lit(0).cast("long"), lambda a, x: a + x)
        return total / F.when(last <= 0, F.size(p)).otherwise(F.lit(window).cast("long") * (last + 1))

    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("value"), i.alias("at"))))
    return F.when(F.size(w) > 0, T.bound(placed, windows))


def mattr(docs: DataFrame, window: int = MATTR_WINDOW) -> DataFrame:
    """Moving-average type-token ratio of the documents with words, in the row."""
    rows = docs.select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", moving_types(F.col("w"), window).alias("mattr"))


def pronouns(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", T.words(F.col("text")).alias("w"))
    return rows.select("doc_id", *[T.counted(F.col("w"), v).alias(k) for k, v in L.PRONOUNS.items()])


def syntax(docs: DataFrame) -> DataFrame:
    """Sentence-length figures, fragments (two words at most) and run-ons (five clauses and 45 words at least)."""
    rows = docs.select("doc_id", T.sentences(F.col("text")).alias("s"))
    rows = rows.select("doc_id", F.transform("s", lambda s: F.struct(F.size(T.words(s)).alias("n"), F.size(T.clauses(s)).alias("k"))).alias("x"))
    some = lambda f: F.size(F.filter("x", f)).cast("long")
    rows = rows.withColumns({"fragments": some(lambda x: x["n"] <= 2), "run_ons": some(lambda x: (x["k"] >= 5) & (x["n"] >= 45))})
    return T.with_distribution(rows, F.col("x.n")).drop("x")


def clause_lengths(docs: DataFrame) -> DataFrame:
    parts = F.flatten(F.transform(T.sentences(F.col("text")), lambda s: F.transform(T.clauses(s), lambda c: F.size(T.words(c)))))
    return T.with_distribution(docs.select("doc_id", parts.alias("x")), F.col("x")).drop("x")


def sentence_openings(docs: DataFrame) -> DataFrame:
    """Counts of the first word and the first two words of sentences."""
    w = T.words(F.col("sentence"))
    rows = sentence_rows(docs).select("doc_id", w.alias("w")).where(F.size("w") > 0)
    grams = F.when(F.size("w") > 1, F.array(F.get("w", F.lit(0)), F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))))).otherwise(F.slice("w", 1, 1))
    return rows.select("doc_id", F.explode(grams).alias("opening")).groupBy("doc_id", "opening").agg(F.count("*").alias("n"))


def passive_pairs(w: Column) -> Column:
    """How many be-forms of an array of words are followed by a word that ends in -ed or -en."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: a.isin(*L.BE_FORMS) & b.rlike("(?:ed|en)$"))
    return F.size(F.filter(pairs, lambda x: x))


def passives(docs: DataFrame) -> DataFrame:
    """Be-forms followed, in their sentence, by a word that ends in -ed or -en."""
    hits = F.transform(T.sentences(F.col("text")), lambda s: passive_pairs(T.words(s)))
    return docs.select("doc_id", F.aggregate(hits, F.lit(0), lambda a, x: a + x).cast("long").alias("passive_markers"))


def rhythm(docs: DataFrame) -> DataFrame:
    """Sentences per paragraph."""
    lengths = F.transform(T.paragraphs(F.col("text")), lambda p: F.size(T.sentences(p)))
    return T.with_distribution(docs.select("doc_id", lengths.alias("x")), F.col("x")).drop("x")


def paragraph_edges(docs: DataFrame) -> DataFrame:
    """Counts of the words that open and close paragraphs (one and two words): doc_id, edge, gram, n."""
    rows = docs.select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p")).select("doc_id", T.words(F.col("p")).alias("w")).where(F.size("w") > 0)
    at = lambda i: F.element_at("w", i)
    one = F.array(F.struct(F.lit("opening").alias("edge"), at(1).alias("gram")), F.struct(F.lit("closing").alias("edge"), at(-1).alias("gram")))
    two = F.array(F.struct(F.lit("opening").alias("edge"), F.concat_ws(" ", at(1), at(2)).alias("gram")), F.struct(F.lit("closing").alias("edge"), F.concat_ws(" ", at(-2), at(-1)).alias("gram")))
    grams = F.when(F.size("w") > 1, F.concat(one, two)).otherwise(one)
    return rows.select("doc_id", F.explode(grams).alias("x")).groupBy("doc_id", "x.edge", "x.gram").agg(F.count("*").alias("n"))


def transitions(docs: DataFrame) -> DataFrame:
    """Sentences by the transition phrase they begin with: doc_id, phrase, n."""
    start = F.regexp_replace(F.lower("sentence"), "^[^a-zA-Z0-9]+", "")
    phrase = F.regexp_extract(start, TRANSITION, 1)
    rows = sentence_rows(docs).select("doc_id", phrase.alias("phrase")).where("phrase <> ''")
    return rows.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def punctuation(docs: DataFrame) -> DataFrame:
    """Counts per mark: doc_id, mark, n, for marks that occur."""
    t = F.col("text")
    each = F.array(*[F.struct(F.lit(c).alias("mark"), T.occurrences(t, c).alias("n")) for c in L.PUNCTUATION])
    return docs.select("doc_id", F.inline(F.filter(each, lambda x: x["n"] > 0)))


def punctuation_pairs(docs: DataFrame) -> DataFrame:
    """Neighbouring marks inside runs of marks, overlapping: doc_id, pair, n."""
    runs = F.regexp_extract_all("text", F.lit(r"""[.,;:!?"'()—–/-]{2,}"""), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return docs.select("doc_id", F.explode(pairs).alias("pair")).groupBy("doc_id", "pair").agg(F.count("*").alias("n"))


def dash_convention(t: Column) -> Column:
    kinds = F.concat_ws("", *[F.when(t.contains(c), n) for c, n in (("—", "em "), ("–", "en "), ("-", "hyphen "))])
    return F.when(kinds == "", "none").when(F.trim(kinds).contains(" "), "mixed").otherwise(F.trim(kinds))


def quote_convention(t: Column, w: Column) -> Column:
    """The quotes of a text, w being its words."""
    held = F.size(F.filter(w, lambda x: x.contains("'")))
    ds, dc = t.contains('"'), t.contains("“") | t.contains("”")
    ss, sc = T.occurrences(t, "'") > held, t.contains("‘") | t.contains("’")
    return (
        F.when((ds | dc) & (ss | sc), "mixed").when(ds & dc, "mixed").when(ds, "double_straight").when(dc, "double_curly")
        .when(ss & sc, "mixed").when(ss, "single_straight").when(sc, "single_curly").otherwise("none")
    )


def apostrophe_convention(t: Column, w: Column) -> Column:
    """The apostrophes of a text, w being its words."""
    straight, curly = F.exists(w, lambda x: x.contains("'")), t.contains("’")
    return F.when(straight & curly, "mixed").when(straight, "straight").when(curly, "curly").otherwise("none")


def conventions(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    w = T.words(t)
    return docs.select("doc_id", dash_convention(t).alias("dash"), quote_convention(t, w).alias("quote"), apostrophe_convention(t, w).alias("apostrophe"))


def capitalization(docs: DataFrame) -> DataFrame:
    """Shares of capitalised sentences, of all-caps words (digits count as such) and of title-case words."""
    rows = docs.select("doc_id", T.sentences(F.col("text")).alias("s"), T.cased_words(F.col("text")).alias("w"))
    some = lambda c, p: T.ratio(F.size(F.filter(c, lambda x: x.rlike(p))), F.size(c))
    return rows.select("doc_id", some("s", INITIAL).alias("initial_ratio"), some("w", ALL_CAPS).alias("all_caps_ratio"), some("w", TITLE_CASE).alias("title_case_ratio"))


def questions(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", T.sentences(F.col("text")).alias("s"))
    held = lambda c: F.size(F.filter("s", lambda x: x.contains(c)))
    n = F.size("s")
    return rows.select("doc_id", held("?").cast("long").alias("question_count"), held("!").cast("long").alias("exclamation_count"), T.ratio(held("?"), n).alias("question_frequency"), T.ratio(held("!"), n).alias("exclamation_frequency"))


def formality(w: Column, n: Column | None = None) -> Column:
    """Of an array of words; or of those of a text's n words that the lists hold."""
    raw = (T.counted(w, L.FORMAL) - T.counted(w, L.CASUAL)) / F.greatest(F.size(w) if n is None else n, F.lit(1))
    return 1 / (1 + F.exp(-5 * raw))


def register(docs: DataFrame) -> DataFrame:
    w = F.col("w")
    rows = docs.select("doc_id", T.words(F.col("text")).alias("w"))
    return rows.select(
        "doc_id", F.when(F.size(w) > 0, formality(w)).otherwise(0.0).alias("formality"), T.counted(w, L.HEDGES).alias("hedges"), T.counted(w, L.BOOSTERS).alias("boosters"),
        T.ratio(F.size(F.filter(w, lambda x: F.length(x) >= 12)), F.size(w)).alias("technical_ratio"),
    )


def bundle(docs: DataFrame) -> DataFrame:
    """All families side by side, one row per document.

    One scan works everything out in the row. Counts per phrase, mark or opening are tables of their own
    (sentence_openings, paragraph_edges, transitions, punctuation ...).
    """
    t, w, s = F.col("text"), F.col("w"), F.col("s")
    rows = docs.select("doc_id", "text", T.words(t).alias("w"), T.cased_words(t).alias("cw"), T.sentences(t).alias("s"), T.paragraphs(t).alias("p"))
    rows = rows.withColumns({"sw": F.transform(s, T.words), "sc": F.transform(s, lambda x: F.transform(T.clauses(x), lambda c: F.size(T.words(c)))), "lp": F.transform("p", lambda x: F.size(T.sentences(x)))})
    # words that some list holds are sifted once, words with a capital or a figure in front by one look each
    listed = sorted({x for v in (L.FUNCTION_WORDS, L.FORMAL, L.CASUAL, L.HEDGES, L.BOOSTERS, *L.PRONOUNS.values()) for x in v})
    rows = rows.withColumns({"listed": F.filter(w, lambda x: x.isin(*listed)), "capital": F.filter("cw", lambda x: x < "a")})
    n, l = F.size(w), F.col("listed")  # noqa: E741
    marks = sum((T.occurrences(t, c) for c in L.PUNCTUATION), F.lit(0))
    some = lambda c, f: F.size(F.filter(c, f)).cast("long")
    share = lambda c, p: T.ratio(F.size(F.filter(c, lambda x: x.rlike(p))), F.size(c))
    capital = lambda p: T.ratio(F.size(F.filter("capital", lambda x: x.rlike(p))), F.size("cw"))
    own = rows.select(
        "doc_id", n.cast("long").alias("word_count"), T.ratio(F.length(F.array_join(w, "")), n).alias("avg_word_length"), F.size(F.array_distinct(w)).cast("long").alias("unique_words"),
        T.ratio(F.size(F.array_distinct(w)), n).alias("type_token_ratio"), T.ratio(once(w), n).alias("hapax_ratio"), F.coalesce(moving_types(w), F.lit(0.0)).alias("mattr"), T.ratio(T.counted(l, L.FUNCTION_WORDS), n).alias("function_word_ratio"),
        T.ratio(F.size(F.filter(w, lambda x: x.contains("'"))), n).alias("contraction_frequency"), *[T.counted(l, v).alias(k) for k, v in L.PRONOUNS.items()],
        F.transform("sw", F.size).alias("ls"), F.flatten("sc").alias("lc"), "lp", some("sw", lambda x: F.size(x) <= 2).alias("fragments"),
        some(F.arrays_zip("sw", "sc"), lambda x: (F.size(x["sc"]) >= 5) & (F.size(x["sw"]) >= 45)).alias("run_ons"),
        F.aggregate(F.transform("sw", passive_pairs), F.lit(0), lambda a, x: a + x).cast("long").alias("passive_markers"),
        (marks / F.greatest(F.length(t), F.lit(1)) * 100.0).alias("punctuation_per_100_chars"), dash_convention(t).alias("dash"), quote_convention(t, w).alias("quote"), apostrophe_convention(t, w).alias("apostrophe"),
        share("s", INITIAL).alias("initial_ratio"), capital(ALL_CAPS).alias("all_caps_ratio"), capital(TITLE_CASE).alias("title_case_ratio"),
        some(s, lambda x: x.contains("?")).alias("question_count"), some(s, lambda x: x.contains("!")).alias("exclamation_count"),
        T.ratio(F.size(F.filter(s, lambda x: x.contains("?"))), F.size(s)).alias("question_frequency"), T.ratio(F.size(F.filter(s, lambda x: x.contains("!"))), F.size(s)).alias("exclamation_frequency"),
        F.when(n > 0, formality(l, n)).otherwise(0.0).alias("formality"), T.counted(l, L.HEDGES).alias("hedges"), T.counted(l, L.BOOSTERS).alias("boosters"), T.ratio(F.size(F.filter(w, lambda x: F.length(x) >= 12)), n).alias("technical_ratio"),
    )
    for name, of in (("sentence", "ls"), ("clause", "lc"), ("paragraph", "lp")):
        figures = ("n", "minimum", "p10", "p25", "median", "p75", "p90", "maximum", "mean", "stdev")
        own = T.with_distribution(own, F.col(of), {f: f"{name}_{f}" for f in figures}).drop(of)
    return own


def fingerprint(docs: DataFrame) -> DataFrame:
    """The flat fingerprint: rounded means and variance, punctuation per character, richness, formality."""
    t = F.col("text")
    rows = docs.select("doc_id", "text", T.words(t).alias("w"), F.transform(T.sentences(t), lambda x: F.size(T.words(x))).alias("ls"), F.transform(T.paragraphs(t), lambda p: F.size(T.sentences(p))).alias("lp"))
    rows = T.with_distribution(rows, F.col("ls"), {"mean": "avg_sentence_length", "stdev": "sd", "n": "total_sentences"})
    rows = T.with_distribution(rows, F.col("lp"), {"mean": "avg_paragraph_length", "n": "total_paragraphs"})
    targets = {"comma": ",", "period": ".", "question": "?", "exclamation": "!", "semicolon": ";", "colon": ":", "dash": "—", "quote": '"', "apostrophe": "'", "parenthesis": "()"}
    chars = F.greatest(F.length(t), F.lit(1))
    return rows.select(
        "doc_id", "avg_sentence_length", (F.col("sd") * F.col("sd")).alias("sentence_length_variance"), "avg_paragraph_length", "total_sentences", "total_paragraphs",
        F.size("w").cast("long").alias("total_words"), T.ratio(F.size(F.array_distinct("w")), F.size("w")).alias("vocabulary_richness"), T.ratio(F.length(F.array_join("w", "")), F.size("w")).alias("avg_word_length"), formality(F.col("w")).alias("formality"),
        *[(T.occurrences(t, c) / chars).alias(f"r_{k}") for k, c in targets.items()],
    )


def grams(w: Column, k: int) -> Column:
    """The k-word phrases of an array of words, in order."""
    places = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat_ws(" ", *[F.get(w, i + (j - 1)) for j in range(k)]))


#: Bits of a place in an array of words: a number of 64 bits holds a hash and a place, or three numbers of this size.
_PLACE = 20


def with_top_pairs(df: DataFrame, words: str, name: str, most: int = 3) -> DataFrame:
    """df with the `most` most frequent pairs of neighbours in an array of words as structs (value, n); ties by first appearance.

    A pair is one number, its hash above and its place below; sorted, those of one hash are a run. Runs are numbers, too: the
    longest first, then by place. The pairs of the best runs are compared word by word. Where one of them holds two pairs of
    a common hash, or places don't fit, the pairs themselves are sorted: a run outside the best ones can't hold a better pair.
    """
    mask = (1 << _PLACE) - 1
    at = lambda x: x.bitwiseAND(F.lit(mask))
    whole = lambda x: F.coalesce(x, F.lit(0).cast("long"))  # noqa: E731 arrays without nulls are sorted as plain numbers
    w, fits = F.col(words), F.size(words) <= mask
    pair = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)).bitwiseAND(F.lit(-1 - mask)).bitwiseOR(i.cast("long"))
    df = df.withColumn("_pairs", F.sort_array(F.transform(T.places(F.when(fits, F.size(w) - 1)), lambda i: whole(pair(i)))))
    pairs = F.col("_pairs")
    new = lambda x, i: (i == 0) | (F.shiftright(x, _PLACE) != F.shiftright(F.get(pairs, i - 1), _PLACE))
    df = df.withColumn("_starts", F.filter(F.transform(pairs, lambda x, i: F.when(new(x, i), i).otherwise(-1)), lambda i: i >= 0))

    def run(start: Column, k: Column) -> Column:
        n = (F.coalesce(F.get("_starts", k + 1), F.size(pairs)) - start).cast("long")
        return F.shiftleft(F.lit(mask).cast("long") - n, 2 * _PLACE).bitwiseOR(F.shiftleft(at(F.get(pairs, start)), _PLACE)).bitwiseOR(start.cast("long"))

    df = df.withColumn("_runs", F.slice(F.sort_array(F.transform("_starts", lambda x, k: whole(run(x, k)))), 1, most))
    n, first, start = (lambda x: (mask - F.shiftright(x, 2 * _PLACE)).cast("int")), (lambda x: at(F.shiftright(x, _PLACE)).cast("int")), (lambda x: at(x).cast("int"))
    same = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1))
    pure = F.forall("_runs", lambda x: F.forall(F.slice(pairs, start(x) + 1, n(x)), lambda y: same(at(y).cast("int"), first(x))))
    found = F.transform("_runs", lambda x: F.struct(F.concat_ws(" ", F.get(w, first(x)), F.get(w, first(x) + 1)).alias("value"), n(x).alias("n")))
    sorted_ = F.slice(F.sort_array(F.transform(T.runs(grams(w, 2)), lambda x: F.struct((-x["n"]).alias("o"), x["first"].alias("first"), x["value"].alias("value")))), 1, most)
    exact = F.transform(sorted_, lambda x: F.struct(x["value"].alias("value"), (-x["o"]).alias("n")))
    return df.withColumn(name, F.when(fits & pure, found).otherwise(exact)).drop("_pairs", "_starts", "_runs")


def top_phrases(text: Column, top: int, sizes: tuple[int, ...]) -> Column:
    """Structs (phrase, n) of the `top` most frequent phrases of so many words; ties by size in their order, then by first appearance."""
    word = T.WORD

    def best(t: str) -> list[dict]:
        w, counts = re.findall(word, t), Counter()  # a counter keeps phrases in the order of their first places
        for k in sizes:
            counts.update(zip(*(w[j:] for j in range(k))))
        return [{"phrase": " ".join(g), "n": n} for g, n in heapq.nsmallest(top, counts.items(), key=lambda x: -x[1])]

    @F.arrow_udf("array<struct<phrase:string,n:bigint>>")
    def ranked(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("phrase", pa.string()), ("n", pa.int64())]))
        return pa.array((best(t.as_py()) if t.is_valid else None for t in texts), kind)

    return ranked(F.lower(text))


def common_phrases(docs: DataFrame, top: int = 10, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """The `top` most frequent phrases of two and three words, ties by first appearance: doc_id, rank, phrase, n."""
    # one document's phrases are ranked in its row, so nothing is shuffled
    rows = docs.select("doc_id", F.posexplode(top_phrases(F.col("text"), top, sizes)).alias("k", "x"))
    return rows.select("doc_id", (F.col("k") + 1).alias("rank"), "x.phrase", "x.n")


def terminology(docs: DataFrame) -> DataFrame:
    """The three most frequent bigrams joined by bars: doc_id, terms, counts."""
    rows = docs.select("doc_id", top_phrases(F.col("text"), 3, (2,)).alias("x")).where(F.size("x") > 0)
    return rows.select("doc_id", F.array_join("x.phrase", "|").alias("terms"), F.array_join(F.transform("x.n", lambda n: n.cast("string")), ",").alias("counts"))
