"""Voice profiles per group of documents and comparison of documents with them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.operators.metrics import TRANSITION, grams, with_top_pairs
from textloom.sources.store import materialize

KEYS = ("sentence_mean", "sentence_stdev", "type_token_ratio", "function_word_ratio", "contraction_frequency", "punctuation_per_100_chars", "question_frequency")
#: Marks whose share of all characters a fingerprint shows, and marks that make up density.
RATIOS = {"comma": ",", "period": ".", "question": "?", "exclamation": "!", "semicolon": ";", "colon": ":", "dash": "—", "quote": '"', "apostrophe": "'", "parenthesis": "()"}
DENSITY = r"""[.,;:!?…—–\-()\[\]{}"'’‘“”«»]"""
COMPARED = ("dash_type", "contraction_policy", "person_policy", "quotation_convention")


def _read(docs: DataFrame, lengths: bool = True) -> DataFrame:
    """docs with the words, sentence and paragraph lengths, sentences and transitions that all figures come from.

    No word runs over white space, so words are cut once, sentence by sentence; for what looks at no lengths, from the text.
    """
    t = F.col("text")
    rows = docs.withColumns({"s": T.sentences(t), "lp": F.transform(T.paragraphs(t), T.sentence_count)})
    rows = rows.withColumn("ws", F.transform("s", T.words))
    rows = rows.withColumn("w", F.flatten("ws") if lengths else T.words(t))
    start = lambda x: F.regexp_extract(F.regexp_replace(F.lower(x), "^[^a-zA-Z0-9]+", ""), TRANSITION, 1)
    return rows.withColumns({"ls": F.transform("ws", F.size), "tr": F.filter(F.transform("s", start), lambda x: x != "")}).drop("ws")


#: Lists of words whose occurrences are counted, by name.
_LISTS = {"function_words": L.FUNCTION_WORDS, "formal": L.FORMAL, "casual": L.CASUAL, **L.PRONOUNS}


def _of_words() -> dict[str, Callable[[Column], Column]]:
    """Whole numbers that a word adds to its text's counts, by name."""
    one = lambda held: held.cast("long")
    return {"words": lambda x: F.lit(1).cast("long"), "letters": lambda x: F.length(x).cast("long"), "contractions": lambda x: one(x.contains("'")), **{k: lambda x, v=v: one(x.isin(*v)) for k, v in _LISTS.items()}}


def _of_text() -> dict[str, Column]:
    """Whole numbers of a text beside those of its words and of its lengths, by name."""
    t = F.col("text")
    has = lambda *cs: F.greatest(*[t.contains(c).cast("int") for c in cs], F.lit(0))
    return {
        "chars": F.length(t), "questions": F.size(F.filter("s", lambda x: x.contains("?"))), **{f"mark_{k}": T.occurrences(t, c) for k, c in enumerate(L.PUNCTUATION)},
        "em": has("—"), "en": has("–"), "hyphen": has("-"), "straight_quotes": has('"'), "curly_quotes": has("“", "”"), "single_curly": has("‘", "’"),
    }


#: Names of the number, sum and sum of squares of lengths, by the kind of their items.
_LENGTHS = {"s": ("sentences", "length", "squares"), "p": ("paragraphs", "para_length", "para_squares")}


def _counts() -> dict[str, Column]:
    """Whole numbers of a text that add up over texts, by name."""
    w = F.col("w")
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + f(x))
    lengths = {k: c for kind, names in _LENGTHS.items() for k, c in zip(names, (F.size(f"l{kind}"), total(f"l{kind}", lambda x: x), total(f"l{kind}", lambda x: x * x)))}
    return {
        "words": F.size(w), "letters": F.length(F.array_join(w, "")), "contractions": F.size(F.filter(w, lambda x: x.contains("'"))), **{k: T.counted(F.col("listed"), v) for k, v in _LISTS.items()}, **lengths, **_of_text(),
    }


def _figures(types: Column) -> dict[str, Column]:
    """What the sums of a text or of many make, by name."""
    n, words = F.col("sentences"), F.col("words")
    spread = lambda k, total, squares: F.when(k > 1, F.sqrt(F.greatest(squares - total * total / k, F.lit(0.0)) / (k - 1))).otherwise(0.0)
    marks = sum((F.col(f"mark_{k}") for k in range(len(L.PUNCTUATION))), F.lit(0))
    apostrophes = F.col(f"mark_{L.PUNCTUATION.index(chr(39))}")
    em, en, hyphen = (F.col(c) > 0 for c in ("em", "en", "hyphen"))
    kinds = em.cast("int") + en.cast("int") + hyphen.cast("int")
    ds, dc, ss, sc = F.col("straight_quotes") > 0, F.col("curly_quotes") > 0, apostrophes > F.col("contractions"), F.col("single_curly") > 0
    return {
        "sentence_mean": T.ratio(F.col("length"), n), "sentence_stdev": spread(n, F.col("length"), F.col("squares")), "type_token_ratio": T.ratio(types, words),
        "function_word_ratio": T.ratio(F.col("function_words"), words), "contraction_frequency": T.ratio(F.col("contractions"), words),
        "punctuation_per_100_chars": marks / F.greatest(F.col("chars"), F.lit(1)) * 100.0, "question_frequency": T.ratio(F.col("questions"), n),
        "paragraph_mean": T.ratio(F.col("para_length"), F.col("paragraphs")), "paragraph_stdev": spread(F.col("paragraphs"), F.col("para_length"), F.col("para_squares")),
        "dash_type": F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(em, "em").when(en, "en").otherwise("hyphen"),
        "quotation_convention": (
            F.when((ds | dc) & (ss | sc), "mixed").when(ds & dc, "mixed").when(ds, "double_straight").when(dc, "double_curly")
            .when(ss & sc, "mixed").when(ss, "single_straight").when(sc, "single_curly").otherwise("none")
        ),
        "contraction_policy": F.when(F.col("contractions") > 0, "contractions_present").otherwise("no_contractions"),
        "person_policy": F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.when(F.col(k) > 0, "present").otherwise("absent")) for k in sorted(L.PRONOUNS)]),
    }


def document_counts(docs: DataFrame, lengths: bool = True) -> DataFrame:
    """docs (doc_id, source, text) with their counts, in one scan; lengths: whether those of sentences are looked at."""
    listed = sorted({x for v in _LISTS.values() for x in v})  # one pass over all words, the others over what it leaves
    rows = _read(docs, lengths).withColumn("listed", F.filter("w", lambda x: x.isin(*listed)))
    return rows.withColumns({k: c.cast("long") for k, c in _counts().items()} | {"types": F.size(F.array_distinct("w")).cast("long")})


def document_figures(docs: DataFrame, lengths: bool = True) -> DataFrame:
    """docs (doc_id, source, text) with their counts and figures, in one scan."""
    return document_counts(docs, lengths).withColumns(_figures(F.col("types")))


def profile_items(docs: DataFrame) -> DataFrame:
    """source, kind, key, n, first: all that the profile of a source adds up, from one scan and one shuffle.

    Kinds: f a count by name, w a word, b a pair of words, s and p lengths of sentences and paragraphs, t a transition.
    Equal items are added up before the shuffle, by hash: where a pair stands first is one number, of its document and its place.
    """
    kind = "struct<kind:string,key:string,n:long,at:int>"

    def some(name: str, values: Column, placed: bool = False) -> Column:
        return F.transform(values, lambda x, i: F.struct(F.lit(name).alias("kind"), x.alias("key"), F.lit(1).cast("long").alias("n"), (i if placed else F.lit(None)).cast("int").alias("at")).cast(kind))

    rows = _read(docs)
    figures = F.array(*[F.struct(F.lit("f").alias("kind"), F.lit(k).alias("key"), c.cast("long").alias("n"), F.lit(None).cast("int").alias("at")).cast(kind) for k, c in _of_text().items()])
    strings = lambda c: F.transform(c, lambda x: x.cast("string"))
    items = F.concat(figures, some("w", F.col("w")), some("b", grams(F.col("w"), 2), True), some("s", strings("ls")), some("p", strings("lp")), some("t", F.col("tr")))
    each = rows.select("doc_id", "source", F.inline(items))
    # a struct's least would sort every item; documents without an id are before all others
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("at")
    return each.groupBy("source", "kind", "key").agg(F.sum("n").alias("n"), F.min(F.when(F.col("at").isNotNull(), place)).alias("first"))


def profiles(docs: DataFrame) -> DataFrame:
    """One row per source: words, the figures over all its texts, its conventions, ranges, terms and top transition.

    docs: (doc_id, source, text), the text being the voice that speaks for the source. Texts are joined by adding up
    their counts; a sentence that runs on from one document into the next counts as two.
    """
    items = materialize(profile_items(docs), "profile")
    added = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    n, length = F.col("n"), F.col("key").cast("long")
    sums = {k: added("f", F.when(F.col("key") == k, n)) for k in _of_text()} | {k: added("w", n * f(F.col("key"))) for k, f in _of_words().items()}
    for name, (number, whole, squares) in _LENGTHS.items():
        sums |= {number: added(name, n), whole: added(name, n * length), squares: added(name, n * length * length)}
    of = lambda k: F.when(F.col("kind") == k, F.col("key").cast("int"))
    rows = items.groupBy("source").agg(
        *[sums[k].alias(k) for k in _counts()], F.count_if(F.col("kind") == "w").alias("types"), F.percentile(of("s"), F.array(F.lit(0.1), F.lit(0.9)), F.col("n")).alias("band"),
        F.min(of("p")).alias("paragraph_least"), F.max(of("p")).alias("paragraph_most"), F.coalesce(F.sum(F.when(F.col("kind") == "t", F.col("n"))), F.lit(0)).alias("transitions"),
    )

    def top(k: str, order: list, most: int, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), *order))
        best = items.where(F.col("kind") == k).withColumn("nth", nth).where(F.col("nth") <= most)
        return best.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("nth", "key", "n"))).alias(name))

    rows = rows.join(top("b", ["first"], 3, "b"), "source", "left").join(top("t", ["key"], 1, "t"), "source", "left")
    share = F.get("t.n", F.lit(0)) / F.col("transitions")
    out = _figures(F.col("types")) | {
        "sentence_range": F.when(F.col("sentences") > 0, F.concat(T.whole_or_tenths(F.get("band", F.lit(0))), F.lit(".."), T.whole_or_tenths(F.get("band", F.lit(1))))).otherwise("none"),
        "paragraph_range": F.when(F.col("paragraphs") > 0, F.concat_ws("..", "paragraph_least", "paragraph_most")).otherwise("none"),
        "terms": F.coalesce(F.array_join("b.key", "|"), F.lit("")), "top_transition": F.coalesce(F.get("t.key", F.lit(0)), F.lit("none")),
        "transition_strength": F.when(share >= 1 / 3, "strong").when(share >= 1 / 6, "moderate").otherwise("weak"),
    }
    return rows.withColumns(out).drop("b", "t", "band")


def compared_conventions(docs: DataFrame) -> DataFrame:
    """source and the conventions (COMPARED) that profiles() gives it; documents' counts add up, no word is shuffled."""
    sums = document_counts(docs, lengths=False).groupBy("source").agg(*[F.sum(k).alias(k) for k in _counts()])
    figures = _figures(F.lit(0))
    return sums.select("source", *[figures[k].alias(k) for k in COMPARED])


def violating(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id of documents of which a convention differs from their source's (source and COMPARED): compare() has violations."""
    p = profile.select("source", *[F.col(k).alias(f"p_{k}") for k in COMPARED])
    differs = [F.coalesce(F.col(k) != F.col(f"p_{k}"), F.lit(False)) for k in COMPARED]
    return document_figures(docs, lengths=False).select("doc_id", "source", *COMPARED).join(p, "source").where(functools.reduce(Column.__or__, differs)).select("doc_id")


def projected_fingerprint(profile: DataFrame) -> DataFrame:
    """The flat fingerprint of each profile; parentheses count both marks, phrases are the profile's terms."""
    chars = F.greatest(F.col("chars"), F.lit(1))
    raw = (F.col("formal") - F.col("casual")) / F.greatest(F.col("words"), F.lit(1))
    ratio = lambda c: F.round(sum((F.col(f"mark_{L.PUNCTUATION.index(x)}") for x in c), F.lit(0)) / chars, 6)
    return profile.select(
        "source", F.round("sentence_mean", 2).alias("avg_sentence_length"), F.round(F.col("sentence_stdev") * F.col("sentence_stdev"), 2).alias("sentence_length_variance"), F.round("paragraph_mean", 2).alias("avg_paragraph_length"),
        *[ratio(c).alias(f"r_{k}") for k, c in RATIOS.items()], F.round("type_token_ratio", 4).alias("vocabulary_richness"), F.col("terms").alias("common_phrases"),
        F.round(F.when(F.col("words") > 0, 1 / (1 + F.exp(-5 * raw))).otherwise(0.0), 4).alias("formality"), F.round(T.ratio(F.col("letters"), F.col("words")), 2).alias("avg_word_length"),
        F.col("sentences").alias("total_sentences"), F.col("paragraphs").alias("total_paragraphs"), F.col("words").alias("total_words"),
    )


def _outlying(lengths: Column, mean: Column, stdev: Column, most: int, z: float = 2.0) -> Column:
    """Structs (no, n) of the `most` lengths furthest from the mean, over z deviations, in order; none without spread."""
    scored = F.transform(lengths, lambda x, i: F.struct((-F.abs((x - mean) / stdev)).alias("z"), (-x).alias("o"), i.alias("no"), x.alias("n")))
    best = F.slice(F.sort_array(F.filter(scored, lambda x: x["z"] < -z)), 1, most)
    ordered = F.sort_array(F.transform(best, lambda x: F.struct(x["no"].alias("no"), x["n"].alias("n"))))
    return F.when(stdev > 0, ordered).otherwise(F.array().cast("array<struct<no:int,n:int>>"))


def outliers(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, kind, no, n: sentences (in words, at most 10) and paragraphs (in sentences, at most 5) far from the profile's mean."""
    p = profile.select("source", *[F.col(c).alias(f"p_{c}") for c in ("sentence_mean", "sentence_stdev", "paragraph_mean", "paragraph_stdev")])
    rows = _read(docs).join(p, "source")
    each = lambda kind, c, most: F.transform(_outlying(F.col(c), F.col(f"p_{kind}_mean"), F.col(f"p_{kind}_stdev"), most), lambda x: F.struct(F.lit(kind).alias("kind"), x["no"].alias("no"), x["n"].alias("n")))
    return rows.select("doc_id", F.inline(F.concat(each("sentence", "ls", 10), each("paragraph", "lp", 5))))


def missing_terms(text: Column, terms: Column) -> Column:
    """The preferred terms (joined by bars) that a text lacks, in any case."""
    held = F.array_distinct(F.filter(F.transform(F.split(terms, r"\|"), T.strip), lambda x: x != ""))
    return F.filter(held, lambda x: ~F.lower(text).contains(F.lower(x)))


def compare(docs: DataFrame, profile: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Documents against their source's profile, without a verdict on authorship.

    Seven distances and their mean, confidence, evidence, sufficiency; violated invariants and formatting conflicts;
    preferred terms that are missing; outlying sentences and paragraphs. authorship_status is resolved where the
    profile's coverage (source, unresolved) has nothing open; without coverage it is unresolved.
    """
    kept = [*KEYS, *COMPARED, "paragraph_mean", "paragraph_stdev", "terms"]
    p = profile.select("source", *[F.col(k).alias(f"p_{k}") for k in kept])
    rows = document_figures(docs).join(p, "source")
    open_ = F.lit(1)
    if coverage is not None:
        rows, open_ = rows.join(coverage.select("source", F.col("unresolved").alias("p_open")), "source", "left"), F.coalesce("p_open", F.lit(1))
    distance = lambda k: F.least(F.abs(F.col(f"p_{k}") - F.col(k)) / F.greatest(F.col(f"p_{k}"), F.col(k), F.lit(1.0)), F.lit(1.0))
    rows = rows.withColumns({f"d_{k}": distance(k) for k in KEYS})
    mean = sum((F.col(f"d_{k}") for k in KEYS), F.lit(0.0)) / len(KEYS)
    one, words = F.lit(1.0), F.col("words")
    violated = F.array_compact(F.array(*[F.when(F.col(k) != F.col(f"p_{k}"), k) for k in COMPARED]))
    versus = lambda name, k: F.when(F.col(k) != F.col(f"p_{k}"), F.concat(F.lit(f"{name}: "), F.col(f"p_{k}"), F.lit(" vs "), F.col(k)))
    shown = lambda kind, c, most: F.array_join(F.transform(_outlying(F.col(c), F.col(f"p_{kind}_mean"), F.col(f"p_{kind}_stdev"), most), lambda x: x["n"].cast("string")), ",")
    return rows.select(
        "doc_id", *[f"d_{k}" for k in KEYS], mean.alias("mean_distance"), (F.least(one, words / 5000.0) * (1.0 - mean)).alias("confidence"), F.least(one, words / 1000.0).alias("evidence_coverage"),
        F.when(words >= 1000, "sufficient").otherwise("insufficient").alias("sufficiency"), F.when(open_ == 0, "resolved").otherwise("unresolved").alias("authorship_status"),
        F.array_join(violated, ",").alias("violations"), F.concat_ws(";", versus("dash", "dash_type"), versus("quotation", "quotation_convention")).alias("formatting_conflicts"),
        F.array_join(missing_terms(F.col("text"), F.col("p_terms")), "|").alias("lexical_conflicts"), shown("sentence", "ls", 10).alias("outlier_sentences"), shown("paragraph", "lp", 5).alias("outlier_paragraphs"),
    )


def band_strength(value: Column, low: float, high: float) -> Column:
    half = (high - low) / 2.0
    depth = F.least(F.greatest(F.least(value - low, high - value), F.lit(0.0)), F.lit(half)) / half
    return F.when(depth >= 2.0 / 3.0, "strong").when(depth >= 1.0 / 3.0, "moderate").otherwise("weak")


def tendencies(docs: DataFrame) -> DataFrame:
    """doc_id, name, value, strength: bands of sentence length, density and richness, and the top transition."""
    rows, each = _tendencies(_read(docs))
    return rows.select("doc_id", F.inline(each))


def _tendencies(read: DataFrame) -> tuple[DataFrame, Column]:
    """What _read() gives with more columns, and the array of a text's tendencies, made of them."""

    def banded(name: str, v: Column, cuts: tuple[float, ...], names: tuple[str, ...]) -> Column:
        inside = [v < cuts[1], v <= cuts[2], F.lit(True)]
        value, strength = F.lit(None).cast("string"), F.lit(None).cast("string")
        for k in (2, 1, 0):
            value = F.when(inside[k], names[k]).otherwise(value)
            strength = F.when(inside[k], band_strength(v, cuts[k], cuts[k + 1])).otherwise(strength)
        return F.struct(F.lit(name).alias("name"), value.alias("value"), strength.alias("strength"))

    rows = read.withColumns({
        "mean": T.ratio(F.aggregate("ls", F.lit(0.0), lambda a, x: a + x), F.size("ls")), "density": F.regexp_count("text", F.lit(DENSITY)) / F.greatest(F.length("text"), F.lit(1)) * 100.0,
        "richness": T.ratio(F.size(F.array_distinct("w")), F.size("w")), "best": F.array_min(F.transform(T.runs(F.col("tr")), lambda x: F.struct((-x["n"]).alias("o"), x["value"].alias("value")))),
    })
    share = -F.col("best.o") / F.size("tr")
    transition = F.struct(F.lit("top_transition").alias("name"), F.coalesce("best.value", F.lit("none")).alias("value"), F.when(share >= 1 / 3, "strong").when(share >= 1 / 6, "moderate").otherwise("weak").alias("strength"))
    return rows, F.array(
        banded("sentence_length_band", F.col("mean"), (0.0, 12.0, 25.0, 40.0), ("short", "medium", "long")), transition,
        banded("punctuation_density", F.col("density"), (0.0, 8.0, 16.0, 24.0), ("low", "moderate", "high")),
        banded("lexical_richness", F.col("richness"), (0.0, 0.35, 0.55, 1.0), ("low", "moderate", "high")),
    )


def invariants(docs: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, kind, value, status, evidence: the ten conventions that a text shows, never a judgment; or some kinds of them.

    What only other kinds need isn't worked out.
    """
    rows, each = _invariants(docs, kinds)
    # the array is no column of its own: a test of its size would be pushed down and everything inlined into it
    return rows.select("doc_id", F.inline(each))


def style(docs: DataFrame) -> DataFrame:
    """doc_id, invariants, tendencies: the rows of invariants() and tendencies() as arrays, from one reading of the texts."""
    rows, held = _invariants(docs)
    rows, leant = _tendencies(rows)
    return rows.select("doc_id", held.alias("invariants"), leant.alias("tendencies"))


def _invariants(docs: DataFrame, kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, Column]:
    """What document_figures() gives with more columns, and the array of a text's invariants, made of them."""
    t = F.col("text")
    rows = document_figures(docs.select("doc_id", F.lit("").alias("source"), "text"), lengths=kinds is None or not {*kinds} <= {*COMPARED})
    rows = T.with_distribution(rows, F.col("ls"), {"p10": "s10", "p90": "s90"})
    rows = T.with_distribution(rows, F.col("lp"), {"minimum": "plo", "maximum": "phi"})
    rows = with_top_pairs(rows, "w", "terms").withColumns({"brackets": F.regexp_count(t, F.lit(r"\[\d+(?:,\s*\d+)*\]")), "authors": F.regexp_count(t, F.lit(r"\([A-Z][A-Za-z' -]+,\s*\d{4}[a-z]?\)"))})
    cited = F.format_string("bracket_numbers=%d,author_year=%d", "brackets", "authors")
    span = lambda n, a, b: F.when(F.col(n) > 0, F.concat(T.whole_or_tenths(F.col(a)), F.lit(".."), T.whole_or_tenths(F.col(b)))).otherwise("none")
    counted = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))
    shown = {
        "quotation_convention": (F.col("quotation_convention"), F.col("quotation_convention")),
        "citation_presentation": (F.when(F.col("brackets") + F.col("authors") > 0, cited).otherwise("none"), cited),
        "heading_capitalization": (F.lit(""), F.lit("not_extractable_from_plain_text")),
        "contraction_policy": (F.col("contraction_policy"), T.decimals(F.col("contraction_frequency"), 4)),
        "preferred_terminology": (F.array_join("terms.value", "|"), F.concat(F.lit("counts="), F.when(F.size("terms") > 0, F.array_join(F.transform("terms", lambda x: x["n"].cast("string")), ",")).otherwise("0"))),
        "prohibited_phrases": (F.lit(""), F.lit("none_configured")),
        "paragraph_range": (span("paragraphs", "plo", "phi"), counted("paragraphs", "paragraphs")),
        "sentence_percentile_range": (span("sentences", "s10", "s90"), counted("sentences", "sentences")),
        "dash_type": (F.col("dash_type"), F.col("dash_type")),
        "person_policy": (F.col("person_policy"), F.concat_ws(",", *[counted(k, k) for k in sorted(L.PRONOUNS)])),
    }
    one = lambda k, v, e: F.struct(F.lit(k).alias("kind"), v.alias("value"), F.lit("unknown" if k == "heading_capitalization" else "pass").alias("status"), e.alias("evidence"))
    return rows, F.array(*[one(k, v, e) for k, (v, e) in shown.items() if kinds is None or k in kinds])


def profile_invariants(profile: DataFrame) -> DataFrame:
    """source, kind, value of the invariants that comparisons look at."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in COMPARED], F.struct(F.lit("preferred_terminology").alias("kind"), F.col("terms").alias("value")))
    return profile.select("source", F.inline(each))


def invariant_violations(own: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, doc_id, kind, expected, found where a document's comparable invariant differs from the expected one.

    own: (keys, doc_id, kind, value), expected: (keys, kind, value): of another version, or of the source's profile.
    """
    names = list(dict.fromkeys([*keys, "doc_id"]))
    e = expected.where(F.col("kind").isin(*COMPARED)).select(*keys, "kind", F.col("value").alias("expected"))
    return own.join(e, [*keys, "kind"]).where("value <> expected").select(*names, "kind", "expected", F.col("value").alias("found"))
