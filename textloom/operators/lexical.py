"""Rule-driven word proposals: contexts, matching, choice, inflection, safety, application, rebasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.operators.intervals import overlapping, sums_before
from textloom.sources.store import materialize

_MARKS = r"""[!-/:-@\[-`{-~]"""
_TOKEN = r"[^ \t\n\x0B\f\r]+"
#: The ranks of rule origins, strongest first.
RANKS = ("protected_span", "user_preference", "project_glossary", "register_evidence", "domain_glossary", "curated_rule", "licensed_resource", "no_change")


def _core(token: Column) -> Column:
    """A token without the marks around it."""
    return F.regexp_replace(token, rf"^{_MARKS}+|{_MARKS}+$", "")


def rules(spark: SparkSession) -> DataFrame:
    """The bundled rules: rule_id, source, target, sense, confidence, precedence."""
    return spark.createDataFrame([(*r, "curated_rule") for r in L.RULES], "rule_id string, source string, target string, sense string, confidence double, precedence string")


def contexts(docs: DataFrame, window: int = 3) -> DataFrame:
    """One row per blank-separated token: doc_id, tok_no, token, offset, left_window, right_window, part_of_speech."""
    found = F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))
    gaps = F.slice(F.transform(F.split("text", _TOKEN, -1), F.length), 1, F.size(found))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(gaps.alias("gap"), found.alias("token"))).alias("tok_no", "x")).select("doc_id", "tok_no", "x.gap", "x.token")
    order = Window.partitionBy("doc_id").orderBy("tok_no")
    end = F.sum(F.col("gap") + F.length("token")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    left = F.concat_ws(" ", *[F.lag(F.lower("token"), k).over(order) for k in range(window, 0, -1)])
    right = F.concat_ws(" ", *[F.lead("token", k).over(order) for k in range(1, window + 1)])
    low = F.lower("token")
    pos = F.when(low.rlike("(?:ing|ed)$"), "verb").when(low.endswith("ly"), "adverb").when(low.rlike("(?:tion|ment|ness)$"), "noun").when(low.rlike("(?:ous|ive|al)$"), "adjective").otherwise("other")
    return rows.select("doc_id", "tok_no", "token", (end - F.length("token")).cast("long").alias("offset"), left.alias("left_window"), right.alias("right_window"), pos.alias("part_of_speech"))


#: Forms that are looked for within the row; more meet the tokens by a join.
FEW_FORMS = 1024


def _with_places(docs: DataFrame, forms: DataFrame, few: list[str] | None) -> DataFrame:
    """doc_id, text, places: which blank-separated tokens are a form (form, ...) but for case and outer marks.

    A few forms are looked for within the row, without a shuffle; of more (None), tokens meet the forms by an equi-join.
    """
    cores = F.transform(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)), lambda x: F.lower(_core(x)))
    if few is not None:
        held = lambda xs: F.filter(T.places(F.size(xs)), lambda i: F.get(xs, i).isin(*few))
        return docs.select("doc_id", "text", T.bound(cores, held).alias("places"))
    met = docs.select("doc_id", F.posexplode(cores).alias("at", "form")).join(forms, "form", "left_semi")
    return docs.select("doc_id", "text").join(met.groupBy("doc_id").agg(F.sort_array(F.collect_list("at")).alias("places")), "doc_id")


def contexts_at(docs: DataFrame, window: int = 3) -> DataFrame:
    """The rows of contexts() for the tokens at some places, within the row: doc_id, token, offset, left_window, right_window.

    docs: (doc_id, text, places), places being the tokens' numbers.
    """
    lengths = F.transform(F.split("text", _TOKEN, -1), F.length)
    parts = F.struct(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)).alias("found"), lengths.alias("gaps"))
    steps = lambda r: F.zip_with(r["found"], F.slice(r["gaps"], 1, F.size(r["found"])), lambda x, g: (F.length(x) + g).cast("long"))

    def shown(r: Column) -> Column:
        left = lambda i: F.array_join(F.transform(F.slice(r["found"], F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window))), F.lower), " ")
        right = lambda i: F.array_join(F.slice(r["found"], i + 2, F.lit(window)), " ")
        return T.bound(T.running(steps(r)), lambda before: F.transform("places", lambda i: F.struct(
            F.get(r["found"], i).alias("token"), (F.get(before, i) + F.get(r["gaps"], i)).alias("offset"), left(i).alias("left_window"), right(i).alias("right_window"),
        )))

    return docs.select("doc_id", F.inline(F.when(F.size("places") > 0, T.bound(parts, shown))))


def covered(token_rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, tok_no, spans: the numbers of the protected spans (span_no, start, end) that cover each token's start."""
    at = token_rows.select("doc_id", "tok_no", "offset", (F.col("offset") + 1).alias("end"))
    held = overlapping(at, spans.select("doc_id", "span_no", F.col("start").alias("s"), F.col("end").alias("e")), left_range=("offset", "end"))
    return held.groupBy("doc_id", "tok_no").agg(F.sort_array(F.collect_list("span_no")).alias("spans"))


#: Phrases that are looked for within the row; more meet the texts by a join.
FEW_PHRASES = 64


def _hits_in_row(keys: Column, few: list[Row], kinds: dict[str, str]) -> Column:
    """Structs (at, k, ...) of the phrases' places in an array of tokens: where a phrase may begin, each is compared."""
    others = [c for c in kinds if c != "keys"]
    one = lambda r: F.struct(F.array(*map(F.lit, r["keys"])).alias("own"), F.lit(len(r["keys"])).alias("k"), *[F.lit(r[c]).cast(kinds[c]).alias(c) for c in others])
    known = F.array(*map(one, few))
    starts = F.filter(T.places(F.size(keys)), lambda i: F.get(keys, i).isin(*sorted({r["keys"][0] for r in few})))
    here = lambda i: F.filter(known, lambda x: F.slice(keys, i + 1, x["k"]) == x["own"])
    return F.flatten(F.transform(starts, lambda i: F.transform(here(i), lambda x: F.struct(i.alias("at"), x["k"].alias("k"), *[x[c].alias(c) for c in others]))))


def phrase_hits(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (doc_id, keys, ...) that hold a phrase, with hits: structs (at, k and the columns of known but keys).

    keys: an array of tokens; known: (keys, ...), phrases of any number of tokens. A few phrases are looked for within the
    row, without a shuffle. Of more, runs of as many tokens as some phrase has meet the phrases by their hashes in an
    equi-join; what meets is compared token by token, and only the distinct lengths come to the driver. Rows without a
    hit may stay, with no hits. Phrases without tokens are never found.
    """
    known = known.where(F.size("keys") > 0)
    few = known.limit(FEW_PHRASES + 1).collect()
    if 0 < len(few) <= FEW_PHRASES:
        return rows.withColumn("hits", T.bound(F.col("keys"), lambda keys: _hits_in_row(keys, few, dict(known.dtypes))))
    lengths = [r[0] for r in known.select(F.size("keys")).distinct().collect()] or [1]
    others = [c for c in known.columns if c != "keys"]
    named = T.with_grams(known, "keys", lengths).withColumn("g", F.explode(F.filter("grams", lambda g: (g["k"] == F.size("keys")))))
    named = named.select(F.col("g.k").alias("k"), F.col("g.h").alias("h"), F.col("keys").alias("own"), *others)
    runs = T.with_grams(rows.select("doc_id", "keys"), "keys", lengths).select("doc_id", F.inline("grams"))
    met = runs.join(named, ["k", "h"]).groupBy("doc_id").agg(F.collect_list(F.struct("at", "k", "own", *others)).alias("hits"))
    # both arrays are worked out once a row
    whole = lambda r: F.filter(r["hits"], lambda x: F.slice(r["keys"], x["at"] + 1, x["k"]) == x["own"])
    named = lambda x: F.struct(x["at"].alias("at"), x["k"].alias("k"), *[x[c].alias(c) for c in others])
    return rows.join(met, "doc_id").withColumn("hits", T.bound(F.struct("keys", "hits"), lambda r: F.transform(whole(r), named)))


def phrases(docs: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Places of the rules' sources that hold a blank: doc_id, source, token, offset, left_window, right_window.

    A source is found as it is written, marks and blanks included, at any length and in any case, where no letter, digit or underscore
    stands before or after it. Of one source's places that overlap the first counts. Longer sources come first,
    then by name; a place that one before it overlaps falls away. Windows are 40 characters.
    """
    cut = lambda c: F.regexp_extract_all(c, F.lit(T.TOKEN), F.lit(0))
    sources = rule_rows.where(F.col("source").contains(" ")).select("source").distinct().withColumn("keys", F.transform(cut(F.col("source")), T.folded))
    rows = docs.select("doc_id", cut(F.col("text")).alias("toks")).withColumn("keys", F.transform("toks", T.folded))
    kept = T.bound(F.struct("toks", "hits"), lambda r: T.bound(_chosen(_leftmost(_apart(r["toks"], r["hits"]))), lambda hits: _shown(r["toks"], hits)))
    return phrase_hits(rows, sources).select("doc_id", F.inline(F.when(F.size("hits") > 0, kept)))


_HIT = "struct<source:string,at:int,k:int>"


def _apart(toks: Column, hits: Column) -> Column:
    """The hits with no word right before or after them, by source and place."""
    word = lambda i: F.coalesce(F.get(toks, i).rlike(T.WORD_RUN), F.lit(False))
    kept = F.filter(hits, lambda x: ~word(x["at"] - 1) & ~word(x["at"] + x["k"]))
    return F.sort_array(F.transform(kept, lambda x: F.struct(x["source"].alias("source"), x["at"].alias("at"), x["k"].alias("k"))))


def _leftmost(hits: Column) -> Column:
    """Of the places of one source that overlap the first, from left to right; sorted by place."""
    def step(last: Column, x: Column) -> tuple[Column, Column]:
        free = (x["source"] != last["source"]) | (x["at"] >= last["end"])
        return F.when(free, F.struct(x["source"].alias("source"), (x["at"] + x["k"]).alias("end"))).otherwise(last), F.when(free, x)

    swept = T.sweep(hits, F.struct(F.lit("").alias("source"), F.lit(0).alias("end")), step, _HIT)["out"]
    return F.sort_array(F.transform(swept, lambda x: F.struct(x["at"].alias("at"), x["k"].alias("k"), x["source"].alias("source"))))


def _chosen(hits: Column) -> Column:
    """Of places that overlap those of the longer source, then by name.

    Places in a row that overlap make a group, and only within one each place is held against those taken before: groups
    stay small, however many places a text has.
    """
    kind = "struct<o:int,source:string,at:int,k:int,group:int>"

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        group = last["group"] + (x["at"] >= last["end"]).cast("int")
        row = F.struct((-F.length(x["source"])).alias("o"), x["source"].alias("source"), x["at"].alias("at"), x["k"].alias("k"), group.alias("group"))
        return F.struct(F.greatest(last["end"], x["at"] + x["k"]).alias("end"), group.alias("group")), row

    def choose(xs: Column) -> Column:
        clash = lambda acc, x: F.exists(acc, lambda y: (x["at"] < y["at"] + y["k"]) & (y["at"] < x["at"] + x["k"]))
        many = F.aggregate(F.sort_array(xs), F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
        return F.when(F.size(xs) == 1, xs).otherwise(many)

    def groups(rows: Column) -> Column:
        starts = F.filter(T.places(F.size(rows)), lambda i: (i == 0) | (F.get(rows, i)["group"] != F.get(rows, i - 1)["group"]))
        ends = lambda starts, i: F.coalesce(F.get(starts, i + 1), F.size(rows))
        return T.bound(starts, lambda starts: F.flatten(F.transform(starts, lambda s, i: T.bound(F.slice(rows, s + 1, ends(starts, i) - s), choose))))

    return T.bound(T.sweep(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("group")), step, kind)["out"], groups)


def _shown(toks: Column, hits: Column) -> Column:
    """source, token, offset, left_window, right_window of each hit."""
    text = lambda start, n: F.array_join(F.slice(toks, start + 1, n), "")
    # every token has a character at least: 40 of them reach as far as the windows do
    left = lambda at: F.right(text(F.greatest(at - 40, F.lit(0)), F.least(at, F.lit(40))), F.lit(40))
    right = lambda end: F.left(text(end, F.lit(40)), F.lit(40))
    return T.bound(T.running(F.transform(toks, lambda x: F.length(x).cast("long"))), lambda before: F.transform(hits, lambda x: F.struct(
        x["source"].alias("source"), text(x["at"], x["k"]).alias("token"), F.get(before, x["at"]).alias("offset"),
        left(x["at"]).alias("left_window"), right(x["at"] + x["k"]).alias("right_window"),
    )))


def _forms(rule_rows: DataFrame) -> DataFrame:
    """form to source: the source itself, or the one source whose -ing or -ed form it is."""
    base = rule_rows.where(~F.col("source").contains(" ")).select("source").distinct()
    silent, low = F.col("source").endswith("e"), F.lower("source")
    ing = F.concat(F.when(silent, F.expr("left(lower(source), length(source) - 1)")).otherwise(low), F.lit("ing"))
    ed = F.concat(low, F.when(silent, F.lit("d")).otherwise(F.lit("ed")))
    exact = base.select(low.alias("form"), "source", F.lit(0).alias("kind"))
    bent = base.select(F.explode(F.array(ing, ed)).alias("form"), "source", F.lit(1).alias("kind"))
    all_ = exact.unionByName(bent)
    n = all_.groupBy("form", "kind").agg(F.count_distinct("source").alias("n"), F.min("source").alias("source")).where("n = 1")
    return n.groupBy("form").agg(F.min(F.struct("kind", "source")).alias("x")).select("form", F.col("x.source").alias("source"))


def inflected(surface: Column, lemma: Column, target: Column) -> Column:
    """The target in the surface's form (-ing, -ed) and case; null where the form isn't known."""
    s, silent = F.lower(surface), F.lower(target).endswith("e")
    ing = F.concat(F.when(silent, F.substring(target, F.lit(1), F.length(target) - 1)).otherwise(target), F.lit("ing"))
    ed = F.concat(target, F.when(silent, F.lit("d")).otherwise(F.lit("ed")))
    form = F.when(s == F.lower(lemma), target).when(s.endswith("ing") & ~F.lower(lemma).endswith("ing"), ing).when(s.endswith("ed") & ~F.lower(lemma).endswith("ed"), ed)
    letters = F.regexp_replace(surface, r"[^\p{L}]", "")
    title = letters.rlike(r"^\p{Lu}[^\p{Lu}]*$")
    return F.when((letters != "") & (letters == F.upper(letters)), F.upper(form)).when(title, F.concat(F.upper(F.substring(form, 1, 1)), F.substring(form, F.lit(2), F.length(form)))).otherwise(form)


def _tokens(window: Column) -> Column:
    cleaned = F.transform(F.split(window, T.SPACE + "+"), lambda x: F.lower(F.regexp_replace(x, rf"^{_MARKS}+|{_MARKS}+$", "")))
    return F.filter(cleaned, lambda x: x != "")


def collocation_safe(replacement: Column, left: Column, right: Column) -> Column:
    """No forbidden pair and no doubled neighbour; the windows are joined to the replacement without a blank."""
    pairs = lambda xs: F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    forbidden = F.array(*[F.lit(x) for x in L.FORBIDDEN_BIGRAMS])
    joined = _tokens(F.concat(left, replacement, right))
    bad = F.exists(pairs(joined), lambda p: F.array_contains(forbidden, F.concat_ws(" ", p["a"], p["b"])))
    own, before, after = _tokens(replacement), _tokens(left), _tokens(right)
    doubled = F.coalesce(F.try_element_at(before, F.lit(-1)) == F.try_element_at(own, F.lit(1)), F.lit(False)) | F.coalesce(F.try_element_at(after, F.lit(1)) == F.try_element_at(own, F.lit(-1)), F.lit(False))
    return (F.size(own) > 0) & ~bad & ~doubled & ~F.exists(pairs(own), lambda p: p["a"] == p["b"])


def propose(docs: DataFrame, rule_rows: DataFrame, spans: DataFrame, safe_threshold: float = 0.9) -> DataFrame:
    """Changes and declines: doc_id, offset, length, surface, target, rule_id, confidence, status.

    Tokens meet rules by an equi-join on their form; sources of several words come before the tokens they overlap. The
    strongest origin wins, equal ones with different targets
    are ambiguous. A token under a protected span, an unknown inflection or an unsafe neighbourhood is declined.
    """
    ranks = F.array(*[F.lit(r) for r in RANKS])
    forms = _forms(rule_rows)
    few = [r[0] for r in forms.select("form").limit(FEW_FORMS + 1).collect()]
    few, forms = (few, F.broadcast(forms)) if len(few) <= FEW_FORMS else (None, forms)
    rows = contexts_at(_with_places(docs, forms, few)).withColumn("surface", _core(F.col("token")))
    rows = rows.withColumn("offset", F.col("offset") + F.call_function("locate", F.col("surface"), F.col("token")) - 1).withColumn("form", F.lower("surface"))
    rows = rows.join(forms, "form").select("doc_id", "offset", "surface", "source", "left_window", "right_window")
    if not rule_rows.where(F.col("source").contains(" ")).isEmpty():
        found = phrases(docs, rule_rows)
        place = found.select("doc_id", F.col("offset").alias("s"), (F.col("offset") + F.length("token")).alias("e"))
        own = rows.select("doc_id", "offset", (F.col("offset") + F.length("surface")).alias("end"))
        under = overlapping(own, place, left_range=("offset", "end")).select("doc_id", "offset").distinct()
        rows = rows.join(under, ["doc_id", "offset"], "left_anti").unionByName(found.select("doc_id", "offset", F.col("token").alias("surface"), "source", "left_window", "right_window"))
    ranked = rule_rows.withColumn("rank", F.array_position(ranks, F.col("precedence")))
    best = ranked.groupBy("source").agg(F.min(F.struct("rank", "rule_id", "target", "sense", "confidence")).alias("r"))
    ties = ranked.join(best.select("source", F.col("r.rank").alias("top")), "source").where("rank = top").groupBy("source").agg(F.count_distinct("target", "sense").alias("choices"))
    rows = rows.join(best, "source").join(ties, "source")
    rows = materialize(rows, "tokens")  # read twice: written once, not worked out by each
    length = F.length("surface")
    held = spans.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    key = ["doc_id", "offset"]
    covered = overlapping(rows.select("doc_id", "offset", (F.col("offset") + length).alias("end")), held, left_range=("offset", "end")).select(*key).distinct().withColumn("covered", F.lit(True))
    rows = rows.join(covered, key, "left")
    rows = rows.withColumn("target", inflected(F.col("surface"), F.col("source"), F.col("r.target")))
    status = (
        F.when(F.col("covered"), "protected_span").when(F.col("choices") > 1, "ambiguous_sense").when(F.col("target").isNull(), "inflection")
        .when(~collocation_safe(F.col("target"), F.col("left_window"), F.col("right_window")), "collocation")
        .when((F.col("r.confidence") < safe_threshold) | (F.col("r.rank") > RANKS.index("curated_rule") + 1), "proposed").otherwise("safe")
    )
    return rows.select("doc_id", "offset", length.cast("long").alias("length"), "surface", "target", F.col("r.rule_id").alias("rule_id"), F.col("r.confidence").alias("confidence"), status.alias("status"))


def apply_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id, text, problem: the texts with the changes (doc_id, offset, length, surface, target) made.

    A document whose changes don't all fit keeps its text, and problem names the first that doesn't: outside the text, over
    another one, or not on its surface. Where changes have a document_hash, the sha256 of the text that they were
    proposed on, and it is another one, problem says so. Null where there is nothing to say.
    """
    hash_ = F.max("document_hash") if "document_hash" in changes.columns else F.lit(None).cast("string")
    other = F.count_distinct("document_hash") > 1 if "document_hash" in changes.columns else F.lit(False)
    per = changes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "surface", "target"))).alias("xs"), hash_.alias("hash"), other.alias("mixed"))
    rows = docs.select("doc_id", "text").join(per, "doc_id", "left")
    t = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("problem"))

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        at, end = last["at"], x["offset"] + x["length"]
        own = F.substring(t, (x["offset"] + 1).cast("int"), x["length"].cast("int"))
        wrong = F.when((x["offset"] < 0) | (x["length"] <= 0) | (end > F.length(t)), "outside").when(x["offset"] < at, "overlap").when(own != x["surface"], "surface")
        kept = F.substring(t, (at + 1).cast("int"), (x["offset"] - at).cast("int"))
        named = F.coalesce(last["problem"], F.concat(wrong, F.lit(":"), x["offset"].cast("string")))
        return F.struct(F.when(named.isNull(), end).otherwise(at).alias("at"), named.alias("problem")), F.when(named.isNull(), F.concat(kept, x["target"]))

    rows = rows.withColumn("swept", T.sweep(F.col("xs"), start, step, "string"))
    stale = F.when(F.col("mixed") | (F.col("hash") != F.sha2(t, 256)), "document_hash")
    problem = F.coalesce(stale, F.col("swept.last.problem"))
    new = F.concat(F.array_join("swept.out", ""), F.substring(t, (F.col("swept.last.at") + 1).cast("int"), F.length(t)))
    return rows.select("doc_id", F.when(problem.isNull(), F.coalesce(new, t)).otherwise(t).alias("text"), problem.alias("problem"))


def rebase(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """Spans (doc_id, span_no, start, end) after the changes: shifted by what ends before them; overlap is an error."""
    c = changes.select("doc_id", F.col("offset").alias("s"), (F.col("offset") + F.col("length")).alias("e"), (F.length("target") - F.col("length")).alias("more"))
    own = spans.select("doc_id", "span_no", "start", "end")
    rows = sums_before(own, c, place="e", value="more", name="shift")
    key = ["doc_id", "span_no", "start", "end"]
    touched = overlapping(own, c.drop("more")).select(*key).distinct().withColumn("overlap", F.lit(True))
    rows = rows.join(touched, key, "left")
    return rows.select("doc_id", "span_no", (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"), F.coalesce("overlap", F.lit(False)).alias("overlap"))


def review(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """The changes that a decision (doc_id, offset, accepted) accepts; undecided and refused ones fall away."""
    return changes.join(decisions.where("accepted").select("doc_id", "offset").distinct(), ["doc_id", "offset"], "left_semi")


def review_problems(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on unknown changes, and changes decided more than once: doc_id, offset, problem."""
    unknown = decisions.join(changes, ["doc_id", "offset"], "left_anti").select("doc_id", "offset", F.lit("unknown").alias("problem")).distinct()
    repeated = decisions.groupBy("doc_id", "offset").count().where("count > 1").select("doc_id", "offset", F.lit("repeated").alias("problem"))
    return unknown.unionByName(repeated)
