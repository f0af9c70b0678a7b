"""Facts in texts: anchors, citations, quotations, protected spans, claims, entities and relations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.sources.store import materialize

# Patterns that the definitions name.
_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
_LONG_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ANCHORS = (
    ("number", r"\b\d+(?:\.\d+)?%?\b|\$\d+(?:,\d{3})*(?:\.\d+)?|\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"),
    ("date", rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b"),
    ("entity", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}\b"),
    ("quote", r'"([^"]{3,})"'),
    ("citation", r"\[\d+(?:,\s*\d+)*\]|\([A-Z][a-z]+(?:\s+(?:et\s+al\.?|&\s+[A-Z][a-z]+))?,?\s*\d{4}[a-z]?\)"),
)
CITATIONS = (
    ("doi", r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"),
    ("bracket_number", r"\[(\d{1,4}(?:,\s*\d{1,4})*)\]"),
    ("author_year", r"\(([A-Z][A-Za-zÀ-ſ' -]+,\s*\d{4}[a-z]?)\)"),
    ("url", r"https?://[^\s\"'<>()\[\]]{4,}"),
)
NUMBER_UNIT = r"\b(\d+(?:[.,]\d+)?)\s*([A-Za-zÀ-ſµΩ°%]{1,12})\b"
DATE = rf"\b(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|\d{{1,2}}\s+(?:{_LONG_MONTHS})\s+\d{{4}}|(?:{_LONG_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b"
QUOTE, CURLY_QUOTE = r'"([^"\n]{20,})"', r"“([^”\n]{20,})”"
_SPAN = "array<struct<kind:string,start:int,end:int,text:string,label:string>>"


def _found(t: Column, pattern: str, kind: str, text=None, label=None, keep=None, cut=None) -> Column:
    """Spans of one pattern: struct(kind, start, end, text, label)."""

    def span(m: Column) -> Column:
        body = text(m["text"]) if text else m["text"]
        end = cut(m) if cut else m["end"]
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), end.alias("end"), body.alias("text"), (label(m["text"]) if label else F.lit("")).alias("label"))

    spans = F.transform(T.matches(t, pattern), span)
    spans = F.filter(spans, keep) if keep else spans
    return F.when(t.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, seq, category, text, position: anchors by position, categories in their order on ties."""
    t = F.col("text")
    each = [_found(t, p, k, text=(lambda x: F.substring(x, F.lit(2), F.length(x) - 2)) if k == "quote" else None) for k, p in ANCHORS]
    ranked = [F.transform(c, lambda s, i=i: s) for i, c in enumerate(each)]
    rows = docs.select("doc_id", F.posexplode(F.concat(*ranked)).alias("slot", "s")).select("doc_id", "slot", "s.*")
    order = Window.partitionBy("doc_id").orderBy("start", "slot")
    return rows.select("doc_id", F.row_number().over(order).alias("seq"), F.col("kind").alias("category"), "text", F.col("start").alias("position"))


def _held(kind: str) -> Column | None:
    """Whether a text has what every anchor of a category has: quickly told, so most texts aren't searched for patterns."""
    t = F.col("text")
    return {"number": t.rlike("[0-9]"), "date": t.rlike("[0-9]"), "quote": t.contains('"'), "citation": t.contains("[") | t.contains("(")}.get(kind)


def anchor_items(docs: DataFrame) -> DataFrame:
    """doc_id, seq, category, text: the anchors of anchors() without places, seq counting within a category, each pattern in one pass."""

    def found(kind: str, pattern: str) -> Column:
        texts = F.regexp_extract_all("text", F.lit(pattern), F.lit(1 if kind == "quote" else 0))
        held = _held(kind)
        texts = texts if held is None else F.when(held, texts).otherwise(F.array().cast("array<string>"))
        return F.transform(texts, lambda x, i: F.struct((i + 1).alias("seq"), F.lit(kind).alias("category"), x.alias("text")))

    each = [found(k, p) for k, p in ANCHORS]
    return docs.where("text IS NOT NULL").select("doc_id", F.inline(F.concat(*each)))


def anchor_texts(docs: DataFrame) -> DataFrame:
    """doc_id, category, text: the anchors of anchors() in no order and without places, so each pattern is one pass over a text."""
    return anchor_items(docs).select("doc_id", "category", "text")


def exact_drift(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """doc_id, preserved, omitted, added: counts of the multiset diff of two versions' anchors (doc_id, category, text)."""
    sided = lambda df, s: df.select("doc_id", "category", "text", F.lit(s).alias("s"), F.lit(1 - s).alias("c"))
    both = sided(source, 1).unionByName(sided(candidate, 0)).groupBy("doc_id", "category", "text").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    least = F.least("s", "c")
    return both.groupBy("doc_id").agg(F.sum(least).alias("preserved"), F.sum(F.col("s") - least).alias("omitted"), F.sum(F.col("c") - least).alias("added"))


def line_nodes(docs: DataFrame) -> DataFrame:
    """One paragraph node per line that isn't blank, with exact offsets: doc_id, node_no, start, end, line, text."""
    rows = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    starts = T.running(F.transform("lines", lambda x: (F.length(x) + 1).cast("long")))
    lines = F.zip_with("lines", starts, lambda x, at: F.struct(at.cast("int").alias("start"), (at + F.length(x)).cast("int").alias("end"), x.alias("text")))
    lines = F.transform(lines, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), (i + 1).alias("line"), x["text"].alias("text")))
    held = F.filter(lines, lambda x: T.strip(x["text"]) != "")
    rows = rows.select("doc_id", F.posexplode(held).alias("k", "n"))
    return rows.select("doc_id", (F.col("k") + 1).alias("node_no"), "n.start", "n.end", "n.line", "n.text")


def lines(docs: DataFrame) -> DataFrame:
    """The nodes of line_nodes() without their places: doc_id, node_no, text."""
    held = F.filter(F.split("text", "\n"), lambda x: x.rlike(rf"[^{T.SPACE[1:]}"))
    return docs.select("doc_id", F.posexplode(held).alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("node_no"), "text")


#: What every citation has, and what every span has: few lines do, and only those are searched for patterns.
_CITING, _TELLING = "[0-9]|://", '[0-9"“]|://'


def citations(nodes: DataFrame) -> DataFrame:
    """doc_id, citation_no, kind, text, start, end, in order of the text; repeated places count once."""
    t = F.col("text")
    nodes = nodes.where(t.rlike(_CITING))
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    doi = lambda x: F.regexp_replace(x, r"\.+$", "")
    each = [
        _found(t, CITATIONS[0][1], "doi", text=doi, cut=lambda m: m["start"] + F.length(doi(m["text"]))), _found(t, CITATIONS[1][1], "bracket_number"),
        _found(t, CITATIONS[2][1], "author_year", text=inner), _found(t, CITATIONS[3][1], "url"),
    ]
    rows = nodes.select("doc_id", F.col("start").alias("base"), F.posexplode(F.concat(*each)).alias("slot", "s"))
    rows = rows.select("doc_id", "slot", F.col("s.kind").alias("kind"), F.col("s.text").alias("text"), (F.col("base") + F.col("s.start")).alias("start"), (F.col("base") + F.col("s.end")).alias("end")).dropDuplicates(["doc_id", "start", "end", "kind"])
    order = Window.partitionBy("doc_id").orderBy("start", "slot")
    return rows.select("doc_id", F.row_number().over(order).alias("citation_no"), "kind", "text", "start", "end")


def quotations(nodes: DataFrame) -> DataFrame:
    """Quoted runs of 20 characters and more inside nodes: doc_id, text, start, end."""
    t = F.col("text")
    inner = lambda x: T.strip(F.substring(x, F.lit(2), F.length(x) - 2))
    each = [_found(t, p, "quotation", text=inner, keep=lambda s: F.length(s["text"]) >= 20) for p in (QUOTE, CURLY_QUOTE)]
    rows = nodes.select("doc_id", F.col("start").alias("base"), F.inline(F.concat(*each)))
    return rows.select("doc_id", "text", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end")).dropDuplicates(["doc_id", "start", "end"])


def number_units(nodes: DataFrame) -> DataFrame:
    """Numbers with a unit that is no stop-word: doc_id, text, unit, start, end."""
    held = F.array(*[F.lit(w) for w in L.UNIT_STOPWORDS])
    unit = lambda x: F.regexp_extract(x, r"^\d+(?:[.,]\d+)?\s*(.*)$", 1)
    spans = _found(F.col("text"), NUMBER_UNIT, "number", label=unit, keep=lambda s: ~F.array_contains(held, F.lower(s["label"])))
    rows = nodes.select("doc_id", F.col("start").alias("base"), F.inline(spans))
    return rows.select("doc_id", "text", F.col("label").alias("unit"), (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))


def dates(nodes: DataFrame) -> DataFrame:
    rows = nodes.select("doc_id", F.col("start").alias("base"), F.inline(_found(F.col("text"), DATE, "date")))
    return rows.select("doc_id", "text", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))


def span_candidates(nodes: DataFrame) -> DataFrame:
    """All kinds of spans together, from one scan of the nodes: doc_id, kind, text, label, start, end.

    Places that a kind repeats count once. Where nodes have a node_type, quotation nodes are quotations as they are.
    """
    t = F.col("text")
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    doi = lambda x: F.regexp_replace(x, r"\.+$", "")
    unit = lambda x: F.regexp_extract(x, r"^\d+(?:[.,]\d+)?\s*(.*)$", 1)
    kinds = [k for k, _ in CITATIONS]
    telling = t.rlike(_TELLING)
    nodes = nodes.where(telling | F.coalesce(F.col("node_type") == "quotation", F.lit(True)) if "node_type" in nodes.columns else telling)
    each = [
        *[_found(t, p, "quotation", text=lambda x: T.strip(inner(x)), keep=lambda s: F.length(s["text"]) >= 20) for p in (QUOTE, CURLY_QUOTE)],
        _found(t, CITATIONS[0][1], "citation", text=doi, label=lambda x: F.lit(kinds[0]), cut=lambda m: m["start"] + F.length(doi(m["text"]))), _found(t, CITATIONS[1][1], "citation", label=lambda x: F.lit(kinds[1])),
        _found(t, CITATIONS[2][1], "citation", text=inner, label=lambda x: F.lit(kinds[2])), _found(t, CITATIONS[3][1], "citation", label=lambda x: F.lit(kinds[3])),
        _found(t, NUMBER_UNIT, "number", label=unit, keep=lambda s: ~F.lower(s["label"]).isin(*L.UNIT_STOPWORDS)), _found(t, DATE, "date"),
    ]
    found = F.concat(*each)
    if "node_type" in nodes.columns:
        whole = F.array(F.struct(F.lit("quotation").alias("kind"), F.lit(0).alias("start"), F.length(t).alias("end"), t.alias("text"), F.lit("").alias("label"))).cast(_SPAN)
        found = F.when(F.col("node_type") != "quotation", found).when(T.strip(t) != "", whole).otherwise(F.array().cast(_SPAN))
    rows = nodes.select("doc_id", F.col("start").alias("base"), F.inline(found)).select("doc_id", "kind", "text", "label", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))
    return rows


def protected_spans(candidates: DataFrame) -> DataFrame:
    """Greedy choice per document: by (start, end, kind), spans that start inside the last kept one are dropped."""
    rows = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "text", "label"))).alias("xs"))
    kept = T.sweep(F.col("xs"), F.lit(-1), lambda last, x: (F.when(x["start"] >= last, x["end"]).otherwise(last), F.when(x["start"] >= last, x)), "struct<start:int,end:int,kind:string,text:string,label:string>")["out"]
    return rows.select("doc_id", F.posexplode(kept).alias("k", "s")).select("doc_id", (F.col("k") + 1).alias("span_no"), "s.kind", "s.start", "s.end", "s.text", "s.label")


def modality(kind: Column, t: Column) -> Column:
    return F.when(kind == "quotation", "reported").when(t.rlike(r"(?i)^(?:if)\b|\b(?:unless|when)\b"), "conditional").when(t.rlike(rf"(?i)\b(?:{'|'.join(L.MODALS)})\b"), "hedged").otherwise("asserted")


def negated(t: Column) -> Column:
    return t.rlike(rf"(?i)\b(?:{'|'.join(L.NEGATIONS)})\b")


def claims(spans: DataFrame) -> DataFrame:
    """One claim per span: doc_id, claim_no, proposition, modality, negation, span_no."""
    order = Window.partitionBy("doc_id").orderBy("span_no")
    return spans.select("doc_id", F.row_number().over(order).alias("claim_no"), F.col("text").alias("proposition"), modality(F.col("kind"), F.col("text")).alias("modality"), negated(F.col("text")).alias("negation"), "span_no")


def entities(claim_rows: DataFrame, citation_rows: DataFrame, most: int = 100, spans: DataFrame | None = None) -> DataFrame:
    """doc_id, entity_no, name, entity_type: capitalised phrases of claims, then authors of author-year citations.

    Names count once, at their first place; a name inside an author-year citation is a person. With spans (span_no,
    text), evidence lists the numbers of those that mention the name.
    """
    phrases = F.regexp_extract_all("proposition", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0))
    a = claim_rows.select("doc_id", F.col("claim_no").alias("o1"), F.posexplode(phrases).alias("o2", "name")).withColumn("o0", F.lit(0))
    authors = citation_rows.where("kind = 'author_year'")
    b = authors.select("doc_id", F.col("citation_no").alias("o1"), F.lit(0).alias("o2"), T.strip(F.substring_index("text", ",", 1)).alias("name"), F.lit(1).alias("o0")).where("name <> ''")
    first = a.unionByName(b).groupBy("doc_id", "name").agg(F.min(F.struct("o0", "o1", "o2")).alias("at"))
    texts = authors.groupBy("doc_id").agg(F.collect_set("text").alias("cited"))
    typed = first.join(texts, "doc_id", "left").withColumn("entity_type", F.when(F.exists(F.coalesce("cited", F.array().cast("array<string>")), lambda c: c.contains(F.col("name"))), "person").otherwise("other"))
    order = Window.partitionBy("doc_id").orderBy("at")
    rows = typed.withColumn("entity_no", F.row_number().over(order)).where(F.col("entity_no") <= most).select("doc_id", "entity_no", "name", "entity_type")
    if spans is None:
        return rows
    held = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("span_no", "text"))).alias("xs"))
    seen = F.transform(F.filter(F.coalesce("xs", F.array().cast("array<struct<span_no:int,text:string>>")), lambda s: s["text"].contains(F.col("name"))), lambda s: s["span_no"].cast("string"))
    return rows.join(held, "doc_id", "left").withColumn("evidence", F.array_join(seen, ",")).drop("xs")


def relationships(claim_rows: DataFrame, entity_rows: DataFrame, most: int = 200) -> DataFrame:
    """doc_id, relation_no, subject_no, predicate, object_no: the two earliest entities of a claim and what is between."""
    held = claim_rows.join(entity_rows, "doc_id").withColumn("at", F.call_function("locate", F.col("name"), F.col("proposition"))).where("at > 0")
    place = Window.partitionBy("doc_id", "claim_no", "at").orderBy("entity_no")
    held = held.withColumn("same", F.row_number().over(place)).where("same = 1")
    two = Window.partitionBy("doc_id", "claim_no").orderBy("at")
    held = held.withColumn("k", F.row_number().over(two)).where("k <= 2")
    pairs = held.groupBy("doc_id", "claim_no", "proposition").agg(
        F.max(F.when(F.col("k") == 1, F.struct("entity_no", "at", "name"))).alias("a"), F.max(F.when(F.col("k") == 2, F.struct("entity_no", "at", "name"))).alias("b")
    ).where("b IS NOT NULL")
    begin = F.col("a.at") + F.length("a.name")
    between = F.substring(F.col("proposition"), begin, F.greatest(F.col("b.at") - begin, F.lit(0)))
    pairs = pairs.withColumn("predicate", F.lower(T.strip(F.regexp_replace(between, rf"{T.SPACE}+", " ")))).where("predicate <> ''")
    order = Window.partitionBy("doc_id").orderBy("claim_no")
    return pairs.withColumn("relation_no", F.row_number().over(order)).where(F.col("relation_no") <= most).select("doc_id", "relation_no", F.col("a.entity_no").alias("subject_no"), "predicate", F.col("b.entity_no").alias("object_no"))


def exact_diff(source: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset diff of two tables by keys: keys, copy, state (preserved, omitted, added)."""
    numbered = lambda df: df.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).select(*keys, "copy")
    s, c = numbered(source).withColumn("s", F.lit(1)), numbered(candidate).withColumn("c", F.lit(1))
    state = F.when(F.col("s").isNull(), "added").when(F.col("c").isNull(), "omitted").otherwise("preserved")
    return s.join(c, [*keys, "copy"], "full").select(*keys, "copy", state.alias("state"))


def number_free(t: Column) -> Column:
    bare = F.regexp_replace(t, r"\$?\d[\d,]*(?:\.\d+)?(?:\s*(?:%|percent|pp)\b)?", "")
    return F.lower(T.strip(F.regexp_replace(bare, rf"{T.SPACE}+", " ")))


def negation_free(t: Column) -> Column:
    bare = F.regexp_replace(t, rf"(?i)\b(?:{'|'.join(L.NEGATIONS)})\b", "")
    return F.lower(T.strip(F.regexp_replace(bare, rf"{T.SPACE}+", " ")))


def numbers_of(t: Column) -> Column:
    found = F.regexp_extract_all(t, F.lit(r"\$?\d[\d,]*(?:\.\d+)?(?:\s*(?:%|percent|pp)\b)?"), F.lit(0))
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[ $,]", ""), "percent|pp", "%")
    return F.transform(found, plain)


def contradictions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges (doc_id, source_no, candidate_no, kind) between claims that differ in their numbers or their negation only."""
    s = left.select("doc_id", F.col("claim_no").alias("source_no"), F.col("proposition").alias("st"), F.col("negation").alias("sn"))
    c = right.select("doc_id", F.col("claim_no").alias("candidate_no"), F.col("proposition").alias("ct"), F.col("negation").alias("cn"))
    n = s.withColumn("key", number_free(F.col("st"))).join(c.withColumn("key", number_free(F.col("ct"))), ["doc_id", "key"])
    n = n.where((F.size(numbers_of(F.col("st"))) > 0) & (F.size(numbers_of(F.col("ct"))) > 0) & (numbers_of(F.col("st")) != numbers_of(F.col("ct"))))
    g = s.withColumn("key", negation_free(F.col("st"))).join(c.withColumn("key", negation_free(F.col("ct"))), ["doc_id", "key"]).where("sn <> cn")
    pick = lambda df, kind: df.select("doc_id", "source_no", "candidate_no", F.lit(kind).alias("kind"))
    return pick(n, "number").unionByName(pick(g, "negation")).distinct()


def _unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """The claims of left that no equal claim of right is left for; equal ones are matched one by one in order."""
    numbered = lambda df: df.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "proposition").orderBy("claim_no")))
    return numbered(left).join(numbered(right).select("doc_id", "proposition", "copy"), ["doc_id", "proposition", "copy"], "left_anti").drop("copy")


def contradicted_pairs(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """doc_id, source_no, candidate_no: of the claims that exact matching leaves over, each takes its first free contradiction."""
    return greedy_pairs(contradictions(_unmatched(source, candidate), _unmatched(candidate, source)))


def claim_diff(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """doc_id, preserved, omitted, added, contradicted, coverage per document of either version (counts).

    Coverage is known where the source has claims at all.
    """
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    # read several times: written once, not worked out by each
    source, candidate = materialize(source, "claims"), materialize(candidate, "claims")
    so, co = materialize(_unmatched(source, candidate), "open"), materialize(_unmatched(candidate, source), "open")
    pairs = n(greedy_pairs(contradictions(so, co)), "contradicted")
    rows = n(source, "ns").join(n(candidate, "nc"), "doc_id", "full").join(n(so, "so"), "doc_id", "left").join(n(co, "co"), "doc_id", "left").join(pairs, "doc_id", "left").na.fill(0)
    return rows.select("doc_id", (F.col("ns") - F.col("so")).alias("preserved"), (F.col("so") - F.col("contradicted")).alias("omitted"), (F.col("co") - F.col("contradicted")).alias("added"), "contradicted", F.when(F.col("ns") > 0, "known").otherwise("unknown_coverage").alias("coverage"))


def greedy_pairs(edges: DataFrame) -> DataFrame:
    """In order of the source, each takes its first free candidate: doc_id, source_no, candidate_no."""

    def match(group):
        taken, out = set(), []
        for source, rows in group.sort_values(["source_no", "candidate_no"]).groupby("source_no", sort=True):
            free = [c for c in rows.candidate_no if c not in taken]
            if free:
                taken.add(free[0])
                out.append((group.doc_id.iloc[0], source, free[0]))
        import pandas as pd

        return pd.DataFrame(out, columns=["doc_id", "source_no", "candidate_no"])

    return edges.select("doc_id", "source_no", "candidate_no").distinct().groupBy("doc_id").applyInPandas(match, "doc_id long, source_no int, candidate_no int")


#: Least sequence ratio of a match, and the ratio under which a match contradicts.
MATCHED, AGREES = 0.7, 0.9
#: Lengths whose ratio of two is over this can't reach MATCHED: 2 min / (a + b) > 0.7 means max < 1.3 / 0.7 min.
_BAND = (2 - MATCHED) / MATCHED


def _marked(t: Column) -> Column:
    """The letters of a text, each with its how-manieth of its kind it is: two texts share as many of these as letters."""
    letters = F.sort_array(F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))))
    numbered = T.bound(letters, lambda xs: F.transform(xs, lambda x, i: F.struct(x["c"].alias("c"), i.alias("i"))))
    first = T.bound(letters, lambda xs: F.filter(F.transform(xs, lambda x, i: F.struct(x["c"].alias("c"), i.alias("i"), ((i == 0) | (F.get(xs, i - 1)["c"] != x["c"])).alias("new"))), lambda x: x["new"]))
    # the letters in order, less where their kind begins
    return T.bound(F.map_from_entries(F.transform(first, lambda x: F.struct(x["c"], x["i"]))), lambda m: F.transform(numbered, lambda x: F.concat(x["c"], (x["i"] - F.try_element_at(m, x["c"])).cast("string"))))


def similar_texts(source: DataFrame, candidate: DataFrame, keys: tuple[str, ...] = ("doc_id", "category")) -> DataFrame:
    """keys, s, c, ratio of pairs of texts of source and candidate (keys, text) with a sequence ratio over MATCHED.

    Each distinct text of a key counts once. Pairs meet by bands of lengths, and only those whose lengths and common
    letters allow the ratio go to Python, pair by pair in Arrow batches, whatever document they are from; equal texts
    never do.
    """
    band = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / F.log(F.lit(_BAND))).cast("int")
    one = lambda df, name: df.select(*keys, F.col("text").alias(name)).distinct().withColumn(f"{name}_marked", _marked(F.col(name)))
    s = one(source, "s").withColumn("band", F.explode(F.array(*[band("s") + k for k in (-1, 0, 1)])))
    c = one(candidate, "c").withColumn("band", band("c"))
    total = F.length("s") + F.length("c")
    able = (2 * F.least(F.length("s"), F.length("c")) > MATCHED * total) & (2 * F.size(F.array_intersect("s_marked", "c_marked")) > MATCHED * total)
    met = s.join(c, [*keys, "band"]).where((F.col("s") != F.col("c")) & able).select(*keys, "s", "c")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    both = source.select(*keys, "text").distinct().join(candidate.select(*keys, "text").distinct(), [*keys, "text"])
    equal = both.select(*keys, F.col("text").alias("s"), F.col("text").alias("c"), F.lit(1.0).alias("ratio"))
    return equal.unionByName(met.withColumn("ratio", ratio("s", "c")).where(F.col("ratio") > MATCHED))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many anchors match and contradict, per document and category; one row at a time, groups following each other.

    A group's rows (side, seq, text, ratio) are the candidate's anchors (0) in order, then, in order of the source, each
    anchor's (1) texts that it may match. Only a group's places are kept, never its pairs.
    """
    group, at, best = None, None, None
    places: dict[str, list[int]] = {}
    used: dict[str, int] = {}
    matched = contradicted = 0
    done: list[tuple[int, int, int]] = []

    def settle() -> None:
        nonlocal best, matched, contradicted
        if best is not None:
            used[best[2]] += 1
            matched += 1
            contradicted += -best[0] < AGREES
        best = None

    def table() -> pa.RecordBatch:
        out = [pa.array(x, pa.int64()) for x in zip(*done)]
        done.clear()
        return pa.RecordBatch.from_arrays(out, ["doc_id", "matched", "contradicted"])

    for batch in batches:
        for doc, category, side, seq, text, r in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            if (doc, category) != group:
                settle()
                if matched:
                    done.append((group[0], matched, contradicted))
                group, at, places, used, matched, contradicted = (doc, category), None, {}, {}, 0, 0
            if side == 0:
                places.setdefault(text, []).append(seq)
                used[text] = 0
                continue
            if seq != at:
                settle()
                at = seq
            # the highest ratio, of equal ones the first in the candidate's order
            if used[text] < len(places[text]):
                offer = (-r, places[text][used[text]], text)
                best = offer if best is None else min(best, offer)
        if done:
            yield table()
    settle()
    if matched:
        done.append((group[0], matched, contradicted))
    if done:
        yield table()


def fact_diff(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """Greedy fuzzy diff of anchors (doc_id, seq, category, text) per document: omissions, additions, contradictions, preservation.

    In order of the source, an anchor takes the free candidate of its category with the highest sequence ratio above
    0.7, of equal ones the first; under 0.9 the two contradict. Equal texts have the highest ratio, so a category of which
    the candidate has every anchor of the source as often is settled by counting: each takes one that is equal to it. Of the others
    similar_texts() finds the pairs that may match, and one pass over the sorted pairs keeps the order.
    """
    return _fact_diff(materialize(source, "anchors"), materialize(candidate, "anchors"))


def _fact_diff(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """fact_diff() of written tables: each is read several times."""
    keys = ["doc_id", "category"]
    sided = lambda df, s: df.select(*keys, F.lower("text").alias("text"), F.lit(s).alias("s"), F.lit(1 - s).alias("c"))
    texts = sided(source, 1).unionByName(sided(candidate, 0)).groupBy(*keys, "text").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    kinds = texts.groupBy(*keys).agg(F.sum("s").alias("n_source"), F.sum("c").alias("n_candidate"), F.sum(F.greatest(F.col("s") - F.col("c"), F.lit(0))).alias("lacking"))
    kinds = materialize(kinds, "facts")
    open_ = kinds.where("lacking > 0 AND n_candidate > 0").select(*keys)
    part = lambda df: df.join(open_, keys, "left_semi").select(*keys, "seq", F.lower("text").alias("text"))
    s, c = materialize(part(source), "open"), materialize(part(candidate), "open")
    pairs = similar_texts(s, c).select(F.col("doc_id").alias("doc_id"), F.col("category").alias("category"), F.col("s").alias("text"), "c", "ratio")
    offers = s.join(pairs, [*keys, "text"]).select(*keys, F.lit(1).alias("side"), "seq", F.col("c").alias("text"), "ratio")
    # written before it is dealt out: a join below that turns into a broadcast would leave the dealing out
    rows = materialize(offers.unionByName(c.select(*keys, F.lit(0).alias("side"), "seq", "text", F.lit(None).cast("double").alias("ratio"))), "offers")
    done = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "seq").mapInArrow(_matched, "doc_id long, matched long, contradicted long")
    sums = done.groupBy("doc_id").agg(F.sum("matched").alias("matched"), F.sum("contradicted").alias("contradicted"))
    settled = F.sum(F.when(F.col("lacking") == 0, F.col("n_source")).otherwise(0))
    whole = kinds.groupBy("doc_id").agg(F.sum("n_source").alias("n_source"), F.sum("n_candidate").alias("n_candidate"), settled.alias("settled")).join(sums, "doc_id", "left")
    hit = F.col("settled") + F.coalesce("matched", F.lit(0))
    kept = F.when(F.col("n_source") == 0, 1.0).otherwise(F.round(hit / F.col("n_source"), 4))
    return whole.select("doc_id", "n_source", "n_candidate", (F.col("n_source") - hit).alias("omissions"), (F.col("n_candidate") - hit).alias("additions"), F.coalesce("contradicted", F.lit(0)).alias("contradictions"), kept.alias("preservation"))


def revalidated(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, ok, findings: whether two versions of documents (doc_id, text) have the same facts and citations.

    Findings show counts only: fact_anchor_drift where anchors are lost, new or contradict, citation_drift where the
    citations, in order, aren't the same. Texts that are equal have the same ones and aren't looked at.
    """
    both = before.select("doc_id", "text").join(after.select("doc_id", F.col("text").alias("new")), "doc_id", "left")
    both = materialize(both.where(~F.col("text").eqNullSafe(F.col("new"))), "changed")
    a, b = materialize(anchor_items(both.select("doc_id", "text")), "anchors"), materialize(anchor_items(both.select("doc_id", F.col("new").alias("text"))), "anchors")
    facts = _fact_diff(a, b).withColumn("fact", F.when(F.col("omissions") + F.col("additions") + F.col("contradictions") > 0, F.format_string("fact_anchor_drift:omissions=%d,additions=%d,contradictions=%d", "omissions", "additions", "contradictions")))
    cited = lambda df, name: df.where("category = 'citation'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias(name))
    none = F.array().cast("array<string>")
    rows = before.select("doc_id").join(facts.select("doc_id", "fact"), "doc_id", "left").join(cited(a, "ca"), "doc_id", "left").join(cited(b, "cb"), "doc_id", "left")
    x, y = F.coalesce("ca.text", none), F.coalesce("cb.text", none)
    rows = rows.withColumn("cite", F.when(x != y, F.format_string("citation_drift:expected=%d,current=%d", F.size(x), F.size(y))))
    return rows.select("doc_id", (F.col("fact").isNull() & F.col("cite").isNull()).alias("ok"), F.concat_ws(";", "fact", "cite").alias("findings"))
