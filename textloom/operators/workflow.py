"""Whole steps made of the single operators: invariants, capsules, node-safe edits, ingest counts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import evidence as E
from textloom.operators import lexical as X
from textloom.operators import profiles as P
from textloom.operators import review as V
from textloom.operators.intervals import contained
from textloom.sources.store import materialize

EDITABLE = ("paragraph", "sentence", "text_run", "list_item", "table_cell")


def node_safe(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changes (doc_id, offset, length) with safe: inside one node whose kind may be edited."""
    n = nodes.where(F.col("node_type").isin(*EDITABLE)).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    own = changes.select("doc_id", "offset", "length", (F.col("offset") + F.col("length")).alias("end"))
    held = contained(own, n, left_range=("offset", "end")).select("doc_id", "offset", "length").distinct().withColumn("safe", F.lit(True))
    return changes.join(held, ["doc_id", "offset", "length"], "left").withColumn("safe", F.coalesce("safe", F.lit(False)))


def capsules(nodes: DataFrame, claims: DataFrame, citations: DataFrame, spans: DataFrame, entities: DataFrame, invariants: DataFrame, tendencies: DataFrame, most: int = 50, most_style: int = 20) -> DataFrame:
    """Per document what all its blocks' contexts share, once: doc_id and arrays.

    claims, spans and entities: the first `most` by number; open_loops: the propositions of all claims that are still open
    (extracted ones all are); citations: all; invariants and tendencies of style: the first most_style by kind; prohibited: the
    parts of the prohibited phrases, each once; untrusted: nodes (authorship_class) that were assisted, then spans
    (status) that are excluded. Documents are those of the nodes (doc_id, node_no, ...).
    """
    def listed(rows: DataFrame, order: str, value: Column, name: str, limit: int | None = None) -> DataFrame:
        kept = rows.select("doc_id", F.col(order).alias("o"), value.alias("v")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("o", "v"))).alias("x"))
        xs = F.transform("x", lambda x: x["v"])
        return kept.select("doc_id", (xs if limit is None else F.slice(xs, 1, limit)).alias(name))

    first = lambda rows, order: rows.where(F.col(order) <= most)
    named = lambda kind: F.concat_ws("=", kind, "value")
    of = lambda label, no: F.concat(F.lit(f"{label}:"), F.col(no).cast("string"))
    nothing = lambda df: df.limit(0)
    assisted = nodes.where("authorship_class = 'ai_assisted'") if "authorship_class" in nodes.columns else nothing(nodes)
    excluded = spans.where("status = 'EXCLUDED'") if "status" in spans.columns else nothing(spans)
    labels = assisted.select("doc_id", F.struct(F.lit(0).alias("k"), F.col("node_no").alias("no")).alias("o"), of("ai_assisted", "node_no").alias("v")).unionByName(excluded.select("doc_id", F.struct(F.lit(1).alias("k"), F.col("span_no").alias("no")).alias("o"), of("excluded_span", "span_no").alias("v")))
    phrases = invariants.where("kind = 'prohibited_phrases'").select("doc_id", F.posexplode(F.split("value", r"\|")).alias("o", "v")).withColumn("v", T.strip(F.col("v"))).where("v <> ''")
    parts = (
        listed(first(claims, "claim_no"), "claim_no", F.col("proposition"), "claims"), listed(claims, "claim_no", F.col("proposition"), "open_loops"), listed(first(spans, "span_no"), "span_no", F.concat_ws(":", "kind", "text"), "spans"),
        listed(citations, "citation_no", F.col("text"), "citations"), listed(first(entities, "entity_no"), "entity_no", F.col("name"), "entities"), listed(invariants, "kind", named("kind"), "invariants", most_style),
        listed(tendencies, "name", named("name"), "tendencies", most_style), listed(phrases.groupBy("doc_id", "v").agg(F.min("o").alias("o")), "o", F.col("v"), "prohibited"), listed(labels, "o", F.col("v"), "untrusted"),
    )
    rows = nodes.select("doc_id").distinct()
    for part in parts:
        rows = rows.join(part, "doc_id", "left")
    return rows.select("doc_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in CAPSULE_LISTS])


CAPSULE_LISTS = ("claims", "open_loops", "spans", "citations", "entities", "invariants", "tendencies", "prohibited", "untrusted")


def capsule_blocks(contexts: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Per block: doc_id, node_no, capsule_id, text, before, after, heading, first; its document's lists are in documents.

    contexts: what block_contexts() gives of the nodes, where it keeps their text without a join of blocks; documents: what capsules() gives. The id is made of the block, its
    surroundings and a digest of the document's lists, so it changes with any of them, and the lists stay with the document.
    """
    digest = F.sha2(F.concat_ws("\x00", *[F.concat_ws("\x01", c) for c in CAPSULE_LISTS]), 256)
    rows = contexts if "text" in contexts.columns else contexts.join(nodes.select("doc_id", "node_no", "text"), ["doc_id", "node_no"])
    # blocks stay where their document's contexts were made: only the documents' digests come to them
    rows = rows.join(documents.select("doc_id", digest.alias("lists")), "doc_id")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "node_no", "text", "before", "after", "heading", "first", "lists")]
    capsule = F.concat(F.lit("cap-"), F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 24))
    return rows.select("doc_id", "node_no", capsule.alias("capsule_id"), "text", "before", "after", "heading", "first")


def ingest_counts(docs: DataFrame, ingested: DataFrame, **parts: DataFrame) -> DataFrame:
    """table, n of what an ingest of the documents not ingested yet would write."""
    new = docs.select("doc_id").distinct().join(ingested.select("doc_id"), "doc_id", "left_anti")
    out = new.agg(F.count("*").alias("n")).select(F.lit("documents").alias("table"), "n")
    for name, rows in parts.items():
        out = out.unionByName(rows.join(new, "doc_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n"))
    return out


def manifest_problems(samples: DataFrame, present: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """sample_id, problem of a corpus manifest: unknown groups, repeated ids, files that aren't there."""
    bad = samples.where(~F.col("grp").isin(*groups)).select("sample_id", F.lit("group").alias("problem"))
    twice = samples.groupBy("sample_id").count().where("count > 1").select("sample_id", F.lit("repeated").alias("problem"))
    gone = samples.join(present, "file", "left_anti").select("sample_id", F.lit("missing").alias("problem"))
    return bad.unionByName(twice).unionByName(gone)


#: Parts of names that tell of text.
TEXT_NAMES = ("text", "content", "prompt", "input", "source", "style", "output", "response", "message")


def text_free(json: Column) -> Column:
    """Whether a JSON value holds no text, at any depth: no telling names, no strings over 64 characters or with white space.

    Null is free of text; what is no JSON isn't.
    """
    # every string with what shows that it is a name: its colon
    strings = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\\\]|\\\\.)*"(?:\s*:)?'.replace("\\\\", "\\")), F.lit(0))
    plain = lambda x: F.get_json_object(F.concat(F.lit('{"v":'), F.regexp_replace(x, r"\s*:$", ""), F.lit("}")), "$.v")
    telling = F.exists(F.filter(strings, lambda x: x.endswith(":")), lambda x: F.lower(plain(x)).rlike("|".join(TEXT_NAMES)))
    loose = F.exists(F.filter(strings, lambda x: ~x.endswith(":")), lambda x: (F.length(plain(x)) > 64) | plain(x).rlike(r"(?U)\s"))
    return F.when(json.isNull(), True).when(F.try_parse_json(json).isNull(), False).otherwise(~telling & ~loose)


def finalized(bases: DataFrame, changes: DataFrame, decisions: DataFrame, nodes: DataFrame, spans: DataFrame, revisions: DataFrame, profile: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """doc_id, gate, passed of the gates between reviewed changes and a new accepted revision, in their order.

    bases: (doc_id, source, text, base_token), the accepted text that the changes (doc_id, offset, length, surface,
    target) were proposed on. review: every decision is on a known change, and none is repeated. node_safe: accepted
    changes lie inside one editable node each. rebase: no protected span is touched, and each still has its text at
    its new place. facts: anchors and citations stay. structure: headings and node types stay. style: the source's
    profile is complete and no invariant is violated (passed where there is no profile). revision: the base is still
    the accepted head. accepted: all of them.
    """
    # every gate looks at these: written once, not worked out by each
    changes = materialize(changes, "changes")
    accepted = materialize(X.review(changes, decisions), "accepted")
    after, spans = materialize(X.apply_changes(bases, accepted), "after"), materialize(spans, "spans")
    names = bases.select("doc_id")
    bad = {
        "review": X.review_problems(changes, decisions).select("doc_id"),
        "node_safe": node_safe(accepted.select("doc_id", "offset", "length"), nodes).where("NOT safe").select("doc_id"),
        "rebase": rebase_problems(X.rebase(spans, accepted), spans, after),
        "facts": E.revalidated(bases.select("doc_id", "text"), after).where("NOT ok").select("doc_id"),
        "structure": V.structure_drift(line_structure(after), line_structure(bases)).select("doc_id"),
    }
    if profile is not None:
        texts = after.join(bases.select("doc_id", "source"), "doc_id")
        bad["style"] = P.violating(texts, profile)
        if coverage is not None:
            bad["style"] = bad["style"].unionByName(bases.join(coverage.where("status = 'complete'").select("source"), "source", "left_anti").select("doc_id"))
    heads = revisions.where("status = 'accepted'").groupBy(F.col("document_id").alias("doc_id")).agg(F.max("token").alias("head"))
    bad["revision"] = bases.join(heads, "doc_id", "left").where("head IS NULL OR head <> base_token").select("doc_id")
    failed = None
    for gate, rows in bad.items():
        one = rows.select("doc_id", F.lit(gate).alias("gate"))
        failed = one if failed is None else failed.unionByName(one)
    per = failed.groupBy("doc_id").agg(F.collect_set("gate").alias("failed"))
    rows = names.join(per, "doc_id", "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))
    one = lambda g: F.struct(F.lit(g).alias("gate"), (~F.array_contains("failed", g)).alias("passed"))
    return rows.select("doc_id", F.inline(F.array(*map(one, bad), F.struct(F.lit("accepted").alias("gate"), (F.size("failed") == 0).alias("passed")))))


def rebase_problems(rebased: DataFrame, spans: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id of documents with a span that an edit touches, or whose text isn't at its new place."""
    was = spans.select("doc_id", "span_no", F.col("start").alias("s"), F.col("end").alias("e"), F.col("text").alias("was"))
    rows = rebased.join(was.select("doc_id", "span_no", "was", (F.col("e") - F.col("s")).alias("n")), ["doc_id", "span_no"])
    near = rows.groupBy("doc_id").agg(F.bool_or("overlap").alias("overlap"), F.collect_list(F.struct("start", "n", "was")).alias("xs"))
    placed = near.join(after.select("doc_id", "text"), "doc_id")
    moved = F.exists("xs", lambda x: ~F.contains(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["n"].cast("int")), x["was"]))
    return placed.where(F.col("overlap") | moved).select("doc_id")


def line_structure(docs: DataFrame) -> DataFrame:
    """doc_id, headings, signature of texts whose nodes are lines: Markdown headings, and a digest of the kinds of lines."""
    lines = F.filter(F.split("text", "\n"), lambda x: T.strip(x) != "")
    heading = lambda x: x.rlike(r"^ {0,3}#{1,6}\s")
    kinds = F.transform(lines, lambda x: F.when(heading(x), F.concat(F.lit("heading"), F.lit("\x00"), x)).otherwise("paragraph"))
    return docs.select("doc_id", F.filter(lines, heading).alias("headings"), F.sha2(F.array_join(kinds, "\x00"), 256).alias("signature"))
