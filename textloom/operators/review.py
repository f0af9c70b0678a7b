"""Review of imported documents: authorship spans, coverage, contexts of blocks, gates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.lexical import phrase_hits

TEXT_NODES = ("paragraph", "heading", "list_item", "table_cell", "quotation")


def authorship_spans(nodes: DataFrame) -> DataFrame:
    """doc_id, span_no, node_no, state: one span per place, a quotation winning; quotations are resolved, others not.

    nodes: (doc_id, node_no, node_type, start, end). The span keeps the place of the first node there.
    """
    rows = nodes.where(F.col("node_type").isin(*TEXT_NODES))
    place = Window.partitionBy("doc_id", "start", "end")
    best = F.row_number().over(place.orderBy(F.desc(F.col("node_type") == "quotation"), "node_no"))
    rows = rows.withColumns({"best": best, "slot": F.min("node_no").over(place)}).where("best = 1")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("slot"))
    return rows.select("doc_id", number.alias("span_no"), "node_no", F.when(F.col("node_type") == "quotation", "resolved").otherwise("unknown").alias("state"))


def coverage(spans: DataFrame, least_words: int = 1000) -> DataFrame:
    """Per package: coverage of the text and of its structure, unresolved spans, status, sufficiency, voice words.

    spans: (package_id, class, resolved, words, unsupported); unsupported names a feature that the import couldn't
    keep, or is null. Open spans and such features need a person; a sample without enough words of the author's own
    is partial.
    """
    rows = spans.groupBy("package_id").agg(
        F.count_if(~is_resolved()).alias("unresolved"), F.coalesce(F.sum(F.when(is_voice(), F.col("words"))), F.lit(0)).alias("words"),
        F.sort_array(F.collect_set("unsupported")).alias("features"), (F.sum("words") > 0).cast("double").alias("text_coverage"),
    )
    rows = rows.withColumns({"structure_coverage": F.when(F.size("features") > 0, 0.0).otherwise(1.0), "sufficiency": F.when(F.col("words") >= least_words, "sufficient").otherwise("insufficient")})
    return rows.select("package_id", "text_coverage", "structure_coverage", "unresolved", F.array_join("features", ",").alias("features"), _status("unresolved > 0 OR size(features) > 0", (F.col("sufficiency") == "sufficient") & (F.col("text_coverage") == 1.0)).alias("status"), "sufficiency", "words")


def _status(open_: str, whole: Column) -> Column:
    return F.when(F.expr(open_), "human_review_required").when(whole, "complete").otherwise("partial")


#: Classes of authorship that may speak for the author.
VOICE = ("authentic_user_prose", "user_revision")


def is_resolved() -> Column:
    return F.col("resolved") & (F.col("class") != "unknown")


def is_voice() -> Column:
    return is_resolved() & F.col("class").isin(*VOICE)


def voice_texts(spans: DataFrame) -> DataFrame:
    """package_id, text: the package's approved voice, its eligible spans (span_no, text, class, resolved) in order.

    Packages without any have no row. A package is one document, so its spans fit in a row.
    """
    rows = spans.where(is_voice()).groupBy("package_id").agg(F.sort_array(F.collect_list(F.struct("span_no", "text"))).alias("x"))
    return rows.select("package_id", F.array_join("x.text", "\n\n").alias("text"))


def profile_coverage(packages: DataFrame, least_words: int = 1000) -> DataFrame:
    """Per profile, closed on failure: the least coverages, all open spans, all features, the worst status.

    Sufficiency is judged again by the words of all packages together, and the status follows it; it never becomes
    complete while something is open. packages: (profile and what coverage() gives).
    """
    rows = packages.groupBy("profile").agg(
        F.min("text_coverage").alias("text_coverage"), F.min("structure_coverage").alias("structure_coverage"), F.sum("unresolved").alias("unresolved"), F.sum("words").alias("words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("features", ","), lambda x: x != ""))))).alias("features"),
        F.bool_or(F.col("status") == "partial").alias("partial"), F.bool_or(F.col("sufficiency") == "insufficient").alias("short"),
    )
    open_, enough = "unresolved > 0 OR size(features) > 0", F.col("words") >= least_words
    by_packages = F.when(F.expr(open_), "human_review_required").when(F.col("partial"), "partial").otherwise("complete")
    status = (
        F.when(F.col("short") & enough, _status(open_, F.col("text_coverage") == 1.0))
        .when(~F.col("short") & ~enough & (by_packages == "complete"), "partial").otherwise(by_packages)
    )
    return rows.select("profile", "text_coverage", "structure_coverage", "unresolved", F.array_join("features", ",").alias("features"), status.alias("status"), F.when(enough, "sufficient").otherwise("insufficient").alias("sufficiency"), "words")


def block_contexts(nodes: DataFrame, reach: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, node_no, before, after, heading, first: neighbours' texts, the nearest heading above, the first block; and columns to keep."""
    rows = nodes.where(F.col("text") != "")
    order = Window.partitionBy("doc_id").orderBy("node_no")
    near = lambda a, b: F.array_join(F.collect_list("text").over(order.rowsBetween(a, b)), " | ")
    above = F.last(F.when(F.col("node_type") == "heading", F.col("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("doc_id", "node_no", *keep, near(-reach, -1).alias("before"), near(1, reach).alias("after"), above.alias("heading"), first.alias("first"))


def repair_decisions(pairs: DataFrame, attempts: int = 3, least: float = 0.85, most_modifications: int = 10) -> DataFrame:
    """pair_id, decision from (pair_id, attempt, modifications, preservation, omissions, contradictions, additions).

    The last attempt and too many modifications fail, whatever was preserved.
    """
    fail = (F.col("attempt") >= attempts) | (F.col("modifications") > most_modifications)
    accept = (F.col("preservation") >= least) & (F.col("omissions") <= 1) & (F.col("contradictions") + F.col("additions") == 0)
    return pairs.select("pair_id", F.when(fail, "fail").when(accept, "accept").otherwise("repair").alias("decision"))


def finding_rollup(findings: DataFrame) -> DataFrame:
    """source, code, n with subtotals: nulls stand for all."""
    return findings.rollup("source", "code").agg(F.count("*").alias("n"))


def structure_drift(current: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, finding where two versions' structures (doc_id, headings, signature) differ.

    Other headings: the first index at which they differ, from 0. Same headings but another digest: that.
    """
    c = current.select("doc_id", F.col("headings").alias("c"), F.col("signature").alias("cs"))
    rows = c.join(expected.select("doc_id", F.col("headings").alias("e"), F.col("signature").alias("es")), "doc_id")
    differs = F.filter(F.transform(F.arrays_zip("c", "e"), lambda x, i: F.when(~x["c"].eqNullSafe(x["e"]), i)), lambda i: i.isNotNull())
    first = F.least(F.coalesce(F.get(differs, F.lit(0)), F.least(F.size("c"), F.size("e"))), F.size("c"), F.size("e"))
    finding = F.when(F.col("c") != F.col("e"), F.concat(F.lit("structure_section_order_drift:first_diff_index="), first.cast("string"))).when(F.col("cs") != F.col("es"), "structure_signature_drift:same_section_order")
    return rows.select("doc_id", finding.alias("finding")).where("finding IS NOT NULL")


def routed(triggers: DataFrame, routes: DataFrame) -> DataFrame:
    """trigger_id, source: every source of a trigger's kind; unknown kinds have none. routes: (kind, sources)."""
    return triggers.join(routes, "kind", "left").select("trigger_id", F.explode_outer(F.coalesce("sources", F.array().cast("array<string>"))).alias("source"))


#: What each privacy mode lets pass. Raw text is never logged, and notes are never written unasked.
PRIVACY_FLAGS = ("network_allowed", "detector_cache_enabled", "retention_enforced", "encrypt_sensitive_fields")
PRIVACY_MODES = {"strict_local": (False, False, True, True), "private_audited": (True, True, False, False), "regulated": (True, False, True, True)}


def privacy_flags(events: DataFrame) -> DataFrame:
    """events (mode, ...) with the mode's flags; an unknown mode has none (null)."""
    at = lambda k: F.try_element_at(F.create_map(*[x for m, f in PRIVACY_MODES.items() for x in (F.lit(m), F.lit(f[k]))]), F.col("mode"))
    fixed = F.when(at(0).isNotNull(), False)
    return events.withColumns({n: at(k) for k, n in enumerate(PRIVACY_FLAGS)} | {"raw_text_logging": fixed, "obsidian_projection_auto": fixed})


def privacy_violations(events: DataFrame) -> DataFrame:
    """event_id, code of uses that their mode forbids. events: (event_id, mode, network, cache: whether it would use them)."""
    rows = privacy_flags(events)
    found = F.array_compact(F.array(F.when(F.col("network") & ~F.col("network_allowed"), "network_use_forbidden"), F.when(F.col("cache") & ~F.col("detector_cache_enabled"), "cache_use_forbidden"), F.when(F.col("network_allowed").isNull(), "unknown_mode")))
    return rows.select("event_id", F.explode(found).alias("code"))


#: Terms that edits leave alone.
PROTECTED_TERMS = {
    "general": ("GDPR", "ISO", "URL", "API", "ASCII", "UTF-8", "Unicode", "PDF", "DOCX", "Markdown", "Obsidian", "GitHub"),
    "legal": (
        "force majeure", "habeas corpus", "prima facie", "quantum meruit", "res judicata", "caveat emptor", "due diligence", "fiduciary duty", "attorney-client privilege",
        "statute of limitations", "burden of proof", "tort", "plaintiff", "defendant", "subpoena", "injunction", "negligence", "arbitration", "jurisdiction", "precedent",
    ),
    "medical": (
        "tachycardia", "arrhythmia", "hypertension", "hypotension", "anemia", "diabetes", "epilepsy", "melanoma", "thrombosis", "ischemia", "edema", "sepsis", "aneurysm",
        "embolism", "osteoporosis", "arthritis", "asthma", "bronchitis",
    ),
}


def gazetteer_hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, domain, term, n of whole-phrase, case-blind occurrences of terms (domain, term) of any number of words.

    Words are runs of letters and digits, so marks between them don't matter. A term without words is never found.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    known = terms.select("domain", "term", words(F.col("term")).alias("keys")).distinct()
    held = phrase_hits(docs.select("doc_id", words(F.col("text")).alias("keys")), known)
    return held.select("doc_id", F.inline("hits")).groupBy("doc_id", "domain", "term").agg(F.count("*").alias("n"))


def described(fingerprints: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, description: a fingerprint in words, one line per trait.

    fingerprints: what metrics.fingerprint() gives; phrases: (doc_id, rank, phrase), of which the first five are named.
    """
    top = phrases.where("rank <= 5").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "phrase"))).alias("p"))
    rows = fingerprints.join(top, "doc_id", "left")
    f, some = F.col("formality"), F.col("total_words") > 0
    tenths = lambda c: T.tenths(F.round(F.round(c, 6), 2))
    marks = F.array_compact(F.array(
        F.when(F.col("r_comma") > 0.01, "frequent comma use"), F.when(F.col("r_semicolon") > 0.001, "semicolon use"),
        F.when(F.col("r_dash") > 0.0005, "em-dash use"), F.when(F.col("r_question") > 0.001, "rhetorical questions"),
    ))
    lines = F.array_compact(F.array(
        F.when(some, F.concat(F.lit("Average sentence length: "), tenths("avg_sentence_length"), F.lit(" words (variance: "), tenths("sentence_length_variance"), F.lit(")"))),
        F.when(some, F.concat(F.lit("Average word length: "), tenths("avg_word_length"), F.lit(" characters"))), F.when(some, F.format_string("Vocabulary richness: %.2f%%", F.round(F.round("vocabulary_richness", 6), 4) * 100)),
        F.when(F.col("total_paragraphs") > 0, F.concat(F.lit("Average paragraph length: "), tenths("avg_paragraph_length"), F.lit(" sentences"))),
        F.when(f > 0.6, "Tone: formal and academic").when(f > 0.3, "Tone: neutral and balanced").otherwise("Tone: casual and conversational"),
        F.when(F.col("p").isNotNull(), F.concat(F.lit("Common phrases: "), F.array_join("p.phrase", ", "))), F.when(F.size(marks) > 0, F.concat(F.lit("Punctuation style: "), F.array_join(marks, ", "))),
    ))
    return rows.select("doc_id", F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n").alias("description"))
