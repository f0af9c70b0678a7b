"""Cleaning and auditing of texts: stray markers, line ends, Unicode state, active content, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as T

BOM = "﻿"
# Patterns that the definitions name, with their category.
TAGS = (
    (r"(?imd)\[Model:\s*[^\]]+\]", "model_tag"),
    (r"(?imd)\[AI\s*[Gg]enerated[^\]]*\]", "ai_tag"),
    (r"(?imd)\[Provenance:[^\]]+\]", "provenance"),
    (r"(?imd)^\s*[-*]+\s*AI\s*[-*]+\s*$", "ai_separator"),
    (r"(?imd)Generated by\s+\S+", "gen_by"),
)
TELEMETRY = (r'"request_id":\s*"[^"]*"', r'"model_version":\s*"[^"]*"', r'"generated_at":\s*"[^"]*"')
JSON_WRAPPER = r'^\s*\{\s*"[^"]+"\s*:\s*"'
REDACTIONS = (
    (r"(?:sk|pk|rk)-(?:live|test)?[A-Za-z0-9_-]{20,}", "<REDACTED_KEY>"),
    (r"ghp_[A-Za-z0-9]{20,}", "<REDACTED_GH_TOKEN>"),
    (r"xox[baprs]-[A-Za-z0-9-]{20,}", "<REDACTED_SLACK>"),
    (r"AKIA[0-9A-Z]{16}", "<REDACTED_AWS_KEY>"),
    (r"Authorization:\s*Bearer\s+[A-Za-z0-9_\-\.]+", "Authorization: Bearer <REDACTED>"),
    (r"Bearer\s+[A-Za-z0-9_\-\.]+", "Bearer <REDACTED>"),
    (r"api[_-]?key[=:]\s*[^\s,;}]+", "api_key=<REDACTED>"),
    (r"://[^:@\s]+:[^@\s]+@", "://<REDACTED_CREDENTIALS>@"),
)
#: Parts of key names that tell of secrets; names are looked at without "_" and "-".
SECRET_NAMES = ("api_key", "apikey", "secret", "password", "token", "credential", "authorization")
ACTIVE = (
    ("html_script", r"(?i)<script\b"),
    ("html_event_handler", r"(?i)<[^>]{0,4096}\bon[a-z]+\s*="),
    ("javascript_link", r"(?i)javascript:"),
    ("vbscript_link", r"(?i)vbscript:"),
    ("data_uri", r"(?i)data:[a-z0-9+/._-]*;base64"),
    ("iframe", r"(?i)<iframe\b"),
    ("embed_object", r"(?i)<object\b|<embed\b"),
    ("file_link", r"(?i)file://"),
    ("remote_resource", r"""(?m)(?:!\[[^\]]*\]\(\s*|\[[^\]]*\]\(\s*|^\s{0,3}\[[^\]]+\]:\s*<?|<img\b[^>]*?src\s*=\s*["']\s*|<)(?:https?://|//)"""),
)
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"

#: Blanks that fall away at the end of a line.
BLANK, AT_END = r"[ \t\x0B\f\r\x1c-\x1f\x85\xa0  -     　]", r"(?=\n|\z)"


def _trailing(c: Column) -> Column:
    """Every line without blanks at its end."""
    return F.regexp_replace(c, rf"{BLANK}+{AT_END}", "")


def scrubbed(docs: DataFrame) -> DataFrame:
    """docs with cleaned (the text after nine ordered steps), categories (steps that fired) and modifications."""
    state = F.struct(F.col("text").alias("t"), F.array().cast("array<string>").alias("found"))

    def bound(value: Column, f) -> Column:
        """f of a value that is worked out once: the value becomes a lambda's variable."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def step(state: Column, category: str, fires, change) -> Column:
        def run(s: Column) -> Column:
            fired = F.coalesce(fires(s["t"]), F.lit(False))
            found = F.when(fired, F.concat(s["found"], F.array(F.lit(category)))).otherwise(s["found"])
            return F.struct(F.when(fired, change(s["t"])).otherwise(s["t"]).alias("t"), found.alias("found"))

        return bound(state, run)

    def unwrapped(t: Column) -> Column:
        inner = F.regexp_extract(t, r':\s*"((?:[^"\\]|\\.)*)"', 1)
        plain = F.replace(F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
        return F.when(t.rlike(r':\s*"((?:[^"\\]|\\.)*)"'), plain).otherwise(t)

    def unfenced(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(T.strip(t), r"\A```[a-zA-Z]*\s*\n", ""), r"\n```\s*\z", "")

    state = step(state, "bom", lambda t: t.startswith(BOM), lambda t: F.substring(t, 2, 2**31 - 1))
    state = step(state, "json_wrapper", lambda t: t.rlike(JSON_WRAPPER), unwrapped)
    for pattern, category in TAGS:
        state = step(state, category, lambda t, p=pattern: t.rlike(p), lambda t, p=pattern: F.regexp_replace(t, p, ""))
    state = step(state, "code_fence", lambda t: T.strip(t).startswith("```") & T.strip(t).endswith("```"), unfenced)
    for pattern in TELEMETRY:
        state = step(state, "telemetry", lambda t, p=pattern: t.rlike(p), lambda t, p=pattern: F.regexp_replace(t, p, ""))
    state = step(state, "crlf", lambda t: t.contains("\r\n"), lambda t: F.replace(t, F.lit("\r\n"), F.lit("\n")))
    state = step(state, "trailing_ws", lambda t: t.rlike(BLANK + AT_END), _trailing)
    state = step(state, "blank_lines", lambda t: t.contains("\n\n\n"), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))
    cleaned = F.concat(F.regexp_replace("_s.t", r"\n+\z", ""), F.lit("\n"))
    df = docs.withColumn("_s", state)
    return df.withColumns({"cleaned": cleaned, "categories": F.col("_s.found"), "modifications": F.size("_s.found").cast("long")}).drop("_s")


def audit(docs: DataFrame) -> DataFrame:
    """Findings without change: doc_id, category, line (0 for whole-text findings); one per line with trailing blanks."""
    t = F.col("text")
    bare = T.strip(t)
    whole = [
        F.when(t.startswith(BOM), "bom"), F.when(t.rlike(JSON_WRAPPER), "json_wrapper"),
        *[F.when(t.rlike(p), k) for p, k in TAGS if k != "ai_separator"],
        F.when(bare.startswith("```") & bare.endswith("```"), "code_fence"),
        *[F.when(t.rlike(p), "telemetry") for p in TELEMETRY],
        F.when(t.contains("\r\n"), "crlf"),
    ]
    one = F.transform(F.array_compact(F.array(*whole)), lambda k: F.struct(k.alias("category"), F.lit(0).alias("line")))
    lines = F.transform(F.split(t, "\n"), lambda x, i: F.struct(F.lit("trailing_ws").alias("category"), F.when(_trailing(x) != x, i + 1).alias("line")))
    return docs.select("doc_id", F.inline(F.concat(one, F.filter(lines, lambda x: x["line"].isNotNull()))))


def line_ending(t: Column) -> Column:
    crlf, bare = t.contains("\r\n"), F.replace(t, F.lit("\r\n"), F.lit(""))
    lf, cr = bare.contains("\n"), bare.contains("\r")
    kinds = crlf.cast("int") + lf.cast("int") + cr.cast("int")
    return F.when(kinds > 1, "mixed").when(crlf, "crlf").when(lf, "lf").when(cr, "cr").otherwise("none")


@F.pandas_udf(StringType())
def _composed(texts):
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _form(texts):
    import unicodedata

    return texts.map(lambda t: None if t is None else next((f.lower() for f in ("NFC", "NFD", "NFKC", "NFKD") if unicodedata.is_normalized(f, t)), "other"))


def nfc(t: Column) -> Column:
    """The composed form; plain ASCII texts never reach Python's side of the expression's result."""
    return F.when(t.rlike(r"[^\x00-\x7f]"), _composed(F.when(t.rlike(r"[^\x00-\x7f]"), t))).otherwise(t)


def normal_form(t: Column) -> Column:
    """The first of nfc, nfd, nfkc, nfkd that the text is in, or other."""
    return F.coalesce(_form(F.when(t.rlike(r"[^\x00-\x7f]"), t)), F.lit("nfc"))


def unicode_inventory(docs: DataFrame) -> DataFrame:
    """Control characters, first place of one, line ends, length, BOM, composed or not, and the normal form."""
    t = F.col("text")
    controls = F.regexp_count(t, F.lit(CONTROL))
    return docs.select(
        "doc_id", t.startswith(BOM).alias("has_bom"), controls.cast("long").alias("control_count"), (F.regexp_instr(t, F.lit(CONTROL)) - 1).cast("long").alias("first_control"),
        line_ending(t).alias("line_ending"), F.length(t).cast("long").alias("codepoints"), (normal_form(t) == "nfc").alias("is_nfc"), normal_form(t).alias("normal_form"),
    )


def unicode_findings(docs: DataFrame) -> DataFrame:
    """doc_id, code, severity, evidence of an inventory."""
    i = unicode_inventory(docs)

    def finding(when: Column, code: str, evidence: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit("warning").alias("severity"), evidence.alias("evidence")))

    found = F.array_compact(F.array(
        finding(F.col("has_bom"), "encoding.bom", F.lit("bom=utf-8")),
        finding(F.col("control_count") > 0, "unicode.control_chars", F.concat(F.lit("first_offset="), F.col("first_control").cast("string"))),
        finding(~F.col("is_nfc"), "unicode.not_nfc", F.lit("form")),
        finding(F.col("line_ending") == "mixed", "line_endings.mixed", F.lit("line_ending=mixed")),
    ))
    return i.select("doc_id", F.inline(found))


def host_only(url: Column) -> Column:
    """scheme://host of a URL in lower case, without user, port and path; a mark where there is no scheme or host."""
    u = F.lower(T.strip(url))
    scheme = F.substring_index(u, "://", 1)
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    rest = F.regexp_replace(rest, r"(?s)[/?#].*$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?s)^.*@", ""), r"(?s):.*$", "")
    return F.when(u.contains("://") & (rest != ""), F.concat(scheme, F.lit("://"), rest)).otherwise("remote_resource")


def active_content(docs: DataFrame) -> DataFrame:
    """doc_id, kind, offset, evidence of every place that could run or fetch something."""
    t = F.col("text")
    empty = F.array().cast("array<struct<kind:string,start:int>>")
    each = [F.when(t.rlike(p), _as_kind(T.matches(t, p), k)).otherwise(empty) for k, p in ACTIVE]
    rows = docs.select("doc_id", "text", F.inline(F.concat(*each)))
    url = F.regexp_extract(F.substring(F.col("text"), F.col("start") + 1, F.lit(2**31 - 1)), r"(?i)([a-z][a-z0-9+.-]*://[^\s\"'<>)]+)", 1)
    evidence = F.when(F.col("kind") == "remote_resource", host_only(url)).otherwise(F.col("kind"))
    return rows.select("doc_id", "kind", F.col("start").cast("long").alias("offset"), evidence.alias("evidence"))


def _as_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start")))


def active_findings(docs: DataFrame) -> DataFrame:
    """Findings of active content: all errors; remote resources are external relationships."""
    remote = F.col("kind") == "remote_resource"
    code = F.when(remote, "external.remote_resource").otherwise(F.concat(F.lit("active_content."), F.col("kind")))
    return active_content(docs).select("doc_id", code.alias("code"), F.lit("error").alias("severity"), F.when(remote, "external_relationship").otherwise("active_content").alias("category"))


def import_status(findings: DataFrame) -> DataFrame:
    """Status per document from findings (doc_id, code, severity, category): the gravest rule that holds."""
    c, error = F.col("category"), F.col("severity") == "error"
    review = c.isin("active_content", "external_relationship", "revision", "authorship") | (F.col("code") == "structure.reading_order_unverified")
    grade = F.when(~error, 1).when(F.col("code") == "unsupported.format", 5).when(review, 4).when(c == "magic_mismatch", 3).otherwise(2)
    names = F.array(*[F.lit(x) for x in ("findings", "failed", "quarantined", "human_review_required", "unsupported_format")])
    return findings.groupBy("doc_id").agg(F.max(grade).alias("g")).select("doc_id", F.element_at(names, F.col("g")).alias("status"))


def redacted(t: Column) -> Column:
    """The text with what looks like keys, tokens and URL credentials replaced, in a fixed order."""
    for pattern, mark in REDACTIONS:
        t = F.regexp_replace(t, pattern, mark)
    return t


def masked(props: Column) -> Column:
    """A map with the values of secret-sounding keys replaced."""

    def secret(key: Column) -> Column:
        plain = F.regexp_replace(F.lower(key), "[_-]", "")
        hit = F.lit(False)
        for name in SECRET_NAMES:
            hit = hit | plain.contains(name)
        return hit

    return F.transform_values(props, lambda k, v: F.when(secret(k), F.lit("<REDACTED>")).otherwise(v))


#: Node types that are counted, under their plural.
COUNTED_NODES = {"paragraphs": "paragraph", "headings": "heading", "list_items": "list_item", "table_cells": "table_cell", "quotations": "quotation", "code_blocks": "code_block", "hyperlinks": "hyperlink"}


def surface_statistics(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, code points, bytes, lines of documents, and how many nodes (doc_id, node_type) of seven types they have."""
    t = F.col("text")
    own = docs.select("doc_id", F.length(t).cast("long").alias("codepoints"), F.octet_length(t).cast("long").alias("bytes"), F.size(F.split(t, "\n")).cast("long").alias("lines"))
    per = nodes.groupBy("doc_id").agg(*[F.count_if(F.col("node_type") == k).alias(n) for n, k in COUNTED_NODES.items()])
    return own.join(per, "doc_id", "left").na.fill(0, list(COUNTED_NODES))


#: What an import takes of one document.
LIMITS = {"bytes": 4_000_000, "expanded_bytes": 16_000_000, "nodes": 50_000, "depth": 32}


def limit_findings(measured: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """doc_id, code, evidence of documents (doc_id, bytes, expanded_bytes, nodes, depth) beyond an import's limits."""
    most = LIMITS | (limits or {})
    found = F.array_compact(F.array(*[F.when(F.col(k) > n, F.struct(F.lit(f"limit.{k}").alias("code"), F.concat(F.lit(f"{k}="), F.col(k).cast("string"), F.lit(f" limit={n}")).alias("evidence"))) for k, n in most.items()]))
    return measured.select("doc_id", F.inline(found))


def measured_texts(docs: DataFrame) -> DataFrame:
    """What limit_findings() looks at, of texts whose nodes are their lines that aren't blank."""
    b = F.octet_length("text").cast("long")
    nodes = F.size(F.filter(F.split("text", "\n"), lambda x: T.strip(x) != "")).cast("long")
    return docs.select("doc_id", b.alias("bytes"), b.alias("expanded_bytes"), nodes.alias("nodes"), (nodes > 0).cast("long").alias("depth"))


#: Terms that no public text may have, and patterns of content that a public Markdown text may not have.
PROHIBITED_TERMS = ("project_id", "claim_id", "block_id", "api_key", "model:")
PUBLIC_ACTIVE = (r"(?i)<(?:script|iframe|object|embed|link|img)\b", r"(?i)\bon[a-z]+\s*=", r"(?i)(?:javascript|vbscript|data):", r"(?i)!?\[[^\]]*\]\(\s*(?:https?:)?//")


def _finding(when: Column, code: str, severity: str, evidence: Column | str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(evidence) if isinstance(evidence, str) else evidence).alias("evidence")))


_FINDINGS = "array<struct<code:string,severity:string,evidence:string>>"


def collapsed(t: Column) -> Column:
    """The text with every run of white space as one blank."""
    return F.regexp_replace(t, r"(?U)\s+", " ")


def missing(text: Column, parts: Column, name: str, ordered: bool = False, collapse: bool = False) -> Column:
    """Findings on expected texts (an array) that a text lacks; ordered: each must come after the one before it."""
    t, ps = (collapsed(text), F.transform(parts, collapsed)) if collapse else (text, parts)
    finding = lambda i: F.struct(F.lit("audit.content.missing").alias("code"), F.lit("error").alias("severity"), F.concat(F.lit(f"{name}="), i.cast("string")).alias("evidence"))
    if not ordered:
        return F.filter(F.transform(ps, lambda p, i: F.when(~t.contains(p), finding(i))), lambda x: x.isNotNull())
    placed = F.transform(ps, lambda p, i: F.struct(p.alias("p"), i.alias("i")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        found = F.call_function("locate", x["p"], t, at)
        return F.when(found > 0, found + F.length(x["p"])).otherwise(at), F.when(found == 0, finding(x["i"]))

    return T.sweep(placed, F.lit(1), step, "struct<code:string,severity:string,evidence:string>")["out"]


def text_audit(t: Column, sections: Column | None = None) -> Column:
    """Findings on a finished text: BOM, carriage returns, one newline at the end, prohibited terms, sections in order."""
    checks = [
        _finding(t.startswith(BOM), "audit.utf8.bom", "error", "bom=utf8"), _finding(t.contains("\r"), "audit.line_endings.cr", "error", "byte=0x0d"),
        _finding(~t.endswith("\n"), "audit.trailing_newline.missing", "error", "tail_missing"), _finding(t.endswith("\n\n"), "audit.trailing_newline.extra", "error", "tail_extra"),
        *[_finding(F.lower(t).contains(p), "audit.metadata.prohibited", "error", f"term={p}") for p in PROHIBITED_TERMS],
    ]
    found = F.array_compact(F.array(*checks))
    return found if sections is None else F.concat(found, F.coalesce(missing(t, sections, "section_index", ordered=True), F.array().cast(_FINDINGS)))


def markdown_audit(t: Column, title: Column | None = None) -> Column:
    """Findings on a Markdown text beyond those of a text: title heading, expected title, a claims section, active content."""
    titles = F.filter(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: x.startswith("# "))
    checks = [_finding(F.size(titles) == 0, "audit.heading.title", "error", "heading=title")]
    if title is not None:
        checks.append(_finding((F.size(titles) > 0) & (title != "") & ~F.array_contains(titles, F.concat(F.lit("# "), title)), "audit.title.missing", "error", "heading=expected_title"))
    checks.append(_finding(t.contains("## Claims"), "audit.claims.heading", "error", "heading=claims"))
    checks += [_finding(t.rlike(p), "audit.html.active_content", "error", f"pattern={k}") for k, p in enumerate(PUBLIC_ACTIVE)]
    return F.array_compact(F.array(*checks))


def unicode_audit(t: Column) -> Column:
    """Findings on any text: not composed (a warning), control characters (an error, with the first place)."""
    controls = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"
    return F.array_compact(F.array(
        _finding(nfc(t) != t, "audit.unicode.not_nfc", "warning", "normalization=nfc"),
        _finding(t.rlike(controls), "audit.unicode.control_chars", "error", F.concat(F.lit("first_offset="), (F.regexp_instr(t, F.lit(controls)) - 1).cast("string"))),
    ))


def artefact_audit(files: DataFrame) -> DataFrame:
    """path, format, code, severity, evidence of finished files (path, text, title, sections, claims), by their suffix.

    .txt is audited as text, .md and .markdown as Markdown too, and both for expected sections and claims; any other
    suffix is audited for Unicode and marked as unknown. title, sections and claims may be null.
    """
    suffix = F.lower(F.regexp_extract("path", r"[^/.](\.[^./]*)$", 1))
    kind = F.when(suffix == ".txt", "txt").when(suffix.isin(".md", ".markdown"), "md").otherwise("any")
    t, none = F.col("text"), F.array().cast(_FINDINGS)
    claims = F.coalesce(missing(t, F.col("claims"), "claim_index", collapse=True), none)
    known = F.concat(text_audit(t, F.col("sections")), claims, F.when(F.col("format") == "md", markdown_audit(t, F.coalesce("title", F.lit("")))).otherwise(none))
    unknown = F.concat(unicode_audit(t), F.array(_finding(F.lit(True), "audit.format.unknown", "warning", F.concat(F.lit("ext="), F.regexp_extract("path", r"[^/.](\.[^./]*)$", 1)))))
    rows = files.withColumn("format", kind)
    return rows.select("path", "format", F.inline(F.when(F.col("format") == "any", unknown).otherwise(known)))


def artefact_findings(docs: DataFrame, sections: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, code, evidence of text_audit() with the same expected sections for all."""
    return docs.select("doc_id", F.inline(text_audit(F.col("text"), F.array(*[F.lit(s) for s in sections]) if sections else None))).drop("severity")


def markdown_findings(docs: DataFrame, title: str | None = None) -> DataFrame:
    """doc_id, code, evidence of markdown_audit()."""
    return docs.select("doc_id", F.inline(markdown_audit(F.col("text"), F.lit(title) if title is not None else None))).drop("severity")


def verdict(findings: DataFrame) -> DataFrame:
    """fail per document with an error, else pass: doc_id, verdict."""
    return findings.groupBy("doc_id").agg(F.when(F.bool_or(F.col("severity") == "error"), "fail").otherwise("pass").alias("verdict"))
