"""Queries of cleaning and auditing, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import evidence as E
from textloom.operators import scrub as C
from textloom.plans.base import DX, over_documents, strip, table

_TR = r"[ \t\x0B\f\r\x1c-\x1f]+"
_SQL_TAGS = ((r"(?im)\[Model:\s*[^\]]+\]", "model_tag"), (r"(?im)\[AI\s*[Gg]enerated[^\]]*\]", "ai_tag"), (r"(?im)\[Provenance:[^\]]+\]", "provenance"), (r"(?im)^\s*[-*]+\s*AI\s*[-*]+\s*$", "ai_separator"), (r"(?im)Generated by\s+\S+", "gen_by"))
_S1 = f"""{DX}, a0 AS (SELECT doc_id, text LIKE '﻿%' AS f_bom, CASE WHEN text LIKE '﻿%' THEN text[2:] ELSE text END AS c FROM dx)"""
_prev, _steps, _cats = "a0", "", ["f_bom"]
for _i, (_p, _k) in enumerate(_SQL_TAGS, 1):
    _steps += f", a{_i} AS (SELECT * EXCLUDE c, regexp_matches(c, '{_p}') AS f_{_k}, regexp_replace(c, '{_p}', '', 'g') AS c FROM {_prev})"
    _prev = f"a{_i}"
    _cats.append(f"f_{_k}")
_SCRUB = f"""{_S1}{_steps}, b1 AS (SELECT * EXCLUDE c, contains(c, chr(13) || chr(10)) AS f_crlf, replace(c, chr(13) || chr(10), chr(10)) AS c FROM {_prev}),
b2 AS (SELECT * EXCLUDE c, c <> regexp_replace(regexp_replace(c, '{_TR}(\\n)', '\\1', 'g'), '{_TR}$', '') AS f_trailing_ws, regexp_replace(regexp_replace(c, '{_TR}(\\n)', '\\1', 'g'), '{_TR}$', '') AS c FROM b1),
b3 AS (SELECT * EXCLUDE c, contains(c, chr(10) || chr(10) || chr(10)) AS f_blank_lines, regexp_replace(c, '\\n{{3,}}', chr(10) || chr(10), 'g') AS c FROM b2)"""
_cats += ["f_crlf", "f_trailing_ws", "f_blank_lines"]
_NAMES = {c: c[2:] for c in _cats}
_AUDIT = " UNION ALL ".join([f"SELECT doc_id, '{k}' AS category, 0 AS line FROM dx WHERE regexp_matches(text, '{p}')" for p, k in _SQL_TAGS if k != "ai_separator"])
_LINE_END = """CASE WHEN (contains(text, chr(13) || chr(10)))::INT + (contains(replace(text, chr(13) || chr(10), ''), chr(10)))::INT + (contains(replace(text, chr(13) || chr(10), ''), chr(13)))::INT > 1 THEN 'mixed'
 WHEN contains(text, chr(13) || chr(10)) THEN 'crlf' WHEN contains(text, chr(10)) THEN 'lf' WHEN contains(text, chr(13)) THEN 'cr' ELSE 'none' END"""
_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
_INV = f"""{DX}, i AS (SELECT doc_id, text LIKE '﻿%' AS has_bom, len(regexp_extract_all(text, '{_CTRL}')) AS control_count,
 CASE WHEN regexp_matches(text, '{_CTRL}') THEN length(string_split_regex(text, '{_CTRL}')[1]) ELSE -1 END AS first_control, {_LINE_END} AS line_ending, length(text) AS codepoints, nfc_normalize(text) = text AS is_nfc, CASE WHEN nfc_normalize(text) = text THEN 'nfc' ELSE 'nfd' END AS normal_form FROM dx)"""
_ACTIVE = (("html_script", r"(?i)<script\b"), ("html_event_handler", r"(?i)<[^>]{0,1000}\bon[a-z]+\s*="), ("javascript_link", "(?i)javascript:"), ("vbscript_link", "(?i)vbscript:"), ("data_uri", "(?i)data:[a-z0-9+/._-]*;base64"), ("iframe", r"(?i)<iframe\b"), ("embed_object", r"(?i)<object\b|<embed\b"), ("file_link", "(?i)file://"),
           ("remote_resource", r"""(?m)(?:!\[[^\]]*\]\(\s*|\[[^\]]*\]\(\s*|^\s{0,3}\[[^\]]+\]:\s*<?|<img\b[^>]*?src\s*=\s*["'']\s*|<)(?:https?://|//)"""))
_PAGES = """CASE page_id % 4 WHEN 1 THEN '<meta name="author" content="A B"><iframe src="https://e.example.org/x"></iframe>'
WHEN 2 THEN '<a href="javascript:void(0)" onclick="run()">go</a><img src="//cdn.example.org/i.png">'
WHEN 3 THEN '<table><tr><td>a</td><td>b</td></tr></table><blockquote>quoted words here</blockquote><pre>x = 1</pre>' ELSE '' END"""
PX = f"WITH px AS (SELECT page_id, url, html || {_PAGES} AS html FROM pages)"


def _kinds(of: str, key: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS doc_id, '{k}' AS kind, unnest(range(len(regexp_extract_all({text}, '{p}')))) AS k FROM {of}" for k, p in _ACTIVE)


def pages_x(spark, sf_dir):
    """pages with the additions that the plain pages lack, as (doc_id, text)."""
    return table(spark, sf_dir, "pages").selectExpr("page_id AS doc_id", "url", f"html || {_PAGES} AS text")


def _props(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    held = F.create_map(F.lit("api_key"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("Access-Token"), F.lit("t"))
    return events.select("event_id", F.inline(F.arrays_zip(F.map_keys(C.masked(held)).alias("key"), F.map_values(C.masked(held)).alias("value"))))


def _redact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text || CASE WHEN doc_id % 5 = 0 THEN ' https://u:p@h.example.org/ Bearer abc.def api_key=zz99; sk-live' || repeat('a', 22) ELSE '' END AS text")
    return docs.select("doc_id", F.md5(C.redacted(F.col("text"))).alias("digest"))


#: Texts with a control character or a decomposed letter, and finished files of three kinds.
_UNI = "CASE doc_id % 4 WHEN 1 THEN substr(text, 1, 3) || chr(7) || text WHEN 2 THEN text || 'e' || '\u0301' ELSE text END"
_ARTEFACTS = (
    "'/out/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' ELSE '.dat' END AS path", "CASE WHEN doc_id % 4 = 1 THEN '# ' || source || chr(10) || text || chr(10) WHEN doc_id % 4 = 2 THEN text || ' project_id' || chr(10) || chr(10) ELSE text END AS text",
    "source AS title", "array('paid', 'on') AS sections", "array('Anna  Miller', 'New Person') AS claims",
)


def _missing_claims(d):
    """Claims of a version that another one lacks, white space apart."""
    from textloom.plans.facts import _candidate, _claims

    held = _claims(d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "proposition"))).alias("x"))
    return _candidate(d).join(held, "doc_id").select("doc_id", F.inline(C.missing(F.col("text"), F.col("x.proposition"), "claim_index", collapse=True)))


_TEXT_R = "text || CASE WHEN doc_id % 5 = 0 THEN ' https://u:p@h.example.org/ Bearer abc.def api_key=zz99; sk-live' || repeat('a', 22) ELSE '' END"
for _p, _m in C.REDACTIONS:
    _TEXT_R = f"regexp_replace({_TEXT_R}, '{_p}', '{_m}', 'g')"

QUERIES = {
    "t01_scrub": over_documents(lambda d: C.scrubbed(d).select("doc_id", F.md5("cleaned").alias("digest"), "modifications")),
    "t02_scrub_findings": over_documents(lambda d: C.scrubbed(d).select("doc_id", F.explode("categories").alias("category"))),
    "t03_audit": over_documents(C.audit),
    "t04_text_audit": over_documents(lambda d: C.artefact_findings(d, ("See", "Anna"))),
    "t05_markdown_audit": over_documents(C.markdown_findings),
    "t06_unicode_audit": over_documents(lambda d: d.select("doc_id", F.inline(C.unicode_audit(F.expr(_UNI))))),
    "t07_missing_claims": over_documents(_missing_claims),
    "t09_audit_routing": over_documents(lambda d: C.artefact_audit(d.selectExpr(*_ARTEFACTS))),
    "t08_verdict": over_documents(lambda d: C.verdict(C.active_findings(d).select("doc_id", "severity").unionByName(C.unicode_findings(d).select("doc_id", "severity")))),
    "p01_unicode_inventory": over_documents(C.unicode_inventory),
    "p02_line_endings": over_documents(lambda d: d.select("doc_id", C.line_ending(F.col("text")).alias("line_ending"))),
    "p03_nfc": over_documents(lambda d: d.select("doc_id", F.md5(C.nfc(F.col("text"))).alias("digest"))),
    "p04_unicode_findings": over_documents(C.unicode_findings),
    "p05_active_content": lambda spark, sf_dir: C.active_content(pages_x(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n")),
    "p06_hosts": lambda spark, sf_dir: pages_x(spark, sf_dir).select("doc_id", C.host_only(F.col("url")).alias("host")),
    "p07_active_findings": over_documents(lambda d: C.active_findings(d).groupBy("doc_id", "code", "category").agg(F.count("*").alias("n"))),
    "p09_import_status": over_documents(lambda d: C.import_status(C.active_findings(d).unionByName(C.unicode_findings(d).select("doc_id", "code", "severity", F.lit("encoding").alias("category"))))),
    "p10_surface_statistics": over_documents(lambda d: C.surface_statistics(d, E.line_nodes(d).withColumn("node_type", F.lit("paragraph")))),
    "p12_redaction": _redact,
    "p13_masked_properties": _props,
    "s06_limits": over_documents(lambda d: C.limit_findings(C.measured_texts(d), {"bytes": 20_000, "expanded_bytes": 40_000, "nodes": 20})),
}

_UF = """u AS (SELECT doc_id, 'encoding.bom' AS code, 'warning' AS severity, 'bom=utf-8' AS evidence FROM i WHERE has_bom UNION ALL SELECT doc_id, 'unicode.control_chars', 'warning', 'first_offset=' || first_control FROM i WHERE control_count > 0
 UNION ALL SELECT doc_id, 'unicode.not_nfc', 'warning', 'form' FROM i WHERE NOT is_nfc UNION ALL SELECT doc_id, 'line_endings.mixed', 'warning', 'line_ending=mixed' FROM i WHERE line_ending = 'mixed')"""
ORACLES = {
    "t01_scrub": f"{_SCRUB} SELECT doc_id, md5(regexp_replace(c, '\\n+$', '') || chr(10)) AS digest, ({' + '.join(f'{c}::INT' for c in _cats)})::BIGINT AS modifications FROM b3",
    "t02_scrub_findings": _SCRUB + " " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS category FROM b3 WHERE {c}" for c, n in _NAMES.items()),
    "t03_audit": f"""{DX}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) + 1 AS line FROM dx) {_AUDIT} UNION ALL SELECT doc_id, 'bom', 0 FROM dx WHERE text LIKE '﻿%'
UNION ALL SELECT doc_id, 'crlf', 0 FROM dx WHERE contains(text, chr(13) || chr(10)) UNION ALL SELECT doc_id, 'trailing_ws', line::INT FROM l WHERE regexp_matches(x, '{_TR}$')""",
    "t04_text_audit": f"""{DX} SELECT doc_id, 'audit.utf8.bom' AS code, 'bom=utf8' AS evidence FROM dx WHERE text LIKE '﻿%' UNION ALL SELECT doc_id, 'audit.line_endings.cr', 'byte=0x0d' FROM dx WHERE contains(text, chr(13)) UNION ALL SELECT doc_id, 'audit.trailing_newline.missing', 'tail_missing' FROM dx WHERE NOT ends_with(text, chr(10)) UNION ALL SELECT doc_id, 'audit.trailing_newline.extra', 'tail_extra' FROM dx WHERE ends_with(text, chr(10) || chr(10))
UNION ALL SELECT doc_id, 'audit.metadata.prohibited', 'term=' || t FROM dx, (VALUES ('project_id'), ('claim_id'), ('block_id'), ('api_key'), ('model:')) v(t) WHERE contains(lower(text), t)
UNION ALL SELECT doc_id, 'audit.content.missing', 'section_index=0' FROM dx WHERE NOT contains(text, 'See') UNION ALL SELECT doc_id, 'audit.content.missing', 'section_index=1' FROM dx WHERE NOT contains(CASE WHEN contains(text, 'See') THEN text[instr(text, 'See') + 3:] ELSE text END, 'Anna')""",
    "t05_markdown_audit": f"""{DX}, t AS (SELECT doc_id, text, len(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: starts_with(x, '# '))) AS titles FROM dx) SELECT doc_id, 'audit.heading.title' AS code, 'heading=title' AS evidence FROM t WHERE titles = 0 UNION ALL SELECT doc_id, 'audit.claims.heading', 'heading=claims' FROM t WHERE contains(text, '## Claims')
UNION ALL SELECT doc_id, 'audit.html.active_content', 'pattern=0' FROM t WHERE regexp_matches(text, '(?i)<(?:script|iframe|object|embed|link|img)\\b') UNION ALL SELECT doc_id, 'audit.html.active_content', 'pattern=1' FROM t WHERE regexp_matches(text, '(?i)\\bon[a-z]+\\s*=') UNION ALL SELECT doc_id, 'audit.html.active_content', 'pattern=2' FROM t WHERE regexp_matches(text, '(?i)(?:javascript|vbscript|data):')
UNION ALL SELECT doc_id, 'audit.html.active_content', 'pattern=3' FROM t WHERE regexp_matches(text, '(?i)!?\\[[^\\]]*\\]\\(\\s*(?:https?:)?//')""",
    "t06_unicode_audit": f"{DX} SELECT doc_id, 'audit.unicode.not_nfc' AS code, 'warning' AS severity, 'normalization=nfc' AS evidence FROM dx WHERE doc_id % 4 = 2 OR nfc_normalize(text) <> text UNION ALL SELECT doc_id, 'audit.unicode.control_chars', 'error', 'first_offset=' || least(3, length(text)) FROM dx WHERE doc_id % 4 = 1",
    "t09_audit_routing": f"""{DX}, a AS (SELECT doc_id % 3 AS k, '/out/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' ELSE '.dat' END AS path, CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'any' END AS format, source, CASE WHEN doc_id % 4 = 1 THEN '# ' || source || chr(10) || text || chr(10) WHEN doc_id % 4 = 2 THEN text || ' project_id' || chr(10) || chr(10) ELSE text END AS text FROM dx),
u AS (SELECT path, format, 'audit.format.unknown' AS code, 'warning' AS severity, 'ext=.dat' AS evidence FROM a WHERE k = 2 UNION ALL SELECT path, format, 'audit.unicode.control_chars', 'error', 'first_offset=' || length(string_split_regex(text, '{_CTRL}')[1]) FROM a WHERE k = 2 AND regexp_matches(text, '{_CTRL}') UNION ALL SELECT path, format, 'audit.unicode.not_nfc', 'warning', 'normalization=nfc' FROM a WHERE k = 2 AND nfc_normalize(text) <> text
 UNION ALL SELECT path, format, 'audit.utf8.bom', 'error', 'bom=utf8' FROM a WHERE k < 2 AND text LIKE '﻿%' UNION ALL SELECT path, format, 'audit.line_endings.cr', 'error', 'byte=0x0d' FROM a WHERE k < 2 AND contains(text, chr(13)) UNION ALL SELECT path, format, 'audit.trailing_newline.missing', 'error', 'tail_missing' FROM a WHERE k < 2 AND NOT ends_with(text, chr(10)) UNION ALL SELECT path, format, 'audit.trailing_newline.extra', 'error', 'tail_extra' FROM a WHERE k < 2 AND ends_with(text, chr(10) || chr(10))
 UNION ALL SELECT path, format, 'audit.metadata.prohibited', 'error', 'term=' || t FROM a, (VALUES ('project_id'), ('claim_id'), ('block_id'), ('api_key'), ('model:')) v(t) WHERE k < 2 AND contains(lower(text), t)
 UNION ALL SELECT path, format, 'audit.content.missing', 'error', 'section_index=0' FROM a WHERE k < 2 AND NOT contains(text, 'paid') UNION ALL SELECT path, format, 'audit.content.missing', 'error', 'section_index=1' FROM a WHERE k < 2 AND NOT contains(CASE WHEN contains(text, 'paid') THEN text[instr(text, 'paid') + 4:] ELSE text END, 'on')
 UNION ALL SELECT path, format, 'audit.content.missing', 'error', 'claim_index=0' FROM a WHERE k < 2 AND NOT contains(regexp_replace(text, '\\s+', ' ', 'g'), 'Anna Miller') UNION ALL SELECT path, format, 'audit.content.missing', 'error', 'claim_index=1' FROM a WHERE k < 2 AND NOT contains(text, 'New Person')
 UNION ALL SELECT path, format, 'audit.heading.title', 'error', 'heading=title' FROM a WHERE k = 1 AND NOT regexp_matches(text, '(?m)(?:^|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}])# ') UNION ALL SELECT path, format, 'audit.html.active_content', 'error', 'pattern=0' FROM a WHERE k = 1 AND regexp_matches(text, '(?i)<(?:script|iframe|object|embed|link|img)\\b') UNION ALL SELECT path, format, 'audit.html.active_content', 'error', 'pattern=1' FROM a WHERE k = 1 AND regexp_matches(text, '(?i)\\bon[a-z]+\\s*=')
 UNION ALL SELECT path, format, 'audit.html.active_content', 'error', 'pattern=2' FROM a WHERE k = 1 AND regexp_matches(text, '(?i)(?:javascript|vbscript|data):') UNION ALL SELECT path, format, 'audit.html.active_content', 'error', 'pattern=3' FROM a WHERE k = 1 AND regexp_matches(text, '(?i)!?\\[[^\\]]*\\]\\(\\s*(?:https?:)?//')) SELECT * FROM u""",
    "t08_verdict": f"""{_INV}, {_UF}, a AS ({_kinds('dx', 'doc_id', 'text')}), f AS (SELECT doc_id, 'error' AS severity FROM a UNION ALL SELECT doc_id, severity FROM u) SELECT doc_id, CASE WHEN bool_or(severity = 'error') THEN 'fail' ELSE 'pass' END AS verdict FROM f GROUP BY doc_id""",
    "p01_unicode_inventory": f"{_INV} SELECT * FROM i",
    "p02_line_endings": f"{DX} SELECT doc_id, {_LINE_END} AS line_ending FROM dx",
    "p03_nfc": f"{DX} SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM dx",
    "p04_unicode_findings": f"{_INV}, {_UF} SELECT * FROM u",
    "p05_active_content": f"{PX}, k AS ({_kinds('px', 'page_id', 'html')}) SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL",
    "p06_hosts": r"SELECT page_id AS doc_id, coalesce(nullif(regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*://)(?:[^/?#]*@)?([^/?#:]+)', 1) || regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*://)(?:[^/?#]*@)?([^/?#:]+)', 2), ''), 'remote_resource') AS host FROM pages",
    "p07_active_findings": f"{DX}, k AS ({_kinds('dx', 'doc_id', 'text')}) SELECT doc_id, CASE WHEN kind = 'remote_resource' THEN 'external.remote_resource' ELSE 'active_content.' || kind END AS code, CASE WHEN kind = 'remote_resource' THEN 'external_relationship' ELSE 'active_content' END AS category, count(*) AS n FROM k GROUP BY ALL",
    "p09_import_status": f"{_INV}, {_UF}, a AS ({_kinds('dx', 'doc_id', 'text')}), f AS (SELECT doc_id, 4 AS g FROM a UNION ALL SELECT doc_id, 1 FROM u) SELECT doc_id, CASE max(g) WHEN 4 THEN 'human_review_required' ELSE 'findings' END AS status FROM f GROUP BY doc_id",
    "p10_surface_statistics": f"{DX} SELECT doc_id, length(text) AS codepoints, strlen(text) AS bytes, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: {strip('x')} <> '')) AS paragraphs, 0 AS headings, 0 AS list_items, 0 AS table_cells, 0 AS quotations, 0 AS code_blocks, 0 AS hyperlinks FROM dx",
    "p12_redaction": f"SELECT doc_id, md5({_TEXT_R}) AS digest FROM documents",
    "p13_masked_properties": "SELECT event_id, 'api_key' AS key, '<REDACTED>' AS value FROM events UNION ALL SELECT event_id, 'user', user_id::VARCHAR FROM events UNION ALL SELECT event_id, 'Access-Token', '<REDACTED>' FROM events",
    "s06_limits": f"{DX}, n AS (SELECT doc_id, strlen(text) AS b, len(list_filter(string_split(text, chr(10)), lambda x: {strip('x')} <> '')) AS k FROM dx) SELECT doc_id, 'limit.bytes' AS code, 'bytes=' || b || ' limit=20000' AS evidence FROM n WHERE b > 20000 UNION ALL SELECT doc_id, 'limit.expanded_bytes', 'expanded_bytes=' || b || ' limit=40000' FROM n WHERE b > 40000 UNION ALL SELECT doc_id, 'limit.nodes', 'nodes=' || k || ' limit=20' FROM n WHERE k > 20",
}
