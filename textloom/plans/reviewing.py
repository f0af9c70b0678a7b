"""Queries of reviews, coverage, gates and reports, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import evidence as E
from textloom.operators import metrics as M
from textloom.operators import review as R
from textloom.operators import scrub as C
from textloom.functions import text as T
from textloom.plans.audit import ORACLES as AUDIT
from textloom.plans.audit import _kinds
from textloom.plans.base import DX, decorated, over_documents, table, words
from textloom.plans.facts import _NODES, CANDIDATE
from textloom.plans.facts import ORACLES as ORACLES_FACTS
from textloom.plans.style import ORACLES as STYLE

#: Reviewed classes of a text's spans, by their place; the last of four is still open.
_CLASS = "CASE (doc_id + node_no) % 4 WHEN 0 THEN 'authentic_user_prose' WHEN 1 THEN 'user_revision' WHEN 2 THEN 'boilerplate' ELSE 'unknown' END"


def _typed(d):
    """Line nodes and, as the Markdown importer sees quotes and headings, nodes of these kinds at the same places."""
    n = E.line_nodes(d)
    quoted = n.where(F.col("text").startswith('"') | F.col("text").contains(' "')).withColumns({"node_no": F.col("node_no") + 100000, "node_type": F.lit("quotation")})
    return n.withColumn("node_type", F.lit("paragraph")).unionByName(quoted)


def review_spans(d):
    """Spans of every line with a class from review: package_id, span_no, text, class, resolved, words, unsupported."""
    words = F.size(T.words(F.col("text"))).cast("long")
    rows = E.lines(d).withColumns({"class": F.expr(_CLASS), "words": words, "unsupported": F.expr("CASE WHEN doc_id % 10 = 0 AND node_no = 1 THEN 'style' END")})
    return rows.select(F.col("doc_id").alias("package_id"), F.col("node_no").alias("span_no"), "text", "class", F.expr("class <> 'unknown'").alias("resolved"), "words", "unsupported")


def voices(d):
    """The approved voice of every document, with its source: doc_id, source, text."""
    return R.voice_texts(review_spans(d)).select(F.col("package_id").alias("doc_id"), "text").join(d.select("doc_id", "source"), "doc_id")


def source_coverage(d, least=5000):
    p = R.coverage(review_spans(d), 100).join(d.select(F.col("doc_id").alias("package_id"), F.col("source").alias("profile")), "package_id")
    return R.profile_coverage(p, least)


def _pairs(d):
    """Versions with their exact drift and the cleaning that the other one needs."""
    from textloom.plans.facts import _candidate

    low = lambda x: E.anchor_texts(x).withColumn("text", F.lower("text"))
    state = E.exact_drift(low(d), low(_candidate(d)))
    rows = C.scrubbed(_candidate(d)).select("doc_id", "modifications").join(state, "doc_id", "left").na.fill(0)
    total = F.col("preserved") + F.col("omitted")
    return rows.select(F.col("doc_id").alias("pair_id"), F.expr("doc_id % 4").alias("attempt"), "modifications", F.when(total > 0, F.col("preserved") / total).otherwise(1.0).alias("preservation"), F.col("omitted").alias("omissions"), F.lit(0).alias("contradictions"), F.col("added").alias("additions"))


def _markdown_structure(d, changed):
    from textloom.plans.sources import _MD
    from textloom.sources.markup import markdown_nodes, structure_signature

    text = F.when(F.lit(changed) & (F.col("doc_id") % 4 == 0), F.concat(F.lit("# More"), F.lit("\n\n"), F.expr(_MD))).when(F.lit(changed) & (F.col("doc_id") % 4 == 1), F.concat(F.expr(_MD), F.lit("\n- item"))).otherwise(F.expr(_MD))
    return structure_signature(markdown_nodes(d.select("doc_id", text.alias("text"))))


_EVENTS = "CASE event_id % 4 WHEN 0 THEN 'strict_local' WHEN 1 THEN 'private_audited' WHEN 2 THEN 'regulated' ELSE 'other' END"
_USES = ("event_id", f"{_EVENTS} AS mode", "event_type = 'click' AS network", "event_type <> 'view' AS cache")


def _terms(spark):
    return spark.createDataFrame([(k, t) for k, ts in R.PROTECTED_TERMS.items() for t in ts], "domain string, term string")


def _termed(spark, sf):
    return decorated(spark, sf).selectExpr("doc_id", "text || CASE doc_id % 5 WHEN 0 THEN ' The plaintiff cited attorney-client privilege, due  diligence and UTF-8.' WHEN 1 THEN ' Asthma, or ASTHMA; sepsis. statute of limitations' ELSE '' END AS text")


QUERIES = {
    "e12_authorship_spans": over_documents(lambda d: R.authorship_spans(_typed(d))),
    "g01_voice_texts": over_documents(lambda d: R.voice_texts(review_spans(d)).select("package_id", F.md5("text").alias("digest"))),
    "g02_coverage": over_documents(lambda d: R.coverage(review_spans(d), 100)),
    "g03_profile_coverage": over_documents(source_coverage),
    "g07_repair": over_documents(lambda d: R.repair_decisions(_pairs(d))),
    "g08_rollup": over_documents(lambda d: R.finding_rollup(C.active_findings(d).join(d.select("doc_id", "source"), "doc_id"))),
    "w06_block_contexts": over_documents(lambda d: R.block_contexts(E.line_nodes(d).withColumn("node_type", F.when(F.col("text").contains("?"), "heading").otherwise("paragraph"))).select("doc_id", "node_no", F.md5("before").alias("before"), F.md5("after").alias("after"), F.md5("heading").alias("heading"), F.md5("first").alias("first"))),
    "j14_structure_drift": over_documents(lambda d: R.structure_drift(_markdown_structure(d, True), _markdown_structure(d, False))),
    "j17_routes": lambda spark, sf: R.routed(table(spark, sf, "events").selectExpr("event_id AS trigger_id", "event_type AS kind"), spark.sql("SELECT * FROM VALUES ('click', array('a', 'b')), ('view', array('c')) AS t(kind, sources)")),
    "p15_privacy": lambda spark, sf: R.privacy_violations(table(spark, sf, "events").selectExpr(*_USES)),
    "p15_flags": lambda spark, sf: R.privacy_flags(table(spark, sf, "events").selectExpr("event_id", f"{_EVENTS} AS mode")),
    "p16_described": over_documents(lambda d: R.described(M.fingerprint(d), M.common_phrases(d))),
    "s14_gazetteer": lambda spark, sf: R.gazetteer_hits(_termed(spark, sf), _terms(spark)),
}

_SP = f"{_NODES}, nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS node_no FROM n)"
_SPANS = f"""{_SP}, sn AS (SELECT nn.doc_id AS package_id, nn.node_no, nn.text, {_CLASS} AS class, (doc_id + node_no) % 4 <> 3 AS resolved, len({words('text')}) AS words, doc_id % 10 = 0 AND node_no = 1 AS odd FROM nn)"""
_COV = f"""{_SPANS}, cv AS (SELECT package_id, CASE WHEN sum(words) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS text_coverage, CASE WHEN bool_or(odd) THEN 0.0 ELSE 1.0 END::DOUBLE AS structure_coverage, count_if(NOT resolved)::BIGINT AS unresolved, CASE WHEN bool_or(odd) THEN 'style' ELSE '' END AS features, coalesce(sum(CASE WHEN (package_id + node_no) % 4 < 2 THEN words END), 0)::BIGINT AS words FROM sn GROUP BY package_id),
cs AS (SELECT *, CASE WHEN unresolved > 0 OR features <> '' THEN 'human_review_required' WHEN words >= 100 AND text_coverage = 1 THEN 'complete' ELSE 'partial' END AS status, CASE WHEN words >= 100 THEN 'sufficient' ELSE 'insufficient' END AS sufficiency FROM cv)"""
PROFILE_COVERAGE = f"""{_COV}, pc AS (SELECT d.source AS profile, min(text_coverage) AS text_coverage, min(structure_coverage) AS structure_coverage, sum(unresolved)::BIGINT AS unresolved, max(features) AS features, sum(words)::BIGINT AS words, bool_or(status = 'partial') AS part, bool_or(sufficiency = 'insufficient') AS short FROM cs JOIN documents d ON d.doc_id = package_id GROUP BY d.source),
pf AS (SELECT profile, text_coverage, structure_coverage, unresolved, features, CASE WHEN unresolved > 0 OR features <> '' THEN 'human_review_required' WHEN short AND words >= 5000 THEN CASE WHEN text_coverage = 1 THEN 'complete' ELSE 'partial' END WHEN NOT short AND words < 5000 AND NOT part THEN 'partial' WHEN part THEN 'partial' ELSE 'complete' END AS status, CASE WHEN words >= 5000 THEN 'sufficient' ELSE 'insufficient' END AS sufficiency, words FROM pc)"""
_DRIFT = ORACLES_FACTS["j02_exact_fact_diff"]
_MODES = {"strict_local": "false, false, true, true", "private_audited": "true, true, false, false", "regulated": "true, false, true, true"}
_FLAGS = f"WITH e AS (SELECT *, {_EVENTS} AS mode FROM events), m(mode, network_allowed, detector_cache_enabled, retention_enforced, encrypt_sensitive_fields) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _MODES.items()) + ")"
ORACLES = {
    "e12_authorship_spans": f"""{_SP}, ty AS (SELECT doc_id, node_no, base, base + length(text) AS e, 'other' AS t FROM nn UNION ALL SELECT doc_id, node_no + 100000, base, base + length(text), 'quotation' FROM nn WHERE starts_with(text, '"') OR contains(text, ' "')),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base, e ORDER BY (t = 'quotation') DESC, node_no) AS k, min(node_no) OVER (PARTITION BY doc_id, base, e) AS slot FROM ty) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY slot)::INT AS span_no, node_no::INT AS node_no, CASE WHEN t = 'quotation' THEN 'resolved' ELSE 'unknown' END AS state FROM b WHERE k = 1""",
    "g01_voice_texts": f"{_SPANS} SELECT package_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY node_no)) AS digest FROM sn WHERE (package_id + node_no) % 4 < 2 GROUP BY package_id",
    "g02_coverage": f"{_COV} SELECT * FROM cs",
    "g03_profile_coverage": f"{PROFILE_COVERAGE} SELECT * FROM pf",
    "g07_repair": f"""WITH f AS ({_DRIFT}), n AS (SELECT doc_id, count_if(state = 'preserved') AS p, count_if(state = 'omitted') AS o, count_if(state = 'added') AS a FROM f GROUP BY doc_id), m AS ({{SCRUBBED}}), j AS (SELECT m.doc_id, doc_id % 4 AS attempt, modifications, CASE WHEN coalesce(p, 0) + coalesce(o, 0) > 0 THEN p / (p + o) ELSE 1 END AS preservation, coalesce(o, 0) AS o, coalesce(a, 0) AS a FROM m LEFT JOIN n USING (doc_id))
SELECT doc_id AS pair_id, CASE WHEN attempt >= 3 OR modifications > 10 THEN 'fail' WHEN preservation >= 0.85 AND o <= 1 AND a = 0 THEN 'accept' ELSE 'repair' END AS decision FROM j""",
    "g08_rollup": f"{DX}, k AS ({_kinds('dx', 'doc_id', 'text')}), f AS (SELECT source, CASE WHEN kind = 'remote_resource' THEN 'external.remote_resource' ELSE 'active_content.' || kind END AS code FROM k JOIN dx ON k.doc_id = dx.doc_id) SELECT source, code, count(*) AS n FROM f GROUP BY ROLLUP (source, code)",
    "w06_block_contexts": f"""{_SP} SELECT doc_id, node_no::INT AS node_no, md5(coalesce(string_agg(text, ' | ') OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS before, md5(coalesce(string_agg(text, ' | ') OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '')) AS after,
md5(last_value(CASE WHEN node_no % 7 = 0 THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS heading, md5(first_value(text) OVER w) AS first FROM nn WINDOW w AS (PARTITION BY doc_id ORDER BY node_no)""",
    # every decorated Markdown text begins with its title or a text line, so one more heading before it differs at once
    "j14_structure_drift": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'structure_section_order_drift:first_diff_index=0' ELSE 'structure_signature_drift:same_section_order' END AS finding FROM documents WHERE doc_id % 4 < 2",
    "j17_routes": "SELECT event_id AS trigger_id, unnest(CASE event_type WHEN 'click' THEN ['a', 'b'] WHEN 'view' THEN ['c'] ELSE [NULL] END) AS source FROM events",
    "p15_privacy": f"{_FLAGS} SELECT event_id, 'network_use_forbidden' AS code FROM e JOIN m ON e.mode = m.mode WHERE event_type = 'click' AND NOT network_allowed UNION ALL SELECT event_id, 'cache_use_forbidden' FROM e JOIN m ON e.mode = m.mode WHERE event_type <> 'view' AND NOT detector_cache_enabled UNION ALL SELECT event_id, 'unknown_mode' FROM e WHERE mode = 'other'",
    "p15_flags": f"{_FLAGS} SELECT event_id, e.mode AS mode, network_allowed, detector_cache_enabled, retention_enforced, encrypt_sensitive_fields, CASE WHEN m.mode IS NOT NULL THEN false END AS raw_text_logging, CASE WHEN m.mode IS NOT NULL THEN false END AS obsidian_projection_auto FROM e LEFT JOIN m ON e.mode = m.mode",
    "p16_described": f"""WITH fp AS ({STYLE['a18_fingerprint']}), ph AS ({STYLE['a19_common_phrases']}), pj AS (SELECT doc_id, string_agg(phrase, ', ' ORDER BY rank) AS p FROM ph WHERE rank <= 5 GROUP BY doc_id),
t AS (SELECT fp.*, p, array_to_string(list_filter([CASE WHEN r_comma > 0.01 THEN 'frequent comma use' END, CASE WHEN r_semicolon > 0.001 THEN 'semicolon use' END, CASE WHEN r_dash > 0.0005 THEN 'em-dash use' END, CASE WHEN r_question > 0.001 THEN 'rhetorical questions' END], lambda x: x IS NOT NULL), ', ') AS marks FROM fp LEFT JOIN pj ON fp.doc_id = pj.doc_id)
SELECT doc_id, '- ' || array_to_string(list_filter([CASE WHEN total_words > 0 THEN printf('Average sentence length: %.1f words (variance: %.1f)', round(avg_sentence_length::DECIMAL(18, 6), 2)::DOUBLE, round(sentence_length_variance::DECIMAL(18, 6), 2)::DOUBLE) END, CASE WHEN total_words > 0 THEN printf('Average word length: %.1f characters', round(avg_word_length::DECIMAL(18, 6), 2)::DOUBLE) END, CASE WHEN total_words > 0 THEN printf('Vocabulary richness: %.2f%%', round(vocabulary_richness::DECIMAL(18, 6), 4)::DOUBLE * 100) END,
CASE WHEN total_paragraphs > 0 THEN printf('Average paragraph length: %.1f sentences', round(avg_paragraph_length::DECIMAL(18, 6), 2)::DOUBLE) END, CASE WHEN formality > 0.6 THEN 'Tone: formal and academic' WHEN formality > 0.3 THEN 'Tone: neutral and balanced' ELSE 'Tone: casual and conversational' END, 'Common phrases: ' || p, CASE WHEN marks <> '' THEN 'Punctuation style: ' || marks END], lambda x: x IS NOT NULL), chr(10) || '- ') AS description FROM t""",
    "s14_gazetteer": f"""{DX}, k AS (SELECT doc_id, regexp_extract_all(lower(text || CASE doc_id % 5 WHEN 0 THEN ' The plaintiff cited attorney-client privilege, due  diligence and UTF-8.' WHEN 1 THEN ' Asthma, or ASTHMA; sepsis. statute of limitations' ELSE '' END), '[a-z0-9]+') AS w FROM dx), u AS (SELECT doc_id, unnest(w) AS t FROM k UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM k UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM k),
g(domain, term, t) AS (VALUES """ + ", ".join(f"('{k}', '{x}', '{x.lower().replace('-', ' ')}')" for k, xs in R.PROTECTED_TERMS.items() for x in xs) + ") SELECT doc_id, domain, term, count(*) AS n FROM u JOIN g ON u.t = g.t GROUP BY ALL",
}
ORACLES["w06_block_contexts"] = ORACLES["w06_block_contexts"].replace("node_no % 7 = 0", "contains(text, '?')")
ORACLES["g07_repair"] = ORACLES["g07_repair"].replace("{SCRUBBED}", AUDIT["t01_scrub"].replace("FROM documents)", f"FROM documents), dc AS (SELECT doc_id, {CANDIDATE} AS text FROM dx)", 1).replace("END AS c FROM dx)", "END AS c FROM dc)", 1))
