"""Queries of whole steps, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.operators import evidence as E
from textloom.operators import lexical as X
from textloom.operators import profiles as P
from textloom.operators import review as R
from textloom.operators import workflow as W
from textloom.plans.base import DX, decorated, over_documents, paragraphs, rounded, sentences, table, words
from textloom.plans.facts import _ENT, _KEPT, _claims
from textloom.plans.facts import ORACLES as ORACLES_FACTS
from textloom.plans.lexis import _CTX, _PROF
from textloom.plans.lexis import ORACLES as LEXIS
from textloom.plans.reviewing import PROFILE_COVERAGE, review_spans, voices
from textloom.plans.style import _CONV, _DASH, _QUOTE
from textloom.plans.style import ORACLES as STYLE
from textloom.sources import ingest as I
from textloom.sources.store import materialize, new_path
from textloom.streaming.logs import window_drift, window_means


#: Payloads of events as JSON: telling names, blanks and long strings at several depths, and some without.
_JSON = """CASE event_id % 8 WHEN 0 THEN '{"score": 0.5, "parts": [1, 2, {"kind": "a b"}]}' WHEN 1 THEN '{"kind": "' || event_type || '", "n": ' || user_id || '}' WHEN 2 THEN '{"a": {"Prompt_ID": 3}}' WHEN 3 THEN '["' || repeat('x', 60 + CAST(user_id % 9 AS INT)) || '"]'
WHEN 4 THEN '{"deep": [{"deeper": {"reply_message": null}}]}' WHEN 5 THEN '{"k": "one\\\\ttwo"}' WHEN 6 THEN '[true, null, "ok", "' || event_type || '"]' ELSE '{"n": "' || event_id || '"}' END"""


def _text_free(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{_JSON} AS json").select("event_id", W.text_free(F.col("json")).alias("text_free"))


def _other(d):
    return d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" — I can't."))).otherwise(F.col("text")))


def _line_nodes(d):
    """Nodes as the text importer makes them, with Markdown headings told apart."""
    return E.line_nodes(d).withColumn("node_type", F.when(F.col("text").rlike(r"^ {0,3}#{1,6}\s"), "heading").otherwise("paragraph"))


def _titled(d):
    """Every fourth text begins with a heading that has a word with a rule."""
    return d.withColumn("text", F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("# How to utilize it all now\n"), F.col("text"))).otherwise(F.col("text")))


def _proposed(spark, sf):
    d = _titled(decorated(spark, sf))
    # spans are read by the proposals and the gates, proposals by decisions and gates: written once, not worked out by each
    spans = materialize(E.protected_spans(E.span_candidates(E.line_nodes(d))), "spans")
    return d, spans, materialize(X.propose(d, X.rules(spark), spans), "proposals")


def _safe(spark, sf):
    d, _, c = _proposed(spark, sf)
    return W.node_safe(c.select("doc_id", "offset", "length"), _line_nodes(d))


def _store(spark, sf):
    """A store that took a quarter of the documents first, then all of them, then all once more."""
    d, path, counts = decorated(spark, sf).select("doc_id", "text"), new_path(spark, "ingest"), []
    for k, some in enumerate((d.where("doc_id % 4 = 0"), d, d)):
        counts.append(I.ingest(some, path).withColumn("run", F.lit(k)))
    return path, counts


def _ingested(spark, sf):
    _, (a, b, c) = _store(spark, sf)
    return a.unionByName(b).unionByName(c)


def _status(spark, sf):
    return I.status(spark, _store(spark, sf)[0])


def _profile(spark, sf):
    """Conventions of the approved voices, and their coverage once a person has gone through the open spans of most documents."""
    plain = decorated(spark, sf)
    done = F.expr("class = 'unknown' AND package_id % 97 <> 7")
    seen = review_spans(plain).withColumns({"resolved": F.col("resolved") | done, "class": F.when(done, "boilerplate").otherwise(F.col("class")), "unsupported": F.lit(None).cast("string")})
    packages = R.coverage(seen, 100).join(plain.select(F.col("doc_id").alias("package_id"), F.col("source").alias("profile")), "package_id")
    return P.compared_conventions(voices(plain)), R.profile_coverage(packages, 200).withColumnRenamed("profile", "source")


def _final(spark, sf):
    """The gates of a review that accepts all changes but those of some documents, on bases that are stale for others."""
    d, spans, c = _proposed(spark, sf)
    c = c.where("status IN ('safe', 'proposed')")
    decisions = c.select("doc_id", "offset", (F.col("doc_id") % 9 != 0).alias("accepted"))
    decisions = decisions.unionByName(decisions.where("doc_id % 10 = 0").withColumn("offset", F.col("offset") + 1))
    bases = d.select("doc_id", "source", "text", F.expr("CASE WHEN doc_id % 14 = 0 THEN 1 ELSE 2 END").alias("base_token"))
    revisions = d.select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("token")).withColumn("status", F.when(F.col("token") < 3, "accepted").otherwise("proposed"))
    return W.finalized(bases, c, decisions, _line_nodes(d), spans, revisions, *_profile(spark, sf))


def _capsules(d):
    # several lists are made of these: written once, not worked out by each
    nodes = materialize(E.line_nodes(d).withColumn("node_type", F.lit("paragraph")).withColumn("authorship_class", F.when((F.col("doc_id") + F.col("node_no")) % 9 == 0, "ai_assisted").otherwise("unknown")), "nodes")
    spans = materialize(E.protected_spans(E.span_candidates(nodes)).withColumn("status", F.when(F.col("span_no") % 5 == 0, "EXCLUDED").otherwise("KEPT")), "spans")
    citations, style = materialize(E.citations(nodes), "citations"), materialize(P.style(d), "style")
    claims = materialize(E.claims(spans), "claims")
    held = lambda name: style.select("doc_id", F.inline(name))
    return nodes, W.capsules(nodes, claims, citations, spans, E.entities(claims, citations), held("invariants"), held("tendencies"))


def _document_capsules(d):
    one = lambda c: F.array_join(c, " | ")
    return _capsules(d)[1].select("doc_id", F.size("claims").cast("long").alias("n_claims"), *[F.md5(one(c)).alias(c) for c in ("claims", "open_loops", "spans", "citations", "entities", "invariants", "tendencies")], one("prohibited").alias("prohibited"), one("untrusted").alias("untrusted"))


def _block_capsules(d):
    nodes, documents = _capsules(d)
    rows = W.capsule_blocks(R.block_contexts(nodes, keep=("text",)), nodes, documents)
    return rows.select("doc_id", "node_no", F.length("capsule_id").alias("id_length"), F.md5("text").alias("text"), F.md5("before").alias("before"), F.md5("after").alias("after"), F.md5("first").alias("first"))


def _manifest(spark, sf):
    d = table(spark, sf, "documents")
    samples = d.select(F.concat(F.lit("s"), (F.col("doc_id") - F.when(F.col("doc_id") % 50 == 1, 1).otherwise(0)).cast("string")).alias("sample_id"), F.when(F.col("doc_id") % 20 == 0, "odd").otherwise("human").alias("grp"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"))
    return W.manifest_problems(samples, d.where("doc_id % 30 <> 3").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file")), ("human", "ai"))


QUERIES = {
    "a21_invariants": over_documents(P.invariants),
    "j11_violations": over_documents(lambda d: P.invariant_violations(P.invariants(_other(d), P.COMPARED), P.invariants(d, P.COMPARED))),
    "j11_profile_violations": over_documents(lambda d: P.invariant_violations(P.invariants(d, P.COMPARED).join(d.select("doc_id", "source"), "doc_id"), P.profile_invariants(P.profiles(voices(d))), ("source",))),
    "w07_capsules": over_documents(_document_capsules),
    "w07_blocks": over_documents(_block_capsules),
    "l12_node_safe": _safe,
    "l14_gates": _final,
    "k07_ingest_counts": over_documents(lambda d: W.ingest_counts(d, d.where("doc_id % 4 = 0"), claims=_claims(d), citations=E.citations(E.line_nodes(d)))),
    "k07_ingest": _ingested,
    "g09_status": _status,
    "s12_manifest": _manifest,
    "p14_text_free": _text_free,
    "e13_lanes": over_documents(lambda d: d.select("doc_id", (F.col("doc_id") % 2 == 0).alias("source_lane")).join(_claims(d.where("doc_id % 2 = 0")).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").groupBy("source_lane").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("claims"))),
    "x04_window_drift": lambda spark, sf: rounded(window_drift(window_means(table(spark, sf, "events"))).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "mean_score", "n", "delta", "drifted")),
}

_REAL = lambda x: f"regexp_replace(printf('%.1f', {x}), '[.]0$', '')"
_BASE = f"""{_CONV}, sl AS (SELECT doc_id, len({words('x')}) AS n FROM (SELECT doc_id, unnest({sentences('text')}) AS x FROM dx)), sq AS (SELECT doc_id, count(*) AS k, quantile_cont(n::DOUBLE, 0.1) AS a, quantile_cont(n::DOUBLE, 0.9) AS b FROM sl GROUP BY doc_id),
pl AS (SELECT doc_id, len({sentences('x')}) AS n FROM (SELECT doc_id, unnest({paragraphs('text')}) AS x FROM dx)), pq AS (SELECT doc_id, count(*) AS k, min(n) AS a, max(n) AS b FROM pl GROUP BY doc_id),
br AS (SELECT doc_id, len(regexp_extract_all(text, '\\[\\d+(?:,\\s*\\d+)*\\]')) AS k, len(regexp_extract_all(text, '\\([A-Z][A-Za-z'' -]+,\\s*\\d{{4}}[a-z]?\\)')) AS a FROM dx), te AS ({STYLE['a22_terminology']})"""
_held = lambda k: f"len(list_filter(w, lambda x: list_contains({L.PRONOUNS[k]!r}, x)))"
_PERSON = " || '|' || ".join(f"'{k}=' || CASE WHEN {_held(k)} > 0 THEN 'present' ELSE 'absent' END" for k in ("first_plural", "first_singular", "second_person", "third_person"))
_PERSONS = " || ',' || ".join(f"'{k}=' || {_held(k)}" for k in ("first_plural", "first_singular", "second_person", "third_person"))
_POLICY = "CASE WHEN st THEN 'contractions_present' ELSE 'no_contractions' END"
_INV = f"""{_BASE}, iv AS (SELECT doc_id, 'quotation_convention' AS kind, {_QUOTE} AS value, 'pass' AS status, {_QUOTE} AS evidence FROM c UNION ALL SELECT doc_id, 'dash_type', {_DASH}, 'pass', {_DASH} FROM c UNION ALL SELECT doc_id, 'contraction_policy', {_POLICY}, 'pass', printf('%.4f', coalesce(len(list_filter(w, lambda x: contains(x, chr(39)))) / nullif(len(w), 0), 0)) FROM c UNION ALL SELECT doc_id, 'person_policy', {_PERSON}, 'pass', {_PERSONS} FROM c
UNION ALL SELECT doc_id, 'citation_presentation', CASE WHEN k + a > 0 THEN 'bracket_numbers=' || k || ',author_year=' || a ELSE 'none' END, 'pass', 'bracket_numbers=' || k || ',author_year=' || a FROM br UNION ALL SELECT dx.doc_id, 'sentence_percentile_range', coalesce({_REAL('a')} || '..' || {_REAL('b')}, 'none'), 'pass', 'sentences=' || coalesce(k, 0) FROM dx LEFT JOIN sq ON dx.doc_id = sq.doc_id
UNION ALL SELECT dx.doc_id, 'paragraph_range', coalesce(a || '..' || b, 'none'), 'pass', 'paragraphs=' || coalesce(k, 0) FROM dx LEFT JOIN pq ON dx.doc_id = pq.doc_id UNION ALL SELECT doc_id, 'heading_capitalization', '', 'unknown', 'not_extractable_from_plain_text' FROM dx UNION ALL SELECT doc_id, 'prohibited_phrases', '', 'pass', 'none_configured' FROM dx
UNION ALL SELECT dx.doc_id, 'preferred_terminology', coalesce(terms, ''), 'pass', 'counts=' || coalesce(counts, '0') FROM dx LEFT JOIN te ON dx.doc_id = te.doc_id)"""
_OTHER = _INV.replace("FROM documents)", "FROM documents), dy AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN text || ' — I can''t.' ELSE text END AS text FROM dx)", 1).replace("AS w FROM dx)", "AS w FROM dy)", 1) + " SELECT doc_id, kind, value FROM iv"
_KINDS = "('dash_type', 'contraction_policy', 'person_policy', 'quotation_convention')"
_TITLED = "CASE WHEN doc_id % 4 = 3 THEN '# How to utilize it all now' || chr(10) || text ELSE text END"
_TX = DX.replace("WITH dx AS (", "WITH d0 AS (") + f", dx AS (SELECT doc_id, source, lang, {_TITLED} AS text FROM d0)"
_TOK = _CTX.replace(DX, _TX, 1)
_SEEN = PROFILE_COVERAGE.replace("(doc_id + node_no) % 4 <> 3 AS resolved", "((doc_id + node_no) % 4 <> 3 OR doc_id % 97 <> 7) AS resolved").replace("doc_id % 10 = 0 AND node_no = 1 AS odd", "false AS odd").replace("words >= 5000", "words >= 200").replace("words < 5000", "words < 200")
_OFF = f"""(SELECT a.doc_id FROM ({_INV.replace(DX, _TX, 1)} SELECT doc_id, kind, value FROM iv) a JOIN documents d ON d.doc_id = a.doc_id JOIN ({_PROF} SELECT source, unnest(['dash_type', 'contraction_policy', 'person_policy', 'quotation_convention']) AS kind, unnest([dash_type, contraction_policy, person_policy, quotation_convention]) AS value FROM prof) p ON p.source = d.source AND p.kind = a.kind WHERE a.value <> p.value
UNION SELECT doc_id FROM documents WHERE source NOT IN (SELECT profile FROM ({_SEEN} SELECT * FROM pf) WHERE status = 'complete'))"""
TENDENCIES = LEXIS["a23_tendencies"]
ORACLES = {
    "a21_invariants": f"{_INV} SELECT * FROM iv",
    "j11_violations": f"WITH a AS ({_OTHER}), b AS ({_INV} SELECT doc_id, kind, value FROM iv) SELECT a.doc_id, a.kind, b.value AS expected, a.value AS found FROM a JOIN b ON a.doc_id = b.doc_id AND a.kind = b.kind WHERE a.value <> b.value AND a.kind IN {_KINDS}",
    "j11_profile_violations": f"WITH a AS ({_INV} SELECT doc_id, kind, value FROM iv), p AS ({_PROF} SELECT source, unnest(['dash_type', 'contraction_policy', 'person_policy', 'quotation_convention']) AS kind, unnest([dash_type, contraction_policy, person_policy, quotation_convention]) AS value FROM prof) SELECT d.source, a.doc_id, a.kind, p.value AS expected, a.value AS found FROM a JOIN documents d ON d.doc_id = a.doc_id JOIN p ON p.source = d.source AND p.kind = a.kind WHERE a.value <> p.value",
    "w07_blocks": f"""{_KEPT.split(", c0 AS")[0].replace("WITH RECURSIVE", "WITH", 1)}, nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS node_no FROM n) SELECT doc_id, node_no::INT AS node_no, 28 AS id_length, md5(text) AS text, md5(coalesce(string_agg(text, ' | ') OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS before, md5(coalesce(string_agg(text, ' | ') OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '')) AS after, md5(first_value(text) OVER w) AS first FROM nn WINDOW w AS (PARTITION BY doc_id ORDER BY node_no)""",
    "w07_capsules": f"""{_ENT}, nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS node_no FROM n), cc AS (SELECT doc_id, string_agg(proposition, ' | ' ORDER BY claim_no) AS claims, count(*) AS k FROM cl WHERE claim_no <= 50 GROUP BY doc_id), ca AS (SELECT doc_id, string_agg(proposition, ' | ' ORDER BY claim_no) AS x FROM cl GROUP BY doc_id),
cs AS (SELECT doc_id, string_agg(kind || ':' || text, ' | ' ORDER BY span_no) AS x FROM sp WHERE span_no <= 50 GROUP BY doc_id), ce AS (SELECT doc_id, string_agg(name, ' | ' ORDER BY entity_no) AS x FROM en WHERE entity_no <= 50 GROUP BY doc_id), ci AS (SELECT doc_id, string_agg(kind || '=' || value, ' | ' ORDER BY kind) AS x FROM iv GROUP BY doc_id), ct AS (SELECT doc_id, string_agg(name || '=' || value, ' | ' ORDER BY name) AS x FROM td GROUP BY doc_id), cb AS (SELECT doc_id, string_agg(text, ' | ' ORDER BY citation_no) AS x FROM cites GROUP BY doc_id),
ut AS (SELECT doc_id, string_agg(v, ' | ' ORDER BY k, no) AS x FROM (SELECT doc_id, 0 AS k, node_no AS no, 'ai_assisted:' || node_no AS v FROM nn WHERE (doc_id + node_no) % 9 = 0 UNION ALL SELECT doc_id, 1, span_no, 'excluded_span:' || span_no FROM sp WHERE span_no % 5 = 0) GROUP BY doc_id), dn AS (SELECT DISTINCT doc_id FROM nn)
SELECT dn.doc_id, coalesce(k, 0) AS n_claims, md5(coalesce(claims, '')) AS claims, md5(coalesce(ca.x, '')) AS open_loops, md5(coalesce(cs.x, '')) AS spans, md5(coalesce(cb.x, '')) AS citations, md5(coalesce(ce.x, '')) AS entities, md5(coalesce(ci.x, '')) AS invariants, md5(coalesce(ct.x, '')) AS tendencies, '' AS prohibited, coalesce(ut.x, '') AS untrusted
FROM dn LEFT JOIN cc ON dn.doc_id = cc.doc_id LEFT JOIN ca ON dn.doc_id = ca.doc_id LEFT JOIN cs ON dn.doc_id = cs.doc_id LEFT JOIN ce ON dn.doc_id = ce.doc_id LEFT JOIN ci ON dn.doc_id = ci.doc_id LEFT JOIN ct ON dn.doc_id = ct.doc_id LEFT JOIN cb ON dn.doc_id = cb.doc_id LEFT JOIN ut ON dn.doc_id = ut.doc_id""".replace(", nn AS (", f", iv AS ({_INV} SELECT * FROM iv), td AS ({TENDENCIES}), nn AS (", 1),
    "l12_node_safe": f"""{_TOK} SELECT ctx.doc_id, "offset", 7::BIGINT AS length, NOT (ctx.doc_id % 4 = 3 AND "offset" < 20) AS safe FROM ctx WHERE token = 'utilize'""",
    "l14_gates": f"""{_TOK}, uu AS (SELECT doc_id, bool_or(doc_id % 10 = 0) AS odd, bool_or(doc_id % 4 = 3 AND "offset" < 20 AND doc_id % 9 <> 0) AS head FROM ctx WHERE token = 'utilize' GROUP BY doc_id), so AS {_OFF}, g AS (SELECT dx.doc_id, coalesce(odd, false) AS odd, coalesce(head, false) AS head, dx.doc_id % 14 = 0 AS stale, so.doc_id IS NOT NULL AS off FROM dx LEFT JOIN uu ON dx.doc_id = uu.doc_id LEFT JOIN so ON dx.doc_id = so.doc_id)
SELECT doc_id, 'review' AS gate, NOT odd AS passed FROM g UNION ALL SELECT doc_id, 'node_safe', NOT head FROM g UNION ALL SELECT doc_id, 'rebase', true FROM g UNION ALL SELECT doc_id, 'facts', true FROM g UNION ALL SELECT doc_id, 'structure', NOT head FROM g UNION ALL SELECT doc_id, 'style', NOT off FROM g UNION ALL SELECT doc_id, 'revision', NOT stale FROM g UNION ALL SELECT doc_id, 'accepted', NOT (odd OR head OR off OR stale) FROM g""",
    "k07_ingest_counts": f"{_KEPT} SELECT 'documents' AS \"table\", count(*) AS n FROM dx WHERE doc_id % 4 <> 0 UNION ALL SELECT 'claims', count(*) FROM cl WHERE doc_id % 4 <> 0 UNION ALL SELECT 'citations', count(*) FROM cites WHERE doc_id % 4 <> 0",
    "k07_ingest": _ENT + ORACLES_FACTS["e11_relationships"][len(_ENT) :].split("SELECT doc_id, row_number()")[0] + ", t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tab, doc_id FROM {x}" for t, x in (("documents", "dx"), ("claims", "cl"), ("entities", "en WHERE entity_no <= 100"), ("protected_spans", "sp"), ("relationships", "pr WHERE predicate <> ''"), ("revisions", "dx")))
    + """) SELECT tab AS "table", k.run, count(CASE WHEN (k.run = 0 AND doc_id % 4 = 0) OR (k.run = 1 AND doc_id % 4 <> 0) THEN 1 END) AS n FROM t, (VALUES (0), (1), (2)) k(run) GROUP BY ALL""",
    "g09_status": f"{DX} SELECT doc_id, 'rev-1' AS accepted_revision, true AS content_persisted FROM dx",
    "s12_manifest": "WITH s AS (SELECT 's' || (doc_id - CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END) AS sample_id, CASE WHEN doc_id % 20 = 0 THEN 'odd' ELSE 'human' END AS grp, doc_id FROM documents) SELECT sample_id, 'group' AS problem FROM s WHERE grp = 'odd' UNION ALL SELECT sample_id, 'repeated' FROM s GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT sample_id, 'missing' FROM s WHERE doc_id % 30 = 3",
    "p14_text_free": f"""WITH j AS (SELECT event_id, ({_JSON.replace("CAST(user_id % 9 AS INT)", "(user_id % 9)").replace(chr(92) * 2, chr(92))})::JSON AS v FROM events), t AS (SELECT event_id, x.key, x.type, x.atom FROM j, json_tree(j.v) x)
SELECT j.event_id, NOT EXISTS (SELECT 1 FROM t WHERE t.event_id = j.event_id AND (regexp_matches(lower(coalesce(t.key, '')), 'text|content|prompt|input|source|style|output|response|message') OR (t.type = 'VARCHAR' AND (length(t.atom->>'$') > 64 OR regexp_matches(t.atom->>'$', '\\s'))))) AS text_free FROM j""",
    "e13_lanes": f"{_KEPT} SELECT true AS source_lane, count(*) AS claims FROM cl WHERE doc_id % 2 = 0 UNION ALL SELECT false, 0",
    "x04_window_drift": "WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(value / 500) AS mean_score, count(*) AS n FROM events GROUP BY 1), l AS (SELECT *, abs(mean_score - lag(mean_score) OVER (ORDER BY day)) AS delta FROM m) SELECT day, round(mean_score, 6) AS mean_score, n, round(delta, 6) AS delta, delta > 0.02 AS drifted FROM l WHERE delta IS NOT NULL",
}
