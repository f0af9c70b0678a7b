"""Queries of facts, spans, claims, entities and diffs, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.operators import evidence as E
from textloom.plans.base import DX, decorated, lst, over_documents, rounded, strip

#: The other version of a third of the documents each: the same, another date and no tail, another amount and a name.
CANDIDATE = """CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(replace(text, '2024-01-', '2023-02-'), ' (Smith, 2020) [1, 2].', '')
 ELSE replace(text, 'paid $', 'paid $9') || ' New Person' END"""


def _candidate(docs):
    return docs.selectExpr("doc_id", f"{CANDIDATE} AS text")


def _nodes(d):
    return E.line_nodes(d)


def _spans(d):
    return E.protected_spans(E.span_candidates(_nodes(d)))


def _claims(d):
    return E.claims(_spans(d))


def _entities(d):
    return E.entities(_claims(d), E.citations(_nodes(d)), spans=_spans(d))


def _claim_pairs(d):
    """Claims of a version and claims with their digits or their polarity changed."""
    c = _claims(d)
    changed = F.when(F.col("claim_no") % 2 == 0, F.regexp_replace("proposition", "[0-9]", "7")).otherwise(F.concat(F.lit("not "), F.col("proposition")))
    return c, c.withColumn("proposition", changed).withColumn("negation", E.negated(F.col("proposition")))


def _over_claims(f):
    return lambda spark, sf_dir: rounded(f(*_claim_pairs(decorated(spark, sf_dir))))


QUERIES = {
    "e01_anchors": over_documents(E.anchors),
    "e02_citations": over_documents(lambda d: E.citations(_nodes(d))),
    "e03_quotations": over_documents(lambda d: E.quotations(_nodes(d))),
    "e04_number_units": over_documents(lambda d: E.number_units(_nodes(d))),
    "e05_dates": over_documents(lambda d: E.dates(_nodes(d))),
    "e06_span_candidates": over_documents(lambda d: E.span_candidates(_nodes(d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("start").alias("first"))),
    "e07_protected_spans": over_documents(_spans),
    "e08_claims": over_documents(_claims),
    "e10_entities": over_documents(_entities),
    "e11_relationships": over_documents(lambda d: E.relationships(_claims(d), _entities(d))),
    "s07_line_nodes": over_documents(lambda d: _nodes(d).select("doc_id", "node_no", "start", "end", "line", F.md5("text").alias("digest"))),
    "j01_fact_diff": over_documents(lambda d: E.fact_diff(E.anchor_items(d), E.anchor_items(_candidate(d)))),
    "j02_exact_fact_diff": over_documents(lambda d: E.exact_diff(E.anchors(d).withColumn("text", F.lower("text")), E.anchors(_candidate(d)).withColumn("text", F.lower("text")), ["doc_id", "category", "text"])),
    "j03_claim_diff": over_documents(lambda d: E.exact_diff(_claims(d).select("doc_id", "proposition", F.col("claim_no").alias("seq")), _claims(_candidate(d)).select("doc_id", "proposition", F.col("claim_no").alias("seq")), ["doc_id", "proposition"])),
    "j04_j05_contradictions": _over_claims(E.contradictions),
    "j06_greedy_pairs": _over_claims(E.contradicted_pairs),
    "j03_j07_claim_diff": over_documents(lambda d: E.claim_diff(_claims(d), _claims(_candidate(d)))),
    "j15_revalidated": over_documents(lambda d: E.revalidated(d.select("doc_id", "text"), _candidate(d))),
    "j07_coverage": over_documents(lambda d: d.select("doc_id").join(_claims(d).groupBy("doc_id").count(), "doc_id", "left").select("doc_id", F.when(F.col("count") > 0, "known").otherwise("unknown_coverage").alias("coverage"))),
}


def starts(t: str, p: str) -> str:
    """Offsets of a pattern's matches, from the lengths of gaps and matches."""
    m, g = f"regexp_extract_all({t}, '{p}')", f"string_split_regex({t}, '{p}')"
    return f"list_transform(range(1, len({m}) + 1), lambda i: list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0))"


def _rows(of: str, p: str, cols: str = "doc_id", mark: str = "_") -> str:
    """Matches m and offsets st. Letters beyond ASCII are looked at as `mark`, so that word boundaries fall as they do
    with Unicode letters; m is cut from the text itself."""
    p = p.replace("'", "''")
    t = f"regexp_replace(text, '[À-ÖØ-öø-ſ]', '{mark}', 'g')" if mark else "text"
    return f"SELECT {cols}, text[st + 1:st + n] AS m, st FROM (SELECT {cols}, text, unnest(list_transform(regexp_extract_all({t}, '{p}'), lambda x: length(x))) AS n, unnest({starts(t, p)})::INT AS st FROM {of})"


_ANCHORS = f"{DX}, x AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS category, {i} AS o, {'m[2:-2]' if k == 'quote' else 'm'} AS text, st FROM ({_rows('dx', p)})" for i, (k, p) in enumerate(E.ANCHORS)) + "), a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st, o) AS seq, category, text, st AS position FROM x)"
_NODES = f"""{DX}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) + 1 AS line FROM dx),
o AS (SELECT doc_id, text, line, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS base FROM l),
n AS (SELECT doc_id, text, line::INT AS line, base FROM o WHERE {strip('text')} <> '')"""
_C = dict(E.CITATIONS)
_CITES = f"""{_NODES}, c0 AS (SELECT doc_id, 'doi' AS kind, 0 AS o, regexp_replace(m, '\\.+$', '') AS text, base + st AS st, base + st + length(regexp_replace(m, '\\.+$', '')) AS en FROM ({_rows('n', _C['doi'], 'doc_id, base')})
 UNION ALL SELECT doc_id, 'bracket_number', 1, m, base + st, base + st + length(m) FROM ({_rows('n', _C['bracket_number'], 'doc_id, base')})
 UNION ALL SELECT doc_id, 'author_year', 2, m[2:-2], base + st, base + st + length(m) FROM ({_rows('n', _C['author_year'], 'doc_id, base', '')})
 UNION ALL SELECT doc_id, 'url', 3, m, base + st, base + st + length(m) FROM ({_rows('n', _C['url'], 'doc_id, base', '')})),
cites AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st, o) AS citation_no, kind, text, st AS start, en AS "end" FROM c0)"""
_ALL = f"""{_CITES}, q AS (SELECT doc_id, {strip('m[2:-2]')} AS text, base + st AS start, base + st + length(m) AS "end" FROM ({_rows('n', E.QUOTE, 'doc_id, base', '')} UNION ALL {_rows('n', E.CURLY_QUOTE, 'doc_id, base', '')}) WHERE length({strip('m[2:-2]')}) >= 20),
nu AS (SELECT doc_id, m AS text, regexp_extract(m, '^\\d+(?:[.,]\\d+)?\\s*(.*)$', 1) AS unit, base + st AS start, base + st + length(m) AS "end" FROM ({_rows('n', E.NUMBER_UNIT, 'doc_id, base', 'x')}) WHERE NOT list_contains({lst(L.UNIT_STOPWORDS)}, lower(regexp_extract(m, '^\\d+(?:[.,]\\d+)?\\s*(.*)$', 1)))),
da AS (SELECT doc_id, m AS text, base + st AS start, base + st + length(m) AS "end" FROM ({_rows('n', E.DATE, 'doc_id, base')})),
cand AS (SELECT doc_id, 'quotation' AS kind, text, '' AS label, start, "end" FROM q UNION ALL SELECT doc_id, 'citation', text, kind, start, "end" FROM cites UNION ALL SELECT doc_id, 'number', text, unit, start, "end" FROM nu UNION ALL SELECT doc_id, 'date', text, '', start, "end" FROM da)"""
_KEPT = _ALL.replace("WITH dx", "WITH RECURSIVE dx", 1) + """, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", kind, text, label) AS r FROM cand),
w AS (SELECT doc_id, r, true AS kept, "end" AS last_end FROM rk WHERE r = 1 UNION ALL SELECT k.doc_id, k.r, k.start >= w.last_end, CASE WHEN k.start >= w.last_end THEN k."end" ELSE w.last_end END FROM w JOIN rk k ON k.doc_id = w.doc_id AND k.r = w.r + 1),
sp AS (SELECT rk.doc_id, row_number() OVER (PARTITION BY rk.doc_id ORDER BY rk.r) AS span_no, kind, start, "end", text, label FROM rk JOIN w ON rk.doc_id = w.doc_id AND rk.r = w.r WHERE w.kept),
cl AS (SELECT doc_id, span_no AS claim_no, text AS proposition, CASE WHEN kind = 'quotation' THEN 'reported' WHEN regexp_matches(text, '(?i)^(?:if)\\b|\\b(?:unless|when)\\b') THEN 'conditional' WHEN regexp_matches(text, '(?i)\\b(?:""" + "|".join(L.MODALS) + """)\\b') THEN 'hedged' ELSE 'asserted' END AS modality,
 regexp_matches(text, '(?i)\\b(?:""" + "|".join(n.replace("'", "''") for n in L.NEGATIONS) + """)\\b') AS negation, span_no FROM sp)"""

ORACLES = {
    "e01_anchors": f"{_ANCHORS} SELECT doc_id, seq::INT AS seq, category, text, position FROM a",
    "e02_citations": f'{_CITES} SELECT doc_id, citation_no::INT AS citation_no, kind, text, start, "end"::INT AS "end" FROM cites',
    "e03_quotations": f"{_ALL} SELECT doc_id, text, start, \"end\"::INT AS \"end\" FROM q",
    "e04_number_units": f"{_ALL} SELECT doc_id, text, unit, start, \"end\"::INT AS \"end\" FROM nu",
    "e05_dates": f"{_ALL} SELECT doc_id, text, start, \"end\"::INT AS \"end\" FROM da",
    "e06_span_candidates": f"{_ALL} SELECT doc_id, kind, count(*) AS n, min(start) AS first FROM cand GROUP BY ALL",
    "e07_protected_spans": f'{_KEPT} SELECT doc_id, span_no::INT AS span_no, kind, start, "end"::INT AS "end", text, label FROM sp',
    "e08_claims": f"{_KEPT} SELECT doc_id, claim_no::INT AS claim_no, proposition, modality, negation, span_no::INT AS span_no FROM cl",
    "s07_line_nodes": f'{_NODES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line)::INT AS node_no, base AS start, (base + length(text))::INT AS "end", line, md5(text) AS digest FROM n',
    "j07_coverage": f"{_KEPT} SELECT dx.doc_id, CASE WHEN count(cl.claim_no) > 0 THEN 'known' ELSE 'unknown_coverage' END AS coverage FROM dx LEFT JOIN cl ON dx.doc_id = cl.doc_id GROUP BY dx.doc_id",
}
_TWO = _ANCHORS.replace("x AS (", "x AS (", 1)
_SECOND = _ANCHORS[len(DX):].replace("x AS (", "x2 AS (", 1).replace("FROM dx", "FROM dc").replace(", a AS (", ", a2 AS (").replace("FROM x)", "FROM x2)")
ORACLES["j02_exact_fact_diff"] = f"""{_ANCHORS}, dc AS (SELECT doc_id, {CANDIDATE} AS text FROM dx){_SECOND},
s AS (SELECT doc_id, category, lower(text) AS text, row_number() OVER (PARTITION BY doc_id, category, lower(text) ORDER BY seq) AS copy FROM a), c AS (SELECT doc_id, category, lower(text) AS text, row_number() OVER (PARTITION BY doc_id, category, lower(text) ORDER BY seq) AS copy FROM a2)
SELECT coalesce(s.doc_id, c.doc_id) AS doc_id, coalesce(s.category, c.category) AS category, coalesce(s.text, c.text) AS text, coalesce(s.copy, c.copy)::INT AS copy, CASE WHEN s.copy IS NULL THEN 'added' WHEN c.copy IS NULL THEN 'omitted' ELSE 'preserved' END AS state
FROM s FULL JOIN c ON s.doc_id = c.doc_id AND s.category = c.category AND s.text = c.text AND s.copy = c.copy"""

_ENT = f"""{_KEPT}, ph AS (SELECT doc_id, claim_no AS o1, unnest(range(len(m))) AS o2, unnest(m) AS name FROM (SELECT doc_id, claim_no, regexp_extract_all(proposition, '[A-Z][a-z]+(?: [A-Z][a-z]+)+') AS m FROM cl)),
au AS (SELECT doc_id, citation_no AS o1, {strip("string_split(text, ',')[1]")} AS name, text FROM cites WHERE kind = 'author_year'), al AS (SELECT doc_id, name, 0 AS o0, o1, o2 FROM ph UNION ALL SELECT doc_id, name, 1, o1, 0 FROM au WHERE name <> ''),
fs AS (SELECT doc_id, name, min({{'a': o0, 'b': o1, 'c': o2}}) AS fst FROM al GROUP BY ALL), pe AS (SELECT DISTINCT fs.doc_id, fs.name FROM fs JOIN au ON au.doc_id = fs.doc_id AND contains(au.text, fs.name)),
en AS (SELECT fs.doc_id, fs.name, row_number() OVER (PARTITION BY fs.doc_id ORDER BY fst) AS entity_no, pe.name IS NOT NULL AS person FROM fs LEFT JOIN pe ON fs.doc_id = pe.doc_id AND fs.name = pe.name)"""
ORACLES["e10_entities"] = f"""{_ENT}, ev AS (SELECT en.doc_id, en.name, string_agg(span_no::VARCHAR, ',' ORDER BY span_no) AS evidence FROM en JOIN sp ON sp.doc_id = en.doc_id AND contains(sp.text, en.name) GROUP BY ALL)
SELECT en.doc_id, entity_no::INT AS entity_no, en.name AS name, CASE WHEN person THEN 'person' ELSE 'other' END AS entity_type, coalesce(evidence, '') AS evidence FROM en LEFT JOIN ev ON en.doc_id = ev.doc_id AND en.name = ev.name WHERE entity_no <= 100"""
ORACLES["e11_relationships"] = f"""{_ENT}, oc AS (SELECT cl.doc_id, claim_no, proposition, entity_no, instr(proposition, name) AS pos, length(name) AS n, row_number() OVER (PARTITION BY cl.doc_id, claim_no, instr(proposition, name) ORDER BY entity_no) AS same FROM cl JOIN en ON cl.doc_id = en.doc_id AND contains(proposition, name) WHERE entity_no <= 100),
ro AS (SELECT *, row_number() OVER (PARTITION BY doc_id, claim_no ORDER BY pos) AS k FROM oc WHERE same = 1),
pr AS (SELECT a.doc_id, a.claim_no, a.entity_no AS subject_no, b.entity_no AS object_no, lower(trim(regexp_replace(a.proposition[a.pos + a.n:b.pos - 1], '\\s+', ' ', 'g'))) AS predicate FROM ro a JOIN ro b ON a.doc_id = b.doc_id AND a.claim_no = b.claim_no AND a.k = 1 AND b.k = 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY claim_no)::INT AS relation_no, subject_no::INT AS subject_no, predicate, object_no::INT AS object_no FROM pr WHERE predicate <> ''"""
#: The candidate version's claims as a table of their own.
_KEPT2 = _KEPT.replace("FROM documents)", f"FROM documents), dc AS (SELECT doc_id, {CANDIDATE} AS text FROM dx)", 1).replace("FROM dx)", "FROM dc)").replace("AS text FROM dc), l AS", "AS text FROM dx), l AS", 1) + " SELECT * FROM cl"
_BOTH = f"{_KEPT}, cl2 AS ({_KEPT2})"
ORACLES["j03_claim_diff"] = f"""{_BOTH}, s AS (SELECT doc_id, proposition, row_number() OVER (PARTITION BY doc_id, proposition ORDER BY claim_no) AS copy FROM cl), c AS (SELECT doc_id, proposition, row_number() OVER (PARTITION BY doc_id, proposition ORDER BY claim_no) AS copy FROM cl2)
SELECT coalesce(s.doc_id, c.doc_id) AS doc_id, coalesce(s.proposition, c.proposition) AS proposition, coalesce(s.copy, c.copy)::INT AS copy, CASE WHEN s.copy IS NULL THEN 'added' WHEN c.copy IS NULL THEN 'omitted' ELSE 'preserved' END AS state FROM s FULL JOIN c ON s.doc_id = c.doc_id AND s.proposition = c.proposition AND s.copy = c.copy"""
ORACLES["t07_missing_claims"] = f"""{_KEPT} SELECT cl.doc_id, 'audit.content.missing' AS code, 'error' AS severity, 'claim_index=' || (claim_no - 1) AS evidence FROM cl JOIN (SELECT doc_id, {CANDIDATE} AS t FROM dx) x ON x.doc_id = cl.doc_id WHERE NOT contains(regexp_replace(t, '\\s+', ' ', 'g'), regexp_replace(proposition, '\\s+', ' ', 'g'))"""
_NUM = r"\$?\d[\d,]*(?:\.\d+)?(?:\s*(?:%|percent|pp)\b)?"
_NEG = r"(?i)\b(?:not|no|never|none|neither|cannot|isn''t|aren''t|wasn''t|weren''t|doesn''t|don''t|didn''t)\b"
_bare = lambda t, p: f"lower(trim(regexp_replace(regexp_replace({t}, '{p}', '', 'g'), '\\s+', ' ', 'g')))"
_nums = lambda t: f"list_transform(regexp_extract_all({t}, '{_NUM}'), lambda x: regexp_replace(regexp_replace(lower(x), '[ $,]', '', 'g'), 'percent|pp', '%', 'g'))"


def _edges(left: str, right: str) -> str:
    return f"""SELECT DISTINCT s.doc_id, s.claim_no AS source_no, c.claim_no AS candidate_no, k.kind FROM {left} s JOIN {right} c ON s.doc_id = c.doc_id, (VALUES ('number'), ('negation')) k(kind)
WHERE (k.kind = 'number' AND {_bare('s.proposition', _NUM)} = {_bare('c.proposition', _NUM)} AND len({_nums('s.proposition')}) > 0 AND len({_nums('c.proposition')}) > 0 AND {_nums('s.proposition')} <> {_nums('c.proposition')})
 OR (k.kind = 'negation' AND s.negation <> c.negation AND {_bare('s.proposition', _NEG)} = {_bare('c.proposition', _NEG)})"""


_CHANGED = f"""{_KEPT}, c1 AS (SELECT doc_id, claim_no, CASE WHEN claim_no % 2 = 0 THEN regexp_replace(proposition, '[0-9]', '7', 'g') ELSE 'not ' || proposition END AS proposition FROM cl), c2 AS (SELECT *, regexp_matches(proposition, '{_NEG}') AS negation FROM c1)"""


def _leftover(own: str, other: str) -> str:
    number = "row_number() OVER (PARTITION BY doc_id, proposition ORDER BY claim_no) AS copy"
    return f"SELECT a.doc_id, a.claim_no, a.proposition, a.negation FROM (SELECT *, {number} FROM {own}) a ANTI JOIN (SELECT *, {number} FROM {other}) b ON a.doc_id = b.doc_id AND a.proposition = b.proposition AND a.copy = b.copy"


def _greedy(left: str, right: str) -> str:
    return f"""lf AS ({_leftover(left, right)}), rg AS ({_leftover(right, left)}), ed AS ({_edges('lf', 'rg')}), es AS (SELECT doc_id, source_no, list_sort(list_distinct(list(candidate_no))) AS cs, row_number() OVER (PARTITION BY doc_id ORDER BY source_no) AS r FROM ed GROUP BY doc_id, source_no),
gr AS (SELECT doc_id, r, source_no, cs[1] AS pick, [cs[1]] AS taken FROM es WHERE r = 1 UNION ALL SELECT e.doc_id, e.r, e.source_no, list_filter(e.cs, lambda x: NOT list_contains(gr.taken, x))[1], list_append(gr.taken, list_filter(e.cs, lambda x: NOT list_contains(gr.taken, x))[1]) FROM gr JOIN es e ON e.doc_id = gr.doc_id AND e.r = gr.r + 1)"""


ORACLES["j04_j05_contradictions"] = f"{_CHANGED} SELECT doc_id, source_no::INT AS source_no, candidate_no::INT AS candidate_no, kind FROM ({_edges('cl', 'c2')})"
ORACLES["j06_greedy_pairs"] = f"{_CHANGED}, {_greedy('cl', 'c2')} SELECT doc_id, source_no::INT AS source_no, pick::INT AS candidate_no FROM gr WHERE pick IS NOT NULL"
ORACLES["j03_j07_claim_diff"] = f"""{_BOTH}, {_greedy('cl', 'cl2')}, g AS (SELECT doc_id, count(*) AS n FROM gr WHERE pick IS NOT NULL GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS n FROM cl GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n FROM cl2 GROUP BY doc_id), x AS (SELECT doc_id, count(*) AS n FROM lf GROUP BY doc_id), y AS (SELECT doc_id, count(*) AS n FROM rg GROUP BY doc_id), i AS (SELECT doc_id FROM a UNION SELECT doc_id FROM b)
SELECT i.doc_id, coalesce(a.n, 0) - coalesce(x.n, 0) AS preserved, coalesce(x.n, 0) - coalesce(g.n, 0) AS omitted, coalesce(y.n, 0) - coalesce(g.n, 0) AS added, coalesce(g.n, 0) AS contradicted, CASE WHEN coalesce(a.n, 0) > 0 THEN 'known' ELSE 'unknown_coverage' END AS coverage FROM i LEFT JOIN a ON a.doc_id = i.doc_id LEFT JOIN b ON b.doc_id = i.doc_id LEFT JOIN x ON x.doc_id = i.doc_id LEFT JOIN y ON y.doc_id = i.doc_id LEFT JOIN g ON g.doc_id = i.doc_id"""
