"""Queries of profiles, comparisons and word proposals, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.operators import evidence as E
from textloom.operators import lexical as X
from textloom.operators import profiles as P
from textloom.plans.base import DX, decorated, lst, occurs, over_documents, paragraphs, rounded, sentences, words
from textloom.plans.facts import _KEPT, starts
from textloom.plans.reviewing import PROFILE_COVERAGE, source_coverage, voices


def _changes(spark, sf):
    d = decorated(spark, sf)
    spans = E.protected_spans(E.span_candidates(E.line_nodes(d)))
    return d, spans, X.propose(d, X.rules(spark), spans)


def _proposals(spark, sf):
    return rounded(_changes(spark, sf)[2])


def _applied(spark, sf):
    d, _, c = _changes(spark, sf)
    return X.apply_changes(d, c.where("status = 'safe'")).select("doc_id", F.md5("text").alias("digest"))


def _rebased(spark, sf):
    _, spans, c = _changes(spark, sf)
    return X.rebase(spans, c.where("status = 'safe'"))


def _review(spark, sf):
    c = _changes(spark, sf)[2].select("doc_id", "offset")
    return X.review(c, c.select("doc_id", "offset", (F.col("doc_id") % 2 == 0).alias("accepted")))


def _review_problems(spark, sf):
    c = _changes(spark, sf)[2].select("doc_id", "offset")
    again = c.where("doc_id % 3 = 0")
    return X.review_problems(c, c.unionByName(again).unionByName(c.where("doc_id % 4 = 0").withColumn("offset", F.col("offset") + 1)))


def _compared(d):
    p = P.profiles(voices(d))
    return P.compare(d, p, source_coverage(d).select(F.col("profile").alias("source"), "unresolved"))


#: Rules of several words beside the bundled ones; the shorter of two that overlap falls away.
_PHRASES = (("ph-1", "is it used", "do we use it", "general", 0.95), ("ph-2", "it used", "we used", "general", 0.95), ("ph-3", "anna miller", "A. M.", "general", 0.5))


def _with_phrases(spark):
    more = spark.createDataFrame([(*r, "user_preference") for r in _PHRASES], "rule_id string, source string, target string, sense string, confidence double, precedence string")
    return X.rules(spark).unionByName(more)


def _phrased(spark, sf):
    d = decorated(spark, sf)
    return X.phrases(d, _with_phrases(spark)).select("doc_id", "source", "token", "offset", F.md5("left_window").alias("left_window"), F.md5("right_window").alias("right_window"))


QUERIES = {
    "a20_projection": over_documents(lambda d: P.projected_fingerprint(P.profiles(voices(d)))),
    "a23_tendencies": over_documents(P.tendencies),
    "g04_profiles": over_documents(lambda d: P.profiles(voices(d)).select("source", "words", *P.KEYS, *P.COMPARED, "sentence_range", "paragraph_range", "terms", "top_transition", "transition_strength")),
    "j08_cover": over_documents(lambda d: X.covered(X.contexts(d), E.protected_spans(E.span_candidates(E.line_nodes(d)))).withColumn("spans", F.array_join("spans", ","))),
    "j10_j13_comparison": over_documents(_compared),
    "j12_missing_terms": over_documents(lambda d: d.join(P.profiles(voices(d)).select("source", "terms"), "source").select("doc_id", F.explode(P.missing_terms(F.col("text"), F.col("terms"))).alias("term"))),
    "w05_outliers": over_documents(lambda d: P.outliers(d, P.profiles(voices(d)))),
    "l01_contexts": over_documents(X.contexts),
    "l03_phrases": _phrased,
    "l08_proposals": _proposals,
    "l09_applied": _applied,
    "l10_review": _review,
    "l10_review_problems": _review_problems,
    "l11_rebased": _rebased,
}


def _counts(of: str, tag: str) -> str:
    """The counts of texts (doc_id, source, text) as CTEs k<tag> (words, sentences, paragraphs) and c<tag> (numbers)."""
    some = lambda ws: f"len(list_filter(w, lambda x: list_contains({lst(ws)}, x)))"
    return f"""k{tag} AS (SELECT doc_id, source, text, {words('text')} AS w, {sentences('text')} AS ss, list_transform({sentences('text')}, lambda x: len({words('x')})) AS ls, list_transform({paragraphs('text')}, lambda p: len({sentences('p')})) AS lp FROM {of}),
c{tag} AS (SELECT doc_id, source, text, w, ls, lp, len(w) AS words, len(array_to_string(w, '')) AS letters, len(list_distinct(w)) AS types, {some(L.FUNCTION_WORDS)} AS fw, len(list_filter(w, lambda x: contains(x, chr(39)))) AS ct, len(ls) AS sentences, coalesce(list_sum(ls), 0)::DOUBLE AS length, coalesce(list_sum(list_transform(ls, lambda x: x * x)), 0)::DOUBLE AS squares,
 len(lp) AS paragraphs, coalesce(list_sum(lp), 0)::DOUBLE AS plen, coalesce(list_sum(list_transform(lp, lambda x: x * x)), 0)::DOUBLE AS psq, {', '.join(f"{occurs('text', x)} AS m{i}" for i, x in enumerate(_MARKS))}, length(text) AS chars, len(list_filter(ss, lambda x: contains(x, '?'))) AS questions, {some(L.FORMAL)} AS formal, {some(L.CASUAL)} AS casual,
 {', '.join(f'{some(v)} AS {k}' for k, v in L.PRONOUNS.items())}, contains(text, '—')::INT AS em, contains(text, '–')::INT AS en, contains(text, '-')::INT AS hy, contains(text, '"')::INT AS ds, (contains(text, '“') OR contains(text, '”'))::INT AS dc, (contains(text, '‘') OR contains(text, '’'))::INT AS sc FROM k{tag})"""


_MARKS = (".", ",", ";", ":", "!", "?", '"', "'", "(", ")", "—", "–", "-", "/")
_ADDED = ["words", "letters", "fw", "ct", "sentences", "length", "squares", "paragraphs", "plen", "psq", *[f"m{i}" for i in range(14)], "chars", "questions", "formal", "casual", *L.PRONOUNS, "em", "en", "hy", "ds", "dc", "sc"]


def _fig(types: str) -> str:
    spread = lambda n, t, q: f"CASE WHEN {n} > 1 THEN sqrt(greatest({q} - {t} * {t} / {n}, 0) / ({n} - 1)) ELSE 0 END"
    ss = "m7 > ct"
    return (
        f"coalesce(length / nullif(sentences, 0), 0) AS sentence_mean, {spread('sentences', 'length', 'squares')} AS sentence_stdev, coalesce({types} / nullif(words, 0), 0) AS type_token_ratio, "
        f"coalesce(fw / nullif(words, 0), 0) AS function_word_ratio, coalesce(ct / nullif(words, 0), 0) AS contraction_frequency, ({' + '.join(f'm{i}' for i in range(14))}) / greatest(chars, 1) * 100 AS punctuation_per_100_chars, coalesce(questions / nullif(sentences, 0), 0) AS question_frequency, "
        f"coalesce(plen / nullif(paragraphs, 0), 0) AS paragraph_mean, {spread('paragraphs', 'plen', 'psq')} AS paragraph_stdev, "
        "CASE WHEN (em > 0)::INT + (en > 0)::INT + (hy > 0)::INT > 1 THEN 'mixed' WHEN em > 0 THEN 'em' WHEN en > 0 THEN 'en' WHEN hy > 0 THEN 'hyphen' ELSE 'none' END AS dash_type, "
        f"CASE WHEN (ds > 0 OR dc > 0) AND ({ss} OR sc > 0) THEN 'mixed' WHEN ds > 0 AND dc > 0 THEN 'mixed' WHEN ds > 0 THEN 'double_straight' WHEN dc > 0 THEN 'double_curly' WHEN {ss} AND sc > 0 THEN 'mixed' WHEN {ss} THEN 'single_straight' WHEN sc > 0 THEN 'single_curly' ELSE 'none' END AS quotation_convention, "
        "CASE WHEN ct > 0 THEN 'contractions_present' ELSE 'no_contractions' END AS contraction_policy, "
        + " || '|' || ".join(f"'{k}=' || CASE WHEN {k} > 0 THEN 'present' ELSE 'absent' END" for k in sorted(L.PRONOUNS))
        + " AS person_policy"
    )


_tenths = lambda x: f"regexp_replace(printf('%.1f', {x}), '[.]0$', '')"
_TR = r"regexp_extract(regexp_replace(lower({}), '^[^a-zA-Z0-9]+', ''), '^(" + "|".join(L.TRANSITIONS) + r")(?:[^\pL\pN]|$)', 1)"
_DOC = f"{DX}, {_counts('dx', '')}, own AS (SELECT doc_id, source, text, words, ls, lp, w, {_fig('types')} FROM c)"
_VOICE = PROFILE_COVERAGE + f", vx AS (SELECT package_id AS doc_id, d.source, string_agg(sn.text, chr(10) || chr(10) ORDER BY node_no) AS text FROM sn JOIN documents d ON d.doc_id = package_id WHERE (package_id + node_no) % 4 < 2 GROUP BY package_id, d.source)"
_PROF = f"""{_VOICE}, {_counts('vx', 'v')}, grp AS (SELECT source, {', '.join(f'sum({x}) AS {x}' for x in _ADDED)} FROM cv2 GROUP BY source),
ty AS (SELECT source, count(DISTINCT x) AS types FROM (SELECT source, unnest(w) AS x FROM kv) GROUP BY source),
sb AS (SELECT source, quantile_cont(n::DOUBLE, 0.1) AS a, quantile_cont(n::DOUBLE, 0.9) AS b FROM (SELECT source, unnest(ls) AS n FROM kv) GROUP BY source), pb AS (SELECT source, min(n) AS a, max(n) AS b FROM (SELECT source, unnest(lp) AS n FROM kv) GROUP BY source),
bg AS (SELECT source, g, count(*) AS n, min({{'d': doc_id, 'i': i}}) AS f FROM (SELECT source, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g, unnest(range(1, len(w))) AS i FROM kv) GROUP BY ALL),
te AS (SELECT source, string_agg(g, '|' ORDER BY r) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS r FROM bg) WHERE r <= 3 GROUP BY source),
tp AS (SELECT source, t, count(*) AS n FROM (SELECT source, {_TR.format('s')} AS t FROM (SELECT source, unnest(ss) AS s FROM kv)) WHERE t <> '' GROUP BY ALL), tt AS (SELECT source, t, n / sum(n) OVER (PARTITION BY source) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, t) AS r FROM tp),
prof AS (SELECT grp.*, {_fig('ty.types')}, ty.types AS types, coalesce(terms, '') AS terms, coalesce(t, 'none') AS top_transition, CASE WHEN share >= 1.0::DOUBLE / 3 THEN 'strong' WHEN share >= 1.0::DOUBLE / 6 THEN 'moderate' ELSE 'weak' END AS transition_strength,
 {_tenths('sb.a')} || '..' || {_tenths('sb.b')} AS sentence_range, pb.a || '..' || pb.b AS paragraph_range FROM grp JOIN ty ON ty.source = grp.source LEFT JOIN sb ON sb.source = grp.source LEFT JOIN pb ON pb.source = grp.source LEFT JOIN te ON te.source = grp.source LEFT JOIN tt ON tt.source = grp.source AND r = 1)"""
_PROF = _PROF.replace("cv AS (SELECT doc_id, source, text", "cv2 AS (SELECT doc_id, source, text")
_BOTH = f"{_PROF}, {_counts('dx', '')}, own AS (SELECT doc_id, source, text, words, ls, lp, w, {_fig('types')} FROM c)"
_dist = lambda k: f"least(abs(p.{k} - o.{k}) / greatest(p.{k}, o.{k}, 1), 1)"
_mean = "(" + " + ".join(_dist(k) for k in P.KEYS) + f") / {len(P.KEYS)}"
_OUT = f"""{_BOTH}, z AS (SELECT o.doc_id, 'sentence' AS kind, unnest(ls) AS n, unnest(range(len(ls))) AS no, sentence_mean_p AS m, sentence_stdev_p AS d FROM (SELECT own.doc_id, own.ls, p.sentence_mean AS sentence_mean_p, p.sentence_stdev AS sentence_stdev_p FROM own JOIN prof p ON own.source = p.source) o
UNION ALL SELECT o.doc_id, 'paragraph', unnest(lp), unnest(range(len(lp))), m, d FROM (SELECT own.doc_id, own.lp, p.paragraph_mean AS m, p.paragraph_stdev AS d FROM own JOIN prof p ON own.source = p.source) o),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY abs((n - m) / d) DESC, n DESC, no) AS nth FROM z WHERE d > 0 AND abs((n - m) / d) > 2), ou AS (SELECT doc_id, kind, no, n FROM y WHERE nth <= CASE kind WHEN 'sentence' THEN 10 ELSE 5 END),
os AS (SELECT doc_id, string_agg(n::VARCHAR, ',' ORDER BY no) AS x FROM ou WHERE kind = 'sentence' GROUP BY doc_id), op AS (SELECT doc_id, string_agg(n::VARCHAR, ',' ORDER BY no) AS x FROM ou WHERE kind = 'paragraph' GROUP BY doc_id)"""
_MISSING = "list_filter(list_distinct(string_split(p.terms, '|')), lambda x: x <> '' AND NOT contains(lower(o.text), lower(x)))"


def _band(c: str, cuts: tuple, names: tuple) -> tuple[str, str]:
    def strength(a: float, b: float) -> str:
        d = f"least(greatest(least({c} - {a}, {b} - {c}), 0), {(b - a) / 2}) / {(b - a) / 2}"
        return f"CASE WHEN {d} >= 2.0::DOUBLE / 3 THEN 'strong' WHEN {d} >= 1.0::DOUBLE / 3 THEN 'moderate' ELSE 'weak' END"

    pick = lambda xs: f"CASE WHEN {c} < {cuts[1]} THEN {xs[0]} WHEN {c} <= {cuts[2]} THEN {xs[1]} ELSE {xs[2]} END"
    return pick([f"'{n}'" for n in names]), pick([strength(a, b) for a, b in zip(cuts, cuts[1:])])


_BANDS = (("sentence_length_band", "sentence_mean", (0.0, 12.0, 25.0, 40.0), ("short", "medium", "long")), ("punctuation_density", "density", (0.0, 8.0, 16.0, 24.0), ("low", "moderate", "high")), ("lexical_richness", "type_token_ratio", (0.0, 0.35, 0.55, 1.0), ("low", "moderate", "high")))
_B = r"[^\x09-\x0D ]+"
_CTX = f"""{DX}, k AS (SELECT doc_id, regexp_extract_all(text, '{_B}') AS m, string_split_regex(text, '{_B}') AS g FROM dx), u AS (SELECT doc_id, unnest(m) AS token, unnest(range(len(m))) AS tok_no, unnest(g[1:len(m)]) AS gap FROM k),
ctx AS (SELECT doc_id, tok_no::INT AS tok_no, token, (sum(length(gap) + length(token)) OVER w - length(token))::BIGINT AS "offset", concat_ws(' ', lag(lower(token), 3) OVER w, lag(lower(token), 2) OVER w, lag(lower(token), 1) OVER w) AS left_window, concat_ws(' ', lead(token, 1) OVER w, lead(token, 2) OVER w, lead(token, 3) OVER w) AS right_window,
 CASE WHEN regexp_matches(lower(token), '(?:ing|ed)$') THEN 'verb' WHEN lower(token) LIKE '%ly' THEN 'adverb' WHEN regexp_matches(lower(token), '(?:tion|ment|ness)$') THEN 'noun' WHEN regexp_matches(lower(token), '(?:ous|ive|al)$') THEN 'adjective' ELSE 'other' END AS part_of_speech FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY tok_no))"""
ORACLES = {
    "a20_projection": f"""{_PROF} SELECT source, round(sentence_mean, 2) AS avg_sentence_length, round(sentence_stdev * sentence_stdev, 2) AS sentence_length_variance, round(paragraph_mean, 2) AS avg_paragraph_length, {', '.join(f"round(({x}) / greatest(chars, 1), 6) AS r_{k}" for k, x in (("comma", "m1"), ("period", "m0"), ("question", "m5"), ("exclamation", "m4"), ("semicolon", "m2"), ("colon", "m3"), ("dash", "m10"), ("quote", "m6"), ("apostrophe", "m7"), ("parenthesis", "m8 + m9")))},
round(type_token_ratio, 4) AS vocabulary_richness, terms AS common_phrases, round(CASE WHEN words > 0 THEN 1 / (1 + exp(-5 * (formal - casual) / greatest(words, 1))) ELSE 0 END, 4) AS formality, round(coalesce(letters / nullif(words, 0), 0), 2) AS avg_word_length, sentences::BIGINT AS total_sentences, paragraphs::BIGINT AS total_paragraphs, words::BIGINT AS total_words FROM prof""",
    "a23_tendencies": _DOC.replace(", own AS (SELECT", ", own AS (SELECT length(regexp_replace(text, '[^.,;:!?…—–()\\[\\]{}\"''’‘“”«»-]', '', 'g')) / greatest(length(text), 1) * 100 AS density,", 1) + f", tx AS (SELECT doc_id, {_TR.format('s')} AS t FROM (SELECT doc_id, unnest(ss) AS s FROM k)), tc AS (SELECT doc_id, t, count(*) AS n FROM tx WHERE t <> '' GROUP BY ALL), tt AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t) AS r FROM tc) "
    + " UNION ALL ".join("SELECT doc_id, '{}' AS name, {} AS value, {} AS strength FROM own".format(n, *_band(c, cuts, names)) for n, c, cuts, names in _BANDS)
    + " UNION ALL SELECT own.doc_id, 'top_transition', coalesce(t, 'none'), CASE WHEN share >= 1.0::DOUBLE / 3 THEN 'strong' WHEN share >= 1.0::DOUBLE / 6 THEN 'moderate' ELSE 'weak' END FROM own LEFT JOIN tt ON own.doc_id = tt.doc_id AND r = 1",
    "g04_profiles": f"{_PROF} SELECT source, words::BIGINT AS words, {', '.join(f'round({k}, 6) AS {k}' for k in P.KEYS)}, {', '.join(P.COMPARED)}, coalesce(sentence_range, 'none') AS sentence_range, coalesce(paragraph_range, 'none') AS paragraph_range, terms, top_transition, transition_strength FROM prof",
    "j10_j13_comparison": f"""{_OUT} SELECT o.doc_id, {', '.join(f'round({_dist(k)}, 6) AS d_{k}' for k in P.KEYS)}, round({_mean}, 6) AS mean_distance, round(least(1, o.words / 5000) * (1 - {_mean}), 6) AS confidence, round(least(1, o.words / 1000), 6) AS evidence_coverage,
CASE WHEN o.words >= 1000 THEN 'sufficient' ELSE 'insufficient' END AS sufficiency, CASE WHEN pf.unresolved = 0 THEN 'resolved' ELSE 'unresolved' END AS authorship_status, array_to_string(list_filter([{', '.join(f"CASE WHEN o.{k} <> p.{k} THEN '{k}' END" for k in P.COMPARED)}], lambda x: x IS NOT NULL), ',') AS violations,
array_to_string(list_filter([CASE WHEN o.dash_type <> p.dash_type THEN 'dash: ' || p.dash_type || ' vs ' || o.dash_type END, CASE WHEN o.quotation_convention <> p.quotation_convention THEN 'quotation: ' || p.quotation_convention || ' vs ' || o.quotation_convention END], lambda x: x IS NOT NULL), ';') AS formatting_conflicts,
array_to_string(list_filter(string_split(p.terms, '|'), lambda x: list_contains({_MISSING}, x)), '|') AS lexical_conflicts, coalesce(os.x, '') AS outlier_sentences, coalesce(op.x, '') AS outlier_paragraphs FROM own o JOIN prof p ON o.source = p.source LEFT JOIN pf ON pf.profile = o.source LEFT JOIN os ON os.doc_id = o.doc_id LEFT JOIN op ON op.doc_id = o.doc_id""",
    "j12_missing_terms": f"{_BOTH} SELECT o.doc_id, unnest({_MISSING}) AS term FROM own o JOIN prof p ON o.source = p.source",
    "w05_outliers": f"{_OUT} SELECT doc_id, kind, no::INT AS no, n::INT AS n FROM ou",
    "l03_phrases": f"""{DX}, h AS ({' UNION ALL '.join(f"SELECT doc_id, text, {i} AS o, '{p}' AS source, unnest({starts('lower(text)', p)})::INT AS st FROM dx" for i, p in enumerate(('anna miller', 'is it used', 'it used')))}), f AS (SELECT h.* FROM h WHERE o < 2 OR NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = h.doc_id AND g.o = 1 AND g.st < h.st + 7 AND h.st < g.st + 10))
SELECT doc_id, source, text[st + 1:st + length(source)] AS token, st::BIGINT AS "offset", md5(CASE WHEN st = 0 THEN '' ELSE text[greatest(st - 40, 0) + 1:st] END) AS left_window, md5(text[st + length(source) + 1:st + length(source) + 40]) AS right_window FROM f""",
    "l01_contexts": f"{_CTX} SELECT * FROM ctx",
    "l08_proposals": f"""{_CTX} SELECT doc_id, "offset", 7::BIGINT AS length, 'utilize' AS surface, 'use' AS target, 'cr-001' AS rule_id, 0.95::DOUBLE AS confidence, 'safe' AS status FROM ctx WHERE token = 'utilize'""",
    "l09_applied": f"{DX} SELECT doc_id, md5(regexp_replace(text, '\\butilize\\b', 'use', 'g')) AS digest FROM dx",
    "j08_cover": _KEPT + _CTX[len(DX):] + """ SELECT ctx.doc_id, tok_no, string_agg(span_no::VARCHAR, ',' ORDER BY span_no) AS spans FROM ctx JOIN sp ON sp.doc_id = ctx.doc_id AND sp.start <= ctx."offset" AND ctx."offset" < sp."end" GROUP BY ctx.doc_id, tok_no""",
    "l11_rebased": _KEPT + _CTX[len(DX):] + """, e AS (SELECT doc_id, "offset" AS o FROM ctx WHERE token = 'utilize') SELECT sp.doc_id, span_no::INT AS span_no, sp.start - 4 * coalesce(count_if(o + 7 <= sp.start), 0) AS start, sp."end" - 4 * coalesce(count_if(o + 7 <= sp.start), 0) AS "end", coalesce(bool_or(o < sp."end" AND sp.start < o + 7), false) AS overlap FROM sp LEFT JOIN e ON e.doc_id = sp.doc_id GROUP BY sp.doc_id, span_no, sp.start, sp."end\"""",
    "l10_review": f"""{_CTX} SELECT doc_id, "offset" FROM ctx WHERE token = 'utilize' AND doc_id % 2 = 0""",
    "l10_review_problems": f"""{_CTX} SELECT doc_id, "offset", 'repeated' AS problem FROM ctx WHERE token = 'utilize' AND doc_id % 3 = 0 UNION ALL SELECT doc_id, "offset" + 1, 'unknown' FROM ctx WHERE token = 'utilize' AND doc_id % 4 = 0""",
}
