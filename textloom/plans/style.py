"""Queries of the style metrics, with their oracles."""

from __future__ import annotations

from textloom.functions import lexicons as L
from textloom.operators import metrics as M
from textloom.plans.base import DX, clauses, figures, lst, occurs, over_documents, paragraphs, sentences, words

_W = f"{DX}, w AS (SELECT doc_id, text, {words('text')} AS w FROM dx)"
_T = f"{_W}, t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w)"
_SENT = f"{DX}, s0 AS (SELECT doc_id, text, {sentences('text')} AS ss FROM dx), s AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS sent_no FROM s0)"
_in = lambda ws: f"len(list_filter(w, lambda x: list_contains({lst(ws)}, x)))"
_FORMALITY = f"1 / (1 + exp(-5 * (({_in(L.FORMAL)} - {_in(L.CASUAL)}) / greatest(len(w), 1))))"
_PUNCT = ", ".join(f"('{c.replace(chr(39), chr(39) * 2)}')" for c in L.PUNCTUATION)
_QUOTE = """CASE WHEN (ds OR dc) AND (ss OR sc) THEN 'mixed' WHEN ds AND dc THEN 'mixed' WHEN ds THEN 'double_straight' WHEN dc THEN 'double_curly'
  WHEN ss AND sc THEN 'mixed' WHEN ss THEN 'single_straight' WHEN sc THEN 'single_curly' ELSE 'none' END"""
_DASH = """CASE WHEN em + en + hy = 0 THEN 'none' WHEN em + en + hy > 1 THEN 'mixed' WHEN em = 1 THEN 'em' WHEN en = 1 THEN 'en' ELSE 'hyphen' END"""
_CONV = f"""{_W}, c AS (SELECT doc_id, text, w, (contains(text, '—'))::INT AS em, (contains(text, '–'))::INT AS en, (contains(text, '-'))::INT AS hy, contains(text, '"') AS ds,
  contains(text, '“') OR contains(text, '”') AS dc, contains(text, '‘') OR contains(text, '’') AS sc,
  {occurs('text', "'")} > len(list_filter(w, lambda x: contains(x, ''''))) AS ss, len(list_filter(w, lambda x: contains(x, ''''))) > 0 AS st, contains(text, '’') AS cu FROM w)"""
_PHRASES = f"""{_W}, g AS (SELECT doc_id, list_concat(list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]), list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS p,
   list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]) AS b FROM w)"""

QUERIES = {
    "a01_tokens": over_documents(lambda d: M.word_counts(d)),
    "a02_sentences": over_documents(lambda d: M.sentence_rows(d).select("doc_id", "sent_no", "n_words", "n_clauses")),
    "a03_a07_syntax": over_documents(M.syntax),
    "a04_lexical": over_documents(M.lexical),
    "a04_hapax": over_documents(M.hapax),
    "a04_function_words": over_documents(M.function_words),
    "a04_contractions": over_documents(M.contractions),
    "a05_mattr": over_documents(M.mattr),
    "a06_pronouns": over_documents(M.pronouns),
    "a07_clauses": over_documents(M.clause_lengths),
    "a07_openings": over_documents(M.sentence_openings),
    "a08_passives": over_documents(M.passives),
    "a09_rhythm": over_documents(M.rhythm),
    "a09_edges": over_documents(M.paragraph_edges),
    "a10_transitions": over_documents(M.transitions),
    "a11_punctuation": over_documents(M.punctuation),
    "a12_punctuation_pairs": over_documents(M.punctuation_pairs),
    "a13_conventions": over_documents(M.conventions),
    "a14_capitalization": over_documents(M.capitalization),
    "a15_questions": over_documents(M.questions),
    "a16_register": over_documents(M.register),
    "a17_bundle": over_documents(M.bundle),
    "a18_fingerprint": over_documents(M.fingerprint),
    "a19_common_phrases": over_documents(M.common_phrases),
    "a22_terminology": over_documents(M.terminology),
}

ORACLES = {
    "a01_tokens": f"{_T} SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL",
    "a02_sentences": f"{_SENT} SELECT doc_id, sent_no::INT AS sent_no, len({words('sentence')}) AS n_words, len({clauses('sentence')}) AS n_clauses FROM s",
    "a03_a07_syntax": f"""{_SENT}, k AS (SELECT doc_id, len({words('sentence')}) AS n_w, len({clauses('sentence')}) AS n_c FROM s)
SELECT dx.doc_id, {figures('n_w')}, count_if(n_w <= 2)::BIGINT AS fragments, count_if(n_c >= 5 AND n_w >= 45)::BIGINT AS run_ons FROM dx LEFT JOIN k ON dx.doc_id = k.doc_id GROUP BY dx.doc_id""",
    "a04_lexical": f"""{_W} SELECT doc_id, len(w) AS word_count, round(coalesce(len(array_to_string(w, '')) / nullif(len(w), 0), 0), 6) AS avg_word_length, len(list_distinct(w)) AS unique_words,
round(coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0), 6) AS type_token_ratio, round(coalesce({_in(L.FUNCTION_WORDS)} / nullif(len(w), 0), 0), 6) AS function_word_ratio,
round(coalesce(len(list_filter(w, lambda x: contains(x, ''''))) / nullif(len(w), 0), 0), 6) AS contraction_frequency FROM w""",
    "a04_hapax": f"{_T}, c AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, round(count_if(n = 1) / sum(n), 6) AS hapax_ratio FROM c GROUP BY doc_id",
    "a05_mattr": f"""{_T}, p AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos) AS b FROM t),
q AS (SELECT doc_id, n, (b IS NULL)::INT AS fresh, greatest(0, least(pos, n - 100) - greatest(0, pos - 99, coalesce(b + 1, 0)) + 1) AS k FROM p)
SELECT doc_id, round(CASE WHEN max(n) <= 100 THEN sum(fresh) / max(n) ELSE sum(k) / (100 * (max(n) - 99)) END, 6) AS mattr FROM q GROUP BY doc_id""",
    "a06_pronouns": f"{_W} SELECT doc_id, " + ", ".join(f"{_in(v)} AS {k}" for k, v in L.PRONOUNS.items()) + " FROM w",
    "a07_clauses": f"{_SENT}, c AS (SELECT doc_id, unnest({clauses('sentence')}) AS c FROM s), k AS (SELECT doc_id, len({words('c')}) AS n_w FROM c) SELECT dx.doc_id, {figures('n_w')} FROM dx LEFT JOIN k ON dx.doc_id = k.doc_id GROUP BY dx.doc_id",
    "a07_openings": f"""{_SENT}, k AS (SELECT doc_id, {words('sentence')} AS w FROM s), o AS (SELECT doc_id, w[1] AS opening FROM k WHERE len(w) > 0 UNION ALL SELECT doc_id, w[1] || ' ' || w[2] FROM k WHERE len(w) > 1)
SELECT doc_id, opening, count(*) AS n FROM o GROUP BY ALL""",
    "a08_passives": f"""{_SENT}, k AS (SELECT doc_id, {words('sentence')} AS w FROM s), c AS (SELECT doc_id, len(list_filter(range(len(w) - 1), lambda i: list_contains({lst(L.BE_FORMS)}, w[i + 1]) AND (ends_with(w[i + 2], 'ed') OR ends_with(w[i + 2], 'en')))) AS n FROM k)
SELECT dx.doc_id, coalesce(sum(n), 0)::BIGINT AS passive_markers FROM dx LEFT JOIN c ON dx.doc_id = c.doc_id GROUP BY dx.doc_id""",
    "a09_rhythm": f"{DX}, p AS (SELECT doc_id, unnest({paragraphs('text')}) AS p FROM dx), k AS (SELECT doc_id, len({sentences('p')}) AS n_s FROM p) SELECT dx.doc_id, {figures('n_s')} FROM dx LEFT JOIN k ON dx.doc_id = k.doc_id GROUP BY dx.doc_id",
    "a09_edges": f"""{DX}, p AS (SELECT doc_id, unnest({paragraphs('text')}) AS p FROM dx), k AS (SELECT doc_id, {words('p')} AS w FROM p),
e AS (SELECT doc_id, 'opening' AS edge, w[1] AS gram FROM k WHERE len(w) > 0 UNION ALL SELECT doc_id, 'closing', w[-1] FROM k WHERE len(w) > 0 UNION ALL SELECT doc_id, 'opening', w[1] || ' ' || w[2] FROM k WHERE len(w) > 1 UNION ALL SELECT doc_id, 'closing', w[-2] || ' ' || w[-1] FROM k WHERE len(w) > 1)
SELECT doc_id, edge, gram, count(*) AS n FROM e GROUP BY ALL""",
    "a10_transitions": f"""{_SENT}, k AS (SELECT doc_id, regexp_replace(lower(sentence), '^[^a-zA-Z0-9]+', '') AS b FROM s), m AS (SELECT doc_id, regexp_extract(b, '^({"|".join(L.TRANSITIONS)})(?:[^\\pL\\pN]|$)', 1) AS phrase FROM k)
SELECT doc_id, phrase, count(*) AS n FROM m WHERE phrase <> '' GROUP BY ALL""",
    "a11_punctuation": f"{DX}, m(mark) AS (VALUES {_PUNCT}) SELECT doc_id, mark, (length(text) - length(replace(text, mark, '')))::BIGINT AS n FROM dx, m WHERE contains(text, mark)",
    "a12_punctuation_pairs": rf"""{DX}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[.,;:!?"''()—–/-]{{2,}}')) AS r FROM dx), p AS (SELECT doc_id, unnest(list_transform(range(1, length(r)), lambda i: substring(r, i, 2))) AS pair FROM r)
SELECT doc_id, pair, count(*) AS n FROM p GROUP BY ALL""",
    "a13_conventions": f"{_CONV} SELECT doc_id, {_DASH} AS dash, {_QUOTE} AS quote, CASE WHEN st AND cu THEN 'mixed' WHEN st THEN 'straight' WHEN cu THEN 'curly' ELSE 'none' END AS apostrophe FROM c",
    "a14_capitalization": f"""{DX}, k AS (SELECT doc_id, {sentences('text')} AS s, regexp_extract_all(text, '[a-zA-Z0-9]+(?:''[a-zA-Z]+)?') AS w FROM dx)
SELECT doc_id, round(coalesce(len(list_filter(s, lambda x: regexp_matches(x, '^[^a-zA-Z]*[A-Z]'))) / nullif(len(s), 0), 0), 6) AS initial_ratio,
round(coalesce(len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x))) / nullif(len(w), 0), 0), 6) AS all_caps_ratio,
round(coalesce(len(list_filter(w, lambda x: length(x) > 1 AND regexp_matches(x, '^[A-Z]') AND x[2:] = lower(x[2:]) AND regexp_matches(x[2:], '[a-z]'))) / nullif(len(w), 0), 0), 6) AS title_case_ratio FROM k""",
    "a15_questions": f"""{DX}, k AS (SELECT doc_id, {sentences('text')} AS s FROM dx), c AS (SELECT doc_id, len(s) AS n, len(list_filter(s, lambda x: contains(x, '?'))) AS q, len(list_filter(s, lambda x: contains(x, '!'))) AS e FROM k)
SELECT doc_id, q AS question_count, e AS exclamation_count, round(coalesce(q / nullif(n, 0), 0), 6) AS question_frequency, round(coalesce(e / nullif(n, 0), 0), 6) AS exclamation_frequency FROM c""",
    "a16_register": f"{_W} SELECT doc_id, round(CASE WHEN len(w) > 0 THEN {_FORMALITY} ELSE 0 END, 6) AS formality, {_in(L.HEDGES)} AS hedges, {_in(L.BOOSTERS)} AS boosters, round(coalesce(len(list_filter(w, lambda x: length(x) >= 12)) / nullif(len(w), 0), 0), 6) AS technical_ratio FROM w",
    "a19_common_phrases": f"""{_PHRASES}, u AS (SELECT doc_id, unnest(p) AS phrase, unnest(range(len(p))) AS k FROM g), c AS (SELECT doc_id, phrase, count(*) AS n, min(k) AS first FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) SELECT doc_id, rank::INT AS rank, phrase, n FROM r WHERE rank <= 10""",
    "a22_terminology": f"""{_PHRASES}, u AS (SELECT doc_id, unnest(b) AS phrase, unnest(range(len(b))) AS k FROM g), c AS (SELECT doc_id, phrase, count(*) AS n, min(k) AS first FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) SELECT doc_id, string_agg(phrase, '|' ORDER BY rank) AS terms, string_agg(n::VARCHAR, ',' ORDER BY rank) AS counts FROM r WHERE rank <= 3 GROUP BY doc_id""",
}
ORACLES["a04_function_words"] = f"{_T} SELECT doc_id, word, count(*) AS n FROM t WHERE list_contains({lst(L.FUNCTION_WORDS)}, word) GROUP BY ALL"
ORACLES["a04_contractions"] = f"{_T} SELECT doc_id, word, count(*) AS n FROM t WHERE contains(word, chr(39)) GROUP BY ALL"
_FIGURES = ("n", "minimum", "p10", "p25", "median", "p75", "p90", "maximum", "mean", "stdev")
_spread = lambda of, name: ", ".join(f"{of}.{f} AS {name}_{f}" for f in _FIGURES)
ORACLES["a17_bundle"] = f"""WITH lx AS ({ORACLES['a04_lexical']}), hx AS ({ORACLES['a04_hapax']}), mt AS ({ORACLES['a05_mattr']}), pn AS ({ORACLES['a06_pronouns']}), sy AS ({ORACLES['a03_a07_syntax']}), cs AS ({ORACLES['a07_clauses']}), ps AS ({ORACLES['a08_passives']}), rh AS ({ORACLES['a09_rhythm']}),
cv AS ({ORACLES['a13_conventions']}), cp AS ({ORACLES['a14_capitalization']}), qu AS ({ORACLES['a15_questions']}), rg AS ({ORACLES['a16_register']}), mk AS ({DX} SELECT doc_id, round(({' + '.join(occurs('text', x) for x in L.PUNCTUATION)}) / greatest(length(text), 1) * 100, 6) AS punctuation_per_100_chars FROM dx)
SELECT lx.*, coalesce(hapax_ratio, 0) AS hapax_ratio, coalesce(mattr, 0) AS mattr, pn.* EXCLUDE doc_id, sy.fragments, sy.run_ons, passive_markers, punctuation_per_100_chars, dash, quote, apostrophe, initial_ratio, all_caps_ratio, title_case_ratio, question_count, exclamation_count, question_frequency, exclamation_frequency, formality, hedges, boosters, technical_ratio, {_spread('sy', 'sentence')}, {_spread('cs', 'clause')}, {_spread('rh', 'paragraph')}
FROM lx LEFT JOIN hx ON hx.doc_id = lx.doc_id LEFT JOIN mt ON mt.doc_id = lx.doc_id JOIN pn ON pn.doc_id = lx.doc_id JOIN sy ON sy.doc_id = lx.doc_id JOIN cs ON cs.doc_id = lx.doc_id JOIN ps ON ps.doc_id = lx.doc_id JOIN rh ON rh.doc_id = lx.doc_id JOIN cv ON cv.doc_id = lx.doc_id JOIN cp ON cp.doc_id = lx.doc_id JOIN qu ON qu.doc_id = lx.doc_id JOIN rg ON rg.doc_id = lx.doc_id JOIN mk ON mk.doc_id = lx.doc_id"""
_MARKS = {"comma": ",", "period": ".", "question": "?", "exclamation": "!", "semicolon": ";", "colon": ":", "dash": "—", "quote": '"', "apostrophe": "'", "parenthesis": "()"}
ORACLES["a18_fingerprint"] = f"""{_W}, l AS (SELECT doc_id, len({words('x')}) AS n FROM (SELECT doc_id, unnest({sentences('text')}) AS x FROM dx)), fs AS (SELECT doc_id, avg(n) AS m, coalesce(var_samp(n), 0) AS v, count(*) AS k FROM l GROUP BY doc_id),
pl AS (SELECT doc_id, len({sentences('x')}) AS n FROM (SELECT doc_id, unnest({paragraphs('text')}) AS x FROM dx)), fp AS (SELECT doc_id, avg(n) AS m, count(*) AS k FROM pl GROUP BY doc_id)
SELECT w.doc_id, round(coalesce(fs.m, 0), 6) AS avg_sentence_length, round(coalesce(fs.v, 0), 6) AS sentence_length_variance, round(coalesce(fp.m, 0), 6) AS avg_paragraph_length, coalesce(fs.k, 0) AS total_sentences, coalesce(fp.k, 0) AS total_paragraphs, len(w) AS total_words,
round(coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0), 6) AS vocabulary_richness, round(coalesce(len(array_to_string(w, '')) / nullif(len(w), 0), 0), 6) AS avg_word_length, round({_FORMALITY}, 6) AS formality,
{', '.join(f"round({occurs('text', c)} / greatest(length(text), 1), 6) AS r_{k}" for k, c in _MARKS.items())} FROM w LEFT JOIN fs ON w.doc_id = fs.doc_id LEFT JOIN fp ON w.doc_id = fp.doc_id"""
