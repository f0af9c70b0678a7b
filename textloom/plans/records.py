"""Queries of scores, drift, decisions, revisions and stores, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.operators import ledger as K
from textloom.operators import scoring as D
from textloom.plans.base import DX, decorated, occurs, over_documents, rounded, strip, table
from textloom.sources import store as ST


def _decisions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("seq"))
    names = F.array(*[F.lit(x) for x in ("AUTHENTIC", "EXCLUDE", "USER_REVISION", "QUOTED", "UNKNOWN")])
    return docs.select((F.col("doc_id") % 50).alias("package_id"), F.col("doc_id").alias("span_id"), "seq", F.element_at(names, ((F.col("doc_id") + F.col("seq")) % 5 + 1).cast("int")).alias("class"))


def _revisions(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("token"), F.when(F.col("role") == "assistant", "accepted").when(F.col("role") == "user", "proposed").otherwise("draft").alias("status"))


#: Revisions that are stored, and a log of proposals: two compete for each head, some name another parent, some documents are new.
_STORED = ("conv_id AS document_id", "turn + 1 AS token", "'rev-' || CAST(turn + 1 AS STRING) AS revision_id")
_BASE = "CASE WHEN conv_id % 10 = 0 AND conv_id % 20 = 0 THEN turn - turn % 2 ELSE 2 + (turn - turn % 2) / 2 END"
_COMPETING = ("conv_id AS document_id", "turn AS seq", f"CAST({_BASE} AS BIGINT) AS base_token", f"CASE WHEN (conv_id + turn) % 7 = 3 THEN 'rev-0' WHEN {_BASE} > 0 THEN 'rev-' || CAST(CAST({_BASE} AS BIGINT) AS STRING) END AS parent_revision_id", "CASE WHEN turn % 5 = 4 THEN 'own-' || CAST(turn AS STRING) END AS revision_id")


def _runs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.dayofyear("ts").alias("run_no"), (F.col("value") / 500).alias("score"))


def _stored(docs):
    """Stored scores of a third of the texts; of other models, expired ones and repeated ones too."""
    rows = docs.where("doc_id % 3 = 0").select(
        F.sha2("text", 256).alias("text_sha256"), F.lit("local").alias("provider"), F.expr("CASE WHEN doc_id % 9 = 0 THEN 'other' ELSE 'heuristic' END").alias("model"), F.lit(1).alias("schema_version"),
        (F.col("doc_id") % 10 / 10).alias("score"), F.lit("human").alias("label"), F.col("doc_id").alias("created_at"), F.expr("CASE WHEN doc_id % 6 = 0 THEN 100 ELSE 200 END").alias("expires_at"),
    )
    return rows


def _length_score(texts):
    """A user's scorer: longer texts score lower."""
    return 1.0 / (1.0 + texts.str.len() / 1000.0)


_KIND = "CASE doc_id % 6 WHEN 0 THEN 'official_spec' WHEN 1 THEN 'paper' WHEN 2 THEN 'release_notes' WHEN 3 THEN 'advisory' WHEN 4 THEN 'community' ELSE 'rumour' END"
_EVIDENCE = (
    "doc_id - doc_id % 11 % 2 AS evidence_id", "CASE WHEN doc_id % 19 = 0 THEN '' ELSE CAST(doc_id % 40 AS STRING) END AS trigger_id", f"{_KIND} AS source_kind", "CASE WHEN doc_id % 9 = 0 THEN 'http' ELSE 'https' END || '://h.example.org/' || (doc_id % 3) AS url",
    "CASE WHEN doc_id % 13 = 0 THEN 'xyz' ELSE {digest} END AS snippet_sha256", "CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'found' END AS summary",
)


def _evidence(spark, sf):
    return table(spark, sf, "documents").selectExpr(*[e.replace("{digest}", "sha2(text, 256)") for e in _EVIDENCE])


_EV = "WITH ev AS (SELECT " + ", ".join(e.replace("{digest}", "sha256(text)").replace("STRING", "VARCHAR") for e in _EVIDENCE) + " FROM documents)"
_PROPOSALS = (
    "doc_id AS proposal_id", "CAST(doc_id % 40 AS STRING) AS trigger_id", "CASE doc_id % 5 WHEN 0 THEN 'metadata_field' WHEN 1 THEN 'telemetry_change' WHEN 2 THEN 'scanner_benchmark_change' WHEN 3 THEN 'privacy_technique' ELSE 'unheard_of' END AS kind",
    "CASE WHEN doc_id % 23 = 0 THEN '' ELSE lang END AS summary", "doc_id % 2 = 0 AS high_impact",
)


def _gate(spark, sf):
    p = table(spark, sf, "documents").selectExpr(*_PROPOSALS)
    decisions = table(spark, sf, "events").selectExpr("user_id AS proposal_id", "event_id AS seq", "CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'deny' ELSE 'later' END AS decision")
    return K.proposal_gate(p, _evidence(spark, sf).where("evidence_id % 3 = 0"), decisions)


_STATES = ("observed", "triaged", "researched", "verified", "proposed", "policy_reviewed", "approved", "quarantined", "validated", "release_approved", "denied", "lost")


def _log(spark, sf):
    e = table(spark, sf, "events")
    names = F.array(*[F.lit(s) for s in _STATES])
    return e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.element_at(names, (F.floor(F.col("event_id") / 7) % 12 + 1).cast("int")).alias("status"))


def _ids(spark, sf):
    c = lambda x: F.col(x).cast("string")
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", K.trigger_id(c("source"), c("lang"), F.lit("")).alias("trigger"), K.evidence_id(c("doc_id"), F.lit("tier2_peer_reviewed"), F.lit("paper"), F.lit("https://h.example.org/"), F.sha2("text", 256), c("lang")).alias("evidence"),
        K.proposal_id(c("doc_id"), F.lit("metadata_field"), c("lang"), F.col("doc_id") % 2 == 0, F.array(c("source"), c("lang"))).alias("proposal"), K.framed_id("proj-", c("source"), c("lang")).alias("project"),
        K.framed_id("import-", c("text"), F.lit("source"), F.lit("text"), F.lit("1"), F.lit("1")).alias("import"),
    )


def _policy(spark, sf):
    names = [*K.ALLOWED_ACTIONS[:4], *K.BLOCKED_ACTIONS[:4], "unheard_of", "metadata_field_addition"]
    actions = table(spark, sf, "events").select(F.col("event_id").alias("action"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 10 + 1).cast("int")).alias("category"))
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "category string")
    return K.policy(actions, one(K.BLOCKED_ACTIONS), one(K.ALLOWED_ACTIONS))


def _counters(spark, sf):
    names = F.array(*[F.lit(x) for x in ("cache_hits", "cache_misses", "duration_ms", "nonsense")])
    e = table(spark, sf, "events")
    steps = e.select(F.dayofyear("ts").alias("run_id"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("name"), F.when(F.col("event_id") % 40 == 2, "set").otherwise("add").alias("op"), (F.col("user_id") % 10).alias("value"))
    return K.run_counters(steps)


def _run_report(spark, sf):
    """Scores by source, written as runs and one of them read back."""
    path = ST.new_path(spark, "runs")
    d = table(spark, sf, "documents")
    for k in range(2):
        ST.write_run(D.corpus_scan(d.where(f"doc_id % 2 = {k}")), path, f"run-{k}")
    return rounded(ST.read_run(spark, path, "run-1").select("doc_id", "label", "score"))


def _retention(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.element_at(F.array(F.lit("cache"), F.lit("reports"), F.lit("originals")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("scope"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    return K.retention(o, F.lit("1998-01-01 00:00:00").cast("timestamp"))


def _versions(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("package"), (F.col("p_partkey") % 12).alias("m"))
    watched = p.where("package % 2 = 0").select("package")
    locked = p.select("package", F.concat(F.lit("1."), F.col("m").cast("string"), F.lit(".0")).alias("locked"))
    known = p.where("package % 3 <> 0").select("package", F.concat(F.lit("1."), (F.col("m") * 5 % 12).cast("string"), F.when(F.col("package") % 7 == 0, ".20240815123456").otherwise(".3")).alias("latest"))
    return K.newer_versions(watched, locked, known)


def _by_name(spark, sf):
    """A registered scorer, called by SQL, and by name where scores are looked up."""
    D.register_scorer(spark, "length_score", _length_score)
    d = decorated(spark, sf)
    d.createOrReplaceTempView("scored_texts")
    by_sql = spark.sql("SELECT doc_id, round(length_score(text), 6) AS score FROM scored_texts")
    scanned = D.corpus_scan(d, "length_score").select("doc_id", "label")
    return by_sql.join(scanned, "doc_id")


QUERIES = {
    "d01_components": over_documents(D.components),
    "d04_scores": over_documents(D.scores),
    "d05_lookup": over_documents(lambda d: D.lookup_or_compute(d, _stored(d), now=F.lit(150))),
    "d06_corpus_scan": over_documents(lambda d: D.corpus_scan(d).groupBy("source", "label").agg(F.count("*").alias("n"), F.sum("score").alias("total"))),
    "d06_unscored": over_documents(lambda d: D.corpus_scan(d, None)),
    "d07_run_report": _run_report,
    "u05_scorer_hook": over_documents(lambda d: D.hooked(_length_score)(d)),
    "u05_scorer_by_name": _by_name,
    "k09_problems": over_documents(lambda d: K.integrity_problems(d.select(F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("id"), F.col("text").alias("content"), (F.length("text") + (F.col("doc_id") % 7 == 0).cast("int")).alias("length"), (F.size(F.split("text", "\n", -1)) - (F.col("doc_id") % 11 == 0).cast("int")).alias("lines")))),
    "k11_counters": _counters,
    "m04_proposal_gate": _gate,
    "w01_decisions": lambda spark, sf: K.latest_decisions(_decisions(spark, sf)),
    "w02_revisions": lambda spark, sf: K.current_revisions(_revisions(spark, sf)),
    "w03_drift": lambda spark, sf: rounded(D.drift(_runs(spark, sf), 0.02)),
    "l13_proposals": lambda spark, sf: K.accept_proposals(table(spark, sf, "conversations").where("turn < 2 AND conv_id % 10 > 0").selectExpr(*_STORED), table(spark, sf, "conversations").selectExpr(*_COMPETING)),
    "l13_chain_gaps": lambda spark, sf: K.chain_gaps(_revisions(spark, sf).where("token % 5 <> 2")),
    "g09_project_status": lambda spark, sf: K.project_status(_revisions(spark, sf)),
    "g06_sufficiency": lambda spark, sf: K.sufficiency(_evidence(spark, sf).withColumn("tier", F.expr("CASE source_kind WHEN 'official_spec' THEN 1 WHEN 'paper' THEN 2 WHEN 'release_notes' THEN 3 WHEN 'advisory' THEN 4 WHEN 'community' THEN 5 END"))),
    "m01_transitions": lambda spark, sf: K.illegal_transitions(_log(spark, sf)),
    "m02_ids": _ids,
    "m03_evidence_problems": lambda spark, sf: K.evidence_problems(_evidence(spark, sf)),
    "j16_newer_versions": _versions,
    "j18_policy": _policy,
    "k08_content_store": over_documents(lambda d: K.content_store(d.select(F.col("text").alias("content")), d.where("doc_id % 4 = 0").select(F.sha2("text", 256).alias("id"))).select("id")),
    "k09_integrity": over_documents(lambda d: K.integrity_violations(d.select(F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("id"), F.col("text").alias("content")))),
    "k10_encryption": over_documents(lambda d: d.select("doc_id", F.md5(K.decrypted(K.encrypted(F.col("text"), F.lit("0123456789abcdef")), F.lit("0123456789abcdef"))).alias("digest"))),
    "x05_retention": _retention,
}

_D = f"""{DX}, k AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*') AS w, list_transform(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: {strip('x')}), lambda x: x <> ''), lambda x: len(string_split_regex(x, '[\\x09-\\x0D ]+'))) AS ls FROM dx),
b AS (SELECT *, list_transform(range(len(w) - 1), lambda i: lower(w[i + 1] || ' ' || w[i + 2])) AS g FROM k),
c AS (SELECT doc_id, len(w) AS n_words, len(ls) AS n_sentences, CASE WHEN len(w) >= 3 THEN (len(g) - len(list_distinct(g))) / len(g) ELSE 0 END AS bigram_repeat, coalesce(list_aggregate(ls, 'var_pop'), 0) AS sentence_variance, len(regexp_extract_all(regexp_replace(text, '[À-ɏ]', 'x', 'g'), '(?i)\\b(I|me|my|we|our|us)\\b')) AS pronouns,
 ({' + '.join(occurs('lower(text)', p) for p in L.STOCK_PHRASES)})::BIGINT AS phrases, coalesce(len(array_to_string(w, '')) / nullif(len(w), 0), 0) AS avg_word_length FROM b),
p AS (SELECT doc_id, n_words >= 3 AND n_sentences >= 2 AS ok, greatest(0, least(1, least(bigram_repeat / 0.15, 1) * 0.15 + (CASE WHEN sentence_variance < 40 THEN 1 - least(sentence_variance / 40, 1) ELSE 0 END) * 0.10 + greatest(0, 1 - pronouns / 5) * 0.35 * 0.20 + least(phrases / 6, 1) * 0.45
 + (CASE WHEN avg_word_length <= 3 THEN 1 WHEN avg_word_length >= 6 THEN 0 ELSE 1 - (avg_word_length - 3) / 3 END) * 0.10)) AS s FROM c),
sc AS (SELECT doc_id, CASE WHEN ok THEN s ELSE 0.5 END AS score, CASE WHEN NOT ok THEN 'uncertain' WHEN s < 0.35 THEN 'human' WHEN s < 0.65 THEN 'uncertain' ELSE 'ai' END AS label FROM p)"""
_R = "WITH r AS (SELECT conv_id AS document_id, turn + 1 AS token, CASE role WHEN 'assistant' THEN 'accepted' WHEN 'user' THEN 'proposed' ELSE 'draft' END AS status FROM conversations)"
_DEC = "WITH d AS (SELECT doc_id % 50 AS package_id, doc_id AS span_id, s AS seq, ['AUTHENTIC', 'EXCLUDE', 'USER_REVISION', 'QUOTED', 'UNKNOWN'][(doc_id + s) % 5 + 1] AS class FROM documents, range(3) t(s))"
ORACLES = {
    "d01_components": f"{_D} SELECT doc_id, n_words, n_sentences, round(bigram_repeat, 6) AS bigram_repeat, round(sentence_variance, 6) AS sentence_variance, pronouns, phrases, round(avg_word_length, 6) AS avg_word_length FROM c",
    "d04_scores": f"{_D} SELECT doc_id, round(score, 6) AS score, label FROM sc",
    "d05_lookup": f"""{_D}, h AS (SELECT sha256(text) AS text_sha256, min(doc_id) AS doc_id FROM dx GROUP BY 1), st AS (SELECT sha256(text) AS text_sha256, (doc_id % 10) / 10 AS score, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS nth FROM dx WHERE doc_id % 3 = 0 AND doc_id % 9 <> 0 AND doc_id % 6 <> 0)
SELECT h.text_sha256, 'local' AS provider, 'heuristic' AS model, 1 AS schema_version, round(coalesce(st.score, sc.score), 6) AS score, CASE WHEN st.score IS NOT NULL THEN 'human' ELSE label END AS label, st.score IS NOT NULL AS hit FROM h JOIN sc ON h.doc_id = sc.doc_id LEFT JOIN st ON h.text_sha256 = st.text_sha256 AND nth = 1""",
    "d06_corpus_scan": f"{_D} SELECT source, CASE WHEN label IN ('human', 'ai') THEN label ELSE 'unknown' END AS label, count(*) AS n, round(sum(score), 6) AS total FROM sc JOIN dx ON sc.doc_id = dx.doc_id GROUP BY 1, 2",
    "d06_unscored": f"{DX} SELECT doc_id, source, 'unknown' AS label, NULL::DOUBLE AS score FROM dx",
    "d07_run_report": f"{_D.replace(DX, 'WITH dx AS (SELECT doc_id, source, lang, text FROM documents)')} SELECT doc_id, CASE WHEN label IN ('human', 'ai') THEN label ELSE 'unknown' END AS label, round(score, 6) AS score FROM sc WHERE doc_id % 2 = 1",
    "u05_scorer_hook": f"{DX} SELECT doc_id, round(1 / (1 + length(text) / 1000), 6) AS score, CASE WHEN 1 / (1 + length(text) / 1000) < 0.35 THEN 'human' WHEN 1 / (1 + length(text) / 1000) < 0.65 THEN 'uncertain' ELSE 'ai' END AS label FROM dx",
    "u05_scorer_by_name": f"{DX} SELECT doc_id, round(1 / (1 + length(text) / 1000), 6) AS score, CASE WHEN 1 / (1 + length(text) / 1000) < 0.35 THEN 'human' WHEN 1 / (1 + length(text) / 1000) < 0.65 THEN 'unknown' ELSE 'ai' END AS label FROM dx",
    "k09_problems": f"{DX} SELECT CASE WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS id, unnest(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'sha256' END, CASE WHEN doc_id % 7 = 0 THEN 'length' END, CASE WHEN doc_id % 11 = 0 THEN 'lines' END], lambda x: x IS NOT NULL)) AS problem FROM dx",
    "k11_counters": "WITH s AS (SELECT dayofyear(ts)::INT AS run_id, event_id AS seq, ['cache_hits', 'cache_misses', 'duration_ms', 'nonsense'][event_id % 4 + 1] AS name, event_id % 40 = 2 AS put, user_id % 10 AS v FROM events), m AS (SELECT run_id, name, max(CASE WHEN put THEN seq END) AS f FROM s GROUP BY ALL) SELECT s.run_id, s.name, sum(v)::BIGINT AS value FROM s JOIN m ON s.run_id = m.run_id AND s.name = m.name WHERE s.name <> 'nonsense' AND (f IS NULL OR seq >= f) GROUP BY ALL",
    "m04_proposal_gate": _EV + ", p AS (SELECT " + ", ".join(_PROPOSALS).replace("STRING", "VARCHAR") + """ FROM documents), t AS (SELECT trigger_id, bool_or(source_kind = 'official_spec') OR count(DISTINCT CASE WHEN source_kind IN ('paper', 'release_notes') THEN url END) >= 2 AS high, bool_or(source_kind IN ('official_spec', 'paper', 'release_notes', 'advisory')) AS basic FROM ev WHERE evidence_id % 3 = 0 GROUP BY 1),
l AS (SELECT user_id AS proposal_id, arg_max(event_type, event_id) AS e FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), c(kind, category) AS (VALUES ('metadata_field', 'metadata_field_addition'), ('telemetry_change', 'telemetry_documentation'), ('scanner_benchmark_change', 'scanner_benchmark'), ('privacy_technique', 'privacy_technique_research'))
SELECT p.proposal_id, category, CASE WHEN category IS NULL THEN 'refused.kind' WHEN NOT coalesce(CASE WHEN high_impact THEN high ELSE basic END, false) THEN 'refused.evidence' WHEN trim(summary) = '' THEN 'refused.summary' WHEN e = 'view' THEN 'denied' WHEN e = 'click' THEN 'approved' ELSE 'policy_reviewed' END AS status, false AS blocked_action FROM p LEFT JOIN t ON p.trigger_id = t.trigger_id LEFT JOIN l ON l.proposal_id = p.proposal_id LEFT JOIN c ON c.kind = p.kind""",
    "w01_decisions": f"{_DEC}, l AS (SELECT *, row_number() OVER (PARTITION BY package_id, span_id ORDER BY seq DESC) AS nth FROM d WHERE class <> 'UNKNOWN') SELECT package_id, span_id, class, class <> 'EXCLUDE' AS kept FROM l WHERE nth = 1",
    "w02_revisions": f"{_R} SELECT document_id, max(token) AS head, max(CASE WHEN status = 'accepted' THEN token END) AS accepted, count(*) AS n_revisions FROM r GROUP BY document_id",
    "w03_drift": "WITH m AS (SELECT dayofyear(ts)::INT AS run_no, avg(value / 500) AS mean_score FROM events GROUP BY 1), l AS (SELECT *, abs(mean_score - lag(mean_score) OVER (ORDER BY run_no)) AS delta FROM m) SELECT run_no, round(mean_score, 6) AS mean_score, round(delta, 6) AS delta, delta > 0.02 AS drifted FROM l WHERE delta IS NOT NULL",
    "l13_proposals": "WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS k FROM (SELECT " + ", ".join(_COMPETING).replace("STRING", "VARCHAR") + """ FROM conversations)),
f AS (SELECT DISTINCT c.conv_id AS document_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::BIGINT AS base_token, '' AS state, h.token AS head, 'rev-' || h.token AS rid FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) + 1 AS token FROM conversations WHERE turn < 2 AND conv_id % 10 > 0 GROUP BY 1) h ON h.conv_id = c.conv_id
UNION ALL SELECT document_id, k, seq, base_token, state, CASE state WHEN 'accepted' THEN base_token + 1 ELSE head END, CASE state WHEN 'accepted' THEN coalesce(own, 'rev-' || (base_token + 1)) ELSE rid END FROM (SELECT f.document_id, p.k, p.seq, p.base_token, f.head, f.rid, p.revision_id AS own,
CASE WHEN f.head IS NULL THEN CASE WHEN p.base_token = 0 AND p.parent_revision_id IS NULL THEN 'accepted' ELSE 'unknown_document' END WHEN p.base_token <> f.head THEN 'stale' WHEN p.parent_revision_id IS DISTINCT FROM f.rid THEN 'stale_parent' ELSE 'accepted' END AS state FROM f JOIN p ON p.document_id = f.document_id AND p.k = f.k + 1))
SELECT document_id, seq, base_token, state, CASE state WHEN 'accepted' THEN head END AS token, CASE state WHEN 'accepted' THEN rid END AS revision_id FROM f WHERE k > 0""",
    "l13_chain_gaps": f"{_R}, l AS (SELECT document_id, token, lag(token) OVER (PARTITION BY document_id ORDER BY token) AS before FROM r WHERE token % 5 <> 2) SELECT * FROM l WHERE before IS NOT NULL AND token <> before + 1",
    "g09_project_status": f"{_R}, d AS (SELECT document_id, count(*) AS n, max(CASE WHEN status = 'accepted' THEN token END) AS a FROM r GROUP BY 1) SELECT count(*) AS documents, sum(n)::BIGINT AS revisions, count(a) AS with_accepted FROM d",
    "g06_sufficiency": f"{_EV} SELECT trigger_id, bool_or(source_kind = 'official_spec') OR count(DISTINCT CASE WHEN source_kind IN ('paper', 'release_notes') THEN url END) >= 2 AS high_impact_met, bool_or(source_kind IN ('official_spec', 'paper', 'release_notes', 'advisory')) AS basic FROM ev GROUP BY 1",
    "m01_transitions": """WITH l AS (SELECT user_id AS item_id, event_id AS seq, ['observed', 'triaged', 'researched', 'verified', 'proposed', 'policy_reviewed', 'approved', 'quarantined', 'validated', 'release_approved', 'denied', 'lost'][event_id // 7 % 12 + 1] AS status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY item_id ORDER BY seq) AS before FROM l)
SELECT item_id, seq, status FROM b WHERE before IS NOT NULL AND NOT ((status = 'denied' AND before NOT IN ('denied', 'release_approved', 'lost')) OR before || '>' || status IN ('observed>triaged', 'triaged>researched', 'researched>verified', 'verified>proposed', 'proposed>policy_reviewed', 'policy_reviewed>approved', 'approved>quarantined', 'quarantined>validated', 'validated>release_approved'))""",
    "m02_ids": """SELECT doc_id, 'trig-' || sha256(source || chr(0) || lang || chr(0))[1:24] AS "trigger", 'ev-' || sha256(doc_id || chr(0) || 'tier2_peer_reviewed' || chr(0) || 'paper' || chr(0) || 'https://h.example.org/' || chr(0) || sha256(text) || chr(0) || lang)[1:24] AS evidence,
'prop-' || sha256(doc_id || chr(0) || 'metadata_field' || chr(0) || lang || chr(0) || CASE WHEN doc_id % 2 = 0 THEN 'high_impact' ELSE 'not_high_impact' END || chr(0) || source || chr(0) || lang)[1:24] AS proposal, 'proj-' || sha256(source || chr(0) || lang)[1:24] AS project, 'import-' || sha256(text || chr(0) || 'source' || chr(0) || 'text' || chr(0) || '1' || chr(0) || '1')[1:32] AS "import" FROM documents""",
    "m03_evidence_problems": f"{_EV} SELECT evidence_id, 'url' AS problem FROM ev WHERE url NOT LIKE 'https://%' UNION ALL SELECT evidence_id, 'digest' FROM ev WHERE NOT regexp_matches(snippet_sha256, '^[0-9a-f]{{64}}$') UNION ALL SELECT evidence_id, 'summary' FROM ev WHERE trim(summary) = '' UNION ALL SELECT evidence_id, 'trigger' FROM ev WHERE trigger_id = '' UNION ALL SELECT evidence_id, 'source_kind' FROM ev WHERE source_kind = 'rumour' UNION ALL SELECT evidence_id, 'repeated' FROM ev GROUP BY 1 HAVING count(*) > 1",
    "j16_newer_versions": "WITH p AS (SELECT p_partkey AS package, p_partkey % 12 AS m FROM part), v AS (SELECT package, '1.' || m || '.0' AS locked, '1.' || (m * 5 % 12) || CASE package % 7 WHEN 0 THEN '.20240815123456' ELSE '.3' END AS latest FROM p WHERE package % 2 = 0 AND package % 3 <> 0) SELECT * FROM v WHERE list_transform(regexp_extract_all(latest, '\\d+'), lambda x: x::BIGINT) > list_transform(regexp_extract_all(locked, '\\d+'), lambda x: x::BIGINT)",
    "j18_policy": "SELECT event_id AS action, CASE WHEN event_id % 10 < 4 OR event_id % 10 = 9 THEN 'allow' ELSE 'block' END AS decision FROM events",
    "k08_content_store": f"{DX} SELECT DISTINCT sha256(text) AS id FROM dx WHERE sha256(text) NOT IN (SELECT sha256(text) FROM dx WHERE doc_id % 4 = 0)",
    "k09_integrity": f"{DX} SELECT sha256(text || 'x') AS id FROM dx WHERE doc_id % 5 = 0",
    "k10_encryption": f"{DX} SELECT doc_id, md5(text) AS digest FROM dx",
    "x05_retention": "SELECT o_orderkey::VARCHAR AS path, ['cache', 'reports', 'originals'][o_orderkey % 3 + 1] AS scope, (epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate::TIMESTAMP))::BIGINT // 86400 AS age_days FROM orders WHERE o_orderkey % 3 < 2 AND (epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate::TIMESTAMP))::BIGINT // 86400 > 30",
}
