"""Append-only logs and what is derived from them: decisions, revisions, evidence, policies, content stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of workflow states. A decision may deny any state but the last; both are final.
FLOW = ("observed", "triaged", "researched", "verified", "proposed", "policy_reviewed", "approved", "quarantined", "validated", "release_approved")
DENIED = "denied"
#: Kinds of sources with their tier, kinds of proposals with their category of action, and what policy says of categories.
SOURCE_TIERS = {"official_spec": 1, "paper": 2, "release_notes": 3, "advisory": 4, "community": 5}
PROPOSAL_CATEGORIES = {
    "metadata_field": "metadata_field_addition", "container_mechanism": "container_mechanism_research", "provenance_standard": "provenance_standard_research",
    "telemetry_change": "telemetry_documentation", "parser_exporter_change": "dependency_update_proposal", "privacy_technique": "privacy_technique_research",
    "scanner_benchmark_change": "scanner_benchmark",
}
ALLOWED_ACTIONS = ("metadata_field_addition", "container_mechanism_research", "provenance_standard_research", "telemetry_documentation", "privacy_technique_research", "scanner_benchmark", "dependency_update_proposal")
BLOCKED_ACTIONS = ("upload_private_document", "detector_optimization", "provenance_destruction", "auto_merge", "auto_publish", "auto_deploy", "watermark_key_recovery", "code_change_without_review")
RETENTION_SCOPES = ("cache", "reports")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def latest_decisions(decisions: DataFrame, keys: tuple[str, ...] = ("package_id", "span_id")) -> DataFrame:
    """The decision with the highest seq per key, of ties the last class by name.

    An exclusion takes the span out until a later class restores it.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("seq"), F.desc("class"))
    last = decisions.where("class <> 'UNKNOWN'").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return last.select(*keys, "class", (F.col("class") != "EXCLUDE").alias("kept"))


def current_revisions(revisions: DataFrame) -> DataFrame:
    """Per document: the head token and the last accepted token."""
    return revisions.groupBy("document_id").agg(F.max("token").alias("head"), F.max(F.when(F.col("status") == "accepted", F.col("token"))).alias("accepted"), F.count("*").alias("n_revisions"))


JUDGED = "document_id long, seq long, base_token long, state string, token long, revision_id string"


def judge(head: tuple[int, str] | None, base: int | None, parent: str | None, revision_id: str | None) -> tuple[str, tuple[int, str] | None]:
    """What becomes of one proposal on a document's head (token, revision id; None where there is none), and the head after it."""
    if head is None:
        if base != 0 or parent is not None:  # only a first revision needs none to stand on
            return "unknown_document", None
        return "accepted", (1, revision_id or "rev-1")
    if base != head[0]:
        return "stale", head
    if parent != head[1]:
        return "stale_parent", head
    return "accepted", (head[0] + 1, revision_id or f"rev-{head[0] + 1}")


def heads(revisions: DataFrame) -> DataFrame:
    """document_id, token, revision_id of each document's newest revision."""
    newest = revisions.groupBy("document_id").agg(F.max(F.struct("token", "revision_id")).alias("h"))
    return newest.select("document_id", F.col("h.token").cast("long").alias("token"), F.col("h.revision_id").alias("revision_id"))


def _fold(frames):
    """Rows in order of documents, each document's head (kind 0) before its proposals by seq, to judged proposals."""
    import pandas as pd

    now, head = object(), None
    none = lambda x: None if pd.isna(x) else x
    for frame in frames:
        out = []
        for doc, kind, seq, base, parent, own in zip(*(frame[c].tolist() for c in ("document_id", "kind", "seq", "base_token", "parent_revision_id", "revision_id"))):
            doc = none(doc)
            if doc != now:
                now, head = doc, None
            if kind == 0:
                head = (int(base), own)
                continue
            base = None if pd.isna(base) else int(base)
            state, head = judge(head, base, none(parent), none(own))
            new = state == "accepted"
            out.append((doc, none(seq), base, state, head[0] if new else None, head[1] if new else None))
        yield pd.DataFrame(out, columns=["document_id", "seq", "base_token", "state", "token", "revision_id"]).astype({c: "Int64" for c in ("document_id", "seq", "base_token", "token")})


def accept_proposals(revisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Optimistic acceptance, in order of seq: document_id, seq, base_token, state, token, revision_id.

    revisions: (document_id, token, revision_id); proposals: (document_id, seq, base_token, parent_revision_id,
    revision_id). A proposal is accepted if its base is the head's token and its parent the head's id; it is then the
    head, so of two on one head the later one is stale. stale: another base; stale_parent: the base's token, but another parent;
    unknown_document: no head, unless the proposal is a first revision (base 0, no parent). Equal seq: by revision id. Refused
    proposals have no token; an id that is left out is "rev-<token>".

    The outcome of a proposal depends on all before it: a document's rows are sorted within its partition and pass
    by once with the head as the only state, so a document of many proposals takes time but no memory.
    """
    text = F.lit(None).cast("string")
    first = heads(revisions).select(F.col("document_id").cast("long").alias("document_id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"), F.col("token").alias("base_token"), text.alias("parent_revision_id"), "revision_id")
    then = proposals.select(F.col("document_id").cast("long").alias("document_id"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("base_token").cast("long").alias("base_token"), "parent_revision_id", "revision_id")
    rows = first.unionByName(then).repartition("document_id").sortWithinPartitions("document_id", "kind", "seq", "revision_id", "base_token", "parent_revision_id")
    return rows.mapInPandas(_fold, JUDGED)


def chain_gaps(revisions: DataFrame) -> DataFrame:
    """Revisions whose token doesn't follow the one before in their document."""
    before = F.lag("token").over(Window.partitionBy("document_id").orderBy("token"))
    return revisions.withColumn("before", before).where("before IS NOT NULL AND token <> before + 1").select("document_id", "token", "before")


def project_status(revisions: DataFrame) -> DataFrame:
    """Documents, revisions and documents with an accepted one."""
    r = current_revisions(revisions)
    return r.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_revisions"), F.lit(0)).alias("revisions"), F.count("accepted").alias("with_accepted"))


def framed_id(prefix: str, *fields: Column) -> Column:
    """prefix and the first hex digits of sha256 over the fields, framed by NUL: 32 of an import, else 24."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *fields), 256), 1, 32 if prefix == "import-" else 24))


def trigger_id(kind: Column, summary: Column, note: Column) -> Column:
    return framed_id("trig-", kind, summary, note)


def evidence_id(trigger: Column, tier: Column, source_kind: Column, url: Column, digest: Column, summary: Column) -> Column:
    return framed_id("ev-", trigger, tier, source_kind, url, digest, summary)


def proposal_id(trigger: Column, kind: Column, summary: Column, high_impact: Column, evidence_ids: Column) -> Column:
    """evidence_ids: an array in the proposal's own order."""
    return framed_id("prop-", trigger, kind, summary, F.when(high_impact, "high_impact").otherwise("not_high_impact"), evidence_ids)


def evidence_problems(evidence: DataFrame) -> DataFrame:
    """evidence_id, problem of evidence (evidence_id, trigger_id, source_kind, url, snippet_sha256, summary).

    No trigger, URLs that aren't https, digests that aren't 64 hex digits, empty summaries, unknown source kinds,
    repeated ids.
    """
    checks = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("url").rlike("^https://"), F.lit(False)), "url"),
        F.when(~F.coalesce(F.col("snippet_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest"),
        F.when(F.coalesce(F.trim("summary"), F.lit("")) == "", "summary"),
        F.when(F.coalesce(F.col("trigger_id").cast("string"), F.lit("")) == "", "trigger"),
        F.when(~F.coalesce(F.col("source_kind").isin(*SOURCE_TIERS), F.lit(False)), "source_kind"),
    ))
    single = evidence.select("evidence_id", F.explode(checks).alias("problem"))
    repeated = evidence.groupBy("evidence_id").count().where("count > 1").select("evidence_id", F.lit("repeated").alias("problem"))
    return single.unionByName(repeated)


def sufficiency(evidence: DataFrame) -> DataFrame:
    """Per trigger: high_impact_met (one of tier 1, or two URLs of tiers 2 and 3) and basic (any of tiers 1 to 4)."""
    urls = F.count_distinct(F.when(F.col("tier").isin(2, 3), F.col("url")))
    return evidence.groupBy("trigger_id").agg((F.coalesce(F.bool_or(F.col("tier") == 1), F.lit(False)) | (urls >= 2)).alias("high_impact_met"), F.coalesce(F.bool_or(F.col("tier").between(1, 4)), F.lit(False)).alias("basic"))


def policy(actions: DataFrame, blocked: DataFrame, allowed: DataFrame) -> DataFrame:
    """action, decision: blocked wins, then allowed, and what is in neither list is blocked."""
    b, a = blocked.select("category", F.lit(True).alias("b")).distinct(), allowed.select("category", F.lit(True).alias("a")).distinct()
    decided = actions.join(b, "category", "left").join(a, "category", "left")
    return decided.select("action", F.when(F.col("b"), "block").when(F.col("a"), "allow").otherwise("block").alias("decision"))


def next_state(status: Column) -> Column:
    """The state after a state; null for final and unknown ones."""
    return F.try_element_at(_map(dict(zip(FLOW, FLOW[1:]))), status)


def illegal_transitions(log: DataFrame) -> DataFrame:
    """item_id, seq, status: steps that are neither to the next state nor a denial of an item that isn't final."""
    before = F.lag("status").over(Window.partitionBy("item_id").orderBy("seq"))
    rows = log.withColumn("before", before).where("before IS NOT NULL")
    ahead = F.coalesce(F.col("status") == next_state(F.col("before")), F.lit(False))
    denied = (F.col("status") == DENIED) & F.col("before").isin(*FLOW[:-1])
    return rows.where(~(ahead | denied)).select("item_id", "seq", "status")


def proposal_gate(proposals: DataFrame, evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposal_id, category, status, blocked_action of proposals (proposal_id, trigger_id, kind, summary, high_impact).

    Too little evidence for the impact or an empty summary is refused at creation. Policy marks what is blocked and
    never approves. Then the last decision (proposal_id, seq, decision: approve or deny) counts, except that what is
    blocked or in no list can't be approved. evidence: (trigger_id, source_kind, url).
    """
    held = sufficiency(evidence.withColumn("tier", F.try_element_at(_map(SOURCE_TIERS), F.col("source_kind"))))
    last = decisions.where(F.col("decision").isin("approve", "deny")).groupBy("proposal_id").agg(F.max_by("decision", "seq").alias("decision"))
    rows = proposals.join(held, "trigger_id", "left").join(last, "proposal_id", "left").withColumn("category", F.try_element_at(_map(PROPOSAL_CATEGORIES), F.col("kind")))
    enough = F.coalesce(F.when(F.col("high_impact"), F.col("high_impact_met")).otherwise(F.col("basic")), F.lit(False))
    blocked, allowed = F.coalesce(F.col("category").isin(*BLOCKED_ACTIONS), F.lit(False)), F.coalesce(F.col("category").isin(*ALLOWED_ACTIONS), F.lit(False))
    status = (
        F.when(F.col("category").isNull(), "refused.kind").when(~enough, "refused.evidence").when(F.coalesce(F.trim("summary"), F.lit("")) == "", "refused.summary")
        .when(F.col("decision") == "deny", "denied").when((F.col("decision") == "approve") & allowed & ~blocked, "approved").otherwise("policy_reviewed")
    )
    return rows.select("proposal_id", "category", status.alias("status"), blocked.alias("blocked_action"))


def content_store(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (id, content) to append: not stored yet, each content once, id = sha256 of the content."""
    rows = new.select(F.sha2("content", 256).alias("id"), "content").dropDuplicates(["id"])
    return rows.join(stored.select("id"), "id", "left_anti")


def store_conflicts(store: DataFrame) -> DataFrame:
    """Ids under which different contents are stored."""
    return store.groupBy("id").agg(F.count_distinct("content").alias("n")).where("n > 1")


def integrity_violations(store: DataFrame) -> DataFrame:
    """Stored rows whose content no longer has its id as digest."""
    return store.where(F.sha2("content", 256) != F.col("id")).select("id")


def integrity_problems(store: DataFrame) -> DataFrame:
    """id, problem of stored rows (id, content, length, lines) whose digest, length or number of lines isn't what was stored.

    Length counts characters, lines the parts between line ends. A row without content is a problem of all three.
    """
    differs = lambda was, now, name: F.when(~was.eqNullSafe(now), name)
    c = F.col("content")
    found = F.array_compact(F.array(differs(F.col("id"), F.sha2(c, 256), "sha256"), differs(F.col("length").cast("long"), F.length(c).cast("long"), "length"), differs(F.col("lines").cast("long"), F.size(F.split(c, "\n", -1)).cast("long"), "lines")))
    return store.select("id", F.explode(found).alias("problem"))


def newer_versions(watched: DataFrame, locked: DataFrame, known: DataFrame) -> DataFrame:
    """package, locked, latest: watched packages whose known version is higher by its numbers, of any number of digits."""
    plain = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    # of numbers without leading zeros the longer one is larger, of equally long ones the later by its digits
    parts = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: F.struct(F.length(plain(x)).alias("n"), plain(x).alias("digits")))
    rows = watched.join(locked, "package").join(known, "package")
    return rows.where(parts(F.col("latest")) > parts(F.col("locked"))).select("package", "locked", "latest")


def retention(files: DataFrame, now: Column, enabled: bool = True, days: int = 30) -> DataFrame:
    """path, scope, age_days of files (path, scope, modified) of the kept scopes older than `days`; nothing is deleted.

    Where the privacy policy doesn't enforce retention (enabled), nothing is reported.
    """
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("modified")) / 86400)
    rows = files.where(F.col("scope").isin(*RETENTION_SCOPES)).select("path", "scope", age.cast("long").alias("age_days"))
    return rows.where((F.col("age_days") > days) & F.lit(enabled))


#: Names that run counters may have.
COUNTERS = ("rewrite_attempts", "repair_attempts", "detector_calls", "cache_hits", "cache_misses", "retry_count", "duration_ms", "input_chars", "output_chars")


def run_counters(steps: DataFrame) -> DataFrame:
    """run_id, name, value of counter steps (run_id, seq, name, op, value): add to the value, or set it and go on.

    Unknown names are left out. What was added before the last set is gone, so each counter is one sum after it.
    """
    rows = steps.where(F.col("name").isin(*COUNTERS))
    reset = rows.groupBy("run_id", "name").agg(F.max(F.when(F.col("op") == "set", F.col("seq"))).alias("from"))
    kept = rows.join(reset, ["run_id", "name"]).where("from IS NULL OR seq >= from")
    return kept.groupBy("run_id", "name").agg(F.sum("value").alias("value"))


def encrypted(c: Column, key: Column, provider: str = "local") -> Column:
    """encv1:<provider>:<base64> of the value under AES-GCM."""
    return F.concat(F.lit(f"encv1:{provider}:"), F.base64(F.aes_encrypt(c, key, F.lit("GCM"))))


def decrypted(c: Column, key: Column) -> Column:
    """The value of encrypted(); null where the envelope or the key is wrong; plain values come back as they are."""
    body = F.unbase64(F.regexp_extract(c, r"(?s)^encv1:[^:]*:(.*)$", 1))
    return F.when(c.startswith("encv1:"), F.try_aes_decrypt(body, key, F.lit("GCM")).cast("string")).otherwise(c)
