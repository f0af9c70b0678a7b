"""A heuristic text score from column arithmetic, and a result table keyed by the text's hash."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T

if TYPE_CHECKING:
    import pandas as pd

WORD = "[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"
WEIGHTS = {"bigram": 0.15, "variance": 0.10, "pronoun": 0.20, "phrase": 0.45, "word_length": 0.10}


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_sentences and the raw figures: repeated bigrams, sentence variance, pronouns, phrases, word length."""
    t = F.col("text")
    w = F.col("w")
    bigrams = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.lower(F.concat_ws(" ", a, b)))
    parts = F.filter(F.transform(F.split(t, "[.!?]+"), T.strip), lambda s: s != "")
    rows = docs.select("doc_id", "text", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"), F.transform(parts, lambda s: F.size(F.split(s, T.SPACE + "+")).cast("double")).alias("ls"))
    rows = rows.withColumn("b", bigrams)
    lower = F.lower(t)
    phrases = sum((T.occurrences(lower, p) for p in L.STOCK_PHRASES), F.lit(0))
    n = F.size("ls")
    total = F.aggregate("ls", F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate("ls", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select(
        "doc_id", F.size(w).cast("long").alias("n_words"), n.cast("long").alias("n_sentences"),
        F.when(F.size(w) >= 3, (F.size("b") - F.size(F.array_distinct("b"))) / F.size("b")).otherwise(0.0).alias("bigram_repeat"),
        F.when(n > 1, squares / n - (total / n) * (total / n)).otherwise(0.0).alias("sentence_variance"),
        F.size(F.regexp_extract_all(t, F.lit(r"(?i)\b(I|me|my|we|our|us)\b"), F.lit(0))).cast("long").alias("pronouns"),
        phrases.cast("long").alias("phrases"), T.ratio(F.length(F.array_join(w, "")), F.size(w)).alias("avg_word_length"),
    )


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, score, label: weighted parts between 0 and 1; too little text is 0.5 and uncertain."""
    c = components(docs)
    one = F.lit(1.0)
    part = {
        "bigram": F.least(F.col("bigram_repeat") / 0.15, one),
        "variance": F.when(F.col("sentence_variance") < 40.0, 1.0 - F.least(F.col("sentence_variance") / 40.0, one)).otherwise(0.0),
        "pronoun": F.greatest(F.lit(0.0), 1.0 - F.col("pronouns") / 5.0) * 0.35,
        "phrase": F.least(F.col("phrases") / 6.0, one),
        "word_length": F.when(F.col("avg_word_length") <= 3.0, 1.0).when(F.col("avg_word_length") >= 6.0, 0.0).otherwise(1.0 - (F.col("avg_word_length") - 3.0) / 3.0),
    }
    whole = sum((part[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    enough = (F.col("n_words") >= 3) & (F.col("n_sentences") >= 2)
    c = c.withColumn("score", F.when(enough, F.greatest(F.lit(0.0), F.least(one, whole))).otherwise(0.5))
    s = F.col("score")
    return c.select("doc_id", "score", F.when(~enough, "uncertain").when(s < 0.35, "human").when(s < 0.65, "uncertain").otherwise("ai").alias("label"))


SCORE_KEY = ("text_sha256", "provider", "model", "schema_version")


Scorer = Callable[[DataFrame], DataFrame]


#: Texts that a user's function gets at once.
_TEXTS = 256


def _in_parts(score: Callable[[pd.Series], pd.Series]) -> Callable[[pa.Array], pa.Array]:
    """score over an Arrow batch, a few texts at a time: a batch's texts are never all objects of Python."""

    def run(texts: pa.Array) -> pa.Array:
        parts = (score(texts.slice(at, _TEXTS).to_pandas()) for at in range(0, len(texts), _TEXTS))
        return pa.concat_arrays([pa.array(x, pa.float64(), from_pandas=True) for x in parts] or [pa.array([], pa.float64())])

    return run


def register_scorer(spark: SparkSession, name: str, score: Callable[[pd.Series], pd.Series]) -> None:
    """Makes a function of a column of texts (in Arrow batches) to scores known by name: to SQL, and to what takes a scorer."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"a scorer's name must be a plain name: {name!r}")
    spark.udf.register(name, F.arrow_udf(_in_parts(score), "double"))


def scorer_of(scorer: Scorer | str) -> Scorer:
    """A scorer itself, or the one that a registered name stands for; an unknown name is Spark's error when it is used."""
    if callable(scorer):
        return scorer
    return lambda docs: _labelled(docs, F.call_udf(scorer, F.col("text")))


def _labelled(docs: DataFrame, score: Column) -> DataFrame:
    s = F.col("score")
    return docs.select("doc_id", score.alias("score")).withColumn("label", F.when(s < 0.35, "human").when(s < 0.65, "uncertain").otherwise("ai"))


def lookup_or_compute(docs: DataFrame, stored: DataFrame, provider: str = "local", model: str = "heuristic", version: int = 1, now: Column | None = None, scorer: Scorer | str = scores) -> DataFrame:
    """text_sha256, provider, model, schema_version, score, label, hit: each distinct text once, stored or newly scored.

    Stored rows (the key, score, label, created_at, expires_at) count if their whole key is the same; of repeated ones
    the last. A scorer may be a registered name. With now, rows that expired by then are misses; without it expiry is not looked at.
    """
    texts = docs.select(F.sha2("text", 256).alias("text_sha256"), "text")
    key = {"provider": F.lit(provider), "model": F.lit(model), "schema_version": F.lit(version)}
    known = stored.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("schema_version") == version))
    if now is not None:
        known = known.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    latest = Window.partitionBy("text_sha256").orderBy(F.desc("created_at"), "score")
    known = known.withColumn("nth", F.row_number().over(latest)).where("nth = 1").select("text_sha256", "score", "label")
    hits = texts.select("text_sha256").distinct().join(known, "text_sha256").withColumn("hit", F.lit(True))
    # one shuffle by the hash serves the join and what keeps one of equal texts; the hash stands for the document, as ids may repeat
    misses = texts.join(known.select("text_sha256"), "text_sha256", "left_anti").dropDuplicates(["text_sha256"])
    new = scorer_of(scorer)(misses.select(F.col("text_sha256").alias("doc_id"), "text")).select(F.col("doc_id").alias("text_sha256"), "score", "label", F.lit(False).alias("hit"))
    return hits.unionByName(new).withColumns(key).select(*SCORE_KEY, "score", "label", "hit")


def hooked(score: Callable[[pd.Series], pd.Series]) -> Callable[[DataFrame], DataFrame]:
    """A scorer from a user's function of a column of texts (in Arrow batches) to scores; labels follow the usual bounds."""
    run = F.arrow_udf(_in_parts(score), "double")
    return lambda docs: _labelled(docs, run(F.col("text")))


def corpus_scan(docs: DataFrame, scorer: Scorer | str | None = scores) -> DataFrame:
    """doc_id, source, label, score of a corpus; what is neither human nor ai is unknown, and without a scorer all is."""
    if scorer is None:
        return docs.select("doc_id", "source", F.lit("unknown").alias("label"), F.lit(None).cast("double").alias("score"))
    s = scorer_of(scorer)(docs.select("doc_id", "text")).withColumn("label", F.when(F.col("label").isin("human", "ai"), F.col("label")).otherwise("unknown"))
    return docs.select("doc_id", "source").join(s.select("doc_id", "label", "score"), "doc_id")


def drift(runs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """run_no, mean_score, delta, drifted against the run before; a run without scores skips both its pairs."""
    means = runs.groupBy("run_no").agg(F.avg("score").alias("mean_score"))
    before = F.lag("mean_score").over(Window.orderBy("run_no"))  # one row per run
    delta = F.abs(F.col("mean_score") - before)
    return means.withColumn("delta", delta).where("delta IS NOT NULL").withColumn("drifted", F.col("delta") > threshold)
