"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding takes compatibility forms apart (full-width letters, ligatures), drops accents and other combining marks and
invisible characters, lower-cases, maps homoglyphs to Latin letters and digit or sign substitutions to the letters they
stand for.
Lexicon entries are whole words or word beginnings with weights, learnt from a bounded sample of labelled rows:
log-odds of an entry between toxic and other documents. Matches inside exception phrases don't count. A document's
sum of weights, normalised by its length, is turned into a probability by a logistic curve on the same sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.llm.quality import crc_mod

#: Look-alikes of Latin letters, and what stands for letters inside words.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases whose words are meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "class clown fish", "clown fish", "pond scum", "soap scum", "stupid question")
#: Labelled rows used for the lexicon; its entries all stand in these rows, so their number is bounded with them.
SAMPLE_ROWS = 16_000
#: A learnt entry stands in so many distinct toxic documents, with at least so much log-odds.
LEAST_DOCUMENTS, LEAST_WEIGHT = 6, 3.0
PREFIXES = (4, 5, 6)

_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES)
_DROPPED = ("Mn", "Me", "Cf")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """The folded text; digits and signs are letters then, so amounts fold to letters too, which match nothing."""
    text = text or ""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if c.isascii() or unicodedata.category(c) not in _DROPPED)
    return text.lower().translate(_FOLD)


def terms_of(text: str | None) -> tuple[set[str], int, int]:
    """Distinct entries that a text could match (`word` or `begin*`), and two signatures that near copies share."""
    words = set(_WORD.findall(fold(text)))
    out = {w for w in words if len(w) > 2}
    for k in PREFIXES:
        out |= {w[:k] + "*" for w in words if len(w) > k}
    hashes = [xxhash.xxh3_64_intdigest(w) >> 1 for w in words] or [0]
    return out, min(hashes), max(hashes)


def _termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(y, *terms_of(t)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([list(x) for x in cols[1]], pa.list_(pa.string())), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["label", "terms", "low", "high"])


def learn_lexicon(sample: DataFrame) -> list[tuple[str, float]]:
    """Weighted entries from rows (text, label). Support counts distinct signatures, so copies don't add to it."""
    termed = materialize(sample.mapInArrow(_termed, "label int, terms array<string>, low long, high long"), "terms")
    n = {r[0]: r[1] for r in termed.groupBy("label").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        return []
    # entries of enough distinct toxic documents; then their counts among all others
    toxics = termed.where("label = 1").select(F.explode("terms").alias("term"), "low", "high")
    per = toxics.groupBy("term").agg(F.count("*").alias("pos"), F.countDistinct("low").alias("a"), F.countDistinct("high").alias("b"))
    able = per.where(F.least("a", "b") >= LEAST_DOCUMENTS).select("term", "pos")
    rest = termed.where("label = 0").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.coalesce("neg", F.lit(0)) + 0.5) / (other + 1))
    found = able.join(rest, "term", "left").select("term", weight.alias("w"), "pos").where(F.col("w") >= LEAST_WEIGHT)
    return sorted((r["term"], float(r["w"])) for r in found.collect())


class Lexicon:
    """The matcher; built in each worker from the entries."""

    def __init__(self, entries: Sequence[tuple[str, float]], exceptions: Sequence[str] = EXCEPTIONS):
        import ahocorasick

        self.weights = dict(entries)
        self.automaton = ahocorasick.Automaton()
        for term in {t.rstrip("*") for t in self.weights}:
            self.automaton.add_word(term, (len(term), self.weights.get(term), self.weights.get(term + "*")))
        for phrase in exceptions:
            folded = fold(phrase)
            known = self.automaton.get(folded, None)
            self.automaton.add_word(folded, (len(folded), *(known[1:3] if known else (None, None)), True))
        self.filled = len(self.automaton) > 0
        if self.filled:
            self.automaton.make_automaton()

    def sum(self, text: str | None) -> tuple[float, int]:
        """Sum of weights of the words matched (a word counts once, by its heaviest entry), and their number."""
        if not self.filled or not text:
            return 0.0, 0
        folded, hits, excused = fold(text), {}, []
        for end, (length, word, begin, *phrase) in self.automaton.iter(folded):
            start = end - length + 1
            if start and folded[start - 1].isalpha():
                continue
            closed = end + 1 == len(folded) or not folded[end + 1].isalpha()
            if phrase and closed:
                excused.append((start, end))
            w = max(x for x in (word if closed else None, None if closed else begin, 0.0) if x is not None)
            if w > hits.get(start, 0.0):
                hits[start] = w
        own = [w for at, w in hits.items() if not any(a <= at <= b for a, b in excused)]
        return sum(own), len(own)


def density(total: float, text: str | None) -> float:
    """The sum by length: longer texts need more, slowly."""
    return total / (1.0 + 0.1 * math.log1p(len(text or "") / 500.0))


_MATCHERS: dict[int, Lexicon] = {}


def _densities(entries: list[tuple[str, float]], exceptions: tuple[str, ...]):
    key = hash((tuple(entries), exceptions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _MATCHERS.get(key)
        if lexicon is None:
            _MATCHERS.clear()
            lexicon = _MATCHERS[key] = Lexicon(entries, exceptions)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums = [lexicon.sum(t) for t in texts]
            x = [density(s, t) for (s, _), t in zip(sums, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64()), pa.array([n for _, n in sums], pa.int64())], names=["doc_id", "x", "n_matches"])

    return run


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic curve over (x, toxic, other) bins, by Newton steps."""
    if not rows:
        return 1.0, -3.0
    x, pos, neg = (np.array(c, np.float64) for c in zip(*rows))
    n, w = pos + neg, np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    ridge = np.diag([0.05, 0.001])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (pos - n * p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.01), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted, n_matches.

    The lexicon is learnt from the `sample_rows` labelled training rows with the smallest hashes. Null and empty texts
    match nothing. Null ids are not held out. Repeated rows are scored each. Extra columns are ignored. Without labels
    of both classes the lexicon is empty and every score is the same.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_mod("doc_id", folds) != held)
    picked = train.select("doc_id", F.col("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    sample = materialize(docs.join(F.broadcast(picked), "doc_id").select("text", "label", "doc_id"), "sample")  # at most sample_rows
    entries = learn_lexicon(sample.select("text", "label"))
    measured = _densities(entries, exceptions)
    schema = "doc_id long, x double, n_matches long"
    # the sample's densities, rounded: at most sample_rows bins
    own = sample.select("label", "text").mapInArrow(_densities(entries, exceptions), "doc_id int, x double, n_matches long")
    bins = own.groupBy((F.round(F.col("x") * 10) / 10).alias("x")).agg(F.sum("doc_id").alias("pos"), F.count("*").alias("n"))
    slope, intercept = _logistic([(r["x"], r["pos"], r["n"] - r["pos"]) for r in bins.collect()])
    scored = docs.mapInArrow(measured, schema)
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("x") + F.lit(intercept))))
    out = scored.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), score.alias("score"), "n_matches")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
