"""The fuzzy diff of anchors against its definition, on random anchors."""

import random
from difflib import SequenceMatcher

from textloom.operators import evidence as E

ANCHORS = "doc_id long, seq int, category string, text string"


def defined(source, candidate):
    """In order of the source, each anchor takes the free candidate of its category with the highest ratio over 0.7."""
    out = {}
    for doc in {r[0] for r in source + candidate}:
        s, c = ([(k, t.lower()) for _, _, k, t in sorted(r for r in rows if r[0] == doc)] for rows in (source, candidate))
        taken, matched, contradicted = set(), 0, 0
        for kind, text in s:
            best, at = 0.7, None
            for i, (other, body) in enumerate(c):
                if i not in taken and other == kind and (r := SequenceMatcher(None, text, body).ratio()) > best:
                    best, at = r, i
            if at is not None:
                taken.add(at)
                matched += 1
                contradicted += best < 0.9
        out[doc] = (len(s), len(c), len(s) - matched, len(c) - matched, contradicted, round(matched / len(s), 4) if s else 1.0)
    return out


def test_fuzzy_diff_equals_its_definition(spark):
    rng = random.Random(6)
    some = lambda: "".join(rng.choice("ab1 é") for _ in range(rng.randrange(1, 12)))
    source, candidate = [], []
    for doc in range(40):
        texts = [some() for _ in range(rng.randrange(0, 14))]
        source += [(doc, k, rng.choice("xy"), t) for k, t in enumerate(texts)]
        edited = [(t[: (i := rng.randrange(len(t) + 1))] + rng.choice("ab1 ") * rng.randrange(3) + t[i + rng.randrange(2) :]) if rng.random() < 0.6 else t for t in texts if rng.random() < 0.9]
        candidate += [(doc, k, rng.choice("xxy"), t or "b") for k, t in enumerate(edited + [some() for _ in range(rng.randrange(3))])]
    source += [(99, k, "number", "10 kg") for k in range(3)]  # repeated anchors, and long ones where common letters are junk
    candidate += [(99, 0, "number", "10 kg"), (99, 1, "number", "11 kg"), (98, 0, "x", "only here"), (97, 0, "x", "ab c " * 60)]
    source += [(97, 0, "x", "ab  c" * 60), (96, 0, "x", "Same"), (95, 0, "x", "")]
    candidate += [(96, 0, "x", "sAME")]
    frame = lambda rows: spark.createDataFrame(rows, ANCHORS)
    got = {r.doc_id: tuple(r)[1:] for r in E.fact_diff(frame(source), frame(candidate)).collect()}
    assert got == defined(source, candidate)
    assert E.fact_diff(frame([]), frame([])).count() == 0


def test_pairs_that_cannot_match_never_reach_python(spark):
    rows = [(1, k, "number", f"{k:06d} unit{'s' * (k % 40)}") for k in range(300)]
    s, c = (spark.createDataFrame(rows, ANCHORS) for _ in range(2))
    pairs = {(r.s, r.c): r.ratio for r in E.similar_texts(s, c).collect()}
    want = {(a[3], b[3]): r for a in rows for b in rows if (r := SequenceMatcher(None, a[3], b[3]).ratio()) > 0.7}
    assert pairs == want


def test_diffs_work_out_each_version_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def counted(texts):
        for t in texts:
            seen.add(len(t))
            yield t

    d = spark.createDataFrame([(1, "In 2020 Anna Miller paid $5."), (2, "On 2024-01-02 he had 7 apples.")], "doc_id long, text string")
    once = d.mapInPandas(counted, d.schema)
    rows = E.revalidated(once, once.withColumn("text", F.replace("text", F.lit("7"), F.lit("8")))).collect()
    assert {r.doc_id: r.ok for r in rows} == {1: True, 2: False}
    assert seen.value <= 6  # a version's anchors each, and the ids
