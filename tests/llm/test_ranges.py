"""Mixing and packing over many ranges give what one range gives."""

import pytest

pytest.importorskip("textloom.llm")


def docs(spark):
    rows = [(i % 90, " ".join(["w"] * (i % 37)), ("a", "a", "b", None)[i % 4]) for i in range(400)] + [(None, "no id", "a")] * 5
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_mixing_over_many_ranges(spark, monkeypatch):
    from textloom.llm import mixing

    rows = docs(spark).cache()
    whole = sorted(map(str, mixing.mix(rows).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    found = mixing.mix(rows).collect()
    assert sorted(map(str, found)) == whole
    taken, target = {}, {}
    for r in found:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = round(r.target)
    assert taken == target


def test_packing_over_many_ranges(spark, monkeypatch):
    from textloom.llm import packing

    rows = docs(spark).cache()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    pieces = lambda rows: sorted(str(tuple(r[c] for c in columns)) for r in rows)
    whole = packing.pack(rows, capacity=64).collect()
    monkeypatch.setattr(packing, "RANGE_PIECES", 5)
    found = packing.pack(rows, capacity=64).collect()
    assert pieces(found) == pieces(whole)
    for placed in (whole, found):
        sequences = {}
        for r in placed:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            ends = [o + n for o, n in sorted(parts)]
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len({r.sequence_id for r in found}) == len({r.sequence_id for r in whole})
