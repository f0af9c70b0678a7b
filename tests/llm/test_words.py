"""Collocations, BPE encoding and spelling variants against the library, brute force and SQL, with hard rows and small blocks."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA

pytest.importorskip("textloom.llm")

SCHEMA = "doc_id long, text string, lang string, f long, word string, block string"
LONG = "q" * 300


def hard_rows():
    """Nulls, empties, repeated rows, ties, letters of several bytes, long words and texts; extra columns with clashing names."""
    texts = [
        None, "", " \n\t ", "a", "Hello,  World\n\nit's <|endoftext|>x <|ENDOFTEXT|> 日本 ﬁé É\tab\r\n x", "w" * 5000, "a b. " * 3000, "A b; " * 40 + "c\x0bd e f g",
        "aaaaa aaaaa aaaaa aaaa aaaaaa aaaaaa aaaaaa aaaaab aaaaab aaaaab " * 3, "élève Élève ÉLÈVE élèves élèves élèves elève elève elève İstan " * 3,
        "Kelvin kelvin keLVIN kelvins kelvins kelvins kelvinss kelvinss kelvinss" * 2, "xyxyxy xyxyxyx xyxyx yxyxy " * 4, f"{LONG} {LONG[1:]}z {LONG}q x{LONG[1:]} " * 3,
    ]
    rows = [(i, t, (None, "en", "fr")[i % 3], 7, "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[11], (None, "null id text of some words", "en", None, None, None)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from textloom.llm.encoding import default_vocabulary

    return Tokenizer.from_file(default_vocabulary())


@pytest.mark.parametrize("block_words", [3, 700, 1 << 22])
def test_encoding_and_decoding_equal_the_library(hard, empty, library, block_words):
    from textloom.llm.bpe import encode_documents

    got = encode_documents(hard, block_words=block_words).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in hard_rows()]
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), ids) for i, ids in want)
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in got)
    assert encode_documents(empty).count() == 0


def test_digests_of_a_whole_table(spark, library):
    from textloom.llm.queries import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op12_bpe_encoding"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256) == (len(ids), *digests)


def test_ids_meet_their_pieces_in_a_join(spark, library):
    from textloom.llm.bpe import decode_ids

    ids = library.encode("Hello world, it's 日本", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, ids), (2, []), (3, None), (4, [ids[0], 999_999])], "k long, ids array<int>")
    assert dict(decode_ids(rows, "k").collect()) == {1: library.decode(ids, skip_special_tokens=False), 2: "", 3: "", 4: library.decode(ids[:1])}


def phrases(rows, threshold, top=2000, absorb=100):
    """Collocations by their definition."""
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        rows = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= absorb * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("threshold", "top", "sizes"), [(3, 2000, {}), (3, 2000, {"slice_mass": 1 << 8, "held": 64, "bits": 12}), (40, 1, {})])
def test_collocations_by_definition(hard, empty, threshold, top, sizes):
    from textloom.llm.collocations import collocations

    got = collocations(hard, threshold, top, **sizes).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == phrases(hard_rows(), threshold, top)
    assert collocations(empty, **sizes).count() == 0


def test_a_slice_is_in_one_task_though_joins_change_while_they_run(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from textloom.llm.collocations import _by_slice
    from textloom.llm.common import materialize

    def counted(batches):
        whole, n = {}, {}
        for b in batches:
            for s, w in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                whole[s], n[s] = w, n.get(s, 0) + 1
        yield pa.RecordBatch.from_pylist([{"slice": s, "whole": whole[s], "n": n[s]} for s in n], schema=pa.schema([("slice", pa.int64()), ("whole", pa.int64()), ("n", pa.int64())]))

    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 512, 1, 8).select((F.col("id") % 64).alias("slice"), F.lit(1).cast("long").alias("mass"), F.randstr(20_000, 1).cast("binary").alias("keys"), F.lit(b"x").alias("counts"))
        found = _by_slice(materialize(rows, "summaries")).mapInArrow(counted, "slice long, whole long, n long").collect()
        assert sorted(map(tuple, found)) == [(s, 8, 8) for s in range(64)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_collocations_equal_their_sql(spark, duck):
    from textloom.llm.queries import ORACLES, QUERIES

    where = DATA.replace("0.001", "0.01")
    got = sorted(map(tuple, QUERIES["op11_phrase_collocations"](spark, where).select(*COLUMNS).collect()))
    sql = ORACLES["op11_phrase_collocations"].replace("FROM documents", f"FROM '{where}/documents.parquet'")
    assert got and got == sorted(duck.execute(sql).fetchall())


def test_scores_beyond_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    a, n, x, y = 10**12 + 7, 10**14 + 1, 10**12 + 9, 10**13 + 3
    df = spark.createDataFrame([(a, n, x, y)], "a long, n long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    got = df.select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r")).alias("s")).first().s
    assert got == 1000 * a * n // (x * y)


def test_merged_summaries_lose_less_than_the_threshold():
    from textloom.llm.collocations import _summed, misra_gries

    rng = np.random.default_rng(3)
    stream = rng.zipf(1.3, 60_000) % 5000
    threshold, true = 60, Counter(stream.tolist())
    capacity = len(stream) // threshold + 1
    keys, counts, lost = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    for part in np.array_split(stream, 23):
        own = np.unique(part.astype(np.uint64), return_counts=True)
        keys, counts, more = misra_gries(*_summed(np.concatenate([keys, own[0]]), np.concatenate([counts, own[1]])), capacity)
        lost += more
        assert len(keys) <= capacity
    held = dict(zip(keys.tolist(), counts.tolist()))
    assert 0 < lost < threshold
    assert all(true[k] - lost <= held.get(k, 0) <= true[k] for k in true)
    assert all(held.get(k, 0) + lost >= threshold and k in held for k, n in true.items() if n >= threshold)


def test_sums_of_counts_that_fit_and_that_do_not():
    from textloom.llm.collocations import _summed, _unpacked

    keys = np.array([5, 2, 5, 2**40 - 1, 0], np.uint64)
    for top in (3, 2**24 - 1, 2**24, 2**31):
        counts = np.array([1, top, top, 2, 7], np.uint64)
        got = _summed(keys.copy(), counts)
        assert dict(zip(got[0].tolist(), got[1].tolist())) == {0: 7, 2: top, 5: 1 + top, 2**40 - 1: 2}
    assert len(_summed(np.empty(0, np.uint64), np.empty(0, np.int64))[0]) == 0
    from textloom.llm.bpe import packed_numbers, unpacked_numbers

    for numbers in ([], [0], [1, 2**32 - 1, 70_000, 255]):
        assert unpacked_numbers(packed_numbers(np.array(numbers, np.uint32))).tolist() == numbers
    steps = np.array([1, 2**39, 3], np.uint64)  # a step beyond 32 bits follows the others
    small = np.minimum(steps, np.uint64(0xFFFFFFFF)).astype(np.uint32)
    wide = steps[steps >= 0xFFFFFFFF].astype("<u8")
    assert _unpacked(packed_numbers(small) + wide.tobytes() + len(wide).to_bytes(4, "little")).tolist() == np.cumsum(steps).tolist()


def variants(rows, least_length=5, least_n=3, ratio=2):
    """Spelling variants by their definition, through shared deletions."""
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least_length and k >= least_n}
    gaps, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[w[:k], w[k + 1 :]].add(w)
    for (a, b), ws in gaps.items():
        for w in ws:
            near[w] |= ws - {w}
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def spelled(df, **how):
    from textloom.llm.spelling import spelling_variants

    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling_variants(df, **how).collect())


def test_spelling_variants_on_hard_rows(hard, empty):
    got = spelled(hard)
    assert got == variants(hard_rows()) and LONG in {r[0] for r in got}
    assert spelled(empty) == []


def test_spelling_variants_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert spelled(docs) == variants(docs.select("doc_id", "text").collect())


def test_near_words_of_dense_random_words(spark):
    from textloom.llm.spelling import near_words

    rng = random.Random(8)
    ws = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(1500)})
    got = {(r.word, r.near) for r in near_words(spark.createDataFrame([(w, k) for k, w in enumerate(ws)], "word string, n long")).collect()}
    have, want = set(ws), set()
    for w in ws:
        edits = {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in "abé"} | {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in "abé"}
        want |= {(w, v) for v in edits & have if v != w}
    assert got == want


def test_chains_of_forms_end_at_their_root(spark):
    rows = [(k, " ".join([w] * (3 * 2**k)), None) for k, w in enumerate(["chains", "chainsa", "chainsab", "chainsabc", "chainsabcd", "chainsabcde"])]
    got = spelled(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got == variants(rows) and {r[2] for r in got if r[0].startswith("chains")} == {"chainsabcde"}
