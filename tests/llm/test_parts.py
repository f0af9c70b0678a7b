"""Parts of the training-data operators against a second computation, small blocks, and hard rows for each stage."""

import hashlib
import io
import random
import string
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA

pytest.importorskip("textloom.llm")
from test_llm import SCHEMA, components, hard_rows, pad  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


def near_copies(rng, n, length=150, most=12, first=0):
    """Documents whose edits make many of them miss each other, but not all."""
    base = [f"b{k}" for k in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(length), rng.randrange(most)):
            w[k] = f"e{rng.randrange(30)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("leaves", "reach", "tile"), [(8, 1, 3), (64, 8, 1000)])
def test_ngram_join_in_small_blocks_and_tiles(spark, leaves, reach, tile):
    from textloom.llm.ngram_join import ngram_components

    rng = random.Random(23)
    rows = near_copies(rng, 150) + near_copies(rng, 60, 40, 6, 1000)
    words = [f"p{k}" for k in range(60)]
    rows += [(2000 + i, " ".join(words + [f"d{i}_{k}" for k in range(rng.choice((5, 15, 40)))])) for i in range(50)]
    rows += [(3000 + i, rows[i % 7][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in ngram_components(df, leaves=leaves, reach=reach, tile=tile, broadcast_rows=0).collect()} == components(rows)


def test_discriminant_equals_densities_worked_out_directly():
    from textloom.llm.quality import DIAGONAL, POOLED, Discriminant

    rng = np.random.default_rng(1)
    x = {k: rng.normal(k, 1 + k, (200 + 50 * k, 5)) @ rng.normal(size=(5, 5)) for k in (0, 1)}
    moments = {k: np.hstack([np.ones((len(v), 1)), v]).T @ np.hstack([np.ones((len(v), 1)), v]) for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = sum(len(x[k]) * cov[k] for k in x) / sum(map(len, x.values()))
    log = {}
    at = rng.normal(size=(30, 5))
    for k, v in x.items():
        c = (1 - POOLED - DIAGONAL) * cov[k] + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(5)
        d = at - v.mean(0)
        log[k] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log(len(v))
    assert np.allclose(Discriminant(moments).score(at), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


def test_quality_query_and_stage_judge_alike(spark):
    from textloom.llm.quality import keep_quality, score_quality

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    want = {r.doc_id for r in score_quality(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in keep_quality(docs, labels).collect()} == want


def test_lexicon_sums_equal_a_plain_scan(duck):
    from textloom.llm.toxicity import Lexicon, fold

    rng = random.Random(2)
    texts = [t for (t,) in duck.execute("SELECT text FROM documents").fetchall()]
    words = sorted({w for t in texts for w in fold(t).split() if w.isalpha() and len(w) > 3})
    entries = [(w, 1.0 + k % 5) for k, w in enumerate(rng.sample(words, 150))] + [(w[:4] + "*", 0.5 + k % 7) for k, w in enumerate(rng.sample(words, 60))]
    lexicon, weights, excused = Lexicon(entries, (words[5] + " " + words[9],)), dict(entries), words[5] + " " + words[9]
    for t in [*texts, None, "", "ｓｅｔ é " + excused + " " + words[5]]:
        f, total, n, at = fold(t), 0.0, 0, 0
        runs = []
        while at < len(f):
            if f[at].isalpha():
                end = at
                while end < len(f) and f[end].isalpha():
                    end += 1
                runs.append((at, f[at:end]))
                at = end
            else:
                at += 1
        skip = [k for k in range(len(f)) if f.startswith(excused, k) and not (k and f[k - 1].isalpha()) and not f[k + len(excused) : k + len(excused) + 1].isalpha()]
        for start, w in runs:
            best = max([weights.get(w, 0.0), *(weights.get(w[:k] + "*", 0.0) for k in range(1, len(w)))])
            if best > 0 and not any(k <= start < k + len(excused) for k in skip):
                total, n = total + best, n + 1
        got = lexicon.sum(t)
        assert got[1] == n and got[0] == pytest.approx(total)


def test_folding_meets_full_width_letters_accents_and_invisible_signs():
    from textloom.llm.toxicity import fold

    assert fold("ＩＤＩＯＴ") == fold("ídïöt") == fold("id​iot") == fold("i̶d̶i̶o̶t̶") == fold("1d10t") == "idiot"
    assert fold(None) == ""


def test_topk_takes_repeated_ids_as_candidates_of_their_own(spark, duck):
    from textloom.llm.queries import ORACLES
    from textloom.llm.topk import top_k

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [9.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 1.0]), (7, [-3.0, 2.0]), (8, [0.5, 0.5]), (9, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, block=3).collect())
    assert (0, 1, 1, 589824) in got and (0, 3, 1, 65536) in got
    table = df.toPandas()
    duck.register("vectors_again", table)
    assert got == sorted(duck.execute(ORACLES["op4_exact_topk"].replace("FROM embeddings", "FROM vectors_again")).fetchall())


def test_topk_with_ties_large_numbers_and_small_blocks(spark):
    from textloom.llm.topk import top_k

    rng = np.random.default_rng(8)
    for scale in (1.0, 1e6, 1e13):
        rows = [(int(i), [float(x) * scale for x in rng.integers(-2, 3, size=7)]) for i in range(220)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
        want = []
        for q in range(0, 220, 50):
            held = {c: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[q], v[c])))) for c in v if c != q}
            best = sorted((-s, c) for c, s in held.items())[:5]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, block=17).collect()) == want


def test_media_columns_a_second_way(spark, hard):
    from textloom.llm.files import opened
    from textloom.llm.media import media_features, write_media
    from textloom.llm.sstable import new_folder

    folder = new_folder(hard, "media")
    rows = media_features(write_media(hard, folder, shard_bytes=4000), folder).collect()
    fs, path = opened(folder)
    assert len({r.shard for r in rows}) > 3
    stored = {}
    for name in {r.shard for r in rows}:
        with tarfile.open(fileobj=io.BytesIO(fs.open_input_file(f"{path}/{name}").read())) as tar:
            for m in tar.getmembers():
                stored[name, m.name.removesuffix(".png")] = tar.extractfile(m).read()
    want, got = Counter(), Counter()
    for i, t, *_ in hard_rows():
        p = pad(t)
        x = np.frombuffer(p, np.uint8).astype(np.float64)
        hist = "/".join(str(int(((x >= 32 * k) & (x < 32 * k + 32)).sum())) for k in range(8))
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), f"192x{len(p) // 192};mean={x.mean():.4f};var={x.var():.4f};hist={hist}"] += 1
    for r in rows:
        got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature] += 1
        png = stored[r.shard, r.digest]
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
    assert got == want


def test_shards_of_small_size_keep_order_and_are_read_by_ranges(spark, hard):
    import pyarrow as pa
    import pyarrow.fs as pafs

    from textloom.llm.files import Staged, opened
    from textloom.llm.sstable import ShardReader, ShardWriter, key_of, new_folder, read_shards, write_shards

    folder = new_folder(hard, "sst")
    shards = write_shards(hard, folder, shard_bytes=300)
    rows = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id or 0) for r in read_shards(shards, folder).collect())
    assert shards.count() > 8 and len(rows) == len(hard_rows()) and rows[0][0] == 0
    assert all(a[0] + a[1] == b[0] and a[2:] <= b[2:] for a, b in zip(rows, rows[1:]))
    fs, path = opened(folder)
    for _ in range(2):  # a task that runs again writes the same file again
        out = ShardWriter(Staged(fs, f"{path}/again.sst"), 2)
        for k in range(4000):
            out.add(key_of(k // 3), np.arange(k % 50))
        out.close()
    data = fs.open_input_file(f"{path}/again.sst").read()

    class Counted(pa.PythonFile):
        read_bytes = 0

    class Raw(io.BytesIO):
        def read(self, n=-1):
            got = super().read(n)
            Counted.read_bytes += len(got)
            return got

    reader = ShardReader(pa.PythonFile(Raw(data), mode="r"))
    assert [len(x) for x in reader.get(700)] == [k % 50 for k in (2100, 2101, 2102)] and reader.get(5000) == []
    assert Counted.read_bytes < len(data) and sum(1 for _ in ShardReader(data)) == 4000
    assert [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".part")] == []


ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.digits + string.ascii_lowercase,
    "BASE36": string.digits + string.ascii_uppercase, "letters": string.ascii_letters, "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_",
}


def test_random_spans_find_planted_keys_of_every_encoding_and_length(spark):
    from textloom.llm.secrets import scan_secrets

    rng, rows, planted = random.Random(6), [], {}
    ordinary = ["internationalizationOfThings", "some-long-file-name-2021-draft", "home/user/Documents/report", "1234567890abcdefghijklmnop", "the_quick_brown_fox_jumps_over", "FOO_BAR_BAZ_QUX_CONSTANT_1", "www-example-org/path/to/page1", "xxxxxxxxxxxxxxxxxxxxxxxxxx1"]
    for o in ordinary * 6:
        rows.append((len(rows), f"see {o} there"))
    clean = len(rows)
    for name, letters in ALPHABETS.items():
        for n in (20, 24, 32, 40, 64, 128):
            for _ in range(15):
                key = "".join(rng.choice(letters) for _ in range(n))
                planted[len(rows)] = (name, n, key)
                rows.append((len(rows), f"é here {key}{'==' if name == 'base64' else ''} end"))
    hit, all_ = Counter(), Counter()
    for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        spans = [s for s in r.all_spans if s.kind == 3]
        if r.doc_id < clean:
            assert spans == []
            continue
        name, n, key = planted[r.doc_id]
        whole = any(s.start <= 7 + len(key) - len(key.strip("-_")) + 2 and s.end >= 7 + n - 2 for s in spans)
        for k in (("encoding", name), ("length", n)):
            all_[k] += 1
            hit[k] += whole
    assert {k: hit[k] / n for k, n in all_.items() if hit[k] < 0.9 * n} == {}


def test_license_bands_retrieve_near_variants(spark):
    """Variants that keep about 0.8 of a template's shingles; exact containment decides which must be found."""
    from textloom.llm.licenses import TEMPLATES, _words, scan_licenses

    rng, rows, want = random.Random(9), [], {}
    for name, text in TEMPLATES[7:]:
        words = _words(text)
        if len(words) < 30:
            continue
        own = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        for _ in range(4):
            w = list(words)
            while True:
                trial = list(w)
                trial[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
                if len({tuple(trial[j : j + 5]) for j in range(len(trial) - 4)} & own) < 0.79 * len(own):
                    break
                w = trial
            want[len(rows)] = name
            rows.append((len(rows), " ".join(["license", *(f"p{rng.randrange(900)}" for _ in range(rng.randrange(90))), *w, "end"])))
    found = defaultdict(set)
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect():
        found[r.doc_id].add(r.license)
    missed = {i: n for i, n in want.items() if n not in found[i]}
    assert len(missed) <= 0.05 * len(want), missed


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "secrets", "mixing", "packing"])
def test_pipeline_stages_take_empty_tables_and_hard_rows(spark, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    empty = spark.createDataFrame([], DOCS)
    assert stage(spark, empty, DATA).count() == 0
    rows = [(None if k % 4 == 0 else k % 9, t, None if k % 2 else "en", s, None) for k, (_, t, _, s, *_) in enumerate(hard_rows())]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = stage(spark, docs, DATA)
    given, got = Counter((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()), None
    if name == "packing":
        assert out.select("doc_id", "piece").where("piece = 0").count() == len(rows)
        return
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.lang, r.source) for r in out.collect())
    if name == "quality":
        assert not got - given
    if name == "near_duplicates":
        sets = components([(k, r[1]) for k, r in enumerate(rows)])
        assert not got - given and sum(got.values()) == len(set(sets.values()))
    if name == "secrets":
        assert sorted(map(str, ((k[0], k[2], k[3]) for k in got.elements()))) == sorted(map(str, ((k[0], k[2], k[3]) for k in given.elements())))
    if name == "mixing":
        assert set(got) <= set(given) and all(n <= 2 * given[k] for k, n in got.items())
