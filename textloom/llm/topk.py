"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors become integers floor(scale * x). The dimensions are cut into GROUPS parts, so a score is the sum of one
partial score per part. Candidates are read where they lie, in blocks of at most BLOCK rows, and are never shuffled;
a task reads the queries block by block from the shared folder.

1. Per candidate block and part, each query lists the k entries with the highest partial scores of that part. Whole
   scores are worked out for listed entries only; the k-th best of all listed is a lower bound for the query's k-th
   best score.
2. The bound divided by the number of parts is the cutoff, which goes to all tasks with the queries: an entry that
   reaches the bound has at least one part that reaches the cutoff.
3. Each block collects the entries with such a part, resolves their whole scores exactly and sends those that reach
   the bound, at most k of them.

The cutoff spares whole scores, sorting and transfer, not partial scores: those of every pair are worked out in phase
1 and again in phase 3, unless the norms of a block's parts show that none of its entries reaches the cutoff.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, spread, written
from textloom.llm.files import opened

GROUPS = 2
#: Candidates and queries in a block.
BLOCK, QUERY_BLOCK = 8192, 256
#: Below these magnitudes of a partial sum, single and double floats hold integers exactly.
_SINGLE, _DOUBLE = 2**23, 2**52
_LONG = 2**63 - 1


def _vectors(ids: pa.Array, arrays: pa.Array, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Identifiers and scaled integer vectors (as doubles) of the rows that take part."""
    arrays = arrays.cast(pa.list_(pa.float64()))
    flat = np.floor(arrays.flatten().to_numpy(zero_copy_only=False) * scale)  # nulls become nan
    ends = np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    fine = (bad[ends] == bad[starts]) & arrays.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fine)
    return ids.take(pa.array(at)).to_numpy(zero_copy_only=False), [flat[starts[i] : ends[i]] for i in at]


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(identifiers, vectors) of at most `most` rows, by ascending identifier."""
    ids, rows = [], []
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            i, v = _vectors(part.column(0), part.column(1), scale)
            ids.append(i)
            rows += v
            if len(rows) >= most:
                every = np.concatenate(ids)
                for a in range(0, len(rows) - most + 1, most):
                    yield _sorted(every[a : a + most], rows[a : a + most])
                rest = len(rows) - len(rows) % most
                ids, rows = [every[rest:]], rows[rest:]
    if rows:
        yield _sorted(np.concatenate(ids), rows)


def _sorted(ids: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    return ids[order], _matrix([rows[i] for i in order])


def _parts(q: np.ndarray, c: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Per part the columns of both sides in a kind of number that holds all partial sums exactly, and their norms."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    cuts = [width * g // GROUPS for g in range(GROUPS + 1)]
    sides, norms = [], []
    for a, b in zip(cuts, cuts[1:]):
        x, y = q[:, a:b], c[:, a:b]
        n, m = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        norms.append((n, m))
        sides.append((x, y))
    top = sum(float(n.max(initial=0)) * float(m.max(initial=0)) for n, m in norms)
    if top >= _DOUBLE:
        return [tuple(np.vectorize(int, otypes=[object])(s) if s.size else s.astype(object) for s in p) for p in sides], norms
    return [tuple(s.astype(np.float32) if top < _SINGLE else s for s in p) for p in sides], norms


def _product(side: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    q, c = side
    return q @ c.T if q.shape[1] else np.zeros((len(q), len(c)), q.dtype)


def _own(qids: np.ndarray, cids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) of equal identifiers; cids ascend."""
    a, b = np.searchsorted(cids, qids, "left"), np.searchsorted(cids, qids, "right")
    n = b - a
    rows = np.repeat(np.arange(len(qids)), n)
    return rows, np.repeat(a, n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)


def _best(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of entries, places of the k with the highest scores of each row, ties to the smaller column."""
    scores = np.unique(scores, return_inverse=True)[1] if scores.dtype == object else scores
    order = np.lexsort((cols, -scores, rows))
    r = rows[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, np.int64)
    nth = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[nth < k]


def _listed(parts: list[np.ndarray], own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: the k highest partial scores of each part and query, with the whole scores of these entries."""
    n, m = parts[0].shape
    rows, cols = [], []
    for p in parts:
        p = p.copy()
        p[own] = p.min(initial=0) - 1  # the query itself comes last
        sort = np.argsort if p.dtype == object else lambda x, axis: np.argpartition(x, k - 1, axis=axis)
        top = sort(-p, axis=1)[:, :k] if m > k else np.tile(np.arange(m), (n, 1))
        rows.append(np.repeat(np.arange(n), top.shape[1]))
        cols.append(top.ravel())
    at = np.unique(np.concatenate(rows) * m + np.concatenate(cols))
    at = at[~np.isin(at, own[0] * m + own[1])]
    rows, cols = at // m, at % m
    return _resolved(parts, rows, cols, k)


def _resolved(parts: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries with their whole scores, those under their query's bound left out, at most k of a query."""
    kind = object if parts[0].dtype == object else np.float64
    whole = sum(p[rows, cols].astype(kind) for p in parts)
    if kind is object:
        whole = np.array([max(-_LONG - 1, min(_LONG, x)) for x in whole], object)
    if bound is not None:
        some = np.flatnonzero(whole >= bound[rows])
        rows, cols, whole = rows[some], cols[some], whole[some]
    some = _best(rows, cols, whole, k)
    return rows[some], cols[some], whole[some]


def _collected(parts: list[np.ndarray], own: tuple[np.ndarray, np.ndarray], k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: the entries with a part at the cutoff, resolved."""
    cutoff = np.ceil(bound / GROUPS) if parts[0].dtype != object else np.array([b if b == -np.inf else -(-int(b) // GROUPS) for b in bound], object)
    if parts[0].dtype == np.float32:
        near = cutoff.astype(np.float32)
        cutoff = np.where(near.astype(np.float64) > cutoff, np.nextafter(near, np.float32(-np.inf)), near).astype(np.float32)
    mask = np.logical_or.reduce([p >= cutoff[:, None] for p in parts]).astype(bool)
    mask[own] = False
    rows, cols = np.nonzero(mask)
    return _resolved(parts, rows, cols, k, bound)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query rows (vec_id, embedding, bound) to blocks, one row each; without a bound anything may be among the best."""

    def packed(rows):
        ids, vectors, bounds = zip(*rows)
        x = _matrix(vectors)
        b = np.array([-np.inf if b is None else b for b in bounds], np.float64)
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()]), pa.array([b.tobytes()])], names=["ids", "width", "rows", "bounds"])

    held = []
    for batch in batches:
        for i, v, b in zip(*(c.to_pylist() for c in batch.columns)):
            held.append((i, np.frombuffer(v), b))
            if len(held) == QUERY_BLOCK:
                yield packed(held)
                held = []
    if held:
        yield packed(held)


def _queries(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(identifiers, vectors, bounds) of every block in the folder, one at a time."""
    fs, path = opened(folder)
    for info in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with pq.ParquetFile(fs.open_input_file(info.path)) as file:
                for batch in file.iter_batches(batch_size=1):
                    row = batch.to_pylist()[0]
                    ids = np.frombuffer(row["ids"], np.int64)
                    yield ids, np.frombuffer(row["rows"]).reshape(len(ids), row["width"]), np.frombuffer(row["bounds"])


def _search(folder: str, k: int, scale: float, cut: bool, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cids, c in _blocks(batches, scale, block):
            for qids, q, bound in _queries(folder):
                sides, norms = _parts(q, c)
                if cut and all((n * m.max(initial=0) * GROUPS + 1 < bound).all() for n, m in norms):
                    continue  # no part of any entry reaches the cutoff
                parts, own = [_product(s) for s in sides], _own(qids, cids)
                rows, cols, whole = _collected(parts, own, k, bound) if cut else _listed(parts, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows], pa.int64()), pa.array(cids[cols], pa.int64()), pa.array([int(x) for x in whole], pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _flat(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = _vectors(batch.column(0), batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "v"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows with another vec_id. Ties go to
    the smaller vec_id. Rows with a null vec_id, a null vector, or a null or (scaled) non-finite component take no part.
    Vectors of unequal length count as if filled with zeros. Every row is a candidate of its own, so a vec_id that
    several rows have can be listed several times; query rows of one vec_id share one list, the best of all. Scores
    beyond 64 bits are held at the largest (or smallest) long, and ranked as such. Extra columns are ignored; without queries there are no rows.
    """
    rows = spread(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    queries = materialize(rows.where(F.expr(f"pmod(vec_id, {every}) = 0")).mapInArrow(_flat(float(scale)), "vec_id long, v binary"), "queries")
    blocks = "ids binary, width int, rows binary, bounds binary"
    schema = "query_id long, vec_id long, score long"
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    folder = written(queries.withColumn("bound", F.lit(None).cast("double")).mapInArrow(_packed, blocks), "blocks")
    listed = rows.mapInArrow(_search(folder, k, float(scale), False, block), schema)
    best = listed.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    least = F.col("least").cast("double")
    bound = least - F.when(F.abs(least) > 2.0**52, F.abs(least) * 2.0**-50).otherwise(0.0)  # never above the long
    bounds = materialize(best.where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), bound.alias("bound")), "bounds")
    folder = written(queries.join(bounds.hint("merge"), "vec_id", "left").select("vec_id", "v", "bound").mapInArrow(_packed, blocks), "blocks")
    found = rows.mapInArrow(_search(folder, k, float(scale), True, block), schema)
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
