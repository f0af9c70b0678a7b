"""N-gram Jaccard join: a grouped prefix join over five-word shingles.

How it runs:

1. Each document becomes a sorted array of 64-bit shingle hashes. A block of documents keeps one array per
   distinct set, so copies inside a block cost nothing further.
2. Shingles are counted over all documents, one row per (block, hash range); what occurs in one document only is
   settled there and never leaves its bucket. Shingles that at least two documents hold go back to their blocks.
3. Each block orders every set by (region, document frequency, hash), one order for all documents, and cuts the
   prefix that the threshold needs. Sets with identical prefixes and size collapse into one group.
4. First each group joins the family of one pivot. A family is dealt into blocks around a circle; the expanded members
   of a block are verified against each other and against those of the REACH next blocks on either side. Up to
   2 * REACH + 1 blocks these are all; in larger families the pivot and three more members are in every block too, and
   no text is shipped more often than that, however large the family. That gives components.
5. Then groups meet on shared prefix shingles, a frequent shingle in tiles, unless both lie in one component or were
   compared in 4. Filters on sizes, positions and unshared shingles drop pairs of groups; what is left is expanded to
   pairs of members of different components, which are verified on whole sets. No link between different components is
   lost, and pairs are neither written out inside a block nor inside a component.

Long documents first emit only the shingles in the lowest REGION of the hash range (all documents the same range, which
comes first in the order); where that is too few to hold a prefix they emit all. Whole sets are verified.

A family of more than 2 * REACH + 1 blocks that does not come together in 4, with members just under the threshold,
costs a number of pairs that grows with its square: that is the candidates' own number, which no exact prefix join
spares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_broadcast, materialize, shingle_hashes
from textloom.llm.components import connected_components

#: Share of the hash range whose shingles every document emits; short documents emit all.
REGION = 0.32
SHORT = 256
#: Shingles after which a block of documents ends, and hashes for one bucket of the count.
BLOCK_SHINGLES, BUCKET_SHINGLES = 400_000, 700_000
#: Rows of an assignment table up to which it is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Documents and shingles in one block to be verified, and shingles in one slice of its indicator matrix.
LEAVES, LEAF_SHINGLES, COLUMNS = 512, 400_000, 2048
#: Blocks of a family, on either side, that a block is verified against.
REACH = 8
#: Groups in one tile of a frequent shingle.
TILE = 1024

_BOUND = np.uint64(int(REGION * 2**64))


def _least_overlap(n):
    """Least number of a set's n shingles that a set at 0.75 or more must share."""
    return (3 * n + 3) // 4


def _staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to (block, doc_id, n, fp, toks); toks is null for a set that its block already has."""
    from pyspark import TaskContext

    # blocks are called by partition and number, as ids may be missing or repeat: the table that is written keeps the names
    block, seen, weight = TaskContext.get().partitionId() << 32, set(), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            ids = part.column(0).to_pylist()
            out = {k: [] for k in ("block", "doc_id", "n", "fp", "toks")}
            for doc_id, s in zip(ids, shingle_hashes(part.column(1).to_pylist())):
                if weight > BLOCK_SHINGLES:
                    block, seen, weight = block + 1, set(), 0
                fp, toks = xxhash.xxh3_128_digest(s.tobytes()), None
                if len(s) and doc_id is not None and fp not in seen:
                    seen.add(fp)
                    if len(s) > SHORT:
                        near = s[: np.searchsorted(s, _BOUND)]
                        toks = near if len(near) > len(s) - _least_overlap(len(s)) else s
                    else:
                        toks = s
                    weight += len(toks)
                    toks = toks.tobytes()
                for k, v in (("block", block), ("doc_id", doc_id), ("n", len(s)), ("fp", fp), ("toks", toks)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["block"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["fp"], pa.binary()), pa.array(out["toks"], pa.binary())],
                names=["block", "doc_id", "n", "fp", "toks"],
            )


def _bucketed(buckets: int):
    """(block, toks) rows to one row per block and hash range: its distinct hashes and how many sets have each."""
    shift = np.uint64(64 - int(buckets).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flush(block: int) -> pa.RecordBatch:
            taus, counts = np.unique(np.concatenate(held.pop(block)), return_counts=True)
            counts = np.minimum(counts, 2**31 - 1).astype(np.uint32)
            of = (taus >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(taus), np.int64)
            keys, starts = np.unique(of, return_index=True)
            ends = [*starts[1:], len(taus)]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([block] * len(keys), pa.int64()), pa.array([taus[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                names=["bucket", "block", "taus", "counts"],
            )

        for batch in batches:
            for block, toks in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block not in held:
                    for old in list(held):
                        yield flush(old)
                    held[block] = []
                held[block].append(np.frombuffer(toks.as_buffer(), np.uint64))
        for old in list(held):
            yield flush(old)

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Of one hash range: per block the hashes that at least two documents hold, with their frequency."""
    blocks = group.column("block").to_pylist()
    taus = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("taus")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("counts")])
    keys, inverse = np.unique(np.concatenate(taus), return_inverse=True)
    df = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)
    out, at = {"block": [], "taus": [], "dfs": []}, 0
    for block, own in zip(blocks, taus):
        d = df[inverse[at : at + len(own)]]
        at += len(own)
        if (keep := d > 1).any():
            out["block"].append(block)
            out["taus"].append(own[keep].tobytes())
            out["dfs"].append(d[keep].tobytes())
    return pa.table({"block": pa.array(out["block"], pa.int64()), "taus": pa.array(out["taus"], pa.binary()), "dfs": pa.array(out["dfs"], pa.binary())})


_PREFIXES = "doc_id long, n long, most long, fp binary, prefix long, ptoks array<long>, ppos array<int>"


def _prefixes(sets: pa.Table, shared: pa.Table) -> pa.Table:
    """Of one block: per set its prefix, and in it what other documents hold too, with positions.

    `most` is the largest overlap with any other set: shingles that no other document has are in none. Where
    partners may have kept part of their shingles to themselves, only the region counts. Sets that cannot reach
    their least overlap are left out.
    """
    out: dict[str, list] = {k: [] for k in ("doc_id", "n", "most", "fp", "prefix", "ptoks", "ppos")}
    if shared.num_rows:
        taus = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in shared.column("taus")])
        dfs = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in shared.column("dfs")])
        order = np.argsort(taus)
        taus, dfs = taus[order], dfs[order]
        for doc_id, n, fp, toks in zip(*(sets.column(c) for c in ("doc_id", "n", "fp", "toks"))):
            own, n = np.frombuffer(toks.as_buffer(), np.uint64), n.as_py()
            at = np.minimum(np.searchsorted(taus, own), len(taus) - 1)
            df = np.where(taus[at] == own, dfs[at], 1)
            alone = df == 1 if n <= 3 * SHORT // 4 else (df == 1) & (own < _BOUND)
            if (most := n - int(alone.sum())) < _least_overlap(n):
                continue
            first = np.lexsort((own, df, own >= _BOUND))[: n - _least_overlap(n) + 1]
            held = np.flatnonzero(df[first] > 1)
            if len(held):
                out["doc_id"].append(doc_id.as_py())
                out["n"].append(n)
                out["most"].append(most)
                out["fp"].append(fp.as_py())
                out["prefix"].append(xxhash.xxh3_64_intdigest(own[first].tobytes()) - 2**63)
                out["ptoks"].append(own[first][held].view(np.int64))
                out["ppos"].append(held.astype(np.int32))
    return pa.table([pa.array(out["doc_id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["most"], pa.int64()), pa.array(out["fp"], pa.binary()), pa.array(out["prefix"], pa.int64()), pa.array(out["ptoks"], pa.list_(pa.int64())), pa.array(out["ppos"], pa.list_(pa.int32()))], names=list(out))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from a product of indicator matrices in slices of columns."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    taus, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1  # a shingle of one set is in no intersection
    rows, cols = owner[keep], place[inverse[keep]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(cols[-1]) + 1 if len(cols) else 0, COLUMNS):
        a, b = np.searchsorted(cols, [lo, lo + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[rows[a:b], cols[a:b] - lo] = 1
        out += x @ x.T
    return out


def _verified(group: pa.Table) -> pa.Table:
    """Of some documents of one family: links at 0.75 or more on whole sets, enough of them to join what is linked."""
    ids = group.column("doc_id").to_numpy()
    sets = shingle_hashes(group.column("text").to_pylist())
    full = [k for k, s in enumerate(sets) if len(s)]
    ids, sets = ids[full], [sets[k] for k in full]
    out_u, out_v = [], []
    if sets:
        both, n = _overlaps(sets), np.array([len(s) for s in sets])
        linked = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(linked, False)
        open_ = np.ones(len(ids), bool)
        while open_.any():  # breadth first: every document is reached by one link
            front = [int(np.argmax(open_))]
            open_[front] = False
            while front:
                at = front.pop()
                new = np.flatnonzero(linked[at] & open_)
                open_[new] = False
                out_u += [ids[at]] * len(new)
                out_v += ids[new].tolist()
                front += new.tolist()
    return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})


def _salts(leaves: int, n: str):
    """Blocks that rows fall into, by their number and their shingles."""
    return F.ceil(F.greatest(F.count("*") / leaves, F.sum(n) / LEAF_SHINGLES)).cast("int")


def _verify(docs: DataFrame, dealt: DataFrame, keys: list[str], broadcast_rows: int) -> DataFrame:
    """Links (u, v) among the documents that dealt (keys, doc_id) puts together."""
    dealt = materialize(dealt, "dealt")
    texts = docs.select("doc_id", "text").join(bounded_broadcast(dealt, dealt.count(), broadcast_rows), "doc_id")
    return texts.groupBy(*keys).applyInArrow(_verified, "u long, v long").distinct()


def _family_blocks(members: DataFrame, leaves: int) -> DataFrame:
    """family, blocks, and members that go to every block of a large one: the pivot and three by the least of a hash each."""
    least = [F.min(F.struct(F.xxhash64(F.lit(k), "doc_id"), "doc_id"))["doc_id"] for k in range(3)]
    return members.groupBy("family").agg(_salts(leaves, "n").alias("blocks"), F.count("*").alias("size"), F.array(F.col("family"), *least).alias("common")).where("size > 1").drop("size")


def _family_links(docs: DataFrame, members: DataFrame, blocks: DataFrame, reach: int, broadcast_rows: int) -> DataFrame:
    """Links among the documents (family, doc_id, n) of every family, by pairs of blocks that are near each other."""
    near = F.expr(f"array_distinct(transform(sequence(-least({reach}, blocks - 1), least({reach}, blocks - 1)), k -> cast(pmod(own + k, blocks) as int)))")
    pair = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    own = members.join(blocks, "family").withColumn("own", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)")).withColumn("other", F.explode(near)).select("family", *pair, "doc_id")
    large = blocks.where(f"blocks > {2 * reach + 1}").withColumn("own", F.explode(F.expr("sequence(0, blocks - 1)"))).select("family", F.col("own").alias("i"), F.col("own").alias("j"), F.explode("common").alias("doc_id"))
    return _verify(docs, own.unionByName(large).distinct(), ["family", "i", "j"], broadcast_rows)


def _pair_links(docs: DataFrame, pairs: DataFrame, leaves: int, broadcast_rows: int) -> DataFrame:
    """Links among stated pairs (a, b, n: shingles of b): every a with some of its b in one group."""
    n = pairs.groupBy("a").agg(_salts(leaves, "n").alias("salts"))
    salted = pairs.join(n, "a").withColumn("salt", F.expr("pmod(xxhash64(b), salts)"))
    hubs = salted.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("doc_id"))
    return _verify(docs, salted.select("a", "salt", F.col("b").alias("doc_id")).unionByName(hubs), ["a", "salt"], broadcast_rows)


def _meetings(tokens: DataFrame, tile: int) -> DataFrame:
    """Pairs a, b (structs of a group) that share a prefix shingle and are not of one component, once per shingle.

    tokens: (tau, pos, gid, n, most, family, whole, lo, hi). The groups of a frequent shingle fall into tiles, and each
    pair of tiles is a key of its own, so that no task gets all of them.
    """
    some = tokens.groupBy("tau").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.min("lo").alias("tau_lo"), F.max("hi").alias("tau_hi")).where("tau_lo <> tau_hi").select("tau", "tiles")
    rows = tokens.join(some, "tau").withColumn("tile", F.expr("cast(pmod(xxhash64(gid), tiles) as int)"))
    rows = materialize(rows.select("tau", "tiles", "tile", F.struct("gid", "n", "most", "pos", "family", "whole", "lo", "hi").alias("g")), "tiles")
    left = rows.select("tau", F.col("tile").alias("i"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("j"), F.col("g").alias("x"))
    right = rows.select("tau", F.explode(F.expr("sequence(0, tile)")).alias("i"), F.col("tile").alias("j"), F.col("g").alias("y"))
    met = left.join(right, ["tau", "i", "j"]).where("(i < j OR x.gid < y.gid) AND (x.lo <> y.hi OR x.hi <> y.lo) AND NOT (x.family = y.family AND x.whole)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _close(met: DataFrame) -> DataFrame:
    """Pairs of groups (a, b) whose overlap may reach the threshold, of rows with one common prefix shingle.

    Per side: n size, most that any other set shares, pos in the prefix. What is behind a common shingle bounds the
    overlap if it is the first; positions of common shingles ascend on both sides, so what is filtered stands behind
    what stays. The shingles that stay bound the overlap by their number and what follows the last on either side.
    """
    side = lambda k: [F.col(f"{k}.gid").alias(k), *[F.col(f"{k}.{c}").alias(f"{c}_{k}") for c in ("n", "most", "pos")]]
    rows = met.select(*side("a"), *side("b"))
    fits = rows.where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").where("7 * least(n_a - pos_a, n_b - pos_b, most_a, most_b) >= 3 * (n_a + n_b)")
    ends = fits.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("hits"), F.max("pos_a").alias("last_a"), F.max("pos_b").alias("last_b"))
    return ends.where("7 * (hits + least(n_a - last_a, n_b - last_b) - 1) >= 3 * (n_a + n_b)").select("a", "b")


def ngram_components(docs: DataFrame, leaves: int = LEAVES, reach: int = REACH, tile: int = TILE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document (doc_id, n_shingles, component_id) under links of Jaccard similarity 0.75 or more.

    Null or wordless text: n_shingles 0, its own component. Null doc_id: counted, component null, never linked.
    Repeated doc_ids are one node, linked by any of their texts. Very long texts are compared whole; a block to verify
    holds at least one text. Other columns are ignored; an empty table gives no rows. Hash equality stands for shingle
    equality (64 bits). leaves, reach, tile and broadcast_rows change how work is dealt, not the result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = materialize(docs.mapInArrow(_staged, "block long, doc_id long, n long, fp binary, toks binary"), "sets")
    held = staged.where("toks is not null")
    total = held.agg(F.sum(F.octet_length("toks") / 8)).first()[0] or 0
    buckets = 1 << max(0, int(max(total / BUCKET_SHINGLES, docs.sparkSession.sparkContext.defaultParallelism)) - 1).bit_length()
    counted = held.select("block", "toks").mapInArrow(_bucketed(buckets), "bucket long, block long, taus binary, counts binary")
    shared = counted.groupBy("bucket").applyInArrow(_shared, "block long, taus binary, dfs binary")
    sets = held.select("block", "doc_id", "n", "fp", "toks")
    prefixes = sets.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_prefixes, _PREFIXES)
    reps = staged.where("n > 0").groupBy("n", "fp").agg(F.min("doc_id").alias("rep"))
    rows = materialize(prefixes, "prefixes").join(reps, ["n", "fp"])
    # one row per distinct set: copies of it in other blocks have the same prefix
    sets = materialize(rows.groupBy("n", "fp", "prefix", "rep").agg(F.max("most").alias("most"), F.first("ptoks").alias("ptoks"), F.first("ppos").alias("ppos")), "distinct")
    # sets with identical prefix and size are one group, named by its least member
    leader = sets.groupBy("n", "prefix").agg(F.min("rep").alias("gid"), F.max("most").alias("group_most"))
    members = sets.join(leader, ["n", "prefix"])

    # groups meet their best pivot: per shingle and band of sizes, the one that has the shingle earliest in its
    # prefix, which is the one with the fewest rare shingles of its own
    tokens = members.where("rep = gid").select("gid", "n", F.floor(F.log("n") / F.log(F.lit(4 / 3))).alias("band"), F.explode(F.arrays_zip("ptoks", "ppos")).alias("x")).select("gid", "n", "band", F.col("x.ptoks").alias("tau"), F.col("x.ppos").alias("pos"))
    pivot = tokens.groupBy("tau", "band").agg(F.min(F.struct(F.col("pos").alias("pivot_pos"), F.col("gid").alias("pivot"))).alias("p"), F.count("*").alias("df")).where("df > 1").select("tau", "band", "p.*")
    met = tokens.join(pivot, ["tau", "band"]).where("gid <> pivot").groupBy("gid", "pivot").agg(F.count("*").alias("hits"), F.min("pivot_pos").alias("at"))
    # families: every group goes with the pivot that most groups meet, of those it shares at least half as much with
    # as with its best
    strong = met.join(met.groupBy("gid").agg(F.max("hits").alias("best")), "gid").where("2 * hits >= best").select("gid", "pivot")
    strong = materialize(strong, "strong")
    liked = strong.groupBy("pivot").agg(F.count("*").alias("groups"))
    chosen = strong.join(liked, "pivot").groupBy("gid").agg(F.max(F.struct("groups", (-F.col("pivot")).alias("p"))).alias("x")).select("gid", (-F.col("x.p")).alias("pivot"))
    grouped = materialize(members.join(chosen, "gid", "left").select("rep", "gid", "n", "most", "group_most", F.coalesce("pivot", "gid").alias("family"), F.when(F.col("rep") == F.col("gid"), F.col("ptoks")).alias("ptoks"), F.when(F.col("rep") == F.col("gid"), F.col("ppos")).alias("ppos")), "families")
    heads = chosen.select("pivot").distinct().select(F.col("pivot").alias("family"), F.col("pivot").alias("doc_id")).join(grouped.select(F.col("rep").alias("doc_id"), "n"), "doc_id")
    family = grouped.select("family", F.col("rep").alias("doc_id"), "n").unionByName(heads.select("family", "doc_id", "n")).distinct()
    family = materialize(family, "members")
    blocks = materialize(_family_blocks(family, leaves), "blocks")
    known = connected_components(materialize(_family_links(docs, family, blocks, reach, broadcast_rows), "links"))

    # what is left: pairs of groups across components that share a prefix shingle
    placed = grouped.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    placed = materialize(placed.join(blocks.select("family", "blocks"), "family", "left").select("rep", "gid", "n", "most", "group_most", "family", (F.coalesce("blocks", F.lit(1)) <= 2 * reach + 1).alias("whole"), "comp", "ptoks", "ppos"), "placed")
    spans = placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    first = placed.where("rep = gid").select("gid", "n", F.col("group_most").alias("most"), "family", "whole", F.explode(F.arrays_zip("ptoks", "ppos")).alias("x")).join(spans, "gid")
    met = _meetings(first.select(F.col("x.ptoks").alias("tau"), F.col("x.ppos").alias("pos"), "gid", "n", "most", "family", "whole", "lo", "hi"), tile)
    inside = placed.where("rep = gid AND NOT whole").join(spans.where("lo <> hi"), "gid", "left_semi").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    pairs = materialize(_close(met).unionByName(inside), "pairs")
    # expanded to members of different components
    side = lambda k, r: placed.select(F.col("gid").alias(k), F.col("rep").alias(r), F.col("n").alias(f"n_{r}"), F.col("most").alias(f"most_{r}"), F.col("comp").alias(f"comp_{r}"))
    expanded = pairs.join(side("a", "u"), "a").join(side("b", "v"), "b").where("comp_u <> comp_v AND (a <> b OR u < v) AND 7 * least(most_u, most_v) >= 3 * (n_u + n_v)")
    more = _pair_links(docs, materialize(expanded.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("n_v").alias("n")), "across"), leaves, broadcast_rows)
    final = connected_components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    of = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "fp", F.coalesce("component", "rep").alias("root"))
    base = staged.select("doc_id", "n", "fp")
    return base.join(of, ["n", "fp"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
