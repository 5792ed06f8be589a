"""The most similar vectors of every vector: cross-polytope hashing with exact reranking.

Unit vectors are rotated by sign flips and fast Hadamard transforms; a hash is the signed axis that comes out largest. Several hashes make
the bucket of a table. Every vector stands in its own bucket of each table and asks in the buckets that its next-best axes give.
Crowded buckets are divided by further hashes, as often as they need it: what is near stays together there, since a crowd
has nearer neighbours. Within a bucket each asker gets its best by the exact cosine, so that near-copies never crowd each other out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.plans.scratch import materialize

#: Hashes that a table has at most, vectors that a bucket has at most unless they agree in all of them, rows compared at once.
DEEPEST, BUCKET, BLOCK = 6, 1_000, 512
#: Most crowded buckets whose names go to all executors, so that rows are shuffled once; of more, rows are joined with them by a shuffle of their own.
MOST_CROWDED = 1_000_000
#: Similarities are rounded to multiples of 1 / ONE.
ONE = 1e12


def usable(x: Column, dims: int) -> Column:
    """Whether a vector has exactly `dims` finite non-null entries, not all zero."""
    ok = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    return F.coalesce((F.size(x) == dims) & ok & F.exists(x, lambda e: e != 0), F.lit(False))


def _units(x: np.ndarray) -> np.ndarray:
    """The rows divided by their lengths; divided by their largest entries first, so that no square overflows. Squares are summed in the order of the dimensions."""
    y = x / np.abs(x).max(1, keepdims=True)
    t = np.zeros(len(y))
    for j in range(y.shape[1]):
        t += y[:, j] * y[:, j]
    return y / np.sqrt(t)[:, None]


def _rotations(dims: int, tables: int, seed: int) -> np.ndarray:
    """Signs of three flips for each hash of each table: (tables, DEEPEST, 3, width)."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), size=(tables, DEEPEST, 3, 1 << max(1, (dims - 1).bit_length())))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width) / np.float32(math.sqrt(width))


def _axes(x: np.ndarray, signs: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The `best` signed axes of each rotated row, best first, and how far each falls short of the first."""
    for s in signs:
        x = _hadamard(x * s)
    k = np.argpartition(-np.abs(x), best, axis=1)[:, :best] if best < x.shape[1] else np.tile(np.arange(x.shape[1]), (len(x), 1))
    v = np.take_along_axis(x, k, 1)
    order = np.argsort(-np.abs(v), axis=1, kind="stable")
    k, v = np.take_along_axis(k, order, 1), np.take_along_axis(v, order, 1)
    return 2 * k + (v < 0), np.abs(v[:, :1]) - np.abs(v)


def _codes(x: np.ndarray, signs: np.ndarray, depth: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the axes of its own bucket (n, DEEPEST), and those of all its buckets (n, 1 + probes, depth), its own first."""
    found = [_axes(x, s, min(3, x.shape[1])) for s in signs]
    own = np.stack([f[0][:, 0] for f in found], axis=1)
    # Buckets that change one axis to its next best or next but one, or two to their next best, by what is lost.
    loss = np.stack([f[1] for f in found[:depth]], axis=1)
    options = [((j, r),) for j in range(depth) for r in (1, 2) if r < loss.shape[2]] + [((i, 1), (j, 1)) for i in range(depth) for j in range(i)]
    cost = np.stack([sum(loss[:, j, r] ** 2 for j, r in o) for o in options], axis=1)
    pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    out = np.repeat(own[:, None, :depth], 1 + pick.shape[1], axis=1)
    for o, changes in enumerate(options):
        row, at = np.nonzero(pick == o)
        for j, r in changes:
            out[row, at + 1, j] = found[j][0][row, r]
    return own, out


def _hashed(batches: Iterator[pa.RecordBatch], dims: int, tables: int, depth: int, probes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """For each vector, once: its unit vector, its bucket and the probed ones of each table, one table after another, and the further hashes that may divide each."""
    signs = _rotations(dims, tables, seed)
    width = signs.shape[-1]
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            n = part.num_rows
            exact = _units(part.column("x").flatten().to_numpy().reshape(n, dims))
            x = np.zeros((n, width), np.float32)
            x[:, :dims] = exact
            buckets, rests = [], []
            for t in range(tables):
                own, codes = _codes(x, signs[t], depth, probes)
                tail = np.zeros((n, DEEPEST), np.uint8)
                tail[:] = own % 256 if width * 2 <= 256 else own % 251
                bucket = np.full(codes.shape[:2], t, np.int64)
                for j in range(depth):
                    bucket = bucket * (2 * width) + codes[:, :, j]
                buckets.append(bucket)
                rests.append(tail[:, depth:])
            all_ = np.concatenate(buckets, axis=1)
            rest = np.ascontiguousarray(np.stack(rests, axis=1))
            many, deep = all_.shape[1], DEEPEST - depth
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * many + 1, many), pa.int32()), pa.array(all_.ravel()))
            tails = pa.FixedSizeBinaryArray.from_buffers(pa.binary(deep * tables), n, [None, pa.py_buffer(rest.tobytes())]).cast(pa.binary())
            vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dims), n, [None, pa.py_buffer(exact.astype("<f8").tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), vec, lists, tails, pa.array(np.full(n, many // tables, np.int32)), pa.array(np.full(n, deep, np.int32))], names=["id", "vec", "buckets", "rests", "each", "deep"])


def _best(ids: np.ndarray, home: np.ndarray, x: np.ndarray, keep: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: for each row (asker) its `keep` most similar homes, equal ones by smaller id, as (asker id, id, similarity)."""
    here = np.nonzero(home)[0]
    here = here[np.argsort(ids[here], kind="stable")]
    y, yi = x[here], ids[here]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(ids) if len(here) else 0, BLOCK):
        xa = x[a : a + BLOCK]
        best_s, best_i = np.full((len(xa), 0), 0.0), np.zeros((len(xa), 0), np.int64)
        for b in range(0, len(here), 4 * BLOCK):
            yb = y[b : b + 4 * BLOCK]
            s = xa @ yb.T
            i = np.broadcast_to(yi[b : b + 4 * BLOCK], s.shape)
            s[i == ids[a : a + BLOCK, None]] = -2
            both = np.concatenate([best_s, s], 1)
            # Only what rounding can bring among the best is summed up exactly.
            cut = np.full((len(xa), 1), least) if both.shape[1] <= keep else np.maximum(-np.partition(-both, keep - 1, axis=1)[:, keep - 1 : keep], least)
            row, col = np.nonzero(s >= cut - 2 / ONE)
            exact = _rounded(s[row, col], xa, yb, row, col)
            s = np.full(s.shape, -2.0)
            s[row, col] = exact
            best_s, best_i = np.concatenate([best_s, s], 1), np.concatenate([best_i, i], 1)
            if best_s.shape[1] > keep:
                top = _top(best_s, keep)
                best_s, best_i = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_i, top, 1)
        row, col = np.nonzero(best_s >= least)
        out.append((ids[a : a + BLOCK][row], best_i[row, col], best_s[row, col]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _rounded(s: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Products s of x[row] and y[col], rounded to 12 digits as their sums in the order of the dimensions: a product's error is at most 2 n u, so only those near a half need that sum."""
    v = s * ONE
    close = np.nonzero(np.abs(v - np.floor(v) - 0.5) <= (x.shape[1] + 4) * 2.3e-16 * ONE + 1e-3)[0]
    p, q, t = row[close], col[close], np.zeros(len(close))
    for j in range(x.shape[1]):
        t += x[p, j] * y[q, j]
    v[close] = t * ONE
    return np.floor(v + 0.5) / ONE


def _top(s: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the `keep` largest values of each row, in order of columns; of equal ones the first."""
    cut = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]
    over, tie = s > cut, s == cut
    return np.nonzero(over | (tie & (np.cumsum(tie, 1) <= keep - over.sum(1, keepdims=True))))[1].reshape(len(s), keep)


def _bytes(a: pa.BinaryArray) -> bytes:
    """The values of a binary array, one after another."""
    if not len(a):
        return b""
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return a.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes()


def _search(batches: Iterator[pa.RecordBatch], dims: int, keep: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and sub-bucket; a bucket may run on into the next batch."""
    kept: pa.Table | None = None

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        ids, home = t.column("id").to_numpy(), t.column("home").to_numpy()
        x = np.frombuffer(b"".join(map(_bytes, t.column("vec").chunks)), "<f8").reshape(len(ids), dims)
        group = t.column("g").to_numpy()
        cuts = np.concatenate([[0], np.nonzero(group[1:] != group[:-1])[0] + 1, [len(group)]])
        got = [_best(ids[a:b], home[a:b], x[a:b], keep, least) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
        if not got:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=["id", "other", "similarity"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([kept, t]) if kept is not None else t
        if not t.num_rows:
            continue
        g = t.column("g").to_numpy()
        last = np.nonzero(g != g[-1])[0]
        end = int(last[-1]) + 1 if len(last) else 0
        kept = t.slice(end)
        if end and (out := solve(t.slice(0, end))) is not None:
            yield out
    if kept is not None and kept.num_rows and (out := solve(kept)) is not None:
        yield out


def similar(vectors: DataFrame, dims: int, k: int = 5, least: float = -1.0, tables: int = 6, probes: int = 3, copies: bool = True, seed: int = 7) -> DataFrame:
    """(id, other, similarity, rank): of each vector the k most similar others with a cosine of at least `least`; equal ones: smaller id first.

    vectors (id BIGINT, x ARRAY<DOUBLE>), one row per id. Vectors that are null, of another length, with null, NaN or infinite entries or of nothing
    but zeros have no partners, and are none. Further columns are ignored. No vectors give no rows. Similarities are rounded to 12 digits,
    so that multiples of one vector tie. Of vectors that are exact copies of each other only the k + 1 smallest ids can be among anyone's k most similar
    ones: the others are not indexed, and get the answer of the largest of these k + 1, which is theirs too. copies=False leaves out their
    answers, as for pairs where each must be among the other's.

    Approximate: a true partner is lost when no table and no probe brings the two together. tables and probes raise recall and cost in
    proportion. All rows are indexed and all ask.
    """
    v = vectors.where(F.col("id").isNotNull() & usable(F.col("x"), dims)).select("id", "x")
    w = W.partitionBy("x").orderBy("id")
    every = v
    first = v.select("id", F.row_number().over(w).alias("copy"), "x").where(F.col("copy") <= k + 1)
    v = materialize(first, "similar-vectors")
    n = v.count()
    depth = min(DEEPEST - 1, max(1, round(math.log(max(n, 1) / 32 + 1) / math.log(2 * (1 << max(1, (dims - 1).bit_length()))))))
    hashed = v.select("id", "x").mapInArrow(lambda it: _hashed(it, dims, tables, depth, probes, seed), "id bigint, vec binary, buckets array<bigint>, rests binary, each int, deep int")
    hashed = materialize(hashed, "similar-hashed")
    rows = hashed.select("id", "vec", "rests", "each", "deep", F.posexplode("buckets").alias("k", "bucket"))
    rest = F.expr("substring(rests, int(k div each) * deep + 1, deep)")
    rows = rows.select("bucket", rest.alias("rest"), "id", (F.col("k") % F.col("each") == 0).alias("home"), "vec")
    rows = _divide(rows, depth)
    parts = max(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
    rows = rows.repartition(parts, "g").sortWithinPartitions("g")
    found = rows.mapInArrow(lambda it: _search(it, dims, k, least), "id bigint, other bigint, similarity double")
    # The same pair has the same similarity from either side and in every bucket.
    both = F.array(F.struct("id", "other", "similarity"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "similarity"))
    exact = found.select(F.inline(both)).distinct()
    ranked = exact.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other")))
    ranked = ranked.where(F.col("rank") <= k)
    if not copies:
        return ranked
    last = v.where(F.col("copy") == k + 1).select("x", F.col("id").alias("rep"))
    more = every.join(last, "x").where("id > rep").select("id", "rep")
    return ranked.unionByName(more.join(ranked.withColumnRenamed("id", "rep"), "rep").drop("rep"))


def _divide(rows: DataFrame, depth: int) -> DataFrame:
    """rows with `g`, the bucket as it is searched: as many further hashes as it takes to have at most BUCKET homes in it."""
    g = F.xxhash64("bucket")
    homes = rows.where("home").select("bucket", "rest")
    crowded = homes.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
    crowded = crowded.select("bucket", F.least(F.lit(DEEPEST - depth), F.ceil(F.log(F.col("n") / BUCKET) / math.log(8))).cast("int").alias("deeper"))
    crowded = materialize(crowded, "similar-crowded")
    if crowded.limit(MOST_CROWDED + 1).count() <= MOST_CROWDED:
        crowded = F.broadcast(crowded)
    joined = rows.join(crowded, "bucket", "left")
    return joined.select(F.when(F.col("deeper").isNull(), g).otherwise(F.xxhash64("bucket", F.expr("substring(rest, 1, deeper)"))).alias("g"), "id", "home", "vec")
