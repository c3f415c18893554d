"""Exact top-k inner products over an impact-ordered index, score at a time.

The index is a written table of blocks of vectors. For each dimension a block holds its vectors in falling order of
their component, cut into posting segments of equal quantised impact (the component rounded down to a multiple of
STEP). Impacts count from the least component of the dimension up, or from the highest down where a query's weight is
negative, so no contribution to a score is negative.

A query takes a block's segments, of all dimensions, in falling order of weight times impact. Each posting adds the most that it
can give to its vector's running sum; one that wasn't taken yet adds at most what the next segment in the order can. So a
vector's upper bound is its sum and, for each of its dimensions that isn't taken, that next impact. A query stops at the first
step that proves few vectors can still be among its k best: those whose upper bound reaches the k-th highest lower bound, or the
k-th highest score met by the same task. Just these are scored again from the exact components. Without such a proof all
segments are taken.

A block yields its k best for each query, and the blocks' lists are merged by a window. Queries are shipped
in chunks of at most ``query_bytes``; further chunks are further passes over the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

STEP, BLOCK_ROWS, QUERY_BYTES = 8, 4096, 32 << 20
#: The share of a block that is scored again at most where a proof has stopped a query, and the shares of all postings after which one is sought.
RESCORE, CUTS = 1 / 16, np.array([0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1])


def vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; rows whose vector is null, empty, or has a null or non-finite component are left out."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


INDEX = "dim int, ids binary, v binary, places binary, seg_dim binary, seg_low binary, seg_start binary"


def segments(x: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of rows by dimension and falling component, end to end; dimension, quantised impact and start of each segment)."""
    n, dim = x.shape
    places = np.argsort(-x, axis=0, kind="stable").T
    low = np.take_along_axis(x.T, places, axis=1) // step * step
    turn = np.ones((dim, n), dtype=bool)
    turn[:, 1:] = low[:, 1:] != low[:, :-1]
    start = np.flatnonzero(turn)
    return places.ravel(), start // n, low.ravel()[start], start


class Block:
    """One block of the index."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, places: np.ndarray, seg_dim: np.ndarray, seg_low: np.ndarray, seg_start: np.ndarray, step: int = STEP):
        self.ids, self.x, self.places, self.dim, self.start, self.step = ids, x, places, seg_dim, seg_start, step
        self.size = np.diff(np.append(seg_start, len(places)))
        self.low = seg_low
        self.least, self.most = x.min(axis=0), x.max(axis=0)

    def best(self, qid: int, q: np.ndarray, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray, float]:
        """(rows, scores) of the k best rows for a query, itself left out, and the share of postings that were taken; rows below ``bar`` may be missing."""
        n = len(self.ids)
        weight = np.abs(q)[self.dim].astype(np.float64)
        up = q[self.dim] > 0
        near = np.where(up, self.low - self.least[self.dim], self.most[self.dim] - self.low - self.step + 1)
        high = weight * (near + self.step - 1)
        order = np.argsort(-high)
        order = order[weight[order] > 0]
        high = high[order]
        ends = np.cumsum(self.size[order])
        total = int(ends[-1]) if len(order) else 0
        base = float((np.where(q > 0, self.least, self.most) * q).sum())
        slack = 1e-9 * (1 + abs(base) + float(high.sum()))
        # what the bounds of a vector's postings may differ from its components by
        width = float(np.abs(q).sum()) * (self.step - 1.0)
        upper, left = np.full(n, base), np.full(n, int((q != 0).sum()))
        own = self.ids == qid
        may, done = ~own, 0
        for cut in np.searchsorted(ends, total * CUTS) + 1 if total else ():
            taken = order[done:cut]
            size = self.size[taken]
            at = np.repeat(self.start[taken] - np.cumsum(size) + size, size) + np.arange(size.sum())
            rows = self.places[at]
            upper += np.bincount(rows, weights=np.repeat(high[done:cut], size), minlength=n)
            left -= np.bincount(rows, minlength=n)
            done = max(done, int(cut))
            next_ = high[done] if done < len(order) else 0.0
            # a sum less the widths is a lower bound, as what wasn't taken adds something
            reach = max(bar, np.partition(upper[~own], -k)[-k] - width if n - own.sum() > k else -np.inf)
            may = ~own & (upper + next_ * left + slack >= reach - slack)
            if may.sum() <= max(RESCORE * n, 2 * k):
                break
        rows = np.flatnonzero(may)
        score = self.x[rows] @ q
        first = np.lexsort((self.ids[rows], -score))[:k]
        return rows[first], score[first], (int(ends[min(done, len(order)) - 1]) / total if total else 0.0)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX.split(", ")]
    raw = lambda a, kind: pa.array([np.ascontiguousarray(a, dtype=kind).tobytes()], pa.binary())
    held: dict[int, list] = {}

    def block(dim: int, parts: list) -> pa.RecordBatch:
        ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        places, seg_dim, seg_low, seg_start = segments(x)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), raw(ids, "<i8"), raw(x, "<i8"), raw(places, "<u2"), raw(seg_dim, "<u4"), raw(seg_low, "<i8"), raw(seg_start, "<u4")], names=names)

    for whole in batches:
        lengths = whole.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            batch = whole.filter(pa.array(lengths == dim))
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for i in range(0, len(ids), BLOCK_ROWS):
                parts = held.setdefault(dim, [])
                parts.append((ids[i : i + BLOCK_ROWS], x[i : i + BLOCK_ROWS]))
                if sum(len(p[0]) for p in parts) >= BLOCK_ROWS:
                    yield block(dim, held.pop(dim))
    for dim, parts in held.items():
        yield block(dim, parts)


def index(base: DataFrame) -> DataFrame:
    """base (vec_id long, v array<long>) -> the written index, a row a block of BLOCK_ROWS vectors of one length, or twice as many less one."""
    return stash(base.mapInArrow(_build, INDEX), "zstd")


def _search(chunk, k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = chunk.value
        bars: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                numbers, qids, qs = queries.get(r["dim"], ((), (), ()))
                kinds = (("ids", "<i8"), ("v", "<i8"), ("places", "<u2"), ("seg_dim", "<u4"), ("seg_low", "<i8"), ("seg_start", "<u4"))
                ids, x, places, seg_dim, seg_low, seg_start = (np.frombuffer(r[c], dtype=t) for c, t in kinds)
                block = Block(ids, x.reshape(-1, r["dim"]), places.astype(np.int64), seg_dim.astype(np.int64), seg_low, seg_start.astype(np.int64))
                largest = max(-int(block.least.min()), int(block.most.max()), 0)
                for j, (number, qid, q) in enumerate(zip(numbers, qids, qs, strict=True)):
                    if largest * sum(abs(c) for c in q.tolist()) >= 1 << 63:
                        raise ValueError(f"scores of query {qid} don't fit into 64 bits")
                    met = bars.get((r["dim"], j), np.zeros(0, dtype=np.int64))
                    rows, score, _ = block.best(int(qid), q, k, float(met[-1]) if len(met) == k else -np.inf)
                    bars[r["dim"], j] = np.sort(np.append(met, score))[::-1][:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number)), pa.array(np.full(len(rows), qid)), pa.array(ids[rows]), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    return kernel


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """base and queries (vec_id long, v array<long>) -> query_id, rank, vec_id, score: each query's k highest integer inner products.

    A query's own vec_id isn't a candidate; ties go to the smaller vec_id; only vectors of the query's length are
    candidates. Queries without a candidate have no rows. Repeated vec_ids are candidates each, and repeated query rows are
    answered each. Components whose products
    could leave 64 bits raise an error.
    """
    spark = base.sparkSession
    blocks = index(base)
    queries = stash(queries.select(F.monotonically_increasing_id().alias("query"), "vec_id", "v"))
    size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    chunks = max(1, -(-int(size[1]) * 8 // query_bytes)) if size[0] else 1
    out = None
    for c in range(chunks):
        part = queries.where(F.pmod(F.xxhash64("query"), F.lit(chunks)) == c) if chunks > 1 else queries
        got = part.select("query", "vec_id", "v", F.size("v").alias("dim")).toArrow()  # of query_bytes, about
        held = {}
        for dim in set(got["dim"].to_pylist()):
            of = got.filter(pc.equal(got["dim"], dim)).combine_chunks()
            held[dim] = of["query"].to_numpy(), of["vec_id"].to_numpy(), of["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        one = blocks.mapInArrow(_search(spark.sparkContext.broadcast(held), k), "query long, query_id long, vec_id long, score long")
        out = one if out is None else out.union(one)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
