"""Hard-negative mining by ball-tree branch-and-bound over inner products.

The index is a written table of blocks of rows, each with a ball tree of its own: a node has the centre and the radius of its
rows, so the inner products of an anchor with them lie within |anchor| * radius of that with the centre. Trees are cut by label
first and by distance below, and a node knows the least and the largest of its labels.

Positives are a search for each anchor's k best rows of its label: a node whose upper bound is beneath the k-th best so far
is pruned. Each positive's score opens a window of scores for negatives, a search for the k best rows of other labels within
it: a node is pruned if its lower bound is above the window, or its upper bound below the window or beneath the k-th best. All
windows of an anchor descend together. A leaf is scored exactly, as one product with the anchors that reach it.

What's best so far is kept along a task, so later blocks are pruned by what earlier ones gave, and a task yields its k best for
each search once. Anchors are shipped in chunks of at most ``query_bytes``; further chunks are further passes over the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

BLOCK_ROWS, LEAF_ROWS, QUERY_BYTES = 4096, 128, 32 << 20
#: Searches that descend together: bounds what a leaf's product and its hits take.
TOGETHER = 1024
#: Scores from here on aren't exact as doubles; such blocks are multiplied as 64-bit integers.
EXACT = 1 << 53
LEAST, MOST = -(1 << 62), 1 << 62
INDEX = "dim int, ids binary, labels binary, v binary, nodes binary, centres binary, radii binary"


def vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label long, v array<long>): floor(scale * x) of each component; rows with a null vec_id or label, or whose vector is null, empty, or has a null or non-finite component are left out."""
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.coalesce(good, F.lit(False))).select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def tree(labels: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of rows; for each node begin, end, left child, right child or -1, least and largest label; centres; radii). Node 0 is the root.

    A node of several labels is cut between two of them, near the middle of its rows, and others at the median of the difference in
    distance to two far rows. Equal rows may fall to either side.
    """
    order = np.argsort(labels, kind="stable")
    points, nodes, centres, radii = x.astype(np.float64), [], [], []
    open_ = [(0, len(labels), -1, 0)]
    while open_:
        a, b, parent, side = open_.pop()
        rows = order[a:b]
        own, mine = points[rows], labels[rows]
        centre = own.mean(axis=0)
        far = np.sqrt(((own - centre) ** 2).sum(axis=1))
        me = len(nodes)
        nodes.append([a, b, -1, -1, int(mine.min()), int(mine.max())])
        centres.append(centre)
        radii.append(far.max() * (1 + 1e-12))
        if parent >= 0:
            nodes[parent][2 + side] = me
        if b - a > leaf:
            if mine[0] != mine[-1]:
                turns = np.flatnonzero(mine[1:] != mine[:-1]) + 1
                cut = int(turns[np.argmin(np.abs(turns - (b - a) // 2))])
            else:
                one = own[far.argmax()]
                away = ((own - one) ** 2).sum(axis=1)
                other = own[away.argmax()]
                order[a:b] = rows[np.argsort(away - ((own - other) ** 2).sum(axis=1), kind="stable")]
                cut = (b - a) // 2
            open_ += [(a, a + cut, me, 0), (a + cut, b, me, 1)]
    return order, np.array(nodes, dtype=np.int64), np.array(centres), np.array(radii)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX.split(", ")]
    held: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, labels, x = (np.concatenate(p) for p in zip(*held.pop(dim), strict=True))
        order, nodes, centres, radii = tree(labels, x)
        parts = (ids[order], labels[order], x[order], nodes, centres, radii)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], names=names)

    for whole in batches:
        lengths = whole.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            batch = whole.filter(pa.array(lengths == dim))
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            for i in range(0, len(ids), BLOCK_ROWS):
                held.setdefault(dim, []).append((ids[i : i + BLOCK_ROWS], labels[i : i + BLOCK_ROWS], x[i : i + BLOCK_ROWS]))
                if sum(len(p[0]) for p in held[dim]) >= BLOCK_ROWS:
                    yield block(dim)
    for dim in list(held):
        yield block(dim)


def index(base: DataFrame) -> DataFrame:
    """base (vec_id long, label long, v array<long>) -> the written index, a row a block of BLOCK_ROWS vectors of one length, or less than twice as many."""
    return stash(base.mapInArrow(_build, INDEX), "zstd")


class Block:
    """One block of the index."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, v: bytes, nodes: bytes, centres: bytes, radii: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.x, self.nodes = np.frombuffer(v, np.int64).reshape(-1, dim), np.frombuffer(nodes, np.int64).reshape(-1, 6)
        self.centres, self.radii = np.frombuffer(centres).reshape(-1, dim), np.frombuffer(radii)
        self.largest = max(int(self.x.max()), -int(self.x.min()))
        self.points = self.x.astype(np.float64)


class Searches:
    """Searches of one task, and the k best rows of each so far: the highest scores within [low, high], ties to the smaller id.

    ``own``: each search's anchor, by its place in ``x``. Searches of an anchor follow each other.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.x, self.ids, self.labels, self.own, self.k, self.same = x, ids, labels, own, k, same
        self.points, self.norm = x.astype(np.float64), np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.sums = np.abs(x).astype(object).sum(axis=1) if len(x) and np.abs(x.astype(np.float64)).sum(axis=1).max() >= EXACT else np.abs(x).sum(axis=1)
        self.low, self.high = low, high
        self.score = np.full((len(own), k), LEAST, dtype=np.int64)
        self.vec = np.full((len(own), k), MOST, dtype=np.int64)
        self.scored = self.leaves = 0

    def take(self, block: Block) -> None:
        if len(self.own) and int(self.sums.max()) * block.largest >= MOST:
            raise ValueError("scores don't fit into 62 bits")
        for i in range(0, len(self.own), TOGETHER):
            self._descend(block, np.arange(i, min(i + TOGETHER, len(self.own))))

    def _bar(self, s: np.ndarray) -> np.ndarray:
        """What a score must reach to count."""
        return np.maximum(self.low[s], self.score[s, -1])

    def _descend(self, block: Block, s: np.ndarray) -> None:
        stack = [(0, s)]
        while stack:
            node, s = stack.pop()
            s = self._open(block, node, s)
            if not len(s):
                continue
            begin, end, left, right = block.nodes[node, :4].tolist()
            if left < 0:
                self._leaf(block, begin, end, s)
                continue
            # first to the child whose centre scores higher for most, so that bars rise early
            nearer = self._products(s, block.centres[left] - block.centres[right]) >= 0
            stack += [(right, s), (left, s)] if 2 * nearer.sum() >= len(s) else [(left, s), (right, s)]

    def _products(self, s: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """The inner products of searches' anchors, each anchor's computed once, with one vector."""
        at = self.own[s]
        return (self.points[at[0] : at[-1] + 1] @ centre)[at - at[0]]

    def _open(self, block: Block, node: int, s: np.ndarray) -> np.ndarray:
        """The searches that can't prune a node."""
        least, most = block.nodes[node, 4:].tolist()
        label = self.labels[self.own[s]]
        s = s[(label >= least) & (label <= most)] if self.same else s[(label != least) | (label != most)]
        if not len(s):
            return s
        middle = self._products(s, block.centres[node])
        reach = self.norm[self.own[s]] * block.radii[node]
        slack = 1e-9 * (1 + np.abs(middle) + reach)
        return s[(middle + reach + slack >= self._bar(s)) & (middle - reach - slack <= self.high[s])]

    def _leaf(self, block: Block, begin: int, end: int, s: np.ndarray) -> None:
        anchors, turn = np.unique(self.own[s], return_inverse=True)
        if int(self.sums[anchors].max()) * block.largest < EXACT:
            score = (self.points[anchors] @ block.points[begin:end].T).astype(np.int64)
        else:
            score = self.x[anchors] @ block.x[begin:end].T
        self.scored, self.leaves = self.scored + score.size, self.leaves + 1
        ids, labels = block.ids[begin:end], block.labels[begin:end]
        if self.same:
            fits = (labels[None] == self.labels[anchors][:, None]) & (ids[None] != self.ids[anchors][:, None])
        else:
            fits = labels[None] != self.labels[anchors][:, None]
        score = np.where(fits, score, LEAST)[turn]
        row, col = np.nonzero((score >= self._bar(s)[:, None]) & (score <= self.high[s][:, None]) & (score > LEAST))
        if not len(row):
            return
        hit = np.unique(row)
        of, got, vec = np.concatenate((row, np.repeat(hit, self.k))), np.concatenate((score[row, col], self.score[s[hit]].ravel())), np.concatenate((ids[col], self.vec[s[hit]].ravel()))
        order = np.lexsort((vec, -got, of))
        of, got, vec = of[order], got[order], vec[order]
        begins = np.searchsorted(of, hit)
        best = begins[:, None] + np.arange(self.k)
        self.score[s[hit]], self.vec[s[hit]] = got[best], vec[best]


def _searching(shared, k: int, same: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict[int, Searches] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] in shared.value:
                    if r["dim"] not in running:
                        running[r["dim"]] = Searches(*shared.value[r["dim"]][1:], k, same)
                    running[r["dim"]].take(Block(**r))
        for dim, s in running.items():
            search, place = np.nonzero(s.score > LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[dim][0][search]), pa.array(s.vec[search, place]), pa.array(s.score[search, place])], names=["search", "found_id", "score"])

    return kernel


def _search(blocks: DataFrame, searches: DataFrame, k: int, same: bool, query_bytes: int) -> DataFrame:
    """searches (search long, anchor long, vec_id, label, v, low long, high long) -> search, found_id, score, rank: each search's k best."""
    spark = blocks.sparkSession
    size = searches.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    chunks = max(1, -(-int(size[1]) * 8 // query_bytes))
    out = None
    for c in range(chunks):
        # all searches of an anchor are in one chunk
        part = searches.where(F.pmod(F.xxhash64("anchor"), F.lit(chunks)) == c) if chunks > 1 else searches
        got = part.withColumn("dim", F.size("v")).toArrow()  # of query_bytes, about
        held = {}
        for dim in set(got["dim"].to_pylist()):
            of = got.filter(pc.equal(got["dim"], dim)).combine_chunks()
            of = of.sort_by("anchor")
            column = lambda c: of[c].combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            _, first, own = np.unique(column("anchor"), return_index=True, return_inverse=True)
            x = of["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            held[dim] = column("search"), x[first], column("vec_id")[first], column("label")[first], own, column("low"), column("high")
        one = blocks.mapInArrow(_searching(spark.sparkContext.broadcast(held), k, same), "search long, found_id long, score long")
        out = one if out is None else out.union(one)
    best = Window.partitionBy("search").orderBy(F.desc("score"), "found_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(base: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """base and anchors (vec_id long, label long, v array<long>) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products. An anchor's positives are the best ``positives`` rows of its label but those of its own
    vec_id; for each, its negatives are the best ``negatives`` rows of other labels whose scores are from ``least`` to
    ``most`` hundredths of the positive's. Ties go to the smaller vec_id. A negative positive score gives an empty window.

    Every row of the anchors is an anchor of its own, also where vec_ids repeat, and every row of the base a candidate. Only
    vectors of an anchor's length are candidates. Anchors without a positive, and positives without a negative, have no rows;
    empty tables give none. Components whose scores could leave 62 bits raise an error. Other columns are ignored.
    """
    blocks = index(base.select("vec_id", "label", "v"))
    asked = stash(anchors.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "v"))
    whole = asked.select(F.col("anchor").alias("search"), "*", F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    found = _search(blocks, whole, positives, True, query_bytes).select(F.col("search").alias("anchor"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = stash(found.join(asked, "anchor").withColumn("search", F.monotonically_increasing_id()))
    # hundredths of any score of 62 bits, without a product that overflows
    part = lambda p: (F.col("positive_score").cast("decimal(38,0)") * p) / F.lit(100).cast("decimal(3,0)")
    windows = pairs.select("search", "anchor", "vec_id", "label", "v", F.ceil(part(least)).cast("long").alias("low"), F.floor(part(most)).cast("long").alias("high"))
    mined = _search(blocks, windows.where("low <= high"), negatives, False, query_bytes)
    return mined.join(pairs.select("search", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score"), "search").select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
