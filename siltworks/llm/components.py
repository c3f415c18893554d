"""Connected components of a link table, as DataFrame joins.

Links are folded first: a task replaces those that it reads, a bounded number at a time, by one link from each node to the
smallest that they reach. Then two steps alternate until every node is tied to one that's tied to none: every neighbour above
a node is tied to the smallest node around it, then every neighbour below, and what they give is folded again. Each round is
a few shuffles of the links, and is written to the shared folder; only a row count, whether they're done, and the few nodes
that hold more than a five-hundredth of all links reach the driver. Its memory goes by the number of shuffles, so folds, which
need none, spare most of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, skewed_join, stash

#: Links that a task folds at a time, and into how many parts the hot nodes' share is counted.
FOLD, PARTS = 1 << 18, 500


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a, b -> each node but the smallest of its component, once, and that smallest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def folded(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(3))
        for graph in np.unique(g):
            mine = g == graph
            x, y = forest(a[mine], b[mine])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), graph)), pa.array(x), pa.array(y)], names=["g", "a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= FOLD:
            yield from folded(held)
            held, n = [], 0
    if n:
        yield from folded(held)


def _kept(links: DataFrame) -> tuple[DataFrame, int]:
    """The links, folded, as a written table, and their number, which is taken as they're written."""
    seen = Observation()
    out = stash(links.select("g", "a", "b").mapInArrow(_fold, "g int, a long, b long").observe(seen, F.count("*").alias("n")))
    return out, seen.get["n"]


def _packed(links: DataFrame) -> tuple[DataFrame, int]:
    """The links, folded as they come and once more by tasks of some FOLD each."""
    links, n = _kept(links)
    packed = _kept(links.coalesce(max(1, -(-n // FOLD))))
    discard(links)
    return packed


def _state(links: DataFrame, n: int) -> tuple[bool, list]:
    """Whether each node is tied to one that's tied to none; and the nodes with more than a PARTS-th of the n links."""
    ends = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("to")), F.struct(F.col("b").alias("x"), F.lit(None).cast("long").alias("to")))
    each = links.select("g", F.explode(ends).alias("e")).groupBy("g", "e.x").agg(F.count("*").alias("n"), F.count("e.to").alias("ties"), F.min("e.to").alias("lo"), F.max("e.to").alias("hi"))
    undone = (F.col("lo") < F.col("hi")) | F.col("ties").between(1, F.col("n") - 1)
    row = each.agg(F.count_if(undone).alias("undone"), F.collect_set(F.when(F.col("n") > max(n // PARTS, PARTS), F.col("x"))).alias("hot")).first()
    return not row["undone"], row["hot"]


def components(links: DataFrame, by: str | None = None) -> DataFrame:
    """links (a long, b long) -> (id, component): the smallest id reachable from each linked id.

    Nodes without a link don't appear. Repeated and reversed links don't matter; an empty table gives an empty one. ``by``: a column
    of ints that tells a few graphs apart, which are done together; it's returned first.
    """
    g = F.lit(0) if by is None else F.col(by)
    links, n = _packed(links.where("a <> b").select(g.cast("int").alias("g"), "a", "b"))
    while True:
        done, hot = _state(links, n)
        if done:
            break
        both = links.union(links.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("g", "a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        up = skewed_join(both.where("b > a"), least, "a", hot, also=("g",)).select("g", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = up.groupBy("g", "a").agg(F.min("b").alias("m"))
        down = skewed_join(up, low, "a", hot, also=("g",)).select("g", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        old = links
        links, n = _packed(down.union(low.select("g", "a", F.col("m").alias("b"))))
        discard(old)
    out = links.groupBy("g", F.col("a").alias("id")).agg(F.min("b").alias("component")).union(links.select("g", F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    return out.drop("g") if by is None else out.withColumnRenamed("g", by)
