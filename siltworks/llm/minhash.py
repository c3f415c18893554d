"""MinHash near-duplicates by tensored banding, with exact confirmation.

Two collections of ``bands`` small keys (``rows`` minima each) are computed per document; the table keys
are all pairs of one key of each collection, so bands**2 tables cost 2 * bands * rows minima. A pair of
documents shares a table exactly when it agrees in some key of both collections. A pair of similarity s
is seen with probability (1 - (1 - s**rows)**bands)**2: 0.999 at 0.75, 0.02 at 0.3 for the defaults.

Table keys are only formed from collection keys that two or more distinct sets share, as no other can
meet; this leaves nothing out and keeps unique documents out of the tables.

Every bucket ties its documents to its smallest id, and documents that are tied are a family. Each document
is compared with the id that the most of its family's documents are tied to. What this leaves outside its
family's largest component is compared, in blocks, with those of the family's documents with which it shares a table:
the sets of some such documents and of some of the family meet in one task, which returns links only. Blocks are
bounded in bytes, so a large family makes more of them; no pair that shares a table is given up.

Documents with equal shingle sets are folded into one before all this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Bitmap, byte_table, chain, discard, hot_keys, mix, skewed_join, slices, stash, word_hash, words
from .components import components

BANDS, ROWS, SHINGLE, BLOCK_BYTES, BLOCK_DOCS = 20, 4, 5, 4 << 20, 500
#: Into how many parts the rows of a family, and each thousand of the rows tied to one id, are dealt for a join.
SALTS, TIES = 64, 500
_SPACE = byte_table((0x09, 0x0D), (0x20, 0x20))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row, end to end, and offsets: k words, or all words of a shorter row as one."""
    low = LOWER[data]
    starts, ends, row = words(low, offs, _SPACE)
    w = word_hash(low, starts, ends)
    count = np.diff(row)
    h = chain(w, k)
    out, ends_out = [], np.zeros(len(offs), dtype=np.int64)
    for i, (a, c) in enumerate(zip(row[:-1].tolist(), count.tolist(), strict=True)):
        if c >= k:
            x = np.sort(h[a : a + c - k + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif c:
            x = chain(w[a : a + c], c)
        else:
            x = np.zeros(0, dtype=np.uint64)
        out.append(x)
        ends_out[i + 1] = ends_out[i] + len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), ends_out


def _sketch(bands: int, rows: int, k: int):
    rng = np.random.default_rng(20240229)
    seeds = rng.integers(1, 2**63, size=(2 * bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch, data, offs in slices(batches):
            sets, ends = shingle_sets(data, offs, k)
            size = np.diff(ends)
            full = size > 0
            keys = np.zeros((batch.num_rows, 2 * bands), dtype=np.uint64)
            digest = np.zeros((batch.num_rows, 2), dtype=np.uint64)
            if full.any():
                at = ends[:-1][full]
                for b in range(2 * bands):
                    for r in range(rows):
                        x = sets * seeds[b, r]
                        x ^= x >> np.uint64(29)
                        x *= seeds[b, r]
                        least = np.minimum.reduceat(x, at)
                        keys[full, b] = mix(keys[full, b] * np.uint64(31) + least + np.uint64(b + 1))
                digest[full, 0] = np.add.reduceat(mix(sets), at)
                digest[full, 1] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * bands, dtype=np.int32)), flat)
            d = digest.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], names=["doc_id", "n_shingles", "d0", "d1", "keys"])

    return kernel


def _sets(k: int, wanted: Bitmap):
    """(id, place, text) -> the sets of the rows that ``wanted`` takes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for whole in batches:
            for batch, data, offs in slices(iter([whole.filter(pa.array(wanted.takes(whole.column(1).to_numpy())))])):
                sets, ends = shingle_sets(data, offs, k)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "set"])

    return kernel


def _confirmed(ties: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, p; n: how many have this p) whose full sets are similar enough, as links (a, b).

    The rows of a p are dealt to n / TIES parts, and its set is sent to each.
    """
    parts = F.ceil(F.col("n") / TIES).cast("int")
    dealt = ties.select("id", "p", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    every = ties.groupBy("p").agg(F.max("n").alias("n")).select("p", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    a, b = sets.select("id", F.col("set").alias("s")), every.join(sets.select(F.col("id").alias("p"), F.col("set").alias("t")), "p")
    sized = F.greatest(F.size("s"), F.size("t")) * percent <= F.least(F.size("s"), F.size("t")) * 100
    shared = F.size(F.array_intersect("s", "t"))
    return dealt.join(a, "id").join(b, ["p", "part"]).where(sized).where(F.lit(100) * shared >= F.lit(percent) * (F.size("s") + F.size("t") - shared)).select(F.col("id").alias("a"), F.col("p").alias("b"))


def _overlaps(percent: int):
    """One block -> links between its open documents (probe) and those of its documents of another component that share a table with them."""

    def links(block: pa.Table) -> pa.Table:
        ids, comp, probe = block["id"].to_numpy(), block["c"].to_numpy(), block["probe"].to_numpy(zero_copy_only=False).astype(bool)
        lists = block["set"].combine_chunks()
        size = lists.value_lengths().to_numpy()
        tokens = lists.flatten().to_numpy().view(np.uint64)  # in whose order sets are
        ends = np.cumsum(size)
        base = np.flatnonzero(~probe)
        keys = block["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        bands = keys.shape[1] // 2
        out_a, out_b = [], []
        for i in np.flatnonzero(probe):
            near = base[(comp[base] != comp[i]) & (100 * np.minimum(size[base], size[i]) >= percent * np.maximum(size[base], size[i]))]
            for lo in range(0, len(near), 4096):
                part = near[lo : lo + 4096]
                same = keys[part] == keys[i]
                part = part[same[:, :bands].any(axis=1) & same[:, bands:].any(axis=1)]
                mine = tokens[ends[i] - size[i] : ends[i]]
                n = size[part]
                at = np.repeat(ends[part] - np.cumsum(n), n) + np.arange(n.sum())
                found = np.searchsorted(mine, tokens[at])
                hit = mine[np.minimum(found, len(mine) - 1)] == tokens[at]
                shared = np.bincount(np.repeat(np.arange(len(part)), n), weights=hit, minlength=len(part)).astype(np.int64)
                hit = ids[part[100 * shared >= percent * (n + size[i] - shared)]]
                out_a.append(np.full(len(hit), ids[i]))
                out_b.append(hit)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(cat(out_a), pa.int64()), "b": pa.array(cat(out_b), pa.int64())})

    return links


def _block_links(family: DataFrame, label: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between a family's documents outside its largest component and all of the family.

    A family's documents are dealt to as many parts as their number or the bytes of their sets need, and so are those outside
    the largest component; every pair of parts is a block.
    """
    members = family.withColumnRenamed("component", "f").join(label.withColumnRenamed("component", "c"), "id", "left").select("f", "id", F.coalesce("c", "id").alias("c")).join(sketch.select("id", (F.col("n_shingles") * 8 + 8 * F.size("keys")).alias("bytes"), "keys"), "id")
    members = stash(members)
    by_comp = members.groupBy("f", "c").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    by_family = by_comp.groupBy("f").agg(F.count("*").alias("comps"), F.max_by("c", F.struct("n", -F.col("c"))).alias("main"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max(F.struct("n", -F.col("c"), "bytes")).alias("most")).where("comps > 1")
    need = lambda n, size: F.ceil(F.greatest(n / BLOCK_DOCS, size / block_bytes)).cast("int")
    parts = by_family.select("f", "main", need(F.col("n"), F.col("bytes")).alias("parts"), need(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("probes"))
    # a family may hold a third of all rows, so each is dealt to SALTS parts
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)))
    open_ = salted.join(parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["f", "salt"])
    open_ = stash(open_.select("f", "id", "c", "keys", "main", "parts", "probes").join(sets, "id"))
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    base = open_.select("f", deal(F.col("parts")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("j"), "id", "c", "keys", "set", F.lit(False).alias("probe"))
    probes = open_.where("c <> main").select("f", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), deal(F.col("probes")).alias("j"), "id", "c", "keys", "set", F.lit(True).alias("probe"))
    found = stash(base.union(probes).groupBy("f", "i", "j").applyInArrow(_overlaps(percent), "a long, b long"))
    discard(members, open_)
    return found


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row per input row.

    Links rows with 100 * shared shingles >= percent * all shingles. Null and empty texts have no shingles and link
    with nothing. Rows that repeat a doc_id are links of one document; a null doc_id is returned alone, in no
    component but its own (null, kept). Other columns are ignored. An empty table gives an empty one.
    """
    text = docs.select("doc_id", "text")
    base = stash(text.mapInArrow(_sketch(bands, rows, k), "doc_id long, n_shingles long, d0 long, d1 long, keys array<long>").withColumn("k", F.concat_ws(":", "n_shingles", "d0", "d1")).drop("d0", "d1"))
    known = base.where("doc_id is not null and n_shingles > 0")
    reps = known.groupBy("k").agg(F.min("doc_id").alias("id"))
    often = hot_keys(base, "k")
    # the keys of a set: of the row with the smallest id, of which repeated rows have the same
    sketch = stash(known.withColumnRenamed("doc_id", "id").join(reps, ["k", "id"]).select("id", "n_shingles", "keys").dropDuplicates(["id", "n_shingles", "keys"]))
    half = sketch.select("id", "n_shingles", F.posexplode("keys").alias("b", "key"))
    met = half.groupBy("b", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("b", "key")
    both = half.join(met, ["b", "key"]).groupBy("id", "n_shingles").agg(F.collect_set(F.when(F.col("b") < bands, F.struct("b", "key"))).alias("x"), F.collect_set(F.when(F.col("b") >= bands, F.struct("b", "key"))).alias("y"))
    keys = both.select("id", "n_shingles", F.explode("x").alias("x"), "y").select("id", "n_shingles", "x", F.explode("y").alias("y")).select("id", "n_shingles", F.xxhash64("x.b", "x.key", "y.b", "y.key").alias("t"))
    tables = stash(keys)
    first = tables.groupBy("t").agg(F.min("id").alias("p"), F.max("id").alias("last")).where("p < last").select("t", "p")

    ties = stash(tables.join(first, "t").where("id <> p").select("id", "p").distinct())
    wanted = ties.select("id").union(ties.select(F.col("p").alias("id"))).distinct()
    # a bitmap of fixed size keeps most other texts out of the pass; what it lets through by chance is left out by the join
    near = text.where("doc_id is not null").select(F.col("doc_id").alias("id"), Bitmap.place(F.col("doc_id")).alias("place"), "text")
    sets = stash(near.mapInArrow(_sets(k, Bitmap(wanted)), "id long, set array<long>").join(wanted, "id", "left_semi").distinct())
    best = skewed_join(ties, ties.groupBy("p").agg(F.count("*").alias("n")), "p", hot_keys(ties, "p")).groupBy("id").agg(F.max_by(F.struct("p", "n"), F.struct("n", -F.col("p"))).alias("x")).select("id", "x.p", "x.n")
    linked = stash(_confirmed(best, sets, percent))
    # as many links as ids, and few more: each id to the least it is tied to, and that to the others
    least = ties.groupBy("id").agg(F.min("p").alias("m"))
    few = least.select(F.col("id").alias("a"), F.col("m").alias("b")).union(ties.join(least, "id").where("p <> m").select("p", "m").distinct())
    # families and confirmed components are two graphs, done together
    done = components(few.select(F.lit(0).alias("g"), "a", "b").union(linked.select(F.lit(1), "a", "b")), "g")
    family, label = (done.where(F.col("g") == i).drop("g") for i in (0, 1))
    rest = _block_links(family, label, sketch, sets, percent)
    linked = linked.union(rest)
    discard(tables, ties, sets)

    same = skewed_join(known.select("doc_id", "k"), reps, "k", often).select("doc_id", "id").distinct()
    # a doc_id on several rows ties its sets together
    repeated = same.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    label = components(linked.union(repeated))
    out = skewed_join(base.select("doc_id", "n_shingles", "k"), reps, "k", often, "left").join(label, "id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
