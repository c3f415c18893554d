"""Repeated byte strings, by merging Burrows-Wheeler transforms of shards.

Which strings of SPAN bytes start at two or more places of the corpus? Equal strings have an equal least
GRAM-byte hash, so every run of places with the same least hash (a stretch) goes to the bucket of that hash,
and no string is looked for elsewhere. A bucket of one stretch that's nowhere else holds nothing; stretches
of equal bytes are one, with their number as weight. What's left, different stretches in one bucket, is
settled exactly by transforms:

* the stretches of a batch of buckets are two shards, each sorted by itself into its transform of rotations,
  with STEP bytes as one symbol;
* the interleave of the two starts as one after the other; each round deals it anew, stably by the symbols
  that the transforms hold, which orders it by STEP further bytes; no suffix is compared or sorted again;
* borders between places of different symbols, or of different blocks before, are kept with it. After
  SPAN / STEP rounds, a block is an interval of common prefixes of at least SPAN bytes. A block of weight 2 or
  more is a repeated string.

Buckets of more than ``hot`` different stretches are settled by one aggregation over their strings' hashes
instead, so no task holds a bucket whose size grows with the corpus. Stretches count as equal if the hash of their
bucket's least gram and one of all their bytes agree, 128 bits; so do the strings of hot buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, prefix_hash, skewed_join, slices, span_hash, stash, word_hash

SPAN, GRAM, STEP, BATCH, HOT = 200, 48, 8, 60_000, 5_000
#: Longest bytes that are hashed by eight at a time, and the number of hot keys' share of all rows.
LANES, PARTS = 2048, 500
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over each w consecutive values: running values from the left and right border of blocks of w meet in every window."""
    n = len(x)
    y = np.full(-(-n // w) * w, fill, dtype=np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    right = op.accumulate(y, axis=1).ravel()
    left = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(left[: n - w + 1], right[w - 1 : n])


def stretches(data: np.ndarray, offs: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(bucket, hash of the bytes, begin, number of places, whether a string may be in it twice) of each stretch; begin counts in data."""
    n, w = len(data), span - gram + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none.view(np.uint64), none.view(np.uint64), none, none, none.astype(bool)
    h = prefix_hash(data)
    at = np.arange(n - gram + 1)
    g = span_hash(h, at, at + gram)
    least = _sliding(g, w, np.minimum, _TOP)
    places = len(least)
    end = np.repeat(offs[1:], np.diff(offs))[:places]
    whole = np.arange(places) + span <= end
    turn = np.ones(places, dtype=bool)
    turn[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    turn[offs[1:-1][offs[1:-1] < places]] = True
    begin = np.flatnonzero(turn)
    stop = np.append(begin[1:], places)
    # grams that are the least of some run, and the stretch of each
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    anchors = np.flatnonzero(g == _sliding(padded, w, np.maximum, np.uint64(0)))
    lo = np.searchsorted(begin, np.maximum(anchors - w + 1, 0), side="right") - 1
    hi = np.searchsorted(begin, np.minimum(anchors, places - 1), side="right") - 1
    count = np.zeros(len(begin), dtype=np.int64)
    for j in range(int((hi - lo).max(initial=-1)) + 1):
        k = lo + j
        k = k[(k <= hi) & (least[begin[np.minimum(k, len(begin) - 1)]] == g[anchors])]
        count += np.bincount(k, minlength=len(begin))
    keep = whole[begin]
    begin, stop, count = begin[keep], stop[keep], count[keep]
    return least[begin], word_hash(data, begin, stop - 1 + span, lanes=LANES), begin, stop - begin, count > 1


def _stretch_rows(span: int, gram: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch, data, offs in slices(batches, "text", 1 << 19):
            key, c, begin, n, twice = stretches(data, offs, span, gram)
            of = np.searchsorted(offs, begin, side="right") - 1
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(key.view(np.int64)), pa.array(c.view(np.int64)), pa.array((begin - offs[of]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)], names=["doc_id", "row", "key", "c", "at", "n", "twice"])

    return kernel


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


class Rotations:
    """The rotations of some strings, end to end; places are counted over all of them."""

    def __init__(self, strings: list[np.ndarray]):
        self.size = np.array([len(s) for s in strings])
        self.base = np.cumsum(self.size) - self.size
        self.data = np.concatenate(strings)
        self.of = np.repeat(np.arange(len(strings)), self.size)
        self.inside = np.arange(len(self.data)) - self.base[self.of]

    def moved(self, at: np.ndarray, by: int) -> np.ndarray:
        """Places ``by`` further in their strings, round the end."""
        of = self.of[at]
        return self.base[of] + (self.inside[at] + by) % self.size[of]

    def symbols(self, step: int) -> np.ndarray:
        """The step (8 at most) bytes from each place on as one number; numbers are in the bytes' order."""
        all_ = np.arange(len(self.data))
        out = np.zeros(len(all_), dtype=np.uint64)
        for k in range(step):
            out = (out << np.uint64(8)) | self.data[self.moved(all_, k)]
        return out


def transform(rot: Rotations, symbol: np.ndarray, shard: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's places in the order of their rotations, and the symbol before each: its Burrows-Wheeler transform."""
    local = np.full(len(symbol), -1, dtype=np.int64)
    local[shard] = np.arange(len(shard))
    rank = _dense(symbol[shard])
    reach, most = step, 2 * int(rot.size[rot.of[shard]].max())
    while reach < most and rank.max() < len(rank) - 1:
        rank = _dense(rank * (len(rank) + 1) + rank[local[rot.moved(shard, reach)]])
        reach *= 2
    order = shard[np.argsort(rank, kind="stable")]
    return order, symbol[rot.moved(order, -step)]


def interleave(a: np.ndarray, b: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge two transforms: from which shard each place of the merged order comes, and its block of common prefixes."""
    n = len(a) + len(b)
    source = np.zeros(n, dtype=bool)
    source[len(a) :] = True
    block = np.zeros(n, dtype=np.int32)
    symbol = np.zeros(n, dtype=a.dtype)
    for _ in range(rounds):
        symbol[~source], symbol[source] = a, b
        dealt = np.argsort(symbol, kind="stable")
        source, block, sorted_ = source[dealt], block[dealt], symbol[dealt]
        border = np.ones(n, dtype=bool)
        border[1:] = (sorted_[1:] != sorted_[:-1]) | (block[1:] != block[:-1])
        block = (np.cumsum(border) - 1).astype(np.int32)
    return source, block


def repeated_places(strings: list[np.ndarray], weight: np.ndarray, span: int = SPAN, step: int = STEP) -> tuple[Rotations, np.ndarray]:
    """For each place of the strings, whether the ``span`` bytes from it on, inside its string, start at places of weight 2 or more in all."""
    while span % step:
        step -= 1
    rot = Rotations(strings)
    symbol = _dense(rot.symbols(step))
    symbol = symbol.astype(np.uint16 if len(symbol) <= 65536 else np.int64)
    half = np.searchsorted(rot.base, len(rot.data) // 2)
    places = np.arange(len(rot.data))
    first, second = places[rot.of < half], places[rot.of >= half]
    empty = places[:0], symbol[:0]
    (oa, ta), (ob, tb) = (transform(rot, symbol.astype(np.int64), s, step) if len(s) else empty for s in (first, second))
    source, block = interleave(ta.astype(symbol.dtype), tb.astype(symbol.dtype), span // step)
    order = np.empty(len(places), dtype=np.int64)
    order[~source], order[source] = oa, ob
    inside = rot.inside[order] + span <= rot.size[rot.of[order]]
    total = np.bincount(block[inside], weights=weight[rot.of[order[inside]]], minlength=int(block[-1]) + 1 if len(block) else 0)
    out = np.zeros(len(places), dtype=bool)
    out[order[inside]] = total[block[inside]] >= 2
    return rot, out


def _runs(flags: np.ndarray, base: np.ndarray, size: np.ndarray) -> list[list[dict]]:
    out = []
    for b, s in zip(base.tolist(), size.tolist(), strict=True):
        f = np.concatenate(([False], flags[b : b + s], [False])).astype(np.int8)
        d = np.diff(f)
        out.append([{"a": int(x), "b": int(y)} for x, y in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True)])
    return out


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _settle(span: int, batch_bytes: int):
    def flush(rows):
        strings = [np.frombuffer(r[3], dtype=np.uint8) for r in rows]
        rot, flags = repeated_places(strings, np.array([r[2] for r in rows], dtype=np.float64), span)
        runs = _runs(flags, rot.base, rot.size)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, _RUNS)], names=["key", "c", "runs"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group, size, group_size = [], [], 0, 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if group and r[0] != group[0][0]:
                    if rows and size + group_size > batch_bytes:
                        yield flush(rows)
                        rows, size = [], 0
                    rows, size, group, group_size = rows + group, size + group_size, [], 0
                group.append(r)
                group_size += len(r[3])
        if rows and size + group_size > batch_bytes:
            yield flush(rows)
            rows = []
        if rows or group:
            yield flush(rows + group)

    return kernel


def _cut(span: int):
    """docs with lists of stretches -> the bytes of each."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(0)[i].as_py() or "").encode()
                wanted = batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([x["key"] for x in wanted], pa.int64()), pa.array([x["c"] for x in wanted], pa.int64()), pa.array([x["w"] for x in wanted], pa.int64()), pa.array([text[x["at"] : x["at"] + x["n"] - 1 + span] for x in wanted], pa.binary()), pa.array([x["hot"] for x in wanted], pa.bool_())], names=["key", "c", "w", "bytes", "hot"])

    return kernel


def _strings(span: int):
    """Stretches of hot buckets -> one row a place, with the hash of its string."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for key, c, w, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = np.frombuffer(raw, dtype=np.uint8)
                at = np.arange(len(data) - span + 1)
                h = word_hash(data, at, at + span, lanes=max(span, LANES))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, c)), pa.array(np.full(n, w)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["key", "c", "w", "i", "h"])

    return kernel


def _keep(texts: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                size, removed, number, sha, kept = [], [], [], [], []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    out, at, gone, runs = [], 0, 0, 0
                    last = -1
                    for s in sorted(spans or [], key=lambda s: s["a"]):
                        if s["a"] > last:
                            runs += 1
                            out.append(raw[max(at, 0) : s["a"]])
                            gone += s["b"] - s["a"]
                        elif s["b"] > last:
                            gone += s["b"] - last
                        last = at = max(last, s["b"])
                    out.append(raw[at:])
                    rest = b"".join(out)
                    size.append(len(raw))
                    removed.append(gone)
                    number.append(runs)
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                more = [pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())] if texts else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(sha, pa.string()), *more], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])

    return kernel


def _most(counted: DataFrame, n: str) -> list[int]:
    """The keys that hold more than 1/PARTS of all that's counted: fewer than PARTS."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    return [r["key"] for r in counted.where(F.col(n) > max(total // PARTS, PARTS)).select("key").collect()]


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, batch_bytes: int = BATCH, hot: int = HOT) -> DataFrame:
    """docs (doc_id, row, text) -> doc_id, row, spans array<struct<a, b>>: bytes of strings of ``span`` bytes that start elsewhere too; documents without are left out.

    ``row`` tells apart rows of one doc_id with different texts; equal rows are copies of each other.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stash(docs.select("doc_id", "row", "text").mapInArrow(_stretch_rows(span, gram), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, key long, c long, at int, n int, twice boolean"))
    shared = stash(found.groupBy("key").agg(F.count("*").alias("all"), F.max("twice").alias("twice")).where("all > 1 or twice").select("key", "all"))
    first, found = found, stash(skewed_join(found, shared.select("key"), "key", _most(shared, "all"), "left_semi"))
    discard(first, shared)
    one = F.min(F.struct("doc_id", "row", "at", "n")).alias("first")
    kinds = stash(found.groupBy("key", "c").agg(F.count("*").alias("w"), F.max("twice").alias("twice"), one))
    sums = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("w").alias("least"), F.max(F.col("twice") & (F.col("w") == 1)).alias("inner"))
    open_ = stash(sums.where("(kinds > 1 and least = 1) or inner").select("key", (F.col("kinds") > hot).alias("hot"), "kinds"))
    first, kinds = kinds, stash(skewed_join(kinds, open_.select("key", "hot"), "key", _most(open_, "kinds"), "left"))
    discard(first, open_)
    whole = kinds.where("w > 1").select("key", "c", F.array(F.struct(F.lit(0).alias("a"), F.col("first.n").alias("b"))).alias("runs"))
    wanted = kinds.where("hot is not null").groupBy(F.col("first.doc_id").alias("d"), F.col("first.row").alias("r")).agg(F.collect_list(F.struct("key", "c", "w", F.col("first.at").alias("at"), F.col("first.n").alias("n"), "hot")).alias("wanted"))
    cut = stash(docs.select("doc_id", "row", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).select("text", "wanted").mapInArrow(_cut(span), "key long, c long, w long, bytes binary, hot boolean").dropDuplicates(["key", "c"]), "zstd")
    cool = cut.where("not hot").select("key", "c", "w", "bytes").repartition(tasks, "key").sortWithinPartitions("key", "c").mapInArrow(_settle(span, batch_bytes), "key long, c long, runs array<struct<a:int,b:int>>")
    places = cut.where("hot").select("key", "c", "w", "bytes").mapInArrow(_strings(span), "key long, c long, w long, i int, h long")
    again = places.groupBy("key", "h").agg(F.sum("w").alias("all")).where("all > 1").select("key", "h")
    single = F.transform(F.collect_set("i"), lambda i: F.struct(i.alias("a"), (i + 1).alias("b")))
    warm = places.where("w = 1").join(again, ["key", "h"], "left_semi").groupBy("key", "c").agg(single.alias("runs"))
    settled = whole.union(cool.join(kinds.where("w = 1").select("key", "c"), ["key", "c"], "left_semi").where(F.size("runs") > 0)).union(warm)
    # copies of a row are one from here on, as their weights are counted, so a row's list has no more than its text's stretches
    hit = found.select("key", "c", "doc_id", "row", "at").distinct().join(settled.groupBy("key", "c").agg(F.first("runs").alias("runs")), ["key", "c"])
    spans = hit.select("doc_id", "row", F.transform("runs", lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["b"] - 1 + span).alias("b"))).alias("s"))
    out = stash(spans.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("s")).alias("spans")))
    discard(found, kinds, cut)
    return out


def remove_repeats(docs: DataFrame, span: int = SPAN, texts: bool = True, gram: int = GRAM, batch_bytes: int = BATCH, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` what's kept; one row per input row.

    Removes each byte covered by a string of ``span`` bytes that also starts anywhere else, judged on the input. A null text
    is empty; texts shorter than ``span`` keep all. Equal rows are copies of each other. Other columns are ignored. Where a
    removal cuts a character, ``kept`` has U+FFFD for what's left of it; the digest is of the bytes.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    spans = repeats(keyed, span, gram, batch_bytes, hot).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "spans")
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_keep(texts), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts)
