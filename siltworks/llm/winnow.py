"""Benchmark decontamination by winnowing.

A text's fingerprints are the least of the GRAM-word hashes in every run of WINDOW words; equal runs have
equal fingerprints, so every shared span of WINDOW words is guaranteed to be met. The fingerprints of the
training texts are joined with those of the benchmark; around each hit the run is extended to its whole
window, which must be one of the benchmark's by two hashes of different seeds, 128 bits. Benchmark items shorter
than a window are one window each and are met by the hash of their full length.

The benchmark is held in blocks of at most ``block_bytes`` of text, as sorted arrays of some 24 bytes a word, each
shipped to the executors on its own; a larger benchmark makes further passes over the training texts, never a
larger broadcast. The training texts aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_table, chain, flat, mix, slices, word_hash, words

WINDOW, GRAM, BLOCK_BYTES = 10, 5, 8 << 20
_OTHER = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def _windows(w: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n word hashes from each start on."""
    out = np.full(len(starts), n, dtype=np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[starts + j])
    return out


def _least(grams: np.ndarray, n: int) -> np.ndarray:
    out = grams[: max(0, len(grams) - n + 1)].copy()
    for j in range(1, n):
        np.minimum(out, grams[j : j + len(out)], out=out)
    return out


class Index:
    """What a block of benchmark items looks like: window hashes by length, the fingerprints, and each window's items."""

    def __init__(self, names: pa.Array, texts: pa.Array, window: int, gram: int):
        with np.errstate(over="ignore"):
            self.names = sorted(set(names.to_pylist()), key=lambda s: s.encode())
            number = {name: i for i, name in enumerate(self.names)}
            item = np.array([number[n] for n in names.to_pylist()], dtype=np.int64)
            data, offs = flat(texts)
            low = LOWER[data]
            starts, ends, row = words(low, offs, _OTHER)
            w, w2 = word_hash(low, starts, ends), word_hash(low, starts, ends, 1)
            count = np.diff(row)
            of, end = np.repeat(np.arange(len(count)), count), np.repeat(row[1:], count)
            least = _least(chain(w, gram), window - gram + 1)
            at = np.arange(len(least))
            self.prints = self._keyed(np.unique(least[at + window <= end[at]]))
            self.by_length = {}
            for n in sorted({min(window, c) for c in count.tolist() if c}):
                at = np.flatnonzero(np.arange(len(w)) + n <= end) if n == window else row[:-1][count == n]
                key, check = _windows(w, at, n), _windows(w2, at, n)
                order = np.lexsort((item[of[at]], check, key))
                key, check, name = key[order], check[order], item[of[at]][order]
                turn = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
                fresh = turn | np.append(True, name[1:] != name[:-1])
                begin = np.append(np.flatnonzero(turn[fresh]), fresh.sum())
                keys, most = np.unique(key[turn], return_counts=True)
                self.by_length[n] = (self._keyed(key[turn])[0], self._keyed(keys)[1], check[turn], int(most.max()), begin, name[fresh])

    @staticmethod
    def _keyed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        return keys, seen


def _member(x: np.ndarray, keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first place of x in keys, or -1."""
    out = np.full(len(x), -1, dtype=np.int64)
    may = np.flatnonzero(seen[(x & np.uint64(0xFFFF)).astype(np.int64)])
    if len(keys) and len(may):
        at = np.minimum(np.searchsorted(keys, x[may]), len(keys) - 1)
        out[may] = np.where(keys[at] == x[may], at, -1)
    return out


def _hits(index: Index, window: int, gram: int, low: np.ndarray, begin: np.ndarray, stop: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, places of the windows) of all benchmark windows in the words of a slice."""
    w = word_hash(low, begin, stop)
    end = np.repeat(row[1:], np.diff(row))
    for n, (keys, seen, check, most, _, _) in sorted(index.by_length.items()):
        if n == window:
            least = _least(chain(w, gram), window - gram + 1)
            m = len(least)
            if not m:
                continue
            turn = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
            runs = _member(least[turn], *index.prints) >= 0
            starts = np.flatnonzero(np.repeat(runs, np.diff(np.append(turn, m))))
        else:
            starts = np.arange(max(0, len(w) - n + 1))
        starts = starts[starts + n <= end[starts]] if len(starts) else starts
        key = _windows(w, starts, n)
        place = _member(key, keys, seen)
        starts, key, place = starts[place >= 0], key[place >= 0], place[place >= 0]
        need = np.unique(starts[:, None] + np.arange(n)) if len(starts) else starts
        other = np.zeros(len(w), dtype=np.uint64)
        other[need] = word_hash(low, begin[need], stop[need], 1)
        sought = _windows(other, starts, n)
        found = np.full(len(starts), -1, dtype=np.int64)
        for k in range(most):  # windows of one key and different checks follow each other
            at = np.minimum(place + k, len(keys) - 1)
            found = np.where((keys[at] == key) & (check[at] == sought), at, found)
        yield n, starts[found >= 0], found[found >= 0]


def _kernel(index, window: int, gram: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        ix = index.value
        for batch, data, offs in slices(batches):
            low = LOWER[data]
            first_byte, last_byte, row = words(low, offs, _OTHER)
            cover = np.zeros(len(first_byte) + 1, dtype=np.int32)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for n, starts, place in _hits(ix, window, gram, low, first_byte, last_byte, row):
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + n, -1)
                at, names = ix.by_length[n][4:]
                of = np.searchsorted(row, starts, side="right") - 1
                size = max(1, len(ix.by_length[n][0]))
                of, place = np.divmod(np.unique(of * np.int64(size) + place), size)
                count = at[place + 1] - at[place]
                flat = np.repeat(at[place] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)
                found.append((np.repeat(of, count), names[flat]))
            hit = np.concatenate((np.cumsum(cover[:-1]) > 0, [False]))
            was = np.concatenate(([False], hit[:-1]))
            first = np.zeros(len(hit), dtype=bool)
            first[row[:-1]] = True
            begin = np.flatnonzero(hit & (~was | first))
            after = np.concatenate((hit[1:], [False]))
            last = np.concatenate((first[1:], [True]))
            stop = np.flatnonzero(hit & (~after | last)) + 1
            offs_of = np.searchsorted(begin, row)
            base = np.repeat(row[:-1], np.diff(offs_of))
            lists = lambda v: pa.ListArray.from_arrays(pa.array(offs_of.astype(np.int32)), pa.array(v))
            key = np.unique(np.concatenate([a * np.int64(len(ix.names)) + b for a, b in found])) if found else np.zeros(0, np.int64)
            of, name = np.divmod(key, max(1, len(ix.names)))
            items = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(ix.names, pa.string()).take(pa.array(name)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(row)), lists(begin - base), lists(stop - base), items], names=["doc_id", "row_key", "n_words", "begin", "stop", "items"])

    return kernel


def _clean(index, window: int, gram: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch, data, offs in slices(batches):
            low = LOWER[data]
            begin, stop, row = words(low, offs, _OTHER)
            hit = np.zeros(batch.num_rows, dtype=bool)
            for _, starts, _ in _hits(index.value, window, gram, low, begin, stop, row):
                hit[np.searchsorted(row, starts, side="right") - 1] = True
            yield batch.filter(pa.array(~hit))

    return kernel


def _indexes(benchmark: DataFrame, window: int, gram: int, block_bytes: int) -> Iterator:
    """The benchmark's blocks, each shipped to the executors; at most block_bytes of text each, about."""
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("name"), "text").distinct()
    total = int(bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    blocks = -(-total * 2 // block_bytes) if total > block_bytes else 1
    for b in range(blocks):
        held = (bench.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b) if blocks > 1 else bench).toArrow().combine_chunks()
        yield bench.sparkSession.sparkContext.broadcast(Index(held["name"], held["text"], window, gram))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs (text, ...), with all their columns, in which no window of ``benchmark`` occurs; a narrow pass for each block."""
    for index in _indexes(benchmark, window, gram, block_bytes):
        docs = docs.mapInArrow(_clean(index, window, gram), docs.schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> doc_id, n_words, spans array<struct<begin, stop>>, items array<string>.

    One row per input row. ``spans``: maximal runs of hit words, by number from 0, stop exclusive; ``items``: the item_ids, as
    sorted strings, of which a window occurs. Null and empty texts have no words; benchmark rows with a null item_id or
    without words are left out; rows that repeat an item_id are one item. With an empty benchmark nothing is hit.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    schema = "doc_id long, row_key long, n_words long, begin array<long>, stop array<long>, items array<string>"
    schema = schema.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    out, blocks = None, 0
    for index in _indexes(benchmark, window, gram, block_bytes):
        one = rows.mapInArrow(_kernel(index, window, gram), schema).withColumn("spans", F.arrays_zip("begin", "stop")).drop("begin", "stop")
        out, blocks = one if out is None else out.union(one), blocks + 1
    if blocks > 1:
        # repeated rows of a document have equal spans, so their number is kept apart
        grown = out.withColumn("copies", F.lit(1)).groupBy("doc_id", "row_key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.sum("copies") / blocks).cast("int").alias("copies"))
        zero = F.expr("cast(array() as array<struct<begin:bigint,stop:bigint>>)")
        joined = F.aggregate("all", zero, lambda acc, x: F.when((F.size(acc) > 0) & (x["begin"] <= F.element_at(acc, -1)["stop"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x))))
        out = grown.withColumn("spans", F.when(F.size("all") > 0, joined).otherwise(zero)).select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return out.select("doc_id", "n_words", "spans", "items")
