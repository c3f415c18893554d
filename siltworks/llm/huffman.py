"""Token-id files: canonical length-limited Huffman codes in independent blocks.

A store is a folder of three Parquet tables that Spark writes and reads: ``blocks`` (bit streams of whole
documents, with the bit offset of every STEP-th id as a checkpoint), ``codebook`` (an id and its code
length; canonical codes follow from the lengths) and ``shards`` (ids in each shard, in order). Code lengths
come from the counts of all ids of all shards. Decoding is by one table of 2**MAX_BITS entries: all
checkpoints of a block are decoded side by side, one table lookup an id.

Documents are range-partitioned by doc_id, so shards and blocks are in ascending order and only the sums
of shards are gathered to number the ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, delete, flat, shared_dir, slices, word_hash

MAX_BITS, STEP, BLOCK_IDS, TABLE, SLOT_BITS = 18, 128, 1 << 18, 900_000, 21
END = 1
BLOCKS = "shard int, at long, n_ids long, docs array<long>, sizes array<long>, marks array<long>, bits binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with none over ``limit`` (or what so many symbols need, if more), by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    merged, is_leaf = weight, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, pairs))
        place = np.argsort(both, kind="stable")
        merged = both[place]
        is_leaf.append(place < n)
    take = 2 * n - 2
    lengths = np.zeros(n, dtype=np.int64)
    for leaf in reversed(is_leaf):  # the first ``take`` of each level: so many leaves, and twice as many of the level below as packages
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: by length, then by symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code = last = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[s])
        if n:
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The symbol and the code length for every run of ``bits`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.left_shift(1, bits - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << bits, dtype=np.uint32), np.ones(1 << bits, dtype=np.uint8)
    total = int(span.sum())
    symbols[:total], sizes[:total] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbols, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream, most significant bit first, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    marks = (ends - size)[::STEP]
    if not len(ids):
        return b"", marks
    # two neighbours as one piece of at most 36 bits, so that one starts in every word of 64
    value = codes[ids].astype(np.uint64)
    if len(ids) % 2:
        value, size, ends = np.append(value, np.uint64(0)), np.append(size, 0), np.append(ends, ends[-1])
    value = (value[::2] << size[1::2].astype(np.uint64)) | value[1::2]
    size, stop = size[::2] + size[1::2], ends[1::2]
    start = stop - size
    word, over = start >> 6, (start & 63) + size - 64  # ``over``: bits that belong to the next word
    inside = np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64))
    out = np.zeros(int(stop[-1] >> 6) + 2, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[first]] = np.bitwise_or.reduceat(inside, first)
    spill = np.flatnonzero(over > 0)
    out[word[spill] + 1] |= value[spill] << (64 - over[spill]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: -(-int(stop[-1]) // 8)], marks


def unpack(stream: bytes, marks: np.ndarray, n: int, symbols: np.ndarray, sizes: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """The n ids of a bit stream: every checkpoint's run is a lane, and all lanes advance together."""
    data = np.frombuffer(stream + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    wide = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    out = np.zeros((len(marks), STEP), dtype=np.uint32)
    at, last, down, mask = marks.astype(np.int64), len(wide) - 1, np.uint32(32 - bits), np.uint32((1 << bits) - 1)
    for k in range(min(STEP, n)):
        word = (wide[np.minimum(at >> 3, last)] >> (down - (at & 7).astype(np.uint32))) & mask
        out[:, k] = symbols[word]
        at = at + sizes[word]
    return out.ravel()[:n]


#: Kinds of bytes in lowered Latin-1 texts in UTF-8, by the vocabulary's pattern: white space, letter, number, other.
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_ASCII = np.full(256, OTHER, dtype=np.uint8)
_ASCII[[9, 10, 11, 12, 13, 32]] = SPACE
_ASCII[ord("a") : ord("z") + 1] = LETTER
_ASCII[ord("0") : ord("9") + 1] = NUMBER
_C2 = np.full(256, OTHER, dtype=np.uint8)  # after the byte C2
_C2[[0x85, 0xA0]], _C2[[0xAA, 0xB5, 0xBA]], _C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = SPACE, LETTER, NUMBER
_C3 = np.full(256, LETTER, dtype=np.uint8)  # after the byte C3
_C3[[0x97, 0xB7]] = OTHER
#: The kind of every byte as it's written, and its lowered form, for bytes.translate, which is faster than an array's lookup.
_KINDS, _LOWERED = _ASCII[LOWER].tobytes(), LOWER.tobytes()


#: How byte-level vocabularies write bytes: printable ones as themselves, the others in order from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: The same for all bytes, as UTF-32.
_CHARS = np.array([BYTE_CHARS.get(b, b) for b in range(256)], dtype="<u4")


class Words:
    """The library's ids of texts, with repeated words encoded once.

    The vocabulary's rules lower a text and split it into words that are encoded apart. Texts of Latin-1 characters are
    split here by the same rules, on their bytes; others, and those with a special token, go to the library whole. The ids of
    every distinct word come from the library and are kept in a table of bounded size, by 128 bits: a word of up to seven
    bytes is told by the first 64 for certain, a longer one has two hashes of different seeds.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.model = self.lib.model
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size() <= 65536 else "<u4")
        self.clear()

    def clear(self, room: int = 0) -> None:
        """An empty table, with room for the words of a long text."""
        self.n, self.room = 0, max(TABLE, room)
        self.bits = max(SLOT_BITS, (2 * self.room).bit_length())
        self.ids = np.zeros(1 << 16, dtype=self.kind)
        self.at = np.zeros(self.room + 1, dtype=np.int64)
        self.keys = np.zeros((2, self.room + 1), dtype=np.uint64)  # by number, so that frequent words, which come early, stand together
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)  # -1: free

    def other(self, number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where the words of these numbers have other hashes; of no word (-1) either may come out."""
        return np.flatnonzero((self.keys[0].take(number, mode="wrap") != hashes[0]) | (self.keys[1].take(number, mode="wrap") != hashes[1]))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each pair of hashes (two rows) in the table, -1 if it isn't there; all probe side by side, by steps of one slot."""
        mask = (1 << self.bits) - 1
        pos = (hashes[0] >> np.uint64(64 - self.bits)).view(np.int64)
        out = self.slot.take(pos)
        open_ = self.other(out, hashes)
        pos = pos[open_]
        while len(open_):
            go = out[open_] >= 0  # another word has the slot; a free one ends the search
            open_, pos = open_[go], (pos[go] + 1) & mask
            out[open_] = self.slot[pos]
            left = self.other(out[open_], hashes[:, open_])
            open_, pos = open_[left], pos[left]
        return out

    def place(self, hashes: np.ndarray) -> None:
        """Put distinct new pairs in, numbered from n on."""
        mask = (1 << self.bits) - 1
        self.keys[:, self.n : self.n + hashes.shape[1]] = hashes
        open_, pos = np.arange(hashes.shape[1]), (hashes[0] >> np.uint64(64 - self.bits)).view(np.int64)
        while len(open_):
            _, first = np.unique(pos, return_index=True)  # of those that meet in a slot the first takes it
            take = first[self.slot[pos[first]] < 0]
            self.slot[pos[take]] = self.n + open_[take]
            left = np.ones(len(open_), dtype=bool)
            left[take] = False
            open_, pos = open_[left], (pos[left] + 1) & mask

    def add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """The library's model on new words, in the characters that stand for their bytes."""
        chars = _CHARS[np.frombuffer(b"".join(words), dtype=np.uint8)].tobytes().decode("utf-32-le")
        parts = [self.model.tokenize(chars[a:b]) for a, b in pairwise(accumulate(map(len, words), initial=0))]
        ends = self.at[self.n] + np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(int(ends[-1]), dtype=self.kind)))
        self.ids[self.at[self.n] : ends[-1]] = np.fromiter(map(attrgetter("id"), chain.from_iterable(parts)), dtype=self.kind, count=int(ends[-1] - self.at[self.n]))
        self.at[self.n + 1 : self.n + 1 + len(parts)] = ends
        self.place(hashes)
        self.n += len(parts)

    def plain(self, data: np.ndarray, offs: np.ndarray, raw: bytes) -> np.ndarray:
        """Which rows are of Latin-1 characters, without a special token."""
        out = np.ones(len(offs) - 1, dtype=bool)
        out[np.searchsorted(offs, np.flatnonzero(data > 0xC3), side="right") - 1] = False
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                out[np.searchsorted(offs, at, side="right") - 1] = False
                at = raw.find(s, at + 1)
        return out

    def split(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lowered bytes of plain texts, and starts and ends of the words in them."""
        n = len(data)
        raw = data.tobytes()
        low = np.frombuffer(bytearray(raw.translate(_LOWERED)), dtype=np.uint8)
        kind = np.frombuffer(bytearray(raw.translate(_KINDS)), dtype=np.uint8)
        lead = np.flatnonzero(data >= 0xC2)
        lead = lead[lead + 1 < n]
        after, second, c3 = lead + 1, data[lead + 1], data[lead] == 0xC3
        low[after] += np.uint8(32) * (c3 & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        kind[after] = both = np.where(c3, _C3[second], _C2[second])
        kind[lead] = both
        border = np.ones(n + 1, dtype=bool)
        border[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        border[after] = False  # a character isn't cut
        border[offs] = True
        # a lone apostrophe before s, t, m, d, re, ve or ll is one word with it
        mark = np.flatnonzero(low == 39)
        mark = mark[(mark + 1 < n) & border[mark] & border[np.minimum(mark + 1, n)]]
        if len(mark):
            row_end = offs[np.searchsorted(offs, mark, side="right")]
            pad = np.concatenate((low, np.zeros(2, np.uint8)))
            one, two = pad[mark + 1], pad[mark + 2]
            size = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where(((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)), 2, 0))
            good = (size > 0) & (mark + 1 + size <= row_end)
            mark, size = mark[good], size[good]
            border[mark + 1] = False
            border[mark + 1 + size] = True
        cuts = np.flatnonzero(border)
        starts, ends = cuts[:-1], cuts[1:]
        word = kind[starts] != SPACE
        return low, starts[word], ends[word]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, end to end with an end id after each, and their number in each."""
        low, starts, ends = self.split(data, offs) if len(data) else (data, offs[:0], offs[:0])
        hashes = np.zeros((2, len(starts)), dtype=np.uint64)
        hashes[0] = word_hash(low, starts, ends)
        long = np.flatnonzero(ends - starts > 7)
        hashes[1, long] = word_hash(low, starts[long], ends[long], 1)
        place = self.find(hashes)
        lost = np.flatnonzero(place < 0)
        if len(lost):
            first = _distinct(hashes, lost)
            if self.n + len(first) > self.room:
                lost = np.arange(len(starts))
                first = _distinct(hashes, lost)
                self.clear(len(first))
            raw, a, b = low.tobytes(), starts[first].tolist(), ends[first].tolist()
            self.add(hashes[:, first], [raw[x:y] for x, y in zip(a, b, strict=True)])
            place[lost] = self.find(hashes[:, lost])
        size, at = self.at[place + 1] - self.at[place], self.at[place]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(at - total + size, size) + np.arange(total[-1] if len(total) else 0)]
        upto = np.append(0, total)[np.searchsorted(starts, offs)]
        return np.insert(ids, upto[1:], END), np.diff(upto) + 1


def _distinct(hashes: np.ndarray, among: np.ndarray) -> np.ndarray:
    """One place, of those given, of each pair."""
    order = among[np.lexsort((hashes[1, among], hashes[0, among]))]
    turn = np.ones(len(order), dtype=bool)
    turn[1:] = (hashes[:, order[1:]] != hashes[:, order[:-1]]).any(axis=0)
    return order[turn]


_WORDS: dict[str, Words] = {}


def _encode(path: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        np.seterr(over="ignore")
        if path not in _WORDS:
            _WORDS[path] = Words(path)
        lib = _WORDS[path]
        before = 0
        for batch, data, offs in slices(batches):
            raw = data.tobytes()
            plain = lib.plain(data, offs, raw)
            if plain.all():
                ids, size = lib.encode(data, offs)
            else:
                ids, size = lib.encode(data[np.repeat(plain, np.diff(offs))], np.append(0, np.cumsum(np.diff(offs)[plain])))
            if not plain.all():
                parts, out = iter(np.split(ids, np.cumsum(size)[:-1]) if len(size) else []), []
                for a, b, p in zip(offs[:-1].tolist(), offs[1:].tolist(), plain.tolist(), strict=True):
                    out.append(next(parts) if p else np.array([*lib.lib.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, END], dtype=lib.kind))
                ids, size = np.concatenate(out), np.array([len(x) for x in out])
            ends = np.cumsum(size)
            width = lib.kind.itemsize
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.append(0, ends * width).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before + ends - size), pa.array(size), pa.array(np.full(batch.num_rows, width, dtype=np.int32)), column], names=["doc_id", "at", "n", "width", "ids"])
            before += int(ends[-1])

    return kernel


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for width, i in ((w, i) for w in (2, 4) for i in range(0, batch.num_rows, 500)):
            part = batch.slice(i, 500)
            part = part.filter(pc.equal(part.column(0), width))
            if part.num_rows:
                got = np.bincount(np.frombuffer(flat(part.column(1))[0].tobytes(), dtype=f"<u{width}"))
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "count"])


def _blocks(lengths):
    schema = pa.schema([("shard", pa.int32()), ("at", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("bits", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = lengths.value
        codes = canonical(size)
        shard, start, docs, parts, n = None, 0, [], [], 0

        def block():
            ids = np.concatenate(parts)
            bits, marks = pack(ids, codes, size)
            return pa.RecordBatch.from_pylist([{"shard": shard, "at": start, "n_ids": len(ids), "docs": docs, "sizes": [len(x) for x in parts], "marks": marks.tolist(), "bits": bits}], schema=schema)

        for batch in batches:
            for sh, at, doc, width, ids in zip(*(batch.column(i) for i in range(5)), strict=True):
                at = at.as_py()
                if docs and (n >= BLOCK_IDS or sh.as_py() != shard or at != start + n):
                    yield block()
                    docs, parts, n = [], [], 0
                if not docs:
                    shard, start = sh.as_py(), at
                docs.append(doc.as_py())
                parts.append(np.frombuffer(ids.as_py(), dtype=f"<u{width.as_py()}").astype(np.int64))
                n += len(parts[-1])
        if docs:
            yield block()

    return kernel


def _read(lengths):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = max(MAX_BITS, int(lengths.value.max()))
        symbols, sizes = decode_table(lengths.value, bits)
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["bits"], np.array(r["marks"], dtype=np.int64), r["n_ids"], symbols, sizes, bits).astype("<u4")
                ends = np.cumsum(r["sizes"])
                raw = [ids[e - s : e].tobytes() for s, e in zip(r["sizes"], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["docs"], pa.int64()), pa.array((ends - r["sizes"]) + r["start"], pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return kernel


def write_ids(docs: DataFrame, tokenizer: str, to: str) -> None:
    """Encode docs (doc_id long, text, ...) and write the store ``to``, a folder that every machine can reach.

    Every row is written: a null or empty text is the end id alone; rows that repeat a doc_id follow each other, a null
    doc_id comes first. Codes have MAX_BITS bits at most, or as many as the number of different ids needs (up to 25). An empty table gives a store without blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one doc_id may have a share of the rows: the number splits it
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("number"), "text")
    dealt = numbered.repartitionByRange(shards, "doc_id", "number").sortWithinPartitions("doc_id", "number").select("doc_id", "text")
    between = shared_dir(spark)
    dealt.mapInArrow(_encode(tokenizer), "doc_id long, at long, n long, width int, ids binary").withColumn("shard", F.spark_partition_id()).write.option("compression", "zstd").parquet(between)
    ids = spark.read.schema("doc_id long, at long, n long, width int, ids binary, shard int").parquet(between)
    counts = ids.select("width", "ids").mapInArrow(_counts, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    got = counts.collect()  # at most one row for each id of the vocabulary
    total = np.zeros(1 + max((r["id"] for r in got), default=0), dtype=np.int64)
    for r in got:
        total[r["id"]] = r["count"]
    lengths = code_lengths(total)
    spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(lengths) if n], "id long, length int").coalesce(1).write.parquet(f"{to}/codebook")
    # one row a shard
    by_shard = ids.groupBy("shard").agg(F.sum("n").alias("n_ids"))
    by_shard.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).coalesce(1).write.parquet(f"{to}/shards")
    shared = spark.sparkContext.broadcast(lengths)
    ids.select("shard", "at", "doc_id", "width", "ids").mapInArrow(_blocks(shared), BLOCKS).write.option("compression", "none").parquet(f"{to}/blocks")
    delete(spark, between)


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """The store's documents: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian 32-bit).

    Reads the blocks in one narrow pass: each shard's first number comes from a broadcast table of one row a shard.
    """
    lengths = np.zeros(1, dtype=np.uint8)
    for r in spark.read.schema("id long, length int").parquet(f"{store}/codebook").collect():
        lengths = np.pad(lengths, (0, max(0, r["id"] + 1 - len(lengths))))
        lengths[r["id"]] = r["length"]
    shards = spark.read.schema("shard int, n_ids long, start long").parquet(f"{store}/shards").select("shard", F.col("start").alias("first"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{store}/blocks").join(F.broadcast(shards), "shard")
    return blocks.withColumn("start", F.col("first") + F.col("at")).mapInArrow(_read(spark.sparkContext.broadcast(lengths)), "doc_id long, start long, n_tokens long, ids binary")
