"""Helpers that the corpus operators share.

Text kernels work on the flat UTF-8 buffer of an Arrow string column with numpy, so a batch of
documents costs a few array passes; a slice of at most ``CHUNK_BYTES`` is worked on at a time, which
bounds a task's memory however many or long the documents are (a single longer document makes a
slice of its own).
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Multiplier of the rolling hash (odd, so that it has an inverse modulo 2**64) and that inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_HELD: dict = {}


def held(key, build: Callable):
    """What ``build`` gives, kept in this process until another key is asked for: a worker is used again by one operator after the other, and holds the tables of the last one only."""
    if key not in _HELD:
        _HELD.clear()  # before building, so that both aren't there together
        _HELD[key] = build()
    return _HELD[key]


#: Bytes of rows that go to a worker at once, and Spark's setting for them. With its own 64 MB a task's whole split is one batch, held twice by the JVM outside its heap and again by the worker.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches are of about BATCH_BYTES (or one row, if that's larger), unless it has a size of its own. Results don't depend on it."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that's unset, a local session takes one of its own; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="siltworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/siltworks-{uuid.uuid4().hex}"


def stash(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    df.write.option("compression", codec).parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.stashed_at = where
    return out


def discard(*stashes: DataFrame) -> None:
    """Delete stashes that no later plan reads."""
    for df in stashes:
        delete(df.sparkSession, df.stashed_at)


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(df: DataFrame, *columns: str, parts: int = 500, rows: int | None = None) -> list:
    """The values that stand in more than 1/parts of all rows, counted over the columns together; at most parts a column. ``rows``: how many there are, where it's known."""
    each = df.select(F.explode(F.array(*columns)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    least = (df.agg(F.count("*")).first()[0] if rows is None else rows) // parts
    return [r["k"] for r in each.where(F.col("n") > max(least, parts)).collect() if r["k"] is not None]


def skewed_join(many: DataFrame, few: DataFrame, key: str, hot: list, how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """``many`` joined with ``few`` (one narrow row a key) on ``key``, and the columns ``also``: the hot keys, of which there is a bounded number, by a broadcast."""
    on = [*also, key]
    if not hot:
        return many.join(few, on, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return many.where(~is_hot).join(few.where(~is_hot), on, how).unionByName(many.where(is_hot).join(F.broadcast(few.where(is_hot)), on, how))


class Bitmap:
    """A Bloom filter of fixed size over a column of longs: one hash, 2**BITS bits, whatever the number of values.

    It only saves work: what it takes is joined exactly afterwards, and when it fills up it takes everything.
    """

    BITS = 25

    def __init__(self, keys: DataFrame):
        at = keys.select(self.place(F.col(keys.columns[0])).alias("at")).select(F.expr("at div 32").alias("word"), F.expr("shiftleft(1, cast(at % 32 as int))").alias("bit"))
        words = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**BITS / 32 rows
        held = np.zeros(1 << self.BITS - 5, dtype=np.int32)
        held[words["word"].to_numpy()] = words["bits"].to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(held)

    @classmethod
    def place(cls, key):
        return F.shiftrightunsigned(F.xxhash64(key), 64 - cls.BITS)

    def takes(self, places: np.ndarray) -> np.ndarray:
        return (self.shared.value[places >> 5] >> (places & 31).astype(np.int32)) & 1 == 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POW[:] = [_powers(BASE, size), _powers(BASE_INV, size)]
    return _POW[0][:n], _POW[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with (h[j] - h[i]) * BASE**-i the rolling hash of data[i:j]."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    if len(data):
        np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(h))[1]
    return mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))


#: Bytes of the longest word that's hashed by eight bytes at a time.
LANES = 64


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, lanes: int = LANES) -> np.ndarray:
    """A 64-bit hash of each data[start:end].

    Words of up to seven bytes differ in their hashes for certain: bytes and length are one number, and the mixing is one to
    one. Longer ones are mixed eight bytes at a time, those of more than ``lanes`` bytes are digested by BLAKE2b.
    """
    size = (end - start).astype(np.uint64)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    salt = np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    left = np.minimum(size, np.uint64(8)) * np.uint64(8)
    first = eight[start]
    first = np.where(left < 64, first & ((np.uint64(1) << np.minimum(left, np.uint64(63))) - np.uint64(1)), first)
    out = mix((first ^ (np.minimum(size, np.uint64(8)) << np.uint64(56))) ^ salt)
    more = np.flatnonzero(size > 7)
    out[more] = mix(out[more] ^ mix(first[more] + size[more] * np.uint64(0xA0761D6478BD642F) + salt))
    more, at = more[size[more] > 8], 8
    whole = more[size[more] > lanes]
    more = more[size[more] <= lanes]
    while len(more):
        rest = size[more] - np.uint64(at)
        bits = np.minimum(rest, np.uint64(8)) * np.uint64(8)
        piece = eight[start[more] + at]
        piece = np.where(bits < 64, piece & ((np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1)), piece)
        out[more] = mix(out[more] * np.uint64(0xE7037ED1A0B428DB) + mix(piece ^ salt))
        at += 8
        more = more[size[more] > at]
    for i in whole.tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def chain(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes, in order."""
    out = np.full(max(0, len(w) - n + 1), n, dtype=np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(out)])
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len+1 offsets in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in runs of rows with at most ``limit`` bytes of text (one row at least), with bytes and offsets."""
    for batch in batches:
        data, offs = flat(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't ``space``, and offsets of each row in them.

    ``space``: a table of 256 booleans. A run never crosses the border of two rows.
    """
    n = len(data)
    inside = ~space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[offs] = True
    was = np.concatenate(([False], inside))[:n]
    starts = np.flatnonzero(inside & (~was | edge[:n]))
    after = np.concatenate((inside, [False]))[1:] if n else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1 if n else starts
    return starts, ends, np.searchsorted(starts, offs)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Booleans for the 256 bytes: true in the given ranges, both ends included."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def arrow_map(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(kernel, schema)
