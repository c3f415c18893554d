"""Exact membership without joins: a cascade of Bloom filters over the complete key universe of a corpus.

Level 1 holds the listed keys of the universe; level 2 the keys of the corpus that level 1 takes wrongly; level 3 the listed
keys that level 2 takes wrongly; and so on until a level takes none wrongly. A key of the universe is listed
exactly when the number of levels that take it in a row is odd. Each level's bits are gathered by an
aggregation, become one binary literal of a size that's checked, and every test is a column expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Most bits that a level may have.
MAX_BITS = 1 << 26


class TooLarge(ValueError):
    """A level would need more than the bits that may be shipped."""


def _bits(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(level)), F.xxhash64(F.lit(level), key)
    return [F.pmod(F.shiftright(a, 1) + F.shiftright(b, 8) * F.lit(i), F.lit(bits)) for i in range(hashes)]


def gathered(at: DataFrame, bits: int) -> bytes:
    """The bytes in which the bits that stand in the column ``at`` are set, by one job; at most one row for each 64 bits reaches the driver."""
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toArrow()
    out = np.zeros(-(-bits // 64), dtype="<i8")
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.tobytes()


def bit(data: bytes, at: Column) -> Column:
    """Whether a bit is set."""
    byte = F.conv(F.hex(F.substring(F.lit(data), (F.call_function("shiftright", at, F.lit(3)) + 1).cast("int"), 1)), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def rate(wanted: int, others: int, first: bool) -> float:
    """The share of other keys that a level may take. The first takes wanted / sqrt(2) of them, the others half, which makes the sum of all bits least."""
    return min(0.5, wanted / (math.sqrt(2) * max(1, others))) if first else 0.5


class Level:
    """One Bloom filter, as bytes on the driver."""

    def __init__(self, keys: DataFrame, number: int, count: int, share: float, max_bits: int):
        self.number, self.hashes = number, max(1, round(-math.log2(share)))
        self.bits = max(8, math.ceil(count * -math.log2(share) / math.log(2)))
        if self.bits > max_bits:
            raise TooLarge(f"level {number} needs {self.bits} bits for {count} keys; at most {max_bits} are shipped")
        self.data = gathered(keys.select(F.explode(F.array(*_bits(F.col("key"), number, self.hashes, self.bits))).alias("at")), self.bits)

    def takes(self, key: Column) -> Column:
        """Whether every bit of the key is set; the level's bytes stand in the plan once, whatever the number of hashes."""
        return F.forall(F.array(*_bits(key, self.number, self.hashes, self.bits)), lambda at: bit(self.data, at))


class Cascade:
    """listed, universe: DataFrames of one string column ``key``. Listed keys outside the universe are left out; nulls and repeats don't matter."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS):
        self.levels: list[Level] = []
        keys = universe.select("key", F.lit(0).alias("l")).union(listed.select("key", F.lit(1).alias("l"))).where("key is not null").groupBy("key").agg(F.max("l").alias("l"), F.min("l").alias("u")).where("u = 0")
        keys = stash(keys.select("key", (F.col("l") == 1).alias("listed")))
        wanted, others = keys.where("listed"), keys.where("not listed")
        while count := wanted.count():
            share = rate(count, 0 if self.levels else others.count(), not self.levels)
            level = Level(wanted.select("key"), len(self.levels) + 1, count, share, max_bits)
            self.levels.append(level)
            wanted, others = others.where(level.takes(F.col("key"))), wanted

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.takes(key) & ~out
        return F.coalesce(out, F.lit(False))


def rule_host(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty if there is none or the url is null."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def rule_path(url: Column) -> Column:
    """From the host's end up to ? # or the end."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(F.regexp_extract(after, r"(?s)^[^/?#]*(.*)$", 1), r"^[^?#]*", 0), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and each of its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """pages (page_id, url, ...), rules of (verdict, host, path), listed of domains (key) -> page_id, host, path, rule, verdict.

    The longest fitting rule decides (length of host and path together; of equal ones the first given); without one a url
    is blocked exactly when its host or a parent domain is listed. Null urls and urls without :// have empty host and path,
    fit no rule with a host and are allowed. One row per input row; with an empty list nothing else is blocked. If the
    list needs more bits than may be shipped, the listed domains are joined instead.
    """
    parts = pages.select("page_id", rule_host(F.col("url")).alias("host"), rule_path(F.col("url")).alias("path"))
    name = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for v, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    judged = parts.withColumn("rule", name).withColumn("by_rule", verdict)
    universe = parts.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))
    try:
        cascade = Cascade(listed.select("key"), universe, max_bits)
        blocked = F.exists(suffixes(F.col("host")), cascade.holds)
        out = judged.withColumn("blocked", blocked)
    except TooLarge:
        hosts = parts.select("host").distinct().withColumn("key", F.explode(suffixes(F.col("host")))).join(listed.select("key").distinct(), "key", "left_semi").select("host", F.lit(True).alias("blocked")).distinct()
        out = judged.join(hosts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
