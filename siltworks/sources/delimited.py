"""Delimited files: encoding and delimiter are told from a bounded head of the file, then Spark reads and parses it.

A file is read in splits. Where some record may run over a line end, or the encoding isn't one of Spark's own, the splits find
their first true record first (``records``). Only encodings in which an ASCII byte may be part of another character are one task's.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FileError, TooLargeError
from ..functions.exprs import strip
from .records import records

# Separators that are tried, and how much of a file is looked at.
DELIMITERS = (",", ";", "\t", "|")
HEAD_BYTES, SNIFF_CHARS, NUL_CHARS, COUNT_LINES = 200_000, 20_000, 4096, 20
EXTENSIONS = (".csv", ".xlsx")
#: Encodings that Spark's reader has, and in which ASCII bytes are part of no other character.
PLAIN = ("utf-8", "iso-8859-1", "us-ascii")


def of_single_bytes(encoding: str) -> bool:
    """UTF-8, or an encoding of one byte a character whose lower half is ASCII: quotes, separators and line ends are told by their bytes."""
    if encoding == "utf-8":
        return True
    try:
        upper = [len(bytes([b]).decode(encoding, "replace")) == 1 and bytes([b, 65]).decode(encoding, "replace")[1:] == "A" for b in range(128, 256)]
        return all(upper) and bytes(range(128)).decode(encoding) == "".join(map(chr, range(128)))
    except (LookupError, UnicodeDecodeError):
        return False


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext not in EXTENSIONS:
        raise FileError(f"{name} is neither .csv nor .xlsx")
    return ext


def head(spark: SparkSession, path: str, limit: int = HEAD_BYTES) -> tuple[bytes, int]:
    """The first bytes of a file that Spark can reach, and its length. No more than those bytes is read."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length").take(1)
    if not rows or not rows[0]["length"]:
        raise FileError(f"{path} is empty")
    at = spark._jvm.org.apache.hadoop.fs.Path(rows[0]["path"])
    stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(at)
    try:
        return bytes(stream.readNBytes(limit)), rows[0]["length"]
    finally:
        stream.close()


def encoding_of(data: bytes) -> str:
    """UTF-8 (with or without a mark), else cp1252 where few bytes are high, else what charset-normalizer says, else Latin-1."""
    if data.startswith(b"\xef\xbb\xbf"):
        return "utf-8"
    for cut in range(4):  # a head may end inside a character
        try:
            data[: len(data) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            pass
    if sum(b > 127 for b in data) < 0.1 * len(data):
        return "windows-1252"
    try:
        from charset_normalizer import from_bytes

        found = from_bytes(data).best()
        return found.encoding if found else "iso-8859-1"
    except ImportError:
        return "iso-8859-1"


def delimiter_of(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        lines = sample.splitlines()[:COUNT_LINES]
        counts = {d: sum(line.count(d) for line in lines) for d in DELIMITERS}
        return max(counts, key=counts.get) if any(counts.values()) else ","


def headers_of(cells: list[str | None]) -> list[str]:
    """Stripped names; blank ones are ``Column N``; repeats get `` (2)``, `` (3)``."""
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(cells, 1):
        name = (cell or "").strip() or f"Column {i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def spans_lines(spark: SparkSession, path: str, delimiter: str) -> bool:
    """Whether some record may run over a line end: a line has quotes other than round whole cells, or a carriage return inside. One pass in splits; any doubt says yes."""
    line = F.regexp_replace("value", r"\r$", "")
    d = re.escape(delimiter)
    bare = F.regexp_replace(line, f'(^|{d})"(?:[^"]++|"")*+"(?=$|{d})', "$1")
    return not spark.read.option("lineSep", "\n").text(path).where(line.contains("\r") | (line.contains('"') & bare.contains('"'))).isEmpty()


def indexed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """row_index from 0 in the file's order: rows are numbered within splits, which are counted and put in order by path and offset."""
    split = ["__path", "__start"]
    placed = rows.withColumn("__id", F.monotonically_increasing_id())
    sizes = placed.groupBy(split).agg(F.count("*").alias("n"), F.min("__id").alias("lo"))  # one row a split
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before), split).select((F.col("before") + F.col("__id") - F.col("lo")).alias("row_index"), *[F.col(f"`{c}`") for c in columns])


def filled(columns: list[str]):
    """Some cell isn't blank. Told from the cells as they are read: a test of cells that are renamed or changed later would make the optimizer derive it anew for every choice of old and new names."""
    return strip(F.concat_ws("", *[F.col(f"`{c}`") for c in columns])) != ""


def read_csv(spark: SparkSession, path: str, max_bytes: int | None = None) -> tuple[DataFrame, dict]:
    """(row_index, columns as text) and {columns, encoding, delimiter, file_type}.

    The first row that isn't blank is the header; blank rows go; short rows are padded and long ones cut; "" is null. An encoding of
    several bytes a character other than UTF-8 must be one that Spark's reader has, as UTF-16.
    """
    if extension(path) != ".csv":
        raise FileError(f"{path} isn't a .csv file")
    data, length = head(spark, path)
    if max_bytes is not None and length > max_bytes:
        raise TooLargeError(f"{path} has {length} bytes; {max_bytes} are allowed")
    encoding = encoding_of(data)
    sample = data.decode(encoding, "replace").lstrip("﻿")
    if "\0" in sample[:NUL_CHARS]:
        raise FileError(f"{path} is not a text file")
    delimiter = delimiter_of(sample[:SNIFF_CHARS])
    first = next((r for r in csv.reader(sample.splitlines(keepends=True), delimiter=delimiter) if any(c.strip() for c in r)), None)
    if not first:
        raise FileError(f"{path} has no rows")
    columns = headers_of(first)
    if of_single_bytes(encoding) and (encoding not in PLAIN or spans_lines(spark, path, delimiter)):
        rows = records(spark, path, len(columns), delimiter, encoding)
        # the header is the first row that isn't blank
        body = rows.where("row_index > 0").select((F.col("row_index") - 1).alias("row_index"), *[F.col("cells")[i].alias(c) for i, c in enumerate(columns)])
        return body, {"columns": columns, "encoding": encoding, "delimiter": delimiter, "file_type": "csv"}
    schema = ", ".join(f"_c{i} string" for i in range(len(columns)))
    raw = spark.read.schema(schema).csv(path, sep=delimiter, encoding=encoding, multiLine=encoding not in PLAIN, quote='"', escape='"', emptyValue="", header=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="PERMISSIVE")
    slots = [f"_c{i}" for i in range(len(columns))]
    place = F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start")
    kept = indexed(raw.where(filled(slots)).select(*place, *[F.nullif(F.col(c), F.lit("")).alias(c) for c in slots]), slots)
    body = kept.where("row_index > 0").select((F.col("row_index") - 1).alias("row_index"), *[F.col(s).alias(c) for s, c in zip(slots, columns, strict=True)])
    return body, {"columns": columns, "encoding": encoding, "delimiter": delimiter, "file_type": "csv"}
