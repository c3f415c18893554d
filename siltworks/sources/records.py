"""Delimited files whose records may run over line ends, read in splits.

A line end is the end of a record or lies inside a quoted cell, which no split can tell by itself. So each line is a
function of the state in which it begins, outside or inside a quoted cell, to the one in which it ends; most lines leave
either as it is. First every split composes the functions of its lines to one, a row a split. The splits of a file are
put in order, which gives the state in which each begins. Then each split parses the records that begin in it, from its first
true record on. The few records that go on in later splits are handed over in pieces and joined by the split they began in.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A line's function by bits: 1, inside after beginning outside; 2, inside after beginning inside.
TO_OUTSIDE, SWAP, KEEP, TO_INSIDE = 0, 1, 2, 3
OUTSIDE, INSIDE = 0, 1
#: The number of a record that ends in a later split: after all others of the split in which it began.
LAST = 1 << 40


def line_function(line: Column, delimiter: str) -> Column:
    """By the usual rules: a quote opens a cell only where the cell begins, two stand for one, and what follows a closing quote belongs to the cell."""
    end, quoted = f"[{re.escape(delimiter)}\\r]", r'(?:[^"]++|"")*+'
    rest = f"[^{re.escape(delimiter)}\\r]*+"
    cells = f'(?:(?:"{quoted}"{rest}|(?!"){rest}){end})*+'
    opens = line.rlike(rf'\A{cells}"{quoted}\z')
    stays = line.rlike(rf'\A{quoted}(?:\z|"{rest}{end}{cells}"{quoted}\z)')
    return F.when(line.contains('"'), opens.cast("int") + F.lit(2) * stays.cast("int")).otherwise(KEEP).cast("tinyint")


def _lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    unmarked = F.when((F.col("start") == 0) & F.col("value").startswith("\ufeff"), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    return lines.withColumn("value", unmarked).select("path", "start", F.col("value").cast("binary").alias("line"), line_function(F.col("value"), delimiter).alias("f"))


def after(f: np.ndarray, state: int) -> np.ndarray:
    """The state after each line."""
    at = np.arange(len(f))
    fixed = (f == TO_OUTSIDE) | (f == TO_INSIDE)
    last = np.maximum.accumulate(np.where(fixed, at, -1))
    swaps = np.cumsum(f == SWAP)
    base = np.where(last >= 0, f[last] == TO_INSIDE, state == INSIDE)
    return (base ^ ((swaps - np.where(last >= 0, swaps[last], 0)) % 2 == 1)).astype(np.int64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch cut where its split changes."""
    if batch.num_rows:
        start, path = batch.column(1).to_numpy(), batch.column(0).dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (path[1:] != path[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield (batch.column(0)[a].as_py(), int(start[a])), batch.slice(a, b - a)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: its path, its start, and the state after it for either state before."""
    held: dict[tuple, list[int]] = {}
    for batch in batches:
        for split, run in _runs(batch):
            f = run.column(2).to_numpy()
            held[split] = [int(after(f, s)[-1]) for s in held.get(split, [OUTSIDE, INSIDE])]
    paths, starts = [k[0] for k in held], [k[1] for k in held]
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["path", "start", "outside", "inside"])


def _in_order(splits: pa.Table) -> pa.Table:
    """The splits of a file with the state in which each begins."""
    splits = splits.sort_by("start")
    state, states = OUTSIDE, []
    for outside, inside in zip(*(splits[c].to_pylist() for c in ("outside", "inside")), strict=True):
        states.append(state)
        state = inside if state == INSIDE else outside
    return pa.table({"path": splits["path"], "start": splits["start"], "state": pa.array(states, pa.int64())})


def _cells(rows: list[list[str]], width: int) -> list[list[str | None]]:
    """Rows with some cell that isn't blank, short ones padded and long ones cut; an empty cell is null."""
    return [[*(c or None for c in r[:width]), *[None] * (width - len(r))] for r in rows if any(c.strip() for c in r)]


def _parsed(text: str, delimiter: str) -> list[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))


_ROWS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("cells", pa.list_(pa.string())), ("piece", pa.binary()), ("closes", pa.bool_())])
ROWS = "path string, start long, n long, cells array<string>, piece binary, closes boolean"


def _records(width: int, delimiter: str, encoding: str):
    """Lines with the state in which their split begins -> records of the split as cells, numbered; and pieces of records that cross its ends."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, n, begun, open_ = None, OUTSIDE, 0, False, []

        def out(rows: list, pieces: list) -> pa.RecordBatch:
            kept = _cells(rows, width)
            path, start = split
            numbers = [*range(n, n + len(kept)), *[LAST] * len(pieces)]
            return pa.RecordBatch.from_arrays([pa.array([path] * len(numbers), pa.string()), pa.array([start] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), pa.array([*kept, *[None] * len(pieces)], pa.list_(pa.string())), pa.array([*[None] * len(kept), *[p for p, _ in pieces]], pa.binary()), pa.array([*[None] * len(kept), *[c for _, c in pieces]], pa.bool_())], schema=_ROWS)

        for batch in batches:
            for key, run in _runs(batch):
                if key != split:
                    if open_:
                        yield out([], [(b"\n".join(open_), False)])
                    split, n, open_ = key, 0, []
                    state = run.column(4)[0].as_py()
                    begun = state == OUTSIDE
                lines, ends = run.column(2).to_pylist(), after(run.column(3).to_numpy(), state)
                state = int(ends[-1])
                closed = np.flatnonzero(ends == OUTSIDE)
                pieces, first = [], 0
                if not begun and len(closed):  # up to here it's the end of an earlier split's record
                    first = int(closed[0]) + 1
                    pieces.append((b"\n".join([*open_, *lines[:first]]), True))
                    open_, begun = [], True
                if begun and len(closed):
                    upto = int(closed[-1]) + 1
                    text = b"\n".join([*open_, *lines[first:upto]]) if upto > first else b""
                    rows = _parsed(text.decode(encoding, "replace"), delimiter) if upto > first else []
                    open_ = lines[upto:]
                else:
                    rows, open_ = [], [*open_, *lines]
                made = out(rows, pieces)
                n += made.num_rows - len(pieces)
                yield made
        if open_:
            yield out([], [(b"\n".join(open_), False)])

    return kernel


def _joined(width: int, delimiter: str, encoding: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_cells(_parsed(t.decode(encoding, "replace"), delimiter), width) for t in batch.column(2).to_pylist()]
            own = [i for i, r in enumerate(rows) for _ in r]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), batch.column(1).take(pa.array(own, pa.int64())), pa.array([LAST + k for r in rows for k in range(len(r))], pa.int64()), pa.array([c for r in rows for c in r], pa.list_(pa.string()))], names=["path", "start", "n", "cells"])

    return kernel


def records(spark: SparkSession, path: str, width: int, delimiter: str, encoding: str) -> DataFrame:
    """(row_index, cells array<string>) of the records that aren't blank, from 0 in the file's order, each of ``width`` cells; an empty cell is null.

    ``encoding``: one in which line ends, quotes and the delimiter are bytes that are part of no other character. A quote that never closes
    takes in the rest of the file, as the rules have it, but for a line end at its very end. A record is one row, so it must fit into a task's memory.
    """
    lines = _lines(spark, path, delimiter)
    splits = lines.select("path", "start", "f").mapInArrow(_composed, "path string, start long, outside long, inside long")
    begins = splits.groupBy("path").applyInArrow(_in_order, "path string, start long, state long")  # a row a split
    read = lines.join(F.broadcast(begins), ["path", "start"]).select("path", "start", "line", "f", "state").mapInArrow(_records(width, delimiter, encoding), ROWS)
    # of a file's pieces, one that doesn't close begins a record or goes on with it, and the next that closes ends it
    pieces = read.where("piece is not null").select("path", "start", "piece", "closes")
    order = Window.partitionBy("path").orderBy("start", F.desc("closes"))
    record = F.coalesce(F.sum(F.col("closes").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = pieces.select("path", "start", "piece", record.alias("record")).groupBy("path", "record").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts"))
    text = F.reduce(F.slice("parts", F.lit(2), F.size("parts")), F.element_at("parts", 1)["piece"], lambda acc, p: F.concat(acc, F.lit(b"\n"), p["piece"]))
    crossing = each.select("path", "start", text.alias("text")).mapInArrow(_joined(width, delimiter, encoding), "path string, start long, n long, cells array<string>")
    rows = read.where("piece is null").select("path", "start", "n", "cells").unionByName(crossing)
    sizes = rows.groupBy("path", "start").agg(F.count("*").alias("size"), F.count_if(F.col("n") < LAST).alias("whole"))  # a row a split
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.when(F.col("n") < LAST, F.col("n")).otherwise(F.col("whole") + F.col("n") - LAST)
    return rows.join(F.broadcast(before), ["path", "start"]).select((F.col("before") + place).alias("row_index"), "cells")
