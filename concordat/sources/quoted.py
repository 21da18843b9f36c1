"""Delimited files whose quoted cells may hold delimiters and line breaks, read in splits.

Where a split begins, a cell may be open. A parallel prefix finds out: each split tells, in one pass over its bytes, where
each state of the reader's automaton would lead and how many lines it has; per file these functions compose to the state
and the line with which every split begins. Then each split is parsed from its known state. It owns the records that begin
in it and reads on behind its end until the last of them is whole, so records of any length come out once.

The automaton reads bytes, so splits may cut characters. Quotes count at a cell's start only; in a quoted cell two quotes
stand for one. A line ends at a line feed, with a carriage return before it or not.

Memory: a split, its arrays (about ten bytes for each), and the longest record. The composition holds one file's splits.

Defined results: lines without a cell are passed over. An empty cell is null, an empty quoted cell is ''. A cell that is
quoted and goes on behind its quote keeps both parts. A quote that is never closed takes the rest of its file. Bytes that
aren't UTF-8 are replaced; a byte-order mark at a file's start is dropped. Empty files have no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.functions.automaton import Automaton
from concordat.sources import ranges
from concordat.store import settled

#: Bytes of a split, and of what is read at a time behind its end.
SPLIT, MORE = 4 << 20, 64 << 10
BOM = b"\xef\xbb\xbf"
RECORD = "path string, file bigint, line bigint, cells array<string>"

OTHER, QUOTE, MARK, LINE = range(4)
#: At a record's start, at another cell's start, in a plain cell, in a quoted one, behind a quote in it.
RECORD_START, CELL_START, PLAIN, QUOTED, CLOSING = range(5)


def _step(state: int, symbol: int) -> int:
    if state == QUOTED:
        return CLOSING if symbol == QUOTE else QUOTED
    if symbol == QUOTE:
        return PLAIN if state == PLAIN else QUOTED
    return (PLAIN, 0, CELL_START, RECORD_START)[symbol]


READER = Automaton(_step, 5, 4)


def symbols(data: bytes, mark: bytes, quote: bytes = b'"') -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[quote[0], mark[0], 0x0A]] = QUOTE, MARK, LINE
    return table[np.frombuffer(data, np.uint8)]


def _behind(file: pa.NativeFile, at: int, state: int, mark: bytes) -> bytes:
    """What follows until a record in this state at this place is whole."""
    parts = []
    while state != RECORD_START and (data := ranges.read_range(file, at, MORE)):
        kinds = symbols(data, mark)
        before, state = READER.states(kinds, state)
        ends = np.flatnonzero((kinds == LINE) & (before != QUOTED))
        if len(ends):
            parts.append(data[: ends[0] + 1])
            break
        parts.append(data)
        at += len(data)
    return b"".join(parts)


def cell(raw: bytes, quote: bytes = b'"') -> str | None:
    """A cell's text."""
    if not raw.startswith(quote):
        return raw.decode("utf-8", "replace") if raw else None
    body, rest, at = raw[1:], b"", 0
    while (at := body.find(quote, at)) >= 0:
        if body[at + 1 : at + 2] != quote:
            body, rest = body[:at], body[at + 1 :]
            break
        at += 2
    return (body.replace(quote * 2, quote) + rest).decode("utf-8", "replace")


def parsed(file: pa.NativeFile, offset: int, length: int, state: int, line: int, mark: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(line, cells) of the records that begin in a split whose first state and line are known."""
    data = ranges.read_range(file, offset, length)
    kinds = symbols(data, mark)
    before, last = READER.states(kinds, state)
    ends = np.flatnonzero((kinds == LINE) & (before != QUOTED))
    first = 0
    if state != RECORD_START:  # the record that is open belongs to an earlier split
        if not len(ends):
            return
        first = int(ends[0]) + 1
    if first >= len(data):
        return
    line += data.count(b"\n", 0, first)
    if last != RECORD_START:
        data += _behind(file, offset + len(data), last, mark)
        kinds = symbols(data, mark)
        before, _ = READER.states(kinds, state)
    cuts = np.flatnonzero(((kinds == LINE) | (kinds == MARK)) & (before != QUOTED))
    cuts = cuts[cuts >= first]
    is_line = (kinds[cuts] == LINE).tolist()
    cuts = cuts.tolist()
    if not cuts or cuts[-1] != len(data) - 1 or not is_line[-1]:  # the file ends without a line feed
        cuts.append(len(data))
        is_line.append(True)
    if offset == 0 and data.startswith(BOM):
        first = 3
    cells: list[str | None] = []
    own = line
    for to, ended in zip(cuts, is_line):
        raw = data[first:to]
        if ended and raw.endswith(b"\r"):
            raw = raw[:-1]
        if b"\n" in raw:
            line += raw.count(b"\n")
        if ended and not cells and not raw:
            own = line = line + 1
        else:
            cells.append(cell(raw))
            if ended:
                yield own, cells
                cells = []
                own = line = line + 1
        first = to + 1


def _began(listed: DataFrame, mark: str, length: int) -> DataFrame:
    """(path, offset, length, state, line): the splits of the files with the state and line they begin with."""
    cut = ranges.splits(listed, length)
    kind = "path string, offset bigint, length bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = x.to_pylist()
            made = []
            for r in rows:
                with ranges.opened(r["path"]) as file:
                    data = ranges.read_range(file, r["offset"], r["length"])
                if r["offset"] == 0 and data.startswith(BOM):
                    data = data[3:]
                made.append((READER.function(symbols(data, mark.encode())), data.count(b"\n")))
            more = [pa.array([f for f, _ in made], pa.list_(pa.int32())), pa.array([n for _, n in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([*x.columns, *more], [*x.schema.names, "leads", "lines"])

    def compose(splits: pd.DataFrame) -> pd.DataFrame:
        splits = splits.sort_values("offset")
        state, line, states, lines = RECORD_START, 1, [], []
        for leads, n in zip(splits.leads, splits.lines):
            states.append(state)
            lines.append(line)
            state, line = int(leads[state]), line + n
        return splits[["path", "offset", "length"]].assign(state=states, line=lines)

    alone = cut.filter(F.col("size") <= length).select("path", "offset", "length", F.lit(RECORD_START).alias("state"), F.lit(1).cast("bigint").alias("line"))
    several = settled(cut.filter(F.col("size") > length).select("path", "offset", "length"))
    told = ranges.dealt(several, "length", "path", "offset").mapInArrow(count, f"{kind}, leads array<int>, lines bigint")
    return alone.union(told.groupBy("path").applyInPandas(compose, f"{kind}, state int, line bigint"))


def _parse(began: DataFrame, mark: str) -> DataFrame:
    """The records of splits. Where began has the columns above and file, records up to the line above are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                lines: list[int] = []
                cells: list[list[str | None]] = []

                def out() -> pa.RecordBatch:
                    kept = [[r["path"]] * len(lines), [r.get("file", 0)] * len(lines), lines, cells]
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(kept, kinds)], ["path", "file", "line", "cells"])

                with ranges.opened(r["path"]) as file:
                    for line, own in parsed(file, r["offset"], r["length"], r["state"], r["line"], mark.encode()):
                        if line <= r.get("above", 0):
                            continue
                        lines.append(line)
                        cells.append(own)
                        if len(lines) == 5000:
                            yield out()
                            lines, cells = [], []
                yield out()

    return began.mapInArrow(run, RECORD)


def records(spark: SparkSession, path: str | list[str], mark: str = ",", length: int = SPLIT) -> DataFrame:
    """(path, line: where the record begins, from 1, cells) of delimited files."""
    if len(mark.encode()) != 1:
        raise ValueError(f"the delimiter {mark!r} isn't one byte")
    return _parse(ranges.dealt(settled(_began(ranges.files(spark, path), mark, length)), "length", "path", "offset"), mark).drop("file")


def _first(found: DataFrame) -> DataFrame:
    """(path, line, cells) of each file's first record."""
    return found.groupBy("path").agg(F.min_by(F.struct("line", "cells"), "line").alias("x")).select("path", "x.*")


class Table:
    """Files of one layout: their header and the records below it.

    header_row: the line, from 1, on which the header stands; a header that begins later on is taken too.
    """

    def __init__(self, spark: SparkSession, path: str | list[str], mark: str = ",", header_row: int = 1, length: int = SPLIT) -> None:
        if len(mark.encode()) != 1:
            raise ValueError(f"the delimiter {mark!r} isn't one byte")
        self._mark, self._began = mark, settled(_began(ranges.files(spark, path), mark, length))
        # Headers lie in the splits that begin before them, or just behind.
        top = _parse(self._began.filter(F.col("line") <= header_row), mark).filter(F.col("line") >= header_row)
        self._heads = settled(_first(top))
        if self._heads.count() < self._began.select("path").distinct().count():
            top = _parse(ranges.dealt(self._began, "length", "path", "offset"), mark).filter(F.col("line") >= header_row)
            self._heads = settled(_first(top))
        first = self._heads.orderBy("path").first()
        self.header: list[str] = [x or "" for x in first.cells] if first else []
        below = _first(top.filter((F.col("path") == first.path) & (F.col("line") > first.line))).first() if first else None
        #: The cells of the first file's first record below its header.
        self.sample: list[str | None] | None = below.cells if below else None

    def rows(self, columns: list[str], order: str = "source_order") -> DataFrame:
        """The records below the headers as text columns, and a number that follows files by name and lines in a file."""
        # One row for each file. Lines up to the header are left out in parsing, so no filter of a reader meets them.
        heads = self._heads.select("path", F.col("line").alias("above"), F.row_number().over(Window.orderBy("path")).cast("bigint").alias("file"))
        below = _parse(ranges.dealt(settled(self._began.join(heads, "path")), "length", "path", "offset"), self._mark)
        place = (F.col("file") * (1 << 40) + F.col("line")).alias(order)
        return below.select(*[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(columns)], place)
