"""Windows of fixed length that occur more than once in a corpus, over bytes or words.

Every window has an anchor, chosen by its content (see ``_rolling``), and
neighbouring windows with the same anchor form a group.  Groups are counted by
anchor first: one light row per group, combined map-side, instead of one per
window.  An anchor that occurs once has no repeated window.  If all groups of an
anchor cover the same units, all their windows are repeated.  What is left, where
equal anchors stand in different surroundings, goes to a resolver: exact counts of
the Rabin-Karp hashes of each window, or suffix sorting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rolling
from ._arrow import run, slices
from .components import steady, written

ROW = "__row"
RANGES = "__ranges"
TEXT = "__text"


class Units:
    """Units of the texts of a slice, end to end, and the document of each."""

    def __init__(self, texts: list[bytes], words: bool):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size + 1) - size - 1
        if words:
            self.start, self.end = _rolling.word_bounds(data)
            self.first = np.searchsorted(self.start, begin)
            last = np.searchsorted(self.start, begin + size)
            self.hashes = [_rolling.word_units(data, self.start, self.end, k) for k in (0, 1)]
            self.count = last - self.first
        else:
            self.first, self.count = begin, size
            self.hashes = [_rolling.byte_units(data, k) for k in (0, 1)]
        n = len(self.hashes[0])
        # Between documents of bytes stands a separator, which belongs to none: an end before its start keeps windows out.
        self.end_of = np.zeros(n, np.int64)
        if len(texts):
            inside = np.repeat(self.first + self.count, self.count)
            at = np.arange(len(inside)) - np.repeat(np.cumsum(self.count) - self.count, self.count) + np.repeat(self.first, self.count)
            self.end_of[at] = inside


def text_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def numbered(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with a row number and its text under private names.

    The number is the place in the input, so it is the same in each evaluation if
    the input is a stored table.  Repeated rows and null or repeated ids are told
    apart by it.
    """
    return steady(df).withColumns({ROW: F.monotonically_increasing_id(), TEXT: F.col(text_col).cast("string")})


def groups(rows: DataFrame, window: int, gram: int, words: bool) -> DataFrame:
    """anchor, cover, row, start, n: the groups of all windows."""
    schema = pa.schema([("anchor", pa.int64()), ("cover", pa.int64()), (ROW, pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy(zero_copy_only=False)
            texts = text_bytes(batch.column(1))
            for a, b in slices(texts):
                u = Units(texts[a:b], words)
                anchor, cover, first, n = _rolling.anchor_groups(*u.hashes, u.end_of, window, gram)
                doc = np.searchsorted(u.first, first, side="right") - 1
                # Empty documents share their place with the next one: the last with that place holds the units.
                cols = anchor.view(np.int64), cover.view(np.int64), row[a:b][doc], (first - u.first[doc]).astype(np.int32), n.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    return run(rows.select(ROW, TEXT), kernel, f"anchor long, cover long, {ROW} long, start int, n int")


def repeated_groups(found: DataFrame) -> DataFrame:
    """Groups whose anchor occurs again; ``sure`` where all with that anchor cover the same units."""
    anchors = (
        found.groupBy("anchor")
        .agg(F.count("*").alias("times"), F.min("cover").alias("least"), F.max("cover").alias("most"))
        .where("times > 1")
        .select("anchor", (F.col("least") == F.col("most")).alias("sure"))
    )
    # Written, since several steps follow from it and hashing all texts again for each would cost more.
    return written(found.join(anchors, "anchor"))


def by_row(ranges: DataFrame) -> DataFrame:
    """Ranges of window starts, collected per row: no more than its text has."""
    return ranges.groupBy(ROW).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"))).alias(RANGES))


def window_hashes(rows: DataFrame, wanted: DataFrame, window: int, words: bool) -> DataFrame:
    """h1, h2, row, start: the hashes of the windows that start in the wanted ranges of each row."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), (ROW, pa.int64()), ("start", pa.int32())])
    joined = rows.join(by_row(wanted), ROW)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            row = batch.column(at(ROW)).to_numpy(zero_copy_only=False)
            texts = text_bytes(batch.column(at(TEXT)))
            owner, start, n = flat_ranges(batch.column(at(RANGES)))
            for a, b in slices(texts):
                u = Units(texts[a:b], words)
                mine = (owner >= a) & (owner < b)
                doc, first, count = owner[mine] - a, start[mine], n[mine]
                doc, place = np.repeat(doc, count), expand(first, count)
                begin = u.first[doc] + place
                hashed = [_rolling.Rolling(h, k).of(begin, begin + window).view(np.int64) for k, h in enumerate(u.hashes)]
                cols = *hashed, row[a:b][doc], place.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    return run(joined, kernel, f"h1 long, h2 long, {ROW} long, start int")


def count_windows(rows: DataFrame, wanted: DataFrame, window: int, words: bool) -> DataFrame:
    """row, start, n = 1: wanted windows whose hash occurs more than once among all wanted."""
    hashed = window_hashes(rows, wanted, window, words)
    often = hashed.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    return hashed.join(often, ["h1", "h2"]).select(ROW, "start", F.lit(1).alias("n"))


def flat_ranges(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the batch, start and number of windows of each range."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    return np.repeat(np.arange(len(size)), size), start, n


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range in turn."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def covered(start: np.ndarray, n: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of units covered by windows that start in the ranges."""
    if not len(start):
        return []
    order = np.argsort(start)
    a, b = start[order], (start + n + window - 1)[order]
    reach = np.maximum.accumulate(b)
    head = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    return list(zip(a[head].tolist(), reach[np.r_[head[1:] - 1, len(a) - 1]].tolist(), strict=True))


def apply(rows: DataFrame, ranges: DataFrame, window: int, emit: Callable[[pa.RecordBatch, list[bytes], list[list[tuple[int, int]]]], pa.RecordBatch], schema: str) -> DataFrame:
    """Join each row with its ranges and let ``emit`` make the output from its text and maximal runs."""
    joined = rows.join(by_row(ranges), ROW, "left")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts = text_bytes(batch.column(at(TEXT)))
            owner, start, n = flat_ranges(batch.column(at(RANGES)))
            edge = np.searchsorted(owner, np.arange(len(texts) + 1))
            runs = [covered(start[a:b], n[a:b], window) if b > a else [] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield emit(batch, texts, runs)

    return run(joined, kernel, schema)
