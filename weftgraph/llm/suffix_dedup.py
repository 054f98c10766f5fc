"""Removal of byte strings that occur more than once, by suffix sorting of shards.

Windows with equal content have equal anchors (see ``repeats``), so the stretches
around anchors are dealt to shards by anchor, and each shard is suffix-sorted on
its own.  Anchors that occur once, or always in the same surroundings, are settled
before by counting; equal stretches travel once.  An anchor with very many
different surroundings would overload a shard: it is extended by the bytes next to
it, which tell its stretches apart, and counted again.  What is still too many, the
few windows around such an extension, is counted by window hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rolling, repeats
from ._arrow import run, slices
from .components import written
from .repeats import ROW, TEXT
from .suffixes import repeated_starts

WINDOW, GRAM = 200, 64
#: Bytes by which the anchors of many stretches are extended, to the right or else to the left.
EXTRA = 24
#: Different stretches of one anchor that a shard takes; those of other anchors are counted by window.
MOST_STRETCHES = 2000
#: Bytes that are sorted at once, except for a single anchor's.
SHARD_BYTES = 2 << 20


def stretches(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """anchor, cover, piece: the bytes of the wanted groups (anchor, cover, row, start, n)."""
    schema = pa.schema([("anchor", pa.int64()), ("cover", pa.int64()), ("piece", pa.binary())])
    lists = wanted.groupBy(ROW).agg(F.collect_list(F.struct("start", "n", "anchor", "cover")).alias(repeats.RANGES))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts = repeats.text_bytes(batch.column(at(TEXT)))
            ranges = batch.column(at(repeats.RANGES))
            owner, start, n = repeats.flat_ranges(ranges)
            flat = ranges.flatten()
            pieces = [texts[o][a : a + k + window - 1] for o, a, k in zip(owner.tolist(), start.tolist(), n.tolist(), strict=True)]
            for a in range(0, len(pieces), 20_000):
                part = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([flat.field(2)[part], flat.field(3)[part], pa.array(pieces[part], pa.binary())], schema=schema)

    return run(rows.join(lists, ROW), kernel, "anchor long, cover long, piece binary")


def sorted_shards(pieces: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """anchor, cover, ranges: starts within each stretch of windows that start elsewhere in its shard too."""
    range_type = pa.list_(pa.struct([("at", pa.int32()), ("many", pa.int32())]))
    schema = pa.schema([("anchor", pa.int64()), ("cover", pa.int64()), ("found", range_type)])

    def settle(anchors: list[int], covers: list[int], texts: list[bytes]) -> pa.RecordBatch:
        hit = repeated_starts(texts, window)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begin = np.cumsum(size) - size
        own = np.searchsorted(begin, hit, side="right") - 1
        head = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(own) != 0)]) if len(hit) else np.zeros(0, np.int64)
        many = np.diff(np.r_[head, len(hit)])
        found: list[list[dict]] = [[] for _ in texts]
        for o, a, k in zip(own[head].tolist(), (hit[head] - begin[own[head]]).tolist(), many.tolist(), strict=True):
            found[o].append({"at": a, "many": k})
        keep = [i for i, f in enumerate(found) if f]
        return pa.RecordBatch.from_arrays([pa.array([anchors[i] for i in keep], pa.int64()), pa.array([covers[i] for i in keep], pa.int64()), pa.array([found[i] for i in keep], range_type)], schema=schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, covers, texts, held = [], [], [], 0
        for batch in batches:
            for a, c, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held > shard_bytes and a != anchors[-1]:
                    yield settle(anchors, covers, texts)
                    anchors, covers, texts, held = [], [], [], 0
                anchors.append(a)
                covers.append(c)
                texts.append(t)
                held += len(t)
        if texts:
            yield settle(anchors, covers, texts)

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(n, "anchor").sortWithinPartitions("anchor")
    return run(dealt, kernel, "anchor long, cover long, found array<struct<at: int, many: int>>")


def extended(rows: DataFrame, wide: DataFrame, window: int, gram: int, extra: int) -> DataFrame:
    """The wide groups (anchor, row, start, n) again, by longer anchors.

    A window with room for it takes the bytes right of the anchor along, another
    those left of it.  Which one depends on where the anchor lies in the window, so
    equal windows still have equal anchors.
    """
    schema = pa.schema([("anchor", pa.int64()), ("cover", pa.int64()), (ROW, pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
    lists = wide.groupBy(ROW).agg(F.collect_list(F.struct("start", "n", "anchor")).alias(repeats.RANGES))
    room = window - gram - extra  # the last place of an anchor in a window that leaves the extra bytes after it

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            row = batch.column(at(ROW)).to_numpy(zero_copy_only=False)
            texts = repeats.text_bytes(batch.column(at(TEXT)))
            ranges = batch.column(at(repeats.RANGES))
            owner, start, n = repeats.flat_ranges(ranges)
            anchors = ranges.flatten().field(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in slices(texts):
                u = repeats.Units(texts[a:b], words=False)
                mine = (owner >= a) & (owner < b)
                doc = owner[mine] - a
                first, count, anchor = u.first[doc] + start[mine], n[mine], anchors[mine]
                roll, second = _rolling.Rolling(u.hashes[0], 0), _rolling.Rolling(u.hashes[1], 1)
                # The anchor is the leftmost of its hash in the first window, and inside all windows of its group.
                low = first + count - 1
                place = np.full(len(low), -1)
                for step in range(window - gram + 1):
                    here = np.minimum(low + step, len(u.end_of) - gram)
                    hit = (place < 0) & (roll.of(here, here + gram) == anchor)
                    place[hit] = here[hit]
                # Windows start at place - offset; those of small offset have room at the right.
                split = np.clip(place - room, first, first + count)  # first start with room
                for right, lo, hi in ((False, first, split), (True, split, first + count)):
                    some = hi > lo
                    s, k, p = lo[some], (hi - lo)[some], place[some]
                    whole = roll.of(p, p + gram + extra) if right else roll.of(p - extra, p + gram)
                    key = _rolling.mix(whole + np.uint64(1 + right))
                    cover = _rolling.mix(second.of(s, s + k + window - 1) + (p - s).astype(np.uint64) * _rolling.BASES[0] + k.astype(np.uint64) * _rolling.BASES[1])
                    d = doc[some]
                    cols = key.view(np.int64), cover.view(np.int64), row[a:b][d], (s - u.first[d]).astype(np.int32), k.astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    return run(rows.join(lists, ROW), kernel, f"anchor long, cover long, {ROW} long, start int, n int")


def resolve(rows: DataFrame, hits: DataFrame, window: int, most: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Repeated ranges (row, start, n) of groups whose anchors occur again, and the groups of wide anchors."""
    sure = hits.where("sure").select(ROW, "start", "n")
    open_ = hits.where("not sure")
    # One row per different stretch, with one place where it stands.
    kinds = open_.groupBy("anchor", "cover").agg(F.count("*").alias("times"), F.min(F.struct(ROW, "start", "n")).alias("one"))
    wide = kinds.groupBy("anchor").agg((F.count("*") > most).alias("wide"))
    kinds = written(kinds.join(wide, "anchor"))
    shown = kinds.where("not wide").select("anchor", "cover", f"one.{ROW}", "one.start", "one.n")
    sorted_ = sorted_shards(stretches(rows, shown, window), window, shard_bytes)
    # A stretch that stands in several places is repeated whole; another has what its shard found.
    verdict = kinds.where("wide or times > 1").select("anchor", "cover", "wide", (F.col("times") > 1).alias("whole"), F.lit(None).cast("array<struct<at: int, many: int>>").alias("found"))
    verdict = verdict.unionByName(sorted_.select("anchor", "cover", F.lit(False).alias("wide"), F.lit(False).alias("whole"), "found"))
    verdict = verdict.groupBy("anchor", "cover").agg(F.max("wide").alias("wide"), F.max("whole").alias("whole"), F.max("found").alias("found"))
    judged = written(open_.join(verdict, ["anchor", "cover"]).select("anchor", "cover", ROW, "start", "n", "wide", "whole", "found"))
    whole = judged.where("whole").select(ROW, "start", "n")
    parts = judged.where("not whole and not wide").select(ROW, "start", F.explode("found").alias("f")).select(ROW, (F.col("start") + F.col("f.at")).alias("start"), F.col("f.many").alias("n"))
    # Stretches of wide anchors go on, each once: of those that stand in several places one is enough for the others to be held against.
    again = kinds.where("wide").select("anchor", f"one.{ROW}", "one.start", "one.n")
    return sure.unionByName(whole).unionByName(parts), again


def find(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST_STRETCHES, shard_bytes: int = SHARD_BYTES, extra: int = EXTRA) -> DataFrame:
    """row, start, n: ranges of starts of repeated windows of numbered rows."""
    hits = repeats.repeated_groups(repeats.groups(rows, window, gram, words=False))
    found, wide = resolve(rows, hits, window, most, shard_bytes)
    if wide.isEmpty():
        return found
    hits = repeats.repeated_groups(extended(rows, wide, window, gram, extra))
    more, wide = resolve(rows, hits, window, most, shard_bytes)
    found = found.unionByName(more)
    if wide.isEmpty():
        return found
    return found.unionByName(repeats.count_windows(rows, wide.select(ROW, "start", "n"), window, words=False))


def keep(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digests: bool = False, most: int = MOST_STRETCHES) -> DataFrame:
    """Bytes of each text that lie in no string of ``window`` bytes that occurs elsewhere.

    Strings are judged on the input, over UTF-8 bytes; all occurrences go,
    overlapping ones too; none crosses documents.  Returns doc_id, n_bytes,
    n_removed, n_spans and either kept binary (it may be cut inside a character)
    and runs array<struct<start, end>>, or with ``digests`` kept_sha256.  Null and
    short texts have no such string; repeated rows repeat each other; other
    columns are left out.  The input should be a stored table, since its rows are
    read more than once.
    """
    rows = repeats.numbered(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text").select(ROW, "doc_id", TEXT)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rest = [("kept_sha256", pa.string())] if digests else [("kept", pa.binary()), ("runs", run_type)]
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), *rest])

    def emit(batch: pa.RecordBatch, texts: list[bytes], runs: list) -> pa.RecordBatch:
        kept = [keep(t, r) for t, r in zip(texts, runs, strict=True)]
        cols = [batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), list(map(len, texts)), [len(t) - len(k) for t, k in zip(texts, kept, strict=True)], list(map(len, runs))]
        cols += [[hashlib.sha256(k).hexdigest() for k in kept]] if digests else [kept, [[{"start": a, "end": b} for a, b in r] for r in runs]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "kept binary, runs array<struct<start: long, end: long>>")
    return repeats.apply(rows, find(rows, window, most=most), window, emit, out)
