"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Each distinct shingle of a document arrives at the registers of a signature as a
Poisson process whose rate is its weight (how often it occurs); a register keeps
the shingle that came first.  Arrivals stop once they are later than every
register's.  Two documents agree in a register with their probability Jaccard
similarity.  Bands of registers make candidates, which are verified exactly on
their shingles; links are joined into groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rolling
from ._arrow import run, slices
from .components import connected, steady, stored
from .repeats import ROW, TEXT, Units, expand, text_bytes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Members of a bucket, and bytes of their texts, in one block; a tile compares two blocks.
TILE, TILE_BYTES = 1024, 4 << 20
#: Shingles that are compared with one text at once.
GATHER = 1 << 20
#: Room for the rounding of sums of fractions.
ROUNDING = 1e-9

_TIME, _PLACE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle; a text of fewer words has one of all its words."""
    return weighted(Units(texts, words=True), width)


def weighted(u: Units, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    roll = _rolling.Rolling(u.hashes[0], 0)
    n = np.where(u.count >= width, u.count - width + 1, np.minimum(u.count, 1))
    doc = np.repeat(np.arange(len(n)), n)
    start = u.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    h = roll.of(start, np.minimum(start + width, u.end_of[start]) if len(start) else start)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[head], h[head], np.diff(np.r_[head, len(doc)])


def sign(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures of n texts (rows of zeros for those without shingles)."""
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    at, k = np.zeros(len(doc)), np.zeros(1, np.uint64)
    while len(doc):
        k = k + np.uint64(1)
        draw = (_rolling.mix(h + k * _TIME) >> np.uint64(11)).astype(np.float64)
        at = at - np.log((draw + 1) * 2.0**-53) / weight
        slot = doc * registers + (_rolling.mix(h ^ (k * _PLACE)) % np.uint64(registers)).astype(np.int64)
        sooner = np.flatnonzero(at < first[slot])
        np.minimum.at(first, slot[sooner], at[sooner])
        won = sooner[at[sooner] == first[slot[sooner]]]
        kept[slot[won]] = h[won]
        going = at < first.reshape(n, registers).max(axis=1)[doc]
        doc, h, weight, at = doc[going], h[going], weight[going], at[going]
    return kept.reshape(n, registers)


def bands_for(threshold: float) -> int:
    """How many bands miss a pair at the threshold no more often than BANDS miss one at THRESHOLD."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    if threshold >= THRESHOLD:
        return BANDS
    return math.ceil(BANDS * math.log1p(-(THRESHOLD**ROWS)) / math.log1p(-(threshold**ROWS)))


def bands(signature: np.ndarray) -> np.ndarray:
    """One key per band, different from band to band."""
    count = signature.shape[1] // ROWS
    parts = signature.reshape(len(signature), count, ROWS)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * _PLACE, parts.shape[:2])
    for r in range(ROWS):
        key = _rolling.mix(key * _TIME + parts[:, :, r])
    return key


def sketches(rows: DataFrame, threshold: float) -> DataFrame:
    """row, doc_id, d1, d2 (digest of the words), size (bytes) and keys (of the bands); texts without words have null digests."""
    schema = pa.schema([(ROW, pa.int64()), ("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])
    count = bands_for(threshold)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id, texts = batch.column(0), batch.column(1), text_bytes(batch.column(2))
            for a, b in slices(texts):
                n = b - a
                u = Units(texts[a:b], words=True)
                digest = [_rolling.Rolling(h, k).of(u.first, u.first + u.count).view(np.int64) for k, h in enumerate(u.hashes)]
                none = u.count == 0
                signature = sign(*weighted(u, SHINGLE), n, count * ROWS)
                keys = bands(signature).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * count), pa.array(keys.ravel()))
                cols = row[a:b], doc_id[a:b], pa.array(digest[0], mask=none), pa.array(digest[1], mask=none), pa.array(list(map(len, texts[a:b])), pa.int64()), lists
                yield pa.RecordBatch.from_arrays(list(cols), schema=schema)

    return run(rows.select(ROW, "doc_id", TEXT), kernel, f"{ROW} long, doc_id long, d1 long, d2 long, size long, keys array<long>")


class Bags:
    """Weighted shingles of the texts of some tiles, by dense numbers."""

    def __init__(self, texts: list[bytes]):
        parts = [(doc + a, h, weight) for a, b in slices(texts) for doc, h, weight in [shingles(texts[a:b])]]
        doc, h, weight = (np.concatenate([p[k] for p in parts]) for k in range(3))
        values, self.at = np.unique(h, return_inverse=True)
        self.weight, self.edge = weight.astype(np.float64), np.searchsorted(doc, np.arange(len(texts) + 1))
        self.total = np.bincount(doc, self.weight, len(texts))
        self.spread = np.zeros(len(values))  # the weights of one text at a time

    def near(self, one: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Whether each of the others has a probability Jaccard of ``threshold`` or more with one.

        Registers agree no more often than the distributions overlap, so others
        whose overlap is less are settled by it.  With r = y / x over the common
        shingles, the similarity is the sum over i of 1 / (x-mass up to r_i over x_i +
        y-mass above r_i over y_i), where the shingles of one text alone lie at the ends.
        """
        size = self.edge[others + 1] - self.edge[others]
        out = np.zeros(len(others), bool)
        mine = slice(self.edge[one], self.edge[one + 1])
        self.spread[self.at[mine]] = self.weight[mine]
        stop = np.cumsum(size)
        a = 0
        while a < len(others):
            b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + GATHER, side="right")))
            out[a:b] = self._near(one, others[a:b], size[a:b], threshold)
            a = b
        self.spread[self.at[mine]] = 0
        return out

    def _near(self, one: int, others: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
        place = expand(self.edge[others], size)
        x = self.spread[self.at[place]]
        both = np.flatnonzero(x)
        owner = np.repeat(np.arange(len(others)), size)[both]
        x, y = x[both], self.weight[place[both]]
        whole, wholes = self.total[one], self.total[others]
        overlap = np.bincount(owner, np.minimum(x / whole, y / wholes[owner]), len(others))
        some = (overlap >= threshold - ROUNDING)[owner]
        owner, x, y = owner[some], x[some], y[some]
        if not len(owner):
            return np.zeros(len(others), bool)
        ratio = y / x
        if ratio.min() != ratio.max():
            order = np.lexsort((ratio, owner))
            owner, x, y = owner[order], x[order], y[order]
        in_x, in_y = np.bincount(owner, x, len(others)), np.bincount(owner, y, len(others))
        before_x, before_y = np.cumsum(in_x) - in_x, np.cumsum(in_y) - in_y
        up_to, above = np.cumsum(x) - before_x[owner], in_y[owner] - (np.cumsum(y) - before_y[owner])
        under = (whole - in_x[owner] + up_to) / x + (wholes[owner] - in_y[owner] + above) / y
        return np.bincount(owner, 1 / under, len(others)) >= threshold - ROUNDING


def similarity(a: bytes, b: bytes) -> float:
    """Probability Jaccard of the weighted shingles of two texts.

    The sum over common shingles i of 1 / sum over j of max(a_j / a_i, b_j / b_i).
    Shingles count by their pair of weights, of which there are few.
    """
    doc, h, n = shingles([a, b])
    order = np.argsort(h, kind="stable")
    doc, h, n = doc[order], h[order], n[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    x, y = (np.add.reduceat(np.where(doc == k, n, 0), head) if len(head) else head for k in (0, 1))
    pairs, many = np.unique(np.column_stack([x, y]), axis=0, return_counts=True) if len(x) else (np.zeros((0, 2)), np.zeros(0))
    total = 0.0
    for (p, q), k in zip(pairs.tolist(), many.tolist(), strict=True):
        if p and q:
            total += k / float((many * np.maximum(pairs[:, 0] / p, pairs[:, 1] / q)).sum())
    return total


def links_of(bags: Bags, keys: np.ndarray, band: int, texts: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Group of each text of a tile, by the links between its left and right ones.

    ``texts`` are their numbers in ``bags``.  A pair is compared in the tile of the first band that it shares, and the first text
    with all, which joins most of a group of copies at once; pairs of one group
    are not compared again.
    """
    group = np.arange(len(texts))
    for i in np.flatnonzero(left):
        other = right.copy()
        other[: i + 1] &= ~left[: i + 1]  # of two that are both left and right, once
        other[i] = False
        at = np.flatnonzero(other & (group != group[i]))
        if i and band and len(at):
            at = at[~(keys[at, :band] == keys[i, :band]).any(axis=1)]
        if not len(at):
            continue
        hit = at[bags.near(texts[i], texts[at], threshold)]
        if len(hit):
            joined = np.zeros(len(texts), bool)
            joined[group[hit]] = joined[group[i]] = True
            same = joined[group]
            group[same] = group[same].min()
    return group


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join what is similar within each bucket.

    members: key, x, y, own, class, keys, text, a row for each tile (x, y) of a
    bucket in which the class is.  A tile returns a spanning set of its links, never pairs.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(table: pa.Table) -> pa.RecordBatch:
        key, x, y, own, ids = (table.column(c).to_numpy() for c in ("key", "x", "y", "own", "class"))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        bags = Bags(text_bytes(table.column(TEXT).combine_chunks()))
        edge = np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]), len(ids)]
        found = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            band = int(np.argmax(keys[a] == key[a]))
            group = links_of(bags, keys[a:b], band, np.arange(a, b), own[a:b] == x[a], own[a:b] == y[a], threshold)
            linked = np.flatnonzero(group != np.arange(b - a))
            found.append((ids[a:b][group[linked]], ids[a:b][linked]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], schema=schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, size = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, x, y = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "x", "y"))
            length = batch.column(batch.schema.get_field_index("size")).to_numpy()
            start = 0
            for i in range(batch.num_rows):
                tile = key[i], x[i], y[i]
                if size > TILE_BYTES and tile != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield settle(pa.Table.from_batches(held))
                    held, size, start = [], 0, i
                last = tile
                size += int(length[i])
            held.append(batch.slice(start))
        if held:
            yield settle(pa.Table.from_batches(held))

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "class")
    return run(dealt, kernel, "a long, b long")


def classes_and_links(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and the classes of equal word sequences with their groups.

    rows: row, doc_id, text.  The classes: d1, d2, class (its first row), class_id
    (its smallest doc_id), best (its first row by doc_id) and root, the class that
    names its group.  Classes that share a band meet in that band's bucket, unless the
    same classes meet in an earlier one; a bucket is cut into blocks by rows and bytes, and each pair of blocks is a tile.
    """
    found = stored(sketches(rows, threshold))
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("row"))
    classes = found.where("d1 is not null").groupBy("d1", "d2").agg(F.min(F.struct(ROW, "size", "keys")).alias("one"), F.min("doc_id").alias("class_id"), F.min(best).alias("best"))
    classes = stored(classes.select("d1", "d2", F.col(f"one.{ROW}").alias("class"), "one.size", "one.keys", "class_id", "best"))
    bucketed = classes.select(F.posexplode("keys").alias("band", "key"), "class", "size")
    blocks = F.greatest(F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_BYTES)), F.lit(1)).cast("int")
    members = [F.count("*").alias("many"), F.min("class").alias("least"), F.max("class").alias("most"), *(F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"mark{k}") for k in (0, 1))]
    shared = bucketed.groupBy("key").agg(*members, F.min("band").alias("band"), blocks.alias("blocks")).where("many > 1")
    # Of buckets with the same members only the first band's would compare any pair.
    shared = shared.groupBy("many", "least", "most", "mark0", "mark1").agg(F.min(F.struct("band", "key", "blocks")).alias("one")).select("one.key", "one.blocks")
    dealt = bucketed.select("key", "class").join(shared, "key").withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    texts = rows.select(F.col(ROW).alias("class"), TEXT)
    placed = dealt.join(classes.select("class", "size", "keys"), "class").join(texts, "class")
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "class", "size", "keys", TEXT)
    roots = connected(compared(placed, threshold))
    with_root = classes.drop("size", "keys").join(roots, classes["class"] == roots["node"], "left").drop("node")
    return found.select(ROW, "doc_id", "d1", "d2"), stored(with_root.withColumn("root", F.coalesce("root", "class")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, group_id, kept: one row per document.

    Documents with the same words are one class; classes that share a band and whose
    shingles have a probability Jaccard similarity of ``threshold`` or more (to within
    1e-9) are linked, and linked classes make a group.  Ids of classes and groups
    are the smallest doc_id of their members; ``kept`` is true for one document of
    each group, its first by doc_id and then by row.  Null and empty texts and texts without words belong to
    no group but their own; an empty table gives no rows; repeated rows are members of one
    class; null ids sort last.  Long texts are taken whole.  Other columns are left out,
    whatever their names.  The input should be a stored table, since its rows are
    read again.
    """
    rows = steady(df).select(F.monotonically_increasing_id().alias(ROW), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias(TEXT))
    found, classes = classes_and_links(rows, threshold)
    groups = classes.groupBy("root").agg(F.min("class_id").alias("group_id"), F.min("best").alias("best"))
    named = classes.join(groups.withColumnRenamed("best", "first"), "root").select("d1", "d2", "class_id", "group_id", F.col("first.row").alias("first"))
    joined = found.where("d1 is not null").join(named, ["d1", "d2"]).select("doc_id", "class_id", "group_id", (F.col(ROW) == F.col("first")).alias("kept"))
    return joined.unionByName(found.where("d1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(True).alias("kept")))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that ``near_duplicates`` keeps, all columns as they are.

    Nulls, ties, repeated rows, long texts and empty tables: as there.  Columns may
    have any names.
    """
    numbered = steady(df).select(F.monotonically_increasing_id().alias(ROW), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__all"))
    rows = numbered.select(ROW, F.col(f"__all.`{id_col}`").cast("long").alias("doc_id"), F.col(f"__all.`{text_col}`").cast("string").alias(TEXT))
    found, classes = classes_and_links(rows, threshold)
    first = classes.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(ROW))
    first = first.unionByName(found.where("d1 is null").select(ROW))
    return numbered.join(first, ROW, "left_semi").select("__all.*")
