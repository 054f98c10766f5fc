"""Near-duplicate embeddings by int8 tile products with error bounds.

Equal vectors of a label are one class.  A label's classes are cut into blocks, and
each pair of blocks is a tile.  In a tile, products of int8-quantised unit vectors
(exact, as small integers) approximate all cosines at once; each vector's
quantisation error bounds how far off they can be, and only pairs that may reach
the threshold are computed in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected, steady, stored

THRESHOLD, BLOCK = 0.93, 2048
#: Room for the rounding of the approximation itself.
SLACK = 1e-5


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values (as floats that hold them exactly), scales and error norms of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - q * scale[:, None], axis=1)
    return q.astype(np.float32), scale, error


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows of x and y whose cosine is ``threshold`` or more."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex = quantise(x / nx[:, None])
    qy, sy, ey = quantise(y / ny[:, None])
    left, right = [], []
    for a in range(0, len(x), rows):
        b = slice(a, a + rows)
        near = (qx[b] @ qy.T) * (sx[b, None] * sy[None, :])
        # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, with |y| = 1 and |x'| <= 1 + |x - x'|.
        near += ex[b, None] + (1 + ex[b, None]) * ey[None, :]
        i, j = np.nonzero(near >= threshold - SLACK)
        i += a
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            sure = (x[p] * y[q]).sum(axis=1) / (nx[p] * ny[q]) >= threshold
            left.append(p[sure])
            right.append(q[sure])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new[root] == root).all():
            break
        root = new[root]
    return root


def link(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: links between vectors of equal label with cosine ``threshold`` or more.

    A vector that is null, zero, or holds null or non-finite components, or whose
    label is null, links with nothing and is its own component.  Repeated rows are
    vectors of their own and link with each other.  Vectors of different length do
    not link.  ``component_id`` is the smallest id reachable, itself included.
    Other columns are left out.  Tiles return counts and a spanning forest, never
    pairs, so a group of copies costs no more than its size.
    """
    rows = steady(df).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    good = F.col("e").isNotNull() & F.col("label").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    usable = rows.where(good)
    classes = stored(usable.groupBy("label", "e").agg(F.min("row").alias("class"), F.count("*").alias("many")))
    sizes = classes.groupBy("label", F.size("e").alias("dim")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.withColumn("dim", F.size("e")).join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    tiles = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("label", "dim", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "class", "many", "e")
    out = "class long, links long, root long"
    schema = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["class"].to_numpy()
        order = np.argsort(ids)
        ids, many, own = ids[order], table["many"].to_numpy()[order], table["own"].to_numpy()[order]
        flat = table["e"].combine_chunks()
        e = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        lo, hi = key[2].as_py(), key[3].as_py()
        x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        i, j = linked_pairs(e[x], e[y], threshold) if len(x) and len(y) else (x[:0], y[:0])
        i, j = x[i], y[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, many[j])
        np.add.at(links, j, many[i])
        root = forest(len(ids), i, j)
        some = np.flatnonzero(links > 0)
        return pa.table([pa.array(c[some]) for c in (ids, links, ids[root])], schema=schema)

    judged = stored(tiles.groupBy("label", "dim", "x", "y").applyInArrow(tile, out))
    counts = judged.groupBy("class").agg(F.sum("links").alias("links"))
    roots = connected(judged.select(F.col("class").alias("a"), F.col("root").alias("b")))
    of_row = usable.join(classes, ["label", "e"]).select("row", "class", "many")
    members = rows.select("row", "vec_id").join(of_row, "row", "left").withColumn("class", F.coalesce("class", "row"))
    members = members.join(counts, "class", "left").join(roots, members["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class"))
    smallest = members.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    full = members.join(smallest, "root")
    return full.select("vec_id", (F.coalesce("many", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(threshold: float = THRESHOLD) -> str:
    return f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {threshold}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) = vec_id AS kept
FROM embeddings"""
