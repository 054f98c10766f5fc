"""Shard placement by a permutation-filled lookup table.

Every shard walks its own permutation of the slots of a table of prime size
(start offset and stride come from two hashes of its name); shards take turns
claiming their next free slot until all are taken.  The table depends on the
shard names alone, slots differ by at most one between shards, and removing a
shard moves few of the others' slots.  Rows find their shard with one hash and
one lookup in the broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 8191
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _draw(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Index of the owning shard for each slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("one or more distinct shards, no more than slots, are needed")
    at = [_draw(s, "offset") % slots for s in shards]
    stride = [_draw(s, "stride") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text (null: the empty text)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Shard of each row: its key with slot int and shard int.

    Native and map-only: the lookup table has ``slots`` rows, whatever the data,
    and is broadcast.  Rows map one to one, repeated rows included; a null key
    has the slot of the empty text; other columns are left out.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(fill_table(shards, slots))), "slot int, shard int")
    keyed = df.select(F.col(key_col).alias("doc_id"), slot_of(F.col(key_col), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def oracle(table: str = "documents", key: str = "doc_id") -> str:
    lookup = ",".join(map(str, fill_table()))
    slot = f"CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS}"
    return f"WITH t AS (SELECT [{lookup}] AS owners), k AS (SELECT {key} AS doc_id, CAST({slot} AS INTEGER) AS slot FROM {table}) SELECT doc_id, slot, CAST(owners[slot + 1] AS INTEGER) AS shard FROM k, t"
