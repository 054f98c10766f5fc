"""Removal of word passages that occur more than once: Rabin-Karp windows counted in Spark."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .components import steady
from .repeats import ROW, TEXT

WINDOW, GRAM = 35, 6
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def find(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row, start, n: ranges of starts of repeated windows of numbered rows."""
    hits = repeats.repeated_groups(repeats.groups(rows, window, gram, words=True))
    sure = hits.where("sure").select(ROW, "start", "n")
    return sure.unionByName(repeats.count_windows(rows, hits.where("not sure"), window, words=True))


def kept_words(raw: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, list[bytes]]:
    """Number of words, number removed, and the words kept."""
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    for a, b in reversed(runs):
        del words[a:b]
    return n, n - len(words), words


def cut_text(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of the runs and the white space after them."""
    if not runs:
        return raw
    lead = len(raw) - len(raw.lstrip())
    parts = TOKEN.findall(raw[lead:])
    for a, b in reversed(runs):
        del parts[a:b]
    return (raw[:lead] + b"".join(parts)).rstrip() if parts else b""


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digests: bool = False) -> DataFrame:
    """Words of each text that lie in no repeated window of ``window`` words.

    Words are runs without ASCII white space; a window is repeated if the same
    words start anywhere else, in the same document or another; all occurrences go.
    Returns doc_id, n_words, n_removed and either kept string (words joined by one
    space) and runs array<struct<start, end>> of removed words, or with
    ``digests`` kept_sha256.  Null and empty texts have no words; repeated rows
    repeat each other's windows; other columns are left out.  The input should be
    a stored table, since its rows are read more than once.
    """
    rows = repeats.numbered(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text").select(ROW, "doc_id", TEXT)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rest = [("kept_sha256", pa.string())] if digests else [("kept", pa.string()), ("runs", run_type)]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), *rest])

    def emit(batch: pa.RecordBatch, texts: list[bytes], runs: list) -> pa.RecordBatch:
        kept = [kept_words(t, r) for t, r in zip(texts, runs, strict=True)]
        cols = [batch.column(batch.schema.get_field_index("doc_id")), [k[0] for k in kept], [k[1] for k in kept]]
        if digests:
            cols.append([hashlib.sha256(b" ".join(k[2])).hexdigest() for k in kept])
        else:
            cols += [[b" ".join(k[2]).decode() for k in kept], [[{"start": a, "end": b} for a, b in r] for r in runs]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    out = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digests else "kept string, runs array<struct<start: long, end: long>>")
    return repeats.apply(rows, find(rows, window), window, emit, out)


def clean(df: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with repeated passages cut from a text column; other columns and rows stay, null texts too."""
    names = df.columns
    others = [c for c in names if c != text_col]
    rows = steady(df).select(F.monotonically_increasing_id().alias(ROW), F.col(text_col).alias(TEXT), F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("__held")).alias("__others"))

    def emit(batch: pa.RecordBatch, texts: list[bytes], runs: list) -> pa.RecordBatch:
        at = batch.schema.get_field_index
        null = batch.column(at(TEXT)).is_null().to_pylist()
        cut = [None if z else cut_text(t, r) for t, r, z in zip(texts, runs, null, strict=True)]
        held = dict(zip(others, batch.column(at("__others")).flatten(), strict=False))
        held[text_col] = pa.array(cut, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([held[c] for c in names], names=names)

    return repeats.apply(rows, find(rows.select(ROW, TEXT), window), window, emit, df.schema)
