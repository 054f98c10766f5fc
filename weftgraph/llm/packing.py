"""Bounded-space online packing of token streams into fixed-size sequences.

Each partition keeps a fixed number of open windows.  A document goes where it
fits best; if it fits nowhere, the fullest window takes as much of it as it holds
and is emitted full, and the rest goes on.  What is open at the end of a partition
is chained into full sequences; the few tokens left (under one sequence a
partition) meet those of other partitions, and the very last of a group are cut
at powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import batch_of, columns, keyed, run, slices
from .bpe import byte_letters

SEQUENCE, OPEN, END_ID = 4096, 32, 2
#: Partitions whose leftovers are merged together: at most this many sequences meet in a task.
GROUP = 64

#: Chunks whose letters have the same lower case one by one as together; others go to the library whole.
SIMPLE = re.compile("[!-~\xa1-\u024f]*").fullmatch
#: The vocabulary's splitter (a fixed value of its file) where only lower-case ASCII is met, and the line breaks that part chunks.
ASCII_SPLIT = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+").findall
#: Parts the ids of chunks: no four bytes in a row of small ids read like that.
APART = b"\xff" * 4
#: Chunks and words that a generation remembers, and the characters up to which they are: an entry takes about 180 bytes and never over 2 KB.
CHUNKS, WORDS, LONG = 200_000, 100_000, 64

Piece = tuple[int, int, bytes, int]  # document, start, ids, tokens of the document


class Remembered:
    """Ids of short texts, in two generations of at most ``most`` entries or what one call takes."""

    def __init__(self, most: int, learn: Callable[[list[str]], Iterable[bytes]]):
        self.most, self.learn = most, learn
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, parts: list[list[str]]) -> list[bytes]:
        """The ids of each list of texts, end to end."""
        need = set()
        for p in parts:
            need.update(p)
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = need - known.keys()
        if again := new & old.keys():
            new -= again
            known.update(zip(again, map(old.__getitem__, again), strict=True))
        learnt = list(new)
        known.update(zip(learnt, self.learn(learnt), strict=True))
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for c in [c for c in learnt if len(c) > LONG]:
            del known[c]
        return out


class WordIds:
    """Ids of whole texts by the tokenizers library, remembered by space-separated chunk.

    The vocabulary's normaliser and splitter never join text across white space, so
    chunks are encoded apart, by the library's model word by word.
    """

    def __init__(self, path: str, chunks: int = CHUNKS, words: int = WORDS):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(f"\n|{pattern}").findall
        self.letters = {b: c for c, b in byte_letters().items()}
        self.raw = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size(with_added_tokens=True))]
        if any(APART in a + b for a in (self.raw[-1], self.raw[0]) for b in (self.raw[-1], self.raw[0])) or len(self.raw) > 0xFF00:
            raise ValueError("the vocabulary is too large for this encoder")
        self.tokens = self.lib.model.tokenize
        self.chunks, self.words = Remembered(chunks, self._chunks), Remembered(words, self._words)

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of normalised words by the library's model."""
        raw, tokens, letters = self.raw, self.tokens, self.letters
        for w in words:
            if w == "\n":
                yield APART
                continue
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(letters)
            yield b"".join([raw[t.id] for t in tokens(w)])

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, by way of its words; all chunks of a kind are split at once."""
        special = [s for s in self.special if s in "\n".join(chunks)]
        out: list[bytes] = [b""] * len(chunks)
        plain: list[int] = []
        simple: list[int] = []
        for k, c in enumerate(chunks):
            if c.isascii() and c.isprintable() and not special:
                plain.append(k)
            elif SIMPLE(c) and not any(s in c for s in special):
                simple.append(k)
            else:
                out[k] = b"".join([self.raw[i] for i in self.lib.encode(c, add_special_tokens=False).ids])
        for kind, split in ((plain, ASCII_SPLIT), (simple, self.split)):
            if kind:
                joined = unicodedata.normalize("NFC", "\n".join([chunks[k] for k in kind])).lower()
                ids = self.words.of([split(joined)])[0].split(APART)
                for k, i in zip(kind, ids, strict=True):
                    out[k] = i
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        cut = []
        for t in texts:
            for c in "\t\n\v\f\r":
                if c in t:
                    t = t.replace(c, " ")
            cut.append(t.split(" "))
        return self.chunks.of(cut)


@functools.lru_cache(maxsize=1)
def shared(path: str) -> WordIds:
    """One table of ids for a worker process, which serves all its tasks."""
    return WordIds(path)


class Packer:
    """Sequences of one partition; ``place`` and ``close`` return finished ones as lists of pieces."""

    def __init__(self, size: int = SEQUENCE, most_open: int = OPEN):
        self.size, self.most = size, most_open
        self.windows: list[list[Piece]] = []
        self.used: list[int] = []

    def _emit(self, k: int) -> list[Piece]:
        self.used.pop(k)
        return self.windows.pop(k)

    def place(self, doc: int, ids: bytes) -> Iterator[list[Piece]]:
        total, start = len(ids) // 4, 0
        while (left := total - start) > 0:
            fits = [k for k, u in enumerate(self.used) if u + left <= self.size]
            if fits:
                k = max(fits, key=self.used.__getitem__)
            elif left < self.size and len(self.used) < self.most or not self.used:
                self.windows.append([])
                self.used.append(0)
                k = len(self.used) - 1
            else:
                k = max(range(len(self.used)), key=self.used.__getitem__)
            n = min(left, self.size - self.used[k])
            self.windows[k].append((doc, start, ids[4 * start : 4 * (start + n)], total))
            self.used[k] += n
            start += n
            if self.used[k] == self.size:
                yield self._emit(k)

    def close(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Full sequences chained from what is open, and the pieces left."""
        return chain([p for w in self.windows for p in w], self.size)


def chain(pieces: list[Piece], size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of the pieces in turn, and the rest."""
    full, now, used = [], [], 0
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            part = ids[at : at + 4 * (size - used)]
            now.append((doc, start + at // 4, part, total))
            used, at = used + len(part) // 4, at + len(part)
            if used == size:
                full.append(now)
                now, used = [], 0
    return full, now


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences of power-of-two sizes, largest first, that hold the pieces exactly."""
    out, rest = [], pieces
    left = sum(len(p[2]) for p in pieces) // 4
    for bit in range(left.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            full, rest = chain(rest, 1 << bit)
            out.append(full[0])
            rest = [p for s in full[1:] for p in s] + rest
    return out


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _rows(sequence: int, pieces: list[Piece], with_ids: bool) -> list[tuple]:
    out, at = [], 0
    for doc, start, ids, total in pieces:
        out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at, ids if with_ids else None))
        at += len(ids) // 4
    return out


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, most_open: int = OPEN, with_ids: bool = True) -> DataFrame:
    """Pack all texts, each followed by the end id, into sequences of ``size`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``with_ids``, ids (little-endian 32-bit).  A null
    text counts as empty and still has its end id; repeated rows are documents of
    their own; an empty table gives no rows; other columns are left out.  Texts are
    encoded once where they are read; only pieces are shuffled, and at most
    ``GROUP`` partitions' leftovers, each under one sequence, meet in a task.
    Sequence ids follow the input partitions, so a recomputed task repeats them.
    """
    first = pa.schema([*SCHEMA, pa.field("lot", pa.int64()), pa.field("left", pa.bool_())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer, made = shared(vocabulary), Packer(size, most_open), 0
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            for a, b in slices(texts):
                rows = []
                for doc, raw in zip(ids[a:b], encoder.encode([t or "" for t in texts[a:b]]), strict=True):
                    for s in packer.place(doc, raw + END_ID.to_bytes(4, "little")):
                        rows += [(*r, part * 1_000_003 + made, False) for r in _rows(part << 32 | made, s, with_ids)]
                        made += 1
                if rows:
                    yield batch_of(first, list(zip(*rows, strict=True)))
        full, rest = packer.close()
        rows = []
        for s in full:
            rows += [(*r, part * 1_000_003 + made, False) for r in _rows(part << 32 | made, s, with_ids)]
            made += 1
        rows += [(*r, -1 - part // GROUP, True) for r in _rows(part, rest, True)]
        if rows:
            yield batch_of(first, list(zip(*rows, strict=True)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: dict[int, list] = {}
        for batch in batches:
            left = batch.column(9)
            done = batch.filter(pa.compute.invert(left))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays(done.columns[:8], schema=SCHEMA)
            for r in batch.filter(left).to_pylist():
                lots.setdefault(r["lot"], []).append((r["sequence_id"], r["offset"], (r["doc_id"], r["start"], r["ids"], r["doc_tokens"])))
        for lot, held in lots.items():
            full, rest = chain([p for *_, p in sorted(held, key=lambda h: h[:2])], size)
            rows = []
            for k, s in enumerate([*full, *powers(rest)]):
                rows += _rows(1 << 60 | (-1 - lot) << 32 | k, s, with_ids)
            yield batch_of(SCHEMA, list(zip(*rows, strict=True)))

    import pyarrow.compute  # noqa: F401

    pieces = run(keyed(df, id_col, text_col), fill, PIECES + ", lot long, left boolean")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = run(pieces.repartition(n, "lot"), merge, PIECES)
    return out if with_ids else out.drop("ids")
