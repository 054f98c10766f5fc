"""Secret scans: keyword automaton, anchored patterns near its hits, checksums.

One Aho-Corasick pass over a text finds the places where a secret can start; the
patterns are then tried there only, anchored.  Kinds with an embedded checksum
are kept when it holds.  Runs of hex digits have no keyword; they come from run
lengths over the bytes.  All is done on UTF-8 bytes (every pattern is ASCII) and
spans are given in code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import batch_of, columns, keyed, run, slices

#: The kinds in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "forge", "package")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Access tokens of code forges and package registries: 30 characters and the CRC-32 of these in six base-62 digits.
SUMMED = {"forge": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")), "package": (("npm_",), re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"))}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

IS_HEX = np.zeros(256, bool)
IS_HEX[[*b"0123456789abcdef"]] = True


def checksum(body: bytes) -> bytes:
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.encode()


class Scanner:
    def __init__(self):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for w in WORDS:
            self.auto.add_word(w, ("assign", len(w)))
        self.auto.add_word("akia", ("access", 4))
        for kind, (heads, _) in SUMMED.items():
            for h in heads:
                self.auto.add_word(h, (kind, len(h)))
        self.auto.make_automaton()

    def hits(self, raw: bytes) -> Iterator[tuple[str, int]]:
        """Kind and start of each keyword, by end position; of one kind, starts ascend."""
        for end, (kind, size) in self.auto.iter(raw.lower().decode("latin-1")):
            yield kind, end + 1 - size

    def byte_spans(self, raw: bytes) -> list[tuple[str, int, int]]:
        found, over = [], dict.fromkeys(KINDS, 0)
        for kind, at in self.hits(raw):
            if at < over[kind]:
                continue
            if kind == "assign":
                if m := ASSIGN.match(raw, at):
                    over[kind] = m.end()
                    if len(m[2]) >= LEAST_VALUE:
                        found.append((kind, at, m.end()))
            elif kind == "access":
                if m := ACCESS.match(raw, at):
                    over[kind] = m.end()
                    if m.end() - at >= LEAST_ACCESS:
                        found.append((kind, at, m.end()))
            elif (m := SUMMED[kind][1].match(raw, at)) and checksum(m[1]) == m[2]:
                over[kind] = m.end()
                found.append((kind, at, m.end()))
        data = np.frombuffer(raw, np.uint8)
        if len(data) >= LEAST_HEX:
            edge = np.flatnonzero(np.diff(IS_HEX[data].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            long_ = np.flatnonzero(edge[1::2] - edge[::2] >= LEAST_HEX)
            found += [("hex", int(edge[2 * i]), int(edge[2 * i + 1])) for i in long_]
        return found

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then kind as listed."""
        raw = text.encode()
        found = self.byte_spans(raw)
        if found and len(raw) != len(text):
            at = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
            found = [(k, int(at[a]), int(at[b])) for k, a, b in found]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each secret, overlaps merged, replaced by its first kind's name."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Secrets of each whole text.

    Returns doc_id and spans array<struct<kind, start, end>>, or with ``digests``
    the counts, the hash of the base spans and all spans as text.  Null and empty
    texts have no spans.  Map-only; repeated rows come through; other columns are
    left out.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    fields = [("doc_id", pa.int64())]
    fields += [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())] if digests else [("spans", pa.list_(span))]
    schema = pa.schema(fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            for a, b in slices(texts, most=1 << 23):
                found = [scanner.spans(t or "") for t in texts[a:b]]
                if digests:
                    base = [[s for s in f if s[0] in KINDS[:3]] for f in found]
                    rest = [*([sum(s[0] == k for s in f) for f in base] for k in KINDS[:3]), [hashlib.sha256(joined(f).encode()).hexdigest() for f in base], list(map(joined, found))]
                else:
                    rest = [[[{"kind": k, "start": x, "end": y} for k, x, y in f] for f in found]]
                yield batch_of(schema, [ids[a:b], *rest])

    out = "doc_id long, " + ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string" if digests else "spans array<struct<kind: string, start: long, end: long>>")
    return run(keyed(df, id_col, text_col), kernel, out)


def mask_column(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets of a text column masked; all columns stay, nulls too."""
    from pyspark.sql import functions as F

    def masked(batches):
        scanner = Scanner()
        for s in batches:
            yield s.map(lambda t: t if t is None else mask(t, scanner.spans(t)))

    import pandas as pd

    masked.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(text_col, F.pandas_udf(masked, "string")(F.col(text_col)))
