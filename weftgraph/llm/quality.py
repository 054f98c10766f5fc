"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded from what its bytes and
words look like; gated attention weighs the encodings, and the weighted sum is
scored.  Only document labels are learned from, so the attention finds by itself
which passages tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _rolling
from ._arrow import keyed, run, slices
from .repeats import text_bytes

PASSAGE_WORDS = 32
#: The model learns from this many labelled documents of each class at most, and from so many bytes of them; documents are taken whole.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1200, 24 << 20
HIDDEN, ATTENTION, STEPS, RATE, DECAY, SEED = 24, 16, 400, 0.01, 1e-3, 5

#: Byte classes: each ASCII sign by itself, letters, digits, white space and others together.
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.full(256, len(_SIGNS) + 5, np.int64)
for _i, _b in enumerate(_SIGNS):
    _CLASS[_b] = _i
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\n", " \t\r\v\f")):
    _CLASS[[ord(c) for c in _chars]] = len(_SIGNS) + _k
CLASSES = len(_SIGNS) + 6
FEATURES = CLASSES + 5


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the text of each; a text without words has one blank passage."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    start, end = _rolling.word_bounds(data)
    first = np.searchsorted(start, begin)
    count = np.searchsorted(start, begin + size) - first
    pieces = np.maximum(1, -(-count // PASSAGE_WORDS))
    base = np.cumsum(pieces) - pieces
    doc = np.repeat(np.arange(len(texts)), pieces)
    n = len(doc)
    word_doc = np.repeat(np.arange(len(texts)), count)
    word_piece = base[word_doc] + (np.arange(len(start)) - first[word_doc]) // PASSAGE_WORDS
    # A byte belongs to the passage of the last word begun; what comes before is the first passage's.
    byte_doc = np.repeat(np.arange(len(texts)), size + 1)
    begun = np.zeros(len(data), np.int64)
    begun[start] = 1
    begun = np.cumsum(begun) - 1
    piece = base[byte_doc]
    if len(start):
        piece = np.maximum(piece, np.where(begun >= 0, word_piece[begun], 0))
    out = np.zeros((n, FEATURES))
    out[:, :CLASSES] = np.bincount(piece * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    words = np.maximum(1, np.bincount(word_piece, minlength=n))
    out[:, :CLASSES] = np.sqrt(out[:, :CLASSES] / np.maximum(1, out[:, :CLASSES].sum(1, keepdims=True)))
    length = np.bincount(word_piece, end - start, n) / words
    spread = np.sqrt(np.maximum(0, np.bincount(word_piece, (end - start) ** 2, n) / words - length**2))
    if len(start):
        hashed = _rolling.word_units(data, start, end)
        order = np.lexsort((hashed, word_piece))
        p, h = word_piece[order], hashed[order]
        head = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (h[1:] != h[:-1])])
        times = np.diff(np.r_[head, len(p)])
        distinct = np.bincount(p[head], minlength=n) / words
        distinct[distinct == 0] = 1  # a blank passage, whatever stands beside it
        most = np.zeros(n)
        np.maximum.at(most, p[head], times)
        twice = np.r_[False, (hashed[1:] == hashed[:-1]) & (word_piece[1:] == word_piece[:-1])]
        again = np.bincount(word_piece, twice, n) / words
    else:
        distinct, most, again = np.ones(n), np.zeros(n), np.zeros(n)
    out[:, CLASSES:] = np.column_stack([np.log1p(length), np.log1p(spread), distinct, most / words, again])
    return out.astype(np.float32), doc


@dataclass
class Model:
    """Standardisation, encoder, gated attention and score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w["E"] + w["e"])

    def attend(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        t, g = np.tanh(h @ w["T"] + w["t"]), 1 / (1 + np.exp(-(h @ w["G"] + w["g"])))
        return t, g, (t * g) @ w["a"]

    def bags(self, x: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        h = self.encode(x)
        t, g, logit = self.attend(h)
        first = np.searchsorted(doc, np.arange(n))  # passages stand in the order of their texts, and each text has one
        top = np.maximum.reduceat(logit, first)
        raised = np.exp(logit - top[doc])
        share = raised / np.add.reduceat(raised, first)[doc]
        z = np.add.reduceat(share[:, None] * h, first, axis=0)
        score = 1 / (1 + np.exp(-(z @ self.weights["s"] + self.weights["b"][0])))
        return h, t, g, share, z, score

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, doc = passages(texts)
        return self.bags(x, doc, len(texts))[-1]


def gradient(model: Model, x: np.ndarray, doc: np.ndarray, label: np.ndarray, share_of: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the cross entropy, each document's divided by ``share_of``, in all weights."""
    w, n = model.weights, len(label)
    unit = np.clip((x - model.mean) / model.scale, -6, 6)
    h, t, g, share, z, score = model.bags(x, doc, n)
    d = (score - label) / share_of
    dz = d[:, None] * w["s"]
    dh = share[:, None] * dz[doc]
    pull = (dz[doc] * h).sum(1)
    dlogit = share * (pull - np.bincount(doc, share * pull, n)[doc])
    dt, dg = dlogit[:, None] * w["a"] * g * (1 - t * t), dlogit[:, None] * w["a"] * t * g * (1 - g)
    dh += dt @ w["T"].T + dg @ w["G"].T
    dh *= 1 - h * h
    return {"E": unit.T @ dh, "e": dh.sum(0), "T": h.T @ dt, "t": dt.sum(0), "G": h.T @ dg, "g": dg.sum(0), "a": (t * g).T @ dlogit, "s": z.T @ d, "b": np.array([d.sum()])}


def train(x: np.ndarray, doc: np.ndarray, label: np.ndarray) -> Model:
    """Fit by full-batch gradient steps with momentum and adaptive rates."""
    r = np.random.default_rng(SEED)
    draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"E": draw(x.shape[1], HIDDEN), "e": np.zeros(HIDDEN), "T": draw(HIDDEN, ATTENTION), "t": np.zeros(ATTENTION), "G": draw(HIDDEN, ATTENTION), "g": np.zeros(ATTENTION), "a": draw(ATTENTION), "s": draw(HIDDEN), "b": np.zeros(1)}
    x = x.astype(np.float64)
    some = x if len(x) else np.zeros((1, x.shape[1]))
    model = Model(some.mean(0), some.std(0) + 1e-3, w)
    if not len(label):  # nothing to learn from: all pass
        w["s"][:], w["b"][:] = 0, 10
        return model
    n = len(label)
    # Each class weighs half, whatever its share of the sample.
    share_of = np.bincount(label, minlength=2)[label] * max(1, len(set(label.tolist())))
    m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    for step in range(1, STEPS + 1):
        grad = gradient(model, x, doc, label, share_of)
        for k, p in w.items():
            grad[k] = grad[k] + DECAY * p / n if p.ndim == 2 else grad[k]
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id's text leaves 1 modulo 3; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from up to ``per_class`` labelled documents of each class that are not held out, with all their passages.

    The sample is the ids of least hash, as far as their texts have ``most_bytes`` in
    all, so it doesn't depend on the order of rows.  Labels other than 0 and 1, null ids and null texts are
    passed over; of several labels or texts for an id the least counts.  Without
    labels or documents every text scores near 1.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    sample = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    # At most twice per_class ids and labels, whatever the corpus.
    rows = keyed(documents, id_col, text_col).where("text is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(before)).where(F.col("bytes") <= most_bytes).drop("bytes")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts = text_bytes(batch.column(at("text")))
            blobs = []
            for a, b in slices(texts):
                x, doc = passages(texts[a:b])
                edge = np.searchsorted(doc, np.arange(b - a + 1))
                blobs += [x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(at("doc_id")), batch.column(at("label")), pa.array(blobs, pa.binary())], schema=schema)

    found = sorted(map(tuple, run(rows, kernel, "doc_id long, label int, x binary").collect()))
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for *_, x in found]
    doc = np.repeat(np.arange(len(bags)), list(map(len, bags)))
    return train(np.concatenate(bags) if bags else np.zeros((0, FEATURES)), doc, np.array([y for _, y, _ in found], np.int64))


def scorer(df: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``df`` with a column of scores, ``into``, which replaces one of that name.

    Whole texts are scored, long ones too; null texts score as empty ones, equal
    texts alike; an empty table gives no rows.
    """
    import pandas as pd

    def scored(batches):
        for s in batches:
            texts = [(t or "").encode() for t in s]
            yield pd.Series(np.concatenate([model.score(texts[a:b]) for a, b in slices(texts)]) if texts else [], dtype="float64")

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(into, F.pandas_udf(scored, "double")(F.col(text_col)))


def score(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document; repeated rows come through, other columns are left out."""
    model = fit(documents, labels, id_col, text_col)
    scored = scorer(keyed(documents, id_col, text_col), model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
