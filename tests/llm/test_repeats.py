"""Repeated windows against brute force, on texts that overlap in many ways."""

import hashlib
import random
import re
from collections import Counter

import pytest

from weftgraph.llm import substrings, suffix_dedup, suffixes

SCHEMA = "doc_id long, text string, n_words string, __ranges int"


def corpus(seed: int, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    words = ["the", "of", "ab", "xy", "naïve", "日本", "q"]
    base = [" ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(r.randint(0, 150))) for _ in range(12)]
    out: list[str | None] = [None, "", " ", "one", "a" * 900, "b" * 150 + "c" + "b" * 150]
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 3)):
            b = r.choice(base).split(" ")
            a = r.randint(0, len(b))
            parts += b[a : a + r.randint(1, 120)]
            if r.random() < 0.5:
                parts += [f"u{r.randint(0, 10**6)}" for _ in range(r.randint(1, 6))]
        out.append(r.choice([" ", "\n", "  "]).join(parts))
    out += [out[-1], out[-2]]
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "clash", i) for i, t in enumerate(texts)], SCHEMA)


def removed(units: list, window: int) -> list[list[bool]]:
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        hit = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                hit[i : i + window] = [True] * window
        out.append(hit)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, tmp_path, seed):
    texts = corpus(seed)
    frame(spark, texts).write.parquet(str(tmp_path / "t"))
    got = substrings.dedup(spark.read.parquet(str(tmp_path / "t")), digests=True).collect()
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    want = [(i if i != 3 else None, len(w), sum(h), hashlib.sha256(" ".join(x for x, y in zip(w, h) if not y).encode()).hexdigest()) for i, (w, h) in enumerate(zip(words, removed(words, 35)))]
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize(("seed", "most"), [(1, 2000), (2, 1)])
def test_bytes(spark, tmp_path, seed, most):
    texts = corpus(seed)
    frame(spark, texts).write.parquet(str(tmp_path / "t"))
    got = suffix_dedup.dedup(spark.read.parquet(str(tmp_path / "t")), digests=True, most=most).collect()
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, (b, h) in enumerate(zip(raw, removed([list(b) for b in raw], 200))):
        spans = sum(y and not x for x, y in zip([False, *h], h))
        want.append((i if i != 3 else None, len(b), sum(h), spans, hashlib.sha256(bytes(x for x, y in zip(b, h) if not y)).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substrings.dedup(empty).collect() == []
    assert suffix_dedup.dedup(empty).collect() == []


def test_clean_keeps_columns(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"start one {passage} end\none", "x", 1), (2, f"other {passage}", None, 2), (3, "a  b\nc ", "y", 3), (4, None, "z", 4)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r for r in substrings.clean(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert [got[k].text for k in (1, 2, 3, 4)] == ["start one end\none", "other", "a  b\nc ", None]
    assert got[1].n_words == "x" and got[4]["__ranges"] == 4


@pytest.mark.parametrize("seed", range(4))
def test_suffix_sorting(seed):
    r = random.Random(seed)
    for _ in range(120):
        letters = r.choice(["a", "ab", "abcdefgh"])
        pieces = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))).encode() for _ in range(r.randint(1, 6))]
        window = r.choice([1, 2, 3, 9, 20])
        seen = Counter(p[i : i + window] for p in pieces for i in range(len(p) - window + 1))
        want, at = [], 0
        for p in pieces:
            want += [at + i for i in range(len(p) - window + 1) if seen[p[i : i + window]] > 1]
            at += len(p) + 1
        # A queue of 100 bytes spills nearly everything to disk.
        assert suffixes.repeated_starts(pieces, window, memory=r.choice([100, 1 << 20])).tolist() == want
