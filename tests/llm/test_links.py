"""Pairs that share a band are compared exactly, whatever their signatures say."""

import random

import numpy as np
import pytest

from weftgraph.llm import minhash


def heavy_pair() -> list[bytes]:
    """Similar texts with a shingle that comes often."""
    words = ["again"] * 9 + [f"w{i}" for i in range(200)]
    return [" ".join(words).encode(), " ".join([*words[:-8], *(f"v{i}" for i in range(8))]).encode()]


def linked(texts, keys, band=0, left=None, right=None, threshold=0.8):
    n = len(texts)
    every = np.ones(n, bool)
    return minhash.links_of(minhash.Bags(texts), keys, band, np.arange(n), every if left is None else left, every if right is None else right, threshold).tolist()


def test_pair_of_heavy_texts_is_compared_exactly():
    texts = heavy_pair()
    assert minhash.similarity(*texts) >= 0.8
    assert linked(texts, np.array([[1, 2], [1, 3]])) == [0, 0]


def plain(a: bytes, b: bytes, width: int = 5) -> float:
    """Probability Jaccard by its definition, over shingles as tuples of words."""
    bags = []
    for text in (a, b):
        words = text.split()
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        bags.append({g: grams.count(g) for g in grams})
    x, y = bags
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def test_similarities_agree_with_the_definition():
    r = random.Random(4)
    texts = [" ".join(r.choice("ab") * r.choice((1, 1, 2)) for _ in range(r.randint(1, 60))).encode() for _ in range(60)]
    texts += [t + b" c c c c" * k for k, t in enumerate(texts[:20])] + [b"one", b"one two", b"one two three four five"]
    bags = minhash.Bags(texts)
    n = len(texts)
    want = np.array([[plain(a, b) for b in texts] for a in texts])
    for threshold in (0.05, 0.3, 0.6, 0.8, 1.0):
        got = np.array([bags.near(i, np.arange(n), threshold) for i in range(n)])
        assert (got == (want >= threshold - 1e-9)).all()
    assert abs(minhash.similarity(texts[0], texts[1]) - want[0, 1]) < 1e-12


def test_gathering_in_parts_changes_nothing(monkeypatch):
    texts = [b" ".join(b"%d" % (i * (k % 7 + 1) % 50) for i in range(80)) for k in range(30)]
    whole = [minhash.Bags(texts).near(i, np.arange(30), 0.5).tolist() for i in range(30)]
    monkeypatch.setattr(minhash, "GATHER", 100)
    assert whole == [minhash.Bags(texts).near(i, np.arange(30), 0.5).tolist() for i in range(30)]


def test_pairs_belong_to_the_first_band_that_they_share():
    texts = heavy_pair()
    texts = [b"another text of no use at all", *texts]
    keys = np.array([[1, 2], [3, 2], [3, 2]])
    assert linked(texts, keys, band=1) == [0, 1, 2]  # bucket 3 links the last two
    assert linked(texts[1:], keys[1:], band=0) == [0, 0]
    side = np.array([True, False, True])
    assert linked(texts, keys[:, 1:], left=side, right=~side) == [0, 1, 1]


@pytest.mark.parametrize("tile", [1, 3, 1024])
def test_groups_agree_with_all_pairs(spark, tmp_path, monkeypatch, tile):
    """Tiles of any size find the components of all banded pairs that are similar enough."""
    monkeypatch.setattr(minhash, "TILE", tile)
    r = random.Random(8)
    base = [f"w{r.randint(0, 400)}" for _ in range(120)]
    texts = []
    for _ in range(60):  # near copies at different distances, some of them linked only through others
        words = list(base)
        for _ in range(r.choice((0, 1, 3, 5, 9))):
            words[r.randrange(120)] = f"v{r.randint(0, 10**6)}"
        texts.append(" ".join(words))
    texts += ["a " * k for k in range(20)] + ["", None, " \n", texts[0], texts[0]]
    raw = [(t or "").encode() for t in texts]
    keys = minhash.bands(minhash.sign(*minhash.shingles(raw), len(raw)))
    group = list(range(len(raw)))
    for i in range(len(raw)):
        for j in range(i):
            if raw[i].split() and raw[j].split() and (keys[i] == keys[j]).any() and minhash.similarity(raw[i], raw[j]) >= 0.8 - 1e-9:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    rows = minhash.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert {x.doc_id: x.group_id for x in rows} == dict(enumerate(group))
    assert sorted(x.group_id for x in rows if x.kept) == sorted(set(group)) and len(set(group)) < 60
    assert {x.doc_id: x.class_id for x in rows}[len(texts) - 1] == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 0.95])
def test_bands_follow_the_threshold(threshold):
    missed = lambda t, n: (1 - t**minhash.ROWS) ** n
    assert missed(threshold, minhash.bands_for(threshold)) <= missed(0.8, 24) * (1 + 1e-9)
    assert minhash.bands_for(0.8) == 24


def test_lower_threshold_finds_its_pairs(spark, tmp_path):
    shared = [[f"a{k}x{i}" for i in range(75)] for k in range(40)]
    texts = [" ".join([*s, *(f"{side}{k}x{i}" for i in range(25))]) for k, s in enumerate(shared) for side in ("b", "c")]
    assert all(0.5 <= minhash.similarity(texts[2 * k].encode(), texts[2 * k + 1].encode()) < 0.8 for k in range(40))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    rows = minhash.near_duplicates(spark.read.parquet(str(tmp_path / "t")), threshold=0.5).collect()
    assert {r.doc_id: r.group_id for r in rows} == {i: i // 2 * 2 for i in range(80)}
