"""The attention model against loops and difference quotients."""

import math

import numpy as np
import pytest

from weftgraph.llm import quality

TEXTS = [b"one two three four. five", b"", b"x" * 40 + b" !!", b" ".join(b"w%d" % (i % 9) for i in range(100)), b"A b C d 1 2 3\nline"]


def model() -> tuple[quality.Model, np.ndarray, np.ndarray]:
    x, doc = quality.passages(TEXTS)
    r = np.random.default_rng(1)
    f, h, a = x.shape[1], 3, 2
    w = {"E": r.normal(size=(f, h)), "e": r.normal(size=h), "T": r.normal(size=(h, a)), "t": r.normal(size=a), "G": r.normal(size=(h, a)), "g": r.normal(size=a), "a": r.normal(size=a), "s": r.normal(size=h), "b": r.normal(size=1)}
    x = x.astype(np.float64)
    return quality.Model(x.mean(0), x.std(0) + 1e-3, w), x, doc


def slow_score(m: quality.Model, passages: list) -> float:
    w, logits, encoded = m.weights, [], []
    for p in passages:
        unit = [min(6.0, max(-6.0, (p[i] - m.mean[i]) / m.scale[i])) for i in range(len(p))]
        h = [math.tanh(sum(unit[i] * w["E"][i, j] for i in range(len(p))) + w["e"][j]) for j in range(len(w["e"]))]
        logit = 0.0
        for k in range(len(w["t"])):
            t = math.tanh(sum(h[j] * w["T"][j, k] for j in range(len(h))) + w["t"][k])
            g = 1 / (1 + math.exp(-(sum(h[j] * w["G"][j, k] for j in range(len(h))) + w["g"][k])))
            logit += t * g * w["a"][k]
        logits.append(logit)
        encoded.append(h)
    share = [math.exp(x) for x in logits]
    z = [sum(s * h[j] for s, h in zip(share, encoded)) / sum(share) for j in range(len(w["s"]))]
    return 1 / (1 + math.exp(-(sum(z[j] * w["s"][j] for j in range(len(z))) + w["b"][0])))


def test_scores_agree_with_loops():
    m, x, doc = model()
    want = [slow_score(m, x[doc == k].tolist()) for k in range(len(TEXTS))]
    assert np.allclose(m.bags(x, doc, len(TEXTS))[-1], want, atol=1e-12)
    assert np.allclose(m.score(TEXTS), want, atol=1e-6)  # features are kept as 32-bit floats
    assert len(doc) == 8 and np.allclose([m.score([t])[0] for t in TEXTS], m.score(TEXTS))


def test_gradient_agrees_with_difference_quotients():
    m, x, doc = model()
    label, share = np.array([0, 1, 0, 1, 1]), np.array([2, 3, 2, 3, 3])

    def loss() -> float:
        s = m.bags(x, doc, len(label))[-1]
        return float(-((label * np.log(s) + (1 - label) * np.log(1 - s)) / share).sum())

    found = quality.gradient(m, x, doc, label, share)
    for k, w in m.weights.items():
        for at in [tuple(0 for _ in w.shape), tuple(n - 1 for n in w.shape)]:
            held = w[at]
            w[at] = held + 1e-6
            up = loss()
            w[at] = held - 1e-6
            down = loss()
            w[at] = held
            assert found[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_sample_takes_whole_documents_within_its_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * (2000 if i % 7 == 0 else 10 + i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert quality.fit(docs, labels, most_bytes=5000).mean.shape == (quality.FEATURES,)
    assert quality.fit(docs, labels, most_bytes=0).score([b"any"])[0] > 0.99


def test_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, "s"), (1, None, "s")], "doc_id long, text string, score string")
    rows = quality.score(one, labels).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].predicted == 1
