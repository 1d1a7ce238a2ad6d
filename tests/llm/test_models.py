"""The learnt models against naive versions of what they compute."""

import math
import random

import numpy as np
import pytest
from siltlake.llm import quality, toxicity
from test_edges import EDGE, text


def naive_bag(words, length):
    """Sum over words of the mean over their grams' one-hot vectors, by ``length``."""
    out = np.zeros(toxicity.BUCKETS)
    for w in words:
        _, b = toxicity.grams([w])
        for x in b.tolist():
            out[x] += 1 / len(b) / length
    return out


def test_grams_are_those_of_each_word():
    words = ["a", "idiot", "idiots", "é", "w" * 30]
    at, bucket = toxicity.grams(words)
    for k, w in enumerate(words):
        own = toxicity.grams([w])[1]
        assert sorted(bucket[at == k].tolist()) == sorted(own.tolist())
        assert len(own) == sum(max(0, len(w) + 3 - n) for n in toxicity.GRAMS) + 1
    shared = set(toxicity.grams(["idiot"])[1]) & set(toxicity.grams(["idiots"])[1])
    assert len(shared) >= 6  # an unseen misspelling has most of the vectors
    assert len(toxicity.grams([])[0]) == 0


def model(seed=1):
    m = toxicity.start(seed)
    m.offsets[:] = 0.3, -0.2
    m.scale = 2.0
    return m


def test_score_is_the_softmax_of_the_averaged_bag_of_the_worst_window():
    m, r = model(), random.Random(4)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "idiot", "x"]) for _ in range(n)) for n in (1, 3, 8, 9, 40)] + ["", None]
    for t, s in zip(texts, m.score(texts), strict=True):
        words, best = (t or "").split(), -math.inf
        size = min(toxicity.WINDOW, len(words))
        for k in range(max(1, len(words) - size + 1)):
            own = [w for j, w in enumerate(words[k : k + size], k) if w not in words[max(0, j - toxicity.WINDOW + 1) : j]]
            z = naive_bag(own, max(1, size)) @ m.embedding.astype("f8") * m.scale @ m.weights.astype("f8") + m.offsets
            best = max(best, np.exp(z[1]) / np.exp(z).sum())
        assert s == pytest.approx(best, rel=1e-6)


def test_bags_are_averages():
    words = ["one", "two", "idiot"]
    keys, v = toxicity.bag(words, 3)
    dense = np.zeros(toxicity.BUCKETS)
    dense[keys] = v
    assert dense == pytest.approx(naive_bag(words, 3), rel=1e-5) and v.sum() == pytest.approx(1, rel=1e-5)


def test_gradients_by_finite_differences():
    m = model()
    m.embedding, m.weights, m.offsets = (x.astype("f8") for x in (m.embedding, m.weights, m.offsets))
    bags, y = [toxicity.bag(t.split(), 4) for t in ("one two", "idiot here now", "", "two idiot")], np.array([0, 1, 0, 1])
    bags = [(k, v.astype("f8")) for k, v in bags]
    _, grads = toxicity.gradients(m, bags, y)
    for x, g in zip((m.embedding, m.weights, m.offsets), grads, strict=True):
        at = np.argsort(-np.abs(g).ravel())[:8]
        for k in at.tolist():
            old, e = x.ravel()[k], 1e-5
            x.ravel()[k] = old + e
            up = toxicity.gradients(m, bags, y)[0]
            x.ravel()[k] = old - e
            down = toxicity.gradients(m, bags, y)[0]
            x.ravel()[k] = old
            assert g.ravel()[k] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-9)


def test_training_joins_misspellings():
    r, bad = random.Random(3), ["grumblat", "vilestic", "zorgfink"]
    rows = [(text(i, 12).split() + [r.choice(bad)] * (i % 2), i % 2) for i in range(300)]
    m = toxicity.start()
    toxicity.train(m, [(k, (v * toxicity.HALF).astype("f2")) for k, v in (toxicity.bag(list(dict.fromkeys(w)), len(w)) for w, _ in rows)], np.array([y for _, y in rows]), 200)
    seen = m.words(["grumblat", "grumblatt", "grumbllat", "w17", "w250"])
    assert seen[:3].min() > 2 * abs(seen[3:]).max()


def isotonic_naive(x, y):
    """Least squares under order: max over starts of the min over ends of means."""
    o = np.argsort(x, kind="stable")
    y = y[o]
    n = len(y)
    return np.array([max(min(y[a : b + 1].mean() for b in range(k, n)) for a in range(k + 1)) for k in range(n)])


@pytest.mark.parametrize("seed", range(3))
def test_isotonic(seed):
    r = np.random.default_rng(seed)
    x, y = r.normal(size=60), r.integers(0, 2, 60).astype("f8")
    knots, levels = quality.isotonic(x, y)
    want = isotonic_naive(x, y)
    assert np.interp(np.sort(x), knots, levels).min() >= 0 and (np.diff(levels) >= 0).all()
    assert sorted(set(np.round(levels, 9))) == sorted(set(np.round(want, 9)))


def test_normal_equations(spark, docs_of):
    """The fitted weights solve the ridge problem put down row by row."""
    r = random.Random(8)
    rows = [(i, text(i, r.randrange(5, 90)) if i % 3 else "!!! 12 ### " * r.randrange(1, 30)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    m = quality.fit(docs_of(rows), labels, features=32)
    import zlib

    own = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    x = np.array([quality.statistics(t) for _, t in own])
    y = np.array([float(i % 3 > 0) for i, _ in own])
    assert m.mean == pytest.approx(x.mean(0)) and m.scale == pytest.approx(np.where(x.std(0) > 1e-9, x.std(0), 1.0))
    back = (np.array([i for i, _ in own], "u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(5) == 0
    fit = ~back if back.sum() >= 50 else np.ones(len(y), bool)
    d = []
    for row in x[fit]:
        z = [max(-8, min(8, (a - b) / c)) for a, b, c in zip(row, m.mean, m.scale)]
        d.append([1.0, *z, *(math.sqrt(2 / 32) * math.cos(sum(a * w for a, w in zip(z, m.omega[:, k])) + m.phase[k]) for k in range(32))])
    d = np.array(d)
    want = np.linalg.solve(d.T @ d + quality.RIDGE * len(y) / 32 * np.eye(d.shape[1]), d.T @ y[fit])
    assert d @ m.weights == pytest.approx(d @ want, abs=1e-6)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_repeated_ids_teach_once(spark, docs_of, module):
    """A labelled id that many rows share, and contradictory labels."""
    rows = [(1, text(k, 20)) for k in range(300)] + [(i, text(i, 20)) for i in range(2, 40)] + [(50 + k, t) for k, (_, t) in enumerate(EDGE)]
    labels = spark.createDataFrame([(i, y, y) for i in range(1, 40) for y in ((0, 1) if i < 5 else (i % 2,))], "doc_id long, quality int, toxic int")
    name, k, held = ("quality", 4, 2) if module is quality else ("toxic", 5, 0)
    some = quality.labelled(docs_of(rows), labels, name, k, held, 30).collect()
    assert len(some) <= 30 and len({r["doc_id"] for r in some}) == len(some)
    assert all(r["y"] == 1 for r in some if r["doc_id"] < 5)
    assert len(module.classify(docs_of(rows), labels).collect()) == len(rows)
