"""The near-dedup stage finds its candidates by SimHash, and loses none that are links."""

import brute
import corpus_pipeline
import numpy as np
import pytest
from siltlake.llm import copies, simhash
from siltlake.llm.graph import components
from test_edges import text
from test_near_copies import edited, jaccard, shingled


def votes(t):
    bits = np.unpackbits(simhash.shingles(t, 5).view("u1").reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(int) * 2 - 1


def led(t, target, name, more):
    """``t`` and words chosen so that its 64-bit fingerprint follows ``target``."""
    for k in range(more):
        last = " ".join(t.split()[-4:])
        t += " " + max((f"{name}{k}x{c}" for c in range(200)), key=lambda w: int(votes(f"{last} {w}")[0] @ target))
    return t


def test_link_whose_short_fingerprints_are_far_apart(spark, docs_of):
    base = text(71, 200)
    total = np.abs(votes(base).sum(0))
    target = np.where(total <= np.sort(total)[40], 1, 0)
    a, b = led(base, target, "up", 22), led(base, -target, "down", 22)
    assert jaccard(shingled(a), shingled(b)) >= 0.8
    far = [simhash.majority(np.unique(simhash.shingles(t, 5))) for t in (a, b)]
    assert (far[0] ^ far[1]).bit_count() > 24
    assert [r["doc_id"] for r in corpus_pipeline.distinct(spark, docs_of([(1, a), (2, b)]), "").collect()] == [1]


def test_candidates_come_by_fingerprints_alone(docs_of):
    rows = [(k, edited(text(950, 200), 50, f"e{k}x")) for k in range(4)]
    found = {how: len({r["component"] for r in copies.near_copies(docs_of(rows), radius=how).collect()}) for how in (copies.RADIUS, (0, 0))}
    assert found == {copies.RADIUS: 1, (0, 0): 4}


@pytest.mark.parametrize("part", [3, 40, copies.PART])
def test_search_joins_what_all_pairs_join(spark, part):
    r = np.random.default_rng(7)
    fp = np.repeat(r.integers(0, 2**64, (20, 4), dtype="u8"), 8, axis=0)
    for row in fp:
        for bit in r.choice(256, r.integers(20, 48), replace=False).tolist():
            row[bit // 64] ^= np.uint64(1 << bit % 64)
    size = r.integers(2, 30, len(fp)).tolist()
    rows = [(copies.band(n, 0.8), k, n, fp[k].tobytes()) for k, n in enumerate(size)]
    groups = brute.Groups(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            small, large = sorted((size[a], size[b]))
            shared = small if small < large else small - 1
            d = np.bitwise_count(fp[a] ^ fp[b])
            if shared >= 0.8 * (small + large - shared) - 1e-9 and d[:2].sum() <= copies.RADIUS[0] and d.sum() <= copies.RADIUS[1]:
                groups.join(a, b)
    nodes = spark.createDataFrame(rows, "band int, node long, n long, fp binary")
    got = {r["id"]: r["component"] for r in components(copies.search(nodes, part=part)).collect()}
    want = {k: groups.of(k) for k in range(len(rows))}
    assert len({groups.of(k) for k in want}) < len(rows) - 40
    assert [got.get(k, k) for k in want] == [min(m for m in want if want[m] == want[k]) for k in want]
