"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns,
each result held against brute force."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from siltlake.llm import bpe, itq, licenses, packing, quality, sharding, simhash, substrings, topk, toxicity

VOCAB = [f"w{k}" for k in range(300)]


def text(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def near(t, k=1):
    words = t.split()
    words[len(words) // 2 : len(words) // 2 + k] = ["changed"] * k
    return " ".join(words)


BASE = text(1, 200)
EDGE = [
    (5, BASE), (2, BASE), (9, near(BASE)), (7, f"{text(2)} {BASE[:120]}"), (7, f"{text(2)} {BASE[:120]}"),
    (None, BASE), (None, None), (1, None), (3, ""), (4, " \t\n\x0b"), (6, "one"), (8, "İK K nbsp x \x85 é CC BY"),
    (10, text(3, 60_000)), (11, "a " * 500), (12, "a " * 501), (-3, "minus id"), (13, "MIT license, mit License. Apache\nLicense"),
    (14, "x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software\ny"),
    (15, "licensed under the Apache License, Version 2.0 cc-by gnu  general public license"),
]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_passages(docs_of):
    got = [tuple(r) for r in substrings.digests(docs_of(EDGE)).collect()]
    assert ordered(got) == ordered(brute.passages(EDGE))


def test_passages_many(docs_of):
    r = random.Random(7)
    shared = [text(100 + k, r.randrange(13, 60)) for k in range(8)]
    rows = [(i, " ".join(x for _ in range(r.randrange(1, 5)) for x in (text(1000 + i, r.randrange(0, 30)), r.choice(shared)))) for i in range(120)]
    got = [tuple(x) for x in substrings.spans(docs_of(rows), chunk_bytes=2000).select("doc_id").distinct().collect()]
    want = brute.passages(rows)
    assert {x for x, in got} == {i for i, _, n, _ in want if n}
    assert ordered(tuple(x) for x in substrings.digests(docs_of(rows)).collect()) == ordered(want)


@pytest.mark.parametrize("seed", range(3))
def test_matching_statistics(seed):
    """Against a search of every length, and of owners."""
    from siltlake.llm.fmindex import FMIndex

    r = np.random.default_rng(seed)
    parts_ = [r.integers(1, 5, r.integers(1, 60)) for _ in range(12)]
    t = np.concatenate([np.append(p, 0) for p in parts_])
    owner = np.repeat(r.permutation(12), [len(p) + 1 for p in parts_])
    index, ends = FMIndex(t, owner, 6), np.arange(1, len(t) + 1)
    length, low, high = index.matching_statistics(t, ends, 6)
    where = lambda p: [k for k in range(len(t) - len(p) + 1) if (t[k : k + len(p)] == p).all()]
    for e, n in zip(ends.tolist(), length.tolist()):
        want = max((m for m in range(1, min(6, e) + 1) if (t[e - m : e] > 0).all() and len(where(t[e - m : e])) >= 2), default=0)
        assert n == want
    full = np.flatnonzero(length == 6)
    got = index.least_owner(low[full], high[full])
    assert got.tolist() == [min(owner[k] for k in where(t[e - 6 : e])) for e in ends[full].tolist()]


def test_texts_without_repeats(docs_of):
    p = text(50, 20)
    rows = [(1, p), (2, f"before\n{p}\tafter"), (3, "kept  as\nit is")]
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs_of(rows), ["doc_id"]).collect()}
    assert got == {1: p, 2: "before\nafter", 3: "kept  as\nit is"}


@pytest.mark.parametrize("how", [{}, {"leaf": 2, "shard_rows": 1, "most_home": 2}])
def test_simhash(docs_of, how):
    rows = [*EDGE, (5, text(90)), (30, near(text(90))), (30, text(91)), (29, text(91)), (None, text(92)), (None, text(92))]
    got = [(r["doc_id"], format(r["fp"] % 2**64, "016x"), r["component_id"]) for r in simhash.near_duplicates(docs_of(rows), **how).collect()]
    assert ordered(got) == ordered(brute.near_prints(rows))


def test_simhash_ids_with_several_texts(spark):
    a, b = 0x0F0F0F0F0F0F0F0F, -0x0F0F0F0F0F0F0F0F
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, fp long")
    assert {r["fp"]: r["component"] for r in simhash.linked(df).collect()} == {a: 1, b: 1}


def prints_around(seeds, each, seed=3):
    r = np.random.default_rng(seed)
    return [int(s) ^ int(sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False))) for s in r.integers(0, 2**63, seeds, dtype="u8") for _ in range(each)]


@pytest.mark.parametrize(("seeds", "each", "how"), [(40, 12, {}), (40, 12, {"leaf": 4, "shard_rows": 5, "most_home": 3}), (2, 300, {"leaf": 16})])
def test_simhash_links_of_any_group(spark, seeds, each, how):
    prints = prints_around(seeds, each)
    df = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {x["fp"] % 2**64: x["component"] for x in simhash.linked(df, **how).collect()}
    groups = brute.Groups(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                groups.join(a, b)
    assert all(got[p] == groups.of(i) for i, p in enumerate(prints))


def test_vantage_trees_miss_nothing_and_prune():
    points = np.random.default_rng(5).integers(0, 2**63, 4000, dtype="u8")
    tree = simhash.VPTree(points, 16)
    home = tree.home(points)
    assert all((home[i] == k).all() for k, i in enumerate(tree.leaves))
    visited = np.zeros((len(points), len(tree.leaves)), bool)
    for leaf, i in tree.visits(points ^ np.uint64(0b1011), 3):
        visited[i, leaf] = True
    assert visited[np.arange(len(points)), home].all()
    assert visited.mean() < 0.4  # of the leaves, even of points without any order
    pairs = {(int(a), int(b)) for i, j in simhash.near_pairs(points, tree, points ^ np.uint64(1 << 40), 1) for a, b in zip(i, j)}
    assert pairs == {(k, k) for k in range(len(points))}


def test_licenses(docs_of):
    for r, (i, t) in zip(sorted(licenses.scan(docs_of([(k, t) for k, (_, t) in enumerate(EDGE)])).collect()), EDGE, strict=True):
        base, (added, best) = brute.license_base(t, licenses.PHRASES), brute.license_added(t, licenses.prepared(licenses.TEMPLATES, licenses.THRESHOLD))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base, (i, t)
        assert r["labels"] == ",".join(sorted(added | {x for x in base[4].split(",") if x}))
        assert r["score"] == (1.0 if base[1] else best)


def test_license_rows_with_null_ids(docs_of):
    assert len(licenses.scan(docs_of(EDGE)).collect()) == len(EDGE)


def test_sharding(docs_of):
    rows = [(i, t, s) for k, (i, t) in enumerate(EDGE * 3) for s in [[None, "a", "b"][k % 3]]]
    out = sharding.shard(docs_of(rows), 4).collect()
    assert len(out) == len(rows) and {r["law"] for r in out} == {"rows"}
    by = [[r["slot"] for r in out if r["shard"] == s] for s in range(4)]
    assert all(sorted(x) == list(range(len(x))) for x in by)
    assert max(map(len, by)) - min(map(len, by)) <= 1
    want = sorted((len((t or "").encode()) + 1, brute.crc(t)) for _, t, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == want
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in out)


def test_copies_are_neighbours(docs_of):
    rows = [(i, f"copy {i % 7}", "a") for i in range(300)] + [(None, "copy 1", "a")] * 40
    out = sorted(sharding.shard(docs_of(rows), 4).collect(), key=lambda r: (r["shard"], r["slot"]))
    seen = [r["text_crc32"] for r in out]
    assert sum(a != b for a, b in zip(seen, seen[1:])) == len(set(seen)) - 1


def test_written_shards_hold_every_row_and_prune(spark, tmp_path):
    """All rows are there, null and repeated ids too; statistics of language and length
    together leave few files to read."""
    import glob

    import pyarrow.parquet as pq

    r = random.Random(9)
    rows = [(i if i % 5 else (None if i % 2 else 1), "x" * int(2 ** (3 + 9 * r.random())), f"l{r.randrange(8)}", f"s{r.randrange(8)}") for i in range(4000)]
    docs = spark.createDataFrame([(*x, len(x[1]), "clash") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    sharding.write_shards(docs, f"{tmp_path}/out", 16, file_rows=50)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == [*docs.columns, "_shard"]
    assert sorted(map(repr, map(tuple, back.drop("_shard").collect()))) == sorted(map(repr, map(tuple, docs.collect())))
    files = glob.glob(f"{tmp_path}/out/*/*.parquet")
    assert all(pq.read_metadata(f).num_rows <= 50 for f in files) and len(files) >= 80
    ranges = []
    for f in files:
        g = pq.read_metadata(f).row_group(0)
        s = {g.column(k).path_in_schema: g.column(k).statistics for k in range(g.num_columns)}
        ranges.append((s["lang"].min, s["lang"].max, s["n_chars"].min, s["n_chars"].max))
    meets = lambda lang, low, high: sum(a <= lang <= b and c <= high and d >= low for a, b, c, d in ranges) / len(ranges)
    both = np.mean([meets(f"l{k}", low, 2 * low) for k in range(8) for low in (16, 256)])
    one = np.mean([meets(f"l{k}", 0, 10**9) for k in range(8)])
    other = np.mean([sum(c <= 2 * low and d >= low for _, _, c, d in ranges) / len(ranges) for low in (16, 256)])
    assert one < 0.6 and other < 0.8 and both < 0.45 and both < min(one, other)


def test_hilbert_curve_steps_to_neighbours():
    bits, dims = 3, 3
    at = sorted((h, c) for c, h in enumerate(sharding.curve(bits, dims)))
    assert [h for h, _ in at] == list(range(1 << bits * dims))
    point = [[c >> bits * d & (1 << bits) - 1 for d in range(dims)] for _, c in at]
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(point, point[1:]))


def test_bpe(docs_of):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    rows = [*EDGE, (20, "emoji 😀😀 ​ zero　wide ſtrange ﬁ İı ﻿ line")]
    want = []
    for i, t in rows:
        e = tok.encode(t or "", add_special_tokens=False)
        d = tok.decode(e.ids, skip_special_tokens=False)
        want.append((i, len(e.ids), brute.sha(np.array(e.ids, "<u4").tobytes()), brute.sha(d.encode()), e.ids, d))
    found = bpe.encode(docs_of(rows), path, chunk_bytes=1000).withColumn("decoded_sha256", F.sha2(bpe.decoded(F.col("ids"), path).cast("binary"), 256)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    assert ordered(tuple(r)[:4] for r in found.collect()) == ordered(x[:4] for x in want)
    assert ordered(tuple(r) for r in bpe.decode(found, path).collect()) == ordered((x[0], x[5]) for x in want)


def test_bpe_decodes_as_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lists = [[], None, [320, 49406, 5, 49407], [10**6, 7, -1, None]]
    got = [r["decoded"] for r in bpe.decode(spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>"), path).orderBy("doc_id").collect()]
    tok = Tokenizer.from_file(path)
    assert got == ["", "", tok.decode(lists[2], skip_special_tokens=False), tok.decode([10**6, 7], skip_special_tokens=False)]


def test_packing(docs_of):
    rows = [(i, t, [None, "a", "b", "a"][k % 4]) for k, (i, t) in enumerate(EDGE)]
    out = packing.best_fit(docs_of(rows), capacity=300).collect()
    assert sum(r["n_words"] for r in out) == sum(len(brute.SPACE.findall(t or "")) for _, t, _ in rows)
    bins = {}
    for r in out:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in b] == np.cumsum([0, *(r["n_words"] for r in b)])[:-1].tolist()
        assert sum(r["n_words"] for r in b) <= 300
        sources = [r["source"] for r in b if r["source"] is not None]
        assert len(set(sources)) == len(sources) and len({r["cluster"] for r in b}) == len(b)
    assert sum(r["bin_id"] is None for r in out) == sum(not (t or "").split() for _, t, _ in rows)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_best_fit(seed):
    r = random.Random(seed)
    pieces = sorted(((r.randrange(1, 60), r.choice([None, "a", "b", "c"]), r.randrange(40)) for _ in range(300)), key=lambda p: -p[0])
    assert packing.pack_group(pieces, 100) == brute.best_fit(pieces, 100)


def turned(v, cosine, r):
    """A vector at ``cosine`` to v."""
    v = np.array(v) / np.linalg.norm(v)
    w = r.normal(size=len(v))
    w -= (w @ v) * v
    return (cosine * v + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)).tolist()


def vectors_of(dim, n=90):
    r = np.random.default_rng(dim)
    seeds = r.normal(size=(17, dim)).tolist()
    out = [(i, seeds[i % 17], i % 3) for i in range(n)]
    out += [(n + k, (np.array(turned(seeds[k % 5], 0.9995, r)) * (k + 1)).tolist(), k % 3) for k in range(30)]
    return [*out, (200, seeds[0], None), (201, [-0.0] * (dim - 1) + [1.0], 2), (202, [0.0] * (dim - 1) + [2.0], 2)]


ODD = [
    (300, None, 1), (301, [0.0] * 8, 1), (302, [1.0] * 7 + [None], 1), (303, [float("nan")] * 8, 1), (304, [float("inf")] * 8, 1), (140, [1e300] * 8, 2), (160, [], 2),
    (1, [3.0, 4.0], 0), (1, [-3.0, 4.0], 0), (7, [3.1, 4.0], 0), (None, [3.0, 4.05], 0), (None, [9.0, 1.0, 1.0], 2), (None, [9.0, 1.0, 1.0], 2), (2000, [1.0], 1),
]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, vec string, id int, n int, node int")


@pytest.mark.parametrize("how", [{}, {"block": 6}, {"tables": (4, 1), "block": 50}, {"tables": (3, 2)}])
def test_near_vectors(spark, how):
    rows = [*vectors_of(64), *vectors_of(8), *ODD]
    want, _ = brute.near_vectors(rows)
    assert ordered(tuple(r) for r in itq.near_vectors(vectors(spark, rows), **how).collect()) == ordered(want)


@pytest.mark.parametrize("tables", [t[1:] for t in itq.TABLES])
def test_recall_of_the_index(spark, tables):
    """Links at cosines from 0.93 to 0.99, and many other vectors."""
    r = np.random.default_rng(11)
    rows = [(i, r.normal(size=64).tolist(), 1) for i in range(1500)]
    rows += [(5000 + 4 * i + k, turned(rows[i][1], c, r), 1) for i in range(300) for k, c in enumerate((0.9301, 0.95, 0.97, 0.99))]
    want, links = brute.near_vectors(rows)
    got = {x["vec_id"]: x["n_links"] for x in itq.near_vectors(vectors(spark, rows), tables=tables).collect()}
    assert all(got[i] <= n for i, n, *_ in want)
    assert sum(got.values()) >= 0.9 * 2 * links


def test_links_do_not_depend_on_the_number_of_vectors(spark, monkeypatch):
    """As if there were more vectors than the first setting is meant for."""
    r = np.random.default_rng(13)
    rows = [(i, r.normal(size=64).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, turned(rows[i][1], 0.9301, r), 1) for i in range(300)]
    of = lambda: ordered(tuple(x) for x in itq.near_vectors(vectors(spark, rows)).collect())
    want = of()
    monkeypatch.setattr(itq, "TABLES", tuple((most, *how) for most, (_, *how) in zip((10, 100, 1 << 62), itq.TABLES)))
    assert of() == want


def test_probes_meet_every_near_substring():
    mask, r = itq.cuts(64, 4)[1], np.random.default_rng(2)
    a = r.integers(0, 2**63, 200, dtype="u8") & mask
    bits = np.array([1 << int(k) for k in np.flatnonzero([int(mask) >> b & 1 for b in range(64)])], "u8")
    for errors in (1, 2):
        b = a.copy()
        for _ in range(errors):
            b ^= bits[r.integers(0, len(bits), len(b))]
        goes = lambda x: {(int(s), k) for sub, of in [(x, np.arange(len(x))), *itq._probes(x, mask, errors)] for s, k in zip(sub, of.tolist())}
        of_a, of_b = goes(a), goes(b)
        assert all((int(b[k]), k) in of_a or (int(a[k]), k) in of_b for k in range(len(a)))


@pytest.mark.parametrize("how", [{}, {"block": 7, "queries": 3}])
def test_topk(spark, how):
    rows = [(i, v) for i, v, _ in [*vectors_of(16), *((i + 1000, *r) for i, *r in vectors_of(8, 60)), *ODD] if v != [1e300] * 8]
    got = sorted(tuple(r) for r in topk.search(vectors(spark, [(*r, 0) for r in rows]), **how).collect())
    assert got == sorted(brute.topk(rows))


def test_topk_of_huge_components(spark):
    rows = [(20 * i, [float(2**18 * (i + 1) + i % 3), 3.0 * i], 0) for i in range(30)]
    assert {tuple(r) for r in topk.search(vectors(spark, rows), k=5).collect()} == brute.topk([(i, v) for i, v, _ in rows], k=5)
    more = topk.search(vectors(spark, [*rows, (1, [1e300, 1.0], 0)]), k=5).collect()
    assert {r["query_id"] for r in more} == {i for i, *_ in rows} and max(r["score"] for r in more) == 2**63 - 1


def test_topk_fewer_rows_and_ties(spark):
    rows = [(20 * i, [1.0, 0.5], 0) for i in range(5)] + [(None, [9.0, 9.0], 0), (3, [-1.0, 0.25], 0)]
    assert {tuple(r) for r in topk.search(vectors(spark, rows)).collect()} == brute.topk([(i, v) for i, v, _ in rows])


def test_empty_tables(spark, docs_of):
    import public_tokenizers

    none = docs_of([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        substrings.digests(none), simhash.near_duplicates(none), licenses.scan(none), sharding.shard(none), packing.best_fit(none),
        bpe.encode(none, public_tokenizers.path("word_bpe_49k.json")), itq.near_vectors(vectors(spark, [])), topk.search(vectors(spark, [])),
        quality.classify(none, labels), toxicity.classify(none, labels),
    ):
        assert df.collect() == []


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(spark, docs_of, module):
    name, k, held, cut = ("quality", 4, 2, 0.7) if module is quality else ("toxic", 5, 0, 0.5)
    bad, r = ["zorgfuck", "grumblat", "vilest"], random.Random(2)
    rows, labels = [], []
    for i in range(400):
        y = i % 2
        words = text(i, 50).split()
        if module is toxicity and y:
            words[r.randrange(50)] = r.choice(bad)
            words[r.randrange(50)] = r.choice(bad)
        rows.append((i, " ".join(words) if module is toxicity or y else "!!! ### 123 " * 20))
        labels.append((i, y, y))
    labels += [(None, 1, 1), (3, None, None), (100_000, 1, 1)]
    rows += [(1000 + n, t) for n, (_, t) in enumerate(EDGE)] + [(None, None)]
    ydf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "0 AS score")
    out = module.classify(docs_of(rows), ydf).collect()
    assert len(out) == len(rows)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= cut) for x in out)
    by = {x["doc_id"]: x for x in out}
    import zlib

    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % k == held) for i, _ in rows if i is not None)
    tested = [by[i] for i in range(400) if by[i]["held_out"]]
    assert np.mean([x["predicted"] == x["doc_id"] % 2 for x in tested]) >= 0.9


def test_held_out_labels_teach_nothing(spark, docs_of):
    import zlib

    rows = [(i, text(i, 30) if i % 2 else "### 12 " * 9) for i in range(120)]
    make = lambda flip: spark.createDataFrame([(i, i % 2 ^ (flip and zlib.crc32(str(i).encode()) % 4 == 2), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    scores = [{r["doc_id"]: r["score"] for r in quality.classify(docs_of(rows), make(flip)).collect()} for flip in (False, True)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("top", [1, 200, 70_000, 2**32 - 1])
def test_numbers_of_words_are_whole_again(top):
    x = np.concatenate([np.random.default_rng(top).integers(0, top, 1000), [0, top]]).astype("<u4")
    assert (bpe.unpack_numbers(bpe.pack_numbers(x)) == x).all() and len(bpe.unpack_numbers(bpe.pack_numbers(x[:0]))) == 0
