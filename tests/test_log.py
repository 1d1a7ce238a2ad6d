"""The key-value engine against SQL, golden values and a dict."""

import random

import pytest
from oracle import same

from siltlake.functions.log import TOMBSTONE, VERSION
from siltlake.operators import read
from siltlake.plans import layout
from siltlake.plans.queries import QUERIES, SQL, generated_queries
from siltlake.sources.store import Store, read_page_files
from siltlake.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    same(spark, QUERIES[name], SQL[name], SF)


def run(spark, pairs, seq):
    return spark.createDataFrame([(k, v, v is None, seq) for k, v in pairs], VERSION)


def test_three_runs_merge(spark):
    runs = [
        run(spark, [(i, 10 * i) for i in range(1, 5001)], 1),
        run(spark, [(i, 100 * i) for i in range(400, 601)], 2),
        run(spark, [(i, -i) for i in range(500, 1001)], 3),
    ]
    got = {r["key"]: r["value"] for r in read.merge(runs, True).collect()}
    assert len(got) == 5000
    assert (got[1], got[400], got[500], got[5000]) == (10, 40000, -500, 50000)


def test_pages(spark):
    live = read.resolve(run(spark, [(i, i * 100) for i in range(1, 2049)], 1))
    leaf = layout.leaves(live)
    assert [r["max_key"] for r in leaf.orderBy("page").collect()] == list(range(256, 2049, 256))
    assert [r["max_key"] for r in layout.internal(leaf).collect()] == [2048]


@pytest.mark.parametrize("n", [1, 2, 3, 26, 27, 100, 729, 2000])
def test_levels(n):
    counts = [0] * 5
    for _ in range(n):
        counts[0] += 1
        for level, most in enumerate(layout.PER_LEVEL):
            if counts[level] >= most:
                counts[level], counts[level + 1] = 0, counts[level + 1] + 1
    assert layout.run_counts(n) == counts


def test_level_shape_and_reopen(spark, tmp_path):
    """5,000 single puts at 32 KiB: flushes of 2048, 2048 and 904 pairs are one run of level 1."""
    at = str(tmp_path / "db")
    s = Store(spark, at, 32 << 10)
    sizes = []
    for i in range(1, 5001):
        s.put(i, 10 * i)
        if not s.memtable:
            sizes.append(i)
    assert sizes == [2048, 4096]
    s.close()
    assert [len(s.runs(k)) for k in range(5)] == [0, 1, 0, 0, 0]
    (r,) = s.runs(1)
    assert (r["min_key"], r["max_key"], r["pairs"], r["pages"]) == (1, 5000, 5000, 20)
    again = Store(spark, at, 32 << 10)
    assert again.get(1024) == 10240 and again.runs() == s.runs()


def test_bulk_runs_lie_in_the_level_of_their_size(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"), 16 * 10)
    for n, level in ((10, 0), (11, 0), (21, 0), (30, 1), (270, 2)):
        assert s._level(n) == (level if n != 21 else 1)
    s.put_all(spark.range(300).selectExpr("id AS key", "id AS value", "id AS seq"))
    assert [len(s.runs(k)) for k in range(5)] == [0, 0, 1, 0, 0]
    s.delete_all(spark.range(300).selectExpr("id AS key"))
    s.put(5, 6)
    s.flush()
    s.compact(2)
    s.compact(3)
    assert [tuple(r) for r in s.scan(0, 999).collect()] == [(5, 6)]


def test_deletions_stay_while_older_runs_do(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"), 16 * 2)
    s.put(1, 1)
    s.flush()
    s.put_all(spark.createDataFrame([(k, None if k == 1 else k, k) for k in range(100)], "key long, value long, seq long"))
    for level in (3, 2, 1):
        if s.runs(level):
            s.compact(level)
    while not s.runs(4):
        s.compact(max(r["level"] for r in s.runs() if r["level"]))
    s.compact(4)
    assert s.runs(0) and s.get(1) is None and s.get(2) == 2
    s.compact()
    assert s.get(1) is None and s.log().where("deleted").count() == 0


def test_ties_of_a_batch_have_a_rule(spark, tmp_path):
    rows = [(1, 5, 7), (1, 9, 7), (1, None, 7), (2, None, 3), (2, 4, 2), (3, None, 1), (3, TOMBSTONE, 1)]
    for n in (1, 3):
        s = Store(spark, str(tmp_path / f"db{n}"))
        s.put_all(spark.createDataFrame(rows, "key long, value long, seq long").repartition(n))
        assert [tuple(r) for r in s.scan(0, 9).collect()] == [(1, 9)]


def test_two_stores_and_two_writers(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    a.put(1, 1)
    b.put(1, 2)
    a.close()
    b.close()
    assert (a.get(1), b.get(1)) == (1, 2)
    one, two = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "a"))
    one.put(2, 2)
    one.close()
    two.put(3, 3)
    with pytest.raises(RuntimeError):
        two.close()
    assert two.manifest["version"] == 1 and [tuple(r) for r in Store(spark, str(tmp_path / "a")).scan(0, 9).collect()] == [(1, 1), (2, 2)]


def test_replaced_runs_go_with_the_commit_after(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    for k in range(2):
        s.put(k, k)
        s.flush()
    before, old = s.scan(0, 9), {r["name"] for r in s.runs()}
    s.compact()
    there = lambda: {p.name for p in (tmp_path / "db").iterdir() if p.name.startswith("run-")}
    assert old < there() and before.count() == 2
    s.put(9, 9)
    s.flush()
    assert not old & there() and there() == {r["name"] for r in s.runs()}
    (tmp_path / "db" / f"manifest-{s.manifest['version'] + 1}.json").write_text('{"version')  # a writer that died
    again = Store(spark, str(tmp_path / "db"))
    assert again.runs() == s.runs()
    again.put(10, 10)
    again.close()
    assert Store(spark, str(tmp_path / "db")).get(10) == 10


def lru(trace, capacity):
    held, out = [], []
    for page in trace:
        out.append(page in held)
        held = [p for p in held if p != page][-(capacity - 1) :] if capacity > 1 else []
        held.append(page)
    return out


@pytest.mark.parametrize(("pages", "capacity", "chunk", "fan"), [(6, 4, 7, 3), (40, 8, 5, 4), (3, 6, 4, 2), (500, 64, 16, 2)])
def test_cache_hits(spark, pages, capacity, chunk, fan):
    rng = random.Random(pages)
    trace = [rng.randrange(pages) if k % 50 else pages + k for k in range(600)]
    df = spark.createDataFrame(list(enumerate(trace)), "access_no long, page_id long")
    got = [r["hit"] for r in layout.lru_hits(df, capacity, chunk, fan).orderBy("access_no").collect()]
    assert got == lru(trace, capacity)


def test_cache_order_and_eviction(spark):
    """Pages 1, 2, 3 and gets of 2, 1, 3: at room for three all hit, at two the third evicts."""
    hits = lambda trace, room: [r["hit"] for r in layout.lru_hits(spark.createDataFrame(list(enumerate(trace)), "access_no long, page_id long"), room).orderBy("access_no").collect()]
    assert hits([1, 2, 3, 2, 1, 3], 3) == [False] * 3 + [True] * 3
    assert hits([1, 2, 3, 2, 1, 3], 2) == [False] * 3 + [True] + [False] * 2
    assert hits([0, 1, 2, 3, 4, 5, 4, 0], 5)[-2:] == [True, False]


def test_keys_over_the_whole_range(spark):
    """Ranks, neighbours and ranges of keys spread over 64 bits; no task gets them all."""
    rng = random.Random(3)
    keys = sorted({rng.randrange(-(2**63), 2**63) for _ in range(3000)} | {-(2**63), 2**63 - 1, 0, -1})
    log = spark.createDataFrame([(k, k % 1000, False, n) for n, k in enumerate(keys)], VERSION)
    assert [r["rn"] for r in layout.numbered(log).orderBy("key").collect()] == list(range(len(keys)))
    parts = [r["count"] for r in read.ranged(log).groupBy("part").count().collect()]
    assert len(parts) == 4 and max(parts) < 0.4 * len(keys)
    import bisect

    asked = [rng.randrange(-(2**63), 2**63) for _ in range(200)] + keys[::97] + [-(2**63), 2**63 - 1]
    for r in read.bounds(log, spark.createDataFrame([(k,) for k in asked], "key long")).collect():
        lo, hi = bisect.bisect_left(keys, r["key"]), bisect.bisect_right(keys, r["key"])
        at = lambda n: keys[n] if 0 <= n < len(keys) else None
        assert (r["floor_key"], r["lower_key"], r["upper_key"]) == (at(hi - 1), at(lo), at(hi))
    ranges = [(n, *sorted((rng.choice(asked), rng.choice(asked)))) for n in range(100)] + [(100, 5, 4), (101, None, 3), (102, -(2**63), 2**63 - 1)]
    for r in read.multi_scan(log, spark.createDataFrame(ranges, "qid long, lo long, hi long")).collect():
        _, lo, hi = ranges[r["qid"]]
        own = [k % 1000 for k in keys if lo is not None and lo <= k <= hi]
        assert (r["n"], r["total"]) == (len(own), sum(own))


def test_wide_trees(spark):
    """More than 256 leaves: two nodes below the root."""
    leaf = layout.leaves(read.resolve(spark.range(70_000).selectExpr("id AS key", "id AS value", "false AS deleted", "id AS seq")))
    assert leaf.count() == 274
    assert [tuple(r) for r in layout.internal(leaf).orderBy("node").collect()] == [(0, 65535, 256), (1, 69999, 18)]


def test_generated_keys_and_queries(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    keys = [tuple(r) for r in QUERIES["uniform_keys"](spark, SF).collect()]
    assert len(keys) == n and all(k == v and 1 <= k <= 10**9 for k, v in keys)
    assert len({k for k, _ in keys}) > 0.99 * n and abs(sum(k for k, _ in keys) / n / 5e8 - 1) < 0.1
    some = [r["key"] for r in generated_queries(spark.range(50).selectExpr("id AS key"), 20, 3).collect()]
    assert len(set(some)) == 20 and set(some) <= set(range(50)) and some != sorted(some)
    assert some == [r["key"] for r in generated_queries(spark.range(50).selectExpr("id AS key"), 20, 3).collect()]


def test_sessions(spark, tmp_path):
    at = str(tmp_path / "db")
    for keys, f in ((range(1, 5001), 10), (range(500, 1001), 100), (range(400, 601), 1000), (range(1, 1025), -10), (range(900, 1101), -100)):
        s = Store(spark, at, 32 << 10)
        s.put_all(spark.createDataFrame([(k, f * k, k) for k in keys], "key long, value long, seq long"))
        s.close()
    s = Store(spark, at)
    assert s.get(1024) == -102400
    rows = s.scan(1024, 4096).collect()
    assert (rows[0]["key"], rows[0]["value"]) == (1024, -102400)
    assert (rows[77]["key"], rows[77]["value"], len(rows)) == (1101, 11010, 3073)
    s.delete(1024)
    assert s.get(1024) is None
    assert s.scan(1024, 4096).first()["key"] == 1025 and s.scan(1024, 4096).count() == 3072
    assert all(r["bytes"] > 0 and r["pages"] == -(-r["pairs"] // 256) for r in s.runs())


def test_against_dict(spark, tmp_path):
    rng, model = random.Random(5), {}
    s = Store(spark, str(tmp_path / "db"), 16 * 12)
    keys = [0, -1, -(2**63), 2**63 - 1, *range(20)]
    for step in range(70):
        k = rng.choice(keys)
        if rng.random() < 0.3:
            s.put(k, TOMBSTONE) if rng.random() < 0.5 else s.delete(k)
            model.pop(k, None)
        else:
            s.put(k, step)
            model[k] = step
        if step == 35:
            s.close()
            s = Store(spark, str(tmp_path / "db"), 16 * 12)
    want = sorted(model.items())
    full = lambda: [tuple(r) for r in s.scan(-(2**63), 2**63 - 1).collect()]
    assert full() == want
    assert s.scan(10, 5).count() == 0 and s.get(7) == model.get(7)
    s.flush()
    s.compact()
    assert full() == want and s.log().where("deleted").count() == 0


def test_empty_merge(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    for k in range(3):
        s.delete(k)
    s.flush()
    s.compact()
    assert s.runs() == [] and s.scan(0, 10).count() == 0 and s.get(1) is None


def test_lookups(spark):
    log = run(spark, [(k, k) for k in (-70000, 0, 5, 200000)], 1)
    got = {r["key"]: tuple(r)[1:] for r in read.bounds(log, spark.createDataFrame([(-80000,), (0,), (3,), (200000,), (300000,)], "key long")).collect()}
    assert got == {-80000: (None, -70000, -70000), 0: (0, 0, 5), 3: (0, 5, 5), 200000: (200000, 200000, None), 300000: (200000, None, None)}


def test_plan_reads_only_the_key_range(spark, tmp_path):
    run(spark, [(k, k) for k in range(100)], 1).write.parquet(str(tmp_path / "r"))
    plan = read.scan(spark.read.parquet(str(tmp_path / "r")), 5, 7)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,5)" in plan and "LessThanOrEqual(key,7)" in plan


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 3)], "key long, value long, seq long").write.parquet(str(tmp_path / "in"))
    s = Store(spark, str(tmp_path / "db"))
    stream = spark.readStream.schema("key long, value long, seq long").parquet(str(tmp_path / "in"))
    ingest(stream, s, str(tmp_path / "c")).awaitTermination()
    again = Store(spark, str(tmp_path / "db"))
    assert [tuple(r) for r in again.scan(0, 9).collect()] == [(1, 6), (2, 7)]
    assert not again.put_all(spark.createDataFrame([(9, 9, 9)], "key long, value long, seq long"), batch="ingest-0")


def page_file(path, pairs):
    """A run file as it lies on disk: root page, inner pages, pairs without filling."""
    import numpy as np

    inner = max(1, len(pairs) // 256 // 256)
    words = np.zeros(512 * (1 + inner) + 2 * len(pairs), "<i8")
    words[512 * (1 + inner) :] = np.array(pairs, "<i8").reshape(-1)
    path.write_bytes(words.tobytes())


def test_page_files(spark, tmp_path):
    page_file(tmp_path / "btree1_2.bin", [(1, 10), (5, TOMBSTONE), (7, 70)])
    page_file(tmp_path / "btree0_11.bin", [(-9, 1), (-3, 2), (0, 0)])
    page_file(tmp_path / "btree0_2.bin", [(-9, 7)])
    page_file(tmp_path / "btree2_0.bin", [(k, k) for k in range(-1000, 140_000)])
    found = read_page_files(spark, str(tmp_path))
    got = sorted(tuple(r) for r in found.where("level < 2").select("level", "run", "key", "value", "deleted").collect())
    assert got == [(0, 2, -9, 7, False), (0, 11, -9, 1, False), (0, 11, -3, 2, False), (0, 11, 0, 0, False), (1, 2, 1, 10, False), (1, 2, 5, None, True), (1, 2, 7, 70, False)]
    assert tuple(found.where("level = 2").selectExpr("sum(key)", "count(value)").first()) == (sum(range(-1000, 140_000)), 141_000)
    assert {r["key"]: r["value"] for r in read.resolve(found.where("level < 2")).collect()}[-9] == 1


def test_csv_of_rates(tmp_path):
    from bench import write_csv

    write_csv(str(tmp_path / "x.csv"), "Put Throughput", {1: 10.0, 2: 3.456})
    assert (tmp_path / "x.csv").read_text() == "Data Size,Put Throughput\n1,10.00\n2,3.46\n"
