"""Registered queries against their SQL, and the pipeline against brute force."""

import brute
import corpus_pipeline
import pytest
from oracle import same
from siltlake.llm import packing, quality, queries, toxicity
from siltlake.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_every_operator_has_a_query():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.queries()) == list(range(1, 11))


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    labels = table(spark, SF, "labels")
    score = lambda module, left: {r["doc_id"]: r["score"] for r in module.score(left, module.fit(left, labels)).collect()}
    left = {i for i, s in score(quality, docs).items() if s >= quality.CUT}
    kept = docs.where(docs.doc_id.isin(sorted(left)))
    left = {i for i, s in score(toxicity, kept).items() if s < toxicity.CUT}
    left = set(brute.near_copies([(i, rows[i][0]) for i in sorted(left)]))
    cut = brute.passages([(i, rows[i][0]) for i in sorted(left)])
    words = {i: n - gone for i, n, gone, _ in cut if not gone or n > gone}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_words"]
        assert r["n_words"] <= packing.CAPACITY
    assert got == words


LONG = " ".join(f"t{k}" for k in range(5000))
TALE = " ".join(f"u{k}" for k in range(40))
ODD = [
    (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 30, None, None, 150), (2, "word " * 30, None, None, 150),
    (None, "one of a kind", "en", "a", 13), (None, "another one", "en", "a", 11), (3, LONG, "en", "b", 5), (3, "same id, not the text", "en", "b", 5), (4, f"x {TALE} y z", "en", "b", 7),
    (5, TALE + " and " + " ".join(f"v{k}" for k in range(40)), "en", "b", 9), (None, TALE + " " + " ".join(f"w{k}" for k in range(50)), "en", None, 1),
]


def stages(spark, at, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS _key", "1 AS component", "2 AS score", "3 AS words")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return {name: stage(spark, table(spark, at, "documents"), at) for name, stage in corpus_pipeline.STAGES}


def test_stages_on_an_empty_table(spark, tmp_path):
    for name, found in stages(spark, str(tmp_path), []).items():
        assert found.collect() == [], name


def test_stages_on_odd_rows(spark, tmp_path):
    found = stages(spark, str(tmp_path), ODD)
    count = lambda rows: sorted(map(repr, map(tuple, rows)))
    for name in ("quality classifier", "toxicity", "SimHash near-dedup", "substring dedup"):
        assert found[name].columns == corpus_pipeline.COLUMNS
    for name in ("quality classifier", "toxicity"):
        assert count(found[name].collect()) == count(ODD)
    assert count(found["SimHash near-dedup"].collect()) == count(r for k, r in enumerate(ODD) if k not in (0, 2, 4))
    without = " and " + " ".join(f"v{k}" for k in range(40))
    got = {(r["doc_id"], r["n_chars"]): r["text"] for r in found["substring dedup"].collect() if r["doc_id"] in (4, 5)}
    assert got == {(4, 7): ODD[9][1], (5, len(without.strip())): without.strip()}
    assert count(r for r in found["substring dedup"].collect() if r["doc_id"] != 5) == count(r for r in ODD if r[0] != 5)
    pieces = found["best-fit packing"].collect()
    assert sum(r["n_words"] for r in pieces) == sum(len((r[1] or "").split()) for r in ODD)
    assert sorted(r["n_words"] for r in pieces if r["doc_id"] == 3) == [5, 904, 2048, 2048]
    assert sum(r["bin_id"] is None for r in pieces) == 3
    twice = [r["bin_id"] for r in pieces if r["doc_id"] == 2]
    assert len(twice) == len(set(twice)) == 2
