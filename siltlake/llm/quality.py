"""Operator 4: quality by random Fourier features, ridge and isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import checkpointed, fold, slices, small_batches, table

SAMPLE = 20_000  # labelled rows that are fitted, at most (the first by hash of the id)
FEATURES = 512
RIDGE = 1e-3
CUT = 0.7
LEARN_PARTS = 16  # partial sums that reach the driver
WORDS = re.compile(r"\S+")


def statistics(text: str | None) -> list[float]:
    """Numbers about the whole text; nothing else about a document is looked at."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), "u1"), minlength=256)
    words, lines, n_bytes = text.split(), text.split("\n"), max(1, int(raw.sum()))
    n = max(1, len(words))
    counts = Counter(words)
    some = lambda chars: float(sum(raw[ord(c)] for c in chars)) / n_bytes
    upper, lower = float(raw[65:91].sum()), float(raw[97:123].sum())
    per = n / n_bytes * 6  # marks a word, not a byte
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        len(text) / n if words else 0.0,
        upper / max(1.0, upper + lower),
        float(raw[48:58].sum()) / n_bytes,
        some("!") / per,
        some("$%*&#@^~") / per,
        some("|") / per,
        some(".,;:") / per,
        some("<>{}[]()=_/\\+") / per,
        float(raw[128:].sum()) / n_bytes,
        float(raw[:9].sum() + raw[11:13].sum() + raw[14:32].sum() + raw[127]) / n_bytes,
        len(counts) / n,
        math.log1p(n) * len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.isupper, words)) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(map(str.isalpha, words)) / n,
    ]


N_STATISTICS = len(statistics("a"))


@dataclass
class Model:
    """Scales of the statistics, the random features, ridge weights, calibration."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, math.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a thousandth of the raw score so that ties stay ordered."""
        r = self.raw(x)
        return np.clip(0.999 * np.interp(r, self.knots, self.levels) + 0.001 / (1 + np.exp(-np.clip(4 * r - 2, -30, 30))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the means of x and y of each block."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def labelled(docs: DataFrame, labels: DataFrame, label: str, k: int, held: int, bound: int) -> DataFrame:
    """doc_id, text, y of at most ``bound`` labelled rows outside the held-out fold,
    those of the smallest hash of the id.  Their ids are few enough to broadcast.  An
    id with several labels has the larger one; one that several documents have
    teaches once, by the least of their texts."""
    some = (
        labels.where(F.col(label).isin(0, 1) & (fold("doc_id", k) != held))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some.select(F.col("doc_id").cast("long").alias("doc_id"), "y")), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = [np.array(statistics(t), "f8").tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], names=["doc_id", "x", "y"])


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and whether a row calibrates (one in five, by its id) rather than fits."""
    x = np.frombuffer(b"".join(b.column(1).to_pylist()), "f8").reshape(-1, N_STATISTICS)
    ids = np.array([i or 0 for i in b.column(0).to_pylist()], "i8").astype("u8")
    return x, np.array(b.column(2).to_pylist(), "f8"), (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(5) == 0


def _summed(data: DataFrame, of) -> list[np.ndarray]:
    """The sum over partitions of a tuple of arrays, added in the order of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        from pyspark import TaskContext

        total = None
        for b in slices(batches):
            part = of(*_rows(b))
            total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], names=["part", "sums"])

    import pickle

    sums = [pickle.loads(r["sums"]) for r in sorted(data.mapInArrow(run, "part int, sums binary").collect(), key=lambda r: r["part"])]
    return [sum(parts[1:], parts[0]) for parts in zip(*sums, strict=True)] if sums else []


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, features: int = FEATURES, seed: int = 4) -> Model | None:
    """The model, or None if there are not both labels among the learning rows."""
    data = checkpointed(labelled(docs, labels, "quality", 4, 2, bound).mapInArrow(_measured, "doc_id long, x binary, y double").repartition(LEARN_PARTS, "doc_id"))
    data = data.coalesce(LEARN_PARTS)  # the sample is bounded, and so is what is summed of it, whatever the cluster deals
    moments = _summed(data, lambda x, y, c: [np.array([len(y), y.sum(), (~c).sum(), c.sum()], "f8"), x.sum(0), (x * x).sum(0)])
    if not moments or not 0 < moments[0][1] < moments[0][0]:
        return None
    n, mean = moments[0][0], moments[1] / moments[0][0]
    scale = np.sqrt(np.maximum(moments[2] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    m = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(len(mean), features)) / math.sqrt(len(mean)), rng.uniform(0, 2 * math.pi, features), np.zeros(0), np.zeros(0), np.zeros(0))
    all_fit = moments[0][2] == 0 or moments[0][3] < 50

    def normal(x, y, c):
        keep = np.ones(len(y), bool) if all_fit else ~c
        d = m.design(x[keep])
        return [d.T @ d, d.T @ y[keep]]

    a, b = _summed(data, normal)
    m.weights = np.linalg.solve(a + RIDGE * n / features * np.eye(len(a)), b)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y, c = _rows(batch)
            keep = np.ones(len(y), bool) if all_fit else c
            yield pa.RecordBatch.from_arrays([pa.array(m.raw(x[keep])), pa.array(y[keep])], names=["r", "y"])

    r = data.mapInArrow(scored, "r double, y double").toPandas().sort_values(["r", "y"])
    m.knots, m.levels = isotonic(r["r"].to_numpy(), r["y"].to_numpy())
    return m


def score(docs: DataFrame, model: Model | None, carry: list[str] = ["doc_id"]) -> DataFrame:
    """carry columns and score of every row; 0.5 where there is no model."""
    schema = docs.select(*carry).schema.add("score", "double")
    names = [*carry, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if len(b):
                x = np.array([statistics(t) for t in b.column(0).to_pylist()])
                s = np.full(len(x), 0.5) if model is None else model.score(x)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s)], names=names)

    return docs.select(F.col("text").alias("_measured"), *carry).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from at most ``bound`` rows of ``labels`` (doc_id, quality) outside fold 2 of
    4; one in five of them calibrates.  Only the text is looked at.

    Nulls: a null text counts as empty, which is scored like any text; rows of labels
    with a null id or label teach nothing; a null id has held_out null.  Repeated
    rows are scored each.  Without learnable labels every score is 0.5.  Empty tables
    give empty results; other columns are ignored.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, bound))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_fourier": op4}
ORACLE_SQL: dict[str, str] = {}
