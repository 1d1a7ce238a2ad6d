"""Operator 6: toxicity by subword-bag embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, pack, slices, small_batches, table, unpack, written
from .quality import labelled

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
SAMPLE = 6000  # labelled rows that are learnt from, at most: a third of them toxic, at most
STEPS = 300  # mini-batches of 128 bags over whole documents
ROUNDS, ROUND_STEPS = 2, 150  # then over windows, chosen anew in each round
WINDOW = 8  # words averaged together when scoring; a document counts as its worst window
WORST = 2  # windows of a document that a round trains on
CUT = 0.5
HALF = 4096  # brings the weights of a bag into the range of half precision
RATE, MOMENTUM = 4.0, 0.9
WORDS = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every character n-gram of '<word>' and of the whole of it, so
    that a misspelt word shares most buckets with the word."""
    lens = np.array([len(w) + 2 for w in words], "i8")
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype("u8") if words else np.zeros(0, "u8")
    ends = np.cumsum(lens)
    word = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(ends, lens) - np.arange(len(code))
    at, bucket = [], []
    h = code.copy()
    for n in range(2, min(max(GRAMS), len(code)) + 1):
        h[: len(code) - n + 1] = h[: len(code) - n + 1] * MIX + code[n - 1 :]
        if n in GRAMS:
            ok = np.flatnonzero(left >= n)
            at.append(word[ok])
            bucket.append((h[ok] ^ np.uint64(n)) * MIX >> np.uint64(48))
    if len(words):
        place = np.arange(len(code)) - np.repeat(ends - lens, lens)
        whole = np.add.reduceat(code * np.power(MIX, place.astype("u8") + np.uint64(1)), ends - lens)
        at.append(np.arange(len(words)))
        bucket.append(whole * MIX >> np.uint64(48))
    return (np.concatenate(at), np.concatenate(bucket).astype("i8")) if words else (np.zeros(0, "i8"),) * 2


def bag(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of different words: the sum of the means over their grams, by
    ``length``."""
    word, bucket = grams(words)
    if not len(words):
        return np.zeros(0, "u2"), np.zeros(0, "f4")
    per = np.bincount(word, minlength=len(words))
    keys, where = np.unique(bucket, return_inverse=True)
    return keys.astype("u2"), np.bincount(where, (1 / per)[word] / length).astype("f4")


def read(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The different words of some texts, and each text as their numbers."""
    slot: dict[str, int] = {}
    at = [np.array([slot.setdefault(w, len(slot)) for w in WORDS.findall((t or "").lower())], "i8") for t in texts]
    return list(slot), at


def fresh(at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether a word did not stand among the ``window - 1`` words before: a word that is
    repeated over and over adds to a window once."""
    order = np.argsort(at, kind="stable")
    before = np.full(len(at), -window)
    again = at[order][1:] == at[order][:-1]
    before[order[1:][again]] = order[:-1][again]
    return np.arange(len(at)) - before >= window


@dataclass
class Model:
    """Embeddings of the buckets and a linear softmax (clean, toxic) of their average.
    As both are linear, a bucket comes to one number (``pull``), and the difference of
    the two logits of a bag to the mean of its words' pulls plus ``bias``."""

    embedding: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    scale: float = 1.0
    shift: float = 0.0  # moves the bias to where the held-back rows part best

    @property
    def pull(self) -> np.ndarray:
        return (self.embedding @ (self.weights[:, 1] - self.weights[:, 0])).astype("f8") * self.scale

    @property
    def bias(self) -> float:
        return float(self.offsets[1] - self.offsets[0]) - self.shift

    def words(self, words: list[str], pull: np.ndarray | None = None) -> np.ndarray:
        word, bucket = grams(words)
        return np.bincount(word, (self.pull if pull is None else pull)[bucket], len(words)) / np.maximum(1, np.bincount(word, minlength=len(words)))

    def windows(self, pulls: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logit of each window of a text (a short text is one window)."""
        n = min(WINDOW, len(at))
        if not n:
            return np.array([self.bias])
        run = np.concatenate([[0.0], np.cumsum(np.where(fresh(at), pulls[at], 0.0))])
        return (run[n:] - run[:-n]) / n + self.bias

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Of each text's worst window; words are looked at once a call."""
        words, at = read(texts)
        pulls = self.words(words)
        return np.array([self.windows(pulls, a).max() for a in at])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def start(seed: int = 6) -> Model:
    rng = np.random.default_rng(seed)
    return Model(rng.normal(0, 0.05, (BUCKETS, DIM)).astype("f4"), rng.normal(0, 0.5, (DIM, 2)).astype("f4"), np.zeros(2, "f4"))


def widened(v: np.ndarray) -> np.ndarray:
    return v.astype("f4") / HALF


def gradients(m: Model, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of some bags, and its gradients by embedding, weights, offsets."""
    h = np.array([v @ m.embedding[at] if len(at) else np.zeros(DIM, m.embedding.dtype) for at, v in bags]) * m.embedding.dtype.type(m.scale)
    z = h @ m.weights + m.offsets
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    rows = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[rows, y], 1e-30)).mean())
    p[rows, y] -= 1
    p /= len(y)
    ge = np.zeros_like(m.embedding)
    for (at, v), g in zip(bags, (p @ m.weights.T) * m.scale, strict=True):
        ge[at] += np.outer(v, g)
    return loss, [ge, h.T @ p, p.sum(0)]


def train(m: Model, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int, seed: int = 7) -> None:
    """Embeddings and softmax together, by gradient descent with momentum over
    mini-batches; steps are as long as the bags' sizes allow.  The bags stay in half
    precision; a batch at a time is widened."""
    rng, order, k = np.random.default_rng(seed), np.arange(len(bags)), len(bags)
    size = np.mean([((widened(v) * m.scale) ** 2).sum() for _, v in bags])
    rates = RATE / max(1.0, float(size)), 0.1, 0.1
    moved = [np.zeros_like(x) for x in (m.embedding, m.weights, m.offsets)]
    for _ in range(steps):
        if k + 128 > len(order):
            rng.shuffle(order)
            k = 0
        rows = order[k : k + 128]
        k += 128
        _, g = gradients(m, [(bags[r][0], widened(bags[r][1])) for r in rows], y[rows])
        for x, d, v, rate in zip((m.embedding, m.weights, m.offsets), g, moved, rates, strict=True):
            v *= MOMENTUM
            v += d
            x -= np.asarray(rate * v, x.dtype)


def edge(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(weighted errors, the middle of the gap) of the cut of z with fewest errors."""
    o = np.argsort(z, kind="stable")
    z, t, u = z[o], y[o] == 1, weight[o]
    wrong = np.concatenate([[0], np.cumsum(u * t)]) + np.concatenate([np.cumsum((u * ~t)[::-1])[::-1], [0]])
    real = np.concatenate([[True], z[1:] > z[:-1], [True]])  # a cut parts different values
    k = int(np.argmin(np.where(real, wrong, np.inf)))
    low, high = z[k - 1] if k else z[0] - 1, z[k] if k < len(z) else z[-1] + 1
    return float(wrong[k]), float((low + high) / 2)


def worst_windows(m: Model, text: str | None, pulls: np.ndarray, words: list[str], at: np.ndarray, y: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bags of the worst windows of a text, each without the words of those before; of a
    clean text also as many others (by its length, so that they are the same again)."""
    out, left = [], at
    for _ in range(WORST):
        if len(left):
            k, n = int(np.argmax(m.windows(pulls, left))), min(WINDOW, len(left))
            out.append([words[x] for x in left[k : k + n][fresh(left)[k : k + n]]])
            left = np.concatenate([left[:k], left[k + n :]])
    if not y and len(at) > WINDOW:
        rng = np.random.default_rng(len(text or ""))
        for k in rng.integers(0, len(at) - WINDOW, WORST).tolist():
            out.append([words[x] for x in at[k : k + WINDOW][fresh(at)[k : k + WINDOW]]])
    return [bag(w, min(WINDOW, len(at))) for w in out]


BAG = "doc_id long, y double, k binary, v binary"


def _collected(df: DataFrame, make) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Bags of a bounded sample, in the order of ids; weights in half precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [(i, t, pack(k), (v * HALF).astype("f2").tobytes()) for i, t, (k, v) in make(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.binary(), pa.binary()))], names=["doc_id", "y", "k", "v"])

    rows = df.select("doc_id", "text", "y").mapInArrow(run, BAG).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["k"], r["v"]))
    return [(unpack(bytes(r["k"]), "<u2"), np.frombuffer(r["v"], "f2")) for r in rows], np.array([int(r["y"]) for r in rows])


def _whole(ids: list, texts: list, ys: list) -> Iterator[tuple]:
    for i, t, y in zip(ids, texts, ys, strict=True):
        words = read([t])[0]
        yield i, y, bag(words, max(1, len(words)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model | None:
    """Learns from at most ``bound`` labelled rows outside fold 0 of 5.  Three in four
    train: first on whole documents, then on the windows that the model of the round
    before finds worst (a toxic document's worst windows are toxic, a clean one's are
    not).  With the others the softmax's bias is set, errors weighted back to the
    shares there are, as the sample holds more toxic rows."""
    some = labels.where((fold("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    n = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    if not (n.get(0) and n.get(1)):
        return None
    one, other = (labelled(docs, some.where(F.col("toxic") == t), "toxic", 5, 0, most) for t, most in ((1, bound // 3), (0, bound - bound // 3)))
    sample = written(one.unionByName(other))
    test = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) == 0
    both = sample.groupBy(test.alias("test")).agg(F.count_distinct("y").alias("n")).where("n = 2").collect()
    if {r["test"] for r in both} != {True, False}:  # too few rows to hold some back
        test = None
    learn = sample if test is None else sample.where(~test)
    bags, y = _collected(learn, _whole)
    if len(set(y.tolist())) < 2:
        return None
    m = start()
    m.scale = float(1 / max(1e-9, np.mean([np.sqrt((widened(v) ** 2).sum()) for _, v in bags if len(v)] or [1.0])))
    train(m, bags, y, STEPS)
    for n_round in range(ROUNDS):

        def windows(ids: list, texts: list, ys: list) -> Iterator[tuple]:
            pull = m.pull
            for i, t, label in zip(ids, texts, ys, strict=True):
                words, (at,) = read([t])
                for b in worst_windows(m, t, m.words(words, pull), words, at, label):
                    yield i, label, b

        bags, y = _collected(learn, windows)
        if len(y):
            train(m, bags, y, ROUND_STEPS, n_round)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(m.logits(b.column(1).to_pylist()))], names=["y", "z"])

    got = (sample if test is None else sample.where(test)).select("doc_id", "text", "y").mapInArrow(tried, "y double, z double").collect()
    z, y = np.array([r["z"] for r in got]), np.array([r["y"] for r in got])
    m.shift = edge(z, y, np.where(y == 1, n[1] / max(1, y.sum()), n[0] / max(1, (1 - y).sum())))[1]
    return m


def score(docs: DataFrame, model: Model | None, carry: list[str] = ["doc_id"]) -> DataFrame:
    """carry columns and score of every row, 0.5 where there is no model."""
    schema, names = docs.select(*carry).schema.add("score", "double"), [*carry, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.score(b.column(0).to_pylist()) if model else np.full(len(b), 0.5))], names=names)

    return docs.select(F.col("text").alias("_read"), *carry).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from at most ``bound`` rows of ``labels`` (doc_id, toxic) outside fold 0 of 5
    (toxic rows a third at most).  The score is the softmax of the averaged subword bag
    of a window of ``WINDOW`` words, for the window of the whole text where it is
    largest, so a long text hides nothing.  Only the text is looked at.

    Nulls: a null text counts as empty; rows of labels with a null
    id or label teach nothing; a null id has held_out null.  Repeated rows are scored
    each.  Without both labels every score is 0.5.  Empty tables give empty results;
    other columns are ignored.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, bound))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_toxicity_subwords": op6}
ORACLE_SQL: dict[str, str] = {}
