"""Operator 7: repeated passages, by an FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import parts, slices, small_batches, table
from .fmindex import FMIndex

WINDOW = 13
GRAM = 4  # words whose hash routes a window
CHUNK_BYTES = 8 << 20
BLOCK_WORDS = 1 << 16  # words that are cut at once, and the rest of a document
SPLIT = 1  # shards for each shuffle partition: more hold less at once, but pack worse
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Half of a minimizer's hash is sent: two that share it are only compared needlessly.
HEAD = np.dtype([("mz", "<u4"), ("doc", "<i8"), ("text", "<i4"), ("at", "<i4"), ("words", "<u4"), ("size", "<u4")])
ROUTED = "shard long, doc_id long, text_key int, data binary"
SPANS = "doc_id long, text_key int, spans binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def minimizers(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of word hashes the place of its least gram (the leftmost of
    equals), and the hash of the gram at each place.  Equal windows choose alike."""
    g = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        g = g * MIX + h[k : len(h) - gram + 1 + k]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    n = len(h) - window + 1
    best, at = g[:n].copy(), np.zeros(n, "i8")
    for k in range(1, window - gram + 1):
        less = g[k : k + n] < best
        best[less] = g[k : k + n][less]
        at[less] = k
    return at + np.arange(n), g


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intervals [a, b) joined where they touch, as pairs."""
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return np.stack([a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]], 1).astype("<i4")


def _cut(shards: int, window: int, gram: int, chunk: int):
    """Documents to segments: runs of windows with one minimizer.  A segment goes to the
    shard of its minimizer once a chunk, with the smallest document that has it;
    larger documents of the chunk with the very segment lose it at once."""

    def segments(docs: list[tuple[int, int, np.ndarray, bytes]], hashes: np.ndarray, sizes: np.ndarray):
        """(minimizer, index of docs, from, to, bytes) of the segments of some documents."""
        at = np.concatenate([d[2] for d in docs])
        ends = np.cumsum(sizes[at])
        lens = np.array([len(d[2]) for d in docs])
        which = np.repeat(np.arange(len(docs)), lens)
        place, g = minimizers(hashes[at], window, gram)
        ok = np.flatnonzero(which[: len(place)] == which[window - 1 :])
        new = np.flatnonzero(np.concatenate([[True], (place[ok][1:] != place[ok][:-1]) | (ok[1:] != ok[:-1] + 1)]))
        a, b = ok[new], ok[np.append(new[1:] - 1, len(ok) - 1)] + window
        buf, begins = b" ".join(d[3] for d in docs), np.concatenate([[0], ends])
        texts = [buf[x:y] for x, y in zip(begins[a].tolist(), (begins[b] - 1).tolist(), strict=True)]
        first = (np.cumsum(lens) - lens)[which[a]]
        return g[place[a]], which[a], a - first, b - first, texts

    def flush(docs: list[tuple[int, int, np.ndarray, bytes]], slot: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        docs = sorted(docs, key=lambda d: d[:2])
        if not docs:
            return
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in slot], "u8")
        sizes = np.array([len(w) + 1 for w in slot], "i8")
        owner: dict[bytes, int] = {}
        texts, heads, shard, gone = [], [], [], []
        # few words at a time, as arrays of each word and window are many times a text
        edge = np.flatnonzero(np.diff(np.cumsum([len(d[2]) for d in docs]) // BLOCK_WORDS)) + 1
        for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(docs)], strict=True):
            mz, doc, a, b, found = segments(docs[i:j], hashes, sizes)
            doc += i
            kept, lost = [], []
            for k, (d, t) in enumerate(zip(doc.tolist(), found, strict=True)):
                if owner.setdefault(t, docs[d][0]) == docs[d][0]:
                    kept.append(k)
                    texts.append(t)
                else:
                    lost.append(k)
            kept, lost = np.array(kept, "i8"), np.array(lost, "i8")
            head = np.zeros(len(kept), HEAD)
            own = doc[kept].tolist()
            head["mz"], head["doc"], head["text"], head["at"], head["words"] = mz[kept] >> np.uint64(32), [docs[d][0] for d in own], [docs[d][1] for d in own], a[kept], (b - a)[kept]
            head["size"] = [len(found[k]) for k in kept.tolist()]
            heads.append(head)
            shard.append((mz[kept] >> np.uint64(20)) % np.uint64(shards))
            if len(lost):
                d = doc[lost]
                cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]]))
                for x, y in zip(cut, cut[1:]):
                    n, k, *_ = docs[d[x]]
                    gone.append((n % shards, n, k, merged(a[lost[x:y]], b[lost[x:y]]).tobytes()))
        del owner
        head, shard = np.concatenate(heads), np.concatenate(shard)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype="u8"))
        rows = []
        for s in range(shards):
            o = order[cuts[s] : cuts[s + 1]]
            if len(o):
                columns = b"".join(np.ascontiguousarray(head[f][o]).view("u1").reshape(len(o), -1).T.tobytes() for f in HEAD.names)
                rows.append((s, None, None, len(o).to_bytes(4, "little") + zstandard.compress(columns + b"".join([texts[k] for k in o.tolist()]), 3)))
        rows += gone
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "doc_id", "text_key", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, slot, held = [], {}, 0
        for x in slices(batches, 100):
            for i, k, t in zip(*(x.column(c).to_pylist() for c in range(3)), strict=True):
                if i is not None and t:
                    words = words_of(t)
                    if len(words) >= window:  # a word is held once a chunk, texts hold its number
                        docs.append((i, k, np.array([slot.setdefault(w, len(slot)) for w in words], "i4"), b" ".join(words)))
                    held += len(t)
                if held >= chunk:
                    yield from flush(docs, slot)
                    docs, slot, held = [], {}, 0
        yield from flush(docs, slot)

    return run


def unpacked(data: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard

    n, raw, at = int.from_bytes(data[:4], "little"), zstandard.decompress(data[4:]), 0
    head = np.zeros(n, HEAD)
    for f in HEAD.names:
        w = HEAD[f].itemsize
        head[f] = np.ascontiguousarray(np.frombuffer(raw, "u1", n * w, at).reshape(w, n).T).reshape(-1).view(HEAD[f])
        at += n * w
    return head, raw[at:]


def repeats(head: np.ndarray, texts: list[bytes], window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(record, from, to): the intervals of the segments of one shard that stand in a
    smaller document.  Segments of equal text are one, of the smallest document; the
    others lie in it whole, and go without the index.  What then shares a minimizer is
    indexed; texts are streamed through it, and reported is where their matching
    statistics reach the window in a range with a smaller document."""
    order = np.lexsort((head["at"], head["doc"]))
    owner: dict[bytes, int] = {}
    same: dict[int, list[int]] = {}
    for k in order.tolist():
        c = owner.setdefault(texts[k], k)
        if head["doc"][c] < head["doc"][k]:
            yield k, np.array([0]), np.array([head["words"][k]])
        else:
            same.setdefault(c, []).append(k)
    contents = np.array(list(same), "i8")
    _, group, n = np.unique(head["mz"][contents], return_inverse=True, return_counts=True)
    contents = contents[n[group] > 1]
    if not len(contents):
        return
    symbol: dict[bytes, int] = {}
    split = [texts[k].split(b" ") for k in contents.tolist()]
    text = np.array([x for ws in split for x in (*(symbol.setdefault(w, len(symbol) + 1) for w in ws), 0)])
    lens = np.array([len(ws) for ws in split])
    first = np.cumsum(lens + 1) - lens - 1
    doc_ids, doc = np.unique(head["doc"][contents], return_inverse=True)
    index = FMIndex(text, np.repeat(doc, lens + 1), window)
    # a text is streamed unless its document is the smallest that has the minimizer
    _, group = np.unique(head["mz"][contents], return_inverse=True)
    least = np.full(group.max() + 1, len(doc_ids))
    np.minimum.at(least, group, doc)
    ask = np.flatnonzero(doc > least[group])
    per = lens[ask] - window + 1
    of = np.repeat(ask, per)
    off = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    length, low, high = index.matching_statistics(text, first[of] + off + window, window)
    long = np.flatnonzero(length >= window)
    hit = long[index.least_owner(low[long], high[long]) < doc[of[long]]]
    of, off = of[hit], off[hit]
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
    for x, y in zip(cut, cut[1:]):
        for k in same[int(contents[of[x]])]:
            yield k, off[x:y], off[x:y] + window


def _search(window: int):
    def run(group: pa.Table) -> pa.Table:
        out, blobs = [], []
        for i, k, x in zip(*(group.column(c).to_pylist() for c in ("doc_id", "text_key", "data")), strict=True):
            if i is None:
                blobs.append(unpacked(x))
            else:
                out.append((i, k, x))
        if blobs:
            head = np.concatenate([h for h, _ in blobs])
            # minimizers of one document only are passed over
            order = np.lexsort((head["doc"], head["mz"]))
            mz, doc = head["mz"][order], head["doc"][order]
            run_at = np.concatenate([[True], mz[1:] != mz[:-1]])
            g = np.cumsum(run_at) - 1
            last = np.append(np.flatnonzero(run_at)[1:] - 1, len(mz) - 1)
            shared = np.zeros(len(head), bool)
            shared[order] = (doc[run_at] != doc[last])[g]
            texts, at = [], 0
            for h, raw in blobs:
                ends = np.cumsum(h["size"], dtype="i8")
                for k in np.flatnonzero(shared[at : at + len(h)]).tolist():
                    texts.append(raw[ends[k] - h["size"][k] : ends[k]])
                at += len(h)
            del blobs
            head = head[shared]
            for k, a, b in repeats(head, texts, window):
                s = merged(a.astype("i8"), b.astype("i8")) + head["at"][k]
                out.append((int(head["doc"][k]), int(head["text"][k]), s.astype("<i4").tobytes()))
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "text_key", "spans"])

    return run


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, text_key, spans (pairs of word numbers, packed) of what is repeated."""
    spark = docs.sparkSession
    cut = docs.select("doc_id", F.hash("text").alias("text_key"), "text").mapInArrow(_cut(SPLIT * parts(spark), window, gram, chunk_bytes), ROUTED)
    return cut.groupBy("shard").applyInArrow(_search(window), SPANS)


def covered(n: int, packed: list[bytes] | None) -> np.ndarray:
    """Which of n words lie in a span."""
    edge = np.zeros(n + 1, "i4")
    for x in packed or ():
        s = np.frombuffer(x, "<i4").reshape(-1, 2)
        np.add.at(edge, s[:, 0], 1)
        np.add.at(edge, s[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def _joined(docs: DataFrame, window: int, carry: list[str]) -> DataFrame:
    """_text, _spans, carry of every row."""
    base = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    found = spans(base, window).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list("spans").alias("_spans"))
    rows = base.select(F.col("text").alias("_text"), F.hash("text").alias("_own"), *carry)
    return rows.join(found, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_key")), "left").select("_text", "_spans", *carry)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    Words are runs of other than ASCII white space.  Removed is each word covered by a
    window of ``window`` words that also starts in a document with a smaller id.
    Windows are routed by their minimizer, so equal ones meet in one shard.  Segments
    (runs of windows with one minimizer) of equal text are settled by a table of texts,
    in a chunk of documents before they are sent and in the shard (most of what
    repeats: whole copies); what is left and shares a minimizer goes through the shard's
    FM-index, whose matching statistics tell which windows a smaller document has.
    Nothing is capped: a hot passage reaches a shard once a chunk of documents.

    Nulls: a null text has no words; a row with a null id loses nothing and takes
    nothing away.  Rows that repeat an id don't take from one another.  Texts of fewer
    words than a window are kept.  An empty table gives no rows; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t, s, i in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                words = words_of(t)
                lost = covered(len(words), s)
                kept = [w for w, x in zip(words, lost.tolist(), strict=True) if not x] if s else words
                rows.append((i, len(words), int(lost.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _joined(docs, window, ["doc_id"]).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, carry: list[str], window: int = WINDOW) -> DataFrame:
    """carry columns, text without the repeated words, n_removed.  What stands between
    kept words stays as it is; a text that loses nothing is unchanged."""
    names = [*carry, "text", "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+\s?")
        for b in slices(batches):
            texts, lost_n = [], []
            for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = 0
                if s:
                    lost = covered(len(words_of(t)), s).tolist()
                    n, at = sum(lost), iter(lost)
                    t = word.sub(lambda m: "" if next(at) else m[0], t)
                texts.append(t)
                lost_n.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(texts, pa.string()), pa.array(lost_n, pa.int64())], names=names)

    return _joined(docs, window, carry).mapInArrow(run, docs.select(*carry).schema.add("text", "string").add("n_removed", "long"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, array_to_string(w[(i + 1):(i + 13)], ' ') AS t FROM (SELECT *, unnest(range(len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT t, min(doc_id) AS least FROM s GROUP BY t),
hit AS (SELECT r, i FROM s JOIN m USING (t) WHERE doc_id > least),
gone AS (SELECT r, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, k: NOT list_contains(g, k - 1)), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r)"""

QUERIES = {"op7_fm_index_passages": op7}
ORACLE_SQL = {"op7_fm_index_passages": _SQL}
