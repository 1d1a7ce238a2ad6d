"""Operator 5: BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import pack, parts, slices, table, unpack, written

CHUNK_BYTES = 48 << 20  # text whose words are held together
BATCH_TOKENS = 1 << 20  # ids that leave a chunk at once
PLACED = "chunk long, shard int, docs array<long>, lens binary, n long, data binary"
NAMES = ["chunk", "shard", "docs", "lens", "n", "data"]
TYPES = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary())


@functools.lru_cache(2)
def load(model: str):
    """A tokenizer without truncation and padding; a worker reads it once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(model)
    tok.no_truncation()
    tok.no_padding()
    return tok


def require_word_model(model: str) -> None:
    """Words may be encoded by themselves only if white space always parts them, and
    pieces joined by blanks only if there is no decoder."""
    spec = json.loads(model)
    split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    if spec.get("decoder") or spec.get("post_processor") or not any(x["behavior"] == "Removed" and x["invert"] and "\\s" in x["pattern"].get("Regex", "") for x in split):
        raise ValueError("the distinct-word table needs a tokenizer that drops white space and has no decoder")


class Slots(dict):
    """A number for each different word, in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers most of which are small: those of one, two and four bytes by themselves."""
    width = (x >= 1 << 8).astype("u1") + (x >= 1 << 16).astype("u1")
    streams = [pack(width, 9), *(pack(x[width == k].astype(t), 9) for k, t in enumerate(("u1", "<u2", "<u4")))]
    return b"".join(len(z).to_bytes(8, "little") + z for z in streams)


def unpack_numbers(data: bytes) -> np.ndarray:
    streams = []
    while data:
        n = int.from_bytes(data[:8], "little")
        streams.append(data[8 : 8 + n])
        data = data[8 + n :]
    width = unpack(streams[0], "u1")
    out = np.empty(len(width), "<u4")
    for k, t in enumerate(("u1", "<u2", "<u4")):
        out[width == k] = unpack(streams[k + 1], t)
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES, strict=True)], names=NAMES)


def _split(shards: int, chunk_bytes: int):
    """Chunks of documents: their different words by the shard of their hash, and the
    documents as numbers of words.  Frequent words have small numbers.  Only ASCII
    white space parts words here; what other there is stays in a word and is left to
    the tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0

        def flush(ids: list, slots: Slots, at: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal count
            chunk, words = part << 32 | count, list(slots)
            count += 1
            every = np.concatenate(at)
            order = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
            number = np.empty(len(words), "<u4")
            number[order] = np.arange(len(words), dtype="<u4")
            of = np.array([zlib.crc32(w) % shards for w in words], "<u4")[order]
            rows = [(chunk, None, ids, pack(np.array([len(a) for a in at], "<u4")), len(words), pack_numbers(number[every] if len(words) else every)), (chunk, -1, None, None, len(words), pack(of))]
            by = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[by], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(ends)).tolist():
                own = order[by[ends[s] : ends[s + 1]]].tolist()
                rows.append((chunk, s, None, None, len(own), zstandard.compress(b"\n".join([words[k] for k in own]), 9)))
            return _rows(rows)

        ids, slots, at, held = [], Slots(), [], 0
        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                ids.append(i)
                at.append(np.fromiter(map(slots.__getitem__, words), "<u4", len(words)))
                held += len(t or "")
                if held >= chunk_bytes:
                    yield flush(ids, slots, at)
                    ids, slots, at, held = [], Slots(), [], 0
        if ids:
            yield flush(ids, slots, at)

    return run


def _encode(model):
    """One word shard, chunk after chunk: each distinct word is encoded once and its ids
    are kept; what is held is the shard's vocabulary, however many chunks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tok, ids = load(model.value), {}
        for b in batches:
            for chunk, shard, n, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "shard", "n", "data")), strict=True):
                words = zstandard.decompress(data).split(b"\n")
                new = [w for w in words if w not in ids]
                for k in range(0, len(new), 20_000):
                    some = new[k : k + 20_000]
                    for w, e in zip(some, tok.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False), strict=True):
                        ids[w] = np.array(e.ids, "<u4").tobytes()
                per = [ids[w] for w in words]
                lens = np.array([len(p) >> 2 for p in per], "<u4")
                yield _rows([(chunk, shard, None, pack(lens), n, pack(np.frombuffer(b"".join(per), "<u4"), 9))])

    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One chunk: the ids of its words back to its documents, by position."""
    of_shard, docs, of = [], None, None
    for b in batches:
        for s, d, n, x, data in zip(*(b.column(c).to_pylist() for c in ("shard", "docs", "lens", "n", "data")), strict=True):
            if s is None:
                docs = d, unpack(n, "<u4").astype("i8"), unpack_numbers(data)
            elif s < 0:
                of = unpack(data, "<u4")
            else:
                of_shard.append((s, unpack(n, "<u4"), unpack(data, "<u4")))
    doc_ids, n_words, slots = docs
    none = [np.zeros(0, "<u4")]
    of_shard.sort(key=lambda x: x[0])
    ids = np.concatenate([x for *_, x in of_shard] or none)
    back = np.argsort(of, kind="stable")  # words in the order in which the shards gave them
    lens = np.empty(len(of), "i8")
    lens[back] = np.concatenate([n for _, n, _ in of_shard] or none)
    starts = np.empty(len(of), "i8")
    starts[back] = np.cumsum(lens[back]) - lens[back]
    ends = np.cumsum(n_words)
    tokens = np.concatenate([[0], np.cumsum(lens[slots])])[np.concatenate([[0], ends])]  # before each document
    cut = 0
    while cut < len(doc_ids):
        to = max(cut + 1, int(np.searchsorted(tokens, tokens[cut] + BATCH_TOKENS, side="right")) - 1)
        some = slots[ends[cut] - n_words[cut] : ends[to - 1]]
        n = lens[some]
        total = int(n.sum())
        mine = ids[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(total)].astype("<i4")
        at = (tokens[cut : to + 1] - tokens[cut]).tolist()
        sha = [hashlib.sha256(mine[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:])]
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(mine, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[cut:to], pa.int64()), pa.array(np.diff(at)), pa.array(sha, pa.string()), lists], names=["doc_id", "n_tokens", "ids_sha256", "ids"])
        cut = to


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, shards: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and ids of every document.

    Documents are split at white space.  A chunk of them becomes numbers of words, and
    its different words go, packed, to the shard of their hash (``shards`` of them; as
    many as there are shuffle partitions).  A shard encodes each distinct word once,
    whatever the number of chunks; the ids return to the chunk and are joined to the
    numbers by position.  Equal to encoding the whole text, as white space always
    parts words here.  Memory: a chunk, or a shard's vocabulary; a word reaches its
    shard once a chunk, however often it occurs.

    Nulls: a null text is empty (0 tokens); a null id is carried.  Repeated rows give
    one row each.  An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    require_word_model(model)
    model, shards = spark.sparkContext.broadcast(model), shards or parts(spark)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    split = written(read.mapInArrow(_split(shards, chunk_bytes), PLACED))
    ids = split.where("shard >= 0").groupBy("shard").applyInArrow(_encode(model), PLACED)
    both = split.where("shard is null or shard < 0").unionByName(ids)
    return both.groupBy("chunk").applyInArrow(_join, "doc_id long, n_tokens long, ids_sha256 string, ids array<int>")


def pieces_of(model_path: str) -> list[str | None]:
    """The table of pieces: the piece of each id, None where an id has none."""
    with open(model_path, encoding="utf-8") as f:
        tok = load(f.read())
    return [tok.id_to_token(i) for i in range(max(tok.get_vocab(with_added_tokens=True).values()) + 1)]


def decoded(ids: Column, model_path: str) -> Column:
    """The text of ``ids``: each is joined to its piece by its place in the table of
    pieces (as many as the vocabulary, so every task has it; pieces hold no line
    break), and pieces are put together by position.  Ids without a piece are passed
    over, as the library does; null or empty ids give the empty text."""
    pieces = F.split(F.lit("\n".join(p or "" for p in pieces_of(model_path))), "\n")
    found = F.transform(ids, lambda i: F.nullif(F.get(pieces, i), F.lit("")))
    return F.coalesce(F.array_join(found, " "), F.lit(""))


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded of every row (``decoded``); ids may be null or repeat."""
    return tokens.select(F.col(id_col).alias("doc_id"), decoded(F.col(ids_col), model_path).alias("decoded"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("word_bpe_49k.json")
    ids = encode(table(spark, sf_dir, "documents"), model)
    return ids.select("doc_id", "n_tokens", "ids_sha256", F.sha2(decoded(F.col("ids"), model).cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe_distinct_words": op5}
ORACLE_SQL: dict[str, str] = {}
