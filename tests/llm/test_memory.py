"""What a Python worker holds besides texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
from siltlake.llm import substrings


def test_segments_are_cut_in_little_memory():
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 3000, 500)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array([0] * 800, pa.int32()), pa.array(texts)], names=["doc_id", "text_key", "text"])
    cut = substrings._cut(4, substrings.WINDOW, substrings.GRAM, 8 << 20)
    for _ in cut(iter([batch.slice(0, 20)])):  # imports
        pass
    tracemalloc.start()
    for _ in cut(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 22 * sum(map(len, texts)), peak / sum(map(len, texts))
