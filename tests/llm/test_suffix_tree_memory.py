"""Steps of the suffix tree hold little of what they read."""

import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa

from alertweave.llm import suffix_tree_lm as lm


def test_word_counts_hold_little(spark):
    train = MagicMock()
    lm._word_counts(train, 509)
    run = train.select.return_value.mapInArrow.call_args[0][0]
    words = [" ".join(f"w{i}" for i in range(a, a + 25_000)) for a in range(0, 1_000_000, 25_000)]
    assert [part.num_rows for part in run(iter([pa.RecordBatch.from_arrays([pa.array(["a b"])], names=["text"])]))] == [2]
    tracemalloc.start()
    try:
        n = sum(part.num_rows for part in run(pa.RecordBatch.from_arrays([pa.array([w])], names=["text"]) for w in words))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1_000_000
    assert peak < 48e6


def test_coded_texts_are_worked_on_in_parts():
    sizes = [0, 5, lm.PART_WORDS + 7, 3, lm.PART_WORDS // 2, lm.PART_WORDS // 3, lm.PART_WORDS // 2, 0]
    cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    codes = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.arange(cuts[-1], dtype=np.int32)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), codes], names=["row", "codes"])
    parts = list(lm._coded_parts(iter([batch.slice(0, 0), batch])))
    assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([batch]).combine_chunks())
    assert all(p.num_rows == 1 or len(p.column("codes").flatten()) <= lm.PART_WORDS for p in parts)
    assert max(p.num_rows for p in parts) > 1
