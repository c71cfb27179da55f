"""Packing holds little for each part of the texts that it works on."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from alertweave.llm import packing
from alertweave.llm.common import slices


def test_parts_of_a_large_batch_take_little_memory(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(packing, "over_texts", lambda df, step, schema, **more: steps.append((step, more.get("limit", 4 << 20))))
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)
    (step, limit), r = steps[0], random.Random(1)
    texts = [" ".join(r.choice(("a", "of", "the", "dog")) for _ in range(2_000)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], names=["doc_id", "text"])
    step(batch.slice(0, 1))
    tracemalloc.start()
    try:
        rows = sum(step(part).num_rows for part in slices(batch, "text", limit))
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    assert rows == 600


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.__dict__.update(inner=inner, texts=0)

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def __setattr__(self, name, value):
        setattr(self.inner, name, value)

    def encode_batch_fast(self, texts, **more):
        self.__dict__["texts"] += len(texts)
        return self.inner.encode_batch_fast(texts, **more)


def test_plain_words_are_tokenised_together():
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    plain = sorted({"".join(r.choice("abcdeßéñü") for _ in range(r.randint(1, 12))) for _ in range(4_000)})
    odd = ["İa", "ǅ", "e\u0301t", "it's", "a.b", "x2y", "Éa", "東京", "<|endoftext|>", "ʼn", "a\u00adb"]
    words = [w for i, w in enumerate(plain) for w in (w, odd[i % len(odd)])] + [plain[0] + "?!", "b&*"]
    memory = packing._Memory(path)
    whole = [e.ids for e in memory.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    memory.tokenizer = Counting(memory.tokenizer)
    names = list(dict.fromkeys(words))
    number = dict(zip(names, memory.look_up(names).tolist(), strict=True))
    assert memory.tokenizer.texts < len(plain) / 20
    bounds = np.concatenate(([0], memory.stops))
    assert [memory.ids[bounds[number[w]] : bounds[number[w] + 1]].tolist() for w in words] == whole


def test_words_of_a_tokenizer_without_ends_are_tokenised_each(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.BPE(vocab={"a": 2, "b": 3, "ab": 4}, merges=[("a", "b")]))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(path := str(tmp_path / "plain.json"))
    ids, bounds = packing.token_ids(pa.array(["ab a", None, "b. aab"]), path)
    assert ids.tolist() == [4, 2, 1, 1, 3, 2, 4, 1] and bounds.tolist() == [0, 3, 4, 8]
