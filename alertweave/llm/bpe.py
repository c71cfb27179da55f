"""Byte-level BPE by merge replay over the distinct words of a block of the corpus.

A task works through its documents in blocks. The block's distinct words (matches of the pattern) are laid out as one
array of byte tokens. An inverted index holds, for each merge rank, the places of the pairs that it joins. Ranks are
taken in ascending order; each is applied at all its places at once, from left to right where they overlap, and only
the pairs next to a merge are looked up anew and entered under their ranks. Documents are then their words' ids in a
row. Blocks are bounded, so a task's memory is; the words that a worker met before are remembered up to a bound.

The replay joins a pair wherever the joined bytes have a rank, as the tiktoken library does, and a word that is itself
in the vocabulary is one token. A pair that arises in a merge may have a lower rank than the merge; within such a word
the order of steps matters, so it is encoded again on its own, step by step.

A null text is empty and has no ids. Rows that repeat an id are encoded each.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm.common import over_texts, read


class Ranks:
    """A vocabulary of byte strings by rank, and the rank that each pair of tokens joins to."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = {i: token for token, i in self.ids.items()}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self.size = max(self.ids.values()) + 1
        keys, ranks = [], []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(rank)
        order = np.argsort(keys)
        self.keys, self.ranks = np.array(keys, dtype=np.int64)[order], np.array(ranks, dtype=np.int64)[order]

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for a pair that is never joined."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def stepwise(self, word: bytes) -> list[int]:
        """One word, the lowest rank first and the leftmost of equals."""
        n = len(word)
        parts: list[bytes] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, bytes]] = []

        def enter(i: int) -> None:
            if 0 <= i and after[i] < n and (rank := self.ids.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(queue, (rank, i, both))

        for i in range(n - 1):
            enter(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j == n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, b"", after[j]
            if after[j] < n:
                before[after[j]] = i
            enter(before[i])
            enter(i)
        return [self.ids[p] for p in parts if p]


@functools.cache
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def _left_to_right(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending places, those that stay if a pair may not begin where the one before it ends."""
    chained = np.zeros(len(at), dtype=bool)
    chained[1:] = after[at[:-1]] == at[1:]
    if not chained.any():
        return at
    head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - head) % 2 == 0]


def replay(words: list[bytes], vocabulary: Ranks) -> list[list[int]]:
    """Ids of each word, by all merges in rank order over all words at once."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    token = vocabulary.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
    n = len(token)
    owner = np.repeat(np.arange(len(words)), sizes)
    # Neighbours within the word; n stands for none.
    last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
    after = np.append(np.where(last, n, np.arange(1, n + 1)), n)
    before = np.full(n + 1, n)
    before[after[:n][~last]] = np.flatnonzero(~last)
    alive, odd = np.ones(n, dtype=bool), np.zeros(len(words), dtype=bool)
    places: dict[int, list[np.ndarray]] = defaultdict(list)
    queue: list[int] = []

    def enter(at: np.ndarray, current: int) -> None:
        """Index the pairs that begin at these places under their ranks."""
        at = at[after[at] < n]
        rank = vocabulary.of_pairs(token[at], token[after[at]])
        odd[owner[at[(rank >= 0) & (rank < current)]]] = True
        at, rank = at[rank > current], rank[rank > current]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else []
        for i, start in enumerate(first):
            r = int(rank[start])
            if r not in places:
                heapq.heappush(queue, r)
            places[r].append(at[start : first[i + 1] if i + 1 < len(first) else len(at)])

    enter(np.arange(n), -1)
    while queue:
        r = heapq.heappop(queue)
        held = places.pop(r)
        at = np.sort(held[0]) if len(held) == 1 else np.unique(np.concatenate(held))
        at = at[alive[at] & (after[at] < n)]
        at = at[vocabulary.of_pairs(token[at], token[after[at]]) == r]
        at = _left_to_right(at, after)
        if not len(at):
            continue
        gone = after[at]
        token[at] = r
        alive[gone] = False
        after[at] = after[gone]
        inner = after[at] < n
        before[after[at][inner]] = at[inner]
        near = before[at]
        enter(np.unique(np.concatenate((at, near[near < n]))), r)

    left = np.flatnonzero(alive)
    bounds = np.searchsorted(owner[left], np.arange(len(words) + 1))
    ids = token[left].tolist()
    out = [ids[bounds[i] : bounds[i + 1]] for i in range(len(words))]
    for i, word in enumerate(words):
        if word in vocabulary.ids:
            out[i] = [vocabulary.ids[word]]
        elif odd[i]:
            out[i] = vocabulary.stepwise(word)
    return out


class _Known(dict):
    """What a worker remembers of a vocabulary: ids as text, their number, and their bytes, for each word."""


@functools.cache
def _memory(path: str) -> _Known:
    return _Known()


def _learn(words: set[str], path: str, most: int) -> dict[str, tuple[str, int, bytes]]:
    known, vocabulary = _memory(path), ranks_of(path)
    new = [w for w in words if w not in known]
    if len(known) + len(new) > most:
        known.clear()
        new = list(words)
    if new:
        for w, ids in zip(new, replay([w.encode() for w in new], vocabulary), strict=True):
            known[w] = (",".join(map(str, ids)), len(ids), b"".join(map(vocabulary.bytes.__getitem__, ids)))
    return known


def encoded(
    docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, most: int = 250_000
) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and decoded (bytes) of each document."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        cut = regex.compile(pattern)
        texts = [cut.findall(t or "") for t in part.column("text").to_pylist()]
        known = _learn({w for words in texts for w in words}, path, most)
        n, ids, decoded = [], [], []
        for words in texts:
            rows = [known[w] for w in words]
            ids.append(",".join([r[0] for r in rows]))
            n.append(sum([r[1] for r in rows]))
            decoded.append(b"".join([r[2] for r in rows]))
        arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids", "decoded"])

    return over_texts(docs.select("doc_id", "text"), step, "doc_id long, n_tokens long, ids string, decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
