"""Packing of tokenised documents into sequences by patterns of lengths.

1. One pass over the texts tokenises, cuts longer documents into pieces of ``capacity`` and keeps lengths and checksums.
2. Pieces are counted by length: at most ``capacity`` numbers, whatever the corpus. This histogram is all that the
   plan needs, so it is made on the driver.
3. The plan. Lengths are rounded up to classes of ``grain`` tokens; every pattern of one to three classes that fills a
   sequence is enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded, and
   the patterns are laid out as often as the pieces allow. What they leave, and what they left open, is packed by best
   fit: longest first, into the least space that takes it. Both work on runs of equal pieces, so the plan is short.
4. Pieces of one length are numbered (counts for each length and salt, then positions within a salt) and find their
   sequence and offset in the plan by length and number.

A null text is empty and still has its end id. Empty tables give no rows. Rows that repeat an id are packed each.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertweave.llm.common import PART_BYTES, hold, over_texts, read
from alertweave.session import materialise

SALTS = 64
#: Words that no normaliser of ``_EVEN`` changes and no pattern splits: lower-case letters that are composed.
PLAIN = "^[a-zß-öø-ÿ]+$"
_EVEN = {"NFC", "Lowercase", "Replace"}
#: Plain words that are tokenised as one text.
TOGETHER = 50


class _Memory:
    """Ids of the words that a worker has met, in one array, up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = self._last()
        self.clear()

    def _last(self) -> np.ndarray | None:
        """Whether an id ends a word; None where ids do not tell, or where plain words may be changed."""
        from tokenizers import normalizers

        made = json.loads(self.tokenizer.to_str())
        suffix = made["model"].get("end_of_word_suffix")
        even = made["normalizer"] or {"normalizers": []}
        even = even.get("normalizers", [even])
        spaces = all(x.get("pattern") == {"Regex": r"\s+"} and x["content"] == " " for x in even if x["type"] == "Replace")
        if not suffix or not spaces or not {x["type"] for x in even} <= _EVEN:
            return None
        # Plain words are tokenised without what leaves them as they are.
        self.normalizers = normalizers.Sequence([]), self.tokenizer.normalizer or normalizers.Sequence([])
        vocabulary = made["model"]["vocab"]
        last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return last

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.stops = np.zeros(1 << 14, dtype=np.int64)

    def look_up(self, words: list[str], most: int = 250_000) -> np.ndarray:
        """The number of each word; words not met before are tokenised."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > most:
            self.clear()
            new = words
        if new:
            plain = pc.match_substring_regex(pa.array(new, pa.string()), PLAIN).to_pylist() if self.last is not None else [False] * len(new)
            for together in (TOGETHER, 1):
                part = [w for w, p in zip(new, plain, strict=True) if p == (together > 1)]
                if part:
                    self._learn(part, *self._encoded(part, together))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _encoded(self, words: list[str], together: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        if together == 1:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))
        texts = [" ".join(words[i : i + together]) for i in range(0, len(words), together)]
        self.tokenizer.normalizer = self.normalizers[0]
        try:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        finally:
            self.tokenizer.normalizer = self.normalizers[1]
        ids = np.fromiter(itertools.chain.from_iterable(found), "<u4")
        n = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        # Should a word have no end or several, each is tokenised by itself.
        return (ids, n) if len(n) == len(words) and n.sum() == len(ids) else self._encoded(words, 1)

    def _learn(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.index)
        begin = int(self.stops[n - 1]) if n else 0
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        for name, size in (("stops", n + len(words)), ("ids", begin + len(ids))):
            held = getattr(self, name)
            if size > len(held):
                setattr(self, name, np.concatenate((held, np.zeros(2 * size - len(held), held.dtype))))
        self.stops[n : n + len(words)] = np.cumsum(sizes) + begin
        self.ids[begin : begin + len(ids)] = ids


_memories: dict[str, _Memory] = {}


def _memory(path: str) -> _Memory:
    """The memory of a worker; it goes when the worker turns to another kind of work."""
    if path not in _memories:
        _memories[path] = _Memory(path)
        hold("packing", _memories.clear)
    return _memories[path]


#: Signs that a sentence or a word may end with; after a letter or digit they are tokens of their own.
SIGNS = ".,;:!?&$#%*"


@functools.cache
def _letter(c: str) -> bool:
    """Whether a character is still a letter or digit at its end when the tokenizer has composed and lower-cased it."""
    made = unicodedata.normalize("NFC", unicodedata.normalize("NFC", c).lower())
    return all(unicodedata.category(x[-1])[0] in "LN" for x in (c, made))


def _parts(words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Each word without the signs at its end, in lower case, and these signs; both parts tokenise by themselves.

    The tokenizer splits letters and digits from signs and lower-cases all but its special tokens.
    """
    words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
    short = pc.utf8_rtrim(words, characters=SIGNS)
    ends = pc.utf8_slice_codeunits(short, -1).dictionary_encode()
    letters = pa.array([c == "" or _letter(c) for c in ends.dictionary.to_pylist()], pa.bool_())
    whole = pc.invert(letters.take(ends.indices))
    short = pc.if_else(whole, words, short)
    # What stands after the short form: as it is ASCII, as many bytes as code points.
    sign_bytes = pc.subtract(pc.binary_length(words), pc.binary_length(short)).to_numpy(zero_copy_only=False)
    stops = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
    at = _spread(stops - sign_bytes, sign_bytes)
    data = pa.py_buffer(np.frombuffer(words.buffers()[2] or b"", np.uint8)[at])
    bounds = np.concatenate(([0], np.cumsum(sign_bytes))).astype(np.int32)
    signs = pa.StringArray.from_buffers(len(words), pa.py_buffer(bounds), data)
    return short.dictionary_encode(), signs.dictionary_encode()


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` places from ``first`` on, for each of them."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def token_ids(texts: pa.Array, path: str, end: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with the end id, and where each text begins.

    The tokenizer drops white space and merges nothing across it, so words are tokenised once for each distinct one,
    plain ones many at a time.
    """
    memory = _memory(path)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    coded = _parts(flat.dictionary)
    names = pc.unique(pa.concat_arrays([c.dictionary for c in coded]))
    known = memory.look_up(names.to_pylist())
    # Two units a word, of which the second may be empty.
    numbers = [known[pc.index_in(c.dictionary, names).to_numpy(zero_copy_only=False)] for c in coded]
    units = np.stack([x[c.indices.to_numpy(zero_copy_only=False)] for x, c in zip(numbers, coded, strict=True)], axis=1).reshape(-1)
    first = np.where(units > 0, memory.stops[units - 1], 0)
    n = memory.stops[units] - first
    # The end id is one more word.
    ids = np.append(memory.ids[_spread(first, n)], np.uint32(end))
    bounds = np.concatenate(([0], np.cumsum(n)[1::2], [len(ids)])).astype(np.int32)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    stops = np.cumsum(sizes)
    codes = np.insert(flat.indices.to_numpy(zero_copy_only=False), stops, len(flat.dictionary))
    out = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)).take(pa.array(codes))
    begin = np.concatenate(([0], stops + np.arange(1, len(sizes) + 1)))
    return out.flatten().to_numpy(zero_copy_only=False), out.offsets.to_numpy()[begin].astype(np.int64)


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each document."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = token_ids(part.column("text"), path)
        n = -(-np.diff(bounds) // capacity)
        owner = np.repeat(np.arange(part.num_rows), n)
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        a = bounds[owner] + start
        b = np.minimum(a + capacity, bounds[owner + 1])
        crc = [zlib.crc32(ids[i:j]) for i, j in zip(a, b, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").take(pa.array(owner)),
                pa.array(piece.astype(np.int32)),
                pa.array(start.astype(np.int64)),
                pa.array((b - a).astype(np.int64)),
                pa.array(crc, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return over_texts(docs.select("doc_id", "text"), step, schema, limit=PART_BYTES, owner="packing")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    right = a.T @ b
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-7 * max(1.0, np.abs(right).max()):
            break
        passive[j] = True
        while True:
            on = np.flatnonzero(passive)
            part = a[:, on]
            z = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(on)), right[on])
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = (x[on][low] / np.maximum(x[on][low] - z[low], 1e-12)).min()
            x[on] += step * (z - x[on])
            passive[on[x[on] <= 1e-9]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """One to three classes that fill ``classes`` exactly, the largest first."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(classes - a, a) for a in range(1, classes // 2 + 1)]
    out += [(classes - a - b, b, a) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    return out


class Plan:
    """Runs of pieces: of ``length``, from number ``first`` on, ``n`` pieces go to sequences ``seq`` and on, at ``offset``."""

    def __init__(self, histogram: dict[int, int], capacity: int, grain: int):
        self.capacity, self.sequences = capacity, 0
        self.left = {k: n for k, n in histogram.items() if n}
        self.used: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []
        # Open sequences by free space: (first sequence, how many of them).
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self._by_patterns(grain)
        self._by_best_fit()

    def _put(self, length: int, n: int, seq: int, space: int) -> None:
        self.runs.append((length, self.used[length], n, seq, self.capacity - space))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _lay(self, lengths: list[int], n: int) -> None:
        """n new sequences that begin with pieces of these lengths."""
        space = self.capacity
        for length in lengths:
            self._put(length, n, self.sequences, space)
            space -= length
        if space:
            self.free[space].append((self.sequences, n))
        self.sequences += n

    def _by_patterns(self, grain: int) -> None:
        classes = self.capacity // grain
        held = np.zeros(classes + 1)
        for length, n in self.left.items():
            held[-(-length // grain)] += n
        # Documents too short for a pattern of three are left to fill gaps.
        choice = [p for p in patterns(classes) if all(held[c] for c in p)]
        if not choice:
            return
        a = np.zeros((classes + 1, len(choice)))
        for j, p in enumerate(choice):
            for c in p:
                a[c, j] += 1
        counts = np.rint(nnls(a, held)).astype(int)
        of_class: dict[int, list[int]] = defaultdict(list)
        for length in sorted(self.left):
            of_class[-(-length // grain)].append(length)
        for j in sorted(np.flatnonzero(counts), key=lambda j: (len(choice[j]), -counts[j])):
            want = int(counts[j])
            while want:
                # The longest pieces that each class still has.
                lengths, taken = [], defaultdict(int)
                for c in choice[j]:
                    while of_class[c] and of_class[c][-1] not in self.left:
                        of_class[c].pop()
                    has = [x for x in reversed(of_class[c]) if self.left.get(x, 0) > taken[x]][:1]
                    if not has:
                        break
                    lengths.append(has[0])
                    taken[has[0]] += 1
                if len(lengths) < len(choice[j]):
                    break
                n = min(want, *(self.left[x] // taken[x] for x in lengths))
                self._lay(lengths, n)
                want -= n

    def _by_best_fit(self) -> None:
        spaces = np.zeros(self.capacity + 1, dtype=bool)
        spaces[list(self.free)] = True
        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                fits = np.flatnonzero(spaces[length:])
                if len(fits):
                    space = int(fits[0]) + length
                    seq, many = self.free[space].pop()
                    take = min(n, many)
                    if take < many:
                        self.free[space].append((seq + take, many - take))
                    if not self.free[space]:
                        spaces[space] = False
                else:
                    space, seq = self.capacity, self.sequences
                    take = -(-n // (self.capacity // length))
                    self.sequences += take
                self._put(length, take, seq, space)
                if space > length:
                    self.free[space - length].append((seq, take))
                    spaces[space - length] = True

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length and first number) with the first sequence and the offset of each run."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return (runs[:, 0] << 44) | runs[:, 1], runs[:, 3], runs[:, 4]


def pack(cut: DataFrame, capacity: int = 4096, grain: int = 16) -> DataFrame:
    """``cut`` (doc_id, piece, length and more) with sequence_id and offset."""
    cut = materialise(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")), "pieces")
    by_salt = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = [(r["length"], r["n"]) for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()]
    keys, seqs, offsets = Plan(dict(counts), capacity, grain).table()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = cut.withColumn("at", within - 1).join(base, ["length", "salt"]).withColumn("at", F.col("at") + F.col("base"))
    numbered = numbered.drop("salt", "base")
    plan = cut.sparkSession.sparkContext.broadcast((keys, seqs, offsets))
    names = [c for c in cut.columns if c != "salt"]

    def run(batches):
        keys, seqs, offsets = plan.value
        for part in batches:
            length, at = (part.column(c).to_numpy() for c in ("length", "at"))
            key = (length << 44) | at
            run = np.searchsorted(keys, key, side="right") - 1
            arrays = [part.column(c) for c in names]
            arrays += [pa.array(seqs[run] + key - keys[run]), pa.array(offsets[run])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in names)
    return numbered.select(*names, "at").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, grain: int = 16) -> DataFrame:
    """Documents as placed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, path, capacity), capacity, grain)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read(spark, sf_dir, "documents"))
