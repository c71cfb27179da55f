"""Language-model scores from a probabilistic suffix tree over words.

The tree has a small part that tasks hold, and a large part in written tables that grows with the corpus.

Symbols of the small part. Words that make up ``symbol_share`` of the training tokens or more are symbols of their own
(at most 1 / symbol_share of them); all others share the symbol of their ending (``endings`` of them), so that a rare
word still tells something about what follows. The end of a text is a symbol, and what a text begins after.

1. Words are counted over the whole training part, one row for each distinct word after a shuffle. Counts of words that
   make up ``count_share`` or more (at most 1 / count_share) are sent to the tasks, all others are looked up by a join.
   Then all texts are written once as numbers of words at hand and hashes of the others; later steps read these.
2. Contexts of one symbol that make up ``context_share`` of the tokens are the first state of the tree, with followers from
   ``follower_share`` on. A context is retained by a divergence test: its next-symbol distribution must diverge from that
   of its longest retained suffix by ``divergence`` (nats for each occurrence) or more.
3. From there on contexts are runs of whole words, of any length. Runs are counted level by level over all
   training texts and kept in written tables. The bars are absolute, so more text gives more and longer contexts: a context
   occurs ``context_least`` times (less in a small corpus: ``context_share`` of its tokens), a follower ``follower_least``
   times and saves ``gain`` nats or more over its occurrences. The same divergence test retains a context. The tree grows
   from its root: a context of two words is looked at if the second has several followers, a longer one if the one without its first
   word is retained and has several followers. It ends where nothing is retained.
4. Smoothing. A follower's count less ``discount`` over the context's count, plus what is left over times the
   distribution of the longest retained suffix; at the root (c + 0.5) / (N + 0.5 S). A rare word's share of its
   symbol is (c + 0.5) / (C + 0.5 (V + 1)) in the symbol's counts, with the convention of the base score: whatever was
   not seen is one more word.
5. Scoring. What a retained context changes is a sum of logarithms: one for the context, and one more for a kept follower.
   The frequent ones are at hand (from ``count_share`` on), all others go to the join as hashes like rare words, and come
   back as one sum for each document. A sketch of all states tells which hashes may be among them; those that are
   not find no partner in the join. The texts are scored in a few ranges of rows, whose hashes go when their sums are written.

All counts cover all training documents. A null text is empty: its one token is the end. A null id counts as training.
Rows that repeat an id are scored each. Without training documents the score is the base score. Words and runs of words are
compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm.common import PART_BYTES, has_bit, let_go, mixed, packed_bits, read, slices, small_batches, words_of
from alertweave.session import materialise

END = 0
#: Hashes of what a text begins after and of its end, which are no words.
START_HASH, END_HASH = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
_STEP, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x510E527FADE682D1)
#: Most cells of the sketches of contexts and states.
CELLS = 1 << 27
#: Words of a part of coded texts, and rows that a task gathers before it sums them up; both bound what a task holds.
PART_WORDS, GATHERED = 1 << 17, 400_000
#: Runs of words are counted in so many passes over the texts, each with its share of the runs, and texts are scored in so many ranges of
#: rows, one after the other, as what is shuffled for either takes more disk than all else; in fewer where there are fewer tokens than this for each.
PASSES, RANGES, TURN_TOKENS = 2, 4, 1 << 21
_CODED = "row long, doc_id long, held_out boolean, n_tokens long, near_base double, inner double, codes array<int>, rare array<long>, endings array<int>"


@dataclass
class Settings:
    symbol_share: float = 1e-4
    count_share: float = 2e-6
    context_share: float = 1e-4
    follower_share: float = 1e-6
    divergence: float = 0.01
    discount: float = 0.75
    endings: int = 509
    context_least: int = 200
    follower_least: int = 2
    gain: float = 4.0


@dataclass
class Level:
    """Contexts of one length. ``keys`` are sorted (context, follower) codes with the discounted share of each."""

    contexts: np.ndarray
    rest: np.ndarray
    keys: np.ndarray
    shares: np.ndarray


@dataclass
class Model:
    settings: Settings
    tokens: int = 0
    distinct: int = 0
    ends: int = 0
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    symbols: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    endings: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n_symbols: int = 1
    root: np.ndarray = field(default_factory=lambda: np.ones(1))
    under: np.ndarray = field(default_factory=lambda: np.ones(1))
    levels: list[Level] = field(default_factory=list)
    #: For each length of contexts in words: key, n and value (what a state adds to the logarithm) of its states.
    states: list[DataFrame] = field(default_factory=list)

    def held(self) -> Model:
        """What is sent to tasks."""
        return replace(self, states=[])

    def known_symbols(self) -> np.ndarray:
        """Symbols of the words at hand."""
        return np.where(self.symbols < 0, self.endings + 1, self.symbols)

    def least(self) -> float:
        s = self.settings
        return max(2.0, min(s.context_least, s.context_share * self.tokens))


def _found(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


class _Tokens:
    """Words of a part of the documents: hash and ending of each distinct one."""

    def __init__(self, texts: pa.Array, endings: int):
        self.words = words_of(texts, lower=True)
        raw = pc.cast(self.words.distinct, pa.binary()).to_pylist()
        self.ending = np.fromiter((zlib.crc32(w[-3:]) % endings for w in raw), np.int64, len(raw))
        codes = self.words.codes
        self.words.codes = np.arange(len(raw))
        self.hash = self.words.hashes()[0].view(np.int64)
        self.words.codes = codes

    def sequence(self, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """A value for each token, ends included, and where each text begins."""
        bounds = self.words.bounds
        return np.insert(values[self.words.codes], bounds[1:], end), bounds + np.arange(len(bounds))

    def symbols(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct word: its symbol, its count where that is at hand, and whether it is."""
        at, known = _found(model.hashes, self.hash)
        count = np.where(known, model.counts[at], 0) if len(model.counts) else np.zeros(len(self.hash), np.int64)
        symbol = np.where(known, model.symbols[at], -1) if len(model.counts) else np.full(len(self.hash), -1)
        return np.where(symbol < 0, self.ending + 1, symbol), count, known


def _keys(hashes: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For contexts of 1, 2, .. words: where there is one, its key, the key of it with the token after it, and of its longest suffix with that."""
    d, run = 0, hashes
    while True:
        d += 1
        context = np.concatenate((run[:1], run[:-1]))
        longer = joined(context, run)
        yield place >= d, context, longer, run
        run = longer


def joined(context: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Key of the run of words that begins with ``context`` and ends with ``run``, both a word shorter."""
    return mixed(context * _STEP + run)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64)


def _word_counts(train: DataFrame, endings: int) -> DataFrame:
    """hash, ending and n of each distinct word; the end of texts is not among them."""
    small_batches(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            first = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
            n = np.add.reduceat(rows[:, 2], first)
            arrays = [pa.array(rows[first, 0]), pa.array(rows[first, 1].astype(np.int32)), pa.array(n)]
            return pa.RecordBatch.from_arrays(arrays, names=["hash", "ending", "n"])

        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                t = _Tokens(part.column("text"), endings)
                if len(t.hash):
                    n = np.bincount(t.words.codes, minlength=len(t.hash))
                    held.append(np.stack([t.hash, t.ending, n], axis=1))
                if sum(map(len, held)) > GATHERED:
                    yield flush()
        if held:
            yield flush()
        let_go()

    found = train.select("text").mapInArrow(run, "hash long, ending int, n long")
    return found.groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def coded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, words and what does not depend on contexts of each row of docs, written once."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.held())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        s = model.settings
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                t = _Tokens(part.column("text"), s.endings)
                symbol, count, known = t.symbols(model)
                per_word = np.where(known, np.log10(count + 0.5), 0.0)
                # A word with a symbol of its own is all of it.
                shared_symbol = symbol <= s.endings
                inner = np.where(shared_symbol, per_word, 0.0)
                inner = inner - np.where(shared_symbol, np.log10(model.under[np.minimum(symbol, len(model.under) - 1)]), 0.0)
                base, bounds = t.sequence(per_word, np.log10(model.ends + 0.5))
                inner, _ = t.sequence(inner, 0.0)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (base, inner)]
                codes, cuts = t.words.codes, t.words.bounds
                number = np.where(known, _found(model.hashes, t.hash)[0], -1)[codes]
                far = ~known[codes]
                before = pa.array(np.concatenate(([0], np.cumsum(far)))[cuts].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(number.astype(np.int32))),
                        pa.ListArray.from_arrays(before, pa.array(t.hash[codes[far]])),
                        pa.ListArray.from_arrays(before, pa.array(t.ending[codes[far]].astype(np.int32))),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "near_base", "inner", "codes", "rare", "endings"],
                )
        let_go()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return _written(rows.mapInArrow(run, _CODED), "coded")


def _coded_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded texts in parts of about ``PART_WORDS`` words; a longer text is a part of its own."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < len(ends):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + PART_WORDS, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class _Coded:
    """Rows of coded texts as tokens: hash, symbol, place in the text (0 is before it) and text of each."""

    def __init__(self, batch: pa.RecordBatch, model: Model):
        lists = batch.column("codes")
        number = lists.flatten().to_numpy(zero_copy_only=False)
        far = number < 0
        self.rare = batch.column("rare").flatten().to_numpy(zero_copy_only=False)
        hashes, symbols = np.empty(len(number), np.uint64), np.empty(len(number), np.int64)
        hashes[far] = self.rare.view(np.uint64)
        symbols[far] = batch.column("endings").flatten().to_numpy(zero_copy_only=False) + 1
        near = number[~far]
        hashes[~far], symbols[~far] = model.hashes.view(np.uint64)[near], model.known_symbols()[near]
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        # Two places a text more: before it and its end.
        self.owner = np.repeat(np.arange(len(sizes)), sizes + 2)
        self.place = np.arange(len(self.owner)) - (bounds[:-1] + 2 * np.arange(len(sizes)))[self.owner]
        last = self.place == sizes[self.owner] + 1
        word = (self.place > 0) & ~last
        self.hashes = np.where(last, END_HASH, START_HASH)
        self.hashes[word] = hashes
        self.symbols = np.full(len(self.owner), END)
        self.symbols[word] = symbols

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol before and symbol of each token as one code, and the text of each."""
        token = self.place > 0
        before = np.concatenate(([END], self.symbols[:-1]))
        return (before * size + self.symbols)[token], self.owner[token]


def _gram_counts(codes: DataFrame, model: Model) -> DataFrame:
    """code and n: each symbol with the symbol after it."""
    shared = codes.sparkSession.sparkContext.broadcast(model.held())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, n = _summed(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["code", "n"])

        for part in _coded_parts(batches):
            code, _ = _Coded(part, model).grams(model.n_symbols)
            held.append(np.unique(code, return_counts=True))
            if sum(len(k) for k, _ in held) > GATHERED:
                yield flush()
        if held:
            yield flush()
        let_go()

    rows = codes.select("codes", "rare", "endings").mapInArrow(run, "code long, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


def _turns(most: int, tokens: int) -> int:
    return min(most, max(1, tokens // TURN_TOKENS))


def _run_counts(codes: DataFrame, model: Model, lengths: range, wanted: np.ndarray) -> tuple[DataFrame, Broadcast]:
    """length, context, before and n: contexts, and the run that is a word shorter and ends a word later.

    The last words of a context, as many as the least of ``lengths``, are in the sketch ``wanted``. It is
    broadcast, to be destroyed when the rows are written. A run is counted in the pass that its key belongs to.
    """
    shared = codes.sparkSession.sparkContext.broadcast((model.held(), wanted))
    passes = _turns(PASSES, model.tokens)

    def counted(turn: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, wanted = shared.value
            held: list[tuple[np.ndarray, ...]] = []

            def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
                order = np.argsort(keys, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
                at = order[first]
                total = np.add.reduceat(columns[-1][order], first) if len(columns) == 4 else np.diff(np.append(first, len(keys)))
                return keys[at], *(c[at] for c in columns[:3]), total

            def flush() -> pa.RecordBatch:
                _, length, context, before, n = summed(*map(np.concatenate, zip(*held, strict=True)))
                held.clear()
                # Rows of one context together: they take less space.
                order = np.argsort(context, kind="stable")
                arrays = [pa.array(length[order]), *(pa.array(x[order].view(np.int64)) for x in (context, before, n))]
                return pa.RecordBatch.from_arrays(arrays, names=["length", "context", "before", "n"])

            for part in _coded_parts(batches):
                t = _Coded(part, model)
                at = np.zeros(0, np.int64)
                for d, (there, context, longer, before) in zip(range(1, lengths.stop), _keys(t.hashes, t.place)):
                    if d < lengths.start:
                        continue
                    if d == lengths.start:
                        at = np.flatnonzero(there)
                        at = at[has_bit(wanted, _cell(context[at], wanted))]
                    at = at[there[at]]
                    if not len(at):
                        break
                    mine = at[longer[at] % np.uint64(passes) == turn] if passes > 1 else at
                    if len(mine):
                        held.append(summed(longer[mine], np.full(len(mine), d, np.int32), context[mine], before[mine]))
                if sum(len(x[0]) for x in held) > GATHERED:
                    yield flush()
            if held:
                yield flush()
            let_go()

        rows = codes.select("codes", "rare", "endings").mapInArrow(run, "length int, context long, before long, n long")
        rows = rows.groupBy("context", "before").agg(F.sum("n").alias("n"), F.min("length").alias("length"))
        return rows.where(F.col("n") >= model.settings.follower_least)

    if passes == 1 and len(lengths) == 1:
        return counted(0), shared
    return functools.reduce(DataFrame.unionByName, [_written(counted(k), f"run-counts-{lengths.start}") for k in range(passes)]), shared


def _cell(keys: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(64 * len(sketch) - 1)).astype(np.int64)


def _sketch(keys: DataFrame) -> np.ndarray:
    """One bit for the cell of each key: 64 cells or more a key, up to ``CELLS``."""
    cells = min(CELLS, 1 << max(16, (64 * keys.count()).bit_length()))
    return packed_bits(keys.select(F.col("key").bitwiseAND(cells - 1).alias("cell")), cells)


def _share(model: Model, code: np.ndarray, d: int) -> np.ndarray:
    """Probability of the follower in a code after its longest retained suffix of up to d symbols."""
    follower, context = code % model.n_symbols, code // model.n_symbols
    p = model.root[follower]
    for i, level in enumerate(model.levels[:d], 1):
        suffix = context % model.n_symbols**i
        at, retained = _found(level.contexts, suffix)
        where, kept = _found(level.keys, suffix * model.n_symbols + follower)
        own = np.where(kept, level.shares[where], 0.0) if len(level.keys) else 0.0
        p = np.where(retained, own + level.rest[at] * p, p) if len(level.contexts) else p
    return p


def _level(grams: DataFrame, model: Model) -> Level:
    """The retained contexts of one symbol."""
    s, size = model.settings, model.n_symbols
    context = F.floor(F.col("code") / size)
    least = s.context_share * model.tokens
    totals = grams.groupBy(context.alias("context")).agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    kept = grams.where(F.col("n") >= max(2.0, s.follower_share * model.tokens)).withColumn("context", context)
    rows = kept.join(totals, "context").toArrow()
    code, n, total = (rows.column(c).to_numpy() for c in ("code", "n", "total"))
    order = np.argsort(code)
    code, n, total = code[order], n[order], total[order]
    own = (n - s.discount) / total
    contexts, at = np.unique(code // size, return_inverse=True)
    rest = 1 - np.bincount(at, weights=own, minlength=len(contexts))
    before = _share(model, code, 0)
    p = own + rest[at] * before
    away = np.bincount(at, weights=n / total * np.log(p / before), minlength=len(contexts))
    unkept = 1 - np.bincount(at, weights=n / total, minlength=len(contexts))
    away = away + np.where(unkept > 1e-12, unkept * np.log(np.maximum(rest, 1e-300)), 0.0)
    stay = away >= s.divergence
    return Level(contexts[stay], rest[stay], code[stay[at]], own[stay[at]])


def _near(rows: DataFrame, model: Model) -> DataFrame:
    """Runs of two words with the logarithm of the second's probability after the first in the part of the tree that tasks hold."""
    shared = rows.sparkSession.sparkContext.broadcast(model.held())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def symbols(hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
            at, known = _found(model.hashes, hashes)
            symbol = np.where(known, model.known_symbols()[at], ending + 1) if len(model.hashes) else ending + 1
            return np.where(ending < 0, END, symbol)

        for batch in batches:
            context, before, ending, after, n = (
                batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in ("context", "before", "context_ending", "ending", "before_n")
            )
            symbol = symbols(before, after)
            p = _share(model, symbols(context, ending) * model.n_symbols + symbol, len(model.levels))
            shared_symbol = (symbol <= model.settings.endings) & (symbol != END)
            p = np.where(shared_symbol, p * (n + 0.5) / model.under[symbol], p)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("context", "before", "n", "total")), pa.array(np.log(p))],
                names=["context", "before", "n", "total", "log_before"],
            )

    return rows.mapInArrow(run, "context long, before long, n long, total long, log_before double")


def _with_key(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, before = (batch.column(c).to_numpy().view(np.uint64) for c in ("context", "before"))
            key = pa.array(joined(context, before).view(np.int64))
            yield pa.RecordBatch.from_arrays([key, *batch.columns], names=["key", *batch.schema.names])

    return rows.mapInArrow(run, "key long, context long, before long, n long, total long, log_before double")


def _written(df: DataFrame, label: str) -> DataFrame:
    """``materialise``, after which Spark removes the files of its shuffles: a corpus has many runs of words."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = df.sparkSession.conf.get(name, "false")
    df.sparkSession.conf.set(name, "true")
    try:
        return materialise(df, label)
    finally:
        df.sparkSession.conf.set(name, was)


def _grow(codes: DataFrame, model: Model, words: DataFrame) -> None:
    """Add the states of one word, two words and so on, as long as contexts are retained."""
    spark, s, least = codes.sparkSession, model.settings, model.least()
    marks = [(int(h.view(np.int64)), -1, model.ends) for h in (START_HASH, END_HASH)]
    runs = words.select("hash", "ending", "n").where(F.col("n") >= s.follower_least)
    runs = runs.unionByName(spark.createDataFrame(marks, "hash long, ending int, n long")).withColumnRenamed("hash", "key")
    wanted, lengths = runs.where(F.col("n") >= least), range(1, 1)
    for d in itertools.count(1):
        if d == lengths.stop:
            # Long contexts are few, so several lengths are counted at a time.
            lengths = range(d, d + 1) if d < 3 else range(d, 3 * d)
            counts, shared = _run_counts(codes, model, lengths, _sketch(wanted))
        # Contexts are known from the level before, with their counts; so is what ends alike and is a word shorter.
        first, second = wanted.withColumnsRenamed({"key": "context", "n": "total"}), runs.withColumnRenamed("key", "before")
        here = counts.where(F.col("length") == d).drop("length")
        if d == 1:
            first, second = first.withColumnRenamed("ending", "context_ending"), second.withColumnRenamed("n", "before_n")
            rows = _near(here.join(first, "context").join(second, "before"), model)
        else:
            rows = here.join(first, "context").join(second.drop("n"), "before")
            rows = rows.select("context", "before", "n", "total", "log_before")
        rows = _written(_with_key(rows), f"runs-{d}")
        if d == lengths[0]:
            shared.destroy()
        saved = F.col("n") * (F.log("n") - F.log("total") - F.col("log_before"))
        rows = rows.withColumn("own", F.when(saved >= s.gain, (F.col("n") - s.discount) / F.col("total")).otherwise(0.0))
        kept, share = F.col("own") > 0, F.col("n") / F.col("total")
        rest = rows.groupBy("context").agg((1 - F.sum("own")).alias("rest"), F.sum(F.when(kept, share).otherwise(0.0)).alias("kept"), F.max("n").alias("most"))
        by = F.log(F.col("own") / F.exp("log_before") + F.col("rest"))
        away = F.sum(share * by) + (1 - F.first("kept")) * F.log(F.first("rest"))
        firsts = [F.first(c).alias(c) for c in ("rest", "total", "most")]
        contexts = rows.where(kept).join(rest, "context").groupBy("context").agg(away.alias("away"), *firsts)
        retained = _written(contexts.where(F.col("away") >= s.divergence).drop("away"), f"contexts-{d}")
        if d > 1 and retained.isEmpty():
            return
        there = rows.drop("total").join(retained, "context", "left").withColumn("by", by)
        salted = F.col("context").bitwiseXOR(F.lit(int(_CONTEXT)))
        own_states = retained.select(salted.alias("key"), F.col("total").alias("n"), (F.log("rest") / math.log(10)).alias("value"))
        followers = there.where(kept & F.col("rest").isNotNull())
        followers = followers.select("key", "n", ((F.col("by") - F.log("rest")) / math.log(10)).alias("value"))
        model.states.append(_written(own_states.unionByName(followers), f"states-{d}"))
        inner = retained.where("most < total").select("context", "rest")
        if d == 1:
            # What follows a word may be told by its symbol already.
            several = rows.groupBy("context").agg(F.max("n").alias("most"), F.first("total").alias("total")).where("most < total")
            inner = _written(several.select("context").join(retained.select("context", "rest"), "context", "left"), "inner-1")
        several = inner.select(F.col("context").alias("before"))
        frequent = rows.where(F.col("n") >= least).select("key", "before", "n")
        wanted = _written(frequent.join(several, "before", "left_semi").select("key", "n"), f"wanted-{d}")
        if wanted.isEmpty():
            return
        # A longer context is looked at only behind a retained one, so followers of others are not asked for again.
        behind = rows.join(inner, "context").withColumn("by", F.coalesce(by, F.lit(0.0)))
        runs = behind.select("key", (F.col("log_before") + F.col("by")).alias("log_before"), "n")


def counted(train: DataFrame, settings: Settings | None = None) -> tuple[Model, DataFrame]:
    """The model without contexts, and the counts of all words."""
    s = settings or Settings()
    words = _written(_word_counts(train, s.endings), "word-counts")
    ends = train.count()
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    model = Model(s, tokens=(total or 0) + ends, distinct=distinct + (ends > 0), ends=ends)
    if not ends:
        return model, words
    frequent = words.where(F.col("n") >= s.count_share * model.tokens).toArrow()
    h, ending, n = (frequent.column(c).to_numpy() for c in ("hash", "ending", "n"))
    order = np.argsort(h)
    model.hashes, model.counts, model.endings = h[order], n[order], ending[order].astype(np.int64)
    own = model.counts >= s.symbol_share * model.tokens
    model.symbols = np.where(own, s.endings + np.cumsum(own), -1)
    model.n_symbols = s.endings + 1 + int(own.sum())

    count, kinds = np.zeros(model.n_symbols, np.int64), np.zeros(model.n_symbols, np.int64)
    for r in words.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        count[r["ending"] + 1], kinds[r["ending"] + 1] = r["n"], r["k"]
    np.subtract.at(count, ending[order][own] + 1, model.counts[own])
    np.subtract.at(kinds, ending[order][own] + 1, 1)
    count[model.symbols[own]] = model.counts[own]
    count[END] = ends
    model.root = (count + 0.5) / (model.tokens + 0.5 * model.n_symbols)
    model.under = count + 0.5 * (kinds + 1)
    return model, words


def grow(codes: DataFrame, model: Model, words: DataFrame) -> None:
    """Add the contexts to the model, from the coded training texts."""
    if not model.ends:
        return
    model.levels.append(_level(_written(_gram_counts(codes, model), "grams"), model))
    _grow(codes, model, words)


def fit(train: DataFrame, settings: Settings | None = None) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words."""
    model, words = counted(train, settings)
    if model.ends:
        grow(coded(train.select("text", F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out")), model), model, words)
    return model, words


def scores(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """``doc_id`` and ``held_out`` of docs with n_tokens, n_known, train_tokens, base_score and score."""
    return scored(coded(docs, model), model, words)


def _ranges(codes: DataFrame) -> list[Column]:
    """Conditions on ``row`` that part the coded texts, each row in one of them; a file lies in one or two, by its statistics."""
    tokens = codes.agg(F.sum("n_tokens")).first()[0] or 0
    n = _turns(RANGES, tokens)
    if n == 1:
        return [F.lit(True)]
    cuts = codes.agg(F.percentile_approx("row", [k / n for k in range(1, n)])).first()[0]
    cuts = sorted(set(cuts))
    row = F.col("row")
    return [row <= cuts[0], *((row > a) & (row <= b) for a, b in itertools.pairwise(cuts)), row > cuts[-1]]


def scored(codes: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """The scores of coded texts."""
    spark, at_hand = codes.sparkSession, model.settings.count_share * model.tokens
    no_states = spark.createDataFrame([], "key long, n long, value double")
    states = functools.reduce(DataFrame.unionByName, model.states, no_states)
    rows = states.where(F.col("n") >= at_hand).toArrow()
    order = np.argsort(rows.column("key").to_numpy().view(np.uint64))
    frequent = [rows.column(c).to_numpy()[order] for c in ("key", "value")]
    shared = spark.sparkContext.broadcast((model.held(), len(model.states), _sketch(states), frequent[0].view(np.uint64), frequent[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, depth, sketch, keys, values = shared.value
        for batch in _coded_parts(batches):
            t = _Coded(batch, model)
            code, owner = t.grams(model.n_symbols)
            score = np.bincount(owner, np.log10(_share(model, code, len(model.levels))), batch.num_rows)
            score += batch.column("inner").to_numpy()
            words_of_row = pc.list_value_length(batch.column("rare")).to_numpy(zero_copy_only=False)
            texts, asked, word = [np.repeat(np.arange(batch.num_rows), words_of_row)], [t.rare], [np.ones(len(t.rare), bool)]
            # A context of more words is a state only if all its suffixes of two words and more are.
            alive = np.arange(len(t.place))
            for d, (there, context, longer, _) in zip(range(depth), _keys(t.hashes, t.place)):
                at = alive[there[alive]]
                own = context[at] ^ _CONTEXT
                may = has_bit(sketch, _cell(own, sketch))
                alive = at[may] if d else at
                at, own = at[may], own[may]
                follower = at[has_bit(sketch, _cell(longer[at], sketch))]
                for place, key in ((at, own), (follower, longer[follower])):
                    where, near = _found(keys, key)
                    if near.any():
                        score += np.bincount(t.owner[place[near]], values[where[near]], batch.num_rows)
                    texts.append(t.owner[place[~near]])
                    asked.append(key[~near].view(np.int64))
                    word.append(np.zeros(len(texts[-1]), bool))
            text, ask, is_word = (np.concatenate(x) for x in (texts, asked, word))
            order = np.lexsort((ask, text))
            text, ask, is_word = text[order], ask[order], is_word[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (ask[1:] != ask[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(text)))
            # One more row for each text, with what is known here; its key meets nothing.
            row = batch.column("row").to_numpy().astype(np.int64)
            arrays = [
                np.concatenate((row, row[text[first]])),
                np.concatenate((mixed(row.view(np.uint64)).view(np.int64), ask[first])),
                np.concatenate((np.zeros(len(row), np.int32), times.astype(np.int32))),
                np.concatenate((np.zeros(len(row), bool), is_word[first])),
                np.concatenate((score, np.zeros(len(first)))),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["row", "key", "times", "word", "near_score"])
        let_go()

    entries = words.where(F.col("n") < at_hand).select(F.col("hash").alias("key"), "n", F.lit(0.0).alias("value"))
    rest = states.where(F.col("n") < at_hand).select("key", F.lit(None).cast("long").alias("n"), "value")
    c = F.coalesce("n", F.lit(0))
    parts = []
    for where in _ranges(codes):
        texts = codes.where(where).select("row", "inner", "codes", "rare", "endings")
        asked = texts.mapInArrow(run, "row long, key long, times int, word boolean, near_score double")
        # The entries, one for each key, are few beside what is asked, which is not sorted for this join.
        sums = (
            asked.join(entries.unionByName(rest).hint("shuffle_hash"), "key", "left")
            .groupBy("row")
            .agg(
                F.sum("near_score").alias("near_score"),
                F.sum(F.when(F.col("word"), F.col("times") * F.log10(c + 0.5))).alias("far_sum"),
                F.sum(F.when(F.col("word") & (c == 0), F.col("times")).otherwise(0)).alias("unknown"),
                F.sum(F.col("times") * F.col("value")).alias("far_states"),
            )
        )
        parts.append(_written(sums, "sums"))
    shared.destroy()
    sums = functools.reduce(DataFrame.unionByName, parts)
    scale = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    far = F.coalesce("far_sum", F.lit(0.0))
    unknown = F.coalesce("unknown", F.lit(0)) + (0 if model.ends else 1)
    base = F.col("near_base") + far - F.col("n_tokens") * scale
    return codes.join(sums, "row").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - unknown).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("near_score") + far + F.coalesce("far_states", F.lit(0.0)) if model.ends else base).alias("score"),
    )


def held_out(doc_id: Column | str = "doc_id", parts: int = 5, part: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % parts == part, F.lit(False))


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    model, words = counted(docs.where("not held_out"))
    codes = coded(docs, model)
    grow(codes.where("not held_out"), model, words)
    return scored(codes, model, words)
