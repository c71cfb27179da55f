"""What the text operators share: bounded Arrow batches, words as codes, and hashes of runs of words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Large numpy arrays are the C library's.
_c_library = ctypes.CDLL(None)
SLICE_BYTES = 4 << 20
#: For steps that hold many numbers for each word.
PART_BYTES = 1 << 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python by rows and bytes; texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part stay near ``limit`` bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Name what a worker keeps from task to task for ``owner``; ``clear`` frees it."""
    _held[owner] = clear


def turn_to(owner: str | None) -> None:
    """Free what this worker keeps for other work than ``owner``'s. Workers outlive tasks, and stages of a job share them."""
    for name in [n for n in _held if n != owner]:
        _held.pop(name)()


def let_go() -> None:
    """Give back to the system what Arrow and the C library have freed but keep at hand."""
    pa.default_memory_pool().release_unused()
    if hasattr(_c_library, "malloc_trim"):
        _c_library.malloc_trim(0)


def over_texts(
    df: DataFrame,
    step: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    column: str = "text",
    limit: int = SLICE_BYTES,
    owner: str | None = None,
) -> DataFrame:
    """Run ``step`` over parts of the Arrow batches of ``df``, of about ``limit`` bytes of texts each."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(owner)
        try:
            for batch in batches:
                for part in slices(batch, column, limit):
                    out = step(part)
                    if out is not None and out.num_rows:
                        yield out
        finally:
            let_go()

    return df.mapInArrow(run, schema)


def packed_away(docs: DataFrame, *needs: str) -> DataFrame:
    """The columns ``needs`` and all others as one struct ``_others``, so that no name of theirs meets one of an operator."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in needs]
    return docs.select(*needs, F.struct(*(others or [F.lit(None).cast("string").alias("none")])).alias("_others"))


def unpacked(docs: DataFrame, needs: tuple[str, ...]) -> list[Column]:
    """The columns of ``docs`` in their order, from rows of ``packed_away(docs, *needs)``."""
    return [F.col(f"`{c}`") if c in needs else F.col(f"_others.c{i}").alias(c) for i, c in enumerate(docs.columns)]


@dataclass
class Words:
    """Words of several texts: ``codes`` into ``distinct``; text i has the codes from ``bounds[i]`` to ``bounds[i + 1]``."""

    codes: np.ndarray
    bounds: np.ndarray
    distinct: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes for each word."""
        both = b"".join(map(xxhash.xxh3_128_digest, pc.cast(self.distinct, pa.binary()).to_pylist()))
        pair = np.frombuffer(both, dtype="<u8").reshape(-1, 2)
        return pair[:, 0][self.codes], pair[:, 1][self.codes]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; a null text has none. ``lower`` lower-cases A-Z alone."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    if not full.all():
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[cuts].astype(np.int64), coded.dictionary)


def packed_bits(cells: DataFrame, size: int) -> np.ndarray:
    """The cells listed in column ``cell``, of ``size`` in all, as one bit each; the result has size / 8 bytes."""
    words = (
        cells.groupBy(F.shiftright("cell", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros((size + 63) >> 6, dtype=np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def has_bit(packed: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return ((packed[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of runs of consecutive words: the same run has the same hash wherever it stands."""

    def __init__(self, hashes: np.ndarray, base: int = 0):
        n = len(hashes)
        self.up, self.down = self._powers(n + 1, base)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * self.up[:n], dtype=np.uint64, out=self.sums[1:])

    @staticmethod
    def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` powers of a base and of its inverse. They are as long as the part, and go with it."""
        b = int(_BASES[base])
        each = (np.full(n, v, np.uint64) for v in (b, pow(b, -1, 1 << 64)))
        out = []
        for powers in each:
            powers[0] = 1
            out.append(np.cumprod(powers, dtype=np.uint64, out=powers))
        return out[0], out[1]

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def starts_of(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every run of ``length`` words that lies in one text, and the text's number."""
    n = np.maximum(np.diff(bounds) - length + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.concatenate(([0], np.cumsum(n)))
    return np.arange(first[-1]) - first[owner] + bounds[owner], owner


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
