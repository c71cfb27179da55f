"""Removal of passages that another document already has, behind a count-min prefilter.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller id. Windows are judged on the input.

Every window has an anchor: of its runs of ``gram`` words the one with the least hash, the first of equals. Equal
windows have equal anchors at equal places, so an anchor seen in one document only has no repeated window.

1. Each task sketches the anchors of its documents; the sketches are added up. A cell is hot if its sum is two or
   more. A count-min estimate never falls below the count, so a window that repeats has hot cells in every row.
2. The second pass takes the anchors whose cells are all hot. The windows of one anchor in a document are consecutive
   and form a span. Spans are grouped exactly (128-bit hashes) and the least document of each is found. A span that
   an earlier document has too goes whole. Where an anchor has spans of several contents, the windows of the first
   holder of each are grouped exactly as well, as spans may overlap in a part only.

The sketch has a fixed size (``rows`` of 2**``bits`` cells, a bit each once summed, 32 MB by default), which is all
that is broadcast. An overfull sketch lets more through to the exact grouping and never changes the result.

Nulls: a null text has no words; a document without id takes no part in the comparison and stays as it is. Rows that
repeat an id count as one document, each of them is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm.common import PART_BYTES, Runs, let_go, over_texts, packed_away, read, signed, slices, small_batches, starts_of, turn_to
from alertweave.llm.common import unpacked, words_of
from alertweave.session import materialise

# Spans belong to an id and a text, so rows that share an id by mistake do not mix.
KEYS = ["doc_id", "text_key"]
ODD = (np.uint64(0x9E6C63D0876A9A47), np.uint64(0xD1B54A32D192ED03), np.uint64(0xAEF17502108EF2D9), np.uint64(0x94D049BB133111EB))


def _text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


class _Anchors:
    """Windows of a part of the documents with the anchor of each."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        self.words = words_of(texts)
        one, two = self.words.hashes()
        self.runs = (Runs(one, 0), Runs(two, 1))
        self.starts, self.owner = starts_of(self.words.bounds, window)
        width = window - gram + 1
        if not len(self.starts):
            self.at = np.zeros(0, np.int64)
            return
        places = np.arange(len(one) - gram + 1)
        grams = self.runs[0](places, places + gram)
        least = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
        self.at = self.starts + least[self.starts]
        self.grams = grams

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """First window of each span, and the number of windows in it."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.concatenate(([True], (self.at[1:] != self.at[:-1]) | (self.owner[1:] != self.owner[:-1])))
        first = np.flatnonzero(new)
        return first, np.diff(np.concatenate((first, [len(self.starts)])))


def _cells(hashes: np.ndarray, rows: int, bits: int) -> list[np.ndarray]:
    return [((hashes * ODD[r]) >> np.uint64(64 - bits)).astype(np.int64) for r in range(rows)]


def sketch(docs: DataFrame, window: int, gram: int, rows: int, bits: int) -> DataFrame:
    """Summed sketch: (sketch row and cell, documents counted), each document once for an anchor."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(seen), return_counts=True)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

        turn_to(None)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                a = _Anchors(part.column("text"), window, gram)
                first, _ = a.groups()
                if not len(first):
                    continue
                pairs = np.empty(len(first), dtype=[("d", np.int64), ("h", np.uint64)])
                pairs["d"], pairs["h"] = a.owner[first], a.grams[a.at[first]]
                hashes = np.unique(pairs)["h"]
                seen.extend(c + (r << bits) for r, c in enumerate(_cells(hashes, rows, bits)))
                held += rows * len(hashes)
                if held > 2_000_000:
                    yield flush()
                    held = 0
        if seen:
            yield flush()
        let_go()

    found = docs.where("doc_id is not null").select("text").mapInArrow(run, "cell long, n long")
    return found.groupBy("cell").agg(F.sum("n").alias("n"))


def hot_bits(summed: DataFrame, rows: int, bits: int) -> np.ndarray:
    """The cells counted twice or more as one bit each; never larger than the sketch."""
    packed = (
        summed.where("n >= 2")
        .groupBy(F.shiftright("cell", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(((rows << bits) + 63) >> 6, dtype=np.uint64)
    out[packed.column("at").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    return out


def repeated_spans(docs: DataFrame, shared: Broadcast[np.ndarray], window: int, gram: int, rows: int, bits: int) -> DataFrame:
    """Spans under anchors that the sketch estimates to repeat, given its hot cells."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch | None:
        a = _Anchors(part.column("text"), window, gram)
        first, n = a.groups()
        if not len(first):
            return None
        anchors = a.grams[a.at[first]]
        keep = np.ones(len(first), dtype=bool)
        for r, cell in enumerate(_cells(anchors, rows, bits)):
            cell = cell + (r << bits)
            keep &= ((shared.value[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        first, n, anchors = first[keep], n[keep], anchors[keep]
        start = a.starts[first]
        stop = start + n + window - 1
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)[a.owner[first]]
        return pa.RecordBatch.from_arrays(
            [
                signed(anchors),
                signed(a.runs[0](start, stop)),
                signed(a.runs[1](start, stop)),
                pa.array(ids.astype(np.int64)),
                part.column("text_key").take(pa.array(a.owner[first])),
                pa.array((start - a.words.bounds[a.owner[first]]).astype(np.int32)),
                pa.array(n.astype(np.int32)),
            ],
            names=["anchor", "one", "two", "doc_id", "text_key", "start", "n"],
        )

    known = docs.where("doc_id is not null").select("doc_id", "text", _text_key())
    return over_texts(known, step, "anchor long, one long, two long, doc_id long, text_key long, start int, n int", limit=PART_BYTES)


def _windows(wanted: DataFrame, window: int) -> DataFrame:
    """(one, two, doc_id, start) of each window of the spans listed with a text."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch | None:
        words = words_of(part.column("text"))
        one, two = (Runs(h, b) for b, h in enumerate(words.hashes()))
        spans = part.column("spans")
        flat = spans.flatten()
        sizes = np.asarray(spans.value_lengths())
        owner = np.repeat(np.arange(part.num_rows), sizes)
        start, n = (np.asarray(flat.field(k)).astype(np.int64) for k in ("start", "n"))
        each = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = start[each] + inner
        at = place + words.bounds[owner[each]]
        ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[owner[each]]
        return pa.RecordBatch.from_arrays(
            [
                signed(one(at, at + window)),
                signed(two(at, at + window)),
                pa.array(ids),
                part.column("text_key").take(pa.array(owner[each])),
                pa.array(place.astype(np.int32)),
            ],
            names=["one", "two", "doc_id", "text_key", "start"],
        )

    return over_texts(wanted, step, "one long, two long, doc_id long, text_key long, start int", limit=PART_BYTES)


def repeated_windows(
    docs: DataFrame, window: int = 50, gram: int = 8, rows: int = 2, bits: int = 27
) -> DataFrame:
    """(doc_id, text_key, start, n): runs of n windows from word ``start`` on that also start in an earlier document."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_bits(sketch(docs, window, gram, rows, bits), rows, bits))
    spans = materialise(repeated_spans(docs, hot, window, gram, rows, bits), "spans")
    # The spans are written, so nobody needs the sketch again; workers would keep it for as long as they live.
    hot.destroy()
    firsts = materialise(
        spans.groupBy("anchor", "one", "two").agg(F.min("doc_id").alias("first_doc")), "first-spans"
    )
    gone = spans.join(firsts, ["anchor", "one", "two"]).where("first_doc < doc_id").select(*KEYS, "start", "n")
    contested = firsts.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1").select("anchor")
    holders = (
        spans.join(firsts.join(contested, "anchor", "left_semi"), ["anchor", "one", "two"])
        .where("first_doc = doc_id")
        .groupBy(*KEYS, "start")
        .agg(F.max("n").alias("n"))
        .groupBy(*KEYS)
        .agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    )
    texts = docs.select("doc_id", "text", _text_key())
    single = materialise(_windows(texts.join(holders, KEYS).select(*KEYS, "text", "spans"), window), "windows")
    least = single.groupBy("one", "two").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    also = single.join(least, ["one", "two"]).where("first_doc < doc_id")
    return gone.unionByName(also.select(*KEYS, "start", F.lit(1).alias("n")))


def cut(docs: DataFrame, window: int = 50, **sketching: int) -> DataFrame:
    """Documents with the repeated passages cut out.

    Adds n_words, n_removed and kept_text (kept words joined by one space); all other columns stay, those of the
    same names are replaced.
    """
    spans = repeated_windows(docs.select("doc_id", "text"), window, **sketching).groupBy(*KEYS).agg(
        F.collect_list(F.struct("start", "n")).alias("repeated_spans")
    )
    kept = docs.drop("n_words", "n_removed", "kept_text")
    needs = ("doc_id", "text")
    joined = packed_away(kept, *needs).withColumn("text_key", _text_key()).join(spans, KEYS, "left")
    names = [*needs, "_others"]
    joined = joined.select(*names, "repeated_spans")

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(part.column("text"))
        counts, removed = words.counts, np.zeros(part.num_rows, np.int64)
        texts: list[str] = []
        lists = part.column("repeated_spans").to_pylist()
        for i, found in enumerate(lists):
            codes = words.codes[words.bounds[i] : words.bounds[i + 1]]
            if found:
                edge = np.zeros(len(codes) + 1, np.int64)
                for s in found:
                    edge[s["start"]] += 1
                    edge[min(s["start"] + s["n"] + window - 1, len(codes))] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                removed[i] = len(codes) - stay.sum()
                codes = codes[stay]
            texts.append(" ".join(words.distinct.take(pa.array(codes)).to_pylist()))
        arrays = [part.column(c) for c in names] + [pa.array(counts.astype(np.int64)), pa.array(removed), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "n_words", "n_removed", "kept_text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name in names)
    cut_texts = over_texts(joined, step, f"{fields}, n_words long, n_removed long, kept_text string", limit=PART_BYTES)
    return cut_texts.select(*unpacked(kept, needs), "n_words", "n_removed", "kept_text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
with w as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as a from documents
), s as (
    select doc_id, i, hash(array_to_string(a[i:i+49], ' ')) as h1, md5(array_to_string(a[i:i+49], ' ')) as h2
    from w, range(1, greatest(len(a) - 48, 1)) t(i) where len(a) >= 50
), m as (select h1, h2, min(doc_id) as d from s group by h1, h2),
g as (select s.doc_id, s.i from s join m on s.h1 = m.h1 and s.h2 = m.h2 and m.d < s.doc_id),
c as (select distinct doc_id, i + k as i from g, range(0, 50) r(k)),
p as (select doc_id, list(i) as gone from c group by doc_id),
f as (
    select w.doc_id, len(a) as n, case when gone is null then a
        else [x for x, j in a if not list_contains(gone, j)] end as b
    from w left join p on p.doc_id = w.doc_id
)
select doc_id, n::bigint as n_words, (n - len(b))::bigint as n_removed, sha256(array_to_string(b, ' ')) as kept_sha256 from f
"""
