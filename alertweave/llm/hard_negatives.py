"""Hard negatives of anchor vectors: Strassen products of integer tiles, and heaps that merge.

Vectors are cut into cells of candidates and blocks of anchors, and every block meets every cell. Inside such a pair the scores
of a tile of anchors and a tile of candidates are one matrix product of 64-bit integers, taken by Strassen's recursion: both
factors are padded with zeros to even sides and halved, seven products of the halves replace eight, and the sums are exact
(64-bit integer arithmetic wraps, so every score below 2^63 in size comes out right). A pair leaves one heap for each of its
anchors, the best ``keep`` of its candidates; heaps of one anchor merge by keeping the best of both, so they are cut before they are
shuffled, and no task sees all candidates of an anchor.

Two rounds: the first finds the positives, multiplying anchors with candidates of their own label only. The second knows the
score of each positive and keeps a heap for each window of scores under a positive, over the candidates of other labels.

Sizes: a cell or block holds at most ``SIDE_BYTES`` of numbers, whatever the length of the vectors; smaller tables are cut
finer, so that all tasks have work. Every candidate is sent to each block of anchors: the anchors are a stated part of all rows.

Defined results: rows without id, label or vector, or with a component that is null or not finite, take no part. Each remaining row
is one row, also when it repeats another; a row is never its own positive. Shorter vectors are padded with zeros. Anchors without
positives, and positives without a negative in their window (all of negative score), have no rows. Columns beyond the three
named in the call may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertweave.llm.common import read
from alertweave.session import materialise

SIDE_BYTES = 32 << 20
TILE_ANCHORS, TILE_CANDIDATES, LEAF = 512, 4096, 16
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two integer matrices by Strassen's recursion down to sides of ``leaf``."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2))) if m % 2 or k % 2 else a
    b = np.pad(b, ((0, k % 2), (0, n % 2))) if k % 2 or n % 2 else b
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), dtype=np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best ``keep`` scores and ids for each of ``n`` owners: higher scores first, ties by smaller id."""

    def __init__(self, n: int, keep: int):
        self.keep = keep
        self.scores = np.full((n, keep), NONE)
        self.ids = np.full((n, keep), np.iinfo(np.int64).max)

    def add(self, owners: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``scores`` (owners x candidates, NONE where there is no candidate) of the candidates ``ids``."""
        worst, last = self.scores[owners, -1][:, None], self.ids[owners, -1][:, None]
        better = (scores > worst) | ((scores == worst) & (scores != NONE) & (ids[None, :] < last))
        if scores.shape[1] > self.keep and np.count_nonzero(better) > 8 * better.shape[0] * self.keep:
            offered = np.where(better, scores, NONE)
            at = scores.shape[1] - self.keep
            better &= scores >= np.partition(offered, at, axis=1)[:, at][:, None]
        row, column = np.nonzero(better)
        if len(row):
            self._merge(owners, row, scores[row, column], ids[column])

    def _merge(self, owners: np.ndarray, row: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        changed = np.unique(row)
        slot = np.repeat(changed, self.keep)
        rows = np.concatenate((slot, row))
        scores = np.concatenate((self.scores[owners[changed]].ravel(), scores))
        ids = np.concatenate((self.ids[owners[changed]].ravel(), ids))
        order = np.lexsort((ids, ~scores, rows))  # the complement falls as a score rises, and cannot overflow
        rows, scores, ids = rows[order], scores[order], ids[order]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        top = place < self.keep
        self.scores[owners[changed]] = scores[top].reshape(-1, self.keep)
        self.ids[owners[changed]] = ids[top].reshape(-1, self.keep)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """owner, score, id of all that is held."""
        owner, place = np.nonzero(self.scores != NONE)
        return owner, self.scores[owner, place], self.ids[owner, place]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, short ones padded with zeros."""
    lists = column.combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def tiles(n: int, side: int) -> list[slice]:
    return [slice(i, min(i + side, n)) for i in range(0, n, side)]


def nearest_of_label(anchors: pa.Table, rows: pa.Table, width: int, keep: int) -> pa.Table:
    """The heap of each anchor of a block over the candidates of its label in a cell."""
    x, label, row = matrix(anchors.column("x"), width), _numbers(anchors, "label"), _numbers(anchors, "row")
    y, other, at, ids = (matrix(rows.column("x"), width), *(_numbers(rows, c) for c in ("label", "row", "vec_id")))
    heaps = Heaps(len(row), keep)
    for value in np.intersect1d(label, other):
        mine, theirs = np.flatnonzero(label == value), np.flatnonzero(other == value)
        for c in tiles(len(theirs), TILE_CANDIDATES):
            cells = theirs[c]
            for a in tiles(len(mine), TILE_ANCHORS):
                scores = strassen(x[mine[a]], y[cells].T)
                scores[row[mine[a]][:, None] == at[cells][None, :]] = NONE
                heaps.add(mine[a], scores, ids[cells])
    owner, score, found = heaps.rows()
    return pa.table({"anchor": row[owner], "positive_id": found, "positive_score": score})


def in_windows(anchors: pa.Table, rows: pa.Table, width: int, keep: int, least: int) -> pa.Table:
    """For each anchor and positive, the heap over the cell's candidates of other labels with scores in the window."""
    x, label, row = matrix(anchors.column("x"), width), _numbers(anchors, "label"), _numbers(anchors, "row")
    y, other, ids = (matrix(rows.column("x"), width), *(_numbers(rows, c) for c in ("label", "vec_id")))
    sizes = pc.list_value_length(anchors.column("scores")).to_numpy().astype(np.int64)
    most = int(sizes.max())
    tops = matrix(anchors.column("scores"), most)
    # No score reaches down to a negative bound below a negative positive: least % of it is above it.
    bottoms = tops - tops * (100 - least) // 100 if np.abs(tops).max() < 2**56 else _floors(tops, least)
    void = (np.arange(most)[None, :] >= sizes[:, None]) | (tops < 0)
    windows = [Heaps(len(row), keep) for _ in range(most)]
    for c in tiles(len(ids), TILE_CANDIDATES):
        for a in tiles(len(row), TILE_ANCHORS):
            scores = strassen(x[a], y[c].T)
            scores[label[a][:, None] == other[c][None, :]] = NONE
            for j, heaps in enumerate(windows):
                live = np.flatnonzero(~void[a, j])
                if len(live):
                    owners = live + a.start
                    part = scores[live]
                    inside = (part <= tops[owners, j][:, None]) & (part >= bottoms[owners, j][:, None])
                    heaps.add(owners, np.where(inside, part, NONE), ids[c])
    parts = [(*heaps.rows(), j) for j, heaps in enumerate(windows)]
    return pa.table(
        {
            "anchor": np.concatenate([row[o] for o, _, _, _ in parts]),
            "place": np.concatenate([np.full(len(o), j) for o, _, _, j in parts]),
            "negative_id": np.concatenate([i for _, _, i, _ in parts]),
            "negative_score": np.concatenate([s for _, s, _, _ in parts]),
        }
    )


def _floors(tops: np.ndarray, least: int) -> np.ndarray:
    """The least score of each window in whole numbers of any size."""
    return np.array([[t - t * (100 - least) // 100 for t in map(int, r)] for r in tops], dtype=np.int64).reshape(tops.shape)


@dataclass
class Grid:
    """How rows and anchors are dealt: ``cells`` of candidates, ``blocks`` of anchors, vectors of ``width`` numbers."""

    cells: int
    blocks: int
    width: int

    @staticmethod
    def of(rows: DataFrame, anchor: Column, side_bytes: int = SIDE_BYTES) -> Grid:
        n, a, width = rows.agg(F.count(F.lit(1)), F.count_if(anchor), F.max(F.size("x"))).first()
        width = max(width or 0, 1)
        side = max(side_bytes // (8 * width), 64)
        fair = max(n // (2 * rows.sparkSession.sparkContext.defaultParallelism), 1024)
        return Grid(max(1, math.ceil(n / min(side, fair))), max(1, math.ceil(a / max(side // 2, 64))), width)

    def pairs(self, anchors: DataFrame, rows: DataFrame, step, schema: str) -> DataFrame:
        """``step`` over every block of anchors with every cell of rows. Rows are told apart by ``row``."""
        spread = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n).cast("long"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        # New column ids: both sides come from one table.
        left = anchors.toDF(*anchors.columns).withColumn("block", spread(self.blocks, 1)).withColumn("cell", every(self.cells))
        right = rows.withColumn("cell", spread(self.cells, 2)).withColumn("block", every(self.blocks))
        arrow = pa.schema([(n, pa.int64()) for n in (c.split()[0] for c in schema.split(", "))])

        def run(one: pa.Table, two: pa.Table) -> pa.Table:
            if one.num_rows == 0 or two.num_rows == 0:
                return arrow.empty_table()
            return step(one, two).cast(arrow)

        return left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(run, schema)


def integers(vectors: DataFrame, scale: int, id_column: str, vector: str, label: str, shift: int = 7, classes: int = 10) -> DataFrame:
    """The rows that take part as ``row, vec_id, label, x``; labels of ids divisible by ``shift`` are moved by one."""
    v, i = F.col(vector), F.col(id_column)
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    named = F.col(label).cast("long")
    named = F.when(i % shift == 0, (named + 1) % classes).otherwise(named)
    taken = vectors.where(i.isNotNull() & F.col(label).isNotNull() & v.isNotNull() & finite)
    return taken.select(
        F.monotonically_increasing_id().alias("row"), i.cast("long").alias("vec_id"), named.alias("label"),
        F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"),
    )


def best(heaps: DataFrame, owner: list[str], score: str, found: str, keep: int) -> DataFrame:
    """Merge the heaps of each owner; ``rank`` counts from 1."""
    order = Window.partitionBy(*owner).orderBy(F.desc(score), F.asc(found))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame,
    scale: int = 256,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    side_bytes: int = SIDE_BYTES,
) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels whose score is between ``least`` % and 100 % of the positive's."""
    # The row numbers must not change between the rounds, so the rows are written once.
    rows = materialise(integers(vectors, scale, id_column, vector, label), "integer-vectors")
    is_anchor = F.col("vec_id") % every == 0
    grid = Grid.of(rows, is_anchor, side_bytes)
    width = grid.width
    anchors = rows.where(is_anchor)
    heaps = grid.pairs(
        anchors, rows, lambda a, r: nearest_of_label(a, r, width, positives), "anchor long, positive_id long, positive_score long"
    )
    ranked = best(heaps, ["anchor"], "positive_score", "positive_id", positives)
    entry = F.struct("rank", "positive_id", "positive_score")
    found = materialise(ranked.groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("found")), "positives")
    known = anchors.join(found, F.col("row") == F.col("anchor")).select("row", "label", "x", F.col("found.positive_score").alias("scores"))
    windows = grid.pairs(
        known, rows, lambda a, r: in_windows(a, r, width, negatives, least),
        "anchor long, place long, negative_id long, negative_score long",
    )
    mined = best(windows, ["anchor", "place"], "negative_score", "negative_id", negatives)
    named = found.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    named = named.select("anchor", "anchor_id", F.posexplode("found").alias("place", "p"))
    named = named.select("anchor", F.col("place").cast("long").alias("place"), "anchor_id", "p.positive_id", "p.positive_score")
    return mined.join(named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings`` among all its rows."""
    return hard_negatives(read(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
e AS (SELECT r, vec_id, label, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, b.r AS br, b.vec_id AS other_id, b.label AS bl,
         CAST(sum(a.c * b.c) AS BIGINT) AS score
  FROM e a JOIN e b ON a.i = b.i AND a.vec_id % 100 = 0
  GROUP BY ALL
),
p AS (
  SELECT ar, anchor_id, other_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id) AS place
  FROM s WHERE al = bl AND ar <> br
),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.ar = s.ar AND s.al <> s.bl
  WHERE p.place <= 5 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""
