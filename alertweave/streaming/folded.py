"""A table of what each micro-batch has changed, folded into snapshots.

Each batch writes one folder, and writes it again when it is repeated. Now and then the folders are folded into a snapshot that is
named by the last batch that it covers. A snapshot counts from the moment that its completion mark is there, which Spark writes last; the
newest complete one is the pointer. Readers touch that snapshot and the folders of later batches. Folders that a snapshot covers
are removed after it is complete, so whatever a crash leaves behind is either ignored or replaced:

* a snapshot without its mark is not read, and the next fold writes it anew;
* folders that a complete snapshot covers are not read, also if a covered batch is repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Snapshots kept for readers that began before the newest was complete.
SNAPSHOTS_KEPT = 2


@dataclass
class FoldedLog:
    """``keys`` name an entry. Of the other columns of ``schema`` those in ``sums`` are added up and those in ``latest`` keep
    their greatest value; the rest are those of the newest batch that has the entry."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    sums: tuple[str, ...] = ()
    latest: tuple[str, ...] = ()
    every: int = 20
    _columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self._columns = StructType.fromDDL(self.schema).names

    def _numbered(self, prefix: str, complete: bool = False) -> list[int]:
        """Numbers of the folders ``prefix=number`` under the path; only those with a completion mark, if asked for."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        found = (re.fullmatch(rf"{prefix}=(\d+)", s.getPath().getName()) for s in files.listStatus(place))
        numbers = sorted(int(m[1]) for m in found if m)
        if complete:
            numbers = [n for n in numbers if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{prefix}={n}/_SUCCESS"))]
        return numbers

    def _remove(self, prefix: str, numbers: list[int]) -> None:
        for n in numbers:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{prefix}={n}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        batch.select(*self._columns).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def covered(self) -> int:
        """The last batch that the newest complete snapshot covers, -1 without one."""
        return max(self._numbered("snapshot", complete=True), default=-1)

    def tail(self) -> list[int]:
        """Complete batches that no snapshot covers."""
        last = self.covered()
        return [n for n in self._numbered("batch_id", complete=True) if n > last]

    def read(self) -> DataFrame:
        """One row for each entry."""
        return self._state(self.covered(), self.tail()).drop("batch_id")

    def _state(self, last: int, tail: list[int]) -> DataFrame:
        rows = self.spark.createDataFrame([], f"{self.schema}, batch_id bigint")
        parts = [(f"{self.path}/snapshot={last}", last)] if last >= 0 else []
        parts += [(f"{self.path}/batch_id={n}", n) for n in tail]
        # A snapshot has the batch of each entry already.
        for place, n in parts:
            stored = self.spark.read.schema(f"{self.schema}, changed_in bigint").parquet(place)
            rows = rows.unionByName(stored.select(*self._columns, F.coalesce("changed_in", F.lit(n)).cast("bigint").alias("batch_id")))
        values = [c for c in self._columns if c not in self.keys]
        merged = [
            F.sum(c).alias(c) if c in self.sums else F.max(c).alias(c) if c in self.latest else F.max_by(c, "batch_id").alias(c)
            for c in values
        ]
        return rows.groupBy(*self.keys).agg(*merged, F.max("batch_id").alias("batch_id")).select(*self._columns, "batch_id")

    def fold(self) -> None:
        """Fold all complete batches into a snapshot, then remove what it covers."""
        last, tail = self.covered(), self.tail()
        if tail:
            state = self._state(last, tail).withColumnRenamed("batch_id", "changed_in")
            state.write.mode("overwrite").parquet(f"{self.path}/snapshot={tail[-1]}")
        self._clean()

    def _clean(self) -> None:
        complete = self._numbered("snapshot", complete=True)
        self._remove("batch_id", [n for n in self._numbered("batch_id") if n <= max(complete, default=-1)])
        self._remove("snapshot", complete[:-SNAPSHOTS_KEPT])

    def fold_if_due(self) -> None:
        if len(self.tail()) >= self.every:
            self.fold()
