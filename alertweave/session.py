"""Session settings the operators rely on, and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # Timestamps are UTC throughout.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of making the text invalid.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Hot keys on the probe side of a join are split at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Beyond a few rows, a table is broadcast by hint or by its measured size only. The size of a stored table is guessed from its file and the
    # widths of column types, which is far too little for a few columns beside a variant.
    "spark.sql.autoBroadcastJoinThreshold": "16k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
}

def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings above to a session made by the caller."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder does if all of Spark runs in one process; on a cluster it is an
    error, since each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local_folder:
            _local_folder.append(tempfile.mkdtemp(prefix="alertweave-"))
        folder = _local_folder[0]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/alertweave/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a slim intermediate table to the shared folder and read it back.

    Used between enrichment stages, where the next stage reads its input several times: the stage runs once, and
    a lost executor costs the next stage a re-read and not a re-run of everything before.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows of ``df`` spread evenly over all cores, two parts for each.

    A table is read by no more tasks than it has row groups, which may be a million rows each. Deal slim rows before they are
    parsed or widened, so that the texts are made where they are read.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
