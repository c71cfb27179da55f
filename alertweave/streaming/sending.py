"""Delivery to destinations of the caller's own: an envelope, a batch size, and a function that sends one payload.

Payloads are numbered and have an id made of their content, so the same rows make the same payloads in every run. The ledger is
the log of attempts: every task writes what became of its payloads, and what it has written counts from the moment that the task is
done, whether or not the job ends well. A payload that the ledger shows as delivered or refused for good is not sent again, by a
later attempt, by a repeated batch, or after a restart. What a task that is lost had sent without writing it down is sent once
more; the id goes along, so that a receiver can tell.

A function that raises makes a network error of one payload (status 0), not a failed task.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertweave import settings as S
from alertweave.functions import payload as P
from alertweave.operators import delivery

# The batch functions below travel to the executors with their helpers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ATTEMPT = "payload_id string, target string, batch bigint, events bigint, attempt int, status int, error string"


def _any_success(status: Column) -> Column:
    return status.between(200, 299)


@dataclass(frozen=True)
class Destination:
    """``send(payload, payload_id)`` returns the status of the reply. ``envelope`` makes the event of an enriched row as a struct.

    ``accepted`` says which statuses mean that a payload has arrived.
    """

    name: str
    send: Callable[[str, str], int] = field(repr=False)
    envelope: Callable[[S.Settings], Column] = field(default=delivery.universal_event, repr=False)
    batch_size: int = S.DEFAULTS.delivery_batch_size
    attempts: int = S.DEFAULTS.delivery_attempts
    accepted: Callable[[Column], Column] = field(default=_any_success, repr=False)
    #: Seconds before the second attempt; doubled before each further one.
    pause: float = 1.0
    #: Tasks that send at the same time.
    senders: int = 8

    def payloads(self, enriched: DataFrame, settings: S.Settings = S.DEFAULTS) -> DataFrame:
        """``payload_id, target, batch, events, payload`` of the rows for this destination."""
        mine = enriched.filter(F.col("destination") == self.name)
        lines = mine.select(
            F.lit(self.name).alias("target"), F.col("alert.alert_id").alias("alert_id"), P.render(self.envelope(settings)).alias("line")
        )
        made = delivery.batches(lines, self.batch_size)
        return made.withColumn("payload_id", F.sha2(F.concat_ws("|", "target", "batch", "payload"), 256))


def _sent(send: Callable[[str, str], int], attempt: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            status, error = [], []
            for payload, payload_id in zip(batch.column("payload").to_pylist(), batch.column("payload_id").to_pylist()):
                try:
                    status.append(int(send(payload, payload_id)))
                    error.append(None)
                except Exception as problem:  # whatever the caller's function raises
                    status.append(0)
                    error.append(f"{type(problem).__name__}: {problem}")
            kept = [batch.column(c) for c in ("payload_id", "target", "batch", "events")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([attempt] * batch.num_rows, pa.int32()), pa.array(status, pa.int32()), pa.array(error, pa.string())],
                ["payload_id", "target", "batch", "events", "attempt", "status", "error"],
            )

    return run


def outcomes(ledger: DataFrame, destination: Destination) -> DataFrame:
    """What became of each payload: delivered, permanent_error, retry or failed, with its attempts and last status."""
    status = F.coalesce("status", F.lit(0))
    arrived = destination.accepted(status)
    again = ~arrived & ((status == 0) | (status == 429) | (status >= 500))
    return ledger.groupBy("payload_id", "target", "batch", "events").agg(
        F.max("attempt").alias("attempts"),
        F.max_by("status", "attempt").alias("last_status"),
        F.max_by("error", "attempt").alias("last_error"),
        F.when(F.max(arrived), F.lit("delivered"))
        .when(F.max(~arrived & ~again), F.lit("permanent_error"))
        .when(F.max("attempt") >= destination.attempts, F.lit("failed"))
        .otherwise(F.lit("retry"))
        .alias("outcome"),
    )


def send(payloads: DataFrame, destination: Destination, ledger: str) -> DataFrame:
    """Send ``payloads`` until each has arrived, was refused for good, or has had all its attempts; the outcomes.

    ``ledger`` is a folder of these payloads alone, which keeps its content between runs.
    """
    spark = payloads.sparkSession
    stored = payloads.sparkSession.createDataFrame([], ATTEMPT)
    stored.write.mode("append").parquet(ledger)
    for attempt in range(1, destination.attempts + 1):
        known = outcomes(spark.read.schema(ATTEMPT).parquet(ledger), destination)
        # Done with, or tried in this attempt already by a run that was broken off.
        done = known.filter((F.col("outcome") != "retry") | (F.col("attempts") >= attempt)).select("payload_id")
        todo = payloads.join(done, "payload_id", "left_anti").select("payload_id", "target", "batch", "events", "payload")
        if todo.isEmpty():
            continue
        if attempt > 1:
            time.sleep(destination.pause * 2 ** (attempt - 2))
        tried = todo.repartition(destination.senders, "payload_id").mapInArrow(_sent(destination.send, attempt), ATTEMPT)
        # By the second commit algorithm the files of a task stay, also if the job fails after it.
        tried.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger)
    return outcomes(spark.read.schema(ATTEMPT).parquet(ledger), destination)


def deliver_to(
    enriched: DataFrame,
    destinations: list[Destination],
    path: str,
    checkpoint: str,
    settings: S.Settings = S.DEFAULTS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Enriched rows of a stream to the destinations they name.

    Under ``path``: ``payloads`` (what is sent), ``ledger`` (attempts), ``outcomes`` (one row a payload) and ``undelivered`` (rows whose
    destination nobody serves), each by micro-batch.
    """
    if len({d.name for d in destinations}) != len(destinations):
        raise ValueError("names of destinations must be unique")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = [d.name for d in destinations]
        rest = batch.filter(~F.coalesce(F.col("destination").isin(names), F.lit(False)))
        reason = F.concat(F.lit("no client for destination "), F.coalesce("destination", F.lit("null")))
        rest.withColumn("undeliverable", reason).write.mode("overwrite").parquet(f"{path}/undelivered/batch_id={batch_id}")
        for destination in destinations:
            place = f"destination={destination.name}/batch_id={batch_id}"
            stored = f"{path}/payloads/{place}"
            destination.payloads(batch, settings).write.mode("overwrite").parquet(stored)
            sent = send(spark.read.parquet(stored), destination, f"{path}/ledger/{place}")
            sent.write.mode("overwrite").parquet(f"{path}/outcomes/{place}")

    writer = enriched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
