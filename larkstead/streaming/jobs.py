"""Job events as streams: the latest state by key, a snapshot before the live events, lease expiry, fan-out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.jobs import RECLAIMED

#: Events that a subscriber's buffer holds; when it is full, newer ones are dropped.
BUFFER = 32


def events(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Files of events as they arrive."""
    return spark.readStream.schema(like.schema).parquet(path)


def latest(stream: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per key, of its last event by ``order``."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return stream.groupBy(key).agg(last.alias("_l")).select(key, *[F.col(f"_l.{v}").alias(v) for v in values])


def snapshot_then_live(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """A stream of the snapshot's rows and the live events; both must be streams. Duplicates may come: dedupe by key."""
    return snapshot.unionByName(live)


def lapsed(jobs: DataFrame, now: int) -> DataFrame:
    """Running jobs whose lease has lapsed, as they go back to the queue; stateless, so batch and stream agree."""
    return jobs.where((F.col("state") == "running") & (F.col("lease_until") < now)).select("id", F.lit("queued").alias("state"), F.lit(RECLAIMED).alias("last_error"))


def buffered(batch: DataFrame, subscriber: str, order: str, size: int = BUFFER) -> DataFrame:
    """The events of one micro-batch that each subscriber's buffer takes: the oldest ``size``."""
    place = F.row_number().over(W.Window.partitionBy(subscriber).orderBy(order))
    return batch.withColumn("_n", place).where(F.col("_n") <= size).drop("_n")


def frames(stream: DataFrame, name: str = "job") -> DataFrame:
    """Events as text frames: an event line, a data line of JSON, an empty line."""
    return stream.select(F.concat(F.lit(f"event: {name}\ndata: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("frame"))


def for_each_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Runs what has arrived through a sink in micro-batches; the sink must be idempotent by batch id."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str, scratch: str) -> DataFrame:
    """The result table of a finite stream, written to the scratch folder and read back."""
    spark, path = stream.sparkSession, f"{scratch}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    for_each_once(stream, sink, f"{path}/checkpoint", mode).awaitTermination()
    schema = spark.createDataFrame([], stream.schema).schema
    out = spark.read.schema(schema.add("batch", "long")).parquet(f"{path}/out")
    if mode == "append":
        return out.drop("batch")
    last = out.agg(F.max("batch").alias("_b"))
    return out.join(F.broadcast(last), F.col("batch") == F.col("_b")).drop("batch", "_b")
