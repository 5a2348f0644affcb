"""Content-addressed blobs (first writer wins) and key/value settings (last writer wins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshot import delete, insert_new


def put_blobs(puts: DataFrame) -> DataFrame:
    """One row per digest: the earliest put's. Partial aggregation, so a digest put often is no hot spot."""
    first = F.min_by(F.struct("size_bytes", "media_type", "created_at"), F.struct("created_at", "seq"))
    return puts.groupBy("sha256").agg(first.alias("b")).select("sha256", "b.size_bytes", "b.media_type", "b.created_at")


def upsert_blob(blobs: DataFrame, new: DataFrame) -> DataFrame:
    """blobs and the new digests; of several new rows with one digest, the earliest."""
    return insert_new(blobs, new, "sha256", ["created_at", "size_bytes", "media_type"])


def stat_blobs(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sha256, size_bytes, media_type) of wanted digests; null sizes for those that aren't there."""
    return wanted.join(blobs.select("sha256", "size_bytes", "media_type"), "sha256", "left")


def get_blob(blobs: DataFrame, digest: str) -> DataFrame:
    return blobs.where(F.col("sha256") == digest)


def blobs_exist(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted digests with whether they are there; what is no digest is absent."""
    known = blobs.select("sha256").distinct().withColumn("_there", F.lit(True))
    return wanted.join(known, "sha256", "left").select("sha256", F.coalesce("_there", F.lit(False)).alias("present"))


def delete_blob(blobs: DataFrame, digest: str) -> DataFrame:
    return delete(blobs, F.col("sha256") == digest)


def total_bytes(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))


def set_settings(log: DataFrame) -> DataFrame:
    """One row per key: the latest write's value."""
    last = F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "seq"))
    return log.groupBy("key").agg(last.alias("s")).select("key", "s.value", "s.updated_at")


def get_setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.where(F.col("key") == key).select("value")


def list_settings(settings: DataFrame) -> DataFrame:
    return settings.orderBy("key")


def delete_setting(settings: DataFrame, key: str) -> DataFrame:
    return delete(settings, F.col("key") == key)
