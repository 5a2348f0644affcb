"""Labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sample(labels: DataFrame, label_column: str, usable: Column, rows: int, id_column: str = "doc_id") -> dict:
    """id -> label (0 or 1) of at most ``rows`` usable labelled ids, those of smallest hash; null ids and labels don't count.

    An id with both labels counts as 0.
    """
    one = (
        labels.where(usable & F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1))
        .groupBy(F.col(id_column).alias("i"))
        .agg(F.min(label_column).cast("int").alias("y"))
    )
    return {r["i"]: r["y"] for r in one.orderBy(F.xxhash64(F.lit(5), "i"), "i").limit(rows).collect()}
