"""Changes of immutable snapshots: each takes a snapshot and gives the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(condition: Column | str) -> Column:
    """A condition where unknown counts as false, as in WHERE."""
    return F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))


def update(rows: DataFrame, condition: Column | str, values: dict[str, Column | str]) -> DataFrame:
    """rows with new values where the condition holds; all values see the old row."""
    yes = holds(condition)
    new = {n: F.when(yes, (F.expr(v) if isinstance(v, str) else v).cast(rows.schema[n].dataType)).otherwise(F.col(n)) for n, v in values.items()}
    return rows.withColumns(new)


def delete(rows: DataFrame, condition: Column | str) -> DataFrame:
    """rows but those where the condition holds; unknown keeps a row."""
    return rows.where(~holds(condition))


def affected(rows: DataFrame, condition: Column | str) -> DataFrame:
    """The number of rows that a change with this condition touches."""
    return rows.where(holds(condition)).agg(F.count(F.lit(1)).alias("affected"))


def first_of(new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; rows with a null key never collide. Aggregates partially, so a frequent key is no hot spot."""
    chosen = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")
    return chosen.unionByName(new.where(F.col(key).isNull()))


def inserted(rows: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What INSERT ... RETURNING gives: those of ``new`` whose key no row has; of new ones with one key, the first by ``order``."""
    return first_of(new, key, order).join(rows.select(key), key, "left_anti").select(*rows.columns)


def insert_new(rows: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows and the new ones that ``inserted`` gives."""
    return rows.unionByName(inserted(rows, new, key, order))
