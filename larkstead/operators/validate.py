"""Constraints as queries: what a table format without them can't enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RELATIONS, ROLES, STATES, conform


def broken(rows: DataFrame, key: str, name: str, good: Column) -> DataFrame:
    """(rule, key) of rows for which a check is false; unknown passes, as in CHECK."""
    return rows.where(~F.coalesce(good, F.lit(True))).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicated(rows: DataFrame, columns: list[str], name: str, where: Column | None = None) -> DataFrame:
    """(rule, key) of values that more than one row has; null never collides."""
    chosen = rows if where is None else rows.where(where)
    for c in columns:
        chosen = chosen.where(F.col(c).isNotNull())
    return chosen.groupBy(*columns).count().where("count > 1").select(F.lit(name).alias("rule"), F.concat_ws("|", *columns).alias("key"))


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str, name: str) -> DataFrame:
    """(rule, key) of references without a parent."""
    known = parents.select(F.col(key).alias("_parent"))
    return rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_parent"), "left_anti").select(F.lit(name).alias("rule"), F.col("id").cast("string").alias("key"))


def violations(users: DataFrame, sessions: DataFrame, blobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(rule, n): how often each constraint of the data model is broken; rules kept have no row."""
    found = [
        broken(users, "id", "users.role", F.col("role").isin(*ROLES)),
        duplicated(users, ["email_folded"], "users.email_folded"),
        orphans(sessions, "user_id", users, "id", "sessions.user_id"),
        broken(blobs, "sha256", "blobs.size_bytes", F.col("size_bytes") >= 0),
        duplicated(blobs, ["sha256"], "blobs.sha256"),
        broken(jobs, "id", "jobs.state", F.col("state").isin(*STATES)),
        broken(jobs, "id", "jobs.progress", F.col("progress").between(0, 1)),
        broken(jobs, "id", "jobs.attempts", F.col("attempts") <= F.col("max_attempts")),
        duplicated(jobs, ["dedupe_key"], "jobs.dedupe_key", F.col("state").isin("queued", "running")),
    ]
    return reduce(DataFrame.unionByName, found).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def null_counts(relations: dict[str, DataFrame]) -> DataFrame:
    """(relation, rows, nulls): rows of each relation, brought to its schema, and those with a null where none may be."""

    def one(name: str, rows: DataFrame) -> DataFrame:
        needed = [F.col(f.name).isNull() for f in RELATIONS[name] if not f.nullable]
        return conform(rows, name).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(reduce(Column.__or__, needed), 1)).alias("nulls")).select(F.lit(name).alias("relation"), "rows", "nulls")

    return reduce(DataFrame.unionByName, [one(name, rows) for name, rows in relations.items()])
