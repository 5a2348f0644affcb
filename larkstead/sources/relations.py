"""The relations, derived from the star-schema tables that stand in for them.

Orders become jobs, events become sessions and a settings log, customers users, documents blobs
and pages, lineitems usage. Each is a projection of one scan, so filters and columns reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LEASE_MS, SESSION_MS


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    """Whole milliseconds, rounded down, of a zone-less timestamp taken as UTC."""
    return F.expr(f"cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) / 1000.0) as long)")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id",
        "concat(c_name, '@Example.com') as email",
        "lower(concat(c_name, '@Example.com')) as email_folded",
        "c_name as display_name",
        "sha2(cast(c_custkey as string), 256) as password_hash",
        "element_at(array('admin', 'member', 'viewer'), cast(c_custkey % 3 + 1 as int)) as role",
        "c_custkey as created_at",
        "c_custkey as updated_at",
        "if(c_custkey % 5 = 0, null, c_custkey + 1000) as last_login_at",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "events").withColumn("ms", millis("ts")).selectExpr(
        "event_id as id",
        "user_id",
        "unhex(sha2(cast(event_id as string), 256)) as token_hash",
        "event_type as user_agent",
        "concat('192.0.2.', event_id % 256) as ip",
        "ms as created_at",
        "ms as last_seen_at",
        f"ms + {SESSION_MS} as expires_at",
    )


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "events").withColumn("ms", millis("ts")).selectExpr("cast(user_id as string) as key", "event_type as value", "ms as updated_at", "event_id as seq")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = "case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else element_at(array('succeeded', 'failed', 'cancelled'), cast(o_orderkey % 3 + 1 as int)) end"
    base = scan(spark, sf_dir, "orders").withColumn("ms", millis("o_orderdate")).withColumn("st", F.expr(state))
    return base.selectExpr(
        "o_orderkey as id",
        "element_at(array('convert', 'translate', 'extract'), cast(o_orderkey % 3 + 1 as int)) as kind",
        """concat('{"documentId":"doc_', o_custkey, '","page":', o_orderkey % 100, '}') as payload""",
        "st as state",
        "5L - cast(substring(o_orderpriority, 1, 1) as long) as priority",
        "case when st = 'running' then (o_orderkey % 10) / 10D when st = 'succeeded' then 1D else 0D end as progress",
        "'' as progress_note",
        "o_orderkey % 4 as attempts",
        "3L as max_attempts",
        "if(st = 'failed', 'boom', '') as last_error",
        "0L as tokens_in",
        "0L as tokens_out",
        "cast(cast(o_totalprice as decimal(18,2)) * 1000 as long) as cost_micros",
        "ms as run_after",
        f"if(st = 'running', ms + {LEASE_MS}, null) as lease_until",
        "if(st = 'running', concat('w', o_orderkey % 4), '') as worker",
        "if(o_orderkey % 10 = 0, null, cast(o_custkey as string)) as dedupe_key",
        "ms as created_at",
        "ms as updated_at",
        "if(st = 'queued', null, ms) as started_at",
        "if(st in ('succeeded', 'failed', 'cancelled'), ms + 86400000, null) as finished_at",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as job_id",
        "cast(l_quantity as long) as tokens_in",
        "cast(l_linenumber as long) * 10 as tokens_out",
        "cast(cast(l_extendedprice as decimal(18,2)) * 1000 as long) as cost_micros",
    )


def blob_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per put, in order of seq: the same bytes may be put again."""
    return scan(spark, sf_dir, "documents").selectExpr("sha2(text, 256) as sha256", "cast(octet_length(text) as long) as size_bytes", "concat('text/', lang) as media_type", "doc_id as created_at", "doc_id as seq", "text as content")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in order, each with a language label and its text."""
    return scan(spark, sf_dir, "documents").selectExpr("doc_id as page", "lang", "text", "source")


def sections(spark: SparkSession, sf_dir: str, per: int = 16) -> DataFrame:
    """Manifests of ten sections each, of ``per`` pages; the first six pages are left out."""
    return scan(spark, sf_dir, "documents").where("doc_id >= 6").groupBy(F.floor((F.col("doc_id") - 6) / per).alias("no")).agg(F.min("doc_id").alias("pdf_start"), F.max("doc_id").alias("pdf_end")).selectExpr(
        "concat('m', floor(no / 10)) as document", "concat('S', no) as code", "pdf_start", "pdf_end", "pdf_end - pdf_start + 1 as pages", "pdf_start - 6 - (no % 3) as printed_page"
    )
