"""Every operator of the library as a named query over the test tables, with its SQL counterpart.

``NOW_*`` are the clocks of the queries: no query reads the real one.
"""

from __future__ import annotations

import hmac
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import text as tx
from ..operators import accounts, content, documents, jobs, validate
from ..operators.snapshot import affected
from ..sources import content as files
from ..sources import relations as rel
from ..streaming import jobs as stream

NOW_JOBS = 801_964_800_000
NOW_SESSIONS = 1_705_708_800_000
DAY = 86_400_000
KEY = b"a test key of thirty-two bytes!!"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_MS = "(epoch_us({})//1000)"
_VIEWS = {
    "v_users": """SELECT c_custkey AS id, c_name || '@Example.com' AS email, lower(c_name || '@Example.com') AS email_folded, c_name AS display_name,
        sha256(c_custkey::VARCHAR) AS password_hash, CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'member' ELSE 'viewer' END AS role,
        c_custkey AS created_at, c_custkey AS updated_at, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey + 1000 END AS last_login_at FROM customer""",
    "v_sessions": f"""SELECT event_id AS id, user_id, sha256(event_id::VARCHAR) AS token_hash, event_type AS user_agent, '192.0.2.' || (event_id % 256) AS ip,
        {_MS.format('ts')} AS created_at, {_MS.format('ts')} AS last_seen_at, {_MS.format('ts')} + 604800000 AS expires_at FROM events""",
    "v_settings_log": f"SELECT user_id::VARCHAR AS key, event_type AS value, {_MS.format('ts')} AS updated_at, event_id AS seq FROM events",
    "v_settings": "SELECT key, arg_max(value, (updated_at, seq)) AS value, max(updated_at) AS updated_at FROM v_settings_log GROUP BY key",
    "v_jobs0": f"""SELECT o_orderkey AS id, {_MS.format('o_orderdate')} AS ms, o_custkey, o_orderkey, o_totalprice, o_orderpriority,
        CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'cancelled' END END AS st FROM orders""",
    "v_jobs": """SELECT id, CASE id % 3 WHEN 0 THEN 'convert' WHEN 1 THEN 'translate' ELSE 'extract' END AS kind,
        '{"documentId":"doc_' || o_custkey || '","page":' || (id % 100) || '}' AS payload, st AS state, 5 - substr(o_orderpriority, 1, 1)::BIGINT AS priority,
        CASE WHEN st = 'running' THEN (id % 10) / 10.0::DOUBLE WHEN st = 'succeeded' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS progress, '' AS progress_note,
        id % 4 AS attempts, 3::BIGINT AS max_attempts, CASE WHEN st = 'failed' THEN 'boom' ELSE '' END AS last_error, 0::BIGINT AS tokens_in, 0::BIGINT AS tokens_out,
        (o_totalprice::DECIMAL(18,2) * 1000)::BIGINT AS cost_micros, ms AS run_after, CASE WHEN st = 'running' THEN ms + 900000 END AS lease_until,
        CASE WHEN st = 'running' THEN 'w' || (id % 4) ELSE '' END AS worker, CASE WHEN id % 10 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS dedupe_key,
        ms AS created_at, ms AS updated_at, CASE WHEN st = 'queued' THEN NULL ELSE ms END AS started_at,
        CASE WHEN st IN ('succeeded', 'failed', 'cancelled') THEN ms + 86400000 END AS finished_at FROM v_jobs0""",
    "v_usage": "SELECT l_orderkey AS job_id, l_quantity::BIGINT AS tokens_in, l_linenumber::BIGINT * 10 AS tokens_out, (l_extendedprice::DECIMAL(18,2) * 1000)::BIGINT AS cost_micros FROM lineitem",
    "v_puts": "SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes, 'text/' || lang AS media_type, doc_id AS created_at, doc_id AS seq FROM documents",
    "v_blobs": "SELECT sha256, arg_min(size_bytes, (created_at, seq)) AS size_bytes, arg_min(media_type, (created_at, seq)) AS media_type, min(created_at) AS created_at FROM v_puts GROUP BY sha256",
    "v_sections": """SELECT 'm' || (no // 10) AS document, 'S' || no AS code, min(doc_id) AS pdf_start, max(doc_id) AS pdf_end, max(doc_id) - min(doc_id) + 1 AS pages, min(doc_id) - 6 - no % 3 AS printed_page
        FROM (SELECT doc_id, (doc_id - 6) // 16 AS no FROM documents WHERE doc_id >= 6) GROUP BY no""",
    "v_altered": "SELECT document, CASE pdf_start % 7 WHEN 0 THEN 'S' ELSE code END AS code, pdf_start - 6 + pdf_start % 3 AS pdf_start, pdf_end - 6 AS pdf_end, pages FROM v_sections",
    "v_checked": "SELECT *, lag(pdf_end) OVER (PARTITION BY document ORDER BY pdf_start, code) AS before, count(*) OVER (PARTITION BY document, code) AS same FROM v_altered",
    "v_tokens": "SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS token FROM documents",
}


def sql(body: str) -> str:
    """body with the views that it names, and those that they name."""
    found: list[str] = []

    def add(text: str) -> None:
        for name, view in _VIEWS.items():
            if name in text.replace(",", " ").replace("(", " ").replace(")", " ").split() and name not in found:
                add(view)
                found.append(name)

    add(body)
    return ("WITH " + ", ".join(f"{n} AS ({_VIEWS[n]})" for n in found) + " " if found else "") + body


def query(oracle: str | None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            SQL[key] = sql(oracle)
        return f

    return register


def transition(name: str, change: Callable[[DataFrame], DataFrame], where: str, sets: str, view: str = "v_jobs", base=rel.jobs) -> None:
    """A snapshot after a change, against CASE expressions: 'column = value; ...' where a condition holds."""
    new = ", ".join(f"CASE WHEN coalesce({where}, false) THEN {v} ELSE {c} END AS {c}" for c, v in (x.split(" = ", 1) for x in re.split(r"; (?=\w+ = )", sets)))
    query(f"SELECT * REPLACE ({new}) FROM {view}", name)(lambda spark, d: shown(change(base(spark, d))))


def shown(rows: DataFrame) -> DataFrame:
    """Binary hashes as text."""
    return rows.withColumn("token_hash", F.lower(F.hex("token_hash"))) if "token_hash" in rows.columns else rows


# Jobs

query("SELECT state, count(*)::BIGINT AS count FROM v_jobs GROUP BY state", "jobs_count_by_state")(lambda s, d: jobs.count_by_state(rel.jobs(s, d)))
query("SELECT * FROM v_jobs WHERE id = 37", "jobs_get")(lambda s, d: jobs.get(rel.jobs(s, d), 37))
query("SELECT * FROM v_jobs WHERE dedupe_key = '7' AND state IN ('queued', 'running') ORDER BY id LIMIT 1", "jobs_pending_by_dedupe")(lambda s, d: jobs.pending_by_key(rel.jobs(s, d), "7"))
query("SELECT * FROM v_jobs ORDER BY created_at DESC, id LIMIT 50", "jobs_recent")(lambda s, d: jobs.recent(rel.jobs(s, d)))
query("SELECT * FROM v_jobs WHERE state = 'queued' ORDER BY created_at DESC, id LIMIT 25", "jobs_recent_by_state")(lambda s, d: jobs.recent(rel.jobs(s, d), 25, "queued"))
query("SELECT * FROM v_jobs WHERE state IN ('queued', 'running')", "jobs_active")(lambda s, d: jobs.active(rel.jobs(s, d)))
query("SELECT * EXCLUDE (lease_until, worker, run_after, dedupe_key) FROM v_jobs", "jobs_public")(lambda s, d: jobs.public(rel.jobs(s, d)))

_CLAIMED = "state, worker, lease_until, attempts, started_at, updated_at"
_CLAIM = f"""SELECT * EXCLUDE (rn) REPLACE ('running' AS state, 'w' || rn AS worker, {NOW_JOBS + 900_000}::BIGINT AS lease_until, attempts + 1 AS attempts,
    coalesce(started_at, {NOW_JOBS}) AS started_at, {NOW_JOBS}::BIGINT AS updated_at)
    FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, id) AS rn FROM v_jobs WHERE state = 'queued' AND run_after <= {NOW_JOBS}) WHERE rn <= """
query(_CLAIM + "1", "jobs_claim_next")(lambda s, d: jobs.claim_next(rel.jobs(s, d), "w1", NOW_JOBS))
query(_CLAIM + "8", "jobs_claim_k")(lambda s, d: jobs.claim_k(rel.jobs(s, d), [f"w{i}" for i in range(1, 9)], NOW_JOBS))


@query(f"""SELECT * FROM v_jobs WHERE id NOT IN (SELECT id FROM v_jobs WHERE state = 'queued' AND run_after <= {NOW_JOBS} ORDER BY priority DESC, id LIMIT 8)
    UNION ALL SELECT * FROM ({_CLAIM}8)""")
def jobs_claim_applied(spark, d):
    found = rel.jobs(spark, d)
    return jobs.applied(found, jobs.claim_k(found, [f"w{i}" for i in range(1, 9)], NOW_JOBS))


def _new_jobs(spark, d) -> DataFrame:
    """Every job again under another id."""
    return rel.jobs(spark, d).selectExpr(
        *[{"id": "id + 100000000 as id", "state": "'queued' as state", "lease_until": "cast(null as long) as lease_until", "worker": "'' as worker"}.get(n, n) for n in rel.jobs(spark, d).columns]
    )


_NEW = "SELECT * REPLACE (id + 100000000 AS id, 'queued' AS state, NULL::BIGINT AS lease_until, '' AS worker) FROM v_jobs"
_JUDGED = f"""SELECT n.*, CASE WHEN n.dedupe_key IS NULL THEN NULL ELSE coalesce(p.id, min(n.id) OVER (PARTITION BY n.dedupe_key)) END AS holder FROM ({_NEW}) n
    LEFT JOIN (SELECT dedupe_key AS key, min(id) AS id FROM v_jobs WHERE state IN ('queued', 'running') GROUP BY dedupe_key) p ON p.key = n.dedupe_key"""
_ACCEPTED = f"SELECT * EXCLUDE (holder) FROM ({_JUDGED}) WHERE holder IS NULL OR holder = id"
query(f"SELECT * FROM v_jobs UNION ALL {_ACCEPTED}", "jobs_enqueue")(lambda s, d: jobs.enqueue(rel.jobs(s, d), _new_jobs(s, d))[0])
query(_ACCEPTED, "jobs_enqueue_returning")(lambda s, d: jobs.accepted(rel.jobs(s, d), _new_jobs(s, d)))
query(f"SELECT id, dedupe_key, holder FROM ({_JUDGED}) WHERE holder <> id", "jobs_enqueue_rejected")(lambda s, d: jobs.enqueue(rel.jobs(s, d), _new_jobs(s, d))[1])
query("SELECT * FROM v_jobs ORDER BY created_at DESC, id LIMIT 50", "jobs_recent_default")(lambda s, d: jobs.recent(rel.jobs(s, d), 0))


def _ids():
    return F.col("id") % 7 == 0


_FREED = "lease_until = NULL; worker = ''"
_AT = f"{NOW_JOBS}::BIGINT"
transition("jobs_progress", lambda j: jobs.progress(j, _ids(), 42.0, "half", NOW_JOBS), "id % 7 = 0 AND state = 'running'", f"progress = 1.0::DOUBLE; progress_note = 'half'; updated_at = {_AT}")
transition("jobs_extend_lease", lambda j: jobs.extend_lease(j, _ids(), NOW_JOBS), "id % 7 = 0 AND state = 'running'", f"lease_until = {NOW_JOBS + 900_000}::BIGINT; updated_at = {_AT}")
transition("jobs_complete", lambda j: jobs.complete(j, _ids(), "done", NOW_JOBS), "id % 7 = 0", f"state = 'succeeded'; progress = 1.0::DOUBLE; progress_note = 'done'; {_FREED}; finished_at = {_AT}; updated_at = {_AT}")
transition("jobs_release", lambda j: jobs.release(j, _ids(), NOW_JOBS), "id % 7 = 0 AND state = 'running'", f"state = 'queued'; attempts = greatest(attempts - 1, 0); run_after = {_AT}; {_FREED}; updated_at = {_AT}")
transition("jobs_retry", lambda j: jobs.retry(j, _ids(), "again", NOW_JOBS + 5000, NOW_JOBS), "id % 7 = 0", f"state = 'queued'; last_error = 'again'; run_after = {NOW_JOBS + 5000}::BIGINT; {_FREED}; updated_at = {_AT}")
transition("jobs_fail", lambda j: jobs.fail(j, _ids(), "broken", NOW_JOBS), "id % 7 = 0", f"state = 'failed'; last_error = 'broken'; {_FREED}; finished_at = {_AT}; updated_at = {_AT}")
_OPEN = "id % 7 = 0 AND state IN ('queued', 'running')"
transition("jobs_cancel", lambda j: jobs.cancel(j, _ids(), NOW_JOBS)[0], _OPEN, f"state = 'cancelled'; {_FREED}; finished_at = {_AT}; updated_at = {_AT}")
query(f"SELECT count(*)::BIGINT AS affected FROM v_jobs WHERE {_OPEN}", "jobs_cancel_affected")(lambda s, d: jobs.cancel(rel.jobs(s, d), _ids(), NOW_JOBS)[1])
_LAPSED = f"state = 'running' AND lease_until < {NOW_JOBS}"
transition("jobs_reclaim", lambda j: jobs.reclaim(j, NOW_JOBS)[0], _LAPSED, f"state = 'queued'; {_FREED}; last_error = '{jobs.RECLAIMED}'; updated_at = {_AT}")
query(f"SELECT count(*)::BIGINT AS affected FROM v_jobs WHERE {_LAPSED}", "jobs_reclaim_affected")(lambda s, d: jobs.reclaim(rel.jobs(s, d), NOW_JOBS)[1])
_OLD = f"state IN ('succeeded', 'failed', 'cancelled') AND finished_at < {NOW_JOBS}"
query(f"SELECT * FROM v_jobs WHERE NOT coalesce({_OLD}, false)", "jobs_purge")(lambda s, d: jobs.purge(rel.jobs(s, d), NOW_JOBS)[0])
query(f"SELECT count(*)::BIGINT AS affected FROM v_jobs WHERE {_OLD}", "jobs_purge_affected")(lambda s, d: jobs.purge(rel.jobs(s, d), NOW_JOBS)[1])
query(
    """SELECT j.* REPLACE (j.tokens_in + coalesce(u.a, 0) AS tokens_in, j.tokens_out + coalesce(u.b, 0) AS tokens_out, j.cost_micros + coalesce(u.c, 0) AS cost_micros)
    FROM v_jobs j LEFT JOIN (SELECT job_id, sum(tokens_in)::BIGINT AS a, sum(tokens_out)::BIGINT AS b, sum(cost_micros)::BIGINT AS c FROM v_usage GROUP BY job_id) u ON u.job_id = j.id""",
    "jobs_usage_totals",
)(lambda s, d: jobs.record_usage(rel.jobs(s, d), rel.usage(s, d)))
query(
    """SELECT json_extract_string(payload, '$.documentId') AS document, sum(cost_micros)::BIGINT AS cost_micros, count(*)::BIGINT AS jobs FROM v_jobs GROUP BY 1""", "jobs_cost_by_document"
)(lambda s, d: rel.jobs(s, d).groupBy(F.get_json_object("payload", "$.documentId").alias("document")).agg(F.sum("cost_micros").alias("cost_micros"), F.count(F.lit(1)).alias("jobs")))
transition("jobs_without_handler", lambda j: jobs.without_handler(j, ["convert", "translate"], NOW_JOBS), "state = 'running' AND kind NOT IN ('convert', 'translate')", f"state = 'failed'; last_error = 'no handler registered for job kind ' || kind; {_FREED}; finished_at = {_AT}; updated_at = {_AT}")
_DELAY = "least(5000 * (1::BIGINT << least(greatest({0}, 1) - 1, 16)::INTEGER), 600000)"
_RETRY = f"({_DELAY} - ('0x' || substr(sha256({{1}}::VARCHAR), 1, 8))::BIGINT % ({_DELAY} // 4))"
_AGAIN = "id % 7 = 0 AND state = 'running' AND attempts < max_attempts"
_SPENT = "id % 7 = 0 AND attempts >= max_attempts"
query(
    f"""SELECT * REPLACE (CASE WHEN {_SPENT} THEN 'failed' WHEN {_AGAIN} THEN 'queued' ELSE state END AS state, CASE WHEN {_SPENT} OR {_AGAIN} THEN 'broken' ELSE last_error END AS last_error,
    CASE WHEN {_SPENT} OR {_AGAIN} THEN NULL ELSE lease_until END AS lease_until, CASE WHEN {_SPENT} OR {_AGAIN} THEN '' ELSE worker END AS worker,
    CASE WHEN {_SPENT} THEN {_AT} ELSE finished_at END AS finished_at, CASE WHEN {_SPENT} OR {_AGAIN} THEN {_AT} ELSE updated_at END AS updated_at,
    CASE WHEN {_AGAIN} THEN {NOW_JOBS} + {_RETRY.format('attempts', 'id')} ELSE run_after END AS run_after) FROM v_jobs""",
    "jobs_finish_attempts",
)(lambda s, d: jobs.finish_attempts(rel.jobs(s, d), _ids(), "broken", NOW_JOBS))

# Sessions

_LIVE = f"s.expires_at > {NOW_SESSIONS}"
_PAIR = "s.id AS session_id, s.expires_at, u.id AS user_id, u.email, u.role"


@query(f"SELECT {_PAIR} FROM v_sessions s JOIN v_users u ON u.id = s.user_id WHERE {_LIVE}")
def session_auth(spark, d):
    found = accounts.authenticate(rel.sessions(spark, d), rel.users(spark, d), None, NOW_SESSIONS)
    return found.select(F.col("session.id").alias("session_id"), "session.expires_at", F.col("user.id").alias("user_id"), "user.email", "user.role")


@query(f"SELECT {_PAIR} FROM v_sessions s JOIN v_users u ON u.id = s.user_id WHERE {_LIVE} AND s.token_hash = sha256('9500')")
def session_by_token(spark, d):
    found = accounts.authenticate(rel.sessions(spark, d), rel.users(spark, d), fn.token_hash(F.lit("9500")), NOW_SESSIONS)
    return found.select(F.col("session.id").alias("session_id"), "session.expires_at", F.col("user.id").alias("user_id"), "user.email", "user.role")


query("SELECT * FROM v_sessions WHERE user_id = 7", "session_list")(lambda s, d: shown(accounts.list_sessions(rel.sessions(s, d), 7)))
query(f"SELECT * FROM v_sessions WHERE NOT expires_at <= {NOW_SESSIONS}", "session_sweep")(lambda s, d: shown(accounts.sweep_sessions(rel.sessions(s, d), NOW_SESSIONS)[0]))
query(f"SELECT count(*)::BIGINT AS affected FROM v_sessions WHERE expires_at <= {NOW_SESSIONS}", "session_sweep_affected")(lambda s, d: accounts.sweep_sessions(rel.sessions(s, d), NOW_SESSIONS)[1])
transition("session_touch", lambda x: accounts.touch_session(x, _ids(), NOW_SESSIONS), "id % 7 = 0", f"last_seen_at = {NOW_SESSIONS}::BIGINT", "v_sessions", rel.sessions)
transition("session_extend", lambda x: accounts.extend_session(x, _ids(), NOW_SESSIONS), f"id % 7 = 0 AND {NOW_SESSIONS} - last_seen_at > {DAY}", f"last_seen_at = {NOW_SESSIONS}::BIGINT; expires_at = {NOW_SESSIONS + 7 * DAY}::BIGINT", "v_sessions", rel.sessions)
query("SELECT * FROM v_sessions WHERE id <> 11", "session_delete")(lambda s, d: shown(accounts.delete_sessions(rel.sessions(s, d), F.col("id") == 11)))
query("SELECT * FROM v_sessions WHERE token_hash <> sha256('12')", "session_delete_by_token")(lambda s, d: shown(accounts.delete_sessions(rel.sessions(s, d), F.col("token_hash") == fn.token_hash(F.lit("12")))))
query("SELECT * FROM v_sessions WHERE user_id <> 7", "session_delete_user")(lambda s, d: shown(accounts.delete_sessions(rel.sessions(s, d), F.col("user_id") == 7)))
query("SELECT id, user_id, created_at, last_seen_at, expires_at FROM v_sessions", "session_public")(lambda s, d: accounts.public_session(rel.sessions(s, d)))


_NEW_SESSIONS = "SELECT * REPLACE (id + 100000000 AS id, user_id + 100 AS user_id) FROM v_sessions WHERE user_id + 100 IN (SELECT id FROM v_users)"


def _new_sessions(old: DataFrame) -> DataFrame:
    """Every session again, for users some of whom are unknown."""
    return old.withColumns({"id": F.col("id") + 100000000, "user_id": F.col("user_id") + 100})


@query(f"SELECT * FROM v_sessions UNION ALL {_NEW_SESSIONS}")
def session_create(spark, d):
    old = rel.sessions(spark, d)
    return shown(accounts.create_session(old, _new_sessions(old), rel.users(spark, d)))


query(_NEW_SESSIONS, "session_create_returning")(lambda s, d: shown(accounts.created_sessions(_new_sessions(rel.sessions(s, d)), rel.users(s, d))))

# Users

query("SELECT * FROM v_users WHERE email_folded = lower(trim(' Customer#000000042@EXAMPLE.com '))", "user_by_email")(lambda s, d: accounts.user_by_email(rel.users(s, d), " Customer#000000042@EXAMPLE.com "))
query("SELECT * FROM v_users WHERE id = 42", "user_by_id")(lambda s, d: accounts.user_by_id(rel.users(s, d), 42))
query("SELECT count(*)::BIGINT AS count FROM v_users", "user_count")(lambda s, d: accounts.count_users(rel.users(s, d)))
query("SELECT * FROM v_users", "user_list")(lambda s, d: accounts.list_users(rel.users(s, d)))
query("SELECT id, email, display_name, role, created_at, last_login_at FROM v_users", "user_public")(lambda s, d: accounts.public_user(rel.users(s, d)))
transition("user_touch", lambda x: accounts.touch_login(x, _ids(), NOW_SESSIONS), "id % 7 = 0", f"last_login_at = {NOW_SESSIONS}::BIGINT; updated_at = {NOW_SESSIONS}::BIGINT", "v_users", rel.users)
query(f"SELECT * REPLACE (CASE WHEN id = 7 THEN 'new' ELSE password_hash END AS password_hash, CASE WHEN id = 7 THEN {NOW_SESSIONS} ELSE updated_at END AS updated_at) FROM v_users", "user_password")(
    lambda s, d: accounts.change_password(rel.users(s, d), rel.sessions(s, d), 7, "new", NOW_SESSIONS)[0]
)
query("SELECT * FROM v_sessions WHERE user_id <> 7", "user_password_sessions")(lambda s, d: shown(accounts.change_password(rel.users(s, d), rel.sessions(s, d), 7, "new", NOW_SESSIONS)[1]))
query("SELECT * FROM v_users WHERE id % 3 <> 0", "user_delete")(lambda s, d: accounts.delete_user(rel.users(s, d), rel.sessions(s, d), F.col("id") % 3 == 0)[0])
query("SELECT * FROM v_sessions WHERE user_id IN (SELECT id FROM v_users WHERE id % 3 <> 0)", "user_delete_cascade")(lambda s, d: shown(accounts.delete_user(rel.users(s, d), rel.sessions(s, d), F.col("id") % 3 == 0)[1]))


_NEW_USERS = "SELECT * REPLACE (id + 100000000 AS id, 'new-' || email_folded AS email_folded) FROM v_users WHERE id % 3 = 0"


def _new_users(old: DataFrame) -> DataFrame:
    """Every user twice more; each third with a new address, which both have."""
    address = F.when(F.col("id") % 3 == 0, F.concat(F.lit("new-"), "email_folded")).otherwise(F.col("email_folded"))
    again = old.withColumn("email_folded", address)
    return again.withColumn("id", F.col("id") + 100000000).union(again.withColumn("id", F.col("id") + 200000000))


query(f"SELECT * FROM v_users UNION ALL {_NEW_USERS}", "user_create")(lambda s, d: accounts.create_user(rel.users(s, d), _new_users(rel.users(s, d))))
query(_NEW_USERS, "user_create_returning")(lambda s, d: accounts.created_users(rel.users(s, d), _new_users(rel.users(s, d))))
query("SELECT id, CASE id % 2 WHEN 0 THEN 'passphrase' ELSE 'file' END AS kind, '' AS ciphertext, '' AS salt FROM v_users", "keyring_public_wraps")(
    lambda s, d: accounts.public_wraps(rel.users(s, d).selectExpr("id", "if(id % 2 = 0, 'passphrase', 'file') as kind", "password_hash as ciphertext", "display_name as salt"))
)
query("SELECT 'users' AS relation, count(*)::BIGINT AS rows, 0::BIGINT AS nulls FROM v_users UNION ALL SELECT 'sessions', count(*), 0 FROM v_sessions UNION ALL SELECT 'jobs', count(*), 0 FROM v_jobs UNION ALL SELECT 'settings', count(*), 0 FROM v_settings UNION ALL SELECT 'blobs', count(*), 0 FROM v_blobs", "schema_null_counts")(
    lambda s, d: validate.null_counts({"users": rel.users(s, d), "sessions": rel.sessions(s, d), "jobs": rel.jobs(s, d), "settings": content.set_settings(rel.settings_log(s, d)), "blobs": content.put_blobs(rel.blob_puts(s, d))})
)


# Blobs and settings

query("SELECT * FROM v_blobs", "blob_put_first")(lambda s, d: content.put_blobs(rel.blob_puts(s, d)))


@query("""SELECT * FROM v_blobs UNION ALL SELECT sha256(sha256), size_bytes, 'new' AS media_type, created_at FROM v_blobs WHERE created_at % 2 = 0""")
def blob_upsert_first(spark, d):
    """Every blob twice more, half of them with a new digest, which both have."""
    found = content.put_blobs(rel.blob_puts(spark, d))
    new = found.withColumns({"sha256": F.expr("if(created_at % 2 = 0, sha2(sha256, 256), sha256)"), "media_type": F.lit("new")})
    return content.upsert_blob(found, new.union(new.withColumns({"created_at": F.col("created_at") + 1, "media_type": F.lit("late")})))


_DIGEST = "(SELECT min(sha256) FROM v_blobs)"


def _digest(spark, d) -> str:
    return rel.blob_puts(spark, d).agg(F.min("sha256")).first()[0]


query(f"SELECT * FROM v_blobs WHERE sha256 = {_DIGEST}", "blob_get")(lambda s, d: content.get_blob(content.put_blobs(rel.blob_puts(s, d)), _digest(s, d)))
query(f"SELECT * FROM v_blobs WHERE sha256 <> {_DIGEST}", "blob_delete")(lambda s, d: content.delete_blob(content.put_blobs(rel.blob_puts(s, d)), _digest(s, d)))
query("SELECT sum(size_bytes)::BIGINT AS total_bytes FROM v_blobs", "blob_total_bytes")(lambda s, d: content.total_bytes(content.put_blobs(rel.blob_puts(s, d))))
query("SELECT sha256, substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 AS path FROM v_blobs", "blob_paths")(
    lambda s, d: content.put_blobs(rel.blob_puts(s, d)).select("sha256", fn.blob_path("sha256").alias("path"))
)


_WANTED = "SELECT sha256(CASE doc_id % 2 WHEN 0 THEN text ELSE text || doc_id END) AS sha256 FROM documents"


def _wanted(spark, d) -> DataFrame:
    """Every document's digest, half of them of an altered text."""
    return rel.scan(spark, d, "documents").selectExpr("sha2(if(doc_id % 2 = 0, text, concat(text, doc_id)), 256) as sha256")


query(f"SELECT sha256, sha256 IN (SELECT sha256 FROM v_blobs) AS present FROM ({_WANTED})", "blob_exists")(lambda s, d: content.blobs_exist(content.put_blobs(rel.blob_puts(s, d)), _wanted(s, d)))
query(f"SELECT w.sha256, b.size_bytes, b.media_type FROM ({_WANTED}) w LEFT JOIN v_blobs b ON b.sha256 = w.sha256", "blob_stat")(lambda s, d: content.stat_blobs(content.put_blobs(rel.blob_puts(s, d)), _wanted(s, d)))


def _files(spark, d) -> DataFrame:
    """Documents as blob files are read; the content of every fourth was tampered with."""
    return rel.blob_puts(spark, d).select("seq", F.col("sha256").alias("digest"), F.expr("cast(if(seq % 4 = 0, concat(content, 'x'), content) as binary)").alias("content"))


query("SELECT doc_id AS seq FROM documents WHERE doc_id % 4 = 0", "blob_verify")(lambda s, d: files.corrupt(_files(s, d)).select("seq"))
query("SELECT doc_id AS seq, substr(hex(encode(CASE doc_id % 4 WHEN 0 THEN text || 'x' ELSE text END)), 21, 64) AS part FROM documents", "blob_range")(
    lambda s, d: files.read_range(_files(s, d), 10, 32).select("seq", F.hex("part").alias("part"))
)
query("SELECT doc_id, regexp_full_match(s, '[0-9a-f]{64}') AS valid FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) ELSE text END AS s FROM documents)", "blob_valid_digest")(
    lambda s, d: rel.scan(s, d, "documents").select("doc_id", fn.valid_digest(F.expr("case doc_id % 3 when 0 then sha2(text, 256) when 1 then upper(sha2(text, 256)) else text end")).alias("valid"))
)

query("SELECT key, value, updated_at FROM v_settings", "setting_upsert_last")(lambda s, d: content.set_settings(rel.settings_log(s, d)))
query("SELECT value FROM v_settings WHERE key = '7'", "setting_get")(lambda s, d: content.get_setting(content.set_settings(rel.settings_log(s, d)), "7"))
query("SELECT * FROM v_settings", "setting_list")(lambda s, d: content.list_settings(content.set_settings(rel.settings_log(s, d))))
query("SELECT * FROM v_settings WHERE key <> '7'", "setting_delete")(lambda s, d: content.delete_setting(content.set_settings(rel.settings_log(s, d)), "7"))

# Scalars

_DIGITS = fn.CROCKFORD
_ULID = "'doc_' || " + " || ".join(f"substr('{_DIGITS}', ({{0}} >> {5 * i}) % 32 + 1, 1)" for i in range(9, -1, -1)) + " || '0000000000000000'"


@query(f"SELECT event_id, {_ULID.format(_MS.format('ts'))} AS id, 'doc' AS kind, {_MS.format('ts')} AS ms, true AS valid FROM events")
def ulid_time_decode(spark, d):
    made = rel.sessions(spark, d).select(F.col("id").alias("event_id"), F.concat(F.lit("doc_"), fn.encode_time("created_at"), F.lit("0" * 16)).alias("id"))
    return made.select("event_id", "id", fn.id_kind("id").alias("kind"), fn.id_time("id").alias("ms"), fn.valid_id("id", "doc").alias("valid"))


query("SELECT id, least(5000 * (1::BIGINT << least(greatest(id, 1) - 1, 16)::INTEGER), 600000)::BIGINT AS delay FROM v_users", "backoff_bounds")(lambda s, d: rel.users(s, d).select("id", fn.backoff_ms("id").alias("delay")))
query("SELECT id, printf('%.6f', cost_micros::DOUBLE / 1e6) AS cost FROM v_jobs", "cost_string")(lambda s, d: rel.jobs(s, d).select("id", fn.cost_string("cost_micros").alias("cost")))
query("SELECT id, substr(sha256('salt' || email_folded), 1, 8) AS mark FROM v_users", "account_fingerprint")(lambda s, d: rel.users(s, d).select("id", fn.fingerprint("email_folded", "salt").alias("mark")))
query("SELECT id, least(greatest((id % 9 - 3)::DOUBLE / 4, 0.0), 1.0)::DOUBLE AS progress FROM v_users", "progress_clamp")(lambda s, d: rel.users(s, d).select("id", fn.clamp((F.col("id") % 9 - 3).cast("double") / 4).alias("progress")))
query("SELECT id, state IN ('succeeded', 'failed', 'cancelled') AS done FROM v_jobs", "job_terminal")(lambda s, d: rel.jobs(s, d).select("id", fn.terminal("state").alias("done")))
query("SELECT id, json_extract_string(payload, '$.documentId') AS document, json_extract(payload, '$.page')::INTEGER AS page FROM v_jobs", "job_payload")(
    lambda s, d: rel.jobs(s, d).withColumn("p", F.from_json("payload", "documentId string, page int")).select("id", F.col("p.documentId").alias("document"), F.col("p.page").alias("page"))
)
query(f"SELECT event_id, {_MS.format('ts')} AS ms FROM events", "event_millis")(lambda s, d: rel.scan(s, d, "events").select("event_id", fn.millis("ts").alias("ms")))


@query(
    f"""SELECT id, sha256(unhex('{bytes(0x5C ^ x for x in KEY.ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(0x36 ^ x for x in KEY.ljust(64, bytes(1))).hex()}') || encode(email_folded)))) AS mark
    FROM v_users"""
)
def hmac_index_lookup(spark, d):
    return rel.users(spark, d).select("id", fn.hmac_index("email_folded", KEY).alias("mark"))


@query("SELECT id, email AS opened, NULL::VARCHAR AS tampered FROM v_users")
def gcm_roundtrip(spark, d):
    sealed = rel.users(spark, d).select("id", fn.encrypt("email", KEY).alias("x"))
    return sealed.select("id", fn.decrypt("x", KEY).alias("opened"), fn.decrypt(F.substring("x", 1, 20), KEY).alias("tampered"))


def derived(name: str, table: str, inputs: dict[str, str], columns: Callable[[], dict[str, Column]], oracle: str) -> None:
    """A query over made-up inputs: expressions that both dialects know, then columns of them; the oracle is a select list over the inputs."""
    made, key = ", ".join(f"{e} AS {n}" for n, e in inputs.items()), next(iter(inputs))

    def run(spark, d):
        rows = rel.scan(spark, d, table).selectExpr(*[f"{e} as {n}" for n, e in inputs.items()])
        return rows.select(key, *[c.alias(n) for n, c in columns().items()])

    query(f"SELECT {key}, {oracle} FROM (SELECT {made} FROM {table})", name)(run)


_U = {"id": "c_custkey"}
derived("email_valid", "customer", _U | {"s": "concat(c_name, case c_custkey % 4 when 0 then '@x.example' when 1 then ' @x' when 2 then '@' else '@a@b' end)"}, lambda: {"valid": fn.valid_email("s")}, r"regexp_full_match(s, '[^@\s<>]+@[^@\s<>]+') AS valid")
derived("text_truncated", "documents", {"doc_id": "doc_id", "s": "text"}, lambda: {"part": F.hex(fn.truncate_bytes("s", 512))}, "substr(hex(encode(s)), 1, 1024) AS part")
derived("password_length", "documents", {"doc_id": "doc_id", "s": "substring(text, 1, cast(doc_id % 20 as int))"}, lambda: {"good": fn.long_enough("s")}, "length(s) >= 10 AS good")
_SUBKEY = hmac.digest(hmac.digest(bytes(32), KEY, "sha256"), b"index\x01", "sha256")
_PADS = [bytes(x ^ k for k in _SUBKEY.ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]
derived("subkey_index", "customer", _U | {"s": "c_name"}, lambda: {"mark": fn.hmac_index("s", fn.subkey(KEY, "index"))}, f"sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode(s)))) AS mark")
_TAGS = "concat_ws(',', lang, concat(lang, '-AT'), case doc_id % 5 when 0 then 'hu' when 1 then 'zh-Hant' when 2 then 'bogus-tag' when 3 then 'ro_RO' else 'de-' end, 'JA', 'xx')"
derived(
    "ocr_languages", "documents", {"doc_id": "doc_id", "tags": _TAGS}, lambda: {"codes": F.array_join(fn.ocr_codes(F.split("tags", ",")), ",")},
    """array_to_string(list_filter([CASE split_part(tags, ',', 1) WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' END,
    CASE split_part(tags, ',', 3) WHEN 'hu' THEN 'hun' WHEN 'zh-Hant' THEN 'chi_sim' WHEN 'ro_RO' THEN 'ron' END, 'jpn', CASE WHEN split_part(tags, ',', 1) <> 'en' THEN 'eng' END], lambda x: x IS NOT NULL), ',') AS codes""",
)
derived("tool_version", "orders", {"id": "o_orderkey", "s": "concat('tool v', o_orderkey % 30, case o_orderkey % 3 when 0 then '' when 1 then '.5' else '.07.1.9' end, ' (c) 1.2')"}, lambda: {"version": fn.first_version("s")}, r"regexp_extract(s, '\d+\.\d+(\.\d+)?', 0) AS version")
derived("index_codes", "documents", {"doc_id": "doc_id", "s": "concat(upper(lang), ' ', chr(10), 'PT-BR', chr(10), upper(lang), chr(10), 'No', chr(10), chr(cast(65 + doc_id % 26 as int)), 'X', chr(10), text)"}, lambda: {"codes": F.array_join(tx.index_codes("s"), ",")},
    r"(SELECT string_agg(x, ',' ORDER BY n) FROM (SELECT x, min(n) AS n FROM (SELECT trim(unnest(string_split(s, chr(10)))) AS x, generate_subscripts(string_split(s, chr(10)), 1) AS n) WHERE regexp_full_match(x, '[A-Z]{2}(-[A-Z]{2})?') GROUP BY x)) AS codes")
derived("index_entries", "documents", {"doc_id": "doc_id", "s": "concat(upper(lang), '  Title of it .... ', doc_id % 90)"}, lambda: {"code": tx.index_entries("s")[0]["code"], "title": tx.index_entries("s")[0]["title"], "page": tx.index_entries("s")[0]["page"]}, "upper(substr(s, 1, 2)) AS code, 'Title of it' AS title, split_part(s, '.... ', 2)::INTEGER AS page")
derived("page_count", "orders", {"id": "o_orderkey", "s": "concat('Title: Pages: 7', chr(10), case o_orderkey % 3 when 0 then 'Page' else 'Pages' end, ':    ', o_orderkey % 700, chr(10), 'x')"}, lambda: {"pages": fn.page_count("s")}, "CASE WHEN id % 3 <> 0 THEN (id % 700)::INTEGER END AS pages")
derived("client_address", "events", {"event_id": "event_id", "f": "case event_id % 4 when 0 then '' when 1 then '1.1.1.1, 2.2.2.2 ' when 2 then '3.3.3.3' end", "r": "case event_id % 3 when 0 then '' else '9.9.9.9' end"}, lambda: {"ip": fn.client_ip("f", "r")},
    "coalesce(CASE event_id % 4 WHEN 1 THEN '2.2.2.2' WHEN 2 THEN '3.3.3.3' END, CASE WHEN event_id % 3 <> 0 THEN '9.9.9.9' END) AS ip")
derived("home_redacted", "orders", {"id": "o_orderkey", "s": "concat('/home/a.b', case o_orderkey % 3 when 0 then '' when 1 then '/x' else 'c/x' end)"}, lambda: {"path": fn.redact_home("s", "/home/a.b")}, "CASE id % 3 WHEN 0 THEN '~' WHEN 1 THEN '~/x' ELSE s END AS path")
derived("secret_redacted", "customer", _U | {"s": "case c_custkey % 3 when 0 then '' else c_name end"}, lambda: {"mark": fn.redact("s")}, "CASE WHEN s = '' THEN '' ELSE '********' END AS mark")
derived("same_origin", "orders", {"id": "o_orderkey", "o": "concat('https://H.example', case o_orderkey % 3 when 0 then ':7745' else '' end, '/x')", "h": "concat('h.EXAMPLE', case o_orderkey % 2 when 0 then ':7745' else '' end)"}, lambda: {"same": fn.same_origin("o", "h")}, "(id % 3 = 0) = (id % 2 = 0) AS same")
derived("ordered_set", "documents", {"doc_id": "doc_id", "s": "concat(lang, ',de,de, en ,,', lang, ',uk ')"}, lambda: {"items": F.array_join(fn.ordered_set(F.split("s", ",")), ",")}, "CASE split_part(s, ',', 1) WHEN 'de' THEN 'de,en,uk' WHEN 'en' THEN 'en,de,uk' ELSE split_part(s, ',', 1) || ',de,en,uk' END AS items")
derived("data_route", "orders", {"id": "o_orderkey", "kind": "case o_orderkey % 4 when 0 then 'receipt' when 1 then 'warranty' when 2 then 'manual' else 'serial' end", "w": "case o_orderkey % 3 when 0 then 'local' else 'cloud' end"}, lambda: {"route": fn.data_route("kind", "w")}, "CASE WHEN kind IN ('receipt', 'warranty') THEN 'local' ELSE w END AS route")
derived(
    "list_parameters", "orders", {"id": "o_orderkey", "l": "o_orderkey % 600 - 10", "st": "case o_orderkey % 3 when 0 then 'queued' when 1 then 'nonsense' else 'failed' end"},
    lambda: {"problems": F.array_join(fn.problems(limit=(F.col("l").between(1, 500), "must be 1 to 500"), state=(F.col("st").isin("queued", "running", "succeeded", "failed", "cancelled"), "is unknown")), "; ")},
    "concat_ws('; ', CASE WHEN l NOT BETWEEN 1 AND 500 THEN 'limit: must be 1 to 500' END, CASE WHEN st = 'nonsense' THEN 'state: is unknown' END) AS problems",
)
derived("id_kinds", "events", {"event_id": "event_id", "s": "concat(case event_id % 4 when 0 then 'doc' when 1 then 'DOC' when 2 then 'job' else '' end, '_', case event_id % 3 when 0 then '01HZZZZZZZ' when 1 then '01hzzzzzzz' else '81HZZZZZZZ' end, '0000000000000000')"},
    lambda: {"kind": fn.id_kind("s"), "valid": fn.valid_id("s", "doc")}, "split_part(s, '_', 1) AS kind, event_id % 4 = 0 AND event_id % 3 <> 2 AS valid")
derived("time_of_millis", "orders", {"id": "o_orderkey", "ms": "cast(o_orderkey as bigint) * 1000003"}, lambda: {"seconds": F.unix_seconds(fn.time("ms")), "millis": fn.millis(fn.time("ms"))}, "ms // 1000 AS seconds, ms AS millis")
derived("payload_json", "orders", {"id": "o_orderkey", "c": "o_custkey", "p": "cast(o_orderkey % 100 as int)"}, lambda: {"payload": fn.payload(F.struct(F.concat(F.lit("doc_"), "c").alias("documentId"), F.col("p").alias("page")))}, """'{"documentId":"doc_' || c || '","page":' || p || '}' AS payload""")
derived("retry_delays", "orders", {"id": "o_orderkey", "n": "o_orderkey % 14 - 3"}, lambda: {"delay": fn.retry_delay_ms("n", "id"), "jitter_ok": (fn.jitter_ms(fn.backoff_ms("n"), "id") < fn.backoff_ms("n") / 4) & (fn.jitter_ms(fn.backoff_ms("n"), "id") >= 0)}, _RETRY.format("n", "id") + " AS delay, true AS jitter_ok")
query("SELECT p_partkey, p_name FROM part", "redacted_export")(lambda s, d: documents.redacted_export(rel.scan(s, d, "part").selectExpr("p_partkey", "p_name", "p_retailprice as price", "p_brand as serial")))


@query("""SELECT id, page <> 13 AS ok, CASE WHEN page = 13 THEN 'ValueError: page 13' WHEN kind = 'extract' THEN 'KeyError: ' || chr(39) || 'extract' || chr(39) END AS error FROM (SELECT id, kind, id % 100 AS page FROM v_jobs) WHERE kind <> 'extract'
    UNION ALL SELECT id, false, 'KeyError: ' || chr(39) || 'extract' || chr(39) FROM v_jobs WHERE kind = 'extract'""")
def handlers_isolated(spark, d):
    """Handlers of two kinds; one fails on some payloads, and one kind has none."""

    def work(payload: str) -> None:
        page = json.loads(payload)["page"]
        if page == 13:
            raise ValueError(f"page {page}")

    return jobs.run_handlers(rel.jobs(spark, d), {"convert": work, "translate": work})

# Text and documents

query("SELECT DISTINCT doc_id FROM v_tokens WHERE token = 'und'", "search_term")(lambda s, d: tx.search_term(rel.scan(s, d, "documents"), "doc_id", "text", "und"))
query("SELECT DISTINCT doc_id FROM v_tokens WHERE token LIKE 'on%'", "search_prefix")(lambda s, d: tx.search_prefix(rel.scan(s, d, "documents"), "doc_id", "text", "on"))
query("SELECT DISTINCT doc_id FROM v_tokens WHERE token IN ('für', 'ción', 'éque')", "search_diacritics")(
    lambda s, d: tx.search_term(rel.scan(s, d, "documents"), "doc_id", "text", "FÜR").union(tx.search_term(rel.scan(s, d, "documents"), "doc_id", "text", "ción")).union(tx.search_term(rel.scan(s, d, "documents"), "doc_id", "text", "Éque")).distinct()
)
query("SELECT token, count(DISTINCT doc_id)::BIGINT AS df FROM v_tokens GROUP BY token", "token_df")(lambda s, d: tx.document_frequency(rel.scan(s, d, "documents"), "text"))
query("SELECT doc_id, token, count(*)::BIGINT AS n FROM v_tokens GROUP BY ALL", "token_postings")(lambda s, d: tx.postings(rel.scan(s, d, "documents"), "doc_id", "text"))
query(
    "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '\\p{{{x}}}'))::BIGINT AS {x.lower()}" for x in tx.SCRIPTS) + " FROM documents", "script_profile"
)(lambda s, d: rel.scan(s, d, "documents").select("doc_id", *[c.alias(n) for n, c in tx.script_counts("text").items()]))
_COUNTED = "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '\\p{{{x}}}')) AS {x.lower()}" for x in tx.SCRIPTS) + f", greatest({', '.join(x.lower() for x in tx.SCRIPTS)}) AS best FROM documents"
query(f"SELECT doc_id, CASE WHEN best > 0 THEN CASE best {' '.join(f'WHEN {x.lower()} THEN {x!r}' for x in tx.SCRIPTS)} END END AS script FROM ({_COUNTED})", "main_script")(lambda s, d: rel.scan(s, d, "documents").select("doc_id", tx.main_script("text").alias("script")))
_SCORES = ", ".join(f"count(*) FILTER (token IN ({', '.join(repr(w) for w in words)}))::BIGINT AS {lang}" for lang, words in tx.FUNCTION_WORDS.items())
query(
    f"""SELECT doc_id, CASE WHEN score > 0 THEN CASE score WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END END AS guess, score
    FROM (SELECT *, greatest(en, de, fr, es) AS score FROM (SELECT d.doc_id, {_SCORES} FROM documents d LEFT JOIN v_tokens t ON t.doc_id = d.doc_id GROUP BY d.doc_id))""",
    "language_guess",
)(lambda s, d: tx.guess_language(rel.scan(s, d, "documents"), "text").select("doc_id", "guess", "score"))
query(
    """SELECT source, run, lang, min(doc_id) AS first_page, max(doc_id) AS last_page, count(*)::BIGINT AS pages FROM (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS run
    FROM (SELECT *, CASE WHEN lang = lag(lang) OVER (PARTITION BY source ORDER BY doc_id) THEN 0 ELSE 1 END AS b FROM documents)) GROUP BY ALL""",
    "language_runs",
)(lambda s, d: documents.language_runs(rel.pages(s, d), "source"))
query("SELECT lang, count(*)::BIGINT AS pages, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS share FROM documents WHERE lang IN ('de', 'en') GROUP BY lang", "scope_languages")(lambda s, d: documents.scope(rel.pages(s, d), ["de", "en"]))
query(
    """SELECT source, count(*)::BIGINT AS pages, floor(median(length(text)))::BIGINT AS median_chars, floor(median(length(text))) >= 200 AS has_text, count(*) <= 64 AS automatic FROM documents GROUP BY source""",
    "text_layer_probe",
)(lambda s, d: documents.text_layer(rel.pages(s, d), "source"))
query(
    """SELECT document, code, 'length' AS problem FROM v_checked WHERE pages <> pdf_end - pdf_start + 1 UNION ALL SELECT document, code, 'range' FROM v_checked WHERE pdf_start < 1 OR pdf_end > 700 OR pdf_end < pdf_start
    UNION ALL SELECT document, code, 'gap' FROM v_checked WHERE pdf_start > before + 1 UNION ALL SELECT document, code, 'overlap' FROM v_checked WHERE pdf_start <= before UNION ALL SELECT document, code, 'duplicate' FROM v_checked WHERE same > 1""",
    "section_gaps",
)(lambda s, d: documents.section_problems(rel.sections(s, d).selectExpr("document", "if(pdf_start % 7 = 0, 'S', code) as code", "pdf_start - 6 + pdf_start % 3 as pdf_start", "pdf_end - 6 as pdf_end", "pages"), 700, "document"))


@query("SELECT document AS name, code, pdf_start::INTEGER AS pdf_start, pages::INTEGER AS pages FROM v_sections")
def manifest_sections(spark, d):
    """Manifests written as JSON, one object a file, and read again."""
    found = rel.sections(spark, d).groupBy(F.col("document").alias("name")).agg(F.sum("pages").alias("pages"), F.collect_list(F.struct("code", "pdf_start", "pdf_end", "pages")).alias("sections"))
    path = f"{_scratch(spark)}/manifests-{uuid.uuid4().hex}"
    found.write.option("maxRecordsPerFile", 1).json(path)
    return files.manifest_sections(files.manifests(spark, path)).select("name", "code", "pdf_start", "pages")


query("SELECT d.doc_id AS page, s.code FROM documents d LEFT JOIN v_sections s ON d.doc_id BETWEEN s.pdf_start AND s.pdf_end", "page_section_join")(
    lambda s, d: documents.page_sections(rel.pages(s, d).select("page"), rel.sections(s, d))
)
query("""SELECT document, code, pdf_start - printed_page AS "offset", (pdf_start - printed_page) - lag(pdf_start - printed_page) OVER (PARTITION BY document ORDER BY pdf_start) AS drift FROM v_sections""", "index_drift")(lambda s, d: documents.index_drift(rel.sections(s, d), "document"))


@query("""SELECT coalesce(i.code, t.code) AS code, coalesce(t.start, i.start) AS start, CASE WHEN i.start IS NULL THEN 'detected' WHEN t.start IS NULL THEN 'index' WHEN i.start = t.start THEN 'both' ELSE 'detected' END AS source,
    coalesce(i.start <> t.start, false) AS conflict FROM (SELECT code || CASE pdf_start % 3 WHEN 0 THEN 'i' ELSE '' END AS code, printed_page + 6 AS start FROM v_sections) i
    FULL JOIN (SELECT code || CASE pdf_start % 4 WHEN 0 THEN 'd' ELSE '' END AS code, pdf_start AS start FROM v_sections) t ON t.code = i.code""")
def section_reconcile(spark, d):
    """Every section by index and by detection, under another code where it is found one way only."""
    found = rel.sections(spark, d)
    return documents.reconcile(found.selectExpr("concat(code, if(pdf_start % 3 = 0, 'i', '')) as code", "printed_page + 6 as start"), found.selectExpr("concat(code, if(pdf_start % 4 = 0, 'd', '')) as code", "pdf_start as start"))


query("SELECT count(*)::BIGINT AS calls, (sum(pages * 550) + count(*) * 32000)::BIGINT AS tokens FROM v_sections", "batch_cost")(lambda s, d: documents.batch_cost(rel.sections(s, d).withColumn("tokens", F.col("pages") * 550)))


@query("""SELECT rule, count(*)::BIGINT AS n FROM (
    SELECT 'jobs.attempts' AS rule FROM v_jobs WHERE attempts > max_attempts UNION ALL
    SELECT 'jobs.dedupe_key' FROM (SELECT dedupe_key FROM v_jobs WHERE state IN ('queued', 'running') AND dedupe_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL
    SELECT 'sessions.user_id' FROM v_sessions WHERE user_id NOT IN (SELECT id FROM v_users) UNION ALL
    SELECT 'blobs.sha256' FROM (SELECT sha256 FROM v_puts GROUP BY 1 HAVING count(*) > 1)) GROUP BY rule""")
def constraint_violations(spark, d):
    return validate.violations(rel.users(spark, d), rel.sessions(spark, d), rel.blob_puts(spark, d), rel.jobs(spark, d))


# Streams, run to the end of their files

def _scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, else that of ``setCheckpointDir``; one of our own only in local mode (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = set_dir.get() if set_dir.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="larkstead-")
    return shared.rstrip("/")


def _event_stream(spark, d) -> DataFrame:
    found = spark.readStream.schema(rel.scan(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    return found.withColumn("ms", rel.millis("ts")).select("user_id", "event_type", "ms", "event_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(epoch_us(ts)//1000, (ts, event_id)) AS ms FROM events GROUP BY user_id")
def stream_latest_state(spark, d):
    return stream.drained(stream.latest(_event_stream(spark, d), "user_id", ["ms", "event_id"], ["event_type", "ms"]), "complete", _scratch(spark))


@query("""SELECT user_id, arg_max(event_type, (ms, event_id)) AS event_type, max(ms) AS ms FROM (SELECT user_id, event_type, epoch_us(ts)//1000 AS ms, event_id FROM events
    UNION ALL SELECT o_custkey, 'snapshot', 0, o_orderkey FROM orders) GROUP BY user_id""")
def stream_snapshot_union(spark, d):
    orders = spark.readStream.schema(rel.scan(spark, d, "orders").schema).option("pathGlobFilter", "orders*.parquet").parquet(d)
    before = orders.selectExpr("o_custkey as user_id", "'snapshot' as event_type", "0L as ms", "o_orderkey as event_id")
    return stream.drained(stream.latest(stream.snapshot_then_live(before, _event_stream(spark, d)), "user_id", ["ms", "event_id"], ["event_type", "ms"]), "complete", _scratch(spark))


@query(f"SELECT id, 'queued' AS state, '{jobs.RECLAIMED}' AS last_error FROM v_jobs WHERE {_LAPSED}")
def stream_lease_expiry(spark, d):
    orders = spark.readStream.schema(rel.scan(spark, d, "orders").schema).option("pathGlobFilter", "orders*.parquet").parquet(d)
    running = orders.where("o_orderstatus = 'P'").withColumn("ms", rel.millis("o_orderdate")).selectExpr("o_orderkey as id", "'running' as state", "ms + 900000 as lease_until")
    return stream.drained(stream.lapsed(running, NOW_JOBS), "append", _scratch(spark))


@query("SELECT * EXCLUDE (rn) FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 32")
def broker_buffer(spark, d):
    return stream.buffered(rel.scan(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id")


@query("""SELECT 'event: job' || chr(10) || 'data: ' || '{"id":' || id || ',"state":"' || state || '"}' || chr(10) || chr(10) AS frame FROM v_jobs WHERE state IN ('queued', 'running')""")
def event_frames(spark, d):
    return stream.frames(jobs.active(rel.jobs(spark, d)).select("id", "state"))
