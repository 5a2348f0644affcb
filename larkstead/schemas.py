"""The data model: five relations, their column types, defaults and constraints."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    """'name:type name:type?' with ? for nullable columns."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds[t.rstrip("?")], t.endswith("?")) for n, t in (x.split(":") for x in text.split())])


USERS = _schema("id:long email:string email_folded:string display_name:string password_hash:string role:string created_at:long updated_at:long last_login_at:long?")
SESSIONS = _schema("id:long user_id:long token_hash:binary user_agent:string ip:string created_at:long last_seen_at:long expires_at:long")
SETTINGS = _schema("key:string value:string updated_at:long")
BLOBS = _schema("sha256:string size_bytes:long media_type:string created_at:long")
JOBS = _schema(
    "id:long kind:string payload:string state:string priority:long progress:double progress_note:string attempts:long max_attempts:long last_error:string "
    "tokens_in:long tokens_out:long cost_micros:long run_after:long lease_until:long? worker:string dedupe_key:string? created_at:long updated_at:long started_at:long? finished_at:long?"
)
EVENTS = _schema("job_id:string kind:string state:string progress:double note:string? error:string? at:long")

ROLES = ("admin", "member", "viewer")
STATES = ("queued", "running", "succeeded", "failed", "cancelled")
PENDING = ("queued", "running")
TERMINAL = ("succeeded", "failed", "cancelled")
MAX_ATTEMPTS = 3
LIST_DEFAULT, LIST_MOST = 50, 500
SESSION_MS, TOUCH_MS = 7 * 86_400_000, 86_400_000
LEASE_MS = 900_000

RELATIONS = {"users": USERS, "sessions": SESSIONS, "settings": SETTINGS, "blobs": BLOBS, "jobs": JOBS}


def conform(rows, relation: str):
    """rows with the columns of a relation, in its order and types; raises where a column is missing or of another kind."""
    schema = RELATIONS[relation]
    if missing := [f.name for f in schema if f.name not in rows.columns]:
        raise ValueError(f"{relation} lacks {', '.join(missing)}")
    wrong = [f.name for f in schema if isinstance(f.dataType, T.NumericType) != isinstance(rows.schema[f.name].dataType, T.NumericType) or isinstance(f.dataType, T.BinaryType) != isinstance(rows.schema[f.name].dataType, T.BinaryType)]
    if wrong:
        raise ValueError(f"{relation} has other types in {', '.join(wrong)}")
    return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schema])
