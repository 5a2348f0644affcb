"""Users and sliding sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fold_email
from ..schemas import SESSION_MS, TOUCH_MS
from .snapshot import affected, delete, insert_new, inserted, update


def authenticate(sessions: DataFrame, users: DataFrame, token_hash: Column, now: int) -> DataFrame:
    """(session, user) structs of live sessions with that token hash; the filter comes before the join."""
    live = sessions.where((F.col("token_hash") == token_hash) & (F.col("expires_at") > now)) if token_hash is not None else sessions.where(F.col("expires_at") > now)
    s, u = live.alias("s"), users.alias("u")
    return s.join(u, F.col("s.user_id") == F.col("u.id")).select(F.struct("s.*").alias("session"), F.struct("u.*").alias("user"))


def created_sessions(new: DataFrame, users: DataFrame) -> DataFrame:
    """The new sessions of known users: those that are inserted."""
    return new.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi").select(*new.columns)


def create_session(sessions: DataFrame, new: DataFrame, users: DataFrame) -> DataFrame:
    """sessions and the new ones of known users."""
    return sessions.unionByName(created_sessions(new, users))


def touch_session(sessions: DataFrame, ids: Column, now: int) -> DataFrame:
    return update(sessions, ids, {"last_seen_at": F.lit(now)})


def extend_session(sessions: DataFrame, ids: Column, now: int) -> DataFrame:
    """Sliding expiry, at most once a day."""
    return update(sessions, ids & (F.lit(now) - F.col("last_seen_at") > TOUCH_MS), {"last_seen_at": F.lit(now), "expires_at": F.lit(now + SESSION_MS)})


def delete_sessions(sessions: DataFrame, condition: Column) -> DataFrame:
    return delete(sessions, condition)


def sweep_sessions(sessions: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Expired sessions go: the complement of what authenticates; and how many."""
    return delete(sessions, F.col("expires_at") <= now), affected(sessions, F.col("expires_at") <= now)


def list_sessions(sessions: DataFrame, user_id: int) -> DataFrame:
    return sessions.where(F.col("user_id") == user_id).orderBy(F.col("last_seen_at").desc(), "id")


def public_user(users: DataFrame) -> DataFrame:
    """Never the password hash, nor the folded address."""
    return users.select("id", "email", "display_name", "role", "created_at", "last_login_at")


def public_session(sessions: DataFrame) -> DataFrame:
    return sessions.select("id", "user_id", "created_at", "last_seen_at", "expires_at")


def created_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """The new users whose folded address is free; of several with one address, that of the smallest id."""
    return inserted(users, new, "email_folded", ["id"])


def create_user(users: DataFrame, new: DataFrame) -> DataFrame:
    """users and the new ones that are created."""
    return insert_new(users, new, "email_folded", ["id"])


def public_wraps(wraps: DataFrame) -> DataFrame:
    """Ways to unlock a keyring, without secret material: ciphertext and salt are blank."""
    return wraps.withColumns({"ciphertext": F.lit(""), "salt": F.lit("")})


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.col("email_folded") == fold_email(F.lit(email)))


def user_by_id(users: DataFrame, user_id: int) -> DataFrame:
    return users.where(F.col("id") == user_id)


def count_users(users: DataFrame) -> DataFrame:
    return users.agg(F.count(F.lit(1)).alias("count"))


def list_users(users: DataFrame) -> DataFrame:
    return users.orderBy("created_at", "id")


def touch_login(users: DataFrame, ids: Column, now: int) -> DataFrame:
    return update(users, ids, {"last_login_at": F.lit(now), "updated_at": F.lit(now)})


def change_password(users: DataFrame, sessions: DataFrame, user_id: int, password_hash: str, now: int) -> tuple[DataFrame, DataFrame]:
    """One change of both: the new hash, and all of the user's sessions gone."""
    return update(users, F.col("id") == user_id, {"password_hash": F.lit(password_hash), "updated_at": F.lit(now)}), delete(sessions, F.col("user_id") == user_id)


def delete_user(users: DataFrame, sessions: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Users go, and with them their sessions."""
    left = delete(users, condition)
    return left, sessions.join(left.select(F.col("id").alias("user_id")), "user_id", "left_semi").select(*sessions.columns)
