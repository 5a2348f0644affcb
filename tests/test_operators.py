"""Edge cases of the snapshot operators: empty tables, nulls, ties, boundaries."""

import pytest
from pyspark.sql import functions as F

from larkstead import schemas
from larkstead.operators import accounts, content, documents, jobs, validate

NOW = 1_000_000


def job(i, state="queued", **more):
    row = dict(id=i, kind="convert", payload="{}", state=state, priority=0, progress=0.0, progress_note="", attempts=0, max_attempts=3, last_error="", tokens_in=0, tokens_out=0, cost_micros=0,
               run_after=0, lease_until=None, worker="", dedupe_key=None, created_at=0, updated_at=0, started_at=None, finished_at=None)
    return row | more


def table(spark, rows, schema=schemas.JOBS):
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def one(df, i):
    return df.where(F.col("id") == i).first()


def test_empty_queue(spark):
    none = table(spark, [])
    assert jobs.claim_next(none, "w", NOW).count() == 0
    assert jobs.claim_k(none, ["a", "b"], NOW).count() == 0
    assert jobs.count_by_state(none).collect() == []
    assert jobs.reclaim(none, NOW)[1].first()[0] == 0


def test_claim_order_boundary_and_ties(spark):
    q = table(spark, [job(3, priority=1), job(2, priority=1), job(1), job(4, priority=9, run_after=NOW + 1), job(5, priority=5, run_after=NOW), job(6, "running", priority=99)])
    assert jobs.claim_next(q, "w", NOW).first()["id"] == 5
    dealt = jobs.claim_k(q, ["a", "b", "c", "d", "e", "f"], NOW).collect()
    assert sorted((r["worker"], r["id"]) for r in dealt) == [("a", 5), ("b", 2), ("c", 3), ("d", 1)]
    assert {r["attempts"] for r in dealt} == {1} and {r["started_at"] for r in dealt} == {NOW}
    assert jobs.applied(q, jobs.claim_k(q, ["a"], NOW)).count() == 6


def test_first_start_is_kept(spark):
    assert jobs.claim_next(table(spark, [job(1, started_at=7)]), "w", NOW).first()["started_at"] == 7


def test_reclaim_needs_a_lapsed_lease(spark):
    q = table(spark, [job(1, "running", lease_until=NOW - 1, attempts=2), job(2, "running", lease_until=NOW), job(3, "running")])
    after, n = jobs.reclaim(q, NOW)
    assert n.first()[0] == 1
    assert one(after, 1)["state"] == "queued" and one(after, 1)["attempts"] == 2
    assert one(after, 2)["state"] == one(after, 3)["state"] == "running"


def test_purge_keeps_unknown_finish(spark):
    q = table(spark, [job(1, "failed"), job(2, "failed", finished_at=NOW - 1), job(3, "failed", finished_at=NOW), job(4, "queued", finished_at=1)])
    assert {r["id"] for r in jobs.purge(q, NOW)[0].collect()} == {1, 3, 4}


def test_release_never_goes_below_zero(spark):
    q = table(spark, [job(1, "running"), job(2, "running", attempts=2), job(3, "succeeded", attempts=2)])
    after = jobs.release(q, F.lit(True), NOW)
    assert [one(after, i)["attempts"] for i in (1, 2, 3)] == [0, 1, 2]


def test_cancelled_job_can_be_completed(spark):
    """Completion has no state guard: the statement is the specification."""
    after = jobs.complete(jobs.cancel(table(spark, [job(1, "running")]), F.lit(True), NOW)[0], F.lit(True), "x", NOW)
    assert one(after, 1)["state"] == "succeeded"


def test_progress_is_clamped_and_guarded(spark):
    q = table(spark, [job(1, "running"), job(2)])
    assert one(jobs.progress(q, F.lit(True), 42.0, "n", NOW), 1)["progress"] == 1.0
    assert one(jobs.progress(q, F.lit(True), -1.0, "n", NOW), 1)["progress"] == 0.0
    assert one(jobs.progress(q, F.lit(True), 0.5, "n", NOW), 2)["progress"] == 0.0


def test_enqueue_dedupes_while_pending_only(spark):
    q = table(spark, [job(1, dedupe_key="a"), job(2, "succeeded", dedupe_key="b")])
    new = table(spark, [job(10, dedupe_key="a"), job(11, dedupe_key="b"), job(12, dedupe_key="b"), job(13), job(14)])
    after, rejected = jobs.enqueue(q, new)
    assert {r["id"] for r in after.collect()} == {1, 2, 11, 13, 14}
    assert {(r["id"], r["holder"]) for r in rejected.collect()} == {(10, 1), (12, 11)}


def test_usage_adds_up(spark):
    q = table(spark, [job(1), job(2)])
    deltas = spark.createDataFrame([(1, 1000, 500, 4200), (1, 200, 100, 800), (9, 1, 1, 1)], "job_id long, tokens_in long, tokens_out long, cost_micros long")
    after = jobs.record_usage(q, deltas)
    assert one(after, 1)["tokens_in"] == 1200 and one(after, 1)["tokens_out"] == 600 and one(after, 1)["cost_micros"] == 5000
    assert one(after, 2)["tokens_in"] == 0 and after.columns == q.columns


def test_limits_and_states_are_checked(spark):
    q = table(spark, [job(1)])
    for limit in (501, "abc"):
        with pytest.raises(ValueError):
            jobs.recent(q, limit)
    for limit in (0, -1, 501, "abc"):
        with pytest.raises(ValueError):
            jobs.check_limit(limit)
    many = table(spark, [job(i) for i in range(60)])
    assert jobs.recent(many, 0).count() == jobs.recent(many, -3).count() == 50
    with pytest.raises(ValueError):
        jobs.recent(q, 5, "nonsense")


def test_public_hides_columns(spark):
    assert not {"lease_until", "worker", "run_after", "dedupe_key"} & set(jobs.public(table(spark, [])).columns)
    users = spark.createDataFrame([], schemas.USERS)
    assert not {"password_hash", "email_folded"} & set(accounts.public_user(users).columns)
    sessions = spark.createDataFrame([], schemas.SESSIONS)
    assert not {"token_hash", "ip", "user_agent"} & set(accounts.public_session(sessions).columns)


def test_handlers_are_isolated(spark):
    def explode(payload):
        raise RuntimeError("boom")

    out = jobs.run_handlers(table(spark, [job(1), job(2, kind="explodes"), job(3, kind="unknown")]), {"convert": lambda p: None, "explodes": explode})
    found = {r["id"]: (r["ok"], r["error"]) for r in out.collect()}
    assert found[1] == (True, None) and found[2] == (False, "RuntimeError: boom") and found[3][0] is False


def test_session_expiry_boundary(spark):
    s = spark.createDataFrame([(1, 1, b"a", "", "", 0, 0, NOW), (2, 1, b"a", "", "", 0, 0, NOW + 1)], schemas.SESSIONS)
    u = spark.createDataFrame([(1, "a", "a", "", "", "admin", 0, 0, None)], schemas.USERS)
    assert [r["session"]["id"] for r in accounts.authenticate(s, u, F.lit(b"a"), NOW).collect()] == [2]
    kept, n = accounts.sweep_sessions(s, NOW)
    assert [r["id"] for r in kept.collect()] == [2] and n.first()[0] == 1


def test_user_delete_cascades(spark):
    s = spark.createDataFrame([(1, 1, b"a", "", "", 0, 0, 0), (2, 2, b"b", "", "", 0, 0, 0)], schemas.SESSIONS)
    u = spark.createDataFrame([(i, str(i), str(i), "", "", "admin", 0, 0, None) for i in (1, 2)], schemas.USERS)
    users, sessions = accounts.delete_user(u, s, F.col("id") == 1)
    assert [r["id"] for r in users.collect()] == [2] and [r["id"] for r in sessions.collect()] == [2]
    assert sessions.columns == s.columns


def test_folded_address_is_unique(spark):
    u = spark.createDataFrame([(1, "A@x", "a@x", "", "", "admin", 0, 0, None)], schemas.USERS)
    new = spark.createDataFrame([(2, "a@X", "a@x", "", "", "admin", 0, 0, None), (3, "b@x", "b@x", "", "", "admin", 0, 0, None)], schemas.USERS)
    assert {r["id"] for r in accounts.create_user(u, new).collect()} == {1, 3}
    twice = new.union(new.withColumn("id", F.col("id") + 10)).repartition(3)
    assert {r["id"] for r in accounts.create_user(u, twice).collect()} == {1, 3}
    assert [r["id"] for r in accounts.created_users(u, twice).collect()] == [3]


def test_new_blobs_of_one_digest_count_once(spark):
    old = spark.createDataFrame([("a", 1, "x", 5)], schemas.BLOBS)
    new = spark.createDataFrame([("a", 1, "y", 6), ("b", 2, "late", 9), ("b", 2, "first", 7)], schemas.BLOBS)
    assert {(r["sha256"], r["media_type"]) for r in content.upsert_blob(old, new).collect()} == {("a", "x"), ("b", "first")}


def test_lists_are_in_order(spark):
    q = table(spark, [job(1, priority=1, created_at=5), job(2, priority=9), job(3, priority=1, created_at=4), job(4, priority=9)])
    assert [r["id"] for r in jobs.active(q).collect()] == [2, 4, 3, 1]
    s = spark.createDataFrame([(1, 7, b"a", "", "", 0, 3, 0), (2, 7, b"b", "", "", 0, 9, 0), (3, 7, b"c", "", "", 0, 9, 0)], schemas.SESSIONS)
    assert [r["id"] for r in accounts.list_sessions(s, 7).collect()] == [2, 3, 1]
    u = spark.createDataFrame([(i, str(i), str(i), "", "", "admin", c, 0, None) for i, c in ((1, 9), (3, 2), (2, 2))], schemas.USERS)
    assert [r["id"] for r in accounts.list_users(u).collect()] == [2, 3, 1]
    k = spark.createDataFrame([("b", "1", 0), ("a", "2", 0)], schemas.SETTINGS)
    assert [r["key"] for r in content.list_settings(k).collect()] == ["a", "b"]


def test_relations_are_checked_against_their_schema(spark):
    users = spark.createDataFrame([(1, "A@x", "a@x", "", "", "admin", 0, 0, None), (2, "B@x", None, "", "", "admin", 0, 0, None)], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.USERS))
    assert [tuple(r) for r in validate.null_counts({"users": users}).collect()] == [("users", 2, 1)]
    for wrong in (users.drop("role"), users.withColumn("id", F.lit("x"))):
        with pytest.raises(ValueError):
            schemas.conform(wrong, "users")


def test_empty_blobs_total_zero(spark):
    assert content.total_bytes(spark.createDataFrame([], schemas.BLOBS)).first()[0] == 0


def test_settings_last_writer_and_blobs_first_writer(spark):
    log = spark.createDataFrame([("k", "first", 5, 1), ("k", "second", 5, 2)], "key string, value string, updated_at long, seq long")
    assert content.set_settings(log).collect() == [("k", "second", 5)]
    puts = spark.createDataFrame([("d", 1, "a", 1, 2), ("d", 1, "b", 1, 1)], "sha256 string, size_bytes long, media_type string, created_at long, seq long")
    assert content.put_blobs(puts).first()["media_type"] == "b"


def test_sections(spark):
    rows = [("x", "A", 7, 10, 4), ("x", "B", 12, 14, 2), ("x", "B", 14, 30, 17), ("y", "A", 1, 10, 10), ("z", "A", 0, 10, 11)]
    s = spark.createDataFrame(rows, "doc string, code string, pdf_start long, pdf_end long, pages long")
    found = {tuple(r) for r in documents.section_problems(s, 20, "doc").collect()}
    assert found == {("x", "B", "gap"), ("x", "B", "length"), ("x", "B", "overlap"), ("x", "B", "range"), ("x", "B", "duplicate"), ("z", "A", "range")}
    s = s.where("doc = 'x'")
    pages = spark.range(5, 9).select(F.col("id").alias("page"))
    assert {tuple(r) for r in documents.page_sections(pages, s).collect()} == {(5, None), (6, None), (7, "A"), (8, "A")}
    assert {tuple(r) for r in documents.page_sections(pages, s, most=0).collect()} == {(5, None), (6, None), (7, "A"), (8, "A")}


def test_violations(spark):
    u = spark.createDataFrame([(1, "a", "a", "", "", "boss", 0, 0, None), (2, "b", "a", "", "", "admin", 0, 0, None)], schemas.USERS)
    s = spark.createDataFrame([(1, 9, b"a", "", "", 0, 0, 0)], schemas.SESSIONS)
    b = spark.createDataFrame([("x", -1, "", 0)], schemas.BLOBS)
    j = table(spark, [job(1, "odd", progress=2.0), job(2, dedupe_key="k"), job(3, dedupe_key="k"), job(4, attempts=4)])
    found = {r["rule"]: r["n"] for r in validate.violations(u, s, b, j).collect()}
    assert found == {"users.role": 1, "users.email_folded": 1, "sessions.user_id": 1, "blobs.size_bytes": 1, "jobs.state": 1, "jobs.progress": 1, "jobs.attempts": 1, "jobs.dedupe_key": 1}
