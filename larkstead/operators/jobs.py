"""The leased priority work queue as reads and snapshot transitions. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..schemas import LEASE_MS, LIST_DEFAULT, LIST_MOST, PENDING, STATES
from .snapshot import affected, delete, update

# Messages that clients compare.
RECLAIMED = "worker lease expired; job reclaimed"
NO_HANDLER = "no handler registered for job kind "


def check_limit(limit: int) -> int:
    if not isinstance(limit, int) or not 1 <= limit <= LIST_MOST:
        raise ValueError(f"limit must be 1 to {LIST_MOST}")
    return limit


def check_state(state: str) -> str:
    if state not in STATES:
        raise ValueError(f"unknown state {state!r}")
    return state


def get(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.where(F.col("id") == job_id)


def pending_by_key(jobs: DataFrame, key: str) -> DataFrame:
    """The pending job that holds a dedupe key (the smallest id, should there be several)."""
    return jobs.where((F.col("dedupe_key") == key) & F.col("state").isin(*PENDING)).orderBy("id").limit(1)


def recent(jobs: DataFrame, limit: int = LIST_DEFAULT, state: str | None = None) -> DataFrame:
    """The newest jobs, of one state if given; the id decides between equal times.

    A limit of 0 or less means the default. ``check_limit`` is the stricter rule for clients' input.
    """
    chosen = jobs if state is None else jobs.where(F.col("state") == check_state(state))
    return chosen.orderBy(F.col("created_at").desc(), "id").limit(LIST_DEFAULT if isinstance(limit, int) and limit <= 0 else check_limit(limit))


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("state").isin(*PENDING)).orderBy(F.col("priority").desc(), "created_at", "id")


def count_by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count(F.lit(1)).alias("count"))


def public(jobs: DataFrame) -> DataFrame:
    """What a client may see: lease, worker, schedule and dedupe key stay inside."""
    return jobs.drop("lease_until", "worker", "run_after", "dedupe_key")


def runnable(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.where((F.col("state") == "queued") & (F.col("run_after") <= now))


def claim_next(jobs: DataFrame, worker: str, now: int, lease_ms: int = LEASE_MS) -> DataFrame:
    """The claimed job as it is after the claim; no row if nothing is runnable."""
    top = runnable(jobs, now).orderBy(F.col("priority").desc(), "id").limit(1)
    return _claimed(top, F.lit(worker), now, lease_ms)


def claim_k(jobs: DataFrame, workers: list[str], now: int, lease_ms: int = LEASE_MS) -> DataFrame:
    """One job for each worker, as successive claims would deal them: the top ones, in order."""
    top = runnable(jobs, now).orderBy(F.col("priority").desc(), "id").limit(len(workers))
    place = F.row_number().over(W.Window.orderBy(F.col("priority").desc(), "id"))
    dealt = top.withColumn("_place", place)
    return _claimed(dealt, F.element_at(F.array(*map(F.lit, workers)), F.col("_place").cast("int")), now, lease_ms).drop("_place")


def _claimed(top: DataFrame, worker, now: int, lease_ms: int) -> DataFrame:
    return update(top, "true", {"state": F.lit("running"), "worker": worker, "lease_until": F.lit(now + lease_ms), "attempts": "attempts + 1", "started_at": F.coalesce("started_at", F.lit(now)), "updated_at": F.lit(now)})


def applied(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """The snapshot with changed rows in place of those of the same id."""
    return jobs.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def _judged(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """new with the id that holds each one's key, if another does. Only jobs with a key are joined."""
    pending = jobs.where(F.col("state").isin(*PENDING) & F.col("dedupe_key").isNotNull()).groupBy("dedupe_key").agg(F.min("id").alias("_pending"))
    keyed = new.where(F.col("dedupe_key").isNotNull())
    first = keyed.groupBy("dedupe_key").agg(F.min("id").alias("_first"))
    placed = keyed.join(first, "dedupe_key").join(pending, "dedupe_key", "left")
    holder = F.coalesce("_pending", "_first")
    judged = placed.withColumn("holder", F.when(holder != F.col("id"), holder)).select(*new.columns, "holder")
    return judged.unionByName(new.where(F.col("dedupe_key").isNull()).withColumn("holder", F.lit(None).cast(new.schema["id"].dataType)))


def accepted(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The new jobs that get into the queue.

    A key is taken while a pending job has it; null keys never collide. Of new jobs with one key the
    smallest id is accepted.
    """
    return _judged(jobs, new).where("holder is null").select(*jobs.columns)


def rejected(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """(id, dedupe_key, holder) of new jobs whose key is taken."""
    return _judged(jobs, new).where("holder is not null").select("id", "dedupe_key", "holder")


def enqueue(jobs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot with the accepted jobs, rejected jobs and the id that holds their key)."""
    return jobs.unionByName(accepted(jobs, new)), rejected(jobs, new)


def progress(jobs: DataFrame, ids, fraction: float, note: str, now: int) -> DataFrame:
    return update(jobs, ids & (F.col("state") == "running"), {"progress": F.lit(min(max(fraction, 0.0), 1.0)), "progress_note": F.lit(note), "updated_at": F.lit(now)})


def extend_lease(jobs: DataFrame, ids, now: int, lease_ms: int = LEASE_MS) -> DataFrame:
    return update(jobs, ids & (F.col("state") == "running"), {"lease_until": F.lit(now + lease_ms), "updated_at": F.lit(now)})


def record_usage(jobs: DataFrame, deltas: DataFrame) -> DataFrame:
    """jobs with the sums of a usage log (job_id, tokens_in, tokens_out, cost_micros) added; whatever their state."""
    sums = deltas.groupBy(F.col("job_id").alias("id")).agg(*[F.sum(n).alias(f"_{n}") for n in ("tokens_in", "tokens_out", "cost_micros")])
    joined = jobs.join(sums, "id", "left")
    return joined.select(*[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) if f"_{n}" in joined.columns else F.col(n) for n in jobs.columns])



def _freed(**values) -> dict:
    return {"lease_until": "cast(null as long)", "worker": "''"} | values


def complete(jobs: DataFrame, ids, note: str, now: int) -> DataFrame:
    """No state guard: even a cancelled job becomes succeeded."""
    return update(jobs, ids, _freed(state=F.lit("succeeded"), progress=F.lit(1.0), progress_note=F.lit(note), finished_at=F.lit(now), updated_at=F.lit(now)))


def release(jobs: DataFrame, ids, now: int) -> DataFrame:
    return update(jobs, ids & (F.col("state") == "running"), _freed(state=F.lit("queued"), attempts="greatest(attempts - 1, 0)", run_after=F.lit(now), updated_at=F.lit(now)))


def retry(jobs: DataFrame, ids, error: str, run_after: int, now: int) -> DataFrame:
    return update(jobs, ids, _freed(state=F.lit("queued"), last_error=F.lit(error), run_after=F.lit(run_after), updated_at=F.lit(now)))


def fail(jobs: DataFrame, ids, error: str, now: int) -> DataFrame:
    return update(jobs, ids, _freed(state=F.lit("failed"), last_error=F.lit(error), finished_at=F.lit(now), updated_at=F.lit(now)))


def cancel(jobs: DataFrame, ids, now: int) -> tuple[DataFrame, DataFrame]:
    """(snapshot, number of jobs cancelled)."""
    open_ = ids & F.col("state").isin(*PENDING)
    return update(jobs, open_, _freed(state=F.lit("cancelled"), finished_at=F.lit(now), updated_at=F.lit(now))), affected(jobs, open_)


def reclaim(jobs: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Jobs with lapsed leases go back to the queue, attempts untouched; and how many."""
    lapsed = f"state = 'running' and lease_until < {now}"
    return update(jobs, lapsed, _freed(state=F.lit("queued"), last_error=F.lit(RECLAIMED), updated_at=F.lit(now))), affected(jobs, lapsed)


def purge(jobs: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Finished jobs older than the cutoff go; and how many."""
    old = f"state in ('succeeded', 'failed', 'cancelled') and finished_at < {cutoff}"
    return delete(jobs, old), affected(jobs, old)


def without_handler(jobs: DataFrame, kinds: list[str], now: int) -> DataFrame:
    """Running jobs of a kind that nobody handles fail at once, attempts left or not."""
    lost = (F.col("state") == "running") & ~F.col("kind").isin(*kinds)
    return update(jobs, lost, _freed(state=F.lit("failed"), last_error=F.concat(F.lit(NO_HANDLER), "kind"), finished_at=F.lit(now), updated_at=F.lit(now)))


def finish_attempts(jobs: DataFrame, ids, error: str, now: int) -> DataFrame:
    """Failed attempts: back to the queue after the back-off (less a jitter that the id seeds), or failed once attempts are used up."""
    from ..functions.scalars import retry_delay_ms

    again = F.col("attempts") < F.col("max_attempts")
    spent = fail(jobs, ids & ~again, error, now)
    wait = F.lit(now) + retry_delay_ms("attempts", "id")
    return update(spent, ids & (F.col("state") == "running") & again, _freed(state=F.lit("queued"), last_error=F.lit(error), run_after=wait, updated_at=F.lit(now)))


def run_handlers(jobs: DataFrame, handlers: dict) -> DataFrame:
    """(id, ok, error) of calling handlers[kind](payload) for each job; one job's error stops no other."""
    import pandas as pd

    def call(frames):
        for frame in frames:
            out = []
            for job, kind, payload in zip(frame["id"], frame["kind"], frame["payload"], strict=True):
                try:
                    handlers[kind](payload)
                    out.append((job, True, None))
                except Exception as e:  # noqa: BLE001
                    out.append((job, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "ok", "error"])

    return jobs.select("id", "kind", "payload").mapInPandas(call, "id long, ok boolean, error string")
