"""The job table: start (an interrupted run of the same type is taken over), progress, finish, latest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def start(jobs: DataFrame, job_type: str, now: Column, stats: str = "{}") -> DataFrame:
    """``jobs`` with the newest running job of the type restarted, or with a new running job if none runs."""
    mine = F.max(F.when((F.col("job_type") == job_type) & (F.col("status") == "running"), F.col("id")))
    state = jobs.agg(mine.alias("_mine"), F.coalesce(F.max("id"), F.lit(0)).alias("_most"))
    joined = jobs.crossJoin(F.broadcast(state))  # one row
    hit = F.col("id") == F.col("_mine")
    changes = {"started_at": now, "finished_at": F.lit(None), "error": F.lit(None), "stats": F.lit(stats)}
    old = joined.select(*[F.when(hit, changes[c].cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in jobs.columns])
    values = {"id": F.col("_most") + 1, "job_type": F.lit(job_type), "status": F.lit("running"), "started_at": now, "stats": F.lit(stats)}
    new = state.where("_mine is null").select(*[values.get(c, F.lit(None)).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns])
    return old.unionByName(new)


def with_stats(jobs: DataFrame, job_id: int, stats: str) -> DataFrame:
    return jobs.withColumn("stats", F.when(F.col("id") == job_id, F.lit(stats)).otherwise(F.col("stats")))


def finish(jobs: DataFrame, job_id: int, now: Column, status: str = "done", error: str | None = None, stats: str | None = None) -> DataFrame:
    """Status, end and error in one change; the last statistics too, so that short runs do not lose them."""
    hit = F.col("id") == job_id
    out = jobs.withColumns({"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "finished_at": F.when(hit, now).otherwise(F.col("finished_at")), "error": F.when(hit, F.lit(error)).otherwise(F.col("error"))})
    return out if stats is None else with_stats(out, job_id, stats)


def latest(jobs: DataFrame, limit: int = 10) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(limit)
