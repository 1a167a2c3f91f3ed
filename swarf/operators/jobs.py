"""Jobs as an append-only log of events: the state of a job is its latest event, so nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("auto_convert", "assisted_manual", "stack")


def valid_mode(mode):
    return mode.isin(*MODES)


def latest(log: DataFrame) -> DataFrame:
    """From job_id, ts, n, status, mode: created_at, updated_at, and the last status and mode that were set.

    max_by combines map-side; n breaks ties of time.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "n"))).alias(c)
    return log.groupBy("job_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), last("status"), last("mode"))


def delete(log: DataFrame, gone: DataFrame) -> DataFrame:
    """The log without the jobs in gone (job_id)."""
    return log.join(gone.select("job_id"), "job_id", "left_anti")


def progress(status):
    return F.when(status == "COMPLETED", 100).otherwise(0)


def with_durations(stages: DataFrame) -> DataFrame:
    """duration_ms from started_at and finished_at."""
    return stages.withColumn("duration_ms", (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000)


def report_summary(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """One row a job: stage rows (those of running and of completed both count), distinct stages, completed, failed, errors."""
    s = stages.groupBy("job_id").agg(
        F.count("*").alias("stage_count"), F.count_distinct("name").alias("distinct_stages"), F.count_if(F.col("status") == "completed").alias("completed_stages"), F.count_if(F.col("status") == "failed").alias("failed_stages"),
        F.count("error").alias("error_count"),
    )
    out = jobs.select("job_id").join(s, "job_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("stage_count", "distinct_stages", "completed_stages", "failed_stages", "error_count")]
    return out.select("job_id", F.col("stage_count").isNotNull().alias("has_report"), *zero)


def paired_stages(stages: DataFrame) -> DataFrame:
    """The intervals of a job's stages: job_id, name, n, started_at, finished_at, status, duration_ms, error.

    stages: rows as they are appended, job_id, name, n (order within the job), ts, status, error. A row "running" goes with
    the next row of its job and name if that ends it (completed or failed); else the stage stays open, without an end. An end with no
    beginning of its own begins and ends at once. Other statuses and nulls are no intervals.
    """
    by = Window.partitionBy("job_id", "name").orderBy("n")
    ends = lambda c: F.coalesce(c.isin("completed", "failed"), F.lit(False))
    s = stages.select("*", F.lead("status").over(by).alias("next_status"), F.lead("ts").over(by).alias("next_ts"), F.lead("error").over(by).alias("next_error"), F.lag("status").over(by).alias("before"))
    begun, done = F.col("status") == "running", ends(F.col("next_status"))
    alone = ends(F.col("status")) & ~F.coalesce(F.col("before") == "running", F.lit(False))
    out = s.where(begun | alone).select(
        "job_id", "name", "n", F.col("ts").alias("started_at"), F.when(alone, F.col("ts")).when(done, F.col("next_ts")).alias("finished_at"), F.when(begun & done, F.col("next_status")).otherwise(F.col("status")).alias("status"),
        F.when(alone, F.col("error")).when(done, F.col("next_error")).alias("error"),
    )
    return with_durations(out)


def run_reports(stages: DataFrame) -> DataFrame:
    """One report a job from its appended stage rows: started_at, finished_at, status, duration_ms, stage_count, distinct_stages, stages, errors.

    stage_count counts rows, those of a beginning and those of an end, as reports always have; distinct_stages counts names, and
    `stages` holds the intervals in order. A job with an open stage is running and has no end; one with a failed stage has failed.
    """
    counts = stages.groupBy("job_id").agg(F.count("*").alias("stage_count"), F.count_distinct("name").alias("distinct_stages"))
    one = F.struct("n", "name", "status", "started_at", "finished_at", "duration_ms", "error")
    p = paired_stages(stages).groupBy("job_id").agg(
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("ended_at"), F.count_if(F.col("finished_at").isNull()).alias("n_open"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.sort_array(F.collect_list(one)).alias("stages"),
    )
    status = F.when(F.col("n_open") > 0, "running").when(F.col("n_failed") > 0, "failed").otherwise("completed")
    p = p.withColumn("status", status).withColumn("finished_at", F.when(F.col("n_open") == 0, F.col("ended_at")))
    errors = F.transform(F.filter("stages", lambda s: s["error"].isNotNull()), lambda s: s["error"])
    return with_durations(p.join(counts, "job_id")).select("job_id", "started_at", "finished_at", "status", "duration_ms", "stage_count", "distinct_stages", F.col("stages"), errors.alias("errors"))
