"""Job status logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.text import trim_ws


def latest_state(events: DataFrame, job: str = "job_id") -> DataFrame:
    """The last event of each job by (ts, seq)."""
    rest = [c for c in events.columns if c != job]
    return events.groupBy(job).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("e")).select(job, "e.*")


#: The stages of a job in order.
STAGES = ("queued", "downloading", "transcribing", "deciding", "building_edl", "slicing", "done")


def job_defaults(jobs: DataFrame) -> DataFrame:
    """Fill what a new job does not tell: status, transcript source and progress.  A mode has no default."""
    values = {"status": "queued", "transcript_source": "asr", "progress_current": 0, "progress_total": 0}
    have = {k: v for k, v in values.items() if k in jobs.columns}
    return jobs.fillna(have)


def with_url(jobs: DataFrame, url: str = "source_url") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) jobs: an address of white space alone, or none, is rejected."""
    good = F.coalesce(F.length(trim_ws(F.col(url))) > 0, F.lit(False))
    return jobs.filter(good), jobs.filter(~good)


def stage_progress(events: DataFrame, job: str = "job_id") -> DataFrame:
    """The last progress of each job and stage in percent (null if nothing is to do)."""
    last = events.groupBy(job, "status").agg(F.max_by(F.struct("current", "total"), "seq").alias("p"))
    return last.select(job, "status", "p.current", "p.total", _percent("p.current", "p.total"))


def _percent(current: str, total: str) -> Column:
    return F.round(100.0 * F.col(current) / F.nullif(F.col(total), F.lit(0))).alias("percent")


def stage_board(events: DataFrame, job: str = "job_id") -> DataFrame:
    """A row for each job and stage in order: (job, stage_ord, stage, state, current, total, percent).

    Stages before the job's latest one are done and tell no progress, the latest is
    active (or done, if it is the last), later ones wait.  A failed or skipped job stops
    at the last stage that it was in.  Progress begins at 0 of 0 with each stage: only
    what was told since the job entered it last counts.
    """
    place = F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)])
    told = events.withColumn("at", place[F.col("status")])
    order = Window.partitionBy(job).orderBy("ts", "seq")
    told = told.filter("at is not null").withColumn("entered", F.coalesce(F.col("at") != F.lag("at").over(order), F.lit(True)))
    latest = told.groupBy(job).agg(F.max_by(F.struct("at", "current", "total", "entered"), F.struct("ts", "seq")).alias("l"))
    board = latest.withColumn("stage_ord", F.explode(F.sequence(F.lit(0), F.lit(len(STAGES) - 1))))
    here = F.col("stage_ord") == F.col("l.at")
    state = F.when((F.col("stage_ord") < F.col("l.at")) | (here & (F.col("l.at") == len(STAGES) - 1)), "done").when(here, "active").otherwise("waiting")
    active = lambda c: F.when(here & ~F.col("l.entered"), F.col(f"l.{c}")).otherwise(F.lit(0).cast("long")).alias(c)
    stage = F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage_ord") + 1)
    return board.select(job, "stage_ord", stage.alias("stage"), state.alias("state"), active("current"), active("total")).select("*", _percent("current", "total"))


def look_up(asked: DataFrame, jobs: DataFrame, results: DataFrame, key: str = "rec_id") -> tuple[DataFrame, DataFrame]:
    """(answers, rows) for the identifiers in ``asked``.

    An answer is ``not_found`` for an unknown identifier, ``not_done`` for a job without a
    result yet, else ``done``; only the results of the last are returned.  Null is unknown.
    """
    known = jobs.groupBy(key).agg(F.max(F.coalesce(F.col("status") == "done", F.lit(False))).alias("__done"))
    asked = asked.select(key).distinct()
    answers = asked.join(known, key, "left").select(key, F.when(F.col("__done").isNull(), "not_found").when(~F.col("__done"), "not_done").otherwise("done").alias("answer"))
    return answers, results.join(answers.filter("answer = 'done'").select(key), key, "left_semi")


def finished(results: DataFrame, jobs: DataFrame, key: str = "rec_id") -> DataFrame:
    """Results of jobs that are done."""
    return results.join(jobs.filter("status = 'done'").select(key).distinct(), key, "left_semi")
