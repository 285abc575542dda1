"""Judging segments in batches: payloads, checks of responses, retries and splits."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cueweave import schemas
from cueweave.functions import scan as S
from cueweave.functions.storage import materialise

BATCH, BUCKET_SEGMENTS, ANSWER_ROWS = 40, 4096, 256
#: What a judge is asked for in each mode.
INSTRUCTIONS = {
    "crosstalk": "Mark a segment remove if it is small talk, a false start or people talking over one another, else keep.",
    "highlights": "Mark a segment keep if it holds a decision, a result or a main point, else remove.",
}
MODES = tuple(INSTRUCTIONS)


def require_mode(jobs: DataFrame, mode: str = "mode", *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows by the allowed modes; a null mode is rejected.

    ``strict``: an unknown mode fails the query that reads the accepted rows instead.
    """
    good = F.coalesce(F.col(mode).isin(*MODES), F.lit(False))
    if strict:
        known = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), F.coalesce(F.col(mode), F.lit("null")))).cast("boolean"))
        return jobs.filter(known), jobs.limit(0)
    return jobs.filter(good), jobs.filter(~good)


def with_instructions(jobs: DataFrame, mode: str = "mode", instructions: dict[str, str] | None = None) -> DataFrame:
    """Jobs with the ``instructions`` of their mode; jobs of an unknown mode are left out."""
    table = jobs.sparkSession.createDataFrame(sorted((instructions or INSTRUCTIONS).items()), f"`{mode}` string, instructions string")
    return jobs.join(F.broadcast(table), mode)  # a row for each mode


def batches(segments: DataFrame, size: int = BATCH, bucket_segments: int | None = None) -> DataFrame:
    """Segments with their batch and place: consecutive batches of ``size`` (1 at least).

    ``bucket_segments``: number a recording's segments in two levels, so many to a bucket.
    """
    bucket = None if bucket_segments is None else F.floor(F.col("seg_ord") / bucket_segments)
    placed = S.position(segments, ["rec_id"], ["seg_ord"], bucket, "__place")
    place, size = F.col("__place"), max(1, size)
    return placed.withColumn("chunk_id", F.floor(place / size).cast("long")).withColumn("pos", (place % size).cast("int")).drop("__place")


def payloads(batched: DataFrame) -> DataFrame:
    """(rec_id, chunk_id, n_segments, payload): the JSON list of each batch in order."""
    item = F.struct("pos", "speaker", "start", "end", "text", "overlap_candidate")
    listed = batched.groupBy("rec_id", "chunk_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    bare = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in ("speaker", "start", "end", "text", "overlap_candidate")]))
    return listed.select("rec_id", "chunk_id", F.size("items").cast("long").alias("n_segments"), F.to_json(bare).alias("payload"))


def parsed_judgments(raw: Column) -> Column:
    """The judgments of a response, or null if any entry is invalid."""
    items = F.transform(F.from_json(raw, schemas.JUDGMENTS), lambda x: F.struct(x["start"].try_cast("double").alias("start"), x["end"].try_cast("double").alias("end"), x["decision"].alias("decision"), F.coalesce(x["reason"], F.lit("")).alias("reason")))
    fine = lambda all_: F.forall(all_, lambda x: x["start"].isNotNull() & x["end"].isNotNull() & F.coalesce(x["decision"].isin("keep", "remove"), F.lit(False)))
    return F.transform(F.array(items), lambda x: F.when(raw.rlike(r"^\s*\[") & fine(x), x))[0]  # bound, so that a response is parsed once


def check_responses(responses: DataFrame) -> DataFrame:
    """Add ``judgments`` and ``outcome`` to (…, n_segments, raw, finish_reason, error_code)."""
    out = responses.withColumn("judgments", parsed_judgments(F.col("raw")))
    outcome = (
        F.when(F.col("error_code") == 429, "rate_limited").when(F.col("error_code").isNotNull(), "api_error")
        .when(F.col("judgments").isNull() & F.coalesce(F.col("finish_reason").contains("MAX_TOKENS"), F.lit(False)), "truncated")
        .when(F.col("judgments").isNull(), "malformed").when(F.size("judgments") != F.col("n_segments"), "wrong_count").otherwise("ok")
    )
    return out.withColumn("outcome", outcome)


KEY = ["rec_id", "chunk_id", "part"]
QUESTION = [*KEY, "n_segments", "payload", "mode", "instructions", "note"]
RESPONSE = pa.schema([("rec_id", pa.int64()), ("chunk_id", pa.int64()), ("part", pa.string()), ("raw", pa.string()), ("finish_reason", pa.string()), ("error_code", pa.int32())])


def in_turn(fn: Callable[[pd.DataFrame], pd.DataFrame], frames: Iterator[pd.DataFrame], batches_per_call: int, in_flight: int) -> Iterator[pd.DataFrame]:
    """Answers of ``fn`` to frames of at most ``batches_per_call`` rows, ``in_flight`` calls at once."""

    def parts() -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batches_per_call):
                part = frame.iloc[at : at + batches_per_call]
                part.index = pd.RangeIndex(len(part))
                yield part

    if in_flight == 1:  # one after the other needs no thread
        yield from map(fn, parts())
        return
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque = deque()
        for part in parts():
            if len(waiting) >= in_flight:
                yield waiting.popleft().result()
            waiting.append(pool.submit(fn, part))
        while waiting:
            yield waiting.popleft().result()


def gathered(answers: Iterator[pd.DataFrame], rows: int = ANSWER_ROWS) -> Iterator[pd.DataFrame]:
    """The same answers in frames of at least ``rows`` rows: a frame for each call would cost more than its answers."""
    some: list[pd.DataFrame] = []
    held = 0
    for answer in answers:
        if len(answer):
            some.append(answer)
            held += len(answer)
        if held >= rows:
            yield pd.concat(some, ignore_index=True)
            some, held = [], 0
    if some:
        yield pd.concat(some, ignore_index=True)


def with_answers(batches: Iterator[pa.RecordBatch], fn: Callable[[pd.DataFrame], pd.DataFrame], kept: list[str], batches_per_call: int, in_flight: int) -> Iterator[pa.RecordBatch]:
    """The columns ``kept`` of the questions, each with the first answer to it and whether there is one.

    What ``fn`` is not told passes by as Arrow columns, so that answers need not be joined to it."""
    rows = batches_per_call * max(1, ANSWER_ROWS // batches_per_call)
    for batch in batches:
        asked = batch.select(QUESTION)
        frames = (asked.slice(at, rows).to_pandas() for at in range(0, batch.num_rows, rows))
        told = [pa.table([pa.array(a[c], kind, from_pandas=True) for c, kind in zip(RESPONSE.names, RESPONSE.types, strict=True)], RESPONSE) for a in gathered(in_turn(fn, frames, batches_per_call, in_flight))]
        answers = pa.concat_tables([RESPONSE.empty_table(), *told]).combine_chunks()
        first: dict[tuple, int] = {}
        for i, key in enumerate(zip(*[answers.column(c).to_pylist() for c in KEY], strict=True)):
            first.setdefault(key, i)
        at = pa.array([first.get(key) for key in zip(*[batch.column(c).to_pylist() for c in KEY], strict=True)], pa.int64())
        taken = answers.select(RESPONSE.names[len(KEY) :]).take(at).combine_chunks()
        columns = [*[batch.column(c) for c in kept], *[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in taken.columns], at.is_valid()]
        yield pa.RecordBatch.from_arrays(columns, [*kept, *taken.column_names, "answered"])


def judge(
    segments: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], batch_size: int = BATCH, mode: str = "highlights", instructions: dict[str, str] | None = None, *,
    tasks: int | None = None, batches_per_call: int = 8, in_flight: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(decisions, failures) of all segments.

    ``fn`` gets frames of (rec_id, chunk_id, part, n_segments, payload, mode,
    instructions, note) and returns (rec_id, chunk_id, part, raw, finish_reason,
    error_code).  ``segments`` may tell each recording's mode in a column ``mode``, else
    ``mode`` holds for all.  A truncated batch is split at once, other failures (no answer
    is one) are tried again once and then split; a single segment that fails twice fails
    its recording.  Of several answers to one batch one counts.  Every wave is written,
    so no answered batch is asked again.  An unknown mode is an error before anything is
    asked.

    Calls are dealt evenly over ``tasks`` tasks (as many as shuffle partitions, if not
    told), whatever the payloads' sizes; a task hands ``fn`` at most ``batches_per_call``
    batches at once and has ``in_flight`` calls under way, in threads if several.  An
    answer counts for a batch that the same task was asked for.
    """
    tasks = tasks or int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = instructions or INSTRUCTIONS
    segments = segments if "mode" in segments.columns else segments.withColumn("mode", F.lit(mode))
    unknown = segments.filter(F.coalesce(~F.col("mode").isin(*texts), F.lit(True))).select("mode").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown mode: {unknown[0]['mode']!r}")
    told = ["speaker", "start", "end", "text", "overlap_candidate"]
    batched = batches(segments.filter("rec_id is not null"), batch_size, BUCKET_SEGMENTS).groupBy("rec_id", "chunk_id")
    batched = batched.agg(F.min("mode").alias("mode"), F.array_sort(F.collect_list(F.struct("pos", "seg_ord", *told))).alias("items"))
    # A question is a row with its segments, so waves neither group nor number segments again.
    work = materialise(batched.select("rec_id", "chunk_id", F.lit("").alias("part"), F.lit(0).alias("attempt"), "mode", "items"), "judge-segments")
    kept = [*work.columns, "n_segments"]
    solved, failed = None, None
    while not work.isEmpty():
        # Dealt before the payloads are made: they are not moved between tasks, nor are answers joined to their questions.
        dealt = work.repartition(tasks)  # a stated number, which adaptive execution leaves as it is
        bare = F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in told]))
        asked = dealt.withColumn("n_segments", F.size("items")).withColumn("payload", F.to_json(bare)).withColumn("note", F.when(F.col("attempt") > 0, "The previous response was not valid; answer with the list alone.").otherwise(""))
        asked = with_instructions(asked, instructions=texts).select(*kept, "payload", "instructions", "note")
        kinds = StructType([asked.schema[c] for c in kept]).add("raw", "string").add("finish_reason", "string").add("error_code", "integer").add("answered", "boolean")
        answers = materialise(asked.mapInArrow(lambda parts: with_answers(parts, fn, kept, batches_per_call, in_flight), kinds), "judge-answers")
        checked = check_responses(answers).withColumn("outcome", F.when(F.col("answered"), F.col("outcome")).otherwise("api_error"))
        pairs = F.arrays_zip(F.col("items.seg_ord").alias("seg_ord"), F.col("judgments").alias("j"))
        fine = F.col("outcome") == "ok"
        # A question is either solved or asked again: only then are its segments needed.
        checked = checked.select(*[c for c in kept if c != "items"], "outcome", F.when(~fine, F.col("items")).alias("items"), F.when(fine, pairs).alias("pairs"))
        checked = materialise(checked, "judge-checked")
        got = checked.filter("outcome = 'ok'").select("rec_id", F.explode("pairs").alias("p")).select("rec_id", "p.seg_ord", "p.j.*")
        solved = got if solved is None else solved.unionByName(got)
        rest = checked.filter("outcome <> 'ok'")
        split = (F.col("n_segments") > 1) & ((F.col("outcome") == "truncated") | (F.col("attempt") > 0))
        lost = (F.col("n_segments") == 1) & (F.col("attempt") > 0)
        gone = rest.filter(lost).select("rec_id", "outcome").distinct()
        failed = gone if failed is None else failed.unionByName(gone)
        half = F.floor(F.col("n_segments") / 2).cast("int")
        parts = F.array(
            F.struct(F.lit("a").alias("half"), F.slice("items", F.lit(1), half).alias("items")),
            F.struct(F.lit("b").alias("half"), F.slice("items", half + 1, F.col("n_segments") - half).alias("items")),
        )
        halves = rest.filter(split).withColumn("p", F.explode(parts)).select("rec_id", "chunk_id", F.concat("part", "p.half").alias("part"), F.lit(0).alias("attempt"), "mode", "p.items")
        again = rest.filter(~split & ~lost).select("rec_id", "chunk_id", "part", (F.col("attempt") + 1).alias("attempt"), "mode", "items")
        work = halves.unionByName(again)
    if solved is None:
        empty = segments.select("rec_id", "seg_ord", "start", "end", F.lit("").alias("decision"), F.lit("").alias("reason")).limit(0)
        return empty, segments.select("rec_id", F.lit("").alias("outcome")).limit(0)
    failed = failed.distinct()
    return solved.join(failed.select("rec_id").distinct(), "rec_id", "left_anti"), failed


def judge_by_rule(segments: DataFrame, keep: Column, reason: Column | None = None) -> DataFrame:
    """Decisions of a column rule: no Python at all."""
    return segments.select("rec_id", "seg_ord", "start", "end", F.when(keep, "keep").otherwise("remove").alias("decision"), (F.lit("") if reason is None else reason).alias("reason"))
