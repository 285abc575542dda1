"""From probes and transcripts of many recordings to cut plans and clean transcripts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise
from cueweave.operators import intervals, judging, reports, transcript
from cueweave.sources.media import media_gate
from cueweave.sources.subtitles import best_transcripts, without_transcript


def spoken_units(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, segments) of transcripts that carry their ``source``.

    Captions are regrouped into sentences, and a sentence is their finest unit;
    recognised speech is grouped into turns.
    """
    columns = ["rec_id", "ord", "word", "start", "end", "speaker", "overlap_candidate"]
    said = materialise(transcript.flag_overlaps(rows.filter("source = 'asr'").select(*columns)), "said")
    turns = transcript.speaker_turns(said)
    # Written, since flags read each sentence several times.
    sentences = materialise(transcript.sentences(rows.filter("source <> 'asr'").select(*columns)), "sentences")
    read = materialise(transcript.flag_overlaps(transcript.segments_as_words(sentences)), "read")
    sentences = transcript.flags_to_segments(sentences, read)
    return said.unionByName(read.select(*columns)), turns.unionByName(sentences.select(*turns.columns))


def highlight_corpus(
    jobs: DataFrame, probes: DataFrame, transcripts: dict[str, DataFrame], keyframes: DataFrame, *,
    keep: Column | None = None, fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None, batch_size: int = judging.BATCH,
) -> dict[str, DataFrame]:
    """The whole job for all recordings of ``jobs`` (rec_id, mode).

    Gate on stream drift, mode, choice of the transcript's source, overlap flags,
    segments, judgment (a column rule ``keep`` over segments, or a model ``fn``), kept
    ranges, cut plan, clean transcript.  Nothing that is wrong with one recording stops
    the others: ``status`` has a row (rec_id, status, reason, source) for each job, and
    only recordings that are ``done`` have rows in the other tables.
    """
    if (keep is None) == (fn is None):
        raise ValueError("give either a rule or a model")
    # Few rows that are read several times: what they are made from is read once.
    jobs, gate = materialise(jobs.select("rec_id", "mode"), "wanted"), materialise(media_gate(probes).select("rec_id", "status", "reason", "duration"), "gate")
    _, unknown = judging.require_mode(jobs)
    sound = jobs.join(gate.filter("status = 'ok'").select("rec_id", "duration"), "rec_id").join(unknown.select("rec_id").distinct(), "rec_id", "left_anti")
    sound = materialise(sound, "jobs")
    rows = materialise(best_transcripts(sound, transcripts)[0], "transcripts")
    silent = without_transcript(sound, rows.select("rec_id").distinct())
    words, segments = spoken_units(rows)
    words, segments = materialise(words, "words"), materialise(segments, "segments")
    if fn is None:
        decisions, failed = judging.judge_by_rule(segments, keep), None
    else:
        decisions, failed = judging.judge(segments.join(sound.select("rec_id", "mode"), "rec_id"), fn, batch_size)
    heard = sound.select("rec_id", "duration").join(rows.select("rec_id").distinct(), "rec_id", "left_semi")
    lost = failed.groupBy("rec_id").agg(F.min("outcome").alias("lost")) if failed is not None else None
    if lost is not None:
        heard = heard.join(lost.select("rec_id"), "rec_id", "left_anti")
    edl, wrong = intervals.checked_edl(decisions, words, heard)
    edl = materialise(edl, "edl")

    status = jobs.select("rec_id").distinct()
    for found, name in (
        (gate.filter("status <> 'ok'").select("rec_id", F.struct(F.lit("skipped_desync").alias("status"), "reason").alias("s")), "gate"),
        (gate.select("rec_id", F.lit(True).alias("s")), "probe"),
        (unknown.select("rec_id", F.struct(F.lit("failed").alias("status"), F.lit("unknown mode").alias("reason")).alias("s")), "mode"),
        (silent.select("rec_id", F.struct(F.lit("failed").alias("status"), "reason").alias("s")), "silent"),
        (lost.select("rec_id", F.struct(F.lit("failed").alias("status"), F.concat(F.lit("judgment: "), "lost").alias("reason")).alias("s")) if lost is not None else None, "judge"),
        (wrong.select("rec_id", F.struct(F.lit("failed").alias("status"), F.concat(F.lit("ranges: "), "kind").alias("reason")).alias("s")), "ranges"),
    ):
        if found is not None:
            status = status.join(found.groupBy("rec_id").agg(F.min("s").alias(name)), "rec_id", "left")
    no_probe = F.when(F.col("probe").isNull(), F.struct(F.lit("failed").alias("status"), F.lit("no probe").alias("reason")))
    first = F.coalesce(no_probe, *[F.col(c) for c in ("gate", "mode", "silent", "judge", "ranges") if c in status.columns], F.struct(F.lit("done").alias("status"), F.lit(None).cast("string").alias("reason")))
    status = status.withColumn("s", first).join(rows.groupBy("rec_id").agg(F.min("source").alias("source")), "rec_id", "left").select("rec_id", "s.*", "source")
    status = materialise(status, "status")
    done = status.filter("status = 'done'").select("rec_id")
    ours = lambda df: df.join(done, "rec_id", "left_semi")
    return {
        "status": status, "segments": ours(segments), "decisions": ours(decisions), "edl": edl, "violations": wrong,
        "plan": reports.render_plan(edl, keyframes), "clean": transcript.remap_words(ours(words), edl),
    }
