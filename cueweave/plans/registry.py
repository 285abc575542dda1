"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.functions import scan
from cueweave.functions.storage import fresh_path, materialise
from cueweave.functions.text import strip_tags
from cueweave.operators import interval_join, intervals, jobs, judging, reports, transcript
from cueweave.operators.highlights import highlight_corpus
from cueweave.plans.fixtures import Fixtures
from cueweave.sources import media, results, subtitles
from cueweave.streaming import streams

RANGE_GAP, RANGE_TINY = 3600.0, 7200.0
ANSWER = pd.Index(["rec_id", "chunk_id", "part", "raw", "finish_reason", "error_code"])
EVENT_BUCKET_US, RANGE_BUCKET = 100 * 86_400_000_000, 100 * 86_400.0


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _ranges(f: Fixtures) -> DataFrame:
    return f.event_ranges().select("rec_id", "start", "end")


def _edl(f: Fixtures) -> DataFrame:
    return intervals.build_edl(f.decisions(), f.words(), f.recordings())


def _spans(f: Fixtures) -> DataFrame:
    return f.recordings().select("rec_id", F.lit("first minute").alias("label"), F.lit(0.0).alias("start"), F.least(F.lit(60.0), "duration").alias("end"))


def _event_runs(f: Fixtures) -> DataFrame:
    r = scan.runs(f.table("events"), ["user_id"], "event_type", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / EVENT_BUCKET_US)
    return r.groupBy("user_id", "run").agg(F.min_by("event_type", "event_id").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _file_gate(f: Fixtures) -> DataFrame:
    videos, rest = subtitles.with_suffix(f.files(), subtitles.VIDEO_SUFFIXES)
    texts, rest = subtitles.with_suffix(rest, subtitles.TRANSCRIPT_SUFFIXES)
    kinds = ((videos, "video"), (texts, "transcript"), (rest, "rejected"))
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(k)) for df, k in kinds])


def _gated(parts: tuple[DataFrame, DataFrame], *columns: str) -> DataFrame:
    good, bad = parts
    return good.select(*columns, F.lit(True).alias("accepted")).unionByName(bad.select(*columns, F.lit(False).alias("accepted")))


def _sentence_flags(f: Fixtures) -> DataFrame:
    said = materialise(transcript.sentences(f.cues().withColumn("end", F.col("end") + 9.0)), "said")
    flagged = materialise(transcript.flag_overlaps(transcript.segments_as_words(said)), "flagged")
    by = {p: transcript.flags_to_segments(said, flagged, p).select("rec_id", "seg_ord", F.col("overlap_candidate").alias(p)) for p in ("position", "identity")}
    return by["position"].join(by["identity"], ["rec_id", "seg_ord"])


def _job_lookup(f: Fixtures) -> DataFrame:
    results = f.table("customer").select(F.col("c_custkey").alias("rec_id"), F.col("c_name").alias("result"))
    answers, rows = jobs.look_up(f.asked(), f.jobs(), results)
    return answers.join(rows, "rec_id", "left")


def _best_transcripts(f: Fixtures) -> DataFrame:
    rows, rejected = subtitles.best_transcripts(f.moded(), f.sourced())
    return rows.select("rec_id", "ord", "word", "speaker", "source").unionByName(rejected.select("rec_id", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("speaker"), F.col("reason").alias("source")))


def _unusable(f: Fixtures) -> DataFrame:
    cues, unusable = subtitles.load_transcripts(f.broken_subtitle_files())
    counted = cues.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_cues"))
    return counted.select("rec_id", "n_cues", F.lit(None).cast("string").alias("reason")).unionByName(unusable.select("rec_id", F.lit(0).cast("long").alias("n_cues"), "reason"))


def _checked(f: Fixtures) -> DataFrame:
    # A recording whose length is 0, and ones that end before they start, give ranges that are not sound.
    recordings = f.recordings().withColumn("duration", F.when(F.col("rec_id") % 6 == 5, -1.0).otherwise(F.col("duration")))
    good, wrong = intervals.checked_edl(f.decisions(), f.words(), recordings)
    return good.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.lit("sound").alias("state")).unionByName(wrong.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.lit("not sound").alias("state")))


def _highlights(f: Fixtures, what: str) -> DataFrame:
    keep = ((F.col("rec_id") * 7 + F.col("seg_ord") * 3) % 5) > 1
    return highlight_corpus(f.moded(), f.conversation_probes(), f.sourced(), f.keyframes(), keep=keep)[what]


def _answers(frame: pd.DataFrame) -> pd.DataFrame:
    """A model with all faults: long batches come cut, some answers to a first question are no
    list or too short, some questions are never answered, and one recording in eleven always
    fails.  It keeps segments of an even number of characters."""
    out = []
    for rec_id, chunk_id, part, n_segments, payload, _, _, note in frame.to_numpy(object).tolist():
        items = json.loads(payload)
        raw = json.dumps([{"start": x["start"], "end": x["end"], "decision": "remove" if len(x["text"]) % 2 else "keep", "reason": "r"} for x in items])
        kind, error, finish = (rec_id + chunk_id) % 5, None, "STOP"
        if n_segments > 3:
            raw, finish = raw[: len(raw) // 2], "MAX_TOKENS"
        elif rec_id % 11 == 5 and chunk_id == 0:
            raw, error = None, 500
        elif not note and kind == 1:
            raw = "I can not say."
        elif not note and kind == 2:
            raw = json.dumps(json.loads(raw)[1:])
        elif not note and kind == 3:
            continue
        out.append((rec_id, chunk_id, part, raw, finish, error))
    return pd.DataFrame(np.array(out, dtype=object).reshape(-1, len(ANSWER)), columns=ANSWER, dtype=object)  # one block: made for every call


def _judged(f: Fixtures) -> DataFrame:
    decisions, failed = judging.judge(f.turns(), _answers, 4, tasks=8, batches_per_call=4, in_flight=2)
    decisions = decisions.select("rec_id", "seg_ord", "start", "end", "decision", F.lit(None).cast("string").alias("outcome"))
    return decisions.unionByName(failed.select("rec_id", "outcome"), allowMissingColumns=True)


def _highlights_judged(f: Fixtures) -> DataFrame:
    got = highlight_corpus(f.moded(), f.conversation_probes(), f.sourced(), f.keyframes(), fn=_answers, batch_size=4)
    clean = got["clean"].groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_words"), F.max("end").alias("last_end"))
    return got["status"].join(clean, "rec_id", "left")


def _nested(f: Fixtures) -> DataFrame:
    whole = intervals.nested_edl(_edl(f), f.recordings())
    ranges = F.transform("ranges", lambda r: F.struct(F.round(r["start"], 6).alias("start"), F.round(r["end"], 6).alias("end")))
    return whole.select("rec_id", F.to_json(ranges).alias("ranges"), "source_duration")


def _wide(f: Fixtures) -> DataFrame:
    """Kept judgments with half a minute around them: ranges that overlap each other."""
    kept = f.decisions().filter("decision = 'keep' and seg_ord % 3 = 0")
    return kept.select("rec_id", F.col("seg_ord").alias("range_ord"), (F.col("start") - 30.0).alias("start"), (F.col("end") + 30.0).alias("end"))


def _stream_ranges(f: Fixtures) -> DataFrame:
    path = fresh_path(f.spark, "stream-ranges")
    ranges = f.event_ranges(f.arriving("events")).select("rec_id", "start", "end")
    streams.upsert_ranges(ranges, f"{path}/table", f"{path}/checkpoint", RANGE_GAP).trigger(availableNow=True).start().awaitTermination()
    return streams.read_ranges(f.spark, f"{path}/table")


def _stream_jobs(f: Fixtures) -> DataFrame:
    path = fresh_path(f.spark, "stream-jobs")
    events = f.job_events(f.arriving("events"))
    streams.upsert_jobs(events, f"{path}/table", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return streams.read_jobs(f.spark, f"{path}/table", ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in events.schema))


def _transcript_docs(f: Fixtures) -> DataFrame:
    return results.transcript_documents(f.words()).select("rec_id", F.to_json("words").alias("words"))


def _event_overlaps(f: Fixtures) -> DataFrame:
    e = f.event_ranges().join(f.table("events").select(F.col("event_id").alias("range_ord"), "event_type"), "range_ord")
    pairs = interval_join.overlapping(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), 3600.0)
    return pairs.select("rec_id", F.col("l.range_ord").alias("purchase"), F.col("r.range_ord").alias("view"), "shared")


_QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {
    "overlap_flags": lambda f: transcript.flag_overlaps(f.words()).select("rec_id", "ord", "overlap_candidate"),
    "speaker_turns": lambda f: transcript.speaker_turns(f.words()),
    "event_runs": _event_runs,
    "coalesce_ranges": lambda f: intervals.coalesce_ranges(_ranges(f), RANGE_BUCKET),
    "merge_gaps": lambda f: intervals.merge_small_gaps(_ranges(f), RANGE_GAP, RANGE_BUCKET),
    "absorb_tiny": lambda f: intervals.absorb_tiny(intervals.coalesce_ranges(_ranges(f)), RANGE_TINY),
    "snap_ranges": lambda f: intervals.snap_to_words(intervals.keep_ranges(f.decisions()), f.words()),
    "build_edl": lambda f: intervals.build_edl(f.decisions(), f.words(), f.recordings()),
    "edl_violations": lambda f: intervals.edl_violations(f.event_ranges()),
    "nested_edl": _nested,
    "checked_edl": _checked,
    "remap_words": lambda f: transcript.remap_words(f.words(), _edl(f)),
    "kept_words": lambda f: transcript.kept_words(f.words(), _edl(f)).select("rec_id", "ord", "word"),
    "words_in_ranges": lambda f: transcript.words_in_ranges(f.words(), _wide(f)).select("rec_id", "ord", "range_ord"),
    "remap_any": lambda f: transcript.remap_words_of_any(f.words(), _wide(f)).select("rec_id", "ord", "range_ord", "start", "end"),
    "event_overlaps": _event_overlaps,
    "stream_ranges": _stream_ranges,
    "stream_jobs": _stream_jobs,
    "transcript_docs": _transcript_docs,
    "cut_words": lambda f: transcript.cut_words(f.words(), _edl(f)).select("rec_id", "ord", "word"),
    "edl_summary": lambda f: reports.edl_summary(_edl(f), f.recordings()),
    "span_removed": lambda f: reports.span_removed(_spans(f), _edl(f)),
    "keyframe_method": lambda f: reports.keyframe_method(_edl(f), f.keyframes()),
    "render_plan": lambda f: reports.render_plan(_edl(f), f.keyframes()),
    "caption_cues": lambda f: subtitles.parse_subtitles(f.subtitle_files()).select("rec_id", "ord", "word", "start", "end", "speaker"),
    "json3_cues": lambda f: subtitles.parse_json3(f.json3_files()).select("rec_id", "ord", "word", "start", "end", "speaker"),
    "strip_tags": lambda f: f.table("pages").select("page_id", strip_tags(F.col("html")).alias("text")),
    "sentences": lambda f: transcript.sentences(f.cues()),
    "segment_batches": lambda f: judging.batches(transcript.speaker_turns(f.words())).select("rec_id", "seg_ord", "chunk_id", "pos"),
    "batch_payload": lambda f: judging.payloads(judging.batches(transcript.speaker_turns(f.words()))),
    "judgments_valid": lambda f: judging.check_responses(f.responses()).select("rec_id", "chunk_id", "n_segments", "outcome"),
    "judged": _judged,
    "highlight_judged": _highlights_judged,
    "media_gate": lambda f: media.media_gate(f.probes()),
    "source_choice": lambda f: subtitles.choose_source(f.source_candidates()),
    "track_choice": lambda f: subtitles.pick_track(f.tracks()),
    "job_latest": lambda f: jobs.latest_state(f.job_events()),
    "stage_progress": lambda f: jobs.stage_progress(f.job_events()),
    "stage_board": lambda f: jobs.stage_board(f.job_events()),
    "job_defaults": lambda f: jobs.job_defaults(f.jobs()).select("rec_id", "status", "transcript_source", "progress_current", "progress_total"),
    "job_lookup": _job_lookup,
    "url_gate": lambda f: _gated(jobs.with_url(f.jobs()), "rec_id"),
    "mode_gate": lambda f: _gated(judging.require_mode(f.jobs()), "rec_id", "mode"),
    "mode_instructions": lambda f: judging.with_instructions(f.jobs().select("rec_id", "mode")),
    "mode_summary": lambda f: reports.mode_summary(reports.edl_summary(_edl(f), f.recordings()), f.moded()),
    "file_gate": _file_gate,
    "first_files": lambda f: subtitles.first_files(f.files().withColumn("rec_id", F.floor(F.col("rec_id") / 7))),
    "concat_lists": lambda f: reports.concat_list(reports.render_plan(_edl(f), f.keyframes())),
    "usable_files": _unusable,
    "aligned_words": lambda f: subtitles.parse_aligned(f.aligned()).select("rec_id", "ord", "word", "start", "end", "speaker"),
    "keyframe_times": lambda f: subtitles.parse_keyframes(f.keyframe_files()),
    "sentence_flags": _sentence_flags,
    "best_transcripts": _best_transcripts,
    "highlight_status": lambda f: _highlights(f, "status"),
    "highlight_clean": lambda f: _highlights(f, "clean").groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_words"), F.max("end").alias("last_end")),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, q=q: rounded(q(Fixtures(spark, sf_dir)))) for name, q in _QUERIES.items()}


# ---------------------------------------------------------------- SQL
_TOK = r"""tok AS (
    SELECT conv_id AS rec_id, turn, role AS speaker, len(l) AS n, unnest(range(len(l))) AS k, unnest(l) AS word
    FROM (SELECT *, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS l FROM conversations))"""
_WORDS = f"""{_TOK}, ms AS (SELECT *, turn * 20000 + k * 250 AS s_ms, turn * 20000 + k * 250 + 200 + (k % 3) * 50 AS e_ms FROM tok),
  words AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY s_ms, turn, k) - 1 AS ord, word, s_ms / 1000.0::DOUBLE AS start, e_ms / 1000.0::DOUBLE AS "end", speaker FROM ms)"""
_FLAGS = """SELECT *, coalesce(start < lag("end") OVER w AND speaker <> lag(speaker) OVER w, false)
    OR coalesce(lead(start) OVER w < "end" AND lead(speaker) OVER w <> speaker, false) AS flagged FROM words WINDOW w AS (PARTITION BY rec_id ORDER BY start, ord)"""
_TURNS = f"""{_WORDS}, runs AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY start, ord) AS seg_ord FROM (
    SELECT *, CASE WHEN speaker <> lag(speaker) OVER (PARTITION BY rec_id ORDER BY start, ord) THEN 1 ELSE 0 END AS new FROM words)),
  turns AS (SELECT rec_id, CAST(seg_ord AS BIGINT) AS seg_ord, arg_min(speaker, ord) AS speaker, arg_min(start, ord) AS start, arg_max("end", ord) AS "end",
    string_agg(word, ' ' ORDER BY ord) AS text FROM runs GROUP BY rec_id, seg_ord)"""
_DECISIONS = f"""{_TURNS}, decisions AS (SELECT rec_id, seg_ord, round(start + 0.1, 3) AS start, round("end" - 0.05, 3) AS "end",
    CASE WHEN (rec_id * 7 + seg_ord * 3) % 5 IN (0, 1) THEN 'remove' ELSE 'keep' END AS decision FROM turns),
  recordings AS (SELECT rec_id, max("end") + 1.0 AS duration FROM words GROUP BY rec_id UNION ALL SELECT -1, 10.0)"""
_RANGES = """ranges AS (SELECT user_id AS rec_id, event_id AS range_ord, (epoch_us(ts) - 1704067200000000) / 1e6 AS start,
    (epoch_us(ts) - 1704067200000000 + CAST(round(value * 100) AS BIGINT) * 6000000) / 1e6 AS "end" FROM events)"""


def _merged(source: str, out: str, new: str) -> str:
    return f"""{out} AS (SELECT rec_id, min(start) AS start, max("end") AS "end" FROM (
      SELECT *, sum(CASE WHEN latest IS NULL OR {new} THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY start, "end") AS island FROM (
        SELECT *, max("end") OVER (PARTITION BY rec_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM {source}))
      GROUP BY rec_id, island)"""


def _absorbed(source: str, out: str, least: float) -> str:
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start, "end") AS i, count(*) OVER (PARTITION BY rec_id) AS n FROM {source}),
  {out}_f AS (SELECT rec_id, i, n, start AS s, "end" AS e, "end" - start >= {least} AS closed FROM {out}_n WHERE i = 1
    UNION ALL SELECT r.rec_id, r.i, r.n, CASE WHEN f.closed THEN r.start ELSE f.s END, r."end", r."end" - CASE WHEN f.closed THEN r.start ELSE f.s END >= {least}
    FROM {out}_f f JOIN {out}_n r ON r.rec_id = f.rec_id AND r.i = f.i + 1),
  {out} AS (SELECT c.rec_id, c.s AS start, CASE WHEN c.i = max(c.i) OVER (PARTITION BY c.rec_id) AND o.e IS NOT NULL THEN greatest(c.e, o.e) ELSE c.e END AS "end"
    FROM {out}_f c LEFT JOIN (SELECT rec_id, e FROM {out}_f WHERE i = n AND NOT closed) o USING (rec_id) WHERE c.closed)"""


_SNAP = """firsts AS (SELECT rec_id, start, arg_max("end", ord) AS "end" FROM words GROUP BY rec_id, start),
  snapped AS (SELECT r.rec_id, CASE WHEN a.start < r.start AND r.start < a."end" THEN a.start ELSE r.start END AS start,
    greatest(CASE WHEN b.start < r."end" AND r."end" < b."end" THEN b."end" ELSE r."end" END, CASE WHEN a.start < r.start AND r.start < a."end" THEN a.start ELSE r.start END) AS "end"
    FROM {source} r ASOF LEFT JOIN firsts a ON r.rec_id = a.rec_id AND r.start >= a.start ASOF LEFT JOIN firsts b ON r.rec_id = b.rec_id AND r."end" >= b.start)"""
_KEPT = f"""keeps AS (SELECT rec_id, start, "end" FROM decisions WHERE decision = 'keep' AND "end" > start),
  {_merged("keeps", "joined", "start > latest")}, {_SNAP.format(source="joined")}, {_merged("snapped", "again", "start > latest")},
  {_merged("again", "near", "start - latest >= 0.3")}, {_absorbed("near", "solid", 0.5)},
  edl AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start, "end") - 1 AS range_ord, start, "end" FROM (
    SELECT r.rec_id, greatest(0.0, coalesce(s.start, 0.0)) AS start, CASE WHEN duration <> 0 THEN least(coalesce(s."end", duration), duration) ELSE coalesce(s."end", duration) END AS "end"
    FROM recordings r LEFT JOIN solid s USING (rec_id)))"""
_EDL = f"{_DECISIONS}, {_KEPT}"
_HELD = """held AS (SELECT w.*, r.range_ord, r.start AS r_start FROM words w ASOF LEFT JOIN edl r ON w.rec_id = r.rec_id AND w.start >= r.start),
  marked AS (SELECT h.*, e."end" AS r_end FROM held h LEFT JOIN edl e ON e.rec_id = h.rec_id AND e.range_ord = h.range_ord)"""
_KEY = """cuts AS (SELECT e.*, coalesce((SELECT min(abs(t - e.start)) FROM range(0, 200, 5) k(t) WHERE e.rec_id % 10 <> 0), 'infinity'::DOUBLE) AS distance FROM edl e)"""
_CUES = r"""cues AS (SELECT conv_id AS rec_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, array_to_string(l, ' ') AS word,
    turn * 10000 / 1000.0::DOUBLE AS start, (turn * 10000 + len(l) * 80) / 1000.0::DOUBLE AS "end", role AS speaker
  FROM (SELECT *, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS l FROM conversations) WHERE len(l) > 0)"""
def _sentences(cues: str) -> str:
    """Sentences of the table ``cues``: tokens one after another, with what is open carried along."""
    return f"""token AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY ord, k) AS i FROM (
      SELECT rec_id, ord, speaker, start AS cs, "end" AS ce, len(l) AS n, unnest(range(len(l))) AS k, unnest(l) AS token FROM (SELECT *, string_split(word, ' ') AS l FROM {cues}))),
  timed AS (SELECT *, CASE WHEN n <= 1 THEN cs ELSE cs + (k / n::DOUBLE) * (ce - cs) END AS s, CASE WHEN n <= 1 THEN ce ELSE cs + ((k + 1) / n::DOUBLE) * (ce - cs) END AS e,
    regexp_matches(token, '[.!?]+["'')\\]]*$') AS stop FROM token),
  walk AS (SELECT rec_id, i, speaker, 0 AS grp, CASE WHEN stop OR ce - cs >= 20.0 THEN 0 ELSE 1 END AS held, cs AS since FROM timed WHERE i = 1
    UNION ALL SELECT t.rec_id, t.i, t.speaker, CASE WHEN w.held = 0 OR t.speaker <> w.speaker THEN w.grp + 1 ELSE w.grp END,
      CASE WHEN t.stop OR t.ce - (CASE WHEN w.held = 0 OR t.speaker <> w.speaker THEN t.cs ELSE w.since END) >= 20.0 OR (CASE WHEN t.speaker <> w.speaker THEN 0 ELSE w.held END) + 1 >= 40 THEN 0
        ELSE (CASE WHEN t.speaker <> w.speaker THEN 0 ELSE w.held END) + 1 END,
      CASE WHEN w.held = 0 OR t.speaker <> w.speaker THEN t.cs ELSE w.since END
    FROM walk w JOIN timed t ON t.rec_id = w.rec_id AND t.i = w.i + 1),
  sentences AS (SELECT rec_id, CAST(grp AS BIGINT) AS seg_ord, arg_min(t.speaker, i) AS speaker, arg_min(s, i) AS start, greatest(arg_max(e, i), arg_min(s, i)) AS "end", string_agg(token, ' ' ORDER BY i) AS text
    FROM walk w JOIN timed t USING (rec_id, i) GROUP BY rec_id, grp)"""


_NEW_JOBS = """jobs AS (SELECT c_custkey AS rec_id, CASE c_custkey % 4 WHEN 0 THEN 'crosstalk' WHEN 1 THEN 'highlights' WHEN 2 THEN 'summary' END AS mode,
    CASE c_custkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'deciding' END AS status, c_custkey % 6 > 2 AS has_url FROM customer)"""
_MODED = """moded AS (SELECT rec_id, CASE WHEN rec_id % 9 = 0 THEN 'summary' WHEN rec_id % 2 = 0 THEN 'crosstalk' ELSE 'highlights' END AS mode FROM (
    SELECT DISTINCT conv_id AS rec_id FROM conversations UNION ALL SELECT DISTINCT -conv_id - 2 FROM conversations WHERE conv_id % 10 = 0))"""
_STAGES = "['queued','downloading','transcribing','deciding','building_edl','slicing','done']"
_JOBS = """log AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'transcribing' WHEN 'click' THEN 'deciding'
    WHEN 'purchase' THEN 'slicing' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, event_id % 50 AS current, CAST(50 AS BIGINT) AS total FROM events)"""


def _job(keep: str, judged: str = "true") -> str:
    """The whole job: words on the shortened time line (rec_id, last) of the recordings that are done."""
    return f"""{_TURNS.replace("words", "spoken")}, {_CUES}, {_MODED}, chosen AS (SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN 'up' WHEN rec_id % 2 = 0 THEN 'url' ELSE 'asr' END AS source, rec_id * 10 + 2000.0::DOUBLE AS duration
      FROM moded WHERE rec_id >= 0 AND rec_id % 8 <> 7 AND mode <> 'summary' AND NOT (rec_id % 3 <> 0 AND rec_id % 2 <> 0 AND rec_id % 5 = 4) AND {judged}),
  captions AS (SELECT c.* REPLACE (CASE source WHEN 'up' THEN speaker ELSE 'SPEAKER' END AS speaker) FROM cues c JOIN chosen USING (rec_id) WHERE source <> 'asr'), {_sentences("captions")},
  segments AS (SELECT rec_id, seg_ord, start, "end", text FROM sentences UNION ALL SELECT rec_id, seg_ord, start, "end", text FROM turns JOIN chosen USING (rec_id) WHERE source = 'asr'),
  words AS (SELECT rec_id, seg_ord AS ord, start, "end" FROM sentences UNION ALL SELECT rec_id, ord, start, "end" FROM spoken JOIN chosen USING (rec_id) WHERE source = 'asr'),
  decisions AS (SELECT rec_id, seg_ord, start, "end", CASE WHEN {keep} THEN 'keep' ELSE 'remove' END AS decision FROM segments), recordings AS (SELECT rec_id, duration FROM chosen),
  {_KEPT}, {_HELD}, off AS (SELECT rec_id, range_ord, coalesce(sum("end" - start) OVER (PARTITION BY rec_id ORDER BY range_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS o FROM edl),
  clean AS (SELECT rec_id, ("end" - r_start) + o AS last FROM marked JOIN off USING (rec_id, range_ord) WHERE "end" <= r_end)"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "overlap_flags": f"WITH {_WORDS} SELECT rec_id, ord, flagged AS overlap_candidate FROM ({_FLAGS})",
        "speaker_turns": f'WITH {_TURNS} SELECT *, false AS overlap_candidate FROM turns',
        "event_runs": """WITH r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
            SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM events))
          SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY user_id, run""",
        "coalesce_ranges": f'WITH {_RANGES}, {_merged("ranges", "o", "start > latest")} SELECT rec_id, round(start, 6) AS start, round("end", 6) AS "end" FROM o',
        "merge_gaps": f'WITH {_RANGES}, {_merged("ranges", "o", f"start - latest >= {RANGE_GAP}")} SELECT rec_id, round(start, 6) AS start, round("end", 6) AS "end" FROM o',
        "absorb_tiny": f'WITH RECURSIVE {_RANGES}, {_merged("ranges", "c", "start > latest")}, {_absorbed("c", "o", RANGE_TINY)} SELECT rec_id, round(start, 6) AS start, round("end", 6) AS "end" FROM o',
        "snap_ranges": f"""WITH {_DECISIONS}, keeps AS (SELECT rec_id, start, "end" FROM decisions WHERE decision = 'keep' AND "end" > start), {_SNAP.format(source="keeps")}
          SELECT rec_id, round(start, 6) AS start, round("end", 6) AS "end" FROM snapped""",
        "build_edl": f'WITH RECURSIVE {_EDL} SELECT rec_id, range_ord, round(start, 6) AS start, round("end", 6) AS "end" FROM edl',
        "edl_violations": f"""WITH {_RANGES} SELECT rec_id, range_ord, kind FROM (SELECT *, CASE WHEN "end" <= start THEN 'empty'
            WHEN start < lag("end") OVER (PARTITION BY rec_id ORDER BY range_ord) THEN 'overlap' END AS kind FROM ranges) WHERE kind IS NOT NULL""",
        "kept_words": f'WITH RECURSIVE {_EDL}, {_HELD} SELECT rec_id, ord, word FROM marked WHERE "end" <= r_end',
        "cut_words": f'WITH RECURSIVE {_EDL}, {_HELD} SELECT rec_id, ord, word FROM marked WHERE "end" > r_end OR r_end IS NULL',
        "remap_words": f"""WITH RECURSIVE {_EDL}, {_HELD}, off AS (SELECT rec_id, range_ord, coalesce(sum("end" - start) OVER (PARTITION BY rec_id ORDER BY range_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS o FROM edl)
          SELECT rec_id, ord, word, round((start - r_start) + o, 6) AS start, round(("end" - r_start) + o, 6) AS "end", speaker, false AS overlap_candidate FROM marked JOIN off USING (rec_id, range_ord) WHERE "end" <= r_end""",
        "edl_summary": f"""WITH RECURSIVE {_EDL} SELECT r.rec_id, count(e.rec_id) AS n_ranges, round(coalesce(sum(e."end" - e.start), 0.0), 6) AS kept_s,
            round(any_value(duration) - coalesce(sum(e."end" - e.start), 0.0), 6) AS removed_s, round(max(e."end" - e.start), 6) AS longest_s FROM recordings r LEFT JOIN edl e USING (rec_id) GROUP BY r.rec_id""",
        "span_removed": f"""WITH RECURSIVE {_EDL}, spans AS (SELECT rec_id, 0.0 AS start, least(60.0, duration) AS "end" FROM recordings)
          SELECT s.rec_id, 'first minute' AS label, round(1 - sum(coalesce(least(s."end", e."end") - greatest(s.start, e.start), 0.0)) / any_value(s."end" - s.start), 6) AS removed_share
          FROM spans s LEFT JOIN edl e ON e.rec_id = s.rec_id AND e.start < s."end" AND e."end" > s.start GROUP BY s.rec_id""",
        "keyframe_method": f"""WITH RECURSIVE {_EDL}, {_KEY} SELECT rec_id, range_ord, round(start, 6) AS start, round("end", 6) AS "end", round(distance, 6) AS distance, CASE WHEN distance <= 2.0 THEN 'copy' ELSE 'reencode' END AS method FROM cuts""",
        "render_plan": f"""WITH RECURSIVE {_EDL}, {_KEY} SELECT rec_id, range_ord, 'clip_' || lpad(CAST(range_ord AS VARCHAR), 4, '0') || '.mp4' AS clip, CASE WHEN distance <= 2.0 THEN 'copy' ELSE 'reencode' END AS method,
            round(start, 6) AS start, round(greatest("end" - start, 0.0), 6) AS duration, CASE WHEN count(*) OVER (PARTITION BY rec_id) = 1 THEN 'copyfile' ELSE 'concat' END AS join_by,
            printf('%.3f', start) AS start_text, printf('%.3f', greatest("end" - start, 0.0)) AS duration_text FROM cuts""",
        "caption_cues": f"WITH {_CUES} SELECT * FROM cues",
        "json3_cues": f"WITH {_CUES} SELECT * REPLACE ('SPEAKER' AS speaker) FROM cues",
        "strip_tags": "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages",
        "segment_batches": f"WITH {_TURNS} SELECT rec_id, seg_ord, seg_ord // 40 AS chunk_id, CAST(seg_ord % 40 AS INTEGER) AS pos FROM turns",
        "judgments_valid": f"""WITH {_TURNS}, b AS (SELECT rec_id, seg_ord // 40 AS chunk_id, count(*) AS n_segments FROM turns GROUP BY ALL)
          SELECT *, CASE (rec_id + chunk_id) % 6 WHEN 3 THEN 'truncated' WHEN 4 THEN 'malformed' WHEN 5 THEN 'wrong_count' ELSE 'ok' END AS outcome FROM b""",
        "media_gate": """WITH p AS (SELECT p_partkey AS rec_id, p_retailprice AS v, p_retailprice + (p_partkey % 7 - 3) * 0.4::DOUBLE AS a, p_partkey % 5 AS kind FROM part),
          d AS (SELECT *, CASE kind WHEN 1 THEN round(v * 1000) / 1000 ELSE v END AS vd, CASE kind WHEN 1 THEN round(a * 1000) / 1000 WHEN 3 THEN v WHEN 4 THEN NULL ELSE a END AS ad FROM p)
          SELECT rec_id, CASE WHEN kind = 4 OR abs(vd - ad) > 1.0 THEN 'skipped_desync' ELSE 'ok' END AS status,
            CASE WHEN kind = 4 THEN 'no audio stream' WHEN abs(vd - ad) > 1.0 THEN 'streams drift' END AS reason,
            round(CASE WHEN kind = 4 OR abs(vd - ad) > 1.0 THEN NULL ELSE v END, 6) AS duration, round(vd, 6) AS video_duration, round(ad, 6) AS audio_duration FROM d""",
        "source_choice": """SELECT c_custkey AS rec_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'uploaded_transcript'
            WHEN c_custkey % 2 = 0 AND c_custkey % 7 <> 0 THEN 'youtube_captions' ELSE 'asr' END AS source FROM customer""",
        "track_choice": """WITH t AS (SELECT o_custkey AS rec_id, o_orderkey AS key, ['en','en-US','en_GB','fr','eng'][o_orderkey % 5 + 1] AS lang, o_orderkey // 32 % 2 = 1 AS manual,
            CASE WHEN o_orderkey % 3 = 0 THEN 'json3' ELSE 'vtt' END AS ext, 'u' || o_orderkey AS url FROM orders)
          SELECT rec_id, lang, ext, url, manual FROM t WHERE lang IN ('en', 'en-US', 'en_GB') QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY manual DESC, key) = 1""",
        "job_latest": f"WITH {_JOBS} SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1",
        "stage_progress": f"""WITH {_JOBS} SELECT job_id, status, current, total, round(100.0::DOUBLE * current / nullif(total, 0)) AS percent FROM log
          QUALIFY row_number() OVER (PARTITION BY job_id, status ORDER BY seq DESC) = 1""",
    }
    sql |= {
        "nested_edl": f"""WITH RECURSIVE {_EDL} SELECT e.rec_id, CAST(to_json(list({{'start': round(start, 6), 'end': round("end", 6)}} ORDER BY range_ord)) AS VARCHAR) AS ranges, round(any_value(duration), 6) AS source_duration
          FROM edl e JOIN recordings r USING (rec_id) GROUP BY e.rec_id""",
        "batch_payload": f"""WITH {_TURNS} SELECT rec_id, seg_ord // 40 AS chunk_id, count(*) AS n_segments,
            CAST(to_json(list({{'speaker': speaker, 'start': start, 'end': "end", 'text': text, 'overlap_candidate': false}} ORDER BY seg_ord)) AS VARCHAR) AS payload FROM turns GROUP BY ALL""",
        "sentences": f'WITH RECURSIVE {_CUES}, {_sentences("cues")} SELECT rec_id, seg_ord, speaker, round(start, 6) AS start, round("end", 6) AS "end", text, false AS overlap_candidate FROM sentences',
        "sentence_flags": f"""WITH RECURSIVE {_CUES}, later AS (SELECT * REPLACE ("end" + 9.0 AS "end") FROM cues), {_sentences("later")},
          f AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(start < lag("end") OVER w AND speaker <> lag(speaker) OVER w, false) OR coalesce(lead(start) OVER w < "end" AND lead(speaker) OVER w <> speaker, false) AS flag
            FROM sentences WINDOW w AS (PARTITION BY rec_id ORDER BY start, seg_ord))
          SELECT a.rec_id, a.seg_ord, a.flag AS identity, b.flag AS position FROM f a JOIN f b ON a.rec_id = b.rec_id AND b.place = a.seg_ord""",
        "checked_edl": f"""WITH RECURSIVE {_EDL.replace('UNION ALL SELECT -1, 10.0)', 'UNION ALL SELECT -1, 10.0), long AS (SELECT * FROM recordings), shortened AS (SELECT rec_id, CASE WHEN rec_id % 6 = 5 THEN -1.0 ELSE duration END AS duration FROM recordings)').replace('FROM recordings r LEFT JOIN solid', 'FROM shortened r LEFT JOIN solid')},
          k AS (SELECT *, "end" <= start OR coalesce(start < lag("end") OVER (PARTITION BY rec_id ORDER BY range_ord), false) AS bad FROM edl)
          SELECT rec_id, CASE WHEN bool_or(bad) THEN count(*) FILTER (WHERE bad) ELSE count(*) END AS n, CASE WHEN bool_or(bad) THEN 'not sound' ELSE 'sound' END AS state FROM k GROUP BY rec_id""",
        "stage_board": f"""WITH {_JOBS}, told AS (SELECT *, list_position({_STAGES}, status) - 1 AS place FROM log WHERE list_contains({_STAGES}, status)),
          e AS (SELECT *, coalesce(place <> lag(place) OVER (PARTITION BY job_id ORDER BY ts, seq), true) AS entered FROM told),
          l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1),
          b AS (SELECT job_id, CAST(s AS INTEGER) AS stage_ord, {_STAGES}[s + 1] AS stage, CASE WHEN s < place OR (s = place AND place = 6) THEN 'done' WHEN s = place THEN 'active' ELSE 'waiting' END AS state,
            CASE WHEN s = place AND NOT entered THEN current ELSE 0 END AS current, CASE WHEN s = place AND NOT entered THEN total ELSE 0 END AS total FROM l, range(7) r(s))
          SELECT *, round(100.0::DOUBLE * current / nullif(total, 0)) AS percent FROM b""",
        "job_defaults": """SELECT c_custkey AS rec_id, CASE c_custkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'deciding' ELSE 'queued' END AS status, CASE WHEN c_custkey % 5 = 0 THEN 'youtube_captions' ELSE 'asr' END AS transcript_source,
            CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS progress_current, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 2 ELSE 0 END AS progress_total FROM customer""",
        "job_lookup": f"""WITH {_NEW_JOBS}, asked AS (SELECT o_custkey AS rec_id FROM orders UNION SELECT -p_partkey FROM part)
          SELECT a.rec_id, CASE WHEN j.rec_id IS NULL THEN 'not_found' WHEN status = 'done' THEN 'done' ELSE 'not_done' END AS answer, CASE WHEN status = 'done' THEN c_name END AS result
          FROM asked a LEFT JOIN jobs j USING (rec_id) LEFT JOIN customer c ON c_custkey = a.rec_id""",
        "url_gate": f"WITH {_NEW_JOBS} SELECT rec_id, has_url AS accepted FROM jobs",
        "mode_gate": f"WITH {_NEW_JOBS} SELECT rec_id, mode, coalesce(mode IN ('crosstalk', 'highlights'), false) AS accepted FROM jobs",
        "mode_instructions": f"""WITH {_NEW_JOBS}, texts(mode, instructions) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in judging.INSTRUCTIONS.items())}) SELECT rec_id, mode, instructions FROM jobs JOIN texts USING (mode)""",
        "mode_summary": f"""WITH RECURSIVE {_EDL}, {_MODED}, one AS (SELECT rec_id, count(*) AS n, round(sum("end" - start), 6) AS kept, round(any_value(duration) - sum("end" - start), 6) AS removed, round(max("end" - start), 6) AS longest FROM recordings r JOIN edl e USING (rec_id) GROUP BY rec_id)
          SELECT mode, count(*) AS n_recordings, CAST(sum(n) AS BIGINT) AS n_ranges, round(sum(kept), 6) AS kept_s, round(sum(removed), 6) AS removed_s, round(max(longest), 6) AS longest_s, round(sum(removed) / nullif(sum(kept) + sum(removed), 0), 6) AS removed_share FROM one JOIN moded USING (rec_id) GROUP BY mode""",
        "file_gate": """WITH p AS (SELECT c_custkey AS rec_id, 'in.v1/' || c_name || ['.mp4', '.MKV', '.mov', '.vtt', '.Srt', '.txt', ''][c_custkey % 7 + 1] AS path FROM customer)
          SELECT *, CASE WHEN rec_id % 7 < 3 THEN 'video' WHEN rec_id % 7 < 5 THEN 'transcript' ELSE 'rejected' END AS kind FROM p""",
        "first_files": """SELECT c_custkey // 7 AS rec_id, min('in.v1/' || c_name || ['.mp4', '.MKV', '.mov', '.vtt', '.Srt', '.txt', ''][c_custkey % 7 + 1]) AS path FROM customer GROUP BY ALL""",
        "concat_lists": f"""WITH RECURSIVE {_EDL} SELECT rec_id, string_agg('file ''clip_' || lpad(CAST(range_ord AS VARCHAR), 4, '0') || '.mp4''', chr(10) ORDER BY range_ord) AS list FROM edl GROUP BY rec_id""",
        "usable_files": f"WITH {_CUES} SELECT rec_id, CASE WHEN rec_id % 7 = 0 THEN 0 ELSE count(*) END AS n_cues, CASE WHEN rec_id % 7 = 0 THEN 'no transcript' END AS reason FROM cues GROUP BY rec_id",
        "aligned_words": f"""WITH {_TOK} SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY turn * 20000 + k * 250, turn, k) - 1 AS ord, word, (turn * 20000 + k * 250) / 1000.0::DOUBLE AS start,
            (turn * 20000 + k * 250 + 200) / 1000.0::DOUBLE AS "end", CASE WHEN k % 7 <> 6 THEN speaker ELSE 'UNKNOWN' END AS speaker FROM tok WHERE k % 11 <> 10""",
        "keyframe_times": "SELECT p_partkey AS rec_id, unnest([0.0::DOUBLE, p_size::DOUBLE, p_partkey + 0.5::DOUBLE]) AS t FROM part",
        "best_transcripts": f"""WITH {_WORDS}, {_CUES}, {_MODED}, c AS (SELECT rec_id, CASE WHEN rec_id < 0 THEN 'no transcript' WHEN rec_id % 3 = 0 THEN 'uploaded_transcript' WHEN rec_id % 2 = 0 THEN 'youtube_captions'
              WHEN rec_id % 5 <> 4 THEN 'asr' ELSE 'no transcript' END AS source FROM moded)
          SELECT rec_id, ord, word, CASE source WHEN 'youtube_captions' THEN 'SPEAKER' ELSE speaker END AS speaker, source FROM c JOIN cues USING (rec_id) WHERE source IN ('uploaded_transcript', 'youtube_captions')
          UNION ALL SELECT rec_id, ord, word, speaker, source FROM c JOIN words USING (rec_id) WHERE source = 'asr'
          UNION ALL SELECT rec_id, NULL, NULL, NULL, source FROM c WHERE source = 'no transcript'""",
        "highlight_status": f"""WITH {_MODED} SELECT rec_id, CASE WHEN rec_id < 0 THEN 'failed' WHEN rec_id % 8 = 7 THEN 'skipped_desync' WHEN mode = 'summary' OR silent THEN 'failed' ELSE 'done' END AS status,
            CASE WHEN rec_id < 0 THEN 'no probe' WHEN rec_id % 8 = 7 THEN 'streams drift' WHEN mode = 'summary' THEN 'unknown mode' WHEN silent THEN 'no transcript' END AS reason,
            CASE WHEN rec_id < 0 OR rec_id % 8 = 7 OR mode = 'summary' OR silent THEN NULL WHEN rec_id % 3 = 0 THEN 'uploaded_transcript' WHEN rec_id % 2 = 0 THEN 'youtube_captions' ELSE 'asr' END AS source
          FROM (SELECT *, rec_id % 3 <> 0 AND rec_id % 2 <> 0 AND rec_id % 5 = 4 AS silent FROM moded)""",
    }
    wide = """wide AS (SELECT rec_id, seg_ord AS range_ord, start - 30.0 AS start, "end" + 30.0 AS "end" FROM decisions WHERE decision = 'keep' AND seg_ord % 3 = 0)"""
    sql |= {
        "words_in_ranges": f"""WITH {_DECISIONS}, {wide} SELECT w.rec_id, w.ord, r.range_ord FROM words w JOIN wide r ON r.rec_id = w.rec_id AND w.start >= r.start AND w."end" <= r."end\"""",
        "remap_any": f"""WITH {_DECISIONS}, {wide}, off AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY rec_id ORDER BY range_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS o FROM wide)
          SELECT w.rec_id, w.ord, r.range_ord, round((w.start - r.start) + o, 6) AS start, round((w."end" - r.start) + o, 6) AS "end" FROM words w JOIN off r ON r.rec_id = w.rec_id AND w.start >= r.start AND w."end" <= r."end\"""",
        "event_overlaps": f"""WITH {_RANGES}, e AS (SELECT r.*, event_type FROM ranges r JOIN events ON event_id = range_ord)
          SELECT a.rec_id, a.range_ord AS purchase, b.range_ord AS view, round(least(a."end", b."end") - greatest(a.start, b.start), 6) AS shared
          FROM e a JOIN e b ON a.rec_id = b.rec_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND least(a."end", b."end") > greatest(a.start, b.start)""",
    }
    sql |= {
        "judged": f"""WITH {_TURNS} SELECT rec_id, seg_ord, round(start, 6) AS start, round("end", 6) AS "end", CASE WHEN length(text) % 2 = 1 THEN 'remove' ELSE 'keep' END AS decision, NULL AS outcome
            FROM turns WHERE rec_id % 11 <> 5 UNION ALL SELECT DISTINCT rec_id, NULL, NULL, NULL, NULL, 'api_error' FROM turns WHERE rec_id % 11 = 5""",
        "highlight_clean": f"""WITH RECURSIVE {_job("(rec_id * 7 + seg_ord * 3) % 5 > 1")} SELECT rec_id, count(*) AS n_words, round(max(last), 6) AS last_end FROM clean GROUP BY rec_id""",
        "highlight_judged": f"""WITH RECURSIVE {_job("length(text) % 2 = 0", "rec_id % 11 <> 5")}, told AS ({sql["highlight_status"]}), c AS (SELECT rec_id, count(*) AS n_words, round(max(last), 6) AS last_end FROM clean GROUP BY rec_id)
            SELECT t.rec_id, CASE WHEN status = 'done' AND t.rec_id % 11 = 5 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'done' AND t.rec_id % 11 = 5 THEN 'judgment: api_error' ELSE reason END AS reason,
              source, n_words, last_end FROM told t LEFT JOIN c USING (rec_id)""",
    }
    sql |= {
        "stream_ranges": sql["merge_gaps"], "stream_jobs": sql["job_latest"],
        "transcript_docs": f"""WITH {_WORDS} SELECT rec_id, CAST(to_json(list({{'word': word, 'start': start, 'end': "end", 'speaker': speaker, 'overlap_candidate': false}} ORDER BY ord)) AS VARCHAR) AS words FROM words GROUP BY rec_id""",
    }
    sql["speaker_turns"] = f"""WITH {_TURNS}, f AS ({_FLAGS}) SELECT t.* FROM (SELECT *, false AS overlap_candidate FROM turns) t"""
    return sql
