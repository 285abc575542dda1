import json

import pandas as pd
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.operators import highlights, jobs
from cueweave.sources import results, subtitles


def test_board(spark):
    rows = [
        (1, 1, "queued", 0, 0), (1, 2, "transcribing", 9, 10), (1, 3, "deciding", 0, 0), (1, 4, "deciding", 3, 8),
        (2, 5, "slicing", 4, 4), (2, 6, "done", 4, 4), (3, 7, "deciding", 5, 10), (3, 8, "failed", 0, 0), (4, 9, "slicing", 2, 4), (4, 10, "slicing", 1, 0),
    ]
    events = spark.createDataFrame(rows, "job_id long, seq long, status string, current long, total long").withColumn("ts", F.timestamp_seconds("seq"))
    board = {(r.job_id, r.stage): (r.state, r.current, r.total, r.percent) for r in jobs.stage_board(events).collect()}
    assert len(board) == 4 * len(jobs.STAGES)
    assert board[1, "transcribing"] == ("done", 0, 0, None) and board[1, "deciding"] == ("active", 3, 8, 38.0) and board[1, "slicing"] == ("waiting", 0, 0, None)
    assert board[2, "done"][0] == "done" and board[3, "deciding"] == ("active", 0, 0, None) and board[4, "slicing"] == ("active", 1, 0, None)


def test_look_up_defaults_and_addresses(spark):
    kind = "rec_id long, status string, transcript_source string, progress_current long, source_url string, mode string"
    table = spark.createDataFrame([(1, "done", None, 5, " u ", None), (2, "deciding", "x", None, "\u2003", None), (3, None, None, None, None, "m")], kind)
    asked = spark.createDataFrame([(1,), (2,), (3,), (9,), (9,), (None,)], "rec_id long")
    answers, rows = jobs.look_up(asked, table, spark.createDataFrame([(1, "r"), (2, "half"), (9, "z")], "rec_id long, result string"))
    assert {r.rec_id: r.answer for r in answers.collect()} == {1: "done", 2: "not_done", 3: "not_done", 9: "not_found", None: "not_found"}
    assert [tuple(r) for r in rows.collect()] == [(1, "r")]
    got = {r.rec_id: r for r in jobs.job_defaults(table).collect()}
    assert (got[3].status, got[3].transcript_source, got[3].progress_current, got[3].mode) == ("queued", "asr", 0, "m") and got[1].mode is None and got[2].transcript_source == "x"
    good, bad = jobs.with_url(table)
    assert [r.rec_id for r in good.collect()] == [1] and sorted(r.rec_id for r in bad.collect()) == [2, 3]


def test_files(spark, tmp_path):
    good = "1\n00:00:01,000 --> 00:00:02,000\nZo\u00eb: caf\u00e9\n"
    (tmp_path / "a.SRT").write_bytes(good.encode() + b"\n\n00:00:03,000 --> 00:00:04,000\nbad \xff byte\n")
    (tmp_path / "b.vtt").write_text("nothing timed")
    (tmp_path / "c.vtt").write_bytes(b"\n")
    (tmp_path / "d.txt").write_text(good)
    files = subtitles.read_subtitles(spark, str(tmp_path))
    cues, unusable = subtitles.load_transcripts(files)
    name = {r.rec_id: r.path.rsplit("/", 1)[1] for r in files.collect()}
    assert sorted(name.values()) == ["a.SRT", "b.vtt", "c.vtt"]
    assert [(name[r.rec_id], r.ord, r.speaker, r.word) for r in cues.orderBy("ord").collect()] == [("a.SRT", 0, "Zo\u00eb", "caf\u00e9"), ("a.SRT", 1, "SPEAKER", "bad \ufffd byte")]
    assert sorted((name[r.rec_id], r.reason) for r in unusable.collect()) == [("b.vtt", "no transcript"), ("c.vtt", "no transcript")]


def test_keyframes_and_aligned_speech(spark):
    files = spark.createDataFrame([(1, "0.0\n\n 2.5 \nN/A\nx"), (2, ""), (3, None)], "rec_id long, text string")
    assert sorted(tuple(r) for r in subtitles.parse_keyframes(files).collect()) == [(1, 0.0), (1, 2.5)]
    word = lambda w, s, e, p: {"word": w, "start": s, "end": e, "speaker": p}
    rows = [(1, [{"words": [word("b", 2.0, 3.0, "P"), word("x", None, 1.0, "P")]}, {"words": [word("a", 1.0, 2.0, None), word("c", 2.0, 2.5, "Q")]}]), (2, [])]
    got = subtitles.parse_aligned(spark.createDataFrame(rows, "rec_id long, " + schemas.ALIGNED))
    assert [(r.ord, r.word, r.speaker) for r in got.orderBy("ord").collect()] == [(0, "a", "UNKNOWN"), (1, "b", "P"), (2, "c", "Q")]


def test_documents_round_trip(spark, tmp_path):
    words = spark.createDataFrame([(1, 1, "b \"q\"", 1.25, 2.0, "B", True), (1, 0, "a", 0.0, 1.0, "A", False), (2, 0, "c", 0.1, 0.2, None, False)], schemas.WORDS)
    results.write_transcripts(words, str(tmp_path / "t"))
    assert sorted(map(tuple, results.read_transcripts(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, words.collect()))
    ranges = spark.createDataFrame([(1, 1, 4.0, 5.5), (1, 0, 0.0, 2.0), (3, 0, 0.0, 1.0)], schemas.RANGES)
    recordings = spark.createDataFrame([(1, 9.0), (3, 1.0)], schemas.RECORDINGS)
    results.write_edls(ranges, recordings, str(tmp_path / "e"))
    back, lengths = results.read_edls(spark, str(tmp_path / "e"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ranges.collect())) and sorted(map(tuple, lengths.collect())) == [(1, 9.0), (3, 1.0)]


def corpus(spark):
    probe = lambda drift: json.dumps({"format": {"duration": "60"}, "streams": [{"codec_type": "video", "duration": "60"}, {"codec_type": "audio", "duration": str(60 + drift)}]})
    wanted = spark.createDataFrame([(1, "highlights"), (2, "crosstalk"), (3, "crosstalk"), (4, "other"), (5, "highlights"), (6, "highlights"), (7, "highlights")], "rec_id long, mode string")
    probes = spark.createDataFrame([(i, probe(5 if i == 3 else 0)) for i in (1, 2, 3, 4, 5, 7)], "rec_id long, json string")
    cue = lambda rec, *said: [(rec, i, w, s, e, p, False) for i, (w, s, e, p) in enumerate(said)]
    sources = {
        "uploaded_transcript": cue(1, ("First part. Drop it", 0.0, 8.0, "A"), ("now. Last part.", 8.0, 16.0, "A")) + cue(3, ("x", 0.0, 1.0, "A")),
        "youtube_captions": cue(1, ("never read", 0.0, 1.0, "A")) + cue(7, ("only this.", 2.0, 4.0, "S")),
        "asr": cue(2, ("hi", 0.0, 1.0, "A"), ("drop", 0.5, 2.0, "B"), ("bye", 3.0, 4.0, "A")) + cue(1, ("nor this", 0.0, 1.0, "A")),
    }
    keys = spark.createDataFrame([(1, 0.0), (2, 3.1)], "rec_id long, t double")
    return wanted, probes, {k: spark.createDataFrame(v, schemas.WORDS) for k, v in sources.items()}, keys


def test_whole_job_by_rule(spark):
    got = highlights.highlight_corpus(*corpus(spark), keep=~F.lower("text").contains("drop"))
    status = {r.rec_id: (r.status, r.reason, r.source) for r in got["status"].collect()}
    assert status == {
        1: ("done", None, "uploaded_transcript"), 2: ("done", None, "asr"), 3: ("skipped_desync", "streams drift", None), 4: ("failed", "unknown mode", None),
        5: ("failed", "no transcript", None), 6: ("failed", "no probe", None), 7: ("done", None, "youtube_captions"),
    }
    assert sorted((r.rec_id, r.start, r.end) for r in got["edl"].collect()) == [(1, 0.0, 4.0), (1, 8 + 8 / 3, 16.0), (2, 0.0, 2.0), (2, 3.0, 4.0), (7, 2.0, 4.0)]  # "drop" begins inside "hi", so its end goes along
    assert sorted((r.rec_id, r.word, r.start) for r in got["clean"].collect()) == [(1, "First part.", 0.0), (1, "Last part.", 4.0), (2, "bye", 2.0), (2, "drop", 0.5), (2, "hi", 0.0), (7, "only this.", 0.0)]
    assert sorted((r.rec_id, r.range_ord, r.method) for r in got["plan"].collect()) == [(1, 0, "copy"), (1, 1, "reencode"), (2, 0, "reencode"), (2, 1, "copy"), (7, 0, "reencode")]
    assert [r.overlap_candidate for r in got["segments"].filter("rec_id = 2").orderBy("seg_ord").collect()] == [True, True, False]


def test_whole_job_by_a_model_that_fails_for_one(spark):
    def model(frame):
        out = []
        for r in frame.itertuples():
            answer = "no" if r.rec_id == 2 else json.dumps([{"start": x["start"], "end": x["end"], "decision": "keep" if r.mode == "highlights" else "remove"} for x in json.loads(r.payload)])
            out.append((r.rec_id, r.chunk_id, r.part, answer, "STOP", None))
        return pd.DataFrame(out, columns=["rec_id", "chunk_id", "part", "raw", "finish_reason", "error_code"])

    got = highlights.highlight_corpus(*corpus(spark), fn=model)
    status = {r.rec_id: (r.status, r.reason) for r in got["status"].collect()}
    assert status[2] == ("failed", "judgment: malformed") and status[1] == status[7] == ("done", None)
    assert {r.rec_id for r in got["clean"].collect()} == {r.rec_id for r in got["decisions"].collect()} == {1, 7}


def test_steps_that_several_tables_share_are_made_once(spark, monkeypatch):
    """Ranges, gate and jobs are written once; what reads them does not make them again."""
    labels = []
    for module in (highlights, highlights.intervals):
        made = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, label, made=made: labels.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or made(df, label))
    got = highlights.highlight_corpus(*corpus(spark), keep=~F.lower("text").contains("drop"))
    plans = dict(labels)
    assert [sum(label == x for label, _ in labels) for x in ("ranges", "gate", "wanted")] == [1, 1, 1]
    assert "collect_list" in plans["ranges"] and not any("collect_list" in plans[x] or "Generate" in plans[x] for x in ("edl", "status"))
    assert "from_json" in plans["gate"] and "from_json" not in plans["jobs"] + plans["status"] + plans["transcripts"]
    assert {r.rec_id for r in got["violations"].collect()}.isdisjoint(r.rec_id for r in got["edl"].collect())
