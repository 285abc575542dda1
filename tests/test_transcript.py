import json
import random

import pytest

from cueweave import schemas
from cueweave.operators import judging, reports, transcript
from cueweave.sources import media, subtitles
from cueweave.streaming import streams


def words(spark, rows):
    return spark.createDataFrame([(1, i, w, float(s), float(e), p, False) for i, (w, s, e, p) in enumerate(rows)], schemas.WORDS)


def test_overlap_flags(spark):
    rows = [("one", 0, 2, "P"), ("two", 1.5, 1.75, "Q"), ("three", 1.75, 3, "Q"), ("four", 2.5, 4, "Q"), ("five", 4, 5, "P"), ("six", 4.5, 6, "Q")]
    got = [r.overlap_candidate for r in transcript.flag_overlaps(words(spark, rows)).orderBy("ord").collect()]
    # "three" overlaps "one", but they are not neighbours; "four" and "five" only touch.
    assert got == [True, True, False, False, True, True]


def test_turns_against_a_plain_loop(spark):
    rng, rows, want = random.Random(11), [], []
    for rec in range(30):
        own = sorted((rng.randrange(60) / 4, i) for i in range(rng.randrange(1, 15)))
        said = [(rec, i, f"w{i}", t, t + rng.randrange(1, 9) / 4, rng.choice(["P", "Q", None]), rng.random() < 0.2) for t, i in own]
        rows += said
        turns = []
        for r in said:
            if turns and turns[-1][-1][5] == r[5]:
                turns[-1].append(r)
            else:
                turns.append([r])
        want += [(rec, k, t[0][5], t[0][3], t[-1][4], " ".join(r[2] for r in t), any(r[6] for r in t)) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    for seconds in (None, 2.0):
        got = transcript.speaker_turns(spark.createDataFrame(rows, schemas.WORDS), seconds)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == want


def test_remap_against_a_plain_loop(spark):
    rng, words_, ranges, want, cut = random.Random(12), [], [], [], []
    for rec in range(25):
        edges = sorted(rng.sample(range(120), 2 * rng.randrange(1, 6)))
        mine = [(edges[i] / 4, edges[i + 1] / 4) for i in range(0, len(edges), 2)]
        ranges += [(rec, k, *r) for k, r in enumerate(mine)]
        for i in range(20):
            start = rng.randrange(120) / 4
            word = (rec, i, f"w{i}", start, start + rng.randrange(0, 8) / 4, "A", False)
            words_.append(word)
            inside = [k for k, (s, e) in enumerate(mine) if s <= start and word[4] <= e]
            offset = sum(e - s for s, e in mine[: inside[0]]) - mine[inside[0]][0] if inside else None
            if inside:
                want.append((rec, i, start + offset, word[4] + offset))
            else:
                cut.append((rec, i))
    w, r = spark.createDataFrame(words_, schemas.WORDS), spark.createDataFrame(ranges, schemas.RANGES)
    assert sorted((x.rec_id, x.ord, x.start, x.end) for x in transcript.remap_words(w, r).collect()) == want
    assert sorted((x.rec_id, x.ord) for x in transcript.cut_words(w, r).collect()) == cut


def sentence_ends(tokens):
    """Where sentences end: from each beginning, the nearest of all places at which one is due.
    Tokens are (text, cue, place, size) and cues (text, start, end, speaker)."""
    n, ends, first = len(tokens), [], 0
    stops = [i for i in range(n) if tokens[i][0][-1] in ".!?"]
    turns = [i for i in range(n - 1) if tokens[i][1][3] != tokens[i + 1][1][3]]
    while first < n:
        due = [n - 1, first + 39, *[i for i in stops if i >= first][:1], *[i for i in turns if i >= first][:1]]
        due += [i for i in range(first, n) if tokens[i][1][2] - tokens[first][1][1] >= 20.0][:1]
        ends.append(min(due))
        first = ends[-1] + 1
    return ends


def test_sentences_end_where_one_is_due(spark):
    rng, rows, want = random.Random(1), [], []
    for rec in range(40):
        cues, at = [], 0.0
        for _ in range(rng.randrange(1, 12)):
            text = " ".join(rng.choice(["a", "b", "c.", "d", "e!"] if rng.random() < 0.6 else ["x"]) for _ in range(rng.randrange(1, 25)))
            cues.append((text, at, at + rng.choice([1.0, 3.0, 25.0]), rng.choice("AB")))
            at += rng.choice([1.0, 4.0])
        rows += [(rec, i, c[0], c[1], c[2], c[3], False) for i, c in enumerate(cues)]
        tokens = [(t, c, i, len(c[0].split())) for c in cues for i, t in enumerate(c[0].split())]
        first = 0
        for number, last in enumerate(sentence_ends(tokens)):
            (_, c, i, n), (_, d, j, m) = tokens[first], tokens[last]
            start, end = c[1] + (i / n) * (c[2] - c[1]), d[1] + ((j + 1) / m) * (d[2] - d[1])
            want.append((rec, number, c[3], start, max(start, end), " ".join(t[0] for t in tokens[first : last + 1])))
            first = last + 1
    got = transcript.sentences(spark.createDataFrame(rows, schemas.WORDS))
    assert sorted((r.rec_id, r.seg_ord, r.speaker, r.start, r.end, r.text) for r in got.collect()) == want


def test_subtitles(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\n<v Jane>Hello <b>there</b></v>\n\nnote\n\n00:00:03.000 --> 00:00:04.000\nZoë B: hi\nyou\n\n00:00:05.000 --> 00:00:05.000\nempty\n"
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\nplain\r\n"
    files = spark.createDataFrame([(1, vtt), (2, srt), (3, "garbage"), (4, "")], "rec_id long, text string")
    got = [(r.rec_id, r.ord, r.word, r.start, r.end, r.speaker) for r in subtitles.parse_subtitles(files).orderBy("rec_id", "ord").collect()]
    assert got == [(1, 0, "Hello there", 1.0, 2.5, "Jane"), (1, 1, "hi you", 3.0, 4.0, "Zoë B"), (2, 0, "plain", 1.0, 2.0, "SPEAKER")]


def test_tracks(spark):
    rows = [
        (1, [("en", [("vtt", "m")])], [("en", [("json3", "a")])]),
        (2, [], [("en-US", [("vtt", "v"), ("json3", "j")])]),
        (3, [("fr", [("json3", "f")])], [("eng", [("json3", "x")])]),
    ]
    got = subtitles.pick_track(spark.createDataFrame(rows, f"rec_id long, manual {schemas.TRACKS}, automatic {schemas.TRACKS}"))
    assert sorted((r.rec_id, r.url) for r in got.collect()) == [(1, "m"), (2, "j")]


def test_media_gate(spark):
    def doc(v, a, duration="100"):
        streams = [{"codec_type": "video", **v}] + ([{"codec_type": "audio", **a}] if a is not None else [])
        return json.dumps({"format": {"duration": duration}, "streams": streams})

    rows = [
        (1, doc({"duration": "100"}, {"duration": "100.2"})), (2, doc({"duration": "100"}, {"duration": "105"})), (3, doc({"duration": "100"}, None)),
        (4, doc({"duration_ts": "100000", "time_base": "1/1000"}, {"duration_ts": "1", "time_base": "1/0"})), (5, doc({"tags": {"DURATION": "00:01:40.5"}}, {"tags": {"DURATION": "00:01:50"}})),
    ]
    got = {r.rec_id: r.status for r in media.media_gate(spark.createDataFrame(rows, "rec_id long, json string")).collect()}
    assert got == {1: "ok", 2: "skipped_desync", 3: "skipped_desync", 4: "ok", 5: "skipped_desync"}


def test_judging_splits_and_fails(spark):
    import pandas as pd

    rows = [(rec, i, "A", float(i), float(i + 1), "bad" if rec == 2 and i == 1 else "t", False) for rec in (1, 2) for i in range(5)]
    segments = spark.createDataFrame(rows, schemas.SEGMENTS)

    def model(frame):
        out = []
        for r in frame.itertuples():
            items = json.loads(r.payload)
            if len(items) > 2:
                raw, why = r.payload[:20], "MAX_TOKENS"
            elif any(x["text"] == "bad" for x in items):
                raw, why = "nonsense", "STOP"
            else:
                raw, why = json.dumps([{"start": x["start"], "end": x["end"], "decision": "keep"} for x in items]), "STOP"
            out.append((r.rec_id, r.chunk_id, r.part, raw, why, None))
        return pd.DataFrame(out, columns=["rec_id", "chunk_id", "part", "raw", "finish_reason", "error_code"])

    decisions, failed = judging.judge(segments, model, batch_size=4)
    assert sorted((r.rec_id, r.seg_ord, r.start) for r in decisions.collect()) == [(1, i, float(i)) for i in range(5)]
    assert [(r.rec_id, r.outcome) for r in failed.collect()] == [(2, "malformed")]


def test_judging_without_answers_and_with_modes(spark):
    import pandas as pd

    rows = [(rec, i, "A", float(i), float(i + 1), "t", False, ("crosstalk", "highlights")[rec % 2]) for rec in (1, 2, 3) for i in range(3)]
    segments = spark.createDataFrame(rows, schemas.SEGMENTS + ", mode string")

    def model(frame):
        assert set(zip(frame["mode"], frame["instructions"])) <= set(judging.INSTRUCTIONS.items())
        out = []
        for r in frame.itertuples():
            items = json.loads(r.payload)
            if r.rec_id == 2 or (r.rec_id == 3 and not r.note):
                continue  # never an answer, or none to the first question
            answer = json.dumps([{"start": x["start"], "end": x["end"], "decision": "keep"} for x in items])
            out += [(r.rec_id, r.chunk_id, r.part, answer, "STOP", None)] * 2
        return pd.DataFrame(out, columns=["rec_id", "chunk_id", "part", "raw", "finish_reason", "error_code"])

    decisions, failed = judging.judge(segments, model, batch_size=2)
    assert sorted((r.rec_id, r.seg_ord) for r in decisions.collect()) == [(rec, i) for rec in (1, 3) for i in range(3)]
    assert [(r.rec_id, r.outcome) for r in failed.collect()] == [(2, "api_error")]
    with pytest.raises(ValueError, match="unknown mode"):
        judging.judge(segments.drop("mode"), model, mode="other")
    none, lost = judging.judge(segments.limit(0), model)
    assert none.isEmpty() and lost.isEmpty()


def test_modes(spark):
    jobs = spark.createDataFrame([(1, "crosstalk"), (2, "Crosstalk"), (3, None)], "rec_id long, mode string")
    good, bad = judging.require_mode(jobs)
    assert [r.rec_id for r in good.collect()] == [1] and sorted(r.rec_id for r in bad.collect()) == [2, 3]
    assert [r.instructions for r in judging.with_instructions(jobs).collect()] == [judging.INSTRUCTIONS["crosstalk"]]
    with pytest.raises(Exception, match="unknown mode"):
        judging.require_mode(jobs, strict=True)[0].collect()


def test_keyframes(spark):
    ranges = spark.createDataFrame([(1, 0, 1.0, 3.0), (1, 1, 7.5, 9.0), (2, 0, 0.0, 1.0)], schemas.RANGES)
    keys = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 10.0)], "rec_id long, t double")
    got = {(r.rec_id, r.range_ord): (r.distance, r.method) for r in reports.keyframe_method(ranges, keys).collect()}
    assert got == {(1, 0): (1.0, "copy"), (1, 1): (2.5, "reencode"), (2, 0): (float("inf"), "reencode")}


@pytest.mark.parametrize(("gap", "want"), [(0.0, {(0, 8), (9, 10)}), (1.5, {(0, 10)}), (1.0, {(0, 8), (9, 10)})])
def test_coalesce_stream(spark, tmp_path, gap, want):
    rows = "(values (0, 5.0), (2, 1.0), (5, 3.0), (9, 1.0), (999999, 1.0)) v(s, seconds)"
    spark.sql(f"select 1L rec_id, timestamp_seconds(s) ts, cast(seconds as double) seconds from {rows}").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("rec_id long, ts timestamp, seconds double").parquet(str(tmp_path / "in"))
    merged = streams.coalesce_stream(source, gap)
    query = merged.writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(int(r.start.timestamp()), int(r.end.timestamp())) for r in spark.table("merged").collect()} == want


def test_job_stream_keeps_the_latest_state(spark, tmp_path):
    kind = "job_id long, seq long, ts timestamp, status string"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = [[(1, 1, 1, "queued"), (2, 2, 2, "queued")], [(1, 4, 4, "done"), (1, 3, 3, "slicing")], [(3, 5, 5, "queued"), (2, 6, 6, "failed")], [(1, 4, 4, "done")]]
    for rows in batches:
        values = ", ".join(f"({j}L, {q}L, timestamp_seconds({t}), '{s}')" for j, q, t, s in rows)
        spark.sql(f"select * from values {values} v(job_id, seq, ts, status)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.upsert_jobs(source, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.job_id: (r.seq, r.status) for r in streams.read_jobs(spark, str(tmp_path / "out"), kind).collect()}
    assert got == {1: (4, "done"), 2: (6, "failed"), 3: (5, "queued")}


def test_arriving_caption_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nB: one\n")
    files = streams.subtitle_blocks(spark, str(tmp_path / "in"))
    for text in ("", "1\n00:00:03,500 --> 00:00:04,000\ntwo words\n"):
        (tmp_path / "in" / f"f{len(text)}.srt").write_text(text)
        streams.write_cues(files, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.word, r.start, r.speaker) for r in got.collect()) == [("one", 1.0, "B"), ("two words", 3.5, "SPEAKER")]


def test_groups_come_whole_and_many_at_once():
    import pyarrow as pa

    rec, block = [1] * 5 + [1] * 3 + [2] * 4 + [None] * 2, [0] * 5 + [1] * 3 + [0] * 4 + [0] * 2
    table = pa.table({"rec_id": pa.array(rec, pa.int64()), "block": pa.array(block, pa.int64()), "x": list(range(14))})
    for size in (1, 2, 3, 6, 14):
        got = list(transcript.whole_groups(iter(table.to_batches(max_chunksize=size))))
        assert [x for t in got for x in t.column("x").to_pylist()] == list(range(14))
        keys = [set(zip(t.column("rec_id").to_pylist(), t.column("block").to_pylist(), strict=True)) for t in got]
        assert sum(map(len, keys)) == 4 and len(set().union(*keys)) == 4
    assert len(list(transcript.whole_groups(iter(table.to_batches())))) == 2  # the last group may go on in another batch
