"""State that streams keep, look-ups that open few files, exact decimals, and how calls are dealt."""

import json
import random
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.functions.storage import materialise, shared_dir
from cueweave.functions.text import three_decimals
from cueweave.operators import intervals, judging
from cueweave.sources import results
from cueweave.streaming import streams
from cueweave.streaming.state import BucketedTable

JOBS = "job_id long, seq long, ts timestamp, status string"


def files(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = BucketedTable(str(tmp_path / "t"), "k long, v long", "k", 8)
    newest = lambda df: df.groupBy("k").agg({"v": "max"}).toDF("k", "v")
    state, seen = {}, []
    for epoch, rows in enumerate([[(i, i) for i in range(40)], [(3, 99), (7, 1)], [], [(3, 50), (100, 5)], [(3, 120)]]):
        batch = spark.createDataFrame(rows, "k long, v long")
        before = files(tmp_path / "t" / "data") if epoch else {}
        table.fold(batch, epoch, newest)
        for k, v in rows:
            state[k] = max(v, state.get(k, v))
        assert {r.k: r.v for r in table.read(spark).collect()} == state
        after = files(tmp_path / "t" / "data")
        changed = {f for f in after if before.get(f) != after[f]}
        assert not epoch or len({f.split("bucket=")[1].split("/")[0] for f in changed}) <= len(rows)
        seen.append(after)
    table.fold(spark.createDataFrame([(3, 10**6)], "k long, v long"), 4, newest)  # the epoch comes again
    assert files(tmp_path / "t" / "data") == seen[-1] and {r.k: r.v for r in table.read(spark).collect()} == state
    assert len(seen[-1]) <= 16


def test_late_ranges_amend_what_is_there(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(5), s / 4, s / 4 + rng.randrange(0, 12) / 4) for s in (rng.randrange(400) for _ in range(200))]
    rng.shuffle(rows)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(streams.MERGED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for at in range(0, 200, 70):
        spark.createDataFrame(rows[at : at + 70], streams.MERGED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for gap, name in ((0.0, "touch"), (0.5, "near")):
            streams.upsert_ranges(source, str(tmp_path / name), str(tmp_path / f"c-{name}"), gap, buckets=4).trigger(availableNow=True).start().awaitTermination(120)
    whole = spark.createDataFrame(rows, streams.MERGED)
    assert sorted(streams.read_ranges(spark, str(tmp_path / "touch")).collect()) == sorted(intervals.coalesce_ranges(whole).collect())
    assert sorted(streams.read_ranges(spark, str(tmp_path / "near")).collect()) == sorted(intervals.merge_small_gaps(whole, 0.5).collect())


def test_few_identifiers_open_few_files(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id as rec_id", "concat('r', id) as result")
    results.write_lookup(rows.unionByName(rows.limit(3)), str(tmp_path / "r"), buckets=16)
    assert sorted(r.result for r in results.look_up_few(spark, str(tmp_path / "r"), [7, 4000, 99999, None], buckets=16).collect()) == ["r4000", "r7"]
    held = results.look_up_few(spark, str(tmp_path / "r"), [7], buckets=16)
    place = held.selectExpr("pmod(xxhash64(rec_id), 16) as b").first().b
    for f in (tmp_path / "r").rglob("*.parquet"):
        if f"__bucket={place}/" not in str(f):
            f.write_bytes(b"not to be opened")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    spark.catalog.clearCache()
    schema = "rec_id long, result string, __bucket int"
    again = spark.read.schema(schema).parquet(str(tmp_path / "r")).filter(f"__bucket = {place} and rec_id = 7")
    assert [r.result for r in again.collect()] == ["r7"] == [r.result for r in held.collect()]


def test_three_decimals_equal_those_of_exact_values(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0005, 2.0015, 0.0005, 0.0015, 0.0625, 0.1875, 0.3125, -0.0625, 0.9995, 0.99949999999999994, 1e-310, -1e-9, 1e15 + 0.125, 123456789.0005, float("nan"), float("inf"), float("-inf"), 4503599627370495.5, 9e18]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 12) for _ in range(4000)] + [k / 16 for k in range(-400, 400)] + [(2 * k + 1) / 2000 for k in range(2000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", three_decimals(F.col("x")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: f"{x:.3f}" for i, x in enumerate(xs)}
    assert Decimal(1.0005) < Decimal("1.0005") and f"{1.0005:.3f}" == "1.000"
    assert spark.createDataFrame([(1e19,), (None,)], "x double").select(three_decimals(F.col("x")).alias("t")).distinct().collect()[0].t is None


def test_calls_are_dealt_evenly(spark, tmp_path):
    segments = spark.createDataFrame([(rec, i, "A", float(i), i + 1.0, "t", False) for rec in range(4) for i in range(300 if rec == 0 else 20)], schemas.SEGMENTS)
    folder = str(tmp_path)

    def model(frame):
        with open(f"{folder}/calls-{TaskContext.get().partitionId()}", "a") as out:  # a note of who was asked
            out.write(f"{len(frame)}\n")
        rows = [(r.rec_id, r.chunk_id, r.part, json.dumps([{"start": x["start"], "end": x["end"], "decision": "keep"} for x in json.loads(r.payload)]), "STOP", None) for r in frame.itertuples()]
        return pd.DataFrame(rows, columns=["rec_id", "chunk_id", "part", "raw", "finish_reason", "error_code"])

    decisions, failed = judging.judge(segments, model, batch_size=5, tasks=6, batches_per_call=2)
    assert decisions.count() == 360 and failed.isEmpty()
    calls = {f.name: [int(n) for n in f.read_text().split()] for f in tmp_path.glob("calls-*")}
    assert len(calls) == 6 and max(map(sum, calls.values())) <= 14 and sum(map(sum, calls.values())) == 72 and max(map(max, calls.values())) == 2


def test_calls_under_way_at_once():
    import threading
    import time

    most, now, lock = [0], [0], threading.Lock()

    def fn(frame):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return frame

    frames = [pd.DataFrame({"x": range(7)}), pd.DataFrame({"x": []}), pd.DataFrame({"x": range(5)})]
    out = list(judging.in_turn(fn, iter(frames), 2, 3))
    assert [len(f) for f in out] == [2, 2, 2, 1, 2, 2, 1] and most[0] == 3


def test_answers_of_many_calls_are_handed_on_together():
    frames = [pd.DataFrame({"x": range(4)}) for _ in range(100)] + [pd.DataFrame({"x": []})]
    out = list(judging.gathered(judging.in_turn(lambda f: f, iter(frames), 4, 2), 256))
    assert [len(f) for f in out] == [256, 144] and [x for f in out for x in f["x"]] == [*range(4)] * 100


def test_waves_do_not_group_segments_again(spark):
    segments = spark.createDataFrame([(1, i, "A", float(i), i + 1.0, "t", False) for i in range(9)], schemas.SEGMENTS)

    def model(frame):
        rows = [(r.rec_id, r.chunk_id, r.part, json.dumps([{"start": x["start"], "end": x["end"], "decision": "keep"} for x in json.loads(r.payload)]), "MAX_TOKENS" if r.n_segments > 2 else "STOP", None) for r in frame.itertuples()]
        return pd.DataFrame([(*r[:3], r[3][:9] if r[4] == "MAX_TOKENS" else r[3], *r[4:]) for r in rows], columns=["rec_id", "chunk_id", "part", "raw", "finish_reason", "error_code"])

    written = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("judge-*")}
    before = written()
    decisions, failed = judging.judge(segments, model, batch_size=9, tasks=2)
    assert Counter(n.rsplit("-", 1)[0] for n in written() - before) == {"judge-segments": 1, "judge-answers": 4, "judge-checked": 4}
    assert sorted((r.seg_ord, r.start) for r in decisions.collect()) == [(i, float(i)) for i in range(9)] and failed.isEmpty()


def test_answers_meet_their_questions_without_a_join(spark, monkeypatch):
    """Every wave's answers come with their segments; the first of several answers counts, foreign ones do not."""
    segments = spark.createDataFrame([(rec, i, "A", float(i), i + 1.0, "t", False) for rec in range(3) for i in range(30)], schemas.SEGMENTS)
    plans = []

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return materialise(df, label)

    def model(frame):
        answer = lambda r, decision: json.dumps([{"start": x["start"], "end": x["end"], "decision": decision} for x in json.loads(r.payload)])
        rows = [(r.rec_id, r.chunk_id, r.part, answer(r, decision), "STOP", None) for r in frame.itertuples() if r.note or r.chunk_id % 2 for decision in ("keep", "remove")]
        return pd.DataFrame([*rows, (99, 0, "", "[]", "STOP", None)], columns=["rec_id", "chunk_id", "part", "raw", "finish_reason", "error_code"])

    monkeypatch.setattr(judging, "materialise", noted)
    decisions, failed = judging.judge(segments, model, batch_size=4, tasks=2, batches_per_call=3, in_flight=2)
    assert sorted((r.rec_id, r.seg_ord, r.start, r.decision) for r in decisions.collect()) == [(rec, i, float(i), "keep") for rec in range(3) for i in range(30)] and failed.isEmpty()
    waves = [plan for label, plan in plans if label in ("judge-answers", "judge-checked")]
    assert len(waves) == 4 and not any("SortMerge" in p or "Join LeftOuter" in p or "Aggregate" in p for p in waves)
    assert max(p.count("JsonToStructs") + p.count("from_json") for p in waves) == 1
