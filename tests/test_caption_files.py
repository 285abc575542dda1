"""The caption data source: the same rows in batch and as a stream, empty files among them."""

import os

from cueweave.sources import caption_files as source
from cueweave.sources import subtitles


def test_batch_and_stream_give_the_same_rows(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nB: one\n")
    (folder / "empty.srt").write_bytes(b"")
    (folder / "deep" / "b.SRT").write_bytes("1\n00:00:01,000 --> 00:00:02,000\ncafé \n".encode() + b"\xff")
    (folder / "c.txt").write_text("not a caption file")
    (folder / "_d.vtt").write_text("hidden")
    for f in folder.rglob("*"):
        os.utime(f, (1, 1))
    want = {("a.vtt", 46), ("empty.srt", 0), ("b.SRT", 38)}
    files = source.caption_files(spark, str(folder))
    name = lambda p: p.rsplit("/", 1)[1]
    rows = {(name(r.path), r.text) for r in files.collect()}
    assert {n for n, _ in rows} == {n for n, _ in want} and ("empty.srt", "") in rows
    assert [t for n, t in rows if n == "b.SRT"][0].endswith("�")
    cues, unusable = subtitles.load_transcripts(files)
    ids = {r.rec_id: name(r.path) for r in files.collect()}
    assert {ids[r.rec_id] for r in cues.collect()} == {"a.vtt", "b.SRT"} and [ids[r.rec_id] for r in unusable.collect()] == ["empty.srt"]

    def drain():
        stream = source.caption_files(spark, f"file://{folder}", stream=True)
        write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={epoch}")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted((name(r.path), r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert drain() == sorted(rows)
    (folder / "late.vtt").write_text("")
    os.utime(folder / "late.vtt", (2, 2))
    assert drain() == sorted([*rows, ("late.vtt", "")])


def test_tasks_are_bounded(tmp_path):
    class Info:
        def __init__(self, i, size):
            self.path, self.size = str(i), size

    dealt = source._dealt([Info(i, 10 << 20) for i in range(10)] + [Info(i, 0) for i in range(2500)])
    assert [len(d.paths) for d in dealt[:3]] == [3, 3, 3] and max(len(d.paths) for d in dealt) <= source.FILES_PER_TASK and sum(len(d.paths) for d in dealt) == 2510
    assert [d.paths for d in source._dealt([])] == [[]] and source._listed(str(tmp_path / "none")) == []
