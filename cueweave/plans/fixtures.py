"""Working tables derived from the given ones; all times begin as whole ms or us."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueweave.functions.columns import once
from cueweave.functions.storage import materialise
from cueweave.functions.text import tokens
from cueweave.operators import transcript
from cueweave.operators.judging import batches

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._words, self._turns, self._cues = spark, sf_dir, None, None, None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tok(self) -> DataFrame:
        t = self.table("conversations")
        # Whole texts move to their recording, not their words.
        t = t.select(F.col("conv_id").alias("rec_id"), "turn", F.col("role").alias("speaker"), "text").repartition("rec_id")
        t = once(t, l=tokens(F.col("text"))).drop("text")
        return t.select("rec_id", "turn", "speaker", F.size("l").alias("n"), F.posexplode("l").alias("k", "word"))

    def words(self) -> DataFrame:
        """Made and written once."""
        if self._words is None:
            self._words = materialise(self._made_words(), "fixture-words")
        return self._words

    def _made_words(self) -> DataFrame:
        s = F.col("turn") * 20000 + F.col("k") * 250
        t = self.tok().withColumn("s_ms", s).withColumn("e_ms", s + 200 + (F.col("k") % 3) * 50)
        order = Window.partitionBy("rec_id").orderBy("s_ms", "turn", "k")
        return t.select("rec_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), "word", (F.col("s_ms") / F.lit(1000.0)).alias("start"), (F.col("e_ms") / F.lit(1000.0)).alias("end"), "speaker", F.lit(False).alias("overlap_candidate"))

    def cues(self) -> DataFrame:
        """Made and written once."""
        if self._cues is None:
            self._cues = materialise(self._made_cues(), "fixture-cues")
        return self._cues

    def _made_cues(self) -> DataFrame:
        t = self.table("conversations")
        t = once(t.select(F.col("conv_id").alias("rec_id"), "turn", F.col("role").alias("speaker"), "text"), l=tokens(F.col("text"))).drop("text").filter("size(l) > 0")
        order = Window.partitionBy("rec_id").orderBy("turn")
        start = F.col("turn") * 10000
        return t.select("rec_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), F.array_join("l", " ").alias("word"), (start / F.lit(1000.0)).alias("start"), ((start + F.size("l") * 80) / F.lit(1000.0)).alias("end"), "speaker", F.lit(False).alias("overlap_candidate"))

    def event_ranges(self, events: DataFrame | None = None) -> DataFrame:
        events = self.table("events") if events is None else events
        s = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US  # sessions run in UTC
        e = s + F.round(F.col("value") * 100).cast("long") * 6000000
        return events.select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("range_ord"), (s / F.lit(1e6)).alias("start"), (e / F.lit(1e6)).alias("end"))

    def turns(self) -> DataFrame:
        """Made and written once."""
        if self._turns is None:
            self._turns = materialise(transcript.speaker_turns(self.words()), "fixture-turns")
        return self._turns

    def decisions(self) -> DataFrame:
        t = self.turns()
        rule = ((F.col("rec_id") * 7 + F.col("seg_ord") * 3) % 5).isin(0, 1)
        return t.select("rec_id", "seg_ord", F.round(F.col("start") + 0.1, 3).alias("start"), F.round(F.col("end") - 0.05, 3).alias("end"), F.when(rule, "remove").otherwise("keep").alias("decision"), F.lit("r").alias("reason"))

    def recordings(self) -> DataFrame:
        r = self.words().groupBy("rec_id").agg((F.max("end") + 1.0).alias("duration"))
        return r.unionByName(self.spark.range(1).select(F.lit(-1).cast("long").alias("rec_id"), F.lit(10.0).alias("duration")))

    def subtitle_files(self) -> DataFrame:
        c = self.cues()
        srt = F.col("rec_id") % 5 == 0

        def clock(name: str):
            ms = F.round(F.col(name) * 1000).cast("long")
            text = F.format_string("%02d:%02d:%02d", F.expr(f"cast(round({name} * 1000) as long) div 3600000"), (F.floor(ms / 60000) % 60), (F.floor(ms / 1000) % 60))
            return F.concat(text, F.when(srt, ",").otherwise("."), F.format_string("%03d", ms % 1000))

        body = F.when(F.col("rec_id") % 2 == 0, F.concat(F.lit("<v "), "speaker", F.lit(">"), "word", F.lit("</v>"))).otherwise(F.concat("speaker", F.lit(": "), "word"))
        block = F.concat(F.when(srt, F.concat((F.col("ord") + 1).cast("string"), F.lit("\n"))).otherwise(""), clock("start"), F.lit(" --> "), clock("end"), F.lit("\n"), body)
        listed = c.select("rec_id", "ord", block.alias("b")).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("ord", "b"))).alias("l"))
        head = F.when(F.col("rec_id") % 5 == 0, "").otherwise("WEBVTT\n\n")
        files = listed.select("rec_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("text"))
        return files.repartition(self.spark.sparkContext.defaultParallelism)  # few bytes, but costly to parse

    def keyframes(self) -> DataFrame:
        r = self.recordings().filter("rec_id % 10 <> 0").select("rec_id")
        return r.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(195), F.lit(5)))).select("rec_id", F.col("t").cast("double").alias("t"))

    def json3_files(self) -> DataFrame:
        half = F.floor(F.length("word") / 2).cast("int")
        whole = F.array(F.struct(F.col("word").alias("utf8")))
        split = F.array(F.struct(F.substring("word", F.lit(1), half).alias("utf8")), F.struct(F.substr("word", half + 1).alias("utf8")))
        s = F.round(F.col("start") * 1000).cast("long")
        event = F.struct(s.alias("tStartMs"), (F.round(F.col("end") * 1000).cast("long") - s).alias("dDurationMs"), F.when(F.col("ord") % 3 == 2, split).otherwise(whole).alias("segs"))
        listed = self.cues().groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("ord", event.alias("e")))).alias("l"))
        return listed.select("rec_id", F.to_json(F.struct(F.transform("l", lambda x: x["e"]).alias("events"))).alias("json"))

    def probes(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("rec_id"), F.col("p_retailprice").alias("v"), (F.col("p_retailprice") + (F.col("p_partkey") % 7 - 3) * 0.4).alias("a"), (F.col("p_partkey") % 5).alias("kind"))

        def stream(name: str, value: str):
            hms = F.format_string("%02d:%02d:%.6f", F.floor(F.col(value) / 3600).cast("int"), (F.floor(F.col(value) / 60) % 60).cast("int"), F.col(value) % 60)
            return F.struct(
                F.lit(name).alias("codec_type"), F.when(F.col("kind") == 0, F.col(value).cast("string")).alias("duration"),
                F.when(F.col("kind") == 1, F.round(F.col(value) * 1000).cast("long").cast("string")).alias("duration_ts"), F.when(F.col("kind") == 1, "1/1000").alias("time_base"),
                F.when(F.col("kind") == 2, F.create_map(F.lit("DURATION"), hms)).alias("tags"),
            )

        streams = F.when(F.col("kind") == 4, F.array(stream("video", "v"))).otherwise(F.array(stream("video", "v"), stream("audio", "a")))
        doc = F.struct(F.struct(F.col("v").cast("string").alias("duration")).alias("format"), streams.alias("streams"))
        return p.select("rec_id", F.to_json(doc).alias("json"))

    def responses(self) -> DataFrame:
        b = batches(self.turns())
        item = F.struct("pos", "start", "end")
        g = b.groupBy("rec_id", "chunk_id").agg(F.array_sort(F.collect_list(item)).alias("l")).withColumn("n_segments", F.size("l").cast("long"))
        kind = (F.col("rec_id") + F.col("chunk_id")) % 6
        full = F.transform("l", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when((kind == 4) & (i == 0), F.lit(None).cast("string")).otherwise("keep").alias("decision"), F.lit("r").alias("reason")))
        raw = F.to_json(F.when(kind == 5, F.slice(full, 1, F.col("n_segments").cast("int") - 1)).otherwise(full))
        cut = F.when(kind == 3, F.substring(raw, F.lit(1), F.floor(F.length(raw) / 2).cast("int"))).otherwise(raw)
        return g.select("rec_id", "chunk_id", "n_segments", cut.alias("raw"), F.when(kind == 3, "MAX_TOKENS").otherwise("STOP").alias("finish_reason"), F.lit(None).cast("int").alias("error_code"))

    def source_candidates(self) -> DataFrame:
        c = self.table("customer").select(F.col("c_custkey").alias("rec_id"))
        up = c.filter("rec_id % 3 = 0").select("rec_id", F.lit("uploaded_transcript").alias("source"), (F.col("rec_id") % 5 != 0).alias("usable"))
        url = c.filter("rec_id % 2 = 0").select("rec_id", F.lit("youtube_captions").alias("source"), (F.col("rec_id") % 7 != 0).alias("usable"))
        return up.unionByName(url).unionByName(c.select("rec_id", F.lit("asr").alias("source"), F.lit(True).alias("usable")))

    def files(self) -> DataFrame:
        """Paths with suffixes of several kinds."""
        suffix = F.element_at(F.array(*map(F.lit, (".mp4", ".MKV", ".mov", ".vtt", ".Srt", ".txt", ""))), (F.col("c_custkey") % 7 + 1).cast("int"))
        return self.table("customer").select(F.col("c_custkey").alias("rec_id"), F.concat(F.lit("in.v1/"), "c_name", suffix).alias("path"))

    def aligned(self) -> DataFrame:
        """Aligned speech, a segment for each turn: every 11th word has no end, every 7th no speaker."""
        s = F.col("turn") * 20000 + F.col("k") * 250
        t = self.tok().withColumn("w", F.struct("word", (s / F.lit(1000.0)).alias("start"), F.when(F.col("k") % 11 != 10, (s + 200) / F.lit(1000.0)).alias("end"), F.when(F.col("k") % 7 != 6, F.col("speaker")).alias("speaker")))
        turns = t.groupBy("rec_id", "turn").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("l"))
        turns = turns.select("rec_id", "turn", F.struct(F.transform("l", lambda x: x["w"]).alias("words")).alias("s"))
        listed = turns.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s"))).alias("l"))
        return listed.select("rec_id", F.transform("l", lambda x: x["s"]).alias("segments"))

    def keyframe_files(self) -> DataFrame:
        """A time on each line, between blank lines and lines that are no times."""
        return self.table("part").select(F.col("p_partkey").alias("rec_id"), F.concat_ws("\n", F.lit("0.0"), F.lit(" "), F.concat(F.lit("  "), F.col("p_size").cast("string")), F.lit("N/A"), F.concat(F.col("p_partkey").cast("string"), F.lit(".5"))).alias("text"))

    def broken_subtitle_files(self) -> DataFrame:
        """Caption files of which every seventh holds no cue."""
        return self.subtitle_files().withColumn("text", F.when(F.col("rec_id") % 7 == 0, "WEBVTT\n\nno cue here").otherwise(F.col("text")))

    def jobs(self) -> DataFrame:
        """New jobs as their senders fill them in."""
        c = self.table("customer").select(F.col("c_custkey").alias("rec_id"))
        k = F.col("rec_id")
        return c.select(
            "rec_id", F.when(k % 4 == 0, "crosstalk").when(k % 4 == 1, "highlights").when(k % 4 == 2, "summary").alias("mode"), F.when(k % 3 == 0, "done").when(k % 3 == 1, "deciding").alias("status"),
            F.when(k % 5 == 0, "youtube_captions").alias("transcript_source"), F.when(k % 2 == 0, k).alias("progress_current"), F.when(k % 2 == 0, k * 2).alias("progress_total"),
            F.when(k % 6 == 0, "\u00a0 \t").when(k % 6 == 1, "").when(k % 6 != 2, F.concat(F.lit(" https://example.com/"), k.cast("string"))).alias("source_url"),
        )

    def asked(self) -> DataFrame:
        """Identifiers of jobs, some of which no job has."""
        return self.table("orders").select(F.col("o_custkey").alias("rec_id")).unionByName(self.table("part").select((-F.col("p_partkey")).alias("rec_id")))

    def sourced(self) -> dict[str, DataFrame]:
        """Transcripts of the conversations by source; some recordings have none."""
        return {
            "uploaded_transcript": self.cues().filter("rec_id % 3 = 0"), "youtube_captions": self.cues().filter("rec_id % 2 = 0").withColumn("speaker", F.lit("SPEAKER")),
            "asr": self.words().filter("rec_id % 5 <> 4"),
        }

    def moded(self) -> DataFrame:
        """A job for each conversation, and ten for recordings that nobody has heard."""
        r = self.table("conversations").select(F.col("conv_id").alias("rec_id")).distinct()
        r = r.unionByName(r.filter("rec_id % 10 = 0").select((-F.col("rec_id") - 2).alias("rec_id")))
        return r.withColumn("mode", F.when(F.col("rec_id") % 9 == 0, "summary").when(F.col("rec_id") % 2 == 0, "crosstalk").otherwise("highlights"))

    def conversation_probes(self) -> DataFrame:
        """A probe for each conversation's recording; every eighth has drifted."""
        v = F.col("rec_id") * 10 + 2000.0
        stream = lambda kind, value: F.struct(F.lit(kind).alias("codec_type"), value.cast("string").alias("duration"))
        doc = F.struct(F.struct(v.cast("string").alias("duration")).alias("format"), F.array(stream("video", v), stream("audio", v + F.when(F.col("rec_id") % 8 == 7, 3.0).otherwise(0.25))).alias("streams"))
        return self.moded().filter("rec_id >= 0").select("rec_id", F.to_json(doc).alias("json"))

    def tracks(self) -> DataFrame:
        """A catalogue of tracks for each customer: one for each of its orders."""
        o = self.table("orders").select(F.col("o_custkey").alias("rec_id"), F.col("o_orderkey").alias("key"))
        lang = F.element_at(F.array(*map(F.lit, ("en", "en-US", "en_GB", "fr", "eng"))), (F.col("key") % 5 + 1).cast("int"))
        o = o.select("rec_id", "key", lang.alias("lang"), (F.floor(F.col("key") / 32) % 2 == 1).alias("manual"), F.when(F.col("key") % 3 == 0, "json3").otherwise("vtt").alias("ext"), F.concat(F.lit("u"), F.col("key").cast("string")).alias("url"))

        def side(flag):
            t = o.filter(flag).select("rec_id", F.struct("key", "lang", F.array(F.struct("ext", "url")).alias("entries")).alias("t"))
            g = t.groupBy("rec_id").agg(F.array_sort(F.collect_list("t")).alias("l"))
            return g.select("rec_id", F.transform("l", lambda x: F.struct(x["lang"].alias("lang"), x["entries"].alias("entries"))).alias("l"))

        a, b = side(F.col("manual")).withColumnRenamed("l", "manual"), side(~F.col("manual")).withColumnRenamed("l", "automatic")
        return a.join(b, "rec_id", "full")

    def arriving(self, name: str) -> DataFrame:
        """A given table as a stream.  A stream takes a folder or a pattern, and the table may be one file."""
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.dir}/{name}.parque[t]")

    def job_events(self, events: DataFrame | None = None) -> DataFrame:
        events = self.table("events") if events is None else events
        status = F.create_map(*[F.lit(x) for p in {"signup": "queued", "view": "transcribing", "click": "deciding", "purchase": "slicing", "error": "failed"}.items() for x in p])
        return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.coalesce(status[F.col("event_type")], F.lit("queued")).alias("status"), (F.col("event_id") % 50).alias("current"), F.lit(50).cast("long").alias("total"))
