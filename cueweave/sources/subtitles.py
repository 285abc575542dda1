"""Caption files, caption documents and aligned transcripts as tables of cues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.functions import text as T
from cueweave.functions.columns import once

VIDEO_SUFFIXES = (".mp4", ".mkv", ".mov")
TRANSCRIPT_SUFFIXES = (".vtt", ".srt")
DEFAULT_SPEAKER = "SPEAKER"


def with_suffix(files: DataFrame, suffixes: tuple[str, ...], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files by their lower-cased suffix."""
    good = F.coalesce(F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*suffixes), F.lit(False))
    return files.filter(good), files.filter(~good)


def read_subtitles(spark: SparkSession, folder: str) -> DataFrame:
    """(rec_id, path, text) of the caption files in a folder; bad bytes are replaced.

    rec_id is a hash of the path.  Spark passes over files of no bytes, so those have no row.
    """
    files = spark.read.format("binaryFile").load(folder)
    accepted, _ = with_suffix(files, TRANSCRIPT_SUFFIXES)
    return accepted.select(F.xxhash64("path").alias("rec_id"), "path", F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def first_files(files: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, path): of several files for one key the first by name."""
    return files.groupBy(key).agg(F.min("path").alias("path"))


def load_transcripts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, unusable) of (rec_id, text) files: files that give no cue are rows of ``unusable``
    (rec_id, reason), never an error."""
    cues = parse_subtitles(files)
    unusable = files.select("rec_id").join(cues.select("rec_id").distinct(), "rec_id", "left_anti")
    return cues, unusable.select("rec_id", F.lit("no transcript").alias("reason"))


def _numbered(cues: DataFrame, tie: str) -> DataFrame:
    order = Window.partitionBy("rec_id").orderBy("start", tie)
    cues = cues.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))
    return cues.select("rec_id", "ord", "word", "start", "end", "speaker", F.lit(False).alias("overlap_candidate"))


def parse_subtitles(files: DataFrame, default_speaker: str = DEFAULT_SPEAKER) -> DataFrame:
    """Cues of (rec_id, text) files in WebVTT or SRT form.

    Blocks are split at blank lines; a block's first timing line counts, later lines
    are its content.  Blocks without timing, with an end not after the start or
    without content are left out.
    """
    blocks = files.select("rec_id", F.posexplode(F.split(T.trim_ws(F.col("text")), r"\r?\n\r?\n+")).alias("block", "body"))
    blocks = once(blocks.filter(F.col("body").rlike(T.TIMING)), lines=T.lines(F.col("body"))).drop("body")
    blocks = once(blocks, at=F.array_position(F.transform("lines", lambda x: x.rlike(T.TIMING)), F.lit(True)).cast("int")).filter("at > 0")
    rest = F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0)))
    blocks = once(blocks, clock=T.clock(F.get("lines", F.col("at") - 1)), content=rest)
    blocks = blocks.select("rec_id", "block", T.seconds(F.col("clock"), 0).alias("start"), T.seconds(F.col("clock"), 4).alias("end"), "content")
    blocks = blocks.filter((F.col("end") > F.col("start")) & (F.size("content") > 0))
    clean = F.filter(F.transform("content", lambda x: T.trim_ws(T.strip_tags(x))), lambda x: x != "")
    blocks = once(blocks, has_voice=F.col("content")[0].rlike(T.VOICE), voice=T.trim_ws(F.regexp_extract(F.col("content")[0], T.VOICE, 1)), clean=clean)
    blocks = once(blocks.filter(F.size("clean") > 0), named=~F.col("has_voice") & F.col("clean")[0].rlike(T.PREFIX))
    head = F.when(F.col("named"), T.trim_ws(F.regexp_extract(F.col("clean")[0], T.PREFIX, 2))).otherwise(F.col("clean")[0])
    speaker = F.when(F.col("has_voice"), F.col("voice")).when(F.col("named"), T.trim_ws(F.regexp_extract(F.col("clean")[0], T.PREFIX, 1))).otherwise(F.lit(default_speaker))
    said = F.filter(F.concat(F.array(head), F.slice("clean", 2, F.size("clean"))), lambda x: x != "")
    blocks = once(blocks, said=T.trim_ws(F.array_join(said, " ")))
    cues = blocks.select("rec_id", "block", "start", "end", speaker.alias("speaker"), F.col("said").alias("word"))
    return _numbered(cues.filter("word <> ''"), "block")


def parse_json3(documents: DataFrame, default_speaker: str = DEFAULT_SPEAKER) -> DataFrame:
    """Cues of (rec_id, json) caption documents."""
    events = documents.select("rec_id", F.posexplode(F.from_json("json", schemas.JSON3)["events"]).alias("at", "e"))
    word = T.trim_ws(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), "\n", " "))
    cues = events.filter("size(e.segs) > 0 and e.tStartMs is not null and e.dDurationMs is not null").select(
        "rec_id", "at", word.alias("word"), (F.col("e.tStartMs") / F.lit(1000.0)).alias("start"),
        ((F.col("e.tStartMs") + F.col("e.dDurationMs")) / F.lit(1000.0)).alias("end"), F.lit(default_speaker).alias("speaker"),
    )
    return _numbered(cues.filter("word <> '' and end > start"), "at")


def parse_aligned(documents: DataFrame) -> DataFrame:
    """Words of aligned speech-recognition results (rec_id, segments); untimed words are left out."""
    segments = documents.select("rec_id", F.posexplode("segments").alias("i", "s"))
    words = segments.select("rec_id", "i", F.posexplode("s.words").alias("j", "w"))
    words = words.select("rec_id", F.struct("i", "j").alias("at"), "w.word", "w.start", "w.end", F.coalesce("w.speaker", F.lit("UNKNOWN")).alias("speaker"))
    return _numbered(words.dropna(subset=["start", "end"]), "at")


def parse_keyframes(files: DataFrame) -> DataFrame:
    """(rec_id, t) of (rec_id, text) files with a time on each line; other lines are left out."""
    times = files.select("rec_id", F.explode(T.lines(F.col("text"))).alias("line")).select("rec_id", T.trim_ws(F.col("line")).try_cast("double").alias("t"))
    return times.filter("t is not null")


def pick_track(tracks: DataFrame) -> DataFrame:
    """The best English track of (rec_id, manual, automatic): manual ones first, then the
    catalogue's languages in order, json3 before vtt, entries in order."""

    def entries(name: str, rank: int) -> DataFrame:
        langs = tracks.select("rec_id", F.lit(rank).alias("kind"), F.posexplode(name).alias("lang_at", "t"))
        return langs.select("rec_id", "kind", "lang_at", F.col("t.lang").alias("lang"), F.posexplode("t.entries").alias("entry_at", "e"))

    found = entries("manual", 0).unionByName(entries("automatic", 1))
    found = found.filter(is_english(F.col("lang")) & F.col("e.ext").isin("json3", "vtt"))
    order = Window.partitionBy("rec_id").orderBy("kind", "lang_at", F.when(F.col("e.ext") == "json3", 0).otherwise(1), "entry_at")
    best = found.withColumn("n", F.row_number().over(order)).filter("n = 1")
    return best.select("rec_id", "lang", F.col("e.ext").alias("ext"), F.col("e.url").alias("url"), (F.col("kind") == 0).alias("manual"))


def is_english(lang: Column) -> Column:
    return (lang == "en") | lang.rlike("^en[-_]")


#: Where a transcript may come from, best first.
SOURCES = ("uploaded_transcript", "youtube_captions", "asr")


def choose_source(candidates: DataFrame) -> DataFrame:
    """(rec_id, source) of the first usable one of (rec_id, source, usable)."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(SOURCES) for x in (s, i)])
    usable = candidates.filter("usable").withColumn("rank", ranks[F.col("source")]).filter("rank is not null")
    return usable.groupBy("rec_id").agg(F.min_by("source", "rank").alias("source"))


def best_transcripts(wanted: DataFrame, transcripts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): of every wanted recording, the rows of its first source that has any.

    ``transcripts`` maps a source of SOURCES to its words or cues by rec_id.  A source is
    only read for recordings that no better one has.  Rows carry ``source``; recordings
    without any are ``rejected`` (rec_id, reason).
    """
    left, parts = wanted.select("rec_id").filter("rec_id is not null").distinct(), []
    for source in SOURCES:
        if source in transcripts:
            own = transcripts[source].join(left, "rec_id", "left_semi").withColumn("source", F.lit(source))
            left = left.join(transcripts[source].select("rec_id").distinct(), "rec_id", "left_anti")
            parts.append(own)
    return reduce(DataFrame.unionByName, parts), without_transcript(left)


def without_transcript(wanted: DataFrame, heard: DataFrame | None = None) -> DataFrame:
    """(rec_id, reason) of the wanted recordings that are not among the ``heard`` ones."""
    left = wanted.select("rec_id").filter("rec_id is not null").distinct()
    left = left if heard is None else left.join(heard, "rec_id", "left_anti")
    return left.select("rec_id", F.lit("no transcript").alias("reason"))
