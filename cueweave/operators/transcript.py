"""Transcripts: overlap flags, turns, sentences, re-timing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions import scan as S
from cueweave.functions.columns import once
from cueweave.functions.text import ends_sentence, tokens, trim_ws
from cueweave.operators.interval_join import contained
from cueweave.operators.intervals import BUCKET_RANGES, cut_lineage, word_at

MAX_WORDS, MAX_SECONDS = 40, 20.0
BLOCK_TOKENS, BUCKET_CUES = 16_384, 4096


def flag_overlaps(words: DataFrame, bucket_seconds: float | None = S.BUCKET_SECONDS) -> DataFrame:
    """Flag both words of an adjacent pair that overlap in time and differ in speaker."""
    seen = F.struct("start", "end", "speaker")
    near = S.scan(words, ["rec_id"], ["start", "ord"], S.by_time(seconds=bucket_seconds), __before=S.Before(seen), __after=S.After(seen))
    before = (F.col("start") < F.col("__before.end")) & (F.col("speaker") != F.col("__before.speaker"))
    after = (F.col("__after.start") < F.col("end")) & (F.col("__after.speaker") != F.col("speaker"))
    flag = F.col("overlap_candidate") | F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    return near.withColumn("overlap_candidate", flag).select(*words.columns)


def speaker_turns(words: DataFrame, bucket_seconds: float | None = S.BUCKET_SECONDS) -> DataFrame:
    """Runs of one speaker; the end is the last word's, not the latest."""
    marked = S.runs(words, ["rec_id"], "speaker", ["start", "ord"], S.by_time(seconds=bucket_seconds))
    place = F.struct("start", "ord")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "ord", "word"))), lambda x: x["word"]), " ")
    turns = marked.groupBy("rec_id", F.col("run").alias("seg_ord")).agg(
        F.min_by("speaker", place).alias("speaker"), F.min_by("start", place).alias("first"), F.max_by("end", place).alias("end"),
        trim_ws(said).alias("text"), F.bool_or("overlap_candidate").alias("overlap_candidate"),
    )
    return turns.select("rec_id", F.col("seg_ord").cast("long").alias("seg_ord"), "speaker", F.col("first").alias("start"), "end", "text", "overlap_candidate")


def segments_as_words(segments: DataFrame) -> DataFrame:
    return segments.select("rec_id", F.col("seg_ord").alias("ord"), F.col("text").alias("word"), "start", "end", "speaker", "overlap_candidate")


def group_starts(stop: np.ndarray, speaker: np.ndarray, known: np.ndarray, cue_start: np.ndarray, cue_end: np.ndarray, max_words: int, max_seconds: float) -> np.ndarray:
    """For each token, where the next sentence starts if one starts at this token."""
    n = len(stop)
    at = np.arange(n)
    hard = stop.copy()
    hard[:-1] |= known[:-1] & known[1:] & (speaker[:-1] != speaker[1:])
    ends = np.minimum.accumulate(np.where(hard, at, n + max_words)[::-1])[::-1]
    after = np.minimum(at + max_words, ends + 1)
    for k in range(min(max_words, n)):
        open_ = after[: n - k] > at[: n - k] + k + 1
        if not open_.any():
            break
        far = open_ & (cue_end[k:] - cue_start[: n - k] >= max_seconds)
        after[: n - k][far] = at[: n - k][far] + k + 1
    return after


def _block_columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    own = lambda c: table.column(c).combine_chunks()
    speaker = own("said_by")
    return own("stop").to_numpy(zero_copy_only=False), speaker.fill_null(0).to_numpy(), speaker.is_valid().to_numpy(zero_copy_only=False), own("cue_start").to_numpy(), own("cue_end").to_numpy()


def _block_exits(tokens_: DataFrame, max_words: int, max_seconds: float, size: int) -> DataFrame:
    """(rec_id, block, exits, counts): for each place at which a block's first sentence may
    start, the place in the next block, and the number of sentences that start in this one."""

    def exits(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        after = group_starts(*_block_columns(table), max_words, max_seconds).tolist()
        out, count = [0] * (size + max_words), [0] * (size + max_words)
        for p in range(min(len(after), size) - 1, -1, -1):
            q = after[p]
            out[p], count[p] = (q - size, 1) if q >= size else (out[q], count[q] + 1)
        return pa.table({"rec_id": [key[0].as_py()], "block": [key[1].as_py()], "exits": [out[:max_words]], "counts": [count[:max_words]]}, pa.schema([("rec_id", pa.int64()), ("block", pa.int64()), ("exits", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))

    return tokens_.groupBy("rec_id", "block").applyInArrow(exits, "rec_id long, block long, exits array<int>, counts array<int>")


def _block_entries(exits: DataFrame) -> DataFrame:
    """(rec_id, block, entry, number): where the first sentence of a block starts, and how
    many started before.  A recording has one short row for each block here."""

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        entry, number, rows = 0, 0, []
        for exits_, counts in zip(table.column("exits").to_pylist(), table.column("counts").to_pylist(), strict=True):
            rows.append((entry, number))
            entry, number = exits_[entry], number + counts[entry]
        return pa.table({"rec_id": table.column("rec_id"), "block": table.column("block"), "entry": pa.array([e for e, _ in rows], pa.int32()), "number": pa.array([n for _, n in rows], pa.int64())})

    return exits.groupBy("rec_id").applyInArrow(follow, "rec_id long, block long, entry int, number long")


def _group_edges(table: pa.Table) -> np.ndarray:
    """Where groups of equal (rec_id, block) begin, and the number of rows."""
    new = np.ones(table.num_rows + 1, bool)
    if table.num_rows:
        key = [table.column("rec_id").is_valid(), pc.fill_null(table.column("rec_id"), 0), table.column("block")]
        key = [np.asarray(k) for k in key]
        new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold all rows of their (rec_id, block)s."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = int(_group_edges(table)[-2]) if table.num_rows else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held


def _sentences_of(table: pa.Table, max_words: int, max_seconds: float, size: int) -> pa.Table:
    """The sentences that start in the blocks of ``table``, which are whole and in order."""
    told = table.filter(pc.is_null(table.column("pos")))
    entries = dict(zip(*[zip(*[told.column(c).to_pylist() for c in pair], strict=True) for pair in (("rec_id", "block"), ("entry", "number"))], strict=True))
    table = table.filter(pc.is_valid(table.column("pos")))
    edges = _group_edges(table)
    stop, *columns = _block_columns(table)
    stop = stop.copy()
    stop[edges[1:] - 1] = True  # the last token of a block
    after = group_starts(stop, *columns, max_words, max_seconds)
    follow, starts, numbers = after.tolist(), [], []
    keys = [table.column(c).take(pa.array(edges[:-1])).to_pylist() for c in ("rec_id", "block")] if entries else None
    for g, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        entry, number = entries.get((keys[0][g], keys[1][g]), (0, 0)) if entries else (0, 0)
        p, end = low + entry, min(high, low + size)
        while p < end:
            starts.append(p)
            numbers.append(number)
            number += 1
            p = follow[p]
    starts = np.array(starts, np.int64)
    ends = after[starts]
    lengths = ends - starts
    offsets = np.append(0, np.cumsum(lengths))
    own = lambda c, at: table.column(c).take(pa.array(at, pa.int64())).combine_chunks()
    words_ = own("token", np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words_), " ")
    begin, end = own("from", starts), own("to", ends - 1)
    return pa.table([own("rec_id", starts), pa.array(numbers, pa.int64()), own("speaker", starts), begin, pc.max_element_wise(begin, end), text], ["rec_id", "seg_ord", "speaker", "start", "end", "text"])


def sentences(cues: DataFrame, max_words: int = MAX_WORDS, max_seconds: float = MAX_SECONDS, block_tokens: int = BLOCK_TOKENS, bucket_cues: int = BUCKET_CUES) -> DataFrame:
    """Regroup cues into sentences with times interpolated inside cues.

    A sentence ends at a token that ends one, before another speaker, when it is full, and
    when a token's cue ends ``max_seconds`` after its first token's cue began: so where it
    ends depends on where it starts.  A recording's tokens are cut into blocks, each with
    the few tokens after it that its last sentence may take.  For recordings of more than
    a block, each block tells where the next one's first sentence starts for every place
    at which its own may start; these are followed from block to block.  So neither a
    recording nor a passage without punctuation has to lie in one task.
    """
    block_tokens = max(block_tokens, max_words)

    def dealt(some: DataFrame) -> DataFrame:
        said = once(some, list=tokens(F.col("word"))).withColumn("n", F.size("list").cast("long"))
        said = S.scan(said.drop("word"), ["rec_id"], ["ord"], F.floor(F.col("ord") / bucket_cues), upto=S.Sum("n"))
        token = said.select("rec_id", "speaker", F.xxhash64("speaker").alias("h"), F.col("start").alias("cue_start"), F.col("end").alias("cue_end"), "n", (F.col("upto") - F.col("n")).alias("before"), F.posexplode("list").alias("k", "token"))
        share = F.col("cue_end") - F.col("cue_start")
        at = lambda k: F.col("cue_start") + (k / F.col("n")) * share
        pos = F.col("before") + F.col("k")
        token = token.select(
            "rec_id", pos.alias("pos"), "speaker", F.when(F.col("speaker").isNotNull(), F.col("h")).alias("said_by"), "token", ends_sentence(F.col("token")).alias("stop"), "cue_start", "cue_end",
            F.when(F.col("n") <= 1, F.col("cue_start")).otherwise(at(F.col("k"))).alias("from"), F.when(F.col("n") <= 1, F.col("cue_end")).otherwise(at(F.col("k") + 1)).alias("to"),
        )
        block = F.floor(F.col("pos") / block_tokens).cast("long")
        ahead = (F.col("pos") % block_tokens < max_words) & (block > 0)
        return token.withColumn("block", F.explode(F.when(ahead, F.array(block, block - 1)).otherwise(F.array(block))))

    # A token and the blank before it are two characters at least.
    long = cues.groupBy("rec_id").agg(F.sum(F.length("word") + 1).alias("chars")).filter(F.col("chars") > 2 * block_tokens).select("rec_id")
    narrow = dealt(cues.join(long, "rec_id", "left_semi")).select("rec_id", "block", "pos", "said_by", "stop", "cue_start", "cue_end")
    entries = _block_entries(_block_exits(narrow, max_words, max_seconds, block_tokens))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            yield from _sentences_of(table, max_words, max_seconds, block_tokens).to_batches()

    # A block's entry comes as a row before its tokens.  Python takes many blocks at once: most recordings are short.
    rows = dealt(cues).unionByName(entries, allowMissingColumns=True).repartition("rec_id", "block").sortWithinPartitions("rec_id", "block", "pos")
    rows = rows.select("rec_id", "block", "pos", "speaker", "said_by", "token", "stop", "cue_start", "cue_end", "from", "to", "entry", "number")
    return rows.mapInArrow(group, "rec_id long, seg_ord long, speaker string, start double, end double, text string").withColumn("overlap_candidate", F.lit(False))


def flags_to_segments(segments: DataFrame, flagged: DataFrame, pairing: str = "position") -> DataFrame:
    """Bring overlap flags of segments-as-words back: by position in time order, or by identity."""
    order = F.row_number().over(Window.partitionBy("rec_id").orderBy("start", "ord")) - 1
    at = order if pairing == "position" else F.col("ord")
    flags = flagged.select("rec_id", at.cast("long").alias("seg_ord"), F.col("overlap_candidate").alias("flag"))
    return segments.join(flags, ["rec_id", "seg_ord"], "left").withColumn("overlap_candidate", F.coalesce("flag", "overlap_candidate")).drop("flag")


def _held(words: DataFrame, marks: DataFrame, bucket_seconds: float | None) -> DataFrame:
    """Words with ``range``, the mark (rec_id, ord, start, end, ...) of the disjoint range that holds all of them."""
    points = words.select("rec_id", F.col("start").alias("t"), F.struct(*[c for c in words.columns if c != "rec_id"]).alias("w"))
    found = word_at(points, marks, bucket_seconds)
    return found.select("rec_id", "w.*", F.when(F.col("w.end") <= F.col("found.end"), F.col("found")).alias("range"))


def covered(words: DataFrame, ranges: DataFrame, bucket_seconds: float | None = S.BUCKET_SECONDS) -> DataFrame:
    """Words with ``range``, the disjoint kept range that holds all of them, or null."""
    return _held(words, ranges.select("rec_id", F.col("range_ord").alias("ord"), "start", "end"), bucket_seconds)


def _pairs(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of a word and a range (with its other columns) that holds all of it."""
    pairs = contained(words, ranges)
    extra = [F.col(f"r.{c}") for c in ranges.columns if c not in ("rec_id", "start", "end")]
    return pairs.select("rec_id", *[F.col(f"l.{c}").alias(c) for c in words.columns if c != "rec_id"], *extra, F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


def words_in_ranges(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every pair of a word and a range that holds all of it: (words' columns, range_ord,
    range_start, range_end).  Ranges may overlap each other."""
    return _pairs(words, ranges.select("rec_id", "range_ord", "start", "end"))


def remap_words_of_any(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """As ``remap_words`` for ranges that may overlap: a word comes once for each range that holds it.

    Ranges carry their offset into the join, so pairs, which may be many times the words,
    are not moved again.
    """
    earlier = Window.partitionBy("rec_id").orderBy("range_ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select("rec_id", "range_ord", "start", "end", F.coalesce(F.sum(F.col("end") - F.col("start")).over(earlier), F.lit(0.0)).alias("offset"))
    move = lambda c: (F.col(c) - F.col("range_start")) + F.col("offset")
    return _pairs(words, placed).select("rec_id", "ord", "word", move("start").alias("start"), move("end").alias("end"), "speaker", "overlap_candidate", "range_ord")


def kept_words(words: DataFrame, ranges: DataFrame) -> DataFrame:
    return covered(words, ranges).filter("range is not null").drop("range")


def cut_words(words: DataFrame, ranges: DataFrame) -> DataFrame:
    return covered(words, ranges).filter("range is null").drop("range")


def remap_words(words: DataFrame, ranges: DataFrame, bucket_seconds: float | None = S.BUCKET_SECONDS) -> DataFrame:
    """Kept words on the shortened time line."""
    bucket = None if bucket_seconds is None else F.floor(F.col("range_ord") / BUCKET_RANGES)
    offsets = S.scan(cut_lineage(ranges.select("rec_id", "range_ord", "start", "end"), bucket_seconds), ["rec_id"], ["range_ord"], bucket, __upto=S.Sum(F.col("end") - F.col("start")))
    marks = offsets.select("rec_id", F.col("range_ord").alias("ord"), "start", "end", (F.col("__upto") - (F.col("end") - F.col("start"))).alias("offset"))
    held = _held(words, marks, bucket_seconds).filter("range is not null")
    move = lambda c: (F.col(c) - F.col("range.start")) + F.col("range.offset")
    return held.select("rec_id", "ord", "word", move("start").alias("start"), move("end").alias("end"), "speaker", "overlap_candidate")
