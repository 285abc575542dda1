"""Harmonic packing of tokenised documents into fixed-length training sequences.

The capacity C is divided by reciprocals: class k holds pieces of at most C // k
tokens, and a bin of class k takes exactly k of them.  A document gives whole
sequences first; what remains goes to class k = C // remainder as it is when it
nearly fills that slot, and otherwise is cut to the slot of class k + 1 exactly,
which leaves a much shorter rest.  A worker fills the bins of every class by
itself, so packing needs no shuffle, no shared state and no second pass: the job
is one map over the input splits.  (Input of fewer splits than there are cores is dealt
over all cores first, which is a shuffle; then pieces depend on the number of cores.)  Bins that are still open when a worker ends
are chained and cut at the capacity, so each worker pads one sequence at most.

A rerun or a lost executor repeats the same split and so the same pieces; the
sequence number holds the worker in its upper bits and a counter in its lower.

Defined results: a null or empty text is its end token alone.  Repeated rows and
null identifiers are packed like all others.  Empty input gives no pieces.  Other
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.functions.storage import spread
from cueweave.llm.memory import releasing, small_batches

CAPACITY = 2048
END_ID = 1
TOLERANCE = 0.02
PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Vocabulary:
    """Ids of a byte-level BPE vocabulary file, exactly as the tokenizers library gives them.

    The same vocabulary is read as ranks for the encoder in use, which is several
    times as fast and gives equal ids.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(self.path, encoding="utf-8") as file:
            text = file.read()
        # Only this list is read; the vocabulary itself would take much memory.
        added, _ = json.JSONDecoder().raw_decode(text, text.index("[", text.index('"added_tokens"')))
        self.special = [token["content"] for token in added]
        del text
        ranks = public_tokenizers.path(os.path.basename(self.path).replace(".json", ".tiktoken"))
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    @functools.cached_property
    def whole(self):
        """The tokenizers library's own encoder, loaded when a text holds a special token."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if any(token in text for token in self.special):  # the library gives these strings ids of their own
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.encoding.encode_ordinary(text), np.uint32)


def pieces(length: int, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> Iterator[tuple[int, int, int]]:
    """(start, length, class) of each piece of a document."""
    start = 0
    while start < length:
        left = length - start
        if left >= capacity:
            size, k = capacity, 1
        else:
            k = capacity // left
            slot = capacity // k
            if slot - left <= tolerance * slot or left <= capacity // 32:
                size = left
            else:
                k += 1
                size = capacity // k
        yield start, size, k
        start += size


class Packer:
    """The open bins of one worker."""

    def __init__(self, worker: int, capacity: int = CAPACITY, tolerance: float = TOLERANCE):
        self.capacity, self.tolerance = capacity, tolerance
        self.next_id = worker << 32
        self.open: dict[int, list[tuple]] = {}

    def _close(self, items: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in items:
            yield doc, start, len(ids), ids.tobytes(), total, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        for start, size, k in pieces(len(ids), self.capacity, self.tolerance):
            items = self.open.setdefault(k, [])
            items.append((doc, start, ids[start : start + size].copy(), len(ids)))
            if len(items) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """Chain the pieces of open bins, cutting at the capacity."""
        items, room = [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    items.append((doc, start, part, total))
                    start, room = start + len(part), room - len(part)
                    if not room:
                        yield from self._close(items)
                        items, room = [], self.capacity
        if items:
            yield from self._close(items)
        self.open = {}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: (doc_id, start, length, ids, doc_tokens,
    sequence_id, offset), ``ids`` being little-endian unsigned 32-bit token ids.
    """
    small_batches(docs.sparkSession)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = Vocabulary(vocabulary), Packer(TaskContext.get().partitionId(), capacity, tolerance)
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "")
                rows.extend(packer.add(doc, np.append(ids, np.uint32(end_id))))
                if len(rows) >= 1024:
                    yield _batch(rows)
                    rows = []
        rows.extend(packer.finish())
        yield _batch(rows)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, PIECE_SCHEMA)


def with_checksums(packed: DataFrame) -> DataFrame:
    """Replace the ids of each piece by their CRC-32."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
