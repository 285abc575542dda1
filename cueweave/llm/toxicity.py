"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words (runs of letters, lower-cased) and their first four letters.  Every term
of the labelled examples (a bounded sample) is indexed; none is dropped.  A term weighs
(1 + log count) x inverse document frequency x (1 + r) ** 0.5, r being its
log-likelihood ratio against the label, which is 0 for a term that no example holds.  Document frequencies are counted over all
documents, and a text's norm covers all its terms: those outside the examples are
looked up by a join on their 63-bit hash, because their number is not bounded.

The examples are kept as a block-max inverted index.  They are ordered by their nearest
pivot and their length and cut into blocks; each block stores, for every common term,
the largest weight among its members.  A text's rare terms are summed exactly from their
postings; those sums plus the block maxima of its common terms bound the score of every
block.  The most promising blocks are scored first, and of the others only those whose
bound reaches the k-th score found so far, so the nearest examples are exact.  They vote
with weights that rise with similarity, and the vote is turned into a probability by the
share of toxic examples at that vote, measured on the examples themselves with each left
out.

Defined results: a text without any term (also empty and null ones) is compared with
the examples that have none either, and gets their toxic share; a text that shares no
term with an example has no evidence and the share of an empty vote; without usable
labels every score is 0.  A document that is labelled twice counts as toxic if one
label says so.  Null labels and null identifiers teach nothing.  Repeated rows give
repeated results.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from copy import copy
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.functions.storage import materialise, spread
from cueweave.llm.memory import release, releasing, small_batches

MAX_EXAMPLES = 4000
NEIGHBOURS = 25
#: Picked by five-fold cross-validation inside the rows that may teach (see the README).
POWER = 2.0
RATIO_POWER = 0.5
BEGINNING = 4
COMMON = 0.08
BLOCK, FIRST_BLOCKS, PIVOTS = 16, 4, 16
BATCH_TEXTS, RARE_TEXTS = 64, 16
#: The share of blocks left over from which all are scored in one product.
DENSE = 0.15
#: So many characters of texts are cut into words at once (a longer text by itself).
PORTION = 3_000_000
_word = re.compile(r"[^\W\d_]+")
_ascii_letters = bytes(ord(c.lower()) if c.isalpha() and i < 128 else 32 for i, c in enumerate(map(chr, range(256))))


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    for low in range(0, len(out), 1 << 16):
        for run in _word.finditer("".join(map(chr, range(low, low + (1 << 16))))):
            out[low + run.start() : low + run.end()] = True
    return out


def spaced(text: str | None) -> bytes:
    """A text in lower case with a space for everything but letters."""
    text = text or ""
    if text.isascii():
        return text.encode().translate(_ascii_letters)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, np.uint32(32))
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    return spaced(text).decode("utf-8", "surrogatepass").split()


def text_terms(text: str | None) -> list[str]:
    """The words of a text and, marked with a hyphen, the beginnings of the longer ones."""
    words = words_of(text)
    return words + [w[:BEGINNING] + "-" for w in words if len(w) > BEGINNING]


def term_hashes(terms: Iterable[str | bytes]) -> np.ndarray:
    """63-bit hashes of terms or their UTF-8; terms are told apart by them."""
    own = (t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in terms)
    return (np.array(list(map(xxhash.xxh3_64_intdigest, own)), np.uint64) >> np.uint64(1)).astype(np.int64)


def beginning(word: bytes) -> bytes:
    """The first letters of a word in UTF-8, marked with a hyphen; nothing for a short word."""
    if word.isascii():
        return word[:BEGINNING] + b"-" if len(word) > BEGINNING else b""
    letters = word.decode("utf-8", "surrogatepass")
    return (letters[:BEGINNING] + "-").encode("utf-8", "surrogatepass") if len(letters) > BEGINNING else b""


def portions(texts: Sequence[str | None]) -> Iterator[Sequence[str | None]]:
    """The texts in order, PORTION characters at a time."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held > PORTION and i > low:
            yield texts[low:i]
            low, held = i, len(text or "")
    if len(texts) > low:
        yield texts[low:]


class Vocabulary:
    """Numbers of terms: the place of a term of the examples among their sorted hashes, or
    -1 - hash for any other."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.padded = hashes, np.append(hashes, -1)

    def numbers(self, terms: Iterable[str | bytes]) -> np.ndarray:
        own = term_hashes(terms)
        at = np.searchsorted(self.hashes, own)
        return np.where(self.padded[at] == own, at, -1 - own)

    def table(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the text, term, how often it occurs there) of many texts, ordered by text.
        The texts' words are cut, told apart and counted together, so that Python
        handles each different word once."""
        joined = np.frombuffer(b"\n".join(map(spaced, texts)), np.uint8)
        letter = joined > 32
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))  # starts and ends of words
        lengths, text = edge[1::2] - edge[::2], np.searchsorted(np.flatnonzero(joined == 10), edge[::2])
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(joined[letter])]).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = {b"": 0}
        head = np.array([heads.setdefault(h, len(heads)) for h in map(beginning, words)], np.int64)
        numbers = self.numbers([*words, *heads])
        held, times = np.unique(text * max(1, len(words)) + coded.indices.to_numpy(), return_counts=True)
        text, word = np.divmod(held, max(1, len(words)))
        long = head[word] > 0
        held, at = np.unique(text[long] * len(heads) + head[word[long]], return_inverse=True)
        begun, start = np.divmod(held, len(heads))
        text = np.concatenate([text, begun])
        order = np.argsort(text, kind="stable")
        terms = np.concatenate([numbers[word], numbers[len(words) + start]])
        times = np.concatenate([times, np.bincount(at, times[long], len(held)).astype(np.int64)])
        return text[order], terms[order], times[order]

    def distinct(self, text: str | None) -> list[int]:
        """The terms of a text, each once."""
        return self.table([text])[1].tolist()

    def counts(self, text: str | None) -> tuple[list[int], list[int]]:
        """The terms of a text and how often each occurs."""
        _, terms, times = self.table([text])
        return terms.tolist(), times.tolist()


class ExampleIndex:
    """Block-max inverted index over example vectors of unit length."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, ids: list[int], labels: list[int], counts: Iterable[tuple]):
        self.terms, self.factor = terms, weights
        vectors = [self.weigh(*c)[:2] for c in counts]
        filled = [i for i in np.argsort(np.array(ids, np.int64), kind="stable") if len(vectors[i][0])]
        filled = [filled[i] for i in self._alike([vectors[i] for i in filled])]
        empty = [i for i in range(len(ids)) if not len(vectors[i][0])]
        self.ids = np.array([ids[i] for i in filled], np.int64)
        self.labels = np.array([labels[i] for i in filled], np.float64)
        self.empty_toxic, self.empty_all = sum(labels[i] for i in empty), len(empty)
        self.base = (sum(labels) + 1) / (len(labels) + 2)
        self.blocks = -(-len(filled) // BLOCK)
        held = np.concatenate([np.zeros(0, np.int64), *[vectors[i][0] for i in filled]])
        by_term = np.argsort(held, kind="stable")
        place = np.repeat(np.arange(len(filled)), [len(vectors[i][0]) for i in filled])
        self.place = place[by_term].astype(np.min_scalar_type(len(filled)))
        self.weight = np.concatenate([np.zeros(0), *[vectors[i][1] for i in filled]])[by_term]
        self.starts = np.searchsorted(held[by_term], np.arange(len(terms) + 1)).astype(np.int32)
        self.own = [vectors[i] for i in filled]  # for the calibration only
        self.edges, self.shares = np.array([]), np.array([])
        self.other, self.total = None, 0  # document frequencies of all other terms; number of documents

    def __getstate__(self) -> dict:
        """What is sent to the tasks: the postings, from which the dense parts are made again."""
        return {k: v for k, v in self.__dict__.items() if k not in ("own", "other", "row", "common", "maxima")}

    @cached_property
    def row(self) -> np.ndarray:
        """The row of ``common`` of each term that many examples hold, else -1."""
        often = np.diff(self.starts) > COMMON * len(self.ids)
        return np.where(often, np.cumsum(often) - 1, -1)

    @cached_property
    def common(self) -> np.ndarray:
        """The weights of the common terms in all examples, block by block."""
        out = np.zeros((int(self.row.max(initial=-1)) + 1, self.blocks * BLOCK))
        for term in np.flatnonzero(self.row >= 0):
            own = slice(self.starts[term], self.starts[term + 1])
            out[self.row[term], self.place[own]] = self.weight[own]
        return out

    @cached_property
    def maxima(self) -> np.ndarray:
        """The largest weight of each common term in each block."""
        return self.common.reshape(len(self.common), self.blocks, BLOCK).max(axis=2, initial=0.0)

    @staticmethod
    def _alike(vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """An order that puts alike examples together: by the nearest of a few pivots, then by length."""
        if not vectors:
            return np.zeros(0, np.int64)
        at = np.concatenate([t for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors])
        starts = np.cumsum([0, *[len(t) for t, _ in vectors]])[:-1]
        near = []
        for i in np.random.default_rng(5).choice(len(vectors), min(PIVOTS, len(vectors)), replace=False):
            pivot = np.zeros(int(at.max()) + 1)
            pivot[vectors[i][0]] = vectors[i][1]
            near.append(np.add.reduceat(pivot[at] * weight, starts))
        return np.lexsort(([len(t) for t, _ in vectors], np.argmax(near, axis=0)))

    def weigh(self, terms: Sequence[int], times: Sequence[int]) -> tuple[np.ndarray, np.ndarray, float]:
        """(terms, weights of unit length, norm) of the terms of the examples in a text."""
        found = np.asarray(terms, np.int64)
        known = found >= 0
        found = found[known]
        weights = (1 + np.log(np.asarray(times, np.float64)[known])) * self.factor[found]
        norm = float(np.sqrt((weights**2).sum()))
        return (found, weights / norm, norm) if norm > 0 else (found[:0], weights[:0], 0.0)

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, *, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, similarities) of the k nearest examples of each vector, nearest first, ties by
        identifier.  ``without`` gives a place that is no candidate for each vector."""
        for low in range(0, len(vectors), BATCH_TEXTS):
            part = vectors[low : low + BATCH_TEXTS]
            scores, floors = self._scores(part, k, None if without is None else without[low : low + len(part)])
            for sims, floor in zip(scores, floors, strict=True):
                at = np.flatnonzero(sims >= max(floor - 1e-9, 1e-12))
                if len(at) > 4 * k:
                    at = at[sims[at] >= np.partition(sims[at], -k)[-k] - 1e-9]
                sims = np.round(sims[at], 12)  # equal examples tie, whatever the order of sums
                best = np.lexsort((self.ids[at], -sims))[:k]
                yield at[best], sims[best]

    def _scores(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities of the vectors with the examples of all blocks that can matter, 0 elsewhere;
        and a bound that k examples reach, if so many are similar at all."""
        texts, width = len(vectors), self.blocks * BLOCK
        text = np.repeat(np.arange(texts), [len(t) for t, _ in vectors])
        terms, weights = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])
        row = self.row[terms]
        asked = np.zeros((texts, len(self.common)))
        asked[text[row >= 0], row[row >= 0]] = weights[row >= 0]
        text, terms, weights = text[row < 0], terms[row < 0], weights[row < 0]
        scores = np.zeros((texts, self.blocks, BLOCK))
        for low in range(0, texts, RARE_TEXTS):  # few at a time: their postings are many
            some = slice(*np.searchsorted(text, (low, low + RARE_TEXTS)))
            first = self.starts[terms[some]].astype(np.int64)
            lengths = self.starts[terms[some] + 1] - first
            at = np.arange(lengths.sum()) + np.repeat(first - np.cumsum(lengths) + lengths, lengths)
            where = np.repeat((text[some] - low) * width, lengths) + self.place[at]
            part = scores[low : low + RARE_TEXTS]
            part += np.bincount(where, np.repeat(weights[some], lengths) * self.weight[at], minlength=part.size).reshape(part.shape)
        bound = scores.max(axis=2) + asked @ self.maxima
        done = np.zeros((texts, self.blocks), bool)

        def finish(todo: np.ndarray) -> None:
            if todo.mean() > DENSE:  # so many that one product costs less than one for each block
                product = (asked @ self.common).reshape(scores.shape)
                product[~todo] = 0
                scores[...] += product
            else:
                for block in np.flatnonzero(todo.any(axis=0)):
                    who = np.flatnonzero(todo[:, block])
                    scores[who, block] += asked[who] @ self.common[:, block * BLOCK : (block + 1) * BLOCK]
            done[todo] = True
            if without is not None:
                scores.reshape(texts, width)[np.arange(texts), without] = 0

        first = min(self.blocks, FIRST_BLOCKS + -(-k // BLOCK))
        todo, best = np.zeros_like(done), np.argpartition(-bound, first - 1, axis=1)[:, :first]
        np.put_along_axis(todo, best, True, axis=1)
        finish(todo)
        reached = np.take_along_axis(scores, best[:, :, None], axis=1).reshape(texts, -1)
        floor = np.partition(reached, -k, axis=1)[:, -k] if k < reached.shape[1] else np.zeros(texts)
        finish(~done & (bound >= floor[:, None] - 1e-9) & (bound > 0))
        scores[~done] = 0
        return scores.reshape(texts, width)[:, : len(self.ids)], floor

    def vote(self, at: np.ndarray, sim: np.ndarray) -> float:
        """Weighted share of toxic neighbours, drawn to the base rate when nothing is close."""
        weights = sim**POWER
        return float((weights @ self.labels[at] + 0.05 * self.base) / (weights.sum() + 0.05))

    def calibrate(self) -> None:
        """Shares of toxic examples by leave-one-out vote, made monotone by pooling neighbours."""
        votes = [self.vote(at, sim) for at, sim in self.nearest_of(self.own, without=np.arange(len(self.ids)))]
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []
        for i in order:
            pools.append([votes[i], self.labels[i], 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, toxic, n = pools.pop()
                pools[-1][1] += toxic
                pools[-1][2] += n
        self.own = []
        self.edges = np.array([p[0] for p in pools])
        self.shares = np.array([(p[1] + self.base) / (p[2] + 1) for p in pools])

    def score(self, at: np.ndarray, sim: np.ndarray) -> tuple[float, list[tuple[int, float, int]]]:
        """(probability, evidence): the nearest examples as (identifier, similarity, label)."""
        vote = self.vote(at, sim)
        share = float(np.interp(vote, self.edges, self.shares)) if len(self.edges) else vote
        return share, [(int(self.ids[i]), float(s), int(self.labels[i])) for i, s in zip(at[:5], sim[:5], strict=True)]

    @property
    def empty_score(self) -> float:
        return (self.empty_toxic + self.base) / (self.empty_all + 1) if self.empty_all or len(self.ids) else 0.0


def _ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratio of each term's presence against the label."""
    total = n_pos + n_neg

    def part(observed, row, column):
        expected = np.where(observed > 0, row * column / total, 1.0)
        return observed * np.log(np.where(observed > 0, observed, 1.0) / expected)

    with_, without = pos + neg, total - pos - neg
    out = part(pos, with_, n_pos) + part(neg, with_, n_neg) + part(n_pos - pos, without, n_pos) + part(n_neg - neg, without, n_neg)
    return np.maximum(2 * out, 0.0)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES) -> ExampleIndex:
    """The index of at most ``max_examples`` labelled documents (chosen by a hash of the
    identifier) over all their terms.  Of several texts of one identifier the one with the
    least hash is the example."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(max_examples)
    held = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id")
    texts = held.agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), F.coalesce("text", F.lit("")))).alias("text"))
    texts = materialise(texts, "examples")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = term_hashes(set(text_terms(text.as_py())))
                label = np.full(len(own), toxic, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(label), pa.array(1 - label)], ["term", "pos", "neg"])

    found = spread(texts.select("toxic", "text")).mapInArrow(terms_of, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    held = found.toArrow().sort_by("term")  # bounded by max_examples
    terms = held["term"].to_numpy()
    ratio = _ratio(held["pos"].to_numpy().astype(float), held["neg"].to_numpy().astype(float), n_pos, n_neg)

    @releasing
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known, n = Vocabulary(terms), np.zeros(len(terms), np.int64), 0

        def told(term: np.ndarray, times: np.ndarray, docs: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(term), pa.array(times), pa.array([docs] + [0] * (len(term) - 1), pa.int64())], ["term", "n", "docs"])

        for batch in batches:
            for texts in portions(batch.column(0).to_pylist()):
                _, seen, _ = vocabulary.table(texts)
                n += len(texts)
                known += np.bincount(seen[seen >= 0], minlength=len(terms))
                rest, times = np.unique(seen[seen < 0], return_counts=True)
                if len(rest):
                    yield told(rest, times, 0)
        if n:  # the first row tells the number of documents, too
            at = np.flatnonzero(known)
            at = at if len(at) else np.zeros(1, np.int64)
            yield told(at, known[at], n)

    known_df, total, other = np.zeros(len(terms)), 0, None
    if len(terms):
        counted = spread(docs.select("text")).mapInArrow(frequencies, "term long, n long, docs long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        # A term outside the examples that one document holds needs no row: whoever asks for it is that document.
        counted = materialise(counted.filter("term >= 0 or n > 1 or docs > 0"), "frequencies")
        total = counted.agg(F.sum("docs")).first()[0] or 0
        own = counted.filter("term >= 0").select("term", "n").toArrow()
        known_df[own["term"].to_numpy()] = own["n"].to_numpy()
        other = counted.filter("term < 0").select("term", "n")
    weights = (np.log((1 + total) / (1 + known_df)) + 1) * (1 + ratio) ** RATIO_POWER

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            counts = [vocabulary.counts(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in counts], pa.list_(pa.int32())), pa.array([n for _, n in counts], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    rows = texts.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow().sort_by("doc_id")
    lists = [[x.values.to_numpy(zero_copy_only=False) for x in rows[c]] for c in ("terms", "counts")]
    index = ExampleIndex(terms, weights, rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), zip(*lists, strict=True))
    index.calibrate()
    index.other, index.total = other, total
    del held, rows, lists
    release()
    return index


def score(docs: DataFrame, index: ExampleIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence) of every document.  Texts are searched in one map; the
    weights of terms outside the examples join its written result by hash."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by max_examples
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = copy(sent.value)  # what the search adds goes with the task
        vocabulary = Vocabulary(examples.terms)
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                texts: dict[str | None, int] = {}  # copies are searched once
                which = [texts.setdefault(t, len(texts)) for t in batch.column(2).to_pylist()]
                vectors, norms, hashes, times = [], [], [], []
                for part in portions(list(texts)):
                    text, terms, numbers = vocabulary.table(part)
                    ends = np.searchsorted(text, np.arange(len(part) + 1))
                    for own in map(slice, ends[:-1], ends[1:]):
                        found, weights, norm = examples.weigh(terms[own], numbers[own])
                        vectors.append((found, weights))
                        norms.append(norm)
                        other = terms[own] < 0
                        hashes.append(terms[own][other])
                        times.append(numbers[own][other])
                near = list(examples.nearest_of(vectors)) if len(examples.ids) else [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
                kinds = [pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                columns = [norms, [a for a, _ in near], [s for _, s in near], hashes, times]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([c[i] for i in which], k) for c, k in zip(columns, kinds, strict=True)]], ["row", "doc_id", "norm", "at", "sim", "hashes", "times"])

    @releasing
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = sent.value
        for batch in batches:
            scores, evidence = [], []
            for norm, rest, at, sim in zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True):
                if norm == 0 and rest == 0 or not len(examples.ids):
                    found = examples.empty_score, []
                else:
                    found = examples.score(np.array(at, np.int64), np.array(sim) * (norm / np.sqrt(norm**2 + rest)))
                scores.append(found[0])
                evidence.append([{"doc_id": i, "similarity": s, "toxic": y} for i, s, y in found[1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    docs = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # Written, so that row numbers hold.
    found = materialise(docs.mapInArrow(search, "row long, doc_id long, norm double, at array<int>, sim array<double>, hashes array<bigint>, times array<int>"), "nearest")
    if index.other is None:
        found = found.withColumn("rest", F.lit(0.0))
    else:
        terms = found.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("t")).select("row", F.col("t.hashes").alias("term"), F.col("t.times").alias("times"))
        idf = F.log(F.lit(1.0 + index.total) / (1 + F.coalesce("n", F.lit(1)))) + 1
        rest = terms.join(index.other, "term", "left").withColumn("weight", (1 + F.log("times")) * idf)
        rest = rest.groupBy("row").agg(F.sum(F.col("weight") * F.col("weight")).alias("rest"))
        found = found.drop("hashes", "times").join(rest, "row", "left").fillna(0.0, ["rest"])
    return found.select("doc_id", "norm", "rest", "at", "sim").mapInArrow(finish, "doc_id long, score double, evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>")
