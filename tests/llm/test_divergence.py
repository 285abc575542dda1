"""The divergence audit against a plain computation, with small blocks, shards and squares."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueweave.llm import divergence, queries

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top=10):
    counts, docs, groups = {}, Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = Counter(w.translate(FOLD) for w in WORD.findall(text or ""))
        counts.setdefault((lang, source), Counter()).update(own)
        docs.update((lang, w) for w in own)
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (k, w), n in docs.items() if k == lang and n >= min_docs)
        sources = sorted(s for k, s in groups if k == lang)
        total = Counter()
        p = {}
        for s in sources:
            own = counts[lang, s]
            n = sum(own[w] for w in kept)
            p[s] = {w: share(own[w], n, len(kept)) for w in kept}
            total.update({w: own[w] for w in kept})
        q = {w: share(total[w], sum(total.values()), len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            found = [("pair", o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [("term", w, f(p[s][w], q[w])) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, limit in ((found, None), (terms, top)):
                for rank, (name, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:limit], 1):
                    out.append((lang, s, name, item, value, rank))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"{c}{d}" for c in "abcdefghij" for d in ("x", "Y", "é", "ß", "中")]
    out = [(" ".join(rng.choice(words[: 5 + 7 * (i % 6)]) for _ in range(rng.randrange(60))), ("en", "de", None)[i % 3], f"s{min(i % 11, rng.randrange(11))}") for i in range(240)]
    out += [(None, "en", "s1"), ("", None, None), ("x" * 100_000 + " aX " * 5000, "en", "s2"), ("12 34 [_] \x00\x7f", "xx", "only"), ("une seule", "fr", "a"), ("autre", "fr", "b"), ("İI ퟿ \U0001f600a", "en", "")]
    return out + out[:5] + [("aX bY", "en", "z" * 300)] * 3


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for name in ("term", "p", "zero", "item", "value", "shard", "terms", "size", "doc_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize(
    "options", [{}, {"block_postings": 60, "segment_postings": 7, "shards": 3, "pairs_held": 9, "sources_per_slice": 2, "counts_per_chunk": 3}, {"block_postings": 1, "segment_postings": 1, "shards": 1, "pairs_held": 150}]
)
def test_equals_plain_computation(docs, rows, options):
    for min_docs in (10, 2):
        got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=min_docs, **options).collect())
        assert got == plain(rows, min_docs)


def test_query(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op11_divergence"](spark, str(tmp_path))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 10)


def test_merge_opens_segments_late():
    """Runs of many segments: never more than a segment of each run is open."""
    runs = [[bytes([97 + i]) + bytes([r]) * k for i in range(26) for k in range(2)] for r in range(4)]
    made = lambda terms: divergence.Segment(terms[0], terms[-1], pa.array(terms, pa.binary()), np.arange(1, len(terms) + 1), *(np.ones(len(terms), np.int64) for _ in range(3)))
    segments = sorted((made(run[i : i + 4]) for run in runs for i in range(0, len(run), 4)), key=lambda s: s.first)
    opened, merged = [0], []

    def stream():
        for s in segments:
            opened[0] += 1
            yield s

    for parts in divergence.merge_segments(stream()):
        terms = [t for terms, *_ in parts for t in terms.to_pylist()]
        assert len(parts) <= 4 and (not merged or min(terms) > max(merged[-1]))
        merged.append(terms)
        assert 4 * opened[0] <= len([t for own in merged for t in own]) + 5 * 4
    assert sorted(t for own in merged for t in own) == sorted(t for run in runs for t in run)


def test_shares_stay_exact_beyond_64_bits(spark):
    rows = [(3 * 10**15, 9 * 10**15), (0, 2), (10**17, 10**18)]
    got = spark.createDataFrame(rows, "c long, n long").select(divergence.share(F.col("c"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // n for c, n in rows]


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).isEmpty()
