"""The n-gram join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.llm import ngram_join, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n=3):
    words = [w for w in "".join(c if c not in "\t\n\v\f\r" else " " for c in (text or "").translate(FOLD)).split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def all_pairs(rows, percent=90, n=3):
    """(doc_id, size, component) by comparing every pair; rows of one identifier are one node."""
    sets = [(i, grams(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    named = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, x) in enumerate(named):
        for j, y in named[k + 1 :]:
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for i, s in sets)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [None, "", " \n\t ", "one", "One", "two words", "two  WORDS", "three words here", "É un", "é un", " "]
    for size in (8, 11, 12, 20, 21, 60, 150, 400):
        base = fresh(size)
        texts.append(" ".join(base))
        for changes in (0, 1, 1, 2, 3, 5, 8):  # around the threshold from both sides
            other = list(base)
            for _ in range(changes):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = [rng.choice(words)]
            texts.append(" ".join(other))
        texts.append(" ".join(base).upper())
        texts.append(" ".join(base + fresh(max(1, size // 12))))
    chain = fresh(300)
    for i in range(0, 60, 6):  # each is near the next one, the ends are far apart
        texts.append(" ".join(chain[:i] + fresh(6) + chain[i + 6 :]))
    page = fresh(200)
    texts += [" ".join(page + fresh(rng.randrange(20, 60))) for _ in range(60)]  # a template: alike, but not linked
    texts += [" ".join(fresh(5000)), "x " * 30_000, "y" * 200_000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 + 3 * order[i], t) for i, t in enumerate(texts)]


KIND = "doc_id long, text string"


def answer(df, **options):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_join.linked_components(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"rounds": 1, "block": 4}, {"percent": 70, "rounds": 2, "block": 8}, {"percent": 80, "words": 2}])
def test_equals_all_pairs(spark, rows, options):
    df = spark.createDataFrame(rows, KIND)
    for name in ("rep", "key", "n", "bitmap", "component", "a", "centre", "keys"):
        df = df.withColumn(name, F.lit("clash"))
    assert answer(df.repartition(3), **options) == all_pairs(rows, options.get("percent", 90), options.get("words", 3))


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op13_ngram_join"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and sorted(tuple(r) for r in got.collect()) == all_pairs(rows)


def test_no_linked_pair_is_without_a_common_tile():
    rng, bands = np.random.default_rng(2), ngram_join.Bands(90)
    for size in (10, 18, 19, 50, 200, 1000, 3000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            differ = bands.differ(2 * len(x))
            out = rng.permutation(len(x))[: differ // 2]
            y = np.unique(np.concatenate([np.delete(x, out), rng.integers(0, 2**63, differ - len(out), dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 90 * (len(x) + len(y) - common):
                assert len(np.intersect1d(bands.keys(x), bands.keys(y)))
            bits = ngram_join.differing_bits(bands.bitmap(x), bands.bitmap(y))
            assert bits <= len(x) + len(y) - 2 * common
            assert bands.possible(len(x), len(y), bits) or 100 * common < 90 * (len(x) + len(y) - common)


def test_unnamed_and_repeated_rows(spark):
    base = [f"a{i}" for i in range(40)]
    near, far = " ".join(base[:-1] + ["z"]), " ".join(f"b{i}" for i in range(40))
    rows = [(5, " ".join(base)), (5, far), (5, far), (9, near), (7, far + " more"), (None, far), (None, None), (8, ""), (9, ""), (3, "other"), (12, "other"), (12, far)]
    assert answer(spark.createDataFrame(rows, KIND)) == all_pairs(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"q{i}" for i in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.006 else f"e{i}" for w in base)) for i in range(400)]
    assert answer(spark.createDataFrame(rows, KIND), rounds=2, block=50) == all_pairs(rows)


def test_empty(spark):
    assert ngram_join.linked_components(spark.createDataFrame([], KIND)).isEmpty()


def test_keys_are_written_once_and_bitmaps_only_where_sets_meet(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(str(rng.random()) for _ in range(60))) for i in range(120)]
    rows += [(1000 + i, t + " more") for i, t in rows[:20]] + [(2000 + i, t) for i, t in rows[:30]]
    written, write = [], ngram_join.materialise

    def seen(df, label, **options):
        out = write(df, label, **options)
        written.append((label, out, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(ngram_join, "materialise", seen)
    assert answer(spark.createDataFrame(rows, KIND).repartition(3)) == all_pairs(rows)
    assert [label for label, df, _ in written if "keys" in df.columns] == ["ngram-sketches"]
    assert [df.count() for _, df, _ in written if "bitmap" in df.columns] == [40]
    (plan,) = [plan for label, _, plan in written if label == "tiles"]
    assert plan.count("hashpartitioning(key") == 1


def test_empty_rows_of_repeated_identifiers_link_nothing(spark):
    base = [f"a{i}" for i in range(200)]
    other = " ".join([*base[:90], *[f"b{i}" for i in range(16)], *base[106:]])  # shares tiles with the first, but is not linked
    rows = [(5, " ".join(base)), (9, other), (5, ""), (9, None), (9, " ")]
    assert len({c for _, _, c in all_pairs(rows)}) == 2
    assert answer(spark.createDataFrame(rows, KIND)) == all_pairs(rows)
