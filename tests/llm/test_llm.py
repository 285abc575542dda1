import gzip
import hashlib
import itertools
import math
import pickle
import random
import re
import sys
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.llm import exact_dedup, langid, line_dedup, minhash, mixing, mtree, packing, pii, toxicity, warc

LONG = "This Line Is Long Enough To Be Counted As A Key "
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    out = [(0, None, None), (1, "", "a"), (2, "one", "b"), (3, "  \n\t ", "a")]
    base = [rng.choice(words) for _ in range(80)]
    for i in range(4, 34):
        text = list(base) if i % 3 else [rng.choice(words) for _ in range(60)]
        for _ in range(i % 7):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((i, " ".join(text) + "\n" + (LONG.upper() if i % 2 else " " + LONG) + "\nend", "abc"[i % 3]))
    return [*out, (50, out[10][1].upper(), "c"), (51, out[10][1], None), (60, "É UN", "a"), (61, "é un", "a")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, n long")


def dropped(rows):
    split = {i: (t or "").split("\n") for i, t, _ in rows}
    key = lambda x: x.strip(" \t\n\v\f\r").translate(ASCII)
    held = {}
    for i, ls in split.items():
        for x in {key(x) for x in ls if len(key(x)) >= 40}:
            held.setdefault(x, []).append(i)
    return {i: "\n".join(x for x in ls if not (len(held.get(key(x), [])) >= 5 and max(held[key(x)]) != i)) for i, ls in split.items()}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lines_by_both_ways(docs, rows, limit):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, broadcast_bytes=limit).collect()}
    assert got == dropped(rows)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lines_of_unnamed_and_repeated_rows(spark, limit):
    often, unnamed = LONG + "often", LONG + "unnamed"
    rows = [(i, often) for i in range(-5, 0)] + [(None, often + "\nx"), (None, often + "\ny"), (None, None), (-1, often), (-1, "z\n" + often)] + [(None, unnamed)] * 6
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=limit).collect()
    want = [(i, "") for i in range(-5, -1)] + [(-1, often), (-1, often), (-1, "z\n" + often), (None, "x"), (None, "y"), (None, "")] + [(None, unnamed)] * 6
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_lines >= r.n_dropped for r in got)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    table = line_dedup.PerfectHash.build(hi, lo)
    assert sorted(table.lookup(hi, lo)) == list(range(5000))


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_groups(docs, rows, bits):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(ASCII), []).append(i)
    want = {(i, max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    got = exact_dedup.find_duplicates(docs, keep="largest", digest_bits=bits)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()} == want


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("bits", [256, 8])
def test_index_of_several_batches(spark, rows, bits, keep, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 4)  # small tables have few rows to a hot group otherwise
    monkeypatch.setattr(exact_dedup, "TEXTS_PER_SALT", 2)
    monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", 3)
    index = exact_dedup.MergeIndex(spark, keep=keep, memtable_rows=4, digest_bits=bits)
    parts = [rows[:12], [(x[0] + 200, x[1], x[2]) for x in rows[5:20]], [*rows[8:], (None, rows[10][1], "a"), (7, rows[10][1], "a"), (7, rows[10][1], "a")]]
    for i, part in enumerate(parts):
        index.flush(spark.createDataFrame(part, "doc_id long, text string, source string").select("doc_id", "text"))
        if i < 2:
            index.compact()
    every, groups = [(x[0], i, (x[1] or "").translate(ASCII)) for i, part in enumerate(parts) for x in part], {}
    for doc, _, text in every:
        groups.setdefault(text, []).append(doc)
    best = {t: (max if keep == "largest" else min)((d for d in g if d is not None), default=None) for t, g in groups.items()}
    got = index.report().collect()
    assert sorted(((r.doc_id or -1, r.batch, r.keep_id, r.group_size) for r in got), key=str) == sorted(((d or -1, i, best[t], len(groups[t])) for d, i, t in every), key=str)
    assert Counter(r.keep_id for r in got if r.kept) == Counter(best.values()) and all(r.doc_id == r.keep_id for r in got if r.kept)
    if bits == 256:
        asked = spark.createDataFrame([(bytes(32),), (hashlib.sha256(rows[10][1].translate(ASCII).encode()).digest(),)], "digest binary")
        assert [(r.keep_id, r.n) for r in index.lookup(asked).collect()] == [(best[rows[10][1].translate(ASCII)], len(groups[rows[10][1].translate(ASCII)]))]


def test_repeated_rows_and_columns_stay_single(docs):
    kept = exact_dedup.drop_duplicates(docs.unionByName(docs.filter("doc_id in (2, 5)")))
    assert kept.columns == docs.columns
    assert kept.filter("doc_id in (2, 5)").count() == 2


def test_rows_that_share_an_identifier_are_judged_one_by_one(spark):
    docs = spark.createDataFrame([(3, "A"), (7, "a"), (7, "C"), (None, "c"), (None, "D"), (None, "d")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text.lower()) for r in exact_dedup.drop_duplicates(docs).collect()), key=str) == [(3, "a"), (7, "c"), (None, "d")]


def test_packing_round_trip(docs, rows):
    words = packing.Vocabulary()
    pieces = packing.pack(docs).collect()
    whole, places = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(whole.setdefault(p.doc_id, []))
        whole[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert whole == {i: words.whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048


def test_mixing_targets_and_flow(docs):
    assert mixing.target_words([10, 10, 100], [3, 1, 2]) == [20, 20, 140]
    assert mixing.target_words([0, 0], [3, 1]) == [0, 0]
    flow = mixing.route([10, 10], [[0], [0, 1]], [12, 8], 2)
    assert flow[0][0] + flow[1].get(0, 0) == 12 and flow[1][1] == 8 and sum(flow[0].values()) <= 20
    got = mixing.mix(docs, F.array("source")).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(str(r.pattern), [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    mixed = mixing.mix(docs, F.array("source")).cache()
    total = mixing.apply_mix(docs, mixed).select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert total == mixed.filter("doc_id is not null").agg(F.sum("taken")).first()[0]
    assert Fraction(3, 2) * sum(r.size for r in got) - total < 5


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail bob.x@mail.example.com now", "email", "bob.x@mail.example.com"), ("john [at] example [dot] com", "email", "john [at] example [dot] com"),
        ("x jane at foo dot org ok", "email", "jane at foo dot org"), ("bоb@exаmple.com", "email", "bоb@exаmple.com"),
        ("call plus one four one five five five five two six seven one now", "phone", "plus one four one five five five five two six seven one"),
        ("ip 192[.]168[.]1[.]1 x", "ip", "192[.]168[.]1[.]1"), ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("at the dot and at on", None, None), ("256.1.1.1 4111111111111112", None, None), ("", None, None),
    ],
)
def test_personal_data(text, kind, found):
    assert [(s.kind, text[s.start : s.end]) for s in pii.all_spans(text)[1]] == ([(kind, found)] if kind else [])


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    counts = []
    for _ in range(400):
        terms = np.unique(rng.zipf(1.3, rng.integers(1, 40)) % 200)
        counts.append((terms.tolist(), rng.integers(1, 5, len(terms)).tolist()))
    factor = np.linspace(1, 3, 200)
    index = toxicity.ExampleIndex(np.arange(200), factor, list(range(400)), [i % 3 == 0 for i in range(400)], counts)
    assert 0 < len(index.common) < 200 and index.blocks == 25
    dense = np.zeros((400, 200))
    for i, (terms, times) in enumerate(counts):
        dense[i, terms] = (1 + np.log(times)) * factor[terms]
    dense /= np.sqrt((dense**2).sum(axis=1, keepdims=True))
    for k in (1, 10, 500):
        for i, (at, sims) in enumerate(index.nearest_of([index.weigh(*c)[:2] for c in counts[:150]], k)):
            want = dense @ dense[i]
            assert np.allclose(sims, np.sort(want[want > 0])[::-1][:k]) and np.allclose(sims, want[index.ids[at]])


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(4, 34)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        scores = [r.score for r in toxicity.score(docs, toxicity.learn(docs, some)).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)


def test_tree_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(int(i), rng.normal(0, 0.1, 8).astype(np.float32).tolist()) for i in range(600)] + [(1000 + i, [0.1] * 8) for i in range(40)]
    vectors = spark.createDataFrame([*data, (2000, None), (2001, [float("nan")] * 8), (2002, []), (2020, [None] * 8)], "vec_id long, embedding array<float>")
    got = mtree.top_inner_products(vectors, vectors.filter("vec_id % 20 = 0"), k=5, shard_rows=200, block_rows=8, page=16)
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in data}
    want = {q: [(s, i) for s, i in sorted(((-int(x[q] @ x[i]), i) for i in x if i != q))[:5]] for q in x if q % 20 == 0}
    have = {}
    for r in got.orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert have == want


def test_tree_skips_shards_and_splits_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 6))
    data = [(i, (centres[i % 6] + rng.normal(0, 0.02, 6)).tolist()) for i in range(1200)] + [(5000 + i, [0.5] * 6) for i in range(700)]
    data += [(7000 + i, [0.25, 1.0]) for i in range(3)] + [(20, [9.0] * 6), (7000, [float("inf"), 1.0]), (7020, [1.0])]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in data] + [(None, [0.1] * 6, 1, "x")], "vec_id long, embedding array<double>, width int, x string")
    sizes = []
    keep = mtree._shards
    monkeypatch.setattr(mtree, "_shards", lambda *a: sizes.append(keep(*a)) or sizes[-1])
    got = mtree.top_inner_products(vectors, vectors.filter("vec_id % 20 = 0"), k=4, shard_rows=100, block_rows=16, page=16).collect()
    x = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in data if np.isfinite(v).all()]
    asked = {}
    for i, v in x:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, (len(v), v.tolist())), (len(v), v.tolist()))
    want = {q: sorted((-int(np.dot(v, y)), i) for i, y in x if i != q and len(y) == w)[:4] for q, (w, v) in asked.items()}
    have = {q: [] for q in asked}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        have[r.query_id].append((-r.score, r.vec_id))
    assert have == want
    rows = [len(pickle.loads(r.tree).ids) for r in sizes[0].collect()]
    assert sum(rows) == len(x) and max(rows) < 300
    assert mtree.top_inner_products(vectors.limit(0), vectors.limit(0)).isEmpty()


def test_records_round_trip(spark):
    page = "<html><title>A &amp; B</title><script>x</script><p>One<br>two <a href='u'>l</a></p></html>"
    pages = spark.createDataFrame([(1, "http://e.org/", page), (2, None, None)], "page_id long, url string, html string")
    sources = {r.page_id: warc.parse(bytes(r.record)) for r in warc.responses(pages).collect()}
    found = warc.derivatives(warc.responses(pages)).collect()
    assert len(found) == 4
    for r in found:
        record = warc.parse(bytes(r.record))
        own = sources[r.page_id].headers
        assert record.headers["warc-refers-to"] == own["warc-record-id"] and record.headers["warc-source-payload-digest"] == own["warc-payload-digest"]
        assert warc.digest(record.block) == r.block_digest and len(record.block) == r.content_length
        if r.page_id == 1 and r.record_type == "conversion":
            assert record.block.decode() == "A & B\nOne\ntwo l"
    assert warc.derive(None) == [] and warc.derive(b"junk") == []


def test_language(spark):
    text = {"en": "the cat and the dog are in the house with that thing", "de": "der hund und die katze sind nicht in dem haus"}
    rows = [(i, text[k] * (1 + i % 3), k) for i, k in enumerate(["en", "de"] * 10)]
    profiles = langid.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the house and that"), (2, "die katze und der hund"), (3, None), (4, "12 !")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, profiles).collect()} == {1: "en", 2: "de", 3: "und", 4: "und"}
    assert langid.Profiles({}).predict("abc") == ("und", 0.0)


def test_near_duplicates_against_all_pairs(docs, rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").translate(ASCII).split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    top = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    got = minhash.near_duplicates(docs, words=4, block_members=3).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), top[i], top[i] == i) for i, s in sets.items()}


def test_rows_that_repeat_an_identifier_are_one_node(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(9)) for k in "ABCDE"} | {"B+": " ".join(f"B{i}" for i in range(10)), "": ""}
    rows = [(3, "A"), (7, "A"), (7, "B"), (4, "B"), (9, "B+"), (9, "C"), (8, ""), (9, ""), (5, "D"), (5, "D"), (None, "A"), (None, "E"), (10, "E"), (2, "")]
    got = minhash.near_duplicates(spark.createDataFrame([(i, text[k], "x") for i, k in rows], "doc_id long, text string, rep string"), words=4)
    want = {3: 3, 7: 3, 4: 3, 9: 3, 8: 8, 5: 5, 10: 10, 2: 2, None: None}
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=str) == sorted(((i, want[i]) for i, _ in rows), key=str)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert line_dedup.dedup_lines(none).isEmpty() and exact_dedup.find_duplicates(none).isEmpty() and packing.pack(none).isEmpty()
    assert mixing.mix(none, F.array("source")).isEmpty() and minhash.near_duplicates(none).isEmpty() and pii.find_personal_data(none).isEmpty()


def test_base_digest(docs):
    row = pii.digest_spans(pii.find_personal_data(docs)).first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest() and row.spans == ""


def test_toxicity_covers_all_terms(spark):
    rows = [(i, f"shared{i % 2} own{i} " + ("bad" if i % 4 == 0 else "good") + " rare" * (i % 3)) for i in range(24)]
    rows += [(100, "own3"), (101, "own4 unseen unseen"), (102, "own4 unseen other"), (103, "own4 unseen other"), (104, "nothing"), (105, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(24)], "doc_id long, toxic int")
    terms = lambda text: [t for w in re.findall(r"[^\W\d_]+", text or "") for t in [w, *([w[:4] + "-"] if len(w) > 4 else [])]]
    counts = {i: Counter(terms(text)) for i, text in rows}
    df = Counter(t for c in counts.values() for t in c)

    def ratio(term):
        cells = [[sum((term in counts[i]) == held and (i % 4 == 0) == bad for i in range(24)) for bad in (0, 1)] for held in (0, 1)]
        return 2 * sum(n * math.log(n * 24 / (sum(row) * (18, 6)[bad])) for row in cells for bad, n in enumerate(row) if n)

    factor = {t: (math.log((1 + len(rows)) / (1 + n)) + 1) * (1 + max(0, ratio(t))) ** toxicity.RATIO_POWER for t, n in df.items()}
    weights = {i: {t: (1 + math.log(n)) * factor[t] for t, n in c.items()} for i, c in counts.items()}
    norms = {i: math.sqrt(sum(w * w for w in c.values())) for i, c in weights.items()}
    base = 7 / 26

    def near(i):
        sims = {j: sum(w * weights[j].get(t, 0) for t, w in weights[i].items()) / norms[i] / norms[j] for j in range(24) if norms[i] and j != i}
        return sims if i >= 24 else sims | {i: 1.0}

    def vote(sims):
        best = sorted(sims.items(), key=lambda x: (-round(x[1], 12), x[0]))[:25]
        return (sum(s**toxicity.POWER * (j % 4 == 0) for j, s in best) + 0.05 * base) / (sum(s**toxicity.POWER for _, s in best) + 0.05)

    own = sorted((vote({j: s for j, s in near(i).items() if j != i}), i) for i in range(24))
    toxic = [int(i % 4 == 0) for _, i in own]
    level = [max(min(sum(toxic[a : b + 1]) / (b + 1 - a) for b in range(k, 24)) for a in range(k + 1)) for k in range(24)]  # the best rising curve
    edges, shares = [], []
    for low in sorted(set(level)):
        pool = [k for k in range(24) if level[k] == low]
        edges.append(own[pool[0]][0])
        shares.append((sum(toxic[k] for k in pool) + base) / (len(pool) + 1))
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert set(got) == set(counts)
    for i, r in got.items():
        sims = near(i)
        best = sorted((s for s in sims.values() if s > 0), reverse=True)[:5]
        assert np.allclose([e.similarity for e in r.evidence], best) and all(math.isclose(e.similarity, sims[e.doc_id]) for e in r.evidence)
        if norms[i]:
            assert math.isclose(r.score, np.interp(vote(sims), edges, shares), abs_tol=1e-9)
    assert got[100].evidence and got[103].evidence and not got[104].evidence


@pytest.mark.parametrize("around", ["{}", "{} (see below)", "[1] {}"])
@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john at example.com today", "email", "john at example.com"),
        ("call +1 415 five five five 2671 now", "phone", "+1 415 five five five 2671"),
        ("call plus 1 415 triple 5 2671 now", "phone", "plus 1 415 triple 5 2671"),
    ],
)
def test_disguises_do_not_need_other_characters(around, text, kind, found):
    text = around.format(text)
    assert [(s.kind, text[s.start : s.end]) for s in pii.all_spans(text)[1]] == [(kind, found)]


def timed(run, limit=10.0):
    began = time.process_time()
    out = run()
    assert time.process_time() - began < limit
    return out


LONG_RUNS = [
    "<" + "a" * 1_000_000, "x dot " + "a" * 1_000_000, "at" + " " * 1_000_000 + "x", " " * 1_000_000, "a at " * 200_000, "(" * 1_000_000, "@" * 1_000_000,
    "a@" * 300_000, "1 " * 500_000 + "one", "one " * 250_000, "+1 " + "(" * 1_000_000, "a (at) b (dot) c " * 60_000, "1." * 500_000, "plus" + " " * 1_000_000, "\u0430" * 300_000 + " at b",
]


@pytest.mark.parametrize("text", LONG_RUNS, ids=range(len(LONG_RUNS)))
def test_long_runs_take_linear_time(text):
    timed(lambda: pii.all_spans(text))


def base_spans(text):
    """The contract's patterns, plainly."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                yield kind, *m.span()


def test_base_spans_and_their_digest_against_the_patterns(spark):
    rng, rows = random.Random(8), []
    parts = ["@", ".", "+", "-", " ", "(", ")", "a", "b.c", "x@y.z", "4111111111111111", "192.168.0.1", "256", "1", "0", "55", "+1 (415) 555-2671", "\n", "\u0430", "_", "%"]
    for i in range(3000):
        rows.append((i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))))
    rows += [(5000, None), (5001, ""), (None, "x@y.z"), (7, "x@y.z"), (7, "x@y.z")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, kind int")
    got = pii.digest_spans(pii.find_personal_data(docs)).collect()
    want = [(i, hashlib.sha256(",".join(":".join(map(str, x)) for x in base_spans(t or "")).encode()).hexdigest()) for i, t in rows]
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_email >= r.n_base_email and r.n_card >= r.n_base_card for r in got) and sum(r.n_base_ip + r.n_base_card + r.n_base_phone > 0 for r in got) > 300


@pytest.mark.parametrize("part", ["<script", "<!--", "<a href", "<a ", "<title>", "</p", "<p", "<style>x", "<a href='", "&#", "<template></script>"])
def test_unclosed_pages_take_linear_time(part):
    for end in ("", ">"):
        page = ("<html>" + part * 100_000 + end).encode()
        record = warc.build({"WARC-Type": "response"}, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page)
        assert len(timed(lambda record=record: warc.derive(record))) == 2


def test_codings_and_source_headers():
    page = "<title>T</title><p>gr\u00fc\u00dfe <a class=x href=\"/one\">1</a><!-- no --><a name=y>2</a><a href='/two'>3</a>".encode()
    packed = gzip.compress(page)
    chunks = b"".join(b"%x;e=1\r\n%s\r\n" % (len(packed[i : i + 20]), packed[i : i + 20]) for i in range(0, len(packed), 20)) + b"0\r\n\r\n"
    bodies = {"gzip": (packed, ""), "deflate": (zlib.compress(page), ""), "gzip ": (chunks, "Transfer-Encoding: chunked\r\n"), "": (page, ""), "br": (b"\x01\x02", ""), "gzip  ": (b"broken", "")}
    for coding, (body, more) in bodies.items():
        http = f"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=utf-8\r\nX-One: a: b\r\nSet-Cookie: c\r\nSet-Cookie: d\r\n{more}Content-Encoding: {coding}\r\n\r\n".encode()
        record = warc.build({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-IP-Address": "1.2.3.4"}, http + body)
        about, text = (warc.parse(r[-1]) for r in warc.derive(record))
        told = about.block.decode().split("\r\n")
        assert {"status: 404", "source-warc-warc-ip-address: 1.2.3.4", "source-http-x-one: a: b", "source-http-set-cookie: c", "source-http-set-cookie: d"} <= set(told)
        good = coding.strip() != "br" and body != b"broken"
        assert ("content-decoded: true" in told) == good and text.block.decode() == ("T\ngr\u00fc\u00dfe 1 23" if good else "")
        assert [x for x in told if x.startswith("outlink")] == (["outlink: /one", "outlink: /two"] if good else [])
    image = warc.build({"WARC-Type": "response"}, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n<p>no text</p>")
    assert warc.parse(warc.derive(image)[1][-1]).block == b""


def cheapest(supplies, members, quotas, repeats):
    """(most words, least cost of giving them), by trying all flows of a small case."""
    best = {0: 0}
    states = {(tuple(quotas), 0): 0}
    for supply, own in zip(supplies, members, strict=True):
        after = {}
        for (left, moved), cost in states.items():
            for gives in itertools.product(*[range(min(left[s], supply * repeats) + 1) for s in own]):
                if sum(gives) <= supply * repeats:
                    rest = list(left)
                    for s, g in zip(own, gives, strict=True):
                        rest[s] -= g
                    more = sum((i // supply) for i in range(sum(gives)))
                    key = (tuple(rest), moved + sum(gives))
                    after[key] = min(after.get(key, cost + more), cost + more)
        states = after
    for (_, moved), cost in states.items():
        best[moved] = min(best.get(moved, cost), cost)
    return max(best), best[max(best)]


def test_flow_against_all_flows():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 4)
        quotas = [rng.randrange(5) for _ in range(n)]
        supplies = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 4))]
        members = [sorted(rng.sample(range(n), rng.randrange(1, n + 1))) for _ in supplies]
        flow = mixing.route(supplies, members, quotas, 2)
        assert all(set(f) <= set(m) for f, m in zip(flow, members, strict=True)) and all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quotas))
        assert (sum(sum(f.values()) for f in flow), sum(i // w for f, w in zip(flow, supplies, strict=True) for i in range(sum(f.values())))) == cheapest(supplies, members, quotas, 2)


def test_flow_of_many_patterns():
    rng = random.Random(7)
    members = [sorted(rng.sample(range(100), 2)) for _ in range(20_000)]
    supplies = [rng.randrange(1, 1000) for _ in members]
    quotas = [rng.randrange(50_000, 150_000) for _ in range(100)]
    flow = timed(lambda: mixing.route(supplies, members, quotas, 2), 60)
    assert [sum(f.get(s, 0) for f in flow) for s in range(100)] == quotas


def test_mix_of_overlapping_sources(spark):
    held = [["a"], ["b"], ["a", "b"], ["b", "c"], [None], None, ["a", None]]
    rows = [(i, f" w{i}\n" * (i % 9), held[i % 7], "x", 1) for i in range(210)] + [(None, "n n", ["a"], "x", 1), (8, "r  r\tr", ["b"], "x", 1), (8, "r  r\tr", ["b"], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>, pattern string, size int").withColumn("row", F.monotonically_increasing_id())
    mixed = mixing.mix(docs, F.col("sources"), share=Fraction(6, 7), carry=["row"]).cache()
    got = mixed.collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got) and all(r.taken == 0 for r in got if not r.pattern)
    sizes = {s: sum(len((t or "").split()) for _, t, own, *_ in rows if own and s in own) for s in ("a", "b", "c", None)}
    targets = dict(zip(sizes, mixing.target_words(list(sizes.values()), [3, 1, 2, 3], Fraction(6, 7)), strict=True))
    by_pattern = {}
    for r in got:
        key = tuple(None if x.none else x.name for x in r.pattern)
        assert r.source_size == sum(sizes[s] for s in key) and math.isclose(r.target, sum(targets[s] for s in key))
        own = by_pattern.setdefault(key, [0, r.routes])
        own[0] += r.taken
    for key, (taken, routes) in by_pattern.items():
        assert taken == sum(x.words for x in routes) and {x.source for x in routes} == set(key)
    reached = {s: sum(x.words for _, routes in by_pattern.values() for x in routes if x.source == s) for s in targets}
    assert all(reached[s] <= target + 1 for s, target in targets.items())
    for key, (taken, _) in by_pattern.items():  # a source short of its target has no words left to ask for
        if key and any(reached[s] < targets[s] - 1 for s in key):
            assert taken == 2 * sum(r.size for r in got if tuple(None if x.none else x.name for x in r.pattern) == key)
    parts = [r for r in got if r.taken % max(1, r.size)]
    assert 0 < len(parts) <= len(by_pattern)
    made = mixing.apply_mix(docs, mixed, key="row").groupBy("row").agg(F.collect_list("text").alias("texts"), F.sum(mixing.word_count(F.col("text"))).alias("words"))
    made = {r.row: r for r in made.collect()}
    texts = {r.row: r.text for r in docs.collect()}
    assert {i: r.words for i, r in made.items()} == {r.row: r.taken for r in got if r.taken}
    assert all(texts[i].startswith(t) for i, r in made.items() for t in r.texts)


def test_more_patterns_than_may_be_routed(spark):
    rng = random.Random(8)
    held = [rng.sample("abcdefg", rng.randrange(1, 6)) if i % 11 else [None] for i in range(300)] + [None]
    docs = spark.createDataFrame([(i, "w " * (i % 13), own) for i, own in enumerate(held)], "doc_id long, text string, sources array<string>")
    full = {r.doc_id: r for r in mixing.mix(docs, F.col("sources"), share=Fraction(3, 4)).collect()}
    for most in (40, 8, 2):
        got = mixing.mix(docs, F.col("sources"), share=Fraction(3, 4), max_patterns=most).collect()
        assert len(got) == len(held) and len({str(r.routes) for r in got}) <= max(most, 9)
        taken = Counter()
        for r in got:
            other = full[r.doc_id]
            assert (r.pattern, r.size, r.source_size) == (other.pattern, other.size, other.source_size) and math.isclose(r.target, other.target)
            assert 0 <= r.taken <= 2 * r.size and {x.source for x in r.routes or ()} <= {None if x.none else x.name for x in r.pattern}
            taken[tuple((x.source, x.words) for x in r.routes or ())] += r.taken
        assert all(n == sum(words for _, words in routes) for routes, n in taken.items())
        reached = Counter()
        for routes in taken:
            reached.update(dict(routes))
        sizes = {s: sum(i % 13 for i, own in enumerate(held) if own and s in own) for s in [*"abcdefg", None]}
        targets = dict(zip(sizes, mixing.target_words(list(sizes.values()), [3, 1, 2, 3, 1, 2, 3, 1], Fraction(3, 4)), strict=True))
        assert all(reached[s] <= target + 1 for s, target in targets.items())


def test_rows_alike_are_cut_across_partitions(spark):
    rows = [(None, "one two three", "a")] * 500 + [(None, f"x{i}", "a") for i in range(40)] + [(7, "five six", "b")] * 90 + [(8, "z", "b")] * 3
    counts = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        got = mixing.mix(docs, F.array("source"), weights=(3, 2)).collect()
        by = Counter()
        for r in got:
            by[r.pattern[0].name] += r.taken
        assert all(abs(by[r.pattern[0].name] - r.target) <= 1 for r in got)
        assert sum(bool(r.taken % r.size) for r in got) <= 2
        counts.append(Counter((r.doc_id, r.size, r.taken) for r in got))
    assert counts[0] == counts[1]


def test_more_languages_than_fit_one_comparison(spark):
    rng = random.Random(9)
    spelled = {f"l{i:02}": [chr(rng.randrange(97, 123)) + chr(rng.randrange(97, 123)) for _ in range(9)] for i in range(12)}
    rows = [(i, " ".join(rng.choices(spelled[k], k=20)), k) for i, k in enumerate([*spelled, "l00", "l00"] * 6)] + [(None, None, "l01"), (900, "12", "l02"), (901, "", None), (901, "kx qz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = []
    for options in ({}, {"max_languages": 5}, {"max_languages": 1}):
        found = langid.identify(docs, langid.learn_profiles(docs, **options)).collect()
        told.append(sorted((r.doc_id or -1, r.lang_pred, round(r.score, 9)) for r in found))
    assert told[0] == told[1] == told[2] and len(told[0]) == len(rows)
    assert len(langid.identify(docs, langid.learn_profiles(docs, train_docs=4, max_languages=5)).collect()) == len(rows)


def test_toxicity_terms_and_dense_blocks_give_what_the_plain_way_gives(monkeypatch):
    rng = random.Random(8)
    texts = [None, "", "a_b2c \x0b\x1cD\x7fe", "Straße ½ Ⅷ Kelvin ²x", *["".join(rng.choice("abcdeABCDE \t\n_-9.é٠一") for _ in range(rng.randrange(300))) for _ in range(200)]]
    texts += [t.encode("ascii", "ignore").decode() for t in texts[4:]]
    plain = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    words = toxicity.Vocabulary(np.sort(toxicity.term_hashes(["abcd-", "abcde", "a"])))
    for t in texts:
        assert toxicity.words_of(t) == plain(t)
        want = Counter(toxicity.text_terms(t))
        terms, times = words.counts(t)
        assert dict(zip(terms, times, strict=True)) == dict(zip(words.numbers(list(want)), want.values(), strict=True))
        assert sorted(words.distinct(t)) == sorted(terms)
    n = 400
    vectors = [(np.sort(np.array(rng.sample(range(60), 20))), np.full(20, 20**-0.5)) for _ in range(n)]
    index = toxicity.ExampleIndex(np.arange(60), np.ones(60), list(range(n)), [i % 2 for i in range(n)], [(t, np.ones(20)) for t, _ in vectors])
    got = []
    for share in (0.0, 1.0):
        monkeypatch.setattr(toxicity, "DENSE", share)
        got.append([(at.tolist(), sim.tolist()) for at, sim in index.nearest_of(vectors[:50])])
    held = {i: set(t.tolist()) for i, (t, _) in enumerate(vectors)}
    for (at, sims), mine in zip(got[0], list(held.values())[:50], strict=True):
        best = sorted(((-len(mine & own) / 20, i) for i, own in held.items()))[: len(at)]
        assert [int(index.ids[p]) for p in at] == [i for _, i in best] and np.allclose(sims, [-s for s, _ in best])
    assert got[0] == got[1]


def test_toxicity_terms_of_many_texts_are_counted_together(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéßΣ一") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    texts = [None, "", " 7 ", "İİ \u0345Σ Σ", *[" ".join(rng.choice(words) for _ in range(rng.randrange(800))) for _ in range(100)], None]
    known = toxicity.Vocabulary(np.sort(toxicity.term_hashes(toxicity.text_terms(texts[5]))))
    monkeypatch.setattr(toxicity, "PORTION", 20_000)
    parts = list(toxicity.portions(texts))
    assert len(parts) > 5 and [t for p in parts for t in p] == texts
    calls = [0]

    def seen(_frame, event, _arg):
        calls[0] += event in ("call", "c_call")

    for part in (texts, *parts, texts[:1]):
        sys.setprofile(seen)
        calls[0] = 0
        text, terms, times = known.table(part)
        sys.setprofile(None)
        assert calls[0] < 300 + 40 * len(part) + 40 * len(words)  # texts hold 400 words each, which are not handled one by one
        assert (np.diff(text) >= 0).all()
        for i, t in enumerate(part):
            want = Counter(toxicity.text_terms(t))
            found = dict(zip(terms[text == i].tolist(), times[text == i].tolist(), strict=True))
            assert found == dict(zip(known.numbers(list(want)).tolist(), want.values(), strict=True))
