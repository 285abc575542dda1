"""The registered queries over small tables with awkward rows, against their contracts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.llm import langid, line_dedup, mixing, mtree, packing, pii, queries, toxicity, warc

ODD = ["", " \n ", " ", "x" * 200_000, "a b " * 30_000, "\U0001f600́ 中文", "\x00\x01\x7f  ", "MiXeD cAsE İI", "\n" * 50_000, "1 2 3", "<|endoftext|> t"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of about 130 rows, with columns whose names clash with those that operators add."""
    path, rng = tmp_path_factory.mktemp("tables"), random.Random(9)
    words = {"en": "the of and house dog tree with that".split(), "de": "der die und haus hund baum mit das".split()}
    texts = [" ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 60))) + (" vile" if i % 9 == 0 else "") for i in range(90) for lang in [("en", "de")[i % 2]]]
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].upper(), None, None, 1) for i in range(10)]
    rows += [(200 + i, t, "en", "s0", len(t)) for i, t in enumerate(ODD)] + [(300, None, None, None, None), (301, texts[4] + " more", "de", "", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind)
    for name in ("size", "row", "keys", "rep", "component", "digest", "batch", "at", "norm", "target", "score", "tag", "hits", "ids", "length", "cell", "pattern"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, int(i % 9 == 0)) for i in range(0, 90)] + [(300, 0, 0), (200, 0, 1), (9999, 1, 1), (3, 0, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).write.parquet(str(path / "labels.parquet"))
    pages = [(i, None if i % 5 == 0 else f"http://e.org/{i}", "<p>one<p>two <a href=/x>l</a>" * (i % 4) if i % 6 else None) for i in range(30)] + [(None, "u", "h"), (3, "u", "h")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("title", F.lit("clash")).write.parquet(str(path / "pages.parquet"))
    vectors = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(5)]) for i in range(120)] + [(140, None), (160, [None] * 5), (180, [float("nan")] * 5), (None, [1.0] * 5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("x", F.lit(1)).write.parquet(str(path / "embeddings.parquet"))
    return str(path), {i: t for i, t, *_ in rows}, rows


def run(spark, name, folder):
    return queries.queries()[name](spark, folder[0]).collect()


def remainder(i, divisor):
    return zlib.crc32(str(i).encode()) % divisor


def test_line_and_exact_dedup(spark, folder):
    got = {r.doc_id: r for r in run(spark, "op1_line_dedup", folder)}
    assert {i: r.n_lines for i, r in got.items()} == {i: (t or "").count("\n") + 1 for i, t in folder[1].items()} and not any(r.n_dropped for r in got.values())
    assert all(r.kept_sha256 == hashlib.sha256((folder[1][i] or "").encode()).hexdigest() for i, r in got.items())
    fold = {i: "".join(c.lower() if c.isascii() else c for c in t or "") for i, t in folder[1].items()}
    groups = {}
    for i, t in fold.items():
        groups.setdefault(t, []).append(i)
    got = run(spark, "op2_exact_dedup", folder)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == {(i, max(groups[t]), len(groups[t]), max(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in fold.items()}


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.Vocabulary().path)
    pieces, sequences = {}, {}
    for r in run(spark, "op3_packing", folder):
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(folder[1])
    for i, own in pieces.items():
        ids, at = whole.encode(folder[1][i] or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), packing.checksum(np.array(ids[at : at + r.length])))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(own)]])
        assert [o for o, _ in sorted(own)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_tokens_equal_those_of_the_library():
    from tokenizers import Tokenizer

    words, rng = packing.Vocabulary(), random.Random(3)
    whole = Tokenizer.from_file(words.path)
    ranges = [(0, 128), (128, 0x250), (0x370, 0x530), (0x590, 0x700), (0x900, 0xA00), (0x2000, 0x2100), (0x3040, 0x30FF), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0x1F300, 0x1F650), (0xE000, 0xE010)]
    texts = [*ODD, *words.special, "a" * 300_000, "中" * 50_000, " " * 50_000, "\r\n\t" * 9_000, "don't we'll I'M"]
    texts += ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 200))) for _ in range(3000)]
    for text in texts:
        assert words.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_toxicity(spark, folder):
    got = run(spark, "op4_toxicity", folder)
    assert len(got) == len(folder[1]) and all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    taught = {i for i in range(90) if remainder(i, 5)}
    assert all(e.doc_id in taught | {300, 200} for r in got for e in r.evidence)
    held = [r for r in got if r.doc_id < 90 and r.held_out]
    assert {r.doc_id for r in held if r.predicted} == {r.doc_id for r in held if r.doc_id % 9 == 0}
    assert len({r.score for r in got if not (folder[1][r.doc_id] or "").strip()}) == 1


def test_languages(spark, folder):
    grams = lambda text: Counter(w[i : i + n] for w in ("".join(c if c.isalpha() else " " for c in text.lower())).split() for w in [f" {w} "] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    number = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], number(x[0])))[: langid.PROFILE_LENGTH]]
    profiles = {}
    for i, t, lang, *_ in folder[2]:
        if lang and t is not None and remainder(i, 4) != 2:
            profiles.setdefault(lang, Counter()).update(grams(t))
    profiles = {k: {g: r for r, g in enumerate(ranked(c))} for k, c in profiles.items()}
    plain = {i: t for i, t in folder[1].items() if t is None or t.replace(" ", "").isascii() or "中" in t}
    for r in run(spark, "op9_langid", folder):
        assert r.held_out == (remainder(r.doc_id, 4) == 2)
        if r.doc_id in plain:
            own = ranked(grams(plain[r.doc_id] or ""))
            away = {k: sum(abs(p[g] - j) if g in p else langid.PROFILE_LENGTH for j, g in enumerate(own)) for k, p in profiles.items()}
            assert r.lang_pred == (min(sorted(away), key=away.get) if own else "und")
            assert 0 <= r.score <= 1 and (own or r.score == 0)


def test_other_queries(spark, folder):
    got = run(spark, "op5_mtree", folder)
    assert Counter(r.query_id for r in got) == {i: 20 for i in range(0, 120, 20)} and all(r.query_id != r.vec_id for r in got)
    got = run(spark, "op6_pii", folder)
    assert {r.doc_id for r in got} == set(folder[1])
    got = run(spark, "op7_warc", folder)
    assert Counter(r.record_type for r in got) == {"metadata": 32, "conversion": 32} and all(r.refers_to and r.target_uri for r in got)
    got = run(spark, "op8_mixing", folder)
    sizes = {i: len((t or "").split()) if i not in (202,) else None for i, t in folder[1].items()}
    assert len(got) == len(sizes) and all(0 <= r.taken <= 2 * r.size for r in got) and got == run(spark, "op8_mixing", folder)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert all(sum(r.size for r in own) == size and abs(sum(r.taken for r in own) - target) <= 1 for (size, target), own in by.items()) and len(by) == 5
    got = run(spark, "op10_minhash", folder)
    assert {r.doc_id for r in got} == set(folder[1]) and {r.component_id for r in got if r.doc_id in (100, 301)} == {0, 4}
    assert all(r.kept == (r.doc_id == r.component_id) and (r.n_shingles > 0) == bool((folder[1][r.doc_id] or "").strip(" \t\n\v\f\r")) for r in got)


def test_empty_tables_of_all_operators(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))).isEmpty()
    assert langid.identify(docs, langid.learn_profiles(docs)).isEmpty() and pii.digest_spans(pii.find_personal_data(docs)).isEmpty()
    assert mixing.apply_mix(docs, mixing.mix(docs, F.array("source"))).isEmpty() and line_dedup.dedup_lines(docs, broadcast_bytes=0).isEmpty()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(pages)).isEmpty()
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.top_inner_products(vectors, vectors).isEmpty()


def test_null_identifiers(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, None), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    assert len(toxicity.score(docs, toxicity.learn(docs, labels)).collect()) == 4
    assert sorted(r.doc_id or 0 for r in packing.pack(docs).collect()) == [0, 0, 1, 1]
    profiles = langid.learn_profiles(docs.withColumn("lang", F.lit("en")))
    assert sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(docs, profiles).collect()) == [(0, "en"), (0, "und"), (1, "en"), (1, "en")]
    mixed = mixing.mix(docs, F.array(F.lit("s"))).collect()
    assert sum(r.taken for r in mixed) == 22 and all(r.taken <= 2 * r.size for r in mixed)  # three halves of 15 words, rounded to even
