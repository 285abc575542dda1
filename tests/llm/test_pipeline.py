"""The corpus pipeline against brute force on a small corpus."""

import re

import corpus_pipeline


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def close(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x) and 100 * len(x & y) >= 80 * len(x | y)


def test_stages(spark, tmp_path):
    base = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(12)]
    texts = [*base, base[0], base[0].upper(), base[1] + " more", None, ""]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0, 0), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == set(range(len(texts)))  # no toxic examples: nothing goes
    last = {(t or "").lower(): i for i, t in enumerate(texts)}
    assert set(kept[1]) == set(last.values())
    gone = {j for i in kept[1] for j in kept[1] if i < j and close(kept[1][i], kept[1][j])}
    assert gone and set(kept[2]) == set(kept[1]) - gone
    assert set(kept[3]) <= {i for i, t in kept[2].items() if re.search(r"\S", t or "")}
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3]) and packed


def test_rows_are_judged_and_not_identifiers(spark, tmp_path):
    text = {k: " ".join(f"{k}{j}" for j in range(30)) + "\n\tend  " for k in "ACDE"} | {"D+": " ".join(f"D{j}" for j in range(30)) + "\n\tend  more"}
    rows = [(3, "A"), (7, "A"), (7, "C"), (None, "D"), (9, "D+"), (None, "E"), (None, "E")]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, text[k], "en", "s", 1) for i, k in rows], kind)
    docs.write.parquet(str(tmp_path / "d0"))
    docs, kept = spark.read.parquet(str(tmp_path / "d0")), []
    name = {v: k for k, v in text.items()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[1:4], 1):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"d{i}"))
        docs = spark.read.parquet(str(tmp_path / f"d{i}"))
        kept.append(sorted(((r.doc_id or 0, name.get(r.text, r.text)) for r in docs.collect())))
    assert kept[0] == [(0, "D"), (0, "E"), (7, "A"), (7, "C"), (9, "D+")]
    assert kept[1] == [(0, "E"), (7, "A"), (7, "C"), (9, "D+")]  # a named document stays before an unnamed one
    words = sum(len(text.get(t, t).split()) for _, t in kept[2])
    assert words == round(1.5 * sum(len(text[t].split()) for _, t in kept[1]))
    assert all(t in text or any(v.startswith(t) for v in text.values()) for _, t in kept[2])  # cut ones keep their white space
