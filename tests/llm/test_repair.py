"""Conversation repair against an exhaustive search, and its two ways against one another."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cueweave.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """Least (cost, audit) by searching over (turns used, symbols given): no table, no bands."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, given = heapq.heappop(heap)
        state = (i, given)
        if state in seen:
            continue
        seen.add(state)
        if i == len(turns) and GRAMMAR.fullmatch(given):
            return cost, audit
        if not re.fullmatch(r"(s?(ua)*u?)?", given):
            continue
        for role in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", i, given + role))
        if i < len(turns):
            initial, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, given))
            if not gone:
                heapq.heappush(heap, (cost + cut, audit + "K", i + 1, given + (initial or "?")))
                for role in "ua":
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, given + role))


def random_turns(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.2, False) if rng.random() < 0.5 else (rng.choice("ua"), False, rng.random() < 0.3) for _ in range(n)]


def long(turns):
    out = repair.Turns()
    for t in turns:
        out.append(t)
    return out


def test_alignment_is_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(400):
        turns = random_turns(rng, rng.randrange(7))
        want = cheapest(turns)
        assert repair.align(turns) == want and repair.align_long(long(turns), step=3) == want


def test_both_alignments_agree_on_many_turns():
    rng = random.Random(2)
    for n in (50, 300, 700):
        turns = random_turns(rng, n)
        assert repair.align(turns) == repair.align_long(long(turns), step=64)
    sound = [("s", False, False)] + [("ua"[i % 2], False, False) for i in range(900)]
    assert repair.align(sound) == (0, "K" * 901) == repair.align_long(long(sound))
    cost, audit = repair.align_long(long([("u", False, False)] * 200_000))
    assert cost == 200_000 and len(audit) >= 200_000


def expected(rows, damage=True):
    """The contract, row by row."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = {t for t, *_ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = cheapest(turns)
        length = sum(x != "D" for x in audit)
        target = ("s" if length % 2 else "") + "ua" * (length // 2)
        lines, i, j = [], 0, 0
        for letter in audit:
            role = {"u": "user", "a": "assistant", "s": "system"}[target[j]] if letter != "D" else None
            if letter == "I":
                lines.append(f"{role}:")
            else:
                if letter != "D":
                    lines.append(f"{role if letter == 'R' else own[i][1]}:{own[i][2]}")
                i += 1
            j += letter != "D"
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["Yes.", "No", "", "  \n", None, "Why? ", "é!\t", "long " * 3000 + ".", "Yes."]
    out = [(c, t, rng.choice(["system", "user", "assistant", "tool", "", None, "user", "assistant"]), rng.choice(texts) if rng.random() < 0.5 else f"t{c}.{t}!") for c in range(60) for t in range(rng.randrange(1, 7))]
    out += [(None, 0, "user", "a."), (None, None, "assistant", "b"), (70, None, "user", "x"), (70, None, None, None), (71, 3, "user", "same."), (71, 3, "user", "same."), (71, 3, "assistant", "tie"), (71, -2, "user", "e")]
    return out + [(c, 0, "user", "only one") for c in range(80, 120)]  # some lose all they have


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("conversations")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("side", "audit", "place", "here", "kind", "copy", "n"):
        df = df.withColumn(name, F.lit("clash"))
    df.write.parquet(str(path / "conversations.parquet"))
    return str(path)


def test_query_equals_brute_force(spark, rows, folder):
    got = queries.queries()["op12_repair"](spark, folder)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected(rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_long_conversations(spark, rows, folder):
    df = repair.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    for options in ({"long_rows": 2}, {"long_bytes": 3}):
        got = repair.repair_conversations(df, present=F.col("here"), **options).collect()
        assert len(got) == len({r[0] for r in rows}) and {r[0]: tuple(r)[1:] for r in got} == expected(rows)


def test_repaired_turns(spark, rows):
    df = spark.createDataFrame(rows, "c long, t long, r string, x string")
    found = {}
    for r in repair.repaired_turns(df, conv_col="c", turn_col="t", role_col="r", text_col="x").collect():
        found.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    want = expected(rows, damage=False)
    for conv, (*_, digest) in want.items():
        own = sorted(found.get(conv, []))
        assert [p for p, *_ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in own).encode()).hexdigest() == digest


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert repair.repair_conversations(repair.damaged(none), present=F.col("here")).isEmpty() and repair.repaired_turns(none).isEmpty()
