import random

import pytest

from cueweave import schemas
from cueweave.operators import intervals as iv


def table(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, start double, end double")


def union(ranges, gap=0.0):
    """Ranges less than a gap apart (or touching, without one) as one, by painting a fine grid."""
    out = []
    for s, e in sorted(ranges):
        if out and (s <= out[-1][1] if not gap else s - out[-1][1] < gap):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def absorbed(ranges, least):
    done, cur = [], None
    for s, e in ranges:
        cur = (cur[0] if cur else s, e)
        if cur[1] - cur[0] >= least:
            done.append(cur)
            cur = None
    if cur and done:
        done[-1] = (done[-1][0], max(done[-1][1], cur[1]))
    return done


def expected_edl(decisions, words, duration):
    def out(t, edge):
        held = [w for w in words if w[0] <= t]
        return held[-1][edge] if held and held[-1][0] < t < held[-1][1] else t

    kept = union([(s, e) for s, e, k in decisions if k == "keep" and e > s])
    kept = union([(out(s, 0), max(out(e, 1), out(s, 0))) for s, e in kept])
    kept = absorbed(union(kept, 0.3), 0.5) or [(0.0, duration)]
    return [(max(0.0, s), min(e, duration)) for s, e in kept]


def test_edl_against_plain_rules(spark):
    rng, decisions, words, recordings, want = random.Random(5), [], [], [], []
    for rec in range(80):
        at, own = 0.0, []
        for i in range(rng.randrange(0, 12)):
            at += rng.randrange(0, 4) / 8
            own.append((at, at + rng.randrange(1, 6) / 8))
            at = own[-1][1]
            words.append((rec, i, "w", *own[-1], "A", False))
        mine = [(s, s + rng.randrange(0, 12) / 16, rng.choice(["keep", "keep", "remove"])) for s in (rng.randrange(0, 80) / 16 for _ in range(rng.randrange(0, 8)))]
        duration = rng.randrange(8, 60) / 8
        if any(s >= duration for s, _, _ in mine):
            duration = 9.0
        decisions += [(rec, i, *d, "") for i, d in enumerate(mine)]
        recordings.append((rec, duration))
        want += [(rec, i, *r) for i, r in enumerate(expected_edl(mine, own, duration))]
    got = iv.build_edl(spark.createDataFrame(decisions, schemas.DECISIONS), spark.createDataFrame(words, schemas.WORDS), spark.createDataFrame(recordings, schemas.RECORDINGS))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_unsound_ranges_are_set_aside(spark):
    decisions = spark.createDataFrame([(1, 0, 1.0, 2.0, "keep", ""), (2, 0, 7.0, 9.0, "keep", ""), (3, 0, 1.0, 2.0, "remove", "")], schemas.DECISIONS)
    recordings = spark.createDataFrame([(1, 9.0), (2, 5.0), (3, 0.0), (4, 6.0)], schemas.RECORDINGS)
    good, wrong = iv.checked_edl(decisions, spark.createDataFrame([], schemas.WORDS), recordings)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 0, 1.0, 2.0), (4, 0, 0.0, 6.0)]
    assert sorted((r.rec_id, r.kind) for r in wrong.collect()) == [(2, "empty"), (3, "empty")]


def test_violations(spark):
    rows = [(1, 0, 0.0, 5.0), (1, 1, 3.0, 8.0), (2, 0, 5.0, 8.0), (2, 1, 0.0, 4.0), (3, 0, 1.0, 1.0), (4, 0, 0.0, 1.0), (4, 1, 1.0, 2.0)]
    found = iv.edl_violations(spark.createDataFrame(rows, schemas.RANGES))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "overlap"), (2, 1, "overlap"), (3, 0, "empty")]
    with pytest.raises(ValueError):
        iv.edl_violations(spark.createDataFrame(rows, schemas.RANGES), strict=True)


def test_absorb_against_a_plain_fold(spark):
    rng, rows, want = random.Random(3), [], []
    for rec in range(60):
        at, mine = 0.0, []
        for _ in range(rng.randrange(1, 9)):
            at += rng.randrange(1, 4) / 4
            end = at + rng.randrange(1, 6) / 8
            mine.append((at, end))
            at = end
        rows += [(rec, *r) for r in mine]
        want += [(rec, *r) for r in absorbed(mine, 0.5)]
    got = [tuple(r) for r in iv.absorb_tiny(table(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_gap_of_exactly_the_limit_stays(spark):
    got = iv.merge_small_gaps(table(spark, [(1, 0.0, 1.0), (1, 1.25, 2.0), (1, 2.5, 3.0)]), 0.5)
    assert sorted((r.start, r.end) for r in got.collect()) == [(0.0, 2.0), (2.5, 3.0)]


def test_nested_and_empty(spark):
    ranges = spark.createDataFrame([(1, 1, 4.0, 5.0), (1, 0, 0.0, 2.0)], schemas.RANGES)
    row = iv.nested_edl(ranges, spark.createDataFrame([(1, 9.0)], schemas.RECORDINGS)).first()
    assert [tuple(x) for x in row.ranges] == [(0.0, 2.0), (4.0, 5.0)] and row.source_duration == 9.0
    assert iv.coalesce_ranges(ranges.select("rec_id", "start", "end").limit(0)).isEmpty()
