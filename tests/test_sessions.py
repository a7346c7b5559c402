import random

import pytest

from casewright.operators.sessions import doubling, sessionize

BASE = 1_600_000_000_000_000


def brute(rows, gap):
    by = {}
    for k, t in rows:
        if k is not None and t is not None and t >= 946_684_800_000_000:
            by.setdefault(k, []).append(t)
    out = []
    for k, ts in by.items():
        ts.sort()
        start, last, n = ts[0], ts[0], 0
        for t in ts:
            if t - last > gap:
                out.append((k, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last, last - start, n))
    return sorted(out)


def got(spark, rows, gap, **kw):
    df = spark.createDataFrame(rows, "who string, at bigint").selectExpr("who", "at", "1 AS start", "'x' AS _bits")
    return sorted(tuple(r) for r in sessionize(df, ["who"], "at", gap, **kw).collect())


@pytest.mark.parametrize("cells", [2, 7, 30, 64])
def test_matches_brute_force(spark, cells):
    r = random.Random(cells)
    gap = 1_800_000_000
    rows = []
    for k in "abc":
        t = BASE
        for _ in range(300):
            t += r.choice([0, 1, gap - 1, gap, gap + 1, gap // 30, 29 * gap // 30, 2 * gap, r.randrange(3 * gap), 500 * gap])
            rows.append((k, t))
    rows += [(None, BASE), ("a", None), ("a", -62_135_596_800_000_000)]
    r.shuffle(rows)
    assert got(spark, rows, gap, cells_per_gap=cells) == brute(rows, gap)


def test_tiny_gaps_and_repeats(spark):
    rows = [("a", BASE), ("a", BASE), ("a", BASE + 1), ("a", BASE + 3), ("b", BASE)]
    for gap in (0, 1, 2, 5):
        assert got(spark, rows, gap) == brute(rows, gap)


def test_empty_table_and_names(spark):
    assert got(spark, [], 10) == []
    with pytest.raises(ValueError):
        sessionize(spark.createDataFrame([], "start_us string, at bigint"), ["start_us"], "at", 10)


def test_doubling_covers_the_reach():
    for reach in range(0, 64):
        covered = {0}
        for s in doubling(reach):
            covered |= {x + s for x in covered}
        assert covered == set(range(reach + 1))
