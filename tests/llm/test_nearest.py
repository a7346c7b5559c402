import random

from casewright.llm.nearest import match_nearest

BASE = 1_600_000_000_000_000


def brute(left, right, tol):
    out = []
    for i, k, t in left:
        if k is None or t is None or t < 946_684_800_000_000:
            continue
        best = min(((abs(u - t), u, j) for j, q, u in right if q == k and u is not None and u >= 946_684_800_000_000 and abs(u - t) <= tol), default=None)
        if best:
            out.append((i, best[2], best[1] - t))
    return sorted(out)


def got(spark, left, right, tol, **kw):
    names = "id bigint, k string, t bigint"
    a, b = spark.createDataFrame(left, names).selectExpr("*", "0 AS _tick"), spark.createDataFrame(right, names).selectExpr("*", "1 AS diff_us")
    return sorted(tuple(r) for r in match_nearest(a, b, ["k"], "t", "t", "id", "id", tol, **kw).collect())


def test_matches_brute_force(spark):
    r = random.Random(1)
    tol = 90_000_000

    def rows(n, first):
        return [(first + i, r.choice(["a", "a", "a", "b", None]), r.choice([None, -62_135_596_800_000_000, BASE + r.randrange(60) * 15_000_000, BASE + r.randrange(900_000_000)])) for i in range(n)]

    left, right = rows(300, 0), rows(300, 1000)
    left += [(900, "a", BASE), (901, "a", BASE)]
    right += [(2001, "a", BASE + tol), (2002, "a", BASE - tol), (2000, "a", BASE - tol)]
    for tick in (None, tol // 7, 3 * tol):
        assert got(spark, left, right, tol, tick_us=tick) == brute(left, right, tol)


def test_bounds_and_empty(spark):
    assert got(spark, [(1, "a", BASE)], [(2, "a", BASE + 90)], 90) == [(1, 2, 90)]
    assert got(spark, [(1, "a", BASE)], [(2, "a", BASE + 91)], 90) == []
    assert got(spark, [], [(2, "a", BASE)], 90) == [] and got(spark, [(1, "a", BASE)], [], 90) == []
