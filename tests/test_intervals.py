import random
import re

from casewright.operators.intervals import DAY_US, periods_and_gaps

BASE = 1_600_000_000_000_000 // DAY_US * DAY_US


def brute(rows):
    by = {}
    for k, a, z in rows:
        if k is not None and a is not None and z is not None and a >= 946_684_800_000_000 and z >= a:
            by.setdefault(k, []).append((a, z))
    out = []
    for k, iv in by.items():
        iv.sort()
        merged = [list(iv[0])]
        for a, z in iv[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out += [("period", k, a, z) for a, z in merged]
        out += [("gap", k, x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame(rows, "k string, a bigint, z bigint").selectExpr("*", "1 AS _shard", "2 AS kind2")
    return sorted(tuple(r) for r in periods_and_gaps(df, ["k"], "a", "z").collect())


def test_matches_brute_force(spark):
    r = random.Random(5)
    rows = []
    for k in "abcd":
        for _ in range(150):
            a = BASE + r.choice([r.randrange(40) * DAY_US, r.randrange(40 * DAY_US), r.randrange(40) * DAY_US - 1])
            rows.append((k, a, a + r.choice([0, 1, DAY_US // 9, DAY_US, 3 * DAY_US, -5, r.randrange(DAY_US)])))
    rows += [("a", BASE, BASE + 200 * DAY_US), (None, BASE, BASE + 1), ("b", None, BASE), ("b", BASE, None), *rows[:20]]
    assert got(spark, rows) == brute(rows)


def test_sparse_touching_and_nested(spark):
    h = DAY_US // 24
    rows = [("a", BASE, BASE + h), ("a", BASE + h, BASE + 2 * h), ("a", BASE + 5 * h, BASE + 5 * h), ("a", BASE + 90 * DAY_US, BASE + 95 * DAY_US), ("a", BASE + 91 * DAY_US, BASE + 92 * DAY_US), ("b", BASE + DAY_US, BASE + 2 * DAY_US), ("b", BASE + 2 * DAY_US, BASE + 3 * DAY_US)]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_shuffles(spark):
    """One scan's pieces, the rows to stitch and the surviving blocks are shuffled once each; other reads reuse them."""
    df = spark.createDataFrame([("a", BASE + 1, BASE + 5), ("a", BASE + 9, BASE + 12), ("a", BASE + 30, BASE + 3 * DAY_US), ("a", BASE + 9 * DAY_US, BASE + 11 * DAY_US)], "k string, a bigint, z bigint")
    out = periods_and_gaps(df, ["k"], "a", "z")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?m)^\W*(?:Broadcast)?Exchange ", plan)) == 3 and plan.count("ReusedExchange") == 2, plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
