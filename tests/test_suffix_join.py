import pytest

from casewright.operators.suffix import suffix_join
from casewright.plans.starqueries import QUERIES


def test_suffix_need_not_be_a_word(spark):
    df = spark.createDataFrame([(1, "SUBSTANDARD"), (2, "x promo small"), (3, "small"), (4, "mall"), (5, None), (6, "SMALLER"), (7, "")], "k int, t string")
    ends = spark.createDataFrame([("STANDARD", 1), ("Promo Small", 2), ("SMALL", 3), ("", 4), (None, 5)], "suffix string, _lengths int").drop("_lengths")
    got = [(r["k"], r["suffix"]) for r in suffix_join(df, "t", ends).collect()]
    assert sorted(got) == [(1, "STANDARD"), (2, "Promo Small"), (2, "SMALL"), (3, "SMALL")]
    assert suffix_join(df.limit(0), "t", ends).count() == 0 and suffix_join(df, "t", ends.limit(0)).count() == 0
    assert suffix_join(df.union(df), "t", ends).count() == 8
    plan = suffix_join(df, "t", ends)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        suffix_join(df, "t", spark.createDataFrame([("a",)], "t string"), "t")


def test_texts_are_never_broadcast(spark):
    df = spark.range(2000).selectExpr("id AS k", "concat('a program ', id % 10, '.exe') AS t")
    # estimated larger than the texts, though only ten remain
    ends = spark.range(100_000).selectExpr("concat(id % 10, '.EXE') AS suffix").distinct()

    def planned():
        out = suffix_join(df, "t", ends)
        return out._jdf.queryExecution().executedPlan().toString(), out.groupBy("t", "suffix").count().collect()

    key, (plan, rows) = "spark.sql.autoBroadcastJoinThreshold", planned()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert sorted((r[0], r[1], r[2]) for r in rows) == [(f"a program {i}.exe", f"{i}.EXE", 200) for i in range(10)]
    before = spark.conf.get(key)
    try:
        for threshold in ("100", "-1"):
            spark.conf.set(key, threshold)
            plan, merged = planned()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan and sorted(merged) == sorted(rows)
    finally:
        spark.conf.set(key, before)


def test_programs_are_counted_before_they_are_joined(spark, tmp_path):
    images = [r"C:\Tools\Agent.exe", r"C:\Tools\agent.exe", r"C:\x\cmd.exe", "cmd.exe", "exe", "", None]
    spark.createDataFrame([(x,) for i, x in enumerate(images) for _ in range(i + 1)], "image string").write.parquet(f"{tmp_path}/proc_creation.parquet")
    spark.createDataFrame([(x,) for x in ("agent.exe", "AGENT.EXE", "exe", "cmd.exe", "cmd.exe", "", "nowhere.exe", None)], "name string").write.parquet(f"{tmp_path}/mem_netscan.parquet")
    out = QUERIES["suffix_join_of_programs"](spark, str(tmp_path))
    both, one = ["agent.exe", "AGENT.EXE", "exe"], ["cmd.exe", "exe"]
    want = [(images[0], x, 1) for x in both] + [(images[1], x, 2) for x in both] + [(images[2], x, 3) for x in one] + [("cmd.exe", x, 4) for x in one] + [("exe", "exe", 5)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
