"""Nearest record in time of the same entity, by tick expansion.

Right records are exploded to every tick that lies within the tolerance of
them; of those that reach a tick from earlier ticks only the latest is kept, of
those from later ticks only the earliest (combined on the map side), so there
is one row per (entity, tick). Left records meet it by an equality join of
(entity, tick): at most one row each, however hot the entity. What remains is
the exact choice among right records of the left record's own tick, which the
ticks alone can't tell apart: a running last and first by time within (entity,
tick), not all pairs of it.

The narrower the tick, the smaller these groups and the more ticks a right
record is in: 2 * ceil(tolerance / tick) + 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import micros, real_time

#: Ticks in a tolerance unless the caller says otherwise.
TICKS = 2


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance_us: int,
    tick_us: int | None = None,
) -> DataFrame:
    """One row (left_id, right_id, diff_us) per left record that has a partner.

    ``left_id`` and ``right_id`` in the result are the values of those columns;
    diff_us is right minus left. The nearest right record at most
    ``tolerance_us`` away (included) wins, of equally near ones the earlier,
    then the one with the smaller id. Rows with a null key, or null or pre-2000
    time pair with nothing. Repeated left rows are paired one by one. Either
    table may be empty; further columns are ignored.
    """
    tick = tick_us or max(1, tolerance_us // TICKS)
    reach = -(-tolerance_us // tick)
    k = [f"_k{i}" for i in range(len(keys))]

    def lean(df: DataFrame, time: str, ident: str) -> DataFrame:
        out = df.select(*[df[c].alias(n) for c, n in zip(keys, k)], micros(df, time).alias("_t"), df[ident].alias("_id")).filter(real_time(F.col("_t")))
        for n in k:
            out = out.filter(F.col(n).isNotNull())
        return out.withColumn("_tick", F.expr(f"_t div {tick}L"))

    ls, rs = lean(left, left_time, left_id), lean(right, right_time, right_id)
    by = [*k, "_tick"]

    # Ticks within the tolerance before and after a right record's own: the record is "later" there or "earlier".
    steps = F.expr(f"filter(sequence(-{reach}L, {reach}L), s -> s <> 0)")
    others = rs.select(*k, F.explode(steps).alias("_s"), "_t", F.col("_id").cast("bigint").alias("_i"), "_tick").withColumn("_tick", F.col("_tick") + F.col("_s"))
    # the latest time, of equal ones the smallest id; the earliest time likewise
    kept = others.groupBy(*by).agg(F.max(F.when(F.col("_s") > 0, F.struct("_t", (-F.col("_i")).alias("_m")))).alias("_e"), F.min(F.when(F.col("_s") < 0, F.struct("_t", "_i"))).alias("_l"))
    kept = kept.select(*by, F.struct(F.col("_e._t").alias("t"), (-F.col("_e._m")).alias("id")).alias("_e"), F.struct(F.col("_l._t").alias("t"), F.col("_l._i").alias("id")).alias("_l"))

    mine = ls.select(*by, "_t", "_id", F.lit(None).cast("struct<t:bigint,id:bigint>").alias("_r"))
    theirs = rs.select(*by, "_t", F.lit(None).cast("bigint").alias("_id"), F.struct(F.col("_t").alias("t"), F.col("_id").cast("bigint").alias("id")).alias("_r"))
    # Left rows come after right rows of the same time, and those with the smaller id come last of all: the running last is the best at or before.
    up = W.partitionBy(*by).orderBy(F.col("_t").asc(), F.col("_r").isNull().asc(), F.col("_r.id").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    # Read backwards, the running last is the earliest later record, of the smallest id.
    down = W.partitionBy(*by).orderBy(F.col("_t").desc(), F.col("_r").isNull().desc(), F.col("_r.id").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = mine.unionByName(theirs).withColumn("_b", F.last("_r", ignorenulls=True).over(up)).withColumn("_n", F.last("_r", ignorenulls=True).over(down)).filter(F.col("_r").isNull())

    met = inside.join(kept, by, "left")
    first = lambda a, b: F.when(F.col(f"{a}.t").isNotNull(), F.col(a)).otherwise(F.col(b))
    near = met.select("_t", "_id", first("_b", "_e").alias("_b"), first("_n", "_l").alias("_n"))
    before, after = F.col("_t") - F.col("_b.t"), F.col("_n.t") - F.col("_t")
    pick = F.when(F.col("_n.t").isNull() | (before <= after), F.col("_b")).otherwise(F.col("_n"))
    paired = near.select(F.col("_id").alias("_l"), "_t", pick.alias("_p")).filter(F.abs(F.col("_p.t") - F.col("_t")) <= tolerance_us)
    return paired.select(F.col("_l").alias("left_id"), F.col("_p.id").alias("right_id"), (F.col("_p.t") - F.col("_t")).alias("diff_us"))
