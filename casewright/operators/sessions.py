"""Sessions: events of an entity split where it was idle.

Events are first reduced to *cells* (a fraction of the gap) per entity: first
and last time and number of events. 64 neighbouring cells make one word of an
occupancy bitmap. The bitmap is closed (dilated, then eroded) by as many cells
as surely lie within the gap, by doubling shifts; its runs are sessions up to
cell resolution. The runs take the cells' counts and their first and last
times, and neighbouring runs whose trimmed ends are at most one gap apart are
joined, which makes the result exact to the microsecond.

At scale: events meet in one map-side combined aggregation by entity and cell,
so a hot entity is spread over its cells there; what is then kept per entity
is bounded by the covered time span over the cell width, not by its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import micros, real_time, refuse_names

RESULT = ("start_us", "end_us", "duration_us", "n_events")


def doubling(reach: int) -> list[int]:
    """Shifts whose repeated application covers 0..reach cells."""
    shifts, covered = [], 0
    while covered < reach:
        step = min(covered + 1, reach - covered)
        shifts.append(step)
        covered += step
    return shifts


def _steps(shifts: list[int]) -> Column:
    return F.array(*[F.lit(s) for s in shifts]) if shifts else F.expr("cast(array() as array<int>)")


def dilate(word: Column, before: Column, shifts: list[int]) -> Column:
    """Bits of ``word`` that lie at most the reach after a bit of ``word`` or the word before it."""

    def step(acc: Column, s: Column) -> Column:
        hi, lo = acc["hi"], acc["lo"]
        up = F.call_function("shiftleft", hi, s).bitwiseOR(F.call_function("shiftrightunsigned", lo, F.lit(64) - s))
        return F.struct(hi.bitwiseOR(up).alias("hi"), lo.bitwiseOR(F.call_function("shiftleft", lo, s)).alias("lo"))

    return F.aggregate(_steps(shifts), F.struct(word.alias("hi"), before.alias("lo")), step, lambda acc: acc["hi"])


def erode(word: Column, after: Column, shifts: list[int]) -> Column:
    """Bits of ``word`` whose next bits, as far as the reach, are all set in ``word`` and the word after it."""

    def step(acc: Column, s: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        down = F.call_function("shiftrightunsigned", lo, s).bitwiseOR(F.call_function("shiftleft", hi, F.lit(64) - s))
        return F.struct(lo.bitwiseAND(down).alias("lo"), hi.bitwiseAND(F.call_function("shiftrightunsigned", hi, s)).alias("hi"))

    return F.aggregate(_steps(shifts), F.struct(word.alias("lo"), after.alias("hi")), step, lambda acc: acc["lo"])


def sessionize(df: DataFrame, keys: Sequence[str], time: str, gap_us: int, cells_per_gap: int = 30) -> DataFrame:
    """Sessions of each entity: ``keys`` + start_us, end_us, duration_us, n_events.

    df: events; time: a timestamp or bigint microseconds; a gap of more than
    ``gap_us`` starts a new session, one of exactly ``gap_us`` does not.
    cells_per_gap (2..64) trades bitmap size against exact joins; it never
    changes the result.

    Rows with a null key, null or pre-2000 time are no events. Equal times and
    repeated rows are counted one by one. A lone event is a session of duration
    0. Empty input gives no rows. Further columns are ignored; a key named like
    a result column is refused.
    """
    if gap_us < 0 or not 2 <= cells_per_gap <= 64:
        raise ValueError("gap_us must not be negative and cells_per_gap lies in 2..64")
    refuse_names(keys, RESULT)
    width = max(1, gap_us // cells_per_gap)
    # Closing by r cells fills holes of up to r: cells r + 1 apart are then joined, and lie less than r + 2 widths apart.
    reach = max(0, min(63, gap_us // width - 2))
    shifts = doubling(reach)
    k = [f"_k{i}" for i in range(len(keys))]

    t = micros(df, time)
    events = df.select(*[df[c].alias(n) for c, n in zip(keys, k)], t.alias("_t")).filter(real_time(F.col("_t")))
    for n in k:
        events = events.filter(F.col(n).isNotNull())
    if gap_us == 0:  # a session is one instant
        instants = events.groupBy(*k, "_t").agg(F.count(F.lit(1)).alias("n_events"))
        return instants.select(*[F.col(n).alias(c) for c, n in zip(keys, k)], F.col("_t").alias("start_us"), F.col("_t").alias("end_us"), F.lit(0).cast("bigint").alias("duration_us"), "n_events")
    cell = F.expr(f"_t div {width}L")
    cells = events.groupBy(*k, cell.alias("_cell")).agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"), F.count(F.lit(1)).alias("_n"))

    bit = F.expr("cast(_cell % 64 as int)")
    words = (
        cells.repartition(*k)
        .groupBy(*k, F.expr("_cell div 64").alias("_w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits"), F.collect_list(F.struct(bit.alias("b"), "_a", "_z", "_n")).alias("_cells"))
    )
    order = W.partitionBy(*k).orderBy("_w")
    zero = F.lit(0).cast("bigint")
    prev = F.when(F.lag("_w").over(order) == F.col("_w") - 1, F.lag("_bits").over(order)).otherwise(zero)
    succ = F.when(F.lead("_w").over(order) == F.col("_w") + 1, F.lead("_bits").over(order)).otherwise(zero)
    # Shift by one word is no shift in the JVM (only six bits of it count): reach stays below 64.
    near = words.withColumn("_prev", prev).withColumn("_next", succ)
    grown = near.withColumn("_d", dilate(F.col("_bits"), F.col("_prev"), shifts)).withColumn("_dn", dilate(F.col("_next"), F.col("_bits"), shifts))
    closed = grown.withColumn("_e", erode(F.col("_d"), F.col("_dn"), shifts).bitwiseOR(F.col("_bits")))
    top = F.when(F.lag("_w").over(order) == F.col("_w") - 1, F.shiftrightunsigned(F.lag("_e").over(order), 63)).otherwise(zero)
    begins = closed.withColumn("_s", F.col("_e").bitwiseAND(F.bitwise_not(F.shiftleft("_e", 1).bitwiseOR(top))))
    numbered = begins.withColumn("_before", F.sum(F.bit_count("_s")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.bit_count("_s"))
    placed = numbered.select(*k, "_s", "_before", F.inline("_cells"))
    upto = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(63) - F.col("b"))
    runs = (
        placed.withColumn("_run", F.col("_before") + F.bit_count(F.col("_s").bitwiseAND(upto)))
        .groupBy(*k, "_run")
        .agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.sum("_n").alias("_n"))
    )
    by_start = W.partitionBy(*k).orderBy("_a")
    fresh = F.when(F.col("_a") - F.lag("_z").over(by_start) <= gap_us, 0).otherwise(1)
    joined = (
        runs.withColumn("_f", fresh)
        .withColumn("_sess", F.sum("_f").over(by_start.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(*k, "_sess")
        .agg(F.min("_a").alias("start_us"), F.max("_z").alias("end_us"), F.sum("_n").alias("n_events"))
    )
    return joined.select(*[F.col(n).alias(c) for c, n in zip(keys, k)], "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")
