"""Overlapping and gapped intervals: continuous periods and the holes between them.

Two levels. Each interval is clipped at the borders of fixed time shards: its
first and last piece go to their shards, the whole shards between them are kept
as one range in the first of them. Pieces are merged inside (entity, shard), so
an entity with very many rows is spread over its shards. Of each shard only
what touches a border, and one block that stands for all its other pieces, is
then stitched per entity; these rows are bounded by the covered shards, not by
the input. Blocks that no longer range covers give their pieces back.

Pieces, stitching rows and surviving blocks are shuffled once each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import micros, real_time, refuse_names

DAY_US = 86_400_000_000


def _numbered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the number (_i) of the run of overlapping or touching [_a, _z] that a row belongs to within ``by``."""
    order = W.partitionBy(*by).orderBy("_a", "_z")
    reach = F.max("_z").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_f", F.when(F.col("_a") <= reach, 0).otherwise(1))
    return marked.withColumn("_i", F.sum("_f").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_f")


def _shard_pieces(df: DataFrame, keys: Sequence[str], k: Sequence[str], start: str, end: str, shard_us: int) -> DataFrame:
    """Merged pieces inside (entity, shard): k, _shard, _a, _z, _touch (reaches a border of the shard)."""
    a, z = micros(df, start), micros(df, end)
    whole = df.select(*[df[c].alias(n) for c, n in zip(keys, k)], a.alias("_a"), z.alias("_z")).filter(real_time(F.col("_a")) & real_time(F.col("_z")) & (F.col("_z") >= F.col("_a")))
    for n in k:
        whole = whole.filter(F.col(n).isNotNull())
    cut = whole.withColumn("_lo", F.expr(f"_a div {shard_us}L")).withColumn("_hi", F.expr(f"_z div {shard_us}L"))
    border = f"{shard_us}L"
    # one piece, or the two ends and the whole shards between them
    pieces = cut.select(
        *k,
        F.inline(
            F.expr(
                f"""if(_lo = _hi, array(named_struct('_shard', _lo, '_a', _a, '_z', _z)),
                    concat(array(named_struct('_shard', _lo, '_a', _a, '_z', (_lo + 1) * {border}),
                                 named_struct('_shard', _hi, '_a', _hi * {border}, '_z', _z)),
                           if(_hi > _lo + 1, array(named_struct('_shard', _lo + 1, '_a', (_lo + 1) * {border}, '_z', _hi * {border})), array())))"""
            )
        ),
    ).filter("_shard IS NOT NULL")  # what the join below asks for: stated here, both readings of the pieces are the same shuffle
    by = [*k, "_shard"]
    merged = _numbered(pieces, by).groupBy(*by, "_i").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z")).drop("_i")
    return merged.withColumn("_touch", (F.col("_a") == F.col("_shard") * shard_us) | (F.col("_z") >= (F.col("_shard") + 1) * shard_us))


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, shard_us: int = DAY_US) -> DataFrame:
    """kind ('period' or 'gap') + ``keys`` + start_us, end_us: continuous periods of each entity and the holes between them.

    Intervals that overlap, nest or touch become one period. Rows with a null
    key, a null or pre-2000 end point, or end before start don't count; end
    equal to start does. Repeated rows change nothing; empty input gives no
    rows. ``shard_us`` sets the grain of the work, never the result.
    """
    refuse_names(keys, ("kind", "start_us", "end_us"))
    k = [f"_k{i}" for i in range(len(keys))]
    local = _shard_pieces(df, keys, k, start, end, shard_us)

    # Stitching: pieces at borders one by one, the others of a shard as one block. A block meets another row only where a range covers its whole shard.
    outline = local.groupBy(*k, "_shard", F.when(F.col("_touch"), F.col("_a")).alias("_own")).agg(F.min("_a").alias("_a"), F.max("_z").alias("_z")).select(*k, "_a", "_z", F.when(F.col("_own").isNull(), F.col("_shard")).alias("_block"))
    runs = _numbered(outline, k).groupBy(*k, "_i").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.when(F.count(F.lit(1)) == 1, F.max("_block")).alias("_block"))
    linked = runs.withColumn("_before", F.lag("_z").over(W.partitionBy(*k).orderBy("_a")))

    def emitted(frame: DataFrame, period: Column) -> DataFrame:
        """The rows' periods (where the condition holds) and the gaps before them."""
        one = F.array(F.struct(F.lit("period").alias("kind"), F.col("_a").alias("start_us"), F.col("_z").alias("end_us")))
        gap = F.array(F.struct(F.lit("gap").alias("kind"), F.col("_before").alias("start_us"), F.col("_a").alias("end_us")))
        none = F.array().cast("array<struct<kind:string,start_us:bigint,end_us:bigint>>")
        return frame.select(*k, F.inline(F.concat(F.when(period, one).otherwise(none), F.when(F.col("_before").isNotNull(), gap).otherwise(none))))

    outer = emitted(linked, F.col("_block").isNull())
    alive = linked.filter("_block IS NOT NULL").select(*k, F.col("_block").alias("_shard"))
    inner = local.filter(~F.col("_touch")).join(alive, [*k, "_shard"], "left_semi")
    inner = emitted(inner.withColumn("_before", F.lag("_z").over(W.partitionBy(*k, "_shard").orderBy("_a"))), F.lit(True))
    return outer.unionByName(inner).select("kind", *[F.col(n).alias(c) for c, n in zip(keys, k)], "start_us", "end_us")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, shard_us: int = DAY_US) -> DataFrame:
    """Continuous periods alone: ``keys`` + start_us, end_us, by the rules of ``periods_and_gaps``."""
    return periods_and_gaps(df, keys, start, end, shard_us).filter("kind = 'period'").drop("kind")


def gaps(periods: DataFrame, keys: Sequence[str], shard_us: int = DAY_US) -> DataFrame:
    """Holes between the periods of an entity (``keys``, start_us, end_us); periods that overlap are taken together."""
    named = periods.select(*keys, F.col("start_us").alias("_from"), F.col("end_us").alias("_to"))
    return periods_and_gaps(named, keys, "_from", "_to", shard_us).filter("kind = 'gap'").drop("kind")
