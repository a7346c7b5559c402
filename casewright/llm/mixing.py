"""Sources mixed to target shares of all tokens, by hash thresholds.

Each record has a fixed pseudo-random hash. Tokens are summed per source and
leading hash bits; the running sum over the buckets tells in which bucket the
source's budget ends, and only that bucket is summed again at finer bits, until
it holds next to nothing. The threshold found is a filter on the hash: no row is
sorted, and a smaller budget always selects a subset of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut_lineage
from .tokens import VOCABULARY, count_tokens, ship

BITS_PER_LEVEL, LEVELS = 12, 3


def _bucket(level: int) -> Column:
    """The first (level + 1) * 12 bits of the hash."""
    return F.shiftrightunsigned("_h", 64 - BITS_PER_LEVEL * (level + 1))


def sized_records(df: DataFrame, ident: str, source: str, text: str, vocabulary: str = VOCABULARY, seed: int = 11) -> DataFrame:
    """_id, _source, _n (tokens), _h (64-bit hash) of each row of a non-null id and source."""
    ship(df.sparkSession, vocabulary)
    lean = df.select(df[ident].cast("bigint").alias("_id"), df[source].alias("_source"), df[text].alias("_text")).filter("_id IS NOT NULL AND _source IS NOT NULL")
    return lean.select("_id", "_source", count_tokens(F.col("_text"), vocabulary).alias("_n"), F.xxhash64("_id", F.lit(seed)).alias("_h"))


def _budgets(wanted: DataFrame, have: DataFrame, total: float | None) -> DataFrame:
    """Per source: _share (adjusted), _whole repeats and _need, the tokens of the last, partial one; sources without tokens have none of it."""
    p = wanted.join(have, "_source", "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    usable = (F.col("_target") > 0) & (F.col("_cap") > 0) & (F.col("_have") > 0)
    weight, feasible = p.filter(usable).agg(F.sum("_target"), F.min(F.col("_cap") * F.col("_have") / F.col("_target"))).first()
    if not weight:
        return p.select("*", F.lit(0.0).alias("_share"), F.lit(0).alias("_whole"), F.lit(0.0).alias("_need"))
    size = feasible * weight if total is None else min(feasible * weight, float(total))
    p = p.withColumn("_share", F.when(usable, F.col("_target") / weight).otherwise(0.0)).withColumn("_size", F.col("_share") * size)
    p = p.withColumn("_whole", F.when(usable, F.least("_cap", F.floor(F.col("_size") / F.col("_have") + 1e-9).cast("int"))).otherwise(0))
    rest = F.when(F.col("_whole") < F.col("_cap"), F.greatest(F.lit(0.0), F.col("_size") - F.col("_whole") * F.col("_have"))).otherwise(0.0)
    return p.withColumn("_need", rest).drop("_size")


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, report) of the mixture.

    sized: from ``sized_records``; targets: source, target_share, max_repeats
    (null sources, shares or repeats don't count; of a source listed twice the
    largest share counts), of any number: nothing but two sums comes to the
    driver. total_tokens: size wanted; without it, or where it is too large,
    the largest size at which every source that has records meets its share
    within its repeats. Shares of sources without tokens are spread over the
    others in proportion.

    records: doc_id, source, n_copies, n_tokens, each record used at least once.
    report: source, target_share, adjusted_share, max_repeats, available_tokens,
    used_tokens, actual_share, most_copies, for every target. Repeated ids are
    separate records of equal hash. Sources without target are not used. An
    empty table gives no records, and a report of zeros.
    """
    told = targets.filter("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL")
    wanted = told.groupBy(F.col("source").alias("_source")).agg(F.max(F.struct(F.col("target_share").cast("double").alias("t"), F.col("max_repeats").cast("int").alias("c"))).alias("_x")).select("_source", F.col("_x.t").alias("_target"), F.col("_x.c").alias("_cap"))
    listed = sized.join(wanted.select("_source"), "_source")
    hist = cut_lineage(listed.groupBy("_source", _bucket(0).alias("_b")).agg(F.sum("_n").alias("_t")))
    plan = cut_lineage(_budgets(wanted, hist.groupBy("_source").agg(F.sum("_t").alias("_have")), total_tokens))

    # The bucket in which the partial repeat's budget ends, level by level; at the last one the nearer side of it.
    order = W.partitionBy("_source").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    left = plan.filter("_need >= 1").select("_source", "_need")
    cuts = None
    for level in range(LEVELS):
        if level:
            inside = listed.join(left.select("_source", "_edge"), "_source").filter(_bucket(level - 1) == F.col("_edge"))
            hist = inside.groupBy("_source", _bucket(level).alias("_b")).agg(F.sum("_n").alias("_t"))
        run = hist.join(left.select("_source", "_need"), "_source").withColumn("_sum", F.sum("_t").over(order)).withColumn("_prev", F.col("_sum") - F.col("_t"))
        hit = run.filter((F.col("_prev") < F.col("_need")) & (F.col("_sum") >= F.col("_need"))).groupBy("_source").agg(F.min_by(F.struct("_b", "_prev", "_sum", "_need"), "_b").alias("x"))
        found = F.col("x._b") + F.when(F.col("x._sum") - F.col("x._need") < F.col("x._need") - F.col("x._prev"), 1).otherwise(0) if level == LEVELS - 1 else F.shiftleft("x._b", BITS_PER_LEVEL * (LEVELS - 1 - level))
        here = hit.select("_source", found.cast("bigint").alias(f"_cut{level}"))
        cuts = here if cuts is None else cuts.join(here, "_source", "left")
        left = hit.select("_source", (F.col("x._need") - F.col("x._prev")).alias("_need"), F.col("x._b").alias("_edge"))

    # A source whose budget meets no bucket (by rounding) takes all there is.
    ends = [F.col(f"_cut{level}") for level in range(LEVELS)]
    steps = plan.join(cuts, "_source", "left").select("_source", "_whole", F.when(F.col("_need") >= 1, F.coalesce(*reversed(ends), F.lit(1 << (BITS_PER_LEVEL * LEVELS)))).otherwise(0).alias("_last"))
    copies = F.col("_whole") + F.when(_bucket(LEVELS - 1) < F.col("_last"), 1).otherwise(0)
    chosen = listed.join(steps.filter("_whole > 0 OR _last > 0"), "_source").withColumn("_c", copies).filter("_c > 0")
    records = chosen.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_c").cast("int").alias("n_copies"), F.col("_n").alias("n_tokens"))
    used = records.groupBy("source").agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("used_tokens"), F.max("n_copies").alias("most_copies"))
    base = plan.select(F.col("_source").alias("source"), F.col("_target").alias("target_share"), F.col("_share").alias("adjusted_share"), F.col("_cap").alias("max_repeats"), F.col("_have").cast("bigint").alias("available_tokens"))
    report = base.join(used, "source", "left").fillna(0, ["used_tokens", "most_copies"])
    grand = F.sum("used_tokens").over(W.partitionBy(F.lit(1)))
    report = report.withColumn("actual_share", F.when(grand > 0, F.col("used_tokens") / grand).otherwise(F.lit(0.0)))
    return records, report.select("source", "target_share", "adjusted_share", "max_repeats", "available_tokens", "used_tokens", "actual_share", "most_copies")
