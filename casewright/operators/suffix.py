"""Join of texts with the endings they have: equality of the last characters, not all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_join(df: DataFrame, column: str, endings: DataFrame, ending: str = "suffix") -> DataFrame:
    """Rows of ``df`` with each row of ``endings`` whose text (in any case) theirs ends with.

    A text is looked up by its last n characters for every length n that an
    ending has, so the work is one equality join per length and nothing is
    compared with everything. Null and empty endings and null texts match
    nothing; repeated rows of either side stay repeated. Columns of the same
    name on both sides are refused.

    The texts, repeated once per length, are never broadcast: Spark's estimate
    of them goes by file sizes and can be 200 times too small. Endings are, if
    what they really hold is within the session's threshold; larger ones are
    merged with the texts.
    """
    if clash := set(df.columns) & set(endings.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keyed = endings.filter(F.length(ending) > 0).withColumn("_key", F.lower(ending))
    # only the distinct lengths of endings come to the driver, with the bytes they take: a few numbers, however many endings there are
    row = F.octet_length(F.struct("*").cast("string")) + F.lit(16 * len(keyed.columns) + 32)
    held = [tuple(r) for r in keyed.groupBy(F.length("_key")).agg(F.sum(row)).collect()]
    lengths = sorted(n for n, _ in held)
    text = F.lower(F.col(column))
    ends = F.array(*[F.when(F.length(text) >= n, F.right(text, F.lit(n))) for n in lengths]).cast("array<string>")
    cut = df.withColumn("_key", F.explode(F.filter(ends, lambda x: x.isNotNull())))
    small = sum(size for _, size in held) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return cut.join(keyed.hint("broadcast" if small else "merge"), "_key").drop("_key")
