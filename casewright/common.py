"""Helpers shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nothing that is recorded here happened earlier; collectors write 0001-01-01 for "no time".
FIRST_REAL_US = 946_684_800_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Column ``name`` as bigint microseconds since 1970 UTC.

    Zoneless timestamps are read as UTC whatever the session's zone; bigint
    columns are taken as microseconds already.
    """
    kind = dict(df.dtypes)[name]
    c = df[name]
    if kind == "bigint":
        return c
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    t = c.cast("timestamp")
    if kind == "timestamp_ntz" and zone not in ("UTC", "Etc/UTC", "Z"):
        t = F.from_utc_timestamp(t, zone)
    return F.unix_micros(t)


def real_time(us: Column) -> Column:
    """True for a stamp that means a time, false for zero times and null."""
    return F.coalesce(us >= FIRST_REAL_US, F.lit(False))


def refuse_names(names: Iterable[str], taken: Iterable[str]) -> None:
    """Key columns may not bear the name of a result column."""
    if clash := sorted(set(names) & set(taken)):
        raise ValueError(f"columns named like result columns: {clash}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    The folder is the session's (spark.checkpoint.dir or setCheckpointDir). On a
    single machine without one, a folder is made and removed at the end; on a
    cluster that is refused, as other machines couldn't read it. With
    spark.cleaner.referenceTracking.cleanCheckpoints Spark removes the files
    once the frame is no longer used.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="casewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def worker_partitions(spark: SparkSession) -> int:
    """Partitions for work that costs far more than its bytes: at least two per core, and what the session sets for shuffles."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A plain table scan over all cores, where its files alone give too few partitions.

    Large tables keep the partitions of their scan; only small ones are
    shuffled. The frame must be a scan (counting its partitions plans it).
    """
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(worker_partitions(df.sparkSession))
