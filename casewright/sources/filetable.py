"""A master file table of any size: records of fixed length read in splits, extensions merged by number, paths by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut_lineage
from ..schema import TABLES
from .binary import file_record

ROOT = 5
RECORD = "inode bigint, base bigint, name string, short boolean, parent bigint, size bigint, created timestamp, modified timestamp, mft_modified timestamp, accessed timestamp, flags int, streams array<string>"


def _records(parts: Iterator[bytes]) -> Iterator[tuple]:
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    for raw in parts:
        if (r := file_record(bytes(raw))) is not None:
            yield tuple(r[n] for n in names)


def paths(nodes: DataFrame, rounds: int = 8) -> DataFrame:
    """inode, path of nodes (inode, parent, name): each round doubles the distance to the ancestor already known, 2 ** rounds steps in all.

    The root's own name is left out. Where a parent is missing, or parents run
    in a circle, a path begins below it.
    """
    known = cut_lineage(nodes.select("inode", F.col("name").alias("path"), F.col("parent").alias("up")))
    for _ in range(rounds):
        above = known.filter(F.col("inode") != ROOT).select(F.col("inode").alias("up"), F.col("path").alias("_head"), F.col("up").alias("_next"))
        open_ = known.filter((F.col("up") != ROOT) & (F.col("up") != F.col("inode")))
        if open_.join(above.select("up"), "up", "left_semi").isEmpty():
            break
        joined = known.join(above, "up", "left")
        done = F.col("_head").isNull() | (F.col("up") == F.col("inode"))
        known = cut_lineage(joined.select("inode", F.when(done, F.col("path")).otherwise(F.concat_ws("/", "_head", "path")).alias("path"), F.when(done, F.col("up")).otherwise(F.col("_next")).alias("up")))
    return known.select("inode", "path")


def file_table(spark: SparkSession, path: str, record_bytes: int = 1024) -> DataFrame:
    """mft of a file table (one file or a pattern of parts of one table), whatever its size, on any file system.

    Records carry their own numbers (tables of Windows XP and later). A record
    that extends another adds its name, size and streams to it. Damaged records
    are left out; a file without records gives no rows.
    """
    raw = spark.sparkContext.binaryRecords(path, record_bytes).mapPartitions(_records)
    found = spark.createDataFrame(raw, RECORD)
    target = F.when(F.col("base") > 0, F.col("base")).otherwise(F.col("inode"))
    main = F.col("base") == 0
    # the record's own name before its extensions', long names before short ones
    rank = F.struct(F.coalesce("short", F.lit(True)).alias("s"), (~main).alias("m"), F.col("inode"))
    own = lambda n: F.max(F.when(main, F.col(n))).alias(n)
    merged = found.groupBy(target.alias("_n")).agg(
        F.min_by(F.when(F.col("name").isNotNull(), F.struct("name", "parent")), F.when(F.col("name").isNotNull(), rank)).alias("_f"), F.coalesce(F.max(F.when(main, F.col("size"))), F.max("size")).alias("size"), *[own(n) for n in ("created", "modified", "mft_modified", "accessed", "flags")], F.flatten(F.collect_list("streams")).alias("_s"), F.max(main).alias("_main")
    )
    whole = cut_lineage(merged.filter("_main AND _f IS NOT NULL").select(F.col("_n").alias("inode"), F.col("_f.name").alias("name"), F.col("_f.parent").alias("parent"), "size", "created", "modified", "mft_modified", "accessed", "flags", F.array_join(F.array_sort("_s"), ",").alias("_s")))
    out = whole.join(paths(whole), "inode").withColumn("is_dir", F.col("flags").bitwiseAND(2) != 0).withColumn("is_deleted", F.col("flags").bitwiseAND(1) == 0).withColumn("ads_name", F.when(F.col("_s") != "", F.col("_s")))
    return out.withColumn("path", F.when(F.col("inode") == ROOT, "").otherwise(F.col("path"))).select(*[c.split(" ")[0] for c in TABLES["mft"].split(", ")])
