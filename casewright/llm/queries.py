"""Queries of the training-data problems and their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import cut_lineage, spread, table
from .mixing import mix_sources, sized_records
from .nearest import match_nearest
from .newtext import new_lines
from .packing import fill_report, pack_documents
from .pii import found_rows, redact
from .residue import mark_residue


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory connection with the process start nearest to it."""
    net, proc = table(spark, sf_dir, "mem_netscan"), table(spark, sf_dir, "proc_creation")
    return match_nearest(net, proc, ["computer", "pid"], "created", "timestamp", "rec_id", "rec_id", 90_000_000).selectExpr("left_id AS net_id", "right_id AS proc_id")


P3_SQL = """
WITH n AS (SELECT rec_id, computer, pid, epoch_us(created) AS t FROM mem_netscan WHERE pid IS NOT NULL AND created >= TIMESTAMP '2000-01-01'),
p AS (SELECT rec_id, computer, pid, epoch_us("timestamp") AS t FROM proc_creation WHERE pid IS NOT NULL AND "timestamp" >= TIMESTAMP '2000-01-01')
SELECT n.rec_id AS net_id, p.rec_id AS proc_id FROM n JOIN p ON n.computer = p.computer AND n.pid = p.pid AND abs(p.t - n.t) <= 90000000
QUALIFY row_number() OVER (PARTITION BY n.rec_id ORDER BY abs(p.t - n.t), p.t, p.rec_id) = 1
"""

def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in mail bodies and rendered scripts, each text once per record."""
    mails = spread(table(spark, sf_dir, "emails").selectExpr("id AS rec_id", "body_text AS text"))
    scripts = spread(table(spark, sf_dir, "ps_scriptblock").selectExpr("rec_id", "message AS text"))
    names = table(spark, sf_dir, "name_list")
    found = [found_rows(redact(part, "rec_id", "text", names)).selectExpr(f"'{src}' AS src", "record_id AS rec_id", "pii_kind", "pii_text") for src, part in (("emails", mails), ("ps_scriptblock", scripts))]
    return found[0].unionByName(found[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newly written lines of every mail."""
    return new_lines(table(spark, sf_dir, "emails")).selectExpr("mail_id AS email_id", "line_no")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns needed of the documents, over all cores."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The container kinds (a fixed table of three rows)."""
    return {r[0]: r[1] for r in table(spark, sf_dir, "pack_sizes").select("pack_kind", "capacity_tokens").orderBy("pack_kind").collect()}


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each capacity."""
    return pack_documents(_documents(spark, sf_dir, "doc_id", "text"), _capacities(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill_report(p8_packing(spark, sf_dir), _capacities(spark, sf_dir))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the packing keeps its promises: every document once, no container too full, no text cut without need, hardly more containers than must be."""
    capacities = _capacities(spark, sf_dir)
    packed = cut_lineage(p8_packing(spark, sf_dir))
    documents = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").count()
    cap = F.create_map(*[F.lit(x) for k, v in capacities.items() for x in (k, v)])[F.col("pack_kind")]
    full = packed.groupBy("pack_kind", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("pack_kind").agg(F.count_if(F.col("n") > cap).alias("over"), F.count(F.lit(1)).alias("used"), F.sum("n").alias("tokens"))
    parts = packed.groupBy("pack_kind", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n")).groupBy("pack_kind").agg(F.count(F.lit(1)).alias("docs"), F.count_if((F.col("parts") > 1) & (F.col("n") <= cap)).alias("cut"))
    both = full.join(parts, "pack_kind")
    return both.select("pack_kind", cap.alias("capacity_tokens"), F.col("docs").alias("n_documents"), F.col("over").alias("n_too_full"), F.col("cut").alias("n_cut_without_need"), (F.col("used") <= F.ceil(F.col("tokens") / cap) * 1.01 + 1).alias("hardly_more_than_must_be")).filter(F.lit(documents) > 0)


P8_CHECKS_SQL = """
SELECT pack_kind, capacity_tokens, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS n_documents, CAST(0 AS BIGINT) AS n_too_full, CAST(0 AS BIGINT) AS n_cut_without_need, true AS hardly_more_than_must_be FROM pack_sizes
"""


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mixture keeps its promises: repeats within the cap, each source within half its largest record of its share (and what the others are off)."""
    sized = cut_lineage(sized_records(_documents(spark, sf_dir, "doc_id", "source", "text"), "doc_id", "source", "text"))
    records, report = mix_sources(sized, table(spark, sf_dir, "mix_targets"))
    largest = sized.groupBy(F.col("_source").alias("source")).agg(F.max("_n").alias("largest"), F.sum("_n").alias("has"))
    known = report.join(largest, "source", "left").fillna(0, ["largest", "has"])
    every = Window.partitionBy(F.lit(1))  # one row per target
    off, total = F.sum(F.when(F.col("used_tokens") > 0, F.col("largest") / 2).otherwise(0)).over(every), F.sum("used_tokens").over(every)
    near = F.abs(F.col("used_tokens") - F.col("adjusted_share") * total) <= F.col("largest") / 2 + F.col("adjusted_share") * off + 1
    return known.select("source", "target_share", "max_repeats", near.alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (F.col("available_tokens") == F.col("has")).alias("all_tokens_counted"))


P9_CHECKS_SQL = "SELECT source, target_share, max_repeats, true AS share_met, true AS repeats_kept, true AS all_tokens_counted FROM mix_targets WHERE source IS NOT NULL"


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = cut_lineage(sized_records(_documents(spark, sf_dir, "doc_id", "source", "text"), "doc_id", "source", "text"))
    return mix_sources(sized, table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their number of copies."""
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by each source."""
    return _mixture(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with residue in place of content."""
    return mark_residue(_documents(spark, sf_dir, "doc_id", "text")).filter("is_residue").selectExpr("record_id AS doc_id").distinct()


QUERIES = {"p3_found": p3_found, "p6_found": p6_found, "p7_found": p7_found, "p8_packing": p8_packing, "p8_fill": p8_fill, "p8_checks": p8_checks, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_checks": p9_checks, "p10_found": p10_found}
ORACLE = {"p3_found": P3_SQL, "p8_checks": P8_CHECKS_SQL, "p9_checks": P9_CHECKS_SQL}
