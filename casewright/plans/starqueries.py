"""Functions and operators of the library on the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..detect.findings import multi_source
from ..detect.patterns import matches
from ..functions.text import basename, bit_names, filetime, hex_to_int, joined
from ..operators.intervals import periods_and_gaps
from ..operators.sessions import sessionize
from ..operators.suffix import suffix_join
from .export import as_text
from .library import neighbourhood, top

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


class Star:
    """Attribute access to the tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, sql: str):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Star(spark, sf_dir))
        ORACLE[name] = sql
        return fn

    return keep


def us(x) -> F.Column:
    return F.unix_micros((c(x) if isinstance(x, str) else x).cast("timestamp"))


@query("events_types_per_user", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(*) >= 2")
def _(s: Star) -> DataFrame:
    return s.events.groupBy("user_id").agg(joined("event_type").alias("types"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows >= 2")


@query("multi_source_values", "SELECT k AS value, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ' + ' ORDER BY source) AS sources, 'LOW' AS worst FROM (SELECT CAST(user_id AS VARCHAR) AS k, event_type AS source FROM events UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'orders' FROM orders) GROUP BY 1 HAVING count(DISTINCT source) > 1")
def _(s: Star) -> DataFrame:
    found = s.events.select(c("user_id").cast("string").alias("value"), c("event_type").alias("source")).unionByName(s.orders.select(c("o_custkey").cast("string").alias("value"), F.lit("orders").alias("source")))
    return multi_source(found.withColumn("confidence", F.lit("LOW")))


@query("suffix_join", "SELECT p_partkey, p_type, w AS suffix FROM part JOIN (VALUES ('STANDARD'), ('PROMO'), ('SMALL')) AS x(w) ON ends_with(lower(p_type), lower(w))")
def _(s: Star) -> DataFrame:
    endings = s.spark.createDataFrame([("STANDARD",), ("PROMO",), ("SMALL",)], "suffix string")
    return suffix_join(s.part.select("p_partkey", "p_type"), "p_type", endings)


@query("suffix_join_of_programs", "SELECT i.image, p.name, count(*) AS n_rows FROM proc_creation i JOIN (SELECT DISTINCT name FROM mem_netscan WHERE name <> '') p ON ends_with(lower(i.image), lower(p.name)) GROUP BY 1, 2")
def _(s: Star) -> DataFrame:
    names = s.mem_netscan.select("name").distinct()
    # an image is counted before it meets the names, which are distinct: (image, name) then comes out once
    images = s.proc_creation.groupBy("image").agg(F.count(F.lit(1)).alias("n_rows"))
    return suffix_join(images, "image", names, "name").select("image", "name", "n_rows")


_EDGE = "SELECT cn.n_name AS src, sn.n_name AS dst, count(*) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2"


def _edges(s: Star) -> DataFrame:
    cust = s.customer.join(s.nation, c("c_nationkey") == c("n_nationkey")).select("c_custkey", c("n_name").alias("src"))
    supp = s.supplier.join(s.nation, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", c("n_name").alias("dst"))
    lines = s.lineitem.select("l_orderkey", "l_suppkey").join(s.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    # pre-aggregated on the customer and supplier keys before names are joined
    slim = lines.groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return slim.join(cust, c("o_custkey") == c("c_custkey")).join(supp, c("l_suppkey") == c("s_suppkey")).groupBy("src", "dst").agg(F.sum("n").alias("n_rows"))


@query("star_graph_2hop", f"WITH e AS ({_EDGE}), h AS (SELECT * FROM e WHERE n_rows >= 120), l AS (SELECT src AS a, dst AS b FROM h UNION SELECT dst, src FROM h), n1 AS (SELECT 'NATION_1' AS node UNION SELECT b FROM l WHERE a = 'NATION_1'), n2 AS (SELECT node FROM n1 UNION SELECT b FROM l WHERE a IN (SELECT node FROM n1)) SELECT * FROM h WHERE src IN (SELECT node FROM n2) AND dst IN (SELECT node FROM n2)")
def _(s: Star) -> DataFrame:
    return neighbourhood(_edges(s).filter("n_rows >= 120"), "NATION_1").select("src", "dst", "n_rows")


@query("pattern_any_all", "SELECT count(*) FILTER (contains(text, 'certutil') OR contains(text, 'mshta')) AS n_any, count(*) FILTER (contains(text, 'timeline') AND contains(text, 'second')) AS n_all FROM documents")
def _(s: Star) -> DataFrame:
    return s.documents.agg(F.count(F.when(matches(c("text"), ("certutil", "mshta")), 1)).alias("n_any"), F.count(F.when(matches(c("text"), ("timeline", "second"), "all"), 1)).alias("n_all"))


@query("bitmask_names", "SELECT p_partkey, concat_ws('|', CASE WHEN p_size & 1 <> 0 THEN 'A' END, CASE WHEN p_size & 2 <> 0 THEN 'B' END, CASE WHEN p_size & 4 <> 0 THEN 'C' END, CASE WHEN p_size & 32 <> 0 THEN 'D' END) AS names FROM part")
def _(s: Star) -> DataFrame:
    return s.part.select("p_partkey", bit_names("p_size", {1: "A", 2: "B", 4: "C", 32: "D"}).alias("names"))


@query("filetime_convert", "SELECT o_orderkey, epoch_us(o_orderdate) AS back_us FROM orders")
def _(s: Star) -> DataFrame:
    return s.orders.select("o_orderkey", us(filetime(us("o_orderdate") * 10 + 116_444_736_000_000_000)).alias("back_us"))


@query("hex_to_int", "SELECT l_orderkey, l_linenumber, l_suppkey AS back FROM lineitem")
def _(s: Star) -> DataFrame:
    return s.lineitem.select("l_orderkey", "l_linenumber", hex_to_int(F.concat(F.lit("0x"), F.hex("l_suppkey"))).alias("back"))


@query("export_csv_format", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, coalesce(o_orderstatus, '') AS o_orderstatus FROM orders")
def _(s: Star) -> DataFrame:
    return as_text(s.orders.select("o_orderkey", "o_orderdate", "o_orderstatus"))


@query("top_programs", "SELECT regexp_extract(lower(image), '[^/\\\\]*$', 0) AS program, count(*) AS n_rows FROM proc_creation WHERE image IS NOT NULL GROUP BY 1 ORDER BY n_rows DESC, 1 LIMIT 10")
def _(s: Star) -> DataFrame:
    return top(s.proc_creation.filter("image IS NOT NULL"), basename("image"), 10, "program")


_GAP = 6 * 3_600_000_000


@query("event_sessions", f"WITH f AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= {_GAP} THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM f) SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_events FROM n GROUP BY user_id, i")
def _(s: Star) -> DataFrame:
    return sessionize(s.events, ["user_id"], "ts", _GAP).select("user_id", "start_us", "end_us", c("n_events").cast("bigint").alias("n_events"))


@query("order_periods", "WITH iv AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS a, epoch_us(max(l_shipdate)) AS z FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate HAVING max(l_shipdate) >= o_orderdate), f AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY k ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv WHERE a >= 946684800000000), n AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS i FROM f), p AS (SELECT k, min(a) AS start_us, max(z) AS end_us FROM n GROUP BY k, i), g AS (SELECT k, lag(end_us) OVER (PARTITION BY k ORDER BY start_us) AS start_us, start_us AS end_us FROM p) SELECT 'period' AS kind, k, start_us, end_us FROM p UNION ALL SELECT 'gap', k, start_us, end_us FROM g WHERE start_us IS NOT NULL")
def _(s: Star) -> DataFrame:
    last = s.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("until"))
    spans = s.orders.join(last, c("o_orderkey") == c("l_orderkey")).select(c("o_custkey").alias("k"), "o_orderdate", "until")
    return periods_and_gaps(spans, ["k"], "o_orderdate", "until")
