"""Statistics, graphs and lists over a case."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, has, is_private_ip, joined, low, ordered, severity_rank, starts
from ..schema import TABLES, Case

c = F.col


def counts(case: Case) -> DataFrame:
    """Rows of every collected table."""
    out = None
    for t in TABLES:
        if case.has(t):
            one = case[t].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else case.spark.createDataFrame([], "table_name string, n_rows bigint")


def detections(findings: DataFrame) -> DataFrame:
    """Hits, range of times and title of each source of findings."""
    title = F.trim(F.substring_index("notes", " —", 1))
    return findings.groupBy("source", "confidence").agg(F.count(F.lit(1)).alias("hits"), F.min("first_seen").alias("first_ts"), F.max("first_seen").alias("last_ts"), F.min(title).alias("title"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: high, med, low, verdict by the number of severe findings."""
    agg = findings.agg(*[F.count(F.when(severity_rank("confidence") == r, 1)).alias(n) for n, r in (("high", 3), ("med", 2), ("low", 1))])
    grade = F.when(c("high") >= 50, "CRITICAL").when(c("high") >= 10, "HIGH").when(c("high") >= 1, "ELEVATED").when(c("med") >= 1, "LOW").otherwise("CLEAN")
    return agg.withColumn("verdict", grade)


def tactics(findings: DataFrame) -> DataFrame:
    """Findings per technique, of every technique named."""
    each = findings.filter("related_campaign IS NOT NULL").select(F.explode(F.split("related_campaign", "[,/]")).alias("t"), "confidence", "source")
    return each.select(F.left(F.trim("t"), F.lit(5)).alias("technique"), "confidence", "source").filter(c("technique").rlike(r"^T\d{4}$")).groupBy("technique").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("source").alias("n_sources"), F.max_by("confidence", severity_rank("confidence")).alias("worst"))


def auth_stats(case: Case) -> DataFrame:
    """Logons by user: successes, failures, explicit ones, addresses, range of times."""
    a = case["auth_events"].filter("user IS NOT NULL AND user <> ''")
    return a.groupBy(F.lower("user").alias("account")).agg(
        F.count(F.when(c("event_id") == 4624, 1)).alias("n_success"),
        F.count(F.when(c("event_id") == 4625, 1)).alias("n_failed"),
        F.count(F.when(c("event_id") == 4648, 1)).alias("n_explicit"),
        F.countDistinct("src_ip").alias("n_ips"),
        F.count(F.when(c("logon_type") == 9, 1)).alias("n_type9"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def logon_types(case: Case) -> DataFrame:
    return case["auth_events"].groupBy("logon_type", "event_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user").alias("n_users"))


def event_stats(case: Case, top: int = 30) -> DataFrame:
    """The most frequent events by id and channel."""
    return case["evtx_events"].groupBy("event_id", "channel").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(c("n_rows").desc(), "event_id", "channel").limit(top)


def process_stats(case: Case) -> DataFrame:
    """Started programs by name: starts, users, parents, suspicious ones."""
    p = case["proc_creation"].filter("image IS NOT NULL")
    return p.groupBy(basename("image").alias("program")).agg(
        F.count(F.lit(1)).alias("n_starts"),
        F.countDistinct(F.lower("user_name")).alias("n_users"),
        F.countDistinct(basename("parent_image")).alias("n_parents"),
        F.count(F.when(c("integrity_level").isin("High", "System"), 1)).alias("n_elevated"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def user_activity(case: Case, findings: DataFrame | None = None) -> DataFrame:
    """Every account with its process starts, logons and findings; 0 where there are none."""
    strip = F.lower(F.element_at(F.split("user_name", r"\\"), -1))
    procs = case["proc_creation"].filter("user_name IS NOT NULL AND user_name <> ''").groupBy(strip.alias("account")).agg(F.count(F.lit(1)).alias("n_procs"), F.countDistinct(basename("image")).alias("n_programs"))
    auths = case["auth_events"].filter("user IS NOT NULL AND user <> ''").groupBy(F.lower("user").alias("account")).agg(F.count(F.lit(1)).alias("n_auth"), F.count(F.when(c("event_id") == 4625, 1)).alias("n_failed"))
    users = procs.select("account").union(auths.select("account")).distinct()
    out = users.join(procs, "account", "left").join(auths, "account", "left")
    if findings is not None:
        named = findings.groupBy(F.lower(F.substring_index("value", "@", 1)).alias("account")).agg(F.count(F.lit(1)).alias("n_findings"))
        out = out.join(named, "account", "left")
    return out.fillna(0)


def hashes(case: Case, findings: DataFrame | None = None) -> DataFrame:
    """Hashes of files in all tables: who reports them, names, and whether they are known bad."""
    parts = [("amcache", "sha256", "path"), ("prefetch", "sha256", "path"), ("defender_events", "sha256", "path"), ("sysmon_process", "sha256", "image"), ("sysmon_imageload", "sha256", "image_loaded"), ("email_attachments", "sha256", "filename")]
    every = None
    for t, h, name in parts:
        one = case[t].filter(F.length(h) >= 32).select(F.lower(h).alias("hash"), F.lit(t).alias("source"), c(name).alias("name"))
        every = one if every is None else every.unionByName(one)
    agg = every.groupBy("hash").agg(joined("source").alias("sources"), F.countDistinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_rows"), F.min("name").alias("name"))
    if findings is None:
        return agg.withColumn("worst", F.lit(None).cast("string"))
    bad = findings.groupBy(F.lower("value").alias("hash")).agg(F.max_by("confidence", severity_rank("confidence")).alias("worst"))
    return agg.join(bad, "hash", "left")


def graph_edges(case: Case) -> DataFrame:
    """Parent and child programs: src, dst, n_starts, n_users, first and last start."""
    p = case["proc_creation"].filter("image IS NOT NULL AND parent_image IS NOT NULL")
    return p.groupBy(basename("parent_image").alias("src"), basename("image").alias("dst")).agg(F.count(F.lit(1)).alias("n_starts"), F.countDistinct(F.lower("user_name")).alias("n_users"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def neighbourhood(edges: DataFrame, centre: str, hops: int = 2) -> DataFrame:
    """Edges among nodes at most so many hops from a node, in either direction; the frontier is a distinct set per hop."""
    links = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("a", "b")
    near = edges.sparkSession.createDataFrame([(centre,)], "node string")
    for _ in range(hops):
        near = near.union(links.join(near, c("a") == c("node"), "left_semi").select("b")).distinct()
    keep_src, keep_dst = near.withColumnRenamed("node", "src"), near.withColumnRenamed("node", "dst")
    return edges.join(keep_src, "src", "left_semi").join(keep_dst, "dst", "left_semi").select(edges.columns)


def process_tree(case: Case) -> DataFrame:
    """Processes in memory with command line, parent's name and starts seen by the log."""
    ps, started = case["mem_pslist"], case["proc_creation"].groupBy(basename("image").alias("_k")).agg(F.count(F.lit(1)).alias("n_logged"), F.max("timestamp").alias("last_logged"))
    parent = ps.select(c("pid").alias("ppid"), c("name").alias("parent_name"))
    return ps.join(case["mem_cmdline"].select("pid", "cmdline"), "pid", "left").join(parent, "ppid", "left").withColumn("_k", F.lower("name")).join(started, "_k", "left").drop("_k")


def network_correlation(case: Case, findings: DataFrame) -> DataFrame:
    """Remote addresses in memory with findings and logons from them."""
    net = case["mem_netscan"].filter("remote_addr IS NOT NULL AND remote_addr NOT IN ('', '*', '0.0.0.0', '::')").groupBy("remote_addr").agg(F.count(F.lit(1)).alias("n_conns"), joined("name").alias("programs"))
    bad = findings.groupBy(c("value").alias("remote_addr")).agg(F.count(F.lit(1)).alias("n_findings"))
    auth = case["auth_events"].groupBy(c("src_ip").alias("remote_addr")).agg(F.countDistinct("timestamp").alias("n_logons"))
    return net.join(bad, "remote_addr", "left").join(auth, "remote_addr", "left").fillna(0, ["n_findings", "n_logons"]).withColumn("is_private", is_private_ip("remote_addr"))


def hidden_processes(case: Case) -> DataFrame:
    return case["mem_psscan"].join(case["mem_pslist"].select("pid"), "pid", "left_anti")


def malfind_groups(case: Case) -> DataFrame:
    """Injected memory by process, its hits nested."""
    return case["mem_malfind"].groupBy("pid", "name").agg(F.count(F.lit(1)).alias("n_hits"), F.array_sort(F.collect_list(F.struct("address", "size", "reason", "vad_tag"))).alias("hits"))


def mail_stats(case: Case) -> DataFrame:
    """Mails by folder: number, senders, attachments, range of times."""
    e = case["emails"].withColumn("_at", F.coalesce("sent_at", "received_at"))
    return e.groupBy("folder").agg(F.count(F.lit(1)).alias("n_mails"), F.countDistinct(F.lower("from_addr")).alias("n_senders"), F.count(F.when(c("has_attachments"), 1)).alias("n_with_files"), F.min("_at").alias("first_ts"), F.max("_at").alias("last_ts"))


def top(df: DataFrame, key: Column, n: int = 10, name: str = "key") -> DataFrame:
    """The most frequent values, ties by value."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(c("n_rows").desc(), c(name).asc_nulls_last()).limit(n)


# ---- lists with filters: one function for the many that only differ in table and columns

# Pieces of addresses that are worth a look (and any address without encryption), and pieces of keys that start programs (parted by …).
SUSPICIOUS_URLS = ("pastebin", "hastebin", "paste.ee", "mega.nz", "gofile.io", "sendspace", "wetransfer", "anonfiles", "bayfiles", "raw.githubusercontent", "bit.ly", "tinyurl")
AUTORUN_KEYS = ("\\currentversion\\run", "\\currentversion\\runonce", "\\winlogon", "image file execution options", "appcertdlls", "appinitdlls", "\\policies\\explorer\\run", "shellserviceobjectdelayload", "\\services\\…imagepath", "bootexecute", "sessionmanager\\subsystems", "lsa\\", "netsh\\", "print\\providers", "securityproviders")


def listed(case: Case, table: str, term: str | None = None, columns: tuple[str, ...] = (), newest: str | None = None, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows of a table that hold a term in some columns, newest first."""
    df = case[table]
    if where is not None:
        df = df.filter(where)
    if term:
        df = df.filter(has(F.concat_ws("\n", *columns), term.lower()))
    if newest:
        df = df.orderBy(c(newest).desc_nulls_last(), *[c(x) for x in columns])
    return df.limit(limit) if limit else df


def suspicious_urls(case: Case) -> DataFrame:
    return listed(case, "browser_history", where=has("url", *SUSPICIOUS_URLS) | starts("url", "http://"))


def autoruns(case: Case) -> DataFrame:
    return listed(case, "registry_raw", where=ordered("key_path", *AUTORUN_KEYS))


# ---- free SQL

_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


def free_query(spark: SparkSession, sql: str, limit: int = 2000) -> DataFrame:
    """A single SELECT or WITH over the registered tables, at most ``limit`` rows; everything else is refused."""
    text = _COMMENT.sub(" ", sql).strip().rstrip(";").strip()
    if not re.match(r"(?is)^(?:select|with)\b", text) or ";" in re.sub(r"'(?:[^'\\]|\\.)*'", "''", text):
        raise ValueError("only one SELECT or WITH statement is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if "Command" in plan.getClass().getName() or "Insert" in plan.getClass().getName():
        raise ValueError("only queries are allowed")
    return spark.sql(text).limit(limit)


__all__ = [n for n in dir() if not n.startswith("_")]
