"""Which readers an artifact's path asks for, and names taken from paths (columns, no Python)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import low

# Fixed values: (reader, pattern of the lower-cased path with forward slashes), tried in order; a file may ask for several.
ROUTES = (
    ("evtx", r"\.evtx$"),
    ("mft", r"(?:^|/)\$mft$"),
    ("usnjrnl", r"(?:\$j|\$usnjrnl(?:[:_.]\$?j)?)$"),
    ("prefetch", r"\.pf$"),
    ("lnk", r"\.lnk$"),
    ("jumplists", r"\.(?:automatic|custom)destinations-ms$"),
    ("recycle_bin", r"(?:^|/)\$i[a-z0-9]{6}(?:\.[^/]*)?$"),
    ("amcache", r"(?:^|/)amcache\.hve$"),
    ("hive", r"(?:^|/)(?:system|software|sam|security)$"),
    ("shimcache", r"(?:^|/)system$"),
    ("hive", r"(?:^|/)(?:ntuser\.dat|usrclass\.dat)$"),
    ("shellbags", r"(?:^|/)(?:ntuser\.dat|usrclass\.dat)$"),
    ("srum_network", r"(?:^|/)srudb\.dat$"),
    ("srum_programs", r"(?:^|/)srudb\.dat$"),
    ("bits_jobs", r"(?:^|/)qmgr\.db$"),
    ("bits_files", r"(?:^|/)qmgr\.db$"),
    ("ntds", r"(?:^|/)ntds\.dit$"),
    ("browser", r"(?:^|/)(?:history|places\.sqlite)$"),
    ("eml", r"\.eml$"),
    ("mbox", r"\.mbox$|(?:^|/)mbox$"),
    ("msg", r"\.msg$"),
    ("wer", r"\.wer$"),
    ("anydesk_sessions", r"connection_trace\.txt$"),
    ("anydesk_trace", r"(?:^|/)ad(?:_svc)?\.trace$"),
    ("anydesk_config", r"(?:^|/)anydesk/[^/]*\.conf$"),
    ("auth_log", r"(?:^|/)(?:auth\.log|secure)(?:[.-][^/]*)?$"),
    ("wtmp", r"(?:^|/)[wb]tmp(?:\.\d+)?$"),
    ("shell_history", r"(?:^|/)\.(?:bash|zsh|sh|ash|fish)_history$"),
    ("crontab", r"(?:^|/)(?:crontab|cron\.d/[^/]+|crontabs/[^/]+)$"),
    ("authorized_keys", r"(?:^|/)authorized_keys2?$"),
    ("passwd", r"/etc/passwd$"),
    ("sudoers", r"/etc/sudoers(?:\.d/[^/]+)?$"),
)


def norm(path: Column) -> Column:
    return F.translate(F.lower(path), "\\", "/")


def readers(path: Column) -> Column:
    """array of reader names of a path, in order, none twice; empty for files nobody reads."""
    tests = [F.when(norm(path).rlike(p), F.lit(r)) for r, p in ROUTES]
    return F.array_distinct(F.filter(F.array(*tests), lambda x: x.isNotNull()))


def user_of(path: Column) -> Column:
    """The account whose profile a path lies in, '' outside of profiles."""
    return F.regexp_extract(F.translate(path, "\\", "/"), r"(?i)(?:^|/)(?:users|documents and settings|home)/([^/]+)/", 1)


def user_in(path: str) -> str:
    """The same for one path, inside a reader."""
    m = re.search(r"(?i)(?:^|/)(?:users|documents and settings|home)/([^/]+)/", path.replace("\\", "/"))
    return m.group(1) if m else ""


def channel_of(path: Column, provider: bool = True) -> Column:
    """Channel of an exported event log's name: provider/channel, or only what stands behind the last %4."""
    base = F.regexp_replace(F.regexp_extract(F.translate(path, "\\", "/"), r"[^/]*$", 0), r"(?i)\.evtx$", "")
    return F.regexp_replace(base, "%4", "/") if provider else F.element_at(F.split(base, "%4"), -1)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of a folder, at any depth: path, length, modificationTime, content, readers."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return df.withColumn("readers", readers(F.col("path")))


__all__ = ["ROUTES", "channel_of", "files", "low", "readers", "user_in", "user_of"]
