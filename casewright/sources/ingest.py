"""From a folder of collected files to the typed tables of a case, in one call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, Case
from . import binary
from .events import amcache, typed
from .eventlog import evtx_events
from .packed import with_archives
from .router import files

#: Readers of whole files by the table they fill.
WHOLE = {"mft": "mft", "usnjrnl": "usnjrnl", "recycle_bin": "recycle_bin", "prefetch": "prefetch", "lnk": "lnk_files", "browser": "browser_history", "jumplists": "jumplists", "shimcache": "shimcache", "shellbags": "shellbags", "srum_network": "srum_network_usage", "srum_programs": "srum_app_usage", "bits_jobs": "bits_jobs", "bits_files": "bits_files", "ntds": "ntds_accounts"}


def tables_of(found: DataFrame) -> dict[str, DataFrame]:
    """Tables of collected files (``router.files``, with archives or without): decoded files, event-log records and their typed tables, and what is folded from registry values."""
    out = {table: binary.decode(found, reader) for reader, table in WHOLE.items()}
    out["emails"] = reduce(DataFrame.unionByName, [binary.decode(found, r) for r in ("eml", "mbox", "msg")])
    raw = binary.decode(found, "hive")
    out["registry_raw"] = raw
    out["persistence"] = binary.run_keys(raw)
    out["services"] = binary.services(raw)
    out["userassist"] = binary.user_assist(raw)
    out["bam_dam"] = binary.bam(raw)
    out["amcache"] = amcache(binary.decode(found, "amcache"))
    out["linux_sessions"] = binary.linux_sessions(binary.decode(found, "wtmp"))
    events = evtx_events(found)
    out["evtx_events"] = events
    out.update(typed(events))
    problems = binary.source_files(found)
    out["source_files"] = problems.select(F.hash("path", "type").alias("id"), "path", "type", "sha256", "size", F.current_timestamp().alias("parsed_at"), "error")
    return out


def collect(spark: SparkSession, folder: str) -> Case:
    """The case of a folder of collected files, ZIP archives opened: tables are read when they are asked for."""
    made = tables_of(with_archives(files(spark, folder)))
    return Case(spark, tables={name: df for name, df in made.items() if name in TABLES})


def write(case: Case, folder: str) -> None:
    """Every table of a case as Parquet, where ``Case(spark, folder)`` finds it."""
    for name in TABLES:
        if case.has(name):
            case[name].write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
