"""Readers of text artifacts: JVM expressions over lines.

All take a frame of lines (path, line_no, value), as ``lines_of`` makes it from
files, and return the catalogue's table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .router import user_of


def text_of(content: Column) -> Column:
    """Bytes as text: UTF-16 by its mark, else UTF-8."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head == "FFFE", F.decode(content, "UTF-16LE")).when(head == "FEFF", F.decode(content, "UTF-16BE")).otherwise(F.decode(content, "UTF-8"))


def lines_of(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), value of every line of the files' content."""
    body = F.regexp_replace(F.regexp_replace(text_of(F.col("content")), "^﻿", ""), "\r\n?", "\n")
    return files.select("path", F.posexplode(F.split(body, "\n")).alias("_i", "value")).select("path", (F.col("_i") + 1).alias("line_no"), "value")


def _get(c: str | Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got)


def auth_log(lines: DataFrame, year: int | None = None) -> DataFrame:
    """linux_auth of authentication logs; ``year`` for stamps without one (null where it is not given)."""
    v = F.col("value")
    iso = _get(v, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*)")
    old = _get(v, r"^([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2})")
    classic = F.try_to_timestamp(F.concat(F.lit(f"{year or 1970} "), F.regexp_replace(old, " +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    ts = F.coalesce(iso.try_cast("timestamp"), classic if year else F.lit(None).cast("timestamp"))
    prog = _get(v, r"^(?:\S+|[A-Z][a-z]{2} +\d{1,2} \S+) \S+ ([\w./-]+?)(?:\[\d+\])?:")
    pid = _get(v, r"^[^\[]*?\[(\d+)\]:").try_cast("int")
    has = v.contains
    kind = (
        F.when(has("Accepted "), "ssh_login_success")
        .when(has("Failed ") & has(" from "), F.when(has("invalid user"), "ssh_invalid_user").otherwise("ssh_login_failed"))
        .when(has("Invalid user "), "ssh_invalid_user")
        .when(has("Disconnected from") | has("Connection closed"), "ssh_disconnect")
        .when((prog == "sudo") & has("COMMAND="), "sudo")
        .when((prog == "su") & (has("FAILED") | has("authentication failure")), "su_failed")
        .when((prog == "su") & (has("session opened") | has("Successful su")), "su_success")
        .when(prog == "useradd", "useradd")
        .when(prog == "usermod", "usermod")
        .when(prog == "userdel", "userdel")
        .when((prog == "passwd") & has("password changed"), "passwd_change")
        .when(prog == "sshd", "ssh_other")
    )
    user = F.coalesce(_get(v, r"(?:Accepted \S+|Failed \S+) for (?:invalid user )?(\S+) from"), _get(v, r"Invalid user (\S+) from"), _get(v, r"sudo(?:\[\d+\])?: +(\S+) :"), _get(v, r"name=([^,\s]+)"), _get(v, r"(?:for user|password changed for|Disconnected from user) (\S+)"))
    ip = _get(v, r"(?:from|by) (?:user \S+ )?([0-9a-fA-F.:]{3,45})(?: port|\s|$)")
    method = _get(v, r"(?:Accepted|Failed) (\S+) for")
    out = lines.select(ts.alias("timestamp"), kind.alias("event_type"), user.alias("user"), ip.alias("src_ip"), method.alias("method"), pid.alias("pid"), v.alias("message"), F.col("path").alias("source_file"), "line_no")
    return out.filter("event_type IS NOT NULL")


def shell_history(lines: DataFrame) -> DataFrame:
    """shell_history of history files: '#<epoch>' dates the next command, ': <epoch>:<s>;command' its own."""
    v = F.col("value")
    order = W.partitionBy("path").orderBy("line_no")
    stamped = lines.withColumn("_e", _get(v, r"^#(\d{9,10})$").try_cast("bigint")).withColumn("_prev", F.lag("_e").over(order))
    own = _get(v, r"^: (\d{9,10}):\d+;").try_cast("bigint")
    at = F.coalesce(own, F.col("_prev"))
    command = F.when(own.isNotNull(), F.regexp_replace(v, r"^: \d+:\d+;", "")).otherwise(v)
    keep = stamped.filter(F.col("_e").isNull() & (F.trim(v) != ""))
    return keep.select(command.alias("command"), F.when(at > 0, F.timestamp_seconds(at)).alias("timestamp"), F.col("path").alias("source"), user_of(F.col("path")).alias("user"), _get("path", r"\.(bash|zsh|sh|ash|fish)_history$").alias("shell"))


def _listed(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.trim("value").rlike("^(?:#.*)?$"))


def crontab(lines: DataFrame) -> DataFrame:
    """linux_persistence of crontabs, those with a user column and short forms (@reboot) included."""
    f = F.split(F.trim("value"), r"\s+")
    system = F.col("path").rlike(r"/etc/(?:crontab|cron\.d/)")
    short = f[0].startswith("@")
    skip = F.when(short, 1).otherwise(5)
    user = F.when(system, F.get(f, skip)).otherwise(_get("path", r"crontabs/([^/]+)$"))
    start = skip + F.when(system, 1).otherwise(0)
    command = F.array_join(F.slice(f, start + 1, F.greatest(F.lit(0), F.size(f) - start)), " ")
    jobs = _listed(lines).filter(~F.trim("value").rlike(r"^\w+ *=") & (F.size(f) > start))
    return jobs.select(F.lit("crontab").alias("type"), "path", command.alias("command"), F.coalesce(user, F.lit("")).alias("user"), F.lit(True).alias("enabled"), F.array_join(F.slice(f, F.lit(1), skip), " ").alias("details"))


def authorized_keys(lines: DataFrame) -> DataFrame:
    """linux_persistence of key files; the key is shortened."""
    key = _get("value", r"((?:ssh-|ecdsa-|sk-)\S+ +\S+)")
    short = F.when(F.length(key) > 40, F.concat(F.left(key, F.lit(40)), F.lit("..."))).otherwise(key)
    return _listed(lines).filter(key.isNotNull()).select(F.lit("authorized_key").alias("type"), "path", short.alias("command"), user_of(F.col("path")).alias("user"), F.lit(True).alias("enabled"), _get("value", r"(?:ssh-|ecdsa-|sk-)\S+ +\S+ +(.*)$").alias("details"))


def passwd(lines: DataFrame) -> DataFrame:
    f = F.split("value", ":")
    shell = F.get(f, 6)
    return _listed(lines).filter(F.size(f) >= 7).select(F.lit("passwd_entry").alias("type"), "path", shell.alias("command"), f[0].alias("user"), (~shell.rlike("(?:nologin|false)$")).alias("enabled"), F.concat_ws(":", f[2], f[3], f[5]).alias("details"))


def sudoers(lines: DataFrame) -> DataFrame:
    v = F.trim("value")
    return _listed(lines).filter(~v.startswith("Defaults")).select(F.lit("sudoers").alias("type"), "path", v.alias("command"), F.regexp_extract(v, r"^(\S+)", 1).alias("user"), F.lit(True).alias("enabled"), F.when(v.contains("NOPASSWD"), "NOPASSWD").alias("details"))


def anydesk_sessions(lines: DataFrame) -> DataFrame:
    """anydesk_sessions of connection traces: columns parted by wide blanks, of which the last three vary."""
    f = F.filter(F.split(F.trim("value"), r"\s{2,}|\t+"), lambda x: x != "")
    n = F.size(f)
    ok = lines.withColumn("_f", f).filter((n >= 4) & F.lower(f[0]).isin("incoming", "outgoing"))
    g = F.col("_f")
    stamp = F.try_to_timestamp(F.regexp_extract(g[1], r"^(\d{4}-\d{2}-\d{2}, \d{2}:\d{2})", 1), F.lit("yyyy-MM-dd, HH:mm"))
    return ok.select(g[0].alias("direction"), stamp.alias("timestamp"), g[2].alias("auth_method"), F.when(F.size(g) >= 5, F.get(g, 3)).alias("client_alias"), F.element_at(g, -1).alias("anydesk_id"), F.col("path").alias("source_file"))


def ini(lines: DataFrame) -> DataFrame:
    """path, key, value of configuration files: comments and sections skipped, split at the first equals sign."""
    v = F.trim("value")
    kv = F.split(v, "=", 2)
    return lines.filter(~v.rlike(r"^(?:[#;\[].*)?$") & v.contains("=")).select("path", "line_no", F.trim(kv[0]).alias("key"), F.trim(kv[1]).alias("value"))


def anydesk_config(lines: DataFrame) -> DataFrame:
    return ini(lines).select("key", "value", F.col("path").alias("source_file"))


def wer(lines: DataFrame) -> DataFrame:
    """wer_crashes of crash reports: the last value of each key, signatures by their position."""
    last = ini(lines).groupBy("path", "key").agg(F.max_by("value", "line_no").alias("value"))
    sig = {0: "app_name", 1: "app_version", 2: "app_timestamp", 3: "fault_module", 4: "fault_module_version", 6: "exception_code", 7: "exception_offset"}
    pick = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    agg = last.groupBy("path").agg(*[pick(f"Sig[{i}].Value").alias(n) for i, n in sig.items()], pick("AppPath").alias("app_path"), pick("EventTime").alias("_t"), pick("Response.BucketId").alias("bucket_id"), pick("NsAppName").alias("_ns"))
    from ..functions.text import filetime

    return agg.select(F.coalesce("app_name", "_ns").alias("app_name"), "app_path", "app_version", "app_timestamp", filetime("_t").alias("crash_time"), "fault_module", "fault_module_version", "exception_code", "exception_offset", "bucket_id", F.col("path").alias("source_file"))
