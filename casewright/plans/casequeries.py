"""Queries over the artifact tables, through the library's operators, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detect.detectors import BY_ID, run_detectors
from ..detect.findings import multi_source
from ..detect.indicators import classify, extract_from, import_list, normal_value
from ..detect.patterns import PatternRule, scan
from ..detect.sigma import parse_rule, run_rule
from ..functions.text import joined
from ..schema import Case
from . import library as L
from . import timeline as TL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir, fn=fn: fn(Case(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def us(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _detect(ident: str):
    def run(case: Case) -> DataFrame:
        return BY_ID[ident].run(case).select("type", "value", "source", "confidence", "related_campaign", us("first_seen").alias("first_us"), "notes")

    return run


REAL = "\"timestamp\" >= TIMESTAMP '2000-01-01'"
BASE = "regexp_extract(lower({}), '[^/\\\\]*$', 0)"
HUMAN = """NOT starts_with(lower("user"), 'umfd-') AND NOT starts_with(lower("user"), 'dwm-') AND lower("user") NOT IN ('local service', 'network service', 'anonymous logon'{more}) AND lower(coalesce(domain, '')) NOT IN ('font driver host', 'window manager')"""


def _sql(kind: str, value: str, conf: str, seen: str, rest: str, distinct: bool = True, note: str = "''", technique: str | None = None) -> str:
    return f"SELECT {'DISTINCT ' if distinct else ''}'{kind}' AS type, {value} AS value, 'detect:%s' AS source, '{conf}' AS confidence, {repr(technique) if technique else 'CAST(NULL AS VARCHAR)'} AS related_campaign, epoch_us({seen}) AS first_us, {note} AS notes FROM {rest}"


_DETECTED = {
    "brute_force": _sql("ip", "src_ip", "HIGH", 'min("timestamp")', f"auth_events WHERE event_id = 4625 AND src_ip NOT IN ('', '-', '127.0.0.1') AND {REAL} GROUP BY src_ip HAVING count(*) >= 5", False, note="'Brute force: ' || count(*) || ' failed logons'", technique="T1110.001"),
    "rdp_brute_force": _sql("ip", "src_ip", "HIGH", 'min("timestamp")', f"auth_events WHERE event_id = 4625 AND logon_type = 10 AND src_ip NOT IN ('', '-', '127.0.0.1', '::1') AND {REAL} GROUP BY src_ip HAVING count(*) >= 5", False, note="'RDP brute force: ' || count(*) || ' failures (logon_type=10)'", technique="T1110.001"),
    "explicit_credentials": _sql("auth", "\"user\" || '@' || coalesce(domain, '')", "MED", 'min("timestamp")', f"auth_events WHERE event_id = 4648 AND {REAL} AND {HUMAN.format(more='')} GROUP BY \"user\", domain HAVING count(*) >= 2", False, note="'Explicit creds ×' || count(*) || ' from ' || array_to_string(list_sort(list(DISTINCT coalesce(src_ip, '-'))), ',') || ' workstation=' || array_to_string(list_sort(list(DISTINCT coalesce(workstation, '-'))), ',')", technique="T1550.002"),
    "pass_the_hash": _sql("auth", "\"user\" || '@' || coalesce(domain, '')", "HIGH", 'min("timestamp")', f"auth_events WHERE event_id = 4648 AND \"user\" <> '' AND NOT ends_with(\"user\", '$') AND {REAL} AND " + HUMAN.format(more=", 'window manager'") + ' GROUP BY "user", domain HAVING count(*) >= 10', False, note="'Pass-the-Hash: ' || count(*) || ' explicit credential events, src=' || array_to_string(list_sort(list(DISTINCT coalesce(src_ip, '-'))), ', ')", technique="T1550.002"),
    "anon_smb_cluster": _sql("ip", "coalesce(nullif(src_ip, ''), coalesce(workstation, 'unknown'))", "HIGH", 'min("timestamp")', f"auth_events WHERE (lower(\"user\") IN ('anonymous logon', 'anonymous', '') OR \"user\" IS NULL) AND logon_type = 3 AND {REAL} GROUP BY coalesce(nullif(src_ip, ''), coalesce(workstation, 'unknown')) HAVING count(*) >= 3", False, note="'Anonymous SMB logon cluster: ' || count(*) || ' events (logon_type=3, null session)'", technique="T1021.002/EternalBlue"),
    "ssh_bruteforce": "SELECT 'ip' AS type, src_ip AS value, 'detect:%s' AS source, 'HIGH' AS confidence, CAST(NULL AS VARCHAR) AS related_campaign, epoch_us(min(try_cast(\"timestamp\" AS TIMESTAMP))) AS first_us, 'SSH brute force: ' || count(*) || ' failed attempts' AS notes FROM linux_auth WHERE event_type IN ('ssh_login_failed', 'ssh_invalid_user') AND src_ip <> '' GROUP BY src_ip HAVING count(*) >= 20",
    "proc_create_lolbin": _sql("process", "image", "HIGH", '"timestamp"', f"proc_creation WHERE {BASE.format('image')} IN ('certutil.exe', 'mshta.exe', 'regsvr32.exe', 'wscript.exe', 'cscript.exe', 'msiexec.exe', 'installutil.exe', 'regasm.exe', 'regsvcs.exe', 'odbcconf.exe', 'ieexec.exe', 'xwizard.exe', 'expand.exe', 'extrac32.exe', 'pcwrun.exe', 'appsyncpublishingserver.exe') AND {REAL}", note="'LOLBin via event 4688: ' || coalesce(nullif(cmdline, ''), image)", technique="T1218"),
    "proc_create_susp_parent": _sql("process", "image", "HIGH", '"timestamp"', f"proc_creation WHERE {BASE.format('image')} IN ('cmd.exe', 'powershell.exe', 'pwsh.exe', 'wscript.exe', 'cscript.exe', 'mshta.exe') AND {BASE.format('parent_image')} IN ('winword.exe', 'excel.exe', 'powerpnt.exe', 'outlook.exe', 'msaccess.exe', 'chrome.exe', 'firefox.exe', 'msedge.exe', 'iexplore.exe', 'opera.exe', 'acrord32.exe') AND {REAL}", note="'Shell spawned by Office/browser via 4688 — parent=' || coalesce(parent_image, '?') || ' cmd=' || coalesce(nullif(cmdline, ''), image)", technique="T1566.001"),
    "proc_create_susp_path": _sql("process", "image", "MED", '"timestamp"', f"proc_creation WHERE regexp_matches(translate(lower(image), '\\', '/'), '/temp/|/appdata/local/temp/|/appdata/roaming/|/downloads/|/public/') AND ends_with(lower(image), '.exe') AND {REAL}", note="'Executable from suspicious write location: ' || coalesce(nullif(cmdline, ''), image)", technique="T1036"),
    "ps_scriptblock_download_cradle": _sql("process", "left(script_text, 200)", "HIGH", '"timestamp"', "ps_scriptblock WHERE regexp_matches(lower(script_text), 'downloadstring|invoke-expression|iex\\(|frombase64string|-enc |-encodedcommand') AND NOT regexp_matches(lower(script_text), 'chocolatey|copyright|microsoft\\.com|#requires')", note="'PS download cradle or obfuscation detected'"),
}
for _id, _text in _DETECTED.items():
    QUERIES[f"detect_{_id}"] = lambda spark, sf_dir, run=_detect(_id): run(Case(spark, sf_dir))
    ORACLE[f"detect_{_id}"] = _text.replace("detect:%s", f"detect:{_id}")


def _shell(ident: str, where: str) -> None:
    """Shell detectors report the command; the stamps of that table are text of many layouts, so only commands are compared."""
    QUERIES[f"detect_{ident}"] = lambda spark, sf_dir: BY_ID[ident].run(Case(spark, sf_dir)).select("value", "confidence").distinct()
    ORACLE[f"detect_{ident}"] = f"SELECT DISTINCT left(command, 200) AS value, 'HIGH' AS confidence FROM shell_history WHERE {where}"


_shell("shell_download_exec", "(contains(lower(command), 'wget') OR contains(lower(command), 'curl')) AND (regexp_matches(lower(command), '(?s)\\|.*bash|\\|.*sh|chmod.*x') OR contains(command, './'))")
_shell("shell_reverse_shell", "regexp_matches(lower(command), '(?s)nc .*-e|ncat .*-e|bash -i >.*/dev/tcp/|python.*pty.*spawn|socat.*exec')")
_shell("shell_antiforensics", "regexp_matches(lower(command), 'history -c|shred |wipe |unset histfile|export histsize=0') OR (contains(lower(command), 'rm ') AND contains(lower(command), '.bash_history'))")


@query("detect_anydesk_incoming_session", "SELECT DISTINCT coalesce(nullif(anydesk_id, ''), coalesce(client_alias, 'unknown')) || ' [' || direction || ']' AS value FROM anydesk_sessions WHERE direction = 'Incoming'")
def _(case: Case) -> DataFrame:
    return BY_ID["anydesk_incoming_session"].run(case).select("value").distinct()


@query("detect_all_summary")
def _(case: Case) -> DataFrame:
    return L.detections(run_detectors(case)).select("source", "confidence", "hits", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


@query("verdict_summary")
def _(case: Case) -> DataFrame:
    return L.verdict(run_detectors(case))


@query("findings_multi_source", """
WITH f AS (SELECT lower(src_ip) AS value, 'detect:brute_force' AS source FROM auth_events WHERE event_id = 4625 AND src_ip NOT IN ('', '-', '127.0.0.1') AND "timestamp" >= TIMESTAMP '2000-01-01' GROUP BY src_ip HAVING count(*) >= 5
UNION ALL SELECT lower(src_ip), 'detect:rdp_brute_force' FROM auth_events WHERE event_id = 4625 AND logon_type = 10 AND src_ip NOT IN ('', '-', '127.0.0.1', '::1') AND "timestamp" >= TIMESTAMP '2000-01-01' GROUP BY src_ip HAVING count(*) >= 5)
SELECT value, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ' + ' ORDER BY source) AS sources, 'HIGH' AS worst FROM f GROUP BY value HAVING count(DISTINCT source) > 1""")
def _(case: Case) -> DataFrame:
    return multi_source(run_detectors(case, ["brute_force", "rdp_brute_force"]))


# ---- views

@query("view_lateral_movement", "SELECT source, \"user\" AS account, src, dst, method, count(*) AS n_rows, epoch_us(max(ts)) AS last_us FROM (SELECT 'auth' AS source, \"timestamp\" AS ts, \"user\", src_ip AS src, workstation AS dst, CAST(logon_type AS VARCHAR) AS method FROM auth_events WHERE logon_type IN (3, 10)) GROUP BY ALL")
def _(case: Case) -> DataFrame:
    from ..schema import lateral_movement

    return lateral_movement(case).groupBy("source", F.col("user").alias("account"), "src", "dst", "method").agg(F.count(F.lit(1)).alias("n_rows"), F.max(us("timestamp")).alias("last_us"))


@query("view_network_activity", "SELECT remote_addr, state, count(*) AS n_rows FROM mem_netscan GROUP BY remote_addr, state")
def _(case: Case) -> DataFrame:
    from ..schema import network_activity

    return network_activity(case).groupBy("remote_addr", "state").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- timelines

_TL = """WITH t AS (
SELECT "timestamp" AS ts, 'auth' AS source, CAST(event_id AS VARCHAR) AS category, coalesce("user", '') AS detail, coalesce(src_ip, '') AS extra FROM auth_events
UNION ALL SELECT "timestamp", 'proc_4688', coalesce(image, ''), coalesce(cmdline, ''), coalesce(user_name, '') FROM proc_creation
UNION ALL SELECT visit_time, 'browser', browser, url, coalesce(title, '') FROM browser_history
UNION ALL SELECT "timestamp", 'powershell', 'script', substring(coalesce(script_text, ''), 1, 120), '' FROM ps_scriptblock),
s AS (SELECT * FROM t WHERE ts >= TIMESTAMP '2000-01-01') """
_FOUR = ("auth", "proc_4688", "browser", "powershell")


@query("timeline_sources", _TL + "SELECT source, count(*) AS n_rows, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY source")
def _(case: Case) -> DataFrame:
    return TL.timeline(case, _FOUR).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.min(us("ts")).alias("first_us"), F.max(us("ts")).alias("last_us"))


@query("timeline_newest", _TL + "SELECT epoch_us(ts) AS ts_us, source, category, detail, extra FROM s ORDER BY ts DESC, source, category NULLS FIRST, detail NULLS FIRST, extra NULLS FIRST LIMIT 500")
def _(case: Case) -> DataFrame:
    return TL.timeline(case, _FOUR, total=500).select(us("ts").alias("ts_us"), "source", "category", "detail", "extra")


@query("timeline_top_per_group", _TL + "SELECT epoch_us(ts) AS ts_us, source, category, detail, extra FROM s QUALIFY row_number() OVER (PARTITION BY source, category ORDER BY ts DESC, detail NULLS FIRST, extra NULLS FIRST) <= 10")
def _(case: Case) -> DataFrame:
    return TL.timeline(case, _FOUR, per_group=10).select(us("ts").alias("ts_us"), "source", "category", "detail", "extra")


@query("timeline_filtered", _TL + "SELECT epoch_us(ts) AS ts_us, source, category, detail, extra FROM s WHERE ts BETWEEN TIMESTAMP '2015-01-05 10:00:00' AND TIMESTAMP '2015-01-05 18:00:00' AND (contains(lower(detail), 'svc') OR contains(lower(category), 'svc') OR contains(lower(extra), 'svc'))")
def _(case: Case) -> DataFrame:
    return TL.timeline(case, _FOUR, "2015-01-05 10:00:00", "2015-01-05 18:00:00", "svc").select(us("ts").alias("ts_us"), "source", "category", "detail", "extra")


@query("activity_histogram", _TL + "SELECT epoch_us(date_trunc('hour', ts)) AS bucket_us, count(*) FILTER (source = 'auth') AS auth, count(*) FILTER (source = 'proc_4688') AS proc_4688, count(*) FILTER (source = 'browser') AS browser, count(*) FILTER (source = 'powershell') AS powershell, count(*) AS total FROM s GROUP BY 1")
def _(case: Case) -> DataFrame:
    return TL.histogram(case, _FOUR).select(us("bucket").alias("bucket_us"), *_FOUR, "total")


@query("correlate_term", """SELECT source, count(*) AS n_rows FROM (
SELECT 'proc_creation' AS source FROM proc_creation WHERE contains(lower(image), 'certutil') OR contains(lower(cmdline), 'certutil') OR contains(lower(parent_image), 'certutil')
UNION ALL SELECT 'auth_events' FROM auth_events WHERE contains(lower("user"), 'certutil') OR contains(lower(src_ip), 'certutil') OR contains(lower(workstation), 'certutil')
UNION ALL SELECT 'mem_netscan' FROM mem_netscan WHERE contains(lower(name), 'certutil') OR contains(lower(remote_addr), 'certutil') OR contains(lower(local_addr), 'certutil')
UNION ALL SELECT 'browser_history' FROM browser_history WHERE contains(lower(url), 'certutil') OR contains(lower(title), 'certutil')
UNION ALL SELECT 'ps_scriptblock' FROM ps_scriptblock WHERE contains(lower(script_text), 'certutil')) GROUP BY source""")
def _(case: Case) -> DataFrame:
    tables = ("proc_creation", "auth_events", "mem_netscan", "browser_history", "ps_scriptblock")
    return TL.pivot(case, "certutil", tables).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- timelines over every collected table; the SQL above covers four of them, fixtures the rest

@query("timeline_all_sources")
def _(case: Case) -> DataFrame:
    return TL.first_last(case).select("source", "n_rows", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


@query("timeline_all_newest")
def _(case: Case) -> DataFrame:
    return TL.timeline(case, total=500).select(us("ts").alias("ts_us"), "source", "category", "detail", "extra")


@query("timeline_all_top_per_group")
def _(case: Case) -> DataFrame:
    return TL.timeline(case, per_group=10).select(us("ts").alias("ts_us"), "source", "category", "detail", "extra")


@query("timeline_all_filtered")
def _(case: Case) -> DataFrame:
    return TL.timeline(case, None, "2015-01-05 10:00:00", "2015-01-05 18:00:00", "svc").select(us("ts").alias("ts_us"), "source", "category", "detail", "extra")


@query("activity_all_histogram")
def _(case: Case) -> DataFrame:
    labels = TL.collected(case)
    return TL.histogram(case, labels).select(us("bucket").alias("bucket_us"), *labels, "total")


@query("correlate_all_term")
def _(case: Case) -> DataFrame:
    return TL.correlate(case, "certutil").select("source", "n_rows", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


# ---- statistics

@query("auth_stats", "SELECT lower(\"user\") AS account, count(*) FILTER (event_id = 4624) AS n_success, count(*) FILTER (event_id = 4625) AS n_failed, count(*) FILTER (event_id = 4648) AS n_explicit, count(DISTINCT src_ip) AS n_ips, count(*) FILTER (logon_type = 9) AS n_type9, epoch_us(max(\"timestamp\")) AS last_us FROM auth_events WHERE \"user\" <> '' GROUP BY 1")
def _(case: Case) -> DataFrame:
    return L.auth_stats(case).select("account", "n_success", "n_failed", "n_explicit", "n_ips", "n_type9", us("last_ts").alias("last_us"))


@query("logon_types", 'SELECT logon_type, event_id, count(*) AS n_rows, count(DISTINCT "user") AS n_users FROM auth_events GROUP BY 1, 2')
def _(case: Case) -> DataFrame:
    return L.logon_types(case)


@query("event_stats", "SELECT event_id, channel, count(*) AS n_rows FROM evtx_events GROUP BY 1, 2 ORDER BY n_rows DESC, event_id NULLS FIRST, channel NULLS FIRST LIMIT 30")
def _(case: Case) -> DataFrame:
    return L.event_stats(case)


def _timed(df: DataFrame) -> DataFrame:
    """First and last times as microseconds."""
    return df.withColumns({"first_us": us("first_ts"), "last_us": us("last_ts")}).drop("first_ts", "last_ts")


@query("process_stats", f"SELECT {BASE.format('image')} AS program, count(*) AS n_starts, count(DISTINCT lower(user_name)) AS n_users, count(DISTINCT {BASE.format('parent_image')}) AS n_parents, count(*) FILTER (integrity_level IN ('High', 'System')) AS n_elevated, epoch_us(min(\"timestamp\")) AS first_us, epoch_us(max(\"timestamp\")) AS last_us FROM proc_creation WHERE image IS NOT NULL GROUP BY 1")
def _(case: Case) -> DataFrame:
    return _timed(L.process_stats(case))


@query("user_activity", f"""WITH p AS (SELECT lower(split_part(user_name, '\\', -1)) AS account, count(*) AS n_procs, count(DISTINCT {BASE.format('image')}) AS n_programs FROM proc_creation WHERE user_name <> '' GROUP BY 1),
a AS (SELECT lower("user") AS account, count(*) AS n_auth, count(*) FILTER (event_id = 4625) AS n_failed FROM auth_events WHERE "user" <> '' GROUP BY 1),
u AS (SELECT account FROM p UNION SELECT account FROM a)
SELECT account, coalesce(n_procs, 0) AS n_procs, coalesce(n_programs, 0) AS n_programs, coalesce(n_auth, 0) AS n_auth, coalesce(n_failed, 0) AS n_failed FROM u LEFT JOIN p USING (account) LEFT JOIN a USING (account)""")
def _(case: Case) -> DataFrame:
    return L.user_activity(case)


@query("mail_stats", "SELECT folder, count(*) AS n_mails, count(DISTINCT lower(from_addr)) AS n_senders, count(*) FILTER (has_attachments) AS n_with_files, epoch_us(min(coalesce(sent_at, received_at))) AS first_us, epoch_us(max(coalesce(sent_at, received_at))) AS last_us FROM emails GROUP BY folder")
def _(case: Case) -> DataFrame:
    return _timed(L.mail_stats(case))


_EDGES = f"SELECT {BASE.format('parent_image')} AS src, {BASE.format('image')} AS dst, count(*) AS n_starts, count(DISTINCT lower(user_name)) AS n_users, epoch_us(min(\"timestamp\")) AS first_us, epoch_us(max(\"timestamp\")) AS last_us FROM proc_creation WHERE image IS NOT NULL AND parent_image IS NOT NULL GROUP BY 1, 2"


@query("graph_edges", _EDGES)
def _(case: Case) -> DataFrame:
    return _timed(L.graph_edges(case))


@query("graph_neighbourhood", f"""WITH e AS ({_EDGES}), l AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
n1 AS (SELECT 'explorer.exe' AS node UNION SELECT b FROM l WHERE a = 'explorer.exe'), n2 AS (SELECT node FROM n1 UNION SELECT b FROM l WHERE a IN (SELECT node FROM n1))
SELECT * FROM e WHERE src IN (SELECT node FROM n2) AND dst IN (SELECT node FROM n2)""")
def _(case: Case) -> DataFrame:
    return _timed(L.neighbourhood(L.graph_edges(case), "explorer.exe"))


@query("network_correlation", """WITH n AS (SELECT remote_addr, count(*) AS n_conns FROM mem_netscan WHERE remote_addr NOT IN ('', '*', '0.0.0.0', '::') GROUP BY 1), a AS (SELECT src_ip AS remote_addr, count(DISTINCT "timestamp") AS n_logons FROM auth_events GROUP BY 1)
SELECT remote_addr, n_conns, coalesce(n_logons, 0) AS n_logons, (SELECT count(*) FROM b WHERE src_ip = remote_addr) AS n_findings FROM n LEFT JOIN a USING (remote_addr)""".replace("WITH n AS", """WITH b AS (SELECT src_ip FROM auth_events WHERE event_id = 4625 AND src_ip NOT IN ('', '-', '127.0.0.1') AND "timestamp" >= TIMESTAMP '2000-01-01' GROUP BY 1 HAVING count(*) >= 5 UNION ALL SELECT src_ip FROM auth_events WHERE event_id = 4625 AND logon_type = 10 AND src_ip NOT IN ('', '-', '127.0.0.1', '::1') AND "timestamp" >= TIMESTAMP '2000-01-01' GROUP BY 1 HAVING count(*) >= 5), n AS"""))
def _(case: Case) -> DataFrame:
    return L.network_correlation(case, run_detectors(case, ["brute_force", "rdp_brute_force"])).select("remote_addr", "n_conns", "n_logons", "n_findings")


# with the findings of every detector; without SQL, which would hold all of them, and tested on a fixture

@query("findings_multi_source_all")
def _(case: Case) -> DataFrame:
    return multi_source(run_detectors(case))


@query("network_correlation_findings")
def _(case: Case) -> DataFrame:
    return L.network_correlation(case, run_detectors(case)).select("remote_addr", "n_conns", "n_findings", "n_logons")


@query("user_activity_findings")
def _(case: Case) -> DataFrame:
    return L.user_activity(case, run_detectors(case))


@query("top_programs_of_users", f"SELECT lower(user_name) AS account, {BASE.format('image')} AS program, count(*) AS n_rows FROM proc_creation WHERE user_name <> '' AND image IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lower(user_name) ORDER BY count(*) DESC, {BASE.format('image')}) <= 3")
def _(case: Case) -> DataFrame:
    from pyspark.sql import Window as W

    from ..functions.text import basename

    n = case["proc_creation"].filter("user_name <> '' AND image IS NOT NULL").groupBy(F.lower("user_name").alias("account"), basename("image").alias("program")).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.withColumn("_r", F.row_number().over(W.partitionBy("account").orderBy(F.col("n_rows").desc(), "program"))).filter("_r <= 3").drop("_r")


@query("explicit_credentials_targets", f"SELECT \"user\" AS account, string_agg(DISTINCT workstation, ',' ORDER BY workstation) AS workstations, count(*) AS n_rows FROM auth_events WHERE event_id = 4648 AND \"user\" <> '' GROUP BY 1 HAVING count(*) >= 2")
def _(case: Case) -> DataFrame:
    a = case["auth_events"].filter("event_id = 4648 AND user <> ''")
    return a.groupBy(F.col("user").alias("account")).agg(F.when(F.count("workstation") > 0, joined("workstation")).alias("workstations"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows >= 2")


# ---- rules

def _rule(detection: dict, logsource: dict, level: str = "high"):
    return parse_rule({"title": "query rule", "detection": detection, "logsource": logsource, "level": level})


@query("rule_selection_and_not_filter", "SELECT DISTINCT 'HIGH' AS confidence, epoch_us(\"timestamp\") AS first_us, coalesce(image, '?') || ' ' || coalesce(cmdline, '') AS value FROM proc_creation WHERE ends_with(lower(image), 'powershell.exe') AND contains(lower(cmdline), '-enc') AND NOT coalesce(contains(lower(parent_image), 'services.exe'), false)")
def _(case: Case) -> DataFrame:
    r = _rule({"selection": {"Image|endswith": "powershell.exe", "CommandLine|contains": "-enc"}, "filter": {"ParentImage|contains": "services.exe"}, "condition": "selection and not filter"}, {"category": "process_creation"})
    return run_rule(case, r).select("confidence", us("first_seen").alias("first_us"), "value")


@query("rule_one_of", "SELECT DISTINCT 'MED' AS confidence, epoch_us(\"timestamp\") AS first_us, coalesce(\"user\", '?') || ' [' || CAST(event_id AS VARCHAR) || '] from ' || coalesce(src_ip, '-') AS value FROM auth_events WHERE (event_id = 4625 AND logon_type = 10) OR (event_id = 4648 AND ends_with(lower(process_name), 'svchost.exe'))")
def _(case: Case) -> DataFrame:
    r = _rule({"sel_a": {"EventID": 4625, "LogonType": 10}, "sel_b": {"EventID": 4648, "ProcessName|endswith": "svchost.exe"}, "condition": "1 of sel_*"}, {"service": "auth"}, "medium")
    return run_rule(case, r).select("confidence", us("first_seen").alias("first_us"), "value")


@query("rule_all_of_wildcards", "SELECT DISTINCT epoch_us(\"timestamp\") AS first_us, coalesce(script_text, '') AS value FROM ps_scriptblock WHERE regexp_matches(lower(script_text), '(?s)^.*downloadstring.*$') AND contains(lower(script_text), 'webclient')")
def _(case: Case) -> DataFrame:
    r = _rule({"s1": {"ScriptBlockText": "*DownloadString*"}, "s2": {"ScriptBlockText|contains|all": ["WebClient"]}, "condition": "all of s*"}, {"category": "ps_script"})
    return run_rule(case, r).select(us("first_seen").alias("first_us"), "value")


@query("rule_windash", "SELECT DISTINCT coalesce(\"user\", '?') || ': ' || left(coalesce(command, ''), 200) AS value FROM shell_history WHERE contains(lower(command), ' -c') OR contains(lower(command), ' /c')")
def _(case: Case) -> DataFrame:
    r = _rule({"s": {"CommandLine|contains|windash": " -c"}, "condition": "s"}, {"category": "shell_history"})
    return run_rule(case, r).select("value").distinct()


@query("pattern_scan", "SELECT DISTINCT 'any of' AS rule_name, left(script_text, 300) AS value FROM ps_scriptblock WHERE contains(script_text, 'DownloadString') OR contains(script_text, 'Ledger.Tools') UNION ALL SELECT DISTINCT 'all of', left(script_text, 300) FROM ps_scriptblock WHERE contains(script_text, 'Get-WinEvent') AND contains(script_text, 'Test-NetConnection')")
def _(case: Case) -> DataFrame:
    rules = [PatternRule("any of", ("DownloadString", "Ledger.Tools"), targets=("scriptblock",)), PatternRule("all of", ("Get-WinEvent", "Test-NetConnection"), "all", ("scriptblock",))]
    return scan(case, rules).select(F.col("notes").alias("rule_name"), "value").distinct()


# ---- indicators

_IP = "(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"


@query("ioc_urls", "SELECT lower(u) AS value, count(*) AS n_rows FROM (SELECT regexp_replace(unnest(regexp_extract_all(url, '(?i)https?://[^\\s\"''<>|]+')), '[.,;:)''\"\\]]+$', '') AS u FROM browser_history WHERE length(url) > 3) GROUP BY 1")
def _(case: Case) -> DataFrame:
    found = extract_from([("browser_history.url", case["browser_history"], "url")])
    return found.filter("type = 'url'").select(F.lower("value").alias("value"), F.col("count").alias("n_rows"))


@query("ioc_extract_documents")
def _(case: Case) -> DataFrame:
    docs = case.spark.read.parquet(f"{case.folder}/documents.parquet")
    return extract_from([("documents.text", docs, "text")]).select("type", "value", "count")


@query("ioc_extract_case")
def _(case: Case) -> DataFrame:
    from ..detect.indicators import extract_case

    return extract_case(case).groupBy("type", "source").agg(F.count(F.lit(1)).alias("n_values"), F.sum("count").alias("n_hits"))


# One of each kind, and what is none of it: (text, kind, as kept).
_LISTED = (
    ("http://a.test/x", "url", "http://a.test/x"), ("HTTP://a.test", "path", "HTTP://a.test"), ("A" * 64, "sha256", "a" * 64), ("B" * 40, "sha1", "b" * 40), (" cC" + "0" * 30, "md5", "cc" + "0" * 30), ("1.2.3.4", "ip", "1.2.3.4"), ("1.2.3.256", "domain", "1.2.3.256"), ("C:\\a\\b", "path", "C:\\a\\b"), ("tmp/x", "path", "tmp/x"),
    ("Sub.Example.COM", "domain", "sub.example.com"), ("a.b", "indicator", "a.b"), ("a b.com", "indicator", "a b.com"), ("word", "indicator", "word"), ("f" * 33, "indicator", "f" * 33), ("", None, ""), ("no-dots_here", "indicator", "no-dots_here"), ("ends.with.", "indicator", "ends.with."),
)
_CLASSIFY_SQL = """
WITH v AS (SELECT remote_addr AS x FROM mem_netscan UNION ALL SELECT url FROM browser_history UNION ALL SELECT image FROM proc_creation UNION ALL SELECT computer FROM evtx_events UNION ALL SELECT from_addr FROM emails UNION ALL SELECT * FROM (VALUES %s)),
t AS (SELECT trim(x) AS x FROM v),
k AS (SELECT x, CASE WHEN x IS NULL OR x = '' THEN NULL WHEN starts_with(x, 'http://') OR starts_with(x, 'https://') THEN 'url'
  WHEN regexp_full_match(x, '[A-Fa-f0-9]+') AND length(x) IN (32, 40, 64) THEN CASE length(x) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END
  WHEN regexp_full_match(x, '[0-9]{1,3}(\\.[0-9]{1,3}){3}') AND greatest(CAST(split_part(x, '.', 1) AS INT), CAST(split_part(x, '.', 2) AS INT), CAST(split_part(x, '.', 3) AS INT), CAST(split_part(x, '.', 4) AS INT)) <= 255 THEN 'ip'
  WHEN contains(x, '/') OR contains(x, '\\') THEN 'path'
  WHEN contains(x, '.') AND regexp_full_match(x, '[A-Za-z0-9._-]*') AND length(string_split(x, '.')[-1]) >= 2 THEN 'domain' ELSE 'indicator' END AS kind FROM t)
SELECT kind, CASE WHEN kind IN ('md5', 'sha1', 'sha256', 'domain') THEN lower(x) ELSE x END AS value, count(*) AS n_rows FROM k GROUP BY 1, 2
""" % ", ".join("('" + x.replace("'", "''") + "')" for x, *_ in _LISTED)


@query("ioc_classify", _CLASSIFY_SQL.replace("\\\\", "\\"))
def _(case: Case) -> DataFrame:
    own = case.spark.createDataFrame([(x,) for x, *_ in _LISTED], "x string")
    texts = [case[t].select(F.col(c).alias("x")) for t, c in (("mem_netscan", "remote_addr"), ("browser_history", "url"), ("proc_creation", "image"), ("evtx_events", "computer"), ("emails", "from_addr"))]
    every = reduce(DataFrame.unionByName, [own, *texts])
    return every.groupBy(classify(F.col("x")).alias("kind"), normal_value(F.col("x")).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


_IMPORT_SQL = """
WITH v AS (SELECT trim(x) AS x FROM (SELECT remote_addr AS x FROM mem_netscan UNION ALL SELECT from_addr FROM emails UNION ALL SELECT '# comment' UNION ALL SELECT '// other' UNION ALL SELECT 'Evil.Test' UNION ALL SELECT 'EVIL.test' UNION ALL SELECT '10.0.0.1' UNION ALL SELECT '  ')),
n AS (SELECT DISTINCT CASE WHEN x IN ('Evil.Test', 'EVIL.test') THEN 'evil.test' ELSE x END AS x FROM v WHERE x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '//'))
SELECT min(x) AS value, 'manual:list' AS source, 'MED' AS confidence, 'camp' AS related_campaign FROM n
WHERE lower(x) NOT IN (SELECT lower(src_ip) FROM auth_events WHERE src_ip IS NOT NULL) GROUP BY lower(x)
"""


@query("ioc_import_absent", _IMPORT_SQL)
def _(case: Case) -> DataFrame:
    known = case["auth_events"].select(F.col("src_ip").alias("value"), F.lit("manual:list").alias("source")).filter("value IS NOT NULL")
    own = case.spark.createDataFrame([(x,) for x in ("# comment", "// other", "Evil.Test", "EVIL.test", "10.0.0.1", "  ")], "value string")
    lines = own.unionByName(case["mem_netscan"].select(F.col("remote_addr").alias("value"))).unionByName(case["emails"].select(F.col("from_addr").alias("value")))
    return import_list(known, lines, "manual:list", "value", "MED", " camp ").select("value", "source", "confidence", "related_campaign")


_URLS = ("http://plain.test/a", "HTTP://x.test", "https://PasteBin.com/raw/1", "https://gofile.io/d/x", "https://bit.ly/3", "https://x.test/?u=http://y", "https://example.org/", "ftp://paste.ee/x", "https://raw.githubusercontent.com/a/b", "https://megaanz.test")


@query("suspicious_urls", "SELECT browser, url, title, epoch_us(visit_time) AS visit_us FROM (SELECT browser, url, title, visit_time FROM browser_history UNION ALL SELECT 'x', u, NULL, NULL FROM (VALUES " + ", ".join(f"('{u}')" for u in _URLS) + ") AS t(u)) WHERE regexp_matches(lower(url), '^http://|pastebin|hastebin|paste\\.ee|mega\\.nz|gofile\\.io|sendspace|wetransfer|anonfiles|bayfiles|raw\\.githubusercontent|bit\\.ly|tinyurl')")
def _(case: Case) -> DataFrame:
    own = case.spark.createDataFrame([("x", u) for u in _URLS], "browser string, url string")
    both = case["browser_history"].unionByName(own, allowMissingColumns=True)
    return L.suspicious_urls(case.with_tables(browser_history=both)).select("browser", "url", "title", us("visit_time").alias("visit_us"))


_KEYS = ("HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", "HKCU\\software\\microsoft\\windows\\currentversion\\RUNONCE\\x", "HKLM\\Software\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon", "HKLM\\x\\Image File Execution Options\\a.exe", "HKLM\\x\\AppCertDlls", "HKLM\\x\\AppInitDLLs", "HKCU\\x\\Policies\\Explorer\\Run", "HKLM\\x\\ShellServiceObjectDelayLoad", "HKLM\\System\\Services\\svc\\ImagePath", "HKLM\\System\\Services\\svc\\Start", "HKLM\\x\\BootExecute", "HKLM\\x\\SessionManager\\SubSystems", "HKLM\\System\\Lsa\\x", "HKLM\\x\\NetSh\\h", "HKLM\\x\\Print\\Providers\\p", "HKLM\\x\\SecurityProviders", "HKCU\\Software\\Downloads\\Upload", "HKLM\\CurrentVersion\\Explorer")


@query("autoruns_of_keys", "SELECT k AS key_path FROM (VALUES " + ", ".join(f"('{x}')" for x in _KEYS) + ") AS t(k) WHERE k ILIKE '%\\CurrentVersion\\Run%' OR k ILIKE '%\\Winlogon%' OR k ILIKE '%Image File Execution Options%' OR k ILIKE '%AppCertDlls%' OR k ILIKE '%AppInitDLLs%' OR k ILIKE '%\\Policies\\Explorer\\Run%' OR k ILIKE '%ShellServiceObjectDelayLoad%' OR k ILIKE '%\\Services\\%ImagePath%' OR k ILIKE '%BootExecute%' OR k ILIKE '%SessionManager\\SubSystems%' OR k ILIKE '%LSA\\%' OR k ILIKE '%NetSH\\%' OR k ILIKE '%Print\\Providers%' OR k ILIKE '%SecurityProviders%'")
def _(case: Case) -> DataFrame:
    return L.autoruns(case.with_tables(registry_raw=case.spark.createDataFrame([(x,) for x in _KEYS], "key_path string"))).select("key_path")


_TABLES_HERE = ("anydesk_events", "anydesk_sessions", "auth_events", "browser_history", "emails", "evtx_events", "linux_auth", "linux_sessions", "mem_netscan", "proc_creation", "ps_scriptblock", "shell_history")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES_HERE))
def _(case: Case) -> DataFrame:
    return L.counts(case)


# ---- typed tables of event-log records

@query("event_log_auth", "SELECT event_id, json_extract_string(message, '$.TargetUserName') AS account, json_extract_string(message, '$.IpAddress') AS src_ip, count(*) AS n_rows FROM evtx_events WHERE event_id IN (4624, 4625, 4648) GROUP BY 1, 2, 3")
def _(case: Case) -> DataFrame:
    from ..sources.events import TYPED

    return TYPED["auth_events"](case["evtx_events"]).groupBy("event_id", F.col("user").alias("account"), "src_ip").agg(F.count(F.lit(1)).alias("n_rows"))


@query("event_log_processes", f"SELECT {BASE.format("json_extract_string(message, '$.NewProcessName')")} AS program, json_extract_string(message, '$.SubjectUserName') AS user_name, count(*) AS n_rows FROM evtx_events WHERE event_id = 4688 GROUP BY 1, 2")
def _(case: Case) -> DataFrame:
    from ..functions.text import basename
    from ..sources.events import TYPED

    return TYPED["proc_creation"](case["evtx_events"]).groupBy(basename("image").alias("program"), "user_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query("event_log_kerberos", "SELECT event_id, json_extract_string(message, '$.TargetUserName') AS account, count(*) AS n_rows FROM evtx_events WHERE event_id IN (4768, 4769) GROUP BY 1, 2")
def _(case: Case) -> DataFrame:
    from ..sources.events import TYPED

    return TYPED["kerberos_events"](case["evtx_events"]).groupBy("event_id", F.col("user").alias("account")).agg(F.count(F.lit(1)).alias("n_rows"))


# ---- text artifacts, read again from their lines

_AUTH_SQL = r"""WITH l AS (SELECT source_file, line_no, min_by(message, rec_id) AS m FROM linux_auth GROUP BY 1, 2),
p AS (SELECT m, regexp_extract(m, '^(?:\S+|[A-Z][a-z]{2} +\d{1,2} \S+) \S+ ([\w./-]+?)(?:\[\d+\])?:', 1) AS prog FROM l),
t AS (SELECT CASE WHEN contains(m, 'Accepted ') THEN 'ssh_login_success' WHEN contains(m, 'Failed ') AND contains(m, ' from ') THEN CASE WHEN contains(m, 'invalid user') THEN 'ssh_invalid_user' ELSE 'ssh_login_failed' END
  WHEN contains(m, 'Invalid user ') THEN 'ssh_invalid_user' WHEN contains(m, 'Disconnected from') OR contains(m, 'Connection closed') THEN 'ssh_disconnect' WHEN prog = 'sudo' AND contains(m, 'COMMAND=') THEN 'sudo'
  WHEN prog = 'su' AND (contains(m, 'FAILED') OR contains(m, 'authentication failure')) THEN 'su_failed' WHEN prog = 'su' AND (contains(m, 'session opened') OR contains(m, 'Successful su')) THEN 'su_success'
  WHEN prog IN ('useradd', 'usermod', 'userdel') THEN prog WHEN prog = 'passwd' AND contains(m, 'password changed') THEN 'passwd_change' WHEN prog = 'sshd' THEN 'ssh_other' END AS event_type,
  coalesce(nullif(regexp_extract(m, '(?:Accepted \S+|Failed \S+) for (?:invalid user )?(\S+) from', 1), ''), nullif(regexp_extract(m, 'Invalid user (\S+) from', 1), ''), nullif(regexp_extract(m, 'sudo(?:\[\d+\])?: +(\S+) :', 1), ''), nullif(regexp_extract(m, 'name=([^,\s]+)', 1), ''), nullif(regexp_extract(m, '(?:for user|password changed for|Disconnected from user) (\S+)', 1), '')) AS account FROM p)
SELECT event_type, account, count(*) AS n_rows FROM t WHERE event_type IS NOT NULL GROUP BY 1, 2"""


@query("auth_lines_users", _AUTH_SQL)
def _(case: Case) -> DataFrame:
    from ..sources.text import auth_log

    once = case["linux_auth"].groupBy("source_file", "line_no").agg(F.min_by("message", "rec_id").alias("value")).select(F.col("source_file").alias("path"), "line_no", "value")
    return auth_log(once).groupBy("event_type", F.col("user").alias("account")).agg(F.count(F.lit(1)).alias("n_rows"))


__all__ = ["ORACLE", "QUERIES", "SparkSession"]
