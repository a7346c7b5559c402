"""The catalogue of artifact tables, and the views over them.

A case is a folder with one Parquet table per artifact; tables that were not
collected are empty frames of the declared schema, so every query runs on every
case. Timestamps are read as they lie: zoneless or in UTC. Text stamps, of
whatever layout, become instants by the case's ``hosts`` table (zone and order
of dates); local ones of a host that isn't listed there are read as UTC, like
zoneless timestamps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.timestamps import normalize_stamps

#: The lookup's row for stamps of hosts it doesn't list, and the columns that name a row's host.
UNLISTED, HOST_COLUMNS = "(unlisted)", ("host", "computer")

# The tables' columns.
TABLES = {
    "source_files": "id int, path string, type string, sha256 string, size bigint, parsed_at timestamp, error string",
    "prefetch": "filename string, path string, run_count bigint, last_run timestamp, first_seen timestamp, volume_paths string, sha256 string, file_refs string",
    "amcache": "path string, sha256 string, compile_time timestamp, first_seen timestamp, publisher string, version string",
    "shimcache": "path string, last_modified timestamp, executed boolean, order_idx int",
    "userassist": "path string, run_count int, last_run timestamp, focus_count int, focus_duration int",
    "bam_dam": "path string, last_run timestamp, sid string, source string",
    "mft": "inode bigint, path string, size bigint, created timestamp, modified timestamp, accessed timestamp, mft_modified timestamp, is_dir boolean, is_deleted boolean, ads_name string, flags int",
    "usnjrnl": "usn bigint, path string, reason string, timestamp timestamp, file_attributes int, source_info string",
    "lnk_files": "path string, target_path string, created timestamp, modified timestamp, accessed timestamp, machine_id string, drive_serial string, volume_label string, args string, working_dir string",
    "jumplists": "app_id string, app_name string, entry_type string, target_path string, created timestamp, modified timestamp, accessed timestamp, access_count int, pin_status string, entry_id string",
    "recycle_bin": "original_path string, deleted_at timestamp, size bigint, sid string, i_file string, r_file string",
    "shellbags": "path string, last_modified timestamp, user string, source string, item_type string",
    "persistence": "type string, name string, command string, path string, key_path string, enabled boolean, sid string, modified timestamp",
    "services": "name string, display_name string, start_type string, binary_path string, object_name string, modified timestamp",
    "scheduled_tasks": "name string, path string, command string, args string, trigger string, author string, last_run timestamp, enabled boolean",
    "wmi_subs": "consumer_name string, consumer_type string, filter_name string, filter_query string, created timestamp",
    "registry_raw": "hive string, key_path string, value_name string, value_type string, value_data string, modified timestamp",
    "evtx_events": "event_id int, channel string, timestamp timestamp, computer string, user_sid string, provider string, message string, xml_raw string, record_id bigint",
    "auth_events": "event_id int, timestamp timestamp, user string, domain string, logon_type int, src_ip string, workstation string, logon_id string, process_name string",
    "kerberos_events": "event_id int, timestamp timestamp, user string, domain string, service_name string, ticket_options string, encryption_type string, src_ip string, failure_code string",
    "ps_scriptblock": "timestamp timestamp, script_id string, script_text string, path string, level string, computer string",
    "ps_history": "command string, timestamp timestamp, source string, user string",
    "defender_events": "event_id int, timestamp timestamp, threat_name string, severity string, path string, action string, detection_user string, process_name string, sha256 string",
    "proc_creation": "event_id int, timestamp timestamp, pid int, ppid int, image string, cmdline string, parent_image string, user_name string, integrity_level string, token_elevation string, logon_id string, computer string",
    "sysmon_process": "timestamp timestamp, pid int, ppid int, image string, cmdline string, parent_image string, parent_cmdline string, sha256 string, integrity_level string, user_name string, logon_id string, computer string",
    "sysmon_network": "timestamp timestamp, pid int, image string, proto string, src_ip string, src_port int, src_host string, dst_ip string, dst_port int, dst_host string, initiated boolean, user_name string, computer string",
    "sysmon_dns": "timestamp timestamp, pid int, image string, query_name string, query_status string, query_results string, user_name string, computer string",
    "sysmon_file": "timestamp timestamp, pid int, image string, target_filename string, user_name string, computer string",
    "sysmon_imageload": "timestamp timestamp, pid int, image string, image_loaded string, sha256 string, signed boolean, signature string, user_name string, computer string",
    "lateral_movement": "type string, timestamp timestamp, src_host string, dst_host string, user string, method string, tool string, details string",
    "ual_access": "client_name string, client_ip string, user_sid string, access_time timestamp, role_guid string",
    "smb_events": "timestamp timestamp, user string, share string, src_ip string, operation string, path string, event_id int",
    "rdp_events": "event_id int, timestamp timestamp, user string, src_ip string, session_id string, duration int",
    "browser_history": "browser string, url string, title string, visit_time timestamp, visit_count int, profile string",
    "browser_downloads": "browser string, url string, local_path string, start_time timestamp, end_time timestamp, bytes bigint, state string",
    "mem_pslist": "pid int, ppid int, name string, mem_offset string, threads int, handles int, wow64 boolean, create_time timestamp, exit_time timestamp",
    "mem_psscan": "pid int, ppid int, name string, mem_offset string, create_time timestamp, exit_time timestamp, stale_pool boolean",
    "mem_cmdline": "pid int, name string, cmdline string",
    "mem_netscan": "mem_offset string, proto string, local_addr string, local_port int, remote_addr string, remote_port int, state string, pid int, name string, created timestamp",
    "mem_filescan": "mem_offset string, name string, path string",
    "mem_handles": "pid int, name string, handle_type string, handle_value string, object_name string",
    "mem_modules": "pid int, name string, base string, size bigint, path string",
    "mem_driverscan": "mem_offset string, name string, size bigint, path string",
    "mem_malfind": "pid int, name string, address string, size bigint, reason string, vad_tag string, hexdump string, disasm string",
    "mem_sysinfo": "key string, value string",
    "mem_hivelist": "mem_offset string, hive_name string, path string, mapped boolean",
    "linux_auth": "timestamp timestamp, event_type string, user string, src_ip string, method string, pid int, message string",
    "linux_sessions": "user string, terminal string, login_time timestamp, logout_time timestamp, src_ip string, source string",
    "shell_history": "command string, timestamp timestamp, source string, user string, shell string",
    "linux_persistence": "type string, path string, command string, user string, enabled boolean, details string",
    "emails": "id bigint, source_file string, folder string, message_id string, from_addr string, from_name string, to_addrs string, cc_addrs string, bcc_addrs string, subject string, sent_at timestamp, received_at timestamp, body_text string, body_html string, has_attachments boolean, x_mailer string, x_originating_ip string, reply_to string, in_reply_to string, headers_raw string",
    "email_attachments": "email_id bigint, filename string, content_type string, size_bytes bigint, sha256 string, is_executable boolean",
    "email_urls": "email_id bigint, url string, domain string",
    "wer_crashes": "app_name string, app_path string, app_version string, app_timestamp string, crash_time timestamp, fault_module string, fault_module_version string, exception_code string, exception_offset string, bucket_id string, source_file string",
    "anydesk_sessions": "direction string, timestamp timestamp, auth_method string, client_alias string, anydesk_id string, source_file string",
    "anydesk_events": "timestamp timestamp, pid int, level string, component string, message string, source_file string",
    "anydesk_config": "key string, value string, source_file string",
    "network_config": "timestamp timestamp, event_id int, adapter string, ip_addr string, gateway string, dns_servers string, subnet string, dhcp_server string, source string",
    "bits_jobs": "job_guid string, job_name string, job_type int, state int, state_name string, priority int, owner string, created_at timestamp, modified_at timestamp, completed_at timestamp",
    "bits_files": "job_guid string, file_guid string, remote_url string, local_path string, bytes_total bigint, bytes_xferred bigint, pct_complete float",
    "srum_network_usage": "timestamp timestamp, app_id int, user_id int, app_name string, user_name string, bytes_sent bigint, bytes_recvd bigint, iface_luid bigint, l2_profile_id int",
    "srum_app_usage": "timestamp timestamp, app_id int, user_id int, app_name string, user_name string, fg_cycles bigint, bg_cycles bigint, fg_context_switches int, bg_context_switches int, fg_bytes_read bigint, fg_bytes_written bigint",
    "typed_urls": "url string, visit_order int, user string, source string",
    "run_mru": "command string, mru_order string, user string, modified timestamp",
    "rdp_client_history": "server string, username string, user string, modified timestamp",
    "muicache": "exe_path string, description string, user string, modified timestamp",
    "opensave_mru": "path string, extension string, mru_order string, user string, modified timestamp",
    "logfile_events": "lsn bigint, operation string, op_code int, transaction_id bigint, target_attr int, filename string, timestamp timestamp",
    "ntds_accounts": "sam_account_name string, display_name string, description string, object_sid string, last_logon timestamp, pwd_last_set timestamp, bad_pwd_count int, account_flags int, is_disabled boolean, is_deleted boolean, pwd_never_expires boolean, no_pwd_required boolean",
    "usb_history": "first_install timestamp, last_arrival timestamp, device_id string, friendly_name string, serial_number string, drive_letter string, volume_name string, manufacturer string, user string, source string",
    "network_adapters": "adapter_name string, description string, ip_address string, subnet_mask string, default_gateway string, dns_servers string, dhcp_enabled string, mac_address string, source string",
    "installed_software": "display_name string, display_version string, publisher string, install_date string, install_location string, uninstall_string string, user string, source string",
    "ioc_indicators": "type string, value string, source string, confidence string, related_campaign string, first_seen timestamp, notes string",
    "ioc_extracted": "type string, value string, source string, context string, count int, first_seen timestamp",
    "attack_techniques": "technique_id string, name string, tactic string, evidence string, artifacts string, confidence string",
    "case_meta": "id int, name string, examiner string, description string, created_at timestamp, updated_at timestamp",
    "case_notes": "id bigint, ref_type string, ref_id string, note string, created_at timestamp",
}


class Case:
    """Named tables of one case, read lazily; missing tables are empty, missing columns null.

    ``tables`` given as frames replace what lies in the folder (tests, merged
    cases). Columns beyond the catalogue are kept after the declared ones.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.folder, self.given = spark, folder, dict(tables or {})
        self._kept: dict[str, DataFrame] = {}
        self._there: dict[str, bool] = {}
        self._filled: dict[str, bool] = {}

    def has(self, name: str) -> bool:
        """Whether the table was collected (it may still be empty)."""
        if name not in self._there:
            self._there[name] = name in self.given or bool(self.folder) and self._exists(f"{self.folder}/{name}.parquet")
        return self._there[name]

    def _exists(self, path: str) -> bool:
        """Whether a file or folder is there, on whatever file system its path names; errors of that system are raised."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return bool(place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place))

    def _raw(self, name: str) -> DataFrame:
        """A collected table as it lies there."""
        return self.given[name] if name in self.given else self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def has_rows(self, name: str) -> bool:
        """Whether the table was collected and holds a row."""
        if name not in self._filled:
            self._filled[name] = self.has(name) and not self._raw(name).isEmpty()
        return self._filled[name]

    def get(self, name: str) -> DataFrame:
        if name not in self._kept:
            ddl = TABLES[name]
            if not self.has(name):
                self._kept[name] = self.spark.createDataFrame([], ddl)
            else:
                df = self._raw(name)
                want = [c.split(" ") for c in ddl.split(", ")]
                have = set(df.columns)
                declared = df.columns
                stamps = {c: f"_instant_{c}" for c, kind in want if kind == "timestamp" and c in have and dict(df.dtypes)[c] == "string"}
                df = self._instants(df, stamps)
                cols = []
                for c, kind in want:
                    if c not in have:
                        cols.append(F.lit(None).cast(kind).alias(c))
                    elif kind == "timestamp" and dict(df.dtypes)[c] == "timestamp_ntz":
                        cols.append(df[c].cast("timestamp").alias(c))
                    elif c in stamps:
                        cols.append(F.timestamp_micros(df[stamps[c]]).alias(c))
                    else:
                        cols.append(df[c])
                rest = [df[c] for c in declared if c not in {n for n, _ in want}]
                self._kept[name] = df.select(*cols, *rest)
        return self._kept[name]

    __getitem__ = get

    def _hosts(self) -> DataFrame | None:
        """host, zone_name, date_order of the case's machines, where that table was collected."""
        df = self._raw("hosts") if self.has("hosts") else None
        return df if df is None else df.select("host", "zone_name", "date_order").filter(F.col("host").isNotNull() & F.col("zone_name").isNotNull())

    def _instants(self, df: DataFrame, stamps: dict[str, str]) -> DataFrame:
        """``df`` with each text stamp's instant (microseconds since 1970 UTC) in the column named for it."""
        if not stamps:
            return df
        kept, kinds = df.columns, dict(df.dtypes)
        until = "collected_at" if kinds.get("collected_at") in ("timestamp", "timestamp_ntz") else None
        named = next((c for c in HOST_COLUMNS if c in kept), None)
        lookup = self.spark.createDataFrame([(UNLISTED, "UTC", None)], "host string, zone_name string, date_order string")
        hosts = self._hosts() if named else None
        if hosts is None:
            df = df.withColumn("_stamped_by", F.lit(UNLISTED))
        else:
            lookup = lookup.unionByName(hosts)
            listed = hosts.select(F.col("host").alias("_listed")).distinct()
            df = df.join(listed, df[named] == F.col("_listed"), "left").withColumn("_stamped_by", F.coalesce("_listed", F.lit(UNLISTED)))
        for c, result in stamps.items():
            df = normalize_stamps(df, c, "_stamped_by", lookup, until, result)
        return df.select(*kept, *stamps.values())

    def with_tables(self, **tables: DataFrame) -> Case:
        return Case(self.spark, self.folder, {**self.given, **tables})

    def register(self) -> None:
        """All tables and views as temporary views, for free SQL."""
        for name in TABLES:
            self.get(name).createOrReplaceTempView(name)
        for name, view in VIEWS.items():
            view(self).createOrReplaceTempView(name)


def _null(kind: str):
    return F.lit(None).cast(kind)


def process_activity(case: Case) -> DataFrame:
    """Processes in memory with command line, prefetch and application cache."""
    cache = case["amcache"].withColumn("_k", F.lower(F.element_at(F.split("path", r"\\"), -1)))
    return (
        case["mem_pslist"].alias("p")
        .join(case["mem_cmdline"].select("pid", "cmdline").alias("c"), F.col("p.pid") == F.col("c.pid"), "left")
        .join(case["prefetch"].alias("f"), F.lower("p.name") == F.lower("f.filename"), "left")
        .join(cache.alias("a"), F.lower("p.name") == F.col("a._k"), "left")
        .select("p.pid", "p.ppid", "p.name", "p.create_time", "p.exit_time", "c.cmdline", "f.run_count", "f.last_run", F.col("a.sha256").alias("amcache_sha256"), F.col("a.path").alias("full_path"))
    )


def network_activity(case: Case) -> DataFrame:
    """Connections in memory with what is known of their remote address."""
    known = case["ioc_indicators"].select(F.col("value").alias("_v"), F.col("confidence").alias("ioc_confidence"), F.col("source").alias("ioc_source"))
    return case["mem_netscan"].join(known, F.col("remote_addr") == F.col("_v"), "left").drop("_v")


def lateral_movement(case: Case) -> DataFrame:
    """Network and remote-desktop logons, RDP and SMB events."""
    a = case["auth_events"].filter(F.col("logon_type").isin(3, 10)).select(F.lit("auth").alias("source"), "timestamp", "user", F.col("src_ip").alias("src"), F.col("workstation").alias("dst"), F.col("logon_type").cast("string").alias("method"))
    r = case["rdp_events"].select(F.lit("rdp").alias("source"), "timestamp", "user", F.col("src_ip").alias("src"), _null("string").alias("dst"), F.lit("rdp").alias("method"))
    s = case["smb_events"].select(F.lit("smb").alias("source"), "timestamp", "user", F.col("src_ip").alias("src"), F.col("share").alias("dst"), F.col("operation").alias("method"))
    return a.unionByName(r).unionByName(s)


def persistence(case: Case) -> DataFrame:
    """Everything that starts by itself."""
    parts = [
        case["persistence"].select(F.lit("registry").alias("source"), "type", "name", "command", "modified"),
        case["services"].select(F.lit("service").alias("source"), F.col("start_type").alias("type"), "name", F.col("binary_path").alias("command"), "modified"),
        case["scheduled_tasks"].select(F.lit("task").alias("source"), F.lit("task").alias("type"), "name", "command", F.col("last_run").alias("modified")),
        case["wmi_subs"].select(F.lit("wmi").alias("source"), F.col("consumer_type").alias("type"), F.col("consumer_name").alias("name"), F.col("filter_query").alias("command"), F.col("created").alias("modified")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_activity(case: Case) -> DataFrame:
    """File creations and journal entries."""
    m = case["mft"].select("path", F.col("created").alias("timestamp"), F.lit("CREATED").alias("action"), "size", "is_deleted")
    u = case["usnjrnl"].select("path", "timestamp", F.col("reason").alias("action"), _null("bigint").alias("size"), F.lit(False).alias("is_deleted"))
    return m.unionByName(u)


def user_activity(case: Case) -> DataFrame:
    """Logons, shell commands and visits by user."""
    a = case["auth_events"].select(F.lit("auth").alias("source"), "timestamp", "user", F.col("event_id").cast("string").alias("detail"))
    s = case["shell_history"].select(F.lit("shell").alias("source"), "timestamp", "user", F.col("command").alias("detail"))
    b = case["browser_history"].select(F.lit("browser").alias("source"), F.col("visit_time").alias("timestamp"), F.col("profile").alias("user"), F.col("url").alias("detail"))
    return a.unionByName(s).unionByName(b)


def alerts(case: Case) -> DataFrame:
    """Antivirus events and injected memory."""
    d = case["defender_events"].select(F.lit("defender").alias("source"), "timestamp", "severity", F.col("threat_name").alias("title"), F.col("path").alias("detail"))
    m = case["mem_malfind"].select(F.lit("malfind").alias("source"), _null("timestamp").alias("timestamp"), F.lit("HIGH").alias("severity"), F.col("name").alias("title"), F.col("reason").alias("detail"))
    return d.unionByName(m)


VIEWS: dict[str, Callable[[Case], DataFrame]] = {
    "v_process_activity": process_activity, "v_network_activity": network_activity, "v_lateral_movement": lateral_movement, "v_persistence": persistence,
    "v_file_activity": file_activity, "v_user_activity": user_activity, "v_alerts": alerts,
}
