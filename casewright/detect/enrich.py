"""Enrichment: tables completed from one another before detectors run.

Each is a function from a case to the frame of one table; ``enriched`` returns
the case with all of them. Rows are added once (distinct), never updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, filetime, has
from ..schema import TABLES, Case

c = F.col


def _owner(key: str = "key_path") -> Column:
    """Account in a user hive's key path."""
    return F.get(F.split(c(key), r"\\"), 2)


def _leaf(key: str = "key_path", n: int = 1) -> Column:
    return F.element_at(F.split(c(key), r"\\"), -n)


def _shape(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table in order, missing ones null."""
    have = set(df.columns)
    cols = [(c(n) if n in have else F.lit(None)).cast(k).alias(n) for n, k in (x.split(" ") for x in TABLES[table].split(", "))]
    return df.select(*cols)


def _added(case: Case, table: str, fresh: DataFrame) -> DataFrame:
    return _shape(case[table], table).unionByName(_shape(fresh, table)).distinct()


def _set(name: str) -> Column:
    """Values that were written at all."""
    return c(name).isNotNull()


def prefetch_first_seen(case: Case) -> DataFrame:
    """prefetch.first_seen from the creation of the trace file, where it is missing: the file of that name, else the earliest of the program's (PROGRAM.EXE-HASH.pf)."""
    made = case["mft"].filter(F.lower("path").endswith(".pf")).groupBy(basename("path").alias("_k")).agg(F.min("created").alias("_made"))
    by_program = made.groupBy(F.regexp_replace("_k", r"-[0-9a-f]+\.pf$", "").alias("_p")).agg(F.min("_made").alias("_by"))
    own = case["prefetch"].withColumn("_f", F.lower("filename"))
    both = own.join(made, c("_f") == c("_k"), "left").join(by_program, c("_f") == c("_p"), "left")
    return _shape(both.withColumn("first_seen", F.coalesce("first_seen", "_made", "_by")), "prefetch")


def bam_from_registry(case: Case) -> DataFrame:
    """bam_dam: the eight bytes of each program's value as a time, by the account in the key."""
    r = case["registry_raw"].filter(has("key_path", "\\bam\\usersettings\\", "\\bam\\state\\usersettings\\", "\\dam\\usersettings\\", "\\dam\\state\\usersettings\\") & c("value_name").contains("\\") & (F.length("value_data") >= 16))
    ft = F.conv(F.concat(*[F.substring("value_data", 1 + 2 * i, 2) for i in range(7, -1, -1)]), 16, 10).try_cast("bigint")
    return _added(case, "bam_dam", r.select(c("value_name").alias("path"), filetime(ft).alias("last_run"), _leaf().alias("sid"), F.when(has("key_path", "\\dam\\"), "DAM").otherwise("BAM").alias("source")))


def typed_urls(case: Case) -> DataFrame:
    r = case["registry_raw"].filter(has("key_path", "\\software\\microsoft\\internet explorer\\typedurls") & c("value_name").startswith("url") & _set("value_data"))
    return _added(case, "typed_urls", r.select(c("value_data").alias("url"), F.regexp_extract("value_name", r"^url(\d+)$", 1).try_cast("int").alias("visit_order"), _owner().alias("user"), c("key_path").alias("source")))


def run_mru(case: Case) -> DataFrame:
    r = case["registry_raw"].filter(has("key_path", "\\software\\microsoft\\windows\\currentversion\\explorer\\runmru") & (c("value_name") != "MRUList") & _set("value_data"))
    return _added(case, "run_mru", r.select(c("value_data").alias("command"), c("value_name").alias("mru_order"), _owner().alias("user"), "modified"))


def rdp_clients(case: Case) -> DataFrame:
    """rdp_client_history: servers by the key that keeps the hint of an account, or by the name of the last one used."""
    hint = c("value_name") == "UsernameHint"
    r = case["registry_raw"].filter(has("key_path", "\\software\\microsoft\\terminal server client\\servers\\") & (hint | (c("value_name") == "MRU0")))
    return _added(case, "rdp_client_history", r.select(F.when(hint, _leaf()).otherwise(c("value_name")).alias("server"), F.when(hint, c("value_data")).otherwise("").alias("username"), _owner().alias("user"), "modified"))


def muicache(case: Case) -> DataFrame:
    r = case["registry_raw"].filter(has("key_path", "\\software\\classes\\local settings\\software\\microsoft\\windows\\shell\\muicache", "\\software\\microsoft\\windows\\shellnoroam\\muicache") & c("value_name").contains("\\"))
    return _added(case, "muicache", r.select(c("value_name").alias("exe_path"), c("value_data").alias("description"), _owner().alias("user"), "modified"))


def opensave(case: Case) -> DataFrame:
    r = case["registry_raw"].filter(has("key_path", "\\software\\microsoft\\windows\\currentversion\\explorer\\comdlg32\\opensavepidlmru\\") & (c("value_name") != "MRUListEx") & c("value_type").isin("REG_SZ", "REG_EXPAND_SZ"))
    return _added(case, "opensave_mru", r.select(c("value_data").alias("path"), _leaf().alias("extension"), c("value_name").alias("mru_order"), _owner().alias("user"), "modified"))


def usb(case: Case) -> DataFrame:
    """usb_history: named devices, with the drive letter of the mounted volume whose data names the serial number (equality on the number cut out of the data, no scan of all pairs)."""
    raw = case["registry_raw"]
    one = raw.filter(has("key_path", "\\enum\\usbstor\\") & (c("value_name") == "FriendlyName") & _set("value_data")).select(c("key_path").alias("device_id"), c("value_data").alias("friendly_name"), _leaf().alias("serial_number")).distinct()
    # mounted devices are UTF-16 text in binary values: _??_USBSTOR#device#serial#{class}
    text = F.when(c("value_data").rlike("^(?:[0-9A-Fa-f]{4})+$"), F.decode(F.unhex("value_data"), "UTF-16LE")).otherwise(c("value_data"))
    mounts = raw.filter(has("key_path", "\\mounteddevices") & c("value_name").startswith("\\DosDevices\\")).select(c("value_name").alias("drive_letter"), F.explode(F.split(text, "[#\\s]")).alias("_m")).filter("_m <> ''").groupBy(F.lower("_m").alias("_m")).agg(F.min("drive_letter").alias("drive_letter"))
    return _added(case, "usb_history", one.join(mounts, F.lower("serial_number") == c("_m"), "left").withColumn("source", F.lit("USBSTOR")))


def adapters(case: Case) -> DataFrame:
    """network_adapters: values of each interface folded to one row, with the description of the class entry that names the interface (or is named like it)."""
    raw = case["registry_raw"]
    pick = lambda *v: F.max(F.when(c("value_name").isin(*v), c("value_data")))
    own = raw.filter(has("key_path", "\\services\\tcpip\\parameters\\interfaces\\")).groupBy(_leaf().alias("adapter_name")).agg(pick("IPAddress").alias("_ip"), pick("DhcpIPAddress").alias("_dhcp"), pick("SubnetMask").alias("_mask"), pick("DhcpSubnetMask").alias("_dmask"), pick("DefaultGateway").alias("_gate"), pick("DhcpDefaultGateway").alias("_dgate"), pick("NameServer", "DhcpNameServer").alias("dns_servers"), pick("EnableDHCP").alias("dhcp_enabled"))
    own = own.filter("_ip IS NOT NULL OR _dhcp IS NOT NULL").select("adapter_name", F.coalesce("_ip", "_dhcp").alias("ip_address"), F.coalesce("_mask", "_dmask").alias("subnet_mask"), F.coalesce("_gate", "_dgate").alias("default_gateway"), "dns_servers", "dhcp_enabled")
    cls = raw.filter(has("key_path", "\\{4d36e972")).groupBy("key_path").agg(pick("DriverDesc").alias("description"), pick("NetCfgInstanceId").alias("_id")).filter("description IS NOT NULL")
    names = cls.select(F.explode(F.array(F.lower("_id"), F.lower(_leaf()))).alias("_n"), "description").filter("_n IS NOT NULL").groupBy("_n").agg(F.min("description").alias("description"))
    return _added(case, "network_adapters", own.join(names, F.lower("adapter_name") == c("_n"), "left").withColumn("source", F.lit("registry")))


def software(case: Case) -> DataFrame:
    """installed_software: values of each uninstall key folded to one row. (Folding by the key above, as the specification has it, would mix all programs.)"""
    r = case["registry_raw"].filter(has("key_path", "\\microsoft\\windows\\currentversion\\uninstall\\"))
    pick = lambda v: F.max(F.when(c("value_name") == v, c("value_data")))
    one = r.groupBy("key_path", _owner().alias("user")).agg(pick("DisplayName").alias("display_name"), pick("DisplayVersion").alias("display_version"), pick("Publisher").alias("publisher"), pick("InstallDate").alias("install_date"), pick("InstallLocation").alias("install_location"), pick("UninstallString").alias("uninstall_string")).filter("display_name IS NOT NULL")
    return _added(case, "installed_software", one.withColumn("source", F.lit("Uninstall")))


ENRICHMENTS = {"prefetch": prefetch_first_seen, "bam_dam": bam_from_registry, "typed_urls": typed_urls, "run_mru": run_mru, "rdp_client_history": rdp_clients, "muicache": muicache, "opensave_mru": opensave, "usb_history": usb, "network_adapters": adapters, "installed_software": software}


def enriched(case: Case) -> Case:
    """The case with all enrichments; those without input add nothing."""
    return case.with_tables(**{t: f(case) for t, f in ENRICHMENTS.items() if case.has("registry_raw") or t == "prefetch" and case.has("mft")})


__all__ = ["ENRICHMENTS", "enriched", "filetime"]
