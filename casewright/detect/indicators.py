"""Indicators of compromise in free text: extraction, classification, import.

All of it is one projection per source column (regular expressions on the JVM),
one explode and one map-side combined aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of
from ..schema import Case

# Columns that are searched, in order of rank.
TARGETS = (
    ("prefetch", "path"), ("prefetch", "volume_paths"), ("amcache", "path"), ("shimcache", "path"), ("mft", "path"), ("usnjrnl", "path"), ("lnk_files", "target_path"), ("lnk_files", "args"), ("persistence", "command"), ("persistence", "key_path"), ("services", "binary_path"), ("scheduled_tasks", "command"), ("scheduled_tasks", "args"), ("evtx_events", "message"), ("ps_scriptblock", "script_text"), ("ps_history", "command"), ("defender_events", "path"), ("proc_creation", "cmdline"), ("sysmon_process", "cmdline"), ("sysmon_process", "parent_cmdline"), ("sysmon_network", "dst_ip"), ("sysmon_network", "dst_host"), ("sysmon_dns", "query_name"), ("browser_history", "url"), ("browser_history", "title"), ("browser_downloads", "url"), ("browser_downloads", "local_path"), ("emails", "from_addr"), ("emails", "to_addrs"), ("emails", "x_originating_ip"), ("emails", "body_text"), ("email_urls", "url"), ("email_attachments", "filename"), ("email_attachments", "sha256"), ("mem_cmdline", "cmdline"), ("mem_netscan", "remote_addr"), ("linux_auth", "message"), ("linux_auth", "src_ip"), ("shell_history", "command"), ("linux_persistence", "command"), ("anydesk_events", "message"), ("registry_raw", "value_data"), ("bits_files", "remote_url"), ("bits_files", "local_path"), ("typed_urls", "url"), ("run_mru", "command"), ("anydesk_sessions", "client_alias"), ("anydesk_sessions", "anydesk_id"), ("wer_crashes", "app_name"), ("wer_crashes", "app_path"), ("wer_crashes", "fault_module"), ("srum_network_usage", "app_name"), ("srum_app_usage", "app_name"), ("bits_jobs", "job_name"), ("rdp_client_history", "server"), ("opensave_mru", "path"),
)

# Folders that make a path worth keeping, and domains that are noise.
SUSPICIOUS_FOLDERS = ("/temp/", "/tmp/", "/appdata/", "/downloads/", "/desktop/", "/public/", "/programdata/", "/recycle", "/perflogs/", "/users/public/", "/startup/", "/windows/debug", "/windows/tasks/", "/users/all users")
NOISE_DOMAINS = ("microsoft.com", "windows.com", "windowsupdate.com", "msftncsi.com", "google.com", "googleapis.com", "gstatic.com", "github.com", "localhost", "w3.org", "schemas.microsoft.com", "ctldl.windowsupdate.com", "ocsp.digicert.com", "crl.microsoft.com", "ns.adobe.com")

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
HASHES = (("sha256", 64), ("sha1", 40), ("md5", 32))
URL = r"(?i)https?://[^\s\"'<>|]+"
IPV4 = _B + r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)" + _E
PRIVATE = r"^(?:10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|127\.|169\.254\.|0\.0\.0\.|255\.)"
REGKEY = r"(?i)" + _B + r"(?:HKEY_[A-Z_]+|HK[A-Z]{1,3})\\[^\s\"'<>|*?]{3,}"
WINPATH = r"[A-Za-z]:\\(?:[^\s\"'<>|*?\\]+\\)*[^\s\"'<>|*?\\]+"
NTFSPATH = r"(?i)/(?:Users|Windows|ProgramData|Program Files[^/]*)/[^\s\"'<>|*?]+"
# The endings of names that count as domains.
ENDINGS = "com|net|org|io|ru|cn|de|uk|gov|mil|edu|info|biz|xyz|top|pro|online|site|cc|tk|pw|app|dev|cloud|tech|me|co|us|ca|fr|jp|br|in|au|pl|nl|se|no|fi|dk|be|ch|at|es|it|pt|cz|hu|gr|ro|bg|tr|ua|kz|sa|ae|il|ir|eg|ma|ng|ke|th|ph|id|my|sg|hk|tw|kr|click|gq|ml|cf|ga|onion|example|test"
DOMAIN = r"(?i)" + _B + rf"(?=[a-z0-9-]++\.)(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{ENDINGS})" + _E
BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"


def _all(c: Column, pattern: str, there: Column | None = None) -> Column:
    """All matches of a pattern; not even looked for where a cheap test says there can be none."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return found if there is None else F.when(there, found).otherwise(F.array().cast("array<string>"))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"[.,;:)'\"\]]+$", "")


def indicators_of(text: Column, base64: bool = False) -> Column:
    """array<struct<type, value>> of one text: hashes (long ones first, and not again as parts), URLs, public addresses, registry keys, suspicious paths, domains."""
    out, rest = [], text
    hexed = text.rlike("[A-Fa-f0-9]{32}")
    for kind, n in HASHES:
        pattern = f"{_B}[A-Fa-f0-9]{{{n}}}{_E}"
        out.append((kind, _all(rest, pattern, hexed)))
        rest = F.regexp_replace(rest, pattern, " ")
    dotted, linked, back = text.contains("."), text.contains("://"), text.contains("\\")
    out.append(("url", F.transform(_all(text, URL, linked), _trimmed)))
    out.append(("ip", F.filter(_all(text, IPV4, dotted), lambda x: ~x.rlike(PRIVATE))))
    out.append(("regkey", F.transform(_all(text, REGKEY, back), lambda x: F.regexp_replace(x, r"[\\.,;:)'\"\]]+$", ""))))
    paths = F.concat(_all(text, WINPATH, text.contains(":\\")), _all(text, NTFSPATH, text.contains("/")))
    out.append(("path", F.filter(F.transform(paths, _trimmed), lambda x: any_of([F.translate(F.lower(x), "\\", "/").contains(f) for f in SUSPICIOUS_FOLDERS]))))
    if base64:
        out.append(("base64", _all(text, BASE64)))
    bare = F.when(linked, F.regexp_replace(text, URL, " ")).otherwise(text)
    domains = F.transform(_all(bare, DOMAIN, dotted), F.lower)
    out.append(("domain", F.filter(domains, lambda x: (F.length(x) >= 6) & ~any_of([(x == d) | x.endswith("." + d) for d in NOISE_DOMAINS]))))

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("value")))

    return F.filter(F.concat(*[named(k, v) for k, v in out]), lambda s: F.length(s["value"]) >= 3)


def extract_from(frames: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """type, value, source, context, count over named texts (name, frame, column), the first source in the list's order winning."""
    parts = []
    by_table: dict[int, list[tuple[int, str, str]]] = {}
    tables = {}
    for rank, (name, df, column) in enumerate(frames):
        by_table.setdefault(id(df), []).append((rank, name, column))
        tables[id(df)] = df
    # one scan of each table, however many of its columns are searched
    for key, cols in by_table.items():
        df = tables[key]
        texts = F.array(*[F.struct(F.lit(rank).alias("_rank"), F.lit(name).alias("source"), F.lit(any(x in name for x in ("ps_", "script", "cmdline"))).alias("_b"), df[column].cast("string").alias("_t")) for rank, name, column in cols])
        lean = df.select(F.explode(texts).alias("_x")).select("_x._rank", "_x.source", "_x._b", "_x._t").filter(F.length("_t") > 3)
        text = F.col("_t")
        found = F.filter(indicators_of(text, any("ps_" in n or "script" in n or "cmdline" in n for _, n, _ in cols)), lambda s: (s["type"] != "base64") | F.col("_b"))
        parts.append(lean.select("_rank", "source", F.left(text, F.lit(200)).alias("context"), F.inline(found)))
    every = reduce(DataFrame.unionByName, parts)
    first = F.min(F.struct("_rank", "value", "source", "context")).alias("_f")
    agg = every.groupBy("type", F.lower("value").alias("_k")).agg(F.count(F.lit(1)).alias("count"), first)
    return agg.select("type", F.col("_f.value").alias("value"), F.col("_f.source").alias("source"), F.col("_f.context").alias("context"), "count")


def extract_case(case: Case) -> DataFrame:
    """Indicators of every searched column that was collected."""
    frames = [(f"{t}.{c}", case[t], c) for t, c in TARGETS if case.has(t)]  # a table is one frame object
    if not frames:
        return case.spark.createDataFrame([], "type string, value string, source string, context string, count bigint")
    return extract_from(frames)


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def classify(value: Column) -> Column:
    """What a listed indicator is: url, sha256, sha1, md5, ip, path, domain or indicator; null for a null or blank text."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
        .when(v.startswith("http://") | v.startswith("https://"), "url")
        .when(v.rlike("^[A-Fa-f0-9]{64}$"), "sha256")
        .when(v.rlike("^[A-Fa-f0-9]{40}$"), "sha1")
        .when(v.rlike("^[A-Fa-f0-9]{32}$"), "md5")
        .when(v.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(v.contains("\\") | v.contains("/"), "path")
        .when(v.rlike(r"^[A-Za-z0-9._-]*\.[A-Za-z0-9_-]{2,}$"), "domain")
        .otherwise("indicator")
    )


def normal_value(value: Column) -> Column:
    """The value as it is kept: without blanks around it, hashes and domains in small letters."""
    v = F.trim(value)
    return F.when(classify(value).isin("md5", "sha1", "sha256", "domain"), F.lower(v)).otherwise(v)


def import_list(known: DataFrame, lines: DataFrame, source: str, column: str = "value", confidence: str = "HIGH", campaign: str = "") -> DataFrame:
    """Rows of a list of indicators that are not yet known from this source (by lower-cased value): type, value, source, confidence, related_campaign.

    Comments (# or //), null and blank lines are skipped; of repeats within the
    list, whatever their case, the smallest spelling counts. A confidence other
    than HIGH, MED or LOW is HIGH.
    """
    fresh = lines.select(F.trim(F.col(column)).alias("_line")).filter((F.col("_line") != "") & ~F.col("_line").rlike("^(?:#|//)"))
    once = fresh.select(normal_value(F.col("_line")).alias("value")).groupBy(F.lower("value").alias("_k")).agg(F.min("value").alias("value"))
    old = known.filter(F.col("source") == source).select(F.lower("value").alias("_k")).distinct()
    grade = confidence if confidence in ("HIGH", "MED", "LOW") else "HIGH"
    return once.join(old, "_k", "left_anti").select(classify(F.col("value")).alias("type"), "value", F.lit(source).alias("source"), F.lit(grade).alias("confidence"), F.lit(campaign.strip()).alias("related_campaign"))
