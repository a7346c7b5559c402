"""Detection rules (selections and a condition over a log source) compiled to Catalyst columns.

A rule is a dict, as read from JSON or YAML. Its condition is tokenised, parsed
to a tree with the usual precedence (not, and, or) and turned into one boolean
column, so a rule costs one filter, and rules over one source share its scan.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_of, any_of
from ..schema import Case
from .findings import union

# Severities of rule levels.
LEVELS = {"critical": "HIGH", "high": "HIGH", "medium": "MED", "med": "MED"}
KNOWN_MODIFIERS = {"contains", "startswith", "endswith", "all", "windash", "re", "gt", "gte", "lt", "lte", "cidr", "cased"}


@dataclass(frozen=True)
class Source:
    """Where a rule looks: the relation, the value it reports, its time, and the fields rules may name."""

    relation: Callable[[Case], DataFrame]
    value: Callable[[], Column]
    seen: str
    fields: Mapping[str, Callable[[], Column]]


@dataclass
class Rule:
    title: str
    detection: dict[str, Any]
    logsource: dict[str, str]
    ident: str = ""
    level: str = ""
    description: str = ""
    tags: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def severity(self) -> str:
        return LEVELS.get(self.level.lower(), "LOW")

    @property
    def technique(self) -> str | None:
        return next((t[len("attack.") :].upper() for t in self.tags if t.lower().startswith("attack.t")), None)

    @property
    def source_id(self) -> str:
        return "sigma:" + (self.ident[:8] if self.ident else re.sub(r"[^a-z0-9]+", "_", self.title.lower())[:32])


def parse_rule(doc: Any) -> Rule:
    """A rule from its document; ValueError says what is wrong with it."""
    if not isinstance(doc, dict) or not doc.get("title"):
        raise ValueError("a rule needs a title")
    if not isinstance(doc.get("logsource"), dict):
        raise ValueError("logsource must be a mapping")
    if not isinstance(doc.get("detection"), dict) or "condition" not in doc["detection"]:
        raise ValueError("detection needs a condition")
    return Rule(doc["title"], dict(doc["detection"]), {k: str(v) for k, v in doc["logsource"].items() if v}, str(doc.get("id") or ""), str(doc.get("level") or ""), str(doc.get("description") or ""), [str(t) for t in doc.get("tags") or []])


def load_rules(folder: str) -> tuple[list[Rule], dict[str, str]]:
    """Rules of a folder (JSON, and YAML where a parser is installed), and what could not be loaded and why."""
    rules, errors = [], {}
    for root, _, names in sorted(os.walk(folder)):
        for name in sorted(names):
            path = os.path.join(root, name)
            try:
                with open(path, encoding="utf-8") as f:
                    if name.endswith(".json"):
                        doc = json.load(f)
                    elif name.endswith((".yml", ".yaml")):
                        import yaml

                        doc = yaml.safe_load(f)
                    else:
                        continue
            except Exception as e:  # one bad file doesn't stop the others
                errors[path] = f"{type(e).__name__}: {e}"
                continue
            for i, one in enumerate(doc if isinstance(doc, list) else [doc]):
                try:
                    rules.append(parse_rule(one))
                except Exception as e:
                    errors[f"{path}#{i}" if isinstance(doc, list) else path] = f"{type(e).__name__}: {e}"
    return rules, errors


def bundled_rules() -> list[Rule]:
    """The rules that come with the library: one behaviour for each log source, every modifier and form of condition among them."""
    with open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "rules", "behaviours.json"), encoding="utf-8") as f:
        return [parse_rule(doc) for doc in json.load(f)]


# ---- conditions

_TOKEN = re.compile(r"\(|\)|[^\s()]+")


def parse_condition(text: str) -> tuple:
    """('or'|'and', left, right), ('not', x), ('name', n), ('some', 'any'|'all', pattern): a tree of the condition."""
    tokens = _TOKEN.findall(text.split("|")[0])
    at = 0

    def peek() -> str:
        return tokens[at].lower() if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"condition ends early: {text}")
        at += 1
        return tokens[at - 1]

    def either() -> tuple:
        left = both()
        while peek() == "or":
            take()
            left = ("or", left, both())
        return left

    def both() -> tuple:
        left = unary()
        while peek() == "and":
            take()
            left = ("and", left, unary())
        return left

    def unary() -> tuple:
        if peek() == "not":
            take()
            return ("not", unary())
        if peek() == "(":
            take()
            inner = either()
            if take() != ")":
                raise ValueError(f"unbalanced condition: {text}")
            return inner
        word = take()
        if word.lower() in ("1", "any", "all") and peek() == "of":
            take()
            return ("some", "all" if word.lower() == "all" else "any", take())
        return ("name", word)

    tree = either()
    if at != len(tokens):
        raise ValueError(f"condition has more after its end: {text}")
    return tree


def _wild(value: str) -> str:
    """Anchored regular expression of a value with * and ?, backslash escaping."""
    out, i = [], 0
    while i < len(value):
        ch = value[i]
        if ch == "\\" and i + 1 < len(value) and value[i + 1] in "*?\\":
            out.append(re.escape(value[i + 1]))
            i += 2
            continue
        out.append(".*" if ch == "*" else "." if ch == "?" else re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def _in_cidr(c: Column, network: str) -> Column:
    import ipaddress

    net = ipaddress.ip_network(network, strict=False)
    if net.version != 4:
        # all eight groups written out, then the leading bits as hexadecimal digits
        groups = lambda half: F.filter(F.split(half, ":"), lambda x: x != "")
        front, back = groups(F.substring_index(c, "::", 1)), groups(F.when(c.contains("::"), F.substring_index(c, "::", -1)).otherwise(""))
        missing = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(front) - F.size(back)))
        whole = F.array_join(F.transform(F.concat(front, missing, back), lambda x: F.lpad(F.lower(x), 4, "0")), "")
        digits, bits = divmod(net.prefixlen, 4)
        hexed = f"{int(net.network_address):032x}"
        low = int(hexed[digits], 16) if bits else 0
        allowed = [f"{low + i:x}" for i in range(1 << (4 - bits))] if bits else []
        fits = whole.startswith(hexed[:digits]) & (F.substring(whole, digits + 1, 1).isin(allowed) if bits else F.lit(True))
        return F.coalesce(c.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$") & (F.length(whole) == 32) & fits, F.lit(False))
    parts = F.split(c, r"\.")
    number = parts[0].try_cast("bigint") * 16777216 + parts[1].try_cast("bigint") * 65536 + parts[2].try_cast("bigint") * 256 + parts[3].try_cast("bigint")
    return F.coalesce(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & number.between(int(net.network_address), int(net.broadcast_address)), F.lit(False))


class Compiler:
    """Columns of a rule over a source. strict: unknown fields and names never match (else they match always, with a warning)."""

    def __init__(self, rule: Rule, source: Source, strict: bool = False, case_sensitive: bool = False):
        self.rule, self.source, self.strict, self.cased = rule, source, strict, case_sensitive

    def unknown(self, what: str) -> Column:
        self.rule.warnings.append(what)
        return F.lit(not self.strict)

    def condition(self) -> Column:
        cond = self.rule.detection["condition"]
        trees = [parse_condition(x) for x in (cond if isinstance(cond, list) else [cond])]
        return any_of([self.tree(t) for t in trees])

    def tree(self, t: tuple) -> Column:
        if t[0] == "or":
            return self.tree(t[1]) | self.tree(t[2])
        if t[0] == "and":
            return self.tree(t[1]) & self.tree(t[2])
        if t[0] == "not":
            return ~F.coalesce(self.tree(t[1]), F.lit(False))
        if t[0] == "name":
            return self.selection(t[1])
        names = [n for n in sorted(self.rule.detection) if n != "condition" and (t[2] == "them" or re.fullmatch(re.escape(t[2]).replace(r"\*", ".*"), n))]
        if not names:
            return self.unknown(f"no selection like {t[2]}")
        cols = [self.selection(n) for n in names]
        return any_of(cols) if t[1] == "any" else all_of(cols)

    def selection(self, name: str) -> Column:
        if name not in self.rule.detection or name == "condition":
            return self.unknown(f"unknown selection {name}")
        body = self.rule.detection[name]
        maps = body if isinstance(body, list) else [body]
        cols = [all_of([self.test(k, v) for k, v in sorted(m.items())]) for m in maps if isinstance(m, dict)]
        words = [m for m in maps if isinstance(m, (str, int))]
        if words:
            cols += [F.coalesce(self.source.value().contains(str(w)), F.lit(False)) for w in words]
        return any_of(cols) if cols else F.lit(True)

    def test(self, key: str, value: Any) -> Column:
        name, *mods = key.split("|")
        if name not in self.source.fields:
            return self.unknown(f"unknown field {name}")
        for m in mods:
            if m not in KNOWN_MODIFIERS:
                self.rule.warnings.append(f"modifier {m} is ignored")
        c = self.source.fields[name]()
        values = value if isinstance(value, list) else [value]
        tests = [self.one(c, mods, v) for v in values]
        return all_of(tests) if "all" in mods else any_of(tests)

    def one(self, c: Column, mods: list[str], v: Any) -> Column:
        if v is None or v == "null":
            return c.isNull()
        if isinstance(v, bool):
            return F.lower(c.cast("string")) == str(v).lower()
        text = c.cast("string")
        if {"gt", "gte", "lt", "lte"} & set(mods):
            n, x = text.try_cast("double"), float(v)
            return n > x if "gt" in mods else n >= x if "gte" in mods else n < x if "lt" in mods else n <= x
        s = str(v)
        if "re" in mods:
            return text.rlike(s)
        if "cidr" in mods:
            return _in_cidr(text, s)
        spellings = [s, s.replace("-", "/")] if "windash" in mods and "-" in s else [s]
        cased = self.cased or "cased" in mods
        if not cased:
            text, spellings = F.lower(text), [x.lower() for x in spellings]
        if "contains" in mods:
            return any_of([text.rlike(_wild(f"*{x}*")) if re.search(r"(?<!\\)[*?]", x) else text.contains(x) for x in spellings])
        if "startswith" in mods:
            return any_of([text.startswith(x) for x in spellings])
        if "endswith" in mods:
            return any_of([text.endswith(x) for x in spellings])
        return any_of([text.rlike(_wild(x)) if re.search(r"[*?]", x) else text == x for x in spellings])


# ---- log sources


def _cols(**names: str) -> dict[str, Callable[[], Column]]:
    return {k: (lambda e=e: F.expr(e)) for k, e in names.items()}


def _table(name: str) -> Callable[[Case], DataFrame]:
    return lambda case: case[name]


def _processes(case: Case) -> DataFrame:
    """Processes in memory and those the security log saw start."""
    lines = case["mem_cmdline"].select("pid", "cmdline")
    ram = case["mem_pslist"].join(lines, "pid", "left").selectExpr("name AS img", "cmdline AS cmd", "'' AS parent_img", "'' AS parent_cmd", "'' AS usr", "'' AS integrity", "create_time AS seen")
    log = case["proc_creation"].selectExpr("image AS img", "cmdline AS cmd", "parent_image AS parent_img", "'' AS parent_cmd", "user_name AS usr", "integrity_level AS integrity", "timestamp AS seen")
    return ram.unionByName(log)


def _sysmon(case: Case) -> DataFrame:
    return case["sysmon_process"].selectExpr("image AS img", "cmdline AS cmd", "parent_image AS parent_img", "parent_cmdline AS parent_cmd", "user_name AS usr", "integrity_level AS integrity", "sha256", "timestamp AS seen")


_PROCESS = _cols(Image="img", OriginalFileName="img", ProcessName="img", CommandLine="cmd", ParentImage="parent_img", ParentProcessName="parent_img", ParentCommandLine="parent_cmd", User="usr", IntegrityLevel="integrity", ProcessId="''", ParentProcessId="''", Hashes="''")
_EVENT = _cols(EventID="event_id", Channel="channel", Provider_Name="provider", Computer="computer", UserSid="user_sid", **{n: "message" for n in ("Message", "SubjectUserName", "TargetUserName", "SubjectDomainName", "IpAddress", "WorkstationName", "ServiceName", "ServiceFileName", "ImagePath", "TaskName", "TicketEncryptionType", "TicketOptions", "ObjectName", "ProcessName", "LogonType", "Status", "Data", "Details", "TargetObject", "MemberName", "GroupName", "PipeName")})
_EVENTS = Source(_table("evtx_events"), lambda: F.expr("concat(cast(event_id AS string), ': ', coalesce(message, ''))"), "timestamp", _EVENT)
_FILE = _cols(TargetFilename="path", FileName="path", FilePath="path", CreationUtcTime="created", IsExecutable="''")
_FILES = Source(_table("mft"), lambda: F.col("path"), "modified", _FILE)
_SCRIPT = Source(_table("ps_scriptblock"), lambda: F.coalesce("script_text", F.lit("")), "timestamp", _cols(ScriptBlockText="script_text", Path="path", Level="level"))
_REG_KEY = "concat(hive, chr(92), key_path, chr(92), value_name)"
_REGISTRY = Source(_table("registry_raw"), lambda: F.expr("concat(coalesce(hive, ''), chr(92), coalesce(key_path, ''), chr(92), coalesce(value_name, ''))"), "modified", _cols(TargetObject=_REG_KEY, Details="value_data", EventType="''", Image="''", ProcessId="''", User="''"))
_DNS = _cols(QueryName="query_name", QueryStatus="query_status", QueryResults="query_results", Image="image", ProcessId="cast(pid AS string)", User="user_name")

SOURCES: dict[str, Source] = {
    "process_creation": Source(_processes, lambda: F.expr("concat(coalesce(img, '?'), ' ', coalesce(cmd, ''))"), "seen", _PROCESS),
    "sysmon:process_creation": Source(_sysmon, lambda: F.expr("concat(coalesce(img, '?'), ' ', coalesce(cmd, ''))"), "seen", {**_PROCESS, **_cols(Hashes="sha256", SHA256="sha256")}),
    "network_connection": Source(_table("mem_netscan"), lambda: F.expr("concat(coalesce(name, '?'), ' → ', coalesce(remote_addr, '?'), ':', cast(coalesce(remote_port, 0) AS string))"), "created", _cols(DestinationIp="remote_addr", DestinationPort="cast(remote_port AS string)", DestinationHostname="remote_addr", SourceIp="local_addr", SourcePort="cast(local_port AS string)", Image="name", ProcessId="cast(pid AS string)", Protocol="proto", Initiated="''")),
    "sysmon:network_connection": Source(_table("sysmon_network"), lambda: F.expr("concat(coalesce(image, '?'), ' → ', coalesce(dst_ip, '?'), ':', cast(coalesce(dst_port, 0) AS string))"), "timestamp", _cols(DestinationIp="dst_ip", DestinationPort="cast(dst_port AS string)", DestinationHostname="dst_host", SourceIp="src_ip", SourcePort="cast(src_port AS string)", Image="image", ProcessId="cast(pid AS string)", Protocol="proto", Initiated="cast(initiated AS string)", User="user_name", Computer="computer")),
    "file_event": _FILES, "file_change": _FILES, "file_delete": _FILES,
    "security": _EVENTS, "system": _EVENTS, "application": _EVENTS, "sysmon": _EVENTS,
    "pipe_created": Source(_table("evtx_events"), lambda: F.coalesce("message", F.lit("")), "timestamp", _EVENT),
    "powershell-classic": _SCRIPT, "ps_script": _SCRIPT,
    "defender": Source(_table("defender_events"), lambda: F.expr("concat(coalesce(threat_name, '?'), ' | ', coalesce(path, '?'))"), "timestamp", _cols(ThreatName="threat_name", Path="path", Action="action", Severity="severity")),
    "auth": Source(_table("auth_events"), lambda: F.expr("concat(coalesce(user, '?'), ' [', cast(event_id AS string), '] from ', coalesce(src_ip, '-'))"), "timestamp", _cols(EventID="event_id", User="`user`", TargetUserName="`user`", SubjectUserName="`user`", Domain="domain", IpAddress="src_ip", WorkstationName="workstation", LogonType="cast(logon_type AS string)", ProcessName="process_name")),
    "sysmon_imageload": Source(_table("sysmon_imageload"), lambda: F.expr("concat(coalesce(image, '?'), ' → ', coalesce(image_loaded, '?'))"), "timestamp", _cols(Image="image", ImageLoaded="image_loaded", Signed="signed", Signature="signature", User="user_name", SHA256="sha256")),
    "driver_load": Source(_table("sysmon_imageload"), lambda: F.coalesce("image_loaded", F.lit("?")), "timestamp", _cols(ImageLoaded="image_loaded", Signed="cast(signed AS string)", Signature="signature", SHA256="sha256", Image="image")),
    "sysmon_dns": Source(_table("sysmon_dns"), lambda: F.coalesce("query_name", F.lit("?")), "timestamp", _DNS),
    "sysmon:dns_query": Source(_table("sysmon_dns"), lambda: F.expr("concat(coalesce(image, '?'), ' queried ', coalesce(query_name, '?'))"), "timestamp", _DNS),
    "registry_event": _REGISTRY, "registry_add": _REGISTRY, "registry_set": _REGISTRY,
    "process_tampering": Source(_table("sysmon_process"), lambda: F.expr("concat(coalesce(image, '?'), ' [', cast(coalesce(pid, 0) AS string), ']')"), "timestamp", _cols(Image="image", User="user_name", Hashes="sha256")),
    "shell_history": Source(_table("shell_history"), lambda: F.expr("concat(coalesce(user, '?'), ': ', left(coalesce(command, ''), 200))"), "timestamp", _cols(CommandLine="command", User="`user`", Shell="shell")),
    "wmi_event": Source(_table("wmi_subs"), lambda: F.expr("concat(coalesce(consumer_name, '?'), ' | ', coalesce(filter_query, '?'))"), "created", _cols(Name="consumer_name", ConsumerType="consumer_type", Filter="filter_query", Query="filter_query")),
    "task_scheduler": Source(_table("scheduled_tasks"), lambda: F.expr("concat(coalesce(name, '?'), ': ', coalesce(command, '?'))"), "last_run", _cols(TaskName="name", TaskPath="path", CommandLine="concat(command, coalesce(concat(' ', args), ''))", Author="author")),
}


def find_source(logsource: Mapping[str, str]) -> tuple[str, Source]:
    """By category, service, product:category, then sysmon:category on Windows; LookupError if none fits."""
    category, service, product = (logsource.get(k, "").lower() for k in ("category", "service", "product"))
    for key in (category, service, f"{product}:{category}", f"sysmon:{category}" if product == "windows" else ""):
        if key in SOURCES:
            return key, SOURCES[key]
    raise LookupError(f"no table for {dict(logsource)}")


def _findings(case: Case, source: Source, rules: list[tuple[Rule, Column]]) -> DataFrame:
    """Findings of rules over one source, in one scan of it."""
    hits = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(i)) for i, (_, hit) in enumerate(rules)])
    labels = F.create_map(*[x for i, (r, _) in enumerate(rules) for x in (F.lit(i), F.struct(F.lit(r.source_id).alias("source"), F.lit(r.severity).alias("confidence"), F.lit(r.technique).cast("string").alias("related_campaign"), F.lit(r.title + (f" — {r.description}" if r.description else "")).alias("notes")))])
    found = source.relation(case).select(source.value().alias("value"), F.col(source.seen).cast("timestamp").alias("first_seen"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("_i")).distinct()
    named = found.withColumn("_l", labels[F.col("_i")])
    return named.select(F.lit("event").alias("type"), "value", "_l.source", "_l.confidence", "_l.related_campaign", "first_seen", "_l.notes")


def run_rule(case: Case, rule: Rule, strict: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Findings of one rule."""
    _, source = find_source(rule.logsource)
    return _findings(case, source, [(rule, Compiler(rule, source, strict, case_sensitive).condition())])


def run_rules(case: Case, rules: list[Rule], strict: bool = False, case_sensitive: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Findings of all rules, and the rules that can't be compiled with the reason. Rules that look into the same relation share one scan of it."""
    errors: dict[str, str] = {}
    by_source: dict[int, tuple[Source, list[tuple[Rule, Column]]]] = {}
    probes: dict[int, DataFrame] = {}
    for r in rules:
        try:
            _, source = find_source(r.logsource)
            hit = Compiler(r, source, strict, case_sensitive).condition()
            probe = probes.setdefault(id(source), source.relation(case))
            probe.filter(hit).schema  # noqa: B018  resolves the plan now, so that one rule's fault stays its own
            by_source.setdefault(id(source), (source, []))[1].append((r, hit))
        except Exception as e:
            errors[r.title] = f"{type(e).__name__}: {e}"
    return union(case, [_findings(case, source, mine) for source, mine in by_source.values()]), errors
