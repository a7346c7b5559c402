import re

import pytest

from casewright.detect.indicators import TARGETS, extract_case, extract_from
from casewright.schema import TABLES, Case

# Endings of the reference that the test tables lack.
ENDINGS = "gov mil edu us ca jp br au me cc app dev cloud online site pro ch it es nl kr tech in pl se no fi dk be at pt cz hu gr ro bg tr ua kz sa ae il ir eg ma ng ke th ph id my sg hk tw".split()


def found(spark, *texts, name="x.t"):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {(r["type"], r["value"]) for r in extract_from([(name, df, "t")]).collect()}


def test_domains(spark):
    got = found(spark, " ".join(f"bad-host.{e}" for e in ENDINGS), "a.live.com b.apple.com c.digicert.com", "www.github.com x.msftncsi.com ocsp.digicert.com ns.adobe.com crl.microsoft.com")
    assert {v for t, v in got if t == "domain"} == {f"bad-host.{e}" for e in ENDINGS} | {"a.live.com", "b.apple.com", "c.digicert.com"}


def test_paths(spark):
    keep = ["/Users/bob/Downloads/tool", "/ProgramData/x/run.ps1", "/Windows/Tasks/a.job", "/Windows/debug/wia", "C:\\Users\\u\\AppData\\noending", "D:\\Windows\\Tasks\\j", "C:\\PerfLogs\\x"]
    got = found(spark, *keep, "/Users/bob/notes.txt and /Windows/System32/cmd.exe", "C:\\Windows\\notepad.exe")
    assert {v for t, v in got if t == "path"} == set(keep)


def test_other_kinds(spark):
    key, blob = "HKPD\\Soft\\Run", "A" * 44
    got = found(spark, f"{key}\\. 255.255.255.0 008.08.8.8 0.9.8.7 10.1.1.1 enc={blob}", name="t.cmdline")
    assert {("regkey", key), ("ip", "008.08.8.8"), ("ip", "0.9.8.7"), ("base64", blob)} == got


@pytest.mark.parametrize("table, column", [("anydesk_sessions", "client_alias"), ("anydesk_sessions", "anydesk_id"), ("wer_crashes", "app_name"), ("wer_crashes", "app_path"), ("wer_crashes", "fault_module"), ("srum_network_usage", "app_name"), ("srum_app_usage", "app_name"), ("bits_jobs", "job_name"), ("rdp_client_history", "server"), ("opensave_mru", "path")])
def test_targets(table, column):
    assert (table, column) in TARGETS and re.search(rf"\b{column} ", TABLES[table])


def test_case(spark):
    case = Case(spark, None, {"rdp_client_history": spark.createDataFrame([("jump.evil.cloud",)], "server string"), "mft": spark.createDataFrame([("/Users/b/Downloads/a",)], "path string")})
    assert {(r["type"], r["value"], r["source"]) for r in extract_case(case).collect()} == {("domain", "jump.evil.cloud", "rdp_client_history.server"), ("path", "/Users/b/Downloads/a", "mft.path")}
