import datetime as dt
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from casewright.detect.detectors import run_detectors
from casewright.detect.enrich import enriched
from casewright.plans import export, library, timeline
from casewright.plans.chain import asked, chain
from casewright.schema import TABLES, Case
from casewright.sources import binary, text
from casewright.sources.router import channel_of, files, readers, user_of

D = dt.datetime(2024, 1, 1)
FT = (1_704_067_200_000_000 + 11_644_473_600_000_000) * 10


def lines(spark, path, body):
    return text.lines_of(spark.createDataFrame([(path, bytearray(body.encode()))], "path string, content binary"))


def test_routes(spark):
    want = {"x/Security.evtx": ["evtx"], "C:\\$MFT": ["mft"], "u/Recent/foo.lnk": ["lnk"], "unknown.bin": [], "readme.txt": [], "W/System32/config/SYSTEM": ["hive", "shimcache"], "home/bob/.bash_history": ["shell_history"], "a/$IABC123.txt": ["recycle_bin"]}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r[0]: r[1] for r in df.select("p", readers(F.col("p"))).collect()} == want
    r = df.limit(1).select(user_of(F.lit("C:\\Users\\bob\\x")).alias("u"), channel_of(F.lit("a/Microsoft-Windows-Sysmon%4Operational.evtx")).alias("c"), channel_of(F.lit("Security.evtx"), False).alias("d")).first()
    assert (r["u"], r["c"], r["d"]) == ("bob", "Microsoft-Windows-Sysmon/Operational", "Security")


def test_text_readers(spark):
    log = "Jan  5 10:00:00 h sshd[12]: Accepted password for root from 1.2.3.4 port 5 ssh2\nJan  5 10:00:01 h sshd[12]: Failed password for invalid user x from 5.6.7.8 port 9 ssh2\nJan  5 10:00:02 h kernel: nothing\n2024-01-05T10:00:03Z h sudo[7]: bob : TTY=pts/1 ; COMMAND=/bin/ls\n"
    rows = text.auth_log(lines(spark, "auth.log", log), 2024).orderBy("line_no").collect()
    assert [(r["event_type"], r["user"], r["src_ip"]) for r in rows] == [("ssh_login_success", "root", "1.2.3.4"), ("ssh_invalid_user", "x", "5.6.7.8"), ("sudo", "bob", None)]
    assert rows[0]["timestamp"] == dt.datetime(2024, 1, 5, 10)
    h = {r["command"]: r["timestamp"] for r in text.shell_history(lines(spark, "home/bob/.bash_history", "#1704067200\nls -l\nid\n: 1704067201:0;pwd\n")).collect()}
    assert h == {"ls -l": D, "id": None, "pwd": D + dt.timedelta(seconds=1)}
    c = text.crontab(lines(spark, "/etc/crontab", "# c\nPATH=/bin\n*/5 * * * * root /bin/x -a b\n@reboot root /bin/y\n")).collect()
    assert {(r["user"], r["command"]) for r in c} == {("root", "/bin/x -a b"), ("root", "/bin/y")}
    p = text.passwd(lines(spark, "/etc/passwd", "root:x:0:0:r:/root:/bin/bash\nd:x:1:1::/:/usr/sbin/nologin\nbroken\n")).collect()
    assert {(r["user"], r["enabled"]) for r in p} == {("root", True), ("d", False)}
    assert text.authorized_keys(lines(spark, "home/a/.ssh/authorized_keys", "ssh-rsa " + "A" * 90 + " me@x\n")).first()["user"] == "a"
    assert text.sudoers(lines(spark, "/etc/sudoers", "Defaults x\nbob ALL=(ALL) NOPASSWD: ALL\n")).first()["details"] == "NOPASSWD"
    s = text.anydesk_sessions(lines(spark, "t", "Incoming    2024-01-01, 10:00    User    alias    123\nOutgoing  2024-01-01, 10:00  Passwd  99\nnoise\n")).collect()
    assert {(r["client_alias"], r["anydesk_id"]) for r in s} == {("alias", "123"), (None, "99")}
    w = text.wer(lines(spark, "r.wer", f"EventTime={FT}\nSig[0].Value=a.exe\nSig[6].Value=c0000005\nAppPath=C:\\a.exe\n")).first()
    assert (w["app_name"], w["exception_code"], w["crash_time"]) == ("a.exe", "c0000005", D)


def usn(name, reason):
    raw = name.encode("utf-16-le")
    size = (60 + len(raw) + 7) // 8 * 8
    return (struct.pack("<IHHQQqqIIIIHH", size, 2, 0, 1, 2, 77, FT, reason, 0, 0, 32, len(raw), 60) + raw).ljust(size, b"\0")


def utmp(kind, user, line, host, sec):
    rec = bytearray(384)
    struct.pack_into("<hxxi", rec, 0, kind, 9)
    for at, v in ((8, line), (44, user), (76, host)):
        rec[at : at + len(v)] = v.encode()
    struct.pack_into("<ii", rec, 340, sec, 0)
    return bytes(rec)


def hive():
    """A root key with one subkey Run and one value."""
    cells, base = bytearray(b"hbin" + b"\0" * 28), {}

    def put(name, body):
        body += b"\0" * (-(len(body) + 4) % 8)
        base[name] = len(cells)
        cells.extend(struct.pack("<i", -(len(body) + 4)) + body)
        return base[name]

    data = put("data", "calc.exe\0".encode("utf-16-le"))
    vk = put("vk", b"vk" + struct.pack("<HIIIHH", 4, 18, data, 1, 1, 0) + b"Calc")
    vals = put("vals", struct.pack("<I", vk))

    def nk(name, subs, n_sub, n_val, values, flags=0x20):
        head = b"nk" + struct.pack("<Hq", flags, FT) + struct.pack("<II", 0, 0) + struct.pack("<III", n_sub, 0, subs) + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<II", n_val, values)
        return head.ljust(72, b"\0") + struct.pack("<HH", len(name), 0) + name

    sub = put("sub", nk(b"Run", 0xFFFFFFFF, 0, 1, vals))
    lst = put("list", b"lf" + struct.pack("<HI4s", 1, sub, b"Run\0"))
    root = put("root", nk(b"ROOT", lst, 1, 0, 0xFFFFFFFF, 0x2C))
    return b"regf".ljust(36, b"\0") + struct.pack("<I", root).ljust(4096 - 36, b"\0") + bytes(cells)


def test_binary_readers(spark, tmp_path):
    (tmp_path / "home").mkdir()
    (tmp_path / "$J").write_bytes(b"\0" * 8192 + usn("a.txt", 0x100 | 0x80000000) + b"\xff" * 16 + usn("b.txt", 0x200))
    (tmp_path / "$IABC123.exe").write_bytes(struct.pack("<qqqi", 2, 5, FT, 9) + "C:\\x.exe\0".encode("utf-16-le"))
    (tmp_path / "wtmp").write_bytes(utmp(2, "reboot", "~", "", 1) + utmp(7, "bob", "tty1", "10.0.0.1", 100) + utmp(8, "", "tty1", "", 200) + utmp(7, "eve", "tty2", "", 300) + utmp(7, "eve", "tty3", "", 310) + utmp(7, "kim", "tty3", "", 320))
    (tmp_path / "NTUSER.DAT").write_bytes(hive())
    (tmp_path / "a.eml").write_bytes(b"From: Bob <b@x.example>\r\nTo: a@x.example\r\nSubject: Hi\r\nMessage-ID: <1@x>\r\nDate: Mon, 1 Jan 2024 01:00:00 +0100\r\n\r\nbody\r\n")
    (tmp_path / "mbox").write_bytes(b"From a\nSubject: one\n\nx\n>From y\n\nFrom b\nSubject: two\n\nz\n")
    (tmp_path / "bad.lnk").write_bytes(b"nothing")
    db = tmp_path / "History"
    con = sqlite3.connect(db)
    con.executescript("CREATE TABLE urls(id, url, title, visit_count); CREATE TABLE visits(url, visit_time); INSERT INTO urls VALUES (1, 'http://x.example/', 't', 3);")
    con.execute("INSERT INTO visits VALUES (1, ?)", (1_704_067_200_000_000 + 11_644_473_600_000_000,))
    con.commit()
    con.close()
    fs = files(spark, str(tmp_path)).cache()
    got = {r["path"]: (r["reason"], r["timestamp"]) for r in binary.decode(fs, "usnjrnl").collect()}
    assert got == {"a.txt": ("FILE_CREATE|CLOSE", D), "b.txt": ("FILE_DELETE", D)}
    r = binary.decode(fs, "recycle_bin").first()
    assert (r["original_path"], r["size"], r["deleted_at"], r["r_file"]) == ("C:\\x.exe", 5, D, "$RABC123.exe")
    s = {(r["user"], r["terminal"], r["logout_time"] is None) for r in binary.linux_sessions(binary.decode(fs, "wtmp")).collect()}
    assert s == {("SYSTEM", "~", True), ("bob", "tty1", False), ("eve", "tty2", True), ("eve", "tty3", True), ("kim", "tty3", True)}
    v = binary.decode(fs, "hive").first()
    assert (v["key_path"], v["value_name"], v["value_data"], v["modified"]) == ("Run", "Calc", "calc.exe", D)
    assert [m["subject"] for m in binary.decode(fs, "mbox").orderBy("subject").collect()] == ["one", "two"]
    m = binary.decode(fs, "eml").first()
    assert (m["from_addr"], m["sent_at"], m["message_id"], m["body_text"].strip()) == ("b@x.example", D, "1@x", "body")
    b = binary.decode(fs, "browser").first()
    assert (b["url"], b["visit_time"], b["visit_count"]) == ("http://x.example/", D, 3)
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in binary.source_files(fs).collect()}
    assert errors["bad.lnk"].startswith("ValueError") and errors["a.eml"] is None
    assert binary.decode(fs, "lnk").count() == 0


def frame(spark, table, rows):
    names = [c.split(" ")[0] for c in TABLES[table].split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table])


def test_enrichment(spark):
    iface = "SYSTEM\\Services\\Tcpip\\Parameters\\Interfaces\\{AB}"
    un = "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Uninstall\\"
    reg = [{"key_path": iface, "value_name": n, "value_data": v} for n, v in (("DhcpIPAddress", "10.0.0.5"), ("DhcpNameServer", "8.8.8.8"), ("EnableDHCP", "1"))] + [{"key_path": "SYSTEM\\Services\\Tcpip\\Parameters\\Interfaces\\{CD}", "value_name": "EnableDHCP", "value_data": "1"}] + [{"key_path": un + k, "value_name": "DisplayName", "value_data": k} for k in ("A", "B")]
    case = enriched(Case(spark, None, {"registry_raw": frame(spark, "registry_raw", reg), "prefetch": frame(spark, "prefetch", [{"filename": "A.EXE"}, {"filename": "B.EXE", "first_seen": D}]), "mft": frame(spark, "mft", [{"path": "Windows/Prefetch/A.EXE-1F.pf", "created": D}])}))
    assert [(r["ip_address"], r["dns_servers"]) for r in case["network_adapters"].collect()] == [("10.0.0.5", "8.8.8.8")]
    assert sorted(r["display_name"] for r in case["installed_software"].collect()) == ["A", "B"]
    assert {r["filename"]: r["first_seen"] for r in case["prefetch"].collect()} == {"A.EXE": D, "B.EXE": D}


def test_export_report_and_free_sql(spark, tmp_path):
    rows = [{"event_id": 4625, "src_ip": "203.0.113.9", "user": "bob", "timestamp": D}] * 5
    case = Case(spark, None, {"auth_events": frame(spark, "auth_events", rows)})
    assert export.export_all(case, str(tmp_path / "out"), "csv") == ["auth_events", "timeline"]
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "auth_events"))
    assert back.count() == 5 and back.first()["timestamp"] == "2024-01-01 00:00:00"
    export.write(case["auth_events"], str(tmp_path / "j"), "jsonl")
    assert "2024-01-01T00:00:00Z" in spark.read.text(str(tmp_path / "j")).first()[0]
    found = run_detectors(case, ["brute_force"])
    page = export.html_report(case, found, "<t>")
    assert "203.0.113.9" in page and "&lt;t&gt;" in page and "ELEVATED" in export.context_text(case, found)
    assert timeline.event_context(case, "2024-01-01 00:01:00", 60).count() == 5
    assert timeline.correlate(case, "bob").first()["n_rows"] == 5
    case.register()
    assert library.free_query(spark, "SELECT count(*) AS n FROM auth_events -- x").first()["n"] == 5
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x SELECT 1", "with x as (select 1) insert into y select * from x"):
        with pytest.raises(Exception):
            library.free_query(spark, bad)


def test_live_bursts(spark, tmp_path):
    from casewright.streaming.live import failed_logons

    src = tmp_path / "in"
    spark.createDataFrame([(4625, "1.2.3.4", D + dt.timedelta(seconds=i)) for i in range(6)] + [(4625, "5.6.7.8", D)], "event_id int, src_ip string, timestamp timestamp").write.parquet(str(src))
    stream = failed_logons(spark.readStream.schema("event_id int, src_ip string, timestamp timestamp").parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["value"] for r in spark.table("bursts").collect()] == ["1.2.3.4"]


def test_terms_of_chains():
    assert asked("svchost.exe (PID 884) @ 0xE9") == ("svchost.exe", "svchost.exe", 884)
    assert asked(" C:\\Temp\\A.exe ") == ("C:\\Temp\\A.exe", "a.exe", None) and asked("C:UsersIEUserDownloadsFirefox.exe")[1] == "firefox.exe"
    assert asked("a (PID x)") == ("a (PID x)", "a (pid x)", None)


def test_every_section_builds(spark):
    case = Case(spark, None, {"case_notes": frame(spark, "case_notes", [{"id": 1, "ref_type": "triage", "ref_id": "detect:x", "note": "benign"}]), "mem_pslist": frame(spark, "mem_pslist", [{"pid": 1, "name": "A.exe"}]), "shimcache": frame(spark, "shimcache", [{"path": "C:\\t\\a.EXE"}]), "ps_scriptblock": frame(spark, "ps_scriptblock", [{"timestamp": D, "script_text": "IEX x", "path": "C:\\s\\Run.ps1"}]), "mem_cmdline": frame(spark, "mem_cmdline", [{"pid": 1, "cmdline": "powershell -f \"D:\\run.ps1\""}])})
    found = spark.createDataFrame([("process", "IEX x", "detect:x", "HIGH", None, D, "n"), ("ip", "1.1.1.1", "manual:list", "LOW", None, D, "n")], "type string, value string, source string, confidence string, related_campaign string, first_seen timestamp, notes string")
    built = {name: build().collect() for name, build in export.sections(case, found).items()}
    assert len(built) >= 37 and [(r["triage"], r["value"]) for r in built["Threat findings"]] == [("benign", "IEX x")]
    assert [(r["name"], r["cached_path"]) for r in built["Process traces"]] == [("A.exe", "C:\\t\\a.EXE")]
    assert [(r["reported_by"], r["n_processes"]) for r in built["Scripts with evidence"]] == [("detect:x", 1)]
