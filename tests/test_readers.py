"""Readers of event logs, compressed and shell artifacts over files made here."""

import datetime as dt
import io
import json
import struct
import zipfile
import zlib

import pytest

from casewright.detect.detectors import run_detectors
from casewright.schema import Case
from casewright.sources import binary, ese, packed, shellitems
from casewright.sources.eventlog import chunk_rows, evtx_events
from casewright.sources.ingest import collect, write
from casewright.sources.samples import cache_10, cache_7, cache_8, cache_8_short, compound, counted, D, database, evtx, folder_item, FT, hive, huffman_all_literals, link, Log, logon, prefetch_file, SID, srudb, u, w


def test_event_log_records(spark):
    data = evtx([[(4625, "bob"), (4624, "eve & <co>")], [(1102, "kim")]])
    broken = data[:4096] + b"\0" * 65536 + data[4096 + 65536 :]  # the first chunk is lost
    df = spark.createDataFrame([("C:\\Logs\\Security.evtx", bytearray(data)), ("x/Broken.evtx", bytearray(broken)), ("x/Text.evtx", bytearray(b"no log")), ("x/Empty.evtx", bytearray())], "path string, content binary")
    rows = evtx_events(df, 3).orderBy("record_id", "channel").collect()
    assert [(r["record_id"], r["event_id"]) for r in rows] == [(1, 4625), (2, 4624), (3, 1102), (3, 1102)]
    r = rows[0]
    assert (r["channel"], r["computer"], r["provider"], r["user_sid"], r["timestamp"]) == ("Security", "PC-7", "Provider-A", "S-1-5-21-500", D + dt.timedelta(seconds=1))
    assert json.loads(rows[1]["message"]) == {"TargetUserName": "eve & <co>", "IpAddress": "203.0.113.9", "LogonType": "3"} and rows[1]["user_sid"] is None
    assert rows[1]["xml_raw"].startswith('<Event xmlns="http://events"><System>') and "eve &amp; &lt;co&gt;" in rows[1]["xml_raw"]


def test_a_damaged_record_loses_itself_only():
    log = Log()
    for n in range(1, 6):
        logon(log, n, 4624, "u")
    data = bytearray(log.done())
    at = data.index(struct.pack("<4sI", b"**\0\0", struct.unpack_from("<I", data, data.index(b"**\0\0", 600) + 4)[0]), 600)
    data[at + 24] = 0x0B
    data[at + 28] = 0x3F
    assert [r["record_id"] for r in chunk_rows(bytes(data))] == [1, 3, 4, 5]
    assert list(chunk_rows(b"")) == [] and list(chunk_rows(b"x" * 65536)) == []


def test_xpress_huffman():
    plain = bytes(range(256)) * 20 + b"end"
    assert packed.xpress_huffman(huffman_all_literals(plain), len(plain)) == plain
    # lengths of one bit for 'a' and for a match of length 3 + 7 at distance 1: "a" and nine copies more
    table = bytearray(256)
    table[ord("a") // 2] |= 1 << 4 * (ord("a") % 2)
    match = 256 + 7
    table[match // 2] |= 1 << 4 * (match % 2)
    assert packed.xpress_huffman(bytes(table) + struct.pack("<HH", 0b0100000000000000, 0), 11) == b"a" * 11
    with pytest.raises(ValueError):
        packed.xpress_huffman(bytes(256) + bytes(8), 5)
    with pytest.raises(ValueError):
        packed.xpress_huffman(b"", 5)


def test_lznt1():
    # two literals, then a match of four at distance two
    chunk = bytes([0b100]) + b"ab" + struct.pack("<H", (2 - 1) << 12 | 4 - 3)
    assert packed.lznt1(struct.pack("<H", 0x8000 | 0x3000 | len(chunk) - 1) + chunk + struct.pack("<H", 0x3000 | 2) + b"xyz" + b"\0\0") == b"ababab" + b"xyz"


def test_compressed_prefetch():
    plain = prefetch_file()
    whole = next(binary.prefetch(plain, "CALC.EXE-1.pf"))
    made = b"MAM\x04" + struct.pack("<I", len(plain)) + huffman_all_literals(plain)
    assert next(binary.prefetch(made, "CALC.EXE-1.pf")) == whole
    checked = b"MAM\x84" + struct.pack("<II", len(plain), zlib.crc32(plain)) + huffman_all_literals(plain)
    assert next(binary.prefetch(checked, "x.pf"))["run_count"] == 4 and whole["last_run"] == D


@pytest.mark.parametrize("made", [cache_10, cache_8, cache_8_short, cache_7])
def test_shimcache(made):
    entries = [("C:\\Temp\\x.exe", FT), ("C:\\Windows\\y.exe", 0)]
    key = "ControlSet001\\Control\\Session Manager\\AppCompatCache"
    data = hive({key: {"AppCompatCache": made(entries)}, key.replace("001", "002"): {"AppCompatCache": made(entries)}})
    got = list(shellitems.shimcache(data, "Windows/System32/config/SYSTEM"))
    assert [(r["path"], r["last_modified"], r["order_idx"]) for r in got] == [("C:\\Temp\\x.exe", D, 0), ("C:\\Windows\\y.exe", None, 1)]
    with pytest.raises(ValueError):
        list(shellitems.shimcache(b"nothing", "SYSTEM"))


def test_shellbags():
    root = "Software\\Microsoft\\Windows\\Shell\\BagMRU"
    my_computer = b"\x14\0\x1f\x50" + bytes.fromhex("e04fd020ea3a6910a2d808002b30309d")
    drive = b"\x19\0\x2fC:\\\0".ljust(25, b"\0")
    share = b"\0\0\xc3\x01\xc5\\\\srv\\share\0"
    data = hive({root: {"0": my_computer, "1": share, "MRUListEx": b"\xff" * 4}, f"{root}\\0": {"0": drive}, f"{root}\\0\\0": {"3": folder_item("LONGNA~1", "Long Name ü"), "4": b"\0\0\x31\0" + bytes(10) + b"plain\0"}})
    got = {r["path"]: r for r in shellitems.shellbags(data, "C/Users/ann/NTUSER.DAT")}
    assert set(got) == {"My Computer", "\\\\srv\\share", "My Computer\\C:\\", "My Computer\\C:\\Long Name ü", "My Computer\\C:\\plain"}
    assert {r["user"] for r in got.values()} == {"ann"} and {r["source"] for r in got.values()} == {"NTUSER"}
    assert [got[p]["item_type"] for p in ("My Computer", "\\\\srv\\share", "My Computer\\C:\\", "My Computer\\C:\\plain")] == ["virtual", "network", "drive", "folder"]
    assert got["My Computer\\C:\\"]["last_modified"] == D + dt.timedelta(seconds=6)


def test_jump_lists():
    def entry(number, path, count, pin):
        raw = bytearray(130)
        raw[72 : 72 + 4] = b"PC-1"
        struct.pack_into("<I", raw, 88, number)
        struct.pack_into("<qi", raw, 100, FT, pin)
        struct.pack_into("<I", raw, 116, count)
        struct.pack_into("<H", raw, 128, len(path))
        return bytes(raw) + u(path) + b"\0" * 4

    listed = struct.pack("<III", 4, 2, 1).ljust(32, b"\0") + entry(0x1A, "C:\\Users\\Public\\a.doc", 33, -1) + entry(2, "C:\\b.doc", 1, 0)
    data = compound({"1a": link("C:\\Users\\Public\\a.doc"), "DestList": listed, "7": link("C:\\only.txt")})
    got = {r["entry_id"]: r for r in shellitems.jumplists(data, "x/5da8f9b674986c19.automaticDestinations-ms")}
    assert {k: (r["target_path"], r["access_count"], r["pin_status"]) for k, r in got.items()} == {"1a": ("C:\\Users\\Public\\a.doc", 33, ""), "2": ("C:\\b.doc", 1, "pinned"), "7": ("C:\\only.txt", 0, "")}
    assert (got["1a"]["app_name"], got["1a"]["created"], got["1a"]["accessed"], got["2"]["created"]) == ("Microsoft Office Word", D, D, None)
    custom = b"\2\0\0\0" + bytes(20) + link("C:\\c.txt") + link("C:\\d.txt") + struct.pack("<I", 0xBABFFBAB)
    assert [r["target_path"] for r in shellitems.jumplists(custom, "x/ab.customDestinations-ms")] == ["C:\\c.txt", "C:\\d.txt"]
    with pytest.raises(ValueError):
        list(shellitems.jumplists(b"x", "x/ab.automaticDestinations-ms"))


def test_outlook_message():
    props = bytes(32) + struct.pack("<IIq", 0x00390040, 6, FT)
    data = compound({"__substg1.0_0037001F": u("Subject ü"), "__substg1.0_1000001F": u("body " * 1000), "__substg1.0_0C1A001F": u("Ann"), "__substg1.0_5D01001F": u("ann@x.example"), "__substg1.0_1035001F": u("<1@x>"), "__properties_version1.0": props, "__recip_version1.0_#00000000/__substg1.0_39FE001F": u("bob@x.example"), "__attach_version1.0_#00000000/__substg1.0_37010102": b"data"})
    m = next(shellitems.msg(data, "Inbox/a.msg"))
    assert (m["subject"], m["from_addr"], m["from_name"], m["to_addrs"], m["message_id"], m["sent_at"], m["has_attachments"], m["folder"]) == ("Subject ü", "ann@x.example", "Ann", "bob@x.example", "1@x", D, True, "Inbox")
    assert m["body_text"] == "body " * 1000


def test_folder_with_archive_to_findings(spark, tmp_path):
    """Files, some in an archive inside an archive, become tables; detectors find what they hold."""
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("C/Windows/System32/winevt/Logs/Security.evtx", evtx([[(4625, "bob")] * 5]))
        z.writestr("C/Users/ann/AppData/x.automaticDestinations-ms", b"damaged")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("C/Windows/System32/config/SYSTEM", hive({"ControlSet001\\Control\\Session Manager\\AppCompatCache": {"AppCompatCache": cache_10([("C:\\Temp\\x.exe", FT)])}}))
        z.writestr("readme.txt", b"no artifact")
    source, target = tmp_path / "in", tmp_path / "case"
    source.mkdir()
    (source / "triage.zip").write_bytes(outer.getvalue())
    (source / "CALC.EXE-1.pf").write_bytes(prefetch_file())
    (source / "broken.zip").write_bytes(b"PK\3\4nothing")
    case = collect(spark, str(source))
    found = {(r["source"], r["value"]) for r in run_detectors(case, ["brute_force", "shimcache_suspicious_path"]).collect()}
    assert found == {("detect:brute_force", "203.0.113.9"), ("detect:shimcache_suspicious_path", "C:\\Temp\\x.exe")}
    assert [r["filename"] for r in case["prefetch"].collect()] == ["CALC.EXE"]
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in case["source_files"].collect()}
    assert errors["x.automaticDestinations-ms"].startswith("ValueError") and errors["CALC.EXE-1.pf"] is None
    write(case.with_tables(**{n: case[n] for n in ("prefetch", "auth_events")}), str(target))
    assert Case(spark, str(target))["auth_events"].count() == 5


def test_resource_usage():
    data = srudb()
    net = list(ese.srum_network(data, "SRUDB.dat"))
    assert [(r["app_name"], r["user_name"], r["bytes_sent"], r["iface_luid"], r["timestamp"]) for r in net] == [("\\Device\\app.exe", "S-1-5-21-500", 1 << 40, 77, D + dt.timedelta(hours=6)), ("svc" * 1000, None, 1, None, D + dt.timedelta(hours=6))]
    p = next(ese.srum_programs(data, "SRUDB.dat"))
    assert (p["fg_cycles"], p["bg_cycles"], p["fg_context_switches"], p["bg_context_switches"], p["fg_bytes_read"], p["fg_bytes_written"]) == (9, 8, 7, 6, 5, 4)
    with pytest.raises(ValueError):
        next(ese.srum_network(b"x" * 700, "SRUDB.dat"))


def test_transfers():
    one, two, job = bytes(range(16)), bytes(range(16, 32)), bytes(range(32, 48))
    blob = bytes(16) + struct.pack("<iii", 0, 1, 6) + bytes(4) + job + counted("update") + counted("") + counted("") + counted("") + counted("S-1-5-18") + struct.pack("<I", 1) + one + struct.pack("<qq", FT, FT + 10_000_000)
    files = [{"Id": one, "Blob": counted("C:\\a.exe") + counted("http://x.test/a.exe") + counted("C:\\BIT1.tmp") + struct.pack("<QQ", 50, 200)}, {"Id": two, "Blob": b"?"}]
    columns = [(1, "guid", "Id"), (256, "blob", "Blob")]
    data = database({"Files": (columns, files, {}), "Jobs": (columns, [{"Id": job, "Blob": blob}], {})})
    j = next(ese.bits_jobs(data, "qmgr.db"))
    assert (j["job_name"], j["owner"], j["state_name"], j["priority"], j["created_at"], j["modified_at"]) == ("update", "S-1-5-18", "Transferred", 1, D, D + dt.timedelta(seconds=1))
    a, b = ese.bits_files(data, "qmgr.db")
    assert (a["remote_url"], a["local_path"], a["pct_complete"], a["job_guid"]) == ("http://x.test/a.exe", "C:\\a.exe", 25.0, j["job_guid"]) and b["job_guid"] is None and b.get("remote_url") is None


def test_directory_accounts():
    columns = [(256, "ltext", "ATTm590045"), (257, "ltext", "ATTm13"), (258, "blob", "ATTr589970"), (259, "i64", "ATTq589876"), (260, "i32", "ATTj589832")]
    sid = SID[:-4] + SID[:-5:-1]
    rows = [{"ATTm590045": u("ann"), "ATTm13": (2, bytes([2 << 3 | 6]) + int("".join(f"{ord(x):07b}" for x in reversed("clerk")), 2).to_bytes(5, "little")), "ATTr589970": sid, "ATTq589876": struct.pack("<q", FT), "ATTj589832": struct.pack("<i", 0x10202)}, {"ATTm590045": u("ANN")}, {"ATTm13": u("no account")}, {"ATTm590045": u("svc")}]
    got = list(ese.ntds_accounts(database({"datatable": (columns, rows, {})}), "ntds.dit"))
    assert [(r["sam_account_name"], r["object_sid"], r["last_logon"], r["is_disabled"], r["pwd_never_expires"]) for r in got] == [("ann", "S-1-5-21-500", D, True, True), ("svc", None, None, False, False)]
    assert got[0]["description"].startswith("clerk")


def test_plain_xpress():
    # three literals, then a match of nine at distance three
    assert ese.lz77(struct.pack("<I", 1 << 28) + b"abc" + struct.pack("<H", (3 - 1) << 3 | 6), 12) == b"abc" * 4


def test_file_table_in_splits_and_as_a_whole(spark, tmp_path):
    from casewright.sources.filetable import file_table, paths
    from casewright.sources.samples import file_table as made

    (tmp_path / "MFT").write_bytes(made())
    whole = {r["inode"]: r for r in binary.mft(made(), "$MFT")}
    split = {r["inode"]: r.asDict() for r in file_table(spark, str(tmp_path / "MFT")).collect()}
    assert whole[9]["path"] == "Users/ann/Downloads/setup program.exe" and whole[9]["ads_name"] == "Zone.Identifier" and whole[9]["size"] == 11
    assert (whole[13]["path"], whole[13]["size"], whole[13]["ads_name"]) == ("Users/ann/Downloads/long name.bin", 40, "extra") and 15 not in whole
    assert whole[10]["path"] == "lost.txt" and whole[14]["is_deleted"] and not whole[14]["is_dir"] and whole[8]["is_dir"] and whole[9]["created"] == D
    circle = {11, 12}
    assert split.keys() == whole.keys() and 5 in whole
    for n in split.keys() - circle:
        assert {k: split[n][k] for k in split[n]} == {k: whole[n].get(k) for k in split[n]}, n
    deep = spark.createDataFrame([(5, 5, ".")] + [(10 + i, 9 + i if i else 5, f"d{i}") for i in range(70)], "inode bigint, parent bigint, name string")
    assert {r["inode"]: r["path"] for r in paths(deep).collect()}[79] == "/".join(f"d{i}" for i in range(70))
