from datetime import datetime

from casewright.llm.newtext import new_lines

D = datetime(2024, 1, 1)
PARENT = "Hello all,\n\nThe dump is ready on the share.\nPlease check the second host.\n\nCheers, Noam\n________________\nNoam Karnholt - Network Engineer"
MAILS = {
    # kept lines (numbers) of each body
    1: (PARENT, None, "<p>", "Noam Karnholt", [1, 3, 4]),
    2: ("Hi Noam,\r\nDone, see below.\r\n\r\nBest,\r\nKai\r\n\r\nOn Mon, 5 Jan 2015 at 10:00, Noam Karnholt <n@x.example> wrote:\r\n> Hello all,\r\n>\r\n> The dump is ready on the share.\r\nWhich share?\r\n> Please check the second host.\r\n", "<p>", "<a>", "Kai Oldmere", [1, 2]),
    3: ("Thanks.\n\n-----Original Message-----\nFrom: Noam Karnholt <n@x.example>\nSent: Mon, 05.01.2015 10:00\nTo: k@x.example\nSubject: Dump\n\nHello all,\nThe dump is ready on the share.", "<p>", "<b>", "Kai Oldmere", []),
    4: ("I looked at it twice.\n\nHello all,\n\nThe dump is ready on the share.\nPlease check the second host.\n", "<p>", "<c>", "Kai Oldmere", [1]),
    5: ("> Get-Process\n> Stop-Service x\nFrom: the second host we got 14 logons.\nRegards to the team by the way, all fine.\n-- host a1: open", None, "<d>", "Kai Oldmere", [1, 2, 3, 4, 5]),
    6: ("On Jan 14, 2015, at 09:18 AM, Noam Karnholt\n<n@x.example> wrote:\n> Hello all,\n\nNew text below.\n\nSent from my Fieldphone\n\nDiese Nachricht ist vertraulich. Wer sie irrtümlich erhält, möge sie löschen.", "<zzz>", "<e>", "Kai Oldmere", [5]),
    7: ("", None, "<f>", None, []),
    8: (None, None, None, None, []),
    9: ("\n \n", "<p>", None, None, []),
}


def test_lines(spark):
    rows = [(i, b, par, msg, "Kai@x.example" if name else None, name, D) for i, (b, par, msg, name, _) in MAILS.items()]
    df = spark.createDataFrame(rows, "id bigint, body_text string, in_reply_to string, message_id string, from_addr string, from_name string, sent_at timestamp").selectExpr("*", "1 AS _line", "2 AS mail_id2")
    got: dict[int, list[int]] = {}
    for r in new_lines(df).collect():
        got.setdefault(r["mail_id"], []).append(r["line_no"])
    got = {k: sorted(v) for k, v in got.items()}
    want = {i: m[4] for i, m in MAILS.items() if m[4]}
    want[2] = [1, 2, 11]  # the answer among the quoted lines, below the closing block
    want[3] = []
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert new_lines(df.limit(0)).count() == 0


def test_recurrent_endings(spark):
    tail = "\n\nNorth desk, room 12"
    rows = [(i, f"Note {i} about the case.{tail}", None, f"<{i}>", "s@x.example", "Kai", D) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, body_text string, in_reply_to string, message_id string, from_addr string, from_name string, sent_at timestamp")
    assert {(r["mail_id"], r["line_no"]) for r in new_lines(df).collect()} == {(i, 1) for i in range(5)}
