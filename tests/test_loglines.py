import random
import re

from casewright.functions.earley import Grammar
from casewright.operators.loglines import grammar, log_entries, parse_line

HEADS = [
    ("    info 2015-01-05 00:18:40.982     8728   8736   clip.sync - Token refresh", "2015-01-05 00:18:40.982", "info", "clip.sync", "Token refresh"),
    ("[2015-01-10T00:34:26.114Z] [DBG  ] [link.relay] Update check: error", "2015-01-10T00:34:26.114Z", "debug", "link.relay", "Update check: error"),
    ("I0112 10:40:39.848417 4364 fiber] warning threshold", "0112 10:40:39.848417", "info", "fiber", "warning threshold"),
    ("12.01.2015 10:29:19,053 Warning app.session: Screen size", "12.01.2015 10:29:19,053", "warn", "app.session", "Screen size"),
    ("12.01.2015 10:39:24,444 fiber: Feature list", "12.01.2015 10:39:24,444", "", "fiber", "Feature list"),
    ("2015-01-06 12:41:20,828 INFO  [worker-4] capture.gdi - Client", "2015-01-06 12:41:20,828", "info", "capture.gdi", "Client"),
    ("2015/01/05 00:41:36 | ui.tray      | err | Token", "2015/01/05 00:41:36", "error", "ui.tray", "Token"),
    ('ts=2015-01-07T22:14:35Z level=info component=link.relay pid=2976 msg="level=error in text"', "2015-01-07T22:14:35Z", "info", "link.relay", "level=error in text"),
    ('{"msg": "a \\"level\\": \\"error\\"", "mod": "updater", "lvl": "W", "ts": "1421208363309"}', "1421208363309", "warn", "updater", 'a "level": "error"'),
    ("2019-02-11 07:34:33 UTC old-node10 sshd[13623]: error: kex exchange", "2019-02-11 07:34:33 UTC", "error", "sshd", "kex exchange"),
    ("<84>1 2021-11-09T20:24:05+0545 ktm-node201 sshd 10533 - - Failed", "2021-11-09T20:24:05+0545", "warn", "sshd", "Failed"),
    ("[2020-07-23T16:14:41.012425+01:00] lon-node105 sshd/INFO: Received", "2020-07-23T16:14:41.012425+01:00", "info", "sshd", "Received"),
    ('time="2020-06-12 22:17:21 +02:00" host=ber prog=sshd lvl=INF text="x"', "2020-06-12 22:17:21 +02:00", "info", "sshd", "x"),
    ("Apr  5 10:09:24 phx-node197 CRON[3691]: pam", "Apr  5 10:09:24", "", "CRON", "pam"),
    ("[2020-07-23T16:13:13.107Z] lon-node105 sshd/INFO: error: kex", "2020-07-23T16:13:13.107Z", "info", "sshd", "error: kex"),
    ("Apr  5 10:09:24 phx-node197 ledgerd[9]: <WRN> queue: deep", "Apr  5 10:09:24", "warn", "ledgerd", "queue: deep"),
    ("Apr  5 10:09:24 phx-node197 ledgerd[9]: depth: 4", "Apr  5 10:09:24", "", "ledgerd", "depth: 4"),
    ('ts=2015-01-07T22:14:35Z level=info unit=a code=5', "2015-01-07T22:14:35Z", "info", "a", "ts=2015-01-07T22:14:35Z level=info unit=a code=5"),
    ('time="2020-06-12 22:17:21" prog=sshd msg="say \\"hi\\" twice"', "2020-06-12 22:17:21", "", "sshd", 'say "hi" twice'),
    ("1552192015.881 stj-node195 sudo[25381]: pam", "1552192015.881", "", "sudo", "pam"),
]
REST = ["| 2019-07-11 20:28:17.073 warn remote: quoted", "  > Peer left", "\tat worker.Step0(91)", "{", '  "level": "error"', "}", "", "0000: a8 ba 9a", "Caused by: x", None, "the peer gave no reason", "x" * 50_000, '{"attempt": 5}']


def test_heads_and_continuations():
    for line, stamp, level, comp, message in HEADS:
        assert parse_line(line) == (True, stamp, level, comp, message, False)
    assert not any(parse_line(x)[0] for x in REST)
    assert parse_line("the peer gave no reason")[5]  # exposed as unparsed
    assert [parse_line(x)[4] for x in REST if x] == [x for x in REST if x]


def test_lines_that_differ_in_digits_share_a_parse():
    known = {}
    for line, *_ in HEADS:
        for digit in "379":
            other = line.translate({ord(d): digit for d in "0123456789"})
            assert parse_line(other, known)[0] == parse_line(other)[0] and parse_line(other, known)[1:] == parse_line(other)[1:]
    assert len(known) == len(HEADS)


def test_first_characters_hide_no_match():
    g = grammar()
    for line, *_ in HEADS:
        for at in range(len(line)):
            for name, pattern in g.terminals.items():
                assert g.can_begin(name, line[at]) or not re.compile(pattern, re.S).match(line + "\0", at)


def test_whole_messages(spark):
    rows = [(1, "f", 1, HEADS[7][0]), (2, "f", 2, "\tat a.B"), (3, "f", 3, None), (4, "f", 4, "  end"), (5, "f", 5, HEADS[0][0]), (6, "f", 2, "later copy")]
    df = spark.createDataFrame(rows, "rec_id bigint, source_file string, line_no int, message string")
    got = {x["first_rec_id"]: (x["message"], x["n_lines"]) for x in log_entries(df, block_lines=2).collect()}
    assert got == {1: ("level=error in text\n\tat a.B\n\n  end", 4), 5: ("Token refresh", 1)}


def test_entries_across_blocks(spark):
    r = random.Random(3)
    rows, want, rec = [], {}, 1000
    for f in ("a.log", "b.log"):
        head = None
        for n in range(1, 61):
            text = r.choice(HEADS)[0] if n > 3 and r.random() < 0.2 else r.choice(REST[:-2])
            rec += 1
            rows.append((rec, f, n, text))
            if parse_line(text)[0]:
                head = (f, n, rec)
                want[head] = 0
            if head:
                want[head] += 1
    rows += [(rec + 1, *rows[5][1:]), (rec + 2, None, 4, "x"), (rec + 3, "a.log", None, HEADS[0][0])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "rec_id bigint, source_file string, line_no int, message string").selectExpr("*", "1 AS _line")
    out = log_entries(df, block_lines=7)
    assert {(x["source_file"], x["first_line"], x["first_rec_id"]): x["n_lines"] for x in out.collect()} == want
    assert log_entries(df.limit(0)).count() == 0


def test_best_weight_wins():
    g = Grammar("S", {"S": [(0.4, "x:A B"), (0.6, "y:B A"), (0.1, "A")]}, {"A": "a+|b", "B": "b|a"})
    assert [n for n, *_ in g.parse("ba")[1]] == ["y"]
    assert g.parse("zz") is None
