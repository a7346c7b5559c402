"""Queries of the general data-processing problems and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..operators.intervals import periods_and_gaps
from ..operators.loglines import log_entries
from ..operators.sessions import sessionize
from ..operators.timestamps import normalize_stamps

IDLE_US = 30 * 60 * 1_000_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of logon accounts and browser profiles."""
    auth = table(spark, sf_dir, "auth_events")
    user = F.lower(F.trim(auth["user"]))
    logons = auth.filter(~user.isin("", "-")).select(F.lit("auth").alias("src"), user.alias("entity"), auth["timestamp"].alias("at"))
    web = table(spark, sf_dir, "browser_history")
    profile = F.trim("profile")
    visits = web.filter(~profile.isin("", "-")).select(F.lit("browser").alias("src"), F.concat_ws("/", "browser", "profile").alias("entity"), F.col("visit_time").alias("at"))
    return sessionize(logons.unionByName(visits), ["src", "entity"], "at", IDLE_US).select("src", "entity", "start_us", "end_us")


P1_SQL = """
WITH ev AS (
  SELECT 'auth' AS src, lower(trim("user")) AS entity, epoch_us("timestamp") AS t FROM auth_events
  WHERE trim("user") NOT IN ('', '-') AND "timestamp" >= TIMESTAMP '2000-01-01'
  UNION ALL
  SELECT 'browser', concat_ws('/', browser, profile), epoch_us(visit_time) FROM browser_history
  WHERE trim(profile) NOT IN ('', '-') AND visit_time >= TIMESTAMP '2000-01-01'),
f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY src, entity ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM ev),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY src, entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS sess FROM f)
SELECT src, entity, min(t) AS start_us, max(t) AS end_us FROM n GROUP BY src, entity, sess
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of presence of each account and the gaps between them."""
    rows = table(spark, sf_dir, "linux_sessions").filter(F.trim("user") != "").withColumnRenamed("user", "user_key")
    return periods_and_gaps(rows, ["user_key"], "login_time", "logout_time")


P5_SQL = """
WITH iv AS (
  SELECT "user" AS user_key, epoch_us(login_time) AS a, epoch_us(logout_time) AS z FROM linux_sessions
  WHERE trim("user") <> '' AND login_time >= TIMESTAMP '2000-01-01' AND logout_time >= login_time),
f AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY user_key ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_key ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS i FROM f),
p AS (SELECT user_key, min(a) AS start_us, max(z) AS end_us FROM n GROUP BY user_key, i),
g AS (SELECT user_key, lag(end_us) OVER (PARTITION BY user_key ORDER BY start_us) AS start_us, start_us AS end_us FROM p)
SELECT 'period' AS kind, user_key, start_us, end_us FROM p
UNION ALL SELECT 'gap', user_key, start_us, end_us FROM g WHERE start_us IS NOT NULL
"""

def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name in ("anydesk_events", "linux_auth"):
        parts.append(log_entries(table(spark, sf_dir, name)).withColumn("src", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the remote-access traces and the authentication logs."""
    return _entries(spark, sf_dir).select("src", "first_rec_id", "n_lines", "stamp_text", "level_key", "component_key")


def p2_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries with their whole messages."""
    return _entries(spark, sf_dir).select("src", "first_rec_id", "message")


# The layouts of a head, told by plain regular expressions instead of a grammar.
_STAMP_SQL = r"(?:\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z| ?[+-]\d\d:?\d\d| [A-Z]{3,5}\b)?|\d\d[.]\d\d[.]\d{4} \d\d:\d\d:\d\d(?:[.,]\d+)?|[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d|[A-Z][a-z]{2} [A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d(?: [A-Z]{2,5})? \d{4}|\d{10}(?:[.]\d+)?|\d{13}|\d{16})"
_LEVEL_SQL = r"(?:[Dd]ebug|DEBUG|[Dd][Bb][Gg]|[Ii]nformation|INFORMATION|[Ii]nfo|INFO|INF|inf|[Ww]arning|WARNING|[Ww]arn|WARN|WRN|wrn|[Ee]rror|ERROR|ERR|err|[DIWE])"


def _p2_sql(columns: str) -> str:
    s, v = _STAMP_SQL, _LEVEL_SQL
    layouts = (  # pattern, group of stamp, of level, of component, of message
        (rf"^ *({v}) ({s}) +\d+ +\d+ +(\S+) - (.*)$", 2, 1, 3, 4),
        (rf"^\[({s})\] \[({v}) *\] \[([^\]]+)\] (.*)$", 1, 2, 3, 4),
        (rf"^({s}) ({v}) +\[\S+\] (\S+) - (.*)$", 1, 2, 3, 4),
        (rf"^({s}) \| (\S+) *\| ({v}) *\| (.*)$", 1, 3, 2, 4),
        (rf"^([DIWE])(\d{{4}} \d\d:\d\d:\d\d[.]\d+) \d+ ([^\]\s]+)\] (.*)$", 2, 1, 3, 4),
        (rf"^({s}) ({v}) ([^\s:]+): (.*)$", 1, 2, 3, 4),
        (rf"^\[({s})\] \S+ ([^\s/\[\]:]+)/({v}): (.*)$", 1, 3, 2, 4),
        (rf"^({s}) (?:\S+ )?([^\s\[\]:]+)(?:\[\d+\])?: (?:({v}): |<({v})> )?(.*)$", 1, 34, 2, 5),
    )
    pri = rf"^<(\d+)>1 ({s}) \S+ (\S+) (?:\d+|-) - - (.*)$"
    head = "^(?:[a-z]+=[^ ]* )*(?:ts|time)="
    arms: dict[str, list[str]] = {k: [] for k in ("stamp", "level", "comp", "msg")}
    for pattern, st, lv, co, ms in layouts:
        q = pattern.replace("'", "''")
        when = f"WHEN regexp_matches(m, '{q}') THEN "
        pick = lambda g: f"regexp_extract(m, '{q}', {g})"
        arms["stamp"].append(when + pick(st))
        arms["level"].append(when + (pick(lv) if lv < 10 else f"{pick(3)} || {pick(4)}"))
        arms["comp"].append(when + pick(co))
        arms["msg"].append(when + pick(ms))
    when = f"WHEN regexp_matches(m, '{pri}') THEN "
    arms["stamp"].append(when + f"regexp_extract(m, '{pri}', 2)")
    arms["level"].append(when + f"CASE WHEN CAST(regexp_extract(m, '{pri}', 1) AS INT) % 8 <= 3 THEN 'error' WHEN CAST(regexp_extract(m, '{pri}', 1) AS INT) % 8 = 4 THEN 'warn' WHEN CAST(regexp_extract(m, '{pri}', 1) AS INT) % 8 = 7 THEN 'debug' ELSE 'info' END")
    arms["comp"].append(when + f"regexp_extract(m, '{pri}', 3)")
    arms["msg"].append(when + f"regexp_extract(m, '{pri}', 4)")

    def logfmt(names: str) -> str:
        p = rf'(?:^| )(?:{names})=(?:"((?:[^"\\]|\\.)*)"|([^ "]+))'
        return f"regexp_extract(m, '{p}', 1) || regexp_extract(m, '{p}', 2)"

    def js(*names: str) -> str:
        return "coalesce(" + ", ".join(f"json_extract_string(j, '$.{n}')" for n in names) + ", '')"

    for key, lf, names in (("stamp", "ts|time", ("ts", "time")), ("level", "level|lvl|severity", ("level", "lvl", "severity")), ("comp", "component|prog|mod|unit", ("component", "prog", "mod", "unit")), ("msg", "msg|message|text", ("msg", "message", "text"))):
        arms[key].insert(0, f"WHEN regexp_matches(m, '{head}') THEN {logfmt(lf)}")
        # a line of an indented dump is valid JSON on its own but has no stamp
        arms[key].insert(0, f"WHEN {js('ts', 'time')} <> '' THEN {js(*names)}")
    parts = ", ".join(f"CASE {' '.join(a)} ELSE '' END AS {k}" for k, a in arms.items())
    one = "SELECT '{t}' AS src, source_file AS f, line_no AS n, min(rec_id) AS rec, coalesce(arg_min(message, rec_id), '') AS m FROM {t} WHERE source_file IS NOT NULL AND line_no IS NOT NULL GROUP BY 2, 3"
    return f"""
WITH lines AS ({one.format(t='anydesk_events')} UNION ALL {one.format(t='linux_auth')}),
told AS (SELECT src, f, n, rec, m, {parts} FROM (SELECT *, CASE WHEN m LIKE '{{%}}' AND json_valid(m) THEN m END AS j FROM lines)),
owned AS (SELECT *, max(CASE WHEN stamp <> '' THEN n END) OVER (PARTITION BY src, f ORDER BY n) AS own FROM told)
SELECT src, max(CASE WHEN n = own THEN rec END) AS first_rec_id, {columns} FROM owned WHERE own IS NOT NULL GROUP BY src, f, own
"""


P2_SQL = _p2_sql("""CAST(count(*) AS INTEGER) AS n_lines, max(CASE WHEN n = own THEN stamp END) AS stamp_text, max(CASE WHEN n = own THEN comp END) AS component_key,
 max(CASE WHEN n = own THEN CASE WHEN level IN ('debug', 'info', 'warn', 'error') THEN level WHEN level = '' THEN '' WHEN lower(level[1]) = 'd' THEN 'debug' WHEN lower(level[1]) = 'i' THEN 'info' WHEN lower(level[1]) = 'w' THEN 'warn' ELSE 'error' END END) AS level_key""")
P2_MESSAGES_SQL = _p2_sql("string_agg(CASE WHEN n = own THEN msg ELSE m END, chr(10) ORDER BY n) AS message")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stamp as one UTC instant."""
    hosts = table(spark, sf_dir, "hosts")
    tables = (("anydesk_sessions", "host", None), ("evtx_events", "computer", None), ("shell_history", "host", None), ("linux_auth", "host", "collected_at"))
    parts = []
    for name, source, until in tables:
        cut = F.col(until) if until else F.lit(None).cast("timestamp_ntz")
        parts.append(table(spark, sf_dir, name).select(F.lit(name).alias("src"), "rec_id", "timestamp", F.col(source).alias("host"), cut.alias("collected_at")))
    rows = reduce(DataFrame.unionByName, parts)
    return normalize_stamps(rows, "timestamp", "host", hosts, "collected_at").filter("utc_us IS NOT NULL").select("src", "rec_id", "utc_us")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_messages": p2_messages, "p4_found": p4_found, "p5_found": p5_found}
ORACLE = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_messages": P2_MESSAGES_SQL, "p5_found": P5_SQL}
