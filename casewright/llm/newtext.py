"""Only the text its sender newly wrote: mails without quotes, signatures and notices.

Bodies are exploded to lines. Marked quotes, blocks under a mail header and
their introducing lines are told by the lines themselves. Quotes without any
mark are told by the thread: line pairs of a message and its replies are ranked
by date in a SQL window, and only the first-authored occurrence is kept. The
closing block is told by its formulas and by what a sender's mails end with
again and again, counted in a window over (sender, line).

Bodies are shuffled once, by mail, before they are exploded: what a line has to
know of its neighbours is a window inside its mail. Occurrences of (thread,
line pair) and of (sender, line) are combined on the map side and joined back,
so a hot thread, sender or line is no single task's group.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import cut_lineage

# Closing formulas as mails of four languages write them.
FORMULAS = (
    "best", "all the best", "best regards", "best wishes", "kind regards", "warm regards", "warmest regards", "regards", "cheers", "thanks", "thanks and regards",
    "thank you", "many thanks", "many thanks and best wishes", "with best regards", "with kind regards", "yours", "yours sincerely", "yours faithfully", "yours truly", "sincerely", "sincerely yours", "respectfully", "br", "rgds", "kr", "take care",
    "mit freundlichen grüßen", "mit freundlichen grüssen", "mit besten grüßen", "mit freundlichem gruß", "freundliche grüße", "viele grüße", "viele grüsse", "beste grüße", "liebe grüße", "schöne grüße", "herzliche grüße", "gruß", "grüße", "lg", "vg", "mfg", "hochachtungsvoll", "danke und gruß", "vielen dank",
    "cordialement", "bien cordialement", "très cordialement", "bien à vous", "salutations", "meilleures salutations", "sincères salutations", "amicalement", "à bientôt", "merci", "cdlt", "merci d'avance",
    "saludos", "un saludo", "saludos cordiales", "atentamente", "un cordial saludo", "gracias", "muchas gracias", "cordialmente",
)

# How device notes begin.
DEVICE_NOTES = (
    "sent from my", "sent from a", "sent from mobile", "sent via", "sent using", "get outlook for", "von unterwegs gesendet", "von meinem", "gesendet von", "gesendet mit", "envoyé depuis", "envoyé de mon", "enviado desde", "typed on a", "sent with",
)

# Words of legal and company notices (a line that holds one of them is a notice).
NOTICES = (
    r"confidentiality notice", r"this (?:e-?mail|message)(?: and any)?.{0,60}(?:confidential|privileged)", r"(?:received|get|got) (?:it|this (?:e-?mail|message)) in error", r"if you (?:are not|aren't) the (?:intended|named) (?:recipient|addressee)",
    r"views in this (?:e-?mail|message) are", r"views expressed.{0,60}(?:author|sender)", r"registered office ?:", r"registered in [A-Z].{0,40}no\.", r"before printing this", r"diese (?:e-?mail|nachricht) (?:ist|kann|enthält).{0,40}vertraulich", r"irrtümlich (?:erhält|erhalten)",
    r"ce (?:courriel|message|mail) est (?:réservé|confidentiel)", r"toute diffusion est interdite", r"este (?:correo|mensaje) es confidencial", r"handelsregister", r"sitz der gesellschaft", r"company no\. ?\d",
)

# The fields of mail headers above quoted text.
FROM_FIELD = r"^(?:From|Von|De|Da) ?: *\S.*$"
DATE_FIELD = r"^(?:Sent|Date|Gesendet|Datum|Envoyé|Enviado|Fecha|Le) ?: *\S.*$"
OTHER_FIELD = r"^(?:To|Cc|Subject|An|Kopie|Betreff|À|A|Objet|Para|Asunto|Reply-To|Importance) ?:.*$"
INTRODUCTION = r"(?i)^(?:-{2,} ?(?:original message|ursprüngliche nachricht|message d'origine|message original|mensaje original|forwarded message|weitergeleitete nachricht|message transféré|mensaje reenviado|forwarded by .*)(?: ?-{2,})?|begin forwarded message ?:|anfang der weitergeleiteten nachricht ?:|début du message (?:transféré|réexpédié) ?:|_{20,}|-{20,})$"
ATTRIBUTION = r"(?i)^.{3,}\b(?:wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|ha scritto)(?: .+)? ?:$"
WRAPPED = r"(?i)^(?:on|am|le|el|il) .*\d.*$"
WRAPPED_END = r"(?i)^<?[^\s<>@]+@[^\s<>]+>? (?:wrote|writes|schrieb|a écrit|escribió) ?:$"
MARK = r"^[ \t]*(?:[>|][ \t]?)+"


# Each notice has one of these pieces; looking for them first is cheaper than the patterns.
NOTICE_PIECES = ("confiden", "privileged", "in error", "recipient", "addressee", "views ", "registered ", "printing this", "vertraulich", "irrtümlich", "courriel", "message est", "mail est", "diffusion", "handelsregister", "gesellschaft", "company no")


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("(?i)(?:" + "|".join(patterns) + ")")


def _closing_cue(line: Column, name: Column) -> tuple[Column, Column]:
    """The closing formula a line begins with, and whether the line begins a closing block (given the columns _low and _formula)."""
    formula = F.regexp_extract(F.col("_low"), r"^(" + "|".join(sorted(FORMULAS, key=len, reverse=True)) + r")(?:[,.!]?[ ]+|[,.!]*$)", 0)
    rest = F.trim(F.expr("substring(_line, length(_formula) + 1)"))
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), r"[\s,]+")
    own_name = F.forall(F.split(F.lower(rest), r"[\s,.]+"), lambda w: F.array_contains(words, w) | (F.length(w) <= 1))
    a_name = rest.rlike(r"^[A-ZÀ-Þ][\w'’.-]+(?: [A-ZÀ-Þ][\w'’.-]*){0,2}$")
    first_word_known = (F.col("_formula") != "") & ((rest == "") | own_name | a_name)
    delimiter = line.rlike(r"^(?:-- ?|—|_{5,}|\*{3,}|={5,}|/[A-Z]{1,4}|-{5,})$")
    device = F.col("_low").rlike("^(?:" + "|".join(DEVICE_NOTES) + ")")
    notice = reduce(or_, [F.col("_low").contains(x) for x in NOTICE_PIECES]) & _any(line, NOTICES)
    return formula, first_word_known | delimiter | device | notice


def new_lines(
    mails: DataFrame,
    ident: str = "id",
    body: str = "body_text",
    message: str = "message_id",
    parent: str = "in_reply_to",
    sender: str = "from_addr",
    sender_name: str = "from_name",
    sent: str = "sent_at",
    least_recurrence: int = 3,
    recurrence_share: float = 0.3,
) -> DataFrame:
    """One row per newly written non-blank line: mail_id, line_no (from 1, split at line feeds), line_text.

    Not new: marked quotes and text under a mail header with what introduces
    them (marked lines of a mail that answers and forwards nothing are its own),
    unmarked text whose line pairs an earlier message of the thread has, and the
    closing block from its first formula, delimiter, device note or notice on
    (up to quoted text, below which an answer counts again), or a last paragraph all of whose lines end at least ``least_recurrence`` and
    ``recurrence_share`` of the sender's mails.

    Null or empty bodies give no rows; null parents, senders or dates only
    switch off what needs them. A mail found twice is judged twice, alike.
    """
    # Every line carries these: 64-bit hashes stand for message ids and senders.
    hashed = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    base = mails.select(
        mails[ident].alias("_id"), mails[body].alias("_body"), hashed(mails[message]).alias("_msg"), hashed(mails[parent]).alias("_par"), hashed(F.lower(F.trim(mails[sender]))).alias("_from"), mails[sender_name].alias("_name"), mails[sent].alias("_sent")
    ).filter("_body IS NOT NULL AND _id IS NOT NULL")
    lines = base.repartition("_id").select("_id", "_msg", "_par", "_from", "_name", "_sent", F.posexplode(F.split("_body", "\n")).alias("_pos", "_raw"))
    lines = lines.withColumn("_line", F.regexp_replace("_raw", r"^[\s ]+|[\s ]+$", ""))
    # blank lines matter as borders of paragraphs only
    order = W.partitionBy("_id").orderBy("_pos")
    mail = W.partitionBy("_id")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    full = lines.filter(F.col("_line") != "")
    full = full.withColumn("_core", F.trim(F.regexp_replace("_raw", MARK, "")))
    full = full.withColumn("_core", F.regexp_replace("_core", r"[\s ]+$", "")).withColumn("_mark", F.col("_raw").rlike(MARK))
    full = full.withColumn("_h", F.xxhash64(F.lower("_core"))).drop("_raw", "_core")
    # blank heads and dates are asked of the next lines, so each line says what it is first
    has_colon = F.col("_line").contains(":")
    own_from, own_date, own_other = (has_colon & F.col("_line").rlike(x) for x in (FROM_FIELD, DATE_FIELD, OTHER_FIELD))
    full = full.withColumn("_is", F.when(own_from, 1).when(own_date, 2).when(own_other, 3).otherwise(0)).withColumn("_end", F.col("_line").endswith(":") & F.col("_line").rlike(WRAPPED_END))
    full = full.withColumn("_i1", F.lead("_is", 1).over(order)).withColumn("_i2", F.lead("_is", 2).over(order)).withColumn("_e1", F.coalesce(F.lead("_end", 1).over(order), F.lit(False)))
    full = full.withColumn("_m1", F.coalesce(F.lead("_mark", 1).over(order), F.lit(False))).withColumn("_m2", F.coalesce(F.lead("_mark", 2).over(order), F.lit(False)))
    full = full.withColumn("_p1", F.lead("_pos", 1).over(order)).withColumn("_nh", F.lead("_h", 1).over(order))
    is_head = (F.col("_is") == 1) & ((F.col("_i1") == 2) | ((F.col("_i1") == 3) & F.col("_i2").isin(2, 3)))
    intro = F.col("_i1").isin(1, 2) & F.col("_line").rlike(INTRODUCTION)
    full = full.withColumn("_cut", F.when(~F.col("_mark") & F.coalesce(is_head | intro, F.lit(False)), F.col("_pos")))
    attr = ~F.col("_mark") & F.col("_m1") & F.col("_line").endswith(":") & F.col("_line").rlike(ATTRIBUTION)
    wrapped = ~F.col("_mark") & F.col("_e1") & F.col("_m2") & F.col("_line").rlike(WRAPPED)
    full = full.withColumn("_attr", attr | wrapped | (F.col("_end") & F.col("_m1")))
    full = full.withColumn("_first_cut", F.min("_cut").over(mail)).withColumn("_quotes", F.max(F.col("_mark")).over(mail)).withColumn("_attrs", F.max(F.col("_attr")).over(mail))
    answers = F.col("_par").isNotNull() | F.col("_first_cut").isNotNull() | F.col("_attrs")
    full = full.withColumn("_quoted", answers & (F.col("_mark") | F.col("_attr") | F.coalesce(F.col("_pos") >= F.col("_first_cut"), F.lit(False))))

    # Closings: from a cue among the sender's own lines on, up to the next quoted line, below which answers may follow.
    full = full.withColumn("_low", F.lower("_line"))
    formula, _ = _closing_cue(F.col("_line"), F.col("_name"))
    full = full.withColumn("_formula", formula)
    _, cue = _closing_cue(F.col("_line"), F.col("_name"))
    full = full.withColumn("_cue", F.max(F.when(~F.col("_quoted") & cue, F.col("_pos"))).over(so_far)).withColumn("_quote", F.max(F.when(F.col("_quoted"), F.col("_pos"))).over(so_far))
    full = full.withColumn("_mine", ~F.col("_quoted") & ~F.coalesce(F.col("_cue") > F.coalesce("_quote", F.lit(-1)), F.lit(False)))

    # Paragraphs of the own lines, counted from the end of the mail: 0 is the last.
    here = F.when(F.col("_mine"), F.col("_pos"))
    full = full.withColumn("_last", F.max(here).over(mail))
    parted = F.col("_mine") & (F.col("_pos") < F.col("_last")) & (F.col("_p1") > F.col("_pos") + 1)
    full = full.withColumn("_paras", F.sum(F.when(parted, 1).otherwise(0)).over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    full = full.withColumn("_more", F.coalesce(F.max(F.when(F.col("_mine"), F.col("_paras"))).over(mail), F.lit(0)) > 0)
    full = full.withColumn("_n_last", F.sum(F.when(F.col("_mine") & (F.col("_paras") == 0), 1).otherwise(0)).over(mail))
    bare = F.col("_par").isNotNull() & ~F.col("_quotes") & F.col("_first_cut").isNull()
    # What follows reads the judged lines several times: they are written once, other lines' texts only as hashes.
    full = cut_lineage(full.select("_id", "_pos", "_p1", "_msg", "_par", "_from", "_sent", "_mark", "_h", "_nh", "_mine", bare.alias("_bare"), "_paras", "_more", "_n_last", F.when(F.col("_mine"), F.col("_line")).alias("_line")))
    own = full.filter("_mine")

    # Sender-recurrent endings: lines of the last own paragraph, counted over the sender's mails. A paragraph goes if all its lines recur and others stay.
    sent_by = base.filter("_from IS NOT NULL").groupBy("_from").agg(F.count(F.lit(1)).alias("_mails"))
    ending = own.filter((F.col("_paras") == 0) & F.col("_from").isNotNull() & F.col("_more")).select("_id", "_pos", "_from", "_h", "_n_last")
    counted = own.filter((F.col("_paras") == 0) & F.col("_from").isNotNull()).groupBy("_from", "_h").agg(F.count(F.lit(1)).alias("_again")).filter(F.col("_again") >= least_recurrence)
    recurring = counted.join(sent_by, "_from").filter(F.col("_again") >= F.col("_mails") * recurrence_share).select("_from", "_h")
    tails = ending.join(recurring, ["_from", "_h"], "left_semi").withColumn("_n", F.count(F.lit(1)).over(mail)).filter("_n = _n_last").select("_id", "_pos")

    # Unmarked quotes: pairs of neighbouring lines; of each in a thread (a message and its replies) the first-authored occurrence stays.
    pairs = full.filter("_nh IS NOT NULL").withColumn("_pair", F.xxhash64("_h", "_nh"))
    by = F.coalesce("_msg", F.lit(0))
    replies = pairs.filter("_bare AND _mine").select(F.col("_par").alias("_thread"), "_pair", "_id", "_pos", "_p1", by.alias("_by"), "_sent")
    rank = F.struct(F.col("_reply"), F.col("_sent").isNull().alias("_no_date"), F.col("_sent"), F.col("_no"), F.col("_by"))
    told = (
        pairs.filter("_msg IS NOT NULL").select(F.col("_msg").alias("_thread"), "_pair", F.lit(0).alias("_reply"), "_sent", F.lit(None).cast("bigint").alias("_no"), F.col("_msg").alias("_by"))
        .unionByName(pairs.filter(F.col("_par").isNotNull() & F.col("_mark")).select(F.col("_par").alias("_thread"), "_pair", F.lit(0).alias("_reply"), "_sent", F.lit(None).cast("bigint").alias("_no"), F.col("_par").alias("_by")))
        .unionByName(replies.select("_thread", "_pair", F.lit(1).alias("_reply"), "_sent", F.col("_id").cast("bigint").alias("_no"), "_by"))
    )
    firsts = told.groupBy("_thread", "_pair").agg(F.min(rank).alias("_f")).select("_thread", "_pair", F.col("_f._by").alias("_author"))
    repeated = replies.join(firsts, ["_thread", "_pair"]).filter(F.col("_author") != F.col("_by")).select("_id", F.explode(F.array("_pos", "_p1")).alias("_pos"))

    kept = own.select("_id", "_pos", "_line").join(tails.unionByName(repeated), ["_id", "_pos"], "left_anti")
    return kept.select(F.col("_id").alias("mail_id"), (F.col("_pos") + 1).alias("line_no"), F.col("_line").alias("line_text"))
