"""Personal information in free text: found by a conditional random field, replaced by typed placeholders.

A linear-chain CRF over word-shape features is trained on the driver from a
small generated table of labelled sentences (``pii_table``) and decoded by
Viterbi in numpy batches inside Arrow-batched Python workers. Texts are taken
line by line, whole; lines that look the same to the features (other digits,
another mail address) are decoded once within a batch. Spans found are checked
exactly afterwards (digits of a phone number, two parts of a name and so on).

Whether a word is a common one is told by a public tokenizer's vocabulary: its
lower-case form is a single entry there, which made-up and rare names are not.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut_lineage
from . import pii_table as T
from .crf import LinearChainCRF
from .tokens import WORDS, common_words, ship

KINDS = ("email", "phone", "id_number", "address", "person")
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]

_W = r"[^\W\d_]"
TOKEN = re.compile(
    rf"""(?P<EMAIL>[A-Za-z0-9][\w.+%-]*(?:@|\s?(?:\[at\]|\(at\)|\{{at\}}|<at>)\s?|\sat\s(?=[\w-]+\sdot\s))[A-Za-z0-9][\w-]*(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{{dot\}}|<dot>)\s?|\sdot\s)[A-Za-z0-9][\w-]*)+)
    |(?P<GUID>[0-9a-fA-F]{{8}}-(?:[0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}})
    |(?P<SID>S-1-\d+(?:-\d+)+)
    |(?P<IP>(?<![\d.])\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![\d.]*\d))
    |(?P<PATH>(?:[A-Za-z]:\\|\\\\|https?://|HKLM:|\.\\)[^\s'"<>|;)]+|\$[\w:.]+)
    |(?P<CLOCK>\d{{1,2}}:\d{{2}}(?::\d{{2}})?)
    |(?P<POSTCODE>(?<!\w)[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\ \d[A-Z]{{2}}(?!\w))
    |(?P<HOUSE>(?<![\w.])\d{{1,4}}[A-Za-z](?!\w))
    |(?P<ALNUM>(?<!\w)(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*(?!\w))
    |(?P<NUM>(?:\+|(?<!\w))(?:\(\d{{1,4}}\)|\d+)(?:[ ./-]{{0,1}}(?:\(\d{{1,4}}\)|\d+))*)
    |(?P<WORD>{_W}+(?:['’]{_W}+)*(?:-{_W}+(?:['’]{_W}+)*)*)
    |(?P<OTHER>\S)""",
    re.X,
)

# Words by which the neighbourhood of a token is told.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir herr herrn frau fräulein monsieur madame mademoiselle mme mlle m señor señora sr sra srta don doña".split())
PARTICLES = frozenset("van von vom zu zum zur de der den del della di da dos du des la le ter ten bin ibn al el af av".split())
STREET_WORDS = frozenset("street road lane avenue drive court close terrace boulevard quay row way place square crescent gardens parade walk hill park mews grove rise view green acre str rue quai chemin allée impasse place boulevard avenue cours calle avenida plaza paseo camino carrer via viale piazza am an im zum zur st rd ave dr blvd ln".split())
STREET_ENDS = ("straße", "strasse", "gasse", "weg", "allee", "platz", "ufer", "damm", "ring", "kai", "hafen", "stieg", "steig", "chaussee")
UNIT_WORDS = frozenset("apt apartment unit flat suite floor room etage wohnung appartement piso".split())
ID_WORDS = frozenset("ssn sin nin nino social security soc sec tax taxpayer steuer-id steuernummer steueridentifikationsnummer national id identity identification personal card passport licence license driving driver's driver travel document personalausweis ausweis reisepass führerschein numéro fiscal dni nie nif idno permis passeport".split())
DOCUMENT_WORDS = ID_WORDS - {"numéro"}  # telephones have a numéro as well
PHONE_WORDS = frozenset("call phone tel telephone mobile cell ring reach reachable fax t anrufen unter officephone telefon téléphone portable appeler prévenir call".split())
NOT_PERSONAL_NUMBER = frozenset("order invoice case ticket version build record change session port value hash serial parcel tracking kb no company maxevents requiredversion seconds entry entrée every zwischen between rechnung auftrag commande facture".split())
# Kinds of companies and of jobs: capital letters beside them are no one's, unless a name stands there.
ORG_WORDS = frozenset("bank logistics energy insurance media foods systems steel pharma pharmaceuticals airlines motors textiles software consulting partners capital holding holdings industries shipping telecom ltd limited inc gmbh ag sarl llc group hotels chemicals optics freight mills rail railways airways aviation aerospace marine mining oil gas water electric electronics robotics laboratories labs solutions services technologies trading ventures estates properties construction engineering furniture paper dairy farms bakeries breweries brewery works plastics ceramics cement timber transport cargo couriers networks publishing press broadcasting studios pictures records games toys sports fashion retail stores clinic hospital health healthcare medical diagnostics biotech genomics semiconductors university college institute academy foundation tiles bricks carpets interiors lighting machinery storage distribution wholesale imports exports recycling trust association agency council ministry corp corporation company plc llp kg se bv nv sa sas spa srl ab oy".split())
# Of these, what ends no person's name, unless it is listed as one.
COMPANY_ENDS = frozenset("logistics insurance foods systems pharma pharmaceuticals airlines textiles software consulting holding holdings industries shipping telecom ltd limited inc gmbh sarl llc plc llp group hotels chemicals optics freight airways aviation aerospace electronics robotics laboratories technologies solutions services ventures properties semiconductors diagnostics biotech genomics healthcare university institute academy foundation association corp corporation".split())
JOB_WORDS = frozenset("manager officer engineer analyst accountant administrator director consultant assistant clerk technician specialist coordinator supervisor auditor investigator examiner counsel attorney lawyer paralegal nurse teacher developer architect designer scientist researcher buyer planner operator programmer tester trainer recruiter secretary receptionist treasurer controller president chairman chairwoman associate representative advisor adviser agent broker strategist editor translator librarian inspector surveyor estimator mechanic electrician leader executive intern trainee geschäftsführer geschäftsführerin leiter leiterin sachbearbeiter sachbearbeiterin ingenieur ingenieurin buchhalter buchhalterin berater beraterin directeur directrice responsable ingénieur comptable chargé assistante gerente jefe jefa ingeniero ingeniera contable".split())

# Letters that open the numbers of records, not of people.
RECORD_PREFIXES = ("kb", "inc", "chg", "req", "ref", "rma", "inv", "cve", "sr", "po", "ms", "id", "ticket", "case", "order", "bug", "rfc", "iso", "build", "ver", "v")
# a date, with or without the hour after it
DATED = re.compile(r"(?:\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d|(?:19|20)\d\d[./-]\d{1,2}[./-]\d{1,2})(?!\d)")


def _shape(text: str) -> str:
    s = re.sub(r"\d", "9", text)
    return re.sub(r"[^\W\d_a-zà-öø-ÿß]+", "X", re.sub(r"[a-zà-öø-ÿß]+", "x", s))


def _letters_and_digits(text: str) -> str:
    """The form of a number: every digit and every letter counts, their kind only."""
    return re.sub(r"[a-zà-öø-ÿß]", "x", re.sub(r"[^\W\d_a-zà-öø-ÿß]", "X", re.sub(r"\d", "9", text)))


def tokens_of(line: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens of a line, each as KIND:what the features see of it, and their places."""
    toks, spans = [], []
    for m in TOKEN.finditer(line):
        kind = m.lastgroup
        if kind == "WORD" or kind == "OTHER":
            toks.append(f"{kind}:{m.group()}")
        elif kind in ("NUM", "ALNUM", "HOUSE", "POSTCODE"):
            text = m.group()
            lead = "+" if text[0] in "+(" or text.startswith("00") else "#" if kind == "ALNUM" and re.match(r"[A-Za-z]*", text).group().lower() in RECORD_PREFIXES else ""
            # a document's name counts some words before its number: "passport, issued there, no. ..."
            document = "!" if any(t[:5] == "WORD:" and t[5:].lower() in DOCUMENT_WORDS for t in toks[-5:]) else ""
            toks.append(f"{kind}:{document}{lead}{_letters_and_digits(text)}")
        else:
            toks.append(kind + ":")
        spans.append(m.span())
    return toks, spans


class Features:
    """Features of a token seen from an offset; picklable, with the words the table knows, the listed names and the file of common words."""

    def __init__(self, vocabulary: frozenset[str], given: frozenset[str], family: frozenset[str], words: str = WORDS):
        self.vocabulary, self.given, self.family, self.words = vocabulary, given, family, words

    def listing(self, given: Sequence[str], family: Sequence[str]) -> Features:
        """The same features with further listed names."""
        return Features(self.vocabulary, self.given | {n.lower() for n in given}, self.family | {n.lower() for n in family}, self.words)

    def __call__(self, token: str, offset: int) -> list[str]:
        if token[0] == "<":
            return [token]
        kind, _, text = token.partition(":")
        if kind == "UNKNOWN":  # a word whose letters the training is not to see
            kind, hidden = "WORD", True
        else:
            hidden = False
        out = ["c=" + kind]
        if kind == "WORD":
            low = text.lower()
            parts = re.split(r"[-'’]", low)
            shape = _shape(text)
            given, family = any(p in self.given for p in parts), any(p in self.family for p in parts)
            known = low in self.vocabulary and not hidden and not given and not family and len(text) > 1
            common = common_words(self.words)
            lex = "1" if low in common else "2" if all(len(p) > 1 and p in common for p in parts) else "c" if text in common else "0"
            out += ["w=" + (low if known else "?"), "s=" + shape, f"l={lex}{shape[:2]}"]
            if given:
                out.append("given" + lex)
            if family:
                out.append("family" + lex)
            if low in TITLES:
                out.append("title")
            if low in PARTICLES:
                out.append("particle")
            if low in STREET_WORDS or low.endswith(STREET_ENDS) and not given:
                out.append("street")
            if low in UNIT_WORDS:
                out.append("unit")
            if low in ID_WORDS:
                out.append("idword")
            if low in PHONE_WORDS:
                out.append("phoneword")
            if low in NOT_PERSONAL_NUMBER:
                out.append("countword")
            if low in ORG_WORDS:
                out.append("orgword")
            if low in JOB_WORDS:
                out.append("jobword")
            if abs(offset) <= 1 and not known:
                out.append("e=" + low[-2:])
        elif kind in ("NUM", "ALNUM", "HOUSE", "POSTCODE"):
            marks, shape = text[: len(text) - len(text.lstrip("!+#"))], text.lstrip("!+#")
            out += ["s=" + shape, "d=" + str(shape.count("9"))]
            if "!" in marks:
                out.append("document")
            if "+" in marks:
                out.append("dial")
            if "#" in marks:
                out.append("record")
        elif kind == "OTHER":
            out.append("p=" + text)
        return out


def _vocabulary() -> frozenset[str]:
    words: set[str] = set()
    fixed = [re.sub(r"\{\w*\}", " ", p) for _, p in T.PATTERNS] + T.IDWORDS + T.JOBS + T.CLOSINGS + T.SHORT_CLOSINGS + T.HEADINGS + T.DIVIDERS + T.DAYS + T.MONTHS + ["AM PM"]
    for line in fixed:
        words.update(t[5:].lower() for t in tokens_of(line)[0] if t.startswith("WORD:"))
    return frozenset(words)


def labelled(row: str) -> tuple[list[str], list[str]]:
    """Tokens and tags of a row with marked spans; rows whose spans cut tokens are refused."""
    text, marks = "", []
    at = 0
    for m in re.finditer(r"⟦(email|phone|id_number|address|person)\|(.*?)⟧", row):
        text += row[at : m.start()]
        marks.append((len(text), len(text) + len(m.group(2)), m.group(1)))
        text += m.group(2)
        at = m.end()
    text += row[at:]
    toks, spans = tokens_of(text)
    tags = ["O"] * len(toks)
    for a, z, kind in marks:
        inside = [i for i, (b, e) in enumerate(spans) if b >= a and e <= z]
        if any(b < z and e > a and i not in inside for i, (b, e) in enumerate(spans)) or not inside:
            raise ValueError(f"span cuts a token: {row}")
        for k, i in enumerate(inside):
            tags[i] = ("I-" if k else "B-") + kind
    return toks, tags


_MODELS: dict[tuple, LinearChainCRF] = {}


def train(copies: int = 10, epochs: int = 12, rows: Sequence[str] | None = None, words: str = WORDS, hidden: float = 0.2, seed: int = 5) -> LinearChainCRF:
    """The model, trained from the labelled table (some 685 rows per copy); kept per process.

    A share of ``hidden`` of the words is shown to the training without its
    letters, so that it learns to do without knowing the words around a span.
    """
    key = (copies, epochs, tuple(rows) if rows else None, words, hidden, seed)
    if key not in _MODELS:
        # half of the table's names count as listed: names must be found with and without the list
        listed_g = frozenset(n.lower() for n in T.GIVEN[::2])
        listed_f = frozenset(n.lower() for n in T.FAMILY[::2])
        feats = Features(_vocabulary(), listed_g, listed_f, words)
        r = random.Random(seed)
        sentences, tags = [], []
        for row in rows or T.labelled_rows(copies):
            toks, labels = labelled(row)
            if toks:
                sentences.append(["UNKNOWN" + t[4:] if t.startswith("WORD:") and r.random() < hidden else t for t in toks])
                tags.append(labels)
        _MODELS[key] = LinearChainCRF(LABELS, feats).fit(sentences, tags, epochs=epochs)
    return _MODELS[key]


def _like_address(text: str) -> bool:
    """Whether the text has a street's form: it names a kind of street where that belongs, or a town follows the street."""
    street, _, rest = text.partition(",")
    if re.fullmatch(r"\d+\w?(?: bis| ter)?", street.strip()):  # the number is set off by a comma
        street, _, rest = rest.strip().partition(",")
        street = "1 " + street
    words = re.findall(rf"{_W}+(?:['’.-]{_W}+)*\.?", street)
    if not words or not (street[0].isdigit() or street[0].isupper() or words[0].lower() in STREET_WORDS):
        return False
    low = [w.lower().rstrip(".") for w in words]
    if any(w.endswith(STREET_ENDS) or w.endswith("str") and len(w) > 3 for w in low) or low[0] in STREET_WORDS:
        return True
    while len(low) > 1 and (low[-1] in UNIT_WORDS or len(low[-1]) == 1 or low[-1] in ("north", "south", "east", "west", "ne", "nw", "se", "sw")):
        low.pop()
    return low[-1] in STREET_WORDS or len(re.findall(rf"{_W}{{2,}}", rest)) > 0


def _like_name(words: Sequence[str], text: str) -> bool:
    """Whether words are spelled as the parts of one name: all capitalised (particles aside) or all small, parted by blanks."""
    if re.search(r"[^\W\d_]{2}\.[^\W\d_]|[_@\\/=:;]", text) or any(re.match(r"[^\W\d_]['’][^\W\d_A-ZÀ-Þ]", w) and w[0].isupper() for w in words):
        return False
    main = [w for w in words if w.lower() not in PARTICLES]
    return all(w[0].isupper() for w in main) or all(w.islower() for w in words) and len(main) <= 3


def _checked(kind: str, line: str, a: int, z: int, toks: list[str], family: frozenset[str] = frozenset()) -> tuple[int, int] | None:
    """The exact check of a span: trimmed, or None where it cannot be of its kind. family: listed family names."""
    while a < z and line[a] in " ,;:.<>'\"|-":
        a += 1
    while z > a and line[z - 1] in " ,;:<>'\"|-#":
        z -= 1
    text = line[a:z]
    digits = sum(ch.isdigit() for ch in text)
    if kind == "email":
        return (a, z) if any(t.startswith("EMAIL:") for t in toks) else None
    if kind == "phone":
        return (a, z) if 7 <= digits <= 15 and not DATED.match(text) else None
    if kind == "id_number":
        # documents print capital letters; small ones between digits are hashes
        return (a, z) if digits >= 6 and len(text) <= 24 and not (re.search(r"[a-z]", text) and digits) else None
    if kind == "address":
        if text.endswith(".") and not re.search(r"(?i)\b(?:\w*str|st|rd|ave|dr|blvd|ln)\.$", text):
            z -= 1
        return (a, z) if digits and _like_address(line[a:z]) else None
    words = [t[5:] for t in toks if t.startswith("WORD:")]
    while words and words[0].lower() in TITLES and words[0][:1].isupper() and len(words) > 1:
        drop = re.match(rf"{re.escape(words[0])}\.?\s*", line[a:z])
        if not drop:
            break
        a += drop.end()
        words = words[1:]
    # particles that open the line or the quotation belong to the family name after them
    if (m := re.search(r"(?:^|[>|'\"(]\s*)((?:[^\W\d_]+ ){1,2})$", line[:a])) and all(w.lower() in PARTICLES for w in m.group(1).split()):
        a = m.start(1)
    before = re.search(r"([^\W\d_]+)\.?\s*$", line[:a])
    titled = bool(before) and before.group(1).lower() in TITLES
    if words and not titled and (end := words[-1].lower()) in COMPANY_ENDS and end not in family:
        return None
    whole = [w for w in words if len(w) > 1 and w.lower() not in PARTICLES]
    if z > a and line[z - 1] == ".":
        z -= 1
    return (a, z) if z > a and (len(whole) >= 2 or titled and whole) and _like_name(words, line[a:z]) and not re.match(r"[-_@\\/]?\w", line[z:]) else None


def _record_number(text: str) -> bool:
    """Whether a number opens with the letters that records open with."""
    return re.match(r"[A-Za-z]*", text).group().lower() in RECORD_PREFIXES


def _dialled(part: str) -> bool:
    """Whether a part of an address is a phone number: long enough and in no form of a postcode."""
    return bool(re.fullmatch(r"[+(]?\d[\d()./ -]*", part)) and 7 <= sum(ch.isdigit() for ch in part) <= 15 and not re.fullmatch(r"\d{5}-\d{3,4}|\d{4}-\d{3}|\d{3}-\d{4}|\d{7}", part)


def _pieces(kind: str, line: str, a: int, z: int) -> Iterator[tuple[str, int, int]]:
    """A span as it is, but for fields and phone numbers taken for parts of an address: each by itself."""
    if kind != "address":
        yield kind, a, z
        return
    for field in re.finditer(r"[^;|\t]+", line[a:z]):
        begin = end = a + field.start()
        for part in re.finditer(r"[^,]+", field.group()):
            if _dialled(part.group().strip()):
                if end > begin:
                    yield kind, begin, end
                yield "phone", a + field.start() + part.start(), a + field.start() + part.end()
                begin = end = a + field.start() + part.end() + 1
            else:
                end = a + field.start() + part.end()
        if end > begin:
            yield kind, begin, end


def find_in_lines(lines: Sequence[str], model: LinearChainCRF) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of the personal information in each line."""
    split = [tokens_of(x) for x in lines]
    alike: dict[tuple[str, ...], int] = {}
    which = [alike.setdefault(tuple(s[0]), len(alike)) for s in split]
    paths = model.decode(list(alike))
    family = getattr(model.featurize, "family", frozenset())
    out: list[list[tuple[str, int, int]]] = [[] for _ in lines]
    for i, number in enumerate(which):
        path = paths[number]
        if not path.any():
            continue
        toks, spans = split[i]
        k = 0
        while k < len(path):
            tag = LABELS[path[k]]
            if tag == "O":
                k += 1
                continue
            kind, b = tag[2:], k
            k += 1
            while k < len(path) and LABELS[path[k]] == "I-" + kind:
                k += 1
            for piece, a, z in _pieces(kind, lines[i], spans[b][0], spans[k - 1][1]):
                if got := _checked(piece, lines[i], a, z, toks[b:k], family):
                    out[i].append((piece, *got))
        # such a number is a person's where the line names a document or something else of a person
        if not any(t.startswith("WORD:") and t[5:].lower() in ID_WORDS for t in toks) and not any(h[0] != "id_number" for h in out[i]):
            out[i] = [h for h in out[i] if not _record_number(lines[i][h[1] : h[2]])]
    return out


RESULT = "record_id {ident}, redacted string, found array<struct<kind:string,text:string,at:int>>"


def _listed_words(df: DataFrame, names: DataFrame) -> DataFrame:
    """_id, _text and the listed names among the text's own words (by join, for lists that are too long to go to every worker)."""
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), "_id", "_text")
    numbered = cut_lineage(numbered)  # the numbers must not change between the two readings
    known = names.filter("name_text IS NOT NULL").select(F.lower("name_text").alias("_word"), F.when(F.col("name_kind") == "given", "g").otherwise("f").alias("_kind")).distinct()
    words = numbered.select("_row", F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))).alias("_word"))
    of_row = words.join(known, "_word").groupBy("_row").agg(F.collect_set(F.concat("_kind", "_word")).alias("_listed"))
    return numbered.join(of_row, "_row", "left").select("_id", "_text", F.coalesce("_listed", F.array().cast("array<string>")).alias("_listed"))


def redact(df: DataFrame, ident: str, text: str, names: DataFrame | None = None, most_names: int = 100_000, model: LinearChainCRF | None = None, words: str = WORDS) -> DataFrame:
    """One row per record: record_id, redacted, found (kind, text, place of each hit).

    redacted is the text with every hit replaced by [EMAIL], [PHONE],
    [ID_NUMBER], [ADDRESS] or [PERSON], otherwise unchanged; the whole text is
    read. names: optional listed names (name_text, name_kind). Up to
    ``most_names`` of them go to every worker, longer lists are joined with the
    texts' words; the result is the same. model: a trained model to use instead
    of training one here. words: file of the vocabulary that tells common words.
    Null texts stay null with no hits, empty ones empty. Rows of a null id are
    kept. Repeated rows are treated one by one; an empty table gives no rows.
    """
    ship(df.sparkSession, words)
    lean = df.select(df[ident].alias("_id"), df[text].alias("_text"))
    given, family, joined = [], [], False
    if names is not None:
        listed = names.filter("name_text IS NOT NULL").select("name_text", "name_kind").distinct().limit(most_names + 1).collect()
        joined = len(listed) > most_names
        if joined:
            lean = _listed_words(lean, names)
        else:
            given = [r[0] for r in listed if r[1] == "given"]
            family = [r[0] for r in listed if r[1] != "given"]
    model = model or train(words=words)
    model = model.with_features(model.featurize.listing(given, family))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            here = model
            if joined:
                seen = {x for row in b["_listed"] for x in row}
                here = model.with_features(model.featurize.listing([x[1:] for x in seen if x[0] == "g"], [x[1:] for x in seen if x[0] == "f"]))
            pieces = [(t.split("\n") if t else []) for t in b["_text"]]
            distinct = list({x for ls in pieces for x in ls})
            hits = dict(zip(distinct, find_in_lines(distinct, here)))
            texts, found = [], []
            for t, ls in zip(b["_text"], pieces):
                if t is None:
                    texts.append(None)
                    found.append([])
                    continue
                at, out, rows = 0, [], []
                for x in ls:
                    done, new = 0, []
                    for kind, a, z in hits[x]:
                        rows.append({"kind": kind, "text": x[a:z], "at": at + a})
                        new += [x[done:a], f"[{kind.upper()}]"]
                        done = z
                    out.append("".join(new) + x[done:])
                    at += len(x) + 1
                texts.append("\n".join(out))
                found.append(rows)
            yield pd.DataFrame({"record_id": b["_id"].to_numpy(), "redacted": pd.Series(texts, dtype=object), "found": pd.Series(found, dtype=object)})

    return lean.mapInPandas(work, RESULT.format(ident=dict(df.dtypes)[ident]))


def found_rows(redacted: DataFrame) -> DataFrame:
    """(record_id, pii_kind, pii_text), each different text once per record."""
    lean = redacted.select("record_id", F.explode(F.array_distinct(F.transform("found", lambda f: F.struct(f["kind"].alias("pii_kind"), f["text"].alias("pii_text"))))).alias("_f"))
    return lean.select("record_id", "_f.pii_kind", "_f.pii_text")
