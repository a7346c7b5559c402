"""Template residue, filler and error pages that stand where content should be.

One multi-pattern automaton holds pieces of error messages, of notices that
scripts or checks are needed and of filler text in four languages, and the
delimiters of template fields. Some pieces are telling (core), others only
count beside them (support). A passage (a sentence or line) is residue when it
holds a core piece and the matched pieces cover most of its words, small words
and numbers left out: text that describes such a message has words of its own,
and what stands in quotation marks is not counted. Coverage is taken against
the passage and not the whole document, because one such passage in a long
document counts. An unfilled field is a passage of its own: it is covered as a
whole. The part of the document that residue takes is reported beside it.

Rows are independent: no shuffle, texts of any length, Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pieces of messages, parted by bars, in small letters with 0 for any number; a piece ending in * goes on to the end of its word.
# From common servers, frameworks, browsers and site kits in English, German, French and Spanish.
CORE = {
    "error": """not found|bad gateway|gateway timeout|gateway time-out|service unavailable|temporarily unavailable|currently unavailable|is unavailable|internal server error|internal error|server error|forbidden|access denied|permission denied|unauthorized|bad request|too many requests|request timeout|timed out|timeout|something went wrong|went wrong|error occurred|unexpected error|does not exist|doesn't exist|no longer available|no longer exists|not available|not on this server
|cannot be displayed|can't be displayed|cannot be found|could not be found|can't find|couldn't find|cannot find|cannot load|under maintenance|for maintenance|scheduled maintenance|under construction|session has expired|session expired|session timed out|has expired|have expired|link is broken|broken link|has been removed|have been removed|has been deleted|has moved|database connection|connection to the database|fatal error|uncaught exception|stack trace|traceback|exception report
|memory size|memory limit|out of memory|nullpointerexception|keyerror|valueerror|typeerror|attributeerror|runtimeexception|syntax error|parse error|not authorized|not allowed|not permitted|have permission|no permission|log in to|sign in to|log in again|oops|error 0|http 0|status 0|0 error|ray id|request id|error id|error code|incident id|try again|unreachable|refused to connect|"error":|"status":|http status|rate limit
|nicht gefunden|existiert nicht|nicht erreichbar|nicht verfügbar|serverfehler|zugriff verweigert|keine berechtigung|nicht berechtigt|abgelaufen|fehler aufgetreten|wartungsarbeiten|gewartet|fehler 0|versuchen sie es|schiefgelaufen|introuvable|n'existe pas|n'est pas disponible|n'est plus disponible|erreur interne|erreur 0|accès refusé|accès interdit|indisponible|a expiré|s'est produite|a rencontré|en maintenance|réessay*
|no encontrad*|no se encuentra|no existe|no está disponible|error interno|acceso denegado|acceso prohibido|no disponible|ha caducado|haber caducado|ha expirado|ha ocurrido|se ha producido|en mantenimiento|inténtelo|inténtalo|intente""",
    "script": """javascript|java script|enable scripts|scripts are|scripts may|noscript|cookies|captcha|a robot|are human|you're human|is human|checking your browser|verifying your browser|verifying you|security check|unusual traffic|ddos protection|browser is not supported|browser is unsupported|browser does not support|browser doesn't support|outdated browser|loading|ad blocker|adblock*|just a moment
|skripte|kein roboter|ein mensch|browser wird|browser unterstützt|un robot|êtes humain|êtes un humain|votre navigateur|es humano|su navegador|tu navegador|un ser humano""",
    "filler": """goes here|go here|your text|your content|your message here|insert text|enter text|sample text|sample content|sample paragraph|dummy text|dummy content|placeholder|filler text|replace this|replace me|replace with|add text|add content|write something|type something|coming soon|to be added|to be written|to be completed|to be determined|to be announced|more to come|asdf*|qwer*|blah|bla|foo bar|foobar|test test|example text|lorem|ipsum|dolor|consectetur|adipiscing|eiusmod|tempor|incididunt|aliqua|nostrud|exercitation|ullamco|laboris|aliquip|commodo|consequat|reprehenderit|voluptate*|cillum|fugiat|excepteur|occaecat|cupidatat|proident|deserunt|mollit|laborum|vivamus|sagittis|pellentesque|malesuada|vestibulum|phasellus|curabitur|suspendisse|voluptas|perspiciatis
|blindtext|platzhalter*|mustertext|beispieltext|fülltext|text folgt|inhalt folgt|folgt in kürze|hier steht|steht hier|hier kommt|noch ausfüllen|texte de remplissage|faux texte|texte fictif|à venir|à compléter|à remplacer|à remplir|votre texte|bientôt disponible|texto de relleno|texto de ejemplo|texto ficticio|texto simulado|su texto|tu texto|próximamente|pendiente de|por completar|sustituir|reemplazar""",
}
SUPPORT = {
    "error": """page*|server*|site|website|url|link|address|requested|request|content*|document|file|article|resource|sorry|please|later|back|home|homepage|start page|return|go|minutes|few|moment|administrator|webmaster|contact|support|browser|error|code|id|number|line|php|occurred|problem|our end|team|notified|looking into|working on|fix|available|unavailable|moved|deleted|removed|expired|session|login|view|show|open|access|permission|connection|establishing|database|apache|nginx|tomcat|cloudflare|port|status|type|message|description|null|bytes|allocated|exhausted|tried|proxy|http|path|upstream|most recent call last|exception|reference|may|due|temporary|check|spelling|typed
|seite|angefordert*|angefragt*|gewünscht*|adresse|startseite|zurück|bitte|später|erneut|noch einmal|sitzung|anmelden|melden|dienst|fehler|inhalt|leider|demandé*|serveur|veuillez|plus tard|accueil|retour|désolé|erreur|problème|reconnect*|connecter|service|página|solicitad*|enlace|puede|servidor|más tarde|volver|inicio|sentimos|error|sesión|contenido""",
    "script": """enable*|turn on|turned on|switch on|switched on|activate*|disabled|switched off|turned off|blocked|required|requires|needs|need|must|run|app|site|page*|continue|proceed|browser|settings|reload|refresh|view|use|accept|allow|verify|verifying|prove|confirm|complete|solve|tick|box|below|check*|seconds|second|take|wait|please|redirected|automatically|click|if|works|work|properly|without|experience|app*|support*|and|in|scripts|modern|content|id|ray|performance|security|network|computer|detected|your
|bitte|aktivieren|aktiviert|deaktiviert|schalten|einschalten|benötigt|anzuzeigen|anzeigen|fortzufahren|seite|ihrem|ihr|browser|bestätigen|überprüft|nutzen|activer|activez|activé|désactivé|veuillez|continuer|lire|article|afficher|navigateur|page|nécessite|nécessaire|prouvez|confirmez|vérification|active|activar|activado|habilite|habilitar|desactivado|continuar|ver|contenido|navegador|página|necesita|requiere|demuestre|confirme|comprobando""",
    "filler": """text|paragraph*|sentence*|heading|title|subtitle|here|release|publish*|publication|final|content|real|later|soon|one|two|three|four|section|example|sample|words|caption|description|body|image|0|sit|amet|elit|sed|ut|labore|et|dolore|magna|enim|minim|veniam|quis|nisi|ex|ea|duis|aute|irure|in|velit|esse|eu|nulla|pariatur|sint|non|sunt|culpa|qui|officia|anim|id|est|ad|do|erat|vel|nec|ac|at|eget|leo|cras|mauris|donec|porttitor|turpis|luctus|lectus|quisque|ornare|nibh|orci|urna|massa|ante|diam|arcu|porta|risus|semper|tellus|viverra|vitae|minima|quisquam|eaque|tempora|ipsa
|dies|ist|ein|inhalt|später|kommt|noch|absatz|satz|überschrift|beispiel|ersetzen|texte|contenu|titre|phrase|paragraphe|exemple|texto|contenido|título|párrafo|frase|ejemplo""",
}
# Small words of the four languages, which neither cover a passage nor ask to be covered.
SMALL = frozenset(
    "a an the of to is are was were be been it its this that these those you your we our us i my he she they them their and or but so as at on in for from by with if not no have has had will would can could may there here do does did out up off any all some more very too now then than when while because who which what how us "
    "der die das den dem des ein eine einen einem einer und oder aber ist sind war wurde werden wird es sie ihr ihre ihrem wir uns ich er zu zur zum im in am an auf von vom mit bei für nicht um dass noch auch nach aus "
    "le la les un une des du de d l et ou mais est sont a été être il elle on nous vous votre notre ce cette ces se s n ne pas plus dans sur pour par avec au aux en que qui y c j "
    "el los las una unos y o pero es son fue ser ha se su sus tu nuestro nuestra este esta estos del al en por para con sin que lo le no más".split()
)

# Pairs of delimiters of template fields, and marks that stand for missing values.
PAIRS = (("{{", "}}"), ("{%", "%}"), ("${", "}"), ("#{", "}"), ("<%", "%>"), ("[%", "%]"), ("<<", ">>"), ("«", "»"), ("&lt;", "&gt;"), ("[[", "]]"), ("%%", "%%"), ("@@", "@@"), ("$$", "$$"), ("__", "__"), ("<", ">"), ("[", "]"), ("{", "}"), ("%", "%"))
MARKS = ("#REF!", "#VALUE!", "#N/A", "#NAME?", "#DIV/0!", "Invalid Date", "NaN, null", "[object Object]", "TODO", "FIXME", "TBD", "TBA", "____", "XXXX", "???")

# Environment variables that are no unfilled fields, and HTML tags.
ENVIRONMENT = frozenset("APPDATA LOCALAPPDATA TEMP TMP SYSTEMROOT SYSTEMDRIVE WINDIR PROGRAMFILES PROGRAMDATA USERPROFILE ALLUSERSPROFILE PUBLIC COMSPEC PATH PATHEXT HOMEDRIVE HOMEPATH USERNAME USERDOMAIN COMPUTERNAME".split())
TAGS = frozenset("noscript script style html head body title meta link div span p a b i u em strong br hr img ul ol li table tr td th tbody thead form input button h1 h2 h3 h4 h5 h6 pre code nav header footer section article main iframe svg label select option textarea blockquote sup sub small".split())
# Words by which a bracket asks to be filled in.
ASKING = frozenset("insert enter your add describe fill write choose type select name date put hier einfügen eingeben ici insérer saisir nom aquí insertar escriba nombre".split())
# Words by which a sentence speaks about fields instead of having one unfilled.
ABOUT_FIELDS = re.compile(
    r"(?i)\b(?:templates?|placeholders?|fields?|form|markers?|variables?|syntax|stands? (?:for|where|in)|replaced|replaces|expands?|expanded|format string|format strings|mail merge|wildcards?|escape[sd]?|regex|on purpose|at run time|search mask|kit|kit's"
    r"|vorlagen?|platzhalter|felder?|feld|formular|ersetzt|ersetzen|variablen?|steht für|suchmaske|serienbrief|modèles?|champs?|remplacée?s?|variables?|marqueurs?|formulaire|syntaxe|plantillas?|campos?|sustituye|reemplaza|reemplazad[oa]s?|marcador(?:es)?|formulario|sintaxis)\b"
)
QUOTED = re.compile(r"(?<=[\w:,(;] )'[^\n]*?'(?=[\s.,;:!?)]|$)|(?<=\w )\"[^\"\n]*\"(?=[\s.,;:!?)]|$)|“[^”\n]*”|„[^“”\n]*[“”]")
SENTENCES = re.compile(r"(?<=[.!?]) +(?=\S)")
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
LEAD = re.compile(r"^(?:[-*•>#]+ +|\[\d{1,2}:\d{2}(?::\d{2})?\] \S+: +|\d+[.)] +)")

_AUTOMATA = None


def _automata():
    """(pieces with their kind and weight, telling pieces alone, delimiters and marks of fields), built once per Python worker."""
    global _AUTOMATA
    if _AUTOMATA is None:
        import ahocorasick

        pieces, cores, fields = ahocorasick.Automaton(), ahocorasick.Automaton(), ahocorasick.Automaton()
        told: dict[str, list[tuple[str, bool, bool]]] = {}
        for core, table in ((True, CORE), (False, SUPPORT)):
            for kind, text in table.items():
                for piece in text.replace("\n", "").split("|"):
                    told.setdefault(piece.removesuffix("*"), []).append((kind, core, piece.endswith("*")))
        for piece, uses in told.items():
            pieces.add_word(piece, (len(piece), tuple(uses)))
            if any(core for _, core, _ in uses):
                cores.add_word(piece, True)
        for k, (opening, _) in enumerate(PAIRS):
            fields.add_word(opening, k)
        for mark in MARKS:
            fields.add_word(mark, -1)
        pieces.make_automaton()
        cores.make_automaton()
        fields.make_automaton()
        _AUTOMATA = pieces, cores, fields
    return _AUTOMATA


def _folded(text: str) -> str:
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", text.lower().replace("’", "'")))


def _pieces_in(low: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, core) of the automaton's pieces that are whole words of a folded text."""
    out, size = [], len(low)
    for last, (n, uses) in _automata()[0].iter(low):
        a, z = last - n + 1, last + 1
        if low[a].isalnum() and a and low[a - 1].isalnum():
            continue
        inside = low[z - 1].isalnum() and z < size and low[z].isalnum()
        for kind, core, open_ended in uses:
            if not inside:
                out.append((a, z, kind, core))
            elif open_ended:
                end = z
                while end < size and low[end].isalnum():
                    end += 1
                out.append((a, end, kind, core))
    return out


def _field_end(text: str, a: int, pair: int) -> int:
    """End of the unfilled field that opens at ``a``, or -1: its closing delimiter on the same line, and a name or a demand between them."""
    opening, closing = PAIRS[pair]
    b = a + len(opening)
    z = text.find(closing, b)
    if z <= b or "\n" in text[b:z]:
        return -1
    inner = text[b:z]
    name = inner.strip()
    end = z + len(closing)
    if not name or not (any(ch.isalpha() for ch in name) or opening in ("{", "{{") and name.isdigit()):
        return -1
    first = re.match(r"[^\W\d_]*", name).group().lower()
    words = WORDS.findall(name)
    if opening in ("{{", "{%", "<%", "[%", "${", "#{"):
        return -1 if name.startswith("env:") or "{" in inner else end
    if opening in ("<<", "«", "&lt;", "[[", "%%", "@@", "$$"):
        return end if inner[0] != opening[0] and re.fullmatch(r"[^\W\d_][\w .:|/-]*", name) else -1
    if opening == "__":
        dunder = name in ("init", "main", "name", "file", "doc", "all", "call", "enter", "exit")
        return -1 if dunder or not re.fullmatch(r"[^\W\d_][\w .]*", inner) or (a and (text[a - 1].isalnum() or text[a - 1] == "_")) or text[end : end + 1].isalnum() or text[end : end + 1] == "_" else end
    if opening == "%":
        return end if inner.upper() not in ENVIRONMENT and re.fullmatch(r"[^\W\d_]\w{2,}(?: \w+)*", inner) and (not a or not (text[a - 1].isalnum() or text[a - 1] in "%_")) and not (text[end : end + 1].isalnum() or text[end : end + 1] in ("%", "_")) and (len(words) == 1 or "_" in inner or inner.isupper()) else -1
    if opening == "<":
        if re.sub(r"\W.*", "", name.lstrip("/")).lower() in TAGS:
            return -1
        return end if first in ASKING or re.fullmatch(r"[^\W\d_]{2,}(?:[_ -][^\W\d_]+){0,5}", inner) and "@" not in inner else -1
    if opening == "[":
        if text[end : end + 1] in ("(", "[") or (a and (text[a - 1].isalnum() or text[a - 1] in "])_$")):
            return -1
        if first in ASKING and len(words) > 1:
            return end
        return end if re.fullmatch(r"[^\W\d_]{2,}(?:[_ ][^\W\d_]+){0,5}", inner) and (len(words) > 1 and all(w[0].isupper() for w in words) or inner.isupper() and len(words) > 1 or "_" in inner or len(words) == 1 and len(inner) > 2 and not text[end : end + 1].isalnum()) or "_" in inner and re.fullmatch(r"\w+", inner) else -1
    return end if re.fullmatch(r"[^\W\d_][^\W\d]{2,}(?: [^\W\d]+){0,4}|\d{1,2}", inner) and not (a and (text[a - 1].isalnum() or text[a - 1] in "$#{_")) and text[end : end + 1] != "}" else -1


def fields_in(text: str) -> list[tuple[int, int]]:
    """(start, end) of the unfilled fields and marks of missing values in one line."""
    out: list[tuple[int, int]] = []
    for last, pair in _automata()[2].iter(text):
        if pair < 0:
            m = _MARK.match(text, _mark_start(text, last))
            found = m.span() if m else None
        else:
            a = last - len(PAIRS[pair][0]) + 1
            z = _field_end(text, a, pair)
            found = (a, z) if z > 0 else None
        if found and (not out or found[0] >= out[-1][1]):
            out.append(found)
        elif found and found[0] <= out[-1][0] and found[1] > out[-1][1]:
            out[-1] = found
    return out


_MARK = re.compile(r"(?<![\w])(?:_{5,}(?:/_+)*|__/__/_{2,}|X{4,}|\?{3,}(?!\?)|TODO\b[(:]?|FIXME\b|TB[DA]\b|#REF!|#VALUE!|#N/A\b|#NAME\?|#DIV/0!|Invalid Date\b|NaN, null\b|\[object Object\])(?!\w)")


def _mark_start(text: str, last: int) -> int:
    """Where the run of equal characters, or the mark, that ends at ``last`` begins."""
    a = last
    if text[a] in "_X?":
        while a and text[a - 1] in (text[last], "/"):
            a -= 1
        return a
    for mark in MARKS:
        if text.endswith(mark, 0, last + 1):
            return last + 1 - len(mark)
    return a


def judge_passage(passage: str, least_cover: float) -> tuple[str, int]:
    """('error', 'script', 'filler', 'field' or '', characters of residue) for one sentence or line."""
    bare = QUOTED.sub(" ", passage)
    low = _folded(bare).strip()
    if not low:
        return "", 0
    hits = _pieces_in(low) if next(_automata()[1].iter(low), None) is not None else []
    cores: dict[str, int] = {}
    for a, z, kind, core in hits:
        if core:
            cores[kind] = cores.get(kind, 0) + z - a
    if cores:
        # words of any kind may cover, as pages mix messages; at least one must be telling
        covered = bytearray(len(low))
        for a, z, *_ in hits:
            covered[a:z] = b"\1" * (z - a)
        core_cover = bytearray(len(low))
        for a, z, _, core in hits:
            if core:
                core_cover[a:z] = b"\1" * (z - a)
        have = need = 0
        for m in WORDS.finditer(low):
            word = m.group()
            if word == "0" or (word in SMALL and not core_cover[m.start()]):
                continue
            need += len(word)
            if covered[m.start()]:
                have += len(word)
        if need and have >= least_cover * need:
            return max(sorted(cores), key=cores.get), len(passage)
    if found := fields_in(bare):
        rest, at = [], 0
        for a, z in found:
            rest.append(bare[at:a])
            at = z
        rest.append(bare[at:])
        if not ABOUT_FIELDS.search(" ".join(rest)):
            return "field", sum(z - a for a, z in found)
    return "", 0


def _worth_a_look(text: str) -> bool:
    """Whether a telling piece or the opening of a field is there at all."""
    _, cores, fields = _automata()
    return next(fields.iter(text), None) is not None or next(cores.iter(_folded(text)), None) is not None


def judge_text(text: str | None, least_cover: float = 0.5) -> tuple[str, int, int]:
    """(kinds found, comma-separated; passages found; their characters) of one text."""
    if not text:
        return "", 0, 0
    if not _worth_a_look(text):
        return "", 0, 0
    kinds: set[str] = set()
    n = chars = 0
    for line in text.splitlines():
        line = LEAD.sub("", line.strip())
        if not line or not _worth_a_look(line):
            continue
        # quotations may hold sentence ends: those don't part sentences
        masked = QUOTED.sub(lambda m: "\0" * len(m.group()), line)
        bounds = [0, *[x for m in SENTENCES.finditer(masked) for x in (m.start(), m.end())], len(line)]
        parts = [line[a:z] for a, z in zip(bounds[::2], bounds[1::2])]
        found = [judge_passage(part, least_cover) for part in parts]
        if len(parts) > 1 and not any(kind for kind, _ in found):
            found = [judge_passage(line, least_cover)]
        for kind, size in found:
            if kind:
                kinds.add(kind)
                n, chars = n + 1, chars + size
    return ",".join(sorted(kinds)), n, chars


def mark_residue(df: DataFrame, ident: str = "doc_id", text: str = "text", least_cover: float = 0.5) -> DataFrame:
    """One row per record: record_id, residue_kinds, n_passages, residue_share, is_residue.

    residue_share is the part of the text's characters that residue takes. Null
    and empty texts are no residue; repeated rows are judged one by one; an
    empty table gives no rows. Further columns are not read.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [judge_text(t, least_cover) for t in b["_text"]]
            size = [len(t) if t else 1 for t in b["_text"]]
            yield pd.DataFrame({"record_id": b["_id"].to_numpy(), "residue_kinds": [g[0] for g in got], "n_passages": pd.Series([g[1] for g in got], dtype="int32").to_numpy(), "residue_share": pd.Series([g[2] / s for g, s in zip(got, size)], dtype="float64").to_numpy()})

    kind = dict(df.dtypes)[ident]
    lean = df.select(df[ident].alias("_id"), df[text].alias("_text")).filter("_id IS NOT NULL")
    return lean.mapInPandas(judge, f"record_id {kind}, residue_kinds string, n_passages int, residue_share double").withColumn("is_residue", F.col("n_passages") > 0)


def without_residue(df: DataFrame, ident: str = "doc_id", text: str = "text", least_cover: float = 0.5) -> DataFrame:
    """``df`` without the records that hold residue (null ids stay)."""
    bad = mark_residue(df, ident, text, least_cover).filter("is_residue").select(F.col("record_id").alias(ident)).distinct()
    return df.join(bad, ident, "left_anti")
