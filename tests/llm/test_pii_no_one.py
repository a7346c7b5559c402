"""What looks like a person's and is no one's, and spans that ran into their neighbours."""

from casewright.llm import pii

# Sentences that the table doesn't have, with companies, jobs, mail and script lines.
NO_ONE = [
    "Creating Scriptblock text (3 of 12):", "ScriptBlock ID: 0f8fad5b-d9cb-469f-a165-70867728950e", "Creating Runspace object (1 of 1):", "Pipeline execution details for command line: Get-Date.",
    "---- Weitergeleitete Nachricht ----", "===== Message transféré =====", "----- Ursprüngliche Nachricht -----", "CONFIDENTIALITY NOTICE: do not forward this mail.", "PRIVACY STATEMENT: we keep no copies.", "VERTRAULICHER HINWEIS: nur für den Empfänger.",
    "Signing Officer, Ravndal Pharma", "Ostergren Freight | Uppsala", "Registered in Tucson: Palmgrove Optics, company no. 00812345.", "The statements in this mail are not made for Morlavius Logistics.", "| Harbour Insurance |", "Plant Engineer, Quilliams Airways",
    "BR Solveig", "KR Anselm", "MfG Saskia", "Thx Kofi",
    "Wer die Nachricht versehentlich bekommt, möge sie löschen.", "On laisse la machine isolée pour ce soir.", "Le dossier est disponible dans le classeur.", "La copia está disponible en el archivo.",
    "KB5037771 was uninstalled again.", "Build 20348.2461 needs KB5044281 first.",
]


def _found(lines):
    return [{(k, x[a:z]) for k, a, z in hits} for x, hits in zip(lines, pii.find_in_lines(lines, pii.train()))]


def test_lines_of_no_one():
    wrong = [(x, h) for x, h in zip(NO_ONE, _found(NO_ONE)) if h]
    assert len(wrong) <= 1, wrong


def test_names_beside_companies_and_jobs():
    lines = ["Solveig Ravndal, Signing Officer, Palmgrove Pharma", "BR Solveig Ravndal", "# approved by Kofi Tollemark (Ostergren Freight)"]
    assert _found(lines) == [{("person", "Solveig Ravndal")}, {("person", "Solveig Ravndal")}, {("person", "Kofi Tollemark")}]


def test_fields_and_phone_numbers_are_no_part_of_an_address():
    lines = ["'Solveig Ravndal;a.b@example.org;030/23125937;Poplarweg 129, 00776 Uppsala'", "The table names Kofi Ravndal, 98 Poplar Hill Road, 030/23125652."]
    assert _found(lines) == [
        {("person", "Solveig Ravndal"), ("email", "a.b@example.org"), ("phone", "030/23125937"), ("address", "Poplarweg 129, 00776 Uppsala")},
        {("person", "Kofi Ravndal"), ("address", "98 Poplar Hill Road"), ("phone", "030/23125652")},
    ]
    line = "98 Poplar Hill Road, 030/23125652, 12 Oak Lane, Tucson 85701-1234"
    assert [(k, line[a:z].strip(" ,")) for k, a, z in pii._pieces("address", line, 0, len(line))] == [("address", "98 Poplar Hill Road"), ("phone", "030/23125652"), ("address", "12 Oak Lane, Tucson 85701-1234")]


def test_numbers_of_records_and_of_documents():
    assert _found(["KB5037771 was uninstalled again.", "Her passport no. KB2216903 is missing."]) == [set(), {("id_number", "KB2216903")}]


def test_an_initial_is_no_title():
    assert _found(["Bitte Marwin M. Palmgrove unter 030/23125630 anrufen."]) == [{("person", "Marwin M. Palmgrove"), ("phone", "030/23125630")}]
