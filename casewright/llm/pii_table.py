"""The small labelled table the personal-information model is trained from.

Rows are sentences of everyday office mail, mail programs' own lines and
scripts, with their spans marked: ⟦kind|text⟧. They come from sentence patterns
whose slots are filled at random by a fixed seed: usual given and family names
of many countries and family names made up of syllables, street and town names
in use, number formats of several countries. Rows without spans hold what looks
alike and is none: orders, versions, company names, projects, places, headings.
Patterns and fillings come from general usage, not from any data set.
"""

from __future__ import annotations

import random

GIVEN = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Kimberly Emily Kevin Donna Brian Michelle George Carol Edward Amanda Ronald Melissa Hans Peter Klaus Jürgen Wolfgang Uwe Heike Sabine Monika Ursula Anke Jens Stefan Katrin Birgit Jean Pierre Michel Philippe Nathalie Isabelle Catherine Sylvie François Céline Hélène Luc José Antonio Manuel Carmen Ana Luis Javier Pilar Lucía Giovanni Giulia Marco Chiara Lorenzo João Mariana Tiago Ingrid Lars Sven Astrid Mette Søren Piotr Agnieszka Katarzyna Tomáš Jana Ivan Olga Dmitri Natalia Svetlana Ahmed Fatima Mohammed Aisha Omar Leila Mehmet Ayşe Emre Priya Rahul Anjali Vikram Wei Li Jing Min Hiroshi Yuki Kenji Sakura Nguyen Linh Kwame Amina Chidi Zanele Siobhan Declan Rhys Angharad Hamish Eilidh".split()
FAMILY = "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Green Baker Adams Nelson Hill Campbell Mitchell Roberts Carter Phillips Evans Turner Parker Collins Edwards Stewart Morris Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Braun Krüger Dubois Moreau Laurent Lefebvre Bernard Petit Durand Leroy Roux Fournier Girard Rossi Russo Ferrari Esposito Bianchi Romano López González Pérez Sánchez Ramírez Torres Flores Silva Santos Oliveira Pereira Costa Hansen Johansson Andersson Nielsen Jensen Larsen Virtanen Korhonen Novák Kowalski Nowak Wiśniewski Ivanov Petrov Popescu Horváth Nagy Yılmaz Kaya Demir Khan Ali Hussein Patel Sharma Singh Gupta Wang Chen Zhang Liu Kim Park Lee Tanaka Suzuki Sato Tran Pham Okafor Mensah Dlamini Murphy Kelly Byrne Fraser MacLeod Janssen Bakker Visser Dijkstra".split()
#: Family names are also made up: beginning, middle, ending.
_STEMS = "Al Ar Bar Bel Ber Bran Cal Cas Cor Dar Del Dom Dor Ek El Fal Far Fen Fer Gar Gel Gor Grim Hal Har Hel Hol Il Jar Kal Kar Kel Kir Kol Lan Lar Len Lind Lor Mal Mar Mel Mir Mol Nar Nor Ol Or Pal Par Pel Per Ran Ras Ros Sal Sar Sel Sig Sol Stern Tal Tar Tor Ul Val Var Ven Vor Wal Wes Wil Yor Zan Zel".split()
_MIDDLES = ["", "", "", "a", "e", "i", "o", "an", "en", "er", "in", "or", "ov", "ust", "ing", "eck"]
_ENDINGS = "berg mann son sen ov ova ski ska well ton ford field wood worth stein bach burg dorf ström qvist gren lund etti ini elli ucci escu iu ashi moto mura da ez es eira inho oğlu çi akis opoulos idis enko chuk yan ian ema stra ink aert eaux ard ier ault wick by holm dal strand haus wald kamp pour zadeh wala rao nathan".split()
PARTICLES = ["van", "von", "de", "van der", "van den", "del", "di", "da", "dos", "zu", "ten", "bin", "al", "el", "von der", "de la"]
_STREET_STEMS = "Oak Maple Cedar Pine Elm Park Lake Hill River Church School Mill Bridge Castle High Victoria Queen King Albert Market North South West East London York Cambridge Main Broad Long New Green Forest Garden Spring Sunset Highland Washington Franklin Jefferson Lincoln Abbey Manor Stanley Windsor Grove Cherry Walnut".split()
_STREET_KINDS = "Street Road Lane Avenue Drive Court Close Terrace Boulevard Way Place Square Crescent Gardens Walk Hill Park Row Grove Parade View St Rd Ave".split()
_GERMAN_STEMS = "Haupt Schul Garten Dorf Berg Bahnhof Kirch Wald Ring Wiesen Linden Goethe Schiller Mozart Bismarck Friedrich Kaiser König Markt Mühlen Brunnen Rosen Eichen Buchen Park See Feld Schloss".split()
_GERMAN_KINDS = ["straße", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "steig"]
_FRENCH_KINDS = ["rue", "avenue", "boulevard", "quai", "place", "chemin", "allée", "impasse", "cours"]
_FRENCH_NAMES = ["de la République", "Victor Hugo", "Jean Jaurès", "du Général-de-Gaulle", "des Écoles", "de la Gare", "du Château", "des Lilas", "de Paris", "Pasteur", "de l'Église", "Saint-Michel", "des Fleurs", "du Pont-Neuf"]
_SPANISH = ["Calle Mayor", "Calle de Alcalá", "Avenida de América", "Plaza de España", "Calle San Juan", "Paseo de Gracia", "Avenida Constitución", "Calle Real"]
TOWNS = ["London", "Leeds", "Bristol", "York", "Oxford", "Portsmouth", "Newcastle", "Glasgow", "Cardiff", "Milton Keynes", "Upper Norwood", "West Bromwich", "Great Yarmouth", "St Albans", "Boston", "Austin", "Denver", "Portland", "Seattle", "San Diego", "Fort Worth", "Grand Rapids", "Salt Lake City", "Springfield", "Berlin", "Hamburg", "München", "Köln", "Stuttgart", "Freiburg", "Bad Homburg", "Neustadt", "Rosenheim", "Wien", "Zürich", "Paris", "Lyon", "Nantes", "Toulouse", "Saint-Étienne", "Aix-en-Provence", "Le Havre", "Bruxelles", "Madrid", "Sevilla", "Valencia", "Las Palmas"]
DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com", "company.example", "gmail.com", "web.de", "orange.fr", "yahoo.co.uk", "uni-x.edu", "corp.local", "it.firm.org"]
_ORG_WORDS = "Nova Alpha Delta Global United First Pacific Atlantic Summit Pioneer Crown Union Metro Apex Vertex Orion Titan Prime Royal National Northern Central Coastal Golden Silver Clear Bright".split()
_ORG_KINDS = "Bank Logistics Energy Insurance Media Foods Systems Steel Pharma Airlines Motors Textiles Software Consulting Partners Capital Holdings Industries Shipping Telecom Ltd Inc GmbH AG SARL LLC Group Hotels Chemicals Optics Freight Mills Rail Railways Airways Aviation Aerospace Marine Mining Oil Gas Water Electric Electronics Robotics Laboratories Labs Solutions Services Technologies Trading Ventures Estates Properties Construction Engineering Furniture Paper Dairy Farms Bakeries Breweries Works Plastics Ceramics Cement Timber Transport Cargo Couriers Networks Publishing Broadcasting Studios Pictures Records Games Toys Sports Fashion Retail Stores Clinic Health Healthcare Medical Diagnostics Biotech University College Institute Academy Foundation Trust Association Agency Corp Corporation Company plc LLP KG SE BV NV SA SAS AB Tools Bricks Windows Carpets Lighting Interiors Fabrics Shoes Bikes Cables Valves Pumps Seeds Spirits Coffee Tiles Doors Kitchens".split()
#: Kinds of companies that are family names as well.
_ORG_FAMILY = "Mills Banks Glass Farms Press Waters Field Steel Mining Marine Motors".split()
JOBS = ["Sales Manager", "Chief Executive Officer", "Software Engineer", "Head of Finance", "Project Manager", "Office Assistant", "Team Leader", "Director of Marketing", "Legal Counsel", "Security Analyst", "Database Administrator", "Human Resources", "Customer Service Representative", "Senior Consultant", "Support Engineer", "Accountant", "Vice President", "IT Administrator", "Product Owner", "Research Associate", "Mechanical Engineer", "Compliance Officer", "Laboratory Technician", "Tax Examiner", "Internal Auditor", "Purchasing Clerk", "Training Coordinator", "Fraud Investigator", "Financial Controller", "Web Developer", "Solution Architect", "Night Shift Supervisor", "Claims Specialist", "Executive Secretary", "Quality Inspector", "Account Executive", "Data Scientist", "Press Editor", "Travel Agent", "Logistics Planner", "Geschäftsführer", "Leiter Einkauf", "Sachbearbeiterin", "Directrice Commerciale", "Responsable Informatique", "Jefe de Ventas"]
IDWORDS = ["SSN", "social security number", "Social Security No.", "tax ID", "taxpayer number", "TIN", "national ID", "national insurance number", "identity card", "ID card", "ID number", "passport", "passport no.", "passport number", "driving licence", "driver's license", "licence no.", "Soc. Sec. No.", "soc. sec. number", "nat. ins. no.", "tax no.", "pass no.", "personal number", "Steuer-ID", "Steuernummer", "Personalausweis", "Ausweisnummer", "Reisepass", "Führerschein", "numéro fiscal", "carte d'identité", "numéro de passeport", "permis de conduire", "DNI", "NIE", "pasaporte"]
CLOSINGS = ["Best regards", "Kind regards", "Regards", "Thanks", "Many thanks", "Best", "Cheers", "Sincerely", "Yours sincerely", "Mit freundlichen Grüßen", "Viele Grüße", "Beste Grüße", "Cordialement", "Bien à vous", "Saludos", "Un saludo", "Warm regards", "Best wishes", "Bien cordialement", "Saludos cordiales"]
SHORT_CLOSINGS = ["BR", "KR", "Rgds", "Brgds", "Thx", "MfG", "LG", "VG", "Cdt"]
#: Headings in capital letters, lines between mails, and what the system writes around a script.
HEADINGS = ["IMPORTANT NOTICE", "LEGAL NOTICE", "PRIVACY NOTICE", "CONFIDENTIALITY NOTE", "CONFIDENTIALITY NOTICE", "DISCLAIMER", "LEGAL DISCLAIMER", "SECURITY WARNING", "GENERAL INFORMATION", "CONFIDENTIAL", "INTERNAL USE ONLY", "TERMS AND CONDITIONS", "MEETING MINUTES", "WICHTIGER HINWEIS", "VERTRAULICHKEITSHINWEIS", "AVIS IMPORTANT", "AVIS DE CONFIDENTIALITÉ", "AVISO LEGAL", "AVISO DE CONFIDENCIALIDAD"]
DIVIDERS = ["Original Message", "Forwarded message", "Forwarded Message", "Begin forwarded message", "Ursprüngliche Nachricht", "Weitergeleitete Nachricht", "Originalnachricht", "Message d'origine", "Message transféré", "Mensaje original", "Mensaje reenviado", "Messaggio originale", "Messaggio inoltrato", "Mensagem original", "Mensagem encaminhada", "Oorspronkelijk bericht", "Doorgestuurd bericht"]
DAYS, MONTHS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", "Monday", "Tuesday", "Friday"], ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_ADJECTIVES = "Blue Red Green Silver Golden Dark Bright Silent Rapid Open Secure Global Digital Smart New Annual Monthly Weekly Quarterly Internal External Final Updated Remote Shared Central Active Deep High".split()
_NOUNS = "Server Report Office Project Meeting Update Plan Budget Access Review Policy Network Data Center Desk Room Service Team Board Account Security Training Summary Release Schedule Backup Storm Falcon Phoenix Bridge Horizon River Mountain Eagle Lantern Tower Harbor Shield Gate Signal".split()
_THINGS = "report server meeting contract update printer backup budget network order file password mailbox laptop invoice project ticket database account schedule presentation firewall parcel room policy release log script folder router".split()
_DOING = "checked closed sent moved updated reviewed finished opened restarted deleted ordered replaced copied planned postponed approved forgot found".split()
_WHEN = ["today", "yesterday", "tomorrow", "last week", "this morning", "on Monday", "before noon", "next month", "over night", "after the break", "as usual", "again"]

#: {K} identity number with letters that open records as well, {P} person, {R} family name first, {L} small letters, {U} capital letters, {T} title, {S} family name after a title, {F} phone, {I} identity number, {A} address, {E} e-mail; the rest are plain slots.
PATTERNS = (
    # people in sentences
    (2, "{P} will join us at {clock}."), (2, "I had lunch with {P} {when}."), (2, "Could you pass this on to {P}, please?"), (2, "{P} is out of office until {day}."), (2, "Our new colleague {P} starts on {day}."), (2, "The contract was signed by {P} and {P}."), (2, "Thanks to {P} for the quick help."), (2, "cc: {P}"), (2, "Attendees: {P}, {P} and {P}"), (2, "Assigned to {P}"), (3, "Owner: {R}"), (2, "Reported by {U}"), (2, "Prepared for {P} by {P}"), (3, "{R} has been added to the group."), (2, "as discussed with {L} {when}"), (2, "{P} said the {thing} was {doing} {when}."),
    (2, "{T} {S} is expected at {clock}."), (2, "Please welcome {T} {S}."), (2, "We told {T} {S} about the {thing}."), (3, "Dear {T} {S},"), (2, "{T} {S} and {T} {S} have {doing} the {thing}."), (1, "Sehr geehrte Frau {S},"), (1, "Sehr geehrter Herr {S},"), (1, "Herr {S} ruft später zurück."), (1, "Frau {S} hat den Vertrag unterschrieben."), (1, "Monsieur {S} rappellera demain."), (1, "Madame {S} a signé le contrat."), (1, "El señor {S} llamará más tarde."), (2, "{P} ist bis Freitag im Urlaub."), (1, "Ich habe mit {P} gesprochen."), (1, "Bitte leiten Sie das an {P} weiter."), (1, "Ansprechpartner: {P}, {F}"), (1, "J'ai parlé avec {P} ce matin."), (1, "{P} est en congé."), (1, "Hablé con {P} esta mañana."), (1, "Contact : {P}, {F}"), (2, "the laptop of {P} ({E}) was {doing} {when}"), (2, "Interviews: {R}; {R}; {P}"), (2, "{P}, {P} und {P} nehmen teil."), (1, "happy birthday to {L}!"), (1, "{U} ARRIVED {when}"), (2, "Who is {P}? Is {P} with {org}?"),
    (2, "Bitte {P} zurückrufen."), (2, "Bitte {P} Bescheid geben ({F})."), (1, "Rückfragen bitte an {P} unter {F}."), (1, "Bitte {T} {S} benachrichtigen."), (2, "Merci de contacter {P} ({F})."), (1, "Prière d'appeler {P} au {F}."), (1, "Favor de avisar a {P} ({F})."), (2, "Please phone {P} ({F})."), (2, "Try {F} or {F}."), (2, "{F} is busy {when}."), (2, "The switchboard has the number {F}."), (1, "Voicemail: {F}"), (2, "the {thing} desk ({F}) answers {when}"), (1, "Handy {F}"), (1, "Portable : {F}"), (1, "Teléfono: {F}"), (2, "Leave word at {F} {when}."), (2, "$mobile = '{F}'"), (1, "$user.MobilePhone = '{F}'"), (2, "My successor is {P}, available on {F}."), (2, "Our contact there is {P}, {F}."), (3, "{R} is named as the owner of the {thing}."), (2, "{R} was a witness."), (2, "{R} has signed in the register."),
    # phones, mail and street addresses
    (3, "My new number is {F}."), (3, "You can reach {P} at {F}."), (2, "Call me on {F} {when}."), (2, "Phone: {F}"), (2, "Tel: {F}"), (2, "Mobile {F}"), (2, "M: {F} | E: {E}"), (2, "Fax {F}"), (1, "Sie erreichen mich unter {F}."), (1, "Telefon {F} oder {E}"), (1, "Vous pouvez me joindre au {F}."), (1, "Llámame al {F}."), (2, "{P}: {F}, {E}"), (2, "text {F} or mail {E}"), (2, "Please mail the {thing} to {E}."), (2, "My address has changed to {E}"), (2, "{E} bounced, try {E}"), (1, "{E}"), (1, "{F}"),
    (3, "We moved to {A}."), (2, "Visit us at {A}."), (2, "Please ship the {thing} to {P}, {A}."), (2, "{A}"), (2, "{P}, {A}"), (2, "{P} lives at {A}, phone {F}."), (2, "The office at {A} is closed {when}."), (1, "Meine neue Adresse ist {A}."), (1, "Wir wohnen in der {A}."), (1, "Mon adresse : {A}."), (1, "J'habite {A}."), (1, "Mi dirección es {A}."), (2, "Address: {A}"), (1, "Anschrift: {A}"), (1, "Adresse : {A}"), (2, "The parcel for {A} was returned."),
    # identity numbers
    (4, "{idword}: {I}"), (4, "The {idword} is {I}."), (3, "My {idword} is {I}, please keep it safe."), (3, "{P}, {idword} {I}, has applied."), (3, "Please verify {idword} {I} {when}."), (2, "{idword} of {P}: {I}"), (2, "copy of the {idword} ({I}) attached"), (1, "Die {idword} lautet {I}."), (1, "Seine {idword} {I} ist abgelaufen."), (1, "Le {idword} est {I}."), (1, "Mi {idword} es {I}."), (2, "{T} {S} gave the {idword} {I} and the phone number {F}."), (2, "name {P}, born {date}, {idword} {I}"), (3, "The {idword} {I} was {doing} {when}."), (2, "I have a copy of the {idword} of {P}: {I}"), (1, "{idword} of {P}: {K}"), (2, "{idword}: {K}"), (2, "{idword} no. {K} of {P} has expired"), (1, "My {idword} is {K}."),
    (3, "{P}, {A}, {F}"), (2, "Name: {P}, address: {A}, phone: {F}"), (2, "{P} / {I} / {F} / {E}"), (2, "{A}; {F}; {E}"), (2, "Guest list: {P}, {F}; {P}, {F}"), (2, "{P} of {A} can be called at {F} {when}."), (2, "The {thing} names {P}, {A}, {F}."), (2, "Entries: {P}, {A}, {F}; {P}, {A}, {F}"), (2, "'{P};{E};{F};{A}'"), (1, "{P},{E},{F},\"{A}\""), (1, "{P}|{F}|{A}"), (2, "{P}|{I}|{F}|{A}"), (2, "{P};{F};{I};{E}"), (1, "'{P}','{F}','{I}'"), (2, "{P} showed the {idword} ({I})."), (2, "The {idword} ({I}) was {doing}."),
    # lines that mail programs write
    (4, "From: {R} <{E}>"), (2, "From: {P} <{E}>"), (2, "To: {P} <{E}>; {R} <{E}>"), (1, "Cc: {E}"), (1, "Von: {P} <{E}>"), (1, "An: {R}"), (1, "De : {P} <{E}>"), (1, "À : {E}"), (1, "De: {P} <{E}>"), (1, "Para: {E}"), (1, "Subject: {head}"), (1, "Betreff: {head}"), (1, "Objet : {head}"), (1, "Date: {day}, {n2} {month} 20{n2} {clock}"), (1, "Sent: {date} {clock}"), (3, "On {day}, {month} {n2}, 20{n2} at {clock} {P} <{E}> wrote:"), (2, "On {date}, {P} wrote:"), (2, "Am {date} um {clock} schrieb {P} <{E}>:"), (1, "Am {date} schrieb {P}:"), (2, "Am {date} um {clock} schrieb {P}:"), (2, "Le {date} à {clock}, {P} a écrit :"), (1, "El {date} a las {clock}, {P} escribió:"), (1, "<{E}> wrote:"), (1, "-----Original Message-----"), (1, "---------- Forwarded message ---------"), (4, "{divider}"),
    # closings and signatures
    (16, "{P}"), (2, "{P} | {job}"), (2, "{P}, {job}"), (1, "{P} - {org}"), (2, "{job}"), (2, "{job}, {org}"), (2, "{org}"), (2, "{org}, {A}"), (2, "{org} | {A} | {F}"), (2, "{closing},"), (2, "{closing}, {given}"), (2, "{closing} {given}"), (2, "{given}"), (2, "Hi {given},"), (1, "Hello {given},"), (1, "Hallo {given},"), (1, "Bonjour {given},"), (1, "Hola {given}:"), (1, "Hi all,"), (1, "Dear colleagues,"), (1, "Sent from my phone"),
    (2, "{job}, {org}"), (2, "| {org} | {A}"), (3, "{org} | {A}"), (1, "{org}, {F}"), (1, "{org} - {A}"), (2, "| {job}, {org}"), (1, "{given}, {job}, {org}"), (2, "{closing} {given}"), (4, "{short} {given}"), (8, "{short} {P}"), (2, "{closing} {P}"), (1, "{closing}, {P}"), (1, "{short}, {given}"), (1, "{short}"), (2, "Head office: {org}, company number {n8}."), (1, "{org}, VAT no. {n9}, {A}"), (1, "Registered office: {org}, {A}"), (1, "Sitz der Gesellschaft: {org}, {town}"), (1, "Siège social : {org}, {A}"), (2, "The opinions of the writer are not those of {org}."), (1, "{org} is not liable for the content of this message."), (1, "This message was not sent on behalf of {org}."), (1, "All rights reserved, {org} 20{n2}"), (4, "{heading}"), (4, "{heading}: this message may hold private information."), (2, "{heading}: please read the {thing} {when}."), (1, "{heading} {UP} {UP}"),
    # scripts
    (3, "# Author: {P}"), (2, "# Author: {P} <{E}>"), (2, "# Contact {given} {F}"), (2, "## maintained by {R} {when}"), (2, "$user = '{P}'"), (2, "$manager = \"{R}\""), (2, "$owner = '{L}'"), (2, "$approver = '{L}'"), (1, "name={L}"), (2, "$phone = \"{F}\""), (2, "$ssn = '{I}'"), (2, "$person = @{{ FullName = '{P}'; Passport = '{I}' }}"), (2, "[pscustomobject]@{{Name='{P}';Phone='{F}';Address='{A}'}}"), (2, "Set-ADUser {account} -DisplayName \"{R}\" -OfficePhone \"{F}\" -StreetAddress \"{A}\""), (2, "Send-MailMessage -From {E} -To {E} -Subject \"{head}\""), (1, "\"{P}\",\"{E}\",\"{I}\",\"{A}\""), (1, "{P};{I};{F}"), (2, "Write-Host 'checking {idword} {I}'"), (2, "<# for {P}, {A} #>"), (1, "$title = '{job}'"), (1, "$company = '{org}'"), (1, "$team = '{pair}'"), (1, "Remove-ADUser -Identity {account}"), (1, "$login = '{account}'"),
    (4, "Creating Scriptblock text ({n1} of {n1}):"), (2, "ScriptBlock ID: {guid}"), (1, "Path: C:\\Scripts\\run.ps1"), (1, "Engine state is changed from None to Available."), (1, "Provider Registry is Started."), (1, "Starting Windows PowerShell"), (1, "Executing Pipeline, Host Application = powershell.exe"), (1, "Context: Severity = Informational, Host Name = ConsoleHost"), (1, "Completed invocation of ScriptBlock ID: {guid}"), (1, "Loading {pair} module ({n1} of {n2})"), (1, "Checking {pair} ..."), (1, "Running {pair} task {n2}"), (1, "Processing {pair} ({n1} of {n2})"),
    # numbers that are no one's
    (2, "Order {num} was shipped {when}."), (2, "Invoice no. {num} is due on {date}."), (2, "Ticket #{num} was {doing}."), (2, "Your tracking number is {num}."), (2, "Case {num} is still open."), (2, "Version {ver} was released, build {n4}."), (2, "serial number {num}"), (1, "part {num}, quantity {n2}"), (2, "The {thing} has {n4} entries between {clock} and {clock}."), (1, "Die Rechnung {num} wurde {when} bezahlt."), (1, "Bestellung {num} ist unterwegs."), (1, "La facture {num} est payée."), (1, "El pedido {num} ha llegado."), (1, "error 0x{hex} at port {n4}"), (2, "The hash {hex} was {doing}."), (1, "md5 {hex}{hex}{hex}{hex}"), (1, "commit {hex}"), (2, "The checksum begins with {z8}."), (1, "serial {z8} of the {thing}"), (1, "counter at {z6}"), (1, "record {z8} was {doing}"), (2, "The {thing} has {n2} {pair} entries."), (1, "{n2} Day {pair} Plan"), (2, "{ip} answered after {n3} ms"), (1, "ping {ip} -n {n2}"), (2, "SID S-1-5-21-{n9}-{n9}-{n4}"), (2, "guid {guid}"), (1, "room {n3}, floor {n1}"), (1, "change request CHG{n6} {n2}"), (1, "Meeting ID: {n3} {n3} {n4}"), (1, "parcel {n4} {n4} {n4}"), (1, "KB{n6} was installed on {host}."), (2, "KB{n7} was removed {when}."), (1, "Build {n5}.{n3} needs KB{n7}."), (1, "$size = {n6}"), (1, "Start-Sleep -Seconds {n2}"), (1, "company no. {n8}, registered in {town}"), (1, "The {thing} number {n3}-{n4} belongs to {org}."),
    # capital letters that are no one's
    (3, "The {pair} starts {when}."), (3, "{pair}"), (2, "Re: {pair} {n2}"), (2, "Project {pair} was {doing} {when}."), (2, "{org} has {doing} the {thing}."), (2, "The {org} contract and the {pair} were {doing}."), (2, "Windows Server, Visual Studio and Google Chrome were {doing}."), (2, "We open offices in {town} and New York."), (1, "See you in {town}, {given}."), (1, "Microsoft Word and Adobe Reader crash {when}."), (1, "Domain Admins and Remote Desktop Users were {doing}."), (1, "Das Team {pair} hat den Server neu gestartet."), (1, "Le projet {pair} avance bien."), (1, "$name = '{pair}'"), (1, "# {pair} script"), (1, "{given} has {doing} the {thing}."), (1, "Ask {given} or {given} about the {thing}."), (1, "THE {UP} {UP} IS DOWN"), (1, "log in as {account} on {host}"), (1, "Notepad Plus, Task Manager, Event Viewer"), (2, "Only {pair} and {org} may read this message."), (1, "Good Morning everyone, Happy New Year!"),
    # other lines
    (4, "The {thing} was {doing} {when}."), (4, "I {doing} the {thing} and the {thing} {when}, so the {thing} should be fine."), (2, "Can you have a look at the {thing}?"), (2, "Please find the {thing} attached."), (1, "Wir haben den Fehler gefunden und beheben ihn morgen."), (1, "Können Sie mir bitte die Datei noch einmal schicken?"), (1, "Nous avons bien reçu votre demande."), (1, "Pouvez-vous m'envoyer le fichier ?"), (1, "El informe está listo para revisar."),
    (1, "Sollten Sie nicht der richtige Empfänger sein, löschen Sie bitte diese Mail."), (2, "Falls Sie diese E-Mail irrtümlich erhalten haben, benachrichtigen Sie bitte den Absender."), (1, "Wer die Unterlagen versehentlich erhält, schickt sie bitte zurück."), (1, "Jede unbefugte Weitergabe ist untersagt, auch wenn sie fälschlich genehmigt wurde."), (1, "Falls das Paket morgen nicht kommt, rufen wir noch einmal an."), (1, "Wir wissen noch nicht, wann der Drucker repariert wird."), (1, "Das Protokoll wurde gestern verschickt, die Anlage fehlt aber."), (1, "Wer zuletzt geht, schließt bitte das Fenster."), (1, "Die Sitzung fällt aus, weil der Raum belegt ist."), (1, "Merci de ne pas imprimer ce message sans raison."), (1, "Nous attendons toujours la réponse du service comptable."), (1, "La salle est fermée pour le reste de la semaine."), (1, "Le rapport sera prêt sur le bureau demain matin."), (1, "Si vous avez reçu ce courriel par erreur, veuillez nous prévenir."), (1, "On a remplacé le câble, mais la panne est restée."), (1, "La impresora está rota desde ayer."), (1, "Si no es el destinatario, borre este correo y avise al remitente."), (1, "El servidor sigue apagado por ahora."), (1, "Gracias por enviar la copia del contrato."), (1, "La riunione è stata spostata a domani."), (1, "Se avete ricevuto questa mail per errore, cancellatela."), (1, "De vergadering gaat vandaag niet door."), (1, "Als u dit bericht ten onrechte hebt ontvangen, gooi het dan weg."), (1, "if you were not meant to get this, please delete it and tell us"), (1, "we keep the old machine offline until it has been checked"),
    (2, "Get-ChildItem -Path C:\\Temp -Recurse | Where-Object {{ $_.Length -gt {n6} }}"), (2, "Import-Module ActiveDirectory"), (1, "foreach ($item in $list) {{ Write-Output $item.Name }}"), (1, "Invoke-WebRequest http://{ip}/file{n2} -OutFile $env:TEMP\\a.exe"), (1, "if ($null -eq $result) {{ return }}"), (1, "New-Item -Path 'HKLM:\\Software\\App' -Force"), (1, "try {{ Stop-Service spooler }} catch {{ }}"), (1, "$date = Get-Date -Format 'yyyy-MM-dd'"), (2, "This e-mail is confidential and intended for the recipient only."), (1, "Diese E-Mail enthält vertrauliche Informationen."), (1, "Ce message est confidentiel."), (1, "Please consider the environment before printing."), (1, "{ip} - - [{date}:{clock}] GET /index.html 200 {n4}"),
)


def _made_up(r: random.Random) -> str:
    return r.choice(_STEMS) + r.choice(_MIDDLES) + r.choice(_ENDINGS)


def person_parts(r: random.Random, given: list[str], family: list[str], made_up: float = 0.5) -> tuple[str, str]:
    """A given name, maybe double or with an initial, and a family name, maybe with a particle or a second part."""
    g, f = r.choice(given), r.choice(family)
    x = r.random()
    if x < made_up:
        f = _made_up(r)
        if r.random() < 0.3:
            g = r.choice(_STEMS) + r.choice(["a", "o", "e", "in", "us", "ia", "y", "ek", "el", "ine"])
    if r.random() < 0.02:
        f = r.choice(_ORG_FAMILY)
    if r.random() < 0.08:
        g += "-" + r.choice(given)
    if r.random() < 0.06:
        f = r.choice(["O'", "Mc", "D'"]) + f
    if r.random() < 0.05:
        f += "-" + r.choice(family)
    if r.random() < 0.15:
        f = r.choice(PARTICLES) + " " + f
    if r.random() < 0.12:
        g += f" {r.choice('ABCDEFGHIJKLMNOPRSTUVWXYZ')}."
    return g, f


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def phone(r: random.Random) -> str:
    """A number with or without country code, grouped at random."""
    sep = r.choice([" ", "-", ".", " ", ""])
    cc = r.choice(["1", "44", "49", "33", "34", "39", "31", "41", "43", "46", "90", "91", "81", "86", "351"])
    groups = [_digits(r, n) for n in r.choice([(3, 3, 4), (2, 4, 4), (1, 2, 2, 2, 2), (3, 4, 4), (2, 8), (3, 3, 3), (3, 6), (2, 3, 2, 2)])]
    form = r.random()
    if form < 0.5:
        return r.choice(["+", "+", "00"]) + cc + r.choice([" ", "-", sep]) + sep.join(groups)
    if form < 0.62:
        return f"+{cc} (0){groups[0]}" + (sep or " ") + sep.join(groups[1:])
    if form < 0.75:
        return f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}"
    if form < 0.85:
        return f"0{_digits(r, r.choice([2, 3, 4]))}{r.choice(['/', ' ', '-'])}{_digits(r, r.choice([5, 6, 7, 8]))}"
    return r.choice([f"0{_digits(r, 2)}{sep}{_digits(r, 4)}{sep}{_digits(r, 4)}", f"0{_digits(r, 1)}{sep}{sep.join(_digits(r, 2) for _ in range(4))}" if sep else f"0{_digits(r, 9)}", f"{_digits(r, 3)}{sep or '-'}{_digits(r, 3)}{sep or '-'}{_digits(r, 4)}"])


def identity(r: random.Random) -> str:
    """A number in the form of an authority of some country; some begin with noughts."""
    noughts = r.random() < 0.06
    d = lambda n: "00" + _digits(r, n - 2) if noughts and n > 2 else _digits(r, n)
    up = "ABCDEFGHJKLMNPRSTUVWXYZ"
    c = lambda n: "".join(r.choice(up) for _ in range(n))
    day = f"{r.randint(1, 28):02}"
    month, year = f"{r.randint(1, 12):02}", f"{r.randint(40, 99)}"
    return r.choice([
        f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(2)}-{d(7)}", f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}", f"{c(2)}{d(6)}{c(1)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{d(2)}/{d(3)}/{d(5)}", f"{year}{month}{day}-{d(4)}", f"19{year}{month}{day}-{d(4)}", f"{day}{month}{year}-{d(4)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(9)}",
        f"{c(1)}{d(8)}", f"{c(2)}{d(7)}", f"{c(1)}{d(2)}{c(2)}{d(4)}", f"{c(5)}{d(6)}{c(2)}{d(1)}{c(2)}", f"{c(5)}{d(6)}{c(1)}{d(1)}{c(2)}", f"{d(8)}{c(1)}", f"{d(8)}-{c(1)}", f"{c(1)}{d(7)}{c(1)}", f"{r.randint(1, 2)} {year} {month} {d(2)} {d(3)} {d(3)} {d(2)}", f"{c(6)}{d(2)}{c(1)}{d(2)}{c(1)}{d(3)}{c(1)}",
    ])


def address(r: random.Random, towns: list[str] | None = None, stems: list[str] | None = None) -> str:
    """Street and number, mostly with unit, postcode or town."""
    town = r.choice(towns or TOWNS)
    if not towns and r.random() < 0.4:
        town = r.choice(["", "", "", "Port ", "New ", "Fort ", "Mount ", "Lake ", "Grand ", "Saint-", "Bad ", "East "]) + _made_up(r) + r.choice(["", "", "", "", " Falls", " Springs", "-sur-Mer"])
    no = str(r.randint(1, 300 if r.random() < 0.75 else 9)) + (r.choice("abcABC") if r.random() < 0.12 else "")
    kind = r.random()
    if kind < 0.55:
        stem = r.choice(stems or _STREET_STEMS) if r.random() < 0.7 else _made_up(r)
        street = stem + (" " + r.choice(["Mill", "Park", "Hill", "Bridge", "House"]) if r.random() < 0.15 else "") + " " + r.choice(_STREET_KINDS)
        unit = f", {r.choice(['Apt', 'Unit', 'Flat', 'Suite', 'Apartment', 'Floor'])} {r.randint(1, 90)}{r.choice(['', '', 'B', 'C'])}" if r.random() < 0.2 else ""
        code = r.choice([f" {r.choice(['SW', 'N', 'LS', 'M', 'EH', 'B', 'CB'])}{r.randint(1, 28)} {r.randint(0, 9)}{r.choice('ABDEFHJLNPQRSTUWXYZ')}{r.choice('ABDEFHJLNPQRSTUWXYZ')}", f", {r.choice(['TX', 'NY', 'CA', 'WA', 'OH', 'IL'])} {_digits(r, 5)}", f" {_digits(r, 5)}", ""])
        rest = "" if r.random() < 0.22 else f", {town}{code}"
        return f"{no} {street}{unit}{rest}"
    if kind < 0.78:
        street = r.choice([r.choice(_GERMAN_STEMS) + r.choice(_GERMAN_KINDS), r.choice(["Am", "An der", "Im", "Zum"]) + " " + (r.choice(_GERMAN_STEMS) + r.choice(["berg", "tor", "hof", "feld", "wall", "graben"])), r.choice(GIVEN) + "-" + r.choice(FAMILY) + "-Straße", _made_up(r).lower().capitalize() + r.choice(_GERMAN_KINDS)])
        return f"{street} {no}" + ("" if r.random() < 0.15 else f", {_digits(r, 5)} {town}")
    if kind < 0.93:
        return f"{no}{r.choice([',', '', ' bis,'])} {r.choice(_FRENCH_KINDS)} {r.choice([*_FRENCH_NAMES, 'des ' + _made_up(r) + 's', 'du ' + _made_up(r)])}" + ("" if r.random() < 0.15 else f", {_digits(r, 5)} {town}")
    return f"{r.choice(_SPANISH)}{r.choice([' ', ', '])}{no}" + ("" if r.random() < 0.15 else f", {_digits(r, 5)} {town}")


def email(r: random.Random, given: list[str], family: list[str]) -> str:
    """An address of a person or post, sometimes disguised."""
    g, f, dom = r.choice(given).lower(), r.choice(family).lower(), r.choice(DOMAINS)
    local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{g}_{f}", f"{f}{r.randint(1, 99)}", f"{g[0]}.{f}+news", r.choice(["info", "sales", "support", "office"])])
    form = r.random()
    if form < 0.08:
        return f"{local} [at] {dom.replace('.', ' [dot] ')}"
    if form < 0.14:
        return f"{local}{r.choice(['(at)', '[at]', ' (at) '])}{dom}"
    if form < 0.18:
        return f"{local} at {dom.replace('.', ' dot ')}"
    return f"{local}@{dom}".title() if form < 0.26 else f"{local}@{dom}"


def filled(pattern: str, r: random.Random, given: list[str], family: list[str], towns: list[str] | None = None, stems: list[str] | None = None) -> str:
    """A pattern with its slots filled and its spans marked."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(("{{", "}}"), i):
            out.append(pattern[i])
            i += 2
        elif pattern[i] == "{":
            z = pattern.index("}", i)
            out.append(_slot(r, pattern[i + 1 : z], given, family, towns, stems))
            i = z + 1
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def labelled_rows(copies: int = 6, seed: int = 20240607) -> list[str]:
    """The table: each pattern filled ``copies`` times its weight, spans as ⟦kind|text⟧; quoted lines and lines of two sentences besides."""
    r = random.Random(seed)
    rows = [filled(pattern, r, GIVEN, FAMILY) for weight, pattern in PATTERNS for _ in range(copies * weight)]
    sentences = [x for x in rows if x.endswith((".", "?"))]
    pairs = [f"{r.choice(sentences)} {r.choice(sentences)}" for _ in range(60 * copies)]
    quoted = [r.choice(["> ", ">", "> > ", "| ", "# ", "- "]) + r.choice(rows) for _ in range(40 * copies)]
    return rows + pairs + quoted


def _slot(r: random.Random, name: str, given: list[str], family: list[str], towns: list[str] | None, stems: list[str] | None) -> str:
    if name in ("P", "R", "L", "S", "U"):
        g, f = person_parts(r, given, family)
        both, turned = f"{g} {f}", r.choice([f"{f}, {g}", f"{f.upper()}, {g}", f"{f.upper()} {g}", f"{f} {g}"])
        text = {"S": f, "L": both.lower(), "U": both.upper(), "R": turned if r.random() < 0.8 else both}.get(name) or (both.upper() if r.random() < 0.04 else both.lower() if r.random() < 0.04 else turned if r.random() < 0.06 else both)
        return f"⟦person|{text}⟧"
    if name == "F":
        return f"⟦phone|{phone(r)}⟧"
    if name == "I":
        return f"⟦id_number|{identity(r)}⟧"
    if name == "K":
        return f"⟦id_number|{r.choice(['KB', 'PO', 'SR', 'MS', 'ID', 'RE', 'PS', 'ER'])}{_digits(r, 7)}⟧"
    if name == "A":
        return f"⟦address|{address(r, towns, stems)}⟧"
    if name == "E":
        return f"⟦email|{email(r, given, family)}⟧"
    if name[0] == "z":
        return "00" + _digits(r, int(name[1:]) - 2)
    if name[0] == "n" and name[1:].isdigit():
        return str(r.randint(1, 9)) + _digits(r, int(name[1:]) - 1)
    plain = {
        "T": lambda: r.choice(["Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Dr.", "Dr", "Prof.", "Miss", "Prof. Dr."]), "idword": lambda: r.choice(IDWORDS), "day": lambda: r.choice(DAYS), "month": lambda: r.choice(MONTHS), "job": lambda: r.choice(JOBS), "closing": lambda: r.choice(CLOSINGS), "short": lambda: r.choice(SHORT_CLOSINGS), "given": lambda: r.choice(given), "town": lambda: r.choice(towns or TOWNS),
        "org": lambda: r.choice([f"{r.choice(_ORG_WORDS)} {r.choice(_ORG_KINDS)}", f"{r.choice(family)} {r.choice(_ORG_KINDS)}", f"{_made_up(r)} {r.choice(_ORG_KINDS)}", f"{r.choice(family)} & {r.choice(['Sons', 'Partners', 'Co.'])}"]),
        "pair": lambda: " ".join([r.choice(_ADJECTIVES), *r.sample(_NOUNS, r.choice([1, 1, 2]))]) if r.random() < 0.7 else " ".join(r.sample(_NOUNS, 2)), "head": lambda: r.choice(["", "Re: ", "RE: ", "AW: ", "Fwd: "]) + f"{r.choice(_ADJECTIVES)} {r.choice(_THINGS)}", "heading": lambda: r.choice(HEADINGS), "divider": lambda: f"{(d := r.choice(['-', '=', '_', '*']) * r.randint(3, 12))}{(b := r.choice(['', ' ']))}{r.choice(DIVIDERS)}{r.choice(['', ':']) if not b else ''}{b}{d}", "UP": lambda: r.choice(_NOUNS).upper(), "thing": lambda: r.choice(_THINGS), "doing": lambda: r.choice(_DOING), "when": lambda: r.choice(_WHEN),
        "date": lambda: r.choice([f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.20{_digits(r, 2)}", f"{r.randint(1, 12):02}/{r.randint(1, 28):02}/20{_digits(r, 2)}", f"20{_digits(r, 2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"]), "clock": lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}" + r.choice(["", "", " AM", " PM"]), "ip": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)), "hex": lambda: f"{r.getrandbits(32):08x}", "guid": lambda: "-".join(f"{r.getrandbits(4 * n):0{n}x}" for n in (8, 4, 4, 4, 12)),
        "account": lambda: r.choice([f"{r.choice(given).lower()}.{r.choice(family).lower()}", f"{r.choice(given)[0].lower()}{r.choice(family).lower()}", f"svc_{r.choice(_THINGS)}"]), "host": lambda: r.choice(["SRV", "PC", "NB", "DC", "WEB"]) + r.choice(["-", ""]) + r.choice(["", "LON-", "A"]) + _digits(r, r.choice([2, 3, 4])), "ver": lambda: ".".join(str(r.randint(0, 40)) for _ in range(r.choice([2, 3, 4]))),
        "num": lambda: r.choice([_digits(r, r.choice([5, 6, 7, 8, 10])), f"{_digits(r, 3)}-{_digits(r, r.choice([3, 4, 5]))}", f"{r.choice(['INV', 'PO', 'SR', 'RMA', 'INC', 'KB', 'CHG', 'REF'])}{r.choice(['', '-'])}{_digits(r, r.choice([5, 6, 7, 8]))}", f"20{_digits(r, 2)}-{_digits(r, r.choice([3, 4, 5]))}-{_digits(r, 4)}", f"{_digits(r, 2)}-{_digits(r, 4)}-{_digits(r, 5)}", f"{_digits(r, 4)}/{_digits(r, 4)}"]),
    }
    return plain[name]()
