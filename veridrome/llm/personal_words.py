"""Fixed values of the personal-data detectors: names, titles, street words, labels."""

#: Given names of many countries, in lower case without marks.
GIVEN = (
    "aiko amara anna beatriz bjorn chloe colette dario elif emeka felix greta henrik inigo ines jorge kenji kwame leonie lucia marta mireille niamh nora oskar pavel ravi samir sunita tomas yusuf zofia "
    "adam ahmed aisha alan albert alejandro alex alexander alice ali amelie amir ana andrea andreas andrew angela anil antonio arjun astrid ayse barbara benjamin bernard boris brian bruno camille carla carlos carmen caroline cecile charlotte "
    "chen christian christina claire clara claudia daniel david deepak diana diego dimitri dmitri dominique dorothea edward elena elizabeth ella emil emily emma erik esther eva fatima fatma fernando fiona florian francesca francois frank freya gabriel george georg giovanni giulia grace gustav hanna hannah hans hassan heidi helen hiroshi hugo "
    "ibrahim igor ingrid irina isabel isabella ivan jack jacques jakob james jan jane javier jean jennifer jens joao johan johanna john jonas jose josef juan julia julie karim karin karl katarina kemal klaus kofi lars laura lea lena leon lin linda lisa louise luca lucas luis magnus mai maria marie mario mark markus martin mary mateo matteo max mehmet mei michael miguel mohamed monika nadia natalia nikola nils noah olga oliver olivia omar pablo paolo patricia paul pedro peter petra philip pierre priya rachel rafael rahul rania robert rosa ruth sanjay sara sarah sergei simon sofia sophie stefan susan sven takashi tariq teresa thomas ursula victor wei william yuki"
).split()
#: Forms of address that stand before a name.
TITLES = "mr mrs ms miss mx dr prof professor doctor sir madam herr frau mme mlle madame monsieur sr sra srta señor señora señorita don doña dott ing".split()
#: What announces a name.
CUES = (
    r"my name is", r"i am called", r"ich hei(?:ß|ss)e", r"je m['’]appelle", r"me llamo", r"mi nombre es", r"typed by", r"signed by", r"signed,", r"spoke to", r"spoke with", r"complaint of", r"sent to", r"please call", r"new tenant:", r"tenant:", r"patient", r"witness", r"applicant", r"owner[=:]", r"from:", r"contact:", r"reviewer note:", r"according to", r"pregunte por", r"le dossier de", r"mi hermana", r"mi hermano", r"last month",
)
#: Words of which every announcement has one.
CUE_WORDS = "name heiße heisse called appelle llamo nombre typed signed spoke complaint sent please tenant patient witness applicant owner from contact note according pregunte dossier hermana hermano last".split()
#: Words that open sentences or name things and so are no surname.
NO_SURNAME = (
    "the a an in no only each after before under when if it its two several please guidance records members staff costs for a decision version build order ticket invoice score step batch window user agent her his our their my home delivery dear refund last new this that these those and or but with without from contact signed applicant witness patient reviewer note according somebody mailbox reply fwd re is was were the toolkit scanner street road avenue lane close court drive terrace way place "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday gdpr hipaa ccpa lgpd coppa ferpa glba flat suite unit apartment who what where which while because since confirmed wrote said gave asked had has have lives vive wohnt und oder der die das mentionne para por und y et est en"
).split()
STREET = "street st road rd avenue ave lane ln drive dr close court ct terrace way place pl square sq crescent boulevard blvd row walk gardens grove hill mews parade quay".split()
#: Before a number: what makes it something else than personal data.
THINGS = r"(?:invoice|order|ticket|case|cases|lots?|step|batch|window|build|version|score|room code|code|ref(?:erence)?|article|section|paragraph|no\. of|rechnung|auftrag|facture|commande|factura|pedido|standard|form|host|port|sku|item|serial|batch)"
#: Labels near numbers that have no form of their own.
LABELS = r"(?:ssn|social security|sozialversicherung|s[ée]curit[ée] sociale|seguridad social|passport|passeport|pasaporte|reisepass|tax|steuer|fiscal|fiscale|ein|tin|nif|nie|dni|driving licen[cs]e|f[üu]hrerschein|permis de conduire|carn[ée] de conducir)"
#: Digits as words, by language.
DIGITS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
} | {"oh": "0", "zwo": "2", "fuenf": "5"}
#: Words for the at sign, each with the words for the dot that go with it.
AT_DOT = {"at": ("dot", "punkt"), "ät": ("punkt",), "arroba": ("punto",), "arobase": ("point",)}
#: Words before and behind a person's name, and words that end or begin the names of offices, places and things.
BEFORE_PERSON = (
    "contact ask call phone email write tell told names named meet met by with from for to of and dear hello hi name called colleague neighbour manager tenant witness patient client customer applicant owner "
    "frau herr kollege kollegin von mit an bei madame monsieur par avec chez de señor señora por con"
).split()
BEHIND_PERSON = (
    "wrote writes said says asked asks told called calls confirmed confirms lives lived signed phoned replied explained mentioned complained reported insisted wants wanted works worked moved asked as "
    "schrieb sagte fragte wohnt bestätigte rief meint arbeitet écrit dit habite confirme demande escribió dijo vive llamó confirmó pide trabaja"
).split()
NO_PERSON = (
    "authority office board commission council agency registry desk unit team service inspectorate bureau review panel body court ministry department committee institute university school college hospital clinic bank company ltd inc gmbh group society union press gazette bulletin monitor watch "
    "road street lane avenue square quay bridge park port bay heights vale valley upper lower north south east west new old saint st mount lake river island city town village county hill hall house mill harbour station centre center "
    "plan form policy notice report register act code law rule rules section article annex order list guide toolkit scanner system programme program project version data privacy health safety general national public federal united european international red green blue black white grey gray"
).split()
