"""Word lists and patterns of the Swedish rules, as fixed values that results depend on. Patterns are Java regular
expressions and are used with the flags (?iuU), so letters fold and word borders work beyond ASCII."""

FLAGS = "(?iuU)"

# Abbreviations of organisations and what they stand for.
ABBREVIATIONS = {
    "SKR": "Sveriges Kommuner och Regioner",
    "MSB": "Myndigheten för samhällsskydd och beredskap",
    "FRA": "Försvarets radioanstalt",
    "FOI": "Totalförsvarets forskningsinstitut",
    "SCB": "Statistiska centralbyrån",
    "FMV": "Försvarets materielverk",
    "ISP": "Inspektionen för strategiska produkter",
    "SBU": "Statens beredning för medicinsk och social utvärdering",
    "IVO": "Inspektionen för vård och omsorg",
    "TLV": "Tandvårds- och läkemedelsförmånsverket",
    "ESV": "Ekonomistyrningsverket",
    "ESF": "Europeiska socialfonden",
    "HaV": "Havs- och vattenmyndigheten",
    "SGU": "Sveriges geologiska undersökning",
    "PRV": "Patent- och registreringsverket",
    "PTS": "Post- och telestyrelsen",
    "KTH": "Kungliga Tekniska högskolan",
    "IMY": "Integritetsskyddsmyndigheten",
    "IVL": "IVL Svenska Miljöinstitutet",
    "RFSL": "Riksförbundet för homosexuellas, bisexuellas, transpersoners, queeras och intersexpersoners rättigheter",
    "SMHI": "Sveriges meteorologiska och hydrologiska institut",
    "WWF": "Världsnaturfonden",
    "SEKO": "Service- och kommunikationsfacket",
    "SIS": "Svenska institutet för standarder",
    "HSB": "HSB Riksförbund",
    "LRF": "Lantbrukarnas Riksförbund",
    "SPF": "SPF Seniorerna",
    "PRO": "Pensionärernas Riksorganisation",
    "TCO": "Tjänstemännens Centralorganisation",
    "LO": "Landsorganisationen i Sverige",
    "SACO": "Sveriges akademikers centralorganisation",
    "MPF": "Myndigheten för psykologiskt försvar",
    "SIN": "Säkerhets- och integritetsskyddsnämnden",
    "SVA": "Statens veterinärmedicinska anstalt",
    "TMF": "Trä- och Möbelföretagen",
    "SVEBIO": "Bioenergiföreningen",
    "SFOG": "Svensk förening för obstetrik och gynekologi",
}

# Endings in s that are no possessive.
KEEP_FINAL_S = (
    "borås", "vitrysslands", "ledarnas", "tidningarnas", "ukrainas", "försvarsmaktens", "nitus", "corpus", "campus",
    "virus", "status", "fokus", "plus", "mars", "bonus", "minus", "versus", "zeus", "nexus", "consensus", "access",
    "news", "defenders", "friends", "partners", "systems", "solutions", "services", "industries", "redhawks", "hawks",
    "press", "express", "congress", "holdings", "studios", "games", "dynamics", "robotics", "electronics", "genetics",
    "analytics", "logistics", "trafikanalys", "biståndsanalys", "omsorgsanalys", "konjunkturanalys", "energianalys",
    "miljöanalys", "livsmedelsanalys", "arbetsanalys", "fastighets", "energis", "finans", "allmännas", "bofors",
    "affairs", "atlas", "siemens", "philips", "mercedes",
)

# Endings of organisation names that a stem goes without.
ORG_ENDINGS = ("föreningen", "förbundet", "organisationen", "myndigheten", "verket", "styrelsen", "institutet", "rådet", "nämnden")

# What marks contact details, document titles and boilerplate lines.
CONTACT = r"@|www\.|https?://|\.se/|\.gov\."
DOCUMENT_TITLE = r"^remiss\s+(av|om)|^betänkande|^SOU\s+\d{4}|^Ds\s+\d{4}|^Prop\.\s*\d{4}|^Dir\.\s*\d{4}|\d{4}[\s:]\d+.*lag(en|stiftning)?"
BOILERPLATE = (
    r"^regeringskansliet$", r"^finansdepartementet$", r"^justitiedepartementet$", r"^socialdepartementet$", r"^utbildningsdepartementet$",
    r"^näringsdepartementet$", r"^miljödepartementet$", r"^klimat-?\s*och\s*näringslivsdepartementet$", r"^utrikesdepartementet$",
    r"^försvarsdepartementet$", r"^kulturdepartementet$", r"^arbetsmarknadsdepartementet$", r"^landsbygds-?\s*och\s*infrastrukturdepartementet$",
    r"^sida\s*\d+", r"^sid\s*\d+", r"^page\s*\d+", r"^\d+\s*\(\s*\d+\s*\)$", r"^\d+$", r"^\d{2,4}[-/]\d{2}$", r"^\d{2,4}[-/]\d{2}[-/]\d{2,4}$",
    r"^remissinstanser$", r"^sändlista$", r"^remisslista$", r"^bilaga\s*\d*", r"^dnr", r"^datum", r"^sammanfattning", r"^innehåll", r"^inledning", r"^bakgrund",
    r"^remiss\s+av", r"^betänkande", r"^till\s+regeringen", r"^se\s+bifogad", r"myndigheter\s+under\s+regeringen", r"remissvaren\s+ska\s+ha\s+kommit\s+in",
    r"remissvaren\s+kommer\s+att\s+publiceras", r"svaret\s+bör\s+lämnas", r"svaren\s+bör\s+lämnas", r"remissvaren\s+ska", r"synpunkter\s+på\s+remissen",
    r"i\s+ett\s+bearbetningsbart\s+format", r"betankande@", r"e-post(adress)?:\s*\S+@", r"www\.regeringen\.se", r"remissinstansens\s+namn",
    r"statsrådsberedningens\s+promemoria", r"filnamnen\s+ska\s+motsvara", r"ange\s+diarienummer", r"^kopia\s+till$", r"betänkandet\s+kan\s+laddas",
    r"råd\s+om\s+hur\s+remissyttranden", r"en\s+sammanfattning\s+av\s+remissvaren", r"remissvar\s+lämnas\s+digitalt", r"remissvar\s+ska\s+lämnas",
    r"i\s+ämnesraden", r"e-postmeddelandet", r"och\s+remissinstansens", r"instansens\s+synpunkter", r"^och\s+i\s+mejlet", r"^rättschef$", r"^kansliråd$",
    r"^departementsråd$", r"^ämnesråd$", r"^\S+@\S+\.\S+$",
)

# Phrases that say which stance an answer takes; the negated ones are counted first and masked.
STANCE_NEGATED = (
    r"\binte\s+tillstyrker\b", r"\binte\s+instämmer\b", r"\binte\s+välkomnar\b", r"\binte\s+stödjer\b", r"\bkan\s+inte\s+stödja\b", r"\bkan\s+inte\s+tillstyrka\b",
    r"\bkan\s+inte\s+ställa\s+sig\s+bakom\b", r"\binte\s+positiv", r"\binte\s+ställer\s+sig\s+positiv",
)
STANCE = {
    "support": (
        r"\b(?:vi\s+)?instämmer\b", r"\btillstyrker\b", r"\bvälkomnar\b", r"\bstödjer\s+(?:förslaget|utredningen|förslagen)\b", r"\bställer\s+sig\s+positiv",
        r"\bser\s+positivt\s+på\b", r"\bär\s+positiv\s+till\b", r"\btillstyrks\b", r"\bdelar\s+(?:utredningens\s+)?bedömning\b",
    ),
    "oppose": (
        r"\b(?:vi\s+)?motsätter\s+(?:oss|sig)\b", r"\bavstyrker\b", r"\bavråder\b", r"\binvänder\s+mot\b", r"\bställer\s+sig\s+kritisk", r"\bär\s+kritisk\s+till\b",
        r"\bavstyrks\b", r"\bser\s+negativt\s+på\b", r"\bär\s+negativ\s+till\b", r"\binte\s+delar\s+(?:utredningens\s+)?bedömning\b",
    ),
    "conditional": (
        r"\bmed\s+förbehåll\b", r"\bunder\s+förutsättning\b", r"\bi\s+huvudsak\s+(?:positiv|tillstyrker)\b", r"\bvillkorat\b",
        r"\bom\s+(?:nödvändiga\s+)?resurser\s+tillförs\b", r"\bi\s+stort\s+(?:sett\s+)?(?:positiv|tillstyrker)\b", r"\bmed\s+vissa\s+reservationer\b", r"\bgrundsätt?ligen\s+positiv\b",
    ),
    "no_opinion": (
        r"\b(?:vi\s+har\s+)?inga\s+synpunkter\b", r"\bavstår\s+från\s+(?:att\s+yttra|synpunkter)\b", r"\b(?:lämnar|har)\s+inget\s+att\s+erinra\b", r"\bingen\s+erinran\b",
        r"\blämnar\s+inga\s+synpunkter\b", r"\binte\s+berörs\b", r"\bfaller\s+utanför\b",
    ),
}

# Months by name.
MONTHS = ("januari", "februari", "mars", "april", "maj", "juni", "juli", "augusti", "september", "oktober", "november", "december")

# HTML entities in Swedish text.
ENTITIES = {"ö": ("ouml", "#xF6", "#246"), "å": ("aring", "#xE5", "#229"), "ä": ("auml", "#xE4", "#228"), "Ö": ("Ouml", "#xD6", "#214"), "Å": ("Aring", "#xC5", "#197"), "Ä": ("Auml", "#xC4", "#196"), " ": ("nbsp", "#160"), "–": ("ndash", "#x2013", "#8211"), "—": ("mdash", "#x2014", "#8212")}

# What an anchor's text says about the reference, first hit first.
ANCHORS = (
    (r"ändr(ing|ingar|as|at)", "amends"), (r"remissvar|svar på remiss", "responds_to"), (r"grundar sig|basera[ds]? på|utgår från", "based_on"), (r"direktiv|uppdrag", "cites"),
    (r"utredning(en)?|SOU", "cites"), (r"proposition(en)?", "based_on"), (r"relatera[dt]|se även|jämför", "related"),
)
# Kinds of documents by the path of their page.
DOCUMENT_URLS = {"sou": r"/statens-offentliga-utredningar/\d{4}/\d{2}/(sou-\d{4}-?\d+)", "directive": r"/kommittedirektiv/\d{4}/\d{2}/(dir\.?-?\d{4}-?\d+)", "proposition": r"/propositioner/\d{4}/\d{2}/(prop\.?-?\d{4}/?\d{2}:\d+)", "remiss": r"/remisser/\d{4}/\d{2}/"}

# Numbers of documents. A blank or hyphen may stand after the kind.
NUMBERS = {
    "sou_pattern": r"\bSOU[\s-]*(\d{4})\s*[:\-]\s*(\d+)",
    "dir_pattern": r"\bDir\.?[\s-]*(\d{4})\s*[:\-]\s*(\d+)",
    "prop_pattern": r"\bProp\.?[\s-]*(\d{4})\s*[/\-]\s*(\d{2})\s*[:\-]\s*(\d+)",
    "ds_pattern": r"\bDs[\s-]*(\d{4})\s*[:\-]\s*(\d+)",
    "fpm_pattern": r"\b(\d{4}/\d{2})\s*[:\-]?\s*FPM\s*(\d+)",
    "dossier_pattern": r"\b([A-Za-z]{1,3})(\d{4})/(\d{4,5})\b",
    "bet_pattern": r"\bBet\.?\s*(\d{4})\s*[/\-]\s*(\d{2})\s*[:\-]\s*([A-Za-z]+\d+)",
}
