"""Word lists and patterns of the note extractors (Java regex syntax).

Alternatives are kept as lists in their order and joined by ``alternatives``.
"""

# case-insensitive, Unicode letters in classes and boundaries
FLAGS = "(?iuU)"


def alternatives(parts: list[str]) -> str:
    return FLAGS + "(?:" + "|".join(parts) + ")"


# ---- coma score ------------------------------------------------------------------------
# Keyword, filler, value, and the notations rewritten before extraction.
COMA_KEYWORD = r"(?:gcs|glasgow\s+coma\s+(?:scale|score))"
COMA_VALUE = FLAGS + COMA_KEYWORD + r"(?:\s+\w+){0,3}?[\s:=]*\b([1-9]|1[0-5])\b(?!\s*/\w)"
COMA_THRESHOLD = FLAGS + r"til\s+under\s+(?:gcs\s*)?\d+"
COMA_HISTORICAL = FLAGS + r"(?:gcs[^.\n\r]{0,50}for\s+\d+\s+dage?\s+siden|for\s+\d+\s+dage?\s+siden[^.\n\r]{0,50}gcs)"
COMA_FALL = (
    FLAGS
    + rf"(?:{COMA_KEYWORD}?\s*(?:er\s+)?(?:falder?|faldet|stiger?|steget)\s+fra|fald\s+(?:i\s+{COMA_KEYWORD}\s+)?fra)"
    + rf"\s+(?:{COMA_KEYWORD}\s+)?\b(\d+)\b\s+ti?l\s+(?:{COMA_KEYWORD}\s+)?\b(\d+)\b"
)
COMA_ARROW = FLAGS + COMA_KEYWORD + r"[^.\n\r]?(?:fra\s+)?\d+(?:\s(?:→|->)\s*(\d+))+"
COMA_SUBSCALE = FLAGS + COMA_KEYWORD + r"[\s:=]*[ØEøe]\d[^.\n\r]*?=\s*\b([1-9]|1[0-5])\b"
COMA_REPEAT = FLAGS + r"(?:rp\.?\s*|gentag\w*\s*)$"

# ---- injury score ----------------------------------------------------------------------
# Value after and before the keyword.
INJURY_AFTER = (
    FLAGS + r"(?:\()?\bISS(?:-?sco+re)?\.?[\s:=\-]*(?:\s*\S+\s+){0,3}?\(?(\b[0-9]|[1-6]\d|7[0-5])\b"
)
INJURY_BEFORE = FLAGS + r"\b([0-9]|[1-6]\d|7[0-5])\b\s*\S*\s*\bISS\b"

# ---- airway ----------------------------------------------------------------------------
# Note types, event words, negations, specific phrase.
PRIMARY_NOTE_TYPES = [
    "AKA-vurderingsnotater",
    "AKA afsluttende notat for akut ambulante",
    "AKA-Skadenotat",
    "AKA-notater",
    "AKA-Traumenotat",
    "AKA Epikrise",
    "Præhopital patient notat (PPJ)",
]
FALLBACK_NOTE_TYPES = ["AOP"]
AIRWAY = (
    FLAGS
    + r"\b(?:intub\w+|[Tt]uben?\b|tubet|tubeplacering\w*|OTI|RSI|ETT|respirator\b\w*|ventilator\w+|mekanisk\s+ventil\w+)\b"
)
AIRWAY_NEGATION = (
    FLAGS
    + r"\b(?:ikke|ej|uden|planlæg\w+|overvej\w+|forsøg\w+|forsøgt|evt.?|eventuelt|undlad\w+|undladt)\b"
)
AIRWAY_SPECIFIC = FLAGS + r"intuberet[s]?\s+(?:i\s+TC|præhospitalt)"

# ---- token sets ------------------------------------------------------------------------
# Words that carry no content.
STOPWORDS = [
    "og", "i", "er", "en", "et", "til", "på", "med", "af", "de", "den", "det", "som", "der", "har", "pt", "pt.",
    "var", "ved", "fra", "om", "for", "ikke", "men", "han", "hun", "sin", "sit", "sig", "da", "så",
]
ANONYMISED = FLAGS + r"\bx{2,}\b"

# ---- arrest ----------------------------------------------------------------------------
# The keyword and the patterns of the line filters.
ARREST = "hjertestop"
ARREST_DATE_PREFIX = FLAGS + r"^(?:\d{1,2}|xx)[\/\-\.](?:\d{1,2}|xx)\s*[\.:\-]?\s"
ARREST_EXCLUDED_TYPES = alternatives(
    [
        "mors-?notat",
        "forskningsnotat",
        "udskrivningsresum[eé]",
        "samtalenotat",
        "historisk",
        "behandlingsniveau",
        "konferencenotat",
        "helbredsforhold",
    ]
)
ARREST_TYPE_NEGATION = alternatives(
    [
        r"hjertestop\s+kald\s+ved\s+fejl",
        r"ikke\s+klinisk\s+hjertestop",
        r"ikke\s+regelret\s+hjertestop",
        r"(?:der\s+har\s+)?ikke\s+v[æe]ret\s+hjertestop",
        r"har\s+ikke\s+v[æe]ret\s+(?:klinisk\s+)?hjertestop",
        r"vurderer\s+ikke[^.\n]{0,60}hjertestop",
        r"formentlig\s+ikke[^.\n]{0,60}hjertestop",
        r"n[æe]ppe[^.\n]{0,40}hjertestop",
        r"vel\s+ikke[^.\n]{0,40}hjertestop",
        r"egentlig[^.\n]{0,60}hjertestop[^.\n]{0,40}ikke",
        r"ikke\s+(?:v[æe]ret\s+)?tale\s+om[^.\n]{0,60}hjertestop",
    ]
)
ARREST_DIAGNOSIS = FLAGS + r"hjertestop\s+med\s+vellykket\s+genoplivning"
ARREST_UNCERTAIN = alternatives(
    [
        r"formodet\s+hjertestop",
        r"muligt?\s+hjertestop",
        r"usikkert\s+om[^.\n]{0,60}hjertestop",
        r"usikker[^.\n]{0,40}hjertestop",
        r"ikke\s+(?:sikkert|afklaret)[^.\n]{0,40}hjertestop",
        r"(?:genuint|reelt?)\s+hjertestop",
        r"om\s+pt\.?\s+har\s+haft[^.\n]{0,40}hjertestop",
        r"efter\s+formodet\s+hjertestop",
        r"m[åa]ske\s+(?:\w+\s+){0,3}hjertestop",
        r"muligvis\s+(?:\w+\s+){0,3}hjertestop",
        r"sandsynligvis\s+(?:\w+\s+){0,3}hjertestop",
        r"sandsynligt\s+(?:\w+\s+){0,3}hjertestop",
        r"t[æe]nkes\s+(?:at\s+)?(?:v[æe]re\s+)?(?:\w+\s+){0,3}hjertestop",
        r"kunne\s+(?:dreje\s+sig\s+om|v[æe]re)[^.\n]{0,40}hjertestop",
        r"evt\.?\s+(?:\w+\s+){0,3}hjertestop",
        r"hjertestop\s*\?",
        r"\?\s*hjertestop",
        r"differentialdiagnose[^.\n]{0,60}hjertestop",
        r"ddx[^.\n]{0,40}hjertestop",
        r"udelukke[^.\n]{0,40}hjertestop",
        r"sp[øo]rgsm[åa]l\s+om[^.\n]{0,40}hjertestop",
        r"uvist\s+om[^.\n]{0,60}hjertestop",
        r"(?:haft\s+)?sikkert\s+hjertestop",
        r"mist[æe]nkt\s+hjertestop",
        r"mist[æe]nkes?[^.\n]{0,40}hjertestop",
    ]
)
ARREST_NEGATIVE = alternatives(
    [
        # denial
        r"ikke\s+(?:klinisk\s+)?hjertestop(?!\s+(?:ved|p[åa]|under))",
        r"ikke\s+regelret\s+hjertestop",
        r"hjertestop\s+kald\s+ved\s+fejl",
        r"n[æe]ppe\s+(?:\w+\s+){0,3}hjertestop",
        r"om\s+der\s+overhovedet\s+har\s+v[æe]ret\s+hjertestop",
        r"der\s+har\s+ikke\s+v[æe]ret\s+hjertestop",
        r"ikke\s+havde\s+hjertestop",
        r"ikke\s+haft\s+hjertestop",
        r"ingen\s+(?:respirations[\s-](?:el(?:ler)?[\s-])?)?hjertestop",
        r"hjertestopholdet\b",
        # no resuscitation
        r"ingen\s+hlr\s+v(?:ed)?\s+hjertestop",
        r"genoplivning\s+ved\s+hjertestop",
        r"ingen\s+(?:hjertemassage|medicin)\s+ved\s+hjertestop",
        r"ikke\s+indikation\s+for\s+(?:hjerte[/]?lungeredning|genoplivning)\s+ved\s+hjertestop",
        r"der\s+er\s+ikke\s+indikation\s+for[^.\n]{0,60}hjertestop",
        r"vil\s+der\s+ikke\s+v[æe]re\s+indikation\s+for\s+genoplivning",
        r"fravalg[^.\n]{0,60}hjertestop",
        r"i\s+tilf[æe]lde\s+af\s+hjertestop[^.\n]{0,80}(?:ikke|ej|ingen)[^.\n]{0,40}genopliv(?:ning)?",
        r"ej\s+(?:hlr|genoplivning)\s+(?:hvis|ved)\s+hjertestop",
        r"ingen\s+hlr\s+(?:hvis|ved)\s+hjertestop",
        r"behandlingsloft[^.\n]{0,60}hjertestop",
        r"skal\s+ikke\s+genoplives[^.\n]{0,60}hjertestop",
        r"ved\s+hjertestop[^.\n]{0,60}ikke\s+iv[æe]rks[æe]ttes",
        r"ønsker?\s+ikke[^.\n]{0,60}genoplivet[^.\n]{0,60}hjertestop",
        r"ikke\s+(?:at\s+)?(?:pt\.?\s+)?genoplives?[^.\n]{0,60}hjertestop",
        r"livsforl[æe]ngende\s+behandling[^.\n]{0,80}hjertestop",
        r"hjertestop\s+el\.?\s*lign\.?",
        r"ift\.?\s+hjertestop",
        r"ifht\.?\s+hjertestop",
        # cause
        r"(?:\w+\s+){0,4}som\s+[åa]rsag\s+til\s+hjertestop",
        r"[åa]rsag\s+til\s+hjertestop",
        r"genese\s+til\s+hjertestop",
        r"forklaring\s+p[åa][^.\n]{0,40}hjertestop",
        r"hvad\s+der\s+udl[øo]ser\s+hjertestop",
        r"hvorfor[^.\n]{0,40}hjertestop",
        r"hjertestop\s+uns\b",
        r"hjertestop\s+p[åa]\s+grund\s+af",
        r"hjertestop\s+pga\.?(?!\s+(?:p[åa]|ved|under))",
        # care after the event
        r"hjertestopbehandling",
        r"\d+\s+dage?\s+efter\s+(?:trauma\s+med\s+)?hjertestop",
        r"post[\s-]hjertestop",
        r"posthjertestop",
        r"konstatering\s+af\s+hjertestop",
        r"prognose[^.\n]{0,60}hjertestop",
        r"f[øo]lger?\s+(?:efter\s+)?hjertestop",
        r"sekvel[^.\n]{0,40}hjertestop",
        r"rehabiliter[^.\n]{0,60}hjertestop",
        r"skader\s+fra[^.\n]{0,60}hjertestop",
        r"(?:kognitive?\s+)?deficits?\s+efter\s+hjertestop",
        r"opv[åa]gning\s+fra\s+hjertestop",
        r"efter\s+opv[åa]gning[^.\n]{0,40}hjertestop",
        r"i\s+lyset\s+af[^.\n]{0,40}hjertestop",
        # earlier events
        r"inden\s+hjertestop",
        r"har\s+v[æe]ret\s+kaldt?\s+til\s+hjertestop",
        r"tidligere\s+(?:\w+\s+){0,3}hjertestop",
        r"tidl\.?\s+hjertestop",
        r"kendt\s+med\s+hjertestop",
        r"anamnestisk[^.\n]{0,60}hjertestop",
        r"i\s+sygehistorien[^.\n]{0,60}hjertestop",
        r"i\s+g[åa]r[^.\n]{0,60}hjertestop",
        r"igår[^.\n]{0,60}hjertestop",
        r"hjertestop\s+(?:19|20)\d{2}\b",
        r"(?:19|20)\d{2}[^.\n]{0,40}hjertestop",
        r"\d+\s+dages?\s+(?:tid\s+)?siden[^.\n]{0,60}hjertestop",
        r"\d+\s*[åa]r\s+siden[^.\n]{0,60}hjertestop",
        r"hjertestop\s+\d+\s+dage\s+senere",
        r"\d+\s+dage\s+senere[^.\n]{0,40}hjertestop",
        r"seneste\s+livstegn[^.\n]{0,60}hjertestop",
        # other persons
        r"fam(?:iliære?\s+)?(?:disp\.?|dispositioner?)[^.\n]{0,80}hjertestop",
        r"for[æa]ldre[^.\n]{0,80}hjertestop",
        r"familie[^.\n]{0,60}hjertestop",
        r"sl[æe]gtning[^.\n]{0,60}hjertestop",
        r"mor\s+(?:d[øo]de?|fik|har)[^.\n]{0,60}hjertestop",
        r"far\s+(?:d[øo]de?|fik|har)[^.\n]{0,60}hjertestop",
        r"(?:nabo(?:patient)?|hustru|[æe]gtefælle|kone|s[øo]n|datter)[^.\n]{0,60}hjertestop",
        r"hjertestop\s+hos\s+(?:nabo|anden|medpatient)",
        # hypothetical
        r"hvis\s+[^.\n]{0,40}f[åa]r\s+hjertestop",
        r"s[åa]fremt\s+(?:pt\.?\s+)?f[åa]r\s+hjertestop",
        r"hvis\s+(?:pt\.?\s+)?(?:igen\s+)?f[åa]r\s+hjertestop",
        r"ved\s+(?:fornyet|nyt|evt\.?)\s+hjertestop",
        r"skulle\s+f[åa]\s+hjertestop",
        r"t[æe]nker[^.\n]{0,60}hjertestop",
        r"ikke\s+vil\s+genoplives[^.\n]{0,60}hjertestop",
        r"vil\s+ikke\s+genoplives[^.\n]{0,60}hjertestop",
        # headings
        r"omst[æe]ndigheder\s+omkring\s+hjertestop",
        r"p[åa]\s+baggrund\s+af\s+hjertestop",
        r"grundet\s+hjertestop",
        r"sekundaert\s+til\s+hjertestop",
        r"sekund[æe]rt\s+til\s+hjertestop",
        r"[åa]rsager?\s+til\s+hjertestop",
        r"information\s+til\s+p[åa]r[øo]rende[^.\n]{0,80}hjertestop",
        r"problemstilling\s+vedr\.?[^.\n]{0,60}hjertestop",
        # in connection with
        r"i\s+forbindelse\s+med\s+(?:\w+\s+){0,2}hjertestop",
        r"ifm\.?\s+hjertestop",
        r"ifbm\.?\s+hjertestop",
        # fear
        r"bekymret[^.\n]{0,60}hjertestop",
        r"bange\s+for[^.\n]{0,60}hjertestop",
        r"frygter?[^.\n]{0,60}hjertestop",
        # corrections
        r"egentlig[^.\n]{0,60}hjertestop[^.\n]{0,40}ikke",
        r"ikke\s+(?:rigtig|egentlig|reelt?)\s+(?:et\s+)?hjertestop",
        r"var\s+der\s+vel\s+ikke\s+tale\s+om[^.\n]{0,40}hjertestop",
        r"ikke\s+(?:v[æe]ret\s+)?tale\s+om[^.\n]{0,40}hjertestop",
        r"hjertestop[^.\n]{0,60}vel\s+ikke",
        r"formentlig\s+ikke[^.\n]{0,60}hjertestop",
        r"vurderes?\s+(?:ikke|at\s+der\s+ikke)[^.\n]{0,60}hjertestop",
        # research
        r"studie[^.\n]{0,60}hjertestop",
        r"randomiserer[^.\n]{0,60}hjertestop",
        r"inkluderer[^.\n]{0,60}hjertestop",
    ]
)
ARREST_CALLED_BUT = (
    FLAGS
    + r"kaldt?\s+(?:til\s+)?hjertestop[^.\n]{0,100}"
    + r"(?:ikke|ingen|men\s+(?:pt\.?\s+)?(?:der\s+)?(?:ikke|ingen|har\s+ikke|havde\s+ikke)|"
    + r"ikke\s+regelret|ikke\s+klinisk|ikke\s+haft)"
)
ARREST_TIMES_N = FLAGS + r"hjertestop\s*(?:\([^)]{1,20}\)\s*)?x\s*(\d+)"
ARREST_POSITIVE = alternatives(
    [
        r"(?:f[åa]r|g[åa]r\s+i|udvikler|f[åa]et|har\s+(?:f[åa]et|udviklet))\s+hjertestop",
        r"idet\s+(?:patienten|pt\.?)\s+har\s+(?:f[åa]et|haft)\s+hjertestop",
        r"(?:patienten|pt\.?)\s+har\s+(?:f[åa]et|haft)\s+hjertestop(?:\s+(?:ved|p[åa]|under))",
        r"har\s+pt\.?\s+udviklet\s+hjertestop",
        r"kaldt?\s+(?:til\s+)?hjertestop",
        r"kaldes\s+(?:til\s+|hjertestop)",
        r"hjertestop\s+(?:på|p[åa])\s+(?:skadestedet|stedet|gaden)",
        r"p[åa]\s+(?:skadestedet|stedet)[^.\n]{0,50}hjertestop",
        r"hjertestop[/]cirkulationssvigt\s+p[åa]\s+skadestedet",
        r"(?:u)?bevidnet\s+hjertestop",
        r"(?:pt\.?\s*)?\d{1,3}[- ]?[åa]rig[^.\n]{0,100}hjertestop",
        r"bringes\s+ind[^.\n]{0,80}hjertestop",
        r"indbringes[^.\n]{0,60}hjertestop",
        r"indbragt[^.\n]{0,60}hjertestop",
        r"(?:ind)?l[æe]gges[^.\n]{0,60}hjertestop",
        r"hjertestop\s+(?:som\s+)?traumemekanisme",
        r"hjertestop\s+under\s+transport\s+hertil",
        r"under\s+transport[^.\n]{0,40}hjertestop",
        r"hjertestop\s*(?:\([^)]{1,20}\)\s*)?x\s*\d+",
        r"igen[^.\n]{0,15}hjertestop",
        r"hjertestop[^.\n]{0,15}igen",
        r"atter[^.\n]{0,15}hjertestop",
        r"hjertestop[^.\n]{0,15}atter",
        r"nyt\s+hjertestop",
        r"fornyet\s+hjertestop",
        r"endnu\s+(?:et|ét)\s+hjertestop",
        r"konstateret\s+hjertestop",
        r"hjertestop\s+konstateres",
        r"(?:umiddelbart|kort)\s+efter[^.\n]{0,60}hjertestop",
        r"(?:ankomst|ankommer|ankom|indkom)[^.\n]{0,60}hjertestop",
        r"meldes\s+om[^.\n]{0,40}hjertestop",
        r"svindende\s+puls[^.\n]{0,40}hjertestop",
        r"ved\s+ankomst[^\n]{0,80}hjertestop",
        r"klinisk\s+hjertestop",
        r"\bhjertestop\b",
    ]
)
ARREST_CONTEXT_NEGATION = alternatives(
    [
        r"[åa]rsag",
        "forklaring",
        "overskrift",
        "tidligere",
        "anamnese",
        r"p[åa]\s+baggrund",
        "grundet",
        "inden",
        r"(?:d\.?\s*\d{1,2}[./-]\d{1,2})",
        r"udl[øo]ser",
        "hvorfor",
        r"omst[æe]ndigheder",
        "diagnose",
        r"post[\s-]?hjertestop",
        "sekundaert",
        r"sekund[æe]rt",
        "historik",
    ]
)
ARREST_TRANSPORT = FLAGS + r"hjertestop\s+under\s+transport\s+hertil"
ARREST_WITNESSED = FLAGS + r"(?:u)?bevidnet\s+hjertestop"
ARREST_PAST = alternatives(
    [
        r"(?:patienten|pt\.?)\s+har\s+(?:haft|v[æe]ret\s+i)\s+hjertestop",
        r"har\s+(?:haft|v[æe]ret)\s+hjertestop",
        r"der\s+har\s+v[æe]ret\s+hjertestop",
        r"har\s+v[æe]ret\s+(?:klinisk\s+)?hjertestop",
    ]
)
ARREST_AGAIN = FLAGS + r"\bigen\b|\batter\b|\bfornyet\b|\bnyt\b|\bendnu\b"
ARREST_STRONG = alternatives(
    [
        r"f[åa]r",
        r"g[åa]r\s+i",
        "udvikler",
        "kaldt?",
        "kaldes",
        "bringes",
        "indbringes",
        "indbragt",
        "ankommer",
        "ankom",
        "indkom",
        r"idet\s+(?:pt|patienten)",
        r"har\s+(?:pt\.?\s+)?(?:f[åa]et|udviklet)",
        "traumemekanisme",
        "skadestedet",
        "stedet",
        "igen",
        "atter",
        "fornyet",
        "nyt",
        "endnu",
        "ubevidnet",
        r"\d{1,3}[- ]?[åa]rig",
        "ankomst",
        "meldes",
        "konstateret",
        "konstateres",
        "svindende",
        "umiddelbart",
        "indlægges",
        r"under\s+transport",
        r"ved\s+ankomst",
        r"p[åa]\s+(?:skadestedet|stedet)",
        r"klinisk\s+hjertestop",
    ]
)
ARREST_EXCLUDED_SECTION = alternatives(
    [r"famili[æe]re?\s+dispositioner?", r"fam\.?\s*disp\.?", r"information\s+til\s+p[åa]r[øo]rende", "hereditet"]
)
ARREST_HEADING = r"(?U)^[A-ZÆØÅ\w][^\n]{0,40}:\s*$"
ARREST_DATE = FLAGS + r"(?:^|\s)(\d{1,2})[/.\-](\d{1,2})(?:\s*[:.]|\s|$)"
ARREST_DATED = FLAGS + r"(?:hjertestop|arresthjertet|arresteret)\s+(?:d\.?|den)\s+(\d{1,2})[/.](\d{1,2})"
ARREST_YEAR = FLAGS + r"\b((?:19|20)\d{2})\b"
ARREST_PRESENT = alternatives(
    [
        r"(?:f[åa]r|g[åa]r\s+i|udvikler|kaldes)\s+hjertestop",
        r"hjertestop\s+konstateres",
        r"hjertestop\s+(?:i\s+dag|i\s+nat|i\s+morges|i\s+aftes|til\s+morgen|her\s+til\s+morgen)",
        r"(?:i\s+dag|i\s+nat|i\s+morges|i\s+aftes|til\s+morgen|her\s+til\s+morgen)[^.\n]{0,30}hjertestop",
        r"hjertestop\s+kl\.?\s*\d{1,2}",
    ]
)
ARREST_RECAP = alternatives(
    [
        r"(?:kort\s+)?sygehistorie",
        r"kort\s+anamnese",
        "resumé",
        "resume",
        r"som\s+(?:bekendt|tidligere\s+beskrevet|n[æe]vnt)",
        "anamnestisk",
        r"pt\.?\s+(?:er|var|blev|har)\s+(?:indlagt|indbragt|overflyttet)",
        r"tidligere\s+i\s+forl[øo]bet",
        r"som\s+det\s+fremg[åa]r\s+(?:af|fra)",
        r"som\s+beskrevet\s+(?:ovenfor|tidligere)",
    ]
)
