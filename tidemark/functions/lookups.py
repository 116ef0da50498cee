"""Names, code prefixes, bounds and labels that results must agree on."""

# Vital parameter names to features.
VITAL_NAMES = {
    "Saturation": "SPO2",
    "ABP Puls (fra A-kanyle)": "HR",
    "Puls": "HR",
    "Puls (fra SAT-måler)": "HR",
    "Resp.frekvens": "RESPIRATORYRATE",
    "SYSTOLIC": "SBP",
    "ART mean inv BT": "MAP",
    "Temperatur": "TEMP",
    "Temp.": "TEMP",
    "Blæretemperatur": "TEMP",
    "Esophagustemperatur": "TEMP",
    "DBP": "DBP",
    "SBP": "SBP",
}

# Parameters always recorded in Fahrenheit.
FAHRENHEIT_NAMES = [
    "Kernetemperatur",
    "Blæretemperatur",
    "Rektaltemperatur",
    "Axiltemperatur",
    "Esophagustemperatur",
]

# Parameters that carry "systolic/diastolic".
PRESSURE_PAIRS = [
    "BT",
    "ART inv BT",
    "Invasivt BT - ABP (sys/dia)",
    "NIBP",
    "ABP inv BT",
    "Invasivt BT - ART (sys/dia)",
]

# Parameters measured invasively and their category.
INVASIVE_PRESSURES = [
    "ART inv BT",
    "Invasivt BT - ABP (sys/dia)",
    "ABP inv BT",
    "Invasivt BT - ART (sys/dia)",
]
INVASIVE_NAMES = {
    "ABP Puls (fra A-kanyle)": "arterial_hr",
    "Blæretemperatur": "invasive_temp",
    "Esophagustemperatur": "invasive_temp",
}

# Body measures, score names, score-embedded vitals.
BODY_NAMES = {"Højde": "HEIGHT", "Vægt": "WEIGHT"}
SCORE_VITALS = {
    "SAT (score)": "Saturation",
    "Temp. (score)": "Temperatur",
    "BT (score)": "BT",
    "RF (score)": "Resp.frekvens",
}
ICU_NAMES = {
    "GLASGOW COMA SCORE": "GCS",
    "Glasgow Coma Score": "GCS",
    "SAPS 3 SCORE": "SAPS3",
    "SOFA total score": "SOFA",
}
WARNING_SCORE_NAMES = {"EWS korr. total score": "EWS_SCORE"}

# Laboratory order names per feature.
LAB_NAMES = {
    "LACTATE": [
        "LAKTAT(POC);P(AB)",
        "LAKTAT;P(AB)",
        "LAKTAT;P(VB)",
        "LAKTAT(POC);P(VB)",
        "LAKTAT;CSV",
        "LAKTAT(POC);CSV",
        "LAKTAT(POC);P(KB)",
    ],
    "BASE_EXCESS": ["BASE EXCESS;ECV", "ECV-BASE EXCESS;(POC)"],
    "HEMOGLOBIN": ["HÆMOGLOBIN;B", "HÆMOGLOBIN(POC);B", "HÆMOGLOBIN (POC);B"],
    "LEUKOCYTES": ["LEUKOCYTTER;B"],
    "B-GROUP-LEUKOCYTES": [
        "LEUKOCYTTYPE (MIKR.) GRUPPE;B",
        "LEUKOCYTTYPE GRUPPE;B",
        "LEUKOCYTTYPE; ANTALK. (LISTE);B",
    ],
    "TEG-R": ["TEG-R"],
    "TEG-MA": ["TEG-MA"],
    "TEG-LY30": ["TEG-LY30"],
}

# Drug code prefixes of length 3 and 4 per class.
DRUG_CLASSES_3 = {
    "cardiovascular_drugs": ["C01", "C02", "C07"],
    "antibiotics": ["J01"],
    "neuro_drugs": ["N05", "M03"],
    "anti_thrombotic": ["B01"],
    "diuretics": ["C03"],
    "hemostatics": ["B02"],
    "hormone_drugs": ["H01"],
    "antidotes": ["V03"],
}
DRUG_CLASSES_4 = {
    "infusion": ["B05B", "B05X"],
    "blood": ["B05A"],
    "opiods": ["N02A"],
    "local_anastethics": ["N01B"],
    "anastethics": ["N01A"],
    "insulin": ["A10A"],
}

# Administration actions that count.
DRUG_ACTIONS = [
    "Administreret",
    "Ny pose",
    "Selvadministration",
    "Adm. ernæring/sterilt vand",
    "Genstartet",
    "Infusion/pose skiftet",
    "Selvmedicinering",
    "Status, indgift",
]

# Procedure code prefixes per specialty.
PROCEDURE_CLASSES = {
    "KA": "neuro",
    "KB": "endokrin",
    "KC": "øje",
    "KD": "ønh",
    "KE": "oral",
    "KF": "kardio",
    "KG": "thorax",
    "KH": "mamma",
    "KJ": "abdomen",
    "KK": "uro",
    "KL": "gyn",
    "KM": "obstetrik",
    "KN": "orto",
    "KP": "vaskulær",
    "KQ": "hud",
    "BGD": "respirator",
    "BGA": "sonde_tube",
}

# Department patterns in order; a list inside the list needs all its patterns.
DEPARTMENT_PATTERNS = [
    ("TB", ["traumecenter"]),
    (
        "ED",
        [
            r"(?!.*traumecenter)(?!.*psyk)(?!.*børnemod).*\bakutmodtagelse\b",
            r"(?!.*traumecenter)(?!.*psyk)(?!.*børnemod).*\bakutklinik\b",
            r"(?!.*traumecenter)(?!.*psyk)(?!.*børnemod).*\b[\w.]+\s+modtagelse\b",
        ],
    ),
    (
        "OR",
        [
            "operationsgang",
            "operationsklinik",
            "operationsafsnit",
            "dagkirurgi",
            "op afs",
            "op-afsnit",
            "centraloperation",
            "operationsanæstesi",
            r"\bBEDØVELSE OG OPERATION\b",
            ["øjenkl", "operation"],
            r"\bREUM/RYG OP\b",
            "kirurgisk endo",
        ],
    ),
    ("ICU", [r"\bintensiv\b", r"\bita\s", r"\bita,"]),
    ("WARD", ["seng"]),
    ("OPD", ["amb"]),
]

# Hospital names and sex labels.
HOSPITALS = [
    "RH",
    "AHH",
    "HGH",
    "NOH",
    "BFH",
    "BOH",
    "RHP",
    "SJ KØGE",
    "SJ HOLBÆK",
    "SJ NYKØBING",
    "SJ ROSKILDE",
    "SJ VORDINGBORG",
    "SJ NÆSTVED",
    "SJ SLAGELSE",
]
SEX_NAMES = {
    "Mand": "Male",
    "Kvinde": "Female",
    "M": "Male",
    "F": "Female",
    "K": "Female",
    "Male": "Male",
    "Female": "Female",
}

# Plausible ranges.
VITAL_BOUNDS = {
    "SBP": (0.0, 300.0),
    "DBP": (0.0, 200.0),
    "MAP": (0.0, 300.0),
    "HR": (0.0, 250.0),
    "SPO2": (0.0, 100.0),
    "RESPIRATORYRATE": (0.0, 80.0),
    "TEMP": (25.0, 43.0),
    "HEIGHT": (50.0, 230.0),
    "WEIGHT": (2.0, 300.0),
}
DEVICE_BOUNDS = {
    "HR": (0.0, 220.0),
    "SPO2": (0.0, 100.0),
    "SBP": (0.0, 300.0),
    "DBP": (0.0, 200.0),
}

# Device channel names, fallback event codes, assessment labels, severity orders.
DEVICE_FEATURES = {
    "M_NInv Sys Blodtryk": "SBP",
    "M_NInv Dia Blodtryk": "DBP",
    "M_Puls": "HR",
    "M_SpO2": "SPO2",
}
DEVICE_FALLBACK_CODES = {
    "SVD00029": "M_Puls",
    "SVD00030": "M_NInv Sys Blodtryk",
    "SVD00031": "M_NInv Dia Blodtryk",
    "SVD00032": "M_SpO2",
}
ASSESSMENT_NAMES = {
    "A: Luftveje": "A",
    "B: Respiration": "B",
    "C: Cirkulation": "C",
    "D: Bevidsthedsniveau": "D",
}
ASSESSMENT_SEVERITY = {
    "A": ["Fri", "Truede", "Blokerede"],
    "B": ["Normal", "Let påvirket", "Meget påvirket", "Respirationsstop"],
    "C": ["Normal", "Let påvirket", "Meget påvirket", "Hjertestop"],
    "D": ["Vågen", "Bevidsthedspåvirket", "Bevidstløs"],
}

# Words that mark a trauma note.
COHORT_KEYWORDS = ["traume", "trauma", "tilskadekomst", "traumemodtagelse", "traumecenter"]


def reverse(groups: dict[str, list[str]]) -> dict[str, str]:
    """``{class: [codes]}`` as ``{code: class}``."""
    return {code: name for name, codes in groups.items() for code in codes}
