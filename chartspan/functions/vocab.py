"""Dictionaries and phrases that results depend on, word for word."""

# (id, name, color, hotkey, hint)
DEFAULT_QUESTIONS = [
    ("Q1", "Symptoms", "#b45309", "1", "flank pain, hematuria, bloody urine"),
    ("Q2", "Progression", "#be123c", "2", "interval stone growth, stones growing"),
    ("Q3", "Rare Disease", "#7c3aed", "3", "cystinuria, cystine, primary hyperoxaluria"),
    ("Q4", "SDOH", "#a21caf", "4", "housing, transportation, support"),
    ("Q5", "Devices", "#1d4ed8", "5", "Fr, French, sheath, laser fiber"),
    ("Q6", "Radiology", "#0f766e", "6", "stone size, location, hydronephrosis"),
    ("Q7", "Diet Advice", "#4d7c0f", "7", "water, sodium, oxalate, protein"),
    ("Q8", "ER Visit", "#c2410c", "8", "ED presentation for stone"),
    ("Q9", "Post-op Complication", "#b91c1c", "9", "complication within 30 days"),
    ("Q10", "Stone Passage", "#4338ca", "0", "passed stone at home"),
]

# question -> terms
DEFAULT_TERMS = {
    "Q1": ["flank pain", "hematuria", "gross hematuria", "bloody urine", "renal colic"],
    "Q2": ["interval stone growth", "stones are growing", "increased stone burden", "stone enlargement"],
    "Q3": ["cystinuria", "cystine", "primary hyperoxaluria", "staghorn"],
    "Q4": ["homeless", "housing", "unemploy", "uninsured", "transportation"],
    "Q5": ["percuflex", "boston scientific", "nitinol", "basket", "laser fiber", "guidewire", "foley"],
    "Q6": ["hydronephrosis", "hydroureter", "nonobstructing", "calculi", "stone burden", "bosniack"],
    "Q7": ["water intake", "fluid intake", "low sodium", "low oxalate", "dietary", "litholink"],
    "Q8": ["emergency department", "emergency room", "ED visit", "ER visit", "acute presentation"],
    "Q9": ["complication", "readmit", "post-operative", "infection", "sepsis", "fever"],
    "Q10": ["passed a stone", "passed stone", "saw a stone pass", "spontaneous passage"],
}

# question -> regular expressions
DEFAULT_REGEXES = {
    "Q5": [r"\d+\s*fr\b", r"\d+x\d+"],
    "Q6": [r"\d+\s*mm\b", r"\d+\s*cm\b", r"\d+\s*x\s*\d+", "mgy"],
}

# questions whose term matches are dropped when a negation cue precedes them
NEGATED_QUESTIONS = ["Q1"]

NEGATION_CUES = ["no ", "not ", "denies ", "negative for ", "without ", "absent "]

RADIOLOGY_PHRASES = [
    "renal sonogram", "renal ultrasound", "ct abdomen", "ct urogram", "mri abdomen",
    "impression:", "findings:", "kidneys/ureters",
]

RADIOLOGY_STRONG = [
    "IMPRESSION:", "FINDINGS:", "TECHNIQUE:", "BIRADS", "BI-RADS", "RADIOGRAPH", "MAMMOGRAM",
]

RADIOLOGY_ANTI = [
    "CHIEF COMPLAINT", "HISTORY OF PRESENT ILLNESS", "HPI:", "PAST MEDICAL HISTORY",
    "REVIEW OF SYSTEMS", "PHYSICAL EXAM", "EMERGENCY DEPARTMENT", "ED COURSE", "ASSESSMENT AND PLAN",
]

MAJOR_HEADERS = [
    "chief complaint", "cc", "history of present illness", "hpi",
    "past medical history", "pmh", "past surgical history", "psh",
    "social history", "sh", "family history", "fh",
    "review of systems", "ros", "physical exam", "physical examination", "pe",
    "vital signs", "vitals", "vs", "labs", "laboratory", "imaging", "radiology",
    "assessment", "assessment and plan", "a/p", "plan", "impression",
    "medications", "allergies", "hospital course", "ed course", "mdm",
    "diagnosis", "diagnoses", "problem list", "disposition", "follow up",
    "history", "subjective", "objective", "exam", "findings", "results",
]

MINOR_HEADERS = [
    "constitutional", "heent", "head", "eyes", "ears", "nose", "throat", "neck",
    "cardiovascular", "cv", "cardiac", "heart", "respiratory", "pulmonary", "lungs",
    "gastrointestinal", "gi", "abdominal", "abdomen", "genitourinary", "gu",
    "musculoskeletal", "msk", "neurological", "neuro", "psychiatric", "psych",
    "skin", "integumentary", "extremities", "lymphatic",
    "endocrine", "hematologic", "immunologic", "allergic",
]

# section -> expression for a whole header line (lower case, no trailing colon); first one wins
SECTION_PATTERNS = [
    ("HPI", r"history\s+of\s+present(ing)?\s+illness|hpi|chief\s+complaint|cc|reason\s+for\s+(visit|consultation)|presenting\s+complaint|subjective"),
    ("PMH", r"past\s+medical\s+history|pmh|medical\s+history|patient\s+history"),
    ("PSH", r"past\s+surgical\s+history|psh|surgical\s+history"),
    ("SOCIAL", r"social\s+history|sh|socioeconomic\s+history|substance\s+use"),
    ("FAMILY", r"family\s+history|fh|family\s+medical\s+history"),
    ("ALLERGIES", r"allergies|allergy|drug\s+allergies|allergen\s+reactions|adverse\s+reactions"),
    ("MEDS", r"medications?|current\s+medications?|discharge\s+medications?|home\s+medications?|outpatient\s+medications?|active\s+medications?"),
    ("ROS", r"review\s+of\s+systems|ros|systems\s+review"),
    ("PE", r"physical\s+exam(ination)?|pe|exam(ination)?|physical\s+findings|objective"),
    ("VITALS", r"vital\s+signs|vitals|vs"),
    ("LABS", r"labs?|lab\s+results|laboratory(\s+data|\s+results|\s+studies)?|results"),
    ("IMAGING", r"imaging(\s+studies)?|radiology|diagnostic\s+studies|studies|x.?ray|ct|mri|ultrasound"),
    ("ASSESSMENT", r"assessment(\s+and\s+plan)?|a/?p|impression|diagnosis|diagnoses|ed\s+diagnosis|final\s+diagnos[ie]s|problem\s+list"),
    ("PLAN", r"plan(\s+of\s+care)?|treatment\s+plan|recommendations|disposition|discharge\s+(instructions|plan|disposition)|follow.?up"),
    ("COURSE", r"hospital\s+course|ed\s+course|course|mdm|medical\s+decision\s+making"),
]

SIGNATURE_TOKENS = ["md", "do", "np", "pa", "rn"]
BREAK_NAMES = ["space", "newline", "blank_line"]

UNKNOWN_QUESTION_COLOR = "#78716c"
UNKNOWN_QUESTION_HINT = "Imported from session"
