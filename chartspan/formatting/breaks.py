"""Where new lines start: section headers, dates, sentences, labels in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspan.formatting import lexicon as lex
from chartspan.formatting.engine import (
    below, blocks, if_contains, only_if, per_line, per_line_with_gaps, replaces, step, sub, subs, where_found,
)
from chartspan.functions.text import alternation, any_of, quote

SECTION = "format_section_breaks"
DATES = "format_dates"
SENTENCES = "format_sentences"

GAP2, GAP3 = r"\s{2,}", r"\s{3,}"


def gap(text: Column, phrases: list[str], lead: str, least: str = GAP2, more: str = "") -> Column:
    """Start a line (``lead``) at phrases that follow a gap. Phrases are literals."""
    return sub(text, f"{least}({any_of(phrases)}{more})", f"{lead}$1")


# --- fixed values: markers after which a dense line is cut ----------------------------------

DENSE_MARKERS = [
    "SUBJECTIVE", "OBJECTIVE", "ASSESSMENT", "PLAN", "A/P",
    "Assessment and Plan", "Assessment/Plan",
    "Chief Complaint", "History of Present Illness", "HPI", "CC",
    "Reason for Visit", "Reason For Consultation",
    "Past Medical History", "Past Surgical History", "PMH", "PSH",
    "Social History", "Family History", "SH", "FH",
    "Patient History", "Previous History", "Medical History", "Surgical History",
    "Review of Systems", "ROS", "Physical Exam", "PE",
    "Physical Examination", "Vital Signs", "Vitals",
    "Labs", "Lab Results", "Laboratory", "Laboratory Data",
    "Labs and Imaging", "Imaging", "Radiology", "Component Value Date",
    "Medications", "Current Medications", "Home Medications",
    "Active Medications", "Current Outpatient Medications",
    "Current Facility-Administered Medications",
    "Discharge Medications", "Orders Placed This Encounter",
    "Allergies", "Allergen Reactions", "Drug Allergies",
    "Active Problems", "Problem List", "Chronic Problems", "Patient Active Problem List",
    "Hospital Course", "Brief Hospital Course", "Course",
    "ED Course", "ED Labs", "ED Medications", "MDM",
    "Disposition", "Discharge", "Discharge Disposition",
    "Condition on Discharge", "Discharge Instructions",
    "Discharge Diagnosis", "Follow Up", "Follow-Up",
    "Mental Status", "Mental Status Exam", "MSE",
    "Diagnosis", "Impression", "Diagnoses",
    "Pre-op Diagnosis", "Post-op Diagnosis", "Preoperative Diagnosis",
    "Postoperative Diagnosis", "Case Type", "Anesthesia",
    "INTAKE & OUTPUT", "Findings", "Wound Classification",
    "Specimens Removed", "Drains", "Condition of the Patient",
    "Respiratory Condition", "Rotation",
    "Physician Signature", "Primary Proceduralist",
    "Operation/Procedure Date", "Resident/Housestaff",
    "Amount And/Or Complexity", "History obtained",
    "Patient presents with", "Interim", "Interim History",
    "Fluids, electrolytes", "Access:", "Prophylaxis:",
    "Code Status", "DVT ppx", "Diet",
    "Intake/Output Summary", "Gross per 24 hour",
    "Consultations", "Pending Items", "Return in",
]

CLINICAL_SECTIONS = [
    "History and Physical", "History of Present Illness", "HPI", "Chief Complaint", "CC",
    "Past Medical History", "Medical Hx", "Past Surgical History", "Surgical Hx",
    "Social History", "Social Hx", "Family History", "Family Hx",
    "Review of Systems", "ROS", "Physical Examination", "Physical Exam", "Vitals", "Vital Signs",
    "Labs and Imaging", "Labs & Imaging", "Lab Results", "LABORATORY",
    "Diagnostic Studies", "Radiology",
    "Medications", "Current Medications", "Current Outpatient Medications",
    "Current Facility-Administered Medications",
    "Allergies", "No Known Allergies",
    "Assessment and Plan", "ASSESSMENT/PLAN", "Assessment", "Plan",
    "Assessment & Plan", "Assessment & Plan by Problem",
    "Problem List", "Patient Active Problem List", "Impression", "Findings", "Synopsis",
    "Preoperative Info",
]

TABLE_HEADERS = [
    "Diagnosis Date", "Procedure Laterality Date", "Problem Relation Age of Onset",
    "Component Value Date", "Medication Sig", "Medication Sig Dispense Refill",
    "Medication Dose Route Frequency", "Allergen Reactions", "Vital Sign", "Lab Results",
]

INLINE_SYSTEMS = [
    "Constitutional", "HENT", "HEENT", "Eyes", "ENT", "Respiratory", "Cardiovascular", "CV",
    "Gastrointestinal", "GI", "Genitourinary", "GU", "Musculoskeletal", "MSK",
    "Neurological", "Neurologic", "Neuro", "Skin", "Psychiatric", "Psych",
    "Psychiatric/Behavioral", "Endocrine", "Hematologic", "Endo/Heme/Allergies",
]

INLINE_EXAM = [
    "GEN", "GENERAL", "HEENT", "HEAD", "EYES", "NECK", "CHEST", "CARDIOVASCULAR", "CV",
    "RESPIRATORY", "PULMONARY", "ABDOMEN", "ABDOMINAL", "GI", "EXTREMITIES", "EXT",
    "MUSCULOSKELETAL", "MSK", "NEUROLOGIC", "NEURO", "SKIN", "PSYCH", "Psychiatric",
]

POST_OP_MARKERS = [
    "Pre-op Diagnosis", "Post-op Diagnosis", "Preoperative Diagnosis", "Postoperative Diagnosis",
    "Pre-op Diagnosis (Required)", "Post-op Diagnosis (Required)",
    "Operation/Procedure Date", "Primary Proceduralist", "Resident/Housestaff",
    "Case Type", "Operation(s)/Procedure(s)", "Anesthesia",
    "INTAKE & OUTPUT", "Findings", "Wound Classification",
    "Specimens Removed", "Drains", "Condition of the Patient",
    "Respiratory Condition", "Disposition", "Rotation",
    "Physician Signature", "Patient Name", "MRN", "DOB", "Sex", "Account #",
]

MENTAL_STATUS_HEADERS = ["mental status", "mental status exam", "mse"]
MENTAL_STATUS_LABELS = [
    "Appearance", "Attitude", "Activity", "Language", "Speech",
    "Thought Process", "Thought Content", "SI/HI", "Mood", "Affect",
    "Mood/Affect", "Perception", "Cognition", "Judgment", "Insight",
    "Judgment and Insight", "Orientation", "Memory", "Attention",
    "Concentration", "Behavior", "Psychomotor",
]

HISTORY_HEADERS = [
    "past medical history", "past surgical history", "pmh", "psh", "medical history",
    "surgical history", "patient active problem list",
]

AFTER_COLON = [
    "Normal ", "Skin ", "No ", "Trace ", "AROM", "PROM", "Pain ", "Good strength", "Legs ",
    "Examination ", "Description", "Status", "Surgery Type", "General anesthesia",
    "Supine Position", "Specials", "Post Op", "PT ",
]
AFTER_WORD = [
    "Skin ", "No ", "Trace ", "Pain ", "Legs ", "Good strength", "Lateral ", "AROM", "PROM",
    "Examination ",
]
INLINE_PHRASES = [
    "Pain with", "Good strength", "Legs warm", "No swelling", "No ligament instability",
    "No deformity",
]


def whole_line(words: list[str]) -> str:
    return r"[ \t]*" + any_of(words) + r":?[ \t]*$"


# --- dense lines ---------------------------------------------------------------------------

@step(SECTION, 9)
def dense_lines(t: Column) -> Column:
    marker = any_of(DENSE_MARKERS)

    def cut(line: Column) -> Column:
        line = sub(line, rf"(?=\s)(?:(?<=[.!?;)\]>])\s+|\s{{2,}})({marker})(?=\s|:|\z)", "\n\n$1")
        with_gap = lambda x: x.rlike(r"\s\s")
        line = only_if(line, with_gap, lambda x: subs(
            x, (r"\s{2,}([A-Z][a-z]+(?:\s++[A-Z][a-z]++)*+)\s*:", "\n\n$1:"),
            (r"\s{2,}([A-Z][A-Z\s/&]{3,})\s*:", "\n\n$1:")))
        line = where_found(line, ["*"], (r"\s+(\*\s+[A-Z][a-z])", "\n$1"))
        return only_if(line, with_gap, lambda x: subs(
            x, (r"(\d{2}/\d{2}/\d{4})\s{2,}([A-Z][a-z]+)", "$1\n\n$2"),
            (r"(?i)\s{2,}(RBC|FFP|Cryo|Whole Blood|Platelets|Cell Saver)\s*\(", "\n$1 (")))

    return only_if(t, lambda x: x.rlike(r"(?md)^.{150}"), lambda x: per_line(
        x, lambda line: F.when(F.length(line) >= 150, cut(line)).otherwise(line)))


@replaces(SECTION, 10)
def clinical_sections(t: Column) -> Column:
    t = sub(t, rf"(?=\s)(?:(?<=[.!?)\]])\s+|\s{{2,}})({any_of(CLINICAL_SECTIONS)})\s*[-:]", "\n\n$1:")
    t = gap(t, TABLE_HEADERS, "\n\n")
    t = subs(t, (r"\s+~\s+", "\n- "), (r"(?m)^~\s+", "- "))
    t = gap(t, ["Past Surgical History:", "Past Medical History:"], "\n\n")
    t = sub(t, r"(?i)\s{2,}(No past medical history pertinent negatives\.)", "\n\n$1")
    t = gap(t, ["No results found for:", "Procedure:"], "\n")
    t = sub(t, r"(?i)\s{2,}Surgeon:", " Surgeon:")
    t = sub(t, r"(?i)\s{2,}Location:", " Location:")
    t = sub(t, rf"(?i)([.;,])\s+({any_of(INLINE_SYSTEMS)}):\s*(Positive|Negative|Denies)", "$1\n$2: $3")
    t = sub(t, rf"([.;])\s+({any_of(INLINE_EXAM)})\s*:", "$1\n$2:")
    t = gap(t, ["Code Status:", "DVT Ppx:", "DVT prophylaxis:", "Diet:", "Surrogate:", "Access:",
                "Dispo:", "Level of Care:"], "\n")
    t = sub(t, r"(?i)\s{2,}(Lab Results)\s+(Lab)", "\n\n$1\n$2")
    return sub(t, r"(?i)\s{2,}(WBC|RBC|HGB|HCT|PLT|NA|K|CL|BUN|CREATBLD|GLUCOSE|CALCIUM)\s+", "\n$1 ")


@replaces(SECTION, 11)
def soap_sections(t: Column) -> Column:
    soap = "(?i:SUBJECTIVE|OBJECTIVE|ASSESSMENT|PLAN)"
    t = sub(t, rf"(?=[\sSOAPsoap])(?:(?<=[.!?;:\]])\s*|(?<=\S)\s{{2,}})({soap})\s*:", "\n\n$1:")
    return sub(t, r"(?i)\s{2,}(Plan:)\s*-", "\n\n$1\n-")


@replaces(SECTION, 12)
def post_op_sections(t: Column) -> Column:
    t = gap(t, POST_OP_MARKERS, "\n\n")
    t = sub(t, r"\s{2,}(\*\s+)", "\n$1")
    t = sub(t, r"(?i)\s{2,}(\[REMOVED\]|\[Active\])", "\n$1")
    return sub(t, r"\s{2,}(\d{2}/\d{2}/\d{2}\s+\d{4})", "\n$1")


@replaces(SECTION, 15)
def emergency_sections(t: Column) -> Column:
    t = gap(t, ["ED Provider Notes", "ED Procedure Notes"], "\n\n", GAP3)
    t = gap(t, ["Chief Complaint", "History of Present Illness", "Patient presents with",
                "ED Course & MDM", "ED Course and Medical Decision Making", "Medical Decision Making",
                "Amount And/Or Complexity", "ED Diagnoses", "Final diagnoses:", "ED Labs & Imaging",
                "Labs Reviewed", "Patient Vitals", "Vitals signs"], "\n\n")
    return gap(t, ["Nursing note"], "\n")


@replaces(SECTION, 16)
def summary_sections(t: Column) -> Column:
    t = gap(t, ["PREADMISSION DIAGNOSIS:", "DISCHARGE DIAGNOSIS:", "ADMITTING DIAGNOSIS:",
                "FINAL DIAGNOSIS:", "BRIEF HISTORY:", "HOSPITAL COURSE:", "DISCHARGE INSTRUCTIONS:",
                "DISCHARGE MEDICATIONS:", "Synopsis:", "Physical Exam:", "Consultations",
                "Condition at Discharge:", "Disposition:", "Patient Instructions:", "Pending Items:",
                "Laboratory Findings:", "Condition on Discharge:", "Recommendations:",
                "Specific Instructions", "Disposition on Discharge:"], "\n\n")
    return sub(t, r"(?i)\s{2,}(Prog[a-z]*:)", "\n\n$1")


@step(SECTION, 18)
def axis_diagnoses(t: Column) -> Column:
    return if_contains(t, ["xis", "XIS"], lambda x: sub(
        x, r"(?i)\s+(Axis\s+(?:IV|V|I{1,3}))\s*:", "\n$1:"))


@step(SECTION, 19)
def mental_status(t: Column) -> Column:
    label = any_of(MENTAL_STATUS_LABELS)
    stays = rf"(?!.*{label})"
    return blocks(
        t, whole_line(MENTAL_STATUS_HEADERS), stays + lex.HEADER_LINE,
        lambda p: below(p, lambda line: F.when(
            F.length(line) > 100, sub(line, rf"\s{{2,}}({label})\s*:", "\n$1:")).otherwise(line)))


@replaces(SECTION, 20)
def procedure_notes(t: Column) -> Column:
    t = gap(t, ["Performed by:", "Authorized by:", "Consent obtained:", "Consent given by:",
                "Risks discussed:", "Alternatives discussed:", "Indication", "Reason for procedure:",
                "Complications:", "Complications?:", "Successful cannulation", "Total number of",
                "Gauge catheter", "Procedure:", "Surgeon:", "Location:"], "\n")
    return sub(t, r"(?i)\s{2,}(CPT\(?R?\)?\s*Code:)", "\n$1")


# --- dates and signatures ------------------------------------------------------------------

@replaces(DATES, 21)
def date_patterns(t: Column) -> Column:
    t = gap(t, ["Date of services:", "Date of Admission:", "Date of Discharge:",
                "Operation/Procedure Date", "Sex:", "Birthdate:", "DOB:", "Age:", "Race:", "PCP:",
                "Attending:", "MRN:", "Account #:", "Last data filed at", "Patient Name",
                "MRN (Required):", "Patient Location"], "\n")
    t = sub(t, r"(?i)\s{2,}(Date:)\s*(\d{2}/\d{2}/\d{4})", "\n$1 $2")
    t = sub(t, r"(?i)\s{2,}(Time:)\s*(\d{1,2}:\d{2})", "\n$1 $2")
    return gap(t, ["Electronically signed by"], "\n\n")


@replaces(DATES, 22)
def timestamps(t: Column) -> Column:
    t = sub(t, r"\s{2,}(\d{2}/\d{2}/\d{2,4}\s+\d{4})\s+([A-Z])", "\n$1 $2")
    return sub(t, r"(\d{2}/\d{2}/\d{2,4})\s{2,}([A-Z][a-z]+\s+[A-Z][a-z]+)", "$1\n$2")


@replaces(DATES, 48)
def signature_lines(t: Column) -> Column:
    t = sub(t, r"\s{3,}([A-Z][a-z]+\s+[A-Z][a-z]+,?\s*(?:MD|DO|PA-C|NP|APRN|RN|MA))", "\n\n$1")
    t = sub(t, r"(?m)\s{2,}(\d{2}/\d{2}/\d{2,4}\s+\d{4})$", "\n$1")
    return sub(t, r"(?i)\s{2,}(Writt(?:en|) by:?)", "\n\n$1")


@replaces(DATES, 49)
def appointment_stamps(t: Column) -> Column:
    month = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    t = sub(t, rf"(?i)\s{{2,}}({month}\s+\d{{1,2}},?\s+\d{{4}})", "\n$1")
    t = sub(t, r"(?i)\s{2,}(\d{1,2}:\d{2}\s*(?:AM|PM)\s+(?:CDT|CST|EST|PST|EDT|PDT))", "\n$1")
    return gap(t, ["(Arrive by", "Post-Op with"], "\n")


# --- sections with state -------------------------------------------------------------------

@step(SECTION, 26)
def past_history(t: Column) -> Column:
    def cut(line: Column) -> Column:
        return F.when(F.length(line) > 150, subs(
            line, (r"\s{2,}~\s*", "\n- "), (r"(?m)^\s*~\s*", "- "),
            (r"(\d{2}/\d{2}/\d{4})\s{2,}([A-Z~])", "$1\n$2"), (r"(\d{4})\s{2,}([A-Z~])", "$1\n$2"),
        )).otherwise(line)

    return blocks(t, whole_line(HISTORY_HEADERS), lex.HEADER_LINE, lambda p: below(p, cut))


@step(SECTION, 36)
def assessment_items(t: Column) -> Column:
    opens = r"(?i:(?=.*assessment)(?=.*plan|.*assessment:?[ \t]*$)).*$"
    closes = r"(?!(?i:.*(?:assessment|plan)))" + lex.HEADER_LINE
    return only_if(t, lambda x: x.rlike(r"[^\S\n]{2}"), lambda x: blocks(
        x, opens, closes, lambda p: below(p, lambda line: subs(
            line, (r"\s{2,}(#\s*[A-Za-z])", "\n\n$1"), (r"\s{2,}(\d+\.\s*[A-Z])", "\n\n$1"),
            (r"\s{2,}(-\s*[A-Za-z])", "\n$1")))))


@replaces(SECTION, 37)
def substance_use(t: Column) -> Column:
    t = gap(t, ["Tobacco Use", "Substance Use Topics"], "\n\n")
    return sub(t, r"(?i)\s{2,}(~\s*(?:Smoking status|Smokeless tobacco|Alcohol use|Drug use):)", "\n$1")


@replaces(SECTION, 38)
def attestations(t: Column) -> Column:
    t = gap(t, ["By signing my name", "Provider Attestation:"], "\n\n")
    t = sub(t, r"(?i)\s{2,}(I, [A-Z][a-z]+)", "\n$1")
    t = gap(t, ["personally performed"], " ")
    t = sub(t, r"\s{3,}([A-Z][a-z]+,\s*(?:MD|DO|PA|NP|APRN|RN))", "\n\n$1")
    return sub(t, r"\s{2,}(\d{2}/\d{2}/\d{2,4}\s+\d{1,2}:\d{2})", "\n$1")


@replaces(SECTION, 39)
def history_and_physical(t: Column) -> Column:
    t = gap(t, ["History and Physical", "Brief Pre-Operative H&P", "Review of symptoms:",
                "Patient Active Problem List"], "\n\n")
    t = gap(t, ["10 systems reviewed"], "\n")
    t = gap(t, ["systems negative except"], " ")
    return sub(t, r"(?i)\s{2,}(\d+\.\s*(?:To OR|R/B/A|Appropriate))", "\n$1")


@replaces(SECTION, 40)
def history_reviewed(t: Column) -> Column:
    return gap(t, ["History reviewed.", "No past medical history pertinent negatives.",
                   "No pertinent family history."], "\n")


@replaces(SECTION, 41)
def imaging_results(t: Column) -> Column:
    t = sub(t, r"(?i)\s{2,}(CT\s+(?:abdomen|pelvis|chest|head|brain|spine)"
               r"|MRI\s+(?:brain|spine|knee|shoulder)|X-ray|XR|CXR)", "\n\n$1")
    return sub(t, r"(?i)\s{2,}\(Results Pending\)", "\n(Results Pending)")


@replaces(SECTION, 42)
def discharge_headings(t: Column) -> Column:
    t = gap(t, ["New Medications", "Modified Medications", "Medications To Continue",
                "Unreviewed Medications", "Diet Instructions", "Activity Instructions",
                "Scheduled Appointments", "Other Instructions"], "\n\n")
    t = gap(t, ["What changed:"], "\n")
    return sub(t, r"\s{2,}(·\s+)", "\n$1")


@replaces(SECTION, 45)
def history_tables(t: Column) -> Column:
    t = sub(t, r"(?i)\s{2,}(Diagnosis\s+Date|Procedure\s+Laterality\s+Date|Problem\s+Relation\s+Age)", "\n\n$1")
    t = sub(t, r"(\d{2}/\d{2}/\d{4})\s{2,}(~\s*[A-Z])", "$1\n$2")
    t = sub(t, r"\s{2,}(\([A-Z0-9]+\))", " $1")
    t = gap(t, ["Procedure:", "No History of Family", "Mother", "Father", "Brother", "Sister",
                "Sibling", "Maternal", "Paternal"], "\n")
    return sub(t, r"(?i)\s{2,}(~\s*(?:Diabetes|Hypertension|Cancer|Heart|Stroke|Kidney))", "\n$1")


@replaces(SECTION, 50)
def care_instructions(t: Column) -> Column:
    t = gap(t, ["Discharge instructions -", "Discharge activity", "Discharge diet",
                "Call Dr/provider"], "\n\n")
    return gap(t, ["Commonly known as:", "Ask about:", "Care Instructions:", "Reportable signs",
                   "MD/Provider name", "MD/Provider phone", "Diet Type:", "Other (specify):",
                   "Explanatory Comment:"], "\n")


# --- sentences -----------------------------------------------------------------------------

@step(SENTENCES, 60)
def sentences(t: Column) -> Column:
    t = sub(t, r"([.!?])\s+([A-Z][a-z])", "$1\n$2")
    return sub(t, rf"(?=\n[A-Za-z])(?<={any_of(lex.ABBREVIATIONS)})\n", " ")


@replaces(SENTENCES, 61)
def sentence_gaps(t: Column) -> Column:
    return sub(t, r"([.!?])\s{2,}([A-Z])", "$1\n\n$2")


@replaces(SENTENCES, 62)
def semicolons(t: Column) -> Column:
    return sub(t, r";\s*([A-Z])", ";\n$1")


# --- headers in running text ---------------------------------------------------------------

@replaces(SECTION, 64)
def capital_headers(t: Column) -> Column:
    return sub(t, r"(?=[\sA-Z])(?<=[a-z.!?])\s*([A-Z][A-Z\s]{3,}:)", "\n\n$1")


@step(SECTION, 65)
def large_gaps(t: Column) -> Column:
    t = sub(t, r"(\d+\.)\s{2,}(\S)", "$1 $2")
    return per_line_with_gaps(t, lambda line: F.when(
        line.rlike(r"\A" + lex.TABLE_LINE), line).otherwise(sub(line, r"[ \t]{3,}", "\n")))


@replaces(SECTION, 66)
def section_breaks(t: Column) -> Column:
    t = sub(t, rf"(?m)([.!?;\])]|^)\s*({any_of(lex.LONG_HEADERS)})(?:\b|:)", "$1\n\n$2")
    return sub(t, rf"(?m)(?:^|\n|  )({any_of(lex.SAFE_WORDS)})\s*:", "\n\n$1:")


@replaces(SECTION, 67)
def headers_on_new_lines(t: Column) -> Column:
    return sub(t, rf"([.!?;\])\"])[ \t]+({any_of(lex.LONG_HEADERS)})(:?)", "$1\n\n$2$3")


@replaces(SECTION, 68)
def label_breaks(t: Column) -> Column:
    labels = any_of(lex.ROS_LABELS + lex.INLINE_EXAM_LABELS)
    return sub(t, rf"(?=\s)(?<=[A-Za-z.!?])\s+({labels})\s*:", "\n$1:")


@replaces(SECTION, 69)
def inline_labels(t: Column) -> Column:
    return sub(t, r"(?:^|\n)\s*(?=[A-Z][A-Za-z]{2,15}:)", "\n")


@replaces(SECTION, 70)
def header_lines(t: Column) -> Column:
    return sub(t, rf"(?m)^([ \t]*-?[ \t]*)({any_of(lex.SECTION_HEADERS)})(:?)[ \t]+(\S.*)$", "$1$2$3\n$4")


@replaces(SECTION, 71)
def header_numbers(t: Column) -> Column:
    return sub(t, r"(?m)^([A-Z][A-Z /&'-]{2,40}):\s+(\d+\.)", "$1:\n$2")


@replaces(SECTION, 74)
def section_colons(t: Column) -> Column:
    return sub(t, r":\s*\n", ":\n")


@replaces(SECTION, 100)
def after_colon(t: Column) -> Column:
    t = sub(t, rf"(?<!\d):\s+(?={alternation(AFTER_COLON)})", ":\n")
    return sub(t, rf"(?=\s)(?<=[a-z,])\s+(?={alternation(AFTER_WORD)})", "\n")


@replaces(SECTION, 101)
def inline_phrases(t: Column) -> Column:
    return sub(t, rf"\s+(?={alternation(INLINE_PHRASES)})", "\n")


@replaces(SECTION, 139)
def section_spacing(t: Column) -> Column:
    return sub(t, rf"\n{{1,2}}({any_of(lex.SECTION_HEADERS)})(:|\b)", "\n\n$1$2")
