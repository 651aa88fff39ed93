"""Medication, lab, vitals, system-review, social, allergy, radiology and discharge content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspan.formatting import lexicon as lex
from chartspan.formatting.breaks import gap, whole_line
from chartspan.formatting.engine import (
    GAP, below, between_marks, blocks, if_contains, join_lines, only_if, per_line, per_line_with_gaps,
    rejoin, rejoin_rules, replaces, runs, step, sub, subs, swap, trimmed_parts,
)
from chartspan.functions.text import alternation, any_of, let, quote, strip
from chartspan.operators.filters import reads_like_radiology

MEDS = "format_medications"
LABS = "format_labs"
VITALS = "format_vitals"
SYSTEMS = "format_ros_pe"

# --- fixed values --------------------------------------------------------------------------

MED_LIST_HEADERS = [
    "medications", "medication", "current medications", "home medications",
    "discharge medications", "active medications", "outpatient medications",
]
DISCHARGE_MED_HEADERS = [
    "discharge medications", "new medications", "medications to continue",
    "current medications", "medication reconciliation",
]
NOT_DRUGS = [
    "Review", "Physical", "Assessment", "History", "Social", "Family",
    "Allergies", "Labs", "Vitals", "Plan", "Diagnosis", "Chief",
]
APPOINTMENT_HEADERS = ["scheduled appointments", "future appointments", "follow-up", "follow up"]
INSTRUCTION_TRIGGERS = [
    "notify your physician for:", "call your doctor if:", "return to the emergency",
    "call if:", "watch for:", "warning signs:", "seek medical attention if:",
]
COUNTED_LABS = [
    "White Blood Cell", "Red Blood Cell", "Hemoglobin", "Hematocrit", "Platelet", "Sodium",
    "Potassium", "Chloride", "Glucose", "Creatinine", "BUN", "Calcium",
]
SPLIT_LABS = [
    "White Blood Cell", "Red Blood Cell", "Hemoglobin", "Hematocrit", "Platelet", "Mean Cell",
    "Nucleated", "Neutrophil", "Lymph", "Monocyte", "Eosinophil", "Basophil", "Sodium",
    "Potassium", "Chloride", "Carbon Dioxide", "Glucose", "BUN", "Creatinine", "Calcium",
    "Albumin", "Bilirubin", "Alkaline", "Alanine", "Aspartate", "Protein",
]
LAB_PANELS = [
    "CBC W/ DIFFERENTIAL", "CBC", "BMP", "CMP", "COMPREHENSIVE METABOLIC PANEL",
    "BASIC METABOLIC PANEL", "LIPASE LVL", "PARTIAL THROMBOPLASTIN TIME",
    "URINALYSIS W/ MICRO", "URINALYSIS", "AUTO DIFF", "URINALYSIS MICROSCOPIC",
    "POC LYTES", "HEPATIC FUNCTION PNL", "PROTHROMBIN TIME", "COAGULATION",
    "THYROID PANEL", "LIPID PANEL",
]
DENSE_EXAM_LABELS = [
    "GEN", "GENERAL", "HENT", "HEENT", "HEAD", "EYES", "EARS", "NOSE", "THROAT",
    "NECK", "RESP", "RESPIRATORY", "C/V", "CV", "CARDIOVASCULAR", "CARDIAC",
    "HEART", "LUNGS", "PULMONARY", "GI", "ABD", "ABDOMINAL", "ABDOMEN",
    "GU", "GENITOURINARY", "EXT", "EXTREMITIES", "MSK", "MUSCULOSKELETAL",
    "NEURO", "NEUROLOGIC", "NEUROLOGICAL", "PSYCH", "PSYCHIATRIC", "SKIN",
    "BACK", "SPINE", "LYMPH", "VASCULAR", "RECTAL", "BREAST",
]
SPACED_EXAM_LABELS = [
    "GENERAL", "VITALS", "EYES", "ENT", "HEENT", "NECK",
    "RESPIRATORY", "CARDIOVASCULAR", "CV", "GI", "GU",
    "ABDOMEN", "MUSCULOSKELETAL", "EXTREMITIES", "NEUROLOGIC", "SKIN",
    "General", "Vitals", "Eyes", "Neck", "Respiratory",
    "Cardiovascular", "Abdomen", "Musculoskeletal", "Extremities",
    "Neurologic", "Skin", "Psychiatric",
]
RADIOLOGY_HEADERS = [
    "FINDINGS", "IMPRESSION", "TECHNIQUE", "INDICATION", "CLINICAL INDICATION",
    "CLINICAL HISTORY", "RECOMMENDATION", "CONCLUSION", "COMPARISON",
]
SIGNATURES = [
    "Electronically signed by", "Images and interpretation reviewed and verified by",
    "Dictated by", "Transcribed by", "Verified by",
]
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
CONTINUES_DOSE = r"(?i:by mouth|oral|topical|take|inhale|\d+\s*(?:mg|mL|tablet))"


def shortest(words: list[str]) -> list[str]:
    """The words that hold no other one: a text that contains any of the words contains one of these."""
    return [w for w in words if not any(v != w and v.lower() in w.lower() for v in words)]


def containing(words: list[str]) -> str:
    """Whole-line expression for lines that contain any of the words."""
    return r".*" + any_of(shortest(words)) + r".*$"


def header_without(words: list[str]) -> str:
    """Whole-line expression for header lines that contain none of the words."""
    return "(?=" + lex.HEADER_LINE + r")(?!.*" + any_of(shortest(words)) + r")" + lex.HEADER_LINE


def when_long(least: int, fn):
    return lambda line: F.when(F.length(line) > least, fn(line)).otherwise(line)


# --- medications ---------------------------------------------------------------------------

@step(MEDS, 13)
def problem_and_drug_lists(t: Column) -> Column:
    def cut(line: Column) -> Column:
        return (
            F.when(line.rlike(r"(?i)Active Problems:") & (F.length(line) > 100),
                   sub(line, r"\s{2,}([A-Z][a-z][a-zA-Z\s,()-]+)(?=\s{2,}|\z)", "\n- $1"))
            .when(line.rlike(r"~\s+[a-zA-Z]+\s+\d") & (F.length(line) > 150),
                  sub(line, r"\s*~\s+", "\n- "))
            .otherwise(line)
        )

    return only_if(t, lambda x: x.rlike(r"(?i)Active Problems:|~\s"), lambda x: per_line(x, cut))


@step(MEDS, 30)
def medication_sigs(t: Column) -> Column:
    heads = ["medications", "home medications", "discharge medications",
             "prior to admission medications", "new medications", "modified medications",
             "medications to continue"]
    cut = when_long(120, lambda line: subs(
        line, (r"\s+~\s+", "\n- "), (r"(?i)\s{2,}(Sig\s+[a-zA-Z])", "\n$1"),
        (r"(\d+\s*(?:mg|mcg|mL|tablet|capsule)[^~]*?)\s{2,}([a-z]+[A-Z]|[A-Z][a-z]+\s+\d)", "$1\n- $2")))
    return blocks(t, containing(heads), header_without(heads), lambda p: below(p, cut))


@step(MEDS, 75)
def stuck_header(t: Column) -> Column:
    return only_if(t, lambda x: x.rlike("(?i)medications"), lambda x: subs(
        x, (r"(?i)(?<!\n)(Medications)(?=\S)", "\n$1"), (r"(?i)(Medications)(?=\S)", "$1\n")))


@step(MEDS, 76)
def medication_bullets(t: Column) -> Column:
    line_is_drug = r"(?![ \t]*[-•])(?=.*?" + lex.MEDICATION + ")"
    return blocks(
        t, whole_line(MED_LIST_HEADERS), header_without(["medication", "allerg"]),
        lambda p: sub(p, rf"(?m)(?<=\n){line_is_drug}[ \t]*(\S(?:.*[^ \t\n])?)[ \t]*$", "- $1"))


@step(MEDS, 77)
def drug_bullets(t: Column) -> Column:
    drug = (r"(?:[a-z][a-zA-Z-]+[ \t](?:[a-zA-Z \t-]*[ \t])?(?:\d|\([A-Z]|[a-z]*[A-Z])"
            r"|[a-z]+[A-Z]+[a-zA-Z]*[ \t]+\d)")
    return blocks(
        t, r"(?=.*(?i:medications)).*:.*$", header_without(["medication"]),
        lambda p: sub(p, rf"(?m)(?<=\n)[ \t]*(?={drug})(\S.*?)[ \t]*$", "- $1"))


@step(MEDS, 78)
def merged_drugs(t: Column) -> Column:
    gone = r",?\s*Disp:\s*,?\s*Rfl:\s*"
    return if_contains(t, ["Rfl:"], lambda x: subs(
        x, (rf"{gone}(?={alternation(NOT_DRUGS)})", "\n\n"), (rf"{gone}(?=[A-Za-z])", "\n- ")))


@step(MEDS, 79)
def empty_refills(t: Column) -> Column:
    t = if_contains(t, ["Disp:", "Rfl:"], lambda x: subs(
        x, (r"(?m),?\s*Disp:\s*,?\s*Rfl:\s*$", ""), (r",\s*Disp:\s*\n", "\n"), (r"(?m),\s*Rfl:\s*$", "")))
    return sub(t, r"(\d)\s*\n\s*(mg|mcg|mL|g)([- ])", "$1 $2$3")


@step(MEDS, 80)
def refills_and_quantities(t: Column) -> Column:
    def cut(line: Column) -> Column:
        fixed = subs(
            strip(line),
            (r"(?i)(Refills?:\s*\d+)\s+([a-z][a-zA-Z-]+(?:\s+[\d.]+)?(?:\s*%)?(?:\s+\w+)?)", "$1\n$2"),
            (r"(?i)(Quantity:\s*\d+\s*\w*)\s+([a-z][a-zA-Z-]+\s+\d)", "$1\n$2"))
        return F.when(
            F.lower(line).contains("refill") & (F.length(strip(line)) > 60),
            let(fixed, lambda f: F.when(f.contains("\n"), f).otherwise(line)),
        ).otherwise(line)

    return only_if(t, lambda x: x.rlike("(?i)refill"), lambda x: per_line(x, cut))


@step(MEDS, 81)
def also_known_as(t: Column) -> Column:
    t = only_if(t, lambda x: x.rlike(GAP) & x.rlike("(?i)also known as"), lambda x: per_line(
        x, lambda line: F.when(
            (F.length(strip(line)) > 120) & line.rlike("(?i)also known as"),
            sub(strip(line), r"\s{2,}", "\n")).otherwise(line)))
    dosing = r"(?:daily|twice a day|three times a day|every \d+ hours|as needed|at bedtime)[ \t]+"
    return only_if(t, lambda x: x.rlike(r"(?i)\d[ \t]*(?:m|g|%)"), lambda x: sub(
        x, rf"(?i)({dosing})([a-z][a-zA-Z-]+[ \t]+\d+(?:[.,]\d+)?[ \t]*(?:mg|mcg|mL|g|%))", "$1\n$2"))


@step(MEDS, 82)
def drug_continuations(t: Column) -> Column:
    member = (rf"(?!{lex.HEADER_LINE})(?!.*{lex.MEDICATION})[ \t]*(?:{CONTINUES_DOSE}|[a-z])")
    return only_if(t, lambda x: x.rlike(lex.MEDICATION), lambda x: runs(
        x, member, lambda p: F.substring_index(p, "\n", 1).rlike(lex.MEDICATION), join_lines))


@step(MEDS, 83)
def one_drug_per_line(t: Column) -> Column:
    def cut(line: Column) -> Column:
        parts = F.filter(F.split(strip(line), r"\s{3,}"), lambda x: x != "")
        listed = F.transform(parts, lambda p: F.when(p.startswith("-"), p).otherwise(F.concat(F.lit("- "), p)))
        drugs = F.forall(parts, lambda p: p.rlike(r"(?i)\A[a-z]") & p.rlike(r"\d"))
        return F.when((F.length(strip(line)) > 100) & (F.size(parts) > 1) & drugs,
                      F.array_join(listed, "\n")).otherwise(line)

    return only_if(t, lambda x: x.rlike(r"[^\S\n]{3}"), lambda x: blocks(
        x, r"(?=.*(?i:medications)).*:.*$", header_without(["medication"]), lambda p: below(p, cut)))


@step(MEDS, 84)
def missing_words(t: Column) -> Column:
    return only_if(t, lambda x: x.rlike("(?i)on file prior to encounter"), lambda x: subs(
        x,
        (r"(?i)No current facility-administered on file prior to encounter\.",
         "No current facility-administered medications on file prior to encounter."),
        (r"(?i)Current Outpatient\s*\n-?\s*on File Prior to Encounter",
         "Current Outpatient Medications on File Prior to Encounter")))


@step(MEDS, 85)
def drug_line_ends(t: Column) -> Column:
    return subs(t, (r",\s*\n(?=\s*-)", "\n"), (r"(?i)(\w)(\d+\s*tablet)", "$1 $2"))


# --- labs ----------------------------------------------------------------------------------

@step(LABS, 27)
def dense_lab_lines(t: Column) -> Column:
    def kinds(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(rf"({any_of(COUNTED_LABS)})(?:(?<=Cell)s)?\s+[\d.]+"), F.lit(1))
        return F.size(F.array_distinct(F.transform(found, F.lower)))

    pattern = rf"\s{{2,}}({any_of(SPLIT_LABS)})"
    return only_if(t, lambda x: x.rlike(pattern), lambda x: per_line_with_gaps(x, lambda line: F.when(
        (F.length(line) > 100) & line.rlike(pattern) & (kinds(line) >= 2), sub(line, pattern, "\n$1")).otherwise(line)))


@step(LABS, 31)
def lab_tables(t: Column) -> Column:
    def cut(line: Column) -> Column:
        return (
            F.when(line.rlike(r"(?i)Component\s+Value\s+Date"), line)
            .when(line.rlike(r"(?i)Lab Results\s+Component"),
                  sub(line, r"(?i)\s+(Lab Results)\s+(Component)", "\n\n$1\n$2"))
            .when((F.length(line) > 100) & line.rlike(r"[A-Z]+\s+[\d.]+\s+\d{2}/\d{2}/\d{4}"),
                  sub(line, r"\s{2,}([A-Z]+)\s+([\d.]+)\s+(\d{2}/\d{2}/\d{4})", "\n$1 $2 $3"))
            .otherwise(line)
        )

    return only_if(
        t, lambda x: x.rlike(r"\s{2,}[A-Z]+\s+[\d.]+\s+\d{2}/\d{2}/\d{4}") | x.rlike(r"(?i)Lab Results\s+Component"),
        lambda x: per_line(x, cut))


@replaces(LABS, 32)
def intake_output(t: Column) -> Column:
    t = gap(t, ["Intake/Output Summary"], "\n\n")
    t = gap(t, ["Last data filed at", "Gross per 24 hour"], "\n")
    for name, unsigned in (("Intake", ""), ("Output", ""), ("Net", "-?")):
        t = sub(t, rf"(?i)\s{{2,}}{name}\s{{2,}}({unsigned}\d+\s*ml)", f"\n{name}: $1")
    return t


@step(LABS, 33)
def result_values(t: Column) -> Column:
    names = alternation(lex.RESULT_LAB_NAMES)

    def count(line: Column) -> Column:
        # a name inside a longer one counts too, so every position is tried
        found = F.regexp_count(line, F.lit(rf"(?={names})"))
        inner = F.regexp_count(line, F.lit("Nucleated RBC Abs|Mean Cell Hemoglobin Concentration"))
        return found + inner

    pattern = rf"\s{{2,}}({names})\s"
    return only_if(t, lambda x: x.rlike(pattern), lambda x: per_line_with_gaps(x, lambda line: F.when(
        (F.length(line) > 80) & line.rlike(pattern) & (count(line) >= 2), sub(line, pattern, "\n$1 ")).otherwise(line)))


@replaces(LABS, 34)
def lab_panels(t: Column) -> Column:
    return sub(t, rf"(?<=[^\n])\s{{2,}}({any_of(LAB_PANELS)})", "\n\n$1")


@replaces(LABS, 35)
def abnormal_flags(t: Column) -> Column:
    return subs(t, (r"(?i)\s+-\s+(Abnormal|Normal)\s{2,}(Result\s+Value)", " - $1\n$2"),
                (r"(?i)\s{3,}(Result\s+Value)", "\n\n$1"))


@step(LABS, 104)
def lab_values(t: Column) -> Column:
    """Names are taken one after the other: a short name met first cuts a longer one.

    No name holds one of the marks, so each stretch between them is cut by itself.
    """
    def cut(x: Column) -> Column:
        for name in lex.LAB_NAMES:
            x = sub(x, rf"(?i)\s+({quote(name)})\s", "\n$1 ")
        return x

    named = rf"\s{any_of(lex.LAB_NAMES)}\s"
    return only_if(t, lambda x: x.rlike(named), lambda x: between_marks(
        x, ".,;:()", lambda part: only_if(part, lambda y: y.rlike(named), cut)))


@step(LABS, 105)
def dense_lab_blocks(t: Column) -> Column:
    def cut(line: Column) -> Column:
        parts = F.filter(F.split(line, r"\s{2,}"), lambda x: x != "")
        return F.when(
            (F.length(line) > 100) & line.rlike(lex.LAB_RESULT) & (F.size(parts) > 2),
            F.array_join(parts, "\n")).otherwise(line)

    labs = [h for h in lex.HEADERS_LOWER if "lab" in h]
    opens = r"(?:(?=.*(?i:lab)).*::[ \t]*$|" + whole_line(labs) + ")"
    return only_if(t, lambda x: x.rlike(GAP), lambda x: blocks(
        x, opens, header_without(["lab"]), lambda p: per_line(p, cut)))


@step(LABS, 106)
def lab_blank_lines(t: Column) -> Column:
    return blocks(
        t, r"(?=.*(?i:lab)).*:[ \t]*$", header_without(["lab"]),
        lambda p: sub(p, r"\n[ \t]*\n[ \t\n]*\n", "\n\n"))


# --- vitals --------------------------------------------------------------------------------

VITAL = r"(?:Temp|Pulse|Resp|BP|SpO2)"


@replaces(VITALS, 28)
def dense_vitals(t: Column) -> Column:
    t = sub(t, r"(\d+(?:\.\d+)?\s*°?[CF]?)\s{2,}(\d+)\s{2,}(\d+)\s{2,}(\d+/\d+)\s{2,}(\d+\s*%?)",
            "Temp: $1\nPulse: $2\nResp: $3\nBP: $4\nSpO2: $5")
    return sub(t, r"\s{2,}(Temp src|Pulse Source|Patient Position|BP Location|FiO2)", "\n$1")


@step(VITALS, 72)
def bmi_lines(t: Column) -> Column:
    return if_contains(t, ["m²", "M²"], lambda x: sub(
        x, r"(?i)(BMI\s+[0-9]+(?:\.[0-9]+)?\s*kg/m²)", "\n$1\n"))


@step(VITALS, 107)
def vital_colons(t: Column) -> Column:
    return sub(t, r"(?i)\b(BP|HR|RR|Temp|SpO2|O2\s*Sat|Pulse|Weight|Height|BMI)\s*[:=]?\s*(\d)", "$1: $2")


@step(VITALS, 108)
def emergency_vitals(t: Column) -> Column:
    return sub(t, r"(?i)\b(ED\s+Vitals?:?)\s*(\d)", "$1\n$2")


@step(VITALS, 109)
def vitals_rows(t: Column) -> Column:
    measure = r"(?i)\b(?:BP|HR|RR|Temp|SpO2|O2\s*Sat|Pulse)\s*[:=]?\s*[\d./]+"
    return only_if(t, lambda x: F.regexp_count(x, F.lit(measure)) > 2, lambda x: per_line(
        x, lambda line: F.when(
            F.regexp_count(line, F.lit(measure)) > 2,
            sub(line, r"(?i)\s+(BP|HR|RR|Temp|SpO2|Pulse)\s*[:=]?\s*(\d)", "\n$1: $2")).otherwise(line)))


@step(VITALS, 110)
def split_vitals(t: Column) -> Column:
    return sub(t, r"(?m)^(?=.*+\n[ \t]*+(?:\d|and))[ \t]*(.*(?:BP|HR|RR|Temp|TEMP|SpO2|O2|Pulse|Resp))[ \t]*\n[ \t]*((?:\d|and).*)$", "$1 $2")


@step(VITALS, 111)
def vitals_headers(t: Column) -> Column:
    return sub(t, rf"(?m)^\s*{VITAL}\s+{VITAL}.*$", "")


@step(VITALS, 112)
def vitals_column_names(t: Column) -> Column:
    name = r"(?:Temp|Pulse|Resp|BP|SpO2|O2\s*Sat)"
    return sub(t, rf"(?im)^\s*{name}(?:\s+{name})+\s*$", "")


@step(VITALS, 113)
def vitals_on_one_line(t: Column) -> Column:
    one = r"[ \t]*(?:BP|HR|RR|Temp|SpO2):[ \t]*[\d./]+[ \t]*"
    return sub(t, rf"(?im)^({one}(?<=\S))[ \t]*\n[ \t]*(?={one}$)", "$1  ")


# --- review of systems, physical exam ------------------------------------------------------

@step(SYSTEMS, 43)
def dense_exam(t: Column) -> Column:
    label = any_of(DENSE_EXAM_LABELS)
    pattern = rf"\s{{2,}}({label})\s*:"
    return only_if(t, lambda x: x.rlike(pattern), lambda x: per_line_with_gaps(x, lambda line: F.when(
        line.rlike(pattern) & (F.regexp_count(line, F.lit(rf"\b{label}\s*:")) >= 2), sub(line, pattern, "\n$1:")).otherwise(line)))


@step(SYSTEMS, 44)
def dense_review(t: Column) -> Column:
    return per_line_with_gaps(t, lambda line: F.when(
        (F.length(line) > 100) & (F.regexp_count(line, F.lit("(?i)(?:Positive|Negative) for")) >= 2),
        sub(line, rf"\s{{2,}}({any_of(lex.ROS_LABELS)})\s*:", "\n$1:")).otherwise(line))


@step(SYSTEMS, 87)
def inline_review(t: Column) -> Column:
    return sub(t, rf"([.;,])\s*({any_of(lex.ROS_LABELS)})\s*:", "$1\n$2:")


def stacked(t: Column, labels: list[str], doubled: str | None = None) -> Column:
    """Lines with more than one label are cut before each label."""
    label = any_of(labels)

    def count(line: Column) -> Column:
        n = F.regexp_count(line, F.lit(rf"\b(?={label}\s*:)"))
        return n + F.regexp_count(line, F.lit(rf"(?i)\b(?:{doubled})\s*:")) if doubled else n

    pattern = rf"\s+({label})\s*:"
    return only_if(t, lambda x: x.rlike(pattern) & (count(x) > 1), lambda x: per_line(x, lambda line: F.when(
        line.contains(":") & line.rlike(pattern) & (count(line) > 1), sub(line, pattern, "\n$1:")).otherwise(line)))


@step(SYSTEMS, 88)
def stacked_review(t: Column) -> Column:
    return stacked(t, lex.ROS_LABELS)


def _stop(bullets: str) -> str:
    """Lines at which a label's content ends."""
    return rf"(?:[ \t]*$|{lex.HEADER_LINE}|{lex.SYSTEM_LINE}|[ \t]*(?:{bullets}|\d+\.\s))"


@step(SYSTEMS, 89)
def label_continuations(t: Column) -> Column:
    """A label on a line of its own takes in the lines up to the next stop."""
    member = rf"(?!{_stop('[-*•] ')})"
    return only_if(t, lambda x: x.rlike(rf"(?m)^{lex.SYSTEM_LINE}"), lambda x: runs(
        x, member, lambda p: p.rlike(rf"(?md)\A{lex.SYSTEM_LINE}"),
        lambda p: join_lines(sub(p, r"\A[ \t]+", ""))))


@step(SYSTEMS, 90)
def review_layout(t: Column) -> Column:
    """``Label: content`` on one line when it fits in 110 characters, else on two."""
    label = rf"(?m)^[ \t]*({any_of(lex.ROS_LABELS)}):(?=.*$)"
    member = rf"(?!{_stop('- ')})"

    def lay_out(piece: Column) -> Column:
        # text before the first label line, the label, everything behind it
        head = F.regexp_extract(piece, rf"(?s)\A(.*?)(?={label})", 1)
        rest = F.substring(piece, F.length(head) + 1, F.length(piece))
        name = F.regexp_extract(rest, label, 1)
        tail = F.regexp_extract(rest, r"(\n*)\z", 1)
        body = F.regexp_replace(
            strip(F.substring(rest, F.locate(":", rest) + 1, F.length(rest))), r"[ \t]*\n[ \t]*", " ")
        return let(body, lambda b: F.concat(head, name, F.lit(":"), F.when(b == "", "").when(
            F.length(name) + 2 + F.length(b) <= 110, F.concat(F.lit(" "), b)
        ).otherwise(F.concat(F.lit("\n"), b)), tail))

    return only_if(t, lambda x: x.rlike(label), lambda x: runs(
        x, member, lambda p: p.rlike(label), lay_out))


@step(SYSTEMS, 93)
def inline_exam(t: Column) -> Column:
    return sub(t, rf"([.;])\s*({any_of(lex.EXAM_LABELS)})\s*:", "$1\n$2:")


@step(SYSTEMS, 94)
def stacked_exam(t: Column) -> Column:
    return stacked(t, lex.INLINE_EXAM_LABELS, "psych|vitals")


EXAM_ENDS = rf"(?!{lex.SYSTEM_LINE}){lex.HEADER_LINE}"


@step(SYSTEMS, 95)
def exam_semicolons(t: Column) -> Column:
    def cut(line: Column) -> Column:
        return F.when(line.contains(";"), let(trimmed_parts(F.split(line, ";")), lambda parts: F.when(
            F.size(parts) > 1, F.array_join(parts, "\n")).otherwise(line))).otherwise(line)

    return if_contains(t, [";"], lambda x: blocks(
        x, lex.PE_LINE, EXAM_ENDS, lambda p: per_line(p, cut)))


@step(SYSTEMS, 96)
def label_colons(t: Column) -> Column:
    return only_if(t, lambda x: x.rlike(r":\S"), lambda x: sub(
        x, rf"\b({alternation(SPACED_EXAM_LABELS)}):(\S)", "$1: $2"))


@step(SYSTEMS, 97)
def exam_sub_labels(t: Column) -> Column:
    main, minor = any_of(lex.EXAM_LABELS), any_of(lex.EXAM_SUB_LABELS)
    combo = rf"[ \t]*(?:-[ \t]*)?{minor}:"
    under = rf"[ \t]*(?:-[ \t]*)?({minor}):[ \t]*(.*?)[ \t]*$"
    return blocks(t, lex.PE_LINE, EXAM_ENDS, lambda p: subs(
        p,
        (rf"(?im)(?<=\n)([ \t]*({main}):(?!{combo}).*)\n[ \t]*\2:{under}", "$1\n  - $3: $4"),
        (rf"(?im)(?<=\n)[ \t]*({main}):{under}", "$1:\n  - $2: $3")))


# Findings broken over lines, as their parts and as they are meant.
FINDINGS = {
    "Normal breath sounds": "Normal breath sounds",
    "Normal heart sounds": "Normal heart sounds",
    "Normal rate and": "Normal rate and",
}
_FINDINGS = rejoin_rules({}, FINDINGS)


@step(SYSTEMS, 98)
def exam_findings(t: Column) -> Column:
    return rejoin(t, _FINDINGS)


# --- social history, allergies -------------------------------------------------------------

@step("format_social", 102)
def social_values(t: Column) -> Column:
    item = (r"(?i:-?[ \t]*(?:smoking status|alcohol use|drug use|tobacco use|substance use).*"
            r"|never smoker|current smoker.*|former smoker.*)")
    value = rf"(?!{lex.HEADER_LINE})(?!{lex.SOCIAL_LINE})(?![ \t]*(?:[-*]|\d+\.))"
    detail = r"[ \t]*(?i:types:|packs/day|years:|start date|quit date)"

    def join(x: Column) -> Column:
        x = sub(x, rf"(?m)^(?!{lex.SOCIAL_LINE})([ \t]*{item})(?<=\S)[ \t]*\n\s*?(?={value}[ \t]*\S){value}[ \t]*(\S.*?)[ \t]*$", "$1 $2")
        return runs(x, detail, lambda p: F.lower(F.substring_index(p, "\n", 1)).contains("smoking status"), join_lines)

    return only_if(t, lambda x: x.rlike(r"(?i)smok|(?:alcohol|drug|tobacco|substance) use"), join)


@step("format_allergies", 29)
def allergen_lists(t: Column) -> Column:
    return if_contains(t, ["~"], lambda x: blocks(
        x, whole_line(["allergies", "allergen reactions"]), header_without(["allerg"]),
        lambda p: below(p, when_long(80, lambda line: sub(line, r"\s+~\s+", "\n- ")))))


@step("format_allergies", 149)
def allergy_bullets(t: Column) -> Column:
    return blocks(
        t, r"(?=.*(?i:allergies)).*:[ \t]*$", header_without(["allerg"]),
        lambda p: sub(p, rf"(?m)(?<=\n)(?!{lex.HEADER_LINE})(?!.*(?i:no known))[ \t]*(?![-•])(\S.*?)[ \t]*$", "- $1"))


# --- radiology -----------------------------------------------------------------------------

def radiology_note(t: Column) -> Column:
    heads = any_of(RADIOLOGY_HEADERS)
    # "INDICATION" is looked for before "CLINICAL INDICATION", so only the short form breaks
    inline = any_of([h for h in RADIOLOGY_HEADERS if h != "CLINICAL INDICATION"])

    def lay_out(x: Column) -> Column:
        x = swap(x, rf"(?<=[^\n]){inline}:", lambda m: F.concat(F.lit("\n\n"), F.upper(m)))
        return subs(
            x,
            (rf"(?m)^({heads}:)\s*(?=\S.{{15,}}$)", "$1\n"),
            (r"([.!?])\s+(\d+)\.\s+(?=[A-Z])", "$1\n$2. "),
            (r"(?i)(IMPRESSION:)\s*(\d+)\.\s+", "$1\n$2. "),
            (r"(?i)\n\s*END\s+OF\s+(?:IMPRESSION|REPORT)\s*\n?", "\n"))

    return only_if(t, reads_like_radiology, lay_out)


step("format_radiology", 57, 153)(radiology_note)


@step("format_radiology", 58)
def comparison_dates(t: Column) -> Column:
    def lay_out(m: Column) -> Column:
        head = F.substring(m, F.lit(1), F.locate(":", m))
        dates = trimmed_parts(F.split(F.substring(m, F.locate(":", m) + 1, F.length(m)), r",\s*"))
        return let(dates, lambda d: F.when(
            F.size(d) > 3,
            F.concat(head, F.lit("\n"), F.array_join(F.transform(d, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n")),
        ).otherwise(F.concat(head, F.lit(" "), F.array_join(d, ", "))))

    return swap(t, r"(?i)COMPARISON:[ ]*(?:\d{2}/\d{2}/\d{4}[, ]*+)++", lay_out)


@step("format_radiology", 59)
def radiology_signatures(t: Column) -> Column:
    t = sub(t, r"(?i)Images and interpretation reviewed and\s+verified by", "Images and interpretation reviewed and verified by")
    return sub(t, rf"([.!?])\s*({any_of(SIGNATURES)})", "$1\n\n$2")


# --- discharge -----------------------------------------------------------------------------

@step("format_discharge", 134)
def discharge_medications(t: Column) -> Column:
    def cut(line: Column) -> Column:
        fixed = sub(strip(line), r"(?i)(Refills?:\s*\d+)\s+([a-z][a-zA-Z-]+(?:\s+[a-zA-Z-]*)?\s+\d)", "$1\n$2")
        return F.when(F.length(strip(line)) > 100, let(fixed, lambda f: F.when(
            f.contains("\n"), f).otherwise(line))).otherwise(line)

    return only_if(t, lambda x: x.rlike("(?i)refill"), lambda x: blocks(
        x, containing(DISCHARGE_MED_HEADERS), header_without(DISCHARGE_MED_HEADERS + ["sig"]),
        lambda p: below(p, cut)))


@step("format_discharge", 135)
def appointments(t: Column) -> Column:
    date = rf"(?i)(?:{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}})"

    def cut(line: Column) -> Column:
        from chartspan.functions.text import OPEN

        parts = F.split(sub(strip(line), date, OPEN + "$0"), OPEN)
        return let(parts, lambda p: F.when(
            F.size(p) > 2,
            F.array_join(trimmed_parts(F.concat(
                F.array(F.concat(F.element_at(p, 1), F.element_at(p, 2))),
                F.slice(p, 3, F.size(p)))), "\n"),
        ).otherwise(line))

    return blocks(
        t, containing(APPOINTMENT_HEADERS), header_without(APPOINTMENT_HEADERS),
        lambda p: below(p, lambda line: F.when(F.length(strip(line)) > 150, cut(line)).otherwise(line)))


@step("format_discharge", 136)
def instructions(t: Column) -> Column:
    def cut(line: Column, trigger: str) -> Column:
        s = strip(line)
        end = F.locate(trigger, F.lower(s)) + len(trigger) - 1
        items = trimmed_parts(F.split(strip(F.substring(s, end + 1, F.length(s))), r"(?=[A-Z][a-z]+\s)"))
        return F.array_join(F.concat(
            F.array(F.substring(s, F.lit(1), end)),
            F.transform(items, lambda x: F.concat(F.lit("- "), x))), "\n")

    def choose(line: Column) -> Column:
        low, long = F.lower(line), F.length(strip(line)) > 150
        out = F.when(F.lit(False), line)
        for trigger in INSTRUCTION_TRIGGERS:
            out = out.when(long & low.contains(trigger), cut(line, trigger))
        return out.otherwise(line)

    return only_if(t, lambda x: x.rlike(any_of(INSTRUCTION_TRIGGERS)), lambda x: per_line(x, choose))
