"""Clean-up, bullets, rejoining of broken headers, words and lines, wrapping."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspan.formatting import lexicon as lex
from chartspan.formatting.engine import (
    Rule, between_marks, blocks, if_contains, join_lines, lookup, only_if, per_line, rejoin, rejoin_rules, runs, step,
    sub, subs, swap, trimmed_parts, where_found,
)
from chartspan.functions.text import alternation, any_of, let, strip

CLEAN = "format_clean"
BULLETS = "format_bullets"
REJOIN = "format_rejoin_headers"
WORDS = "format_word_splits"
MERGE = "format_merge_lines"
WRAP = "format_wrap"
DEDUPE = "format_dedupe_headers"

# --- fixed values: phrases that arrive broken over lines, as their parts and as they are meant ---

# Whole words.
PHRASES = {
    "Assessment & Plan": "Assessment & Plan",
    "Delayed nephrogram": "Delayed nephrogram",
    "Diagnostic Studies": "Diagnostic Studies",
    "ED Course": "ED Course",
    "ED Course & MDM": "ED Course & MDM",
    "ED Labs and Imaging": "ED Labs and Imaging",
    "eGFR cr": "eGFRcr",
    "extensive history": "extensive history",
    "Family History": "Family History",
    "FINDINGS / IMPRESSION": "FINDINGS/IMPRESSION",
    "FINDINGS IMPRESSION": "FINDINGS/IMPRESSION",
    "Follow-up Care": "Follow-up Care",
    "Follow-up Care and Appointments": "Follow-up Care and Appointments",
    "Further history": "Further history",
    "history of": "history of",
    "IMPRESSION FINDINGS": "IMPRESSION FINDINGS/",
    "Labs and Imaging": "Labs and Imaging",
    "Lactic Acid": "Lactic Acid",
    "Lactic Acid Level": "Lactic Acid Level",
    "Limited evaluation": "Limited evaluation",
    "Limited exam": "Limited exam",
    "Limited study": "Limited study",
    "Medical Decision Making": "Medical Decision Making",
    "Mental Status": "Mental Status",
    "negative for": "negative for",
    "Neuro exam": "Neuroexam",
    "no evidence of": "no evidence of",
    "No results found": "No results found",
    "other medications": "other medications",
    "Past Medical History": "Past Medical History",
    "Past Surgical History": "Past Surgical History",
    "Physical Exam": "Physical Exam",
    "Physical Examination": "Physical Examination",
    "positive for": "positive for",
    "RDW CV": "RDW CV",
    "RDW SD": "RDW SD",
    "reason for exam": "reason for exam",
    "reason for study": "reason for study",
    "reason for visit": "reason for visit",
    "Review of Systems": "Review of Systems",
    "due to artifact": "due to artifact",
    "due to motion": "due to motion",
    "Social History": "Social History",
    "Some medications": "Some medications",
    "the medications": "the medications",
    "Thought Cont ent": "Thought Content",
    "treatment plan": "treatment plan",
    "Troponin - I": "Troponin-I",
    "Troponin I": "Troponin-I",
    "Vital Signs": "Vital Signs",
    "without evidence": "without evidence",
}

# The same for phrases that may go on within a word ("medication", "medications").
STEMS = {
    "above medication": "above medication",
    "COURSE AND MEDICAL": "COURSE AND MEDICAL",
    "over-the-counter medications": "over-the-counter medications",
    "primary care provider": "primary care provider",
    "the above medication": "the above medication",
    "Thought Content": "Thought Content",
}

# Headers, which may go on as well.
SET_HEADERS = {
    "ADMITTING DIAGNOSIS": "ADMITTING DIAGNOSIS",
    "Assessment & Plan": "Assessment & Plan",
    "CODE STATUS": "CODE STATUS",
    "COURSE AND MEDICAL": "COURSE AND MEDICAL",
    "DISCHARGE DIAGNOSIS": "DISCHARGE DIAGNOSIS",
    "DISCHARGE INSTRUCTIONS": "DISCHARGE INSTRUCTIONS",
    "ED Course & MDM": "ED Course & MDM",
    "ED Course and MDM": "ED Course & MDM",
    "ED COURSE AND MEDICAL": "ED COURSE AND MEDICAL",
    "ED COURSE AND MEDICAL DECISION MAKING": "ED COURSE AND MEDICAL DECISION MAKING",
    "ED Labs and Imaging": "ED Labs and Imaging",
    "eGFR cr": "eGFRcr",
    "FINAL DIAGNOSIS": "FINAL DIAGNOSIS",
    "FINDINGS / IMPRESSION": "FINDINGS/IMPRESSION",
    "History of Present": "History of Present",
    "IMPRESSION FINDINGS /": "IMPRESSION FINDINGS/",
    "Labs and Imaging": "Labs and Imaging",
    "Lactic Acid": "Lactic Acid Level",
    "Lactic Acid Level": "Lactic Acid Level",
    "Neuro exam": "Neuroexam",
    "POSTOPERATIVE DIAGNOSIS": "POSTOPERATIVE DIAGNOSIS",
    "PREADMISSION DIAGNOSIS": "PREADMISSION DIAGNOSIS",
    "PREOPERATIVE DIAGNOSIS": "PREOPERATIVE DIAGNOSIS",
    "RDW CV": "RDW CV",
    "RDW SD": "RDW SD",
    "Review of Systems": "Review of Systems",
    "Thought Content": "Thought Content",
    "Troponin - I": "Troponin-I",
    "Troponin I": "Troponin-I",
}

# Whole words of headers cut by the page width, then those that may go on.
WRAPPED_WORDS = {
    "Assessment and Plan": "Assessment and Plan",
    "Chief Complaint": "Chief Complaint",
    "ED Course": "ED Course",
    "ED Diagnosis": "ED Diagnosis",
    "Family History": "Family History",
    "History of Present Illness": "History of Present Illness",
    "Past Medical History": "Past Medical History",
    "Past Surgical History": "Past Surgical History",
    "Physical Exam": "Physical Exam",
    "Physical Examination": "Physical Examination",
    "Review of Systems": "Review of Systems",
    "Social History": "Social History",
    "Vital Signs": "Vital Signs",
}
WRAPPED_STEMS = {
    "CARDIO VASCULAR": "CARDIOVASCULAR",
    "Endo/ Heme/ Aller gies": "Endo/Heme/Allergies",
    "GI/ Abdomen:": "GI/Abdomen:",
    "GI/ GU:": "GI/GU:",
    "H EENT:": "HEENT:",
    "H ENT:": "HENT:",
    "HEENT/ Neck:": "HEENT/Neck:",
    "MUSCULO SKELETAL": "MUSCULOSKELETAL",
    "NEURO LOGIC": "NEUROLOGIC",
}

SLASH_LABELS = {
    "GI/ GU:": "GI/GU:",
    "HEENT/ Neck:": "HEENT/Neck:",
    "Psychiatric/ Behavioral:": "Psychiatric/Behavioral:",
    "Pulmonary/ Chest:": "Pulmonary/Chest:",
}

# Broken headers that keep their letters: (first part, what follows on the next line).
KEPT_HEADERS = [
    ("Past Medical|Past Surgical|Family Medical|Family|Social|Brief", "History"),
    ("Hospital", "Course"),
    ("Physical", "Exam"),
    ("Assessment", "and Plan"),
    ("Review of", "Systems"),
    ("History of Present", "Illness"),
    ("History of", "Present Illness"),
    ("Chief", "Complaint"),
    ("Vital", "Signs"),
    ("Mental", "Status"),
    ("Current|Discharge|Home", "Medications"),
    ("Laboratory", "values"),
    ("Labs", r"&\s*Imaging"),
    ("Medical", r"Decision\s+Making"),
    ("Condition (?:on|at)", "Discharge"),
]

DRUG_NAMES = {
    "amlodipine": "amLODIPine", "sildenafil": "sildenafiL", "tadalafil": "tadalafiL",
    "prilosec": "PriLOSEC",
}

STOP_WORDS = ["of", "and", "the", "for", "to", "in", "on", "at", "with", "by", "per", "or", "a", "an"]
PREPOSITIONS = ["of", "in", "to", "for", "with", "on", "at", "by", "from", "as", "or", "and", "the", "a", "an"]
UNITS = ["mg", "ml", "mcg", "kg", "cm", "mm", "http", "www"]
LONE_WORDS = (r"(?:(?i:history|exam|results|found\.?|plan|medications?|of|study|evaluation|motion|for)"
              r"|POS|Final)")

_COMPOUND = rejoin_rules(PHRASES, STEMS)
_SET = rejoin_rules({}, SET_HEADERS)
_WRAPPED = rejoin_rules(WRAPPED_WORDS, WRAPPED_STEMS)
_SLASHED = rejoin_rules({}, SLASH_LABELS)

HEADER = lex.HEADER_LINE


# --- cleaning ------------------------------------------------------------------------------

@step(CLEAN, 1)
def plain_characters(t: Column) -> Column:
    t = if_contains(t, ["\u00a0"], lambda x: F.translate(x, "\u00a0", " "))
    return where_found(t, ["\r"], (r"\r\n?", "\n"))


@step(CLEAN, 5)
def break_tags(t: Column) -> Column:
    return if_contains(t, ["br", "BR", "Br", "bR"], lambda x: subs(
        x, (r"(?i)<br\s*/?>", "\n"), (r"(?m)(?:^|\n)\s*br>\s*(?:\n|$)", "\n"),
        (r"(?i)\Abr>\s*", ""), (r"(?i)\s*br>\s*", "\n")))


@step(CLEAN, 6)
def escaped_line_feeds(t: Column) -> Column:
    return F.replace(t, F.lit("\\n"), F.lit("\n"))


@step(CLEAN, 7)
def blank_runs(t: Column) -> Column:
    return where_found(t, ["  ", "\t"], (r"[ \t]{2,}", " "))


@step(CLEAN, 63)
def missing_spaces(t: Column) -> Column:
    return subs(t, (r"([a-z0-9])([A-Z][a-z]{2,})", "$1 $2"), (r"\)([A-Za-z])", ") $1"))


@step(CLEAN, 115)
def collapse_white_space(t: Column) -> Column:
    t = if_contains(t, ["\u00a0", "\r"], lambda x: F.translate(x, "\u00a0\r", " "))
    t = where_found(t, [" \n", "\n ", "\t"], (r"[ \t]*\n[ \t]*", "\n"))
    t = where_found(t, ["\n\n\n"], (r"\n{3,}", "\n\n"))
    return strip(where_found(t, ["  "], (r" {2,}", " ")))


@step(CLEAN, 116)
def lone_punctuation(t: Column) -> Column:
    return subs(t, (r"(?m)^\s*[.,;:!?]\s*$", ""), (r"(?m)^[-=_*]{3,}$", ""))


@step(CLEAN, 118)
def page_markers(t: Column) -> Column:
    return sub(t, r"(?i)(?:\A|\n)\s*(?:Page\s+\d+(?:\s+of\s+\d+)?|---+|\*\*\*+)\s*(?:\n|\z)", "\n")


@step(CLEAN, 119)
def reviewed_lines(t: Column) -> Column:
    return sub(t, r"(?im)^[ \t]*reviewed\.(?!.{71,}$).*(?:\n|\z)", "")


@step(CLEAN, 138)
def blank_line_runs(t: Column) -> Column:
    return where_found(t, ["\n\n\n\n"], (r"\n{4,}", "\n\n\n"))


@step(CLEAN, 144)
def inner_blanks(t: Column) -> Column:
    t = only_if(t, lambda x: x.endswith(" ") | x.contains(" \n") | x.contains("\t"), lambda x: sub(x, r"(?m)(?<=\S)[ \t]+$", ""))
    return where_found(t, ["  "], (r"(?<=\S) {2,}", " "))


@step(CLEAN, 150)
def trim_lines(t: Column) -> Column:
    at_edge = lambda x: x.startswith(" ") | x.endswith(" ") | x.contains("\n ") | x.contains(" \n") | x.contains("\t")
    t = only_if(t, at_edge, lambda x: sub(x, r"(?m)^[ \t]+|[ \t]+$", ""))
    return where_found(t, ["\n\n\n"], (r"\n{3,}", "\n\n"))


# --- bullets -------------------------------------------------------------------------------

@step(BULLETS, 3)
def tilde_bullets(t: Column) -> Column:
    return if_contains(t, ["~"], lambda x: subs(
        x, (r"(\s)~\s+", "$1\n- "), (r"(?m)^~\s+", "- "), (r"([.)\]:])\s*~\s+", "$1\n- ")))


@step(BULLETS, 4)
def plain_bullets(t: Column) -> Column:
    t = where_found(t, ["~", "•"], (r"\s+[~•]\s+", "\n- "))
    t = where_found(t, ["-"], (r"\s{2,}-\s+", "\n- "), (r"(?<=\n)\s*-\s+", "- "))
    return where_found(t, ["*"], (r"\s+\*\s+", "\n- "))


@step(BULLETS, 14)
def inline_tildes(t: Column) -> Column:
    return if_contains(t, ["~"], lambda x: subs(
        x, (r"\s+~\s+", "\n- "), (r"(?m)^~\s+", "- "),
        (r"\s+~\s*([A-Za-z][A-Za-z\s,()-]+)(\s+\d{2}/\d{2}/\d{4}|\s+\d{4})?", "\n- $1$2")))


@step(BULLETS, 73)
def numbered_items(t: Column) -> Column:
    return subs(t, (r"(?<=:)\s*(\d+\.)", "\n$1"), (r"(?<=[.!?])\s+(\d+\.)", "\n$1"))


@step(BULLETS, 120)
def bullet_bodies(t: Column) -> Column:
    """A bullet takes in the lines up to the next line that stands for itself."""
    stops = (rf"(?:$|[ \t]*- |\d+\.(?:\s|$)|[ \t]*[A-Z][A-Z /&'-]{{2,}}:[ \t]*$|{lex.TABLE_LINE}"
             rf"|{HEADER}|{lex.SYSTEM_LINE}|{lex.SOCIAL_LINE})")
    bare = rf"(?m)\A[ \t]*-[ \t]*{any_of(lex.SECTION_HEADERS)}:?[ \t]*$"
    return if_contains(t, ["- "], lambda x: runs(
        x, rf"(?!{stops})", lambda p: p.rlike(r"\A[ \t]*- ") & ~p.rlike(bare), join_lines))


@step(BULLETS, 148)
def list_spacing(t: Column) -> Column:
    return sub(t, r"(?m)^\s*-\s+", "- ")


# --- rejoining headers ---------------------------------------------------------------------

@step(REJOIN, 8, 146, 155)
def compound_terms(t: Column) -> Column:
    return rejoin(t, _COMPOUND)


@step(REJOIN, 52, 145, 154)
def split_headers(t: Column) -> Column:
    kept = "|".join(rf"(?<=(?:{a}))(?=\s*\n\s*{b})" for a, b in KEPT_HEADERS)
    follows = "|".join(dict.fromkeys(b for _a, b in KEPT_HEADERS))
    t = only_if(t, lambda x: x.rlike(rf"(?i)\n\s*(?:{follows})"), lambda x: sub(
        x, rf"(?i)(?=\s*\n)(?:{kept})\s*\n\s*", " "))
    return rejoin(t, _SET)


@step(REJOIN, 53, 143)
def fragmented_labels(t: Column) -> Column:
    """A label cut in two by a line break, found by looking the glued halves up."""
    names = {}
    for label in lex.ROS_LABELS + lex.EXAM_LABELS + lex.EXAM_SUB_LABELS:
        names[label.lower()] = label + ":"
    # in the pair, the first line is one short word and the second starts with a label's end
    pair = r"(?m)^[ \t]*[^\s]{1,20}(?<!:)[ \t]*\n[ \t]*[^:\n]*:"
    key = lambda m: F.lower(F.regexp_replace(m, r"\A[ \t]+|[ \t]*\n[ \t]*|:\z", ""))
    return if_contains(t, ["\n"], lambda x: swap(x, pair, lookup(names, key)))


@step(REJOIN, 54)
def slash_labels(t: Column) -> Column:
    return rejoin(t, _SLASHED)


@step(REJOIN, 55)
def exam_and_history(t: Column) -> Column:
    return subs(t, (r"(?i)(Exam)\s*\n\s*(conducted\s+with)", "$1 $2"),
                (r"(?im)^([ \t]*-?[ \t]*History)[ \t]*\n[ \t]*(?=of\s)", "$1 "))


@step(REJOIN, 99)
def general_appearance(t: Column) -> Column:
    return sub(t, r"(?i)\b(General):\s*\n\s*(Appearance):", "$1/Appearance:")


def _label_key(label: str) -> str:
    return "".join(ch for ch in label.lower() if ch.isascii() and ch.isalnum())


@step(REJOIN, 140)
def acronym_headers(t: Column) -> Column:
    extra = ["HISTORY AND PHYSICAL EXAM", "HISTORY AND PHYSICAL EXAMINATION"]
    known = sorted({_label_key(x) for x in lex.SECTION_HEADERS + lex.ROS_LABELS + lex.EXAM_LABELS
                    + lex.EXAM_SUB_LABELS + extra})
    pair = r"(?m)^[ \t]*[A-Z]{2,6}[ \t]*\n[ \t]*[A-Z][A-Za-z/ &'-]{1,40}?:[^\S\n]*"

    def repair(m: Column) -> Column:
        key = F.regexp_replace(F.lower(m), "[^a-z0-9]", "")
        glued = F.regexp_replace(m, r"\s+", "")
        return F.when(key.isin(known), F.concat(glued, F.lit(" "))).otherwise(m)

    joined = if_contains(t, ["\n"], lambda x: swap(x, pair, repair))
    return sub(joined, r"(?m): $", ":")


@step(REJOIN, 141)
def history_and_physical_header(t: Column) -> Column:
    return only_if(t, lambda x: x.rlike(r"(?i)\n\s*AND PHYSICAL"), lambda x: subs(
        x, (r"(?i)(HISTORY)\s*\n\s*(AND PHYSICAL(?: EXAM(?:INATION)?)?)", "$1 $2"),
        (r"(?i)(HISTORY)\s*\n\s*(AND PHYSICAL)\s*\n\s*(EXAM(?:INATION)?)", "$1 $2 $3")))


@step(REJOIN, 142)
def allergies_before_vitals(t: Column) -> Column:
    return sub(t, r"(?i)No Known (?:Allergies\s+)?Vitals/Physical Exam",
               "No Known Allergies\nVitals/Physical Exam")


@step(REJOIN, 147, 156)
def lone_connectors(t: Column) -> Column:
    # a line that holds nothing else
    alone = rf"(?md)^[ \t]*(?:&|(?i:and)|{LONE_WORDS})[ \t]*$"
    return only_if(t, lambda x: x.contains("\n") & x.rlike(alone), lambda x: subs(
        x,
        (r"(?=[ \t]*\n)(?<=[^\s.!?])[ \t]*\n[ \t]*(&|(?i:and))[ \t]*\n[ \t]*(?=\S)", " $1 "),
        (rf"(?m)(?=[ \t]*\n)(?<=[^\s.:!?])[ \t]*\n[ \t]*(?={LONE_WORDS}[ \t]*$)", " "),
        (rf"(?m)^[ \t]*({LONE_WORDS})[ \t]*\n[ \t]*([a-z].*)$", "$1 $2")))


# --- repeated headers ----------------------------------------------------------------------

@step(DEDUPE, 91, 152)
def repeated_headers(t: Column) -> Column:
    """Drop a header seen again less than ten lines after its last kept copy.

    Only the note's header lines go through the fold, which carries the last five kept.
    """
    header = rf"(?md)\A(?:[ \t]*{any_of(lex.SECTION_HEADERS)}:?[ \t]*$|[ \t]*[A-Z][A-Z\s]{{1,39}}[ \t]*\z)"

    def drop(x: Column) -> Column:
        lines = F.split(x, "\n", -1)
        heads = F.filter(
            F.transform(lines, lambda s, i: F.struct(i.alias("i"), F.lower(strip(s)).alias("h"), (
                (strip(s) != "") & s.rlike(header)).alias("is"))),
            lambda r: r["is"])
        empty_recent = F.array().cast("array<struct<i:int,h:string>>")
        empty_drop = F.array().cast("array<int>")

        def fold(acc: Column, r: Column) -> Column:
            again = F.exists(acc["recent"], lambda k: (k["h"] == r["h"]) & (r["i"] - k["i"] < 10))
            kept = F.concat(acc["recent"], F.array(F.struct(r["i"].alias("i"), r["h"].alias("h"))))
            last5 = F.slice(kept, F.greatest(F.size(kept) - 4, F.lit(1)), F.lit(5))
            return F.struct(
                F.when(again, acc["recent"]).otherwise(last5).alias("recent"),
                F.when(again, F.concat(acc["drop"], F.array(r["i"]))).otherwise(acc["drop"]).alias("drop"))

        dropped = F.aggregate(
            heads, F.struct(empty_recent.alias("recent"), empty_drop.alias("drop")), fold, lambda a: a["drop"])

        def without(gone: Column) -> Column:
            # the blank line right before a dropped header goes with it
            rows = F.transform(lines, lambda s, i: F.struct(s.alias("s"), (
                F.array_contains(gone, i)
                | ((strip(s) == "") & F.array_contains(gone, i + 1))).alias("x")))
            return F.array_join(F.transform(F.filter(rows, lambda r: ~r["x"]), lambda r: r["s"]), "\n")

        return let(dropped, lambda gone: F.when(F.size(gone) == 0, x).otherwise(without(gone)))

    return if_contains(t, ["\n"], drop)


# --- words ---------------------------------------------------------------------------------

@step(WORDS, 24)
def unhyphenated_words(t: Column) -> Column:
    """A single word on a line goes on in the next line: joined, with a blank after "("."""
    first = rf"(?!{HEADER})[ \t]*(?=\S{{4,}}[ \t]*$)(\S*[a-zA-Z])"
    stop = r"(?!(?i:" + alternation(STOP_WORDS) + r")(?:\s|$))"
    following = rf"(?!{HEADER})[ \t]*{stop}([a-z].*?)[ \t]*$"
    opened = rf"(?!{HEADER})[ \t]*(\S*\()[ \t]*\n(?!{HEADER})[ \t]*(?![-*]|\d+\.)(\S.*?)[ \t]*$"
    return if_contains(t, ["\n"], lambda x: subs(
        x, (rf"(?m)^{first}[ \t]*\n{following}", "$1$2"), (rf"(?m)^{opened}", "$1 $2")))


@step(WORDS, 25)
def hyphenated_words(t: Column) -> Column:
    return only_if(t, lambda x: x.rlike(r"-\s*\n"), lambda x: sub(x, r"(\w+)-\s*\n\s*([a-z])", "$1-$2"))


@step(WORDS, 114)
def drug_names(t: Column) -> Column:
    key = lambda m: F.lower(F.regexp_replace(m, r"\s+", ""))
    t = only_if(
        t, lambda x: let(F.lower(x), lambda low: low.contains("lodipine") | low.contains("denafi")
                         | low.contains("lafi") | low.contains("losec")),
        lambda x: swap(x, r"(?i)\b(?:am\s*lodipine|sil\s*denafi\s*l|tada\s*lafi\s*l|pri\s*losec)\b",
                       lookup(DRUG_NAMES, key)))
    return only_if(t, lambda x: x.rlike(r"m\s*L"), lambda x: sub(x, r"\bm\s*L\b", "mL"))


@step(WORDS, 132)
def split_words(t: Column) -> Column:
    words = lex.SPLIT_WORDS
    t = rejoin(t, _WRAPPED)
    # most texts hold none: look at blanks first, at what follows them next
    lefts = alternation(dict.fromkeys(w.split(" ")[0] for w in words))
    rights = alternation(dict.fromkeys(w.split(" ", 1)[1] for w in words))
    # no word holds one of these marks, so what stands between them is repaired by itself
    repair = lookup(words, lambda m: m)
    near = rf"(?= {rights})(?<={lefts})"
    return only_if(t, lambda x: x.rlike(near), lambda x: between_marks(x, r".,;:\n", lambda part: only_if(
        part, lambda y: y.rlike(near), lambda y: swap(y, alternation(words), repair))))


@step(WORDS, 133)
def words_across_blanks(t: Column) -> Column:
    return only_if(t, lambda x: x.rlike(r"\n[ \t]*\n[ \t\n]*[a-z]"), lambda x: sub(
        x, r"(?m)^(.*[a-zA-Z])[ \t]*\n[ \t]*\n[ \t\n]*([a-z].{3,})$", "$1 $2"))


# --- merging lines -------------------------------------------------------------------------

#: Stands at a line start: whether the next line can be one that goes on, before costlier looks at this one.
NEXT_GOES_ON = r"(?=.*+\n[ \t]*+[a-z])"


@step(MERGE, 121)
def soft_breaks(t: Column) -> Column:
    return sub(t, rf"(?m)^{NEXT_GOES_ON}(.*[^\s.:;])[ \t]*\n(?!{HEADER})[ \t]*([a-z].*)$", "$1 $2")


@step(MERGE, 122)
def lowercase_continuations(t: Column) -> Column:
    goes_on = rf"(?!(?i:{alternation(UNITS)}))(?!.*{lex.MEDICATION})(?=[a-z].{{5,}}$)"
    return sub(t, rf"(?m)^{NEXT_GOES_ON}(?!.*{lex.MEDICATION})(.*[^\s.!?:|-])[ \t]*\n[ \t]*{goes_on}", "$1 ")


@step(MERGE, 124)
def dangling_prepositions(t: Column) -> Column:
    word = r"(?i:" + alternation(PREPOSITIONS) + ")"
    return sub(t, rf"(?m)^{NEXT_GOES_ON}((?:.*\s)?{word})[ \t]*\n(?!{HEADER})[ \t]*([a-z].*)$", "$1 $2")


@step(MERGE, 125)
def status_lines(t: Column) -> Column:
    return sub(t, rf"(?m)^[ \t]*(?i:Status):?[ \t]*\n(?!{HEADER})[ \t]*(\S.*)$", "Status: $1")


@step(MERGE, 126)
def plan_blank_lines(t: Column) -> Column:
    return blocks(
        t, r"[ \t]*(?i:plan:?[ \t]*|assessment and plan.*|plan of care.*)$",
        rf"(?!.*(?i:plan)){HEADER}", lambda p: sub(p, r"\n[ \t]*\n[ \t\n]*\n", "\n\n"))


@step(MERGE, 127)
def sentence_ends(t: Column) -> Column:
    return sub(t, r"(?m)(?=[ \t]*\n)(?<=[^\s.:])[ \t]*\n[ \t]*(?=[a-z].{0,27}\.[ \t]*$)", " ")


@step(MERGE, 128)
def orphan_headers(t: Column) -> Column:
    return sub(t, rf"(?m)^(?=\S)({HEADER})\n[ \t]*\n(.*\S.*)$", "$1\n$2")


@step(MERGE, 129)
def orphan_dates(t: Column) -> Column:
    return sub(t, r"(?m)(?=[ \t]*\n)(?<=\S)[ \t]*\n[ \t]*(?=(?:\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})[ \t]*$)", " ")


@step(MERGE, 130)
def orphan_numbers(t: Column) -> Column:
    number = r"[ \t]*\d{1,6}[ \t]*$"

    def join(x: Column) -> Column:
        x = runs(x, number, lambda p: F.lower(F.substring_index(p, "\n", 1)).contains("mg"), join_lines)
        return sub(x, rf"(?m)^(.*at \d{{2}}/\d{{2}}/\d{{2}})[ \t]*\n[ \t]*(?={number})", "$1 ")

    return only_if(t, lambda x: x.rlike(rf"(?md)^{number}"), join)


@step(MERGE, 131)
def orphan_items(t: Column) -> Column:
    return sub(t, rf"(?m)^[ \t]*(\d+\.)[ \t]*\n(?!{HEADER})[ \t]*(\S.*)$", "$1 $2")


# --- wrapping ------------------------------------------------------------------------------

def _cut(line: Column, most: int, cuts: str) -> Column:
    """Pieces as lines, without the blanks around a cut; what is left in the end stays as it is.

    Every piece but the first starts after blanks; ``cuts`` ends one that is longer than ``most``.
    """
    pattern = F.lit(rf"(?s)(?:\A|\p{{Zs}}*+)(?:((?>.{{1,{most}}})\z)|({cuts}))")
    rest, pieces = F.regexp_extract_all(line, pattern, F.lit(1)), F.regexp_extract_all(line, pattern, F.lit(2))
    return F.array_join(F.filter(
        F.zip_with(rest, pieces, lambda r, p: F.when(r != "", r).otherwise(sub(p, r"\p{Zs}+\z", ""))), lambda x: x != ""), "\n")


def _long_lines(t: Column, width: int, cuts: str, finish: Rule = lambda x: x) -> Column:
    whole = rf"(?d)\A[ \t\f\r]*{lex.TABLE_LINE}"
    return only_if(t, lambda x: x.rlike(rf"(?md)^.{{{width + 1}}}"), lambda x: per_line(
        x, lambda line: F.when(
            (F.length(line) > width) & ~line.rlike(whole), finish(_cut(line, width, cuts))).otherwise(line)))


@step(WRAP, 23)
def long_lines(t: Column) -> Column:
    """Lines beyond 1,200 characters end at the last sentence, semicolon or gap before that."""
    return _long_lines(t, 1200, r".{0,1200}\.(?= )|.{0,1200};(?= )|.{0,1200} (?= )|.{1201}",
                       lambda x: sub(x, r"\A\p{Zs}+", ""))


def wrap(t: Column, width: int = 98) -> Column:
    """Wrap at the last blank in reach; a line without one in its second half is cut."""
    least = math.ceil(width / 2)
    return _long_lines(t, width, rf".{{{least},{width}}}(?= )|.{{{width}}}")


step(WRAP, 137)(wrap)
