"""Formatting of whole notes and of single jobs."""

import pytest

from chartspan.formatting.engine import STEPS, behind_gap, chained
from chartspan.formatting.jobs import JOBS, format_diff, format_job, format_notes

# dense notes made up for these tests, and the whole result
NOTES = {
    "panel": (
        "Labs Reviewed   BASIC METABOLIC PANEL - Abnormal       Result Value    Sodium Level 131 (*)     "
        "Potassium Level 5.4 (*)     Anion Gap 17 (*)",
        "Labs Reviewed\nBASIC METABOLIC PANEL - Abnormal Result Value\nSodium Level 131 (*)\nPotassium Level 5.4 (*)\n"
        "Anion Gap 17 (*)"),
    "findings": (
        "Physical Exam   GEN: Thin, tired  HENT: Dry lips.   RESP: Coarse at both bases.  ABD: Full, no guarding.  "
        "NEURO: Drowsy but answers.",
        "Physical Exam\nGEN: Thin, tired\nHENT: Dry lips. RESP: Coarse at both bases. ABD: Full, no guarding.\n"
        "NEURO: Drowsy but answers."),
    "five axes": (
        "Admitting Diagnosis: Axis I: Panic disorder Axis II: None Axis III: Asthma Axis IV: Loss of work Axis V: 48",
        "Admitting Diagnosis:\n\nAxis I:\nPanic disorder\n\nAxis II:\nNone\n\nAxis III:\nAsthma\n\nAxis IV:\n"
        "Loss of work\n\nAxis V:\n48"),
    "drugs": (
        "Medications:  ~  torsemide 10 mg daily  ~  warfarin 3 mg daily  ~  insulin glargine 18 units nightly",
        "Medications\n- torsemide 10 mg daily\n- warfarin 3 mg daily\n- insulin glargine 18 units nightly"),
    "problems": (
        "Past Medical History:   Diagnosis Date   ~ Gout    ~ Atrial fibrillation    ~ Sleep apnea    ~ Low back pain",
        "Past Medical History:\n\nDiagnosis Date\n- Gout\n- Atrial fibrillation\n- Sleep apnea\n- Low back pain"),
    "systems": (
        "Review of Systems   Constitutional: Positive for chills. Negative for sweats.   HENT: Negative for hoarseness.    "
        "Respiratory: Positive for cough.    Cardiovascular: Negative for palpitations.",
        "Review of Systems\nConstitutional:\nPositive for chills. Negative for sweats.\nHENT: Negative for hoarseness.\n"
        "Respiratory: Positive for cough.\nCardiovascular: Negative for palpitations."),
    "stay": (
        "PREADMISSION DIAGNOSIS: Hip fracture   DISCHARGE DIAGNOSIS: Hip fracture, fixed   BRIEF HISTORY: Fell on ice   "
        "HOSPITAL COURSE: Walked on day two   DISCHARGE INSTRUCTIONS: Clinic in ten days",
        "PREADMISSION DIAGNOSIS:\nHip fracture\n\nDISCHARGE DIAGNOSIS:\nHip fracture, fixed\n\nBRIEF HISTORY: Fell on ice\n\n"
        "HOSPITAL COURSE:\nWalked on day two\n\nDISCHARGE INSTRUCTIONS:\nClinic in ten days"),
    "splits": (
        "Long standing hyper tension with nau sea and short ness of breath.",
        "Long standing hypertension with nausea and shortness of breath."),
    "row": (
        "Vital Signs:   Temp Pulse Resp BP SpO2   38 °C 104 22 96/58 91%",
        "Vital Signs: Temp Pulse Resp BP SpO2: 38 °C 104 22 96/58 91%"),
}


def frame(spark, texts):
    rows = [(k, v, None, None, None, v) for k, v in texts.items()]
    return spark.createDataFrame(rows, "note_id string, text string, type string, date string, source string, raw_text string")


def test_dense_notes(spark):
    got = {r.note_id: r.text for r in format_notes(frame(spark, {k: v[0] for k, v in NOTES.items()})).collect()}
    assert got == {k: v[1] for k, v in NOTES.items()}


def test_no_bounds(spark):
    """Lists and headers beyond any round number are laid out whole."""
    dates = ", ".join(f"01/02/{1000 + i}" for i in range(600))
    columns = " ".join(["Temp", "Pulse"] * 40)
    header = "x" * 150 + "   " + " ".join(["Word"] * 80) + " : y"
    rows = {"d": "COMPARISON: " + dates, "c": columns + "\nnext", "h": header}
    out = lambda job: {r.note_id: r.text for r in format_job(frame(spark, rows), job).collect()}
    assert out("format_radiology")["d"].count("\n- ") == 600
    assert "Temp" not in out("format_vitals")["c"]
    assert ("\n\n" + " ".join(["Word"] * 80) + ":") in out("format_section_breaks")["h"]


# job -> [(input, output)], worked out by hand
GOLDENS = {
    "format_clean": [
        ("a\u00a0b\r\nc<br/>d\\ne", "a b\nc\nd\ne"),
        ("x\n\n\n\ny\n---\nPage 3 of 9\nz", "x\n\ny\nz"),
        ("feverChills (mild)today 3Weeks", "fever Chills (mild) today 3 Weeks"),
        ("keep\n  reviewed. by me\nReviewed. " + "x" * 80, "keep\nReviewed. " + "x" * 80),
    ],
    "format_bullets": [
        ("list ~ one ~ two", "list\n- one\n- two"),
        ("plan: 1. rest 2. fluids. 3. walk", "plan:\n1. rest 2. fluids.\n3. walk"),
        ("- first half\nsecond half\n- other\nPLAN:\nrest", "- first half second half\n- other\nPLAN:\nrest"),
    ],
    "format_sentences": [
        ("Seen by Dr. Smith today. He left. ok", "Seen by Dr. Smith today.\nHe left. ok"),
        ("one; Two", "one;\nTwo"),
    ],
    "format_rejoin_headers": [
        ("ED Course\n&\nMDM\ntext", "ED Course & MDM\ntext"),
        ("Past Medical\nHISTORY: x", "Past Medical History: x"),
        ("Chief\nComplaint", "Chief Complaint"),
        ("DISCHARGE\nDIAGNOSIS: x", "DISCHARGE DIAGNOSIS: x"),
        ("Respir\natory: clear", "Respiratory: clear"),
        ("HE\nENT: normal", "HEENT: normal"),
        ("General:\nAppearance: well", "General/Appearance: well"),
        ("GI/\nGU: benign", "GI/GU: benign"),
        ("no known\nplan\nnext", "no known plan\nnext"),
    ],
    "format_word_splits": [
        ("re gular cardio vascular", "regular cardiovascular"),
        ("pre-\ndiabetic", "pre-diabetic"),
        ("contin\nued care", "continued care"),
        ("H\nENT: x", "HENT: x"),
        ("am LODIPine 5 m L", "amLODIPine 5 mL"),
        ("the patient\n\nwas seen", "the patient was seen"),
        ("History\nof falls", "History\nof falls"),
    ],
    "format_dedupe_headers": [
        ("PLAN:\nrest\n\nPLAN:\nfluids", "PLAN:\nrest\nfluids"),
        ("PLAN:\n" + "x\n" * 8 + "PLAN:\ny", "PLAN:\n" + "x\n" * 8 + "y"),
        ("PLAN:\n" + "x\n" * 9 + "PLAN:\ny", "PLAN:\n" + "x\n" * 9 + "PLAN:\ny"),
        # distance counts from the last kept copy, not from a dropped one
        ("PLAN:\n" + "x\n" * 5 + "PLAN:\n" + "x\n" * 5 + "PLAN:\ny", "PLAN:\n" + "x\n" * 10 + "PLAN:\ny"),
    ],
    "format_medications": [
        ("Medications\naspirin 81 mg daily\nlisinopril 10 mg\nAllergies: none",
         "Medications\n- aspirin 81 mg daily\n- lisinopril 10 mg\nAllergies: none"),
        ("take 1 tablet, Disp: , Rfl: lisinopril 10 mg", "take 1 tablet\n- lisinopril 10 mg"),
        ("take 1 tablet, Disp: , Rfl: Allergies", "take 1 tablet\n\nAllergies"),
        ("aspirin 81 mg\nby mouth\nNext line", "aspirin 81 mg by mouth\nNext line"),
    ],
    "format_labs": [
        ("seen  BUN 12 and Glucose Level 90 x", "seen\nBUN 12 and\nGlucose Level 90 x"),
        ("Labs:\na\n\n\n\nb\nPLAN\nc\n\n\n\nd", "Labs:\na\n\nb\nPLAN\nc\n\n\n\nd"),
    ],
    "format_vitals": [
        ("BP 120/80", "BP: 120/80"),
        ("seen BP 120/80 HR 70 RR 16", "seen\nBP: 120/80  HR: 70  RR: 16"),
        ("Temp Pulse Resp BP\nok", "\nok"),
    ],
    "format_ros_pe": [
        ("well. HENT: normal; Eyes: clear", "well.\nHENT: normal;\nEyes: clear"),
        ("Skin:\nwarm\ndry\n\nnext", "Skin: warm dry\n\nnext"),
        ("Physical Exam\nsoft; tender\nPLAN\na; b", "Physical Exam\nsoft\ntender\nPLAN\na; b"),
        ("Physical Exam:\nAbdomen: Tenderness: none\nend", "Physical Exam:\nAbdomen:\n  - Tenderness: none\nend"),
        # a system label takes in the lines that follow it
        ("Skin: warm\nand dry", "Skin: warm and dry"),
    ],
    "format_social": [
        ("- Smoking status\nnever\nTypes: none\nYears: 3\nend", "- Smoking status never Types: none Years: 3\nend"),
        # a social header of its own stays on its line
        ("Smoking status:\nnever", "Smoking status:\nnever"),
        ("Alcohol use\n\nno\nPLAN", "Alcohol use\n\nno\nPLAN"),
    ],
    "format_allergies": [
        ("Allergies:\nlatex\n- nuts\nNo known drug\nPLAN\nrest", "Allergies:\n- latex\n- nuts\nNo known drug\nPLAN\nrest"),
    ],
    "format_radiology": [
        ("Technique: CT. FINDINGS: a stone in the kidney", "Technique: CT.\n\nFINDINGS:\na stone in the kidney".replace("Technique: CT.", "Technique: CT. ")),
        ("COMPARISON: 01/02/2020, 02/03/2020, 03/04/2021, 04/05/2022 x", "COMPARISON:\n- 01/02/2020\n- 02/03/2020\n- 03/04/2021\n- 04/05/2022\nx"),
        ("no radiology words", "no radiology words"),
    ],
    "format_discharge": [
        ("Follow up:\n" + "see the clinic " * 9 + "on 01/02/2024 at nine and 02/03/2024 at ten",
         "Follow up:\n" + "see the clinic " * 9 + "on 01/02/2024 at nine and\n02/03/2024 at ten"),
        ("Call if: Fever rises " + "and stays " * 14 + "Chills come", "Call if:\n- Fever rises " + "and stays " * 13 + "and stays\n- Chills come"),
    ],
    "format_merge_lines": [
        ("the patient\nwas seen", "the patient was seen"),
        ("Ends here.\nwas seen", "Ends here.\nwas seen"),
        ("Status:\nstable", "Status: stable"),
        ("Seen on\n01/02/2024\nOk then", "Seen on 01/02/2024\nOk then"),
        ("PLAN\n\nrest", "PLAN\nrest"),
        ("1.\nRest", "1. Rest"),
    ],
    "format_wrap": [
        ("word " * 40, "\n".join(["word " * 18 + "word", "word " * 18 + "word", "word word "])),
        ("x" * 200, "x" * 98 + "\n" + "x" * 98 + "\nxxxx"),
        ("| " + "cell | " * 30, "| " + "cell | " * 30),
    ],
    "format_section_breaks": [
        ("Stable.  Chief Complaint: pain", "Stable.\n\nChief Complaint:\npain"),
        ("Axis I: one Axis II: two", "\n\nAxis I:\none\n\n\nAxis II:\ntwo"),
    ],
    "format_dates": [
        ("x  DOB: 01/02/1960  MRN: 5", "x\nDOB: 01/02/1960\nMRN: 5"),
        ("x  Electronically signed by me", "x\n\nElectronically signed by me"),
    ],
}


def test_every_job_has_goldens():
    assert set(GOLDENS) == set(JOBS) and len(JOBS) == 18


@pytest.mark.parametrize("job", list(GOLDENS))
def test_job(spark, job):
    cases = GOLDENS[job]
    notes = frame(spark, {str(i): raw for i, (raw, _) in enumerate(cases)})
    got = {r.note_id: r.text for r in format_job(notes, job).collect()}
    for i, (raw, want) in enumerate(cases):
        assert got[str(i)] == want, raw


def test_formatting_is_one_pass(spark):
    plan = format_notes(frame(spark, {"a": "b"}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_width_and_diff(spark):
    notes = frame(spark, {"a": "word " * 30, "b": "short"})
    narrow = {r.note_id: r.text for r in format_notes(notes, width=40).collect()}
    assert max(len(x) for x in narrow["a"].split("\n")) <= 40
    diff = {r.note_id: r for r in format_diff(notes, format_notes(notes)).collect()}
    assert (diff["a"].raw_lines, diff["a"].formatted_lines, diff["a"].breaks_added, diff["a"].changed) == (1, 2, 1, True)
    assert not diff["b"].changed


def test_no_text_is_lost(spark):
    """Wrapping a very long line drops nothing but blanks."""
    text = " ".join(f"w{i}" for i in range(5000)) + "😀" * 300
    [row] = format_job(frame(spark, {"a": text}), "format_wrap").collect()
    assert "".join(row.text.split()) == "".join(text.split())


def test_wrapping_counts_from_the_start_of_the_line(spark):
    """A leading blank counts towards 1,200 characters, and only blanks are dropped at a cut."""
    from pyspark.sql import functions as F

    from chartspan.formatting import repairs

    line = " " + "a" * 1198 + ". " + "b" * 20
    tabbed = "c" * 90 + "\t \x0b " + "d" * 40
    row = spark.createDataFrame([(line, tabbed)], "long string, tab string").select(
        repairs.long_lines(F.col("long")), repairs.wrap(F.col("tab"))).first()
    assert row[0] == "a" * 1198 + ".\n" + "b" * 20 and row[1] == "c" * 90 + "\t \x0b\n" + "d" * 40
    # one character more and the sentence ends beyond reach: cut where no end is met
    far = " " + "a" * 1200 + ". " + "b" * 20
    cut = spark.createDataFrame([(far,)], "t string").select(repairs.long_lines(F.col("t"))).first()[0]
    assert cut == "a" * 1200 + "\n. " + "b" * 20


def test_prose_is_looked_at_once_for_neighbouring_gap_rules(spark):
    """Replaces at gaps share one look, and a text that only the last of them changes is still changed."""
    steps = [s for s in sorted(STEPS, key=lambda s: s.no) if s.job == "format_section_breaks"]
    listed = [p for s in steps for p, _ in s.pairs if behind_gap(p)]
    assert len(listed) > len(steps) and len(chained(steps)) < sum(len(s.pairs) or 1 for s in steps) - len(listed) / 2
    text = "calm prose without marks   Explanatory Comment: none"
    [row] = format_job(frame(spark, {"a": text}), "format_section_breaks").collect()
    assert row.text == "calm prose without marks\nExplanatory Comment: none"


def test_names_and_words_are_repaired_between_marks(spark):
    """Many clauses, few of them with something to repair: each is cut by itself, whatever its neighbours hold."""
    rows = {"a": "prose, more; " * 50 + "with hyper tension, nau sea (re gular). " + "end."}
    [row] = format_job(frame(spark, rows), "format_word_splits").collect()
    assert row.text == "prose, more; " * 50 + "with hypertension, nausea (regular). end."


def test_plain_searches_change_no_text(spark):
    """Rules behind a plain search give what their expressions give by themselves, and are behind one."""
    import random

    from pyspark.sql import functions as F

    from chartspan.formatting import engine, repairs
    from chartspan.functions.text import strip

    rng = random.Random(4)
    rows = [("".join(rng.choice(" \t\n\n\r \x0b-*~•aB.1") for _ in range(rng.randrange(14))),) for _ in range(4000)]
    texts = spark.createDataFrame(rows, "t string")
    plain = {
        repairs.plain_characters: lambda t: engine.sub(F.translate(t, " ", " "), r"\r\n?", "\n"),
        repairs.blank_runs: lambda t: engine.sub(t, r"[ \t]{2,}", " "),
        repairs.blank_line_runs: lambda t: engine.sub(t, r"\n{4,}", "\n\n\n"),
        repairs.collapse_white_space: lambda t: strip(engine.subs(
            F.translate(t, " \r", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"), (r" {2,}", " "))),
        repairs.inner_blanks: lambda t: engine.subs(t, (r"(?m)(?<=\S)[ \t]+$", ""), (r"(?<=\S) {2,}", " ")),
        repairs.trim_lines: lambda t: engine.subs(t, (r"(?m)^[ \t]+|[ \t]+$", ""), (r"\n{3,}", "\n\n")),
        repairs.plain_bullets: lambda t: engine.subs(
            t, (r"\s+[~•]\s+", "\n- "), (r"\s{2,}-\s+", "\n- "), (r"(?<=\n)\s*-\s+", "- "), (r"\s+\*\s+", "\n- ")),
    }
    t = F.col("t")
    differ = [F.count_if(~rule(t).eqNullSafe(body(t))) for rule, body in plain.items()]
    assert list(texts.agg(*differ).first()) == [0] * len(plain)
    for rule in plain:
        assert "contains(" in texts.select(rule(t))._jdf.queryExecution().optimizedPlan().toString().lower()
