"""Format jobs over the derived notes, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import N, NOTES_SQL, _ws, notes, sql
from chartspan.formatting import jobs
from chartspan.formatting import lexicon as lex

# What a dense chart adds to its prose, by note number; every job finds something to do.
FRAGMENTS = [
    "Medications:  ~  aspirin 81 mg daily  ~  carBAMazepine 200 mg BID   Sig take 1 tablet, Disp: , Rfl: lisinopril 10 mg daily  "
    "amLODIPine 5 mg Refills: 2 metoprolol 25 mg",
    "Physical Exam   GEN: Nontoxic; alert; calm  HENT: Normal.   RESP: Clear.  NEURO: Intact.   Review of Systems   "
    "Constitutional: Positive for fatigue. Negative for fever.   HENT: Negative for pain.",
    "Labs Reviewed   CBC W/ DIFFERENTIAL - Abnormal       Result Value    White Blood Cells 13.6 (*)     Red Blood Cells 3.99 (*)  "
    "Vital Signs:   BP 118/65 HR 92 RR 16 Temp 37   ALLERGIES:\npenicillin\nlatex",
    "IMPRESSION: 1. Stable stone in the left kidney. 2. No change. COMPARISON: 01/02/2020, 02/03/2020, 03/04/2021, 04/05/2022 "
    "END OF REPORT   Scheduled Appointments: Jan 3, 2024 clinic\nPLAN:\n\nPLAN:\nReviewed. ok\nSmoking status:\nformer\nre gular cardio vascular",
]


def dense_notes(spark, sf):
    f = F.array(*[F.lit(x) for x in FRAGMENTS])
    return notes(spark, sf, "   ").withColumn(
        "text", F.concat("text", F.lit("   "), F.element_at(f, (F.col("pos") % 4 + 1).cast("int"))))


def sized(df):
    return df.select("note_id", "text")


def _register(job):
    oracle = ORACLES.get(job)

    @query(job, oracle)
    def _(spark, sf):
        return sized(jobs.format_job(dense_notes(spark, sf), job))


def _lit(x):
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_DENSE = (NOTES_SQL.replace("chr(10)", "'   '").replace("notes AS", "sparse AS") + """,
dense AS (SELECT note_id, pos, raw_text, text || '   ' || CASE pos % 4 """ + " ".join(
    f"WHEN {i} THEN {_lit(x)}" for i, x in enumerate(FRAGMENTS)) + " END AS text FROM sparse)")


def replaced(column, *pairs):
    """Nested SQL replaces; ``\\n`` in a replacement is a line feed."""
    out = column
    for pattern, new in pairs:
        new = " || chr(10) || ".join("'" + p + "'" for p in new.split("\n"))
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    return out


_ABBR = "|".join(a.replace(".", "\\.") for a in sorted(lex.ABBREVIATIONS, key=len, reverse=True))
_SENTENCES = replaced(
    "text", ("([.!?])\\s+([A-Z][a-z])", "\\1\n\\2"), (f"(?i)({_ABBR})\\n([A-Za-z])", "\\1 \\2"),
    (f"(?i)({_ABBR})\\n([A-Za-z])", "\\1 \\2"),  # once more for abbreviations in a row
    ("([.!?])\\s{2,}([A-Z])", "\\1\n\n\\2"), (";\\s*([A-Z])", ";\n\\1"))

_CLEAN = replaced(
    "trim(" + replaced(
        "replace(" + replaced(
            "replace(text, chr(160), chr(32))", ("\\r\\n?", "\n"), ("(?i)<br\\s*/?>", "\n"),
            ("(?m)(?:^|\\n)\\s*br>\\s*(?:\\n|$)", "\n"), ("(?i)^br>\\s*", ""), ("(?i)\\s*br>\\s*", "\n"))
        + ", '\\n', chr(10))",
        ("[ \\t]{2,}", " "), ("([a-z0-9])([A-Z][a-z]{2,})", "\\1 \\2"), ("\\)([A-Za-z])", ") \\1"),
        ("[ \\t]*\\n[ \\t]*", "\n"), ("\\n{3,}", "\n\n"), (" {2,}", " ")) + ", chr(32) || chr(10))",
    ("(?m)^\\s*[.,;:!?]\\s*$", ""), ("(?m)^[-=_*]{3,}$", ""),
    ("(?i)(?:^|\\n)\\s*(?:Page\\s+\\d+(?:\\s+of\\s+\\d+)?|---+|\\*\\*\\*+)\\s*(?:\\n|$)", "\n"),
    ("(?im)^[ \\t]*reviewed\\..{0,70}(?:\\n|$)", ""), ("\\n{4,}", "\n\n\n"), ("(?m)^[ \\t]+|[ \\t]+$", ""), ("\\n{3,}", "\n\n"))

# One cut at a time: at 1,200 characters, then at 98.
_TABLE = "regexp_matches({0}, '^\\s*\\|.*\\|') OR regexp_matches({0}, '^\\s*\\+.*(---|===)')"
_WRAP = f"""
l0 AS (SELECT note_id, CAST(i AS INT) AS i, parts[i] AS line, {_TABLE.format('parts[i]')} AS tab FROM (SELECT note_id, string_split(text, chr(10)) AS parts FROM dense), unnest(range(1, len(parts) + 1)) AS u(i)),
long(note_id, i, k, tab, piece, rest) AS (
  SELECT note_id, i, 0, tab, CAST(NULL AS VARCHAR), line FROM l0
  UNION ALL
  SELECT note_id, i, k + 1, tab, CASE WHEN length(rest) <= 1200 OR tab THEN rest ELSE trim(substr(rest, 1, cut)) END,
         CASE WHEN length(rest) <= 1200 OR tab THEN NULL ELSE ltrim(substr(rest, cut + 1)) END FROM (
    SELECT *, CASE WHEN contains(head, '. ') THEN length(head) - instr(reverse(head), ' .') WHEN contains(head, '; ') THEN length(head) - instr(reverse(head), ' ;')
                   WHEN contains(head, '  ') THEN length(head) - instr(reverse(head), '  ') ELSE 1201 END AS cut FROM (
      SELECT note_id, i, k, tab, rest, substr(rest, 1, 1202) AS head FROM long WHERE rest IS NOT NULL))),
l1 AS (SELECT note_id, i, k, piece AS line, {_TABLE.format('piece')} AS tab FROM long WHERE k > 0 AND (piece <> '' OR (k = 1 AND rest IS NULL))),
short(note_id, i, k, j, tab, piece, rest) AS (
  SELECT note_id, i, k, 0, tab, CAST(NULL AS VARCHAR), line FROM l1
  UNION ALL
  SELECT note_id, i, k, j + 1, tab, CASE WHEN length(rest) <= 98 OR tab THEN rest ELSE rtrim(substr(rest, 1, cut)) END,
         CASE WHEN length(rest) <= 98 OR tab THEN NULL ELSE ltrim(substr(rest, cut + 1)) END FROM (
    SELECT *, CASE WHEN spot >= 49 THEN spot ELSE 98 END AS cut FROM (
      SELECT note_id, i, k, j, tab, rest, CASE WHEN contains(substr(rest, 1, 99), ' ') THEN 99 - instr(reverse(substr(rest, 1, 99)), ' ') ELSE -1 END AS spot
      FROM short WHERE rest IS NOT NULL)))"""



def _gap(phrases, lead="\n"):
    words = sorted(phrases, key=len, reverse=True)
    body = "|".join("".join("\\" + c if c in "()?.*+[]{}|^$" else c for c in w) for w in words)
    return f"(?i)\\s{{2,}}({body})", lead + "\\1"


_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_DATES = replaced(
    "text",
    _gap(["Date of services:", "Date of Admission:", "Date of Discharge:", "Operation/Procedure Date", "Sex:", "Birthdate:", "DOB:",
          "Age:", "Race:", "PCP:", "Attending:", "MRN:", "Account #:", "Last data filed at", "Patient Name", "MRN (Required):",
          "Patient Location"]),
    ("(?i)\\s{2,}(Date:)\\s*(\\d{2}/\\d{2}/\\d{4})", "\n\\1 \\2"), ("(?i)\\s{2,}(Time:)\\s*(\\d{1,2}:\\d{2})", "\n\\1 \\2"),
    _gap(["Electronically signed by"], "\n\n"),
    ("\\s{2,}(\\d{2}/\\d{2}/\\d{2,4}\\s+\\d{4})\\s+([A-Z])", "\n\\1 \\2"),
    ("(\\d{2}/\\d{2}/\\d{2,4})\\s{2,}([A-Z][a-z]+\\s+[A-Z][a-z]+)", "\\1\n\\2"),
    ("\\s{3,}([A-Z][a-z]+\\s+[A-Z][a-z]+,?\\s*(?:MD|DO|PA-C|NP|APRN|RN|MA))", "\n\n\\1"),
    ("(?m)\\s{2,}(\\d{2}/\\d{2}/\\d{2,4}\\s+\\d{4})$", "\n\\1"), ("(?i)\\s{2,}(Writt(?:en|) by:?)", "\n\n\\1"),
    (f"(?i)\\s{{2,}}({_MONTH}\\s+\\d{{1,2}},?\\s+\\d{{4}})", "\n\\1"),
    ("(?i)\\s{2,}(\\d{1,2}:\\d{2}\\s*(?:AM|PM)\\s+(?:CDT|CST|EST|PST|EDT|PDT))", "\n\\1"),
    _gap(["(Arrive by", "Post-Op with"]))

# Lines of the dense notes with the header test, and section state carried by a window.
_HEADS = ", ".join("'" + h.replace("'", "''") + "'" for h in lex.HEADERS_LOWER)
_LINES = f"""
dl AS (SELECT note_id, CAST(i AS INT) AS i, parts[i] AS line, {_ws('parts[i]')} AS t FROM
  (SELECT note_id, string_split(text, chr(10)) AS parts FROM dense), unnest(range(1, len(parts) + 1)) AS u(i)),
hl AS (SELECT *, lower(regexp_replace(t, ':$', '')) IN ({_HEADS}) OR (regexp_matches(regexp_replace(t, ':$', ''), '^[A-Z][A-Z\\s/&]+$')
       AND length(regexp_replace(t, ':$', '')) <= 50) AS is_header FROM dl)"""

_ALLERGY = """
st AS (SELECT *, CASE WHEN contains(lower(t), 'allergies') AND ends_with(t, ':') THEN 2 WHEN is_header AND NOT contains(lower(t), 'allerg') THEN 0 END AS turn FROM hl),
carried AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY i), 0) AS state FROM st)"""

# The fold over a note's header lines, one header at a time.
_REPEATS = f"""
heads AS (SELECT note_id, i, lower(t) AS h, row_number() OVER (PARTITION BY note_id ORDER BY i) AS ord FROM dl WHERE t <> '' AND (
  lower(t) IN ({_HEADS}) OR lower(regexp_replace(t, ':$', '')) IN ({_HEADS}) OR (regexp_matches(t, '^[A-Z][A-Z\\s]+$') AND length(t) <= 40))),
fold(note_id, ord, i, again, recent) AS (
  SELECT note_id, ord, i, false, [{{'i': i, 'h': h}}] FROM heads WHERE ord = 1
  UNION ALL
  SELECT note_id, ord, i, again, CASE WHEN again THEN recent ELSE list_append(recent[greatest(len(recent) - 3, 1):], {{'i': i, 'h': h}}) END FROM (
    SELECT n.note_id, n.ord, n.i, n.h, f.recent, len(list_filter(f.recent, lambda k: k.h = n.h AND n.i - k.i < 10)) > 0 AS again
    FROM fold f JOIN heads n ON n.note_id = f.note_id AND n.ord = f.ord + 1)),
gone AS (SELECT note_id, i FROM fold WHERE again)"""

ORACLES = {
    "format_dates": sql(f"SELECT note_id, {_DATES} AS text FROM dense", _DENSE),
    "format_allergies": sql(
        """SELECT note_id, string_agg(CASE WHEN state = 2 AND turn IS DISTINCT FROM 2 AND t <> '' AND NOT starts_with(t, '-') AND NOT starts_with(t, '•')
             AND NOT is_header AND NOT contains(lower(t), 'no known') THEN '- ' || t ELSE line END, chr(10) ORDER BY i) AS text FROM carried GROUP BY 1""",
        _DENSE, _LINES, _ALLERGY),
    "format_dedupe_headers": "WITH RECURSIVE " + sql(
        """SELECT note_id, string_agg(line, chr(10) ORDER BY i) AS text FROM dl WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.note_id = dl.note_id
             AND (g.i = dl.i OR (g.i = dl.i + 1 AND dl.t = ''))) GROUP BY 1""", _DENSE, _LINES, _REPEATS)[5:],
    "format_sentences": sql(f"SELECT note_id, {_SENTENCES} AS text FROM dense", _DENSE),
    "format_clean": sql(f"SELECT note_id, {_CLEAN} AS text FROM dense", _DENSE),
}

for _job in jobs.JOBS:
    if _job != "format_wrap":
        _register(_job)


@query("format_wrap", "WITH RECURSIVE " + sql(
    "SELECT note_id, string_agg(piece, chr(10) ORDER BY i, k, j) AS text FROM short WHERE j > 0 AND (piece <> '' OR (j = 1 AND rest IS NULL)) GROUP BY 1",
    _DENSE.replace("dense AS (", "gapped AS (", 1) + ", dense AS (SELECT note_id, regexp_replace(text, ' {2,}', ' ', 'g') AS text FROM gapped)",
    _WRAP)[5:])
def _(spark, sf):
    plain = dense_notes(spark, sf).withColumn("text", F.regexp_replace("text", " {2,}", " "))
    return sized(jobs.format_job(plain, "format_wrap"))


@query("format_notes")
def format_notes(spark, sf):
    return sized(jobs.format_notes(dense_notes(spark, sf)))


@query("format_diff", sql(
    f"""SELECT note_id, raw_lines, formatted_lines, formatted_lines - raw_lines AS breaks_added, changed FROM (
        SELECT note_id, len(string_split(raw_text, chr(10)))::INT AS raw_lines, len(string_split(done, chr(10)))::INT AS formatted_lines,
               raw_text <> done AS changed FROM (SELECT note_id, raw_text, {_SENTENCES} AS done FROM dense))""", _DENSE))
def _(spark, sf):
    n = dense_notes(spark, sf)
    return jobs.format_diff(n, jobs.format_job(n, "format_sentences"))


@query("format_with_fallback", sql(
    """SELECT note_id, CASE WHEN pos % 3 = 0 THEN 'model' ELSE 'regex' END AS mode,
       CASE WHEN pos % 3 = 0 THEN '' WHEN pos % 3 = 1 THEN 'Model error: out of memory - using regex fallback'
            ELSE 'Model error: Unknown - using regex fallback' END AS error,
       CASE WHEN pos % 3 = 0 THEN 'M: ' || left(text, 100) ELSE '' END AS model_text FROM notes""", N))
def _(spark, sf):
    n = notes(spark, sf)
    predicted = n.where("pos % 3 < 2").select(
        "note_id", F.concat(F.lit("M: "), F.substring("text", 1, 100)).alias("text"),
        F.when(F.col("pos") % 3 == 1, "out of memory").alias("error"))
    got = jobs.format_with_fallback(n, "model", predicted)
    return got.select("note_id", "mode", F.coalesce("error", F.lit("")).alias("error"),
                      F.when(F.col("mode") == "model", F.col("text")).otherwise("").alias("model_text"))
