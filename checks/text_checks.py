"""Lines, sections, tokens and model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import BADGES_SQL, LINES_SQL, N, TOKENS_SQL, _ws, notes, sql
from chartspan.formatting import lexicon as lex
from chartspan.functions import vocab
from chartspan.operators import lines, stats, tokens


def L(spark, sf):
    return lines.explode_lines(notes(spark, sf))


@query("explode_lines", sql('SELECT note_id, line_no, "start", line FROM lines', N, LINES_SQL))
def _(spark, sf):
    return L(spark, sf)


@query("implode_lines", sql("SELECT note_id, text FROM notes", N))
def _(spark, sf):
    return lines.implode_lines(L(spark, sf))


def _set(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _line_flags():
    t = _ws("line")
    bare = f"regexp_replace({t}, ':$', '')"
    return f"""{t} = '' AS is_blank,
      lower({bare}) IN ({_set(lex.HEADERS_LOWER)}) OR (regexp_matches({bare}, '^[A-Z][A-Z\\s/&]+$') AND length({bare}) <= 50) AS is_header,
      lower({bare}) IN ({_set(lex.SYSTEM_LABELS_LOWER)}) AS is_system_label,
      (starts_with({t}, '+') AND (contains({t}, '---') OR contains({t}, '==='))) OR
        (starts_with({t}, '|') AND length({t}) - length(replace({t}, '|', '')) >= 2) AS is_table_row,
      regexp_matches(line, '^\\s*\\d+[.)]\\s') AS is_numbered,
      regexp_matches(line, '{lex.MEDICATION}') AS is_medication,
      {t} <> '' AND ({' OR '.join(f"contains(lower({t}), '{n.lower()}')" for n in lex.LAB_NAMES)}
        OR regexp_matches({t}, '(?i)\\d+\\.?\\d*\\s*(mg/dL|mmol/L|mEq/L|g/dL|%|K/uL|M/uL)')) AS is_lab_result,
      lower({bare}) IN ({_set([h.lower() for h in lex.SOCIAL_HEADERS])}) AS is_social_header,
      regexp_matches({t}, '(?i)^-?\\s*(smoking status|alcohol use|drug use|tobacco use|substance use)')
        OR regexp_matches({t}, '(?i)^never smoker$') OR regexp_matches({t}, '(?i)^(current|former) smoker') AS is_social_item"""


# Every fourth line is dressed up so that each class occurs.
_DRESS = """
dressed AS (SELECT note_id, line_no, CASE (pos + line_no) % 16
    WHEN 0 THEN '  PAST MEDICAL HISTORY: ' WHEN 1 THEN 'take 2 tablets ' || line WHEN 2 THEN '| ' || line || ' |' WHEN 3 THEN '1. ' || line
    WHEN 4 THEN 'Eyes:' WHEN 5 THEN 'Glucose Level 90 mg/dL' WHEN 6 THEN 'Tobacco Use:' WHEN 7 THEN '- Smoking status: ' || line
    WHEN 8 THEN '+---+' WHEN 9 THEN 'LINES AND TUBES & MORE' WHEN 10 THEN '- ' || line WHEN 11 THEN '12 3.5 7 ' || line ELSE line END AS line FROM raw_lines)"""


def dressed(spark, sf):
    base = lines.explode_lines(notes(spark, sf), ("note_id", "pos"))
    k = (F.col("pos") + F.col("line_no")) % 16
    line = F.col("line")
    cases = {
        0: F.lit("  PAST MEDICAL HISTORY: "), 1: F.concat(F.lit("take 2 tablets "), line),
        2: F.concat(F.lit("| "), line, F.lit(" |")), 3: F.concat(F.lit("1. "), line),
        4: F.lit("Eyes:"), 5: F.lit("Glucose Level 90 mg/dL"), 6: F.lit("Tobacco Use:"),
        7: F.concat(F.lit("- Smoking status: "), line), 8: F.lit("+---+"), 9: F.lit("LINES AND TUBES & MORE"),
        10: F.concat(F.lit("- "), line), 11: F.concat(F.lit("12 3.5 7 "), line),
    }
    out = F.when(F.lit(False), line)
    for n, v in cases.items():
        out = out.when(k == n, v)
    return base.withColumn("line", out.otherwise(line)).drop("pos", "start")


@query("classify_lines", sql(f"SELECT note_id, line_no, {_line_flags()} FROM dressed", N, LINES_SQL, _DRESS))
def _(spark, sf):
    return lines.classify_lines(dressed(spark, sf)).drop("line")


def _major(section, bare="bare"):
    return f"{bare} IN ({_set(vocab.MAJOR_HEADERS)}) OR {section} <> 'NONE'"


@query("detect_sections", sql("SELECT note_id, line_no, section FROM lines", N, LINES_SQL))
def _(spark, sf):
    return lines.detect_sections(L(spark, sf)).select("note_id", "line_no", "section")


def _type_case(line, bullet, bare, section):
    return (f"CASE WHEN {bullet} THEN 'LIST_ITEM' WHEN {_major(section, bare)} THEN 'MAJOR_HEADER' "
            f"WHEN {bare} IN ({_set(vocab.MINOR_HEADERS)}) THEN 'MINOR_HEADER' "
            f"WHEN regexp_matches({line}, '\\d+\\.?\\d*\\s+\\d+\\.?\\d*\\s+\\d+\\.?\\d*') OR contains({line}, '|') OR contains({line}, chr(9)) "
            "THEN 'TABLE_ROW' ELSE 'NARRATIVE' END")


def _section_of(bare):
    return "CASE " + " ".join(
        f"WHEN regexp_matches({bare}, '^(?:{p})\\s*:?$') THEN '{n}'" for n, p in vocab.SECTION_PATTERNS) + " ELSE 'NONE' END"


@query("line_types", sql(
    f"SELECT note_id, line_no, section, {_type_case('line', 'bullet', 'bare', 'section')} AS line_type FROM ("
    f"SELECT *, {_section_of('bare')} AS section FROM (SELECT *, regexp_matches(ltrim(line), '^([~•](\\s|$)|[-*])') AS bullet, "
    f"{_ws('regexp_replace(lower(line), chr(58) || chr(36), chr(0))')} AS b0, "
    + _ws("CASE WHEN ends_with(line, ':') THEN lower(line[:-2]) ELSE lower(line) END") + " AS bare FROM dressed))", N, LINES_SQL, _DRESS))
def _(spark, sf):
    return lines.line_types(dressed(spark, sf)).select("note_id", "line_no", "section", "line_type")


@query("carry_sections", sql("SELECT note_id, line_no, carried FROM carried", N, LINES_SQL))
def _(spark, sf):
    return lines.carry_sections(lines.detect_sections(L(spark, sf))).select("note_id", "line_no", "carried")


@query("section_badges", sql("SELECT note_id, pos, section FROM badges", N, LINES_SQL, BADGES_SQL))
def _(spark, sf):
    return lines.section_badges(lines.carry_sections(lines.detect_sections(L(spark, sf))))


@query("section_text", sql(
    "SELECT note_id, section_no, max(carried) AS section, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ("
    "SELECT *, CAST(sum(CASE WHEN section <> 'NONE' THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY line_no) AS BIGINT) AS section_no "
    "FROM carried) GROUP BY 1, 2", N, LINES_SQL))
def _(spark, sf):
    return lines.section_text(lines.carry_sections(lines.detect_sections(L(spark, sf))))


# --- tokens --------------------------------------------------------------------------------

def T(spark, sf):
    return tokens.tokenize_offsets(notes(spark, sf))


@query("tokenize_offsets", sql('SELECT note_id, idx, token, "start", "end" FROM toks', N, TOKENS_SQL))
def _(spark, sf):
    return T(spark, sf)


_VOCAB = """
vocabulary AS (SELECT token, CAST(min(length(token)) + 10 AS INT) AS token_id FROM (SELECT lower(token) AS token FROM toks WHERE idx % 3 = 0) GROUP BY 1)"""


@query("encode_tokens", sql(
    "SELECT t.note_id, t.idx, coalesce(v.token_id, 1) AS token_id FROM toks t LEFT JOIN vocabulary v ON lower(t.token) = v.token",
    N, TOKENS_SQL, _VOCAB))
def _(spark, sf):
    t = T(spark, sf)
    known = t.where("idx % 3 = 0").select(F.lower("token").alias("token")).distinct().withColumn(
        "token_id", F.length("token") + 10)
    return tokens.encode_tokens(t, known, 1, lower=True).select("note_id", "idx", "token_id")


def stub_model():
    """A stand-in classifier: logits from the token's length and place, so SQL can restate them.

    Built inside a function so that it travels to the workers with the query.
    """

    def load():
        def score(toks):
            return [[((len(t) * (j + 3) + i * (j + 1)) % 11) / 4 for j in range(3)] for i, t in enumerate(toks)]

        return score

    return load


_LOGITS = """
logits AS (SELECT note_id, idx, token, "start", ((length(token) * 3 + idx) % 11) / 4.0 AS l0, ((length(token) * 4 + idx * 2) % 11) / 4.0 AS l1,
                  ((length(token) * 5 + idx * 3) % 11) / 4.0 AS l2 FROM toks),
probs AS (SELECT *, exp(l0 - m) / s AS p0, exp(l1 - m) / s AS p1, exp(l2 - m) / s AS p2 FROM (
  SELECT *, exp(l0 - m) + exp(l1 - m) + exp(l2 - m) AS s FROM (SELECT *, greatest(l0, l1, l2) AS m FROM logits))),
decoded AS (SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS label_no, greatest(p0, p1, p2) AS conf FROM probs)"""


def scored(spark, sf):
    return tokens.score_tokens(notes(spark, sf), stub_model())


def decoded(spark, sf):
    return tokens.decode_logits(scored(spark, sf))


@query("score_tokens", sql("SELECT note_id, idx, CAST(l0 AS DOUBLE) AS l0, CAST(l1 AS DOUBLE) AS l1, CAST(l2 AS DOUBLE) AS l2 FROM logits",
                           N, TOKENS_SQL, _LOGITS))
def _(spark, sf):
    return scored(spark, sf).select("note_id", "idx", *[F.element_at("logits", i + 1).alias(f"l{i}") for i in range(3)])


@query("decode_logits", sql(
    """SELECT note_id, idx, label_no, round(conf, 3) AS confidence, round(p0, 3) AS space, round(p1, 3) AS newline, round(p2, 3) AS blank_line,
       round(-(p0 * log2(p0) + p1 * log2(p1) + p2 * log2(p2)), 3) AS entropy,
       p0 + p1 + p2 - conf - least(p0, p1, p2) >= conf * 0.8 AS ambiguous FROM decoded""", N, TOKENS_SQL, _LOGITS))
def _(spark, sf):
    d = tokens.decode_logits(scored(spark, sf))
    p = tokens.break_struct(F.col("probs"))
    return d.withColumn("p", p).select("note_id", "idx", "label_no", "confidence", "p.*", "entropy", "ambiguous")


@query("apply_breaks", sql(
    "SELECT note_id, trim(string_agg(token || CASE label_no WHEN 2 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) ELSE ' ' END, '' ORDER BY idx), "
    "' ' || chr(10)) AS text FROM decoded GROUP BY 1", N, TOKENS_SQL, _LOGITS))
def _(spark, sf):
    whole = tokens.predicted_text(tokens.score_notes(notes(spark, sf), stub_model()))
    return whole.where(F.col("error").isNull()).select("note_id", "text")


_AHEAD = """
ahead0 AS (SELECT *, coalesce(sum(CASE WHEN label_no <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isle,
           coalesce(lag(label_no) OVER (PARTITION BY note_id ORDER BY idx) <> 0, true) AS is_line_start FROM decoded),
ahead AS (SELECT *, string_agg(token, ' ') OVER (PARTITION BY note_id, isle ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS line_text FROM ahead0)"""


@query("line_lookahead", sql("SELECT note_id, idx, is_line_start, line_text FROM ahead", N, TOKENS_SQL, _LOGITS, _AHEAD))
def _(spark, sf):
    rows = tokens.score_and_explain(notes(spark, sf), stub_model())
    return rows.select("note_id", "idx", "is_line_start", "line_text")


_LOW = "CASE WHEN ends_with(token, ':') THEN lower(token[:-2]) ELSE lower(token) END"
_TBARE = _ws("CASE WHEN ends_with(line_text, ':') THEN lower(line_text[:-2]) ELSE lower(line_text) END")
_BULLET = "(regexp_matches(token, '^[~•]$') OR starts_with(token, '-') OR starts_with(token, '*'))"
_EXPLAINED = f"""
det AS (SELECT *, CASE WHEN is_line_start THEN {_section_of('bare')} ELSE 'NONE' END AS detected FROM (SELECT *, {_TBARE} AS bare, {_LOW} AS low FROM ahead)),
explained AS (SELECT *, ['space', 'newline', 'blank_line'][label_no + 1] AS decision,
  CASE WHEN is_line_start THEN {_type_case('line_text', _BULLET, 'bare', 'detected')} ELSE 'NARRATIVE' END AS line_type,
  coalesce(last_value(CASE WHEN detected <> 'NONE' THEN detected END IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY idx), 'NONE') AS section,
  CASE WHEN label_no = 0 THEN 'context' WHEN ends_with(token, ':') OR low IN ({_set(vocab.MAJOR_HEADERS + vocab.MINOR_HEADERS)}) THEN 'section_header'
       WHEN is_line_start AND {_BULLET} THEN 'list_item' WHEN low IN ({_set(vocab.SIGNATURE_TOKENS)}) THEN 'signature' ELSE 'learned_pattern' END AS reason FROM det)"""


def explained(spark, sf):
    return tokens.score_and_explain(notes(spark, sf), stub_model())


@query("explain_breaks", sql("SELECT note_id, idx, decision, line_type, section, reason FROM explained",
                             N, TOKENS_SQL, _LOGITS, _AHEAD, _EXPLAINED))
def _(spark, sf):
    return explained(spark, sf).select("note_id", "idx", "decision", "line_type", "section", "reason")


@query("token_badges", sql(
    "SELECT note_id, \"start\" AS pos, section FROM (SELECT *, coalesce(lag(section) OVER (PARTITION BY note_id ORDER BY idx), 'NONE') AS prior FROM explained) "
    "WHERE is_line_start AND section <> 'NONE' AND section <> prior", N, TOKENS_SQL, _LOGITS, _AHEAD, _EXPLAINED))
def _(spark, sf):
    return tokens.token_badges(explained(spark, sf))


@query("token_stats", sql(
    """SELECT note_id, count(*) AS total_tokens, count(*) FILTER (WHERE label_no = 0) AS spaces, count(*) FILTER (WHERE label_no = 1) AS newlines,
       count(*) FILTER (WHERE label_no = 2) AS blank_lines, round(avg(conf), 3) AS avg_confidence,
       count(*) FILTER (WHERE is_line_start AND line_type IN ('MAJOR_HEADER', 'MINOR_HEADER')) AS headers,
       count(*) FILTER (WHERE is_line_start AND line_type = 'LIST_ITEM') AS list_items,
       coalesce(string_agg(DISTINCT CASE WHEN detected <> 'NONE' THEN detected END, ';' ORDER BY CASE WHEN detected <> 'NONE' THEN detected END), '') AS sections_found
       FROM explained GROUP BY 1""", N, TOKENS_SQL, _LOGITS, _AHEAD, _EXPLAINED))
def _(spark, sf):
    return stats.token_stats(explained(spark, sf)).withColumn("sections_found", F.array_join("sections_found", ";"))
