"""Tokens, model scores and their decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chartspan.functions import vocab
from chartspan.functions.text import WHITESPACE, let
from chartspan.operators.lines import _low, is_bullet_token, line_type_of, section_of
from chartspan.plans.session import by_value, text_batches

by_value(__name__)

#: Tokens of a line that are looked at.
LOOKAHEAD = 10
#: Parts that the occurrences of a token are dealt to.
SALTS = 16
#: Token rows after which a batch is handed on.
_ROWS = 1 << 16
#: Bytes of text that are cut into tokens at once.
_BYTES = 1 << 19
#: White space beyond ASCII: the leading bytes, and the last bytes that may follow them.
_WIDE_SPACES = {
    b"\xc2": b"\x85\xa0", b"\xe1\x9a": b"\x80", b"\xe2\x80": bytes(range(0x80, 0x8B)) + b"\xa8\xa9\xaf",
    b"\xe2\x81": b"\x9f", b"\xe3\x80": b"\x80"}
#: Plain values, so that they travel to the tasks with the functions of this module.
_PATTERNS = vocab.SECTION_PATTERNS


def _spaces(text: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are white space: the characters of Unicode's ``White_Space``."""
    found = (text == 0x20) | (text - np.uint8(0x09) < 5)
    for lead, lasts in _WIDE_SPACES.items():
        at = np.flatnonzero(text == lead[0])
        at = at[at + len(lead) < len(text)]
        for i, byte in enumerate(lead[1:], 1):
            at = at[text[at + i] == byte]
        at = at[np.isin(text[at + len(lead)], np.frombuffer(lasts, np.uint8))]
        for i in range(len(lead) + 1):
            found[at + i] = True
    return found


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """White-space tokens of an array of texts: the note of each, the token, its start and its end in characters."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    upto = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset:plain.offset + len(plain) + 1]
    body = plain.buffers()[2]
    text = np.frombuffer(body, np.uint8)[upto[0]:upto[-1]] if body is not None else np.zeros(0, np.uint8)
    upto = upto - upto[0]
    word = ~_spaces(text)
    # a token ends at a space, or with its note
    edge = np.zeros(len(text) + 1, bool)
    edge[upto] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    note = np.searchsorted(upto, starts, "right") - 1
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    tokens = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(text[word])).cast(pa.string())
    if len(text) and text.max() > 0x7F:
        # characters before each byte
        chars = np.concatenate([[0], np.cumsum(text & 0xC0 != 0x80)])
        starts, ends, upto = chars[starts], chars[ends], chars[upto]
    first = upto[note]
    return note, tokens, (starts - first).astype(np.int32), (ends - first).astype(np.int32)


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with some ``_BYTES`` of text each; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // _BYTES
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def tokenize_offsets(notes: DataFrame, keep: tuple[str, ...] = ("note_id",)) -> DataFrame:
    """White-space tokens with offsets, cut inside the task: no shuffle, linear in the text."""
    text_batches()
    given = notes.select(*keep, F.col("text").alias("__text"))
    fields = [*given.schema.fields[:-1], *StructType.fromDDL("idx int, token string, start int, end int").fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _portions(batch, batch.num_columns - 1):
                note, tokens, starts, ends = _cut(some.column(some.num_columns - 1))
                idx = np.arange(len(note)) - np.searchsorted(note, note)
                for i in range(0, len(note), _ROWS):
                    rows = slice(i, i + _ROWS)
                    kept = [c.take(pa.array(note[rows])) for c in some.columns[:-1]]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(idx[rows], pa.int32()), tokens[rows], pa.array(starts[rows]), pa.array(ends[rows])],
                        [*some.schema.names[:-1], "idx", "token", "start", "end"])

    return given.mapInArrow(run, StructType(fields))


def encode_tokens(tokens: DataFrame, vocabulary: DataFrame, unknown: int, lower: bool = False) -> DataFrame:
    """Vocabulary ids of tokens; ``vocabulary`` holds (token, token_id).

    Frequent tokens are spread: occurrences carry a salt of their note, and each vocabulary entry
    meets them once per salt.
    """
    key = F.lower("token") if lower else F.col("token")
    keyed = tokens.withColumn("__key", key).withColumn("__salt", F.pmod(F.xxhash64("note_id"), F.lit(SALTS)).cast("int"))
    ids = vocabulary.select(F.col("token").alias("__key"), "token_id",
                            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return keyed.join(ids, ["__key", "__salt"], "left").withColumn(
        "token_id", F.coalesce("token_id", F.lit(unknown))).drop("__key", "__salt")


def _scoring(model: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """Batches of notes to batches of their tokens, starts, logits and error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model()

        def one(tokens: list[str]) -> tuple[np.ndarray, str | None]:
            try:
                rows = np.asarray(score(tokens), dtype="float64")
                if rows.ndim != 2 or len(rows) != len(tokens):
                    raise ValueError(f"{len(rows)} rows of scores for {len(tokens)} tokens")
                return rows, None
            except Exception as e:
                return np.zeros((0, 0)), f"{type(e).__name__}: {e}"

        for batch in (some for b in batches for some in _portions(b, 1)):
            note, words, starts, _ = _cut(batch.column(1))
            # notes without a token are left out
            known, sizes = np.unique(note, return_counts=True)
            if not len(known):
                continue
            upto = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            bundles = [batch.column(0).take(pa.array(known)), pa.ListArray.from_arrays(upto, words),
                       pa.ListArray.from_arrays(upto, pa.array(starts))]
            scored = [one(t) for t in bundles[1].to_pylist()]
            rows, errors = [x[0] for x in scored], [x[1] for x in scored]
            ends = np.cumsum([0, *(len(r) for r in rows)])
            widths = np.concatenate([[0], *(np.full(len(r), r.shape[1]) for r in rows)])
            flat = np.concatenate([np.zeros(0), *(r.ravel() for r in rows)])
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum(widths), pa.int32()), pa.array(flat))
            logits = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), tokens, mask=pa.array([e is not None for e in errors], pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [*bundles, logits, pa.array(errors, pa.string())], ["note_id", "tokens", "starts", "logits", "error"])

    return run


def score_notes(
    notes: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]]
) -> DataFrame:
    """Run a token classifier over whole notes: (note_id, tokens, starts, logits, error).

    ``model`` is called once per worker task and returns a function from a note's tokens to one
    row of logits per token. Notes flow through in Arrow batches, one row each. A note on which
    the model fails has null logits and the failure's text in ``error``; it costs no other note.
    """
    text_batches()
    return notes.select("note_id", "text").mapInArrow(
        _scoring(model), "note_id string, tokens array<string>, starts array<int>, logits array<array<double>>, error string")


def score_tokens(
    notes: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]]
) -> DataFrame:
    """Scores as rows (note_id, idx, token, start, end, logits) of the notes the model could score.

    Tokens travel along with their scores, so nothing has to be joined or shuffled afterwards.
    ``score_notes`` tells which notes failed.
    """
    rows = score_notes(notes, model).where(F.col("error").isNull()).select(
        "note_id", F.posexplode(F.arrays_zip("tokens", "starts", "logits")).alias("idx", "__t"))
    return rows.select(
        "note_id", "idx", F.col("__t.tokens").alias("token"), F.col("__t.starts").alias("start"),
        (F.col("__t.starts") + F.length("__t.tokens")).alias("end"), F.col("__t.logits").alias("logits"))


def predicted_text(scored: DataFrame) -> DataFrame:
    """(note_id, text, error) from ``score_notes``: breaks applied inside the note's row, no shuffle.

    It is what ``format_with_fallback`` takes as the model's predictions.
    """
    ends = F.transform("logits", lambda x: F.array_position(x, F.array_max(x)))
    mark = lambda n: F.when(n == 3, "\n\n").when(n == 2, "\n").otherwise(" ")
    text = F.array_join(F.zip_with("tokens", ends, lambda t, n: F.concat(t, mark(n))), "")
    return scored.select("note_id", F.btrim(text, F.lit(" \n")).alias("text"), "error")


def softmax(logits: Column) -> Column:
    """Shares of the exponentials. The maximum, the exponentials and their sum are bound, so each is computed once."""
    exps = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(exps, lambda es: let(
        F.aggregate(es, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(es, lambda e: e / total)))


def decode_logits(scored: DataFrame) -> DataFrame:
    """Probabilities, label (first maximum wins), confidence, entropy in bits, ambiguity."""
    p = scored.withColumn("p", softmax(F.col("logits")))
    entropy = -F.aggregate("p", F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    ranked = F.sort_array("p", asc=False)
    return p.select(
        *[c for c in scored.columns if c != "logits"],
        (F.array_position("logits", F.array_max("logits")) - 1).cast("int").alias("label_no"),
        F.array_max("p").alias("raw_confidence"),
        F.round(F.array_max("p"), 3).alias("confidence"),
        F.transform("p", lambda x: F.round(x, 3)).alias("probs"),
        F.round(entropy, 3).alias("entropy"),
        (F.element_at(ranked, 2) >= F.element_at(ranked, 1) * 0.8).alias("ambiguous"),
    )


def break_struct(probs: Column) -> Column:
    """The three break probabilities under their names."""
    return F.struct(*[F.element_at(probs, i + 1).alias(n) for i, n in enumerate(vocab.BREAK_NAMES)])


def apply_breaks(tokens: DataFrame) -> DataFrame:
    """Tokens and labels back to text: blank, line feed or empty line after each token."""
    sep = F.when(F.col("label_no") == 2, "\n\n").when(F.col("label_no") == 1, "\n").otherwise(" ")
    pieces = F.array_sort(F.collect_list(F.struct("idx", F.concat("token", sep).alias("s"))))
    joined = F.array_join(F.transform(pieces, lambda x: x["s"]), "")
    return tokens.groupBy("note_id").agg(joined.alias("text")).withColumn(
        "text", F.btrim("text", F.lit(" \n")))


def line_lookahead(tokens: DataFrame, k: int = LOOKAHEAD) -> DataFrame:
    """For each token the text up to the next break, ten tokens at most.

    A line ends with its first token that carries a break, so lines are islands of the running
    break count and a token sees the rest of its own island.
    """
    order = Window.partitionBy("note_id").orderBy("idx")
    prior = Window.partitionBy("note_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tokens.withColumn(
        "break_no", F.coalesce(F.sum((F.col("label_no") != 0).cast("int")).over(prior), F.lit(0)))
    ahead = Window.partitionBy("note_id", "break_no").orderBy("idx").rowsBetween(0, k - 1)
    started = F.coalesce(F.lag("label_no").over(order) != 0, F.lit(True))
    return (
        numbered.withColumn("is_line_start", started)
        .withColumn("line_text", F.array_join(F.collect_list("token").over(ahead), " "))
        .drop("break_no")
    )


def _why(found: DataFrame) -> DataFrame:
    """Decision name, line type and the reason of each break, from the row alone."""
    at_start = F.col("is_line_start")
    low = F.col("__low")
    bullet = at_start & is_bullet_token(F.col("token"))
    known = low.isin([*vocab.MAJOR_HEADERS, *vocab.MINOR_HEADERS])
    names = F.array(*[F.lit(n) for n in vocab.BREAK_NAMES])
    return found.withColumn("__low", _low(F.col("token"))).withColumns({
        "decision": F.element_at(names, F.col("label_no") + 1),
        "line_type": F.when(at_start, line_type_of("line_text", bullet, F.col("detected")))
        .otherwise("NARRATIVE"),
        "reason": F.when(F.col("label_no") == 0, "context")
        .when(F.endswith("token", F.lit(":")) | known, "section_header")
        .when(bullet, "list_item")
        .when(low.isin(vocab.SIGNATURE_TOKENS), "signature")
        .otherwise("learned_pattern"),
    }).drop("__low")


def explain_breaks(tokens: DataFrame) -> DataFrame:
    """Decision name, line type, carried section and the reason of each break.

    ``tokens`` come from ``line_lookahead``. Scores that still lie in their notes' rows are
    explained without a shuffle by ``explain_notes``.
    """
    order = Window.partitionBy("note_id").orderBy("idx")
    found = tokens.withColumn(
        "detected", F.when(F.col("is_line_start"), section_of("line_text")).otherwise("NONE"))
    return _why(found.withColumn("section", F.coalesce(
        F.last(F.when(F.col("detected") != "NONE", F.col("detected")), ignorenulls=True).over(order),
        F.lit("NONE"))))


#: Lines of a task whose section is remembered; short lines come again and again.
_REMEMBERED = 1 << 16


def _section_names() -> tuple[list[str], Callable[[list[str]], list[int]]]:
    """``section_of`` for the lines of a task: the names, ``NONE`` first, and the place among them of each line's name."""
    named = [re.compile(rf"(?:{pattern})\s*:?", re.ASCII) for _, pattern in _PATTERNS]
    anyone = re.compile("(?:" + "|".join(pattern for _, pattern in _PATTERNS) + r")\s*:?", re.ASCII)
    known: dict[str, int] = {}

    def place(line: str) -> int:
        bare = line.lower().removesuffix(":").strip(WHITESPACE)
        found = 0
        if anyone.fullmatch(bare):
            found = next((i for i, pattern in enumerate(named, 1) if pattern.fullmatch(bare)), 0)
        if len(known) >= _REMEMBERED:
            known.clear()
        known[line] = found
        return found

    def places(lines: list[str]) -> list[int]:
        get = known.get
        return [place(x) if (found := get(x)) is None else found for x in lines]

    return ["NONE", *(name for name, _ in _PATTERNS)], places


def _lines(text: str, sizes: np.ndarray, broken: np.ndarray, k: int) -> list[str]:
    """For each token the text up to the next break, ``k`` tokens at most: cuts of the tokens joined by blanks."""
    places = np.arange(len(sizes))
    following = np.minimum.accumulate(np.where(broken, places, len(sizes) - 1)[::-1])[::-1]
    ends = np.cumsum(sizes) + places
    last = np.minimum(following, places + k - 1)
    return [text[i:j] for i, j in zip((ends - sizes).tolist(), ends[last].tolist())]


_EXPLAINED = ("note_id string, idx int, token string, start int, logits array<double>, __label int, is_line_start boolean, "
              "line_text string, detected string, section string, prior_section string")


def _explaining(k: int):
    """Batches of ``note_id, tokens, starts, logits`` to token rows with line starts, the text up to the next break and sections."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = _section_names()
        names = pa.array(names, pa.string())
        columns = [f.split()[0] for f in _EXPLAINED.split(", ")]

        def note(text: str, sizes: np.ndarray, width: int, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
            n = len(sizes)
            label = flat.reshape(n, width).argmax(axis=1) if width else np.zeros(n, np.int64)
            fresh = np.concatenate([[True], label[:-1] != 0])
            lines = _lines(text, sizes, label != 0, k)
            detected = np.zeros(n, np.int64)
            at = np.flatnonzero(fresh)
            detected[at] = places([lines[i] for i in at.tolist()])
            at = np.maximum.accumulate(np.where(detected != 0, np.arange(n), -1))
            return label, fresh, lines, detected, np.where(at >= 0, detected[at], 0)

        for batch in batches:
            words, starts, logits = (batch.column(i).values for i in (1, 2, 3))
            cuts, begins, upto = (np.asarray(batch.column(i).offsets) for i in (1, 2, 3))
            inner, values = np.asarray(logits.offsets), np.asarray(logits.values)
            sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
            texts = pc.binary_join(batch.column(1), " ").to_pylist()
            rows, held = [], 0
            for i in range(batch.num_rows):
                lo, hi = upto[i], upto[i + 1]
                n = hi - lo
                label, fresh, lines, detected, section = note(
                    texts[i], sizes[cuts[i]:cuts[i + 1]], int(inner[lo + 1] - inner[lo]), values[inner[lo]:inner[hi]])
                rows.append([
                    batch.column(0).take(pa.array(np.full(n, i))), pa.array(np.arange(n), pa.int32()),
                    words.slice(cuts[i], n), starts.slice(begins[i], n), logits.slice(lo, n), pa.array(label, pa.int32()),
                    pa.array(fresh, pa.bool_()), pa.array(lines, pa.string()), names.take(pa.array(detected)), names.take(pa.array(section)),
                    names.take(pa.array(np.concatenate([[0], section[:-1]])))])
                held += n
                if held >= _ROWS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows)], columns)
                    rows, held = [], 0

    return run


def _decoded(whole: DataFrame) -> DataFrame:
    decoded = decode_logits(whole.withColumn("end", F.col("start") + F.length("token")))
    # the first maximum again, already known
    return _why(decoded.withColumn("label_no", F.col("__label")).drop("__label"))


def explain_notes(scored: DataFrame, k: int = LOOKAHEAD) -> DataFrame:
    """``line_lookahead`` and ``explain_breaks`` of ``score_notes`` rows, decoded.

    A note's tokens are one array of its row, so line starts, the text up to the next break and
    the carried section come from one pass over it and nothing is shuffled. ``prior_section`` is
    the section before each token.
    """
    text_batches()
    return _decoded(scored.where(F.col("error").isNull()).select("note_id", "tokens", "starts", "logits").mapInArrow(_explaining(k), _EXPLAINED))


def score_and_explain(
    notes: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]], k: int = LOOKAHEAD
) -> DataFrame:
    """``explain_notes`` of ``score_notes`` in one pass: tokens and scores stay with the task's Python between the two."""
    text_batches()
    score, explain = _scoring(model), _explaining(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sound = (b if not b.num_rows - b.column(4).null_count else b.filter(pc.is_null(b.column(4))) for b in score(batches))
        yield from explain(b for b in sound if b.num_rows)

    return _decoded(notes.select("note_id", "text").mapInArrow(run, _EXPLAINED))


def token_badges(tokens: DataFrame) -> DataFrame:
    """Section changes at line starts, from explained tokens with offsets."""
    order = Window.partitionBy("note_id").orderBy("idx")
    known = "prior_section" in tokens.columns
    prior = F.col("prior_section") if known else F.coalesce(F.lag("section").over(order), F.lit("NONE"))
    return (
        tokens.withColumn("__prior", prior)
        .where(F.col("is_line_start") & (F.col("section") != "NONE") & (F.col("section") != F.col("__prior")))
        .select("note_id", F.col("start").alias("pos"), "section")
    )


def label_tokens(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """Name the predicted label of each token; 0 stays the empty label."""
    names = F.array(*[F.lit(x) for x in labels])
    return tokens.withColumn(
        "label", F.coalesce(F.try_element_at(names, F.col("label_no") + 1), F.lit("RADIOLOGY")))
