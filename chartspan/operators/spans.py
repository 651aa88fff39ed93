"""Span algebra: overlaps, segments, merging and expansion.

Range joins go through position bins, so the equi-join key is (note, bin) and a note with a
great many spans is spread over its bins. Copies of one span are folded before they meet
anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.functions.text import let, slice_strides, slice_text, strides
from chartspan.plans.scale import bin_of, islands, span_bins, written

_WORD_TAIL = r"(?U)\A\S*"
#: Characters beside a span that are looked at before the whole text is.
_NEAR = 512


# --- overlap joins -------------------------------------------------------------------------

def _binned(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.withColumn("__bin", F.explode(span_bins(F.col(start), F.col(end))))


def find_overlaps(
    new_spans: DataFrame, annotations: DataFrame, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(new span, annotation) pairs of one note with ``start < b.end and end > b.start``.

    ``new_spans`` carry ``span_id``; each pair is reported in the first bin both sides touch.
    """
    left = _binned(new_spans.select("span_id", "note_id", "start", "end"))
    right = _binned(annotations.select(
        "note_id", "ann_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"), *carry),
        "b_start", "b_end")
    first = bin_of(F.greatest("start", "b_start"))
    return left.join(right, ["note_id", "__bin"]).where(
        (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start"))
        & (F.col("__bin") == first)
    ).drop("__bin")


def find_adjacent(new_spans: DataFrame, annotations: DataFrame) -> DataFrame:
    """Touching spans, looked at only for new spans that overlap nothing."""
    overlapped = find_overlaps(new_spans, _distinct_spans(annotations)).select("span_id")
    free = new_spans.join(overlapped, "span_id", "left_anti")
    return _touching(free, annotations)


def _distinct_spans(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("note_id", "start", "end").agg(F.min("ann_id").alias("ann_id"))


def _touching(spans: DataFrame, annotations: DataFrame) -> DataFrame:
    """Equality on either edge: two equi-joins instead of one condition with OR."""
    s = spans.select("span_id", "note_id", "start", "end")
    a = annotations.select(
        "note_id", "ann_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    cols = ["note_id", "span_id", "start", "end", "ann_id", "b_start", "b_end"]
    after = s.join(a.withColumn("start", F.col("b_end")), ["note_id", "start"]).select(cols)
    ahead = s.join(a.withColumn("end", F.col("b_start")), ["note_id", "end"]).select(cols)
    # an empty pair of spans would meet both ways; report it once
    return after.unionByName(ahead.where(F.col("start") != F.col("b_end")))


def primary_neighbour(new_spans: DataFrame, annotations: DataFrame) -> DataFrame:
    """For each new span the annotation it would be merged with: the earliest inserted one it
    overlaps, else the earliest it touches. Adds ``primary`` (struct) and ``is_adjacent``.

    One pass over candidates serves both: spans meet in the bins of their positions, ends
    included. Annotations are folded to one row per distinct span first (earliest ``seq`` wins,
    combined map-side), so copies of a span do not multiply the candidates. A new span without
    any stays in the join, so it is not fetched again. ``span_id`` is unique; rows that repeat
    one are taken for the same span.
    """
    folded = annotations.groupBy("note_id", F.col("start").alias("b_start"), F.col("end").alias("b_end")).agg(
        F.min_by(F.struct("seq", "ann_id", "start", "end", "questions", "source"), "seq").alias("best"))
    left = new_spans.withColumn("__bin", F.explode_outer(_bins_with_ends("start", "end")))
    right = folded.withColumn("__bin", F.explode(_bins_with_ends("b_start", "b_end")))
    over = (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start"))
    touch = (F.col("start") == F.col("b_end")) | (F.col("end") == F.col("b_start"))
    level = F.when(over, 0).when(touch, 1)
    found = left.join(right, ["note_id", "__bin"], "left").withColumn("__level", level)
    candidate = F.when(F.col("__level").isNotNull(), F.struct(F.col("__level").alias("level"), "best"))
    rest = [c for c in new_spans.columns if c not in ("span_id", "note_id")]
    return found.groupBy("note_id", "span_id").agg(
        F.first(F.struct(*rest)).alias("__span"),
        F.min_by(candidate, F.when(F.col("__level").isNotNull(), F.struct("__level", "best.seq"))).alias("__pick"),
    ).select(
        "span_id", "note_id", "__span.*",
        F.col("__pick.best").alias("primary"),
        (F.col("__pick.level") == 1).alias("is_adjacent"),
    )


def _bins_with_ends(start: str, end: str) -> Column:
    return F.sequence(bin_of(F.col(start)), bin_of(F.greatest(start, end)))


def overlap_extend(new_spans: DataFrame, annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """The first neighbour grown to cover the new span; questions unchanged."""
    return _grown(new_spans, annotations, notes, "extend")


def overlap_merge(new_spans: DataFrame, annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """As ``overlap_extend``, and the new span's question is added when absent."""
    return _grown(new_spans, annotations, notes, "merge")


def _grown(new_spans: DataFrame, annotations: DataFrame, notes: DataFrame, policy: str) -> DataFrame:
    pairs = primary_neighbour(new_spans, annotations).where(F.col("primary").isNotNull())
    text = notes.select("note_id", F.col("text").alias("note_text"))
    return pairs.join(text, "note_id").select("note_id", "span_id", F.inline(F.array(_outcome(policy, True)))).select(
        "ann_id", "note_id", "start", "end", "text", "questions", "source", "span_id")


POLICIES = {"extend": "update", "merge": "update", "keep_both": "create", "cancel": "cancel"}


def _outcome(policy: str, met: bool) -> Column:
    """What a policy makes of a new span that has a neighbour (``met``), or has none."""
    grow = met and POLICIES[policy] == "update"
    start = F.least("start", "primary.start") if grow else F.col("start")
    end = F.greatest("end", "primary.end") if grow else F.col("end")
    old, mine = F.col("primary.questions"), F.col("question_id")
    if not grow:
        questions = F.array(mine)
    elif policy == "extend":
        questions = old
    else:
        questions = F.when(F.array_contains(old, mine), old).otherwise(F.array_append(old, mine))
    return F.struct(
        F.lit(policy).alias("policy"),
        (F.col("primary.ann_id") if grow else F.lit(None).cast("string")).alias("ann_id"),
        start.alias("start"),
        end.alias("end"),
        slice_text("note_text", start, end).alias("text"),
        questions.alias("questions"),
        (F.col("primary.source") if grow else F.lit(None).cast("string")).alias("source"),
        F.lit(POLICIES[policy] if met else "create").alias("action"),
    )


def overlap_outcomes(
    new_spans: DataFrame, annotations: DataFrame, notes: DataFrame, policies: tuple[str, ...]
) -> DataFrame:
    """``overlap_resolve`` under several policies, a row each (``policy``).

    Neighbours are looked for once; a policy is a projection of the pair.
    """
    met = [_outcome(p, True) for p in policies if POLICIES[p] != "cancel"]
    free = [_outcome(p, False) for p in policies]
    paired = primary_neighbour(new_spans, annotations)
    text = notes.select("note_id", F.col("text").alias("note_text"))
    outcomes = F.when(F.col("primary").isNull(), F.array(*free))
    outcomes = outcomes.otherwise(F.array(*met)) if met else outcomes
    return paired.join(text, "note_id").select(
        "span_id", "note_id", F.coalesce("is_adjacent", F.lit(False)).alias("is_adjacent"), F.inline(outcomes),
    ).select("policy", "span_id", "note_id", "ann_id", "start", "end", "text", "questions", "action", "is_adjacent")


def overlap_resolve(
    new_spans: DataFrame, annotations: DataFrame, notes: DataFrame, policy: str = "merge"
) -> DataFrame:
    """Batch form: what becomes of each new span under ``extend``, ``merge``, ``keep_both`` or
    ``cancel``. A span without a neighbour is always created; ``action`` tells which it was."""
    return overlap_outcomes(new_spans, annotations, notes, (policy,)).drop("policy")


def coalesce_annotations(annotations: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Connected overlapping spans of a note become one span with all their questions.

    Annotations are first folded by (note, start): at most one row per text position then
    enters the running maximum, whatever the number of annotations.
    """
    rows = annotations.select(
        "note_id", "start", "end", "ann_id", "source", F.explode_outer("questions").alias("q"))
    per_start = rows.groupBy("note_id", "start").agg(
        F.max("end").alias("end"),
        F.min("ann_id").alias("ann_id"),
        F.count_distinct("ann_id").alias("n"),
        F.collect_set("q").alias("questions"),
        F.bool_and(F.col("source") == "suggested").alias("is_suggested"),
    )
    numbered = islands(per_start, ["note_id"], "start", "end", gap=-1)
    merged = numbered.groupBy("note_id", "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("ann_id").alias("ann_id"),
        F.sum("n").alias("n_merged"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("questions")))).alias("questions"),
        F.bool_and("is_suggested").alias("is_suggested"),
    ).drop("island")
    if notes is None:
        return merged
    text = notes.select("note_id", F.col("text").alias("note_text"))
    return merged.join(text, "note_id").withColumn(
        "text", slice_text("note_text", F.col("start"), F.col("end"))).drop("note_text")


# --- segments ------------------------------------------------------------------------------

def distinct_edges(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct cut points of every note: 0, its length and each span edge inside it."""
    sizes = notes.select("note_id", F.length("text").alias("size"))
    edges = annotations.select(
        "note_id", F.explode(F.array("start", "end")).alias("pos")).distinct()
    inner = edges.join(sizes, "note_id").select(
        "note_id", F.least(F.greatest("pos", F.lit(0)), "size").alias("pos"))
    ends = sizes.select("note_id", F.explode(F.array(F.lit(0), "size")).alias("pos"))
    return inner.unionByName(ends).distinct()


def _inside(annotations: DataFrame) -> DataFrame:
    return annotations.withColumn("start", F.greatest("start", F.lit(0)))


def _edge_pieces(spans: DataFrame) -> DataFrame:
    """(note, seg_no, p, p_end): the stretches between neighbouring span edges of a note.

    Numbered as in the cut note, which has one more piece in front unless an edge is at 0.
    """
    order = Window.partitionBy("note_id").orderBy("p")
    edges = spans.select("note_id", F.explode(F.array("start", "end")).alias("p")).distinct()
    first = F.min("p").over(Window.partitionBy("note_id"))
    return edges.select(
        "note_id", "p",
        F.lead("p").over(order).alias("p_end"),
        (F.row_number().over(order) - F.when(first == 0, 1).otherwise(0)).alias("seg_no"),
    )


def _covering(pieces: DataFrame, spans: DataFrame) -> DataFrame:
    """Each piece lies between neighbouring edges, so a span covers it exactly when it covers the
    piece's start: a point-in-interval join on (note, bin)."""
    left = pieces.where(F.col("p_end").isNotNull()).withColumn("__bin", bin_of(F.col("p")))
    return left.join(_binned(spans), ["note_id", "__bin"]).where(
        (F.col("start") <= F.col("p")) & (F.col("end") >= F.col("p_end"))
    ).drop("__bin")


def segment_annotations(annotations: DataFrame) -> DataFrame:
    """(note, seg_no, annotation): which annotations cover which piece, in long form, so a piece
    under very many annotations stays many rows rather than one long list."""
    inside = _inside(annotations)
    spans = inside.select("note_id", "start", "end").distinct()
    cover = _covering(_edge_pieces(spans), spans).select("note_id", "seg_no", "start", "end")
    return inside.join(cover, ["note_id", "start", "end"]).select("note_id", "seg_no", "ann_id")


def build_segments(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """Cut each note at every span edge; each piece tells what covers it.

    Annotations are folded to distinct spans once, which are written; coverage is worked out on these and on edges.
    The edges reach the notes as one sorted list per note, bounded by the text, so the text is joined once and cut
    inside its row. What covers a piece joins last, one row to a piece, and never meets in a note's row.
    ``segment_annotations`` gives the ids as rows where a list would be too long to handle.
    """
    folded = written(_inside(annotations).groupBy("note_id", "start", "end").agg(
        F.array_sort(F.collect_list(F.struct("ann_id"))).alias("ids"),
        F.array_distinct(F.flatten(F.collect_list("questions"))).alias("questions"),
        F.bool_or(F.col("source") == "suggested").alias("is_suggested"),
    ), "spans")
    per_note = folded.select("note_id", F.explode(F.array("start", "end")).alias("p")).groupBy("note_id").agg(
        F.array_sort(F.collect_set("p")).alias("edges"))
    pieces = per_note.select("note_id", F.posexplode("edges").alias("__i", "p"), "edges").select(
        "note_id", "p", F.try_element_at("edges", F.col("__i") + 2).alias("p_end"))
    facts = _covering(pieces, folded).groupBy("note_id", F.col("p").alias("start")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "ids"))).alias("covers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter("questions", lambda q: q.isNotNull()))))).alias("questions"),
        F.bool_or("is_suggested").alias("is_suggested"),
    ).select(
        "note_id", "start", "questions", "is_suggested",
        F.transform(F.flatten(F.transform("covers", lambda c: c["ids"])), lambda i: i["ann_id"]).alias("annotation_ids"),
        F.aggregate("covers", F.lit(0).cast("long"), lambda n, c: n + F.size(F.array_distinct(
            F.filter(c["ids"], lambda i: i["ann_id"].isNotNull())))).alias("n"),
    )
    size = F.length("text")
    origin = F.array(F.lit(0))
    starts = (
        F.when(F.col("edges").isNull(), origin)
        .when(F.element_at("edges", 1) == 0, F.col("edges"))
        .otherwise(F.concat(origin, F.col("edges")))
    )
    end = lambda i: F.coalesce(F.try_element_at("__starts", i + 2), size)
    # everything a piece needs is put into its element, so no long column rides along the explode
    piece = lambda p, i: F.struct(
        p.alias("start"), end(i).alias("end"), slice_strides("__text", p, end(i)).alias("text"))
    segments = (
        notes.select("note_id", "text").join(per_note, "note_id", "left")
        .withColumn("__starts", let(size, lambda n: F.filter(starts, lambda p: (p < n) | (p == 0))))
        .withColumn("__text", strides("text"))
        .select("note_id", F.posexplode(F.transform("__starts", piece)).alias("seg_no", "__s"))
        .select("note_id", "seg_no", "__s.*")
    )
    none = F.array().cast("array<string>")
    return segments.join(facts, ["note_id", "start"], "left").select(
        "note_id", "seg_no", "start", "end", "text",
        F.when(F.col("n").isNull(), "plain").otherwise("highlight").alias("kind"),
        F.coalesce("questions", none).alias("questions"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_annotations"),
        F.coalesce("annotation_ids", none).alias("annotation_ids"),
        F.coalesce("is_suggested", F.lit(False)).alias("is_suggested"))


def badges_in_segments(badges: DataFrame, segments: DataFrame) -> DataFrame:
    """Badges (note, pos, section) with the segment they fall in."""
    left = badges.withColumn("__bin", bin_of(F.col("pos")))
    right = _binned(segments.select("note_id", "seg_no", "start", "end"))
    return left.join(right, ["note_id", "__bin"]).where(
        (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    ).drop("__bin")


def annotations_in_sections(annotations: DataFrame, badges: DataFrame) -> DataFrame:
    """The section an annotation starts in: the last badge at or before its start, else NONE.

    An as-of lookup over distinct starts: starts and badges are sorted together and the last
    badge is carried forward. Both are bounded by the note's text, however many annotations
    share a start.
    """
    starts = annotations.select("note_id", F.col("start").alias("pos")).distinct().select(
        "note_id", "pos", F.lit(None).cast("string").alias("section"), F.lit(1).alias("side"))
    marks = badges.select("note_id", "pos", "section", F.lit(0).alias("side"))
    order = Window.partitionBy("note_id").orderBy("pos", "side")
    placed = (
        starts.unionByName(marks)
        .withColumn("section", F.last("section", ignorenulls=True).over(order))
        .where(F.col("side") == 1)
        .select("note_id", F.col("pos").alias("start"), "section")
    )
    return annotations.join(placed, ["note_id", "start"], "left").withColumn(
        "section", F.coalesce("section", F.lit("NONE")))


# --- token spans ---------------------------------------------------------------------------

def chain_merge_spans(
    tokens: DataFrame, gap_tolerance: int = 6, collapse_all: bool = True, label: str = "RADIOLOGY"
) -> DataFrame:
    """Runs of positive tokens with at most ``gap_tolerance`` other tokens between neighbours.

    ``tokens`` hold note_id, idx, start, end, label_no, label and optionally prob. With
    ``collapse_all`` every positive label counts as one type; otherwise a change of type ends
    the run. ``confidence`` is 1 for every run; ``mean_prob`` carries the information.
    """
    kind = F.lit(label) if collapse_all else F.col("label")
    positive = tokens.where(F.col("label_no") != 0).withColumn("type", kind)
    if "prob" not in tokens.columns:
        positive = positive.withColumn("prob", F.lit(1.0))
    order = Window.partitionBy("note_id").orderBy("idx")
    prev_idx = F.lag("idx").over(order)
    fresh = (
        prev_idx.isNull()
        | (F.col("idx") - prev_idx > gap_tolerance + 1)
        | ~F.lag("type").over(order).eqNullSafe(F.col("type"))
    )
    # a run has one type; as a key it leaves only numbers to aggregate, which takes no sort
    return (
        positive.withColumn("__new", fresh.cast("int"))
        .withColumn("__run", F.sum("__new").over(order))
        .groupBy("note_id", "__run", "type")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.lit(1.0).alias("confidence"),
            F.avg("prob").alias("mean_prob"),
        )
        .drop("__run")
    )


def merge_adjacent_spans(spans: DataFrame, max_char_gap: int = 50) -> DataFrame:
    """Neighbouring spans of one type at most ``max_char_gap`` characters apart become one.

    Spans with the same start and type are folded first, which bounds a note's group by its
    text. A nested span does not shrink the merged one.
    """
    folded = spans.groupBy("note_id", "type", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("note_id").orderBy("start", "type")
    typed = folded.withColumn(
        "__turn", F.coalesce((F.lag("type").over(order) != F.col("type")).cast("int"), F.lit(1)))
    typed = typed.withColumn("__block", F.sum("__turn").over(order)).drop("__turn")
    numbered = islands(typed, ["note_id", "__block"], "start", "end", gap=max_char_gap)
    return numbered.groupBy("note_id", "__block", "island", "type").agg(
        F.min("start").alias("start"), F.max("end").alias("end")).drop("__block", "island")


def _run_before(text: str, at: str, run: str) -> Column:
    """Length of the run of characters that ends at ``at``; ``run`` is matched on the reversed text.

    The characters next to ``at`` settle nearly every span; the whole text is read only when the run fills them.
    """
    end = F.least(F.col(at), F.length(text))
    size = lambda t: F.length(F.regexp_extract(F.reverse(t), run, 0))
    near = size(F.substring(F.col(text), F.greatest(end - _NEAR, F.lit(0)) + 1, F.least(end, F.lit(_NEAR))))
    return let(near, lambda n: F.when(n < _NEAR, n).otherwise(size(F.substring(F.col(text), F.lit(1), end))))


def _run_after(text: str, at: str, run: str) -> Column:
    """Length of the run of characters that begins at ``at``."""
    size = lambda t: F.length(F.regexp_extract(t, run, 0))
    near = size(F.substring(F.col(text), F.col(at) + 1, F.lit(_NEAR)))
    return let(near, lambda n: F.when(n < _NEAR, n).otherwise(size(F.substring(F.col(text), F.col(at) + 1, F.length(text)))))


def _to_word(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumns({
        "__s": F.col(start) - _run_before("note_text", start, _WORD_TAIL),
        "__e": F.col(end) + _run_after("note_text", end, _WORD_TAIL)})


def expand_to_word(spans: DataFrame, notes: DataFrame) -> DataFrame:
    """Grow spans to the white space around them."""
    text = notes.select("note_id", F.col("text").alias("note_text"))
    return _recut(_to_word(spans.join(text, "note_id"), "start", "end"))


def expand_to_sentence(spans: DataFrame, notes: DataFrame) -> DataFrame:
    """Grow spans to line or sentence bounds (the closing mark included), then to words."""
    text = notes.select("note_id", F.col("text").alias("note_text"))
    opened = (
        spans.join(text, "note_id")
        .withColumn("__open", F.col("start") - _run_before("note_text", "start", r"\A[^\n.!?]*"))
        .withColumn("__b", F.col("end") + _run_after("note_text", "end", r"(?s)\A[^\n.!?]*[\n.!?]?"))
    )
    indent = F.least(_run_after("note_text", "__open", r"(?U)\A\s*"), F.col("start") - F.col("__open"))
    opened = opened.withColumn("__a", F.col("__open") + indent)
    return _recut(_to_word(opened, "__a", "__b").drop("__open", "__a", "__b"))


def _recut(df: DataFrame) -> DataFrame:
    from chartspan.functions.text import strip

    return df.withColumns({
        "start": F.col("__s"), "end": F.col("__e"),
        "text": strip(slice_text("note_text", F.col("__s"), F.col("__e"))),
    }).drop("__s", "__e", "note_text")


def extract_radiology_entities(
    notes: DataFrame, labelled_tokens: DataFrame, collapse_all: bool = True
) -> DataFrame:
    """Radiology notes' labelled tokens as entities: chain, merge, grow to sentences, merge.

    Chained spans begin and end with tokens, and sentence growth ends on words, so words never
    have to be completed in between: the note text is met twice, to grow and to cut. The radiology
    notes are told apart once and written.
    """
    from chartspan.operators.filters import filter_radiology_notes

    radiology = written(filter_radiology_notes(notes).select("note_id", "text"), "radiology")
    tokens = labelled_tokens.join(radiology.select("note_id"), "note_id", "left_semi")
    merged = merge_adjacent_spans(
        chain_merge_spans(tokens, collapse_all=collapse_all), 120 if collapse_all else 30)
    if collapse_all:
        merged = merge_adjacent_spans(expand_to_sentence(merged, radiology), 0)
    return expand_to_word(merged, radiology)
