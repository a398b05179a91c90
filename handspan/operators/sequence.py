"""Window operators over note sequences. All use one window, by key and note_idx, so one exchange and one sort serve them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from handspan.functions.keys import CHORD_MS, direction, distance_imaginary, distance_lattice_x, distance_lattice_y, is_black, is_cramped

KEY = ("score_id",)


def by_note(keys=KEY):
    return Window.partitionBy(*keys).orderBy("note_idx")


def with_neighbours(notes: DataFrame, *, column: str = "midi", before: int = 1, after: int = 1, keys=KEY) -> DataFrame:
    """Adds column_m1.. and column_p1..: the values of the notes before and after; null past the ends."""
    w = by_note(keys)
    new = {f"{column}_m{k}": F.lag(column, k).over(w) for k in range(1, before + 1)}
    new |= {f"{column}_p{k}": F.lead(column, k).over(w) for k in range(1, after + 1)}
    return notes.withColumns(new)


def with_prior(notes: DataFrame, *, keys=KEY) -> DataFrame:
    """Adds prior_midi, and the deltas and direction from it."""
    prior = F.lag("midi").over(by_note(keys))
    return notes.withColumns({"prior_midi": prior, "delta": F.col("midi") - prior, "direction": direction("midi", prior)})


def ngram_labels(labels: DataFrame, n: int, *, label: str = "hsd", keys=KEY) -> DataFrame:
    """(keys, ngram_idx, ngram): each label with the n - 1 before it, 'x' where there is none or it is null, and n - 1 trailing items."""
    w = by_note(keys)
    at = lambda j: F.coalesce(F.lag(label, j).over(w) if j else F.col(label), F.lit("x"))
    # a trailing item k has the last label k places from its end; so the items come from one window, by one sort
    items = [F.concat(*[at(j - k) if j >= k else F.lit("x") for j in range(n - 1, -1, -1)]) for k in range(n)]
    rows = labels.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("_i"), F.when(F.lead(F.lit(1)).over(w).isNull(), F.array(*items)).otherwise(F.array(items[0])).alias("_items"))
    return rows.select(*keys, "_i", F.posexplode("_items").alias("_k", "ngram")).select(*keys, (F.col("_i") + F.col("_k")).alias("ngram_idx"), "ngram")


def bigram_labels(notes: DataFrame, *, hand: str = "hand", digit: str = "digit", keys=KEY) -> DataFrame:
    """Adds bigram: previous finger, direction mark and finger; '^^' stands before the first."""
    w = by_note(keys)
    prior = F.coalesce(F.concat(F.lag(hand).over(w), F.lag(digit).over(w).cast("string")), F.lit("^^"))
    mark = F.when(F.lag("midi").over(w) < F.col("midi"), "/").when(F.lag("midi").over(w) > F.col("midi"), "\\").otherwise("-")
    return notes.withColumn("bigram", F.concat(prior, mark, F.col(hand), F.col(digit).cast("string")))


def with_pivot(notes: DataFrame, *, hand: str = "hand", digit: str = "digit", name: str = "is_pivot", keys=KEY) -> DataFrame:
    """Adds whether a note pivots: to the thumb when the hand doesn't fall back, or from it when it doesn't go on."""
    w = by_note(keys)
    d0, h0, step = F.lag(digit).over(w), F.lag(hand).over(w), F.col("midi") - F.lag("midi").over(w)
    outward = F.when(F.col(hand) == ">", step).otherwise(-step)
    to_thumb = (F.col(digit) == 1) & (d0 != 1) & (outward >= 0)
    from_thumb = (d0 == 1) & (F.col(digit) != 1) & (outward <= 0)
    return notes.withColumn(name, F.coalesce((h0 == F.col(hand)) & (to_thumb | from_thumb), F.lit(False)))


def with_simple_pivot(notes: DataFrame, *, hand: str = "hand", digit: str = "digit", name: str = "pivots_next", keys=KEY) -> DataFrame:
    """Adds whether the step to the next note pivots by the evaluator's right-hand rule: to the thumb upwards, from it downwards."""
    w = by_note(keys)
    d1, h1, step = F.lead(digit).over(w), F.lead(hand).over(w), F.lead("midi").over(w) - F.col("midi")
    pivot = F.when(step > 0, d1 == 1).when(step < 0, F.col(digit) == 1).otherwise(False) & (d1 != F.col(digit))
    return notes.withColumn(name, F.coalesce((h1 == F.col(hand)) & pivot, F.lit(False)))


def with_segments(notes: DataFrame, *, level: str = ",", mark: str = "seg_mark", keys=KEY) -> DataFrame:
    """Adds segment_idx: marks at or above the level (, ; . from least to most) end a segment."""
    marks = ",;."[",;.".index(level) :]
    ends = F.when(F.coalesce(F.col(mark).isin(*marks), F.lit(False)), 1).otherwise(0)
    return notes.withColumn("segment_idx", F.coalesce(F.sum(ends).over(by_note(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))


def one_segment(notes: DataFrame) -> DataFrame:
    """The degenerate segmenter: every sequence is one segment."""
    return notes.withColumn("segment_idx", F.lit(0))


def rebase_onsets(notes: DataFrame, *, onset: str = "onset_ms", keys=KEY) -> DataFrame:
    """Adds rebased_onset: onset minus that of the last note of the segment before (0 for the first)."""
    w = by_note(keys)
    first = F.lag("segment_idx").over(w).isNull() | (F.lag("segment_idx").over(w) != F.col("segment_idx"))
    base = notes.withColumn("_base", F.when(first, F.coalesce(F.lag(onset).over(w), F.lit(0))))
    base = base.withColumn("_base", F.last("_base", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return base.withColumn("rebased_onset", F.col(onset) - F.col("_base")).drop("_base")


def pitch_window(notes: DataFrame, *, reach: int = 4, keys=KEY) -> DataFrame:
    """Adds pitches: the MIDI numbers around each note as strings, '-1' past the ends."""
    w = by_note(keys)
    at = [F.lag("midi", k).over(w) for k in range(reach, 0, -1)] + [F.col("midi")] + [F.lead("midi", k).over(w) for k in range(1, reach + 1)]
    return notes.withColumn("pitches", F.array(*[F.coalesce(c.cast("string"), F.lit("-1")) for c in at]))


def _chord(k: int, w, onset: str, ms: int) -> Column:
    other = F.lag(onset, -k).over(w) if k < 0 else F.lead(onset, k).over(w)
    return F.coalesce(other > F.col(onset) - ms if k < 0 else other < F.col(onset) + ms, F.lit(False))


def _at(column: str, k: int, w) -> Column:
    return F.lag(column, -k).over(w) if k < 0 else F.lead(column, k).over(w)


def chord_counts(notes: DataFrame, *, onset: str = "onset_ms", ms: int = CHORD_MS, keys=KEY) -> DataFrame:
    """Adds chord_left, chord_right, chord_lower, chord_upper: of four notes on each side, those within ms."""
    w = by_note(keys)
    near = {k: _chord(k, w, onset, ms) for k in (-4, -3, -2, -1, 1, 2, 3, 4)}
    total = lambda it: sum((c.cast("int") for c in it), F.lit(0))
    return notes.withColumns(
        {
            "chord_left": total(c for k, c in near.items() if k < 0),
            "chord_right": total(c for k, c in near.items() if k > 0),
            "chord_lower": total(c & (_at("midi", k, w) < F.col("midi")) for k, c in near.items()),
            "chord_upper": total(c & (_at("midi", k, w) > F.col("midi")) for k, c in near.items()),
        }
    )


def chord_category(staff: Column, lower: Column, upper: Column) -> Column:
    return F.concat(staff, lower.cast("string"), upper.cast("string"))


def chord_border(lower: Column, upper: Column) -> Column:
    """left: nothing below and something above; right: the mirror image; else none."""
    return F.when((lower == 0) & (upper > 0), "left").when((upper == 0) & (lower > 0), "right").otherwise("none")


def tempo_features(notes: DataFrame, *, onset: str = "onset_ms", per_second: int = 1000, keys=KEY) -> DataFrame:
    """Adds left_nps, right_nps, window_nps: notes per second over four notes before, after and both; 0 where no time passes."""
    w = by_note(keys)
    left, right = w.rowsBetween(-4, 0), w.rowsBetween(0, 4)
    lt = F.col(onset) - F.first(onset).over(left)
    rt = F.last(onset).over(right) - F.col(onset)
    ln, rn = F.count("*").over(left), F.count("*").over(right)
    rate = lambda n, t: F.when(t == 0, 0.0).otherwise(n * float(per_second) / t)
    return notes.withColumns({"left_nps": rate(ln, lt), "right_nps": rate(rn, rt), "window_nps": rate(ln + rn - 1, lt + rt)})


def articulation_features(notes: DataFrame, *, onset: str = "onset_ms", dur: str = "dur_ms", ms: int = CHORD_MS, keys=KEY) -> DataFrame:
    """Adds separated_count, staccato_count, normalized_silence of the nine-note window of notes that are in no chord, else 0.

    A gap belongs to the note after it, so the window's gaps are those of the notes -3 to 4.
    """
    w = by_note(keys)
    wide, inner = w.rowsBetween(-4, 4), w.rowsBetween(-3, 4)
    n = chord_counts(notes, onset=onset, ms=ms, keys=keys)
    gap = F.col(onset) - (F.lag(onset).over(w) + F.lag(dur).over(w))
    n = n.withColumns({"_gap": gap, "_left": F.lag(dur).over(w)})
    alone = (F.col("chord_left") == 0) & (F.col("chord_right") == 0)
    span = F.last(onset).over(wide) - F.first(onset).over(wide)
    silence = F.coalesce(F.sum(F.greatest("_gap", F.lit(0))).over(inner), F.lit(0))
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(inner), F.lit(0))
    # the first note of the window has a gap before it, but a window that starts with the sequence has none
    new = {
        "separated_count": F.when(alone, count(F.col("_gap") > 2 * ms)).otherwise(0),
        "staccato_count": F.when(alone, count(F.col("_gap") >= F.col("_left") / 2)).otherwise(0),
        "normalized_silence": F.when(alone & (span > 0), silence / span).otherwise(0.0),
    }
    return n.withColumns(new).drop("_gap", "_left", "chord_left", "chord_right", "chord_lower", "chord_upper")


def repeat_runs(notes: DataFrame, *, keys=KEY) -> DataFrame:
    """Adds repeats_before and repeats_after: equal pitches next to each note."""
    w = by_note(keys)
    new = F.coalesce((F.lag("midi").over(w) != F.col("midi")).cast("int"), F.lit(1))
    n = notes.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run").orderBy("note_idx")
    whole = Window.partitionBy(*keys, "_run")
    before = F.row_number().over(run) - 1
    return n.withColumns({"repeats_before": before, "repeats_after": (F.count("*").over(whole) - before - 1).cast("int")}).drop("_run")


def phrase_ends(notes: DataFrame, *, keys=KEY) -> DataFrame:
    """Adds bop and eop: first and last note of the sequence."""
    w = by_note(keys)
    return notes.withColumns({"bop": F.lag("note_idx").over(w).isNull(), "eop": F.lead("note_idx").over(w).isNull()})


def finger_contour(notes: DataFrame, *, hand: str = "hand", digit: str = "digit", keys=KEY) -> DataFrame:
    """(keys, contour): fingers with the direction mark between each two."""
    n = with_prior(notes, keys=keys)
    mark = F.when(F.col("direction") > 0, "/").when(F.col("direction") < 0, "\\").when(F.col("direction") == 0, "-").otherwise("")
    n = n.withColumn("_c", F.concat(mark, F.col(hand), F.col(digit).cast("string")))
    return n.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "_c"))), lambda s: s["_c"]), "").alias("contour"))


def complex_chording(notes: DataFrame, *, hand: str = "hand", digit: str = "digit", onset: str = "onset_ms", ms: int = CHORD_MS, keys=KEY) -> DataFrame:
    """Adds complex_chording: in the chord around a note, fingers out of order against the first finger of their hand."""
    w = by_note(keys)
    n = chord_counts(notes, onset=onset, ms=ms, keys=keys)
    around = F.collect_list(F.struct(F.col("note_idx").alias("i"), F.col(hand).alias("h"), F.col(digit).alias("d"))).over(w.rowsBetween(-4, 4))
    chord = F.filter(around, lambda s: (s["i"] >= F.col("note_idx") - F.col("chord_left")) & (s["i"] <= F.col("note_idx") + F.col("chord_right")))

    def wrong(h: str):
        own = F.filter("_chord", lambda s: s["h"] == h)
        first = F.element_at(own, 1)["d"]
        rest = F.slice(own, 2, 8)
        bad = F.filter(rest, lambda s: s["d"] <= first if h == ">" else s["d"] >= first)
        return F.when(F.size(own) > 1, F.size(bad)).otherwise(0)

    n = n.withColumn("_chord", chord)
    return n.withColumn("complex_chording", wrong(">") + wrong("<")).drop("_chord", "chord_left", "chord_right", "chord_lower", "chord_upper")


def contour_flags(notes: DataFrame, *, max_leap: int = 15, keys=KEY) -> DataFrame:
    """Adds returning, will_return, ascending (a valley) and descending (a peak), by distances on the lattice."""
    w = by_note(keys)
    x = {k: distance_lattice_x(_at("midi", k, w), F.col("midi"), max_leap) if k < 0 else distance_lattice_x(F.col("midi"), _at("midi", k, w), max_leap) for k in (-2, -1, 1, 2)}
    return notes.withColumns({"returning": x[-2] == 0, "will_return": x[2] == 0, "ascending": (x[-1] < 0) & (x[1] > 0), "descending": (x[-1] > 0) & (x[1] < 0)})


def lattice_ngrams(notes: DataFrame, *, max_leap: int = 15, keys=KEY) -> DataFrame:
    """Adds x_m4..x_p4 and y_m4..y_p4: lattice distances to four notes on each side."""
    w = by_note(keys)
    new = {}
    for k in (-4, -3, -2, -1, 1, 2, 3, 4):
        pair = (_at("midi", k, w), F.col("midi")) if k < 0 else (F.col("midi"), _at("midi", k, w))
        side = f"{'m' if k < 0 else 'p'}{abs(k)}"
        new[f"x_{side}"] = distance_lattice_x(*pair, max_leap)
        new[f"y_{side}"] = distance_lattice_y(*pair)
    return notes.withColumns(new)


def leaps(notes: DataFrame, *, max_leap: int = 15, keys=KEY) -> DataFrame:
    """Adds leap: the step from the note before is larger than max_leap."""
    return notes.withColumn("leap", F.coalesce(F.abs(F.col("midi") - F.lag("midi").over(by_note(keys))) > max_leap, F.lit(False)))


def sounding_at_onset(notes: DataFrame, *, threshold_ms: int = CHORD_MS, slice_ms: int = 4000, onset: str = "onset_ms", dur: str = "dur_ms", keys=KEY) -> DataFrame:
    """Adds sounding_lower and sounding_upper: different pitches that sound, or are struck, at each note's onset.

    An interval join by time slices: a note is put into every slice that it sounds in, and an onset looks into its own.
    """
    n = notes.withColumn("_end", F.greatest(F.col(onset) + F.col(dur) - threshold_ms, F.col(onset) + 1))
    of = lambda c: F.floor(c / slice_ms)
    held = n.select(*keys, F.explode(F.sequence(of(F.col(onset)), of(F.col("_end") - 1))).alias("_slice"), F.col("midi").alias("_m"), F.col(onset).alias("_on"), "_end").distinct()
    at = n.select(*keys, "note_idx", "midi", F.col(onset).alias("_t"), of(F.col(onset)).alias("_slice"))
    found = at.join(held, [*keys, "_slice"]).where((F.col("_on") <= F.col("_t")) & (F.col("_t") < F.col("_end")))
    counts = found.groupBy(*keys, "note_idx").agg(F.countDistinct(F.when(F.col("_m") < F.col("midi"), F.col("_m"))).alias("sounding_lower"), F.countDistinct(F.when(F.col("_m") > F.col("midi"), F.col("_m"))).alias("sounding_upper"))
    return notes.join(counts, [*keys, "note_idx"], "left")


def tempo_at(notes: DataFrame, marks: DataFrame, *, offset: str = "offset", keys=KEY) -> DataFrame:
    """Adds bpm and onset_s from the tempo mark in force: the last at or before the note's offset, whose pace holds for the whole offset.

    An as-of join in one window: marks and notes of a sequence in order of offset, marks first, carry the pace on.
    """
    both = notes.select(*keys, "note_idx", F.col(offset).alias("_o"), F.lit(None).cast("double").alias("_bpm"), F.lit(1).alias("_kind")).unionAll(
        marks.select(*keys, F.lit(None).cast(notes.schema["note_idx"].dataType).alias("note_idx"), F.col("start").alias("_o"), F.col("bpm").cast("double").alias("_bpm"), F.lit(0).alias("_kind"))
    )
    w = Window.partitionBy(*keys).orderBy("_o", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    paced = both.withColumn("bpm", F.last("_bpm", ignorenulls=True).over(w)).where("_kind = 1")
    return notes.join(paced.select(*keys, "note_idx", "bpm"), [*keys, "note_idx"]).withColumn("onset_s", F.col(offset) * 60 / F.col("bpm"))


def local_predicates(notes: DataFrame, *, keys=KEY) -> DataFrame:
    """Adds is_black, is_cramped, and distances from the note before."""
    w = by_note(keys)
    return notes.withColumns({"is_black": is_black("midi"), "is_cramped": is_cramped("midi"), "imaginary": distance_imaginary(F.lag("midi").over(w), F.col("midi"))})
