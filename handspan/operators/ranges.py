"""Sequence operators for sequences larger than a task: ranges of (keys, place), with what crosses their borders carried on.

A window over a key keeps the whole sequence in one task. Here rows are dealt to ranges of their order, however long a
sequence is, and two things make a range's results those of the whole sequence:

- windows of bounded reach get the last rows before the range and the first ones after it (`Ranges.windowed`), so every
  operator of `operators.sequence` whose window has bounds works unchanged, with the range as a part of its key;
- what runs on without bounds (sums, the last value given, places) is scanned in two passes: each range is summed up in
  one row per border, these few rows are scanned, and each range begins with what the ranges before it leave for the
  sequence that it begins with (`Ranges.running`).

Rows go to their range by its number, so no hash puts several large ranges into one task. What is carried has a row or
two for each range, however many rows or sequences there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from handspan.functions.fingering import default_hand
from handspan.functions.keys import CHORD_MS
from handspan.operators.sequence import KEY
from handspan.plans.lineage import cut_lineage

PART = "_part"


class Ranges:
    """Rows of sequences in ranges of (keys, order); `order` may be several columns, which must tell the rows of a sequence apart."""

    def __init__(self, rows: DataFrame, keys=KEY, order=("note_idx",), parts: int | None = None, _dealt: bool = False):
        self.keys, self.order = tuple(keys), tuple(order)
        self.parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.kept = not _dealt
        if not _dealt:
            rows = cut_lineage(rows.repartitionByRange(self.parts, *self.keys, *self.order).withColumn(PART, F.spark_partition_id()))
        self.rows = rows

    def _with(self, rows: DataFrame) -> Ranges:
        return Ranges(rows, self.keys, self.order, self.parts, _dealt=True)

    def _in_place(self) -> DataFrame:
        """The rows, each range in one task; windows by range and keys need no other exchange."""
        return self.rows.repartitionById(self.parts, F.col(PART))

    def result(self) -> DataFrame:
        return self.rows.drop(PART)

    def map(self, function: Callable[[DataFrame], DataFrame]) -> Ranges:
        """Columns that need no other row."""
        return self._with(function(self.rows))

    def _ghosts(self, count: int, ahead: bool) -> DataFrame:
        """The last `count` rows before each range, or the first ones after it, with the number of the range that wants them."""
        if not count:
            return self.rows.limit(0).withColumn("_scan_own", F.lit(False))
        place = [F.col(c).asc() if ahead else F.col(c).desc() for c in (*self.keys, *self.order)]
        near = self.rows.withColumn("_r", F.row_number().over(Window.partitionBy(PART).orderBy(*place))).where(F.col("_r") <= count)  # cut in each task before it is exchanged
        own = [c for c in self.rows.columns if c != PART]
        ends = near.groupBy(PART).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.struct(*own).alias("x")))), lambda s: s["x"]).alias("_near"))
        # each range that has rows has one at least, so `count` ranges are enough
        w = Window.orderBy(F.col(PART).desc() if not ahead else F.col(PART))  # a row for each range
        w = w.rowsBetween(1, count)
        got = ends.select(PART, F.slice(F.flatten(F.collect_list("_near").over(w)), 1, count).alias("_got"))
        return got.select(PART, F.explode("_got").alias("x")).select(PART, "x.*").select(*self.rows.columns).withColumn("_scan_own", F.lit(False))

    def windowed(self, function: Callable[..., DataFrame], before: int = 1, after: int = 1, **options) -> Ranges:
        """function(rows, keys=...), an operator that looks at most `before` rows back and `after` rows on in a sequence."""
        every = self._in_place().withColumn("_scan_own", F.lit(True))
        for count, ahead in ((before, False), (after, True)):
            if count:
                every = every.unionByName(self._ghosts(count, ahead))
        every = every.repartitionById(self.parts, F.col(PART))
        return self._with(function(every, keys=(PART, *self.keys), **options).where("_scan_own").drop("_scan_own"))

    def running(self, values: dict[str, Column], how: str = "sum", *, upto: bool = True, back: bool = False, peers: bool = False) -> Ranges:
        """Adds, for each name, the sum, the largest or the last value that isn't null (how = sum, max, last) of a sequence's rows up to each row.

        Without upto the row itself doesn't count. back: from the end of the sequence on, so `last` is the next value given.
        peers: rows of one place count all (the order must be one column). Values are Columns of the row itself; rows of
        one place are always in one range.
        """
        total = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
        way = [F.col(c).desc() if back else F.col(c).asc() for c in self.order]
        key, at = F.struct(*[F.col(k) for k in self.keys]), F.struct(*[F.col(c) for c in (*self.keys, *self.order)])
        first, last = (F.max_by, F.min_by) if back else (F.min_by, F.max_by)
        names = {f"_scan_{i}": name for i, name in enumerate(values)}
        # read twice, so it is made once
        rows = (self.rows if self.kept else cut_lineage(self.rows)).withColumns({f"_scan_{i}": c for i, c in enumerate(values.values())})
        # of each range: the sequence it begins with, the one it ends with, and what the latter's rows leave
        borders = rows.groupBy(PART).agg(first(key, at).alias("_scan_begins"), last(key, at).alias("_scan_ends"))
        tail = rows.join(F.broadcast(borders), PART).where(key == F.col("_scan_ends"))  # a row for each range is broadcast
        left = {v: total(F.col(v)) if how != "last" else last(F.col(v), F.when(F.col(v).isNotNull(), at)) for v in names}
        marks = borders.join(tail.groupBy(PART).agg(*[c.alias(v) for v, c in left.items()]), PART)
        begin = F.struct(F.lit(0).alias("_scan_kind"), F.col("_scan_begins").alias("_scan_key"), *[F.when(F.lit(False), F.col(v)).alias(v) for v in names])
        end = F.struct(F.lit(1).alias("_scan_kind"), F.col("_scan_ends").alias("_scan_key"), *[F.col(v) for v in names])
        marks = marks.select(PART, F.inline(F.array(begin, end)))
        step = Window.partitionBy("_scan_key").orderBy(F.col(PART).desc() if back else F.col(PART), "_scan_kind").rowsBetween(Window.unboundedPreceding, -1)
        carried = marks.select(PART, "_scan_kind", F.col("_scan_key").alias("_scan_begins"), *[total(F.col(v)).over(step).alias(f"{v}_before") for v in names]).where("_scan_kind = 0").drop("_scan_kind")
        local = Window.partitionBy(PART, *self.keys).orderBy(*way)
        local = local.rangeBetween(Window.unboundedPreceding, 0) if peers else local.rowsBetween(Window.unboundedPreceding, 0 if upto else -1)
        own = self._with(rows)._in_place().withColumns({f"{v}_own": total(F.col(v)).over(local) for v in names})
        own = own.join(F.broadcast(carried), PART)
        goes_on = key == F.col("_scan_begins")

        def both(v: str) -> Column:
            here, before = F.col(f"{v}_own"), F.when(goes_on, F.col(f"{v}_before"))
            return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)) if how == "sum" else F.greatest(here, before) if how == "max" else F.coalesce(here, before)

        new = {name: both(v) for v, name in names.items()}
        return self._with(own.select(*[c for c in self.rows.columns if c not in new], *[c.alias(n) for n, c in new.items()]))


def with_prior(notes: DataFrame, *, keys=KEY, parts: int | None = None) -> DataFrame:
    """Adds prior_midi, delta and direction, as `sequence.with_prior`."""
    from handspan.operators.sequence import with_prior as prior

    return Ranges(notes, keys, parts=parts).windowed(prior, 1, 0).result()


def with_segments(notes: DataFrame, *, level: str = ",", mark: str = "seg_mark", keys=KEY, parts: int | None = None) -> DataFrame:
    """Adds segment_idx, as `sequence.with_segments`."""
    marks = ",;."[",;.".index(level) :]
    ends = F.coalesce(F.col(mark).isin(*marks), F.lit(False)).cast("int")
    return Ranges(notes, keys, parts=parts).running({"segment_idx": ends}, upto=False).map(lambda d: d.withColumn("segment_idx", F.col("segment_idx").cast("int"))).result()


def with_handed_digits(fingerings: DataFrame, *, keys=KEY, parts: int | None = None) -> DataFrame:
    """Adds hand and hsd, as `fingering.with_handed_digits`: the last hand mark is carried on."""
    own = F.col("strike_hand")
    after = F.coalesce(F.col("release_hand"), own)
    r = Ranges(fingerings, keys, parts=parts).running({"_before": after}, "last", upto=False)
    d = r.result().withColumn("hand", F.coalesce(own, F.col("_before"), default_hand(F.col("staff")))).drop("_before")
    return d.withColumn("hsd", F.when(F.col("strike_digit").isNull(), F.lit("x")).otherwise(F.concat("hand", F.col("strike_digit").cast("string"))))


def repeat_runs(notes: DataFrame, *, keys=KEY, parts: int | None = None) -> DataFrame:
    """Adds repeats_before and repeats_after, as `sequence.repeat_runs`: the places where a run begins are carried both ways."""

    def begins(rows, keys):
        w = Window.partitionBy(*keys).orderBy("note_idx")
        return rows.withColumn("_begins", F.coalesce(F.lag("midi").over(w) != F.col("midi"), F.lit(True)))

    r = Ranges(notes, keys, parts=parts).windowed(begins, 1, 0).running({"_at": F.lit(1)})
    start = F.when(F.col("_begins"), F.col("_at"))
    r = r.running({"_run": start}, "last").running({"_next": start}, "last", upto=False, back=True)
    r = r.running({"_left": F.lit(1)}, upto=False, back=True)
    after = F.coalesce(F.col("_next") - F.col("_at") - 1, F.col("_left"))
    return r.result().withColumns({"repeats_before": (F.col("_at") - F.col("_run")).cast("int"), "repeats_after": after.cast("int")}).drop("_begins", "_at", "_run", "_next", "_left")


def tempo_at(notes: DataFrame, marks: DataFrame, *, offset: str = "offset", keys=KEY, parts: int | None = None) -> DataFrame:
    """Adds bpm and onset_s, as `sequence.tempo_at`: marks and notes in order of offset, marks first, carry the pace on."""
    kind = notes.schema["note_idx"].dataType
    both = notes.select(*keys, F.col(offset).alias("_o"), F.lit(1).alias("_kind"), "note_idx", F.lit(None).cast("double").alias("_bpm"), F.struct(*[c for c in notes.columns if c not in keys]).alias("_note"))
    paces = marks.select(*keys, F.col("start").alias("_o"), F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("note_idx"), F.col("bpm").cast("double").alias("_bpm"), F.lit(None).cast(both.schema["_note"].dataType).alias("_note"))
    r = Ranges(both.unionByName(paces), keys, ("_o", "_kind", "note_idx"), parts).running({"bpm": F.col("_bpm")}, "last")
    paced = r.result().where("_kind = 1")
    return paced.select(*[c if c in keys else F.col("_note")[c].alias(c) for c in notes.columns], "bpm").withColumn("onset_s", F.col(offset) * 60 / F.col("bpm"))


def with_pedals(fingerings: DataFrame, *, keys=KEY, parts: int | None = None) -> DataFrame:
    """Adds soft_state and damper_state, as `fingering.with_pedals`: the last sign of each pedal is carried on."""
    sign = {f"{c}_state": F.substring(c, -1, 1) for c in ("soft", "damper")}
    d = Ranges(fingerings, keys, parts=parts).running(sign, "last").result()
    return d.withColumns({"soft_state": F.coalesce("soft_state", F.lit("f")), "damper_state": F.coalesce("damper_state", F.lit("^"))})


#: Pitches of the MIDI range.
PITCHES = range(128)


def sounding_at_onset(notes: DataFrame, *, threshold_ms: int = CHORD_MS, onset: str = "onset_ms", dur: str = "dur_ms", keys=KEY, parts: int | None = None) -> DataFrame:
    """Adds sounding_lower and sounding_upper, as `sequence.sounding_at_onset`, by a sweep in order of onsets.

    A pitch sounds at an onset if the latest end among its notes so far lies beyond it. So the sweep carries 128 ends, and
    hands them to the next range, instead of a copy of each note for all the time that it sounds; no note meets another.
    Pitches outside 0..127 aren't counted and have null counts.
    """
    end = F.greatest(F.col(onset) + F.col(dur) - threshold_ms, F.col(onset) + 1)
    ends = {f"_end{p}": F.when(F.col("midi") == p, end) for p in PITCHES}
    swept = Ranges(notes, keys, (onset,), parts).running(ends, "max", peers=True).result()
    every = F.array(*[F.when(F.col(f"_end{p}") > F.col(onset), F.lit(p)) for p in PITCHES])
    count = lambda test: F.when(F.col("midi").between(PITCHES[0], PITCHES[-1]), F.size(F.filter("_sounding", test)))
    out = swept.withColumn("_sounding", F.array_compact(every))
    out = out.withColumns({"sounding_lower": count(lambda p: p < F.col("midi")), "sounding_upper": count(lambda p: p > F.col("midi"))})
    return out.drop("_sounding", *ends)
