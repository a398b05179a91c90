"""Joins, counts, checks, orders and set operations over tables of notes and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from handspan.operators.sequence import KEY, by_note


def finger_notes(notes: DataFrame, fingerings: DataFrame, *, keys=KEY, drop_wildcards: bool = False, drop_other_hand: bool = False, hand: str = "hand", default: str = "default_hand") -> DataFrame:
    """Notes with their fingers, of sequences in which both have the same count. Options leave out sequences with 'x' or the other hand."""
    n = notes.groupBy(*keys).agg(F.count("*").alias("_n"))
    f = fingerings.groupBy(*keys).agg(F.count("*").alias("_f"), F.max((F.col("hsd") == "x").cast("int")).alias("_x"), *([F.max((F.col(hand) != F.col(default)).cast("int")).alias("_o")] if drop_other_hand else []))
    good = n.join(f, list(keys)).where("_n = _f")
    if drop_wildcards:
        good = good.where("_x = 0")
    if drop_other_hand:
        good = good.where("_o = 0")
    return notes.join(fingerings, [*keys, "note_idx"]).join(good.select(*keys), list(keys), "left_semi")


def load_summary(notes: DataFrame, fingerings: DataFrame, *, keys=KEY, hand: str = "hand", default: str = "default_hand") -> DataFrame:
    """One row: sequences whose counts differ, with wildcards, with other-hand fingers; such fingers; notes included."""
    n = notes.groupBy(*keys).agg(F.count("*").alias("n"))
    other = (F.col(hand) != F.col(default)).cast("int")
    f = fingerings.groupBy(*keys).agg(F.count("*").alias("f"), F.sum((F.col("hsd") == "x").cast("int")).alias("x"), F.sum(other).alias("o"))
    both = n.join(f, list(keys), "full").withColumn("bad", (~F.col("n").eqNullSafe(F.col("f"))).cast("int"))
    count = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0))).cast("long")
    return both.agg(
        count(F.col("bad")).alias("bad"), count(F.col("x") > 0).alias("wildcarded"), count(F.col("o") > 0).alias("other_hand"), F.coalesce(F.sum("o"), F.lit(0)).cast("long").alias("other_hand_fingers"),
        F.coalesce(F.sum(F.when((F.col("bad") == 0) & (F.col("x") == 0), F.col("n"))), F.lit(0)).cast("long").alias("notes"),
    )


def counts(notes: DataFrame, *levels: str) -> DataFrame:
    """Notes and pitch range for every prefix of the levels, null standing for 'all'."""
    return notes.rollup(*levels).agg(F.count("*").alias("notes"), F.min("midi").alias("low"), F.max("midi").alias("high"))


def check_consistent(fingerings: DataFrame, notes: DataFrame, *, keys=KEY, annot: str = "annot_id") -> DataFrame:
    """(keys, counts, expected) of sequences whose annotations have different lengths or another length than the notes."""
    per = fingerings.groupBy(*keys, annot).agg(F.count("*").alias("n"))
    n = notes.groupBy(*keys).agg(F.count("*").alias("expected"))
    lengths = per.groupBy(*keys).agg(F.array_sort(F.collect_set("n")).alias("counts"))
    return lengths.join(n, list(keys), "left").where((F.size("counts") > 1) | ~F.element_at("counts", 1).eqNullSafe(F.col("expected")))


def is_fully_annotated(fingerings: DataFrame, notes: DataFrame, *, keys=KEY, digit: str = "digit") -> DataFrame:
    """(keys, fully_annotated): every note has a digit."""
    f = fingerings.groupBy(*keys).agg(F.sum(F.col(digit).isNotNull().cast("int")).alias("given"))
    n = notes.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(f, list(keys), "left").select(*keys, F.coalesce(F.col("given") == F.col("n"), F.lit(False)).alias("fully_annotated"))


def monophony(notes: DataFrame, *, onset: str = "onset_ms", dur: str = "dur_ms", keys=KEY) -> DataFrame:
    """(keys, monophonic, orderly): no note begins before all earlier ones have ended; no two begin together."""
    w = Window.partitionBy(*keys).orderBy(onset, "note_idx").rowsBetween(Window.unboundedPreceding, -1)
    n = notes.withColumn("_over", F.coalesce(F.max(F.col(onset) + F.col(dur)).over(w) > F.col(onset), F.lit(False)))
    return n.groupBy(*keys).agg((F.max(F.col("_over").cast("int")) == 0).alias("monophonic"), (F.count("*") == F.countDistinct(onset)).alias("orderly"))


def human_performance(notes: DataFrame, *, onset: str = "onset_ms", dur: str = "dur_ms", keys=KEY) -> DataFrame:
    """(keys, human): false if over half of the durations, or over a tenth of the onsets, repeat others."""
    repeated = lambda c: 1 - F.countDistinct(c) / F.count("*")
    return notes.groupBy(*keys).agg(((repeated(dur) <= 0.5) & (repeated(onset) <= 0.1)).alias("human"))


def human_performance_ms(notes: DataFrame, *, onset: str = "onset_ms", dur: str = "dur_ms", near_ms: int = 30, legato_ms: int = 5, keys=KEY) -> DataFrame:
    """(keys, human_ms): the older test, by equal onsets among near neighbours, and by gaps too small to be played as a part of the melodic (not near) steps."""
    w = by_note(keys)
    step = F.col(onset) - F.lag(onset).over(w)
    gap = F.abs(F.col(onset) - (F.lag(onset).over(w) + F.lag(dur).over(w)))
    near = F.abs(step) < near_ms
    n = notes.withColumns({"_near": near.cast("int"), "_equal": (step == 0).cast("int"), "_legato": (gap < legato_ms).cast("int"), "_melodic": (~near).cast("int")})
    share = lambda a, b: F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0))
    return n.groupBy(*keys).agg(((share("_equal", "_near") <= 0.5) & (share("_legato", "_melodic") <= 0.5)).alias("human_ms"))


def gold_votes(gold: DataFrame, *, keys=KEY, fingering: str = "fingering") -> DataFrame:
    """(keys, fingering, votes, total, distinct)."""
    v = gold.groupBy(*keys, fingering).agg(F.count("*").alias("votes"))
    t = v.groupBy(*keys).agg(F.sum("votes").alias("total"), F.count("*").alias("distinct"))
    return v.join(t, list(keys))


def gold_ending_with(gold: DataFrame, digit: int, *, fingering: str = "fingering") -> DataFrame:
    return gold.where(F.element_at(fingering, -1) == digit)


def gold_missing(gold: DataFrame, suggestions: DataFrame, *, keys=KEY, fingering: str = "fingering") -> DataFrame:
    """Distinct gold that isn't suggested."""
    return gold.select(*keys, fingering).distinct().join(suggestions.select(*keys, fingering), [*keys, fingering], "left_anti")


def model_vs_baseline(a: DataFrame, b: DataFrame, *, on, value: str = "value") -> DataFrame:
    """(on, a, b): results of two models for the same things."""
    return a.select(*on, F.col(value).alias("a")).join(b.select(*on, F.col(value).alias("b")), list(on))


def order_notes(notes: DataFrame, *, onset: str = "onset_ms", keys=KEY) -> DataFrame:
    """Notes by onset, then pitch, numbered anew; of equal pitches in a chord one stays."""
    w = Window.partitionBy(*keys).orderBy(onset, "midi")
    return notes.dropDuplicates([*keys, onset, "midi"]).withColumn("note_idx", F.row_number().over(w) - 1)


def order_gold(votes: DataFrame, *, seed: int = 1, keys=KEY, fingering: str = "fingering") -> DataFrame:
    """Adds place: by votes upwards, ties in an order fixed by the seed."""
    return votes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("votes", F.xxhash64(fingering, F.lit(seed)), fingering)))


def trim_at_last_gold(ranked: DataFrame, *, hit: str = "hit", keys=KEY) -> DataFrame:
    """Ranks up to the last one that is gold; none where there is no gold."""
    w = Window.partitionBy(*keys).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_later", F.sum(F.col(hit).cast("int")).over(w)).where("_later > 0").drop("_later")


def cutoff_at(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def by_cost(suggestions: DataFrame, cutoff: int | None = None, *, keys=KEY) -> DataFrame:
    """(keys, cost, fingerings): suggestions of each cost; with a cutoff those up to it and the ties of the last."""
    s = suggestions
    if cutoff is not None:
        s = s.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy("cost"))).where(F.col("_r") <= cutoff)
    return s.groupBy(*keys, "cost").agg(F.array_sort(F.collect_list("fingering")).alias("fingerings"))


def combine_staves(upper: DataFrame, lower: DataFrame, *, keys=KEY) -> DataFrame:
    """(keys, rank, fingering, cost): the i-th upper with the i-th lower; the shorter list goes on with its best."""
    u, lo = (d.select(*keys, "rank", F.col("fingering").alias(n), F.col("cost").alias(f"{n}_cost")) for d, n in ((upper, "u"), (lower, "l")))
    both = u.join(lo, [*keys, "rank"], "full")
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = lambda c: F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(w))
    return both.select(*keys, "rank", F.concat(best("u"), F.lit("@"), best("l")).alias("fingering"), (best("u_cost") + best("l_cost")).alias("cost"))


def combine_segments(suggestions: DataFrame, k: int, *, mode: str = "raw", keys=KEY) -> DataFrame:
    """(keys, rank, fingering, cost): the k best whole sequences of one suggestion per segment.

    A fold over the segments: every kept sequence with every suggestion, the k best again. Costs add up as they are
    (raw), per note (norm) or by rank. Ties are ordered by the fingering.
    """
    value = {"raw": F.col("cost").cast("double"), "norm": F.col("cost") / F.length(F.regexp_replace("fingering", "[<>]", "")), "rank": F.col("rank").cast("double")}[mode]
    per = suggestions.withColumn("_v", value).groupBy(*keys, "segment_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("_v").alias("c"), F.col("fingering").alias("f")))).alias("options"))
    seq = per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_idx", "options"))), lambda s: s["options"]).alias("layers"))
    start = F.expr("array(named_struct('c', cast(0 as double), 'f', ''))")
    step = lambda acc, layer: F.slice(F.array_sort(F.flatten(F.transform(acc, lambda a: F.transform(layer, lambda b: F.struct((a["c"] + b["c"]).alias("c"), F.concat(a["f"], b["f"]).alias("f")))))), 1, k)
    best = seq.select(*keys, F.posexplode(F.aggregate("layers", start, step)).alias("_r", "x"))
    return best.select(*keys, (F.col("_r") + 1).alias("rank"), F.col("x.f").alias("fingering"), F.col("x.c").alias("cost"))


def preset_test_set(examples: DataFrame, *, title: str = "title", last: int = 30) -> DataFrame:
    """Adds is_test: pieces numbered up to `last`."""
    return examples.withColumn("is_test", F.coalesce(F.try_to_number(F.split(title, "-")[0], F.lit("999999")) <= last, F.lit(False)))


def drop_wildcards(fingerings: DataFrame, *, keys=KEY, hsd: str = "hsd") -> DataFrame:
    """Sequences without any 'x'."""
    bad = fingerings.where(F.col(hsd) == "x").select(*keys).distinct()
    return fingerings.join(bad, list(keys), "left_anti")


def other_hand_count(fingerings: DataFrame, *, keys=KEY, hand: str = "hand", default: str = "default_hand") -> DataFrame:
    """(keys, other_hand, wildcards)."""
    return fingerings.groupBy(*keys).agg(F.sum((F.col(hand) != F.col(default)).cast("int")).alias("other_hand"), F.sum((F.col("hsd") == "x").cast("int")).alias("wildcards"))


def bigram_bits(fingerings: DataFrame, *, keys=KEY) -> DataFrame:
    """Adds bits: from and to finger with the direction, null where either is missing. Needs strike, release and midi."""
    w = by_note(keys)
    before = F.lag("release").over(w)
    bits = F.struct(before.alias("from"), F.col("strike").alias("to"), F.signum(F.col("midi") - F.lag("midi").over(w)).cast("int").alias("direction"))
    return fingerings.withColumn("bits", F.when(before.isNotNull() & (before != "x") & (F.col("strike") != "x"), bits))
