"""Match rates between predictions and one or several ground truths, and reports over labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from handspan.operators.sequence import KEY


def pair_annotations(a: DataFrame, b: DataFrame, *, keys=KEY, ordered: bool = True, coder: str = "coder", value: str = "value") -> DataFrame:
    """(keys, note_idx, a_coder, b_coder, a, b): note-aligned pairs; ordered keeps one of each two, else all between different coders."""
    left = a.select(*keys, "note_idx", F.col(coder).alias("a_coder"), F.col(value).alias("a"))
    right = b.select(*keys, "note_idx", F.col(coder).alias("b_coder"), F.col(value).alias("b"))
    pairs = left.join(right, [*keys, "note_idx"])
    return pairs.where("a_coder < b_coder" if ordered else "a_coder != b_coder")


def simple_match_rate(pairs: DataFrame, *, one: str = "a", other: str = "b", keys=KEY) -> DataFrame:
    same = (F.col(one) == F.col(other)).cast("int")
    return pairs.groupBy(*keys).agg(F.sum(same).alias("matches"), F.count("*").alias("notes"), F.avg(same).alias("rate"))


def note_rates(pairs: DataFrame, *, one: str = "a", other: str = "b", truth: str = "b_coder", keys=KEY) -> DataFrame:
    """(keys, notes, truths, gen, high, soft): the mean over ground truths, the best one, and notes that any one agrees with.

    One pass by note and one by truth; keys name the sequence and the prediction.
    """
    same = (F.col(one) == F.col(other)).cast("int")
    by_truth = pairs.groupBy(*keys, truth).agg(F.sum(same).alias("m"), F.count("*").alias("n"))
    whole = by_truth.groupBy(*keys).agg(F.max("n").alias("notes"), F.count("*").alias("truths"), (F.sum("m") / F.sum("n")).alias("gen"), F.max(F.col("m") / F.col("n")).alias("high"))
    soft = pairs.groupBy(*keys, "note_idx").agg(F.max(same).alias("any")).groupBy(*keys).agg(F.avg("any").alias("soft"))
    return whole.join(soft, list(keys))


def match_rates(pairs: DataFrame, *, staff: str = "staff", keys=KEY, **options) -> DataFrame:
    """(staff, rate, segments, mean, weighted_mean, stdev, weighted_stdev) of gen, high and soft, for each staff and for both ('combined')."""
    rates = note_rates(pairs, keys=(*keys, staff), **options)
    long = rates.unpivot([*keys, staff, "notes"], ["gen", "high", "soft"], "rate", "value")
    sums = long.cube(staff, "rate").agg(
        F.grouping(staff).alias("_all"), F.grouping("rate").alias("_any"), F.count("*").alias("segments"), F.avg("value").alias("mean"),
        (F.sum(F.col("value") * F.col("notes")) / F.sum("notes")).alias("weighted_mean"), F.stddev_samp("value").alias("stdev"),
        (F.sum(F.col("value") * F.col("value") * F.col("notes")) / F.sum("notes")).alias("_sq"),
    )
    spread = F.sqrt(F.greatest(F.col("_sq") - F.col("weighted_mean") * F.col("weighted_mean"), F.lit(0.0)))
    return sums.where("_any = 0").select(F.when(F.col("_all") == 1, "combined").otherwise(F.col(staff)).alias(staff), "rate", "segments", "mean", "weighted_mean", "stdev", spread.alias("weighted_stdev"))


def corpus_match_rates(rates: DataFrame, *, weight: str = "notes", keys=()) -> DataFrame:
    """(keys, gen, high, soft): piece rates averaged, by notes or (weight='uniform') each piece alike."""
    mean = lambda c: F.avg(c) if weight == "uniform" else F.sum(F.col(c) * F.col(weight)) / F.sum(weight)
    return rates.groupBy(*keys).agg(*[mean(c).alias(c) for c in ("gen", "high", "soft")])


def human_match_rates(annotations: DataFrame, *, keys=KEY, coder: str = "coder", value: str = "value") -> DataFrame:
    """Rates of each annotation against the others of its piece."""
    return note_rates(pair_annotations(annotations, annotations, keys=keys, ordered=False, coder=coder, value=value), keys=(*keys, "a_coder"))


def classification_report(pairs: DataFrame, *, truth: str = "truth", predicted: str = "predicted", keys=()) -> DataFrame:
    """(keys, label, support, predicted_n, precision, recall, f1): null where there is nothing to divide by."""
    cells = pairs.groupBy(*keys, truth, predicted).agg(F.count("*").alias("n"))
    long = cells.select(*keys, F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    long = long.unionAll(cells.select(*keys, F.col(predicted).alias("label"), F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long")))
    s = long.groupBy(*keys, "label").agg(F.sum("support").alias("support"), F.sum("given").alias("predicted_n"), F.sum("hit").alias("hit"))
    p, r = F.col("hit") / F.nullif("predicted_n", F.lit(0)), F.col("hit") / F.nullif("support", F.lit(0))
    return s.select(*keys, "label", "support", "predicted_n", p.alias("precision"), r.alias("recall"), F.when(F.col("predicted_n") + F.col("support") > 0, 2 * F.col("hit") / (F.col("predicted_n") + F.col("support"))).alias("f1"))


def weighted_f1(report: DataFrame) -> DataFrame:
    """(accuracy, weighted_f1) of a report: f1 weighted by support."""
    return report.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), (F.sum(F.coalesce("f1", F.lit(0.0)) * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def example_accuracy(pairs: DataFrame, *, truth: str = "truth", predicted: str = "predicted", keys=KEY) -> DataFrame:
    """(examples, example_accuracy, token_accuracy): sequences wholly right; tokens right among those not at an end."""
    same = (F.col(truth) == F.col(predicted)).cast("int")
    per = pairs.groupBy(*keys).agg(F.min(same).alias("whole"), F.min("note_idx").alias("lo"), F.max("note_idx").alias("hi"))
    inner = pairs.join(per, list(keys)).where((F.col("note_idx") > F.col("lo")) & (F.col("note_idx") < F.col("hi"))).agg(F.avg(same).alias("token_accuracy"))
    return per.agg(F.count("*").alias("examples"), F.avg("whole").alias("example_accuracy")).crossJoin(F.broadcast(inner))  # one row each


def verbatim_match_counts(pairs: DataFrame, near: Column, *, one: str = "a", other: str = "b", keys=KEY, coder: str = "b_coder") -> DataFrame:
    """(annotators, exact, near, distance): annotators whose whole fingering equals the reference, or does up to near neighbours."""
    same = F.col(one) == F.col(other)
    per = pairs.groupBy(*keys, coder).agg(F.min(same.cast("int")).alias("exact"), F.min((same | near).cast("int")).alias("close"), F.sum((~same).cast("int")).alias("distance"))
    return per.groupBy(*keys).agg(F.count("*").alias("annotators"), F.sum("exact").alias("exact"), F.sum("close").alias("near"), F.sum("distance").alias("distance"))
