"""Cross-validation of counted models in one pass: counts of all folds are added up once, and a fold's model is the total less its own.

Counts are sums, so what a model that never saw a fold has counted is everything less what the fold itself holds. One
aggregation by fold serves all k models; nothing is trained k times. The models: a tagger with the label's share among
the examples of equal features and among the labels after the one before (both smoothed), decoded by the k-best fold;
and the transition weights of `search.transition_weights`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from handspan.operators.matchrates import match_rates
from handspan.operators.search import gathered_costs, k_best_paths, transition_weights
from handspan.operators.sequence import KEY, by_note

LABELS = 5


def _counts(label: str) -> Column:
    """How often each of the labels 1..LABELS occurs, as an array."""
    return F.array(*[F.sum((F.col(label) == d).cast("long")) for d in range(1, LABELS + 1)])


def _less(total: Column, own: Column) -> Column:
    return F.zip_with(total, F.coalesce(own, F.array(*[F.lit(0).cast("long")] * LABELS)), lambda t, o: t - o)


def left_out_counts(rows: DataFrame, by: list[str], *, label: str = "digit", fold: str = "fold") -> DataFrame:
    """(by, fold, counts): for each group of the rows and each fold that it occurs in, the labels of the other folds.

    One aggregation by group and fold; the totals are sums of its rows, which are few.
    """
    own = rows.where(F.col(label).isNotNull()).groupBy(*by, fold).agg(_counts(label).alias("own"))
    total = own.groupBy(*by).agg(F.array(*[F.sum(F.get("own", F.lit(i))) for i in range(LABELS)]).alias("total"))
    seen = rows.select(*by, fold).distinct()
    same = lambda a, b: F.lit(True) if not by else sum((F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")).cast("int") for c in by), F.lit(0)) == len(by)
    got = seen.alias("s").join(total.alias("t"), same("s", "t"), "left").join(own.alias("o"), same("s", "o") & F.col(f"s.{fold}").eqNullSafe(F.col(f"o.{fold}")), "left")
    zero = F.array(*[F.lit(0).cast("long")] * LABELS)
    return got.select(*[F.col(f"s.{c}").alias(c) for c in by], F.col(f"s.{fold}").alias(fold), _less(F.coalesce("t.total", zero), F.col("o.own")).alias("counts"))


def _logs(counts: Column, smooth: float, places: int | None) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n) + LABELS * smooth
    log = lambda n: F.log((n + smooth) / total)
    return F.transform(counts, lambda n: F.round(log(n), places) if places is not None else log(n))


def left_out_scores(rows: DataFrame, features: list[str], *, label: str = "digit", fold: str = "fold", smooth: float = 1.0, places: int | None = None, keys=KEY) -> DataFrame:
    """Adds em, the log of each label's share given the features, and tr, those of each label after each other one (25): by the other folds.

    places rounds the logs, so that equal sums are ties in any order of adding up. Features may be null, which is a value.
    """
    em = left_out_counts(rows, features, label=label, fold=fold).withColumn("em", _logs(F.col("counts"), smooth, places)).drop("counts")
    before = rows.select(fold, F.lag(label).over(by_note(keys)).alias("prev"), F.col(label)).where("prev is not null")
    # every previous label stands in every fold, so that an unseen one has smoothed shares
    some = rows.select(fold).distinct().select(fold, F.explode(F.array(*[F.lit(d) for d in range(1, LABELS + 1)])).alias("prev"), F.lit(None).cast("int").alias(label))
    tr = left_out_counts(before.select(fold, F.col("prev").cast("int").alias("prev"), F.col(label).cast("int").alias(label)).unionByName(some), ["prev"], label=label, fold=fold)
    tr = tr.withColumn("tr", _logs(F.col("counts"), smooth, places)).groupBy(fold).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("prev", "tr"))), lambda s: s["tr"])).alias("tr"))
    same = [rows[c].eqNullSafe(em[c]) for c in (*features, fold)]
    on = same[0]
    for c in same[1:]:
        on &= c
    scored = rows.join(em, on, "left").select(*[rows[c] for c in rows.columns], "em")
    return scored.join(F.broadcast(tr), fold)  # a row for each fold


def decode(scored: DataFrame, *, carry: tuple[str, ...] = (), keys=KEY) -> DataFrame:
    """(keys, digits, score): the likeliest labels of each sequence by em and tr; a first label has no transition."""
    first = F.lag("note_idx").over(by_note(keys)).isNull()
    rows = scored.withColumn("_first", first)
    cost = F.expr(f"array({', '.join(f'-(get(em, {q % 5}) + if(_first, 0D, get(tr, {q})))' for q in range(25))})")
    costs = gathered_costs(rows.select(*keys, "note_idx", cost.alias("c_step"), F.lit(0).alias("midi")), keys)
    return k_best_paths(costs, 1, keys=keys).select(*keys, "digits", (-F.col("cost")).alias("score"))


def cross_validate_counts(examples: DataFrame, features: list[str], *, label: str = "digit", fold: str = "fold", smooth: float = 1.0, places: int | None = None, keys=KEY) -> DataFrame:
    """(keys, note_idx, fold, truth, predicted) of every example: each fold tagged by a model of the others."""
    scored = left_out_scores(examples, features, label=label, fold=fold, smooth=smooth, places=places, keys=keys)
    best = decode(scored, keys=keys).select(*keys, "digits")
    place = examples.withColumn("_at", F.row_number().over(by_note(keys)))
    return place.join(best, list(keys)).select(*keys, "note_idx", fold, F.col(label).alias("truth"), F.substring("digits", F.col("_at"), F.lit(1)).cast("int").alias("predicted"))


def fold_match_rates(predictions: DataFrame, *, fold: str = "fold", keys=KEY) -> DataFrame:
    """`matchrates.match_rates` for each fold, and for all together."""
    pairs = predictions.select(*keys, "note_idx", F.col(fold).cast("string").alias(fold), F.col("predicted").alias("a"), F.col("truth").alias("b"), F.lit("truth").alias("b_coder"))
    return match_rates(pairs, staff=fold, keys=keys)


def fold_report(predictions: DataFrame, *, fold: str = "fold") -> DataFrame:
    """(fold, label, support, predicted_n, precision, recall, f1): the classification report of each fold."""
    from handspan.operators.matchrates import classification_report

    return classification_report(predictions, keys=(fold,))


def left_out_weights(fingered: DataFrame, *, fold: str = "fold", keys=KEY, digit: str = "digit") -> DataFrame:
    """(fold, p, q, f, g, weight): the transition weights of all folds but each; one pass, as weights are sums over sequences.

    Transitions that only the fold itself has are left out: how many sequences have one is subtracted in whole numbers.
    """
    each = transition_weights(fingered, keys=keys, digit=digit, by=(fold,))
    w = by_note(keys)
    has = fingered.select(fold, *keys, F.lag("midi").over(w).alias("p"), F.col("midi").alias("q"), F.lag(digit).over(w).alias("f"), F.col(digit).alias("g")).where("p is not null").distinct()
    own = each.join(has.groupBy(fold, "p", "q", "f", "g").agg(F.count("*").alias("n")), [fold, "p", "q", "f", "g"])
    four = Window.partitionBy("p", "q", "f", "g")  # a row for each fold
    total = own.withColumns({"_w": F.sum("weight").over(four), "_n": F.sum("n").over(four)})
    folds = fingered.select(F.col(fold).alias("_fold")).distinct()
    every = total.select("p", "q", "f", "g", "_w", "_n").distinct().join(F.broadcast(folds))  # a row of each transition for each fold
    every = every.join(own.withColumnRenamed(fold, "_fold").select("_fold", "p", "q", "f", "g", "weight", "n"), ["_fold", "p", "q", "f", "g"], "left")
    left = every.where(F.col("_n") > F.coalesce("n", F.lit(0)))
    return left.select(F.col("_fold").alias(fold), "p", "q", "f", "g", (F.col("_w") - F.coalesce("weight", F.lit(0.0))).alias("weight"))
