"""Agreement between annotators: confusion tables, kappa, alpha."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from handspan.operators.sequence import KEY, ngram_labels


def confusion(pairs: DataFrame, labels: list, *, one: str = "one", other: str = "other", keys=(), common: str | None = None) -> DataFrame:
    """(keys, one, other, n) over the whole grid of labels. With `common` only rows that this annotation leaves as 'x' count."""
    if common:
        pairs = pairs.where(F.col(common) == "x")
    grid = pairs.select(*keys).distinct() if keys else pairs.sparkSession.range(1).select()
    label = F.array(*[F.lit(x) for x in labels])
    grid = grid.withColumn(one, F.explode(label)).withColumn(other, F.explode(label))
    n = pairs.where(F.col(one).isNotNull() & F.col(other).isNotNull()).groupBy(*keys, one, other).agg(F.count("*").alias("n"))
    return grid.join(n, [*keys, one, other], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def confusion_matrix(table: DataFrame, labels: list, *, one: str = "one", other: str = "other", keys=()) -> DataFrame:
    """The table with a column for each label of `other`."""
    return table.groupBy(*keys, one).pivot(other, labels).agg(F.sum("n"))


def cohens_kappa(table: DataFrame, *, one: str = "one", other: str = "other", keys=()) -> DataFrame:
    """(keys, n, po, pe, kappa) of confusion tables; kappa is null where chance alone agrees wholly."""
    total = table.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.when(F.col(one) == F.col(other), F.col("n")).otherwise(0)).alias("same"))
    rows = table.groupBy(*keys, F.col(one).alias("label")).agg(F.sum("n").alias("a"))
    columns = table.groupBy(*keys, F.col(other).alias("label")).agg(F.sum("n").alias("b"))
    by = [*keys, "label"]
    chance = rows.join(columns, by).groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    both = total.join(chance, list(keys)) if keys else total.crossJoin(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("total"), F.col("ab") / (F.col("total") * F.col("total"))
    return both.select(*keys, F.col("total").alias("n"), po.alias("po"), pe.alias("pe"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def with_pooled(table: DataFrame, *, one: str = "one", other: str = "other", key: str = "staff", pooled: str = "both") -> DataFrame:
    """A confusion table by key with the table over all keys, by grouping sets of its cells; so one pass over the pairs gives both. A null key keeps its own table."""
    cells = [F.col(one), F.col(other)]
    sets = table.groupingSets([[F.col(key), *cells], cells], key, one, other).agg(F.sum("n").alias("n"), F.grouping(F.col(key)).alias("_all"))
    return sets.select(F.when(F.col("_all") == 1, pooled).otherwise(F.col(key)).alias(key), one, other, "n")


def nominal(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.0).otherwise(1.0)


def interval(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))


#: Different labels of which a caller's distance function is asked for every two; a table of distances has no such limit.
MOST_LABELS = 2_000


def _table_expected(values: DataFrame, table: DataFrame, missing: float, keys) -> DataFrame:
    """(keys, de): the distances of all two labels, from those that the table has and `missing` for all others; equal labels have none."""
    n = values.withColumn("n", F.col("n_v").cast("double"))
    all_ = n.groupBy(*keys).agg((F.pow(F.sum("n"), F.lit(2.0)) - F.sum(F.col("n") * F.col("n"))).alias("_pairs"))
    known = n.select(*keys, F.col("v").alias("a"), F.col("n").alias("n_a")).join(table, "a")
    known = known.join(n.select(*keys, F.col("v").alias("b"), F.col("n").alias("n_b")), [*keys, "b"])
    listed = known.groupBy(*keys).agg(F.sum(F.col("n_a") * F.col("n_b") * F.col("d")).alias("_sum"), F.sum(F.col("n_a") * F.col("n_b")).alias("_listed"))
    both = all_.join(listed, list(keys), "left") if keys else all_.crossJoin(F.broadcast(listed))  # one row each
    return both.select(*keys, (F.coalesce("_sum", F.lit(0.0)) + missing * (F.col("_pairs") - F.coalesce("_listed", F.lit(0.0)))).alias("de"))


def distance_table(distances: DataFrame, a: str = "a", b: str = "b", d: str = "d") -> DataFrame:
    """(a, b, d) both ways, of different labels: a pair given both ways must agree, of a pair given twice the larger distance counts."""
    one = distances.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(d).cast("double").alias("d")).where("a != b and d is not null")
    return one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy("a", "b").agg(F.max("d").alias("d"))


def krippendorff_alpha(data: DataFrame, distance: Callable[[Column, Column], Column] | DataFrame = nominal, *, unit=("unit",), value: str = "value", keys=(), among: list[str] | None = None, coder: str = "coder", missing: float = 1.0) -> DataFrame:
    """(keys, pairable, observed, expected, alpha): 1 - Do/De from the coincidence matrix; units of fewer than two values don't count.

    Pairs are made within a unit between its different values, with their counts, so a unit that very many coders
    share is summed first. `among` keeps some coders. Values that are null aren't given. Chance disagreement is in
    closed form for the nominal and the interval distance; another function is asked for each pair of different labels,
    of which there may be MOST_LABELS, or the call fails. A table of distances (a, b, d) is joined to the pairs that occur:
    equal labels are 0 apart, and two that the table lacks are `missing` apart, so no label meets every other.
    """
    table = distance_table(distance) if isinstance(distance, DataFrame) else None
    d = data.where(F.col(value).isNotNull())
    if among is not None:
        d = d.where(F.col(coder).isin(*among))
    by = [*keys, *unit]
    counts = d.dropna(subset=by).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # one exchange and one sort by unit; a unit's labels stand beside each of them, and no row meets another by a join
    w = Window.partitionBy(*by)
    units = counts.withColumns({"m": F.sum("c").over(w), "_all": F.collect_list(F.struct(F.col("v").alias("w"), F.col("c").alias("e"))).over(w)}).where("m > 1")
    pairs = units.select(*keys, "v", "c", "m", F.explode("_all").alias("_w")).select(*keys, "v", "c", "m", "_w.w", "_w.e")
    same = F.col("v") == F.col("w")
    coincidence = pairs.groupBy(*keys, "v", "w").agg(F.sum(F.col("c") * (F.col("e") - F.when(same, 1).otherwise(0)) / (F.col("m") - 1)).alias("o"), F.sum(F.when(same, F.col("c"))).alias("n_v"))
    values = coincidence.where(same).select(*keys, "v", "n_v")  # each label of a unit meets itself once there
    if table is not None:
        coincidence = coincidence.join(table.select(F.col("a").alias("v"), F.col("b").alias("w"), "d"), ["v", "w"], "left")
        apart = F.when(F.col("v") == F.col("w"), 0.0).otherwise(F.coalesce("d", F.lit(float(missing))))
    else:
        apart = distance(F.col("v"), F.col("w"))
    observed = coincidence.groupBy(*keys).agg(F.sum(F.col("o") * apart).alias("do"), F.sum("o").alias("n"))
    n, v = F.col("n_v").cast("double"), F.col("v")
    if distance is nominal:
        expected = values.groupBy(*keys).agg((F.pow(F.sum(n), F.lit(2.0)) - F.sum(n * n)).alias("de"))
    elif distance is interval:
        expected = values.groupBy(*keys).agg((2.0 * (F.sum(n) * F.sum(n * v * v) - F.pow(F.sum(n * v), F.lit(2.0)))).alias("de"))
    elif table is not None:
        expected = _table_expected(values, table, float(missing), keys)
    else:  # a distance of the caller's is asked for each pair of different labels
        found = values.select("v").distinct().limit(MOST_LABELS + 1).count()
        if found > MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} labels: give a table of distances")
        other = values.select(*keys, F.col("v").alias("w"), F.col("n_v").alias("n_w"))
        cross = values.join(other, list(keys)) if keys else values.join(other, F.lit(True))
        expected = cross.groupBy(*keys).agg(F.sum(F.col("n_v") * F.col("n_w") * distance(F.col("v"), F.col("w"))).alias("de"))
    both = observed.join(expected, list(keys)) if keys else observed.crossJoin(F.broadcast(expected))
    do, de = F.col("do") / F.col("n"), F.col("de") / (F.col("n") * (F.col("n") - 1))
    return both.select(*keys, F.col("n").alias("pairable"), do.alias("observed"), de.alias("expected"), F.when(de > 0, 1 - do / de).alias("alpha"))


def alpha_with_candidate(humans: DataFrame, candidate: DataFrame, distance: Callable[[Column, Column], Column] | DataFrame = nominal, *, keys=(), **options) -> DataFrame:
    """(keys, alpha, alpha_with, delta): the humans' alpha, theirs with one model's labels, and the difference."""
    own = krippendorff_alpha(humans, distance, keys=keys, **options).select(*keys, "alpha")
    more = krippendorff_alpha(humans.unionByName(candidate), distance, keys=keys, **options).select(*keys, F.col("alpha").alias("alpha_with"))
    both = own.join(more, list(keys)) if keys else own.crossJoin(F.broadcast(more))
    return both.withColumn("delta", F.col("alpha_with") - F.col("alpha"))


def alpha_ngram(labels: DataFrame, n: int, distance: Callable[[Column, Column], Column] = nominal, *, sequence=KEY, coder: str = "coder", label: str = "hsd", keys=()) -> DataFrame:
    """Alpha over n-gram items of each coder's sequence; n-grams reach past both ends."""
    items = ngram_labels(labels, n, label=label, keys=(*sequence, coder))
    return krippendorff_alpha(items, distance, unit=(*sequence, "ngram_idx"), value="ngram", coder=coder, keys=keys)


def trigram_distance(a: Column, b: Column, eps: float = 0.99, nuanced: bool = False) -> Column:
    """Between trigram strings of single-character digits: 0 equal; nuanced: 1 - eps if only the middle differs, by long neighbours."""
    if not nuanced:
        return nominal(a, b)
    at = lambda c, k: F.substring(c, k, 1)
    ends = (at(a, 1) == at(b, 1)) & (at(a, 3) == at(b, 3))
    x, y = F.try_to_number(at(a, 2), F.lit("9")).cast("int"), F.try_to_number(at(b, 2), F.lit("9")).cast("int")
    near = F.coalesce(F.least(x, y).isin(2, 3) & (F.abs(x - y) == 1), F.lit(False))
    return F.when(a == b, 0.0).when(ends & near, 1 - eps).otherwise(1.0)


def bigram_label_distance(a: Column, b: Column, t: float = 1.0, p: float = 1.0, n: float = 1.0) -> Column:
    """Between bigram labels (prevhand prevdigit mark hand digit): 1/p across hands or where only one pivots, else the digits' distance / (t * 16)."""
    hand = lambda c, k: F.substring(c, k, 1)
    digit = lambda c, k: F.when(F.substring(c, k, 1).rlike("[1-5]"), F.substring(c, k, 1).cast("int"))

    def pivots(c):
        up = F.substring(c, 3, 1)
        return F.coalesce((hand(c, 1) == hand(c, 4)) & (((up == "/") & (digit(c, 5) == 1) & (digit(c, 2) != 1)) | ((up == "\\") & (digit(c, 2) == 1) & (digit(c, 5) != 1))), F.lit(False))

    clash = (hand(a, 4) != hand(b, 4)) | (pivots(a) != pivots(b))
    apart = F.pow(F.abs(digit(a, 5) - digit(b, 5)).cast("double"), F.lit(2.0))
    return F.when(clash, 1.0 / p).otherwise(F.coalesce(apart, F.lit(0.0)) / (t * 16)) / n
