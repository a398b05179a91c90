"""Statistics over groups of results; moments are plain aggregates, p-values are Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def one_way_anova(rows: DataFrame, *, group: str = "model", value: str = "value", keys=()) -> DataFrame:
    """(keys, groups, n, ss_between, ss_within, f, p): null f and p where nothing varies within groups."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    total = per.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("groups"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    both = per.join(total, list(keys)) if keys else per.crossJoin(F.broadcast(total))  # one row
    out = both.groupBy(*keys, "groups", "total").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2.0))).alias("ss_between"), F.sum(F.col("n") * F.col("var")).alias("ss_within"))
    f = (F.col("ss_between") / (F.col("groups") - 1)) / F.nullif(F.col("ss_within") / (F.col("total") - F.col("groups")), F.lit(0.0))
    out = out.select(*keys, "groups", F.col("total").alias("n"), "ss_between", "ss_within", f.alias("f"))
    return out.withColumn("p", f_test_p(F.col("f"), F.col("groups") - 1.0, F.col("n") - F.col("groups").cast("double")))


def paired_ttest(pairs: DataFrame, *, one: str = "a", other: str = "b", keys=()) -> DataFrame:
    """(keys, n, mean_difference, t, df, p) of the paired differences; null t and p where they don't vary."""
    d = (F.col(one) - F.col(other)).cast("double")
    s = pairs.where(d.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"))
    return s.select(*keys, "n", "mean_difference", (F.col("mean_difference") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).alias("t"), (F.col("n") - 1).alias("df")).withColumn("p", t_test_p(F.col("t"), F.col("df").cast("double")))


def pairwise_mean_diff(rows: DataFrame, *, group: str = "model", value: str = "value", keys=()) -> DataFrame:
    """(keys, a, b, difference) of the means of every two groups."""
    m = rows.groupBy(*keys, group).agg(F.avg(value).alias("mean"))
    a = m.select(*keys, F.col(group).alias("a"), F.col("mean").alias("x"))
    b = m.select(*keys, F.col(group).alias("b"), F.col("mean").alias("y"))
    return a.join(b, [a[k] == b[k] for k in keys] + [a["a"] < b["b"]]).drop(*[b[k] for k in keys]).select(*keys, "a", "b", (F.col("x") - F.col("y")).alias("difference"))


def repeat_by_weight(rows: DataFrame, *, weight: str = "weight") -> DataFrame:
    """Each row as often as its weight says; not at all for a weight below 1."""
    return rows.where(F.col(weight) >= 1).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int")))).drop("_k")


def feature_tallies(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, n, evaluations, most): value counts of each feature, and over all its values their sum and their largest."""
    long = rows.select(*[F.col(f).cast("string").alias(f) for f in features]).unpivot([], features, "feature", "value")
    n = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    whole = n.groupBy("feature").agg(F.sum("n").alias("evaluations"), F.max("n").alias("most"))
    return n.join(whole, "feature")


def span_diff(spans: DataFrame, a: str, b: str) -> DataFrame:
    """(hd1, hd2, field, a, b) where two span tables differ."""
    fields = [c for c in spans.columns if c not in ("table", "hd1", "hd2")]
    long = spans.unpivot(["table", "hd1", "hd2"], fields, "field", "v")
    left = long.where(F.col("table") == a).select("hd1", "hd2", "field", F.col("v").alias("a"))
    right = long.where(F.col("table") == b).select("hd1", "hd2", "field", F.col("v").alias("b"))
    return left.join(right, ["hd1", "hd2", "field"]).where("a != b")


# Coefficients of the Lanczos approximation of the gamma function, for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def ln_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number."""
    series = sum((F.lit(c) / (x + (k - 1)) for k, c in enumerate(_LANCZOS) if k), F.lit(_LANCZOS[0]))
    return 0.5 * F.log(F.lit(2 * math.pi)) + (x - 0.5) * F.log(x + 6.5) - (x + 6.5) + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, two terms a step; steps grow with the square root of its arguments."""
    steps = F.sequence(F.lit(1), (40 + 8 * F.sqrt(F.greatest(a, b))).cast("int"))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    first = 1 / (1 - (a + b) * x / (a + 1))

    def step(s, m):
        m = m.cast("double")
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        c1, d1 = 1 + even / s["c"], 1 / (1 + even * s["d"])
        c2, d2 = 1 + odd / c1, 1 / (1 + odd * d1)
        return state(c2, d2, s["h"] * c1 * d1 * c2 * d2)

    return F.aggregate(steps, state(F.lit(1.0), first, first), step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function; 0 at 0 and 1 at 1."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    inside = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def f_test_p(f: Column, df1: Column, df2: Column) -> Column:
    """The chance of an F at least as large; null where F is."""
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def t_test_p(t: Column, df: Column) -> Column:
    """The two-sided chance of a t at least as large; null where t is."""
    return incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t))
