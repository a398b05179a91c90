"""Features, splits and a tagger for sequence-labelling experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from handspan.functions.keys import distance_integral, is_black
from handspan.operators.sequence import (
    KEY,
    _at,
    articulation_features,
    by_note,
    chord_border,
    chord_category,
    chord_counts,
    contour_flags,
    lattice_ngrams,
    leaps,
    phrase_ends,
    repeat_runs,
    sounding_at_onset,
    tempo_features,
)

V7 = (
    "staff", "chord_cat", "chord_border", "concurrent_cat", "bop", "eop", "x_m3", "x_m2", "x_m1", "x_p1", "x_p2", "x_p3", "y_m3", "y_m2", "y_m1", "y_p1", "y_p2", "y_p3",
    "dxgram_1", "dxgram_2", "dxgram_3", "black_m1", "black", "black_p1", "black3gram", "returning", "will_return", "ascending", "descending", "leap", "velocity",
    "left_nps", "right_nps", "window_nps", "staccato_count", "normalized_silence", "separated_count", "odd_repeats_before",
)
#: Columns of each version of the feature set.
VERSIONS = {
    7: V7,
    6: tuple(c for c in V7 if c not in ("concurrent_cat", "chord_border", "dxgram_3")),
    5: tuple(c for c in V7 if c not in ("concurrent_cat", "chord_border", "dxgram_3", "staccato_count", "normalized_silence", "separated_count", "odd_repeats_before")),
    4: tuple(c for c in V7 if c not in ("concurrent_cat", "chord_border", "dxgram_3", "staccato_count", "normalized_silence", "separated_count", "odd_repeats_before", "leap")),
    3: ("staff", "chord_left", "chord_right", "bop", "eop", "x_m2", "x_m1", "x_p1", "x_p2", "y_m2", "y_m1", "y_p1", "y_p2", "black_m1", "black", "black_p1", "velocity", "left_nps", "right_nps", "window_nps"),
}


def features(notes: DataFrame, version: int = 7, *, max_leap: int = 15, concurrent: bool = True, keys=KEY) -> DataFrame:
    """notes with the columns of a feature set. Needs midi, onset_ms, dur_ms, staff and velocity (null: 64)."""
    w = by_note(keys)
    n = notes
    if version == 7 and concurrent:
        n = sounding_at_onset(n, keys=keys)
        n = n.withColumn("concurrent_cat", chord_category(F.col("staff"), F.col("sounding_lower"), F.col("sounding_upper")))
    n = articulation_features(n, keys=keys)
    n = tempo_features(n, keys=keys)
    n = repeat_runs(n, keys=keys)
    n = chord_counts(n, keys=keys)
    n = lattice_ngrams(n, max_leap=max_leap, keys=keys)
    n = contour_flags(n, max_leap=max_leap, keys=keys)
    n = phrase_ends(leaps(n, max_leap=max_leap, keys=keys), keys=keys)
    gram = lambda k: F.concat_ws("|", *[F.col(f"x_m{i}").cast("string") for i in range(k, 0, -1)], *[F.col(f"x_p{i}").cast("string") for i in range(1, k + 1)])
    black = lambda k: F.coalesce(is_black(_at("midi", k, w) if k else F.col("midi")), F.lit(False))
    n = n.withColumns({
        "chord_cat": chord_category(F.col("staff"), F.col("chord_lower"), F.col("chord_upper")), "chord_border": chord_border(F.col("chord_lower"), F.col("chord_upper")),
        "dxgram_1": gram(1), "dxgram_2": gram(2), "dxgram_3": gram(3), "black_m1": black(-1), "black": black(0), "black_p1": black(1),
        "velocity": F.coalesce("velocity", F.lit(64)), "odd_repeats_before": F.col("repeats_before") % 2 == 1,
    })
    n = n.withColumn("black3gram", F.concat_ws("|", *[F.col(c).cast("string") for c in ("black_m1", "black", "black_p1")]))
    return n.select(*notes.columns, *[c for c in VERSIONS[version] if c not in notes.columns and (c != "concurrent_cat" or concurrent)])


def features_by_settings(notes: DataFrame, *, distance: str = "lattice", chording: bool = True, black: bool = True, leap: bool = True, velocity: bool = True, tempo: bool = True, articulation: bool = True, repeats: bool = True, categorical: bool = False, max_leap: int = 15, builders=(), keys=KEY) -> DataFrame:
    """Feature columns by switches; `categorical` makes all of them strings.

    builders: functions of the notes that give (notes with new columns, their names), for features of the caller's.
    """
    w, n, got = by_note(keys), notes, []

    def add(df, *names):
        got.extend(names)
        return df

    if articulation:
        n = add(articulation_features(n, keys=keys), "staccato_count", "normalized_silence", "separated_count")
    if tempo:
        n = add(tempo_features(n, keys=keys), "left_nps", "right_nps", "window_nps")
    if repeats:
        n = add(repeat_runs(n, keys=keys), "repeats_before", "repeats_after")
    if chording:
        n = add(chord_counts(n, keys=keys), "chord_left", "chord_right", "chord_lower", "chord_upper")
    if distance == "lattice":
        n = add(lattice_ngrams(n, max_leap=max_leap, keys=keys), *[f"{a}_{s}{k}" for a in "xy" for s in "mp" for k in range(1, 5)])
    else:
        pair = lambda k: (_at("midi", k, w), F.col("midi")) if k < 0 else (F.col("midi"), _at("midi", k, w))
        names = {f"d_{'m' if k < 0 else 'p'}{abs(k)}": distance_integral(*pair(k), max_leap) for k in (-4, -3, -2, -1, 1, 2, 3, 4)}
        n = add(n.withColumns(names), *names)
    if leap:
        n = add(leaps(n, max_leap=max_leap, keys=keys), "leap")
    if black:
        n = add(n.withColumn("black", is_black("midi")), "black")
    if velocity:
        n = add(n.withColumn("velocity", F.coalesce("velocity", F.lit(64))), "velocity")
    for build in builders:
        n, names = build(n)
        n = add(n, *names)
    kind = (lambda c: F.col(c).cast("string").alias(c)) if categorical else F.col
    return n.select(*[c for c in notes.columns if c not in got], *[kind(c) for c in got])


def reverse_sequences(notes: DataFrame, *, keys=KEY) -> DataFrame:
    """Numbers notes from the end."""
    return notes.withColumn("note_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("note_idx"))) - 1)


def group_split(rows: DataFrame, test_size: float, seed: int = 1, *, group=KEY) -> DataFrame:
    """Adds is_test; a group is whole on one side, by the md5 of its key and the seed, so other engines can split alike."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group], F.lit(str(seed)))
    place = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") % 1_000_000
    return rows.withColumn("is_test", place < int(test_size * 1_000_000))


def group_kfold(rows: DataFrame, k: int, *, group=KEY) -> DataFrame:
    """Adds fold: groups whole, dealt out by size there and back, so that folds are of like size.

    Groups are sorted in ranges of their size and numbered within each range; a range's first number is the count of
    those before it, so no task sees all groups.
    """
    from handspan.plans.lineage import cut_lineage

    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n")).repartitionByRange(F.desc("_n"), *group).sortWithinPartitions(F.desc("_n"), *group)
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sizes = cut_lineage(sizes.select(*group, F.spark_partition_id().alias("_range"), in_range.alias("_at")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = sizes.groupBy("_range").agg(F.count("*").alias("_c")).withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    at = F.pmod(F.col("_first") + F.col("_at"), F.lit(2 * k))
    folds = sizes.join(F.broadcast(ranges), "_range").select(*group, F.when(at < k, at).otherwise(2 * k - 1 - at).cast("int").alias("fold"))
    return rows.join(folds, list(group))


def fold_counts(rows: DataFrame, *, fold: str = "fold", staff: str = "staff", group=KEY) -> DataFrame:
    """(fold, staff, pooled, examples, notes) for each fold and staff, and for all staffs together (pooled, with a null staff); a null staff of the rows has its own row."""
    per = rows.groupBy(fold, staff, *group).agg(F.count("*").alias("n"))
    return per.groupingSets([[F.col(fold), F.col(staff)], [F.col(fold)]], fold, staff).agg((F.grouping(F.col(staff)) == 1).alias("pooled"), F.count("*").alias("examples"), F.sum("n").alias("notes"))


def edge_features(fingered: DataFrame, *, keys=KEY, tags=("str", "sma", "lar", "3t4", "bl4", "bl1", "bl5", "pa1", "wea")) -> DataFrame:
    """Rule costs and counts of each pair of labels in a row: nine rules, chord notes below and above, repeated finger."""
    from handspan.operators.search import rule_costs, with_trigrams

    t = rule_costs(with_trigrams(chord_counts(fingered, keys=keys), keys=keys), tags)
    return t.withColumn("repeat_finger", F.coalesce(F.col("d1") == F.col("d2"), F.lit(False))).drop("m1", "m2", "m3", "h1", "h2", "h3", "d1", "d2", "d3", "chord_left", "chord_right")


def train_tagger(examples: DataFrame, columns: list[str], *, label: str = "digit", size: int = 1024, reg: float = 0.01):
    """A fitted pipeline: hashed features and a multinomial logistic regression of the digit."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher

    text = [c for c, kind in examples.dtypes if c in columns and kind in ("string", "boolean")]
    hasher = FeatureHasher(inputCols=columns, outputCol="hashed", numFeatures=size, categoricalCols=text)
    model = LogisticRegression(featuresCol="hashed", labelCol="tag_label", family="multinomial", regParam=reg, maxIter=30)
    return Pipeline(stages=[hasher, model]).fit(examples.withColumn("tag_label", (F.col(label) - 1).cast("double")))


def tag(model, examples: DataFrame) -> DataFrame:
    """Adds predicted, the likeliest digit, and scores, the log of each digit's chance."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(examples)
    return out.withColumns({"predicted": (F.col("prediction") + 1).cast("int"), "scores": F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(1e-12))))}).drop("hashed", "rawPrediction", "probability", "prediction")


def cross_validate(examples: DataFrame, columns: list[str], k: int = 5, *, label: str = "digit", group=KEY, reg: float = 0.01) -> DataFrame:
    """(fold, notes, rate, share): match rate of each fold under a tagger trained on the others, and its part of the notes."""
    rows = group_kfold(examples, k, group=group)
    out = None
    for f in range(k):
        model = train_tagger(rows.where(F.col("fold") != f), columns, label=label, reg=reg)
        got = tag(model, rows.where(F.col("fold") == f)).agg(F.lit(f).alias("fold"), F.count("*").alias("notes"), F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("rate"))
        out = got if out is None else out.unionAll(got)
    return out.withColumn("share", F.col("notes") / F.sum("notes").over(Window.partitionBy()))  # a row for each fold


def tune(examples: DataFrame, columns: list[str], regs: list[float], k: int = 3, *, label: str = "digit", group=KEY) -> list[tuple[float, float]]:
    """(reg, accuracy) of each setting, best first, by cross-validation on grouped folds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import FeatureHasher
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = group_kfold(examples, k, group=group).withColumn("tag_label", (F.col(label) - 1).cast("double"))
    text = [c for c, kind in rows.dtypes if c in columns and kind in ("string", "boolean")]
    model = LogisticRegression(featuresCol="hashed", labelCol="tag_label", family="multinomial", maxIter=20)
    stages = Pipeline(stages=[FeatureHasher(inputCols=columns, outputCol="hashed", numFeatures=1024, categoricalCols=text), model])
    grid = ParamGridBuilder().addGrid(model.regParam, regs).build()
    fitted = CrossValidator(estimator=stages, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="tag_label", metricName="accuracy"), numFolds=k, foldCol="fold").fit(rows)
    return sorted(((g[model.regParam], m) for g, m in zip(grid, fitted.avgMetrics, strict=True)), key=lambda x: -x[1])


def build_examples(notes: DataFrame, fingerings: DataFrame, version: int = 7, *, keys=KEY, **options) -> DataFrame:
    """Notes, labels and features of sequences that fit; wildcards are dropped. Options as in finger_notes."""
    from handspan.operators.corpus import finger_notes

    return finger_notes(features(notes, version, keys=keys), fingerings, keys=keys, drop_wildcards=True, **options)
