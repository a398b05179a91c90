"""Sequences in ranges, deep search, versions, folds, distance tables, prints, databases and SQL functions."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from handspan.functions import fingering, sql
from handspan.functions.rules import RULES
from handspan.operators import agreement, features, folds, ranges, search, sequence
from handspan.sources import database, pig

PARTS = 8


@pytest.fixture(scope="module")
def skewed(spark):
    """One score holds more than half of all rows, one has a single row."""
    rng = random.Random(1)
    rows = []
    for score, n in ((1, 330), (2, 40), (3, 1), (4, 229), (None, 20)):
        for i in range(n):
            rows.append((score, i, 60 if rng.random() < 0.6 else 60 + rng.randrange(5), rng.choice([",", ".", None, None, ";"]), rng.choice([">", "<", None, None, None]), rng.choice([None, None, "<"]), rng.choice([1, 2, None]), "upper", (i * 17) // 40 * 40, 100_000 if i % 50 == 3 else 60, rng.choice([None, None, "pf"]), rng.choice([None, "_", None])))
    return spark.createDataFrame(rows, "score_id int, note_idx int, midi int, seg_mark string, strike_hand string, release_hand string, strike_digit int, staff string, onset_ms long, dur_ms long, soft string, damper string").cache()


def same(a, b, columns):
    a, b = (sorted(map(str, x.select("score_id", "note_idx", *columns).collect())) for x in (a, b))
    assert a == b and a


def test_ranges_give_the_windows_results(skewed):
    n, key = skewed, ("score_id",)
    same(ranges.with_prior(n, parts=PARTS), sequence.with_prior(n), ["prior_midi", "delta", "direction"])
    same(ranges.with_segments(n, parts=PARTS), sequence.with_segments(n), ["segment_idx"])
    same(ranges.with_handed_digits(n, parts=PARTS), fingering.with_handed_digits(n, keys=key), ["hand", "hsd"])
    same(ranges.with_pedals(n, parts=PARTS), fingering.with_pedals(n, keys=key), ["soft_state", "damper_state"])


def test_runs_tempo_and_sounding_in_ranges(skewed):
    n = skewed.where("score_id is not null")
    same(ranges.repeat_runs(n, parts=PARTS), sequence.repeat_runs(n), ["repeats_before", "repeats_after"])
    same(ranges.sounding_at_onset(n, parts=PARTS), sequence.sounding_at_onset(n), ["sounding_lower", "sounding_upper"])
    o = n.withColumn("offset", F.col("note_idx").cast("double"))
    marks = n.where("note_idx % 16 = 3").select("score_id", F.col("note_idx").cast("double").alias("start"), (60 + F.col("note_idx")).alias("bpm"))
    same(ranges.tempo_at(o, marks, parts=PARTS), sequence.tempo_at(o, marks), ["bpm", "onset_s"])


def test_ranges_are_even_and_short_ranges_are_looked_past(skewed):
    sizes = sorted(r["count"] for r in ranges.Ranges(skewed, parts=PARTS).rows.groupBy("_part").count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    few = skewed.where("score_id = 1 and note_idx < 9")  # fewer rows in a range than a window looks back
    same(ranges.Ranges(few, parts=PARTS).windowed(sequence.lattice_ngrams, 4, 4).result(), sequence.lattice_ngrams(few), ["x_m4", "x_p4", "y_p3"])
    nothing = skewed.where("score_id = 99")
    assert ranges.with_segments(nothing, parts=PARTS).count() == 0 and ranges.sounding_at_onset(nothing, parts=PARTS).count() == 0


@pytest.fixture(scope="module")
def layered(spark):
    notes = [(1, i, m, ">") for i, m in enumerate([64, 66, 61, 69, 64])] + [(2, i, m, "<") for i, m in enumerate([60, 60, 55])] + [(3, 0, 61, ">")] + [(4, i, m, ">") for i, m in enumerate([21, 108, 21])]
    return search.class_layers(spark.createDataFrame(notes, "score_id long, note_idx int, midi int, hand string"), "parncutt").cache()


def every_path(layered):
    """All allowed paths of each score by brute force: {score: sorted [(cost, digits)]}."""
    out = {}
    for r in layered.collect():
        m, n, got = r.layers, r.n, []
        for d in itertools.product(range(5), repeat=n):
            costs = [m[i][(d[i - 1] if i else 0) * 25 + d[i] * 5 + (d[i + 1] if i + 1 < n else 0)] for i in range(n)]
            if None not in costs:
                got.append((sum(costs), "".join(str(x + 1) for x in d)))
        out[r.score_id] = sorted(got)
    return out


def test_deep_paths_ranks_and_recall(spark, layered):
    want = every_path(layered)
    assert len(want[1]) > 200
    got = {}
    for r in search.deep_paths(layered, 5000).collect():
        got.setdefault(r.score_id, []).append((r["rank"], r.cost, r.digits))
    for score, paths in want.items():
        assert sorted(got[score]) == ([(i + 1, c, d) for i, (c, d) in enumerate(paths)] or [(0, None, None)])
    assert sorted(map(str, search.deep_paths(layered, 7).collect())) == sorted(map(str, search.k_best_paths(layered, 7).collect()))
    asked = [(1, i) for i in range(0, len(want[1]), 17)] + [(2, len(want[2]) - 1), (3, 0)]
    gold = spark.createDataFrame([(s, want[s][i][1]) for s, i in asked] + [(1, "1"), (2, None), (1, "66666"), (4, "111")], "score_id long, digits string")
    ranks = {(r.score_id, r.digits): r["rank"] for r in search.gold_rank(layered, gold).collect()}
    assert all(ranks[s, want[s][i][1]] == str(i + 1) for s, i in asked)
    assert ranks[1, "1"] is None and ranks[1, "66666"] is None and ranks[4, "111"] is None
    found = search.recall_paths(layered, gold).collect()
    last = Counter()
    for r in found:
        last[r.score_id] = max(last[r.score_id], r["rank"])
    assert last == {1: max(i for s, i in asked if s == 1) + 1, 2: len(want[2]), 3: 1}
    assert sum(r.is_gold for r in found) == len(asked)


@pytest.mark.parametrize("preset", ["parncutt", "badgerow", "balliauw", "jacobs"])
def test_class_tables_cost_what_candidates_cost(spark, preset):
    rng = random.Random(5)
    notes = [(s, i, rng.randrange(40, 80), "><"[s % 2]) for s in range(6) for i in range(rng.randrange(1, 9))]
    n = spark.createDataFrame(notes, "score_id long, note_idx int, midi int, hand string")
    old = search.layers(search.trigram_cost(search.playable(search.candidates(n, table=search.PRESETS[preset][1])), preset))
    a, b = (sorted(map(str, search.k_best_paths(x, 4).collect())) for x in (old, search.class_layers(n, preset)))
    assert a == b


def test_versions_share_a_search(spark):
    rng = random.Random(6)
    notes = [(s, i, rng.randrange(50, 75), ">") for s in range(4) for i in range(2 + s)]
    n = spark.createDataFrame(notes, "score_id long, note_idx int, midi int, hand string")
    got = search.versioned_paths(n, "parncutt", [("all", {}), ("-str", {"str": 0.0}), ("wea", {"wea": 3.5})], 3).collect()
    for name, weights in (("all", {}), ("-str", {"str": 0.0}), ("wea", {"wea": 3.5})):
        own = search.k_best_paths(search.class_layers(n, "parncutt", weights), 3).collect()
        assert sorted((r.score_id, r["rank"], r.digits, r.cost) for r in got if r.version == name) == sorted((r.score_id, r["rank"], r.digits, r.cost) for r in own)


def test_folds_are_the_total_less_their_own(spark):
    rng = random.Random(7)
    rows = [(s, i, s % 3, rng.choice(["x", "y", None]), rng.randrange(1, 6), rng.randrange(60, 64)) for s in range(9) for i in range(6)]
    df = spark.createDataFrame(rows, "score_id long, note_idx int, fold int, kind string, digit int, midi int")
    for r in folds.left_out_counts(df, ["kind"]).collect():
        assert list(r.counts) == [sum(1 for x in rows if x[2] != r.fold and x[3] == r.kind and x[4] == d) for d in range(1, 6)]
    got = folds.cross_validate_counts(df, ["kind"])
    assert got.count() == len(rows) and got.where("predicted not between 1 and 5").count() == 0
    report = {(r.fold, r.label): r for r in folds.fold_report(got).collect()}
    tagged = got.collect()
    for (fold, label), r in report.items():
        assert r.support == sum(x.fold == fold and x.truth == label for x in tagged) and r.predicted_n == sum(x.fold == fold and x.predicted == label for x in tagged)
    whole = search.transition_weights(df.where("fold != 1")).collect()
    own = folds.left_out_weights(df).where("fold = 1").collect()
    assert {(r.p, r.q, r.f, r.g): round(r.weight, 9) for r in whole} == {(r.p, r.q, r.f, r.g): round(r.weight, 9) for r in own}


def test_null_staffs_keep_their_own_rows(spark):
    pairs = spark.createDataFrame([("upper", 1, 1), (None, 2, 2), ("lower", 1, 2)], "staff string, one int, other int")
    table = agreement.confusion(pairs, [1, 2], keys=["staff"])
    n = pairs.groupBy("staff", "one", "other").agg(F.count("*").alias("n"))
    pooled = agreement.cohens_kappa(agreement.with_pooled(n), keys=["staff"]).where("staff = 'both'").first()
    assert pooled.n == 3 and table.count() > 0
    rows = spark.createDataFrame([(1, 0, "upper", 0), (1, 1, None, 0), (2, 0, "lower", 0)], "score_id int, note_idx int, staff string, fold int")
    got = {(r.staff, r.pooled): (r.examples, r.notes) for r in features.fold_counts(rows).collect()}
    assert got == {("upper", False): (1, 1), (None, False): (1, 1), ("lower", False): (1, 1), (None, True): (3, 3)}


def test_repeated_annotations_are_numbered_each(spark):
    a = spark.createDataFrame([(1, "12&3@4"), (1, "12&3@4"), (2, None), (3, "")], "id int, abcdf string")
    got = Counter((r.id, r.staff, r.note_idx) for r in fingering.explode_abcdf(a).collect())
    assert got == {(1, "upper", 0): 2, (1, "upper", 1): 2, (1, "upper", 2): 2, (1, "lower", 0): 2}


def test_alpha_by_a_table_of_distances(spark):
    rng = random.Random(8)
    rows = [(u, c, rng.randrange(1, 6)) for u in range(30) for c in range(3)]
    df = spark.createDataFrame(rows, "unit int, coder int, value int")
    table = spark.createDataFrame([(a, b, float((a - b) ** 2)) for a in range(1, 6) for b in range(1, a)], "a int, b int, d double")
    by_table, by_rule = agreement.krippendorff_alpha(df, table).first(), agreement.krippendorff_alpha(df, agreement.interval).first()
    assert round(by_table.alpha, 12) == round(by_rule.alpha, 12)
    nothing = agreement.krippendorff_alpha(df, table.where("a > 9"), missing=1.0).first()
    assert round(nothing.alpha, 12) == round(agreement.krippendorff_alpha(df).first().alpha, 12)
    assert agreement.distance_table(spark.createDataFrame([(1, 2, 3.0), (2, 1, 4.0), (1, 1, 9.0)], "a int, b int, d double")).count() == 2


def test_many_labels_need_a_table(spark, monkeypatch):
    monkeypatch.setattr(agreement, "MOST_LABELS", 3)
    df = spark.createDataFrame([(u, c, u % 5) for u in range(10) for c in range(2)], "unit int, coder int, value int")
    with pytest.raises(ValueError, match="labels"):
        agreement.krippendorff_alpha(df, lambda a, b: F.abs(a - b).cast("double"))


def test_songs_by_prints(spark):
    rows = [("p", a, i * 0.5 + (0.25 if a == "c" and i == 3 else 0), i * 0.5 + 0.4, i % 2) for a in "abcd" for i in range(6) if not (a == "d" and i == 5)]
    df = spark.createDataFrame(rows + rows[:3], "piece_id string, annot_id string, on_s double, off_s double, channel int")
    assert {(r.annot_id, r.song_id) for r in pig.group_same_song(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}


def test_database_counts_and_reads_in_parts(spark, tmp_path):
    database.attach(spark, "pianos", f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver")
    votes = spark.createDataFrame([(i % 5, str(i % 3), i) for i in range(60)] + [(9, "x", 60)], "exercise int, fingering string, id int")
    database.write_table(votes, "pianos", "APP", "VOTES")
    counted = database.vote_counts(spark, "pianos", "APP", least=2)
    plan = counted._jdf.queryExecution().toString()
    assert "PushedAggregates: [COUNT(*)]" in plan and "PushedGroupByExpressions: [EXERCISE, FINGERING]" in plan
    assert {(r.exercise, r.fingering): r.votes for r in counted.collect()} == {k: n for k, n in Counter((i % 5, str(i % 3)) for i in range(60)).items() if n > 1}
    parts = database.in_parts(spark, "pianos", "APP", "VOTES", column="ID", parts=4)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 61
    some = parts.where("EXERCISE = 3")
    assert "EqualTo(EXERCISE,3)" in some._jdf.queryExecution().toString() and some.count() == 12
    database.write_table(spark.createDataFrame([], votes.schema), "pianos", "APP", "EMPTY")
    assert database.in_parts(spark, "pianos", "APP", "EMPTY", column="ID").count() == 0


def test_sql_functions_are_the_columns(spark):
    names = sql.register(spark, prefix="t_")
    assert len(names) == len(sql.functions_of()) + 1
    rng = random.Random(9)
    rows = [(*[rng.randrange(50, 75) for _ in range(3)], *[rng.choice("<>")] * 3, *[rng.randrange(1, 6) for _ in range(3)]) for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(sql.TRIGRAM))
    plain = ", ".join(a.split(" ")[0] for a in sql.TRIGRAM)
    by_sql = spark.sql("SELECT " + ", ".join(f"t_rule_{t}({plain}) AS r_{t}" for t in RULES) + " FROM {df}", df=df)
    own = df.select(*[rule(sql.trigram()).alias(f"r_{t}") for t, rule in RULES.items()])
    assert [tuple(r) for r in by_sql.collect()] == [tuple(r) for r in own.collect()]
    text = by_sql._jdf.queryExecution().optimizedPlan().toString()
    assert "t_rule_" not in text.replace(" AS ", " ").split("Project", 1)[0] and "Join" not in text  # the bodies stand in the plan
    each = spark.sql(f"SELECT sum(cost) AS s FROM {{df}}, LATERAL t_rule_costs({plain})", df=df).first().s
    assert each == sum(float(x) for r in own.collect() for x in r)
    assert spark.sql("SELECT t_pitch_name(61) AS p, t_distance_semitone(60, 90) AS d, t_is_black_key(61) AS b").first() == ("C#4", 17, True)
