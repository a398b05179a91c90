"""Searches that find nothing, corrections one after the other, spans of the left hand, strings outside the grammar."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from handspan.functions import dims, fingering
from handspan.operators import corpus, features, ranking, search, stats


def notes(spark, sequences):
    """sequences: {score: (midi, digits, hand)}."""
    rows = [(s, i, m, d, hand) for s, (midi, digits, hand) in sequences.items() for i, (m, d) in enumerate(zip(midi, digits, strict=True))]
    return spark.createDataFrame(rows, "score_id long, note_idx int, midi int, digit int, hand string")


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(2)
    out = {}
    for s in range(14):
        n, m, midi = rng.randrange(1, 6), 60, []
        for _ in range(n):
            m += rng.choice([-3, -2, -1, 0, 1, 2, 3, 5])
            midi.append(m)
        out[s] = (midi, [rng.randrange(1, 6) for _ in midi], "><"[s % 2])
    out[20] = ([40, 90, 60], [1, 2, 3], ">")  # no hand reaches that far
    out[21] = ([60, 62, 40, 90], [1, 2, 3, 4], ">")
    return out


def test_unplayable_phrases_have_a_row(spark, phrases):
    got = {}
    for r in search.advise(notes(spark, phrases), "parncutt", 3).collect():
        got.setdefault(r.score_id, []).append((r.rank, r.digits, r.cost))
    assert set(got) == set(phrases)
    assert got[20] == [(0, None, None)] and got[21] == [(0, None, None)]
    with pytest.raises(Exception, match="no fingering for 20"):
        search.advise(notes(spark, {20: phrases[20]}), "parncutt", 3, unplayable="error").collect()
    cyclic = {r.score_id for r in search.advise_cyclic(notes(spark, phrases), "parncutt", 2).collect()}
    assert cyclic == set(phrases)


@pytest.mark.parametrize("method", ["hamming", "pivot"])
def test_corrections_are_those_of_searches_one_after_the_other(spark, phrases, method):
    got = {r.score_id: (r.corrections, r.distance, r.playable) for r in search.strike_reentry(notes(spark, phrases), method=method).collect()}
    far = lambda a, b: int(a != b) if method == "hamming" else abs(a - b) + 3 * ((a == 1) != (b == 1))
    # the best fingering of every rest of a phrase that begins with gold's finger, and of the whole (at -1)
    rows = [(100 * s + at, i, m, hand, None if at < 0 else gold[at]) for s, (midi, gold, hand) in phrases.items() for at in range(-1, len(midi)) for i, m in enumerate(midi[max(at, 0) :])]
    df = spark.createDataFrame(rows, "score_id long, note_idx int, midi int, hand string, fix int")
    costed = search.trigram_cost(search.candidates(df, first=F.col("fix")), "parncutt")
    best = {r.score_id: r.digits for r in search.k_best_paths(search.layers(costed), 1).collect()}
    for s, (midi, gold, hand) in phrases.items():
        at, corrections, distance, playable = -1, 0, 0, True
        while at < len(midi) - 1 or at < 0:
            tips = best[100 * s + at] if len(midi) > 1 else str(2 if midi[0] % 12 in (1, 3, 6, 8, 10) else 1)
            if tips is None:
                playable = False
                break
            start = max(at, 0)
            wrong = next((i for i, (x, g) in enumerate(zip(tips, gold[start:], strict=True)) if int(x) != g), None)
            if wrong is None:
                break
            corrections, distance = corrections + 1, distance + far(gold[start + wrong], int(tips[wrong]))
            at = start + wrong
        assert got[s] == (corrections, distance, playable), s


def test_details_add_up(spark, phrases):
    n = notes(spark, phrases)
    best = search.advise(n, "badgerow", 2)
    cost = {(r.score_id, r.rank): r.cost for r in best.collect() if r.rank and len(r.digits) > 1}
    rows = search.suggestion_details(best, n, "badgerow")
    sums = {(r.score_id, r.rank): r.c for r in rows.groupBy("score_id", "rank").agg(F.sum("cost").alias("c")).collect()}
    assert all(sums[k] == c for k, c in cost.items())
    assert rows.where(F.aggregate(F.map_values("detail"), F.lit(0.0), lambda a, x: a + x) != F.col("cost")).count() == 0


def test_left_hand_spans_of_one_model_are_its_own(spark):
    s = {(r.table, r.hd1, r.hd2): r for r in dims.finger_spans(spark).collect()}
    assert len(s) == 250
    assert (s["badgerow", "<4", "<1"].min_rel, s["badgerow", ">1", ">4"].min_rel, s["badgerow", "<1", "<4"].max_rel) == (3, 2, -3)
    assert (s["badgerow", "<3", "<2"].max_comf, s["badgerow", ">2", ">3"].max_comf, s["badgerow", "<2", "<3"].min_comf) == (3, 2, -3)
    for (t, a, b), r in s.items():
        if t != "badgerow" and a[0] == ">":
            assert tuple(r)[3:] == tuple(s[t, "<" + b[1], "<" + a[1]])[3:]
    on = notes(spark, {1: ([60, 62], [4, 1], "<")})
    got = on.agg(dims.span("badgerow", "min_rel", F.lit("<"), F.lit(4), F.lit(1)).alias("x")).first().x
    assert got == 3


def test_text_that_is_no_fingering_is_told(spark):
    a = spark.createDataFrame([(1, "12?3@")], "score_id long, abcdf string")
    with pytest.raises(Exception, match="not a fingering: \\?"):
        fingering.explode_abcdf(a).collect()
    assert fingering.explode_abcdf(a, strict=False).count() == 3
    b = spark.createDataFrame([(1, "1 (2<34) 5\n@x")], "score_id long, abcdf string")
    got = [(r.note_idx, r.ornament) for r in fingering.explode_abcdf(b).where("staff = 'upper'").orderBy("note_idx").collect()]
    assert got == [(0, None), (1, ["2", "<3", "4"]), (2, None)]


def test_marks_that_repeat_are_dropped(spark):
    given = {">1>2<3<4>5": ">12<34>5", "1>2>3@>4>5": "1>23@>45", "<<1": "<1", "": "", "123": "123", ">1@>2": ">1@>2"}
    d = spark.createDataFrame(list(given.items()), "t string, want string")
    assert d.where(fingering.simplify_abcdf("t") != F.col("want")).count() == 0


@pytest.mark.parametrize("mode", ["raw", "norm", "rank"])
def test_best_sequences_of_segments(spark, mode):
    rng = random.Random(6)
    rows = [(1, s, r, "".join(rng.choice("12345") for _ in range(1 + s)), float(rng.randrange(5))) for s in range(3) for r in range(1, 4)]
    got = [(r.fingering, round(r.cost, 9)) for r in corpus.combine_segments(spark.createDataFrame(rows, "score_id long, segment_idx int, rank int, fingering string, cost double"), 5, mode=mode).orderBy("rank").collect()]
    value = lambda x: {"raw": x[4], "norm": x[4] / len(x[3]), "rank": float(x[2])}[mode]
    per = [[x for x in rows if x[1] == s] for s in range(3)]
    want = sorted((round(sum(map(value, c)), 9), "".join(x[3] for x in c)) for c in itertools.product(*per))[:5]
    assert [(c, f) for f, c in got] == want


def test_groups_are_dealt_by_size(spark):
    rows = [(g, k) for g in range(23) for k in range(1 + g % 4)]
    got = {(r.score_id, r.fold) for r in features.group_kfold(spark.createDataFrame(rows, "score_id long, k int").repartition(5), 3).collect()}
    order = sorted(range(23), key=lambda g: (-(1 + g % 4), g))
    assert got == {(g, [0, 1, 2, 2, 1, 0][i % 6]) for i, g in enumerate(order)}


def test_precision_down_to_the_last_relevant(spark):
    g = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 0, 2), (1, 3, 1, 2), (1, 4, 0, 2), (2, 1, 1, 3), (2, 2, 0, 3)], "score_id long, rank int, hit int, relevant long")
    got = {r.score_id: r.ap for r in ranking.average_precision_at_recall(g).collect()}
    assert got[1] == pytest.approx((1 + 2 / 3) / 2) and got[2] is None
    assert tuple(ranking.mean_average_precision(ranking.average_precision_at_recall(g)).first()) == (pytest.approx(5 / 6), 1)


def test_feature_settings_and_validation(spark):
    rng = random.Random(1)
    rows = [(s, i, 60 + rng.randrange(12), 500 * i, 400, 64, "upper") for s in range(6) for i in range(12)]
    n = spark.createDataFrame(rows, "score_id long, note_idx int, midi int, onset_ms long, dur_ms int, velocity int, staff string")
    got = features.features_by_settings(n, velocity=True)
    assert got.count() == len(rows) and "velocity" in got.columns
    back = features.reverse_sequences(n).where("score_id = 0").orderBy("note_idx")
    assert [r.onset_ms for r in back.collect()] == [500 * i for i in range(11, -1, -1)]
    labelled = features.features(n, 3).withColumn("digit", F.when(F.col("black"), 2).otherwise(1 + F.col("midi") % 2))
    cv = features.cross_validate(labelled, ["black", "x_m1"], 3)
    assert [r.notes for r in cv.orderBy("fold").collect()] == [24] * 3 and cv.agg(F.min("rate")).first()[0] > 0.4
    tuned = features.tune(labelled, ["black", "x_m1"], [0.01, 10.0], 2)
    assert [r for r, _ in tuned][0] == 0.01 and len(tuned) == 2


def test_chances_are_those_of_the_distributions(spark):
    cases = [(0.0, 3, 20), (0.38, 4, 995), (2.5, 1, 1), (7.3, 9, 40), (1.01, 200, 5000), (900.0, 2, 3)]
    d = spark.createDataFrame([(f, float(a), float(b)) for f, a, b in cases], "f double, a double, b double")
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for r in d.select("*", stats.f_test_p(F.col("f"), F.col("a"), F.col("b")).alias("p"), stats.t_test_p(F.col("f"), F.col("b")).alias("q"), stats.ln_gamma(F.col("b")).alias("g")).collect():
        assert r.p == pytest.approx(1 - jvm.FDistribution(r.a, r.b).cumulativeProbability(r.f), abs=1e-9)
        assert r.q == pytest.approx(2 * (1 - jvm.TDistribution(r.b).cumulativeProbability(r.f)), abs=1e-9)
        assert r.g == pytest.approx(math.lgamma(r.b), rel=1e-12)


def test_functions_of_the_callers(spark):
    rows = [(1, 1, i, 60 + i, a, b, True, ">", ">") for i, (a, b) in enumerate([(1, 1), (2, 3), (3, 3), (4, 1)])]
    p = spark.createDataFrame(rows, "score_id long, rank int, note_idx int, midi int, one int, other int, same_hand boolean, one_hand string, other_hand string")
    named = ranking.trigram_big_delta(p, tau="nuanced").first()
    own = ranking.trigram_big_delta(p, tau=lambda equal, similar, relaxed: F.when(equal, 0.0).when(similar, 0.01).otherwise(1.0), proxy=lambda one, other, midi: F.array_sort(F.array(one, other)) == F.array(F.lit(2), F.lit(3))).first()
    assert named.tri_delta == pytest.approx(own.tri_delta) and named.tri_delta == pytest.approx(0.01 + 5 - 1 + 0.0)
    marks = spark.createDataFrame([(1, 1, 4, 3, 0), (1, 1, 4, 4, 0)], "score_id long, rank int, n int, matches int, wild int")
    assert ranking.user_prob(marks, lambda c: (c["matches"].cast("double"), c["n"].cast("double"))).first().p == 7 / 8
    n = spark.createDataFrame([(1, 0, 60), (1, 1, 62)], "score_id long, note_idx int, midi int")
    off = dict.fromkeys(("chording", "black", "leap", "velocity", "tempo", "articulation", "repeats"), False)
    got = features.features_by_settings(n, **off, builders=[lambda d: (d.withColumn("high", F.col("midi") > 61), ["high"])])
    assert sorted(r.high for r in got.collect()) == [False, True]


def test_every_measure_of_one_pass_is_that_of_its_own(spark):
    rng = random.Random(9)
    rows = [(s, r, i, rng.randrange(48, 72), rng.randrange(1, 6), rng.randrange(1, 6), rng.random() > 0.1, ">", rng.choice("><")) for s in range(4) for r in range(1, 4) for i in range(1 + s * 2)]
    p = spark.createDataFrame(rows, "score_id long, rank int, note_idx int, midi int, one int, other int, same_hand boolean, one_hand string, other_hand string").withColumn("same_hand", F.col("one_hand") == F.col("other_hand"))
    got = {(r.score_id, r.rank): r for r in ranking.rank_measures(p).collect()}
    for mark, decay in (("", "none"), ("_u", "uniform")):
        for d in ("hmg", "al"):
            assert all(got[r.score_id, r.rank][d + mark] == pytest.approx(r.normalized) for r in ranking.big_delta(p, delta=d, decay=decay).collect())
        assert all(got[r.score_id, r.rank]["rho" + mark] == pytest.approx(r.rho) for r in ranking.pivot_clashes(p, decay=decay).collect())
        for t, tau in (("tri", "trigram"), ("nua", "nuanced"), ("rlx", "relaxed")):
            assert all(got[r.score_id, r.rank][t + mark] == pytest.approx(r.tri_normalized) for r in ranking.trigram_big_delta(p, tau=tau, decay=decay).collect())
