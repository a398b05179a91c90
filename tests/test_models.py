"""Published examples of the rule models, searches and measures."""

import itertools

import pytest
from pyspark.sql import Window, functions as F

from handspan.functions import dims, fingering, keys
from handspan.operators import agreement, ranking, search, sequence

FRAGMENTS = {
    "A": [76, 79, 77, 79, 76, 77, 74, 76], "B": [76, 73, 74, 78], "C": [64, 61, 64, 69, 64], "D": [61, 65, 63, 66, 65, 68, 66],
    "E": [81, 92, 93, 88, 89, 85, 86, 80], "F": [55, 58, 62, 58, 67, 62], "G": [90, 91, 90, 88, 90, 88, 86],
}
# Costs by rule of one fingering of each fragment, other rules 0.
COSTS = {
    ("A", "24342313"): {"sma": 1, "wea": 2, "3t4": 1}, ("C", "31251"): {"sma": 2, "wea": 1, "bl1": 5}, ("D", "2435132"): {"sma": 6, "wea": 2, "345": 1, "bl5": 2},
    ("E", "14523152"): {"sma": 6, "lar": 2, "wea": 3, "bl1": 5}, ("F", "124251"): {"str": 2, "sma": 2, "lar": 6, "wea": 2}, ("G", "3432321"): {"wea": 1, "3t4": 1},
}


def notes(spark, midi, digits=None, hand=">"):
    rows = [(1, i, m, int(digits[i]) if digits else None, hand) for i, m in enumerate(midi)]
    return spark.createDataFrame(rows, "score_id long, note_idx int, midi int, digit int, hand string")


@pytest.mark.parametrize("case", sorted(COSTS))
def test_rule_costs(spark, case):
    name, digits = case
    tags = ["str", "sma", "lar", "wea", "345", "3t4", "bl4", "bl1", "bl5", "pa1"]
    t = search.rule_costs(search.with_trigrams(notes(spark, FRAGMENTS[name], digits)), tags)
    got = t.agg(*[F.sum(f"r_{x}").alias(x) for x in tags]).first().asDict()
    assert got == {x: COSTS[case].get(x, 0) for x in tags}


def test_total_cost(spark):
    assert search.segment_cost(notes(spark, FRAGMENTS["A"], "24342313")).first().cost == 6


def test_thumb_on_black(spark):
    t = search.rule_costs(search.with_trigrams(notes(spark, [61, 65], "13")), ["bl1"])
    assert t.orderBy("note_idx").first().r_bl1 == 3


def test_path_count(spark):
    assert search.fingering_count(notes(spark, [69, 60, 69, 76])).first().paths == 320


def test_cyclic_search(spark):
    got = search.advise_cyclic(notes(spark, FRAGMENTS["B"]), "parncutt", 16).collect()
    assert len(got) == 16 and all(r.digits[0] == r.digits[-1] for r in got)


@pytest.mark.parametrize("midi, hand", [([60, 62, 64, 65], ">"), ([61, 66, 63], "<"), ([70, 70, 60, 75], ">")])
@pytest.mark.parametrize("preset", ["parncutt", "badgerow", "balliauw", "jacobs"])
def test_k_best_is_brute_force(spark, midi, hand, preset):
    n = notes(spark, midi, hand=hand)
    got = [(r.digits, round(r.cost, 6)) for r in search.advise(n, preset, 6, mode="none").orderBy("rank").collect()]
    every = ["".join(p) for p in itertools.product("12345", repeat=len(midi))]
    ok = [p for p in every if all((a == b) == (x == y) for (a, b), (x, y) in zip(itertools.pairwise(midi), itertools.pairwise(p), strict=True))]
    rows = [(k, i, m, int(p[i]), hand) for k, p in enumerate(ok) for i, m in enumerate(midi)]
    df = spark.createDataFrame(rows, "score_id long, note_idx int, midi int, digit int, hand string")
    costs = {r.score_id: r.cost for r in search.segment_cost(df, preset).collect()}
    best = sorted((round(c, 6), ok[k]) for k, c in costs.items())[:6]
    assert got == [(p, c) for c, p in best]


def test_lone_and_fixed_notes(spark):
    one = lambda m, **o: search.advise(notes(spark, [m]), k=3, **o).collect()
    assert [r.digits for r in one(60)] == ["1"] and [r.digits for r in one(61)] == ["2"] and [r.digits for r in one(61, last=3)] == ["3"]
    two = search.advise(notes(spark, [60, 64]), k=5, first=2, last=4).collect()
    assert [r.digits for r in two] == ["24"]


def test_rulers(spark):
    d = spark.range(1).select(keys.distance_physical(F.lit(60), F.lit(64)), keys.distance_physical(F.lit(64), F.lit(67)), keys.distance_physical(F.lit(64), F.lit(60)), keys.distance_imaginary(F.lit(64), F.lit(65))).first()
    assert d[0] == d[1] == -d[2] and d[3] == 2


def test_distances_between_hands(spark):
    pair = lambda m, a, b: dims.edit_distance(m, F.lit(a[0]), F.lit(int(a[1])), F.lit(b[0]), F.lit(int(b[1])))
    got = spark.range(1).select(pair("pivot", "<5", "<1"), pair("pivot", "<5", ">1"), pair("pivot", "<1", ">1"), pair("natural", "<5", ">5"), pair("pivot", ">2", ">1"), pair("hamming", "<1", ">1")).first()
    assert tuple(got) == (7, 14, 10, 9, 4, 1)


def test_tokens(spark):
    a = spark.createDataFrame([(1, ">1<2(34)3-14-2/5-1;>1p5_.xx@x")], "score_id long, abcdf string")
    got = fingering.explode_abcdf(a).where("staff = 'upper'").orderBy("note_idx").collect()
    assert [r.token for r in got] == [">1", "<2", "(34)", "3-1", "4-2/5-1;", ">1", "p5_.", "x", "x"]
    assert (got[2].strike_digit, got[2].is_ornament, got[3].release_digit, got[4].alt, got[4].seg_mark, got[6].soft, got[6].damper) == (3, True, 1, "5-1", ";", "p", "_")


def test_hand_is_carried(spark):
    a = spark.createDataFrame([(1, "123<12341@>54321321")], "score_id long, abcdf string")
    got = fingering.with_handed_digits(fingering.explode_abcdf(a), keys=["score_id", "staff"])
    text = {r.staff: r.h for r in got.groupBy("staff").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "hsd"))), lambda s: s["hsd"]), "").alias("h")).collect()}
    assert text == {"upper": ">1>2>3<1<2<3<4<1", "lower": ">5>4>3>2>1>3>2>1"}


def test_alpha_of_published_matrix(spark):
    m = ["1 2 3 3 2 1 4 1 2 . . .", "1 2 3 3 2 2 4 1 2 5 . 3", ". 3 3 3 2 3 4 2 2 5 1 .", "1 2 3 3 2 4 4 1 2 5 1 ."]
    rows = [(i, c, int(v) if v != "." else None) for c, line in enumerate(m) for i, v in enumerate(line.split())]
    assert round(agreement.krippendorff_alpha(spark.createDataFrame(rows, "unit int, coder int, value int")).first().alpha, 3) == 0.743


def test_overlap_of_rankings(spark):
    arr = lambda s: F.array(*[F.array(F.lit(c)) for c in s])
    a, b = arr("abcde"), arr("abdcf")
    got = spark.range(1).select(*[ranking.agreement(a, b, F.lit(k)) for k in (1, 3, 4, 5)]).first()
    assert [round(x, 3) for x in got] == [1.0, 0.667, 1.0, 0.8]
    a, b = arr("abcdefg"), arr("zcavwxy")
    assert [round(x, 3) for x in spark.range(1).select(*[ranking.average_overlap(a, b, F.lit(k)) for k in (3, 5, 7)]).first()] == [0.222, 0.313, 0.312]
    same = spark.range(1).select(ranking.rbo_min(a, a, 0.9), ranking.rbo_res(a, a, 0.9), ranking.rbo_ext(a, arr("bacdefg"), 0.9)).first()
    assert [round(x, 3) for x in same] == [0.767, 0.233, 0.9]


def test_wildcard_rank(spark):
    gold = ["12345", "1xx4x", "x234x", "12345"]
    rows = [(1, r, i, g, int(c) if c != "x" else None, i + 1, True) for r in range(1, 11) for g, s in enumerate(gold) for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "score_id long, rank int, note_idx int, g int, gold int, tip int, same_hand boolean")
    p = ranking.wildcard_rank_prob(ranking.pair_marks(df, keys=("score_id", "rank", "g")), "match")
    assert round(ranking.expected_reciprocal_rank(p).first().err, 5) == 0.86305


def test_certain_rank_ends_the_cascade(spark):
    p = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (1, 3, 0.5)], "score_id long, rank int, p double")
    assert ranking.expected_reciprocal_rank(p).first().err == 1.0


def test_strike_reentry(spark):
    n = notes(spark, FRAGMENTS["G"], "3432321")
    best = search.advise(n, "parncutt", 1).first().digits
    own = n.withColumn("digit", F.element_at(F.split(F.lit(best), ""), F.col("note_idx") + 1).cast("int"))
    assert search.strike_reentry(own).first().corrections == 0
    other = search.strike_reentry(notes(spark, FRAGMENTS["G"], "5432154")).first()
    assert other.corrections > 0 and other.distance == other.corrections


def test_ablation(spark):
    n = notes(spark, [60, 62, 64])
    got = search.rule_ablation(n, "parncutt", 1, lambda s: s.where("rank = 1").select("version", "score_id", F.col("cost").alias("v")))
    assert got.count() == 13 and got.where("version = 'all'").first().loss == 0


def test_viterbi_is_brute_force(spark):
    e = [(1, i, lab, ((i * 7 + lab * 3) % 5) / 2) for i in range(4) for lab in range(1, 6)]
    t = {(a, b): ((a * 2 + b) % 4) / 3 for a in range(1, 6) for b in range(1, 6)}
    em = spark.createDataFrame(e, "score_id long, note_idx int, label int, score double")
    tr = spark.createDataFrame([(*k, v) for k, v in t.items()], "prev int, cur int, score double")
    score = lambda p: sum(x[3] for i, d in enumerate(p) for x in e if x[1] == i and x[2] == d) + sum(t[a, b] for a, b in itertools.pairwise(p))
    assert round(search.viterbi_decode(em, tr).first().score, 9) == round(max(map(score, itertools.product(range(1, 6), repeat=4))), 9)


def test_ngrams_reach_past_both_ends(spark):
    n = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "score_id long, note_idx int, hsd string")
    assert [r.ngram for r in sequence.ngram_labels(n, 3).orderBy("ngram_idx").collect()] == ["xxa", "xab", "abx", "bxx"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bad_fingers_take_no_row_of_each_candidate(spark):
    n = notes(spark, [60, 61, 61, 67]).unionAll(notes(spark, [64]).withColumn("score_id", F.lit(2).cast("long")))
    bad = search.bad_fingers(n)
    assert "sequence(0, 124" not in _plan(bad)
    got = {(r.score_id, r.note_idx, r.position) for r in bad.collect()}
    assert got == {(2, 0, 0)} | {(1, i, p) for i in range(4) for p in (-1, 0, 1) if 0 <= i + p < 4}
    trigrams = search.trigram_cost(search.candidates(n, mode="none").where("(m1 is null or d1 <> d2) and (m3 is null or d2 <> d3)"))
    best = trigrams.withColumn("least", F.min("cost").over(Window.partitionBy("score_id", "note_idx"))).where("cost = least").collect()
    for r in bad.collect():
        used = {b[f"d{r.position + 2}"] for b in best if (b.score_id, b.note_idx) == (r.score_id, r.note_idx)}
        assert r.bad == sorted({1, 2, 3, 4, 5} - used)


def _brute(costs, k):
    """The k cheapest paths of a segment's 125 costs, by cost and digits; for rings of those only that end as they begin."""
    found = []
    n = len(costs)
    for d in itertools.product(range(5), repeat=n):
        of = [costs[i][(d[i - 1] if i else 0) * 25 + d[i] * 5 + (d[i + 1] if i + 1 < n else 0)] for i in range(n)]
        if None not in of:
            found.append((sum(of), "".join(str(x + 1) for x in d)))
    return sorted(found)


@pytest.mark.parametrize("k", [1, 3, 7])
def test_fold_of_batches(k):
    """Segments of all lengths in one batch, equal costs, notes that nothing is allowed for, empty and null segments."""
    import random

    import pyarrow as pa

    from handspan.operators import paths

    r = random.Random(k)
    segments = [[[r.choice([None, 0.0, 1.0, 2.0, 3.0]) for _ in range(125)] for _ in range(n)] for n in (3, 1, 5, 2, 4, 3, 1, 2)]
    segments += [[[0.0] * 125] * 4, [[None] * 125, [1.0] * 125], [], None]
    column = pa.array(segments, pa.list_(pa.list_(pa.float64())))
    for ring in (False, True):
        got = {i: [] for i in range(len(segments))}
        for who, ranks, digits, costs in paths.best_rows(column, None, None, k, ring):
            for i, rank, d, c in zip(who, ranks, digits.to_pylist(), [None] * len(who) if costs is None else costs, strict=True):
                got[i].append((rank, d, c))
        for i, s in enumerate(segments):
            want = [x for x in (_brute(s, k) if s else []) if not ring or x[1][0] == x[1][-1]][:k]
            assert sorted(got[i]) == [(j + 1, d, c) for j, (c, d) in enumerate(want)] or (not want and got[i] == [(0, None, None)])


def test_fold_of_long_segments():
    """Orders are numbered anew on the way: on equal costs the first strings in order come, at any length."""
    import pyarrow as pa

    from handspan.operators import paths

    n = 3 * paths.RENUMBER + 5
    (_, ranks, digits, _), *rest = paths.best_rows(pa.array([[[0.0] * 125] * n], pa.list_(pa.list_(pa.float64()))), None, None, 6)
    assert not rest and list(ranks) == [1, 2, 3, 4, 5, 6]
    assert digits.to_pylist() == ["1" * (n - 2) + x for x in ("11", "12", "13", "14", "15", "21")]


@pytest.mark.parametrize("search_of", [
    lambda n: search.table_advise(n, n.sparkSession.sql("select 0 as low_color, 0 as high_color, 1 as low_finger, 2 as high_finger, 2 as semitones, 1 as cost")),
    lambda n: search.trained_advise(n, n.sparkSession.sql("select 60 as p, 62 as q, 1 as f, 3 as g, 0.5D as weight")),
    lambda n: search.advise_cyclic(n, "parncutt", 2),
    lambda n: search.rule_ablation(n, "parncutt", 1, lambda s: s.withColumn("v", F.col("cost")), k=1),
    lambda n: search.viterbi_decode(n.selectExpr("score_id", "note_idx", "explode(sequence(1, 5)) as label", "1D as score"), n.sparkSession.sql("select 1 as prev, 2 as cur, 1D as score")),
])
def test_searches_fold_batches(spark, search_of):
    """All searches hand their gathered notes to the fold of batches, once."""
    n = notes(spark, [60, 62, 64])
    assert search_of(n).count()
    seen = []
    best_of, versions_of = search._best_of, search._versions_of
    keep = lambda f: lambda gathered, *a, **o: seen.append(gathered.columns) or f(gathered, *a, **o)
    search._best_of, search._versions_of = keep(best_of), keep(versions_of)
    try:
        search_of(n)
    finally:
        search._best_of, search._versions_of = best_of, versions_of
    assert len(seen) == 1 and "notes" in seen[0]


def test_deep_searches_take_costs_by_reach(spark):
    n = notes(spark, [60, 62, 64, 61])
    costs, layered = search.class_costs(n, "parncutt"), search.class_layers(n, "parncutt")
    gold = search.k_best_paths(costs, 9).where("rank in (4, 9)").select("score_id", "digits")
    rows = lambda df: sorted(map(str, df.collect()))
    for deep in (lambda x: search.deep_paths(x, 20), lambda x: search.recall_paths(x, gold), lambda x: search.gold_rank(x, gold)):
        assert rows(deep(costs)) == rows(deep(layered))
