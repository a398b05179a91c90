"""What a task holds doesn't grow with the tables: no joins where one sort serves, and parts by rows."""

import pytest
from pyspark.sql import functions as F

from handspan.operators import agreement, search, sequence
from handspan.plans import binding
from handspan.plans.registry import QUERIES
from handspan.sources import pig


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_follow_rows(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    monkeypatch.setattr(binding, "PART_ROWS", 100)
    assert binding.bound_notes(spark, sf_dir).rdd.getNumPartitions() == -(-rows // 100)


@pytest.mark.parametrize("distance", [agreement.nominal, lambda a, b: F.abs(a - b).cast("double")])
def test_alpha_joins_no_units(spark, distance):
    rows = [(1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "b", 3), (2, "c", 1), (3, "a", 5), (None, "a", 1), (None, "b", 4)]
    df = spark.createDataFrame(rows, "unit int, coder string, value int")
    got = agreement.krippendorff_alpha(df, distance)
    assert "Join Inner, (" not in _plan(got)  # totals and labels meet by no key
    first = got.first()
    assert first.pairable == pytest.approx(5)  # units 1 and 2; one value is no pair, and rows without a unit don't count
    assert first.observed == pytest.approx({True: (2 * 1 + 2 * 2 / 2) / 5, False: (2 * 1 + 2 * 2 * 2 / 2) / 5}[distance is agreement.nominal])


def test_ngrams_by_one_window(spark):
    rows = [(s, i, chr(97 + i) if i != 2 else None) for s, n in ((1, 1), (2, 4)) for i in range(n)]
    got = sequence.ngram_labels(spark.createDataFrame(rows, "score_id int, note_idx int, l string"), 3, label="l")
    assert _plan(got).count("Window [") == 1
    want = {1: ["xxa", "xax", "axx"], 2: ["xxa", "xab", "abx", "bxd", "xdx", "dxx"]}
    assert {s: [r.ngram for r in got.where(f"score_id = {s}").orderBy("ngram_idx").collect()] for s in want} == want
    assert [r.ngram_idx for r in got.where("score_id = 2").orderBy("ngram_idx").collect()] == list(range(6))


def test_reentry_folds_batches_of_segments(spark):
    """Costs go by reach to a fold of Arrow batches; segments of many lengths have the rows that they have alone."""
    pitches = [60, 62, 64, 65, 67, 69, 71, 72, 84, 36]
    rows = [(s, i, pitches[(s * 3 + i) % 10], ">" if s % 2 else "<", (s + i) % 5 + 1 if (s + i) % 4 else None) for s in range(8) for i in range(s + 1)]
    df = spark.createDataFrame(rows, "score_id int, note_idx int, midi int, hand string, digit int")
    got = search.strike_reentry(df, method="pivot")
    assert "MapInArrow" in _plan(got) and "lambdafunction(CASE" not in _plan(got)
    together = sorted(map(tuple, got.collect()))
    assert [r[0] for r in together] == list(range(8)) and any(r[1] for r in together) and {r[3] for r in together} == {True, False}
    assert together[5:] == sorted(tuple(r) for s in (5, 6, 7) for r in search.strike_reentry(df.where(f"score_id = {s}"), method="pivot").collect())


def test_same_song_exchanges_events_once(spark):
    """Annotations are compared by the sets that share events: no join has the events themselves."""
    rows = [("p", a, 0, t / 10, t / 10 + 0.05) for a in "abc" for t in range(6) if (a, t) != ("c", 5)] + [("p", "c", 0, 0.7, 0.75), ("p", "a", 0, 0.0, 0.05), ("q", None, 1, 0.0, 1.0), (None, "a", 1, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "piece_id string, annot_id string, channel int, on_s double, off_s double")
    got = pig.group_same_song(df)
    assert "tick" not in "".join(line for line in _plan(got).splitlines() if "Join" in line)
    assert {tuple(r) for r in got.collect()} == {("p", "a", "a"), ("p", "b", "a"), ("p", "c", "c"), ("q", None, None), (None, "a", "a")}


def test_evaluate_model_takes_annotators_from_one_pass(spark, sf_dir):
    joined = [line for line in _plan(QUERIES["evaluate_model"](spark, sf_dir)).splitlines() if "Join Inner, " in line]
    assert len(joined) == 3  # annotations with notes, with suggestions, and with sizes
