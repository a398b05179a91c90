"""Registered queries over phrases against brute force, on a small event table with one-note phrases."""

import datetime
import itertools

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from handspan.plans.registry import QUERIES

KINDS = {1: "click", 2: "view", 3: "purchase", 4: "signup", 5: "error"}


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Every event of an id that 8 divides ends a phrase: score 1 has lone notes and a phrase of seven, score 2 others."""
    ids = {1: [8, 16, 24, 32, 40, 48, 56, 64, 72, 80, 1, 2, 3, 4, 5, 6, 88, 96], 2: [104, 112, 9, 10, 120, 11, 12, 13]}
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), s, KINDS[1 + (i * 3 + i // 5) % 5], float(i * 5 % 49)) for s, own in ids.items() for i, k in enumerate(own)]
    folder = tmp_path_factory.mktemp("events")
    names = ["event_id", "ts", "user_id", "event_type", "value"]
    pq.write_table(pa.table({n: pa.array(c, pa.timestamp("us") if n == "ts" else None) for n, c in zip(names, zip(*rows), strict=True)}), folder / "events.parquet")
    return str(folder)


def phrases(spark, events):
    """{(score, phrase): its notes} by the rule of the event table."""
    from handspan.plans.binding import bound_notes

    out, segment = {}, {}
    for r in bound_notes(spark, events).orderBy("score_id", "note_idx").collect():
        own = segment.setdefault(r.score_id, 0)
        out.setdefault((r.score_id, own), []).append(r)
        segment[r.score_id] = own + (r.event_id % 8 == 0)
    return out


def test_evaluate_model_takes_lone_notes(spark, events):
    notes = phrases(spark, events)
    tips = {}
    for r in QUERIES["advise_parncutt"](spark, events).orderBy("rank").collect():
        tips.setdefault((r.score_id, r.segment_idx), []).append(r.digits)
    got = {(r.score_id, r.segment_idx, r.annot_id): r for r in QUERIES["evaluate_model"](spark, events).collect()}
    assert set(got) == {(*k, a) for k in notes for a in "12"}
    lone = set()
    for k, own in notes.items():
        for a in "12":
            gold, r = [n.digit if a == "1" else n.digit_b for n in own], got[*k, a]
            err, left = 0.0, 1.0
            for rank, t in enumerate(tips[k], 1):
                p = sum(int(x) == g for x, g in zip(t, gold, strict=True)) / len(gold)
                err, left = err + p * left / rank, left * (1 - p)
            assert r.notes == len(own) and r.hmg == pytest.approx(err, abs=1e-6)
            if len(own) == 1:
                tip = 2 if own[0].midi % 12 in (1, 3, 6, 8, 10) else 1
                near = {tip, gold[0]} in ({2, 3}, {3, 4})
                want = (1.0, 1.0, 1.0) if tip == gold[0] else (0.0, 0.99, 0.5) if near else (0.0, 0.0, 0.0)
                assert (r.hmg, r.tri_clvrst, r.clvrst) == want
                lone.add(want)
    assert len(lone) == 3


def test_best_combined_segments(spark, events):
    own = {}
    for (score, segment), notes in phrases(spark, events).items():
        cheapest = own.setdefault(score, {}).setdefault(segment, {})
        for n in notes:
            cheapest[str(n.digit)] = min(cheapest.get(str(n.digit), n.dur_ms), n.dur_ms)
    want = []
    for score, segments in own.items():
        every = sorted((float(sum(c for _, c in p)), "".join(f for f, _ in p)) for p in itertools.product(*[segments[s].items() for s in sorted(segments)]))
        want += [(score, r, f, c) for r, (c, f) in enumerate(every[:4], 1)]
    assert len(want) == 8
    assert sorted(map(tuple, QUERIES["combine_segments_best"](spark, events).collect())) == sorted(want)


def test_tag_scores_gives_match_rates(spark, sf_dir, monkeypatch):
    """Against rates counted from the notes that the tagger tagged."""
    from handspan.operators import features

    tagged, tag = [], features.tag

    def keep(model, rows):
        tagged.append(tag(model, rows))
        return tagged[-1]

    monkeypatch.setattr(features, "tag", keep)
    got = {r.score_id: (r.notes, r.matches, r.rate) for r in QUERIES["tag_scores"](spark, sf_dir).collect()}
    own = {}
    for r in tagged[0].select("score_id", "predicted", "digit").collect():
        own.setdefault(r.score_id, []).append(r.predicted == r.digit)
    assert got == {s: (len(x), sum(x), round(sum(x) / len(x), 6)) for s, x in own.items()}
    assert 0 < sum(m for _, m, _ in got.values()) < sum(n for n, _, _ in got.values())


def test_recall_reaches_gold_past_rank_200(spark):
    from pyspark.sql import functions as F

    from handspan.operators import search

    midi = {1: [69, 60, 69, 76], 2: [69, 60, 69, 76], 3: [60, 64, 64], 4: [60, 62]}
    n = spark.createDataFrame([(s, i, m, ">") for s, own in midi.items() for i, m in enumerate(own)], "score_id long, note_idx int, midi int, hand string")
    every = {s: [r.digits for r in search.advise(n.where(F.col("score_id") == s), k=1000, mode="none").orderBy("rank").collect()] for s in midi}
    assert len(every[1]) == 320 and "123" not in every[3]
    gold = spark.createDataFrame([(1, every[1][249]), (1, every[1][0]), (2, every[2][3]), (3, "123"), (4, every[4][-1])], "score_id long, fingering string")
    asked = []

    def suggest(k, only):
        own = n if only is None else n.join(only, ["score_id"], "left_semi")
        asked.append((k, sorted(r.score_id for r in own.select("score_id").distinct().collect())))
        return search.advise(own, k=k, mode="none").withColumnRenamed("digits", "fingering")

    got = {}
    for r in search.recall_all(suggest, gold).orderBy("rank").collect():
        got.setdefault(r.score_id, []).append(r.fingering)
    assert got[1] == every[1][:250] + every[1][250 : asked[-1][0]] and every[1][249] in got[1]
    assert got[2] == every[2][:25] and got[3] == every[3] and got[4] == every[4]
    assert asked == [(25, [1, 2, 3, 4]), (50, [1, 3]), (100, [1]), (200, [1]), (400, [1])]
