"""More registered queries: sequences in ranges, deep search, versions of a model, folds, distance tables, databases and SQL functions.

Some give the rows of another query by another way; these share its columns and SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from handspan.functions import fingering, sql
from handspan.functions.dims import PARNCUTT_RULES
from handspan.functions.keys import is_black
from handspan.operators import agreement, corpus, folds, ranges, search, sequence
from handspan.plans.binding import FINGERINGS_SQL, NOTES_SQL, SUGGESTIONS_SQL, bound_notes, suggestions
from handspan.plans.queries import _BEST, _PLAYABLE, _RULES, _SEG, _SEG_FULL, _TAGS, _TRI, _V, COLUMNS, ORACLE_SQL, PHRASE, QUERIES, W, _alpha, _exploded, _phrases, _pig, _preset, _searched, _span, _two, _typed, query
from handspan.sources import pig


def another_way(name: str, of: str):
    """Registers a function that gives the rows of the query `of` by another way."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _typed(f(spark, sf_dir), COLUMNS[of])

        QUERIES[name], ORACLE_SQL[name], COLUMNS[name] = run, ORACLE_SQL[of], COLUMNS[of]
        return f

    return wrap


# --- sequences in ranges --------------------------------------------------------------------------------------------


@another_way("prior_note_in_ranges", "prior_note")
def prior_note_in_ranges(spark, d):
    return ranges.with_prior(bound_notes(spark, d))


@query("segments_in_ranges", "score_id:i note_idx:i segment_idx:i", f"SELECT score_id, note_idx, {_SEG} AS segment_idx FROM notes")
def segments_in_ranges(spark, d):
    return ranges.with_segments(bound_notes(spark, d))


@query("handed_digits_in_ranges", "score_id:i note_idx:i hand:s hsd:s soft_state:s damper_state:s", """
  SELECT score_id, note_idx, hand, coalesce(hand || strike_digit, 'x') AS hsd, coalesce(last_value(soft IGNORE NULLS) OVER w, 'f') AS soft_state, coalesce(last_value(damper IGNORE NULLS) OVER w, '^') AS damper_state
  FROM hands WINDOW w AS (PARTITION BY score_id ORDER BY note_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", FINGERINGS_SQL)
def handed_digits_in_ranges(spark, d):
    return ranges.with_pedals(ranges.with_handed_digits(_exploded(spark, d)))


@another_way("repeat_runs_in_ranges", "repeat_runs")
def repeat_runs_in_ranges(spark, d):
    return ranges.repeat_runs(bound_notes(spark, d))


@another_way("lattice_ngrams_in_ranges", "lattice_ngrams")
def lattice_ngrams_in_ranges(spark, d):
    return ranges.Ranges(bound_notes(spark, d)).windowed(sequence.lattice_ngrams, 4, 4).result()


@another_way("sounding_by_sweep", "sounding_at_onset")
def sounding_by_sweep(spark, d):
    return ranges.sounding_at_onset(bound_notes(spark, d))


@another_way("tempo_at_in_ranges", "tempo_at")
def tempo_at_in_ranges(spark, d):
    n = bound_notes(spark, d).withColumn("offset", F.col("note_idx").cast("double"))
    marks = n.where("note_idx % 16 = 0").select("score_id", F.col("offset").alias("start"), (60 + F.col("note_idx") % 90).alias("bpm"))
    return ranges.tempo_at(n, marks)


# --- search ---------------------------------------------------------------------------------------------------------


@query("deep_paths", "score_id:i segment_idx:i rank:i digits:s cost:d", "SELECT score_id, segment_idx, rank, digits, cost FROM best WHERE len > 1", _searched(_preset("parncutt"), _PLAYABLE, 12))
def deep_paths(spark, d):
    """The twelve cheapest fingerings of phrases of several notes, taken one at a time from the queue."""
    layered = search.class_costs(_phrases(spark, d), "parncutt", keys=PHRASE)
    return search.deep_paths(layered.where("n > 1"), 12, keys=PHRASE).where("rank > 0")


@query("gold_rank", "score_id:i segment_idx:i digits:s cost:d rank:s", """
  SELECT g.score_id, g.segment_idx, g.digits, g.cost, CAST(1 + coalesce((SELECT sum(c.n) FROM counted c WHERE c.score_id = g.score_id AND c.segment_idx = g.segment_idx AND c.pos = c.len - 1 AND (c.cost < g.cost OR c.cost = g.cost AND c.sign < 0)), 0) AS VARCHAR) AS rank FROM gold g""",
  _searched(_preset("parncutt"), _PLAYABLE, 5) + """, gold AS (SELECT score_id, segment_idx, digits, cost FROM best WHERE len > 1 AND rank = 5), counted AS (
  SELECT score_id, segment_idx, pos, len, d2 AS a, d3 AS b, cand.cost, sign(CAST(d2 || '' || d3 AS INT) - CAST(left(g.digits, 2) AS INT)) AS sign, 1::HUGEINT AS n FROM cand JOIN gold g USING (score_id, segment_idx) WHERE pos = 0 AND len > 1
  UNION ALL
  SELECT score_id, segment_idx, pos, len, a, b, cost, sign, sum(n)::HUGEINT AS n FROM (
    SELECT p.score_id, p.segment_idx, c.pos, c.len, c.d2 AS a, c.d3 AS b, p.cost + c.cost AS cost, CASE WHEN p.sign <> 0 OR c.pos = c.len - 1 THEN p.sign ELSE sign(c.d3 - CAST(g.digits[c.pos + 2] AS INT)) END AS sign, p.n
    FROM counted p JOIN cand c ON c.score_id = p.score_id AND c.segment_idx = p.segment_idx AND c.pos = p.pos + 1 AND c.d1 = p.a AND c.d2 = p.b JOIN gold g ON g.score_id = p.score_id AND g.segment_idx = p.segment_idx WHERE p.cost + c.cost <= g.cost) GROUP BY ALL)""")
def gold_rank(spark, d):
    """The place of each phrase's fifth best fingering among all of its fingerings, by counting them all."""
    layered = search.class_costs(_phrases(spark, d), "parncutt", keys=PHRASE)
    gold = search.k_best_paths(layered.where("n > 1"), 5, keys=PHRASE).where("rank = 5").select(*PHRASE, "digits")
    return search.gold_rank(layered, gold, keys=PHRASE)


@query("recall_all", "score_id:i segment_idx:i rank:i digits:s cost:d is_gold:b", "SELECT score_id, segment_idx, rank, digits, cost, rank IN (2, 5) AS is_gold FROM best b WHERE len > 1 AND rank <= (SELECT max(rank) FROM best g WHERE g.score_id = b.score_id AND g.segment_idx = b.segment_idx AND g.rank IN (2, 5))", _searched(_preset("parncutt"), _PLAYABLE, 5))
def recall_all(spark, d):
    """The fingerings of each phrase up to the last of its gold ones, which are the second and the fifth best here."""
    layered = search.class_costs(_phrases(spark, d), "parncutt", keys=PHRASE)
    gold = search.k_best_paths(layered.where("n > 1"), 5, keys=PHRASE).where("rank in (2, 5)").select(*PHRASE, "digits")
    return search.recall_paths(layered, gold, keys=PHRASE)


def _bounded(a: str, b: str, mode: str) -> str:
    over, under = f"m{b} - m{a} <= {_span('max_prac', f'd{a}', f'd{b}')}", f"m{b} - m{a} >= {_span('min_prac', f'd{a}', f'd{b}')}"
    fits = {"min": under, "both": f"{over} AND {under}"}[mode]
    return f"CASE WHEN m{a} IS NULL OR m{b} IS NULL THEN true WHEN m{a} = m{b} THEN d{a} = d{b} ELSE d{a} <> d{b} AND {fits} END"


def _bounded_search(mode: str):
    text = f"{_BEST} UNION ALL SELECT DISTINCT score_id, segment_idx, 0, NULL, NULL FROM seg WHERE len > 1 AND NOT EXISTS (SELECT 1 FROM best WHERE best.score_id = seg.score_id AND best.segment_idx = seg.segment_idx)"

    @query(f"advise_within_{mode}", "score_id:i segment_idx:i rank:i digits:s cost:d", text, _searched(_preset("parncutt"), f"({_bounded('1', '2', mode)}) AND ({_bounded('2', '3', mode)})", 3))
    def run(spark, d):
        return search.advise(_phrases(spark, d), "parncutt", 3, mode=mode, keys=PHRASE)


for _mode in ("min", "both"):
    _bounded_search(_mode)


@query("rule_costs_by_sql", "score_id:i note_idx:i " + " ".join(f"r_{t}:i" for t in _TAGS), f"SELECT score_id, note_idx, {', '.join(f'{c} AS r_{t}' for t, c in _RULES.items())} FROM ({_TRI})")
def rule_costs_by_sql(spark, d):
    """All rules as SQL functions in a query of plain text."""
    if not spark.catalog.functionExists("hs_rule_costs"):
        sql.register(spark, prefix="hs_")
    trigrams = search.with_trigrams(bound_notes(spark, d))
    call = ", ".join(f"hs_rule_{t}(m1, m2, m3, h1, h2, h3, d1, d2, d3) AS r_{t}" for t in _TAGS)
    return spark.sql(f"SELECT score_id, note_idx, {call} FROM {{trigrams}}", trigrams=trigrams)


@query("rank_cutoff", "score_id:i rank:i tip:i", "SELECT score_id, rank, tip FROM tips WHERE note_idx = 0 AND rank <= 3", SUGGESTIONS_SQL)
def rank_cutoff(spark, d):
    return corpus.cutoff_at(suggestions(bound_notes(spark, d)).where("note_idx = 0"), 3)


@query("without_wildcards", "score_id:i segment_idx:i notes:i", f"SELECT score_id, segment_idx, count(*) AS notes FROM (SELECT *, {_SEG} AS segment_idx FROM hands) GROUP BY 1, 2 HAVING NOT bool_or(strike_digit IS NULL)", FINGERINGS_SQL)
def without_wildcards(spark, d):
    f = sequence.with_segments(fingering.with_handed_digits(_exploded(spark, d), keys=["score_id"]))
    return corpus.drop_wildcards(f, keys=PHRASE).groupBy(*PHRASE).agg(F.count("*").alias("notes"))


@query("confusion_matrix", "staff:s one:i l1:i l2:i l3:i l4:i l5:i", "SELECT s.staff, l AS one, " + ", ".join(f"(SELECT count(*) FROM notes n WHERE n.staff = s.staff AND n.digit = l AND n.digit_b = {i}) AS l{i}" for i in range(1, 6)) + " FROM (SELECT DISTINCT staff FROM notes) s, (SELECT unnest(range(1, 6)) AS l)")
def confusion_matrix(spark, d):
    n = bound_notes(spark, d).select("staff", F.col("digit").alias("one"), F.col("digit_b").alias("other"))
    labels = [1, 2, 3, 4, 5]
    wide = agreement.confusion_matrix(agreement.confusion(n, labels, keys=["staff"]), labels, keys=["staff"])
    return wide.select("staff", "one", *[F.col(str(i)).alias(f"l{i}") for i in labels])


#: Ablation: a version's number is the last two digits of the phrase's id; rule i is muted in version i.
_VERSIONS = NOTES_SQL + f", cut AS (SELECT *, {_SEG_FULL} AS segment_idx FROM notes), many AS (SELECT score_id * 100 + v AS score_id, segment_idx, note_idx, midi, hand, digit FROM cut, (SELECT unnest(range(0, {len(PARNCUTT_RULES) + 1})) AS v)), seg AS (SELECT *, count(*) OVER (PARTITION BY score_id, segment_idx) AS len, row_number() OVER (PARTITION BY score_id, segment_idx ORDER BY note_idx) - 1 AS pos FROM many)"
_MUTED = " + ".join(f"CASE WHEN score_id % 100 = {i + 1} THEN 0 ELSE ({_RULES[tag]}) END" for i, tag in enumerate(PARNCUTT_RULES))
_NAMES = "['all', " + ", ".join(f"'-{tag}'" for tag in PARNCUTT_RULES) + "]"


@query("rule_ablation", "version:s value:d loss:d", f"""
  SELECT {_NAMES}[v + 1] AS version, value, (SELECT avg(cost) FROM best WHERE len > 1 AND rank = 1 AND score_id % 100 = 0) - value AS loss FROM (
    SELECT score_id % 100 AS v, avg(cost) AS value FROM best WHERE len > 1 AND rank = 1 GROUP BY 1)""", _searched(_MUTED, _PLAYABLE, 1, segs=_VERSIONS))
def rule_ablation(spark, d):
    """What the best fingering of a phrase costs on average, with all rules and without each one: thirteen versions of the model in one search."""
    p = _phrases(spark, d)
    several = p.withColumn("_n", F.count("*").over(Window.partitionBy(*PHRASE))).where("_n > 1").drop("_n")
    return search.rule_ablation(several, "parncutt", 1, lambda best: best.where("rank = 1").withColumn("v", F.col("cost")), k=1, keys=PHRASE)


# --- folds ----------------------------------------------------------------------------------------------------------

_COUNTED = """, marked AS (SELECT score_id, segment_idx, pos, digit, score_id % 3 AS fold, midi % 12 IN (1, 3, 6, 8, 10) AS black, coalesce(sign(midi - lag(midi) OVER s), 2) AS step, lag(digit) OVER s AS prev FROM seg WINDOW s AS (PARTITION BY score_id, segment_idx ORDER BY pos)
), shares AS (
  SELECT f.fold, x.black, x.step, l.d, round(ln((count(*) FILTER (WHERE m.digit = l.d) + 1) / CAST(count(m.digit) + 5 AS DOUBLE)), 6) AS em
  FROM (SELECT DISTINCT fold FROM marked) f, (SELECT DISTINCT black, step FROM marked) x CROSS JOIN (SELECT unnest(range(1, 6)) AS d) l LEFT JOIN marked m ON m.fold <> f.fold AND m.black = x.black AND m.step = x.step GROUP BY ALL
), follows AS (
  SELECT f.fold, p.d AS prev, l.d, round(ln((count(*) FILTER (WHERE m.digit = l.d) + 1) / CAST(count(m.digit) + 5 AS DOUBLE)), 6) AS tr
  FROM (SELECT DISTINCT fold FROM marked) f, (SELECT unnest(range(1, 6)) AS d) p CROSS JOIN (SELECT unnest(range(1, 6)) AS d) l LEFT JOIN marked m ON m.fold <> f.fold AND m.prev = p.d GROUP BY ALL
)"""
_LEFT_OUT = """-((SELECT em FROM shares WHERE shares.fold = score_id % 3 AND shares.black = (m2 % 12 IN (1, 3, 6, 8, 10)) AND shares.step = coalesce(sign(m2 - m1), 2) AND shares.d = d2)
  + CASE WHEN m1 IS NULL THEN 0 ELSE (SELECT tr FROM follows WHERE follows.fold = score_id % 3 AND follows.prev = d1 AND follows.d = d2) END)"""
_TAGGED_FOLDS = _searched(_LEFT_OUT, "true", 1, more=_COUNTED) + ", tagged AS (SELECT s.score_id, s.segment_idx, s.note_idx, s.score_id % 3 AS fold, s.digit AS truth, CAST(b.digits[s.pos + 1] AS INT) AS predicted FROM seg s JOIN best b ON b.score_id = s.score_id AND b.segment_idx = s.segment_idx)"


def _folded(spark, d):
    w = Window.partitionBy(*PHRASE).orderBy("note_idx")
    step = F.coalesce(F.signum(F.col("midi") - F.lag("midi").over(w)).cast("int"), F.lit(2))
    examples = _phrases(spark, d).withColumns({"fold": F.col("score_id") % 3, "black": is_black("midi"), "step": step})
    return folds.cross_validate_counts(examples, ["black", "step"], places=6, keys=PHRASE)


@query("cross_validated_tags", "score_id:i segment_idx:i note_idx:i fold:i truth:i predicted:i", "SELECT * FROM tagged", _TAGGED_FOLDS)
def cross_validated_tags(spark, d):
    """Every phrase tagged by what the other two folds counted."""
    return _folded(spark, d)


@query("fold_match_rates", "fold:s rate:s segments:i mean:d weighted_mean:d", """
  SELECT coalesce(CAST(fold AS VARCHAR), 'combined') AS fold, unnest(['gen', 'high', 'soft']) AS rate, segments, mean, weighted_mean FROM (
    SELECT fold, count(*) AS segments, avg(r) AS mean, sum(m) / CAST(sum(n) AS DOUBLE) AS weighted_mean FROM (SELECT score_id, segment_idx, fold, sum(CAST(truth = predicted AS INT)) AS m, count(*) AS n, avg(CAST(truth = predicted AS INT)) AS r FROM tagged GROUP BY 1, 2, 3) GROUP BY GROUPING SETS ((fold), ()))""", _TAGGED_FOLDS)
def fold_match_rates(spark, d):
    return folds.fold_match_rates(_folded(spark, d), keys=PHRASE)


@query("fold_report", "fold:i label:i support:i predicted_n:i precision:d recall:d f1:d", """
  SELECT fold, label, support, predicted_n, hit / nullif(predicted_n, 0)::DOUBLE AS precision, hit / nullif(support, 0)::DOUBLE AS recall, 2.0 * hit / (support + predicted_n) AS f1 FROM (
    SELECT fold, l AS label, sum(CAST(truth = l AS INT)) AS support, sum(CAST(predicted = l AS INT)) AS predicted_n, sum(CAST(truth = l AND predicted = l AS INT)) AS hit FROM tagged, (SELECT unnest(range(1, 6)) AS l) GROUP BY 1, 2) WHERE support + predicted_n > 0""", _TAGGED_FOLDS)
def fold_report(spark, d):
    return folds.fold_report(_folded(spark, d))


@query("left_out_weights", "fold:i p:i q:i f:i g:i weight:d", f"""
  SELECT k.fold, p, q, f, g, sum(share) AS weight FROM (SELECT DISTINCT score_id % 3 AS fold FROM notes) k JOIN (
    SELECT score_id % 3 AS fold, p, midi AS q, f, digit AS g, count(*) / CAST(sum(count(*)) OVER (PARTITION BY score_id, p, midi) AS DOUBLE) AS share FROM (SELECT *, lag(midi) {W} AS p, lag(digit) {W} AS f FROM notes) WHERE p IS NOT NULL GROUP BY score_id, p, midi, f, digit) s ON s.fold <> k.fold
  GROUP BY 1, 2, 3, 4, 5""")
def left_out_weights(spark, d):
    return folds.left_out_weights(bound_notes(spark, d).withColumn("fold", F.col("score_id") % 3))


# --- agreement ------------------------------------------------------------------------------------------------------

_FAR = "CASE WHEN {0} = {1} THEN 0.0 WHEN abs({0} - {1}) = 4 THEN 0.8 ELSE least(abs({0} - {1}) + (CASE WHEN ({0} = 1) <> ({1} = 1) THEN 3 ELSE 0 END), 6) / 6.0 END"


@query("alpha_by_distances", "pairable:i observed:d expected:d alpha:d", f"SELECT *, 1 - observed / expected AS alpha FROM ({_alpha(_FAR)})", _V)
def alpha_by_distances(spark, d):
    """Alpha by a table of finger distances, in which little finger and thumb are missing: those are 0.8 apart."""
    five = lambda c: F.explode(F.sequence(F.lit(1), F.lit(5))).alias(c)
    far = spark.range(1).select(five("a")).select("a", five("b")).where("a < b and b - a < 4")
    far = far.withColumn("d", F.least(F.col("b") - F.col("a") + F.when(F.col("a") == 1, 3).otherwise(0), F.lit(6)) / 6.0)
    return agreement.krippendorff_alpha(_two(bound_notes(spark, d)), far, unit=("score_id", "note_idx"), missing=0.8)


@query("event_prints", "piece_id:s n:i same:b", """
  SELECT CAST(score_id AS VARCHAR) AS piece_id, count(DISTINCT (channel, tick)) AS n, true AS same FROM (
    SELECT score_id, CASE hand WHEN '<' THEN 1 ELSE 0 END AS channel, unnest([round(onset_ms / 1000.0::DOUBLE * 1920), round((onset_ms + dur_ms) / 1000.0::DOUBLE * 1920)]) AS tick FROM notes) GROUP BY 1""")
def event_prints(spark, d):
    """Prints of two annotations whose rows come in other orders, one of them twice, are the same."""
    p = _pig(spark, d).drop("annot_id")
    two = p.withColumn("annot_id", F.lit("0")).unionByName(p.union(p).withColumn("annot_id", F.lit("1")))
    prints = pig.event_prints(two)
    return prints.groupBy("piece_id").agg(F.max("n").alias("n"), ((F.min("n") == F.max("n")) & (F.min("s1") == F.max("s1")) & (F.min("s2") == F.max("s2")) & (F.count("*") == 2)).alias("same"))


_PRINTED = NOTES_SQL + """, copies AS (
  SELECT score_id, annot, CASE hand WHEN '<' THEN 1 ELSE 0 END AS channel, unnest([round((onset_ms / 1000.0::DOUBLE + late) * 1920), round(((onset_ms + dur_ms) / 1000.0::DOUBLE + late) * 1920)]) AS tick
  FROM notes, (SELECT unnest(range(0, 4)) AS annot) CROSS JOIN LATERAL (SELECT CASE WHEN annot = 3 AND event_id % 50 = 7 THEN 0.25 WHEN annot = 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS late)
), signs AS (
  SELECT score_id, annot, string_agg(DISTINCT channel || ':' || CAST(tick AS BIGINT), ' ' ORDER BY channel || ':' || CAST(tick AS BIGINT)) AS events FROM copies GROUP BY 1, 2
)"""


@query("same_song", "piece_id:s annot_id:s song_id:s", "SELECT score_id AS piece_id, annot AS annot_id, min(annot) OVER (PARTITION BY score_id, events) AS song_id FROM signs", _PRINTED)
def same_song(spark, d):
    """Four annotations of each score: two alike, one a beat late, and one in which some notes (of some scores none) come later."""
    k = F.array(*[F.lit(str(i)) for i in range(4)])
    p = _pig(spark, d).drop("annot_id").withColumn("annot_id", F.explode(k))
    late = F.when((F.col("annot_id") == "3") & (F.col("event_id") % 50 == 7), 0.25).when(F.col("annot_id") == "2", 0.5).otherwise(0.0)
    return pig.group_same_song(p.withColumns({"on_s": F.col("on_s") + late, "off_s": F.col("off_s") + late}))
