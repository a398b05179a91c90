"""The registered queries: operators bound to the given tables, each with SQL for an independent engine.

A query names its columns and kinds (i whole number, d double, s text, b boolean); both sides are cast alike, doubles
to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from handspan.functions import dims, fingering, keys, measures, rules
from handspan.operators import agreement, corpus, features, matchrates, ranking, search, sequence, stats
from handspan.plans.binding import FINGERINGS_SQL, NOTES_SQL, SUGGESTIONS_SQL, bound_notes, fingering_text, interval_costs, pairs, suggestions
from handspan.streaming.notes import note_rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COLUMNS: dict[str, list[list[str]]] = {}
SPARK = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}
SQL = {"i": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}


def _typed(df: DataFrame, spec: list[list[str]]) -> DataFrame:
    """The columns of a query, cast to their kinds."""
    return df.select(*[(F.round(F.col(c).cast("double"), 6) + 0.0 if k == "d" else F.col(c).cast(SPARK[k])).alias(c) for c, k in spec])


def query(name: str, columns: str, sql: str | None = None, ctes: str = NOTES_SQL, lambdas: bool = False):
    """Registers a function (spark, sf_dir) under a name, and its SQL: a select over the named tables."""
    spec = [c.split(":") for c in columns.split()]

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _typed(f(spark, sf_dir), spec)

        QUERIES[name], COLUMNS[name] = run, spec
        if sql is not None:
            out = ", ".join(f'{SQL[k].format(chr(34) + c + chr(34))} AS "{c}"' for c, k in spec)
            ORACLE_SQL[name] = f"WITH {ctes}\nSELECT {out} FROM (\n{sql}\n)"
        return f

    return wrap


W = "OVER (PARTITION BY score_id ORDER BY note_idx)"


def black(m: str) -> str:
    return f"(({m}) % 12 IN (1, 3, 6, 8, 10))"


def imaginary(m: str) -> str:
    return f"(list_extract([0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12], CAST(({m}) % 12 + 1 AS INT)) + 14 * (({m}) // 12))"


# --- notes ----------------------------------------------------------------------------------------------------------


@query("key_predicates", "score_id:i note_idx:i is_black:b is_white:b color:s is_cramped:b", f"SELECT score_id, note_idx, {black('midi')} AS is_black, NOT {black('midi')} AS is_white, CASE WHEN {black('midi')} THEN 'black' ELSE 'white' END AS color, midi % 12 IN (2, 7, 9) AS is_cramped FROM notes")
def key_predicates(spark, d):
    n = bound_notes(spark, d)
    return n.select("score_id", "note_idx", keys.is_black("midi").alias("is_black"), keys.is_white("midi").alias("is_white"), keys.key_color("midi").alias("color"), keys.is_cramped("midi").alias("is_cramped"))


@query("prior_note", "score_id:i note_idx:i prior_midi:i delta:i direction:i", f"SELECT score_id, note_idx, lag(midi) {W} AS prior_midi, midi - lag(midi) {W} AS delta, sign(midi - lag(midi) {W}) AS direction FROM notes")
def prior_note(spark, d):
    return sequence.with_prior(bound_notes(spark, d))


@query("between_neighbours", "score_id:i note_idx:i between:b", f"SELECT score_id, note_idx, coalesce((lag(midi) {W} < midi AND midi < lead(midi) {W}) OR (lead(midi) {W} < midi AND midi < lag(midi) {W}), false) AS between FROM notes")
def between_neighbours(spark, d):
    n = sequence.with_neighbours(bound_notes(spark, d))
    return n.select("score_id", "note_idx", keys.is_between("midi", "midi_m1", "midi_p1").alias("between"))


PHYSICAL = f"""
  SELECT score_id, note_idx, midi, p, greatest(least(midi - p, 17), -17) AS semitone, midi - p AS unclamped, {imaginary('midi')} - {imaginary('p')} AS imaginary,
    CASE WHEN midi < p THEN -1 ELSE 1 END * len(list_filter({keys.semitone_bounds()!r}, lambda x: x < abs(list_extract({keys.key_positions()!r}, midi - 20) - list_extract({keys.key_positions()!r}, p - 20)))) AS physical
  FROM (SELECT score_id, note_idx, midi, lag(midi) {W} AS p FROM notes) WHERE p IS NOT NULL"""


@query("note_distances", "score_id:i note_idx:i semitone:i unclamped:i imaginary:i physical:i", PHYSICAL)
def note_distances(spark, d):
    n = sequence.with_prior(bound_notes(spark, d)).where("prior_midi is not null")
    p, m = F.col("prior_midi"), F.col("midi")
    return n.select("score_id", "note_idx", keys.distance_semitone(p, m).alias("semitone"), keys.distance_semitone(p, m, None).alias("unclamped"), keys.distance_imaginary(p, m).alias("imaginary"), keys.distance_physical(p, m).alias("physical"))


def _x(a: str, b: str) -> str:
    return f"coalesce(greatest(least({imaginary(b)} - {imaginary(a)}, 15), -15), 0)"


def _y(a: str, b: str) -> str:
    return f"coalesce(CAST({black(b)} AS INT) - CAST({black(a)} AS INT), 0)"


_NEAR = ", ".join([f"lag(midi, {k}) {W} AS m{k}" for k in range(1, 5)] + [f"lead(midi, {k}) {W} AS p{k}" for k in range(1, 5)])
_XY = ", ".join([f"{_x(f'm{k}', 'midi')} AS x_m{k}, {_x('midi', f'p{k}')} AS x_p{k}, {_y(f'm{k}', 'midi')} AS y_m{k}, {_y('midi', f'p{k}')} AS y_p{k}" for k in range(1, 5)])


@query("lattice_ngrams", "score_id:i note_idx:i " + " ".join(f"{a}_{s}{k}:i" for a in "xy" for s in "mp" for k in range(1, 5)), f"SELECT score_id, note_idx, {_XY} FROM (SELECT *, {_NEAR} FROM notes)")
def lattice_ngrams(spark, d):
    return sequence.lattice_ngrams(bound_notes(spark, d))


@query("integral_distances", "score_id:i note_idx:i before:i after:i", f"SELECT score_id, note_idx, coalesce(greatest(least(midi - lag(midi) {W}, 15), -15), 0) AS before, coalesce(abs(greatest(least(lead(midi) {W} - midi, 15), -15)), 0) AS after FROM notes")
def integral_distances(spark, d):
    n = sequence.with_neighbours(bound_notes(spark, d))
    return n.select("score_id", "note_idx", keys.distance_integral("midi_m1", "midi").alias("before"), keys.distance_integral("midi", "midi_p1", absolute=True).alias("after"))


@query("pitch_names", "midi:i name:s back:i n:i", "SELECT midi, name, midi AS back, count(*) AS n FROM (SELECT midi, list_extract(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], midi % 12 + 1) || (midi // 12 - 1) AS name FROM notes) GROUP BY midi, name")
def pitch_names(spark, d):
    n = bound_notes(spark, d).groupBy("midi").agg(F.count("*").alias("n"))
    return n.withColumn("name", keys.midi_to_pitch_name("midi")).withColumn("back", keys.pitch_name_to_midi("name"))


@query("pitch_window", "score_id:i note_idx:i pitches:s", f"SELECT score_id, note_idx, concat_ws(' ', {', '.join(f'coalesce(CAST(m{k} AS VARCHAR), {chr(39)}-1{chr(39)})' for k in (4, 3, 2, 1))}, midi, {', '.join(f'coalesce(CAST(p{k} AS VARCHAR), {chr(39)}-1{chr(39)})' for k in (1, 2, 3, 4))}) AS pitches FROM (SELECT *, {_NEAR} FROM notes)")
def pitch_window(spark, d):
    return sequence.pitch_window(bound_notes(spark, d)).withColumn("pitches", F.array_join("pitches", " "))


@query("ngram_labels", "score_id:i ngram_idx:i ngram:s", """
  SELECT score_id, i AS ngram_idx, coalesce(a, 'x') || coalesce(b, 'x') || coalesce(c, 'x') AS ngram FROM (
    SELECT score_id, i, lag(h, 2) OVER w AS a, lag(h) OVER w AS b, h AS c FROM (
      SELECT score_id, note_idx AS i, hand || digit AS h FROM notes UNION ALL
      SELECT score_id, n + k, NULL FROM (SELECT score_id, count(*) AS n FROM notes GROUP BY 1), (SELECT unnest([0, 1]) AS k))
    WINDOW w AS (PARTITION BY score_id ORDER BY i))""")
def ngram_labels(spark, d):
    return sequence.ngram_labels(bound_notes(spark, d).withColumn("hsd", F.concat("hand", F.col("digit").cast("string"))), 3)


@query("bigram_labels", "score_id:i note_idx:i bigram:s", f"SELECT score_id, note_idx, coalesce(lag(hand || digit) {W}, '^^') || CASE WHEN lag(midi) {W} < midi THEN '/' WHEN lag(midi) {W} > midi THEN '\\' ELSE '-' END || hand || digit AS bigram FROM notes")
def bigram_labels(spark, d):
    return sequence.bigram_labels(bound_notes(spark, d))


_PIVOT = """coalesce(h0 = hand AND ((d = 1 AND d0 <> 1 AND out >= 0) OR (d0 = 1 AND d <> 1 AND out <= 0)), false)"""


def _pivots(digit: str) -> str:
    return f"SELECT *, {_PIVOT} AS piv FROM (SELECT score_id, note_idx, hand, {digit} AS d, lag({digit}) {W} AS d0, lag(hand) {W} AS h0, CASE hand WHEN '>' THEN midi - lag(midi) {W} ELSE lag(midi) {W} - midi END AS out FROM notes)"


@query("pivots", "score_id:i note_idx:i is_pivot:b", f"SELECT score_id, note_idx, piv AS is_pivot FROM ({_pivots('digit')})")
def pivots(spark, d):
    return sequence.with_pivot(bound_notes(spark, d))


@query("pivot_count", "score_id:i pivots:i", f"SELECT score_id, sum(CASE WHEN (s > 0 AND d1 = 1 OR s < 0 AND digit = 1) AND d1 <> digit THEN 1 ELSE 0 END) AS pivots FROM (SELECT *, lead(digit) {W} AS d1, lead(midi) {W} - midi AS s FROM notes) GROUP BY 1")
def pivot_count(spark, d):
    return sequence.with_simple_pivot(bound_notes(spark, d)).groupBy("score_id").agg(F.sum(F.col("pivots_next").cast("int")).alias("pivots"))


@query("pivot_alignment", "score_id:i mismatches:i", f"SELECT a.score_id, sum(CAST(a.piv <> b.piv AS INT)) AS mismatches FROM ({_pivots('digit')}) a JOIN ({_pivots('digit_b')}) b USING (score_id, note_idx) GROUP BY 1")
def pivot_alignment(spark, d):
    n = sequence.with_pivot(bound_notes(spark, d), name="a_pivot")
    return search.pivot_alignment(sequence.with_pivot(n, digit="digit_b", name="b_pivot"))


_SEG = "coalesce(sum(CASE WHEN seg_mark IN (',', ';', '.') THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY note_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("segments", "score_id:i note_idx:i segment_idx:i level_two:i", f"SELECT score_id, note_idx, {_SEG} AS segment_idx, {_SEG.replace(chr(39) + ',' + chr(39) + ', ', '')} AS level_two FROM notes")
def segments(spark, d):
    n = sequence.with_segments(bound_notes(spark, d), level=";").withColumnRenamed("segment_idx", "level_two")
    return sequence.with_segments(n)


@query("rebased_onsets", "score_id:i note_idx:i rebased_onset:i", f"SELECT score_id, note_idx, onset_ms - coalesce(max(e) OVER (PARTITION BY score_id ORDER BY segment_idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rebased_onset FROM (SELECT *, max(onset_ms) OVER (PARTITION BY score_id, segment_idx) AS e FROM (SELECT *, {_SEG} AS segment_idx FROM notes))")
def rebased_onsets(spark, d):
    return sequence.rebase_onsets(sequence.with_segments(bound_notes(spark, d)))


_ON = ", ".join([f"lag(onset_ms, {k}) {W} AS om{k}, lag(midi, {k}) {W} AS m{k}" for k in range(1, 5)] + [f"lead(onset_ms, {k}) {W} AS op{k}, lead(midi, {k}) {W} AS p{k}" for k in range(1, 5)])


def _near(side: str, cond: str = "") -> str:
    parts = []
    for s in side:
        for k in range(1, 5):
            t = f"om{k} > onset_ms - 30" if s == "m" else f"op{k} < onset_ms + 30"
            parts.append(f"CAST(coalesce({t}{(' AND ' + cond.format(f'{s}{k}')) if cond else ''}, false) AS INT)")
    return " + ".join(parts)


_CHORDS = f"SELECT *, {_near('m')} AS chord_left, {_near('p')} AS chord_right, {_near('mp', '{0} < midi')} AS chord_lower, {_near('mp', '{0} > midi')} AS chord_upper FROM (SELECT *, {_ON} FROM notes)"


@query("chord_counts", "score_id:i note_idx:i chord_left:i chord_right:i chord_lower:i chord_upper:i border:s", f"SELECT *, CASE WHEN chord_lower = 0 AND chord_upper > 0 THEN 'left' WHEN chord_upper = 0 AND chord_lower > 0 THEN 'right' ELSE 'none' END AS border FROM ({_CHORDS})")
def chord_counts(spark, d):
    return sequence.chord_counts(bound_notes(spark, d)).withColumn("border", sequence.chord_border(F.col("chord_lower"), F.col("chord_upper")))


_TEMPO = """
  SELECT *, CASE WHEN lt = 0 THEN 0 ELSE ln * 1000.0 / lt END AS left_nps, CASE WHEN rt = 0 THEN 0 ELSE rn * 1000.0 / rt END AS right_nps, CASE WHEN lt + rt = 0 THEN 0 ELSE (ln + rn - 1) * 1000.0 / (lt + rt) END AS window_nps FROM (
    SELECT *, onset_ms - first_value(onset_ms) OVER l AS lt, last_value(onset_ms) OVER r - onset_ms AS rt, count(*) OVER l AS ln, count(*) OVER r AS rn FROM notes
    WINDOW l AS (PARTITION BY score_id ORDER BY note_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), r AS (PARTITION BY score_id ORDER BY note_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))"""


@query("tempo_features", "score_id:i note_idx:i left_nps:d right_nps:d window_nps:d", _TEMPO)
def tempo_features(spark, d):
    return sequence.tempo_features(bound_notes(spark, d))


_ART = f"""
  SELECT score_id, note_idx, CASE WHEN alone THEN coalesce(sum(CAST(gap > 60 AS INT)) OVER i, 0) ELSE 0 END AS separated_count, CASE WHEN alone THEN coalesce(sum(CAST(gap >= left_dur / 2.0 AS INT)) OVER i, 0) ELSE 0 END AS staccato_count,
    CASE WHEN alone AND span > 0 THEN coalesce(sum(greatest(gap, 0)) OVER i, 0) / span ELSE 0 END AS normalized_silence FROM (
    SELECT *, onset_ms - (lag(onset_ms) {W} + lag(dur_ms) {W}) AS gap, lag(dur_ms) {W} AS left_dur, chord_left + chord_right = 0 AS alone,
      last_value(onset_ms) OVER w - first_value(onset_ms) OVER w AS span FROM ({_CHORDS}) WINDOW w AS (PARTITION BY score_id ORDER BY note_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
  WINDOW i AS (PARTITION BY score_id ORDER BY note_idx ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING)"""


@query("articulation_features", "score_id:i note_idx:i separated_count:i staccato_count:i normalized_silence:d", _ART)
def articulation_features(spark, d):
    return sequence.articulation_features(bound_notes(spark, d))


@query("repeat_runs", "score_id:i note_idx:i repeats_before:i repeats_after:i", f"""
  SELECT score_id, note_idx, row_number() OVER (PARTITION BY score_id, run ORDER BY note_idx) - 1 AS repeats_before, count(*) OVER (PARTITION BY score_id, run) - row_number() OVER (PARTITION BY score_id, run ORDER BY note_idx) AS repeats_after FROM (
    SELECT *, sum(new) {W} AS run FROM (SELECT *, CASE WHEN lag(midi) {W} = midi THEN 0 ELSE 1 END AS new FROM notes))""")
def repeat_runs(spark, d):
    return sequence.repeat_runs(bound_notes(spark, d))


@query("phrase_ends", "score_id:i note_idx:i bop:b eop:b", "SELECT score_id, note_idx, note_idx = min(note_idx) OVER (PARTITION BY score_id) AS bop, note_idx = max(note_idx) OVER (PARTITION BY score_id) AS eop FROM notes")
def phrase_ends(spark, d):
    return sequence.phrase_ends(bound_notes(spark, d))


@query("finger_contour", "score_id:i contour:s", f"SELECT score_id, string_agg(CASE WHEN midi > p THEN '/' WHEN midi < p THEN '\\' WHEN midi = p THEN '-' ELSE '' END || hand || digit, '' ORDER BY note_idx) AS contour FROM (SELECT *, lag(midi) {W} AS p FROM notes) GROUP BY 1")
def finger_contour(spark, d):
    return sequence.finger_contour(bound_notes(spark, d))


@query("contour_flags", "score_id:i note_idx:i returning:b will_return:b ascending:b descending:b leap:b", f"SELECT score_id, note_idx, x_m2 = 0 AS returning, x_p2 = 0 AS will_return, x_m1 < 0 AND x_p1 > 0 AS ascending, x_m1 > 0 AND x_p1 < 0 AS descending, coalesce(abs(midi - m1) > 15, false) AS leap FROM (SELECT *, {_XY} FROM (SELECT *, {_NEAR} FROM notes))")
def contour_flags(spark, d):
    return sequence.leaps(sequence.contour_flags(bound_notes(spark, d)))


@query("complex_chording", "score_id:i note_idx:i complex_chording:i", f"""
  SELECT c.score_id, c.note_idx, coalesce(sum(CASE WHEN r.hand = '>' AND r.rn > 1 AND r.digit <= r.fd THEN 1 WHEN r.hand = '<' AND r.rn > 1 AND r.digit >= r.fd THEN 1 ELSE 0 END), 0) AS complex_chording FROM ({_CHORDS}) c JOIN (
    SELECT c.score_id, c.note_idx AS at, n.hand, n.digit, row_number() OVER (PARTITION BY c.score_id, c.note_idx, n.hand ORDER BY n.note_idx) AS rn, first_value(n.digit) OVER (PARTITION BY c.score_id, c.note_idx, n.hand ORDER BY n.note_idx) AS fd
    FROM ({_CHORDS}) c JOIN notes n ON n.score_id = c.score_id AND n.note_idx BETWEEN c.note_idx - c.chord_left AND c.note_idx + c.chord_right) r ON r.score_id = c.score_id AND r.at = c.note_idx GROUP BY 1, 2""")
def complex_chording(spark, d):
    return sequence.complex_chording(bound_notes(spark, d))


@query("sounding_at_onset", "score_id:i note_idx:i sounding_lower:i sounding_upper:i", """
  SELECT a.score_id, a.note_idx, count(DISTINCT CASE WHEN b.midi < a.midi THEN b.midi END) AS sounding_lower, count(DISTINCT CASE WHEN b.midi > a.midi THEN b.midi END) AS sounding_upper
  FROM notes a JOIN notes b ON a.score_id = b.score_id AND b.onset_ms <= a.onset_ms AND a.onset_ms < greatest(b.onset_ms + b.dur_ms - 30, b.onset_ms + 1) GROUP BY 1, 2""")
def sounding_at_onset(spark, d):
    return sequence.sounding_at_onset(bound_notes(spark, d))


@query("tempo_at", "score_id:i note_idx:i bpm:d onset_s:d", """
  SELECT n.score_id, n.note_idx, m.bpm, n.note_idx * 60.0 / m.bpm AS onset_s FROM notes n ASOF JOIN (SELECT score_id, note_idx AS start, 60 + note_idx % 90 AS bpm FROM notes WHERE note_idx % 16 = 0) m ON n.score_id = m.score_id AND n.note_idx >= m.start""")
def tempo_at(spark, d):
    n = bound_notes(spark, d).withColumn("offset", F.col("note_idx").cast("double"))
    marks = n.where("note_idx % 16 = 0").select("score_id", F.col("offset").alias("start"), (60 + F.col("note_idx") % 90).alias("bpm"))
    return sequence.tempo_at(n, marks)


@query("note_rates", "window_start:s score_id:i notes:i low:i high:i", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS score_id, count(*) AS notes, min(36 + CAST(floor(value) AS INT) % 49) AS low, max(36 + CAST(floor(value) AS INT) % 49) AS high FROM events GROUP BY 1, 2")
def rates(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("score_id"), (36 + F.floor("value").cast("int") % 49).alias("midi"))
    return note_rates(e).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


# --- fingering strings ----------------------------------------------------------------------------------------------


def _exploded(spark, d):
    n = bound_notes(spark, d)
    return fingering.explode_abcdf(fingering_text(n)).where("staff = 'upper'")


@query("explode_abcdf", "score_id:i note_idx:i strike_hand:s strike_digit:i release_digit:i soft:s damper:s is_ornament:b seg_mark:s", "SELECT * FROM fing", FINGERINGS_SQL)
def explode_abcdf(spark, d):
    return _exploded(spark, d)


@query("handed_digits", "score_id:i note_idx:i hand:s hsd:s release:s soft_state:s damper_state:s", """
  SELECT score_id, note_idx, hand, coalesce(hand || strike_digit, 'x') AS hsd, coalesce(hand || release_digit, hand || strike_digit, 'x') AS release,
    coalesce(last_value(soft IGNORE NULLS) OVER w, 'f') AS soft_state, coalesce(last_value(damper IGNORE NULLS) OVER w, '^') AS damper_state
  FROM hands WINDOW w AS (PARTITION BY score_id ORDER BY note_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", FINGERINGS_SQL)
def handed_digits(spark, d):
    return fingering.with_pedals(fingering.with_strike_release(_exploded(spark, d), keys=["score_id"]), keys=["score_id"])


@query("segregated_digits", "score_id:i digits:s", "SELECT score_id, CASE WHEN max(CAST(hand <> '>' AS INT)) = 0 THEN string_agg(coalesce(CAST(strike_digit AS VARCHAR), 'x'), '' ORDER BY note_idx) END AS digits FROM hands GROUP BY 1", FINGERINGS_SQL)
def segregated_digits(spark, d):
    return fingering.segregated_digits(fingering.with_handed_digits(_exploded(spark, d), keys=["score_id"]), keys=["score_id"])


@query("other_hand_count", "score_id:i other_hand:i wildcards:i", "SELECT score_id, sum(CAST(hand <> '>' AS INT)) AS other_hand, sum(CAST(strike_digit IS NULL AS INT)) AS wildcards FROM hands GROUP BY 1", FINGERINGS_SQL)
def other_hand_count(spark, d):
    return corpus.other_hand_count(fingering.with_handed_digits(_exploded(spark, d), keys=["score_id"]).withColumn("default_hand", F.lit(">")))


@query("simplify_abcdf", "score_id:i text:s", f"SELECT score_id, string_agg(CASE WHEN lag_h = h THEN '' ELSE h END || digit, '' ORDER BY note_idx) AS text FROM (SELECT *, lag(h) {W} AS lag_h FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '<' ELSE '>' END AS h FROM notes)) GROUP BY 1")
def simplify_abcdf(spark, d):
    n = sequence.with_segments(bound_notes(spark, d)).withColumn("t", F.concat(F.when(F.col("event_id") % 3 == 0, "<").otherwise(">"), F.col("digit").cast("string")))
    parts = n.groupBy("score_id", "segment_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "t"))), lambda s: s["t"]), "&").alias("abcdf"))
    return fingering.join_segments(parts.withColumn("abcdf", fingering.flatten_abcdf("abcdf"))).select("score_id", F.col("abcdf").alias("text"))


@query("pig_fingers", "score_id:i note_idx:i pig:s back:s strike:s", "SELECT score_id, note_idx, s || digit || '_' || s || digit_b AS pig, hand || digit || '-' || hand || digit_b AS back, s || digit AS strike FROM (SELECT *, CASE hand WHEN '<' THEN '-' ELSE '' END AS s FROM notes)")
def pig_fingers(spark, d):
    n = bound_notes(spark, d).withColumn("hsd", F.concat("hand", F.col("digit").cast("string"), F.lit("-"), "hand", F.col("digit_b").cast("string")))
    n = n.withColumn("pig", fingering.hsd_to_pig_finger("hsd"))
    return n.withColumns({"back": fingering.pig_finger_to_hsd("pig"), "strike": fingering.pig_strike("pig")})


@query("one_note_advice", "score_id:i note_idx:i advice:i", f"SELECT score_id, note_idx, CASE WHEN event_id % 4 = 0 THEN digit WHEN {black('midi')} THEN 2 ELSE 1 END AS advice FROM notes")
def one_note_advice(spark, d):
    return bound_notes(spark, d).withColumn("advice", fingering.one_note_advice("midi", F.when(F.col("event_id") % 4 == 0, F.col("digit"))))


@query("bigram_bits", "score_id:i note_idx:i from:s to:s direction:i", f"""
  SELECT score_id, note_idx, CASE WHEN ok THEN r END AS "from", CASE WHEN ok THEN hsd END AS "to", CASE WHEN ok THEN sign(midi - m) END AS direction FROM (
    SELECT *, lag(release) {W} AS r, lag(midi) {W} AS m, coalesce(lag(release) {W} <> 'x' AND hsd <> 'x', false) AS ok FROM (SELECT *, coalesce(hand || strike_digit, 'x') AS hsd, coalesce(hand || release_digit, hand || strike_digit, 'x') AS release FROM hands))""", FINGERINGS_SQL)
def bigram_bits(spark, d):
    n = bound_notes(spark, d).select("score_id", "note_idx", "midi")
    f = fingering.with_strike_release(_exploded(spark, d), keys=["score_id"]).join(n, ["score_id", "note_idx"])
    return corpus.bigram_bits(f).select("score_id", "note_idx", "bits.*")


# --- joins, counts, checks ------------------------------------------------------------------------------------------


@query("finger_notes", "score_id:i segment_idx:i note_idx:i midi:i hsd:s", "SELECT score_id, segment_idx, note_idx, midi, hand || strike_digit AS hsd FROM (SELECT *, bool_or(strike_digit IS NULL) OVER (PARTITION BY score_id, segment_idx) AS x FROM phrased) WHERE NOT x", FINGERINGS_SQL + f", phrased AS (SELECT *, {_SEG} AS segment_idx FROM hands)")
def finger_notes(spark, d):
    n = sequence.with_segments(bound_notes(spark, d)).select("score_id", "segment_idx", "note_idx", "midi")
    f = fingering.with_handed_digits(_exploded(spark, d), keys=["score_id"]).select("score_id", "note_idx", "hsd", "hand")
    f = n.select("score_id", "segment_idx", "note_idx").join(f, ["score_id", "note_idx"])
    return corpus.finger_notes(n, f, keys=("score_id", "segment_idx"), drop_wildcards=True)


@query("load_summary", "bad:i wildcarded:i other_hand:i other_hand_fingers:i notes:i", "SELECT 0 AS bad, sum(CAST(x > 0 AS INT)) AS wildcarded, sum(CAST(o > 0 AS INT)) AS other_hand, sum(o) AS other_hand_fingers, coalesce(sum(CASE WHEN x = 0 THEN n END), 0) AS notes FROM (SELECT score_id, count(*) AS n, sum(CAST(strike_digit IS NULL AS INT)) AS x, sum(CAST(hand <> '>' AS INT)) AS o FROM hands GROUP BY 1)", FINGERINGS_SQL)
def load_summary(spark, d):
    f = fingering.with_handed_digits(_exploded(spark, d), keys=["score_id"]).withColumn("default_hand", F.lit(">"))
    return corpus.load_summary(bound_notes(spark, d), f)


@query("note_counts", "staff:s score_id:i notes:i low:i high:i", "SELECT staff, score_id, count(*) AS notes, min(midi) AS low, max(midi) AS high FROM notes GROUP BY ROLLUP (staff, score_id)")
def note_counts(spark, d):
    return corpus.counts(bound_notes(spark, d), "staff", "score_id")


@query("check_consistent", "score_id:i counts:s expected:i", "SELECT score_id, CASE WHEN b = n THEN '' || n ELSE b || ',' || n END AS counts, n AS expected FROM (SELECT score_id, count(*) AS n, sum(CAST(event_id % 97 <> 5 AS INT)) AS b FROM notes GROUP BY 1) WHERE b <> n")
def check_consistent(spark, d):
    n = bound_notes(spark, d)
    two = n.select("score_id", F.lit("a").alias("annot_id")).unionAll(n.where("event_id % 97 != 5").select("score_id", F.lit("b")))
    return corpus.check_consistent(two, n).withColumn("counts", F.concat_ws(",", F.transform("counts", lambda c: c.cast("string"))))


@query("fully_annotated", "score_id:i fully_annotated:b", "SELECT score_id, bool_and(event_id % 97 <> 5) AS fully_annotated FROM notes GROUP BY 1")
def fully_annotated(spark, d):
    n = bound_notes(spark, d)
    return corpus.is_fully_annotated(n.withColumn("digit", F.when(F.col("event_id") % 97 != 5, F.col("digit"))), n)


@query("monophony", "score_id:i monophonic:b orderly:b", "SELECT score_id, NOT bool_or(coalesce(e > onset_ms, false)) AS monophonic, count(*) = count(DISTINCT onset_ms) AS orderly FROM (SELECT *, max(onset_ms + dur_ms) OVER (PARTITION BY score_id ORDER BY onset_ms, note_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM notes) GROUP BY 1")
def monophony(spark, d):
    return corpus.monophony(bound_notes(spark, d))


@query("human_performance", "score_id:i human:b human_ms:b", f"""
  SELECT score_id, 1 - count(DISTINCT dur_ms) / count(*)::DOUBLE <= 0.5 AND 1 - count(DISTINCT onset_ms) / count(*)::DOUBLE <= 0.1 AS human,
    coalesce(sum(CAST(s = 0 AS INT)) / nullif(sum(CAST(s < 30 AS INT)), 0)::DOUBLE, 0) <= 0.5 AND coalesce(sum(CAST(abs(g) < 5 AS INT)) / nullif(sum(CAST(s >= 30 AS INT)), 0)::DOUBLE, 0) <= 0.5 AS human_ms
  FROM (SELECT *, onset_ms - lag(onset_ms) {W} AS s, onset_ms - (lag(onset_ms) {W} + lag(dur_ms) {W}) AS g FROM notes) GROUP BY 1""")
def human_performance(spark, d):
    n = bound_notes(spark, d)
    return corpus.human_performance(n).join(corpus.human_performance_ms(n), "score_id")


@query("gold_votes", "o_custkey:i fingering:s votes:i total:i distinct:i", 'SELECT o_custkey, fingering, votes, sum(votes) OVER w AS total, count(*) OVER w AS "distinct" FROM (SELECT o_custkey, l_returnflag || l_linestatus AS fingering, count(*) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_custkey)')
def gold_votes(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("fingering"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return corpus.gold_votes(li.join(o, "l_orderkey"), keys=["o_custkey"])


@query("advice_votes", "exercise:i fingering:s votes:i", "SELECT l_suppkey AS exercise, l_returnflag || l_linestatus AS fingering, count(*) AS votes FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag LIKE '%R%' GROUP BY 1, 2")
def advice_votes(spark, d):
    from handspan.sources.abcd import advice_votes as votes

    s = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("exercise"), F.concat("l_returnflag", "l_linestatus").alias("fingering"), F.col("l_returnflag").alias("study"))
    e = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("exercise"), F.lit(2).alias("note_count"))
    return votes(s, e, study="%R%")


@query("order_notes", "score_id:i note_idx:i onset_ms:i midi:i", "SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY onset_ms, midi) - 1 AS note_idx, onset_ms, midi FROM (SELECT DISTINCT score_id, onset_ms // 5000 AS onset_ms, midi FROM notes)")
def order_notes(spark, d):
    n = bound_notes(spark, d).withColumn("onset_ms", F.floor(F.col("onset_ms") / 5000))
    return corpus.order_notes(n)


@query("gold_missing", "score_id:i midi:i", "SELECT DISTINCT score_id, midi FROM notes EXCEPT SELECT score_id, midi FROM notes WHERE digit = digit_b")
def gold_missing(spark, d):
    """Pitches on whose finger the annotators never agree."""
    n = bound_notes(spark, d)
    return corpus.gold_missing(n, n.where("digit = digit_b"), fingering="midi")


@query("by_cost", "score_id:i cost:d n:i", "SELECT score_id, dur_ms // 50 AS cost, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY score_id ORDER BY dur_ms // 50) AS r FROM notes) WHERE r <= 5 GROUP BY 1, 2")
def by_cost(spark, d):
    s = bound_notes(spark, d).select("score_id", F.floor(F.col("dur_ms") / 50).alias("cost"), F.col("digit").cast("string").alias("fingering"))
    return corpus.by_cost(s, 5).withColumn("n", F.size("fingerings"))


@query("trim_at_last_gold", "score_id:i rank:i hit:b", "SELECT score_id, rank, hit FROM (SELECT *, max(CASE WHEN hit THEN rank END) OVER (PARTITION BY score_id) AS last FROM (SELECT score_id, note_idx + 1 AS rank, event_id % 7 = 3 AS hit FROM notes)) WHERE rank <= last")
def trim_at_last_gold(spark, d):
    return corpus.trim_at_last_gold(bound_notes(spark, d).select("score_id", (F.col("note_idx") + 1).alias("rank"), (F.col("event_id") % 7 == 3).alias("hit")))


@query("combine_staves", "score_id:i rank:i fingering:s cost:d", """
  SELECT coalesce(u.score_id, l.score_id) AS score_id, coalesce(u.rank, l.rank) AS rank, coalesce(u.f, max(CASE WHEN u.rank = 1 THEN u.f END) OVER w) || '@' || coalesce(l.f, max(CASE WHEN l.rank = 1 THEN l.f END) OVER w) AS fingering,
    coalesce(u.c, max(CASE WHEN u.rank = 1 THEN u.c END) OVER w) + coalesce(l.c, max(CASE WHEN l.rank = 1 THEN l.c END) OVER w) AS cost
  FROM (SELECT score_id, note_idx + 1 AS rank, digit || '' AS f, dur_ms AS c FROM notes) u FULL JOIN (SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY digit_b) AS rank, digit_b || '' AS f, count(*) AS c FROM notes GROUP BY score_id, digit_b) l ON u.score_id = l.score_id AND u.rank = l.rank
  WINDOW w AS (PARTITION BY coalesce(u.score_id, l.score_id))""")
def combine_staves(spark, d):
    n = bound_notes(spark, d)
    u = n.select("score_id", (F.col("note_idx") + 1).alias("rank"), F.col("digit").cast("string").alias("fingering"), F.col("dur_ms").alias("cost"))
    lo = n.groupBy("score_id", "digit_b").agg(F.count("*").alias("cost"))
    lo = lo.select("score_id", F.row_number().over(Window.partitionBy("score_id").orderBy("digit_b")).alias("rank"), F.col("digit_b").cast("string").alias("fingering"), "cost")
    return corpus.combine_staves(u, lo)


#: Two-sided chance of a t, by integrating its density in 4000 steps.
_T_CHANCE = "1 - 2 * abs(t) / 4000 / 3 * list_sum(list_transform(range(0, 4001), lambda k: CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + pow(k * abs(t) / 4000, 2) / df, -(df + 1) / 2.0)))"
#: Chance of an F, likewise.
_F_CHANCE = """1 - f / 4000 / 3 * list_sum(list_transform(range(0, 4001), lambda k: CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * exp(lgamma((a + b) / 2.0) - lgamma(a / 2.0) - lgamma(b / 2.0) + a / 2.0 * ln(a / b)) * pow(k * f / 4000, a / 2.0 - 1) * pow(1 + a * k * f / 4000 / b, -(a + b) / 2.0)))"""


@query("model_vs_baseline", "event_type:s n:i mean_difference:d t:d df:i p:d", f"SELECT *, {_T_CHANCE} AS p FROM (SELECT event_type, count(*) AS n, avg(x) AS mean_difference, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM (SELECT event_type, score_id, avg(value) - avg(dur_ms) / 10.0 AS x FROM notes GROUP BY 1, 2) GROUP BY 1)")
def model_vs_baseline(spark, d):
    n = bound_notes(spark, d)
    a = n.groupBy("event_type", "score_id").agg(F.avg("value").alias("value"))
    b = n.groupBy("event_type", "score_id").agg((F.avg("dur_ms") / 10.0).alias("value"))
    return stats.paired_ttest(corpus.model_vs_baseline(a, b, on=["event_type", "score_id"]), keys=["event_type"])


# --- agreement and match rates --------------------------------------------------------------------------------------

_CONF = "SELECT s.staff, a.l AS one, b.l AS other, (SELECT count(*) FROM notes n WHERE n.staff = s.staff AND n.digit = a.l AND n.digit_b = b.l) AS n FROM (SELECT DISTINCT staff FROM notes) s, (SELECT unnest(range(1, 6)) AS l) a, (SELECT unnest(range(1, 6)) AS l) b"


def _coders(spark, d):
    return bound_notes(spark, d).select("score_id", "note_idx", "staff", F.col("digit").alias("one"), F.col("digit_b").alias("other"))


@query("confusion", "staff:s one:i other:i n:i", _CONF)
def confusion(spark, d):
    return agreement.confusion(_coders(spark, d), [1, 2, 3, 4, 5], keys=["staff"])


_KAPPA = """
  SELECT staff, n, po, pe, (po - pe) / (1 - pe) AS kappa FROM (SELECT staff, n, same / n AS po, ab / (n * n) AS pe FROM (
    SELECT staff, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(digit = digit_b AS INT)) AS DOUBLE) AS same, (SELECT CAST(sum(x.c * y.c) AS DOUBLE) FROM
      (SELECT staff, digit AS l, count(*) AS c FROM notes GROUP BY 1, 2) x JOIN (SELECT staff, digit_b AS l, count(*) AS c FROM notes GROUP BY 1, 2) y ON x.staff = y.staff AND x.l = y.l WHERE x.staff = notes.staff) AS ab
    FROM notes GROUP BY staff))"""


@query("cohens_kappa", "staff:s n:i po:d pe:d kappa:d", _KAPPA)
def cohens_kappa(spark, d):
    return agreement.cohens_kappa(agreement.confusion(_coders(spark, d), [1, 2, 3, 4, 5], keys=["staff"]), keys=["staff"])


@query("kappa_by_staff", "staff:s n:i po:d pe:d kappa:d", f"{_KAPPA} UNION ALL {_KAPPA.replace('FROM notes', 'FROM (SELECT score_id, note_idx, digit, digit_b, ' + repr('both') + ' AS staff FROM notes) notes')}")
def kappa_by_staff(spark, d):
    """Of each staff and of both, from one table of counts."""
    table = agreement.with_pooled(agreement.confusion(_coders(spark, d), [1, 2, 3, 4, 5], keys=["staff"]))
    return agreement.cohens_kappa(table, keys=["staff"])


@query("label_kappa", "n:i po:d pe:d kappa:d", "SELECT n, po, pe, (po - pe) / (1 - pe) AS kappa FROM (SELECT count(*) AS n, avg(CAST(quality = toxic AS INT)) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels)")
def label_kappa(spark, d):
    lab = spark.read.parquet(f"{d}/labels.parquet").select(F.col("quality").alias("one"), F.col("toxic").alias("other"))
    return agreement.cohens_kappa(agreement.confusion(lab, [0, 1]))


def _two(n):
    return n.select("score_id", "note_idx", F.lit("a").alias("coder"), F.col("digit").alias("value")).unionAll(n.select("score_id", "note_idx", F.lit("b"), F.col("digit_b")))


def _alpha(d: str) -> str:
    return f"""
  SELECT 2 * count(*) AS pairable, sum(dd) / count(*) AS observed, (SELECT sum(p.c * q.c * ({d.format('p.v', 'q.v')})) FROM v p, v q) / (2.0 * count(*) * (2.0 * count(*) - 1)) AS expected FROM (SELECT {d.format('digit', 'digit_b')} AS dd FROM notes)"""


_V = NOTES_SQL + ", v AS (SELECT v, CAST(count(*) AS DOUBLE) AS c FROM (SELECT digit AS v FROM notes UNION ALL SELECT digit_b FROM notes) GROUP BY 1)"


@query("alpha_nominal", "pairable:i observed:d expected:d alpha:d", f"SELECT *, 1 - observed / expected AS alpha FROM ({_alpha('CAST({0} <> {1} AS INT)')})", _V)
def alpha_nominal(spark, d):
    return agreement.krippendorff_alpha(_two(bound_notes(spark, d)), unit=("score_id", "note_idx"))


@query("alpha_interval", "pairable:i observed:d expected:d alpha:d", f"SELECT *, 1 - observed / expected AS alpha FROM ({_alpha('({0} - {1}) * ({0} - {1})')})", _V)
def alpha_interval(spark, d):
    return agreement.krippendorff_alpha(_two(bound_notes(spark, d)), agreement.interval, unit=("score_id", "note_idx"))


@query("alpha_with_candidate", "alpha:d alpha_with:d delta:d", """
  SELECT alpha, alpha_with, alpha_with - alpha AS delta FROM (SELECT
    (SELECT 1 - avg(CAST(digit <> digit_b AS INT)) / ((SELECT sum(p.c * q.c) FROM v p, v q WHERE p.v <> q.v) / (2.0 * count(*) * (2.0 * count(*) - 1))) FROM notes) AS alpha,
    (SELECT 1 - avg((CAST(digit <> digit_b AS INT) + CAST(digit <> c AS INT) + CAST(digit_b <> c AS INT)) / 3.0) / ((SELECT sum(p.c * q.c) FROM v3 p, v3 q WHERE p.v <> q.v) / (3.0 * count(*) * (3.0 * count(*) - 1))) FROM three) AS alpha_with)""",
    _V + ", three AS (SELECT *, 1 + digit % 5 AS c FROM notes), v3 AS (SELECT v, CAST(count(*) AS DOUBLE) AS c FROM (SELECT digit AS v FROM three UNION ALL SELECT digit_b FROM three UNION ALL SELECT c FROM three) GROUP BY 1)")
def alpha_with_candidate(spark, d):
    n = bound_notes(spark, d)
    model = n.select("score_id", "note_idx", F.lit("m").alias("coder"), (1 + F.col("digit") % 5).cast("int").alias("value"))
    return agreement.alpha_with_candidate(_two(n), model, unit=("score_id", "note_idx"))


_TRIGRAMS = NOTES_SQL + """, items AS (SELECT score_id, note_idx AS i, digit AS a, digit_b AS b FROM notes UNION ALL SELECT score_id, n + k, NULL, NULL FROM (SELECT score_id, count(*) AS n FROM notes GROUP BY 1), (SELECT unnest([0, 1]) AS k)),
    g AS (SELECT coalesce(lag(a, 2) OVER w || '', 'x') || coalesce(lag(a) OVER w || '', 'x') || coalesce(a || '', 'x') AS a, coalesce(lag(b, 2) OVER w || '', 'x') || coalesce(lag(b) OVER w || '', 'x') || coalesce(b || '', 'x') AS b FROM items WINDOW w AS (PARTITION BY score_id ORDER BY i)),
    v AS (SELECT v, CAST(count(*) AS DOUBLE) AS c FROM (SELECT a AS v FROM g UNION ALL SELECT b FROM g) GROUP BY 1)"""


@query("alpha_trigram", "pairable:i observed:d expected:d alpha:d", """
  SELECT *, 1 - observed / expected AS alpha FROM (SELECT 2 * count(*) AS pairable, avg(CAST(a <> b AS INT)) AS observed, (4.0 * count(*) * count(*) - (SELECT sum(c * c) FROM v)) / (2.0 * count(*) * (2.0 * count(*) - 1)) AS expected FROM g)""",
    _TRIGRAMS)
def alpha_trigram(spark, d):
    t = _two(bound_notes(spark, d)).withColumn("value", F.col("value").cast("string"))
    return agreement.alpha_ngram(t, 3, label="value")


_SOFT = "CASE WHEN {0} = {1} THEN 0.0 WHEN {0}[1] = {1}[1] AND {0}[3] = {1}[3] AND coalesce(least(TRY_CAST({0}[2] AS INT), TRY_CAST({1}[2] AS INT)) IN (2, 3) AND abs(TRY_CAST({0}[2] AS INT) - TRY_CAST({1}[2] AS INT)) = 1, false) THEN 0.01 ELSE 1.0 END"


@query("alpha_trigram_nuanced", "pairable:i observed:d expected:d alpha:d", f"""
  SELECT *, 1 - observed / expected AS alpha FROM (SELECT 2 * count(*) AS pairable, avg({_SOFT.format('a', 'b')}) AS observed, (SELECT sum(p.c * q.c * ({_SOFT.format('p.v', 'q.v')})) FROM v p, v q) / (2.0 * count(*) * (2.0 * count(*) - 1)) AS expected FROM g)""", _TRIGRAMS)
def alpha_trigram_nuanced(spark, d):
    t = _two(bound_notes(spark, d)).withColumn("value", F.col("value").cast("string"))
    return agreement.alpha_ngram(t, 3, lambda a, b: agreement.trigram_distance(a, b, nuanced=True), label="value")


@query("simple_match_rate", "score_id:i matches:i notes:i rate:d", "SELECT score_id, sum(CAST(digit = digit_b AS INT)) AS matches, count(*) AS notes, avg(CAST(digit = digit_b AS INT)) AS rate FROM notes GROUP BY 1")
def simple_match_rate(spark, d):
    t = _two(bound_notes(spark, d))
    return matchrates.simple_match_rate(matchrates.pair_annotations(t, t))


_RATES = """
  SELECT score_id, staff, count(*) AS notes, 2 AS truths, (sum(a) + sum(b)) / (2.0 * count(*)) AS gen, greatest(avg(a), avg(b)) AS high, avg(greatest(a, b)) AS soft
  FROM (SELECT *, CAST(p = digit AS INT) AS a, CAST(p = digit_b AS INT) AS b FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN digit ELSE 1 + (event_id % 5) END AS p FROM notes)) GROUP BY 1, 2"""


def _predictions(spark, d):
    n = bound_notes(spark, d)
    p = n.withColumn("a", F.when(F.col("event_id") % 3 == 0, F.col("digit")).otherwise((1 + F.col("event_id") % 5).cast("int")))
    return p.select("score_id", "staff", "note_idx", "a", F.explode(F.create_map(F.lit("a"), F.col("digit"), F.lit("b"), F.col("digit_b"))).alias("b_coder", "b"))


@query("note_rates_multi", "score_id:i notes:i truths:i gen:d high:d soft:d", _RATES)
def note_rates_multi(spark, d):
    return matchrates.note_rates(_predictions(spark, d))


@query("match_rates", "staff:s rate:s segments:i mean:d weighted_mean:d stdev:d weighted_stdev:d", f"""
  SELECT coalesce(staff, 'combined') AS staff, rate, count(*) AS segments, avg(v) AS mean, sum(v * notes) / sum(notes) AS weighted_mean, stddev_samp(v) AS stdev, sqrt(greatest(sum(v * v * notes) / sum(notes) - pow(sum(v * notes) / sum(notes), 2), 0)) AS weighted_stdev
  FROM (SELECT staff, notes, unnest(['gen', 'high', 'soft']) AS rate, unnest([gen, high, soft]) AS v FROM ({_RATES})) GROUP BY GROUPING SETS ((staff, rate), (rate))""")
def match_rates(spark, d):
    return matchrates.match_rates(_predictions(spark, d))


@query("corpus_match_rates", "gen:d high:d soft:d uniform_gen:d", f"SELECT sum(gen * notes) / sum(notes) AS gen, sum(high * notes) / sum(notes) AS high, sum(soft * notes) / sum(notes) AS soft, avg(gen) AS uniform_gen FROM ({_RATES})")
def corpus_match_rates(spark, d):
    r = matchrates.note_rates(_predictions(spark, d))
    u = matchrates.corpus_match_rates(r, weight="uniform").select(F.col("gen").alias("uniform_gen"))
    return matchrates.corpus_match_rates(r).crossJoin(u)  # one row each


@query("human_match_rates", "score_id:i a_coder:s notes:i gen:d", "SELECT score_id, unnest(['a', 'b']) AS a_coder, notes, gen FROM (SELECT score_id, count(*) AS notes, avg(CAST(digit = digit_b AS INT)) AS gen FROM notes GROUP BY 1)")
def human_match_rates(spark, d):
    return matchrates.human_match_rates(_two(bound_notes(spark, d)))


@query("classification_report", "label:i support:i predicted_n:i precision:d recall:d f1:d", """
  SELECT label, support, predicted_n, hit / nullif(predicted_n, 0)::DOUBLE AS precision, hit / nullif(support, 0)::DOUBLE AS recall, 2.0 * hit / (support + predicted_n) AS f1 FROM (
    SELECT l AS label, sum(CAST(digit = l AS INT)) AS support, sum(CAST(digit_b = l AS INT)) AS predicted_n, sum(CAST(digit = l AND digit_b = l AS INT)) AS hit FROM notes, (SELECT unnest(range(1, 6)) AS l) GROUP BY 1)""")
def classification_report(spark, d):
    return matchrates.classification_report(_coders(spark, d), truth="one", predicted="other")


@query("weighted_f1", "accuracy:d weighted_f1:d", """
  SELECT sum(hit) / sum(support)::DOUBLE AS accuracy, sum(2.0 * hit / (support + predicted_n) * support) / sum(support) AS weighted_f1 FROM (
    SELECT l AS label, sum(CAST(digit = l AS INT)) AS support, sum(CAST(digit_b = l AS INT)) AS predicted_n, sum(CAST(digit = l AND digit_b = l AS INT)) AS hit FROM notes, (SELECT unnest(range(1, 6)) AS l) GROUP BY 1)""")
def weighted_f1(spark, d):
    return matchrates.weighted_f1(matchrates.classification_report(_coders(spark, d), truth="one", predicted="other"))


@query("example_accuracy", "examples:i example_accuracy:d token_accuracy:d", "SELECT count(DISTINCT score_id) AS examples, (SELECT avg(m) FROM (SELECT min(CAST(digit = digit_b AS INT)) AS m FROM notes GROUP BY score_id)) AS example_accuracy, avg(CASE WHEN note_idx > 0 AND note_idx < last THEN CAST(digit = digit_b AS INT) END) AS token_accuracy FROM (SELECT *, max(note_idx) OVER (PARTITION BY score_id) AS last FROM notes)")
def example_accuracy(spark, d):
    return matchrates.example_accuracy(_coders(spark, d), truth="one", predicted="other")


@query("verbatim_match_counts", "score_id:i annotators:i exact:i near:i distance:i", "SELECT score_id, 1 AS annotators, min(CAST(digit = digit_b AS INT)) AS exact, min(CAST(digit = digit_b OR (least(digit, digit_b) IN (2, 3) AND abs(digit - digit_b) = 1) AS INT)) AS near, sum(CAST(digit <> digit_b AS INT)) AS distance FROM notes GROUP BY 1")
def verbatim_match_counts(spark, d):
    t = _two(bound_notes(spark, d))
    return matchrates.verbatim_match_counts(matchrates.pair_annotations(t, t), measures.adjacent_long(F.col("a"), F.col("b")))


# --- statistics -----------------------------------------------------------------------------------------------------


@query("one_way_anova", "groups:i n:i ss_between:d ss_within:d f:d p:d", f"""
  SELECT *, {_F_CHANCE} AS p FROM (SELECT *, groups - 1.0 AS a, CAST(n - groups AS DOUBLE) AS b FROM (SELECT g AS groups, n, round(b, 3) AS ss_between, round(w, 3) AS ss_within, (b / (g - 1)) / (w / (n - g)) AS f FROM (SELECT count(*) AS g, sum(c) AS n, sum(c * pow(m - gm, 2)) AS b, sum(c * v) AS w FROM (SELECT event_type, count(*) AS c, avg(value) AS m, var_pop(value) AS v, (SELECT avg(value) FROM notes) AS gm FROM notes GROUP BY 1))))""")
def one_way_anova(spark, d):
    a = stats.one_way_anova(bound_notes(spark, d), group="event_type")
    return a.withColumns({"ss_between": F.round("ss_between", 3), "ss_within": F.round("ss_within", 3)})


@query("pairwise_mean_diff", "a:s b:s difference:d", "SELECT x.event_type AS a, y.event_type AS b, x.m - y.m AS difference FROM (SELECT event_type, avg(value) AS m FROM notes GROUP BY 1) x JOIN (SELECT event_type, avg(value) AS m FROM notes GROUP BY 1) y ON x.event_type < y.event_type")
def pairwise_mean_diff(spark, d):
    return stats.pairwise_mean_diff(bound_notes(spark, d), group="event_type")


@query("repeat_by_weight", "score_id:i n:i total:i", "SELECT score_id, sum(digit) AS n, sum(digit * midi) AS total FROM notes GROUP BY 1")
def repeat_by_weight(spark, d):
    return stats.repeat_by_weight(bound_notes(spark, d), weight="digit").groupBy("score_id").agg(F.count("*").alias("n"), F.sum("midi").alias("total"))


@query("feature_tallies", "feature:s value:s n:i evaluations:i most:i", "SELECT feature, v AS value, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS evaluations, max(count(*)) OVER (PARTITION BY feature) AS most FROM (SELECT unnest(['digit', 'hand', 'midi']) AS feature, unnest([digit || '', hand, midi || '']) AS v FROM notes) GROUP BY 1, 2")
def feature_tallies(spark, d):
    return stats.feature_tallies(bound_notes(spark, d), ["digit", "hand", "midi"])


# --- rule models ----------------------------------------------------------------------------------------------------

def _span(field: str, a: str = "d1", b: str = "d2", table: str = "parncutt") -> str:
    at = f"CAST(({a} - 1) * 5 + {b} AS INT)"
    return f"CASE WHEN h2 = '>' THEN list_extract({dims.span_array(table, field, '>')}, {at}) ELSE list_extract({dims.span_array(table, field, '<')}, {at}) END"


def _spread(field: str, table: str = "parncutt") -> str:
    return f"list_extract({dims.span_array(table, field)}, CAST((least(d1, d2) - 1) * 5 + greatest(d1, d2) AS INT))"


def _rules_sql(table: str = "parncutt", step: str = "greatest(least(m2 - m1, 17), -17)", skip: str = "greatest(least(m3 - m1, 17), -17)") -> dict[str, str]:
    s12 = lambda f: _span(f, table=table)
    s13 = lambda f: _span(f, "d1", "d3", table)
    b = {k: black(f"m{k}") for k in (1, 2, 3)}
    pen = "CASE WHEN d1 = 1 OR d2 = 1 THEN 1 ELSE {0} END"
    follow = "((d1 < d2 AND m1 < m2) OR (d1 > d2 AND m1 > m2))"
    out = "CASE WHEN h2 = '>' THEN d2 - d1 ELSE d1 - d2 END"
    ins = "CASE WHEN h2 = '>' THEN m2 < m1 ELSE m2 > m1 END"
    outs = "CASE WHEN h2 = '>' THEN m2 > m1 ELSE m2 < m1 END"
    pcc = f"CASE WHEN {skip} > {s13('max_comf')} THEN CASE WHEN d2 = 1 AND ((m1 < m2 AND m2 < m3) OR (m3 < m2 AND m2 < m1)) AND {skip} > {s13('max_prac')} THEN 2 ELSE 1 END WHEN {skip} < {s13('min_comf')} THEN CASE WHEN d2 = 1 AND ((m1 < m2 AND m2 < m3) OR (m3 < m2 AND m2 < m1)) AND {skip} < {s13('min_prac')} THEN 2 ELSE 1 END ELSE 0 END"
    small = f"CASE WHEN {out} > 0 THEN greatest({s12('min_rel')} - {step}, 0) WHEN {out} < 0 THEN greatest({step} - {s12('max_rel')}, 0) ELSE 0 END"
    r = {
        "str": f"2 * (greatest({step} - {s12('max_comf')}, 0) + greatest({s12('min_comf')} - {step}, 0))",
        "sma": f"{pen.format(2)} * {small}", "smaw": small,
        "smal": f"{pen.format(2)} * greatest({s12('min_rel')} - {step}, 0)", "larl": f"{pen.format(2)} * greatest({step} - {s12('max_rel')}, 0)",
        "lar": f"CASE WHEN {follow} THEN {pen.format(2)} * greatest(abs({step}) - {_spread('max_rel', table)}, 0) END",
        "larj": f"CASE WHEN {follow} THEN greatest(abs({step}) - {_spread('max_rel', table)}, 0) END",
        "larb": f"CASE WHEN {follow} THEN {pen.format(2)} * greatest(abs({step}) - CASE WHEN m3 IS NOT NULL AND {pcc} <= 1 THEN {_spread('max_comf', table)} ELSE {_spread('max_rel', table)} END, 0) END",
        "pcc": pcc, "pcs": f"greatest({s13('min_comf')} - {skip}, 0) + greatest({skip} - {s13('max_comf')}, 0)",
        "wea": "CAST(d2 IN (4, 5) AS INT)", "weaj": "CAST(d2 = 4 AS INT)", "345": "CAST(list_sort([d1, d2, d3]) = [3, 4, 5] AS INT)", "3t4": "CAST(d1 = 3 AND d2 = 4 AS INT)",
        "bl4": f"CAST((d1 = 4 AND {b[1]} AND d2 = 3 AND NOT {b[2]}) OR (d1 = 3 AND NOT {b[1]} AND d2 = 4 AND {b[2]}) AS INT)",
        "bl1": f"CASE WHEN d2 = 1 AND {b[2]} THEN 1 + 2 * CAST(coalesce(NOT {b[1]}, false) AS INT) + 2 * CAST(coalesce(NOT {b[3]}, false) AS INT) END",
        "bl5": f"CASE WHEN d2 = 5 AND {b[2]} THEN 2 * CAST(coalesce(NOT {b[1]}, false) AS INT) + 2 * CAST(coalesce(NOT {b[3]}, false) AS INT) END",
        "pa1": f"CASE WHEN d2 = 1 AND {outs} AND {b[1]} = {b[2]} THEN 1 WHEN d2 = 1 AND {outs} AND {b[2]} THEN 3 WHEN d1 = 1 AND {ins} AND {b[1]} = {b[2]} THEN 1 WHEN d1 = 1 AND {ins} AND {b[1]} THEN 3 END",
        "aprb": "CAST(d1 = d3 AND (d1, d2) IN ((3, 4), (4, 3), (4, 5), (5, 4)) AS INT)", "afcb": "CAST(m1 = m3 AND d1 <> d3 AS INT)",
        "b1pb": f"CASE WHEN m1 <> m2 AND (({ins} AND d1 = 1 AND {b[1]} AND d2 IN (4, 5) AND NOT {b[2]}) OR (NOT {ins} AND d2 = 1 AND {b[2]} AND d1 IN (4, 5) AND NOT {b[1]})) THEN d2 - 1 END",
        "b1wb": f"CASE WHEN m1 <> m2 AND d1 = 1 AND {b[1]} AND NOT {b[2]} AND d2 IN (4, 5) AND ({ins} OR {step} < {s12('min_rel')}) THEN d2 - 1 END",
        "wb1b": f"CASE WHEN m1 <> m2 AND d2 = 1 AND {b[2]} AND NOT {b[1]} AND d1 IN (4, 5) AND ({outs} OR {step} > {s12('max_rel')}) THEN d1 - 1 END",
        "pchw": f"CAST({skip} < {s13('min_comf')} OR {skip} > {s13('max_comf')} AS INT) + CAST(({skip} < {s13('min_comf')} OR {skip} > {s13('max_comf')}) AND m1 < m2 AND m2 < m3 AND d2 = 1 AND ({skip} < {s13('min_prac')} OR {skip} > {s13('max_prac')}) AS INT) + CAST(m1 = m3 AND d1 <> d3 AS INT)",
        "pcow": f"greatest({s13('min_comf')} - {skip}, 0) + greatest({skip} - {s13('max_comf')}, 0)",
        "rfrw": f"CAST(m1 <> m3 AND d1 = d3 AND {pcc} > 0 AS INT)", "impw": f"10 * (greatest({step} - {s12('max_prac')}, 0) + greatest({s12('min_prac')} - {step}, 0))",
        "nrfw": "CAST(m1 = m2 AND d1 <> d2 AS INT)",
    }
    return {k: f"coalesce(CASE WHEN m1 IS NOT NULL OR {k in ('wea', 'weaj', 'bl1', 'bl5')} THEN {v} END, 0)" if k not in ("pcc", "pcs", "pchw", "pcow", "rfrw") else f"coalesce(CASE WHEN m1 IS NOT NULL AND m3 IS NOT NULL THEN {v} END, 0)" for k, v in ((k, f"({v})") for k, v in r.items())}


_TRI = f"SELECT score_id, note_idx, hand AS h2, lag(midi) {W} AS m1, midi AS m2, lead(midi) {W} AS m3, lag(digit) {W} AS d1, digit AS d2, lead(digit) {W} AS d3 FROM notes"
_RULES = _rules_sql()
_TAGS = list(_RULES)


@query("rule_costs", "score_id:i note_idx:i " + " ".join(f"r_{t}:i" for t in _TAGS), f"SELECT score_id, note_idx, {', '.join(f'{v} AS r_{k}' for k, v in _RULES.items())} FROM ({_TRI})")
def rule_costs(spark, d):
    return search.rule_costs(search.with_trigrams(bound_notes(spark, d)), _TAGS)


_JACOBS = "str sma larj pcc pcs weaj 3t4 bl4 bl1 bl5 pa1"
_BADGEROW = "str sma larb pcc pcs wea 345 3t4 bl4 bl1 bl5 pa1 aprb afcb b1wb b1pb"
#: What the published code gives each model: rules, spans, ruler, and rules of half weight.
_MODELS = {
    "parncutt": ("str sma lar pcc pcs wea 345 3t4 bl4 bl1 bl5 pa1", "parncutt", "semitone", ""),
    "jacobs": (_JACOBS, "parncutt", "physical", ""),
    "jarules": (_JACOBS, "parncutt", "semitone", ""),
    "jaball": (_JACOBS, "balliauw_large", "imaginary", ""),
    "jaSball": (_JACOBS, "balliauw_small", "imaginary", ""),
    "jaMball": (_JACOBS, "balliauw_medium", "imaginary", ""),
    "badgerow": (_BADGEROW, "badgerow", "semitone", ""),
    "badpar": (_BADGEROW, "parncutt", "semitone", ""),
    "balliauw": ("str smaw pchw pcow weaj 3t4 bl4 bl1 bl5 pa1 rfrw impw nrfw", "balliauw_large", "imaginary", "bl1 bl5"),
    "badball": (_BADGEROW, "balliauw_large", "imaginary", ""),
    "badSball": (_BADGEROW, "balliauw_small", "imaginary", ""),
    "badMball": (_BADGEROW, "balliauw_medium", "imaginary", ""),
}


def _millimetres(a: str, b: str) -> str:
    at = keys.key_positions()
    return f"CASE WHEN {b} < {a} THEN -1 ELSE 1 END * len(list_filter({keys.semitone_bounds()!r}, lambda x: x < abs(list_extract({at!r}, CAST({b} - 20 AS INT)) - list_extract({at!r}, CAST({a} - 20 AS INT)))))"


def _preset(name: str) -> str:
    tags, table, ruler, half = _MODELS[name]
    ruler = {"semitone": lambda a, b: f"greatest(least({b} - {a}, 17), -17)", "imaginary": lambda a, b: f"({imaginary(b)} - {imaginary(a)})", "physical": _millimetres}[ruler]
    r = _rules_sql(table, ruler("m1", "m2"), ruler("m1", "m3"))
    return " + ".join(f"{0.5 if t in half.split() else 1.0} * {r[t]}" for t in tags.split())


def _costed(name: str):
    @query(f"segment_cost_{name}", "score_id:i notes:i cost:d", f"SELECT score_id, count(*) AS notes, sum({_preset(name)}) AS cost FROM ({_TRI}) GROUP BY 1 HAVING count(*) >= 3")
    def cost(spark, d):
        return search.segment_cost(bound_notes(spark, d), name)

    return cost


for _name in _MODELS:
    _costed(_name)


def _phrases(spark, d):
    n = sequence.with_segments(bound_notes(spark, d), level=".")
    return n.select("score_id", "segment_idx", "note_idx", "midi", "hand", "digit")


PHRASE = ("score_id", "segment_idx")


#: Phrases end at full stops.
_SEG_FULL = "coalesce(sum(CASE WHEN seg_mark = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY note_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_SEGS = NOTES_SQL + f", cut AS (SELECT *, {_SEG_FULL} AS segment_idx FROM notes), seg AS (SELECT *, count(*) OVER (PARTITION BY score_id, segment_idx) AS len, row_number() OVER (PARTITION BY score_id, segment_idx ORDER BY note_idx) - 1 AS pos FROM cut)"


def _searched(cost: str, allowed: str, k: int, ring: bool = False, more: str = "", segs: str | None = None) -> str:
    """Tables to search phrases step by step: `tri` (notes and neighbours), `cand` (digits of three notes with costs) and `best` (the k cheapest, by cost and digits).

    ring: the first note comes again at the end, and paths with different first fingers are kept apart, to be closed.
    more: tables that costs look into, made of `seg`. segs: what makes `seg`, where that isn't the phrases.
    """
    notes = "seg" if not ring else "(SELECT score_id, segment_idx, pos, len + 1 AS len, digit, hand, midi FROM seg UNION ALL SELECT score_id, segment_idx, len, len + 1, digit, hand, midi FROM seg WHERE pos = 0)"
    apart, closed = (", p.digits[1]", " AND digits[1] = digits[-1]") if ring else ("", "")
    return "RECURSIVE " + (segs or _SEGS) + f""", five AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS d){more}, tri AS (
  SELECT *, hand AS h2, lag(midi) OVER p AS m1, midi AS m2, lead(midi) OVER p AS m3 FROM {notes} WINDOW p AS (PARTITION BY score_id, segment_idx ORDER BY pos)
), cand AS MATERIALIZED (
  SELECT score_id, segment_idx, pos, len, m1, m3, d1, d2, d3, CAST({cost} AS DOUBLE) AS cost
  FROM (SELECT tri.*, a.d AS d1, b.d AS d2, c.d AS d3 FROM tri, five a, five b, five c WHERE (m1 IS NOT NULL OR a.d = 1) AND (m3 IS NOT NULL OR c.d = 1)) WHERE {allowed}
), paths AS (
  SELECT score_id, segment_idx, pos, len, d2 AS a, d3 AS b, cost, CASE WHEN len = 1 THEN d2 || '' ELSE d2 || '' || d3 END AS digits FROM cand WHERE pos = 0
  UNION ALL
  SELECT score_id, segment_idx, pos, len, a, b, cost, digits FROM (
    SELECT p.score_id, p.segment_idx, c.pos, c.len, c.d2 AS a, c.d3 AS b, p.cost + c.cost AS cost, p.digits || CASE WHEN c.pos < c.len - 1 THEN c.d3 || '' ELSE '' END AS digits,
      row_number() OVER (PARTITION BY p.score_id, p.segment_idx, c.d2, c.d3{apart} ORDER BY p.cost + c.cost, p.digits || CASE WHEN c.pos < c.len - 1 THEN c.d3 || '' ELSE '' END) AS r
    FROM paths p JOIN cand c ON c.score_id = p.score_id AND c.segment_idx = p.segment_idx AND c.pos = p.pos + 1 AND c.d1 = p.a AND c.d2 = p.b) WHERE r <= {k}
), best AS (
  SELECT * FROM (SELECT score_id, segment_idx, len, digits, cost, row_number() OVER (PARTITION BY score_id, segment_idx ORDER BY cost, digits) AS rank FROM paths WHERE pos = len - 1{closed}) WHERE rank <= {k}
)"""


_LONE = f"SELECT score_id, segment_idx, 1 AS rank, CASE WHEN {black('midi')} THEN '2' ELSE '1' END AS digits, 0.0 AS cost FROM seg WHERE len = 1"
_BEST = f"SELECT score_id, segment_idx, rank, digits, cost FROM best WHERE len > 1 UNION ALL {_LONE}"
_ADVISED = f"{_BEST} UNION ALL SELECT DISTINCT score_id, segment_idx, 0, NULL, NULL FROM seg WHERE len > 1 AND NOT EXISTS (SELECT 1 FROM best WHERE best.score_id = seg.score_id AND best.segment_idx = seg.segment_idx)"


def _move(a: str, b: str, table: str = "parncutt") -> str:
    fingers = {"1": "d1", "2": "d2", "3": "d3"}
    return f"CASE WHEN m{a} IS NULL OR m{b} IS NULL THEN true WHEN m{a} = m{b} THEN {fingers[a]} = {fingers[b]} ELSE {fingers[a]} <> {fingers[b]} AND m{b} - m{a} <= {_span('max_prac', fingers[a], fingers[b], table)} END"


_PLAYABLE = f"({_move('1', '2')}) AND ({_move('2', '3')})"


@query("advise_parncutt", "score_id:i segment_idx:i rank:i digits:s cost:d", _ADVISED, _searched(_preset("parncutt"), _PLAYABLE, 5))
def advise_parncutt(spark, d):
    """The five cheapest fingerings of every phrase; one that can't be played has a row of rank 0."""
    return search.advise(_phrases(spark, d), "parncutt", 5, keys=PHRASE)


@query("advise_details", "score_id:i segment_idx:i rank:i note_idx:i digit:i cost:d rules:d", f"""
  SELECT score_id, segment_idx, rank, note_idx, d2 AS digit, {_preset("parncutt")} AS cost, {_preset("parncutt")} AS rules FROM (
    SELECT *, lag(m2) OVER w AS m1, lead(m2) OVER w AS m3, lag(d2) OVER w AS d1, lead(d2) OVER w AS d3 FROM (
      SELECT a.score_id, a.segment_idx, a.rank, s.note_idx, s.pos, s.hand AS h2, s.midi AS m2, CAST(a.digits[s.pos + 1] AS INT) AS d2 FROM ({_ADVISED}) a JOIN seg s ON s.score_id = a.score_id AND s.segment_idx = a.segment_idx AND a.rank > 0)
    WINDOW w AS (PARTITION BY score_id, segment_idx, rank ORDER BY pos))""", _searched(_preset("parncutt"), _PLAYABLE, 2))
def advise_details(spark, d):
    """What each note of the two cheapest fingerings costs, and the sum of its rules' map."""
    p = _phrases(spark, d)
    out = search.suggestion_details(search.advise(p, "parncutt", 2, keys=PHRASE), p, keys=PHRASE)
    return out.withColumn("rules", F.aggregate(F.map_values("detail"), F.lit(0.0), lambda a, x: a + x))


@query("fingering_count", "score_id:i segment_idx:i paths:d", "SELECT score_id, segment_idx, 5 * product(CASE WHEN m1 IS NULL THEN 1.0 WHEN m1 = midi THEN 1.0 ELSE 4.0 END) AS paths FROM (SELECT *, lag(midi) OVER (PARTITION BY score_id, segment_idx ORDER BY note_idx) AS m1 FROM seg) GROUP BY 1, 2", _SEGS)
def fingering_count(spark, d):
    return search.fingering_count(_phrases(spark, d), keys=PHRASE)


_UP = "((m2 > m1) = (h2 = '>'))"
_INTERVAL = f"""CASE WHEN m1 IS NULL THEN 0 WHEN abs(m2 - m1) > 12 THEN 999 ELSE abs(abs(m2 - m1) - 2 * (CASE WHEN {_UP} THEN d2 - d1 ELSE d1 - d2 END))
  + CASE WHEN CASE WHEN {_UP} THEN d2 = 1 AND {black('m2')} ELSE d1 = 1 AND {black('m1')} END THEN 3 ELSE 0 END END"""


@query("table_advise", "score_id:i segment_idx:i rank:i digits:s cost:d", _BEST, _searched(_INTERVAL, "true", 3))
def table_advise(spark, d):
    return search.table_advise(_phrases(spark, d), interval_costs(spark), 3, keys=PHRASE)


@query("transition_weights", "p:i q:i f:i g:i weight:d", f"""
  SELECT p, q, f, g, sum(share) AS weight FROM (
    SELECT score_id, p, midi AS q, f, digit AS g, count(*) / CAST(sum(count(*)) OVER (PARTITION BY score_id, p, midi) AS DOUBLE) AS share FROM (SELECT *, lag(midi) {W} AS p, lag(digit) {W} AS f FROM notes) WHERE p IS NOT NULL GROUP BY score_id, p, midi, f, digit)
  GROUP BY 1, 2, 3, 4""")
def transition_weights(spark, d):
    return search.transition_weights(bound_notes(spark, d))


_LEARNT = """-coalesce((SELECT round(sum(share), 6) FROM (
    SELECT p, q, f, g, count(*) / CAST(sum(count(*)) OVER (PARTITION BY score_id, segment_idx, p, q) AS DOUBLE) AS share FROM (
      SELECT score_id, segment_idx, lag(midi) OVER s AS p, midi AS q, lag(digit) OVER s AS f, digit AS g FROM seg WINDOW s AS (PARTITION BY score_id, segment_idx ORDER BY pos)) WHERE p IS NOT NULL GROUP BY score_id, segment_idx, p, q, f, g) w
  WHERE w.p = m1 AND w.q = m2 AND w.f = d1 AND w.g = d2), 0)"""


@query("trained_advise", "score_id:i segment_idx:i rank:i digits:s cost:d", _BEST, _searched(_LEARNT, "true", 2))
def trained_advise(spark, d):
    """By shares in millionths, so that equal sums are ties for any order of adding up."""
    p = _phrases(spark, d)
    return search.trained_advise(p, search.transition_weights(p, keys=PHRASE).withColumn("weight", F.round("weight", 6)), 2, keys=PHRASE)


@query("random_advise", "score_id:i rank:i notes:i valid:b", "SELECT score_id, rank, count(*) AS notes, true AS valid FROM notes, (SELECT unnest(range(1, 4)) AS rank) GROUP BY 1, 2")
def random_advise(spark, d):
    return search.random_advise(bound_notes(spark, d), 3).select("score_id", "rank", F.length("digits").alias("notes"), F.col("digits").rlike("^[1-5]+$").alias("valid"))


@query("bad_fingers", "score_id:i segment_idx:i note_idx:i position:i bad:s", """
  SELECT score_id, segment_idx, note_idx, position, coalesce(string_agg(f.d || '', '' ORDER BY f.d) FILTER (WHERE NOT list_contains(used, f.d)), '') AS bad FROM (
    SELECT c.score_id, c.segment_idx, s.note_idx, position, list(DISTINCT CASE position WHEN -1 THEN d1 WHEN 0 THEN d2 ELSE d3 END) AS used
    FROM (SELECT *, min(cost) OVER (PARTITION BY score_id, segment_idx, pos) AS least FROM cand) c JOIN seg s USING (score_id, segment_idx, pos), (SELECT unnest([-1, 0, 1]) AS position)
    WHERE cost = least AND (position = 0 OR position = -1 AND m1 IS NOT NULL OR position = 1 AND m3 IS NOT NULL) GROUP BY 1, 2, 3, 4), five f GROUP BY 1, 2, 3, 4""",
    _searched(_preset("parncutt"), "(m1 IS NULL OR d1 <> d2) AND (m3 IS NULL OR d2 <> d3)", 1))
def bad_fingers(spark, d):
    return search.bad_fingers(_phrases(spark, d), keys=PHRASE).withColumn("bad", F.array_join("bad", ""))


#: Every beginning of a phrase as a phrase of its own, numbered by 100 * segment_idx: 0 the whole one, p + 1 that from place p on with gold's finger there.
_RESTARTS = _SEGS.replace("seg AS (", "whole_seg AS (") + ", seg AS (SELECT score_id, segment_idx * 100 + s AS segment_idx, note_idx, midi, hand, digit, pos - greatest(s - 1, 0) AS pos, len - greatest(s - 1, 0) AS len FROM whole_seg, (SELECT unnest(range(0, 100)) AS s) WHERE pos >= s - 1)"


@query("strike_reentry", "score_id:i segment_idx:i corrections:i distance:i playable:b", """
  SELECT score_id, phrase AS segment_idx, max(corrections) AS corrections, max(corrections) AS distance, arg_max(playable, corrections) AS playable FROM walk GROUP BY 1, 2""",
  _searched(_preset("parncutt"), f"{_PLAYABLE} AND (pos > 0 OR segment_idx % 100 = 0 OR d2 = digit)", 1, segs=_RESTARTS) + f""", advised AS (
  SELECT score_id, segment_idx, digits FROM best WHERE len > 1 OR segment_idx % 100 > 0 UNION ALL SELECT score_id, segment_idx, CASE WHEN {black('midi')} THEN '2' ELSE '1' END FROM seg WHERE len = 1 AND segment_idx % 100 = 0
), wrong AS (
  SELECT a.score_id, a.segment_idx, min(CASE WHEN CAST(a.digits[s.pos + 1] AS INT) <> s.digit THEN s.pos END) AS at FROM advised a JOIN seg s ON s.score_id = a.score_id AND s.segment_idx = a.segment_idx GROUP BY 1, 2
), walk AS (
  SELECT p.score_id, p.segment_idx // 100 AS phrase, 0::BIGINT AS p, 0 AS corrections, m.at, m.score_id IS NOT NULL AS playable FROM (SELECT DISTINCT score_id, segment_idx FROM seg WHERE segment_idx % 100 = 0) p LEFT JOIN wrong m ON m.score_id = p.score_id AND m.segment_idx = p.segment_idx
  UNION ALL
  SELECT w.score_id, w.phrase, w.p + w.at, w.corrections + 1, m.at, m.score_id IS NOT NULL FROM walk w LEFT JOIN wrong m ON m.score_id = w.score_id AND m.segment_idx = w.phrase * 100 + w.p + w.at + 1 WHERE w.at IS NOT NULL
)""")
def strike_reentry(spark, d):
    return search.strike_reentry(_phrases(spark, d), keys=PHRASE)


@query("edit_distances", "score_id:i hamming:i natural:i pivot:i", """
  SELECT score_id, sum(CAST(digit <> digit_b AS INT)) AS hamming, sum(abs(digit - digit_b)) AS natural, sum(abs(digit - digit_b) + CASE WHEN (digit = 1) <> (digit_b = 1) THEN 3 ELSE 0 END) AS pivot FROM notes GROUP BY 1""")
def edit_distances(spark, d):
    n = bound_notes(spark, d)
    dist = lambda m: F.sum(dims.edit_distance(m, F.col("hand"), F.col("digit"), F.col("hand"), F.col("digit_b"))).alias(m)
    return n.groupBy("score_id").agg(dist("hamming"), dist("natural"), dist("pivot"))


@query("cross_hand_distances", "score_id:i natural:i pivot:i", """
  SELECT score_id, sum(CASE WHEN o = hand THEN abs(digit - digit_b) ELSE digit + digit_b - 1 END) AS natural,
    sum(CASE WHEN o = hand THEN abs(digit - digit_b) + CASE WHEN (digit = 1) <> (digit_b = 1) THEN 3 ELSE 0 END ELSE digit + digit_b + 8 END) AS pivot
  FROM (SELECT *, CASE WHEN event_id % 4 = 1 THEN '<' ELSE '>' END AS o FROM notes) GROUP BY 1""")
def cross_hand_distances(spark, d):
    n = bound_notes(spark, d).withColumn("o", F.when(F.col("event_id") % 4 == 1, "<").otherwise(">"))
    dist = lambda m: F.sum(dims.edit_distance(m, F.col("hand"), F.col("digit"), F.col("o"), F.col("digit_b"))).alias(m)
    return n.groupBy("score_id").agg(dist("natural"), dist("pivot"))


# The spans of rising right-hand pairs in which the two tables differ (pair, field, values), and of the left hand's own.
_DIFFERING = """
  SELECT * FROM (VALUES (1, 2, 'max_comf', 8, 9), (1, 3, 'min_rel', 3, 1), (1, 3, 'max_comf', 10, 11), (1, 4, 'min_rel', 5, 2), (1, 4, 'max_comf', 12, 13), (1, 5, 'max_comf', 13, 14), (2, 3, 'max_comf', 3, 2)) AS t(x, y, field, a, b)"""
_LEFT_DIFFERING = """
  SELECT * FROM (VALUES (1, 2, 'max_comf', 8, 9), (1, 3, 'min_rel', 3, 1), (1, 3, 'max_comf', 10, 11), (1, 4, 'min_rel', 5, 3), (1, 4, 'max_comf', 12, 13), (1, 5, 'max_comf', 13, 14)) AS t(x, y, field, a, b)"""


@query("span_diff", "hd1:s hd2:s field:s a:i b:i events:i", f"""
  SELECT hd1, hd2, field, a, b, events FROM (
    SELECT '>' || x AS hd1, '>' || y AS hd2, field, a, b FROM ({_DIFFERING}) UNION ALL SELECT '<' || y, '<' || x, field, a, b FROM ({_LEFT_DIFFERING})
    UNION ALL SELECT '>' || y, '>' || x, CASE WHEN starts_with(field, 'min') THEN 'max' ELSE 'min' END || substr(field, 4), -a, -b FROM ({_DIFFERING}) UNION ALL SELECT '<' || x, '<' || y, CASE WHEN starts_with(field, 'min') THEN 'max' ELSE 'min' END || substr(field, 4), -a, -b FROM ({_LEFT_DIFFERING})
  ) LEFT JOIN (SELECT hand || lag_digit AS hd1, hand || digit AS hd2, count(*) AS events FROM (SELECT *, lag(digit) {W} AS lag_digit FROM notes) GROUP BY 1, 2) USING (hd1, hd2)""")
def span_diff(spark, d):
    """Where two span tables differ, with how often the pair is played."""
    n = sequence.with_neighbours(bound_notes(spark, d), column="digit", after=0)
    used = n.groupBy(F.concat("hand", F.col("digit_m1").cast("string")).alias("hd1"), F.concat("hand", F.col("digit").cast("string")).alias("hd2")).agg(F.count("*").alias("events"))
    return stats.span_diff(dims.finger_spans(spark), "parncutt", "badgerow").join(used, ["hd1", "hd2"], "left")


@query("combine_segments", "score_id:i rank:i cost:d", "SELECT score_id, 1 AS rank, sum(c) AS cost FROM (SELECT score_id, segment_idx, min(dur_ms) AS c FROM seg GROUP BY 1, 2) GROUP BY 1", _SEGS)
def combine_segments(spark, d):
    """The cheapest whole sequence of one suggestion for each phrase: its digits, each at its shortest duration."""
    p = sequence.with_segments(bound_notes(spark, d), level=".").groupBy("score_id", "segment_idx", F.col("digit").cast("string").alias("fingering")).agg(F.min("dur_ms").alias("cost")).withColumn("rank", F.lit(1))
    return corpus.combine_segments(p, 1)


@query("combine_segments_best", "score_id:i rank:i fingering:s cost:d", "SELECT score_id, rank, f AS fingering, c AS cost FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY c, f) AS rank FROM whole WHERE s = last) WHERE rank <= 4",
    "RECURSIVE " + _SEGS + """, options AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY score_id ORDER BY segment_idx) AS s, count(DISTINCT segment_idx) OVER (PARTITION BY score_id) AS last FROM (SELECT score_id, segment_idx, digit || '' AS f, CAST(min(dur_ms) AS DOUBLE) AS c FROM seg GROUP BY 1, 2, 3)),
  whole AS (SELECT score_id, s, last, f, c FROM options WHERE s = 1 UNION ALL
    SELECT score_id, s, last, f, c FROM (SELECT o.score_id, o.s, o.last, w.f || o.f AS f, w.c + o.c AS c, row_number() OVER (PARTITION BY o.score_id ORDER BY w.c + o.c, w.f || o.f) AS r FROM whole w JOIN options o ON o.score_id = w.score_id AND o.s = w.s + 1) WHERE r <= 4)""")
def combine_segments_best(spark, d):
    """The four cheapest whole sequences of one suggestion for each phrase: its digits, each at its shortest duration."""
    p = sequence.with_segments(bound_notes(spark, d), level=".").groupBy("score_id", "segment_idx", F.col("digit").cast("string").alias("fingering")).agg(F.min("dur_ms").alias("cost")).withColumn("rank", F.lit(1))
    return corpus.combine_segments(p, 4)


# --- ranked evaluation ----------------------------------------------------------------------------------------------

_LONG = "(least(digit, tip) IN (2, 3) AND abs(digit - tip) = 1)"
_DELTA = {"hmg": "CAST(digit <> tip AS DOUBLE)", "al": f"CASE WHEN digit = tip THEN 0.0 WHEN {_LONG} THEN 0.5 ELSE 1.0 END", "bwa": f"CASE WHEN digit = tip THEN 0.0 WHEN {_LONG} OR (NOT {black('midi')} AND least(digit, tip) IN (1, 4) AND abs(digit - tip) = 1) THEN 0.5 ELSE 1.0 END"}
_N = "count(*) OVER (PARTITION BY score_id, rank)"


def _deltas(name: str, decay: str):
    w = "1.0" if decay == "none" else "(n - note_idx)"

    @query(f"delta_{name}_{decay}", "score_id:i rank:i n:i big_delta:d normalized:d", f"SELECT score_id, rank, n, n * sum({w} * ({_DELTA[name]})) / sum({w}) AS big_delta, sum({w} * ({_DELTA[name]})) / sum({w}) AS normalized FROM (SELECT *, {_N} AS n FROM tips) GROUP BY 1, 2, 3", SUGGESTIONS_SQL)
    def delta(spark, d):
        return ranking.big_delta(pairs(bound_notes(spark, d)), delta=name, decay=decay)

    return delta


for _name in _DELTA:
    for _decay in ("none", "uniform"):
        _deltas(_name, _decay)

_RHO = f"SELECT score_id, rank, n, sum(CAST(coalesce((s > 0 AND d1 = 1 OR s < 0 AND digit = 1) AND d1 <> digit, false) <> coalesce((s > 0 AND t1 = 1 OR s < 0 AND tip = 1) AND t1 <> tip, false) AS INT)) AS rho FROM (SELECT *, {_N} AS n, lead(digit) OVER r AS d1, lead(tip) OVER r AS t1, lead(midi) OVER r - midi AS s FROM tips WINDOW r AS (PARTITION BY score_id, rank ORDER BY note_idx)) GROUP BY 1, 2, 3"


@query("pivot_clashes", "score_id:i rank:i rho:d", _RHO, SUGGESTIONS_SQL)
def pivot_clashes(spark, d):
    return ranking.pivot_clashes(pairs(bound_notes(spark, d)))


_PSAT = f"SELECT a.score_id, a.rank, (1 - a.x) / pow(1 + 1.0 / r.n, r.rho) AS p FROM (SELECT score_id, rank, avg({_DELTA['al']}) AS x FROM tips GROUP BY 1, 2) a JOIN ({_RHO}) r USING (score_id, rank)"


@query("prob_satisfied", "score_id:i rank:i p:d", _PSAT, SUGGESTIONS_SQL)
def prob_satisfied(spark, d):
    p = pairs(bound_notes(spark, d))
    return ranking.prob_satisfied(ranking.big_delta(p, delta="al"), ranking.pivot_clashes(p))


def _mus(mu: str, by: str):
    @query(f"prob_satisfied_{mu}", "score_id:i rank:i p:d", f"SELECT a.score_id, a.rank, (1 - a.x) / {by} AS p FROM (SELECT score_id, rank, avg({_DELTA['al']}) AS x FROM tips GROUP BY 1, 2) a JOIN ({_RHO}) r USING (score_id, rank)", SUGGESTIONS_SQL)
    def satisfied(spark, d):
        p = pairs(bound_notes(spark, d))
        return ranking.prob_satisfied(ranking.big_delta(p, delta="al"), ranking.pivot_clashes(p), mu=mu)

    return satisfied


_mus("power2", "pow(2.0, r.rho)")
_mus("plus1", "(r.rho + 1.0)")


def _err(p: str) -> str:
    left = " * ".join(f"(1 - coalesce(lag(p, {k}) OVER w, 0))" for k in range(1, 5))
    return f"SELECT score_id, sum(t) AS err FROM (SELECT score_id, p / rank * {left} AS t FROM ({p}) WINDOW w AS (PARTITION BY score_id ORDER BY rank)) GROUP BY 1"


@query("expected_reciprocal_rank", "score_id:i err:d", _err(_PSAT), SUGGESTIONS_SQL)
def expected_reciprocal_rank(spark, d):
    p = pairs(bound_notes(spark, d))
    return ranking.expected_reciprocal_rank(ranking.prob_satisfied(ranking.big_delta(p, delta="al"), ranking.pivot_clashes(p)))


_TAU = f"""
  SELECT score_id, rank, n, sum(CASE WHEN e THEN 0 WHEN s THEN 1 - 0.99 ELSE 1 END) AS nuanced, sum(CAST(NOT e AS INT)) AS trigram, sum(CASE WHEN e THEN 0 WHEN x THEN 1 - 0.99 ELSE 1 END) AS relaxed FROM (
    SELECT *, (a2 AND a1 AND a0) AS e, (a2 AND b1 AND a0) AS s, (a2 OR (b2 AND a3 AND a1)) AND (a1 OR (b1 AND a2 AND a0)) AND (a0 OR (b0 AND a1 AND z1)) AS x FROM (
      SELECT score_id, rank, i, n, same AS a0, near AS b0, coalesce(lag(same) OVER w, true) AS a1, coalesce(lag(same, 2) OVER w, true) AS a2, coalesce(lag(same, 3) OVER w, true) AS a3, coalesce(lead(same) OVER w, true) AS z1, coalesce(lag(near) OVER w, false) AS b1, coalesce(lag(near, 2) OVER w, false) AS b2 FROM (
        SELECT score_id, rank, note_idx AS i, n, digit = tip AS same, {_LONG} AS near FROM (SELECT *, {_N} AS n FROM tips) UNION ALL SELECT score_id, rank, n + k, n, true, false FROM (SELECT DISTINCT score_id, rank, {_N} AS n FROM tips), (SELECT unnest([0, 1]) AS k))
      WINDOW w AS (PARTITION BY score_id, rank ORDER BY i))) GROUP BY 1, 2, 3"""


def _taus(tau: str):
    @query(f"tau_{tau}", "score_id:i rank:i n:i tri_delta:d tri_normalized:d", f"SELECT score_id, rank, n, {tau} AS tri_delta, {tau} / (n + 2) AS tri_normalized FROM ({_TAU})", SUGGESTIONS_SQL)
    def taus(spark, d):
        return ranking.trigram_big_delta(pairs(bound_notes(spark, d)), tau=tau)

    return taus


for _name in ("trigram", "nuanced", "relaxed"):
    _taus(_name)


def _gains(spark, d):
    """Fingers on pitch classes, ranked by how often annotator 1 uses them; annotator 2's uses are votes."""
    n = bound_notes(spark, d)
    item = lambda c: F.concat_ws("-", F.col(c), F.col("midi") % 12).alias("fingering")
    used = n.groupBy("score_id", item("digit")).agg(F.count("*").alias("_n"))
    s = used.select("score_id", F.row_number().over(Window.partitionBy("score_id").orderBy(F.desc("_n"), "fingering")).alias("rank"), "fingering")
    v = n.groupBy("score_id", item("digit_b")).agg(F.count("*").alias("votes"))
    return ranking.with_gains(s, v), v


_GAINS = NOTES_SQL + """, tips AS (SELECT score_id, fingering, row_number() OVER (PARTITION BY score_id ORDER BY c DESC, fingering) AS rank FROM (SELECT score_id, digit || '-' || midi % 12 AS fingering, count(*) AS c FROM notes GROUP BY 1, 2)),
 votes AS (SELECT score_id, digit_b || '-' || midi % 12 AS fingering, count(*) AS votes FROM notes GROUP BY 1, 2),
 gains AS (SELECT t.score_id, t.rank, t.fingering, coalesce(v.votes, 0) AS votes, coalesce(v.votes, 0) / CAST(x.t AS DOUBLE) AS gain, CAST(v.votes IS NOT NULL AS INT) AS hit, x.relevant
  FROM tips t JOIN (SELECT score_id, sum(votes) AS t, count(*) AS relevant FROM votes GROUP BY 1) x USING (score_id) LEFT JOIN votes v ON v.score_id = t.score_id AND v.fingering = t.fingering)"""


@query("average_precision", "score_id:i ap:d precision:d recall:d", "SELECT score_id, sum(hit * h / rank) / max(relevant) AS ap, max(CASE WHEN rank = 3 THEN h END) / 3.0 AS precision, max(CASE WHEN rank = 3 THEN h END) / CAST(max(relevant) AS DOUBLE) AS recall FROM (SELECT *, CAST(sum(hit) OVER (PARTITION BY score_id ORDER BY rank) AS DOUBLE) AS h FROM gains) GROUP BY 1", _GAINS)
def average_precision(spark, d):
    g, _ = _gains(spark, d)
    return ranking.average_precision(g).join(ranking.precision_recall_at_k(g, 3), "score_id")


@query("mean_average_precision", "hand:s map:d pieces:i at_recall:d whole:i", """
  SELECT CASE score_id % 2 WHEN 0 THEN '>' ELSE '<' END AS hand, avg(ap) AS map, count(*) AS pieces, avg(CASE WHEN found = relevant THEN ap END) AS at_recall, count(CASE WHEN found = relevant THEN 1 END) AS whole FROM (
    SELECT score_id, sum(hit * h / rank) / max(relevant) AS ap, max(h) AS found, max(relevant) AS relevant FROM (SELECT *, CAST(sum(hit) OVER (PARTITION BY score_id ORDER BY rank) AS DOUBLE) AS h FROM gains) GROUP BY 1) GROUP BY 1""", _GAINS)
def mean_average_precision(spark, d):
    g, _ = _gains(spark, d)
    side = F.when(F.col("score_id") % 2 == 0, ">").otherwise("<")
    of = lambda p: ranking.mean_average_precision(p.withColumn("hand", side), by=("hand",))
    at = of(ranking.average_precision_at_recall(g)).select("hand", F.col("map").alias("at_recall"), F.col("pieces").alias("whole"))
    return of(ranking.average_precision(g)).join(at, "hand")


@query("ndcg", "score_id:i dcg:d ideal:d ndcg:d", """
  SELECT g.score_id, dcg, ideal, dcg / ideal AS ndcg FROM (SELECT score_id, sum(gain / CASE rank WHEN 1 THEN 1 ELSE log2(rank) END) AS dcg FROM gains WHERE rank <= 4 GROUP BY 1) g
  JOIN (SELECT score_id, sum(share / CASE r WHEN 1 THEN 1 ELSE log2(r) END) AS ideal FROM (SELECT score_id, votes / CAST(sum(votes) OVER (PARTITION BY score_id) AS DOUBLE) AS share, row_number() OVER (PARTITION BY score_id ORDER BY votes DESC) AS r FROM votes) WHERE r <= 4 GROUP BY 1) i USING (score_id)""", _GAINS)
def ndcg(spark, d):
    g, v = _gains(spark, d)
    return ranking.ndcg(g, v, k=4)


@query("cumulative_gain", "score_id:i rank:i cumulative:d discounted:d", "SELECT score_id, rank, sum(gain) OVER w AS cumulative, sum(gain / CASE rank WHEN 1 THEN 1 ELSE log2(rank) END) OVER w AS discounted FROM gains WINDOW w AS (PARTITION BY score_id ORDER BY rank)", _GAINS)
def cumulative_gain(spark, d):
    return ranking.cumulative_gain(_gains(spark, d)[0])


def _marks(spark, d):
    n = suggestions(bound_notes(spark, d))
    g = n.select("score_id", "rank", "note_idx", "tip", F.lit(True).alias("same_hand"), F.explode(F.create_map(F.lit(1), F.when(F.col("event_id") % 4 != 2, F.col("digit")), F.lit(2), F.when(F.col("event_id") % 2 == 1, F.col("tip")))).alias("g", "gold"))
    return ranking.pair_marks(g, keys=("score_id", "rank", "g"))


_MARKS = SUGGESTIONS_SQL + """, cells AS (SELECT score_id, rank, note_idx, tip, count(*) OVER (PARTITION BY score_id, rank) AS len, unnest([1, 2]) AS g, unnest([CASE WHEN event_id % 4 <> 2 THEN digit END, CASE WHEN event_id % 2 = 1 THEN tip END]) AS gold FROM tips),
 marks AS (SELECT score_id, rank, g, count(*) AS n, sum(CAST(coalesce(gold = tip, false) AS INT)) AS m, sum(CAST(gold IS NULL AS INT)) AS w, sum(CAST(coalesce(least(gold, tip) IN (2, 3, 4) AND abs(gold - tip) = 1, false) AS INT)) AS x,
   sum(CAST(coalesce(gold <> tip, false) AS INT)) AS cl, 2.0 / (count(*) + 1) * sum(CASE WHEN gold <> tip THEN len - note_idx ELSE 0 END) AS wc,
   sum(CASE WHEN gold IS NULL OR gold = tip THEN 1.0 WHEN least(gold, tip) IN (2, 3, 4) AND abs(gold - tip) = 1 THEN 1 - pow(2.0, -note_idx) ELSE 0 END) AS eq,
   2.0 / (count(*) + 1) * sum(CASE WHEN gold <> tip AND NOT (least(gold, tip) IN (2, 3, 4) AND abs(gold - tip) = 1) THEN len - note_idx + 1 ELSE 0 END) AS ec FROM cells GROUP BY 1, 2, 3)"""
_USERS = {
    "strict": ("CAST(m = n AS DOUBLE)", "1.0"),
    "estimated": ("CASE WHEN m = n THEN 1.0 WHEN w + m = n THEN m / n::DOUBLE ELSE 0 END", "CASE WHEN m = n THEN 1.0 WHEN w + m = n THEN m / n::DOUBLE ELSE 1 END"),
    "equal_proxy": ("CASE WHEN m = n OR m + x = n THEN 1.0 WHEN w + m = n THEN m / n::DOUBLE WHEN w + m + x = n THEN (m + x / pow(2.0, x)) / n ELSE 0 END", "CASE WHEN m = n OR m + x = n THEN 1.0 WHEN w + m = n THEN m / n::DOUBLE WHEN w + m + x = n THEN (m + x) / n::DOUBLE ELSE 1 END"),
    "proxy": ("CASE WHEN m = n THEN 1.0 WHEN m + x = n THEN (m + x / pow(2.0, x)) / n WHEN w + m = n THEN m / n::DOUBLE WHEN w + m + x = n THEN (m + x / pow(2.0, x)) / n ELSE 0 END", "CASE WHEN m = n OR m + x = n THEN 1.0 WHEN w + m = n THEN m / n::DOUBLE WHEN w + m + x = n THEN (m + x) / n::DOUBLE ELSE 1 END"),
    "equity": ("CASE WHEN w = n THEN 0 WHEN m = n THEN n ELSE eq / pow(2.0, ec) END", "CASE WHEN w = n THEN 0 ELSE n END"),
    "pure_equity": ("CASE WHEN w = n OR w + m + x <> n THEN 0 ELSE eq END", "CASE WHEN w = n THEN 0 ELSE n END"),
}


def _user(kind: str):
    a, b = _USERS[kind]

    @query(f"user_{kind}", "score_id:i rank:i p:d", f"SELECT score_id, rank, coalesce(sum({a}) / nullif(sum({b}), 0), 0) AS p FROM marks GROUP BY 1, 2", _MARKS)
    def user(spark, d):
        return ranking.user_prob(_marks(spark, d), kind)

    return user


for _name in _USERS:
    _user(_name)

_WILD = {"match": "m / (n - w)::DOUBLE", "discordant": "m / (n - w)::DOUBLE / (cl + 1)", "similarity": "m / (n - w)::DOUBLE / (wc + 1)", "equity": "(eq - w) / (n - w)"}


def _wild(method: str):
    p = f"SELECT score_id, rank, coalesce(sum(CASE WHEN n > w THEN ({_WILD[method]}) * (n - w) END) / sum(n), 0) AS p FROM marks GROUP BY 1, 2"

    @query(f"wildcard_rank_{method}", "score_id:i err:d", _err(p), _MARKS)
    def wild(spark, d):
        return ranking.expected_reciprocal_rank(ranking.wildcard_rank_prob(_marks(spark, d), method))

    return wild


for _name in _WILD:
    _wild(_name)


@query("proximal_gain", "score_id:i rank:i gain:d normalized_gain:d", "SELECT score_id, rank, sum(velocity * (9 - abs(digit - tip))) AS gain, sum(velocity * (9 - abs(digit - tip))) / (9.0 * sum(velocity)) AS normalized_gain FROM tips GROUP BY 1, 2", SUGGESTIONS_SQL)
def proximal_gain(spark, d):
    s = suggestions(bound_notes(spark, d)).withColumn("votes", F.col("velocity"))
    return ranking.proximal_gain(s, dims.edit_distance("natural", F.col("hand"), F.col("digit"), F.col("hand"), F.col("tip")), 9)


@query("bigram_label_distance", "score_id:i distance:d", f"""
  SELECT score_id, sum(CASE WHEN pa <> pb THEN 1.0 ELSE pow(digit - digit_b, 2) / 16.0 END) AS distance FROM (
    SELECT *, coalesce((u AND digit = 1 AND a0 <> 1) OR (v AND a0 = 1 AND digit <> 1), false) AS pa, coalesce((u AND digit_b = 1 AND b0 <> 1) OR (v AND b0 = 1 AND digit_b <> 1), false) AS pb FROM (
      SELECT *, lag(digit) {W} AS a0, lag(digit_b) {W} AS b0, coalesce(lag(midi) {W} < midi, false) AS u, coalesce(lag(midi) {W} > midi, false) AS v FROM notes)) GROUP BY 1""")
def bigram_label_distance(spark, d):
    n = sequence.bigram_labels(bound_notes(spark, d)).withColumnRenamed("bigram", "a")
    n = sequence.bigram_labels(n, digit="digit_b").withColumnRenamed("bigram", "b")
    return n.groupBy("score_id").agg(F.sum(agreement.bigram_label_distance(F.col("a"), F.col("b"))).alias("distance"))




@query("rank_biased_overlap", "score_id:i average_overlap:d agreement_3:d rbo_at_5:d rbo_min:d rbo_ext:d", """
  SELECT score_id, avg(a) AS average_overlap, max(CASE WHEN d = 3 THEN a END) AS agreement_3, sum(pow(0.9, d - 1) * a) * 0.1 AS rbo_at_5,
    0.1 / 0.9 * (sum(pow(0.9, d) / d * (x - xk)) - ln(1 - 0.9) * max(xk)) AS rbo_min, 0.1 / 0.9 * sum(pow(0.9, d) * a) + max(xk) / 5.0 * pow(0.9, 5) AS rbo_ext
  FROM (SELECT *, x / CAST(d AS DOUBLE) AS a, max(CASE WHEN d = 5 THEN x END) OVER (PARTITION BY score_id) AS xk FROM (
    SELECT score_id, d, len(list_intersect(list_slice(p, 1, d), list_slice(q, 1, d))) AS x FROM (SELECT score_id, list(l ORDER BY c DESC, l) AS p, list(l ORDER BY e DESC, l) AS q FROM (
      SELECT score_id, l, 10 * sum(CAST(digit = l AS INT)) + l / 10.0 AS c, 10 * sum(CAST(digit_b = l AS INT)) + l / 10.0 AS e FROM notes, (SELECT unnest(range(1, 6)) AS l) GROUP BY 1, 2) GROUP BY 1), (SELECT unnest(range(1, 6)) AS d))) GROUP BY 1""")
def rank_biased_overlap(spark, d):
    n = bound_notes(spark, d).withColumn("item", F.explode(F.array(*[F.lit(x) for x in range(1, 6)])))
    s = n.groupBy("score_id", F.col("item").cast("string").alias("item")).agg((10 * F.sum((F.col("digit") == F.col("item")).cast("int")) + F.first("item") / 10.0).alias("c"), (10 * F.sum((F.col("digit_b") == F.col("item")).cast("int")) + F.first("item") / 10.0).alias("e"))
    a = ranking.tied_ranking(s, score="c").withColumnRenamed("ranking", "p").join(ranking.tied_ranking(s, score="e").withColumnRenamed("ranking", "q"), "score_id")
    p, q, five = F.col("p"), F.col("q"), F.lit(5)
    return a.select("score_id", ranking.average_overlap(p, q, five).alias("average_overlap"), ranking.agreement(p, q, F.lit(3)).alias("agreement_3"), ranking.rbo_at_k(p, q, 0.9, five).alias("rbo_at_5"), ranking.rbo_min(p, q, 0.9).alias("rbo_min"), ranking.rbo_ext(p, q, 0.9).alias("rbo_ext"))


@query("mean_err", "staff:s mean_err:d weighted_mean_err:d", "SELECT staff, avg(e) AS mean_err, sum(e * n) / sum(n) AS weighted_mean_err FROM (SELECT staff, score_id, count(*) AS n, sum(value * digit) / sum(digit) AS e FROM notes GROUP BY 1, 2) GROUP BY 1")
def mean_err(spark, d):
    n = bound_notes(spark, d).withColumns({"err": F.col("value"), "weight": F.col("digit")})
    p = ranking.phrase_mean_err(n, keys=("staff", "score_id")).join(n.groupBy("staff", "score_id").agg(F.count("*").alias("notes")), ["staff", "score_id"])
    return ranking.mean_err(p, keys=("staff",))


# --- features and splits --------------------------------------------------------------------------------------------


@query("features_v7", "score_id:i note_idx:i chord_cat:s chord_border:s bop:b eop:b dxgram_1:s dxgram_2:s black3gram:s returning:b leap:b velocity:i odd_repeats_before:b separated_count:i left_nps:d", f"""
  SELECT c.score_id, c.note_idx, c.staff || c.chord_lower || c.chord_upper AS chord_cat, CASE WHEN c.chord_lower = 0 AND c.chord_upper > 0 THEN 'left' WHEN c.chord_upper = 0 AND c.chord_lower > 0 THEN 'right' ELSE 'none' END AS chord_border, c.note_idx = 0 AS bop, p1 IS NULL AS eop,
    x_m1 || '|' || x_p1 AS dxgram_1, x_m2 || '|' || x_m1 || '|' || x_p1 || '|' || x_p2 AS dxgram_2, coalesce({black('m1')}, false) || '|' || {black('c.midi')} || '|' || coalesce({black('p1')}, false) AS black3gram, x_m2 = 0 AS returning, coalesce(abs(c.midi - m1) > 15, false) AS leap, c.velocity,
    r.repeats_before % 2 = 1 AS odd_repeats_before, a.separated_count, t.left_nps
  FROM (SELECT *, {_XY} FROM ({_CHORDS})) c JOIN ({_ART}) a USING (score_id, note_idx) JOIN ({_TEMPO}) t ON t.score_id = c.score_id AND t.note_idx = c.note_idx
  JOIN (SELECT score_id, note_idx, row_number() OVER (PARTITION BY score_id, run ORDER BY note_idx) - 1 AS repeats_before FROM (SELECT *, sum(new) {W} AS run FROM (SELECT *, CASE WHEN lag(midi) {W} = midi THEN 0 ELSE 1 END AS new FROM notes))) r ON r.score_id = c.score_id AND r.note_idx = c.note_idx""")
def features_v7(spark, d):
    return features.features(bound_notes(spark, d))


@query("group_kfold", "score_id:i fold:i", "SELECT score_id, CASE WHEN p % 10 < 5 THEN p % 10 ELSE 9 - p % 10 END AS fold FROM (SELECT score_id, row_number() OVER (ORDER BY count(*) DESC, score_id) - 1 AS p FROM notes GROUP BY 1)")
def group_kfold(spark, d):
    return features.group_kfold(bound_notes(spark, d), 5).select("score_id", "fold").distinct()


@query("reverse_sequences", "score_id:i note_idx:i midi:i", "SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY note_idx DESC) - 1 AS note_idx, midi FROM notes")
def reverse_sequences(spark, d):
    return features.reverse_sequences(bound_notes(spark, d))


@query("build_examples", "score_id:i segment_idx:i note_idx:i hsd:s chord_left:i chord_right:i", f"""
  SELECT p.score_id, p.segment_idx, p.note_idx, p.hand || p.strike_digit AS hsd, c.chord_left, c.chord_right FROM (SELECT *, bool_or(strike_digit IS NULL) OVER (PARTITION BY score_id, segment_idx) AS x FROM phrased) p
  JOIN ({_CHORDS.replace('PARTITION BY score_id', 'PARTITION BY score_id, segment_idx').replace('FROM notes', 'FROM (SELECT n.*, phrased.segment_idx FROM notes n JOIN phrased USING (score_id, note_idx))')}) c ON c.score_id = p.score_id AND c.note_idx = p.note_idx WHERE NOT x""",
    FINGERINGS_SQL + f", phrased AS (SELECT *, {_SEG} AS segment_idx FROM hands)")
def build_examples(spark, d):
    """Features and labels of the phrases without wildcards."""
    n = sequence.with_segments(bound_notes(spark, d)).drop("hand", "digit")
    f = fingering.with_handed_digits(_exploded(spark, d), keys=["score_id"]).select("score_id", "note_idx", "hsd", "hand")
    f = n.select("score_id", "segment_idx", "note_idx").join(f, ["score_id", "note_idx"])
    return features.build_examples(n, f, 3, keys=("score_id", "segment_idx"))


@query("fold_counts", "fold:i staff:s pooled:b examples:i notes:i", "SELECT score_id % 3 AS fold, staff, grouping(staff) = 1 AS pooled, count(DISTINCT score_id) AS examples, count(*) AS notes FROM notes GROUP BY GROUPING SETS ((score_id % 3, staff), (score_id % 3))")
def fold_counts(spark, d):
    return features.fold_counts(bound_notes(spark, d).withColumn("fold", F.col("score_id") % 3))


@query("group_split", "score_id:i is_test:b whole:b", """
  SELECT score_id, CAST(CAST('0x' || substr(md5(score_id || '|1'), 1, 12) AS UBIGINT) % 1000000 AS BIGINT) < 300000 AS is_test, true AS whole FROM (SELECT DISTINCT score_id FROM notes)""")
def group_split(spark, d):
    s = features.group_split(bound_notes(spark, d), 0.3)
    return s.groupBy("score_id").agg(F.first("is_test").alias("is_test"), (F.countDistinct("is_test") == 1).alias("whole"))


_EDGES = "str sma lar 3t4 bl4 bl1 bl5 pa1 wea".split()


@query("edge_features", "score_id:i note_idx:i " + " ".join(f"r_{t}:i" for t in _EDGES) + " chord_lower:i chord_upper:i repeat_finger:b", f"SELECT t.score_id, t.note_idx, {', '.join(f'{_RULES[t]} AS r_{t}' for t in _EDGES)}, c.chord_lower, c.chord_upper, coalesce(d1 = d2, false) AS repeat_finger FROM ({_TRI}) t JOIN (SELECT score_id, note_idx, chord_lower, chord_upper FROM ({_CHORDS})) c USING (score_id, note_idx)")
def edge_features(spark, d):
    return features.edge_features(bound_notes(spark, d))


@query("tag_scores", "score_id:i notes:i matches:i rate:d")
def tag_scores(spark, d):
    """Match rates by score of a tagger trained on the other scores."""
    n = features.group_split(features.features(bound_notes(spark, d), 3), 0.3)
    columns = ["chord_left", "x_m1", "x_p1", "black", "velocity", "window_nps"]
    model = features.train_tagger(n.where(~F.col("is_test")), columns)
    out = features.tag(model, n.where("is_test"))
    same = (F.col("predicted") == F.col("digit")).cast("int")
    return out.groupBy("score_id").agg(F.count("*").alias("notes"), F.sum(same).alias("matches"), F.avg(same).alias("rate"))


_TAGGED = """-(CASE WHEN d2 = digit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - m2 % 7 * d2 / 40.0::DOUBLE + CASE WHEN m1 IS NULL THEN 0.0::DOUBLE ELSE coalesce((SELECT ln(count(*)) FROM (
    SELECT lag(digit) OVER s AS f, digit AS g FROM seg WINDOW s AS (PARTITION BY score_id, segment_idx ORDER BY pos)) w WHERE w.f = d1 AND w.g = d2), 0) END)"""


@query("viterbi_decode", "score_id:i segment_idx:i digits:s score:d", "SELECT score_id, segment_idx, digits, -cost AS score FROM best", _searched(_TAGGED, "true", 1))
def viterbi_decode(spark, d):
    p = _phrases(spark, d)
    e = p.withColumn("label", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("score", F.when(F.col("label") == F.col("digit"), F.lit(1.0)).otherwise(F.lit(0.0)) - F.col("midi") % 7 * F.col("label") / 40)
    w = Window.partitionBy(*PHRASE).orderBy("note_idx")
    t = p.select(F.lag("digit").over(w).alias("prev"), F.col("digit").alias("cur")).where("prev is not null").groupBy("prev", "cur").agg(F.log(F.count("*")).alias("score"))
    return search.viterbi_decode(e, t, keys=PHRASE)


_TAGS_SQL = f"""
  SELECT a.*, r.rho AS rho_no_d, r.rho AS rho_uni_d, t.trigram AS tri_D, t.nuanced AS nua_D, t.relaxed AS rlx_D, t.trigram / (t.n + 2) AS norm_tri_D, t.nuanced / (t.n + 2) AS norm_nua_D, t.relaxed / (t.n + 2) AS norm_rlx_D,
    1 - norm_hmg AS p_sat, 1 - t.trigram / (t.n + 2) AS tri_p_sat, 1 - t.nuanced / (t.n + 2) AS nua_p_sat, 1 - t.relaxed / (t.n + 2) AS rlx_p_sat
  FROM (SELECT score_id, rank, sum({_DELTA['hmg']}) AS hmg, avg({_DELTA['hmg']}) AS norm_hmg, sum({_DELTA['al']}) AS al, avg({_DELTA['al']}) AS norm_al FROM tips GROUP BY 1, 2) a JOIN ({_RHO}) r USING (score_id, rank) JOIN ({_TAU}) t ON t.score_id = a.score_id AND t.rank = a.rank"""


@query("rank_tags", "score_id:i rank:i hmg:d norm_hmg:d al:d norm_al:d rho_no_d:d rho_uni_d:d p_sat:d tri_p_sat:d nua_p_sat:d rlx_p_sat:d tri_D:d nua_D:d rlx_D:d norm_tri_D:d norm_nua_D:d norm_rlx_D:d", _TAGS_SQL, SUGGESTIONS_SQL)
def rank_tags(spark, d):
    return ranking.rank_tags(pairs(bound_notes(spark, d)))


def _err_of(tags: dict[str, str]) -> str:
    parts = [f"(SELECT score_id, err AS {t} FROM ({_err(f'SELECT m.score_id, m.rank, {p} AS p FROM m')}))" for t, p in tags.items()]
    return "SELECT * FROM " + parts[0] + "".join(f" JOIN {p} USING (score_id)" for p in parts[1:])


_ERRS = {"hmg": "p_sat", "hmg_rho": "p_sat / pow(1 + 1.0 / n, rho_no_d)", "al": "1 - norm_al", "al_rho": "(1 - norm_al) / pow(1 + 1.0 / n, rho_no_d)"} | {
    k: v for t, c in (("tri", "tri"), ("tri_nua", "nua"), ("tri_rlx", "rlx")) for k, v in ((t, f"{c}_p_sat"), (f"{t}_rho", f"{c}_p_sat / pow(1 + 1.0 / (n + 2), rho_no_d)"))
}


@query("err_tags", "score_id:i " + " ".join(f"{t}:d" for t in _ERRS), _err_of(_ERRS), SUGGESTIONS_SQL + f", m AS (SELECT x.*, (SELECT count(*) FROM notes WHERE notes.score_id = x.score_id) AS n FROM ({_TAGS_SQL}) x)")
def err_tags(spark, d):
    return ranking.err_tags(pairs(bound_notes(spark, d)))


@query("evaluate_model", "score_id:i segment_idx:i annot_id:s notes:i hmg:d tri_clvrst:d clvrst:d")
def evaluate_model(spark, d):
    """The rule model's five best fingerings of each phrase against both annotators.

    A lone note has one suggestion, so each measure is its chance to satisfy: 1 for the annotator's finger; for another 0,
    but with decayed distances of long neighbours 0.5 by note and 0.99 by trigram. It has no step, so no clash.
    """
    n = sequence.with_segments(bound_notes(spark, d), level=".")
    p = n.select(*PHRASE, "note_idx", "midi", "hand", "digit")
    a = n.select(*PHRASE, "note_idx", "hand", F.explode(F.create_map(F.lit("1"), F.col("digit"), F.lit("2"), F.col("digit_b"))).alias("annot_id", "digit")).withColumn("weight", F.lit(1))
    return ranking.evaluate_model(search.advise(p, "parncutt", 5, keys=PHRASE), a, p, keys=PHRASE)


@query("segmented_err", "score_id:i segment_idx:i err:d", f"SELECT score_id // 1000 AS score_id, score_id % 1000 AS segment_idx, err FROM ({_err('SELECT score_id * 1000 + segment_idx AS score_id, rank, 1 - avg(CAST(digit <> tip AS INT)) AS p FROM (SELECT *, ' + _SEG.replace('PARTITION BY score_id ORDER', 'PARTITION BY score_id, rank ORDER') + ' AS segment_idx FROM tips) GROUP BY score_id, segment_idx, rank')})", SUGGESTIONS_SQL)
def segmented_err(spark, d):
    s = sequence.with_segments(bound_notes(spark, d))
    p = suggestions(s).select(*PHRASE, "rank", "note_idx", "midi", F.col("digit").alias("one"), F.col("tip").alias("other"), F.lit(True).alias("same_hand"))
    return ranking.expected_reciprocal_rank(ranking.prob_satisfied(ranking.big_delta(p, keys=(*PHRASE, "rank")), keys=(*PHRASE, "rank")), keys=PHRASE)


_PG = "SELECT score_id, rank, sum(velocity * (9 - abs(digit - tip))) AS gain, sum(velocity * (9 - abs(digit - tip))) / (9.0 * sum(velocity)) AS p FROM tips GROUP BY 1, 2"


@query("proximal_reciprocal_rank", "score_id:i err:d", _err(_PG), SUGGESTIONS_SQL)
def proximal_reciprocal_rank(spark, d):
    s = suggestions(bound_notes(spark, d)).withColumn("votes", F.col("velocity"))
    g = ranking.proximal_gain(s, dims.edit_distance("natural", F.col("hand"), F.col("digit"), F.col("hand"), F.col("tip")), 9)
    return ranking.expected_reciprocal_rank(g.select("score_id", "rank", F.col("normalized_gain").alias("p")))


@query("discounted_proximal_gain", "score_id:i dcpg:d ndcpg:d", f"SELECT score_id, sum(gain / CASE rank WHEN 1 THEN 1 ELSE log2(rank) END) AS dcpg, sum(gain / CASE rank WHEN 1 THEN 1 ELSE log2(rank) END) / sum(gain / CASE r WHEN 1 THEN 1 ELSE log2(r) END) AS ndcpg FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY gain DESC, rank) AS r FROM ({_PG})) GROUP BY 1", SUGGESTIONS_SQL)
def discounted_proximal_gain(spark, d):
    s = suggestions(bound_notes(spark, d)).withColumn("votes", F.col("velocity"))
    g = ranking.proximal_gain(s, dims.edit_distance("natural", F.col("hand"), F.col("digit"), F.col("hand"), F.col("tip")), 9)
    ideal = g.withColumn("rank", F.row_number().over(Window.partitionBy("score_id").orderBy(F.desc("gain"), "rank")))
    return ranking.discounted_proximal_gain(g, ideal)


@query("pivot_clash_discount", "score_id:i rank:i discount:d aligned:b", f"SELECT score_id, rank, pow(1.1, -rho) AS discount, rho = 0 AS aligned FROM ({_RHO})", SUGGESTIONS_SQL)
def pivot_clash_discount(spark, d):
    return ranking.pivot_clash_discount(ranking.pivot_clashes(pairs(bound_notes(spark, d))), 1.1)


@query("pseudo_model", "score_id:i rank:i annot_idx:i notes:i", "SELECT * FROM (SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY digit) AS rank, digit AS annot_idx, count(*) AS notes FROM notes GROUP BY score_id, digit) WHERE rank <= 3")
def pseudo_model(spark, d):
    n = bound_notes(spark, d).withColumn("annot_idx", F.col("digit"))
    return search.pseudo_model(n, k=3).groupBy("score_id", "rank", "annot_idx").agg(F.count("*").alias("notes"))


@query("strike_distance", "score_id:i segment_idx:i rank:i distance:i", f"""
  SELECT a.score_id, a.segment_idx, a.rank, sum(abs(s.digit - t.d) + CASE WHEN (s.digit = 1) <> (t.d = 1) THEN 3 ELSE 0 END) AS distance
  FROM ({_ADVISED}) a JOIN seg s ON s.score_id = a.score_id AND s.segment_idx = a.segment_idx, LATERAL (SELECT CAST(a.digits[s.pos + 1] AS INT) AS d) t WHERE a.rank > 0 GROUP BY 1, 2, 3""", _searched(_preset("parncutt"), _PLAYABLE, 3))
def strike_distance(spark, d):
    p = _phrases(spark, d)
    gold = p.withColumn("pos", F.row_number().over(Window.partitionBy(*PHRASE).orderBy("note_idx")) - 1)
    return search.strike_distance(search.advise(p, "parncutt", 3, keys=PHRASE), gold, "pivot", keys=PHRASE, k=3)


@query("advise_cyclic", "score_id:i segment_idx:i rank:i digits:s cost:d", """
  SELECT score_id, segment_idx, rank, digits, cost FROM best UNION ALL SELECT DISTINCT score_id, segment_idx, 0, NULL, NULL FROM seg WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.score_id = seg.score_id AND best.segment_idx = seg.segment_idx)""",
    _searched(_preset("parncutt"), _PLAYABLE, 3, ring=True))
def advise_cyclic(spark, d):
    """The three cheapest fingerings of each phrase, played over and over."""
    return search.advise_cyclic(_phrases(spark, d), "parncutt", 3, keys=PHRASE)


@query("order_gold", "o_custkey:i place:i votes:i", "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY votes) AS place, votes FROM (SELECT o_custkey, l_returnflag || l_linestatus AS fingering, count(*) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def order_gold(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("fingering"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return corpus.order_gold(corpus.gold_votes(li.join(o, "l_orderkey"), keys=["o_custkey"]), keys=["o_custkey"])


@query("gold_ending_with", "score_id:i notes:i", "SELECT score_id, count(*) AS notes FROM notes GROUP BY 1 HAVING arg_max(digit, note_idx) = 2")
def gold_ending_with(spark, d):
    g = bound_notes(spark, d).groupBy("score_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "digit"))), lambda s: s["digit"]).alias("fingering"))
    return corpus.gold_ending_with(g, 2).withColumn("notes", F.size("fingering"))


@query("preset_test_set", "score_id:i is_test:b", "SELECT DISTINCT score_id, score_id <= 30 AS is_test FROM notes")
def preset_test_set(spark, d):
    t = bound_notes(spark, d).select("score_id", F.concat(F.col("score_id").cast("string"), F.lit("-1")).alias("title")).distinct()
    return corpus.preset_test_set(t)


def _pig(spark, d):
    from handspan.sources import pig

    return pig.segments_to_pig(bound_notes(spark, d)).withColumns({"piece_id": F.col("score_id").cast("string"), "annot_id": (F.col("event_id") % 2).cast("string")})


@query("pig_rows", "score_id:i note_idx:i name:s channel:i finger:s on_s:d off_s:d", "SELECT score_id, note_idx, list_extract(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], midi % 12 + 1) || (midi // 12 - 1) AS name, CASE hand WHEN '<' THEN 1 ELSE 0 END AS channel, CASE hand WHEN '<' THEN '-' ELSE '' END || digit AS finger, onset_ms / 1000.0 AS on_s, (onset_ms + dur_ms) / 1000.0 AS off_s FROM notes")
def pig_rows(spark, d):
    return _pig(spark, d)


@query("pig_text", "piece_id:s annot_id:s lines:i text:s", """
  SELECT piece_id, annot_id, count(*) + 1 AS lines, '//Version: PianoFingering_v170101' || chr(10) || string_agg(concat_ws(chr(9), id, printf('%.6f', on_s), printf('%.6f', off_s), name, velocity, velocity, channel, finger), chr(10) ORDER BY id) AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY piece_id, annot_id ORDER BY on_s, midi, off_s, finger, velocity) - 1 AS id FROM (
      SELECT score_id AS piece_id, event_id % 2 AS annot_id, onset_ms / 1000.0::DOUBLE AS on_s, (onset_ms + dur_ms) / 1000.0::DOUBLE AS off_s, midi, velocity, CASE hand WHEN '<' THEN 1 ELSE 0 END AS channel, CASE hand WHEN '<' THEN '-' ELSE '' END || digit AS finger,
        list_extract(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], midi % 12 + 1) || (midi // 12 - 1) AS name FROM notes)) GROUP BY 1, 2""")
def pig_text(spark, d):
    from handspan.sources import pig

    return pig.render_pig(_pig(spark, d)).withColumn("lines", F.size(F.split("text", "\n")))


@query("standard_channels", "score_id:i note_idx:i channel:i", """
  SELECT n.score_id, n.note_idx, coalesce(f.c, n.c) AS channel FROM (SELECT *, event_id % 5 AS c FROM notes) n LEFT JOIN (
    SELECT score_id, onset_ms // 20000 AS o, midi, min(event_id % 5) AS c FROM (SELECT *, min(event_id % 2) OVER (PARTITION BY score_id) AS a FROM notes) WHERE event_id % 2 = a GROUP BY 1, 2, 3) f ON f.score_id = n.score_id AND f.o = n.onset_ms // 20000 AND f.midi = n.midi""")
def standard_channels(spark, d):
    from handspan.sources import pig

    p = _pig(spark, d).withColumns({"on_s": F.floor(F.col("onset_ms") / 20000), "channel": F.col("event_id") % 5})
    return pig.standardize_channels(p)


@query("abcd_header", "score_id:i abcdf:s authority:s weight:i", "SELECT score_id, string_agg(digit || '', '' ORDER BY note_idx) AS abcdf, 'A ' || score_id AS authority, count(*) AS weight FROM notes GROUP BY 1")
def abcd_header(spark, d):
    """Headers written from the scores' fingerings, and read back."""
    from handspan.sources import abcd

    t = bound_notes(spark, d).groupBy("score_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "digit"))), lambda s: s["digit"].cast("string")), "").alias("abcdf"), F.count("*").alias("n"))
    a = t.select("score_id", F.lit(0).alias("annot_idx"), F.lit("1").alias("annot_id"), "abcdf", F.concat(F.lit("A "), F.col("score_id").cast("string")).alias("authority"), F.lit("1900").alias("authority_year"), F.lit("T").alias("transcriber"), F.lit(None).cast("timestamp").alias("transcription_date"), F.concat(F.lit("Weight: "), F.col("n").cast("string")).alias("comments"))
    return abcd.parse_annotations(abcd.render_abcd(a).select("score_id", F.lit("p").alias("path"), F.col("header").alias("text")))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query: the five cheapest fingerings of every phrase, on the smallest tables."""
    return QUERIES["advise_parncutt"](spark, "/root/testdata/sf0.001")


__all__ = ["ORACLE_SQL", "QUERIES", "entry", "rules"]
