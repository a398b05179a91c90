"""Views that read the event table as note sequences, in Spark and as SQL: a user is a score, an hour is 100 ms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from handspan.functions.keys import LOWEST  # noqa: F401  the pitches made here lie on the keyboard


#: Rows that a task gets of a table dealt by `in_parts`.
PART_ROWS = 200_000


def in_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by key into parts of about PART_ROWS, and one for each core at least.

    Sorted rows compress so well that adaptive execution, which merges parts by their bytes, gives a task many millions
    of them; with a given number of parts it merges none, so what a task holds doesn't grow with the table.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS)), *keys)


def bound_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_id, event_id, note_idx, midi, digit, digit_b, hand, staff, seg_mark, onset_ms, dur_ms, velocity, event_type, value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value", "event_type")
    e = in_parts(e, "user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    digit = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    w = Window.partitionBy("score_id").orderBy("us", "event_id")
    n = e.select(
        F.col("user_id").alias("score_id"), "event_id", us.alias("us"), (F.lit(36) + F.floor("value").cast("int") % 49).alias("midi"), digit.alias("digit"), (1 + (k * 7) % 5).cast("int").alias("digit_b"),
        F.when(F.col("user_id") % 2 == 0, ">").otherwise("<").alias("hand"), F.when(F.col("user_id") % 2 == 0, "upper").otherwise("lower").alias("staff"),
        F.when(k % 8 == 0, ".").when(k % 5 == 0, ",").alias("seg_mark"), (50 + (k * 13) % 400).cast("int").alias("dur_ms"), (40 + (k * 11) % 64).cast("int").alias("velocity"), "event_type", "value",
    )
    first = F.min("us").over(Window.partitionBy("score_id"))
    return n.withColumns({"note_idx": F.row_number().over(w) - 1, "onset_ms": F.floor((F.col("us") - first) / 36000000.0).cast("long")}).drop("us")


NOTES_SQL = """
ev AS (
  SELECT user_id AS score_id, event_id, epoch_us(ts) AS us, 36 + CAST(floor(value) AS INT) % 49 AS midi,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS digit,
    CAST(1 + (event_id * 7) % 5 AS INT) AS digit_b, CASE WHEN user_id % 2 = 0 THEN '>' ELSE '<' END AS hand,
    CASE WHEN user_id % 2 = 0 THEN 'upper' ELSE 'lower' END AS staff, CASE WHEN event_id % 8 = 0 THEN '.' WHEN event_id % 5 = 0 THEN ',' END AS seg_mark,
    CAST(50 + (event_id * 13) % 400 AS INT) AS dur_ms, CAST(40 + (event_id * 11) % 64 AS INT) AS velocity, event_type, value
  FROM events
), notes AS (
  SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY us, event_id) - 1 AS note_idx,
    CAST(floor((us - min(us) OVER (PARTITION BY score_id)) / 36000000.0) AS BIGINT) AS onset_ms
  FROM ev
)"""


def suggestions(notes: DataFrame, ranks: int = 5) -> DataFrame:
    """Note rows of ranked suggestions: at rank r every digit is r places on from annotator 1's, around the hand."""
    n = notes.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(ranks))))
    return n.withColumn("tip", (1 + (F.col("digit") - 1 + F.col("rank")) % 5).cast("int"))


SUGGESTIONS_SQL = NOTES_SQL + """, tips AS (
  SELECT n.*, r.rank, CAST(1 + (digit - 1 + r.rank) % 5 AS INT) AS tip FROM notes n, (SELECT CAST(unnest(range(1, 6)) AS INT) AS rank) r
)"""


def pairs(notes: DataFrame) -> DataFrame:
    """Suggestions beside the human fingering, as the ranked measures take them."""
    return suggestions(notes).select("score_id", "rank", "note_idx", "midi", F.col("digit").alias("one"), F.col("tip").alias("other"), F.lit(True).alias("same_hand"), F.col("hand").alias("one_hand"), F.col("hand").alias("other_hand"))


def fingering_text(notes: DataFrame) -> DataFrame:
    """(score_id, abcdf): a fingering string of each score, upper staff: hand marks, releases, pedals, alternatives, ornaments and segment marks by the events' ids."""
    k = F.col("event_id")
    mark = F.when(k % 6 == 0, F.col("hand")).when(k % 17 == 3, F.when(F.col("hand") == ">", "<").otherwise(">")).otherwise("")
    plain = F.concat(F.when(k % 11 == 2, "p").when(k % 11 == 7, "f").otherwise(""), mark, F.col("digit").cast("string"), F.when(k % 9 == 4, F.concat(F.lit("-"), F.col("digit_b").cast("string"))).otherwise(""), F.when(k % 10 == 1, "_").when(k % 10 == 5, "^").otherwise(""))
    token = F.when(k % 19 == 6, "x").when(k % 23 == 9, F.concat(F.lit("("), F.col("digit").cast("string"), F.col("digit_b").cast("string"), F.lit(")"))).otherwise(plain)
    grace = (k % 23 == 9) & (k % 19 != 6)
    other = F.concat(F.when(grace, "/(").otherwise("/"), F.col("digit_b").cast("string"), F.when(grace, ")").otherwise(""))
    token = F.concat(token, F.when(k % 13 == 8, other).otherwise(""), F.coalesce("seg_mark", F.lit("")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", token.alias("t")))), lambda s: s["t"]), "")
    return notes.groupBy("score_id").agg(F.concat(line, F.lit("@x")).alias("abcdf"))


FINGERINGS_SQL = NOTES_SQL + """, marks AS (
  SELECT *, event_id % 19 = 6 AS is_x, event_id % 23 = 9 AS is_orn,
    CASE WHEN event_id % 6 = 0 THEN hand WHEN event_id % 17 = 3 THEN CASE hand WHEN '>' THEN '<' ELSE '>' END END AS hand_mark
  FROM notes
), fing AS (
  SELECT score_id, note_idx, midi, event_id, seg_mark,
    CASE WHEN is_x OR is_orn THEN NULL ELSE hand_mark END AS strike_hand, CASE WHEN NOT is_x THEN digit END AS strike_digit,
    CASE WHEN NOT is_x AND NOT is_orn AND event_id % 9 = 4 THEN digit_b END AS release_digit,
    CASE WHEN is_x OR is_orn THEN NULL WHEN event_id % 11 = 2 THEN 'p' WHEN event_id % 11 = 7 THEN 'f' END AS soft,
    CASE WHEN is_x OR is_orn THEN NULL WHEN event_id % 10 = 1 THEN '_' WHEN event_id % 10 = 5 THEN '^' END AS damper,
    is_orn AND NOT is_x AS is_ornament
  FROM marks
), hands AS (
  SELECT *, coalesce(last_value(strike_hand IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY note_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '>') AS hand FROM fing
)"""


def interval_costs(spark: SparkSession) -> DataFrame:
    """Interval costs by a rule: how far the step is from the fingers' own reach, a fingers' crossing more."""
    r = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("low_color"))
    for name, lo, hi in (("high_color", 0, 1), ("low_finger", 1, 5), ("high_finger", 1, 5), ("semitones", 0, 12)):
        r = r.withColumn(name, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return r.withColumn("cost", F.abs(F.col("semitones") - 2 * (F.col("high_finger") - F.col("low_finger"))) + F.when((F.col("high_finger") == 1) & (F.col("high_color") == 1), 3).otherwise(0))
