"""Fingering text files: one note per line with onset, offset, pitch, velocities, channel and finger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from handspan.functions.keys import midi_to_pitch_name
from handspan.plans.binding import in_parts

FILE = r"((\d+)-(\d+))_fingering\.txt$"
FIELDS = "id int, on_s double, off_s double, name string, on_vel int, off_vel int, channel int, finger string"


def read_pig(spark: SparkSession, path: str) -> DataFrame:
    """(piece_id, annot_id, id, on_s, off_s, name, on_vel, off_vel, channel, finger); lines that begin with // are left out."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path")).where(~F.col("value").startswith("//") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    columns = [f[i].cast(kind).alias(name) for i, (name, kind) in enumerate(x.split() for x in FIELDS.split(", "))]
    return lines.select(F.regexp_extract("path", FILE, 2).alias("piece_id"), F.regexp_extract("path", FILE, 3).alias("annot_id"), *columns)


def render_pig(notes: DataFrame, *, keys=("piece_id", "annot_id")) -> DataFrame:
    """(keys, text): a version line and the notes, numbered from 0 by onset and pitch, then offset, finger and velocity; times to six places."""
    w = Window.partitionBy(*keys).orderBy("on_s", "midi", "off_s", "finger", "on_vel")
    n = notes.withColumn("_id", F.row_number().over(w) - 1)
    line = F.concat_ws("\t", F.col("_id").cast("string"), F.format_string("%.6f", F.round("on_s", 6)), F.format_string("%.6f", F.round("off_s", 6)), "name", F.col("on_vel").cast("string"), F.col("off_vel").cast("string"), F.col("channel").cast("string"), "finger")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", line.alias("l")))), lambda s: s["l"]), "\n")
    return n.groupBy(*keys).agg(F.concat(F.lit("//Version: PianoFingering_v170101\n"), text).alias("text"))


def write_pig(notes: DataFrame, path: str) -> None:
    """A folder for each piece and annotation."""
    render_pig(notes).write.partitionBy("piece_id", "annot_id").text(path)


def segments_to_pig(segments: DataFrame, *, velocity: int = 64) -> DataFrame:
    """Fingered notes of segments as rows to render: the channel is the hand's, or the staff's; missing velocities are given."""
    channel = F.when(F.coalesce("hand", F.when(F.col("staff") == "lower", "<").otherwise(">")) == "<", 1).otherwise(0)
    v = F.coalesce("velocity", F.lit(velocity))
    digit = F.coalesce(F.concat(F.when(F.col("hand") == "<", "-").otherwise(""), F.col("digit").cast("string")), F.lit("0"))
    return segments.withColumns({"name": midi_to_pitch_name("midi"), "on_vel": v, "off_vel": v, "channel": channel, "finger": digit, "on_s": F.col("onset_ms") / 1000, "off_s": (F.col("onset_ms") + F.col("dur_ms")) / 1000})


def standardize_channels(pig: DataFrame) -> DataFrame:
    """Every note's channel as in the piece's first annotation, matched by onset and pitch."""
    first = pig.withColumn("_first", F.min("annot_id").over(Window.partitionBy("piece_id"))).where("annot_id = _first")
    first = first.groupBy("piece_id", "on_s", "name").agg(F.min("channel").alias("_channel"))
    return pig.join(first, ["piece_id", "on_s", "name"], "left").withColumn("channel", F.coalesce("_channel", "channel")).drop("_channel")


def zero_channels(pig: DataFrame) -> DataFrame:
    return pig.withColumn("channel", F.lit(0))


def _event_classes(pig: DataFrame, ticks_per_second: int) -> DataFrame:
    """(piece_id, _annots, n, s1, s2): the sets of annotations (structs, in order) that share events (channel, tick), with the number of these events and the sums of two hashes.

    One exchange, by event, so a task's share depends on no piece's or annotation's length; repeated events fall together.
    """
    tick = lambda c: F.round(F.col(c) * ticks_per_second).cast("long")
    events = pig.select("piece_id", "annot_id", "channel", F.explode(F.array(tick("on_s"), tick("off_s"))).alias("tick"))
    sets = in_parts(events, "piece_id", "channel", "tick").groupBy("piece_id", "channel", "tick").agg(F.sort_array(F.collect_set(F.struct("annot_id"))).alias("_annots"))
    total = lambda seed: F.sum(F.xxhash64("channel", "tick", F.lit(seed)).cast("decimal(38,0)"))  # noqa: E731  sums of 64-bit hashes never leave 38 digits
    return sets.groupBy("piece_id", "_annots").agg(F.count("*").alias("n"), total(1).alias("s1"), total(2).alias("s2"))


def _prints(classes: DataFrame) -> DataFrame:
    each = classes.select("piece_id", F.explode("_annots").alias("_a"), "n", "s1", "s2").select("piece_id", "_a.annot_id", "n", "s1", "s2")
    return each.groupBy("piece_id", "annot_id").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])


def event_prints(pig: DataFrame, *, ticks_per_second: int = 1920) -> DataFrame:
    """(piece_id, annot_id, n, s1, s2): a print of each annotation's set of (channel, tick): its size and the sums of two hashes.

    Repeated events are dropped first, so prints are sums over a set: they add up in any order and task, and only sums are
    exchanged after that, whatever the length of an annotation.
    """
    return _prints(_event_classes(pig, ticks_per_second))


def group_same_song(pig: DataFrame, *, ticks_per_second: int = 1920, verify: bool = True) -> DataFrame:
    """(piece_id, annot_id, song_id): annotations of a piece whose events fall on the same ticks share the least annotation id.

    Equal prints are candidates. With verify, an annotation's events are compared with those of its candidate, by the sets
    of annotations that share events, and one that differs from it is a song of its own.
    """
    classes = _event_classes(pig, ticks_per_second)
    least = Window.partitionBy("piece_id", "n", "s1", "s2")
    found = _prints(classes).select("piece_id", "annot_id", F.min("annot_id").over(least).alias("song_id"))
    if not verify:
        return found
    has = lambda c: F.array_contains("_annots", F.struct(F.col(c).alias("annot_id")))
    odd = found.where("annot_id != song_id").join(classes.select("piece_id", "_annots"), "piece_id").where(has("annot_id") & ~has("song_id"))  # sets of one size differ where one has what the other lacks
    odd = odd.select("piece_id", "annot_id").distinct().withColumn("_odd", F.lit(True))
    return found.join(odd, ["piece_id", "annot_id"], "left").select("piece_id", "annot_id", F.when(F.col("_odd"), F.col("annot_id")).otherwise(F.col("song_id")).alias("song_id"))
