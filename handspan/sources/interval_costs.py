"""Tables of interval costs: a heading for each pair of key colours, then a row for each pair of fingers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MISSING = 999


def parse_interval_costs(lines: DataFrame) -> DataFrame:
    """(low_color, high_color, low_finger, high_finger, semitones, cost) from (file, line_no, value); cells that aren't there cost 999.

    Colours are 0 for white and 1 for black. The whole grid is given, up to the file's largest interval.
    """
    heading = r"^(White|Black)_to_(White|Black)"
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    color = lambda k: F.last(F.when(F.col("value").rlike(heading), F.when(F.regexp_extract("value", heading, k) == "Black", 1).otherwise(0)), ignorenulls=True).over(w)
    most = F.max(F.nullif(F.regexp_extract("value", r"^Max_Interval: *(\d+)", 1), F.lit("")).cast("int")).over(Window.partitionBy("file"))
    rows = lines.withColumns({"low_color": color(1), "high_color": color(2), "most": most}).where(F.col("value").rlike(r"^\s*[1-5]\s+[1-5]\s"))
    f = F.split(F.trim("value"), r"\s+")
    cells = rows.select("most", "low_color", "high_color", f[0].cast("int").alias("low_finger"), f[1].cast("int").alias("high_finger"), F.posexplode(F.slice(f, F.lit(3), F.size(f))).alias("semitones", "_c"))
    cells = cells.select("low_color", "high_color", "low_finger", "high_finger", "semitones", F.col("_c").cast("int").alias("_cost"), "most")
    five, two = F.array(*[F.lit(x) for x in range(1, 6)]), F.array(F.lit(0), F.lit(1))
    grid = rows.select("most").distinct()
    for name, values in (("low_color", two), ("high_color", two), ("low_finger", five), ("high_finger", five)):
        grid = grid.withColumn(name, F.explode(values))
    grid = grid.withColumn("semitones", F.explode(F.sequence(F.lit(0), "most"))).drop("most")
    return grid.join(cells.drop("most"), ["low_color", "high_color", "low_finger", "high_finger", "semitones"], "left").withColumn("cost", F.coalesce("_cost", F.lit(MISSING))).drop("_cost")


def read_interval_costs(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return parse_interval_costs(whole)
