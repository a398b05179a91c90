"""Annotated scores: text files with a header of fingering annotations before the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The marks of the header.
TITLE = r"^% abcDidactyl v(\d+)"
END = r"^% abcDidactyl END"
FINGERING = r"^% abcD fingering (\d+): ?(.*)$"
AUTHORITY = r"^% Authority: ?(.*?) ?(?:\((\d{4})\))?$"
TRANSCRIBER = r"^% Transcriber: ?(.*)$"
DATE = r"^% Transcription date: ?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(score_id, path, text): one row per file; the id is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("*", F.col("_metadata.file_path").alias("path"))
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("score_id"), "path", F.col("value").alias("text"))


def parse_annotations(texts: DataFrame, *, corpus: str = "") -> DataFrame:
    """One row per annotation of each header: annot_idx, annot_id, abcdf, authority, authority_year, transcriber, transcription_date, comments, weight, version.

    Header lines that say nothing else are comments of the annotation above them; a text without a header has none.
    """
    lines = texts.select("score_id", "path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy("score_id", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_f, is_end, is_title = F.col("line").rlike(FINGERING), F.col("line").rlike(END), F.col("line").rlike(TITLE)
    lines = lines.withColumns({"annot": F.sum(is_f.cast("int")).over(w), "ended": F.max(is_end.cast("int")).over(w), "begun": F.max(is_title.cast("int")).over(w), "version": F.max(F.regexp_extract("line", TITLE, 1)).over(w)})
    h = lines.where("begun = 1 and ended = 0 and annot > 0 and line like '\\%%'")
    is_other = ~is_f & ~F.col("line").rlike(AUTHORITY) & ~F.col("line").rlike(TRANSCRIBER) & ~F.col("line").rlike(DATE)
    pick = lambda p, k: F.max(F.when(F.col("line").rlike(p), F.nullif(F.regexp_extract("line", p, k), F.lit(""))))
    comments = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_other & (F.trim(F.regexp_replace("line", "^%", "")) != ""), F.struct("line_no", F.trim(F.regexp_replace("line", "^%", "")).alias("t"))))), lambda s: s["t"]), "\n")
    got = h.groupBy("score_id", "path", "annot", "version").agg(
        pick(FINGERING, 1).alias("annot_id"), F.coalesce(pick(FINGERING, 2), F.lit("")).alias("abcdf"), pick(AUTHORITY, 1).alias("authority"), pick(AUTHORITY, 2).alias("authority_year"),
        pick(TRANSCRIBER, 1).alias("transcriber"), F.to_timestamp(pick(DATE, 1)).alias("transcription_date"), comments.alias("comments"),
    )
    weight = F.coalesce(F.nullif(F.regexp_extract("comments", r"Weight: (\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return got.select(F.lit(corpus).alias("corpus"), "score_id", (F.col("annot") - 1).cast("int").alias("annot_idx"), "annot_id", "abcdf", "authority", "authority_year", "transcriber", "transcription_date", "comments", weight.alias("weight"), "version")


def read_abcd(spark: SparkSession, path: str, *, corpus: str = "") -> DataFrame:
    """The annotations of all files in a folder, and in those below it."""
    return parse_annotations(read_texts(spark, path), corpus=corpus)


def split_body(texts: DataFrame) -> DataFrame:
    """Adds body: the text after the header, all of it where there is none."""
    rest = F.regexp_extract("text", r"(?s)(?:^|\n)% abcDidactyl END[^\n]*\n(.*)$", 1)
    return texts.withColumn("body", F.when(F.col("text").rlike(r"(?m)" + END), rest).otherwise(F.col("text")))


def sniff_format(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike(r"(?m)" + TITLE), "abcd").when(F.ltrim(c).startswith("<"), "musicxml").otherwise("abc")


def render_abcd(annotations: DataFrame) -> DataFrame:
    """(score_id, header): the header lines of each score's annotations, version 6."""
    comments = F.transform(F.filter(F.split(F.coalesce("comments", F.lit("")), "\n"), lambda c: c != ""), lambda c: F.concat(F.lit("% "), c))
    year = F.when(F.col("authority_year").isNotNull(), F.concat(F.lit(" ("), F.col("authority_year"), F.lit(")"))).otherwise("")
    lines = F.concat(
        F.array(F.concat(F.lit("% abcD fingering "), F.col("annot_id"), F.lit(": "), F.col("abcdf")), F.concat(F.lit("% Authority: "), F.coalesce("authority", F.lit("")), year),
                F.concat(F.lit("% Transcriber: "), F.coalesce("transcriber", F.lit("")))),
        F.when(F.col("transcription_date").isNotNull(), F.array(F.concat(F.lit("% Transcription date: "), F.date_format("transcription_date", "yyyy-MM-dd HH:mm:ss")))).otherwise(F.array().cast("array<string>")), comments,
    )
    each = annotations.select("score_id", "annot_idx", F.array_join(lines, "\n").alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("annot_idx", "t"))), lambda s: s["t"]), "\n")
    return each.groupBy("score_id").agg(F.concat(F.lit("% abcDidactyl v6\n"), body, F.lit("\n% abcDidactyl END\n")).alias("header"))


def write_abcd(annotations: DataFrame, path: str) -> None:
    """One text per score, in a folder of its id."""
    render_abcd(annotations).write.partitionBy("score_id").text(path)


def assemble_annotations(pieces: DataFrame, fingerings: DataFrame, *, on: str = "score_id") -> DataFrame:
    """Joins pieces and fingerings: a right-hand mark where there is no hand, '@' where there is no staff, ids from 1, the weight as a comment."""
    f = pieces.join(fingerings, on)
    text = F.when(F.col("fingering").rlike("[<>]"), F.col("fingering")).otherwise(F.concat(F.lit(">"), F.col("fingering")))
    text = F.when(text.contains("@"), text).otherwise(F.concat(text, F.lit("@")))
    place = F.row_number().over(Window.partitionBy(on).orderBy(F.desc("weight"), "fingering"))
    return f.withColumns({"abcdf": text, "annot_id": place.cast("string"), "comments": F.concat(F.lit("Weight: "), F.col("weight").cast("string"))})


def advice_votes(subjects: DataFrame, exercises: DataFrame, *, full: bool = True, study: str | None = None) -> DataFrame:
    """(exercise, fingering, votes): subjects' fingerings of exercises by count, most first. full: of the exercise's whole length only."""
    s = subjects.where(F.col("fingering").isNotNull())
    if study is not None:
        s = s.where(F.col("study").like(study))
    j = s.join(exercises, "exercise")
    if full:
        j = j.where(F.length("fingering") == F.col("note_count"))
    return j.groupBy("exercise", "fingering").agg(F.count("*").alias("votes")).orderBy("exercise", F.desc("votes"), "fingering")


class Corpora:
    """Named corpora: each a function of a session that gives annotations; several are read as one table."""

    def __init__(self):
        self.readers = {}

    def register(self, name: str, reader) -> None:
        self.readers[name] = reader

    def load(self, spark: SparkSession, *names: str) -> DataFrame:
        if not names or any(n not in self.readers for n in names):
            raise KeyError(f"known corpora: {sorted(self.readers)}")
        out = None
        for n in names:
            df = self.readers[n](spark).withColumn("corpus", F.lit(n))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out


def enrich_composer(scores: DataFrame, pieces: DataFrame, composers: DataFrame) -> DataFrame:
    """Adds composer by the piece's number (before '-') and the composer's periods as text; a piece that isn't listed, or a composer without periods, fails the job."""
    s = scores.withColumn("_piece", F.split("score_id", "-")[0]).join(pieces.withColumnRenamed("piece", "_piece"), "_piece", "left")
    s = s.join(composers, "composer", "left")
    known = F.when(F.col("composer").isNull(), F.raise_error(F.concat(F.lit("unknown piece: "), F.col("score_id")))).when(F.col("composer").isNotNull() & F.col("periods").isNull(), F.raise_error(F.concat(F.lit("unknown composer: "), F.col("composer")))).otherwise(F.array_join("periods", "_"))
    return s.withColumn("period_str", known).drop("_piece")


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def read_results(spark: SparkSession, folder: str, base: str, schema: str) -> DataFrame:
    """All result files of a folder whose names begin with the base."""
    return spark.read.schema(schema).option("header", True).csv(folder, pathGlobFilter=f"{base}*", recursiveFileLookup=True)
