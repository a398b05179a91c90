"""Readers and writers on small files."""

from pyspark.sql import functions as F

from handspan.sources import abcd, interval_costs, pig
from handspan.streaming.notes import note_rates

SCORE = """% abcDidactyl v6
% abcD fingering 1: 123<12341@>54321321
% Authority: Ann Example (1889)
% Transcriber: Bo Example
% Transcription date: 2016-09-12 17:25:43
% slow and even
% abcD fingering 2: 2xx12341@54321321
% Authority: Cy Example (1915)
% Weight: 7
% abcDidactyl END
X:1
K:C
CDEF|
"""
PIG = """//Version: PianoFingering_v170101
0\t0.000000\t0.500000\tC4\t64\t80\t0\t1
1\t0.500000\t1.000000\tE4\t64\t80\t0\t3
"""


def test_abcd(spark, tmp_path):
    (tmp_path / "a.abcd").write_text(SCORE)
    (tmp_path / "b.abc").write_text("X:1\nK:C\nC|\n")
    got = {r.annot_id: r for r in abcd.read_abcd(spark, str(tmp_path), corpus="t").collect()}
    assert set(got) == {"1", "2"} and got["1"].abcdf == "123<12341@>54321321" and got["1"].authority_year == "1889" and got["1"].comments == "slow and even"
    assert got["1"].transcription_date.year == 2016 and got["2"].weight == 7 and got["2"].annot_idx == 1 and got["2"].transcriber is None
    texts = abcd.split_body(abcd.read_texts(spark, str(tmp_path))).withColumn("format", abcd.sniff_format("text"))
    body = {r.score_id: (r.body, r.format) for r in texts.collect()}
    assert body["a"] == ("X:1\nK:C\nCDEF|\n", "abcd") and body["b"][1] == "abc"
    again = abcd.render_abcd(abcd.read_abcd(spark, str(tmp_path))).select("score_id", F.lit("x").alias("path"), F.col("header").alias("text"))
    back = {r.annot_id: (r.abcdf, r.authority, r.authority_year, r.comments) for r in abcd.parse_annotations(again).collect()}
    assert back == {k: (r.abcdf, r.authority, r.authority_year, r.comments) for k, r in got.items()}


def test_corpora_and_composers(spark):
    c = abcd.Corpora()
    for n in "xy":
        c.register(n, lambda s, n=n: s.createDataFrame([(f"1-{n}", "12")], "score_id string, abcdf string"))
    both = c.load(spark, "x", "y")
    assert both.count() == 2 and {r.corpus for r in both.collect()} == {"x", "y"}
    p = spark.createDataFrame([("1", "Example")], "piece string, composer string")
    k = spark.createDataFrame([("Example", ["Baroque", "Classical"])], "composer string, periods array<string>")
    assert {r.period_str for r in abcd.enrich_composer(both, p, k).collect()} == {"Baroque_Classical"}


def test_assembled(spark):
    p = spark.createDataFrame([("s",)], "score_id string")
    f = spark.createDataFrame([("s", "123", 2), ("s", "<321@", 5)], "score_id string, fingering string, weight int")
    got = {r.annot_id: (r.abcdf, r.comments) for r in abcd.assemble_annotations(p, f).collect()}
    assert got == {"1": ("<321@", "Weight: 5"), "2": (">123@", "Weight: 2")}


def test_pig(spark, tmp_path):
    for n, finger in (("001-1", "1"), ("001-2", "1")):
        (tmp_path / f"{n}_fingering.txt").write_text(PIG.replace("\t0\t1\n", f"\t{0 if n[-1] == '1' else 1}\t{finger}\n"))
    rows = pig.read_pig(spark, str(tmp_path))
    assert rows.count() == 4 and {r.piece_id for r in rows.collect()} == {"001"}
    assert {r.channel for r in pig.standardize_channels(rows).collect()} == {0}
    assert {r.song_id for r in pig.group_same_song(pig.zero_channels(rows)).collect()} == {"1"}
    assert {r.song_id for r in pig.group_same_song(rows).collect()} == {"1", "2"}
    text = pig.render_pig(rows.where("annot_id = '1'").withColumn("midi", F.when(F.col("name") == "C4", 60).otherwise(64))).first().text
    assert text == PIG.rstrip("\n")


def test_segments_to_pig(spark):
    s = spark.createDataFrame([(61, "<", "upper", 3, None, 0, 500), (60, None, "upper", None, 70, 500, 250)], "midi int, hand string, staff string, digit int, velocity int, onset_ms int, dur_ms int")
    got = [(r.name, r.channel, r.on_vel, r.finger) for r in pig.segments_to_pig(s).orderBy("on_s").collect()]
    assert got == [("C#4", 1, 64, "-3"), ("C4", 0, 70, "0")]


def test_interval_costs(spark, tmp_path):
    (tmp_path / "t.dat").write_text("Max_Interval: 2\nWhite_to_White\n1 2  999 1 2\n2 1  999 3\nWhite_to_Black\n1 2 5 6 7\n")
    t = {(r.low_color, r.high_color, r.low_finger, r.high_finger, r.semitones): r.cost for r in interval_costs.read_interval_costs(spark, str(tmp_path / "t.dat")).collect()}
    assert len(t) == 2 * 2 * 25 * 3 and t[0, 0, 1, 2, 2] == 2 and t[0, 0, 2, 1, 2] == 999 and t[0, 1, 1, 2, 0] == 5 and t[1, 1, 5, 5, 0] == 999


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("m", 0.5)], "model string, value double")
    abcd.write_results(rows, str(tmp_path / "out"))
    assert abcd.read_results(spark, str(tmp_path / "out"), "part", "model string, value double").collect() == rows.collect()


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 60), (1, "2024-01-01 00:20:00", 64), (1, "2024-01-01 05:00:00", 50)], "score_id long, ts string, midi int").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = note_rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.notes, r.low, r.high) for r in spark.sql("select * from rates").collect()] == [(2, 60, 64)]
