"""Fingering strings: tokens, hands carried on, strikes and releases, pedals, and conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The grammar of a fingering token.
FINGER = r"[<>]?[1-5](?:-[<>]?[1-5])?|x"
SCORED = rf"[pf]*(?:{FINGER})[_^]*"
ORNAMENT = rf"\((?:{SCORED})+\)"
TOKEN = rf"(?:{ORNAMENT}(?:/{ORNAMENT})?|{SCORED}(?:/{SCORED})?)[,;.]?"
PLAIN = r"^([pf]*)([<>]?)([1-5]|x)?(?:-([<>]?)([1-5]))?([_^]*)"


def explode_abcdf(annotations: DataFrame, *, text: str = "abcdf", strict: bool = True) -> DataFrame:
    """One row per note of a fingering string: staff, line_idx, note_idx, token, its parts, and the handed digits of an ornament.

    '@' parts the staffs (upper, lower), '&' the lines; note_idx counts on through the lines of a staff. Of an
    ornament the first finger is taken, of alternatives the first. A null or empty string gives no rows. White space
    is left out; other text that is no fingering fails the job, or is left out too if not strict.
    """
    staffs = annotations.select("*", F.posexplode(F.split(text, "@")).alias("_s", "_staff"))
    lines = staffs.withColumn("_lines", F.transform(F.split("_staff", "&"), lambda line: F.regexp_replace(line, r"\s+", "")))
    # notes are counted inside the row, so rows that repeat an annotation keep their own numbers
    size = lambda line: F.size(F.regexp_extract_all(line, F.lit(f"({TOKEN})"), 1))
    before = F.transform("_lines", lambda _, i: F.aggregate(F.slice("_lines", F.lit(1), i), F.lit(0), lambda n, line: n + size(line)))
    lines = lines.select("*", F.posexplode(F.arrays_zip(F.col("_lines").alias("line"), before.alias("before"))).alias("line_idx", "_z"))
    lines = lines.withColumns({"_line": F.col("_z.line"), "_before": F.col("_z.before")})
    found, rest = F.regexp_extract_all("_line", F.lit(f"({TOKEN})"), 1), F.regexp_replace("_line", TOKEN, "")
    if strict:
        found = F.when((rest == "") | rest.isNull(), found).otherwise(F.raise_error(F.concat(F.lit("not a fingering: "), rest, F.lit(" in "), F.col("_line"))).cast("array<string>"))
    tokens = lines.withColumn("_tokens", found)
    rows = tokens.select(*annotations.columns, "_s", "line_idx", "_before", F.posexplode("_tokens").alias("_i", "token"))
    first = F.regexp_replace(F.split("token", "/")[0], r"[,;.]$", "")
    bare = F.regexp_replace(first, r"^\(", "")
    part = lambda k: F.regexp_extract("_bare", PLAIN, k)
    blank = lambda c: F.when(c != "", c)
    rows = rows.withColumn("_bare", bare)
    return rows.select(
        *annotations.columns,
        F.when(F.col("_s") == 0, "upper").otherwise("lower").alias("staff"), "line_idx", (F.col("_before") + F.col("_i")).cast("int").alias("note_idx"), "token",
        blank(part(2)).alias("strike_hand"), F.when(part(3).rlike("[1-5]"), part(3).cast("int")).alias("strike_digit"),
        blank(part(4)).alias("release_hand"), F.when(part(5) != "", part(5).cast("int")).alias("release_digit"),
        blank(part(1)).alias("soft"), blank(part(6)).alias("damper"), F.col("token").startswith("(").alias("is_ornament"),
        F.when(F.col("token").startswith("("), F.regexp_extract_all(F.regexp_extract("token", r"^\(([^)]*)\)", 1), F.lit(f"({FINGER})"), 1)).alias("ornament"),
        blank(F.coalesce(F.regexp_extract("token", r"/([^,;.]*)", 1), F.lit(""))).alias("alt"), blank(F.regexp_extract("token", r"([,;.])$", 1)).alias("seg_mark"),
    )


def default_hand(staff: Column) -> Column:
    return F.when(staff == "lower", "<").otherwise(">")


def _carried(keys):
    return Window.partitionBy(*keys).orderBy("note_idx").rowsBetween(Window.unboundedPreceding, 0)


def with_handed_digits(fingerings: DataFrame, *, keys) -> DataFrame:
    """Adds hand and hsd: the last hand mark, else the staff's own hand; 'x' where no digit is given.

    A mark on the release part counts for the notes after it.
    """
    before = Window.partitionBy(*keys).orderBy("note_idx").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.coalesce(F.col("strike_hand"), F.last(F.coalesce("release_hand", "strike_hand"), ignorenulls=True).over(before))
    hand = F.coalesce(mark, default_hand(F.col("staff")))
    return fingerings.withColumns({"hand": hand, "hsd": F.coalesce(F.concat(hand, F.col("strike_digit").cast("string")), F.lit("x"))})


def with_strike_release(fingerings: DataFrame, *, keys) -> DataFrame:
    """Adds strike and release as handed digits; a missing release is the strike."""
    f = with_handed_digits(fingerings, keys=keys)
    release = F.when(F.col("release_digit").isNotNull(), F.concat(F.coalesce("release_hand", "hand"), F.col("release_digit").cast("string"))).otherwise(F.col("hsd"))
    return f.withColumns({"strike": F.col("hsd"), "release": release})


def with_pedals(fingerings: DataFrame, *, keys) -> DataFrame:
    """Adds soft_state (p or f) and damper_state (_ or ^): the last sign given; f and ^ before any."""
    w = _carried(keys)
    state = lambda c, start: F.coalesce(F.last(F.substring(c, -1, 1), ignorenulls=True).over(w), F.lit(start))
    return fingerings.withColumns({"soft_state": state("soft", "f"), "damper_state": state("damper", "^")})


def segregated_digits(fingerings: DataFrame, *, keys) -> DataFrame:
    """(keys, digits): the digits of a staff in a row, null if any finger is of the other hand. Needs hand and staff."""
    other = F.max((F.col("hand") != default_hand(F.col("staff"))).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", F.coalesce(F.col("strike_digit").cast("string"), F.lit("x")).alias("d")))), lambda s: s["d"]), "")
    return fingerings.groupBy(*keys).agg(F.when(other == 0, text).alias("digits"))


def flatten_abcdf(text) -> Column:
    return F.translate(text, "&", "")


def simplify_abcdf(text) -> Column:
    """Drops hand marks that repeat the one before; each staff begins anew."""
    c = F.col(text) if isinstance(text, str) else text
    # each mark stands before its run of other signs; one like the mark before it, with no '@' between, is dropped
    runs = F.regexp_extract_all(c, F.lit(r"([<>]?[^<>]+|[<>])"), 1)
    mark = lambda x: F.regexp_extract(x, r"^[<>]", 0)

    def shown(x, i):
        before = F.get(runs, i - 1)
        again = (i > 0) & (mark(x) != "") & (mark(x) == mark(before)) & ~before.contains("@")
        return F.when(again, F.substring(x, 2, 1 << 30)).otherwise(x)

    return F.array_join(F.transform(runs, shown), "")


def join_segments(segments: DataFrame, *, text: str = "abcdf", order: str = "segment_idx", keys=("score_id",)) -> DataFrame:
    """(keys, abcdf): the segments' strings one after the other, simplified."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")
    return segments.groupBy(*keys).agg(whole.alias(text)).withColumn(text, simplify_abcdf(text))


def pig_finger_to_hsd(finger) -> Column:
    """'-3_2' to '<3-<2'; without a sign the right hand."""
    c = F.col(finger) if isinstance(finger, str) else finger
    part = lambda k: F.regexp_extract(c, r"^(-?)([1-5])(?:_(-?)([1-5]))?", k)
    hand = lambda k: F.when(part(k) == "-", "<").otherwise(">")
    return F.when(part(2) == "", "x").when(part(4) == "", F.concat(hand(1), part(2))).otherwise(F.concat(hand(1), part(2), F.lit("-"), hand(3), part(4)))


def hsd_to_pig_finger(hsd) -> Column:
    c = F.col(hsd) if isinstance(hsd, str) else hsd
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "-", "_"), "<", "-"), ">", ""), "^x$", "0")


def pig_strike(finger) -> Column:
    """A finger without its release part."""
    return F.split(finger, "_")[0]


def one_note_advice(midi, digit=None) -> Column:
    """The finger of a lone note: the given one, else 2 on black and 1 on white."""
    from handspan.functions.keys import is_black

    own = F.when(is_black(midi), 2).otherwise(1)
    return own if digit is None else F.coalesce(F.col(digit) if isinstance(digit, str) else digit, own)
