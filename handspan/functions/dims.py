"""Dimension tables of the fingering models: finger spans, edit distances, presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIELDS = ("min_prac", "min_comf", "min_rel", "max_rel", "max_comf", "max_prac")
PAIRS = ((1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5))

# Semitone spans of the right hand's rising finger pairs, in order of PAIRS and FIELDS.
RISING_SPANS = {
    "parncutt": (
        (-5, -3, 1, 5, 8, 10), (-4, -2, 3, 7, 10, 12), (-3, -1, 5, 9, 12, 14), (-1, 1, 7, 10, 13, 15), (1, 1, 1, 2, 3, 5),
        (1, 1, 3, 4, 5, 7), (2, 2, 5, 6, 8, 10), (1, 1, 1, 2, 2, 4), (1, 1, 3, 4, 5, 7), (1, 1, 1, 2, 3, 5),
    ),
    "balliauw_large": (
        (-10, -8, 1, 6, 9, 11), (-8, -6, 3, 9, 13, 15), (-6, -4, 5, 11, 14, 16), (-2, 0, 7, 12, 16, 18), (1, 1, 1, 2, 5, 7),
        (1, 1, 3, 4, 6, 8), (2, 2, 5, 6, 10, 12), (1, 1, 1, 2, 2, 4), (1, 1, 3, 4, 6, 8), (1, 1, 1, 2, 4, 6),
    ),
    "balliauw_medium": (
        (-8, -6, 1, 5, 8, 10), (-7, -5, 3, 9, 12, 14), (-5, -3, 5, 11, 13, 15), (-2, 0, 7, 12, 14, 16), (1, 1, 1, 2, 5, 7),
        (1, 1, 3, 4, 6, 8), (2, 2, 5, 6, 10, 12), (1, 1, 1, 2, 2, 4), (1, 1, 3, 4, 6, 8), (1, 1, 1, 2, 4, 6),
    ),
    "balliauw_small": (
        (-7, -5, 1, 3, 8, 10), (-6, -4, 3, 6, 10, 12), (-4, -2, 5, 8, 11, 13), (-2, 0, 7, 10, 12, 14), (1, 1, 1, 2, 4, 6),
        (1, 1, 3, 4, 6, 8), (2, 2, 5, 6, 8, 10), (1, 1, 1, 2, 2, 4), (1, 1, 3, 4, 6, 8), (1, 1, 1, 2, 4, 6),
    ),
    "badgerow": (
        (-5, -3, 1, 5, 9, 10), (-4, -2, 1, 7, 11, 12), (-3, -1, 2, 9, 13, 14), (-1, 1, 7, 10, 14, 15), (1, 1, 1, 2, 2, 5),
        (1, 1, 3, 4, 5, 7), (2, 2, 5, 6, 8, 10), (1, 1, 1, 2, 2, 4), (1, 1, 3, 4, 5, 7), (1, 1, 1, 2, 3, 5),
    ),
}

# The left hand's spans that aren't the right hand's mirrored, by (larger digit, smaller digit), rising.
LEFT_SPANS = {"badgerow": {(4, 1): (-3, -1, 3, 9, 13, 14), (3, 2): (1, 1, 1, 2, 3, 5)}}

HANDED_DIGITS = ("<5", "<4", "<3", "<2", "<1", ">1", ">2", ">3", ">4", ">5")


def span_of(table: str, hand: str, a: int, b: int) -> dict[str, int]:
    """A hand's span from digit a to digit b: a falling pair is the rising one turned about, one digit spans nothing.

    The right hand rises from the smaller digit to the larger one; the left hand is its mirror image but for LEFT_SPANS.
    """
    if a == b:
        return dict.fromkeys(FIELDS, 0)
    small, large = sorted((a, b))
    rising = RISING_SPANS[table][PAIRS.index((small, large))]
    if hand == "<":
        rising = LEFT_SPANS.get(table, {}).get((large, small), rising)
    return dict(zip(FIELDS, rising if (a < b) == (hand == ">") else [-x for x in rising[::-1]], strict=True))


def span_array(table: str, field: str, hand: str = ">") -> list[int]:
    """A hand's values at index 5 * (a - 1) + b - 1."""
    return [span_of(table, hand, a, b)[field] for a in range(1, 6) for b in range(1, 6)]


def span(table: str, field: str, hand: Column, a: Column, b: Column) -> Column:
    """A span of one hand's digit pair."""
    values = lambda h: F.array(*[F.lit(x) for x in span_array(table, field, h)])
    at = ((a - 1) * 5 + b).cast("int")
    return F.when(hand == ">", F.element_at(values(">"), at)).otherwise(F.element_at(values("<"), at))


def finger_spans(spark: SparkSession) -> DataFrame:
    """(table, hd1, hd2, six spans): 50 rows for each table."""
    rows = []
    for t in RISING_SPANS:
        for a in range(1, 6):
            for b in range(1, 6):
                rows += [(t, f"{h}{a}", f"{h}{b}", *span_of(t, h, a, b).values()) for h in "<>"]
    return spark.createDataFrame(rows, "table string, hd1 string, hd2 string, " + ", ".join(f"{f} int" for f in FIELDS))


def handed_place(hand, digit) -> Column:
    """Place of a finger in the row of both hands, little finger of the left hand first: 0..9."""
    return F.when(hand == "<", 5 - digit).otherwise(digit + 4)


def edit_distance(method: str, hand_a, digit_a, hand_b, digit_b) -> Column:
    """hamming: 1 if the fingers differ. natural: places apart. pivot: places apart, three more to or from a thumb
    of the same hand, nine more (less one for the thumbs between) to the other hand. A missing digit costs nothing.
    """
    apart = F.abs(handed_place(hand_a, digit_a) - handed_place(hand_b, digit_b))
    if method == "hamming":
        d = (apart > 0).cast("int")
    elif method == "natural":
        d = apart
    elif method == "pivot":
        thumb = (digit_a == 1) != (digit_b == 1)
        d = F.when(hand_a == hand_b, apart + F.when(thumb, 3).otherwise(0)).otherwise(apart + 9)
    else:
        raise ValueError(method)
    return F.coalesce(d, F.lit(0))


PARNCUTT_RULES = ("str", "sma", "lar", "pcc", "pcs", "wea", "345", "3t4", "bl4", "bl1", "bl5", "pa1")
JACOBS_RULES = ("str", "sma", "larj", "pcc", "pcs", "weaj", "3t4", "bl4", "bl1", "bl5", "pa1")
BADGEROW_RULES = ("str", "sma", "larb", "pcc", "pcs", "wea", "345", "3t4", "bl4", "bl1", "bl5", "pa1", "aprb", "afcb", "b1wb", "b1pb")
BALLIAUW_RULES = ("str", "smaw", "pchw", "pcow", "weaj", "3t4", "bl4", "bl1", "bl5", "pa1", "rfrw", "impw", "nrfw")
HALF_BLACK = {"bl1": 0.5, "bl5": 0.5}

#: Model variants: (rules, span table, ruler, weights that aren't 1).
PRESETS = {
    "parncutt": (PARNCUTT_RULES, "parncutt", "semitone", {}),
    "jacobs": (JACOBS_RULES, "parncutt", "physical", {}),
    "jarules": (JACOBS_RULES, "parncutt", "semitone", {}),
    "jaball": (JACOBS_RULES, "balliauw_large", "imaginary", {}),
    "jaSball": (JACOBS_RULES, "balliauw_small", "imaginary", {}),
    "jaMball": (JACOBS_RULES, "balliauw_medium", "imaginary", {}),
    "badgerow": (BADGEROW_RULES, "badgerow", "semitone", {}),
    "badpar": (BADGEROW_RULES, "parncutt", "semitone", {}),
    "balliauw": (BALLIAUW_RULES, "balliauw_large", "imaginary", HALF_BLACK),
    "badball": (BADGEROW_RULES, "balliauw_large", "imaginary", {}),
    "badSball": (BADGEROW_RULES, "balliauw_small", "imaginary", {}),
    "badMball": (BADGEROW_RULES, "balliauw_medium", "imaginary", {}),
}
