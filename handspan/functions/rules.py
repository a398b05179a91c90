"""Rule costs of a fingered trigram, each a Column; a model is a weighted sum of them.

A trigram has three pitches, hands and digits; a first note has no note 1 and a last note no note 3. Rules on
intervals hold within one hand: hands that are missing don't count as others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from handspan.functions.dims import PRESETS, span
from handspan.functions.keys import RULERS, is_between, is_black, is_white

RING, LITTLE = 4, 5


class Trigram:
    """Columns of a trigram, with the spans and the ruler that its rules use.

    step and skip are the ruler's distances from note 1 to notes 2 and 3, where columns hold them already.
    """

    def __init__(self, midi: list[Column], hand: list[Column], digit: list[Column], table: str = "parncutt", ruler: str = "semitone", step: Column | None = None, skip: Column | None = None):
        self.m1, self.m2, self.m3 = midi
        self.h1, self.h2, self.h3 = hand
        self.d1, self.d2, self.d3 = digit
        self.table = table
        self.hand = self.h2
        self.same = F.coalesce(self.h1 == self.h2, F.lit(True)) & F.coalesce(self.h2 == self.h3, F.lit(True)) & F.coalesce(self.h1 == self.h3, F.lit(True))
        self.right = self.hand == ">"
        self.step = RULERS[ruler](self.m1, self.m2) if step is None else step
        self.skip = RULERS[ruler](self.m1, self.m3) if skip is None else skip
        self.thumb12 = (self.d1 == 1) | (self.d2 == 1)
        #: Digits rise outwards on the keyboard: 1 to 5 upwards for the right hand, 5 to 1 for the left.
        self.outward = F.when(self.right, self.d2 - self.d1).otherwise(self.d1 - self.d2)

    def s12(self, field: str) -> Column:
        return span(self.table, field, self.hand, self.d1, self.d2)

    def s13(self, field: str) -> Column:
        return span(self.table, field, self.hand, self.d1, self.d3)

    def spread(self, field: str) -> Column:
        """The span of digits 1 and 2 taken as a rising right-hand pair."""
        return span(self.table, field, F.lit(">"), F.least(self.d1, self.d2), F.greatest(self.d1, self.d2))


def _positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def _cost(condition: Column, value) -> Column:
    """value where the condition holds, else 0; a condition that isn't known doesn't hold."""
    return F.coalesce(F.when(condition, value), F.lit(0))


def stretch(t: Trigram) -> Column:
    return _cost(t.same & t.m1.isNotNull(), 2 * (_positive(t.step - t.s12("max_comf")) + _positive(t.s12("min_comf") - t.step)))


def small_span(t: Trigram, penalty: int = 2) -> Column:
    short = F.when(t.outward > 0, _positive(t.s12("min_rel") - t.step)).when(t.outward < 0, _positive(t.step - t.s12("max_rel"))).otherwise(0)
    return _cost(t.same & t.m1.isNotNull(), F.when(t.thumb12, 1).otherwise(penalty) * short)


def small_span_literal(t: Trigram) -> Column:
    return _cost(t.same & t.m1.isNotNull(), F.when(t.thumb12, 1).otherwise(2) * _positive(t.s12("min_rel") - t.step))


def _digits_follow(t: Trigram) -> Column:
    return ((t.d1 < t.d2) & (t.m1 < t.m2)) | ((t.d1 > t.d2) & (t.m1 > t.m2))


def large_span(t: Trigram, penalty: int = 2) -> Column:
    return _cost(t.same & _digits_follow(t), F.when(t.thumb12, 1).otherwise(penalty) * _positive(F.abs(t.step) - t.spread("max_rel")))


def large_span_literal(t: Trigram) -> Column:
    return _cost(t.same & t.m1.isNotNull(), F.when(t.thumb12, 1).otherwise(2) * _positive(t.step - t.s12("max_rel")))


def large_span_comfort(t: Trigram) -> Column:
    steady = t.m3.isNotNull() & (position_change_count(t) <= 1)
    limit = F.when(steady, t.spread("max_comf")).otherwise(t.spread("max_rel"))
    return _cost(t.same & _digits_follow(t), F.when(t.thumb12, 1).otherwise(2) * _positive(F.abs(t.step) - limit))


def _ends(t: Trigram) -> Column:
    return t.same & t.m1.isNotNull() & t.m3.isNotNull()


def position_change_count(t: Trigram) -> Column:
    through = (t.d2 == 1) & is_between(t.m2, t.m1, t.m3)
    over, under = t.skip > t.s13("max_comf"), t.skip < t.s13("min_comf")
    full = through & F.when(over, t.skip > t.s13("max_prac")).otherwise(t.skip < t.s13("min_prac"))
    return _cost(_ends(t) & (over | under), F.when(full, 2).otherwise(1))


def position_change_size(t: Trigram) -> Column:
    return _cost(_ends(t), _positive(t.s13("min_comf") - t.skip) + _positive(t.skip - t.s13("max_comf")))


def weak_finger(t: Trigram) -> Column:
    return _cost(t.d2.isin(RING, LITTLE), 1)


def weak_ring_finger(t: Trigram) -> Column:
    return _cost(t.d2 == RING, 1)


def three_four_five(t: Trigram) -> Column:
    return _cost(t.same & (F.sort_array(F.array(t.d1, t.d2, t.d3)) == F.array(F.lit(3), F.lit(4), F.lit(5))), 1)


def three_to_four(t: Trigram) -> Column:
    return _cost(t.same & (t.d1 == 3) & (t.d2 == RING), 1)


def four_on_black(t: Trigram) -> Column:
    down = (t.d1 == RING) & is_black(t.m1) & (t.d2 == 3) & is_white(t.m2)
    up = (t.d1 == 3) & is_white(t.m1) & (t.d2 == RING) & is_black(t.m2)
    return _cost(F.coalesce(down, F.lit(False)) | F.coalesce(up, F.lit(False)), 1)


def _white(m: Column) -> Column:
    return F.coalesce(is_white(m), F.lit(False)).cast("int")


def thumb_on_black(t: Trigram) -> Column:
    return _cost((t.d2 == 1) & is_black(t.m2), 1 + 2 * _white(t.m1) + 2 * _white(t.m3))


def five_on_black(t: Trigram) -> Column:
    return _cost((t.d2 == LITTLE) & is_black(t.m2), 2 * _white(t.m1) + 2 * _white(t.m3))


def thumb_passing(t: Trigram, bad: int = 3) -> Column:
    level = is_black(t.m1) == is_black(t.m2)
    inward = F.when(t.right, t.m2 < t.m1).otherwise(t.m2 > t.m1)
    outward = F.when(t.right, t.m2 > t.m1).otherwise(t.m2 < t.m1)
    over = _cost((t.d1 == 1) & inward, F.when(level, 1).when(is_black(t.m1), bad).otherwise(0))
    under = (t.d2 == 1) & outward
    return _cost(t.same & t.m1.isNotNull(), F.when(F.coalesce(under, F.lit(False)) & (level | is_black(t.m2)), F.when(level, 1).otherwise(bad)).otherwise(over))


def alternation_pairing(t: Trigram) -> Column:
    pair = (t.d1 == t.d3) & (((t.d1 == 3) & (t.d2 == 4)) | ((t.d1 == 4) & t.d2.isin(3, 5)) | ((t.d1 == 5) & (t.d2 == 4)))
    return _cost(t.same & pair, 1)


def alternation_finger_change(t: Trigram) -> Column:
    return _cost(t.same & (t.m1 == t.m3) & (t.d1 != t.d3), 1)


def black_thumb_pivot(t: Trigram) -> Column:
    weak2, weak1 = t.d2.isin(RING, LITTLE), t.d1.isin(RING, LITTLE)
    inward = F.when(t.right, t.m2 < t.m1).otherwise(t.m2 > t.m1)
    from_thumb = inward & (t.d1 == 1) & is_black(t.m1) & weak2 & is_white(t.m2)
    to_thumb = ~inward & (t.d2 == 1) & is_black(t.m2) & weak1 & is_white(t.m1)
    return _cost(t.same & (t.m1 != t.m2) & (from_thumb | to_thumb), t.d2 - 1)


def thumb_on_black_to_weak(t: Trigram) -> Column:
    against = F.when(t.right, t.m2 < t.m1).otherwise(t.m2 > t.m1)
    on = (t.m1 != t.m2) & (t.d1 == 1) & is_black(t.m1) & is_white(t.m2) & t.d2.isin(RING, LITTLE)
    return _cost(t.same & on & (against | (t.step < t.s12("min_rel"))), t.d2 - 1)


def weak_to_thumb_on_black(t: Trigram) -> Column:
    along = F.when(t.right, t.m2 > t.m1).otherwise(t.m2 < t.m1)
    on = (t.m1 != t.m2) & (t.d2 == 1) & is_black(t.m2) & is_white(t.m1) & t.d1.isin(RING, LITTLE)
    return _cost(t.same & on & (along | (t.step > t.s12("max_rel"))), t.d1 - 1)


def position_change(t: Trigram) -> Column:
    out = (t.skip < t.s13("min_comf")) | (t.skip > t.s13("max_comf"))
    far = (t.skip < t.s13("min_prac")) | (t.skip > t.s13("max_prac"))
    through = (t.m1 < t.m2) & (t.m2 < t.m3) & (t.d2 == 1) & far
    return _cost(_ends(t), out.cast("int") + (out & through).cast("int") + ((t.m1 == t.m3) & (t.d1 != t.d3)).cast("int"))


def repeat_finger_on_position_change(t: Trigram) -> Column:
    return _cost(_ends(t) & (t.m1 != t.m3) & (t.d1 == t.d3) & (position_change_count(t) > 0), 1)


def impractical(t: Trigram) -> Column:
    return _cost(t.same & t.m1.isNotNull(), 10 * (_positive(t.step - t.s12("max_prac")) + _positive(t.s12("min_prac") - t.step)))


def nonrepeating_finger(t: Trigram) -> Column:
    return _cost((t.m1 == t.m2) & ((t.d1 != t.d2) | (t.h1 != t.h2)), 1)


#: Rules by tag; a caller may add its own functions of a Trigram.
RULES: dict[str, Callable[[Trigram], Column]] = {
    "str": stretch, "sma": small_span, "smal": small_span_literal, "smaw": lambda t: small_span(t, 1), "lar": large_span, "larl": large_span_literal,
    "larj": lambda t: large_span(t, 1), "larb": large_span_comfort, "pcc": position_change_count, "pcs": position_change_size,
    "wea": weak_finger, "weaj": weak_ring_finger, "345": three_four_five, "3t4": three_to_four, "bl4": four_on_black, "bl1": thumb_on_black,
    "bl5": five_on_black, "pa1": thumb_passing, "pa1w": lambda t: thumb_passing(t, 2), "aprb": alternation_pairing, "afcb": alternation_finger_change,
    "b1pb": black_thumb_pivot, "b1wb": thumb_on_black_to_weak, "wb1b": weak_to_thumb_on_black, "pchw": position_change, "pcow": position_change_size,
    "rfrw": repeat_finger_on_position_change, "impw": impractical, "nrfw": nonrepeating_finger,
}


def preset_costs(t: Trigram, preset: str, weights: dict[str, float] | None = None) -> dict[str, Column]:
    """The weighted cost of each rule of a preset; `weights` replace the preset's own (0 mutes a rule)."""
    tags, _, _, own = PRESETS[preset]
    return {tag: RULES[tag](t) * F.lit(float((own | (weights or {})).get(tag, 1.0))) for tag in tags}
