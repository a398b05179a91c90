"""Columns over MIDI pitches: key colours, directions, distances on the keyboard, pitch names."""

from __future__ import annotations

from itertools import accumulate, cycle, islice

from pyspark.sql import Column, functions as F

# Fixed values.
BLACK = (1, 3, 6, 8, 10)
CRAMPED = (2, 7, 9)
#: Millimetres from each key's centre line to the next one's, from A0 on.
KEY_STEPS_MM = (11.5, 15.5, 8, 23.5, 9.5, 14, 14, 9.5, 23.5, 8, 15.5, 11.5)
#: Ranks of the pitch classes where every pair of neighbouring white keys has a black one between them.
IMAGINARY_RANKS = (0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12)
PITCH_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
LOWEST, HIGHEST = 21, 108
MAX_LEAP = 16
CHORD_MS = 30


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pitch_class(midi) -> Column:
    return F.pmod(_col(midi), F.lit(12))


def is_black(midi) -> Column:
    return pitch_class(midi).isin(*BLACK)


def is_white(midi) -> Column:
    return ~is_black(midi)


def key_color(midi) -> Column:
    """'black' or 'white'."""
    return F.when(is_black(midi), "black").when(is_white(midi), "white")


def is_cramped(midi) -> Column:
    return pitch_class(midi).isin(*CRAMPED)


def signed_semitone_delta(midi, prior) -> Column:
    return _col(midi) - _col(prior)


def semitone_delta(midi, prior) -> Column:
    return F.abs(signed_semitone_delta(midi, prior))


def direction(midi, prior) -> Column:
    """1 up, -1 down, 0 the same; null without a prior note."""
    return F.signum(signed_semitone_delta(midi, prior)).cast("int")


def is_between(midi, a, b) -> Column:
    """Strictly between, either way round; false where a note is missing."""
    m, a, b = _col(midi), _col(a), _col(b)
    return F.coalesce(((a < m) & (m < b)) | ((b < m) & (m < a)), F.lit(False))


def distance_semitone(a, b, max_leap: int | None = MAX_LEAP) -> Column:
    """b - a, held within one more than max_leap either way; None doesn't hold it."""
    d = _col(b) - _col(a)
    return d if max_leap is None else F.greatest(F.least(d, F.lit(max_leap + 1)), F.lit(-max_leap - 1))


def key_positions() -> list[float]:
    """Millimetres to the centre line of each key from A0 to C8."""
    return list(accumulate(islice(cycle(KEY_STEPS_MM), HIGHEST - LOWEST + 1)))


def semitone_bounds(max_leap: int = MAX_LEAP) -> list[float]:
    """The upper bound in millimetres of each semitone distance but the last: half way between average spans."""
    at = key_positions()
    mean = [sum(at[i + size] - at[i] for i in range(12)) / 12 for size in range(max_leap)]
    return [0.0] + [(mean[i] + mean[i - 1]) / 2 for i in range(2, max_leap)]


def distance_physical(a, b, max_leap: int = MAX_LEAP) -> Column:
    """The millimetres between two keys as signed average semitones; all beyond the table share the last one."""
    at = F.array(*[F.lit(float(x)) for x in key_positions()])
    mm = F.element_at(at, (_col(b) - (LOWEST - 1)).cast("int")) - F.element_at(at, (_col(a) - (LOWEST - 1)).cast("int"))
    bounds = semitone_bounds(max_leap)
    size = sum((F.abs(mm) > x).cast("int") for x in bounds)
    return F.when(_col(b) < _col(a), -size).otherwise(size)


def imaginary_rank(midi) -> Column:
    ranks = F.array(*[F.lit(x) for x in IMAGINARY_RANKS])
    return F.element_at(ranks, (pitch_class(midi) + 1).cast("int")) + 14 * F.floor(_col(midi) / 12).cast("int")


def distance_imaginary(a, b) -> Column:
    """Semitones, and one more for each pair of neighbouring white keys passed."""
    return imaginary_rank(b) - imaginary_rank(a)


def distance_lattice_x(a, b, max_leap: int | None = 15, absolute: bool = False) -> Column:
    d = distance_imaginary(a, b)
    if max_leap is not None:
        d = F.greatest(F.least(d, F.lit(max_leap)), F.lit(-max_leap))
    return F.coalesce(F.abs(d) if absolute else d, F.lit(0))


def distance_lattice_y(a, b, absolute: bool = False) -> Column:
    """1 from white to black, -1 from black to white, else 0."""
    d = is_black(b).cast("int") - is_black(a).cast("int")
    return F.coalesce(F.abs(d) if absolute else d, F.lit(0))


def distance_integral(a, b, max_leap: int | None = 15, absolute: bool = False) -> Column:
    """Semitones, held within max_leap; 0 where a note is missing."""
    d = _col(b) - _col(a)
    if max_leap is not None:
        d = F.greatest(F.least(d, F.lit(max_leap)), F.lit(-max_leap))
    return F.coalesce(F.abs(d) if absolute else d, F.lit(0))


#: Rulers by name: Columns of two pitches.
RULERS = {"semitone": distance_semitone, "physical": distance_physical, "imaginary": distance_imaginary}


def midi_to_pitch_name(midi) -> Column:
    names = F.array(*[F.lit(n) for n in PITCH_NAMES])
    return F.concat(F.element_at(names, (pitch_class(midi) + 1).cast("int")), (F.floor(_col(midi) / 12) - 1).cast("string"))


def pitch_name_to_midi(name) -> Column:
    """From names like C#4 and Bb3; null for anything else."""
    part = lambda k: F.regexp_extract(_col(name), r"^([A-G])([#b]*)(-?\d+)$", k)
    steps = F.create_map(*[F.lit(x) for n, s in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11), strict=True) for x in (n, s)])
    marks = F.length(F.regexp_replace(part(2), "b", "")) - F.length(F.regexp_replace(part(2), "#", ""))
    return F.when(part(1) != "", F.try_element_at(steps, part(1)) + marks + 12 * (part(3).cast("int") + 1))
