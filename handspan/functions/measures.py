"""Columns that compare two fingerings of a note, and the weights of ranked evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from handspan.functions.keys import is_white


def adjacent_long(one: Column, other: Column) -> Column:
    """The long fingers 2-3 and 3-4, either way round."""
    return (F.least(one, other).isin(2, 3)) & (F.abs(one - other) == 1)


def adjacent_on_white(one: Column, other: Column, midi: Column) -> Column:
    """Long neighbours anywhere, and 1-2 and 4-5 on white keys."""
    return adjacent_long(one, other) | (is_white(midi) & F.least(one, other).isin(1, 4) & (F.abs(one - other) == 1))


def delta_hamming(one, other, same_hand=None) -> Column:
    return F.when((one == other) & (F.lit(True) if same_hand is None else same_hand), 0.0).otherwise(1.0)


def _delta(one, other, near: Column, same_hand, eps: float) -> Column:
    same = F.lit(True) if same_hand is None else same_hand
    return F.when(~same, 1.0).when(one == other, 0.0).when(near, 1.0 - eps).otherwise(1.0)


def delta_adjacent_long(one, other, same_hand=None, eps: float = 0.5) -> Column:
    return _delta(one, other, adjacent_long(one, other), same_hand, eps)


def delta_black_white_adjacent(one, other, midi, same_hand=None, eps: float = 0.5) -> Column:
    return _delta(one, other, adjacent_on_white(one, other, midi), same_hand, eps)


def decay_none(n, i) -> Column:
    return F.lit(1.0)


def decay_uniform(n, i) -> Column:
    return (n - i + 1).cast("double")


def mu_power2(rho, n) -> Column:
    return F.pow(F.lit(2.0), rho)


def mu_plus1(rho, n) -> Column:
    return rho + 1.0


def mu_scale(rho, n) -> Column:
    return F.pow(1.0 + 1.0 / n, rho)


def phi_inverse(rank) -> Column:
    return 1.0 / rank


DELTAS: dict[str, Callable] = {"hmg": lambda a, b, m, s: delta_hamming(a, b, s), "al": lambda a, b, m, s: delta_adjacent_long(a, b, s), "bwa": lambda a, b, m, s: delta_black_white_adjacent(a, b, m, s)}
DECAYS: dict[str, Callable] = {"none": decay_none, "uniform": decay_uniform}
MUS: dict[str, Callable] = {"power2": mu_power2, "plus1": mu_plus1, "scale": mu_scale}
