"""The k-best fold over the segments of an Arrow batch: all segments of like length go from note to note together.

Spark deals, joins and sorts the notes; this is the fold's arithmetic inside a task. Its state is the last two digits
(25 cells) with at most k paths each, of which only costs, an order and the way back are kept.
"""

from __future__ import annotations

#: Notes whose 125 costs are held at once, over 4 + k.
NOTES_AT_ONCE = 60_000
#: Steps after which the order numbers of paths (a digit more in base 5 at each step) are numbered anew.
RENUMBER = 18


def places(q):
    """Where each reach's array has the cost of place q of the 125 (a number, or a numpy array of them)."""
    a, b, c = q // 25, q // 5 % 5, q % 5
    return {"c_step": a * 5 + b, "c_skip": 25 * (b > 0) + a * 5 + c, "c_own": b, "c_digits": q, "c_whole": q, "m": q}


def _table(lists, weights=None):
    """An Arrow array of lists of one length as a numpy table; null entries, and all of a null list, are inf. Entries may be lists of each rule's cost, for weights."""
    import numpy as np
    import pyarrow as pa

    inner = lists.flatten()
    have = np.asarray(lists.is_valid().to_numpy(zero_copy_only=False))
    width = len(inner) // max(int(have.sum()), 1)
    out = np.full((len(lists), width), np.inf)
    if pa.types.is_list(inner.type):
        known = np.asarray(inner.is_valid().to_numpy(zero_copy_only=False))
        rules = inner.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(known.sum()), -1)
        flat = np.full(len(inner), np.inf)
        flat[known] = sum((rules[:, i] * w for i, w in enumerate(weights)), np.zeros(len(rules)))
    else:
        flat = inner.to_numpy(zero_copy_only=False).astype(float)
    out[have] = np.where(np.isnan(flat), np.inf, flat).reshape(-1, width)
    return out


def segments_of(column):
    """(lengths, the flattened values) of an Arrow list column; a null list has no notes."""
    import numpy as np

    lengths = np.diff(column.offsets.to_numpy())
    lengths[~np.asarray(column.is_valid().to_numpy(zero_copy_only=False))] = 0
    return lengths, column.flatten()


def total(parts: dict):
    """The 125 costs of each note, from the tables of each reach (one row serves all notes)."""
    import numpy as np

    at = places(np.arange(125))
    cost = None
    for name, table in parts.items():
        cost = table[:, at[name]] if cost is None else cost + table[:, at[name]]
    return cost


def tables_of(notes, constants=None, chunk=None, weights=None) -> dict:
    """The tables of each reach of an Arrow array of notes: structs of lists, or lists of 125 costs; constants: c_digits by segment, all alike."""
    import pyarrow as pa

    if not pa.types.is_struct(notes.type):
        return {"m": _table(notes)}
    weighed = lambda name: None if weights is None else weights[name]
    found = {f.name: _table(notes.field(i), weighed(f.name)) for i, f in enumerate(notes.type) if f.name.startswith("c_")}
    if constants is not None:
        found["c_digits"] = _table(constants.take(pa.array(chunk[:1])), weighed("c_digits"))
    return {name: found[name] for name in places(0) if name in found}


def in_chunks(lengths, k: int):
    """Indices of segments, the longest first, as many at a time as NOTES_AT_ONCE allows."""
    import numpy as np

    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return []
    ends = np.cumsum(lengths[order])
    return np.split(order, np.flatnonzero(np.diff(ends * (4 + k) // NOTES_AT_ONCE)) + 1)


def rows_of(chunk, lengths, starts):
    """The notes' places in the batch, segment by segment, and where each segment of the chunk begins among them."""
    import numpy as np

    own = lengths[chunk]
    begin = np.cumsum(own) - own
    return np.repeat(starts[chunk] - begin, own) + np.arange(own.sum()), begin


def k_best(m, begin, lengths, k: int):
    """Yields (first segment, costs, digits) of segments of one length: the k cheapest paths, ties by digits, inf where there are fewer.

    m: the notes' 125 costs, inf where not allowed; the segments' notes follow each other, the longest segments first.
    costs: segments x paths; digits: segments x paths x notes, from 0.
    """
    import numpy as np

    ending = {int(n): (int(at[0]), int(at[-1]) + 1) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}
    if 1 in ending:
        lo, hi = ending[1]
        costs = m[begin[lo:hi]][:, 0:25:5]
        order = np.argsort(costs, axis=1, kind="stable")[:, :k]
        yield lo, np.take_along_axis(costs, order, 1), order[:, :, None]
    active = int((lengths > 1).sum())
    cost = m[begin[:active]][:, :25].reshape(active, 25, 1)
    code = np.broadcast_to(np.arange(25)[None, :, None], cost.shape)
    back = [None]
    for t in range(1, int(lengths.max(initial=0))):
        layer = m[begin[:active] + t]
        if t + 1 in ending:  # the last note's own cost
            lo, hi = ending[t + 1]
            yield lo, *_ended((cost[lo:hi] + layer[lo:hi, ::5, None]), code[lo:hi], [b[lo:hi] if b is not None else None for b in back], k)
            active, layer, cost, code = lo, layer[:lo], cost[:lo], code[:lo]
        if not active:
            return
        cost, code, came = _step(cost, code, layer, k)
        back.append(came)
        if t % RENUMBER == 0:
            flat = code.reshape(active, -1)
            code = np.argsort(np.argsort(flat, axis=1, kind="stable"), axis=1, kind="stable").reshape(code.shape)


def _step(cost, code, layer, k: int):
    """The cells one note on: cost and code of their k best, and the digit and path they came by (digit * paths + path)."""
    import numpy as np

    count, _, had = cost.shape
    # paths that end in b, by the digit a before it: segments x b x (a, path), in the order of their digits
    g = cost.reshape(count, 5, 5, had).transpose(0, 2, 1, 3).reshape(count, 5, 5 * had)
    number = code.reshape(count, 5, 5, had).transpose(0, 2, 1, 3).reshape(count, 5, 5 * had)
    by_digits = np.argsort(number, axis=2, kind="stable")
    g, number = np.take_along_axis(g, by_digits, 2), np.take_along_axis(number, by_digits, 2)
    b = np.arange(5)[None, :, None]
    own = layer.reshape(count, 5, 5, 5)[np.arange(count)[:, None, None], by_digits // had, b]  # segments x b x (a, path) x c
    grown = (g[..., None] + own).transpose(0, 1, 3, 2)
    keep = min(k, 5 * had)
    if keep == 1:
        best = np.argmin(grown, axis=3)[..., None]  # the first of equal ones
    else:
        best = np.argsort(grown, axis=3, kind="stable")[..., :keep]
    new = np.take_along_axis(grown, best, 3).reshape(count, 25, keep)
    flat = best.reshape(count, 5, 5 * keep)
    came = np.take_along_axis(by_digits, flat, 2).reshape(count, 25, keep).astype(np.int16)
    after = np.take_along_axis(number, flat, 2).reshape(count, 25, keep) * 5 + (np.arange(25) % 5)[None, :, None]
    return new, after, came


def _ended(cost, code, back, k: int):
    import numpy as np

    count, _, had = cost.shape
    by_digits = np.argsort(code.reshape(count, -1), axis=1, kind="stable")
    costs = np.take_along_axis(cost.reshape(count, -1), by_digits, 1)
    best = np.argsort(costs, axis=1, kind="stable")[:, :k]
    at = np.take_along_axis(by_digits, best, 1)
    notes = len(back) + 1
    digits = np.empty((*at.shape, notes), dtype=np.uint8)
    cell, path = at // had, at % had
    digits[..., -1], digits[..., -2] = cell % 5, cell // 5
    each = np.arange(count)[:, None]
    for t in range(len(back) - 1, 0, -1):
        came = back[t][each, cell, path].astype(np.int64)
        before = back[t - 1].shape[2] if t > 1 else 1
        cell, path = came // before * 5 + cell // 5, came % before
        digits[..., t - 1] = cell // 5
    return np.take_along_axis(costs, best, 1), digits


def strings(digits):
    """Digits (rows x notes, from 0) as an Arrow array of strings."""
    import numpy as np
    import pyarrow as pa

    text = np.ascontiguousarray(digits.astype(np.uint8) + 49)
    return pa.array(text.view(f"S{text.shape[1]}").ravel(), pa.binary()).cast(pa.string())


def best_rows(column, constants, lone, k: int, ring: bool = False, weights: dict | None = None):
    """Yields (segments of the batch, ranks, digits, costs) as Arrow-ready arrays: the k cheapest of each segment, or one row of rank 0.

    lone: a digit for each segment of one note, at no cost; null elsewhere. ring: paths whose last digit is the first.
    """
    import numpy as np
    import pyarrow as pa

    lengths, notes = segments_of(column)
    starts = np.cumsum(lengths) - lengths
    lengths = lengths.copy()
    if lone is not None:
        given = np.flatnonzero(lone.is_valid().to_numpy(zero_copy_only=False))
        if len(given):
            lengths[given] = 0
            yield given, np.ones(len(given), np.int32), lone.take(pa.array(given)), np.zeros(len(given))
    else:
        given = np.zeros(0, np.int64)
    empty = np.setdiff1d(np.flatnonzero(lengths == 0), given)
    for chunk in in_chunks(lengths, k):
        at, begin = rows_of(chunk, lengths, starts)
        m = total(tables_of(notes.take(pa.array(at)), constants, chunk, weights))
        for lo, costs, digits in _ring(m, begin, lengths[chunk], k) if ring else k_best(m, begin, lengths[chunk], k):
            who, which = np.nonzero(np.isfinite(costs))
            if len(who):
                yield chunk[lo + who], (which + 1).astype(np.int32), strings(digits[who, which]), costs[who, which]
            none = np.flatnonzero(~np.isfinite(costs).any(axis=1))
            empty = np.concatenate([empty, chunk[lo + none]])
    if len(empty):
        yield empty, np.zeros(len(empty), np.int32), pa.nulls(len(empty), pa.string()), None


def _ring(m, begin, lengths, k: int):
    """`k_best` of the paths that end with the digit they begin with: each first digit apart, then together."""
    import numpy as np

    found = []
    for first in range(5):
        closed = m.copy().reshape(-1, 5, 5, 5)
        others = [d for d in range(5) if d != first]
        for at in (begin, begin + lengths - 1):
            closed[at[:, None], :, others] = np.inf
        found.append(list(k_best(closed.reshape(-1, 125), begin, lengths, k)))
    for same in zip(*found, strict=True):
        costs, digits = np.concatenate([x[1] for x in same], axis=1), np.concatenate([x[2] for x in same], axis=1)
        best = np.argsort(costs, axis=1, kind="stable")[:, :k]  # equal ones stay by their first digits, and by all digits within these
        yield same[0][0], np.take_along_axis(costs, best, 1), np.take_along_axis(digits, best[:, :, None], 1)


def reentries(gold, starts_column, constants, first):
    """Yields (segments of the batch, corrections, distance, playable): each segment's walk along its cheapest fingering, begun anew where gold differs.

    gold: each note's costs, `digit` (null agrees with any) and `far`, the distance of each finger to it. starts_column:
    each note's 25 costs as a first note. first: the finger of a lone note.
    """
    import numpy as np
    import pyarrow as pa

    lengths, notes = segments_of(gold)
    starts = np.cumsum(lengths) - lengths
    _, anew = segments_of(starts_column)
    lone = first.to_numpy(zero_copy_only=False)
    for chunk in in_chunks(lengths, 1):
        at, begin = rows_of(chunk, lengths, starts)
        own = notes.take(pa.array(at))
        m = total(tables_of(own, constants, chunk)).reshape(-1, 5, 5, 5)
        s = _table(anew.take(pa.array(at)).field("m")).reshape(-1, 5, 5)
        digit = own.field("digit").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        far = own.field("far").flatten().to_numpy(zero_copy_only=False).reshape(-1, 5).astype(np.int64)
        yield chunk, *_walk(m, s, digit, far, begin, lengths[chunk], lone[chunk].astype(np.int64) - 1)


def _walk(m, s, digit, far, begin, lengths, first):
    """(corrections, distance, playable) of segments, the longest first; digit 0: none given."""
    import numpy as np

    rest = np.full((len(m), 5, 5), np.inf)  # the least cost after a note, by its digit and the next one's
    longest = int(lengths.max(initial=0))
    for t in range(longest - 2, -1, -1):
        row = begin[: (lengths > t + 1).sum()] + t
        ends = lengths[: len(row)] == t + 2
        later = (m[row + 1] + rest[row + 1][:, None]).min(axis=3)
        rest[row] = np.where(ends[:, None, None], m[row + 1][..., 0], later)
    many = (lengths > 1).sum()
    whole = (s[begin[:many]] + rest[begin[:many]]).reshape(many, 25)
    tip = first.copy()  # -1: no fingering fits
    tip[:many] = np.where(np.isfinite(whole.min(axis=1, initial=np.inf)), whole.argmin(axis=1) // 5 if many else 0, -1)
    finger = np.zeros_like(tip)
    corrections, distance, ok = np.zeros_like(tip), np.zeros_like(tip), np.ones(len(tip), bool)
    for t in range(longest):
        active = int((lengths > t).sum())
        ok[:active] &= tip[:active] >= 0
        who = np.flatnonzero(tip[:active] >= 0)
        row, had = begin[who] + t, tip[who]
        now = np.where(digit[row] == 0, had, digit[row] - 1)
        hit = now == had
        corrections[who] += ~hit
        distance[who] += np.where(hit, 0, far[row, had])
        known = (now >= 0) & (now < 5)
        at = np.where(known, now, 0)
        before = np.where((hit & (t > 0))[:, None], m[row, finger[who], at], s[row, at])
        cost = np.where(known[:, None], before + rest[row, at], np.inf)
        tip[who] = np.where(np.isfinite(cost.min(axis=1, initial=np.inf)), cost.argmin(axis=1) if len(who) else 0, -1)
        finger[who] = at
    return corrections, distance, ok
