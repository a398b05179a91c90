"""External induced sorting of the suffixes of a shard, with common-prefix values, to a bounded depth.

The shard's strings stand one after the other, parted by a symbol below all bytes, a still smaller one at the end. As in induced suffix
sorting, only suffixes at local minima (a smaller symbol after a larger one) are sorted outright: the
pieces between them are named in order, and the string of names is sorted by recursion on pairs of names,
until a name spans `depth` symbols. All other suffixes follow by induction: one ascending sweep places the
descending suffixes, one descending sweep the ascending ones. Tuples (suffix, common prefix with the one
before it in its bucket) wait in a priority queue by first symbol, first in first out within it; the queue
keeps its tail on disk beyond a memory limit. A tuple's common prefix is one more than the least common
prefix among the suffixes swept since the last tuple of its bucket, so no pair of suffixes is compared.

Beyond the limit the symbols are a mapped file too, and so are the suffixes that the first sweep has placed;
the second sweep's result is kept in such a queue and given bucket by bucket. What stays in memory is a byte
per symbol (which suffixes ascend) and the sort of the local minima, one key word at a time.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of queued tuples that one sweep keeps in memory.
QUEUE_BYTES = 2 << 20
#: Symbols that are looked at together.
RUN = 1 << 20


class BucketQueue:
    """A monotone priority queue: tuples (position, common prefix) by bucket, in order of arrival."""

    def __init__(self, buckets: int, memory: int = QUEUE_BYTES):
        self.parts: list[list] = [[] for _ in range(buckets)]  # of each bucket what is in memory
        self.spilled: list[list] = [[] for _ in range(buckets)]  # and before it (place, tuples) in the file
        self.held, self.memory = 0, memory
        self.file = None

    def push(self, bucket: int, position: np.ndarray, common: np.ndarray) -> None:
        self.held += position.nbytes + common.nbytes
        self.parts[bucket].append((position, common))
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """All that is in memory goes to the file, each bucket in one piece."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for b, got in enumerate(self.parts):
            if got:
                n = sum(len(g[0]) for g in got)
                self.file.writelines([*[g[0].tobytes() for g in got], *[g[1].tobytes() for g in got]])
                self.spilled[b].append((at, n))
                at += n * 9
                self.parts[b] = []
        self.held = 0

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a bucket that have arrived; they leave the queue."""
        got = []
        for at, n in self.spilled[bucket]:
            self.file.seek(at)
            data = self.file.read(n * 9)
            got.append((np.frombuffer(data, np.int64, n), np.frombuffer(data, np.uint8, n, n * 8)))
        for a, b in self.parts[bucket]:
            self.held -= a.nbytes + b.nbytes
            got.append((a, b))
        self.parts[bucket], self.spilled[bucket] = [], []
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.uint8)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def mapped(n: int, dtype: type, memory: int) -> np.ndarray:
    """An array of zeros: in memory if it fits the limit, else in a file of this task."""
    if n * np.dtype(dtype).itemsize <= memory:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,)).view(np.ndarray)  # a plain array on the map: its slices cost less


def _rising(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one, by the first symbol that differs; the last one counts as rising."""
    out = np.ones(len(t), bool)
    for z in range(len(t) - 1, 0, -RUN):
        a = max(z - RUN, 0)
        step = np.sign(t[a + 1 : z + 1].astype(np.int32) - t[a:z])
        turn = np.flatnonzero(step)
        following = np.searchsorted(turn, np.arange(z - a))
        inside = following < len(turn)
        out[a:z][inside] = step[turn[following[inside]]] > 0
        out[a:z][~inside] = out[z]
    return out


def _range_minimum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) of each range; ranges aren't empty."""
    table = [values]
    while len(table[-1]) > 1 and (1 << len(table)) <= int((hi - lo).max(initial=1)):
        t, step = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(t[:-step], t[step:]))
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k, t in enumerate(table):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << k)])
    return out


class _Sweep:
    """One direction of the induction."""

    def __init__(self, symbols: np.ndarray, wanted: np.ndarray, depth: int, memory: int, buckets: int):
        self.t, self.wanted, self.depth = symbols, wanted, depth
        self.queue = BucketQueue(buckets, memory)
        self.least = np.zeros(buckets, np.uint8)  # since the last tuple of each bucket

    def take(self, position: np.ndarray, common: np.ndarray) -> None:
        """Sweeps over suffixes in their order and queues those that they induce."""
        if not len(position):
            return
        before = position - 1
        at = np.flatnonzero((position > 0) & self.wanted[np.maximum(before, 0)])
        lowest = common.min()
        if not len(at):
            np.minimum(self.least, lowest, out=self.least)
            return
        bucket = self.t[before[at]]
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        first = np.append(True, bucket[1:] != bucket[:-1])
        lo = np.empty(len(at), np.int64)
        lo[1:] = at[:-1] + 1
        lo[first] = 0
        value = _range_minimum(common, lo, at + 1)
        heads = np.flatnonzero(first)
        value[heads] = np.minimum(value[heads], self.least[bucket[heads]])
        value = np.minimum(value.astype(np.int16) + 1, self.depth).astype(np.uint8)
        ends = np.append(heads[1:], len(at))
        tail = np.minimum.accumulate(common[::-1])[::-1]
        np.minimum(self.least, lowest, out=self.least)
        for a, z in zip(heads.tolist(), ends.tolist(), strict=True):
            self.queue.push(int(bucket[a]), before[at[a:z]], value[a:z])
            last = at[z - 1] + 1
            self.least[bucket[a]] = tail[last] if last < len(common) else self.depth


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to depth: by four symbols at a time, then by one."""
    out = np.zeros(len(a), np.uint8)
    alive, end, k = np.arange(len(a)), len(t) - 1, 0
    four = np.ndarray(max(len(t) - 3, 0), np.uint64, t, strides=(2,))
    while k + 4 <= depth and len(alive):
        x, y = a[alive] + k, b[alive] + k
        same = np.maximum(x, y) < len(four)
        same[same] = four[x[same]] == four[y[same]]
        stay = alive[~same]
        out[stay] = k + _differ(t, a[stay] + k, b[stay] + k, 4, end)
        alive, k = alive[same], k + 4
    out[alive] = k + _differ(t, a[alive] + k, b[alive] + k, depth - k, end)
    return out


def _differ(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, end: int) -> np.ndarray:
    """How many symbols from a and from b on are the same, up to `most`, one symbol after the other."""
    out = np.zeros(len(a), np.uint8)
    alive = np.arange(len(a))
    for k in range(most):
        x, y = a[alive] + k, b[alive] + k
        same = (np.maximum(x, y) <= end) & (t[np.minimum(x, end)] == t[np.minimum(y, end)])
        alive = alive[same]
        if not len(alive):
            break
        out[alive] += 1
    return out


def _ranked(names: np.ndarray, reach: int, span: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, by recursion on pairs `reach` apart until they span depth symbols."""
    if span >= depth or not len(names) or int(names.max()) + 1 == len(names):
        return names
    later = np.zeros(len(names), np.int64)
    later[:-reach] = names[reach:] + 1 if reach < len(names) else later[:-reach]
    _, pairs = np.unique(names * (int(names.max()) + 2) + later, return_inverse=True)
    return _ranked(pairs.astype(np.int64), reach * 2, span * 2, depth)


def _key_word(t: np.ndarray, rising: np.ndarray, minima: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """Symbols k to k + 3 of each piece as one number; of equal symbols a rising one is larger."""
    word = np.zeros(len(minima), np.uint64)
    for j in range(k, k + 4):
        at = np.minimum(minima + j, len(t) - 1)
        word = (word << np.uint64(16)) | np.where(j < length, t[at].astype(np.uint64) * np.uint64(2) + rising[at] + np.uint64(1), np.uint64(0))
    return word


def _named(t: np.ndarray, rising: np.ndarray, minima: np.ndarray, depth: int) -> np.ndarray:
    """The ranks of the pieces between local minima, equal ones alike, by one key word after the other from the last.

    A piece that ends before a word comes before all that have it, so only those are sorted by it; most end within the first.
    """
    following = np.append(minima[1:], len(t) - 1)
    length = np.minimum(following - minima + 1, depth + 2)
    words = range(0, int(length.max(initial=1)), 4)
    order = np.arange(len(minima))
    for k in reversed(words):
        has = length[order] > k
        own = order[has]
        order = np.concatenate([order[~has], own[np.argsort(_key_word(t, rising, minima[own], length[own], k), kind="stable")]])
    new = np.zeros(len(order), bool)
    for k in words:
        has = np.flatnonzero(length[order] > k)
        own = order[has]
        word = np.zeros(len(order), np.uint64)
        word[has] = _key_word(t, rising, minima[own], length[own], k)
        new[1:] |= word[1:] != word[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


def sorted_buckets(symbols: np.ndarray, depth: int = 50, memory: int = QUEUE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, common) of each first symbol in ascending order: all suffixes but the last in order of at least their first
    `depth` symbols, and each one's common prefix with the one before it in its bucket, up to depth.

    symbols: small positive integers, and a 0 at the end and nowhere else; strings are parted by 1.
    """
    t = np.ascontiguousarray(symbols, np.uint16)
    n = len(t)
    if n < 2:
        return
    buckets = int(t.max()) + 1
    rising = _rising(t)
    minima = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    seeds = minima[np.argsort(_ranked(_named(t, rising, minima, depth), 1, 2, depth + 2), kind="stable")]
    common = np.zeros(len(seeds), np.uint8)
    if len(seeds) > 1:
        common[1:] = _common(t, seeds[:-1], seeds[1:], depth)
    cut = np.searchsorted(t[seeds], np.arange(buckets + 1))

    one = lambda a, b: _common(t, np.array([a]), np.array([b]), depth)
    falling, done = BucketQueue(buckets, memory), BucketQueue(buckets, memory)
    up = _Sweep(t, ~rising, depth, memory, buckets)
    for c in range(buckets):
        own_last = None
        up.least[:] = 0
        p, v = up.queue.pop(c)
        while len(p):
            if own_last is None:
                v = v.copy()
                v[0] = 0
            falling.push(c, p, v)
            own_last = p[-1]
            up.take(p, v)
            p, v = up.queue.pop(c)
        s, v = seeds[cut[c] : cut[c + 1]], common[cut[c] : cut[c + 1]].copy()
        if len(s):
            v[:1] = one(own_last, s[0]) if own_last is not None else 0
            up.take(s, v)
    up.queue.close()

    down = _Sweep(t, rising, depth, memory, buckets)
    for c in range(buckets - 1, -1, -1):
        got = []
        down.least[:] = 0
        p, v = down.queue.pop(c)
        while len(p):
            if not got:
                v = v.copy()
                v[0] = 0
            got.append((p, v))
            down.take(p, v)
            p, v = down.queue.pop(c)
        sp = np.concatenate([g[0] for g in got]) if got else np.empty(0, np.int64)
        sv = np.concatenate([g[1] for g in got]) if got else np.empty(0, np.uint8)
        lp, lv = falling.pop(c)
        joint = one(lp[-1], sp[-1])[0] if len(lp) and len(sp) else np.uint8(0)
        if len(lp):
            back = np.empty(len(lp), np.uint8)
            back[0], back[1:] = joint, lv[1:][::-1]
            down.take(lp[::-1], back)
            done.push(c, lp, lv)
        if len(sp):
            done.push(c, np.ascontiguousarray(sp[::-1]), np.append(joint, sv[1:][::-1]).astype(np.uint8))
    down.queue.close()
    falling.close()
    for c in range(buckets):
        p, v = done.pop(c)
        if len(p):
            yield p, v
    done.close()


def sorted_suffixes(symbols: np.ndarray, depth: int = 50, memory: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """What sorted_buckets gives, in two arrays."""
    got = [(np.empty(0, np.int64), np.empty(0, np.uint8)), *sorted_buckets(symbols, depth, memory)]
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
