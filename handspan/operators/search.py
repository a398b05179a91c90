"""Search for the cheapest fingerings: candidate costs per note, and a k-best fold over each segment.

One note has 125 candidates, the digits of itself and its neighbours. Their costs are plain generated code on
exploded rows; the fold over a segment's notes is one higher-order expression whose state is 25 cells (the last
two digits) of at most k paths. Both need only the partitioning by key, so a job has one exchange.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from handspan.functions.dims import PRESETS, edit_distance, span
from handspan.functions.keys import RULERS, is_between
from handspan.functions.rules import RULES, Trigram, preset_costs
from handspan.operators.paths import best_rows, in_chunks, places, reentries, rows_of, segments_of, tables_of, total
from handspan.operators.sequence import KEY, by_note
from handspan.plans.lineage import cut_lineage, workers_find_library


def with_trigrams(fingered: DataFrame, *, hand: str = "hand", digit: str = "digit", keys=KEY) -> DataFrame:
    """Adds m1 m2 m3, h1 h2 h3, d1 d2 d3: a note with its neighbours, null past the ends."""
    w = by_note(keys)
    new = {}
    for name, c in (("m", "midi"), ("h", hand), ("d", digit)):
        new |= {f"{name}1": F.lag(c).over(w), f"{name}2": F.col(c), f"{name}3": F.lead(c).over(w)}
    return fingered.withColumns(new)


def _measured(trigrams: DataFrame, table: str, ruler: str) -> tuple[DataFrame, Trigram]:
    """(trigrams with their distances as columns _step and _skip, the trigram of these columns); so rules don't measure anew."""
    c = lambda x: [F.col(f"{x}{k}") for k in (1, 2, 3)]
    measure = RULERS[ruler]
    with_distances = trigrams.withColumns({"_step": measure(F.col("m1"), F.col("m2")), "_skip": measure(F.col("m1"), F.col("m3"))})
    return with_distances, Trigram(c("m"), c("h"), c("d"), table, ruler, F.col("_step"), F.col("_skip"))


def trigram_cost(trigrams: DataFrame, preset: str = "parncutt", weights: dict[str, float] | None = None) -> DataFrame:
    """Adds cost and detail, a map of the weighted costs of the preset's rules."""
    _, table, ruler, _ = PRESETS[preset]
    measured, t = _measured(trigrams, table, ruler)
    costs = preset_costs(t, preset, weights)
    return measured.withColumns({"cost": sum(costs.values(), F.lit(0.0)), "detail": F.create_map(*[x for tag, c in costs.items() for x in (F.lit(tag), c)])}).drop("_step", "_skip")


def rule_costs(trigrams: DataFrame, tags: Iterable[str], *, table: str = "parncutt", ruler: str = "semitone") -> DataFrame:
    """Adds a column r_<tag> for each rule, unweighted."""
    from handspan.functions.rules import RULES

    measured, t = _measured(trigrams, table, ruler)
    return measured.withColumns({f"r_{tag}": RULES[tag](t) for tag in tags}).drop("_step", "_skip")


def segment_cost(fingered: DataFrame, preset: str = "parncutt", *, keys=KEY, **options) -> DataFrame:
    """(keys, notes, cost) of given fingerings; segments of fewer than three notes aren't costed."""
    costed = trigram_cost(with_trigrams(fingered, keys=keys, **options), preset)
    return costed.groupBy(*keys).agg(F.count("*").alias("notes"), F.sum("cost").alias("cost")).where("notes >= 3")


def transition_allowed(m_a: Column, d_a: Column, m_b: Column, d_b: Column, hand: Column, table: str, mode: str = "max") -> Column:
    """A repeated pitch keeps its finger and another pitch changes it; mode none, max (up to the largest span), min or both. True past the ends."""
    apart = m_b - m_a
    if mode == "none":
        fits = F.lit(True)
    else:
        over, under = apart <= span(table, "max_prac", hand, d_a, d_b), apart >= span(table, "min_prac", hand, d_a, d_b)
        fits = {"max": over, "min": under, "both": over & under}[mode]
    return F.when(apart.isNull(), True).when(apart == 0, d_a == d_b).otherwise((d_a != d_b) & fits)


def candidates(notes: DataFrame, *, table: str = "parncutt", mode: str = "max", first: int | Column | None = None, last: int | Column | None = None, hand: str = "hand", keys=KEY) -> DataFrame:
    """125 rows for each note (q from 0: d1, d2, d3 less one, in base 5) with `allowed`; first and last fix the digits of the end notes (a null Column value doesn't)."""
    w = by_note(keys)
    n = notes.withColumns({"m1": F.lag("midi").over(w), "m2": F.col("midi"), "m3": F.lead("midi").over(w), "h2": F.col(hand)})
    n = n.withColumns({"h1": F.when(F.col("m1").isNotNull(), F.col(hand)), "h3": F.when(F.col("m3").isNotNull(), F.col(hand))})
    n = n.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(124))))
    n = n.withColumns({"d1": F.floor(F.col("q") / 25).cast("int") + 1, "d2": F.floor(F.col("q") / 5).cast("int") % 5 + 1, "d3": F.col("q") % 5 + 1})
    ok = transition_allowed(F.col("m1"), F.col("d1"), F.col("m2"), F.col("d2"), F.col(hand), table, mode) & transition_allowed(F.col("m2"), F.col("d2"), F.col("m3"), F.col("d3"), F.col(hand), table, mode)
    if first is not None:
        ok &= F.col("m1").isNotNull() | F.coalesce(F.col("d2") == first, F.lit(True))
    if last is not None:
        ok &= F.col("m3").isNotNull() | F.coalesce(F.col("d2") == last, F.lit(True))
    return n.withColumn("allowed", ok)


def playable(candidate_rows: DataFrame) -> DataFrame:
    """The candidates that are allowed, and one row more of each note, so that no note is lost."""
    return candidate_rows.where("allowed or q = 0")


def layers(costed: DataFrame, *, width: int = 125, keys=KEY) -> DataFrame:
    """(keys, n, first_midi, layers): each segment's notes in order as arrays of `width` costs, null where not allowed or not given. Needs q, cost, allowed.

    A segment with a note that nothing is allowed for has no layers, as no path passes it.
    """
    some = F.sort_array(F.collect_list(F.when(F.col("allowed"), F.struct("q", F.col("cost").cast("double").alias("cost")))))
    per = costed.groupBy(*keys, "note_idx").agg(F.first("midi").alias("midi"), some.alias("_some"))
    spread = F.get(F.transform(F.array(F.map_from_entries("_some")), lambda m: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda q: F.try_element_at(m, q))), F.lit(0))
    per = per.withColumn("m", F.when(F.size("_some") == width, F.transform("_some", lambda s: s["cost"])).when(F.size("_some") > 0, spread))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("note_idx", "m"))), lambda s: s["m"])
    return per.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("midi", "note_idx").alias("first_midi"), F.when(F.count("m") == F.count("*"), whole).alias("layers"))


#: What a rule looks at: `own` the digit of the note and the colours of the three, `step` the first two notes, `skip` the first
#: and the last note, whether the second is a thumb and lies between, `digits` no pitch. Other rules look at the whole trigram.
REACH = dict.fromkeys(("wea", "weaj", "bl1", "bl5"), "own") | dict.fromkeys(("345", "aprb"), "digits")
REACH |= dict.fromkeys(("str", "sma", "smal", "smaw", "lar", "larl", "larj", "3t4", "bl4", "pa1", "pa1w", "b1pb", "b1wb", "wb1b", "impw", "nrfw"), "step")
REACH |= dict.fromkeys(("pcc", "pcs", "pchw", "pcow", "rfrw", "afcb"), "skip")
#: Classes of a reach that may be broadcast, at most 125 costs of each; more are joined.
HELD_CLASSES = 40_000
#: The longest list that a fold of whole paths keeps.
MOST_BEST = 200
_NONE = -1_000_000


def neighbours(notes: DataFrame, hand: str = "hand", keys=KEY) -> DataFrame:
    """Adds m1 m2 m3 and h2: a note's pitch with its neighbours', null past the ends, and its hand."""
    w = by_note(keys)
    return notes.withColumns({"m1": F.lag("midi").over(w), "m2": F.col("midi"), "m3": F.lead("midi").over(w), "h2": F.col(hand)})


def _reach(reach: str, table: str, ruler: str):
    """(keys of its classes, digits of a place, number of places, trigram) of a reach; a class's keys are its columns k0, k1, .."""
    m1, m2, m3, h = F.col("m1"), F.col("m2"), F.col("m3"), F.col("h2")
    k, q, none = [F.col(f"k{i}") for i in range(4)], F.col("q"), F.lit(None)
    place = lambda by, count: F.floor(q / by).cast("int") % count + 1
    shown = lambda hand, *notes: [F.when(n.isNotNull(), hand) for n in notes]
    number, nothing = none.cast("int"), none.cast("string")
    if reach == "own":
        return [m1 % 12, m2 % 12, m3 % 12, h], 5, Trigram(k[:3], shown(k[3], *k[:3]), [number, place(1, 5), number], table, ruler)
    if reach == "step":
        return [m1, m2, h], 25, Trigram([k[0], k[1], number], [*shown(k[2], k[0]), k[2], nothing], [place(5, 5), place(1, 5), number], table, ruler)
    if reach == "skip":
        between = is_between(m2, m1, m3)
        middle = F.when(k[3], k[0] + F.signum(k[1] - k[0]).cast("int")).otherwise(k[0])
        return [m1, m3, h, between], 50, Trigram([k[0], middle, k[1]], [*shown(k[2], k[0]), k[2], *shown(k[2], k[1])], [place(5, 5), F.floor(q / 25).cast("int") + 1, place(1, 5)], table, ruler)
    if reach == "digits":
        return [], 125, Trigram([F.lit(60), F.lit(60), F.lit(60)], [F.lit(">")] * 3, [place(25, 5), place(5, 5), place(1, 5)], table, ruler)
    return [m1, m2, m3, h], 125, Trigram(k[:3], [*shown(k[3], k[0]), k[3], *shown(k[3], k[2])], [place(25, 5), place(5, 5), place(1, 5)], table, ruler)


def cost_classes(neighboured: DataFrame, reach: str, tags, weights: dict[str, float], table: str, ruler: str, mode: str | None = None, apart: bool = False) -> tuple[DataFrame, list[Column]]:
    """(a table with a row for each class of the notes: k0, k1, .., costs; the notes' keys): the costs of one reach at each place.

    costs sums the weighted rules; if apart, it has an array for each rule, unweighted. With a mode, a step that isn't
    allowed has no cost. Keys that are null stand as _NONE, so that classes are joined by equality.
    """
    keys, places, t = _reach(reach, table, ruler)
    found = neighboured.select(*[c.alias(f"k{i}") for i, c in enumerate(keys)]).distinct() if keys else neighboured.sparkSession.range(1).select()
    rows = found.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    each = [RULES[tag](t).cast("double") for tag in tags]
    cost = F.array(*each) if apart else sum((c * F.lit(float(weights.get(tag, 1.0))) for tag, c in zip(tags, each, strict=True)), F.lit(0.0))
    if mode is not None:
        k0, k1, h = F.col("k0"), F.col("k1"), F.col("k2")
        cost = F.when(transition_allowed(k0, t.d1, k1, t.d2, h, table, mode), cost)
    names = [f"k{i}" for i in range(len(keys))]
    got = rows.withColumn("c", cost).groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "c"))), lambda s: s["c"]).alias("costs"))
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(str(_NONE)))
    return got.select(*[plain(F.col(n)).alias(n) for n in names], "costs"), [plain(c) for c in keys]


def with_cost_arrays(neighboured: DataFrame, preset: str, weights: dict[str, float] | None = None, *, mode: str | None = "max", apart: bool = False) -> DataFrame:
    """Adds c_step, c_skip, c_own, c_digits, c_whole (where the preset has such rules): each note's costs from tables of the distinct classes.

    Notes are many and classes few: what a rule looks at is computed once for each class (at most 129 * 129 steps of
    each hand, whatever the number of notes) and joined.
    """
    tags, table, ruler, own = PRESETS[preset]
    weights = own | (weights or {})
    out = neighboured
    for reach in ("step", "skip", "own", "digits", "whole"):
        rules = [tag for tag in tags if REACH.get(tag, "whole") == reach]
        if not rules and reach != "step":
            continue
        classes, keys = cost_classes(neighboured, reach, rules, weights, table, ruler, mode if reach == "step" else None, apart)
        out = with_classes(out, classes, keys, f"c_{reach}")
    return out


def with_classes(notes: DataFrame, classes: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Adds the classes' costs (k0, k1, .., costs) as `name`, by the notes' keys; a table without keys has one row, for all notes."""
    if not keys:
        return notes.crossJoin(F.broadcast(classes.select(F.col("costs").alias(name))))
    classes = cut_lineage(classes)
    named = classes.select(*[F.col(f"k{i}").alias(f"_of{i}") for i in range(len(keys))], F.col("costs").alias(name))
    named = F.broadcast(named) if classes.count() <= HELD_CLASSES else named
    out = notes.withColumns({f"_on{i}": c for i, c in enumerate(keys)})
    return out.join(named, [F.col(f"_on{i}") == F.col(f"_of{i}") for i in range(len(keys))], "left").drop(*[f"_of{i}" for i in range(len(keys))], *[f"_on{i}" for i in range(len(keys))])


def gathered_costs(costed: DataFrame, keys=KEY) -> DataFrame:
    """(keys, n, first_midi, notes, c_digits if any): each segment's notes in order with the cost arrays of their reaches."""
    each = [c for c in ("c_step", "c_skip", "c_own", "c_whole") if c in costed.columns]
    constant = [F.first("c_digits").alias("c_digits")] if "c_digits" in costed.columns else []
    return costed.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("midi", "note_idx").alias("first_midi"), F.sort_array(F.collect_list(F.struct("note_idx", *each))).alias("notes"), *constant)


def _composed(have: set[str], count: int = 125) -> Column:
    """The costs of a note (125, or the first of them) from its columns c_step, c_skip, ..

    Generated code: a lambda would be interpreted at each place. It is SQL text, as some thousand Columns take seconds to make.
    """
    return F.expr(f"array({', '.join(' + '.join(f'get({name}, {i})' for name, i in places(q).items() if name in have) for q in range(count))})")


def class_costs(notes: DataFrame, preset: str, weights: dict[str, float] | None = None, *, mode: str = "max", first: int | None = None, last: int | None = None, hand: str = "hand", keys=KEY) -> DataFrame:
    """(keys, n, first_midi, notes, ..): each segment's costs by reach, as `gathered_costs`; first and last fix the digits of the end notes."""
    costed = with_cost_arrays(cut_lineage(neighbours(notes, hand, keys)), preset, weights, mode=mode)
    if first is not None or last is not None:  # a note whose digit is fixed has no steps to others
        kept = lambda b: F.lit(True) if first is None else F.col("m1").isNotNull() | F.lit(b == first)
        left = lambda b: F.lit(True) if last is None else F.col("m3").isNotNull() | F.lit(b == last)
        steps = F.array(*[F.when(kept(q % 5 + 1) & left(q % 5 + 1), F.get("c_step", F.lit(q))) for q in range(25)])
        costed = costed.withColumn("c_step", steps)
    return gathered_costs(costed, keys)


def class_layers(notes: DataFrame, preset: str, weights: dict[str, float] | None = None, *, mode: str = "max", hand: str = "hand", keys=KEY) -> DataFrame:
    """(keys, n, first_midi, layers) as `layers` gives them, by tables of classes: no row for each candidate, and one collect."""
    costed = with_cost_arrays(cut_lineage(neighbours(notes, hand, keys)), preset, weights, mode=mode)
    have = {c for c in costed.columns if c.startswith("c_")}
    per = costed.select(*keys, "note_idx", "midi", _composed(have).alias("m"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("note_idx", "m"))), lambda s: s["m"])
    return per.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("midi", "note_idx").alias("first_midi"), whole.alias("layers"))


def k_best_paths(layered: DataFrame, k: int, *, keys=KEY) -> DataFrame:
    """(keys, rank, digits, cost): the k cheapest digit strings of each segment; ties in order of the digits.

    A segment without any allowed path (an infinite cost allows none) has one row of rank 0, without digits or cost.
    The state of the fold is 25 * k paths; beyond MOST_BEST the same rows come from `deep_paths`.
    """
    if k > MOST_BEST:
        return deep_paths(layered, k, keys=keys)
    return _best_of(layered.withColumnRenamed("layers", "notes"), k, keys)


def _best_of(gathered: DataFrame, k: int, keys, lone: Column | None = None, ring: bool = False) -> DataFrame:
    """(keys, rank, digits, cost) of segments whose `notes` (and `c_digits`, if any) have the costs; the fold works on Arrow batches.

    lone: the digit of a segment of one note, null for others. ring: only paths that end with their first digit.
    """
    import pyarrow as pa

    kinds = [f"`{c}` {t}" for c, t in gathered.dtypes if c in keys]
    constant = "c_digits" in gathered.columns
    rows = gathered.select(*keys, "notes", *(["c_digits"] if constant else []), *([lone.cast("string").alias("_lone")] if lone is not None else []))
    workers_find_library(gathered.sparkSession)
    count, with_lone = len(keys), lone is not None

    def work(batches):
        for b in batches:
            for who, ranks, digits, costs in best_rows(b.column(count), b.column(count + 1) if constant else None, b.columns[-1] if with_lone else None, k, ring):
                own = [b.column(j).take(pa.array(who)) for j in range(count)]
                costs = pa.nulls(len(who), pa.float64()) if costs is None else pa.array(costs, pa.float64())
                yield pa.RecordBatch.from_arrays([*own, pa.array(ranks, pa.int32()), digits, costs], names=[*keys, "rank", "digits", "cost"])

    return rows.mapInArrow(work, ", ".join([*kinds, "rank int", "digits string", "cost double"]))


def _layer_arrays(column, constants=None) -> list:
    """The layers of each row of an Arrow list column: a numpy table (notes x 5 x 5 x 5) with inf where nothing is allowed, None for no notes."""
    import pyarrow as pa

    out: list = [None] * len(column)
    lengths, notes = segments_of(column)
    starts = lengths.cumsum() - lengths
    for chunk in in_chunks(lengths, 1):
        at, begin = rows_of(chunk, lengths, starts)
        m = total(tables_of(notes.take(pa.array(at)), constants, chunk))
        for i, lo in zip(chunk, begin, strict=True):
            out[i] = m[lo : lo + lengths[i]].reshape(-1, 5, 5, 5)
    return out


def _costs(layered: DataFrame) -> list[str]:
    """The columns of a table that hold its costs."""
    return ["layers"] if "layers" in layered.columns else [c for c in ("notes", "c_digits") if c in layered.columns]


def _to_come(m) -> list:
    """For each note, the least cost still to come after it and its follower have their digits (5 x 5)."""
    rest = [m[-1][:, :, 0]]  # the last note's own cost, by the digits of the two last notes
    for layer in m[-2:0:-1]:
        rest.append((layer + rest[-1][None, :, :]).min(axis=2))
    return rest[::-1]


def _paths_in_order(m):
    """(cost, digits) of every allowed path, the cheapest first, ties by digits: one at a time, as long as they are asked for.

    Each entry of the queue is a beginning of a path with the least cost that it can end with. One that is taken leaves
    two: its own best continuation, and the next best beginning in its place. So the queue grows by one an entry, not by
    the paths there are.
    """
    import heapq

    import numpy as np

    if len(m) == 1:
        costs = sorted((float(m[0][0, d, 0]), str(d + 1)) for d in range(5) if np.isfinite(m[0][0, d, 0]))
        yield from costs
        return
    rest = _to_come(m)
    head = [(float(m[0][0, a, b] + rest[0][a, b]), f"{a + 1}{b + 1}", float(m[0][0, a, b])) for a in range(5) for b in range(5)]
    head = sorted(x for x in head if x[0] < np.inf)
    queue = [(*head[0], head, 0)] if head else []
    number = 0
    while queue:
        total, digits, cost, among, i = heapq.heappop(queue)[:5]
        if i + 1 < len(among):
            heapq.heappush(queue, (*among[i + 1], among, i + 1))
        at = len(digits) - 1
        if at == len(m) - 1:
            yield total, digits
            number += 1
            continue
        a, b = int(digits[-2]) - 1, int(digits[-1]) - 1
        more = [(cost + float(m[at][a, b, c]), c) for c in range(5)]
        after = rest[at] if at < len(m) - 1 else None
        more = sorted((g + float(after[b, c]), f"{digits}{c + 1}", g) for g, c in more if np.isfinite(g) and np.isfinite(after[b, c]))
        if more:
            heapq.heappush(queue, (*more[0], more, 0))


def deep_paths(layered: DataFrame, k: int, *, keys=KEY) -> DataFrame:
    """(keys, rank, digits, cost): the k cheapest digit strings of each segment, for any k, as `k_best_paths` ranks them.

    The least cost still to come is known for every note and pair of digits, so beginnings are taken in the order of the
    paths they lead to (`_paths_in_order`) and rows go out as they are found; memory grows with the paths taken of one
    segment at a time. A segment without any allowed path has one row of rank 0.
    """
    import pyarrow as pa

    kinds = [f"`{c}` {t}" for c, t in layered.dtypes if c in keys]
    held = _costs(layered)
    rows = layered.select(*keys, *held)
    workers_find_library(layered.sparkSession)

    def work(batches):
        from itertools import islice

        for b in batches:
            for i, m in enumerate(_layer_arrays(*b.columns[-len(held) :])):
                paths = iter(_paths_in_order(m)) if m is not None else iter(())
                rank = 0
                while chunk := list(islice(paths, min(k - rank, 10_000))):
                    yield found(b, i, [rank + 1 + x for x in range(len(chunk))], [x[1] for x in chunk], [x[0] for x in chunk])
                    rank += len(chunk)
                if not rank:
                    yield found(b, i, [0], [None], [None])

    def found(b, i, ranks, digits, costs):
        own = [b.column(j).take(pa.array([i] * len(ranks))) for j in range(len(keys))]
        return pa.RecordBatch.from_arrays([*own, pa.array(ranks, pa.int32()), pa.array(digits, pa.string()), pa.array(costs, pa.float64())], names=[*keys, "rank", "digits", "cost"])

    return rows.mapInArrow(work, ", ".join([*kinds, "rank int", "digits string", "cost double"]))


def recall_paths(layered: DataFrame, gold: DataFrame, *, keys=KEY) -> DataFrame:
    """(keys, rank, digits, cost, is_gold): the paths of each segment in order, until all of its gold strings that can be played have come.

    One search a segment: it goes on from where it is, whatever depth that takes. gold: keys, digits; segments without
    playable gold have no rows.
    """
    import pyarrow as pa

    kinds = [f"`{c}` {t}" for c, t in layered.dtypes if c in keys]
    wanted = gold.groupBy(*keys).agg(F.collect_set("digits").alias("_wanted"))
    held = _costs(layered)
    rows = layered.join(wanted, list(keys)).select(*keys, "_wanted", *held)
    workers_find_library(layered.sparkSession)

    def work(batches):
        for b in batches:
            for i, (m, strings) in enumerate(zip(_layer_arrays(*b.columns[-len(held) :]), b.column(len(keys)).to_pylist(), strict=True)):
                left = {s for s in strings if _rank_cost(m, s) is not None}
                rank, found = 0, []
                for cost, digits in _paths_in_order(m) if left else ():
                    rank += 1
                    hit = digits in left
                    left.discard(digits)
                    found.append((rank, digits, cost, hit))
                    if len(found) == 10_000 or not left:
                        own = [b.column(j).take(pa.array([i] * len(found))) for j in range(len(keys))]
                        ranks, texts, costs, hits = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([*own, pa.array(ranks, pa.int32()), pa.array(texts), pa.array(costs, pa.float64()), pa.array(hits)], names=[*keys, "rank", "digits", "cost", "is_gold"])
                        found = []
                    if not left:
                        break

    return rows.mapInArrow(work, ", ".join([*kinds, "rank int", "digits string", "cost double", "is_gold boolean"]))


def _rank_cost(m, digits: str | None) -> float | None:
    """What a digit string costs; None if it can't be played or hasn't one digit for each note."""
    import numpy as np

    if m is None or digits is None or len(digits) != len(m) or not set(digits) <= set("12345"):
        return None
    d = [int(c) - 1 for c in digits]
    cost = float(m[0][0, d[0], d[1] if len(d) > 1 else 0])
    for i in range(1, len(m)):
        cost += float(m[i][d[i - 1], d[i], d[i + 1] if i + 1 < len(m) else 0])
    return cost if np.isfinite(cost) else None


def gold_rank(layered: DataFrame, gold: DataFrame, *, keys=KEY) -> DataFrame:
    """(keys, digits, cost, rank): the rank that each given digit string has among all allowed paths of its segment, however deep.

    Nothing is listed: paths are counted, by their cost and by how they compare with the given one, from note to note. rank
    is a string of digits, as it passes 64 bits; cost and rank are null where the string can't be played or has not one
    digit for each note. gold: keys, digits.
    """
    import pyarrow as pa

    kinds = [f"`{c}` {t}" for c, t in layered.dtypes if c in keys]
    held = _costs(layered)
    rows = layered.join(gold, list(keys)).select(*keys, "digits", *held)
    workers_find_library(layered.sparkSession)

    def work(batches):
        for b in batches:
            got = [_rank_of(m, d) for m, d in zip(_layer_arrays(*b.columns[-len(held) :]), b.column(len(keys)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys) + 1], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.string())], names=[*keys, "digits", "cost", "rank"])

    return rows.mapInArrow(work, ", ".join([*kinds, "digits string", "cost double", "rank string"]))


def _rank_of(m, digits: str | None) -> tuple[float | None, str | None]:
    from collections import Counter

    import numpy as np

    own = _rank_cost(m, digits)
    if own is None:
        return None, None
    d = [int(c) - 1 for c in digits]
    if len(m) == 1:
        costs = [(float(m[0][0, x, 0]), x) for x in range(5)]
        return own, str(sum(c < (own, d[0]) for c in costs) + 1)
    order = lambda x, y: (x > y) - (x < y)
    rest = _to_come(m)
    cells: dict[tuple[int, int, int], Counter] = {}
    for a in range(5):
        for b in range(5):
            if np.isfinite(m[0][0, a, b]):
                cells[a, b, order((a, b), (d[0], d[1]))] = Counter({float(m[0][0, a, b]): 1})
    for i in range(1, len(m)):
        last = i == len(m) - 1
        following: dict[tuple[int, int, int], Counter] = {}
        for (a, b, sign), counts in cells.items():
            for c in range(1 if last else 5):
                g = float(m[i][a, b, c])
                if not np.isfinite(g):
                    continue
                least = 0.0 if last else float(rest[i][b, c])
                key = (b, c, sign) if last else (b, c, sign or order(c, d[i + 1]))
                held = following.setdefault(key, Counter())
                for cost, n in counts.items():
                    if cost + g + least <= own:  # what must end beyond it is behind it
                        held[cost + g] += n
        cells = following
    before = sum(n for (_, _, sign), counts in cells.items() for cost, n in counts.items() if cost < own or cost == own and sign < 0)
    return own, str(before + 1)


def _with_lone(gathered: DataFrame, k: int, given: int | None = None, *, keys=KEY) -> DataFrame:
    """The k best paths, but a lone note has one: the given digit, else the second finger on black and the thumb on white, at no cost."""
    from handspan.functions.fingering import one_note_advice

    lone, digit = F.col("n") == 1, one_note_advice("first_midi", F.lit(given)).cast("string")
    if k > MOST_BEST:
        return deep_paths(gathered.where(~lone), k, keys=keys).unionAll(gathered.where(lone).select(*keys, F.lit(1), digit, F.lit(0.0)))
    return _best_of(gathered, k, keys, F.when(lone, digit))


def fingering_count(notes: DataFrame, *, table: str = "parncutt", mode: str = "none", hand: str = "hand", keys=KEY) -> DataFrame:
    """(keys, paths): complete allowed fingerings of each segment, by the same fold over counts; a double, as they grow beyond any whole number."""
    c = candidates(notes, table=table, mode=mode, hand=hand, keys=keys).where("d1 = 1 or m1 is not null").withColumn("cost", F.lit(1.0))
    ok = transition_allowed(F.col("m1"), F.col("d1"), F.col("m2"), F.col("d2"), F.col(hand), table, mode)
    steps = c.where("d3 = 1").withColumn("ok", ok.cast("double"))
    per = steps.groupBy(*keys, "note_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "ok"))), lambda s: s["ok"]).alias("m"))
    seq = per.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("note_idx", "m"))), lambda s: s["m"]).alias("ms"))
    five = F.sequence(F.lit(0), F.lit(4))
    add = lambda x, y: x + y
    step = lambda acc, m: F.transform(five, lambda b: F.aggregate(F.transform(five, lambda a: F.get(acc, a) * F.get(m, a * 5 + b)), F.lit(0.0), add))
    rest = F.slice("ms", F.lit(2), F.size("ms"))
    return seq.select(*keys, F.aggregate(rest, F.expr("array_repeat(1D, 5)"), step, lambda acc: F.aggregate(acc, F.lit(0.0), add)).alias("paths"))


def advise(notes: DataFrame, preset: str = "parncutt", k: int = 5, *, mode: str = "max", first: int | None = None, last: int | None = None, weights: dict[str, float] | None = None, unplayable: str = "row", hand: str = "hand", keys=KEY) -> DataFrame:
    """(keys, rank, digits, cost): the k cheapest fingerings of each segment under a preset.

    A lone note has one: the given digit, else the second finger on black and the thumb on white, at no cost. A segment
    that no fingering fits has one row of rank 0 without digits or cost (unplayable="row"), or fails the job ("error").
    """
    costs = class_costs(notes, preset, weights, mode=mode, first=first, last=last, hand=hand, keys=keys)
    best = _with_lone(costs, k, first if first is not None else last, keys=keys)
    if unplayable == "error":
        where = F.concat_ws(", ", *[F.col(c).cast("string") for c in keys])
        best = best.withColumn("rank", F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("no fingering for "), where)).cast("int")))
    return best


def suggestion_details(suggestions: DataFrame, notes: DataFrame, preset: str = "parncutt", weights: dict[str, float] | None = None, *, hand: str = "hand", keys=KEY) -> DataFrame:
    """(keys, rank, note_idx, digit, cost, detail): what each rule adds to each note of a suggestion, as a map; suggestions without digits have no rows."""
    w = by_note(keys)
    own = notes.select(*keys, "note_idx", "midi", F.col(hand).alias("hand"), (F.row_number().over(w) - 1).alias("pos"))
    tips = explode_digits(suggestions, keys=keys).withColumnRenamed("tip", "digit").join(own, [*keys, "pos"])
    costed = trigram_cost(with_trigrams(tips, keys=(*keys, "rank")), preset, weights)
    return costed.select(*keys, "rank", "note_idx", "digit", "cost", "detail")


def advise_cyclic(notes: DataFrame, preset: str = "parncutt", k: int = 5, *, mode: str = "max", weights: dict[str, float] | None = None, hand: str = "hand", keys=KEY) -> DataFrame:
    """The k cheapest fingerings that can be played over and over: the first note is set at the end again, with its finger.

    One search: the fold keeps the first fingers apart. A segment that no such fingering fits has a row of rank 0.
    """
    w = by_note(keys)
    own = F.struct(*[F.col(c) for c in notes.columns])
    again = F.first(own).over(w).withField("note_idx", (F.col("note_idx") + 1).cast(notes.schema["note_idx"].dataType))
    ends = notes.select(own.alias("_own"), F.when(F.lead("note_idx").over(w).isNull(), again).alias("_again"))
    both = ends.select(F.explode(F.array_compact(F.array("_own", "_again"))).alias("_note"))
    ring = both.select(*[F.col("_note")[c].alias(c) for c in notes.columns])
    return _best_of(class_costs(ring, preset, weights, mode=mode, hand=hand, keys=keys), k, keys, ring=True)


def table_advise(notes: DataFrame, costs: DataFrame, k: int = 1, *, hand: str = "hand", missing: int = 999, keys=KEY) -> DataFrame:
    """The k cheapest fingerings by a table of interval costs (low_color, high_color, low_finger, high_finger, semitones, cost).

    A step is looked up by its lower and higher note; a step that the table lacks costs `missing`. For the left hand
    the roles of low and high change. A repeated pitch counts as not ascending. A lone note has one suggestion.
    """
    from handspan.functions.keys import is_black

    n = cut_lineage(neighbours(notes, hand, keys))
    own = [F.col("m1"), F.col("m2"), F.col("h2")]
    steps = n.select(*[c.alias(f"k{i}") for i, c in enumerate(own)]).where("k0 is not null").distinct().withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(24))))
    m1, m2, d1, d2 = F.col("k0"), F.col("k1"), F.floor(F.col("q") / 5).cast("int") + 1, F.col("q") % 5 + 1
    up = (m2 > m1) == (F.col("k2") == ">")
    color = lambda m: is_black(m).cast("int")
    steps = steps.withColumns({
        "low_color": F.when(up, color(m1)).otherwise(color(m2)), "high_color": F.when(up, color(m2)).otherwise(color(m1)),
        "low_finger": F.when(up, d1).otherwise(d2), "high_finger": F.when(up, d2).otherwise(d1), "semitones": F.abs(m2 - m1),
    })
    looked = steps.join(F.broadcast(costs.withColumnRenamed("cost", "_cost")), ["low_color", "high_color", "low_finger", "high_finger", "semitones"], "left")  # a fixed table of some hundred rows
    at = lambda q: F.min(F.when(F.col("q") == q, F.coalesce("_cost", F.lit(missing)).cast("double")))
    classes = looked.groupBy("k0", "k1", "k2").agg(F.array(*[at(q) for q in range(25)]).alias("costs"))
    costed = with_classes(n, classes, own, "c_step")
    start = F.when(F.col("m1").isNull(), F.array_repeat(F.lit(0.0), 25))  # where no hand is known, no step is in the table
    costed = costed.withColumn("c_step", F.coalesce(start, "c_step", F.array_repeat(F.lit(float(missing)), 25)))
    return _with_lone(gathered_costs(costed, keys), k, keys=keys)


def transition_weights(fingered: DataFrame, *, keys=KEY, digit: str = "digit", by=()) -> DataFrame:
    """(by, p, q, f, g, weight): for each two pitches in a row the share of each two fingers within a sequence, summed over the sequences."""
    w = by_note(keys)
    own = list(dict.fromkeys([*by, *keys]))
    b = fingered.select(*own, F.lag("midi").over(w).alias("p"), F.col("midi").alias("q"), F.lag(digit).over(w).alias("f"), F.col(digit).alias("g")).where("p is not null")
    four = b.groupBy(*own, "p", "q", "f", "g").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*own, "p", "q"))
    return four.withColumn("share", share).groupBy(*by, "p", "q", "f", "g").agg(F.sum("share").alias("weight"))


def trained_advise(notes: DataFrame, weights: DataFrame, k: int = 1, *, hand: str = "hand", keys=KEY) -> DataFrame:
    """The k fingerings of the largest sums of trained weights; cost is the negative sum."""
    n = neighbours(notes, hand, keys)
    at = lambda q: -F.coalesce(F.sum(F.when((F.col("f") == q // 5 + 1) & (F.col("g") == q % 5 + 1), F.col("weight"))), F.lit(0.0)).cast("double")
    classes = weights.groupBy(F.col("p").alias("k0"), F.col("q").alias("k1")).agg(F.array(*[at(q) for q in range(25)]).alias("costs"))
    costed = with_classes(n, classes, [F.col("m1"), F.col("m2")], "c_step")
    costed = costed.withColumn("c_step", F.coalesce("c_step", F.array_repeat(F.lit(-0.0), 25)))
    return _with_lone(gathered_costs(costed, keys), k, keys=keys)


def pseudo_model(annotations: DataFrame, *, best: bool = True, k: int = 5, keys=KEY) -> DataFrame:
    """The first (or last) k annotations of a piece as ranked suggestions."""
    w = Window.partitionBy(*keys).orderBy(F.col("annot_idx") if best else F.desc("annot_idx"))
    return annotations.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= k)


def random_advise(notes: DataFrame, k: int, seed: int = 1, *, keys=KEY) -> DataFrame:
    """(keys, rank, digits, cost): k digit strings fixed by the seed; cost is the rank."""
    n = notes.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    n = n.withColumn("_d", (F.pmod(F.xxhash64(*keys, "note_idx", "rank", F.lit(seed)), F.lit(5)) + 1).cast("string"))
    digits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("note_idx", "_d"))), lambda s: s["_d"]), "")
    return n.groupBy(*keys, "rank").agg(digits.alias("digits")).withColumn("cost", F.col("rank").cast("double"))


def bad_fingers(notes: DataFrame, preset: str = "parncutt", *, hand: str = "hand", keys=KEY) -> DataFrame:
    """(keys, note_idx, position, bad): for the note before (-1), the note (0) and the one after (1) the digits in no cheapest local trigram.

    Neighbouring digits of a trigram differ, on a repeated pitch too.
    """
    costed = with_cost_arrays(cut_lineage(neighbours(notes, hand, keys)), preset, mode=None)
    have = {c for c in costed.columns if c.startswith("c_")}
    # a step of equal digits has no cost, but a first note has no step; a last one has no third digit
    cost = lambda q: " + ".join(f"get({name}, {i})" for name, i in places(q).items() if name in have)
    differs = lambda q: " and ".join([*(["m1 is null"] if q // 25 == q // 5 % 5 else []), *(["m3 is null"] if q // 5 % 5 == q % 5 else [])])
    every = [f"if({differs(q)}, {cost(q)}, null)" if differs(q) else cost(q) for q in range(125)]
    m = costed.select(*keys, "note_idx", "m1", "m3", F.expr(f"array({', '.join(every)})").alias("_m"))
    least = m.withColumn("_least", F.array_min("_m"))
    used = lambda position, d: " or ".join(f"get(_m, {q}) = _least" for q in range(125) if (q // 25, q // 5 % 5, q % 5)[position + 1] == d)
    bad = lambda position: f"array_compact(array({', '.join(f'if({used(position, d)}, null, {d + 1})' for d in range(5))}))"
    each = F.expr(f"array(if(m1 is null, null, struct(-1 as position, {bad(-1)} as bad)), struct(0 as position, {bad(0)} as bad), if(m3 is null, null, struct(1 as position, {bad(1)} as bad)))")
    return least.select(*keys, "note_idx", F.explode(F.array_compact(each)).alias("_b")).select(*keys, "note_idx", "_b.position", "_b.bad")


def explode_digits(suggestions: DataFrame, *, keys=KEY) -> DataFrame:
    """One row per note of each suggestion: keys, rank, pos, tip."""
    return suggestions.select(*keys, "rank", F.posexplode(F.split("digits", "")).alias("pos", "_d")).where("_d != ''").select(*keys, "rank", "pos", F.col("_d").cast("int").alias("tip"))


def strike_distance(suggestions: DataFrame, gold: DataFrame, method: str = "hamming", *, keys=KEY, k: int = 1) -> DataFrame:
    """(keys, rank, distance): edit distance of each of the k best suggestions to gold (keys, pos, digit, hand)."""
    tips = explode_digits(suggestions.where(F.col("rank") <= k), keys=keys)
    d = edit_distance(method, F.col("hand"), F.col("digit"), F.col("hand"), F.col("tip"))
    return tips.join(gold, [*keys, "pos"]).groupBy(*keys, "rank").agg(F.sum(d).alias("distance"))


def strike_reentry(notes: DataFrame, preset: str = "parncutt", method: str = "hamming", *, hand: str = "hand", keys=KEY) -> DataFrame:
    """(keys, corrections, distance, playable): advise, and at the first finger that isn't gold's begin again there with gold's finger, until none differs.

    Needs notes.digit as gold's; a null one agrees with any finger. Where no fingering fits from some beginning on, it
    ends there with playable false. One fold from the end gives the least cost to come after each pair of fingers, so one
    from the beginning can follow the cheapest fingering, and begin anew at any note, without another search. Both work on
    Arrow batches, on the notes' costs by reach.
    """
    import pyarrow as pa

    from handspan.functions.fingering import one_note_advice

    own = notes.select(*keys, "note_idx", "midi", F.col(hand).alias("hand"), "digit")
    # each note twice, the second time as one that a search begins at; both take their costs from the same classes
    both = cut_lineage(neighbours(own, "hand", keys)).withColumn("_anew", F.explode(F.array(F.lit(False), F.lit(True))))
    costed = with_cost_arrays(both.withColumn("m1", F.when(~F.col("_anew"), F.col("m1"))), preset)
    have = {c for c in costed.columns if c.startswith("c_")}
    each = sorted(have - {"c_digits"})
    far = F.array(*[edit_distance(method, F.col("hand"), F.col("digit"), F.col("hand"), F.lit(d)).cast("long") for d in range(1, 6)])
    listed = lambda which, *names: F.sort_array(F.collect_list(F.when(which, F.struct("note_idx", *names))))
    per = costed.groupBy(*keys).agg(
        F.min_by("midi", "note_idx").alias("first_midi"), listed(~F.col("_anew"), *each, F.col("digit").cast("int").alias("digit"), far.alias("far")).alias("gold"),
        listed(F.col("_anew"), F.when(F.col("_anew"), _composed(have, 25)).alias("m")).alias("starts"), *([F.first("c_digits").alias("c_digits")] if "c_digits" in have else []),
    )
    kinds = [f"`{c}` {t}" for c, t in per.dtypes if c in keys]
    rows = per.select(*keys, "gold", "starts", one_note_advice("first_midi", F.lit(None)).alias("_first"), *(["c_digits"] if "c_digits" in have else []))
    workers_find_library(notes.sparkSession)
    count = len(keys)

    def work(batches):
        for b in batches:
            for who, *found in reentries(b.column(count), b.column(count + 1), b.column(count + 3) if b.num_columns > count + 3 else None, b.column(count + 2)):
                own = [b.column(j).take(pa.array(who)) for j in range(count)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(x) for x in found]], names=[*keys, "corrections", "distance", "playable"])

    return rows.mapInArrow(work, ", ".join([*kinds, "corrections long", "distance long", "playable boolean"]))


def pivot_alignment(pairs: DataFrame, *, a: str = "a_pivot", b: str = "b_pivot", keys=KEY) -> DataFrame:
    """(keys, mismatches): notes whose pivot flags differ."""
    return pairs.groupBy(*keys).agg(F.sum((F.col(a) != F.col(b)).cast("long")).alias("mismatches"))


def ablations(preset: str, n: int) -> list[tuple[str, dict[str, float]]]:
    """(name, weights) that mute every combination of up to n rules of a preset; the first mutes none."""
    tags = PRESETS[preset][0]
    return [("all", {})] + [("-" + "-".join(m), dict.fromkeys(m, 0.0)) for size in range(1, n + 1) for m in combinations(tags, size)]


def versioned_paths(notes: DataFrame, preset: str, versions: list[tuple[str, dict[str, float]]], k: int, *, mode: str = "max", hand: str = "hand", keys=KEY) -> DataFrame:
    """(version, keys, rank, digits, cost): the k best of each segment under several sets of weights, in one fold over its notes.

    The notes' rule costs come once, unweighted, from the tables of classes; a version's costs are their weighted sums,
    made beside the fold. So neither notes nor candidates are multiplied by the versions. Phrases of one note have the
    finger that their cheapest candidate gives.
    """
    tags, _, _, own = PRESETS[preset]
    costed = with_cost_arrays(cut_lineage(neighbours(notes, hand, keys)), preset, mode=mode, apart=True)
    have = [c for c in costed.columns if c.startswith("c_")]
    rules = {c: [t for t in tags if REACH.get(t, "whole") == c[2:]] for c in have}
    own_weights = lambda given: {c: [float((own | given).get(t, 1.0)) for t in rules[c]] for c in have}
    sets = [(name, own_weights(given)) for name, given in versions]
    return _versions_of(gathered_costs(costed, keys), sets, k, keys)


def _versions_of(gathered: DataFrame, sets: list[tuple[str, dict[str, list[float]]]], k: int, keys) -> DataFrame:
    """(version, keys, rank, digits, cost): `_best_of` under each set of weights; costs are lists with a cost of each rule."""
    import pyarrow as pa

    kinds = [f"`{c}` {t}" for c, t in gathered.dtypes if c in keys]
    constant = "c_digits" in gathered.columns
    rows = gathered.select(*keys, "notes", *(["c_digits"] if constant else []))
    workers_find_library(gathered.sparkSession)
    count = len(keys)

    def work(batches):
        for b in batches:
            for version, weights in sets:
                for who, ranks, digits, costs in best_rows(b.column(count), b.column(count + 1) if constant else None, None, k, weights=weights):
                    own = [b.column(j).take(pa.array(who)) for j in range(count)]
                    costs = pa.nulls(len(who), pa.float64()) if costs is None else pa.array(costs, pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([version] * len(who), pa.string()), *own, pa.array(ranks, pa.int32()), digits, costs], names=["version", *keys, "rank", "digits", "cost"])

    return rows.mapInArrow(work, ", ".join(["version string", *kinds, "rank int", "digits string", "cost double"]))


def rule_ablation(notes: DataFrame, preset: str, n: int, value, *, k: int = 5, hand: str = "hand", keys=KEY) -> DataFrame:
    """(version, value, loss): value(suggestions) -> (version, keys, v) averaged for each muted version; loss is the full model's less its own.

    All versions share one search (`versioned_paths`).
    """
    best = versioned_paths(notes, preset, ablations(preset, n), k, hand=hand, keys=keys)
    scored = cut_lineage(value(best).groupBy("version").agg(F.avg("v").alias("value")))
    full = scored.where("version = 'all'").select(F.col("value").alias("_full"))
    return scored.crossJoin(F.broadcast(full)).select("version", "value", (F.col("_full") - F.col("value")).alias("loss"))  # a row for each version


def viterbi_decode(emissions: DataFrame, transitions: DataFrame, *, label: str = "label", score: str = "score", keys=KEY) -> DataFrame:
    """(keys, digits, score): the best path of labels 1..5 from token scores (keys, note_idx, label, score) and (prev, cur, score), both larger is better."""
    at = lambda d: F.max(F.when(F.col(label) == d, F.col(score).cast("double")))
    e = emissions.groupBy(*keys, "note_idx").agg(F.array(*[at(d) for d in range(1, 6)]).alias("_e"))
    step = lambda q: F.coalesce(F.max(F.when((F.col("prev") == q // 5 + 1) & (F.col("cur") == q % 5 + 1), F.col("score"))), F.lit(0.0)).cast("double")
    t = transitions.agg(F.array(*[step(q) for q in range(25)]).alias("_t"))  # one row
    rows = e.withColumn("_first", F.col("note_idx") == F.min("note_idx").over(Window.partitionBy(*keys))).crossJoin(F.broadcast(t))
    cost = F.expr(f"array({', '.join(f'-(get(_e, {q % 5}) + if(_first, 0D, get(_t, {q})))' for q in range(25))})")
    costs = gathered_costs(rows.withColumns({"c_step": cost, "midi": F.lit(0)}), keys)
    return _best_of(costs, 1, keys).select(*keys, "digits", (-F.col("cost")).alias("score"))


def recall_all(suggest, gold: DataFrame, *, step: int = 25, keys=KEY) -> DataFrame:
    """Doubles k until all gold of a segment is suggested or no more suggestions come for it.

    suggest(k, only) -> (keys, rank, fingering, cost) of the segments in `only` (keys), or of all where it is None; only
    those that still miss gold are deepened. Gold that can't be played makes a segment go through all its fingerings.
    """
    from handspan.operators.corpus import gold_missing

    k, only, before, done = step, None, None, None
    while True:
        got = cut_lineage(suggest(k, only))
        n = got.groupBy(*keys).agg(F.count("*").alias("_n"))
        if only is not None:
            gold = gold.join(only, list(keys), "left_semi")
        more = gold_missing(gold, got, keys=keys).select(*keys).distinct().join(n, list(keys))
        if before is not None:
            more = more.join(before, list(keys)).where("_n > _before").drop("_before")
        more = cut_lineage(more)
        ended = got.join(more, list(keys), "left_anti").select(*got.columns)
        done = ended if done is None else done.unionByName(ended)
        if more.isEmpty():
            return done
        k, only, before = k * 2, more.select(*keys), more.withColumnRenamed("_n", "_before")
