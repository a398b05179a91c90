"""Ranked evaluation of suggested fingerings against human ones: distances, reciprocal ranks, gains, overlaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from handspan.functions.measures import DECAYS, DELTAS, MUS, adjacent_long, adjacent_on_white, phi_inverse
from handspan.operators.sequence import KEY

RANKED = (*KEY, "rank")


def with_counts(pairs: DataFrame, *, keys=RANKED) -> DataFrame:
    """Adds n, the notes of the sequence, and i, the note's place from 1."""
    return pairs.withColumns({"n": F.count("*").over(Window.partitionBy(*keys)), "i": F.row_number().over(Window.partitionBy(*keys).orderBy("note_idx"))})


def big_delta(pairs: DataFrame, *, delta: str = "hmg", decay: str = "none", keys=RANKED) -> DataFrame:
    """(keys, n, big_delta, normalized): decayed distance over a pair of fingerings, at most n. Needs one, other, same_hand, midi."""
    p = with_counts(pairs, keys=keys)
    d = DELTAS[delta](F.col("one"), F.col("other"), F.col("midi"), F.col("same_hand"))
    weight = DECAYS[decay](F.col("n"), F.col("i"))
    return p.groupBy(*keys, "n").agg((F.first("n") * F.sum(weight * d) / F.sum(weight)).alias("big_delta")).withColumn("normalized", F.col("big_delta") / F.col("n"))


def _tau_rows(pairs: DataFrame, keys, proxy) -> DataFrame:
    """The n + 2 trigram positions of each pair: equal, middle-similar and relaxed flags."""
    near = (PROXIES[proxy] if isinstance(proxy, str) else proxy)(F.col("one"), F.col("other"), F.col("midi"))
    p = with_counts(pairs, keys=keys).withColumns({"same": (F.col("one") == F.col("other")) & F.col("same_hand"), "near": near & F.col("same_hand")})
    ends = p.where("i = n").select(*keys, "n", F.explode(F.array(F.col("i") + 1, F.col("i") + 2, F.col("i") + 3, F.col("i") + 4)).alias("i"), F.lit(True).alias("same"), F.lit(False).alias("near"))
    heads = p.where("i = n").select(*keys, "n", F.explode(F.array(F.lit(-1), F.lit(0))).alias("i"), F.lit(True).alias("same"), F.lit(False).alias("near"))
    rows = p.select(*keys, "n", "i", "same", "near").unionByName(ends).unionByName(heads)
    w = Window.partitionBy(*keys).orderBy("i")
    at = lambda c, k: F.coalesce((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w), F.lit(c == "same")) if k else F.col(c)
    equal = at("same", -2) & at("same", -1) & at("same", 0)
    similar = at("same", -2) & at("same", 0) & at("near", -1)
    fine = lambda k: at("same", k) | (at("near", k) & at("same", k - 1) & at("same", k + 1))
    rows = rows.withColumns({"equal": equal, "similar": similar, "relaxed": fine(-2) & fine(-1) & fine(0)})
    return rows.where("i between 1 and n + 2")


#: Which unequal fingers may stand for one another, by name: Columns of two digits and the pitch.
PROXIES = {"long": lambda one, other, midi: adjacent_long(one, other), "white": adjacent_on_white}


def trigram_big_delta(pairs: DataFrame, *, tau="trigram", decay: str = "none", eps: float = 0.99, proxy="long", full_context: bool = True, keys=RANKED) -> DataFrame:
    """(keys, n, tri_delta, tri_normalized): the same with trigrams that end at each position; in full context two more than notes.

    tau: trigram (equal or not), nuanced (ends equal and the middle interchangeable), relaxed (each of the three
    equal or interchangeable in its own trigram), or a function of these three flags that gives the value. proxy: long,
    white, or a function (one, other, midi) that says which fingers are interchangeable.
    """
    rows = _tau_rows(pairs, keys, proxy)
    if not full_context:
        rows = rows.where("i <= n")
    total = F.col("n") + (2 if full_context else 0)
    if callable(tau):
        value = tau(F.col("equal"), F.col("similar"), F.col("relaxed"))
    else:
        soft = {"trigram": F.lit(False), "nuanced": F.col("similar"), "relaxed": F.col("relaxed")}[tau]
        value = F.when(F.col("equal"), 0.0).when(soft, 1.0 - eps).otherwise(1.0)
    weight = DECAYS[decay](total, F.col("i"))
    out = rows.groupBy(*keys, "n").agg((F.sum(weight * value) / F.sum(weight)).alias("tri_normalized"))
    return out.select(*keys, "n", (F.col("tri_normalized") * total).alias("tri_delta"), "tri_normalized")


def _clash(keys) -> Column:
    """1 at a step where exactly one of the two fingerings pivots by the right-hand rule."""
    w = Window.partitionBy(*keys).orderBy("note_idx")
    step = F.lead("midi").over(w) - F.col("midi")

    def pivots(digit, hand):
        d1 = F.lead(digit).over(w)
        on = F.when(step > 0, d1 == 1).when(step < 0, F.col(digit) == 1).otherwise(False)
        return F.coalesce((F.lead(hand).over(w) == F.col(hand)) & on & (d1 != F.col(digit)), F.lit(False))

    return (pivots("one", "one_hand") != pivots("other", "other_hand")).cast("int")


def pivot_clashes(pairs: DataFrame, *, decay: str = "none", keys=RANKED) -> DataFrame:
    """(keys, rho): steps where exactly one of the two fingerings pivots by the right-hand rule. Needs one_hand and other_hand."""
    p = with_counts(pairs, keys=keys).withColumns({"_clash": _clash(keys), "_w": DECAYS[decay](F.col("n"), F.col("i"))})
    return p.groupBy(*keys).agg((F.count("*") * F.sum(F.col("_w") * F.col("_clash")) / F.sum("_w")).alias("rho"))


def rank_measures(pairs: DataFrame, *, keys=RANKED, eps: float = 0.99) -> DataFrame:
    """Every distance and clash count of the result sets in one pass: (keys, n) and, each without and with (_u) decay, the
    normalised hmg and al, rho, and the normalised tri, nua and rlx over n + 2 trigrams.

    One window and one aggregate by the same keys. A trigram stands at its last note; the two that reach past the end
    stand at the last note too.
    """
    w = Window.partitionBy(*keys).orderBy("note_idx")
    p = with_counts(pairs, keys=keys)
    p = p.withColumns({"_same": (F.col("one") == F.col("other")) & F.col("same_hand"), "_near": adjacent_long(F.col("one"), F.col("other")) & F.col("same_hand")})
    at = lambda c, k: F.coalesce((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w), F.lit(c == "_same")) if k else F.col(c)
    fine = lambda k: at("_same", k) | (at("_near", k) & at("_same", k - 1) & at("_same", k + 1))

    def trigram(o):
        equal = at("_same", o - 2) & at("_same", o - 1) & at("_same", o)
        soft = {"tri": F.lit(False), "nua": at("_same", o - 2) & at("_near", o - 1) & at("_same", o), "rlx": fine(o - 2) & fine(o - 1) & fine(o)}
        return {tag: F.when(equal, 0.0).when(x, 1.0 - eps).otherwise(1.0) for tag, x in soft.items()}

    here, last = trigram(0), F.col("i") == F.col("n")
    after = [trigram(1), trigram(2)]
    delta = {d: DELTAS[d](F.col("one"), F.col("other"), F.col("midi"), F.col("same_hand")) for d in ("hmg", "al")}
    p = p.withColumns({"_clash": _clash(keys), **{f"_{d}": x for d, x in delta.items()}, **{f"_{t}": x for t, x in here.items()}, **{f"_{t}{k}": F.when(last, a[t]) for k, a in enumerate(after, 1) for t in here}})
    n, i, sums = F.col("n"), F.col("i"), []
    for mark, decay in (("", "none"), ("_u", "uniform")):
        weigh = DECAYS[decay]
        one = weigh(n, i)
        sums += [(F.sum(one * F.col(f"_{d}")) / F.sum(one)).alias(f"{d}{mark}") for d in delta]
        sums.append((F.count("*") * F.sum(one * F.col("_clash")) / F.sum(one)).alias(f"rho{mark}"))
        three, tail = weigh(n + 2, i), [weigh(n + 2, n + k) for k in (1, 2)]
        all_weights = F.sum(three + F.when(last, tail[0] + tail[1]).otherwise(0.0))
        sums += [(F.sum(three * F.col(f"_{t}") + F.when(last, tail[0] * F.col(f"_{t}1") + tail[1] * F.col(f"_{t}2")).otherwise(0.0)) / all_weights).alias(f"{t}{mark}") for t in here]
    return p.groupBy(*keys, "n").agg(*sums)


def prob_satisfied(deltas: DataFrame, rho: DataFrame | None = None, *, normalized: str = "normalized", mu: str = "scale", keys=RANKED) -> DataFrame:
    """(keys, p): 1 - normalised distance, divided by mu(rho)."""
    p = 1.0 - F.col(normalized)
    if rho is None:
        return deltas.select(*keys, p.alias("p"))
    return deltas.join(rho, list(keys)).select(*keys, (p / MUS[mu](F.col("rho"), F.col("n"))).alias("p"))


def expected_reciprocal_rank(probs: DataFrame, *, keys=KEY, k: int | None = None, phi=phi_inverse) -> DataFrame:
    """(keys, err): sum over ranks of phi(rank) * p * the chance that no better rank satisfied. Exact for p = 1."""
    s = probs if k is None else probs.where(F.col("rank") <= k)
    ordered = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "p"))).alias("_ranks"))
    return ordered.select(*keys, _cascade(F.col("_ranks"), "p", phi).alias("err"))


def _cascade(ranks: Column, p: str, phi=phi_inverse) -> Column:
    """The expected reciprocal rank of ranks in order, each a struct of its rank and chances to satisfy."""
    start = F.struct(F.lit(0.0).alias("err"), F.lit(1.0).alias("left"))
    step = lambda a, x: F.struct((a["err"] + phi(x["rank"]) * x[p] * a["left"]).alias("err"), (a["left"] * (1 - x[p])).alias("left"))
    return F.aggregate(ranks, start, step, lambda a: a["err"])


def phrase_mean_err(errs: DataFrame, *, keys=("corpus", "model", "title"), value: str = "err", weight: str = "weight") -> DataFrame:
    """(keys, mean_err, people): errors of a phrase weighted by people."""
    return errs.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean_err"), F.sum(weight).alias("people"))


def mean_err(phrases: DataFrame, *, keys=("corpus", "model"), notes: str = "notes") -> DataFrame:
    """(keys, mean_err, weighted_mean_err): over phrases, each alike and by notes."""
    return phrases.groupBy(*keys).agg(F.avg("mean_err").alias("mean_err"), (F.sum(F.col("mean_err") * F.col(notes)) / F.sum(notes)).alias("weighted_mean_err"))


# --- gold and gains -------------------------------------------------------------------------------------------------


def with_gains(suggestions: DataFrame, votes: DataFrame, *, keys=KEY, fingering: str = "fingering") -> DataFrame:
    """Suggestions with votes, gain (share of all votes) and hit."""
    total = votes.groupBy(*keys).agg(F.sum("votes").alias("_total"), F.count("*").alias("relevant"))
    s = suggestions.join(votes.select(*keys, fingering, "votes"), [*keys, fingering], "left").join(total, list(keys))
    v = F.coalesce("votes", F.lit(0))
    return s.withColumns({"votes": v, "gain": v / F.col("_total"), "hit": (v > 0).cast("int")}).drop("_total")


def average_precision(gains: DataFrame, *, k: int | None = None, keys=KEY) -> DataFrame:
    """(keys, ap): precision at the hits, over all relevant ones (at most k of them)."""
    s = gains if k is None else gains.where(F.col("rank") <= k)
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_at", F.sum("hit").over(w) / F.col("rank"))
    relevant = F.max("relevant") if k is None else F.least(F.max("relevant"), F.lit(k))
    return s.groupBy(*keys).agg((F.sum(F.col("_at") * F.col("hit")) / relevant).alias("ap"))


def average_precision_at_recall(gains: DataFrame, *, keys=KEY) -> DataFrame:
    """(keys, ap): average precision over the ranks down to the last relevant one; null where the ranks don't hold all relevant ones."""
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    s = gains.withColumn("_h", F.sum("hit").over(w)).withColumn("_at", F.col("_h") / F.col("rank"))
    whole = F.max("_h") == F.max("relevant")
    return s.groupBy(*keys).agg(F.when(whole, F.sum(F.col("_at") * F.col("hit")) / F.max("relevant")).alias("ap"))


def mean_average_precision(precisions: DataFrame, *, by=()) -> DataFrame:
    """(by, map, pieces): the mean of the pieces' average precisions; pieces without one don't count."""
    return precisions.groupBy(*by).agg(F.avg("ap").alias("map"), F.count("ap").alias("pieces"))


def precision_recall_at_k(gains: DataFrame, k: int, *, keys=KEY) -> DataFrame:
    s = gains.where(F.col("rank") <= k)
    return s.groupBy(*keys).agg((F.sum("hit") / F.lit(k)).alias("precision"), (F.sum("hit") / F.max("relevant")).alias("recall"))


def _discount(rank: Column, base: str) -> Column:
    b = {"2": F.log2(rank), "e": F.log(rank)}.get(base)
    return F.when(rank == 1, 1.0).otherwise(F.log(rank) / F.log(F.lit(float(base))) if b is None else b)


def dcg(gains: DataFrame, *, k: int | None = None, base: str = "2", keys=KEY) -> DataFrame:
    s = gains if k is None else gains.where(F.col("rank") <= k)
    return s.groupBy(*keys).agg(F.sum(F.col("gain") / _discount(F.col("rank"), base)).alias("dcg"))


def ndcg(gains: DataFrame, votes: DataFrame, *, k: int | None = None, base: str = "2", keys=KEY) -> DataFrame:
    """(keys, dcg, ideal, ndcg): the ideal order is by votes, as long as the suggestions are."""
    own = dcg(gains, k=k, base=base, keys=keys)
    length = (gains if k is None else gains.where(F.col("rank") <= k)).groupBy(*keys).agg(F.max("rank").alias("_k"))
    total = votes.groupBy(*keys).agg(F.sum("votes").alias("_t"))
    ideal = votes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes")))).join(length, list(keys)).join(total, list(keys))
    ideal = ideal.where(F.col("rank") <= F.col("_k")).groupBy(*keys).agg(F.sum(F.col("votes") / F.col("_t") / _discount(F.col("rank"), base)).alias("ideal"))
    return own.join(ideal, list(keys)).withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0))


def pair_marks(pairs: DataFrame, *, keys) -> DataFrame:
    """Counts of a suggestion against one gold fingering, for the user models and rank measures.

    (keys, n, matches, wild, proxies, clashes, wclashes, equity): wild are gold's 'x' (null); proxies near neighbours;
    a clash at place i weighs n - i + 1, in all times 2 / (n + 1).
    """
    p = with_counts(pairs, keys=keys)
    wild = F.col("gold").isNull()
    match = F.coalesce((F.col("gold") == F.col("tip")) & F.col("same_hand"), F.lit(False))
    proxy = F.coalesce((F.least("gold", "tip").isin(2, 3, 4)) & (F.abs(F.col("gold") - F.col("tip")) == 1) & F.col("same_hand"), F.lit(False))
    clash = ~wild & ~match
    one = lambda c: F.sum(c.cast("int"))
    return p.groupBy(*keys, "n").agg(
        one(match).alias("matches"), one(wild).alias("wild"), one(proxy).alias("proxies"), one(clash).alias("clashes"),
        (F.sum(F.when(clash, F.col("n") - F.col("i") + 1).otherwise(0)) * 2.0 / (F.col("n") + 1)).alias("wclashes"),
        F.sum(F.when(match | wild, 1.0).when(proxy, 1 - F.pow(F.lit(2.0), -(F.col("i") - 1).cast("double"))).otherwise(0.0)).alias("equity"),
        (F.sum(F.when(clash & ~proxy, F.col("n") - (F.col("i") - 1) + 1).otherwise(0)) * 2.0 / (F.col("n") + 1)).alias("equity_clashes"),
    )


def _user(kind: str) -> tuple[Column, Column]:
    """(numerator, denominator) of one gold fingering under a model of the user."""
    n, m, w, p = (F.col(c) for c in ("n", "matches", "wild", "proxies"))
    share = m / n
    if kind == "strict":
        return (m == n).cast("double"), F.lit(1.0)
    if kind == "estimated":
        return F.when(m == n, 1.0).when(w + m == n, share).otherwise(0.0), F.when(m == n, 1.0).when(w + m == n, share).otherwise(1.0)
    if kind in ("proxy", "equal_proxy"):
        near = F.lit(1.0) if kind == "equal_proxy" else (m + p / F.pow(F.lit(2.0), p)) / n
        num = F.when(m == n, 1.0).when(m + p == n, near).when(w + m == n, share).when(w + m + p == n, (m + p / F.pow(F.lit(2.0), p)) / n).otherwise(0.0)
        den = F.when(m == n, 1.0).when(m + p == n, 1.0).when(w + m == n, share).when(w + m + p == n, (m + p) / n).otherwise(1.0)
        return num, den
    if kind in ("equity", "pure_equity"):
        if kind == "pure_equity":
            num = F.when(w + m + p != n, 0.0).otherwise(F.col("equity"))
        else:
            num = F.when(m == n, n.cast("double")).otherwise(F.col("equity") / F.pow(F.lit(2.0), F.col("equity_clashes")))
        return F.when(w == n, 0.0).otherwise(num), F.when(w == n, 0.0).otherwise(n.cast("double"))
    raise ValueError(kind)


#: Models of the user's content with a suggestion.
USERS = ("strict", "estimated", "proxy", "equal_proxy", "equity", "pure_equity")


def user_prob(marks: DataFrame, kind, *, keys=RANKED) -> DataFrame:
    """(keys, p): the chance that a user who would play one of the gold fingerings takes the suggestion; 0 without any that tells.

    kind: one of USERS, or a function of a dictionary of the marks' columns that gives (numerator, denominator) of one gold.
    """
    num, den = kind({c: F.col(c) for c in marks.columns}) if callable(kind) else _user(kind)
    return marks.groupBy(*keys).agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0.0))).alias("p")).withColumn("p", F.coalesce("p", F.lit(0.0)))


def wildcard_rank_prob(marks: DataFrame, method: str = "match", *, keys=RANKED) -> DataFrame:
    """(keys, p): sum of marks / (discord + 1) over gold, by the notes that aren't wild.

    match: equal fingers; discordant: the same, less by every clash; similarity: by weighted clashes; equity: near
    neighbours count in part.
    """
    said = F.col("n") - F.col("wild")
    mark = {"match": F.col("matches") / said, "discordant": F.col("matches") / said / (F.col("clashes") + 1), "similarity": F.col("matches") / said / (F.col("wclashes") + 1), "equity": (F.col("equity") - F.col("wild")) / said}[method]
    return marks.groupBy(*keys).agg((F.sum(F.when(said > 0, mark * said)) / F.sum(F.col("n"))).alias("p")).withColumn("p", F.coalesce("p", F.lit(0.0)))


def proximal_gain(pairs: DataFrame, distance: Column, d_max: int, *, keys=RANKED) -> DataFrame:
    """(keys, gain, normalized_gain): votes times what each note's distance leaves of the largest. Needs votes."""
    return pairs.groupBy(*keys).agg(F.sum(F.col("votes") * (d_max - distance)).alias("gain"), (F.sum(F.col("votes") * (d_max - distance)) / F.sum(F.col("votes") * d_max)).alias("normalized_gain"))


def cumulative_gain(gains: DataFrame, *, value: str = "gain", keys=KEY) -> DataFrame:
    """Adds cumulative and discounted: running sums over ranks."""
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return gains.withColumns({"cumulative": F.sum(value).over(w), "discounted": F.sum(F.col(value) / _discount(F.col("rank"), "2")).over(w)})


# --- rank-biased overlap --------------------------------------------------------------------------------------------


def tied_ranking(scores: DataFrame, *, item: str = "item", score: str = "score", keys=KEY) -> DataFrame:
    """(keys, ranking): sets of items of equal score, best first."""
    s = scores.groupBy(*keys, score).agg(F.array_sort(F.collect_set(item)).alias("set"))
    return s.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(score, "set")), False), lambda x: x["set"]).alias("ranking"))


def _depths(ranking: Column) -> Column:
    """(item, at) of every item: the least depth whose prefix holds it; the items of a tie come in together."""
    before = lambda i: F.aggregate(F.slice(ranking, 1, i), F.lit(0), lambda n, tie: n + F.size(tie))
    ties = F.transform(ranking, lambda tie, i: F.struct(tie.alias("tie"), (before(i) + 1).alias("at")))
    return F.flatten(F.transform(ties, lambda t: F.transform(t["tie"], lambda x: F.struct(x.alias("item"), t["at"].alias("at")))))


class Overlap:
    """Two rankings met once: at which depths the items of each, and those of both, come in. All sums over depths count these."""

    def __init__(self, met: Column):
        self.met = met
        self.short, self.long = F.least(F.size(met["a"]), F.size(met["b"])), F.greatest(F.size(met["a"]), F.size(met["b"]))

    def at(self, depth: Column) -> Column:
        """Items in both prefixes of a depth."""
        return self._within("both", depth)

    def share(self, depth: Column) -> Column:
        """The part of both prefixes that they have in common."""
        return 2.0 * self.at(depth) / (self._within("a", depth) + self._within("b", depth))

    def _within(self, which: str, depth: Column) -> Column:
        return F.size(F.filter(self.met[which], lambda d: d <= depth))


def _met(a: Column, b: Column, measure) -> Column:
    """measure(Overlap of a and b), for which the two are met once."""
    pair = F.struct(_depths(a).alias("a"), _depths(b).alias("b"))
    places = lambda items: F.transform(items, lambda x: x["at"])
    both = lambda p, known: F.filter(F.transform(p["a"], lambda x: F.when(F.try_element_at(known, x["item"]).isNotNull(), F.greatest(x["at"], F.try_element_at(known, x["item"])))), lambda d: d.isNotNull())
    once = lambda column, f: F.get(F.transform(F.array(column), f), F.lit(0))
    joined = once(pair, lambda p: F.struct(places(p["a"]).alias("a"), places(p["b"]).alias("b"), once(F.map_from_entries(p["b"]), lambda known: both(p, known)).alias("both")))
    return once(joined, lambda met: measure(Overlap(met)))


def overlap(a: Column, b: Column, depth: Column) -> Column:
    """Items in both rankings down to a depth; sets of ties count whole."""
    return _met(a, b, lambda o: o.at(depth))


def agreement(a: Column, b: Column, depth: Column) -> Column:
    """2 * overlap over the lengths of both prefixes."""
    return _met(a, b, lambda o: o.share(depth))


def _total(first: Column, last: Column, term) -> Column:
    """The sum of term(depth, as a double) over the depths first..last; 0 where there are none."""
    depths = F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(depths, F.lit(0.0), lambda total, d: total + term(d.cast("double")))


def average_overlap(a: Column, b: Column, depth: Column) -> Column:
    return _met(a, b, lambda o: _total(F.lit(1), depth, o.share) / depth)


def rbo_at_k(a: Column, b: Column, p: float, depth: Column) -> Column:
    return _met(a, b, lambda o: (1 - p) * _total(F.lit(1), depth, lambda d: F.pow(F.lit(p), d - 1) * o.share(d)))


def rbo_min(a: Column, b: Column, p: float, depth: Column | None = None) -> Column:
    """The overlap that no continuation of the two rankings can undercut: what is seen, and nothing new after it."""

    def measure(o):
        end = o.short if depth is None else depth
        seen = o.at(end)
        gained = _total(F.lit(1), end, lambda d: F.pow(F.lit(p), d) * (o.at(d) - seen) / d)
        return (1 - p) / p * (gained - seen * math.log(1 - p))

    return _met(a, b, measure)


def rbo_ext(a: Column, b: Column, p: float) -> Column:
    """The overlap carried on beyond both rankings as they end; within the longer one the shorter goes on at its last rate."""

    def measure(o):
        rate = o.at(o.short) / o.short
        seen = _total(F.lit(1), o.long, lambda d: F.pow(F.lit(p), d) * o.share(d))
        lent = _total(o.short + 1, o.long, lambda d: F.pow(F.lit(p), d) * rate * (d - o.short) / d)
        beyond = rate + (o.at(o.long) - o.at(o.short)) / o.long
        return (1 - p) / p * (seen + lent) + beyond * F.pow(F.lit(p), o.long.cast("double"))

    return _met(a, b, measure)


def rbo_res(a: Column, b: Column, p: float) -> Column:
    """What the unseen rest of the rankings can add at most: each unseen place is one that both would share."""

    def measure(o):
        known = o.at(o.long)
        full = o.short + o.long - known  # the depth from which the two could agree wholly
        tail = lambda first: _total(first, full, lambda d: F.pow(F.lit(p), d) / d)
        ends = F.pow(F.lit(p), o.short.cast("double")) + F.pow(F.lit(p), o.long.cast("double")) - F.pow(F.lit(p), full.cast("double"))
        return ends - (1 - p) / p * (o.short * tail(o.short + 1) + o.long * tail(o.long + 1) - known * (math.log(1 - p) + tail(F.lit(1))))

    return _met(a, b, measure)


# --- result sets ----------------------------------------------------------------------------------------------------

def pivot_clash_discount(clashes: DataFrame, base: float = 2.0, *, rho: str = "rho") -> DataFrame:
    """Adds discount, base ** -clashes, and aligned, no clash at all."""
    return clashes.withColumns({"discount": F.pow(F.lit(base), -F.col(rho)), "aligned": F.col(rho) == 0})


def rank_tags(pairs: DataFrame, *, keys=RANKED) -> DataFrame:
    """One row per ranked suggestion with every rank measure: distances, clashes, chances to satisfy.

    rho_uni_d equals rho_no_d, as clashes are weighted by the general decay.
    """
    n, c = F.col("n"), F.col
    out = rank_measures(pairs, keys=keys).select(
        *keys, "n", (n * c("hmg")).alias("hmg"), c("hmg").alias("norm_hmg"), (n * c("al")).alias("al"), c("al").alias("norm_al"), c("rho").alias("rho_no_d"), c("rho").alias("rho_uni_d"),
        *[x for t in ("tri", "nua", "rlx") for x in (((n + 2) * c(t)).alias(f"{t}_D"), c(t).alias(f"norm_{t}_D"))],
    )
    return out.withColumns({"p_sat": 1 - F.col("norm_hmg"), **{f"{t}_p_sat": 1 - F.col(f"norm_{t}_D") for t in ("tri", "nua", "rlx")}})


def err_tags(pairs: DataFrame, *, keys=KEY, mu: str = "scale") -> DataFrame:
    """(keys, one column for each reciprocal-rank measure): rho tags divide by mu(clashes); clvrst decays distances and clashes.

    The measures of all ranks are collected once; each tag is a fold over them.
    """
    c, n, t = F.col, F.col("n"), F.col("n") + 2
    probs = {
        "hmg": (c("hmg"), None, n), "hmg_rho": (c("hmg"), c("rho"), n), "al": (c("al"), None, n), "al_rho": (c("al"), c("rho"), n), "clvrst": (c("al_u"), c("rho_u"), n), "tri": (c("tri"), None, t), "tri_rho": (c("tri"), c("rho"), t),
        "tri_nua": (c("nua"), None, t), "tri_nua_rho": (c("nua"), c("rho"), t), "tri_rlx": (c("rlx"), None, t), "tri_rlx_rho": (c("rlx"), c("rho"), t), "tri_clvrst": (c("rlx_u"), c("rho_u"), t),
    }
    p = [((1.0 - far) if rho is None else (1.0 - far) / MUS[mu](rho, size)).alias(tag) for tag, (far, rho, size) in probs.items()]
    ranks = rank_measures(pairs, keys=(*keys, "rank")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", *p))).alias("_ranks"))
    return ranks.select(*keys, *[_cascade(F.col("_ranks"), tag).alias(tag) for tag in probs])


def annotation_pairs(suggestions: DataFrame, annotations: DataFrame, notes: DataFrame, *, keys=KEY, k: int = 5) -> DataFrame:
    """The k best suggestions (keys, rank, digits) beside every annotation (keys, annot_id, weight, note_idx, hand, digit), note by note."""
    tips = suggestions.where(F.col("rank") <= k).select(*keys, "rank", F.posexplode(F.split("digits", "")).alias("_pos", "_d")).where("_d != ''").select(*keys, "rank", "_pos", F.col("_d").cast("int").alias("other"))
    n = notes.select(*keys, "note_idx", "midi", F.col("hand").alias("other_hand"), (F.row_number().over(Window.partitionBy(*keys).orderBy("note_idx")) - 1).alias("_pos"))
    a = annotations.select(*keys, "annot_id", "weight", "note_idx", F.col("hand").alias("one_hand"), F.col("digit").alias("one"))
    return a.join(n, [*keys, "note_idx"]).join(tips, [*keys, "_pos"]).withColumn("same_hand", F.col("one_hand") == F.col("other_hand"))


def evaluate_model(suggestions: DataFrame, annotations: DataFrame, notes: DataFrame, *, keys=KEY, k: int = 5) -> DataFrame:
    """(keys, annot_id, weight, notes, reciprocal-rank measures): a model against every annotation; 0 where it suggests nothing."""
    p = annotation_pairs(suggestions, annotations, notes, keys=keys, k=k)
    size = notes.groupBy(*keys).agg(F.count("*").alias("notes"))
    weights = annotations.select(*keys, "annot_id", "weight").distinct()
    tags = err_tags(p, keys=(*keys, "annot_id"))
    new = [c for c in tags.columns if c not in (*keys, "annot_id")]
    return weights.join(tags, [*keys, "annot_id"], "left").fillna(0.0, new).join(size, list(keys))


def discounted_proximal_gain(gains: DataFrame, ideal: DataFrame | None = None, *, keys=KEY) -> DataFrame:
    """(keys, dcpg[, ndcpg]): proximal gains over ranks, discounted; beside the ideal order's where it is given."""
    total = lambda g, name: g.groupBy(*keys).agg(F.sum(F.col("gain") / _discount(F.col("rank"), "2")).alias(name))
    own = total(gains, "dcpg")
    if ideal is None:
        return own
    return own.join(total(ideal, "_ideal"), list(keys)).withColumn("ndcpg", F.when(F.col("_ideal") > 0, F.col("dcpg") / F.col("_ideal")).otherwise(0.0)).drop("_ideal")
