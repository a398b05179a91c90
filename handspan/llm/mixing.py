"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are proportional to share ** t, where share is a source's part of all tokens. The exponent t in
[0, 1] is bisected to the largest value that reaches a target entropy; if the weights would then repeat a
source more often than allowed, t is bisected upwards to the repetition limit. Each source's documents
are dealt into blocks by a hash; an epoch is a permutation of the blocks, and of the documents in each.
A source takes whole epochs, then the leading blocks of one more, then the leading documents of the
block in which its token budget ends. A cut is one row per source (a block's and a document's place in
their permutations), so documents are selected where they lie: no text is shuffled, and a source with a
third of all rows is no group of its own anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from handspan.llm.shared import column, dropped, folded, numbered, place, stored
from handspan.llm.token_counts import token_counts

#: Sources up to which the source table is held by the driver and broadcast; beyond it it stays a table.
HELD_SOURCES = 10_000
BLOCK_DOCS = 1024
#: Points of a round of the bisection, and its rounds: 16 ** 15 parts of the interval, one job each where sources are many.
POINTS, ROUNDS = 15, 15


def bisect(holds: Callable[[list[float]], list[bool]], low: float, high: float, rounds: int = ROUNDS, points: int = POINTS) -> float:
    """The largest t in [low, high] for which `holds`, where it holds for all smaller ones (low if for none).

    Each round asks for several points of the interval at once and goes on between the last that holds and the next.
    """
    if holds([high])[0]:
        return high
    for _ in range(rounds):
        at = [low + (high - low) * k / (points + 1) for k in range(1, points + 1)]
        good = holds(at)
        k = next((i for i, g in enumerate(good) if not g), points)
        low, high = (at[k - 1] if k else low), (at[k] if k < points else high)
    return low


def _moments(sources: DataFrame, held: bool) -> Callable[[list[float]], list[tuple[float, float]]]:
    """exponents t -> (sum of share**t, entropy in bits of the weights) of each."""
    entropy = lambda t, z, s: math.log2(z) - t * s / z  # noqa: E731  of weights share**t / z, s the sum of share**t * log2(share)
    if held:
        shares = [r[0] for r in sources.where("share > 0").select("share").collect()]

        def at(ts):
            z = [(t, math.fsum(s**t for s in shares), math.fsum(s**t * math.log2(s) for s in shares)) for t in ts]
            return [(zt, entropy(t, zt, st)) for t, zt, st in z]

        return at
    cut = stored(sources.where("share > 0").select("share"), "shares")

    def at(ts):
        p = [F.pow("share", F.lit(t)) for t in ts]
        row = cut.agg(*[F.sum(x).alias(f"z{i}") for i, x in enumerate(p)], *[F.sum(x * F.log2("share")).alias(f"s{i}") for i, x in enumerate(p)]).first()
        return [(row[i], entropy(t, row[i], row[len(ts) + i])) for i, t in enumerate(ts)]

    return at


def _source(column):
    """A join key for a source; null is a source of its own."""
    return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), column.cast("string")))


def mixture(docs: DataFrame, tokenizer: str, entropy: float = 0.95, repeats: float = 4.0, budget: int | None = None, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The plan, one row per source: src, n_docs, n_tokens, share, weight, target, epochs, cut_block, cut_doc, n_blocks, exponent.

    entropy: target as a part of the largest possible (log2 of the sources with tokens). repeats: most
    epochs of any source within the budget. budget: tokens in all; None takes the least that uses every
    source whole at least once. A source without tokens takes one epoch. An empty table has no rows.
    """
    counted = token_counts(docs.select(column(key).alias("k"), column(source).alias("s"), column(text).alias("text")), tokenizer, keep=["k", "s"])
    counted = stored(counted.select(F.col("k").alias("key"), _source(F.col("s")).alias("src"), "n_tokens"), "mixing-tokens")
    sources = counted.groupBy("src").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sources = per_source = stored(sources, "mixing-sources")
    total, n = sources.agg(F.sum("n_tokens"), F.count("*")).first()
    total = total or 0
    held = n <= HELD_SOURCES
    sources = sources.withColumn("share", F.col("n_tokens") / F.lit(float(total or 1)))
    t, z, size = 1.0, 1.0, float(total)
    if total:
        at = _moments(sources, held)
        with_tokens, top, bottom = sources.where("share > 0").agg(F.count("*"), F.max("share"), F.min("share")).first()
        goal = entropy * math.log2(with_tokens) if with_tokens > 1 else 0.0

        # powers grow with the share, so the extremes are those of the largest and the smallest share
        def least(x, z_x):  # the budget at this exponent
            return float(budget) if budget is not None else total * top ** (1 - x) * z_x

        def repeated(x, z_x):  # the most epochs of a source
            return bottom ** (x - 1) / z_x * least(x, z_x) / total

        t = bisect(lambda xs: [h >= goal for _, h in at(xs)], 0.0, 1.0)
        if repeated(t, at([t])[0][0]) > repeats:
            t = 1 - bisect(lambda ys: [repeated(1 - y, z_y) <= repeats for y, (z_y, _) in zip(ys, at([1 - y for y in ys]), strict=True)], 0.0, 1 - t)
        z = at([t])[0][0]
        size = least(t, z)
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(t)) / z).otherwise(0.0)
    plan = (
        sources.withColumn("weight", weight)
        .withColumn("exponent", F.lit(t))
        .withColumn("target", F.round(F.col("weight") * size).cast("long"))
        .withColumn("epochs", F.when(F.col("n_tokens") > 0, F.floor(F.col("target") / F.greatest("n_tokens", F.lit(1)))).otherwise(1).cast("long"))
        .withColumn("rest", F.when(F.col("n_tokens") > 0, F.col("target") - F.col("epochs") * F.col("n_tokens")).otherwise(0))
        .withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("long"))
    )
    plan = stored(plan, "mixing-plan")
    small = (lambda d: F.broadcast(d)) if held else (lambda d: d)
    dealt = counted.join(small(plan.select("src", "epochs", "rest", "n_blocks")), "src").where("rest > 0")
    dealt = dealt.withColumn("block", _block(seed)).withColumn("block_place", _block_place(seed, F.col("epochs"))).withColumn("doc_place", _doc_place(seed, F.col("epochs")))
    per_block = dealt.groupBy("src", "block", "block_place", "rest").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.partitionBy("src").orderBy("block_place", "block").rowsBetween(Window.unboundedPreceding, -1)
    cut = per_block.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0))).where("before < rest and before + tokens >= rest")
    cut = cut.groupBy("src").agg(F.min_by(F.struct("block", "block_place", "before"), "block_place").alias("c")).select("src", "c.*")
    inside = dealt.join(small(cut), ["src", "block", "block_place"])
    order = Window.partitionBy("src").orderBy("doc_place").rangeBetween(Window.unboundedPreceding, -1)  # one block of each source
    inside = inside.withColumn("done", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)) + F.col("before")).where("done < rest")
    cut = inside.groupBy("src").agg(F.max("block_place").alias("cut_block"), F.max("doc_place").alias("cut_doc"))
    cuts = stored(plan.join(cut, "src", "left").drop("rest"), "mixing-cuts")
    dropped(counted, per_source, plan)
    return cuts


def _block(seed: int):
    return F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.col("n_blocks"))


def _block_place(seed: int, epoch):
    return F.xxhash64(F.col("src"), F.col("block"), epoch.cast("long"), F.lit(seed))


def _doc_place(seed: int, epoch):
    return F.xxhash64(F.col("key"), epoch.cast("long"), F.lit(seed + 1))


def mix(docs: DataFrame, plan: DataFrame, seed: int = 7, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of docs as often as the plan takes them, with mix_epoch, mix_block (its place) and mix_place.

    Read in order of (mix_epoch, mix_block, mix_place) a source's rows are its block permutations. Rows
    of a source that is not in the plan don't appear; repeated rows of docs are taken like any other; a null key
    is dealt like any other value, a null source is a source; an empty table gives no rows. Columns that clash with
    the three new names, by the session's rule of case, are replaced, and any other name may occur.
    """
    held = plan.count() <= HELD_SOURCES
    own = plan.select("src", F.col("epochs").alias("_epochs"), "n_blocks", "cut_block", "cut_doc")
    new = ("mix_epoch", "mix_block", "mix_place")
    fold = folded(docs.sparkSession)
    kept = [(i, c) for i, c in enumerate(docs.columns) if fold(c) not in new]
    d = numbered(docs).select(F.struct(*[f"c_{i}" for i, _ in kept]).alias("row"), F.col(f"c_{place(docs, key)}").alias("key"), _source(F.col(f"c_{place(docs, source)}")).alias("src"))
    d = d.join(F.broadcast(own) if held else own, "src").withColumn("block", _block(seed))
    last = _block_place(seed, F.col("_epochs"))
    taken = F.col("cut_block").isNotNull() & ((last < F.col("cut_block")) | ((last == F.col("cut_block")) & (_doc_place(seed, F.col("_epochs")) <= F.col("cut_doc"))))
    n = F.col("_epochs") + F.when(taken, 1).otherwise(0)
    d = d.where(n > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return d.select(*[F.col(f"row.c_{i}").alias(c) for i, c in kept], F.col("epoch").alias("mix_epoch"), _block_place(seed, F.col("epoch")).alias("mix_block"), _doc_place(seed, F.col("epoch")).alias("mix_place"))
