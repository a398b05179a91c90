"""Connected components of a link table by alternating large-star and small-star.

Large-star gives every larger neighbour of a node the node's smallest neighbour; small-star links a node's
smaller neighbours to the smallest of them. The two alternate until nothing changes; then every node links
to the smallest of its component. Each half round ends in a table in the shared folder, so the lineage stays
short and a lost executor costs one step; tables that have been used are deleted. The minima that a half round joins
are few (Spark broadcasts them), or a table of their own too, so that Spark can split the join at a node with very
many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from handspan.llm.shared import dropped, stored


#: Links from which the minima are tables of their own.
MANY_LINKS = 500_000


def _print(links: DataFrame) -> tuple[int, int]:
    n, h = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, int(h or 0)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) of every node of a link between two different nodes; component is its smallest node.

    Links with a null end or with both ends equal are left out; repeated links count once; no links
    give no rows. The result is a table in the shared folder.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    e = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct()
    e = stored(e, "links")
    last = _print(e)
    while last[0]:
        used = [e]

        def kept(df, name):
            used.append(stored(df, name))
            return used[-1]

        keep = kept if last[0] >= MANY_LINKS else lambda df, _: df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "large-star-minima")
        large = kept(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "small-star-minima")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        dropped(*used)
        now = _print(e)
        if now == last:
            break
        last = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = stored(found.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
    dropped(e)
    return found
