"""Merkle fixity audit of WARC replicas, in DataFrame functions only.

A table of pages stands for an archive of WARC resource records in order of their slots (page ids). A
record's leaf is the SHA-256 of its bytes; a slot's leaf digests all records of the slot, whatever their order,
from sums that merge, so a slot that very many rows share is summed before the exchange. A node covers FAN
consecutive slots, then FAN nodes, and so on: it has its records, its bytes, and the digest of its children in order,
each with its place, records, bytes and digest, so that it vouches for the offset range of every child; up to one
root. Each level is a table, made from the one below. Replicas are compared from the root down; only children of
nodes that differ are looked at, and the leaves that are left are the damaged slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from handspan.llm.shared import dropped, stored

FAN = 16
#: Slots in one archive file; offsets start anew in each.
FILE_SLOTS = 4096


def record(url: Column, page_id: Column, html: Column) -> Column:
    """The bytes of a page's WARC record."""
    body = F.coalesce(html.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def leaves(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(node, records, size, digest): one row per slot. A null id is slot -1; null texts count as empty."""
    r = pages.select(F.coalesce(pages[key].cast("long"), F.lit(-1)).alias("node"), record(pages[url], pages[key], pages[html]).alias("r"))
    r = r.select("node", F.octet_length("r").cast("long").alias("size"), F.sha2("r", 256).alias("h"))
    limbs = [F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(5)]
    return r.groupBy("node").agg(F.count("*").alias("records"), F.sum("size").alias("size"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *limbs), 256).alias("digest"))


def _above(node: str, width: int):
    """The floor of node / width in whole numbers: exact for every 64-bit id."""
    return F.expr(f"({node} div {width}) - if(pmod({node}, {width}) != 0 and {node} < 0, 1, 0)")


def tree(leaf_rows: DataFrame, levels: int) -> list[DataFrame]:
    """The levels of the tree, leaves first; each has (node, records, size, digest)."""
    out = [leaf_rows]
    for _ in range(levels):
        up = out[-1].withColumn("child", F.col("node")).withColumn("node", _above("node", FAN))
        digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "records", "size", "digest"))), lambda c: F.concat_ws(":", c["child"].cast("string"), c["records"].cast("string"), c["size"].cast("string"), c["digest"])), "\n"), 256)
        level = up.groupBy("node").agg(F.sum("records").alias("records"), F.sum("size").alias("size"), digest.alias("digest"))  # at most FAN children
        out.append(stored(level, "tree-level"))
    return out


def audit(primary: DataFrame, replica: DataFrame, **names) -> DataFrame:
    """The slots in which two archives differ: slot, status (changed, missing, extra), file, offset and size in the primary, records, replica_size, the two digests.

    A slot that only the replica holds has no file, offset or size. Equal archives, and two empty ones, give no rows.
    Pages with a null id share slot -1; null texts count as empty; records of one slot count in any order, repeated ones
    each time; a very long text is one record. Other columns are not read.
    """
    a, b = stored(leaves(primary, **names), "leaves"), stored(leaves(replica, **names), "replica-leaves")
    top = max((r[0] or 0) for r in (a.agg(F.max("node")).first(), b.agg(F.max("node")).first()))
    levels = 1
    while FAN**levels <= top:
        levels += 1
    ours, theirs = tree(a, levels), tree(b, levels)
    suspects, used = None, []
    for x, y in zip(ours[::-1], theirs[::-1], strict=True):
        if suspects is not None:
            x, y = (t.withColumn("above", _above("node", FAN)).join(suspects, "above", "left_semi").drop("above") for t in (x, y))
        y = y.select("node", F.col("records").alias("replica_records"), F.col("size").alias("replica_size"), F.col("digest").alias("replica_digest"))
        differ = x.join(y, "node", "full").where(~F.col("digest").eqNullSafe(F.col("replica_digest")))
        last = stored(differ, "differing-nodes")
        used.append(last)
        suspects = last.select(F.col("node").alias("above"))
    dropped(*ours[1:], *theirs, *used[:-1])
    file = _above("node", FILE_SLOTS)
    before = Window.partitionBy("file").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # at most FILE_SLOTS slots
    places = a.withColumn("file", file).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")).select("node", "file", "offset")
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("replica_digest").isNull(), "missing").otherwise("changed")
    out = last.join(places, "node", "left")
    return out.select(F.col("node").alias("slot"), status.alias("status"), "file", "offset", "size", "records", "replica_size", "digest", "replica_digest")
