"""Connected components of an edge table, without gathering any group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (a, b); component is the least id reachable.

    Alternating stars: in turn, each node's larger and smaller neighbours are
    linked to its least one, until nothing changes; the number of rounds grows
    with the logarithm of the longest path.  Least neighbours are aggregates
    that combine before they move, and joins with them split hot nodes.  Null
    ends, loops and repeated edges count for nothing; no edges give no rows.
    """
    now, mark = _marked(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now, new = _marked(small)
        if new == mark:
            break
        mark = new
    # Every edge now points from a node to the least of its component.
    least = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return least.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def joined_components(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(doc_id, component) after ``links`` (a, b) are added to ``known``, which has the same columns.

    Links are moved to the components that their ends are known to have, so only
    what joins two components is walked.  An id in neither is its own component.
    """
    if known is None:
        return written(components(links).select(F.col("id").alias("doc_id"), "component"), "components")
    of = lambda end: known.select(F.col("doc_id").alias(end), F.col("component").alias(f"of_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(ends).select(F.col("id").alias("component"), F.col("component").alias("least"))
    before = known.join(moved, "component", "left").select("doc_id", F.coalesce("least", "component").alias("component"))
    new = moved.select(F.col("component").alias("doc_id"), F.col("least").alias("component"))
    return written(before.unionByName(new).groupBy("doc_id").agg(F.min("component").alias("component")), "components")


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and an order-free hash of them.

    The two are read from what was written, as an observation of the write would
    stay with the session, which fitted models must be able to carry along.
    """
    now = written(edges, "edges")
    r = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return now, (r.n, r.x)
