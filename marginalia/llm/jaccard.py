"""Operator 1: n-gram Jaccard join in the metric space of shingle sets.

Documents link when 4 * |x & y| >= 3 * |x | y|, a Jaccard distance of 0.25 or less.

* Equal sets are one point; only the least id of each goes on.
* First pivots are single shingles.  A set is nearest to the pivots of its own
  shingles, which are its Voronoi regions.  By the triangle inequality a set
  within 0.25 lacks a quarter of x's shingles at most, so of any order that all
  sets share, the first floor(n / 4) + 1 shingles of two linked sets have one in
  common: that window says into which regions a set must be replicated.  The
  order takes rare shingles before those seen to be frequent, these by their
  counts' powers of two, then goes by hash.
  Any order gives the same links; a good one keeps regions small.  Regions with
  the same members are one.
* A window within a region: with ``reach`` shingles from the region's on to the
  last, two members share that many at most if the region is of the first
  shingle that they share, and linked ones share three sevenths of their sizes'
  sum.  So 7 * min(reach) >= 3 * (n + m), or the pair is left to another region
  or to none; a member that no size in its region allows leaves it at once.
  Documents of one frame, alike but for a part of their own, have no pairs.
* A region of ``LEAST`` members or fewer compares pairs of different components.
  A larger one takes ``PIVOTS`` documents of different components as pivots, and
  the members' distances to them are computed.  Those within 0.25 are linked.
* The pivots divide the region.  In their order, a member within 0.5 of one goes
  to its part, and one within 0.25 to no later one; those within 0.25 of none
  are the rest.  Of two linked members the first that a pivot takes within 0.25
  has the other within 0.5 of it (the triangle inequality), so every pair meets
  again.  Where a distance is not known the member goes to both.  Pivots have
  met all members and leave.
* A part with several components left is a region of its own, with its members'
  reach, and is joined in the same way.  A part that is no smaller than
  three quarters of its region is not worth more pivots: metric distances say
  no more about it.  Its pairs within the window are compared, in blocks.
* Before a distance is computed, both sets' distances to ``CLASSES`` more pivots -
  classes of the shingles, told by their hash - bound it from below.

Distances are computed on whole sets of 64-bit shingle hashes.  Links join
components that are known, so only new ones are walked.

Each case has a result: null and empty texts and texts without words have no
shingles and link with nothing; with one to four words the whole sequence is one
shingle; equal texts link; rows that share an id count as linked; a null id is
its own row with a null component; no documents give no rows.  Other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import mapped, own_columns, written
from .components import joined_components
from .repeats import _SPACE, Hasher, buffers, mix, small_or_shuffled

SHINGLE = 5
#: Members of a region that are compared with each other, and pivots of a larger one.
LEAST, PIVOTS = 16, 4
#: Rows of a region that is dealt out further, as a power of two, and members of a block of pairs.
DEAL, BLOCK = 17, 1000
#: Classes of shingles.
CLASSES = 256
#: Numbers in a side of a join that is sent to all tasks; a larger one is shuffled.
SMALL = 500_000
#: A shingle in this many sets of one task, and in this many in all, is put last; at most so many shingles are.
SEEN, OFTEN, HOT = 2, 2, 1_000_000

_CLASS = np.uint64(64 - CLASSES.bit_length() + 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd numbers that tell a word's place in a shingle (fixed values).
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text in a buffer."""
    n = len(data)
    data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], solid[:-1]]) if n else solid
    after = np.concatenate([solid[1:], [False]]) if n else solid
    lo = np.flatnonzero(solid & (~before | edge[:n]))
    hi = np.flatnonzero(solid & (~after | edge[1:])) + 1
    word = Hasher(data, 1).of(0, lo, hi)
    first = np.searchsorted(lo, bounds)
    sums = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        sums += word[k : k + len(sums)] * _STEPS[k]
    sums = mix(sums)
    out = []
    for f, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - f >= SHINGLE:
            out.append(np.unique(sums[f : e - SHINGLE + 1]))
        elif e > f:
            out.append(mix((word[f:e] * _STEPS[: e - f]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - f)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sets(batches: Iterator) -> Iterator[tuple]:
    """Ids (an Arrow array, as they may be null) and shingle sets of (text, doc_id) batches, a buffer of texts at a time."""
    for b in batches:
        for lo, hi, data, bounds in buffers(b.column(0)):
            yield b.column(1).slice(lo, hi - lo), shingle_sets(data, bounds)


def points(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, n, s1, s2, classes) of each document's set, and (hot shingle, sets with it) of each task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n", "s1", "s2", "classes", "hot"]
        seen: set[tuple[int, int, int]] = set()
        kept: list[np.ndarray] = []
        size = 0

        def frequent():
            shingle, count = np.unique(np.concatenate(kept), return_counts=True)
            some = count >= SEEN
            return pa.RecordBatch.from_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(count[some]), *(pa.nulls(int(some.sum()), t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array(shingle[some].view(np.int64))], names)

        for ids, sets in _sets(batches):
            n = np.array([len(s) for s in sets], np.int64)
            s1 = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64)
            s2 = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            classes = [np.minimum(np.bincount((s >> _CLASS).view(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(classes, pa.binary()), pa.nulls(len(n), pa.int64())], names)
            for s, *sig in zip(sets, n.tolist(), s1.tolist(), s2.tolist()):
                if tuple(sig) not in seen:
                    seen.add(tuple(sig))
                    kept.append(s)
                    size += len(kept[-1])
            if size > 2_000_000:
                yield frequent()
                kept, size, seen = [], 0, set()
        if kept:
            yield frequent()

    return mapped(docs.select("text", "doc_id"), run, "doc_id long, n long, s1 long, s2 long, classes binary, hot long")


def first_regions(docs: DataFrame, hot: np.ndarray, level: np.ndarray) -> DataFrame:
    """(region, deal, dealt, doc_id, n, reach) of each document's window of shingle pivots; ``level`` orders the sorted ``hot`` ones after all others.

    A region whose shingle is in 2 ** DEAL sets or more is dealt to several places.
    """
    last = docs.sparkSession.sparkContext.broadcast((hot, level))  # HOT numbers at most

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hot, level = last.value
        for ids, sets in _sets(batches):
            tokens, deals, own, sizes = [], [], [], []
            for doc, s in zip(ids.to_pylist(), sets):
                if not len(s):
                    continue
                want = len(s) // 4 + 1
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    often = np.where(hot[at] == s, level[at], 0)
                    first = np.argsort(often, kind="stable")[:want]
                    tokens.append(s[first])
                    deals.append(np.maximum(often[first].astype(np.int64) - DEAL, 0))
                else:
                    tokens.append(s[:want])
                    deals.append(np.zeros(want, np.int64))
                own.append(doc)
                sizes.append(len(s))
            if tokens:
                k = np.array([len(t) for t in tokens])
                doc, n = np.repeat(np.array(own, np.int64), k), np.repeat(np.array(sizes, np.int32), k)
                place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                bits = np.concatenate(deals)
                deal = mix(doc.view(np.uint64)).view(np.int64) & ((1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(deal.astype(np.int32)), pa.array(bits > 0), pa.array(doc), pa.array(n), pa.array((n - place).astype(np.int32))], ["region", "deal", "dealt", "doc_id", "n", "reach"])

    return mapped(docs.select("text", "doc_id"), run, "region long, deal int, dealt boolean, doc_id long, n int, reach int")


def distances(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union of each pair's sets."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set"])

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            both, either = [], []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                n = int((y[at] == x).sum()) if len(y) else 0
                both.append(n)
                either.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = written(mapped(docs.join(small_or_shuffled(ids, F.lit(1), SMALL), "doc_id").select("text", "doc_id"), pack, "doc_id long, set binary"), "sets")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    return mapped(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y"), measure, "a long, b long, both long, either long")


#: A link, and a distance of 0.5 or less.
_LINKED, _NEAR = "100 * both >= 75 * either", "2 * both >= either"


def screened(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with what sizes and classes allow: may_link, may_near.

    Two sets' counts in a class differ by what the sets do not share at least,
    and at a Jaccard distance of d they do not share d / (2 - d) of their sizes'
    sum at most.  Counts stop at 255, which only makes a difference smaller.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16) for i in (2, 3))
            n, m = b.column(4).to_numpy(), b.column(5).to_numpy()
            apart = np.maximum(np.abs(x - y).sum(1), np.abs(n - m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(7 * apart <= n + m), pa.array(3 * apart <= n + m)], ["a", "b", "may_link", "may_near"])

    of = lambda end, c, n: sets.select(F.col("doc_id").alias(end), F.col("classes").alias(c), F.col("n").alias(n))
    both = pairs.join(of("a", "x", "n"), "a").join(of("b", "y", "m"), "b").select("a", "b", "x", "y", "n", "m")
    # An id that stands for several sets may have several rows here.
    return mapped(both, run, "a long, b long, may_link boolean, may_near boolean").groupBy("a", "b").agg(F.max("may_link").alias("may_link"), F.max("may_near").alias("may_near"))


#: Whether members x and y of a region may be linked, if the region's is the first shingle that they share.
_WINDOW = "7 * least(x.reach, y.reach) >= 3 * (x.n + y.n)"


def _distinct_regions(rows: DataFrame) -> DataFrame:
    """(region, doc_id, n, reach) of regions with members whose sizes allow a pair, of equal regions one.

    The rows move once, and those of shingles that no other document has, or
    whose reach no size in the region allows, end there.
    """
    own = W.partitionBy("region", "deal")
    level = {"members": F.count("*").over(own), "least_n": F.min("n").over(own), "sum_n": F.sum("n").over(own), "least_reach": F.min("reach").over(own)}
    fits = "CASE WHEN members > 2 THEN 7 * reach >= 3 * (n + least_n) WHEN members = 2 THEN 7 * least_reach >= 3 * sum_n ELSE false END"
    some = written(rows.repartition("region", "deal").withColumns(level).filter(f"dealt or {fits}").groupBy("region", "doc_id").agg(F.min("n").alias("n"), F.max("reach").alias("reach")), "members")
    found = some.groupBy("region").agg(F.count("*").alias("size"), F.min("doc_id").alias("p"), F.max("doc_id").alias("q"), F.bit_xor(F.xxhash64("doc_id")).alias("x")).filter("p < q")
    same = found.join(found.groupBy("size", "p", "q", "x").agg(F.min("region").alias("first")), ["size", "p", "q", "x"]).select("region", "first")
    # Of regions with the same members the widest reach counts, which only adds pairs.
    return some.join(same, "region").groupBy(F.col("first").alias("region"), "doc_id").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))


def _compared(docs: DataFrame, sets: DataFrame, pairs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, linked, near) of pairs, near where it may be, and the components with their links."""
    asked = written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "asked")
    if asked.isEmpty():
        return docs.sparkSession.createDataFrame([], "a long, b long, linked boolean, near boolean"), known
    seen = written(screened(asked, sets), "screened")
    measured = distances(docs, seen.filter("may_link").select("a", "b")).groupBy("a", "b").agg(F.max(F.expr(_LINKED)).alias("linked"), F.max(F.expr(_NEAR)).alias("near"))
    out = seen.join(measured, ["a", "b"], "left").select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("near", "may_near").alias("near"))
    out = written(out, "compared")
    links = out.filter("linked").select("a", "b")
    return out, known if links.isEmpty() else joined_components(known, links)


def _placed(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members with their component, and the size, of regions that have several components."""
    every = members.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = every.groupBy("region").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("size")).filter("c1 <> c2").select("region", "size")
    return every.join(several, "region")


def _pairs(placed: DataFrame) -> DataFrame:
    """Pairs (x, y) of members of one region and different components within the window; a large region's in blocks."""
    last = f"(size - 1) div {BLOCK}"
    row = F.struct("doc_id", "component", "n", "reach")
    left = placed.select("region", F.expr(f"pmod(xxhash64(doc_id), {last} + 1)").alias("block"), row.alias("x"))
    right = placed.select("region", F.explode(F.expr(f"sequence(0L, {last})")).alias("block"), row.alias("y"))
    return left.join(right, ["region", "block"]).filter(f"x.doc_id < y.doc_id and x.component <> y.component and {_WINDOW}").select(F.col("x.doc_id").alias("x"), F.col("y.doc_id").alias("y")).distinct()


def _round(docs: DataFrame, sets: DataFrame, members: DataFrame, known: DataFrame, pivots: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Components after the regions' members have met their pivots, or each other, and the parts that are left.

    ``members`` has (region, doc_id, n, reach), and ``before``: what the size of
    the region was that a part comes from, or null.
    """
    open_ = written(_placed(members, known), "open")
    divided = (F.col("size") > least) & (F.col("before").isNull() | (4 * F.col("size") < 3 * F.col("before")))
    large = open_.filter(divided)
    # Components are dealt to the pivots' places, and regions that overlap choose alike, so that they ask for the same distances.
    own = large.groupBy("region", F.pmod(F.xxhash64("component", F.lit(1)), F.lit(pivots)).alias("salt")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(2)), "doc_id", "component")).alias("p"))
    own = written(own.select("region", "salt", F.col("p.doc_id").alias("pivot"), F.col("p.component").alias("c")), "pivots")
    met = large.join(small_or_shuffled(own, F.lit(4), SMALL), "region").filter("doc_id <> pivot")
    met = written(met.select("region", "size", "salt", F.col("doc_id").alias("x"), F.col("pivot").alias("y"), (F.col("component") == F.col("c")).alias("same")), "met")
    # What is small, and what pivots do not make smaller, is compared pair by pair, together with the pivots.
    compared, known = _compared(docs, sets, met.filter("not same").select("x", "y").unionByName(_pairs(open_.filter(~divided))), known)
    if met.isEmpty():
        return known, None

    # Parts.  Whether a member is within a pivot's 0.25 or 0.5 is not known where one component has both.
    ends = met.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    near = ends.join(compared, ["a", "b"], "left").filter("same or near").groupBy("region", "salt", F.col("x").alias("doc_id")).agg(F.max(F.coalesce("linked", F.lit(False))).alias("linked"), F.max("same").alias("same"))
    first = near.filter("linked").groupBy("region", "doc_id").agg(F.min("salt").alias("first"))
    # A part in which no member is within 0.25 of its pivot has no pair that the rest has not.
    takes = near.groupBy("region", "salt").agg(F.max(F.expr("linked or same")).alias("takes")).filter("takes").select("region", "salt")
    left = large.select("region", "doc_id", "n", "reach", "size").join(own.select("region", F.col("pivot").alias("doc_id")), ["region", "doc_id"], "left_anti")
    inside = near.join(takes, ["region", "salt"]).join(first, ["region", "doc_id"], "left").filter("first is null or salt <= first").select("region", "doc_id", "salt").join(left, ["region", "doc_id"])
    outside = left.join(first, ["region", "doc_id"], "left_anti").withColumn("salt", F.lit(-1).cast("long"))
    part = lambda df: df.select(F.xxhash64("region", "salt").alias("region"), "doc_id", "n", "reach", F.col("size").alias("before"))
    return known, written(part(inside).unionByName(part(outside)), "parts")


def joined(docs: DataFrame, pivots: int = PIVOTS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    base = own_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = written(points(base), "points")
    own = rows.filter("hot is null").select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2")
    sets = rows.filter("hot is null and doc_id is not null and n > 0").select("doc_id", "n", "classes")
    counts = rows.filter("hot is not null").groupBy("hot").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    often = counts.orderBy(F.desc("n"), "hot").limit(HOT).select("hot", F.log2("n").cast("byte").alias("level")).toArrow()
    hot, level = often.column("hot").to_numpy().view(np.uint64), often.column("level").to_numpy()
    order = np.argsort(hot)
    hot, level = hot[order], level[order]

    # The least id of equal sets stands for them; an id with several sets links what stands for them.
    real = own.filter("doc_id is not null and n_shingles > 0")
    lowest = real.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    stands = written(real.join(lowest, ["n_shingles", "s1", "s2"]).select("doc_id", "rep").distinct(), "stands")
    home = stands.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("high"), F.max(F.expr("doc_id = rep")).alias("itself"))
    several = stands.join(home.filter("rep <> high").select("doc_id", F.col("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
    known = joined_components(None, several)
    others = small_or_shuffled(written(home.filter("not itself").select("doc_id"), "others"), F.lit(1), SMALL)
    texts = base.filter("doc_id is not null")
    members = written(_distinct_regions(first_regions(texts.join(others, "doc_id", "left_anti"), hot, level)), "regions").withColumn("before", F.lit(None).cast("long"))
    while members is not None:
        known, members = _round(texts, sets, members, known, pivots, least)
    of = home.select("doc_id", "rep").join(known.select(F.col("doc_id").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    return own.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
