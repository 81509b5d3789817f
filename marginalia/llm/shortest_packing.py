"""Operator 13: shortest-pack-first packing over the histogram of lengths.

Documents are tokenised where they lie, and cut only where they are longer than
a sequence.  How many pieces there are of each length - at most ``size`` numbers -
goes to the driver, which plans on counts: lengths come longest first, and go to
the packs that are filled least.  Packs of one pattern of lengths are one entry
with a number, split when only some of them take a piece; so the plan grows with
lengths and patterns, not with documents.

What room is left would be padding.  So the packs filled least are taken apart
again, as many as the room asks for, and their pieces are cut to fill the rest;
what is left over of them makes sequences of powers of two, which need no
padding.  Only documents of those packs, in all as many tokens as there was room
for, and the over-long are cut.

Pieces join their pattern's place on rank within length.  The cut ones, a few in
a thousand, are tokenised once more for their parts' checksums.

Each case has a result: null text counts as empty and still has its end id;
repeated rows are packed each; rows with one id, or none, keep apart by their
tokens; pieces of equal length are ranked by a salt, then the id, the piece and
the checksum; no documents give no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F

from . import tokens
from .common import mapped, own_columns, written
from .repeats import small_or_shuffled

SIZE, END_ID = 4096, 2
#: Parts at least into which the pieces of one length are dealt for ranking, pieces a part in the mean beyond that, and ranks that look for their place together.
SALTS, PART, RANKS = 64, 100_000, 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_crc32 long"
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def shortest_first(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """Places of whole pieces, the packs that have room, and the number of packs.

    A place (length, first rank, number, first sequence, offset) says: the
    pieces of this length with ranks from ``first rank`` on, ``number`` of them,
    go one each to successive sequences.  A pack entry is (filled, first
    sequence, number).
    """
    packs: dict[int, list[tuple[int, int]]] = {}
    filled: list[int] = []
    places, used = [], 0

    def put(fill: int, first: int, n: int) -> None:
        if fill < size and n:
            if fill not in packs:
                packs[fill] = []
                insort(filled, fill)
            packs[fill].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            if filled and filled[0] + length <= size:
                fill = filled[0]
                first, n = packs[fill].pop()
                if not packs[fill]:
                    del packs[fill], filled[0]
                take = min(n, todo)
                put(fill, first + take, n - take)
                put(fill + length, first, take)
                places.append((length, rank, take, first, fill))
            else:
                # New packs; those that follow of this length go to the shortest of them.
                each = min(size // length, todo)
                n = todo // each
                places += [(length, rank + k * n, n, used, k * length) for k in range(each)]
                put(each * length, used, n)
                take, used = each * n, used + n
            rank, todo = rank + take, todo - take
    return places, [(fill, first, n) for fill in filled for first, n in sorted(packs[fill])], used


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple], list[tuple]]:
    """Places of whole pieces, and of pieces that are cut.

    Cut pieces lie in a row, and so does the room they fill.  A row (length,
    first rank, number, first place, room's first place, room, number of rooms,
    first sequence, offset) has pieces and rooms that meet.
    """
    places, packs, used = shortest_first(counts, size)
    packs = [p for p in packs if p[0] & (p[0] - 1)]  # a power of two has no padding
    # A pack that is taken apart has its own room no more and fills its tokens' worth of the others'.
    apart = -(-sum((size - fill) * n for fill, _, n in packs) // size)
    gone, rooms = [], []
    for fill, first, n in packs:
        k = min(n, apart)
        apart -= k
        if k:
            gone.append((first, first + k))
        if n > k:
            rooms.append((size - fill, n - k, first + k, fill))
    gone.sort()
    whole, cut = [], []
    for length, rank, n, first, offset in places:
        at, end, k = first, first + n, max(0, bisect_right(gone, (first, used + 1)) - 1)
        while at < end:
            while k < len(gone) and gone[k][1] <= at:
                k += 1
            lo, hi = gone[k] if k < len(gone) else (end, end)
            if lo > at:
                whole.append((length, rank + at - first, min(lo, end) - at, at, offset))
            if lo < end:
                cut.append((length, rank + max(lo, at) - first, min(hi, end) - max(lo, at)))
            at = min(hi, end)
    # Long pieces to wide rooms, so that there are few cuts.
    cut.sort(reverse=True)
    rooms.sort(reverse=True)
    left = sum(length * n for length, _, n in cut) - sum(room * n for room, n, _, _ in rooms)
    for bit in reversed(range(size.bit_length())):
        if left >> bit & 1:
            rooms.append((1 << bit, 1, used, 0))
            used += 1
    rows, y, at = [], 0, iter(rooms)
    room, n, first, offset = next(at, (0, 0, 0, 0))
    x = 0
    for length, rank, number in cut:
        while True:
            lo, hi = max(x, y), min(x + length * number, y + room * n)
            a, b = (lo - x) // length, (hi - 1 - x) // length
            rows.append((length, rank + a, b - a + 1, x + a * length, y, room, n, first, offset))
            if y + room * n < x + length * number:
                y += room * n
                room, n, first, offset = next(at)
            else:
                break
        x += length * number
        if y + room * n == x:
            y = x
            room, n, first, offset = next(at, (0, 0, 0, 0))
    return whole, rows


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """Every document's pieces of ``size`` tokens at most, with the checksums of piece and document; a narrow job."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder = tokens.encoder(vocabulary, "word")
        for b in batches:
            for lo, hi in tokens.slices(b.column(1)):
                ids, starts = coder.batch(b.column(1).slice(lo, hi - lo))
                rows = []
                for doc, i, j in zip(b.column(0).slice(lo, hi - lo).to_pylist(), starts[:-1], starts[1:]):
                    x = np.append(ids[i:j], np.uint32(end_id)).astype("<u4")
                    whole = zlib.crc32(x)
                    rows += [(doc, at, min(size, len(x) - at), whole if len(x) <= size else zlib.crc32(x[at : at + size]), len(x), whole) for at in range(0, len(x), size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [*COLUMNS, "doc_crc32"])

    return mapped(own_columns(docs, "doc_id", "text"), run, SCHEMA)


def parts_of_cut(docs: DataFrame, cut: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """The parts of pieces that are cut, with their checksums.

    ``cut`` has a row for each piece: doc_id, doc_tokens, doc_crc32 and ``parts``.
    Texts meet them on the id, and those of another document with that id are
    told by their tokens.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder = tokens.encoder(vocabulary, "word")
        for b in batches:
            for lo, hi in tokens.slices(b.column(1)):
                ids, starts = coder.batch(b.column(1).slice(lo, hi - lo))
                rows = []
                doc, n, crc, parts = (b.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 2, 3, 4))
                for k, (i, j) in enumerate(zip(starts[:-1], starts[1:])):
                    x = np.append(ids[i:j], np.uint32(end_id)).astype("<u4")
                    if len(x) == n[k] and zlib.crc32(x) == crc[k]:
                        rows += [(doc[k], p["start"], p["length"], zlib.crc32(x[p["start"] : p["start"] + p["length"]]), n[k], p["sequence_id"], p["offset"]) for p in parts[k]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [*COLUMNS, "sequence_id", "offset"])

    texts = own_columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = cut.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "doc_id", "doc_tokens", "doc_crc32", "parts")
    ids = small_or_shuffled(written(wanted.select("id", "none").distinct(), "cut-ids"), F.lit(1))
    few = texts.join(ids, ["id", "none"], "left_semi").dropDuplicates()
    both = few.join(wanted, ["id", "none"]).select("doc_id", "text", "doc_tokens", "doc_crc32", "parts")
    return mapped(both, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and offset.

    Pieces of ``size`` are sequences of their own, numbered below zero where
    they lie; only shorter ones are counted, planned and ranked.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    all_of_them = written(pieces(docs, vocabulary, size, end_id), "pieces")
    full = all_of_them.filter(F.col("length") == size).select(*COLUMNS, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = all_of_them.filter(F.col("length") < size)
    salts = max(SALTS, short.count() // PART)
    short = short.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    each = written(short.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    whole, cut = plan(counts, size)
    # A run has a row for every RANKS ranks, so a frequent length has many keys and a piece meets RANKS runs at most.
    by_ranks = F.explode(F.expr(f"sequence(first div {RANKS}, (first + number - 1) div {RANKS})"))
    whole_runs = spark.createDataFrame(whole, "length long, first long, number long, sequence long, offset long").withColumn("ranks", by_ranks)
    cut_runs = spark.createDataFrame(cut, "length long, first long, number long, place long, room_place long, room long, rooms long, sequence long, offset long").withColumn("ranks", by_ranks)
    before = each.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "base")
    ranked = written(
        short.withColumn("own", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("own")).withColumn("ranks", F.expr(f"rank div {RANKS}")).drop("salt", "own", "base"), "ranked",
    )
    seated = ranked.join(whole_runs, ["length", "ranks"]).filter("rank >= first and rank < first + number").select(*COLUMNS, F.expr("sequence + rank - first").alias("sequence_id"), "offset")
    met = (
        ranked.join(cut_runs, ["length", "ranks"]).filter("rank >= first and rank < first + number")
        .withColumn("x", F.expr("place + (rank - first) * length")).withColumn("lo", F.expr("greatest(x, room_place)")).withColumn("hi", F.expr("least(x + length, room_place + rooms * room)"))
        .withColumn("k", F.explode(F.expr("sequence((lo - room_place) div room, (hi - 1 - room_place) div room)")))
        .withColumn("from", F.expr("greatest(x, room_place + k * room)")).withColumn("to", F.expr("least(x + length, room_place + (k + 1) * room)"))
        .withColumn("part", F.expr("struct(start + from - x as start, to - from as length, sequence + k as sequence_id, offset + from - room_place - k * room as offset)"))
        .groupBy("doc_id", "doc_tokens", "doc_crc32", "length", "rank").agg(F.collect_list("part").alias("parts"))  # ``size`` parts of a piece at most
    )
    parts = parts_of_cut(docs, written(met, "cut"), vocabulary, end_id)
    return full.unionByName(seated).unionByName(parts.select(*COLUMNS, "sequence_id", "offset"))
