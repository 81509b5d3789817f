"""Operator 4: best-fit packing planned on a histogram of lengths.

Documents are tokenised where they lie; only (document, piece, length, checksum)
rows move.  The number of pieces of each length - at most ``size`` numbers -
goes to the driver, which plans best-fit decreasing over counts: bins with the
same free room are one entry with a multiplicity.  The plan is a table of slot
runs per length, and pieces take slots by joining on rank within their length.

Each case has a result: null text counts as empty and still has its end id; a
document longer than ``size`` is cut into full pieces and a last one that may be
shorter; pieces of equal length are ranked by a salt of the document id, then
the id, then the piece; repeated rows are packed each; no documents give no
rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F

from . import tokens
from .common import mapped, own_columns, written

SIZE, END_ID = 2048, 0
#: Parts into which the pieces of one length are dealt for ranking, and ranks that look for their slot together.
SALTS, RANKS = 64, 64

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slot runs (length, first rank, number, first sequence, offset).

    Best-fit decreasing over counts.  A run says: the pieces of this length with
    ranks from ``first rank`` on, ``number`` of them, go one each to successive
    sequences from ``first sequence`` on, at ``offset``.  Open bins are kept per
    free room as runs of sequences, so the work grows with the number of
    lengths and runs, not with documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    free: list[int] = []
    slots, used = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    free.pop(at)
                take = min(n, todo)
                if n > take:
                    put(left, first + take, n - take)
                slots.append((length, rank, take, first, size - left))
                put(left - length, first, take)
            else:
                fit = size // length
                full, rest = divmod(todo, fit)
                if full:
                    for k in range(fit):
                        slots.append((length, rank + k * full, full, used, k * length))
                    put(size - fit * length, used, full)
                    used += full
                    take = full * fit
                else:
                    for k in range(rest):
                        slots.append((length, rank + k, 1, used, k * length))
                    put(size - rest * length, used, 1)
                    used += 1
                    take = rest
            rank, todo = rank + take, todo - take
    return slots


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a narrow job."""

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
                    for k, at in enumerate(range(0, len(x), size)):
                        part = x[at : at + size]
                        rows.append((doc, k, at, len(part), zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], list(COLUMNS))

    return mapped(own_columns(docs, "doc_id", "text"), run, SCHEMA)


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, salts: int = SALTS) -> DataFrame:
    """One row per piece with its sequence and offset.

    Full pieces are sequences of their own, numbered below zero where they lie;
    only shorter ones are counted, planned and ranked.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, size, end_id), "pieces")
    full = cut.filter(F.col("length") == size).select(*COLUMNS, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.filter(F.col("length") < size).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    # At most size * salts rows, whatever the corpus.
    seen = [tuple(r) for r in short.groupBy("length", "salt").agg(F.count("*").alias("n")).orderBy("length", "salt").collect()]
    counts: dict[int, int] = {}
    base = []
    for length, salt, n in seen:
        base.append((length, salt, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    # A run of slots has a row for every RANKS ranks, so a frequent length has many keys and a piece meets RANKS runs at most.
    runs = spark.createDataFrame(plan(counts, size), "length long, first long, number long, sequence long, offset long")
    slots = runs.withColumn("ranks", F.explode(F.expr(f"sequence(first div {RANKS}, (first + number - 1) div {RANKS})")))
    before = spark.createDataFrame(base, "length long, salt int, base long")
    ranked = (
        short.withColumn("own", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("own")).withColumn("ranks", F.expr(f"rank div {RANKS}"))
    )
    seated = ranked.join(slots, ["length", "ranks"]).filter("rank >= first and rank < first + number").select(*COLUMNS, F.expr("sequence + rank - first").alias("sequence_id"), "offset")
    return full.unionByName(seated)
