"""Operator 3: long repeated byte strings by prefix-free parsing.

Triggers - places where a rolling hash of ``TRIGGER`` bytes falls below a bound -
cut every text into phrases.  A string of ``length`` bytes that starts at i has
the first trigger t at or after i inside it, so equal strings have it at equal
offset: what order the corpus' suffixes have is settled by the phrase's tail
before t (dictionary) and by what follows t (parse).

* Parse: each trigger, with the starts it stands for, is keyed by a hash of the
  bytes after it that all those strings share (``core``) and of the whole span
  that they cover.  Keys that occur once leave; equal spans are one entry of the
  parse, and every string in a repeated entry is repeated.
* Dictionary: where one core has several spans, each distinct span is expanded
  once into its suffixes, cut at ``length`` bytes; equal ones meet by hash.

Only suffixes that agree on ``length`` bytes matter, so the order is kept as its
runs of equal suffixes; the order between runs is never needed, and no sort of
the corpus is done.  Strings without any trigger are entries of their own.
A hit is two agreeing 64-bit hashes of different families.

Strings of ``length`` bytes miss shorter passages, so ``shared_windows`` counts
beside them what documents share by words: of every ``PASSAGE`` words in a row
the window of ``WORDS`` words with the least hash is looked up in all documents.
A passage of ``PASSAGE`` words that two documents share has such a window in
common, as both choose the same one.

Matches never cross documents.  Each case has a result: null text counts as
empty; texts shorter than ``length`` lose nothing; overlapping matches are
united; repeated rows count as other places of their strings; ids may repeat or
be null; no documents give no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import kept, mapped, own_columns, written

LENGTH = 400
#: Bytes under the rolling hash of triggers, and one in how many places is one.
TRIGGER, EVERY = 24, 48
#: Starts are told by their distance from the trigger, in steps of this many bytes.
STEP = 100
#: Numbers in a side of a join that is sent to all tasks; a larger one is shuffled.
SMALL = 4_000_000
#: The same for lists of places, which are nearly always shuffled: they grow with the corpus.
FEW = 20_000

#: Words of a passage that is surely found, and of the windows that find it.
PASSAGE, WORDS = 51, 25
#: Bytes of the texts that are gone through at once, about; a longer text is by itself.
BUFFER = 1 << 18

_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Hasher:
    """Two families, or as many as are asked for, of polynomial hashes mod 2**64 of all substrings of a buffer."""

    def __init__(self, data: np.ndarray, families: int = 2):
        n = len(data)
        self.sums, self.back = [], []
        for family in range(families):
            r = np.random.default_rng(1000 + family)
            letters = r.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
            base = int(r.integers(1 << 40, 1 << 62)) * 8 + 5
            up, down = (self.powers(b, n) for b in (base & _MASK, pow(base, -1, 1 << 64)))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * up[:n], dtype=np.uint64)]))
            self.back.append(down)

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        """base ** 0 ... base ** n; those up to a buffer's usual length are remembered."""
        make = lambda k: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(k, base, np.uint64)]), dtype=np.uint64)
        if n > BUFFER:
            return make(n)
        known = kept("powers", dict)
        if base not in known:
            known[base] = make(BUFFER)
        return known[base]

    def of(self, family: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Mixed hash of bytes [lo, hi) of the buffer."""
        s = self.sums[family]
        return mix((s[hi] - s[lo]) * self.back[family][lo])

    def rolling(self, size: int) -> np.ndarray:
        """Mixed hash, first family, of the ``size`` bytes at each place."""
        s = self.sums[0]
        n = len(s) - size
        return mix((s[size:] - s[:-size]) * self.back[0][:n]) if n > 0 else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (n[0] numbers), then those of lo[1], and so on."""
    ends = np.cumsum(n)
    return np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)


def parse(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Entries of all texts in a buffer: (text, core, span, first start in the text, starts, level).

    ``bounds`` has each text's begin, and the last one's end.  Level 0 entries
    are strings without a trigger.
    """
    h = Hasher(data)
    roll = h.rolling(TRIGGER)
    t = np.flatnonzero(roll < np.uint64(_MASK // EVERY))
    doc = np.searchsorted(bounds, t, "right") - 1
    inside = t + TRIGGER <= bounds[doc + 1]
    t, doc = t[inside], doc[inside]
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(t) else np.empty(0, bool)
    before = np.where(first, bounds[doc] - 1, np.concatenate([[0], t[:-1]]) if len(t) else t)
    last_start = bounds[doc + 1] - length
    lo, hi = np.maximum(before + 1, t + TRIGGER - length), np.minimum(t, last_start)
    out = []
    levels = -(-length // STEP)
    for level in range(1, levels + 1):
        a = np.maximum(lo, t - STEP * level + 1)
        b = np.minimum(hi, t - STEP * (level - 1))
        ok = a <= b
        a, b, at, d = a[ok], b[ok], t[ok], doc[ok]
        core = h.of(0, at, at + max(length - STEP * level + 1, TRIGGER)) ^ np.uint64(level)
        out.append((d, core, h.of(1, a, b + length), a - bounds[d], b - a + 1, np.full(len(a), level)))
    # Starts after one trigger and too far before the next, or the text's end.
    ends_at = np.minimum(t + TRIGGER - length - 1, last_start)
    starts_at = before + 1
    tails = np.arange(len(bounds) - 1)
    newest = bounds[:-1] - 1
    if len(t):
        newest = newest.copy()
        newest[doc] = t  # the last trigger of each text stays
    lo0 = np.concatenate([starts_at, newest + 1])
    hi0 = np.concatenate([ends_at, bounds[1:] - length])
    d0 = np.concatenate([doc, tails])
    ok = lo0 <= hi0
    n0 = (hi0 - lo0 + 1)[ok]
    if n0.sum():
        i = ranges(lo0[ok], n0)
        d = np.repeat(d0[ok], n0)
        out.append((d, h.of(0, i, i + length), h.of(1, i, i + length), i - bounds[d], np.ones(len(i), np.int64), np.zeros(len(i), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


def buffers(column, most: int = BUFFER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of neighbouring texts of about ``most`` bytes: first, end, bytes, bounds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        lo = hi


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that only equal rows share."""
    text = F.coalesce("text", F.lit(""))
    return own_columns(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"))


def small_or_shuffled(side: DataFrame, numbers: Column, most: int = SMALL) -> DataFrame:
    """``side`` with a broadcast hint if it has ``most`` numbers in all at most; else as it is, to be shuffled."""
    total = side.agg(F.sum(numbers).alias("n")).first().n or 0
    return F.broadcast(side) if total <= most else side


#: Bits of an entry's number of starts and level in the packed place.
_N, _L = 9, 3
#: Bits of the number in a run's place.
_RUN = 31


def _combined(doc, core, span, start, n, level) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Entries of a buffer, of which level 0 ones that repeat in it are taken apart.

    Text of one short period has no triggers, and few different strings at very
    many places.  Returned: which entries stay; one entry of each string that
    repeats; and the runs (text, first start, number) of these strings' starts.
    """
    bare = np.flatnonzero(level == 0)
    _, first, back, times = np.unique(core[bare] + span[bare] * _M1, return_index=True, return_inverse=True, return_counts=True)
    again = bare[times[back] > 1]
    stay = np.ones(len(core), bool)
    stay[again] = False
    again = again[np.lexsort((start[again], doc[again]))]
    d, f = doc[again], start[again]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1] + 1)])) if len(again) else np.empty(0, np.int64)
    return np.flatnonzero(stay), bare[first[times > 1]], (d[new], f[new], np.diff(np.concatenate([new, [len(again)]])))


def entries(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(core, span, key, place) of every trigger and distance of every text.

    Strings without a trigger that repeat within a megabyte of text are combined
    there: two rows without key and place stand for each such string, and rows
    without core and span (place: first start and number) for where it starts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keys = b.column(1).to_numpy()
            for lo, hi, data, bounds in buffers(b.column(0)):
                if len(data) < length:
                    continue
                doc, core, span, start, n, level = parse(data, bounds, length)
                stay, one, (d, f, k) = _combined(doc, core, span, start, n, level)
                two = np.repeat(one, 2)
                none, known = pa.nulls(len(two), pa.int64()), pa.nulls(len(d), pa.int64())
                hashes = np.concatenate([stay, two])
                own = keys[lo:hi]
                place = (start[stay] << (_N + _L)) | (n[stay] << _L) | level[stay]
                whole = lambda *parts: pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p, pa.int64()) for p in parts])
                yield pa.RecordBatch.from_arrays([
                    whole(core[hashes].view(np.int64), known), whole(span[hashes].view(np.int64), known),
                    whole(own[doc[stay]], none, own[d]), whole(place, none, (f << _RUN) | k),
                ], ["core", "span", "key", "place"])

    return mapped(docs.select("text", "key"), run, "core long, span long, key long, place long")


def expanded(docs: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """(core, whole, key, start, alone) of each start of the wanted entries.

    ``wanted``: key, list of (place, core, alone).
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keys, lists = b.column(1).to_numpy(), b.column(2)
            for lo, hi, data, bounds in buffers(b.column(0), 1 << 18):
                h = Hasher(data)
                part = lists.slice(lo, hi - lo)
                flat = part.flatten()
                doc = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                place, core, alone = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                n = (place >> _L) & ((1 << _N) - 1)
                start = ranges(place >> (_N + _L), n)
                own = np.repeat(doc, n)
                at = start + bounds[own]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(core, n)), pa.array(h.of(1, at, at + length).view(np.int64)), pa.array(keys[lo:hi][own]),
                    pa.array(start), pa.array(np.repeat(alone, n)),
                ], ["core", "whole", "key", "start", "alone"])

    joined = docs.join(small_or_shuffled(wanted, F.size("list") + 1, FEW), "key")
    return mapped(joined.select("text", "key", "list"), run, "core long, whole long, key long, start long, alone boolean")


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, list of (first, n)): the starts of repeated strings of each text that has some."""
    all_entries = entries(docs, length)
    # Written first, so that a frequent core's entries can be split in the join.
    cores = all_entries.filter("core IS NOT NULL").groupBy("core").agg(F.count("*").alias("n")).filter("n > 1")
    cores = written(cores.select("core", F.lit(True).alias("again")), "cores")
    kept = written(all_entries.join(cores, "core", "left").filter("again OR core IS NULL").drop("again"), "entries")
    found = kept.filter("core IS NOT NULL")
    runs = kept.filter("core IS NULL").select("key", F.shiftright("place", _RUN).alias("first"), F.col("place").bitwiseAND((1 << _RUN) - 1).alias("n"))
    spans = found.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("rep"))
    spans = written(spans, "spans")
    first = F.shiftright("place", _N + _L).alias("first")
    number = (F.shiftright("place", _L).bitwiseAND((1 << _N) - 1)).alias("n")
    whole = found.filter("place IS NOT NULL").join(spans.filter("n > 1").select("core", "span"), ["core", "span"]).select("key", first, number).unionAll(runs)
    # Where a core has one span only, nothing is left to tell apart.
    mixed = spans.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core")
    # The lowest bits of a place are the level; level 0 strings are whole already.
    some = spans.join(mixed, "core").filter(F.col("rep.place").bitwiseAND((1 << _L) - 1) > 0)
    wanted = written(some.groupBy(F.col("rep.key").alias("key")).agg(F.collect_list(F.struct(F.col("rep.place").alias("place"), "core", (F.col("n") == 1).alias("alone"))).alias("list")), "wanted")
    starts = written(expanded(docs, wanted, length), "starts")
    # A start is expanded twice only in equal rows, whose spans occur twice anyway.
    again = starts.groupBy("core", "whole").agg(F.count("*").alias("k")).filter("k > 1").select("core", "whole")
    single = starts.filter("alone").join(again, ["core", "whole"]).select("key", F.col("start").alias("first"), F.lit(1).cast("long").alias("n"))
    return whole.unionByName(single).groupBy("key").agg(F.collect_set(F.struct("first", "n")).alias("list"))


def word_windows(data: np.ndarray, bounds: np.ndarray, words: int = WORDS, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the chosen windows of all texts in a buffer."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    lo = np.flatnonzero(solid & (~np.concatenate([[False], solid[:-1]]) | edge[:-1]))
    hi = np.flatnonzero(solid & (~np.concatenate([solid[1:], [False]]) | edge[1:])) + 1
    doc = np.searchsorted(bounds, lo, "right") - 1
    n = len(lo) - words + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = Hasher(data).of(1, lo[:n], hi[words - 1 :])
    inside = doc[:n] == doc[words - 1 :]
    each = passage - words + 1
    if n < each:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h[~inside] = np.uint64(_MASK)
    runs = np.lib.stride_tricks.sliding_window_view(h, each)
    # A run of windows is one document's if its first and last are.
    whole = inside[: len(runs)] & (doc[: len(runs)] == doc[each - 1 + words - 1 :])
    at = np.unique((runs.argmin(1) + np.arange(len(runs)))[whole])
    return doc[at], h[at]


def shared_windows(docs: DataFrame) -> DataFrame:
    """(key, shared): how many of a document's chosen windows stand in another document too, where some do."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keys = b.column(1).to_numpy()
            for lo, hi, data, bounds in buffers(b.column(0)):
                doc, h = word_windows(data, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi][doc]), pa.array(h.view(np.int64))], ["key", "window"])

    chosen = written(mapped(docs.select("text", "key"), run, "key long, window long"), "windows")
    both = written(chosen.groupBy("window").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("window"), "shared")
    return chosen.join(small_or_shuffled(both, F.lit(1), FEW), "window").groupBy("key").agg(F.count("*").alias("shared"))


def removed(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and, with ``texts``, kept (the bytes left) of every document."""
    base = _keyed(docs)
    found = repeated_starts(base, length).join(shared_windows(base), "key", "full")
    found = written(found.withColumn("shared", F.coalesce("shared", F.lit(0).cast("long"))), "repeats")
    joined = base.join(small_or_shuffled(found, F.coalesce(F.size("list"), F.lit(0)) + 1, FEW), "key", "left").select("doc_id", "text", "list", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, text in enumerate(b.column(1)):
                raw = text.as_buffer().to_pybytes()
                spans = b.column(2)[i]
                lost = n = 0
                kept = raw
                if spans.is_valid:
                    flat = spans.values
                    lo, hi = merged(flat.field(0).to_numpy(), flat.field(1).to_numpy(), length)
                    lost, n = int((hi - lo).sum()), len(lo)
                    at = np.concatenate([[0], hi]), np.concatenate([lo, [len(raw)]])
                    kept = b"".join(raw[x:y] for x, y in zip(*at))
                rows.append((len(raw), lost, n, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if texts else []))
            cols = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_shared", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 2 + len(kinds)])

    return mapped(joined, run, "doc_id long, n_shared long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def merged(first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings of ``length`` bytes starting at first ... first + n - 1."""
    order = np.argsort(first, kind="stable")
    lo, hi = first[order], (first + n - 1 + length)[order]
    top = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > top[:-1]])
    at = np.flatnonzero(new)
    return lo[at], top[np.concatenate([at[1:] - 1, [len(lo) - 1]])]


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated bytes taken out of ``text``; all columns stay.

    A character of which a byte goes, goes.  ``n_chars``, where there is one, is
    counted anew.
    """
    # The rows are one column here, so that none of theirs can clash.
    base = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    starts = written(repeated_starts(_keyed(docs), length), "repeats")
    joined = base.join(small_or_shuffled(starts, F.size("list") + 1, FEW), "key", "left")

    @F.pandas_udf("string")
    def cut(texts, lists):
        import pandas as pd

        out = []
        for t, x in zip(texts, lists):
            if x is not None and t is not None:
                raw = t.encode()
                lo, hi = merged(np.array([r["first"] for r in x]), np.array([r["n"] for r in x]), length)
                t = b"".join(raw[i:j] for i, j in zip(np.concatenate([[0], hi]), np.concatenate([lo, [len(raw)]]))).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    row = lambda c: F.col("row").getField(c)
    some = F.col("list").isNotNull()
    text = F.when(some, cut(row("text"), "list")).otherwise(row("text"))
    out = joined.select("row", some.alias("some"), text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("some"), F.length("text").cast("long")).otherwise(row("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*((new[c] if c in new else row(c)).alias(c) for c in docs.columns))
