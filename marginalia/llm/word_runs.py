"""Operator 11: periodic runs of words, by enumerating maximal pairs.

A run is a stretch of consecutive words with smallest period q, ``times`` times
q words long at least and ``least`` words long at least, which no neighbouring
word extends.  It shows as a maximal pair: the words from its start and those
from q words later agree for length - q words, and no further on either side.

Texts are looked at where they lie.  Words get numbers; the suffix order of a
document is made by doubling, and the common prefixes of neighbours in it span
the tree of LCP intervals, which is gone through from the leaves up.  A node's
list of places says of each place its class, the word on its left; children of
a node agree on no further word on the right.  So two places of different
children and different classes are a maximal pair.

Two things bound the work, and neither leaves a run out:

* A pair that is a run agrees on ``shortest`` words or more, so a document in
  which no such gram occurs twice has none, and the tree's nodes begin there.
* A run's pair lies next to each other in its node's list: a place between the
  two would give the stretch a smaller period, since they agree on twice their
  distance at least (hence ``times`` is 3 or more).  When lists are joined, the
  smaller into the larger, only new neighbours are compared.  Pairs grow with
  the places times their logarithm, and not with a group's square.

The constraint on the distance then says that the pair is a run; nothing is
extended.  Each case has a result: null and empty texts have no words and no
runs; words are compared as bytes, case and all; repeated rows are looked at
each; a run found with several distances keeps the smallest; other columns of
the input are not read; a long text takes memory in proportion to its words.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import mapped, own_columns

LEAST, TIMES = 6, 4
#: Words that are sorted together.
TOGETHER = 300_000

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def shortest(least: int, times: int) -> int:
    """Words on which the two places of a run agree at least, whatever its period."""
    return min(max(least - p, (times - 1) * p) for p in range(1, least + 1))


def doubtful(ids: np.ndarray, sizes: np.ndarray, gram: int) -> np.ndarray:
    """Of each document, whether a gram may occur twice in it: equal grams have equal keys."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(sizes), bool)
    n = len(ids) - gram + 1
    if n < 2:
        return out
    at = np.flatnonzero(doc[:n] == doc[gram - 1 :])
    key = (doc[:n] * 0x632BE5AB + 1).astype(np.uint64)
    for k in range(gram):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k].astype(np.uint64)
    key = key[at]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out[doc[at[order[1:][same]]]] = True
    return out


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of ``x`` in order, and ranks of its stretches of 1, 2, 4, ... items.

    Equal stretches have equal ranks.  Every document in ``x`` ends in a number
    that occurs once, so a stretch that recurs ends before it.
    """
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], x[order[1:]] != x[order[:-1]]]))
    sizes = np.diff(np.append(first, len(x)))
    rank = np.empty(len(x), np.int32)
    rank[order] = np.repeat(first, sizes)
    levels, open_, k = [rank], order[np.repeat(sizes > 1, sizes)], 1
    while len(open_):
        old = rank[open_].astype(np.int64)
        key = old * len(x) + rank[open_ + k]
        own = np.argsort(key, kind="stable")
        open_, key, old = open_[own], key[own], old[own]
        group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        base = np.repeat(group, np.diff(np.append(group, len(key))))
        rank = rank.copy()
        rank[open_] = old + np.repeat(first, sizes) - base
        levels.append(rank)
        open_, k = open_[np.repeat(sizes > 1, sizes)], 2 * k
    places = np.empty(len(x), np.int64)
    places[rank] = np.arange(len(x))
    return places, levels


def common(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """On how many items the suffixes at ``a`` and at ``b`` agree."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        n += (levels[k][a + n] == levels[k][b + n]).astype(np.int64) << k
    return n


class Pairs:
    """Goes through an LCP-interval tree and keeps the maximal pairs whose distance makes them runs."""

    def __init__(self, classes: list[int], least: int, times: int):
        self.classes, self.least, self.times = classes, least, times
        self.found: list[tuple[int, int, int]] = []

    def see(self, i: int, j: int, agree: int) -> None:
        p = j - i
        if (self.times - 1) * p <= agree and agree + p >= self.least and self.classes[i] != self.classes[j]:
            self.found.append((i, agree + p, p))

    def joined(self, a: list[int], b: list[int], agree: int) -> list[int]:
        """The list of two children of a node; neighbours from different ones are compared."""
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k = bisect(a, x)
            if k:
                self.see(a[k - 1], x, agree)
            if k < len(a):
                self.see(x, a[k], agree)
        if 8 * len(b) < len(a):
            for x in b:
                insort(a, x)
            return a
        return sorted(a + b)

    def tree(self, places: list[int], agree: list[int]) -> None:
        """From the leaves up; ``agree`` has the common prefix of each place and the next."""
        stack: list[tuple[int, list[int]]] = []
        for x, n in zip(places, [*agree, -1]):
            node = [x]
            while stack and stack[-1][0] > n:
                depth, first = stack.pop()
                node = self.joined(first, node, depth)
            if stack and stack[-1][0] == n:
                node = self.joined(stack.pop()[1], node, n)
            stack.append((n, node))


def runs_of(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """Of documents that have runs: (start, length, period) of each, by start, then period."""
    if times < 3:
        raise ValueError("times must be 3 or more")
    gram = shortest(least, times)
    picked = np.flatnonzero(doubtful(ids, sizes, gram))
    if not len(picked):
        return {}
    begins = np.concatenate([[0], np.cumsum(sizes)])
    many = int(ids.max()) + 1
    # A document's words have numbers of its own, and one that ends it.
    x = np.concatenate([part for k, d in enumerate(picked) for part in (ids[begins[d] : begins[d + 1]] + k * (many + 1), [k * (many + 1) + many])])
    starts = np.concatenate([[0], np.cumsum(sizes[picked] + 1)])
    places, levels = suffix_order(x)
    a, b = places[:-1], places[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    agree = np.zeros(len(a), np.int64)
    agree[near] = common(a[near], b[near], levels)
    classes = np.concatenate([[-1], x[:-1]])
    classes[starts[:-1]] = -1
    pairs = Pairs(classes.tolist(), least, times)
    deep = np.flatnonzero(agree >= gram)
    cuts = np.flatnonzero(np.diff(deep) > 1) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(deep)]])
    for i, j in zip(lo.tolist(), hi.tolist()):
        if j > i:
            t, n = int(deep[i]), j - i
            pairs.tree(places[t : t + n + 1].tolist(), agree[t : t + n].tolist())
    least_period: dict[tuple[int, int], int] = {}
    for start, length, p in pairs.found:
        if least_period.get((start, length), p) >= p:
            least_period[start, length] = p
    out: dict[int, list[tuple[int, int, int]]] = {}
    if least_period:
        all_of_them = sorted((s, n, p) for (s, n), p in least_period.items())
        for (s, n, p), k in zip(all_of_them, np.searchsorted(starts, [s for s, _, _ in all_of_them], "right") - 1):
            out.setdefault(int(picked[k]), []).append((int(s - starts[k]), n, p))
        for own in out.values():
            own.sort(key=lambda r: (r[0], r[2]))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run has after its first period."""
    gone = np.zeros(len(words), bool)
    for start, length, p in runs:
        gone[start + p : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def word_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, the runs of every document, and its words joined by spaces without their repeats; a narrow job."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def told(docs: list, words: list[list[bytes]]) -> pa.RecordBatch:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            flat = [w for own in words for w in own]
            number = dict(zip(dict.fromkeys(flat), count()))
            found = runs_of(np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), sizes, least, times) if flat else {}
            texts = [b" ".join(without_repeats(own, found[k]) if k in found else own) for k, own in enumerate(words)]
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in found.get(k, ())] for k in range(len(words))]
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes), pa.array(rows, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        for b in batches:
            docs, words, n = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                own = (text.as_py() or b"").split()  # of bytes: at the six ASCII white-space characters
                if docs and n + len(own) > TOGETHER:
                    yield told(docs, words)
                    docs, words, n = [], [], 0
                docs.append(doc)
                words.append(own)
                n += len(own)
            if docs:
                yield told(docs, words)

    return mapped(own_columns(docs, "doc_id", "text"), run, SCHEMA)


def with_planted(docs: DataFrame, key: Column) -> DataFrame:
    """Documents of which those with key % 10 = 0 repeat themselves to their end from some word on.

    With g = key div 10 and n words: from word a = g % n on, words are the
    p = 1 + (n - a) div (3 + g % 8) words from a on, over and over.
    """
    words = "CASE WHEN pmod(key, 10) = 0 THEN filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '') END"
    return (
        own_columns(docs, "doc_id", "text").withColumn("key", key).withColumn("words", F.expr(words))
        .withColumn("n", F.expr("nullif(cast(size(words) as bigint), 0)")).withColumn("g", F.expr("key div 10"))
        .withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
        .withColumn("unit", F.expr("concat(array_join(slice(words, cast(a + 1 as int), cast(p as int)), ' '), ' ')"))
        .withColumn("rest", F.expr("array_join(slice(words, cast(a + 1 as int), cast((n - a) % p as int)), ' ')"))
        .withColumn("made", F.expr("concat(array_join(slice(words, 1, cast(a as int)), ' '), ' ', repeat(unit, cast((n - a) div p as int)), rest)"))
        .select("doc_id", F.expr("CASE WHEN n > 0 THEN made ELSE text END").alias("text"))
    )


def told(docs: DataFrame) -> DataFrame:
    """The digests of ``word_runs``: number of runs, the one with the greatest exponent, and hashes."""
    first = "array_sort(runs, (l, r) -> CASE WHEN l.length * r.period <> r.length * l.period THEN CASE WHEN l.length * r.period > r.length * l.period THEN -1 ELSE 1 END WHEN l.start <> r.start THEN CASE WHEN l.start < r.start THEN -1 ELSE 1 END WHEN l.period < r.period THEN -1 WHEN l.period > r.period THEN 1 ELSE 0 END)"
    best = docs.withColumn("best", F.expr(f"try_element_at({first}, 1)"))
    return best.select(
        "doc_id", "n_words", F.expr("cast(size(runs) as bigint)").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same for the checking engine: equal grams of five words at one distance, in a row, are a maximal pair.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: cast(ascii(c) AS bigint))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda t, k: xor(t >> 1, 3988292384 * (t & 1))))) AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM a),
s AS (SELECT r, i, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT r, w, unnest(range(n - 4)) AS i FROM p WHERE n > 4)),
m AS (SELECT x.r, y.i - x.i AS p, x.i FROM s x JOIN s y ON y.r = x.r AND y.s = x.s AND y.i > x.i),
l AS (SELECT r, p, min(i) AS start, count(*) + 4 AS same FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM m) GROUP BY r, p, k),
u AS (SELECT r, start, same + p AS length, min(p) AS period FROM l WHERE 3 * p <= same AND same + p >= 6 GROUP BY r, start, same + p),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) AS k FROM u) WHERE k = 1),
t AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM u GROUP BY r),
x AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM u) GROUP BY r)
SELECT p.doc_id, p.n AS n_words, coalesce(t.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(t.told, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN x.gone IS NULL THEN p.w ELSE list_transform(list_filter(range(p.n), lambda i: NOT list_contains(x.gone, i)), lambda i: p.w[i + 1]) END, ' ')) AS collapsed_sha256
FROM p LEFT JOIN t ON t.r = p.r LEFT JOIN b ON b.r = p.r LEFT JOIN x ON x.r = p.r
"""
