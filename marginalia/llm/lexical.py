"""Operator 12: ranked lexical search by scanning documents with one automaton.

The terms of a block of items make an Aho-Corasick automaton, whose patterns
carry a space on either side, so that only whole terms are found.  A text is
brought to terms and single spaces, and one pass of the automaton over it counts
every term: there is no index of documents, and no row for a document's terms.

The first pass over the documents counts documents, terms and, for each item
term, the documents that hold it; tasks give sums.  The second counts again,
scores and keeps the ``top`` best documents of each item and task; these few
rows are ranked, in two steps, so that no task sees those of all tasks at once.
Terms and weights of a block are what every task gets: at most ``BLOCK`` bytes
of items, or one item that is longer.  More items are more blocks.

Each case has a result: null or term-less texts count for nothing and are in no
answer; items without terms, or of which no term occurs, have no rows; terms
repeated in an item count as often; equal scores go by doc_id, a null one last;
repeated rows are documents of their own; rows with one item_id are one item
with the terms of all of them; a null item_id is an item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import mapped, own_columns

TOP = 20
#: Bytes of items' texts in a block; parts into which the tasks' best rows are dealt before the last ranking.
BLOCK, SALTS = 4 << 20, 64
#: Documents that are scored together.
TOGETHER = 256

#: ASCII letters and digits, small, and what is no ASCII stand for themselves; the rest separates.
_TO_TERMS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in a row."""
    return (text or "").encode().translate(_TO_TERMS).split()


class Block:
    """Items with their terms: numbers of terms, and of each term the items that have it and how often."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        rows = [(self.number.setdefault(t, len(self.number)), k, n) for k, (_, text) in enumerate(items) for t, n in Counter(terms(text)).items()]
        rows.sort()
        term, item, times = np.array(rows, np.int64).reshape(-1, 3).T
        self.first = np.searchsorted(term, np.arange(len(self.number) + 1))
        self.item, self.times = item.copy(), times.copy()
        self.weight = np.zeros(len(self.number), np.int64)

    def automaton(self):
        """The automaton of all terms, a space on either side of each."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for t, k in self.number.items():
            out.add_word(f" {t.decode('latin-1')} ", k)
        out.make_automaton()
        return out


def counted(found, text: bytes) -> tuple[int, Counter]:
    """How many terms a text has, and which of the automaton's how often."""
    own = text.translate(_TO_TERMS).split()
    if not own:
        return 0, Counter()
    return len(own), Counter(map(itemgetter(1), found.iter(f" {b' '.join(own).decode('latin-1')} ")))


def corpus_counts(docs: DataFrame, block: Block) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and the documents that hold each of the block's terms."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found, holds, n_docs, n_terms = block.automaton(), np.zeros(len(block.number), np.int64), 0, 0
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                n, own = counted(found, text.as_py() or b"")
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                holds[np.fromiter(own, np.int64, len(own))] += 1
        some = np.flatnonzero(holds)
        keys, values = np.concatenate([[-2, -1], some]), np.concatenate([[n_docs, n_terms], holds[some]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["term", "n"])

    sums = {r.term: r.n for r in mapped(own_columns(docs, "text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.pop(-2, 0), sums.pop(-1, 0), sums


def best_of_tasks(docs: DataFrame, block: Block, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item (its place in the block), doc_id, score: the best documents that each task has seen."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found, wide = block.automaton(), len(block.items)
        best = np.empty((3, 0), np.int64)  # item, doc, score; by item, then the best first
        least = np.zeros(wide, np.int64)

        def take(ids: list[int], sizes: list[int], owns: list[Counter]) -> None:
            nonlocal best
            per = np.fromiter(map(len, owns), np.int64, len(owns))
            doc = np.repeat(np.arange(len(owns)), per)
            term = np.fromiter((t for own in owns for t in own), np.int64, int(per.sum()))
            tf = np.fromiter((n for own in owns for n in own.values()), np.int64, len(term))
            m = 75 + 25 * np.array(sizes, np.int64) * n_docs // n_terms
            gain = block.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            fan = block.first[term + 1] - block.first[term]
            at = np.repeat(block.first[term] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            scores = np.zeros(len(owns) * wide, np.int64)
            np.add.at(scores, np.repeat(doc, fan) * wide + block.item[at], np.repeat(gain, fan) * block.times[at])
            scores = scores.reshape(len(owns), wide)
            row, item = np.nonzero((scores > 0) & (scores >= least))
            if not len(row):
                return
            both = np.concatenate([best, [item, np.array(ids, np.int64)[row], scores[row, item]]], axis=1)
            both = both[:, np.lexsort((both[1], -both[2], both[0]))]
            begins = np.searchsorted(both[0], np.arange(wide))
            best = both[:, np.arange(both.shape[1]) - begins[both[0]] < top]
            begins = np.searchsorted(best[0], np.arange(wide + 1))
            full = np.flatnonzero(np.diff(begins) == top)
            least[full] = best[2][begins[full] + top - 1]

        ids, sizes, owns = [], [], []
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1).cast(pa.binary())):
                n, own = counted(found, text.as_py() or b"")
                if own:
                    ids.append(_NO_ID if doc.as_py() is None else doc.as_py())
                    sizes.append(n)
                    owns.append(own)
                if len(owns) == TOGETHER:
                    take(ids, sizes, owns)
                    ids, sizes, owns = [], [], []
        if owns:
            take(ids, sizes, owns)
        doc_ids = pa.array(best[1], mask=best[1] == _NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), doc_ids, pa.array(best[2])], ["item", "doc_id", "score"])

    return mapped(own_columns(docs, "doc_id", "text"), run, "item long, doc_id long, score long")


def blocks(items: DataFrame, most: int) -> Iterator[Block]:
    """Items by id in blocks of ``most`` bytes; they come to the driver one block at a time."""
    own, size = [], 0
    rows = own_columns(items, "item_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if own and r.item_id == own[-1][0]:
            own[-1] = (r.item_id, f"{own[-1][1]} {r.text}")
        else:
            if own and size + len(r.text) > most:
                yield Block(own)
                own, size = [], 0
            own.append((r.item_id, r.text))
        size += len(r.text)
    if own:
        yield Block(own)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` best documents."""
    spark: SparkSession = docs.sparkSession
    answers = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in blocks(items, most):
        if not block.number:
            continue
        n_docs, n_terms, holds = corpus_counts(docs, block)
        if not holds:
            continue
        for term, df in holds.items():
            block.weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        names = spark.createDataFrame([(k, i) for k, i in enumerate(block.items)], "item long, item_id long")
        found = best_of_tasks(docs, block, n_docs, n_terms, top).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        few = found.withColumn("k", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).filter(F.col("k") <= top)
        answers = answers.unionByName(few.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    last = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return answers.withColumn("rank", last).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


#: The same by joins, for the checking engine.
ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
qt AS (SELECT item_id, t, count(*) AS times FROM q GROUP BY item_id, t),
c AS (SELECT count(*) AS nd, cast(sum(len(t)) AS bigint) AS l FROM w WHERE len(t) > 0),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS t FROM w) WHERE t IN (SELECT t FROM qt) GROUP BY r, doc_id, n, t),
df AS (SELECT t, cast(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS bigint) AS w FROM tf, c GROUP BY t, nd),
s AS (SELECT qt.item_id, r, doc_id, sum(times * df.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // l))))) AS score
      FROM tf JOIN df ON df.t = tf.t JOIN qt ON qt.t = tf.t CROSS JOIN c GROUP BY qt.item_id, r, doc_id)
SELECT item_id, cast(k AS int) AS rank, doc_id, cast(score AS bigint) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0) WHERE k <= 20
"""
