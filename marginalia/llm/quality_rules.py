"""Operator 10: quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Units of a text are runs of letters and digits and runs of other signs.  Their
one- and two-grams are hashed into ``buckets``; the counts over a trusted target
(labelled good documents, ``limit`` at most) and over the whole raw corpus make
two multinomials.  A text's mean log-likelihood ratio of its n-grams, compared
with a fixed threshold, is the verdict; base rules stand before it.

Each case has a result: null and empty texts have no words, fail the base rules
and are not kept; a text without units has ratio 0; without labelled rows every
ratio is 0, so the base rules alone decide; repeated rows get the same row each;
no documents give no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_SPLIT, own_columns, written

BUCKETS, LIMIT, SMOOTHING, THRESHOLD = 1 << 15, 20_000, 1.0, -0.4
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
UNITS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def with_text(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a key that equal rows share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return own_columns(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"))


def base_columns(docs: DataFrame) -> DataFrame:
    """The counts of the base rules for each row of ``with_text``.

    Words in repeated three-word windows: a text that has some sorts its windows'
    hashes with their places, which puts equal windows side by side; the places
    of equal neighbours, sorted, give the words covered.
    """
    words = F.filter(F.split("text", WORD_SPLIT), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select(
        "doc_id", "key", words.alias("w"), lines.alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    windows = cut.select(
        "doc_id", "key", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, greatest(size(w) - 2, 0))").alias("h"),
    )
    some = windows.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")).otherwise(F.expr("array()").cast("array<bigint>")))
    ordered = some.withColumn("p", F.expr("sort_array(transform(h, (x, i) -> struct(x as h, cast(i as bigint) as i)))"))
    again = "x.h = get(p, i - 1).h or x.h = get(p, i + 1).h"
    places = ordered.withColumn("q", F.expr(f"sort_array(transform(filter(p, (x, i) -> {again}), x -> x.i))"))
    covered = F.expr("aggregate(q, struct(-3L as last, 0L as n), (a, x) -> struct(x as last, a.n + least(3L, x - a.last) as n), a -> a.n)")
    return places.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def grams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket) of every one- and two-gram of units."""
    units = docs.select("key", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)).alias("u"))
    pairs = units.select("key", F.explode(F.arrays_zip(F.col("u").alias("a"), F.expr("slice(u, 2, greatest(size(u), 1))").alias("b"))).alias("g"))
    one, two = F.xxhash64("g.a"), F.when(F.col("g.b").isNotNull(), F.xxhash64("g.a", "g.b"))
    both = pairs.select("key", F.explode(F.array(one, two)).alias("x"))
    return both.filter("x is not null").select("key", F.pmod("x", F.lit(buckets)).cast("int").alias("bucket"))


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, weight): log of the target's probability over the raw corpus's.

    ``target`` has the ids of trusted documents, ``LIMIT`` at most.  Counts run
    over every document and are pre-aggregated before they move; the result has
    ``buckets`` rows at most.
    """
    flagged = docs.join(F.broadcast(target.select("doc_id").distinct().withColumn("good", F.lit(1))), "doc_id", "left")
    keys = flagged.select(F.when(F.col("good") == 1, 1).otherwise(0).cast("long").alias("key"), "text")
    counts = written(grams(keys, buckets).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("key").alias("good")), "counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    if not total.good:
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    room = smoothing * buckets
    const = math.log(total.raw + room) - math.log(total.good + room)
    return counts.select("bucket", (F.log(F.col("good") + smoothing) - F.log(F.col("raw") + smoothing) + const).alias("weight"))


def trusted(labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Ids of documents labelled good, ``limit`` at most, picked by a hash of the id."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, limit: int = LIMIT) -> DataFrame:
    """The base counts, the ratio and the verdict of every document."""
    texts = with_text(docs)
    table = weights(texts, trusted(labels, limit), buckets)
    ratio = grams(texts, buckets).join(F.broadcast(table), "bucket").groupBy("key").agg(F.avg("weight").alias("llr"))
    failed: Column = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    llr = F.round(F.coalesce(F.col("llr"), F.lit(0.0)), 9)
    return base_columns(texts).join(ratio, "key", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (llr >= threshold)).alias("kept"), llr.alias("llr"),
    )
