"""Operator 6: secret scan with a random forest against false positives, in DataFrame functions only.

A candidate is a run of characters of keys and tokens: of 16 or more with a digit
in it anywhere, of six or more with or without a digit right after a word that
names a secret or after an assignment.  '=' is in no run but as padding at its
end, so NAME=value gives the value, with the name before it.  Its features - length, kinds of characters and transitions between them,
distinct characters, share covered by dictionary words, signs of a path, and the
words beside it - go to a random forest (Spark ML on DataFrames) that was trained
on labelled findings.  Candidates that it takes for secrets are findings.

Labelled findings are a table (before, candidate, after, label); the default one
is made by rule from seeds: keys, hex and base64 tokens beside words that name a
secret, against paths, identifiers, versions, digests and numbers beside words
that name something else.

Each case has a result: null and empty texts have no candidates; overlapping
candidates cannot be, as runs are maximal; equal candidates at other places are
findings each; repeated rows are scanned each; no labelled findings of either
kind is an error of the caller (ValueError).  Other columns are not read, and
``redact`` passes them through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import own_columns

#: Characters before and after a candidate that its neighbouring words come from.
NEAR = 48
TREES, DEPTH, SEED, THRESHOLD = 24, 6, 11, 0.5
#: Words that name a secret, and words that name something else (fixed values).
SECRET_WORDS = "token secret password passwd pwd api apikey key auth bearer credential private access signature"
OTHER_WORDS = "commit sha checksum digest version path file id uuid hash etag revision build image href url src page number phone"
#: Words whose letters in a candidate speak against chance (fixed values).
DICTIONARY = "test user name data file path index main config server client build release version image page item list table value number string public static content module package example sample default local http https www com org html json text"
#: Words that stand where a secret could, with what is no secret (fixed values).
PLAIN_WORDS = "required optional string number disabled enabled default management control features following however because nothing something certain language another between through available unknown Authentication Provider Settings Required Optional Monday Summary Important Although"

FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "transitions", "transition_rate", "distinct_rate",
    "hex_only", "covered", "slashes", "dots", "dashes", "extension", "assigned", "quoted", "secret_word", "other_word",
)


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def _any_of(words: str) -> str:
    return "(?i)(?<![a-z])(" + "|".join(words.split()) + ")(?![a-z])"


#: Characters of a run, and what ends one after padding.
RUN, END = "[A-Za-z0-9_+/.-]", "(?![A-Za-z0-9_+/=.-])"
#: The least length anywhere, and right after a word that names a secret or an assignment.
LONG, SHORT = 16, 6
#: What a short run or one without a digit must stand after.
BESIDE = rf"(?<={_any_of(SECRET_WORDS)}\W{{1,6}})|(?<=[=:]\s{{0,8}}[\"']?)"
#: A candidate: a maximal run, and its padding; padding counts to the length.
CANDIDATE = (
    rf"(?<!{RUN})(?:(?=[A-Za-z_+/.-]*[0-9])(?:{RUN}{{{LONG},}}|{RUN}{{{LONG - 1}}}(?==={{0,1}}{END})|{RUN}{{{LONG - 2}}}(?==={END}))"
    rf"|(?:{BESIDE}){RUN}{{{SHORT},}})(?:={{1,2}}{END})?"
)


def features(found: DataFrame) -> DataFrame:
    """Adds the feature columns to rows of (before, candidate, after)."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(c).cast("double")
    covered = n - F.length(F.regexp_replace(F.lower(c), "(" + "|".join(sorted(DICTIONARY.split(), key=len, reverse=True)) + ")", ""))
    transitions = _count(c, "[a-z](?=[^a-z])") + _count(c, "[A-Z](?=[^A-Z])") + _count(c, "[0-9](?=[^0-9])")
    cols = {
        "length": n, "digits": _count(c, "[0-9]") / n, "uppers": _count(c, "[A-Z]") / n, "lowers": _count(c, "[a-z]") / n,
        "marks": _count(c, "[^A-Za-z0-9]") / n, "transitions": transitions, "transition_rate": transitions / n,
        "distinct_rate": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "hex_only": c.rlike("^[0-9a-fA-F]+$").cast("double"), "covered": covered.cast("double") / n,
        "slashes": _count(c, "/"), "dots": _count(c, r"\."), "dashes": _count(c, "[-_]"),
        "extension": c.rlike(r"\.[a-z]{2,4}[0-9]?$").cast("double"),
        "assigned": before.rlike(r"""[=:]\s*["']?$""").cast("double"), "quoted": (before.rlike("""["']$""") & after.rlike("""^["']""")).cast("double"),
        "secret_word": before.rlike(_any_of(SECRET_WORDS) + r"\W{0,6}$").cast("double"), "other_word": before.rlike(_any_of(OTHER_WORDS) + r"\W{0,6}$").cast("double"),
    }
    return found.withColumns({k: cols[k] for k in FEATURES})


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, before, candidate, after) of every candidate; pos counts code points from 0."""
    some = own_columns(docs, "doc_id", "text").filter(F.col("text").rlike(CANDIDATE))
    cut = some.select("doc_id", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("text", CANDIDATE, -1).alias("gap"))
    # What stands near may hold other candidates, the name in NAME=value too: so many of them and their gaps fill NEAR.
    k = -(-NEAR // SHORT)
    before = f"aggregate(sequence(greatest(i - {k}, 0), i), '', (a, j) -> concat(a, if(j > greatest(i - {k}, 0), c[j - 1], ''), gap[j]))"
    after = f"aggregate(sequence(i + 1, least(i + 1 + {k}, size(c))), '', (a, j) -> concat(a, if(j > i + 1, c[j - 1], ''), gap[j]))"
    each = cut.select("doc_id", F.explode(F.expr(
        f"transform(c, (x, i) -> struct(x as candidate, right({before}, {NEAR}) as before, left({after}, {NEAR}) as after, "
        "cast(aggregate(slice(gap, 1, i + 1), 0L, (a, g) -> a + length(g)) + aggregate(slice(c, 1, i), 0L, (a, g) -> a + length(g)) as bigint) as pos))"
    )).alias("f"))
    return each.select("doc_id", "f.pos", "f.before", "f.candidate", "f.after")


def default_findings(spark: SparkSession, n: int = 200) -> DataFrame:
    """Labelled findings made by rule: ``n`` seeds of each kind."""
    seeds = spark.range(n).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("h"))
    b64 = F.translate(F.regexp_replace(F.base64(F.unhex("h")), r"\s", ""), "=", "")
    word = lambda words, k: F.element_at(F.split(F.lit(words), " "), (F.pmod(F.col("id") * 7 + k, F.lit(len(words.split()))) + 1).cast("int"))
    quote = F.when(F.col("id") % 2 == 0, '"').otherwise("")
    sign = F.element_at(F.array(*map(F.lit, (" = ", "=", ": ", ":"))), (F.col("id") % 4 + 1).cast("int"))
    at = (F.col("id") % 24 + 1).cast("int")
    cut = lambda text, lo, k: text.substr(at, F.lit(lo) + F.col("id") % k)
    name = F.concat_ws("_", word(DICTIONARY, 1), word(DICTIONARY, 3), word(DICTIONARY, 5), F.col("id").cast("string"))
    path = F.concat(F.lit("/"), word(DICTIONARY, 2), F.lit("/"), word(DICTIONARY, 4), F.lit("/v"), F.col("id").cast("string"), F.lit("/"), word(DICTIONARY, 6), F.lit(".html"))
    digits = F.translate(F.col("h"), "abcdef", "012345")
    letters = F.translate(b64, "0123456789+/", "gWhXiYjZkQmR")
    short = F.concat(cut(F.translate(F.col("h"), "0123456789", "ghijklmnop"), 3, 5), (F.col("id") * 7 % 100).cast("string"), F.when(F.col("id") % 3 == 0, F.lit("-")).when(F.col("id") % 3 == 1, F.lit("_")).otherwise(F.lit("")), cut(F.translate(b64, "+/", "x7"), 3, 5))
    camel = F.concat(word(DICTIONARY, 1), F.initcap(word(DICTIONARY, 3)), F.initcap(word(PLAIN_WORDS, 2)))
    date = F.concat(F.lit("20"), digits.substr(1, 2), F.lit("-"), digits.substr(3, 2), F.lit("-"), digits.substr(5, 2))
    host = F.concat(F.lit("www."), word(DICTIONARY, 2), F.lit("-"), word(DICTIONARY, 5), F.lit(".com"))
    after_secret = F.concat(F.lit("the "), word(SECRET_WORDS, 4), F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.concat(sign, quote)))
    kinds = [
        (F.concat(F.lit("so "), word(SECRET_WORDS, 0), sign, quote), F.when(F.col("id") % 3 == 0, F.lit(40)).when(F.col("id") % 3 == 1, F.lit(32)).otherwise(F.lit(24)), "hex", 1),
        (F.concat(F.lit("my "), word(SECRET_WORDS, 2), sign, quote), None, "b64", 1),
        (F.concat(word(OTHER_WORDS, 0), sign, quote), F.lit(40), "hex", 0),
        (F.concat(F.lit("see "), word(OTHER_WORDS, 3), F.lit(" ")), F.lit(32), "hex", 0),
        (F.concat(F.lit("in "), word(OTHER_WORDS, 1), sign, quote), None, "path", 0),
        (F.lit("we call "), None, "name", 0), (F.concat(word(SECRET_WORDS, 1), sign, quote), None, "name", 0),
        (F.lit("on the way "), None, "path", 0), (F.lit("of the "), None, "digits", 0), (F.concat(word(OTHER_WORDS, 5), sign), None, "digits", 0),
        (F.concat(F.lit("my "), word(SECRET_WORDS, 5), sign, quote), None, "short", 1), (F.concat(F.lit("my "), word(SECRET_WORDS, 6), sign, quote), None, "letters", 1),
        (after_secret, None, "plain", 0), (F.concat(word(OTHER_WORDS, 2), sign, quote), None, "plain", 0), (F.concat(F.lit("as it is"), sign, quote), None, "plain", 0),
        (after_secret, None, "camel", 0), (F.concat(F.lit("as it is"), sign, quote), None, "camel", 0), (F.concat(word(OTHER_WORDS, 4), sign, quote), None, "date", 0),
        (F.concat(F.lit("as it is"), sign, quote), None, "date", 0), (F.concat(word(OTHER_WORDS, 6), sign, quote), None, "host", 0), (F.concat(F.lit("so it is"), sign, quote), None, "short", 0),
    ]
    out = None
    for before, size, kind, label in kinds:
        c = {"hex": F.col("h").substr(at, size) if size is not None else None, "b64": cut(b64, 20, 30), "path": path, "name": name, "digits": cut(digits, 16, 8),
             "short": short, "letters": cut(letters, 20, 30), "plain": word(PLAIN_WORDS, 0), "camel": camel, "date": date, "host": host}[kind]
        part = seeds.select(before.alias("before"), c.alias("candidate"), F.concat(quote, F.lit(" and then")).alias("after"), F.lit(label).alias("label"))
        out = part if out is None else out.unionAll(part)
    return out


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """A random forest on labelled findings (before, candidate, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = features(findings.filter(F.col("candidate").isNotNull() & F.col("label").isNotNull()).select(F.coalesce("before", F.lit("")).alias("before"), "candidate", F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("double").alias("label")))
    kinds = {r.label for r in rows.select("label").distinct().collect()}
    if kinds != {0.0, 1.0}:
        raise ValueError("labelled findings of both kinds are needed")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt")
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label"))


def scored(found: DataFrame, model) -> DataFrame:
    """Adds ``score``, the forest's share for a secret, to candidates."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(features(found))
    p = vector_to_array("probability")
    return model.transform(vectors).select(*found.columns, F.round(F.element_at(p, 2), 9).alias("score"))


def scan(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, pos, candidate, before, after, score and is_secret."""
    return scored(candidates(docs), model).withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, model, mask: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with each secret replaced by ``mask``; other rows and columns as they are.

    The secrets of a text are gathered by the text's hash, so a document's id
    may repeat or be null.
    """
    from .repeats import small_or_shuffled
    from .common import written

    found = scan(docs.select(F.xxhash64("text").alias("doc_id"), "text"), model, threshold).filter("is_secret")
    own = written(found.groupBy(F.col("doc_id").alias("h")).agg(F.collect_set("candidate").alias("secrets")), "secrets")
    # The rows are one column here, so that none of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h"))
    out = rows.join(small_or_shuffled(own, F.size("secrets") * 8), "h", "left")
    # Longer first, so that a secret inside another does not break it; a short one only where it is a run of its own.
    whole = lambda s: F.concat(F.lit(rf"(?<!{RUN})\Q"), s, F.lit(rf"\E(?!{RUN})"))
    masked = lambda t, s: F.when(F.length(s) >= LONG, F.replace(t, s, F.lit(mask))).otherwise(F.regexp_replace(t, whole(s), F.lit(re.sub(r"([\\$])", r"\\\1", mask))))
    clean = F.aggregate(F.array_sort("secrets", lambda a, b: F.length(b) - F.length(a)), F.col("row.text"), masked)
    text = F.when(F.col("secrets").isNotNull(), clean).otherwise(F.col("row.text")).alias("text")
    return out.select(*(text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
