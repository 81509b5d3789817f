"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm.common import crc_of_id, give_back_heaps, new_path, own_columns, written
from marginalia.llm.queries import table, vocabulary

#: Shorter than operator 3's own 400 bytes, so that passages of over 50 words go.
REPEAT = 260
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier takes for toxic go.

    It learns from the labels of the whole table, not of what is left of it.
    """
    from marginalia.llm.toxicity import fit, score

    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.pmod(crc_of_id(), F.lit(5)) != 0)
    return score(docs, model, keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of linked documents the one with the least id stays; of equal ids one row.

    Of rows with one id the greatest by text stays, so not one without text;
    only these rows are gathered.  Rows with a null id all stay.
    """
    from marginalia.llm.jaccard import joined
    from marginalia.llm.repeats import small_or_shuffled

    groups = joined(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    kept = own_columns(docs, *COLUMNS).join(small_or_shuffled(groups, F.lit(1)), "doc_id", "left_anti")
    again = written(own_columns(docs, "doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "same-id")
    again = small_or_shuffled(again, F.lit(1))
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: bytes of strings of ``REPEAT`` bytes, some 45 words, that repeat are cut out of the texts."""
    from marginalia.llm.repeats import deduplicated

    return deduplicated(own_columns(docs, *COLUMNS), REPEAT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: secrets in the texts are masked; every document stays."""
    from marginalia.llm.secrets import default_findings, redact, train

    out = redact(own_columns(docs, *COLUMNS), train(default_findings(spark)))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token sequences of 2048, packed best-fit."""
    from marginalia.llm.packing import pack

    return pack(docs, vocabulary("word_bpe_49k.json"))


def _after_others(stage):
    """The stage, begun with what the stages before it have left of the executors' heaps given back."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heaps(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [
    ("toxicity", _after_others(drop_toxic)),
    ("near_duplicates", _after_others(drop_near_duplicates)),
    ("repeats", _after_others(cut_repeats)),
    ("secrets", _after_others(mask_secrets)),
    ("packing", _after_others(pack_sequences)),
]

#: No SQL can express a trained classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
