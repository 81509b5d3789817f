"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_of_id

#: Where the public vocabulary files lie when the package that has them isn't installed.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removed

    return removed(table(spark, sf_dir, "documents"), texts=False)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_zip import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = fit(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import joined

    return joined(table(spark, sf_dir, "documents"))


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 0
    model = fit(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_id_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .id_files import write_and_read

    return write_and_read(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import default_findings, scan, train

    model = train(default_findings(spark))
    found = scan(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "pos", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_runs import told, with_planted, word_runs

    return told(word_runs(with_planted(table(spark, sf_dir, "documents"), crc_of_id())))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_shortest_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shortest_packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_jaccard_join, op2_toxicity_cnn, op3_repeated_bytes, op4_best_fit_packing, op5_id_containers, op6_secret_scan, op7_media_columns, op8_quality_compression,
        op9_bpe_round_trip, op10_quality_rules, op11_word_runs, op12_lexical_search, op13_shortest_packing,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from . import lexical, word_runs

    return {"op11_word_runs": word_runs.ORACLE, "op12_lexical_search": lexical.ORACLE}
