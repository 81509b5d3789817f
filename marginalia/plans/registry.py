"""Names every query of the library and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import SPARK, Sql, needs, plain, run
from ..operators import findings, graph, ledger, links, overlap, records, scan, text, usage
from ..streaming import usage as streams
from . import tiles
from .derive import RELATIONS
from .store import written

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Key -> SQL of every operator.
OPERATORS: dict[str, Sql] = {f.__name__: f for m in (usage, overlap, ledger, graph, scan, findings, records, links, text) for f in m.OPS}


#: Relations that stand under several others, or several times under one, and are written once for a query.
WRITTEN = {"comment", "told_comment", "encoded_run", "told_run", "scanned", "fence", "front", "mention", "coverer", "posting", "disk", "record_file", "structural", "record_object", "violation", "decision", "step", "reach_a", "reach_b", "reach_c"}

#: Relations that are made of tiles in Spark, for a query of its own or for all; their SQL is what they are checked by.
TILES = {"coverer": tiles.coverer, "pair": tiles.pair("shared", "terms", "score", "ab", "ba", "declared")}
TILES_OF = {
    "join_4_overlap_pairs": {"pair": tiles.pair("terms", "shared")}, "agg_8_cosine": {"pair": tiles.pair("score")}, "agg_9_coverage": {"pair": tiles.pair("ab", "ba")},
    "join_6_declared": {"pair": tiles.pair("score", "declared")}, "top_2_pairs": {"pair": tiles.top},
}


def relation(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table, or a derived relation, as a DataFrame."""
    known = {} if known is None else known
    if name not in known:
        if name in TILES:
            made = TILES[name](spark, lambda n: relation(spark, sf_dir, n, known))
            known[name] = written(made, name) if name in WRITTEN else made
        elif name in RELATIONS:
            sql = RELATIONS[name]
            made = run(spark, sql, **{n: relation(spark, sf_dir, n, known) for n in needs(sql(SPARK))})
            known[name] = written(made, name) if name in WRITTEN else made
        else:
            known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return known[name]


def over(spark: SparkSession, sql: Sql, known: dict[str, DataFrame], sf_dir: str = "") -> DataFrame:
    """The operator over frames that are given, and what is derived from them or from the tables of a folder."""
    for name, made in TILES_OF.get(getattr(sql, "__name__", ""), {}).items():
        if name not in known:
            known[name] = made(spark, lambda n: relation(spark, sf_dir, n, known))
    return run(spark, sql, **{n: relation(spark, sf_dir, n, known) for n in needs(sql(SPARK))})


def query(sql: Sql) -> Callable[[SparkSession, str], DataFrame]:
    """The operator over the given tables of a folder."""

    return lambda spark, sf_dir: over(spark, sql, {}, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(usage.join_3_never_invoked_coverer)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: query(sql) for key, sql in OPERATORS.items()} | streams.QUERIES


def _parsed(d) -> str:
    return f"SELECT {d.valid_json('line')} AS ok, count(*) AS n FROM @transcript GROUP BY {d.valid_json('line')}"


def oracle_sql() -> dict[str, str]:
    return {key: plain(sql, RELATIONS) for key, sql in OPERATORS.items()} | streams.ORACLE | {key: plain(sql, RELATIONS) for key, sql in streams.OPERATORS.items()} | {"strm_1_parsed_lines": plain(_parsed, RELATIONS)}
