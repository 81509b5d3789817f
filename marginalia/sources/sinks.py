"""Writing findings, ledgers, baselines, graphs and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_findings(findings: DataFrame, path: str) -> None:
    """One folder per severity."""
    findings.write.mode("overwrite").partitionBy("sev").parquet(path)


def write_baseline(report: DataFrame, path: str) -> None:
    """Written once; a second time is an error."""
    report.write.mode("errorifexists").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.repartition("kind").sortWithinPartitions("kind", "id").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartition("kind").sortWithinPartitions("kind", "a", "b").write.mode("overwrite").parquet(f"{path}/edges")


def merge_sections(current: DataFrame, updates: DataFrame, sections: list[str]) -> DataFrame:
    """The ledger with whole sections of ``updates`` in place of its own; other sections stay."""
    both = current.alias("c").join(updates.alias("u"), F.col("c.skill") == F.col("u.skill"), "full")
    pick = [
        (F.when(F.col(f"u.{s}").isNotNull(), F.col(f"u.{s}")).otherwise(F.col(f"c.{s}")) if s in sections else F.col(f"c.{s}")).alias(s)
        for s in current.columns if s != "skill"
    ]
    return both.select(F.coalesce("c.skill", "u.skill").alias("skill"), *pick)


def append_rejected(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose name is not there yet, one per name; repeats are refused."""
    return new.join(existing.select("name"), "name", "left_anti").dropDuplicates(["name"])


def nested_usage(usage: DataFrame) -> DataFrame:
    """One JSON object of all names' counts."""
    entry = F.struct("skill", F.struct("d7", "d30", "d90", F.col("total").alias("all")).alias("invocations"))
    return usage.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("skills"))
