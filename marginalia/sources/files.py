"""Reading corpora, transcripts, catalogs, edges, ledgers and records from folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders that a scan leaves out.
SKIPPED = (".git", "node_modules", ".venv")


def read_corpus(spark: SparkSession, path: str, skip: bool = True) -> DataFrame:
    """(skill, path, content, text, length) of every file under ``<path>/<skill>/``.

    Text is null where the bytes are not UTF-8.  A scan skips three folders; an
    inventory (``skip=False``) skips nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").replace("file://", "")
    rel = F.regexp_replace(F.col("path"), F.lit("^.*?" + root.replace(".", r"\.") + "/+"), F.lit(""))
    out = files.select(
        F.split_part(rel, F.lit("/"), F.lit(1)).alias("skill"), F.regexp_replace(rel, "^[^/]+/", "").alias("path"),
        "content", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"), "length",
    )
    return out.filter(~F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in SKIPPED) + ")/")) if skip else out


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of every non-blank line of every .jsonl file; names with a leading dot are left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*.jsonl").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")


def invocations(lines: DataFrame) -> DataFrame:
    """(skill, called) of every skill block in transcript lines; malformed lines give none."""
    block = "message struct<content: array<struct<type: string, name: string, input: struct<skill: string>>>>"
    parsed = lines.select(F.from_json("line", f"timestamp string, {block}").alias("r"))
    each = parsed.select(F.expr("try_to_timestamp(r.timestamp)").alias("called"), F.explode("r.message.content").alias("b"))
    return each.filter((F.col("b.type") == "tool_use") & (F.col("b.name") == "Skill") & (F.col("b.input.skill") != "")).select(F.col("b.input.skill").alias("skill"), "called")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(skill, category); of a skill that is listed twice the last counts."""
    raw = spark.read.schema("categories array<struct<id: string, skills: array<string>>>").json(path, multiLine=True)
    each = raw.select(F.posexplode("categories").alias("pos", "c")).select("pos", "c.id", F.explode("c.skills").alias("skill"))
    return each.groupBy("skill").agg(F.max_by("id", "pos").alias("category"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Declared edges; a broken file has none."""
    one = "struct<from: string, to: string, type: string, when: string, note: string, source: string, status: string>"
    return spark.read.schema(f"edges array<{one}>").json(path, multiLine=True).selectExpr("inline(edges)")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(skill, path, sha256) of every ledger file's inventory; the skill is the file's name."""
    raw = spark.read.schema("integrity struct<fileCount: int, files: map<string, string>, lastVerified: string>").json(path, multiLine=True)
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    return raw.select(name.alias("skill"), F.explode("integrity.files").alias("path", "sha256"))
