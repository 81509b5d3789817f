"""Readers of folders and writers: what they keep, refuse and order."""

import json

import pytest
from pyspark.errors import AnalysisException

from marginalia.sources import files, sinks


def test_catalog_keeps_the_last_entry(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps({"categories": [{"id": "a", "skills": ["x", "y"]}, {"id": "b", "skills": ["x"]}, {"id": "c", "skills": []}, {"id": "d"}]}, indent=1))
    assert {tuple(r) for r in files.read_catalog(spark, str(tmp_path / "catalog.json")).collect()} == {("x", "b"), ("y", "a")}


def test_edges_of_sound_and_broken_files(spark, tmp_path):
    (tmp_path / "edges.json").write_text(json.dumps({"edges": [{"from": "a", "to": "b", "type": "operative", "note": None}, {"from": "c", "to": "d", "extra": 1}]}))
    got = files.read_edges(spark, str(tmp_path / "edges.json"))
    assert {(r["from"], r["to"], r["type"]) for r in got.collect()} == {("a", "b", "operative"), ("c", "d", None)}
    (tmp_path / "broken.json").write_text("{not json")
    assert files.read_edges(spark, str(tmp_path / "broken.json")).count() == 0


def test_ledgers_are_named_by_their_files(spark, tmp_path):
    for name, inventory in {"one": {"SKILL.md": "h1", "a/b.md": "h2"}, "two": {}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"integrity": {"fileCount": len(inventory), "files": inventory, "lastVerified": None}}))
    (tmp_path / "three.json").write_text("{}")
    assert {tuple(r) for r in files.read_ledger(spark, str(tmp_path)).collect()} == {("one", "SKILL.md", "h1"), ("one", "a/b.md", "h2")}


def test_findings_have_a_folder_for_each_severity(spark, tmp_path):
    rows = spark.createDataFrame([("a", "X", "BLOCK"), ("b", "Y", "NOTE"), ("c", None, "NOTE")], "skill string, code string, sev string")
    for _ in range(2):  # a second time takes the place of the first
        sinks.write_findings(rows, str(tmp_path / "f"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {("a", "X", "BLOCK"), ("b", "Y", "NOTE"), ("c", None, "NOTE")}
    assert {p.name for p in (tmp_path / "f").iterdir() if p.is_dir()} == {"sev=BLOCK", "sev=NOTE"}


def test_a_baseline_is_written_once(spark, tmp_path):
    report = spark.createDataFrame([(1,)], "n int")
    sinks.write_baseline(report, str(tmp_path / "b"))
    with pytest.raises(AnalysisException):
        sinks.write_baseline(report, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_a_graph_is_written_in_order(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "2"), ("a", "2"), ("a", "1"), ("a", None)], "kind string, id string")
    edges = spark.createDataFrame([("x", "2", "1"), ("x", "1", "3"), ("x", "1", "2")], "kind string, a string, b string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "g/nodes")).collect()} == {("b", "2"), ("a", "2"), ("a", "1"), ("a", None)}
    assert [tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "g/edges")).collect()] == [("1", "2"), ("1", "3"), ("2", "1")]


def test_usage_as_one_object(spark):
    rows = spark.createDataFrame([("b", 0, 1, 2, 3), ("a", 1, 1, 1, 1)], "skill string, d7 long, d30 long, d90 long, total long")
    (row,) = sinks.nested_usage(rows).collect()
    assert json.loads(row.skills) == {"a": {"d7": 1, "d30": 1, "d90": 1, "all": 1}, "b": {"d7": 0, "d30": 1, "d90": 2, "all": 3}}
