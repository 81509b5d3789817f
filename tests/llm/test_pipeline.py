"""The pipeline's stages on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def corpus(spark, folder):
    r = random.Random(2)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "re") for b in ("ren", "tas", "vel", "dor", "sun", "pim")]
    rows = [" ".join(r.choice(vocab) + str(r.randint(0, 999)) for _ in range(r.randint(60, 120))) for _ in range(120)]
    for i in range(0, 40):
        rows[i] = rows[i].replace(" ", " zogg ", 3)
    rows[50] = rows[51]
    passage = " ".join(r.choice(vocab) + str(r.randint(0, 999)) for _ in range(70))
    rows[60] += " " + passage
    rows[61] += " " + passage
    rows[70] += ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" end'
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 40)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, passage


def test_stages_take_effect(spark, tmp_path):
    sf = f"file://{tmp_path}"
    rows, passage = corpus(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = seen["toxicity"]
    assert len([i for i in kept if i < 40]) <= 4 and len([i for i in kept if i >= 40]) >= 76
    assert set(kept) - set(seen["near_duplicates"]) == {51}
    assert passage[:60] not in seen["repeats"][60].text and len(seen["repeats"][62].text) == len(rows[62])
    assert "[secret]" in seen["secrets"][70].text and set(seen["secrets"]) == set(seen["near_duplicates"])
    assert set(seen["packing"]) == set(seen["secrets"])


def test_one_row_of_each_id_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (3, "one text of its own"), (3, "two quite other words"), (3, None), (4, "alone here"), (None, "no id"), (None, "no id"), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = [(None, "no id"), (None, "no id"), (1, text), (3, "two quite other words"), (4, "alone here"), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_stages_on_an_empty_table(spark, tmp_path):
    sf = f"file://{tmp_path}"
    corpus(spark, sf)
    none = spark.read.parquet(f"{sf}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_each_stage_begins_with_heaps_given_back(spark, monkeypatch):
    """Heap that a stage leaves does not stand beside the next one's workers: a collection on each core comes first."""
    from marginalia.llm import common

    common.give_back_heaps(spark)  # runs wherever tasks run
    begun = []
    monkeypatch.setattr(corpus_pipeline, "give_back_heaps", lambda s: begun.append(s))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        with pytest.raises(Exception):
            stage(spark, None, "/nowhere")  # a stage's own work needs documents
        assert begun == [spark] * k
