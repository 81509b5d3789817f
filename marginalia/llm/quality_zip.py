"""Operator 8: compression classifier with dictionaries of good and bad text.

Two zstandard dictionaries are built from labelled text, one from good and one
from bad documents.  A text is cut into segments, each compressed with either
dictionary; the difference of the two sizes, divided by the segment's bytes, is
large where the text looks like the good texts.  A logistic curve over the
mean, the least and the spread of these differences makes the score.

Fitting takes a bounded sample of labelled documents (``limit`` and
``common.FITTING`` bytes, picked by a hash of the id): half builds the
dictionaries, half fits the curve.  The library trains each dictionary on every
segment of every text of its kind in the first half, and picks what recurs in
them.  Scoring takes every segment of every text.

Each case has a result: null and empty texts have no segments and get the
curve's value at zeros; no labelled rows, or labels of one kind, give that
kind's share as every score (0.5 without labels); repeated rows are scored
each; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import mapped, own_columns, pick_labelled

#: Labelled documents that fitting takes at most.
LIMIT = 6000
SEGMENT = 1500
#: Bytes of a dictionary, and of the segments that it is trained on.
DICTIONARY, SAMPLE = 64 << 10, 4096
LEVEL = 3
THRESHOLD = 0.7
FEATURES = 4


def segments(text: bytes, size: int = SEGMENT) -> list[bytes]:
    """The text in parts of nearly equal length, ``size`` bytes at most."""
    n = -(-len(text) // size)
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


class Pair:
    """Compressors with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        def compressor(raw: bytes):
            d = z.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.good, self.bad = compressor(good), compressor(bad)

    def features(self, text: str) -> list[float]:
        """Mean, least and spread of the normalised differences, and the ratio of the compressed text."""
        raw = text.encode("utf-8", "replace")
        parts = segments(raw)
        if not parts:
            return [0.0] * FEATURES
        g = [len(self.good.compress(p)) for p in parts]
        b = [len(self.bad.compress(p)) for p in parts]
        d = [(y - x) / len(p) for x, y, p in zip(g, b, parts)]
        mean = sum(y - x for x, y in zip(g, b)) / len(raw)
        return [mean, min(d), max(d), min(sum(g), sum(b)) / len(raw)]


def build(texts: list[str], size: int = DICTIONARY) -> bytes:
    """A dictionary of ``size`` bytes at most, trained on all of all texts.

    Too few or too short texts to train on are the dictionary themselves.
    """
    import zstandard as z

    raw = [t.encode("utf-8", "replace") for t in texts if t]
    try:
        return z.train_dictionary(size, [part for t in raw for part in segments(t, SAMPLE)]).as_bytes()
    except (z.ZstdError, ValueError):
        return b"\n".join(raw) or b" " * 8


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (last: constant) of a logistic curve, by Newton steps with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = LIMIT) -> dict:
    """Dictionaries and curve from the labelled rows for which ``usable`` holds."""
    rows = pick_labelled(docs, labels, "quality", usable, limit)
    # By a hash, as ids may go by source or language.
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    y = np.array([r[2] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return {"constant": 0.5 if not len(y) else float(y[0])}
    # Rows of either kind are dealt in turn, so that both halves have both.
    order = np.argsort(y, kind="stable")
    for_dictionary, for_curve = order[::2], order[1::2]
    good, bad = (build([rows[i][1] for i in for_dictionary if rows[i][2] == k]) for k in (1, 0))
    pair = Pair(good, bad)
    x = np.array([pair.features(rows[i][1]) for i in for_curve])
    mean, scale, w = fit_curve(x, y[for_curve])
    return {"good": good, "bad": bad, "mean": mean, "scale": scale, "w": w}


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document; a narrow job."""
    if "constant" in model:
        p = F.lit(model["constant"]).cast("double")
        return own_columns(docs, "doc_id").select("doc_id", p.alias("score"), (p >= threshold).cast("int").alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes at most, or the few texts that were too short to train on

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        pair = Pair(m["good"], m["bad"])
        for b in batches:
            x = np.array([pair.features(t.as_py() or "") for t in b.column(1)]).reshape(-1, FEATURES)
            z = ((x - m["mean"]) / m["scale"]) @ m["w"][:-1] + m["w"][-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype("int32"))], ["doc_id", "score", "predicted"])

    return mapped(own_columns(docs, "doc_id", "text"), run, "doc_id long, score double, predicted int")
