"""Operator 2: convolutional text classifier with hashed words.

A word (letters of any script, lower case) and its first letters are hashed to
rows of an embedding table, whose sum stands for the word; filters of several
widths run over the words of a whole text, the largest answer of each filter is
kept, and a linear layer makes the logit.  It is
trained in numpy; only the places where a filter was largest get a gradient.

Thresholds are calibrated by language: the language is guessed from the text
itself (its function words), and the logit is shifted so that 0.5 is where the
labelled rows of that language that did not train the network, a fifth of them
all, are told apart best.  No given language, source,
id or label enters a score.

Fitting takes a bounded sample of labelled documents (``limit`` and
``common.FITTING`` bytes, picked by a hash of the id).  Scoring runs over every word of every text.

Each case has a result: null and empty texts, and texts without letters, get
the score of a text whose filters all answer 0; no labelled rows, or labels of
one kind, give that kind's share (0.5 without labels); repeated rows are scored
each; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import slices
from .common import give_back, kept, mapped, own_columns, pick_labelled

#: Labelled documents that fitting takes at most.
LIMIT = 8000
BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 32, 0.02
#: Mini-batches at least; few rows are gone over more often.
STEPS = 600
#: Labelled rows of the rarer kind that weigh as much as what holds without them, in a language's threshold.
PRIOR = 20
#: Function words by which a text's language is guessed (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with are this be as on",
    "fr": "le la les des et un une qui que dans pour pas est elle il par",
    "de": "der die das und den dem ein eine nicht mit ist von zu auf ich sie",
    "es": "el los las del y una que en por con para es su no se lo",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_WORD = re.compile(r"[^\W\d_]+")
_BY_LANGUAGE = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

#: Lengths of the beginnings of a word that are hashed beside the whole word.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Words whose vectors a worker remembers, and bytes of text whose words are in memory at a time.
MEMO, PART = 120_000, 250_000


def rows(word: str) -> list[int]:
    """Rows of a word and of its beginnings: crc32 by the table's size; row 0, always zero, where there is none."""
    cut = ["=" + word, *("<" + word[:k] if len(word) > k else "" for k in BEGINNINGS)]
    return [1 + crc32(c.encode("utf-8", "replace")) % (BUCKETS - 1) if c else 0 for c in cut]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Known:
    """A memory of words: each has a number, and a row in ``values`` that ``make`` fills."""

    def __init__(self, make, width: int, kind, most: int | None = MEMO):
        self.make, self.number, self.values, self.most = make, {}, np.empty((0, width), kind), most

    def numbers(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the words of several texts; new words are made at once."""
        if self.most is not None and len(self.number) > self.most:
            self.number = {}
        number = self.number
        new = list({w for x in lists for w in x if w not in number})
        if new:
            lo, hi = len(number), len(number) + len(new)
            number.update(zip(new, range(lo, hi)))
            if hi > len(self.values):  # doubled, so that growing costs in proportion
                self.values = np.concatenate([self.values[:lo], np.empty((2 * hi - lo, self.values.shape[1]), self.values.dtype)])
            self.values[lo:hi] = self.make(np.array([rows(w) for w in new], np.int32))
        return [np.fromiter(map(number.__getitem__, x), np.int32, len(x)) for x in lists]


def language(found: list[str]) -> int:
    """Index in LANGUAGES of the language whose function words are most; ties: the first."""
    counts = [0] * len(_BY_LANGUAGE)
    for k, known in enumerate(_BY_LANGUAGE.values()):
        counts[k] = sum(map(known.__contains__, found))
    best = max(counts)
    return counts.index(best) if best else len(LANGUAGES) - 1


class Cnn:
    """The network's weights and steps."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = (r.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
        self.e[0] = 0
        self.k = [(r.standard_normal((w * WIDTH, FILTERS)) / np.sqrt(w * WIDTH)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = (r.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.c = np.float32(0)

    def vectors(self, sub: np.ndarray) -> np.ndarray:
        """The words whose rows are given, as sums of them."""
        return self.e[sub].sum(-2)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's largest answer (0 at least) over a text's vectors, and where."""
        n = max(len(x), 1)
        x = np.concatenate([x, np.zeros((n - len(x) + WIDTHS[-1] - 1, WIDTH), np.float32)])
        best, where = [], []
        for w, k, b in zip(WIDTHS, self.k, self.b):
            a = x[:n] @ k[:WIDTH]
            for i in range(1, w):
                a += x[i : n + i] @ k[i * WIDTH : (i + 1) * WIDTH]
            at = a.argmax(0)
            where.append(at)
            best.append(np.maximum(a[at, np.arange(FILTERS)] + b, 0))
        return np.concatenate(best), where

    def logit(self, x: np.ndarray) -> float:
        return float(self.pooled(x)[0] @ self.v + self.c)

    def train(self, texts: list[np.ndarray], sub: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adagrad over mini-batches; rare labels weigh more.  ``texts`` has numbers of words, ``sub`` their rows."""
        r = np.random.default_rng(seed)
        up = float(np.sqrt((1 - y.mean()) / y.mean()))
        sums = {n: 1e-6 for n in ("v", "c")}
        ge, gk, gb = np.full(BUCKETS, 1e-6, np.float32), [np.full_like(k, 1e-6) for k in self.k], [np.full_like(b, 1e-6) for b in self.b]
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(texts)))):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                dv, dc = np.zeros_like(self.v), 0.0
                dk, db = [np.zeros_like(k) for k in self.k], [np.zeros_like(b) for b in self.b]
                touched, grads = [], []
                for t in part:
                    x = self.vectors(sub[texts[t]])
                    h, where = self.pooled(x)
                    x = np.concatenate([x, np.zeros((WIDTHS[-1], WIDTH), np.float32)])
                    ids = np.concatenate([sub[texts[t]], np.zeros((WIDTHS[-1], sub.shape[1]), np.int32)])
                    p = 1 / (1 + np.exp(-float(h @ self.v + self.c)))
                    g = np.float32((p - y[t]) * (up if y[t] else 1) / len(part))
                    dv += g * h
                    dc += g
                    gh = g * self.v * (h > 0)
                    for j, w in enumerate(WIDTHS):
                        own, at = gh[j * FILTERS : (j + 1) * FILTERS], where[j]
                        if not own.any():
                            continue
                        near = at[:, None] + np.arange(w)
                        dk[j] += (x[near].reshape(FILTERS, -1) * own[:, None]).T
                        db[j] += own
                        touched.append(ids[near].ravel())
                        grads.append(np.repeat((own[:, None] * self.k[j].T).reshape(-1, WIDTH), sub.shape[1], 0))
                rate = RATE
                sums["v"] = sums["v"] + dv * dv
                self.v -= rate * dv / np.sqrt(sums["v"])
                sums["c"] += dc * dc
                self.c -= np.float32(rate * dc / np.sqrt(sums["c"]))
                for j in range(len(WIDTHS)):
                    gk[j] += dk[j] ** 2
                    self.k[j] -= rate * dk[j] / np.sqrt(gk[j])
                    gb[j] += db[j] ** 2
                    self.b[j] -= rate * db[j] / np.sqrt(gb[j])
                if touched:
                    at, inv = np.unique(np.concatenate(touched), return_inverse=True)
                    d = np.zeros((len(at), WIDTH), np.float32)
                    np.add.at(d, inv, np.concatenate(grads))
                    ge[at] += (d * d).mean(1)
                    step = rate * d / np.sqrt(ge[at])[:, None]
                    step[at == 0] = 0
                    self.e[at] -= step


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = LIMIT) -> dict:
    """Network and thresholds from the labelled rows for which ``usable`` holds."""
    known = pick_labelled(docs, labels, "toxic", usable, limit)
    y = np.array([r[2] for r in known], np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": 0.5 if not len(y) else float(y[0])}
    seen = Known(lambda sub: sub, 1 + len(BEGINNINGS), np.int32, most=None)
    texts, langs = [], []
    for lo in range(0, len(known), 200):  # so that the words of a few texts are in memory at a time
        found = [words(r[1]) for r in known[lo : lo + 200]]
        texts += seen.numbers(found)
        langs += map(language, found)
    langs = np.array(langs)
    fitting = np.arange(len(y)) % 5 != 0
    net = Cnn()
    net.train([t for t, f in zip(texts, fitting) if f], seen.values, y[fitting])
    z, y, langs = np.array([net.logit(net.vectors(seen.values[t])) for t, f in zip(texts, fitting) if not f]), y[~fitting], langs[~fitting]
    whole = best_cut(z, y, 0.0, 0)
    shift = [best_cut(z[langs == k], y[langs == k], whole) for k in range(len(LANGUAGES))]
    del known, texts, seen
    give_back()
    return {"net": net, "shift": np.array(shift)}


def best_cut(z: np.ndarray, y: np.ndarray, default: float, prior: int = PRIOR) -> float:
    """The logit that tells apart best (F1), the middle of the gap under it, drawn to ``default`` as by ``prior`` rows.

    However few rows there are, each counts: what draws to the cut is how many
    rows of the rarer kind there are.  With rows of one kind nothing can be told
    apart, and ``default`` stays.  Equal logits stay on one side.
    """
    rarer = min(y.sum(), len(y) - y.sum())
    if not rarer:
        return float(default)
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + hit[-1])
    f1[:-1][z[1:] == z[:-1]] = -1
    k = int(f1.argmax())
    return float((rarer * (z[k] + z[min(k + 1, len(z) - 1)]) / 2 + prior * default) / (rarer + prior))


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, score and predicted of every document; a narrow job."""
    if "constant" in model:
        p = F.lit(model["constant"]).cast("double")
        return own_columns(docs, *keep).withColumns({"score": p, "predicted": (p >= 0.5).cast("int")})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * WIDTH floats and some, whatever the corpus

    def probabilities(texts, known: Known) -> np.ndarray:
        net, shift = shared.value["net"], shared.value["shift"]
        out = []
        for lo, hi in slices(texts, PART):
            found = [words(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
            out += [net.logit(known.values[n]) - shift[language(f)] for n, f in zip(known.numbers(found), found)]
        return 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = kept(("words", shared.value["net"].v.tobytes()), lambda: Known(shared.value["net"].vectors, WIDTH, np.float32))
        for b in batches:
            p = probabilities(b.column(at), known)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype("int32"))], [*keep, "score", "predicted"])

    at = keep.index("text") if "text" in keep else len(keep)
    texts = own_columns(docs, *keep) if "text" in keep else own_columns(docs, *keep, "text")
    return mapped(texts, run, own_columns(docs, *keep).schema.add("score", "double").add("predicted", "integer"))
