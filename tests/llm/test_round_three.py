"""Periodic runs, lexical search and shortest-pack-first packing against brute force, on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import lexical, shortest_packing, tokens, word_runs
from marginalia.llm.common import crc_of_id
from marginalia.llm.queries import vocabulary

WORDS = vocabulary("word_bpe_49k.json")
EMPTY = "doc_id long, text string"
CLASH = ("n", "k", "g", "a", "p", "key", "words", "runs", "item", "rank", "score", "part", "term", "length", "start", "salt", "base", "room", "parts", "id", "none", "x", "lo")


def texts(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        own = []
        while len(own) < r.randint(0, 90):
            if r.random() < 0.3:
                unit = [f"w{r.randrange(6)}" for _ in range(r.randint(1, 9))]
                own += (unit * r.randint(2, 8))[: r.randint(1, 60)]
            own.append(f"w{r.randrange(40)}")
        out.append(r.choice((" ", "  ", "\n", "\t ")).join(own))
    return [*out, out[0], out[0], None, "", "  \n", "a", "a " * 500, "é É é  x x  " * 9, "\x1ca b\x0bc", "b" * 3000]


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame(rows, EMPTY).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


def brute_runs(words, least=6, times=4):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            if words[i] == words[i + p]:
                start = i
                while i + p < len(words) and words[i] == words[i + p]:
                    i += 1
                if i - start + p >= max(least, times * p):
                    found.setdefault((start, i - start + p), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_word_runs(spark):
    rows = [*enumerate(texts(1)), (None, "a b " * 9), (3, "x " * 7)]
    want = []
    for doc, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        if doc is not None and (h := zlib.crc32(str(doc).encode())) % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-math.floor(10**9 * r[1] / r[2]), r[0], r[2]), default=None)
        told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc, len(words), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = word_runs.told(word_runs.word_runs(word_runs.with_planted(frame(spark, rows), crc_of_id()))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.n_runs for r in got) > 50
    assert word_runs.word_runs(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("least,times", [(6, 4), (2, 3), (12, 3), (5, 6)])
def test_runs_of_random_words(least, times):
    r = random.Random(7)
    for _ in range(200):
        docs = []
        for _ in range(r.randint(1, 5)):
            few = r.choice((1, 2, 3, 30))
            docs.append([r.randrange(few) for _ in range(r.randint(0, 40))] * r.choice((1, 1, 2, 5)))
        flat = np.array([w for d in docs for w in d], np.int64)
        got = word_runs.runs_of(flat, np.array([len(d) for d in docs]), least, times) if len(flat) else {}
        assert [got.get(k, []) for k in range(len(docs))] == [brute_runs(d, least, times) for d in docs]


def test_runs_work_grows_with_the_words():
    """Of a stretch of one word every place agrees with every other; neighbours alone are compared."""
    seen = []
    see = word_runs.Pairs.see
    try:
        word_runs.Pairs.see = lambda self, *a: (seen.append(1), see(self, *a))[1]
        steps = []
        for n in (1000, 4000):
            seen.clear()
            assert word_runs.runs_of(np.zeros(n, np.int64), np.array([n])) == {0: [(0, n, 1)]}
            steps.append(len(seen))
    finally:
        word_runs.Pairs.see = see
    assert steps[1] < 5 * steps[0]


def brute_search(docs, items, top=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(cut(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    merged = {}
    for i, t in items:
        merged.setdefault(i, []).extend(cut(t))
    out = []
    for i, ts in merged.items():
        scored = []
        for (doc, c), size in zip(own, sizes):
            m = 75 + 25 * size * n // total if total else 0
            if score := sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in ts if c[t]):
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(i, k, doc, -s) for k, (s, _, doc) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def test_lexical_search(spark):
    docs = [*enumerate(texts(2)), (None, "w1 w2 w3"), (7, "W1.w2-w3;w3"), (8, "w1é w1 É é w1"), (9, "w1.w1|w1"), (10, "<w5>" * 40), (11, "w1_w2 w3\x7fw4")]
    items = [(1, "w1 w2, W3!"), (2, "w1 w1 w1"), (3, ""), (4, None), (5, "nowhere"), (None, "É é x "), (1, "w4"), (6, " ".join(f"w{k}" for k in range(40))), (7, "w3 w3")]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("item", "rank", "score", "doc_id", "part", "k")})
    want = brute_search(docs, sorted(items, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert len(want) > 60
    assert sorted(map(tuple, lexical.search(frame(spark, docs), queries).collect()), key=str) == want
    # Blocks of one item each give the same.
    assert sorted(map(tuple, lexical.search(frame(spark, docs), queries, most=1).collect()), key=str) == want
    assert lexical.search(spark.createDataFrame([], EMPTY), queries).count() == 0
    assert lexical.search(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_search_keeps_the_best_of_many(spark):
    docs = [(i, "a " * (1 + i % 5) + "b " * (i % 7)) for i in range(1500)]
    items = [(0, "a"), (1, "b a"), (2, "b b b")]
    got = lexical.search(spark.createDataFrame(docs, EMPTY).repartition(2), spark.createDataFrame(items, "item_id long, text string"), top=30)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 30)


def placed(got, size):
    """Padding of sequences that are gapless; raises else."""
    places, padding = {}, 0
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    return padding


def test_shortest_packing(spark):
    rows = [*enumerate(texts(3)), (None, "one two three"), (None, None), (3, "another text of id three"), (3, "another text of id three"), (90, "word " * 9000), (91, "word " * 4095), (92, "word " * 4096)]
    tok = tokens.load(WORDS)
    want = Counter()
    for doc, text in rows:
        want[doc, tuple(tok.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    for size in (4096, 64):
        got = shortest_packing.pack(frame(spark, rows), WORDS, size=size).collect()
        assert placed(got, size) == 0
        assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
        # Each part is one of a document with that id and length, and each of its ids lies in one part.
        covered = Counter()
        for r in got:
            own = [ids for doc, ids in want if doc == r.doc_id and len(ids) == r.doc_tokens]
            fits = [ids for ids in own if zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
            assert fits
            for at in range(r.start, r.start + r.length):
                covered[r.doc_id, r.doc_tokens, at] += 1
        assert covered == sum((Counter({(doc, len(ids), at): n for at in range(len(ids))}) for (doc, ids), n in want.items()), Counter())
    assert shortest_packing.pack(spark.createDataFrame([], EMPTY), WORDS).count() == 0


def test_plan_is_whole_and_has_no_padding():
    r = random.Random(4)
    for _ in range(100):
        size = r.choice((8, 64, 4096))
        counts = Counter(r.randint(1, size - 1) for _ in range(r.randint(0, 1500)))
        whole, cut = shortest_packing.plan(counts, size)
        seated = Counter()
        for length, _, n, _, _ in whole:
            seated[length] += n
        assert all(seated[k] <= n for k, n in counts.items())
        assert sum(n - seated[k] for k, n in counts.items()) <= sum(x[2] for x in cut)


def test_few_documents_are_cut():
    r = random.Random(5)
    counts = Counter(min(4095, int(r.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    _, packs, used = shortest_packing.shortest_first(counts, 4096)
    assert sum((4096 - fill) * n for fill, _, n in packs) < 0.01 * 4096 * used
    assert sum(x[2] for x in shortest_packing.plan(counts)[1]) < 0.05 * 20_000


def test_new_chunks_reach_the_library_joined():
    """Ids and their numbers are those of each chunk by itself, from few texts; where an id crosses, chunks go alone."""
    tok = tokens.load(vocabulary("byte_bpe_50k.json"))
    handed = []

    def encode(texts):
        handed.extend(texts)
        return tokens.library(tok)(texts)

    widths = np.array([len(tok.id_to_token(i)) for i in range(tok.get_vocab_size())])
    words = [" " + w for w in ("é", "naïve", "don't", "a.b", "日本", "x=1", "'s", "́mark", *(f"w{i}" for i in range(2000)))]
    mixed = [*words[:900], " ", "glued", ",", " a\n", "\n", *words[900:]]
    coder = tokens.Encoder(encode, "byte", widths=widths)
    ids, counts = coder.joined(mixed)
    assert len(handed) < 20
    want = [tok.encode(t, add_special_tokens=False).ids for t in mixed]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    coder.widths = widths + 1  # no place fits: all go by themselves
    ids, counts = coder.joined(mixed)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [len(x) for x in coder.joined([])] == [0, 0]


def test_blocks_coded_in_groups_are_the_same(monkeypatch):
    from marginalia.llm import id_files

    ids = np.random.default_rng(3).integers(0, 5000, 16 * 21 + 5).astype("<u4")
    whole = id_files.encode(ids, 5000, 16)
    monkeypatch.setattr(id_files, "LANES", 4)
    assert id_files.encode(ids, 5000, 16) == whole and (id_files.decode(whole, len(ids), 5000, 16) == ids).all()


def test_few_rows_of_a_language_count_in_its_threshold():
    """One labelled row of a kind moves the cut, more move it further; equal logits stay on one side; rows of one kind leave it."""
    import numpy as np
    from marginalia.llm.toxicity import PRIOR, best_cut

    one, four = (best_cut(np.array([2.0] * n + [1.0] * 9), np.array([1.0] * n + [0.0] * 9), 0.0) for n in (1, 4))
    assert (one, four) == (1.5 / (1 + PRIOR), 4 * 1.5 / (4 + PRIOR))
    z, y = np.array([3.0, 2.0, 2.0, 2.0, 1.0]), np.array([1.0, 1.0, 1.0, 0.0, 0.0])
    assert best_cut(z, y, 1.5) == 1.5
    assert best_cut(z, np.zeros(5), 0.7) == best_cut(np.zeros(0), np.zeros(0), 0.7) == best_cut(z, np.ones(5), 0.7) == 0.7
