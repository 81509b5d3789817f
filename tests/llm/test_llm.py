"""Numbered operators against brute force, round trips and held-out accuracy, on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bpe, id_files, jaccard, media, packing, quality_rules, quality_zip, repeats, secrets, tokens, toxicity
from marginalia.llm.common import crc_of_id, pick_labelled
from marginalia.llm.components import components
from marginalia.llm.queries import vocabulary

BYTE, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = ["a  b", "a   b", "a\n b", "a \nb", " a", "a ", "", "\n\n a\n\n\nb  ", "it's don't 've a.'s", "<|endoftext|> x", "<|startoftext|>a", "éa x", "x y", " a b", "\x1ca b", "tab\tx y", "ΑΒΓ ǅ İstanbul", "a_b1c2 3.5 ½²", "emoji 😀😀 x", "a​b c", "\r\n x", "a\nb\nc\nd", "Á.b—.c É,É;", "x≠y ok.", "d'une l'été's", "A" * 50, "!!! ??? a!!b"]


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(140))
    out = []
    for _ in range(n):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(0, 200)))
        out.append(t + (" " + passage[r.randint(0, 80):] if r.random() < 0.3 else ""))
    return out + out[:4] + [None, "", "a", "a" * 1500, "ab" * 500, "é" * 450]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    # Names that the operators use inside must not clash with the input's.
    return df.withColumns({c: F.lit("x") for c in ("key", "n", "list", "a", "b", "region", "component", "score", "salt", "digest", "start", "hot")}) if extra else df.repartition(3)


EMPTY = "doc_id long, text string"


def test_bpe_equals_library(spark):
    rows = [*texts(), *ODD]
    tok = tokens.load(BYTE)
    want = []
    for i, t in enumerate(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_decode(frame(spark, rows, True), BYTE).collect())) == want
    back = bpe.decoded(bpe.token_ids(frame(spark, rows), BYTE), BYTE).collect()
    assert all(r.text == (rows[r.doc_id] or "") for r in back)
    assert bpe.encode_decode(spark.createDataFrame([], EMPTY), BYTE).count() == 0


@pytest.mark.parametrize("kind,path", [("byte", BYTE), ("word", WORDS)])
def test_chunked_encoder_equals_library(kind, path):
    import pyarrow as pa

    rows = [t or "" for t in texts(2)] + ODD
    ids, starts = tokens.encoder(path, kind).batch(pa.array(rows))
    tok = tokens.load(path)
    for i, t in enumerate(rows):
        assert ids[starts[i] : starts[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_packing(spark):
    rows = [*texts(3), "word " * 5000]
    tok = tokens.load(WORDS)
    got = packing.pack(frame(spark, rows, True), WORDS).collect()
    for i, t in enumerate(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 2048))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(r.length for r in own) == len(ids) and all(r.length == 2048 for r in own[:-1])
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(spark.createDataFrame([], EMPTY), WORDS).count() == 0


def test_plan_uses_few_sequences():
    r = random.Random(4)
    counts = Counter(r.randint(1, 2047) for _ in range(3000))
    used = {f + i for _, _, n, f, _ in packing.plan(counts) for i in range(n)}
    assert len(used) <= 1.05 * sum(k * n for k, n in counts.items()) / 2048 + 1


@pytest.mark.parametrize("ids", [[], [5], list(range(3000)), [7] * 5000, list(np.random.default_rng(5).integers(0, 50257, 5000))])
def test_coder_round_trip(ids):
    x = np.array(ids, "<u4")
    docs, sizes, back = id_files.open_container(id_files.pack_container([1, None], np.array([len(ids), 0]), x, 50_257))
    assert back.tolist() == ids and docs == [1, None] and sizes.tolist() == [len(ids), 0]


def test_damaged_block_is_refused():
    data = bytearray(id_files.pack_container([1], np.array([4000]), np.arange(4000, dtype="<u4"), 50_257))
    data[-20] ^= 1
    with pytest.raises(ValueError):
        id_files.open_container(bytes(data))


def test_id_containers(spark):
    rows = texts(6)
    tok = tokens.load(BYTE)
    want, at = [], 0
    for i, t in enumerate(rows):
        x = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, id_files.write_and_read(frame(spark, rows, True), BYTE).collect())) == want
    assert id_files.write_and_read(spark.createDataFrame([], EMPTY), BYTE).count() == 0


def brute_repeats(rows, length):
    raws, seen = [(t or "").encode() for t in rows], {}
    for d, r in enumerate(raws):
        for i in range(len(r) - length + 1):
            seen.setdefault(r[i : i + length], []).append((d, i))
    marks = [np.zeros(len(r) + 1, bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                marks[d][i : i + length] = True
    out = []
    for d, r in enumerate(raws):
        m = marks[d][:-1]
        kept = bytes(np.frombuffer(r, np.uint8)[~m])
        out.append((d, len(r), int(m.sum()), int(np.diff(np.concatenate([[0], m.astype(int)])).clip(0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_repeats_equal_brute_force(spark, length):
    rows = texts(7)
    got = repeats.removed(frame(spark, rows, True), length).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, length)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    share = lambda n: {i for i, w in enumerate(words) if runs(w, n) & set().union(*(runs(v, n) for j, v in enumerate(words) if j != i))}
    assert share(repeats.PASSAGE) <= {r.doc_id for r in got if r.n_shared} <= share(repeats.WORDS)


def test_repeats_on_no_rows(spark):
    assert repeats.removed(spark.createDataFrame([], EMPTY)).count() == 0


def brute_jaccard(rows):
    sets = []
    for t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, label))]


@pytest.mark.parametrize("pivots,least", [(1, 2), (2, 8)])
def test_jaccard_equals_brute_force(spark, pivots, least):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(800)]
    rows = texts(8, 30)
    for size in (8, 60, 300):
        base = [r.choice(vocab) for _ in range(size)]
        for _ in range(14):
            x = list(base)
            for _ in range(int(r.random() * 0.06 * size)):
                x[r.randrange(size)] = r.choice(vocab)
            rows.append(" ".join(x))
    rows += ["one two three four", "ONE two\tthree  four", "one", "One"]
    assert sorted(map(tuple, jaccard.joined(frame(spark, rows, True), pivots, least).collect())) == brute_jaccard(rows)


@pytest.mark.parametrize("pivots,least,block", [(2, 4, 1000), (3, 16, 5)])
def test_jaccard_near_the_bound(spark, monkeypatch, pivots, least, block):
    """Copies of one base that differ in so many words that about half of the pairs link."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(11)
    rows = []
    for size, wrong, copies in ((60, 0, 30), (90, 1, 40), (140, 2, 40)):
        base = [f"b{size}x{i}" for i in range(size)]
        for k in range(copies):
            x = list(base)
            for _ in range(wrong + k % 2):
                x[r.randrange(size)] = f"u{r.random()}"
            rows.append(" ".join(x + [f"t{r.random()}" for _ in range(k % 4 * size // 60)]))
    want = brute_jaccard(rows)
    assert 3 < len({c for _, _, c in want}) < len(rows) - 20
    assert sorted(map(tuple, jaccard.joined(frame(spark, rows, True), pivots, least).collect())) == want


def test_jaccard_pairs_of_one_frame_stay_flat(spark, monkeypatch):
    """Documents that share 30 of 40 shingles, of one frame, and link with none."""
    seen = []
    compared = jaccard._compared

    def counted(docs, sets, pairs, known):
        seen.append(pairs.count())
        return compared(docs, sets, pairs, known)

    monkeypatch.setattr(jaccard, "_compared", counted)
    common = " ".join(f"c{i}" for i in range(34))
    for n in (50, 200, 800):
        seen.clear()
        rows = [common + "".join(f" u{d}x{i}" for i in range(10)) for d in range(n)]
        got = jaccard.joined(frame(spark, rows)).collect()
        assert all(r.component_id == r.doc_id and r.n_shingles == 40 for r in got) and len(got) == n
        assert sum(seen) <= 2 * n


def test_jaccard_ids_that_repeat_or_are_null(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None)]
    got = sorted(map(tuple, jaccard.joined(spark.createDataFrame(rows, EMPTY)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (3, 2, 1), (4, 0, 4)], key=str)
    assert jaccard.joined(spark.createDataFrame([], EMPTY)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_rules(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def labels_for(spark, n, bad):
    return spark.createDataFrame([(i, int(i not in bad), int(i in bad)) for i in range(n)], "doc_id long, quality int, toxic int")


def test_quality_rules(spark):
    good = [f"the sun w{i % 7} shines on field {i} and x{i * 7} river y{i * 3} " * 2 + " ".join(f"leaf{(i * k) % 97} tree{(i + k) % 89}," for k in range(25)) for i in range(60)]
    junk = [" ".join(f"W{(i * k) % 97}%%% &&& #{k}" for k in range(40)) for i in range(12)]
    rows = good + junk + [None, "", "same line\nsame line\n\n \nx", "a b c a b c a b c", "a b c d"]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows), labels_for(spark, 60 + 12, set(range(60, 72)))).collect()}
    for i, t in enumerate(rows):
        r, (n, chars, symbols, dup, rep) = got[i], brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
    assert all(got[i].kept for i in range(60) if not got[i].base_failed) and not any(got[i].kept for i in range(60, 72))
    assert quality_rules.judge(spark.createDataFrame([], EMPTY), labels_for(spark, 3, set())).count() == 0


def test_ratio_equals_brute_force(spark):
    rows = ["a b, c a", "b c d!", "a a", None]
    got = {r.doc_id: r.llr for r in quality_rules.judge(frame(spark, rows), labels_for(spark, 2, {1})).collect()}
    units = [re.findall(r"\w+|[^\w\s]+", t or "") for t in rows]
    grams = [[(u,) for u in x] + list(zip(x, x[1:])) for x in units]
    raw, good = Counter(g for x in grams for g in x), Counter(grams[0])
    room = quality_rules.BUCKETS
    w = {g: np.log((good[g] + 1) / (sum(good.values()) + room)) - np.log((raw[g] + 1) / (sum(raw.values()) + room)) for g in raw}
    for i, x in enumerate(grams):
        assert abs(got[i] - (np.mean([w[g] for g in x]) if x else 0)) < 1e-6


def test_media_round_trip(spark):
    rows = texts(9)
    got = media.media_columns(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        raw = (rows[r.doc_id] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256, r.height) == (len(stored), hashlib.sha256(stored).hexdigest(), len(payload) // 192)
        assert by_text.setdefault(raw, r.feature) == r.feature
    assert media.media_columns(spark.createDataFrame([], EMPTY)).count() == 0


def test_media_shards_are_tar_files(spark, tmp_path):
    import tarfile

    folder = f"file://{tmp_path}/shards"
    df = spark.createDataFrame([("d1", bytearray(b"x" * 192)), ("d2", bytearray(b"y" * 384))], "digest string, payload binary")
    index = media.write_shards(df.coalesce(1), folder).collect()
    (name,) = {r["shard"] for r in index}
    with tarfile.open(tmp_path / "shards" / name) as tar:
        assert {m.name: media.from_png(tar.extractfile(m).read()) for m in tar} == {"d1.png": b"x" * 192, "d2.png": b"y" * 384}
    heads = media.read_headers(spark.createDataFrame(index), folder).collect()
    assert {(r.digest, r.width, r.height) for r in heads} == {("d1", 64, 1), ("d2", 64, 2)}


def test_secrets_beside_their_names(spark):
    h = hashlib.sha256(b"beside").hexdigest()
    ghp, mixed, long_name = "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "AbCdEfGhIjKlMnOpQrStUvWxYzabcdef", "SERVICE_2_ACCESS_KEY"
    secret = {0: f"API_KEY={h[:40]}", 1: f"see https://x.example/a?access_token={ghp}&page=2", 2: 'password: "hunter2-Tr0ub"', 3: f'token = "{mixed}"', 4: f"export {long_name}={h[:32]}", 5: "password=hunter2-Tr0ub"}
    want = {0: h[:40], 1: ghp, 2: "hunter2-Tr0ub", 3: mixed, 4: h[:32], 5: "hunter2-Tr0ub"}
    plain = {6: "password: required", 7: "the access control of another management", 8: "Summary: something between", 9: f"commit={h[:40]}", 10: "date: 2024-01-02", 11: "tokens of fourteen letters"}
    rows = {**secret, **plain}
    model = secrets.train(secrets.default_findings(spark))
    found = secrets.scan(spark.createDataFrame(list(rows.items()), EMPTY), model).collect()
    assert {(r.doc_id, r.candidate) for r in found if r.is_secret} == set(want.items())
    assert all(rows[r.doc_id][r.pos : r.pos + len(r.candidate)] == r.candidate and rows[r.doc_id][: r.pos].endswith(r.before) and len(r.before) == min(r.pos, secrets.NEAR) for r in found)
    assert {r.doc_id for r in found} >= {6, 7, 8, 9, 10} and 11 not in {r.doc_id for r in found}
    # Padding belongs to a candidate and counts to its length, a name before '=' does not.
    padded = spark.createDataFrame([(0, "of aGVsbG8gd29y1A== here"), (1, "x1234567890123=y1")], EMPTY)
    assert [(r.doc_id, r.candidate) for r in secrets.candidates(padded).collect()] == [(0, "aGVsbG8gd29y1A==")]
    # A short secret is masked where it stands by itself, not inside other words.
    clean = secrets.redact(spark.createDataFrame([(0, "password=hunter2-Tr0ub or hunter2-Tr0ub, not xhunter2-Tr0uby")], EMPTY), model, mask="<$1>").first().text
    assert clean == "password=<$1> or <$1>, not xhunter2-Tr0uby"


def test_secrets(spark):
    model = secrets.train(secrets.default_findings(spark, 60), trees=12)
    h = hashlib.sha256(b"x").hexdigest()
    rows = [f'some token = "{h[:40]}" here', f"commit {h[10:50]} of it", "see /usr/share/doc/v2/index.html today", "plain text", None, "", f'password: "{h[:32]}" and token = "{h[8:48]}"']
    found = secrets.scan(frame(spark, rows), model).collect()
    hits = {r.doc_id for r in found if r.is_secret}
    assert hits == {0, 6} and sum(r.is_secret for r in found if r.doc_id == 6) == 2
    assert all(rows[r.doc_id][r.pos : r.pos + len(r.candidate)] == r.candidate for r in found)
    clean = {r.doc_id: r.text for r in secrets.redact(frame(spark, rows), model).collect()}
    assert h[:40] not in clean[0] and "[secret]" in clean[0] and clean[3] == "plain text" and clean[4] is None and h[8:48] not in clean[6] and clean[1] == rows[1]
    assert secrets.scan(spark.createDataFrame([], EMPTY), model).count() == 0
    with pytest.raises(ValueError):
        secrets.train(secrets.default_findings(spark, 5).filter("label = 1"))


def labelled(n=240):
    r = random.Random(10)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ren", "tas", "vel", "dor") for c in ("a", "en", "is", "ot", "um")]
    rows, bad = [], set()
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        if i % 3 == 0:
            bad.add(i)
            w[r.randrange(len(w))] = r.choice(["zogg", "brukk"])
            w = [x + "%%%" if k % 2 else x.upper() for k, x in enumerate(w)]
        rows.append(" ".join(w))
    return rows, bad


def test_toxicity_held_out(spark):
    rows, bad = labelled(900)
    rows = [t.lower().replace("%", "") for t in rows] + [None, ""]
    held = F.pmod(crc_of_id(), F.lit(5)) == 0
    model = toxicity.fit(frame(spark, rows), labels_for(spark, 900, bad), ~held)
    got = toxicity.score(frame(spark, rows), model).withColumn("held", held).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [r for r in got if r.held and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id in bad) for r in test]) >= 0.9
    none = toxicity.fit(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"), ~held)
    assert {r.score for r in toxicity.score(frame(spark, rows), none).collect()} == {0.5}


def test_language_counts_all_words():
    for k, (name, known) in enumerate(toxicity.FUNCTION_WORDS.items()):
        word = next(w for w in known.split() if not any(w in v.split() for n, v in toxicity.FUNCTION_WORDS.items() if n != name))
        assert toxicity.language(["xyzzy", word] * 2000) == k
        assert toxicity.language(["xyzzy"] * 9998 + [word, "xyzzy"]) == k


def test_quality_dictionary_sees_whole_texts():
    r = random.Random(12)
    noise = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    mark = "a phrase that recurs far behind the start of every text"
    got = quality_zip.build([noise(9_000) + mark + noise(9_000) for _ in range(60)])
    assert len(got) <= quality_zip.DICTIONARY and mark.encode() in got
    # Too few to train on: the texts themselves.
    assert quality_zip.build(["short text"]) == b"short text" and quality_zip.build(["", None]) == b" " * 8


def test_quality_scores_equal_recomputed_sizes(spark):
    """Scores from sizes that the library gives for each segment of whole texts, one by one."""
    import zstandard as z

    rows, bad = labelled()
    rows += [None, "", rows[0], rows[0], "long " * 9000]
    model = quality_zip.fit(frame(spark, rows), labels_for(spark, 240, bad), F.lit(True))
    shrink = [z.ZstdCompressor(dict_data=(lambda d: (d.precompute_compress(level=quality_zip.LEVEL), d)[1])(z.ZstdCompressionDict(model[k])), write_checksum=False, write_content_size=False, write_dict_id=False) for k in ("good", "bad")]
    want = {}
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        n = -(-len(raw) // quality_zip.SEGMENT)
        sizes = [[len(c.compress(raw[len(raw) * k // n : len(raw) * (k + 1) // n])) for k in range(n)] for c in shrink]
        own = [len(raw) * (k + 1) // n - len(raw) * k // n for k in range(n)]
        gaps = [(y - x) / m for x, y, m in zip(*sizes, own)]
        f = [(sum(sizes[1]) - sum(sizes[0])) / len(raw), min(gaps), max(gaps), min(map(sum, sizes)) / len(raw)] if raw else [0.0] * 4
        want[i] = 1 / (1 + math.exp(-sum(w * (x - m) / s for w, x, m, s in zip(model["w"], f, model["mean"], model["scale"])) - model["w"][-1]))
    got = {r.doc_id: r for r in quality_zip.score(frame(spark, rows, True), model).collect()}
    assert len(got) == len(rows) and all(abs(got[i].score - p) < 1e-9 and got[i].predicted == int(got[i].score >= 0.7) for i, p in want.items())
    assert quality_zip.score(spark.createDataFrame([], EMPTY), model).count() == 0


def test_fitting_stops_at_its_bound(spark):
    """Of labelled texts the first by hash are taken; a long one ends them, and is not passed over for shorter ones."""
    rows = [(i, "x" * (50 if i % 3 else 500)) for i in range(60)] + [(7, "again")]
    docs, labels = spark.createDataFrame(rows, EMPTY), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    order = [r.doc_id for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).collect()]
    got = {r[0] for r in pick_labelled(docs, labels, "toxic", F.lit(True), 60, 2000)}
    assert got == set(order[: len(got)]) and 4 <= len(got) < 60
    assert len(pick_labelled(docs, labels, "toxic", F.lit(True), 60, 1)) == 1


def test_toxicity_equals_a_naive_pass(spark):
    """Scores from sums of word vectors and filters in plain loops."""
    rows, bad = labelled(300)
    rows = [t.lower().replace("%", "") for t in rows] + [None, "", rows[0], rows[0], "zogg " * 3000]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame([(i, int(i in bad)) for i in range(300)], "doc_id long, toxic int"), F.lit(True))
    net, seen = model["net"], toxicity.Known(lambda sub: sub, 1 + len(toxicity.BEGINNINGS), np.int32, most=None)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows, True), model).collect()}
    for i, t in list(enumerate(rows))[::17] + list(enumerate(rows))[-5:]:
        own = toxicity.words(t or "")
        (numbers,) = seen.numbers([own])
        x = [sum(net.e[row].astype(float) for row in seen.values[n]) for n in numbers]
        n = max(len(x), 1)
        x += [np.zeros(toxicity.WIDTH)] * (n - len(x) + toxicity.WIDTHS[-1] - 1)
        pooled = [max(0.0, max(float(np.concatenate(x[at : at + w]) @ k[:, f]) for at in range(n)) + float(b[f])) for w, k, b in zip(toxicity.WIDTHS, net.k, net.b) for f in range(toxicity.FILTERS)]
        z = sum(p * float(v) for p, v in zip(pooled, net.v)) + float(net.c) - model["shift"][toxicity.language(own)]
        assert abs(got[i].score - 1 / (1 + math.exp(-min(30, max(-30, z))))) < 1e-3, i
        assert got[i].predicted == int(got[i].score >= 0.5)


def test_secret_scores_equal_votes_of_trees(spark):
    """Features by plain Python, and the forest's share recounted tree by tree from its written rules."""
    model = secrets.train(secrets.default_findings(spark, 40), trees=6, depth=4)
    h = hashlib.sha256(b"z").hexdigest()
    rows = [f'token = "{h[:40]}" here', f"commit {h[10:50]} of it", "see /usr/share/doc/v2/index.html today", 'password: "hunter2-Tr0ub"', "password: required", None, "", f"key={h[:20]}" * 1, "x " * 4000 + f"secret: {h[:24]}"]
    found = secrets.scan(frame(spark, rows, True), model).collect()
    assert {r.doc_id for r in found} >= {0, 1, 2, 3, 4, 7, 8}
    count = lambda p, c: len(re.findall(p, c))
    named = lambda words, b: bool(re.search(r"(?i)(?<![a-z])(" + "|".join(words.split()) + r")(?![a-z])\W{0,6}$", b))

    def vector(b, c, a):
        n = len(c)
        turns = count("[a-z](?=[^a-z])", c) + count("[A-Z](?=[^A-Z])", c) + count("[0-9](?=[^0-9])", c)
        left = re.sub("|".join(sorted(secrets.DICTIONARY.split(), key=len, reverse=True)), "", c.lower())
        return [n, count("[0-9]", c) / n, count("[A-Z]", c) / n, count("[a-z]", c) / n, count("[^A-Za-z0-9]", c) / n, turns, turns / n, len(set(c)) / n, bool(re.fullmatch("[0-9a-fA-F]+", c)), (n - len(left)) / n,
                count("/", c), count(r"\.", c), count("[-_]", c), bool(re.search(r"\.[a-z]{2,4}[0-9]?$", c)), bool(re.search(r"""[=:]\s*["']?$""", b)), bool(re.search(r"""["']$""", b) and re.search(r"""^["']""", a)), named(secrets.SECRET_WORDS, b), named(secrets.OTHER_WORDS, b)]

    def share(tree, x):
        node = tree._call_java("rootNode")
        while node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.impurityStats().prob(1.0)

    for r in found:
        x = vector(r.before, r.candidate, r.after)
        assert abs(r.score - np.mean([share(t, x) for t in model.trees])) < 1e-6, r
        assert r.is_secret == (r.score >= 0.5) and rows[r.doc_id][r.pos : r.pos + len(r.candidate)] == r.candidate


def test_quality_held_out(spark):
    rows, bad = labelled()
    rows += [None, ""]
    held = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = quality_zip.fit(frame(spark, rows), labels_for(spark, 240, bad), ~held)
    got = quality_zip.score(frame(spark, rows), model).withColumn("held", held).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    test = [r for r in got if r.held and r.doc_id < 240]
    assert np.mean([r.predicted == (r.doc_id not in bad) for r in test]) >= 0.9
