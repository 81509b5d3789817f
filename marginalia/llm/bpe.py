"""Operator 9: byte-pair encoding and decoding with a queue of merge ranks.

A split unit's symbols form a doubly linked list; a heap holds the rank of each
adjacent pair that can merge.  The lowest rank is taken; an entry whose symbols
have changed since it was pushed is stale and is skipped.  Decoding concatenates
the vocabulary's byte strings.

Each case has a result: null text counts as empty; an empty text has no ids, 0
tokens and decodes to the empty text; ties of rank merge from left to right;
special tokens written in a text get their own id, as the library does it;
repeated rows are encoded each; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from . import tokens
from .common import kept, mapped, own_columns

#: Splits a text before merges; the fixed pattern of this family of vocabularies.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's strings.

    Printable Latin-1 bytes stand for themselves; the rest take the code points
    from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Bpe:
    """Vocabulary and merges of a file, with a bounded memory of split units."""

    def __init__(self, path: str, most: int = tokens.MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.letters = byte_letters()
        self.first = [vocab[c] for c in self.letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        #: (left id, right id) -> (rank, merged id)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        back = {c: bytes([b]) for b, c in enumerate(self.letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: b"".join(back[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.decimal = {i: str(i).encode() for i in self.strings}
        self.chunks = tokens.Encoder(lambda texts: [self.encode(t) for t in texts], "byte", most)

    def merge(self, unit: bytes) -> list[int]:
        """Ids of one split unit."""
        ids = [self.first[b] for b in unit]
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = -1
        merges, queue = self.merges, []
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := merges.get((new, ids[after[j]])):
                    heapq.heappush(queue, (m[0], i, new, ids[after[j]], m[1]))
            if (k := before[i]) >= 0 and (m := merges.get((ids[k], new))):
                heapq.heappush(queue, (m[0], k, ids[k], new, m[1]))
        return [x for x in ids if x >= 0]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        out: list[int] = []
        for unit in SPLIT.findall(text):
            out += self.merge(unit.encode())
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens written in it get their ids."""
        if self.cut is None:
            return self.plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

def coder(path: str) -> Bpe:
    """This worker's coder of a vocabulary file."""
    return kept(("bpe", path), lambda: Bpe(path))


def _batches(batches: Iterator, vocabulary: str) -> Iterator:
    """The coder, the ids of documents, and their token ids one list each, a few megabytes of text at a time."""
    bpe = coder(vocabulary)
    for b in batches:
        for lo, hi in tokens.slices(b.column(1)):
            ids, starts = bpe.chunks.batch(b.column(1).slice(lo, hi - lo))
            yield bpe, b.column(0).slice(lo, hi - lo), [ids[i:j].tolist() for i, j in zip(starts[:-1], starts[1:])]


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; a narrow job."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for bpe, docs, lists in _batches(batches, vocabulary):
            shown = [hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, x))).hexdigest() for x in lists]
            back = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in lists]
            yield pa.RecordBatch.from_arrays([docs, pa.array(map(len, lists), pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(own_columns(docs, "doc_id", "text"), run, SCHEMA)


def token_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the ids themselves, for use outside the query."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, docs, lists in _batches(batches, vocabulary):
            yield pa.RecordBatch.from_arrays([docs, pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return mapped(own_columns(docs, "doc_id", "text"), run, "doc_id long, ids array<int>")


def decoded(tokenised: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of ``ids``; null ids decode to the empty text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = coder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return mapped(own_columns(tokenised, "doc_id", "ids"), run, "doc_id long, text string")
