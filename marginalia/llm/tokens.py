"""Token ids of whole texts, with a bounded memory of chunks already seen.

Both vocabularies split a text before they merge.  The functions here cut a
batch of texts at some of those places with Arrow's vectorised kernels: at
single spaces, between a letter and an ASCII punctuation mark, around single
newlines.  A text's ids are its chunks' ids in a row; equal chunks of a batch
are looked up once.  Texts in which a cut could fall inside a split unit
(other white space, runs of spaces, special tokens) are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: New chunks that are joined into one text for the library.
JOINED = 500
#: Chunks, and ids of all of them, that the memory holds before it drops those that came once.
MEMO, IDS = 600_000, 8_000_000

_LETTER, _MARK = r"([A-Za-z0-9À-ÖØ-öø-ſ])", r"([!-/:-@\[-`{-~])"
#: Lower-casing this letter gives two code points, the second of which joins a mark after it.
_DOTTED = "|\u0130"
_ODD = r"<\||[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Stands at the front of a chunk that no space precedes.
_GLUED = "\x01"


def load(path: str):
    """The library's tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def library(tok) -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts with the library."""
    return lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


class Encoder:
    """Ids of texts; ``kind`` is 'byte' (spaces belong to words) or 'word' (white space is dropped)."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], kind: str, most: int = MEMO, size: int | None = None, widths: np.ndarray | None = None):
        #: ``size``: ids are below it.  ``widths``: how many bytes of a text each id stands for; new chunks are then joined.
        self.encode, self.byte, self.most, self.size, self.widths = encode, kind == "byte", most, size, widths
        self.forget()

    def forget(self) -> None:
        #: A chunk's number; of each number, its place in ``ids`` and how many ids it has.
        self.number: dict[str, int] = {}
        self.ids, self.first, self.count = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        #: Whether it came again since the memory was last thinned.
        self.again = np.empty(0, bool)

    def thin(self) -> None:
        """Keeps the chunks that came again, unless they fill over half of the memory."""
        keep = np.flatnonzero(self.again)
        n, first = self.count[keep], self.first[keep]
        if 2 * len(keep) > self.most or 2 * n.sum() > IDS:
            return self.forget()
        ends = np.cumsum(n)
        names = list(self.number)  # in the order of their numbers
        self.number = dict(zip(map(names.__getitem__, keep.tolist()), range(len(keep))))
        self.ids = self.ids[np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))]
        self.first, self.count, self.again = ends - n, n, np.zeros(len(keep), bool)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The numbers of distinct chunks; new ones are encoded."""
        if len(self.number) > self.most or len(self.ids) > IDS:
            self.thin()
        out = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        self.again[out[out >= 0]] = True
        new = np.flatnonzero(out < 0)
        missing = [chunks[i] for i in new.tolist()]
        if missing:
            ids, counts = [self.ids], [self.count]
            for at in range(0, len(missing), 5_000):
                part = missing[at : at + 5_000]
                texts = [c[1:] if c[:1] == _GLUED else " " + c for c in part] if self.byte else part
                flat, n = self.each(texts) if self.widths is None else self.joined(texts)
                counts.append(n)
                ids.append(flat)
            out[new] = np.arange(len(self.number), len(self.number) + len(missing))
            self.number.update(zip(missing, out[new].tolist()))
            self.ids, self.count = np.concatenate(ids), np.concatenate(counts)
            self.first = np.cumsum(self.count) - self.count
            self.again = np.concatenate([self.again, np.zeros(len(missing), bool)])
        return out

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has."""
        got = self.encode(texts)
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), "<u4", int(counts.sum())), counts

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, of which neighbours that begin with a space are encoded as one text of ``JOINED``.

        An id never crosses two units of the split, and merges on either side of
        a place that no id crosses are those of the sides by themselves; so where
        each text's last byte ends an id, the ids are its own.  A text that has a
        line's end, or nothing after its space, is by itself, and so are those of
        a joined text in which an id crosses.
        """
        own = [t[:1] == " " and len(t) > 1 and "\n" not in t for t in texts]
        rows = np.flatnonzero(own)
        groups = [rows[i : i + JOINED] for i in range(0, len(rows), JOINED)]
        got = self.encode(["".join([texts[i] for i in g.tolist()]) for g in groups])
        sizes = pc.binary_length(pa.array(texts, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        counts, parts, alone = np.zeros(len(texts), np.int64), [], [np.flatnonzero(~np.array(own, bool))]
        for g, ids in zip(groups, got):
            ids = np.array(ids, "<u4")
            ends, want = np.cumsum(self.widths[ids]), np.cumsum(sizes[g])
            last = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[last] == want).all():
                counts[g] = np.diff(last, prepend=-1)
                parts.append((g, ids))
            else:
                alone.append(g)
        rest = np.concatenate(alone)
        if len(rest):
            ids, counts[rest] = self.each([texts[i] for i in rest.tolist()])
            parts.append((rest, ids))
        # Ids go from the order in which they were encoded to that of the texts.
        order = np.concatenate([g for g, _ in parts]) if parts else np.empty(0, np.int64)
        flat = np.concatenate([ids for _, ids in parts]) if parts else np.empty(0, "<u4")
        n = counts[order]
        first = np.empty(len(texts), np.int64)
        first[order] = np.cumsum(n) - n
        ends = np.cumsum(counts)
        return flat[np.repeat(first - (ends - counts), counts) + np.arange(len(flat))], counts

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text begins (one more than texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD + ("|  " if self.byte else _DOTTED))
        plain = pc.if_else(odd, "", texts)
        if self.byte:
            plain = pc.replace_substring_regex(plain, _LETTER + _MARK, rf"\1 {_GLUED}\2")
            plain = pc.replace_substring_regex(plain, r"([^ \n])\n([^ \n])", "\\1 " + _GLUED + "\n " + _GLUED + "\\2")
            # The first chunk has no space before it, unless the text begins with one.
            plain = pc.binary_join_element_wise(_GLUED, plain, "")
        else:
            plain = pc.replace_substring(pc.ascii_lower(plain), "\n", " ")
            plain = pc.replace_substring_regex(plain, _LETTER + _MARK, r"\1 \2")
        lists = pc.split_pattern(plain, " ")
        coded = lists.flatten().dictionary_encode()
        # No chunk has a space, so one string holds them all on their way to Python.
        chunks = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ") if len(coded.dictionary) else []
        at = self.numbers(chunks)[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.count.take(at)
        ends = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat(self.first.take(at) - ends[:-1], n)
        places += np.arange(ends[-1])
        out = self.ids.take(places)
        lo = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        starts = ends[lo]
        if odd.true_count:
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            whole = dict(zip(rows.tolist(), self.encode(texts.take(pa.array(rows)).to_pylist())))
            parts = [np.array(whole[i], "<u4") if i in whole else out[starts[i] : starts[i + 1]] for i in range(len(texts))]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            out = np.concatenate(parts).astype("<u4")
        return out, starts


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder of a vocabulary file by the library."""

    def make() -> Encoder:
        tok = load(path)
        ids = tok.get_vocab(with_added_tokens=True)
        size = 1 + max(ids.values())
        widths = None
        if kind == "byte":  # a byte-level vocabulary has a character for each byte
            widths = np.zeros(size, np.int64)
            widths[list(ids.values())] = [len(t) for t in ids]
        return Encoder(library(tok), kind, size=size, widths=widths)

    return kept(("encoder", path, kind), make)


def slices(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes at most; a longer text has its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)
