"""Operator 5: token ids in compressed containers, by a context-mixing range coder.

A container holds a run of documents in ascending id order: an index of
documents and lengths, and blocks of ids.  Every block starts from nothing, is
coded without any other, and has a checksum of its 32-bit ids.  Before each id
four parts of the code space are dealt out:

* order 2 and 1: the id that last followed the last two ids, or the last one, in
  this block, with a state of how often in a row that held;
* order 0: the ids seen in this block so far, in ``2**ZERO`` places by their last bits;
* the rest: every id of the vocabulary, by a fixed law (a merge's rank is about
  its frequency's rank).

The shares adapt within the block: each state of order 2 and of order 1 has a
chance that moves by how often it held, and so has the law's share of what no
prediction holds.  An id is coded in the part of the highest order that has it.
The range coder has 56 bits and 24-bit digits; carries are settled when a block
is over.  All blocks of a container are coded side by side, one id of each at a
time, as numpy vectors, ``LANES`` blocks at once.

Each case has a result: null text counts as empty and has its end id only; equal
ids are ordered by a hash of the text and each has its rows; a null id comes
first; a document of any length lies in one container and many blocks; ids of
``MOST`` or above raise ValueError; a damaged container or block raises
ValueError; no documents give no containers.  Other columns of the input are not
read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from . import tokens
from .common import mapped, own_columns, written
from .repeats import small_or_shuffled

END_ID = 2
#: Parts of the writing job whose ids are added up together.
PARTS = 1000
#: Ids of a block, and of a container, about: a document is not divided between containers.
BLOCK, CONTAINER = 512, 4_000_000
#: Blocks that are coded side by side at most.
LANES = 4000
MAGIC = b"IDMIX3\n\0"

#: Ids are below this number.
MOST = 1 << 17
#: log2 of: the code space, the fixed law's total, the places of a block's table of order 1 or 2, and of order 0.
TOTAL, LAW, PLACES, ZERO = 28, 18, 7, 7
#: A range is this wide at least before an id is coded; digits have 24 bits.
WIDE = 1 << 32
#: What a chance of 1 is.
ONE = 1 << TOTAL
#: First chances that a prediction holds, by state (none yet, or how many times in a row it held, plus one), orders 1 and 2; the most and the least that one becomes.
CHANCES = np.array([[0.01, 0.12, 0.28, 0.4], [0.01, 0.22, 0.5, 0.7]])
SURE, LEAST = 0.85, 0.004
#: Chances move by a 2**RATE-th of their error; those of order 0, which are told from the law's, by a 2**RATE0-th.
RATE, RATE0 = 4, 5
#: First chance that an id which is not predicted comes by the law, and its bounds.
FRESH, FRESH_SURE, FRESH_LEAST = 0.55, 0.9, 0.15
#: A prediction's next state by min(entry - 4 * id, 4), which is its state if it held and 4 if not.
_NEXT = np.array([1, 2, 3, 3, 1], np.int32)
#: By that, what is added to a chance that lost its part.
_GAIN = np.array([(SURE - LEAST) * h + LEAST for h in (1, 1, 1, 1, 0)]) * ONE / (1 << RATE)
_GAIN = _GAIN.astype(np.int64)
#: Parts by their order, a column for orders 1 and 2; factors of hashes.
_ORDERS = np.array([[2], [3]], np.uint8)
_FACTOR, _FACTOR2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_TOTAL, _DIGIT = np.uint64(TOTAL), np.uint64(24)
#: Where the law's chance goes, by the part of an id (law, order 0, 1, 2), and by which shift.
_GOAL, _SHIFT = (np.array([FRESH_SURE, FRESH_LEAST, 0, 0]) * ONE).astype(np.int64), np.array([RATE0, RATE0, 40, 40])


def law(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cumulated weights of ids below ``size``, and the id at each weight: at least 1 each, the rest in proportion to 1 / (id + 100)."""
    if size > MOST:
        raise ValueError(f"ids must be below {MOST}")
    w = 1 / (np.arange(size) + 100.0)
    cum = np.floor(np.concatenate([[0], np.cumsum(w)]) / w.sum() * ((1 << LAW) - size)).astype(np.int64) + np.arange(size + 1)
    return cum, np.repeat(np.arange(size, dtype=np.int64), np.diff(cum))


class Mixer:
    """The predictions of all blocks of a container, at one place of each.

    Rows of two are orders 1 and 2, rows of four the parts of the code space: law, order 0, order 1, order 2.
    """

    def __init__(self, lanes: int):
        # An entry is four times the id that last followed, and a state.  Numpy asks for huge pages from 4 MB on.
        room, own = np.zeros((2 * lanes << PLACES) + (lanes << ZERO) + (1 << 20), np.int32), 2 * lanes << PLACES
        self.table, self.zero = room[:own], room[own : own + (lanes << ZERO)]
        self.chances = np.repeat((CHANCES * ONE).astype(np.int64)[:, None], lanes, 1).ravel()
        self.fresh = np.full(lanes, int(FRESH * ONE), np.int64)
        self.lane = np.arange(lanes, dtype=np.int64)
        self.base0 = self.lane << ZERO
        self.base, self.base_chance = np.arange(2 * lanes).reshape(2, lanes) << PLACES, np.arange(2 * lanes).reshape(2, lanes) << 2
        self.hash, self.before = np.zeros((2, lanes), np.uint64), np.zeros(lanes, np.uint64)
        self.begin, self.part, self.known = (np.zeros((4, lanes), np.int64) for _ in range(3))

    def predict(self) -> None:
        begin, part = self.begin, self.part
        self.at = (self.hash >> np.uint64(64 - PLACES)).view(np.int64)
        self.at += self.base
        self.entry = self.table.take(self.at)
        self.at_chance = (self.entry & 3) + self.base_chance
        self.chance = self.chances.take(self.at_chance)
        part[3] = self.chance[1]
        # Order 2 has the end of the code space, order 1 its share of what is left, order 0 of what is left then; the law begins at 0.
        left = np.subtract(ONE, part[3], out=begin[3])
        own = np.multiply(left, self.chance[0], out=part[2])
        own >>= TOTAL
        left = np.subtract(left, own, out=begin[2])
        self.unit = left * self.fresh
        self.unit >>= TOTAL + LAW
        rest = np.left_shift(self.unit, LAW, out=begin[1])
        each = np.subtract(left, rest, out=part[1])
        each >>= ZERO

    def meet(self, low: np.ndarray) -> None:
        """Tells which predictions the ids that came, as 32-bit numbers, hold."""
        self.four = low << 2
        # A difference below 4 is the state of a prediction that held.
        self.held = (self.entry - self.four).view(np.uint32)
        np.minimum(self.held, 4, out=self.held)

    def learn(self, ids: np.ndarray, low: np.ndarray, at0: np.ndarray, which: np.ndarray) -> None:
        """The ids that came, twice, their places in order 0, and the part each was in."""
        self.table[self.at] = _NEXT.take(self.held) + self.four
        self.zero[at0] = low
        gain = _GAIN.take(self.held)
        gain -= self.chance >> RATE
        self.chance += gain
        self.chances[self.at_chance] = self.chance
        goal = _GOAL.take(which)
        goal -= self.fresh
        goal >>= _SHIFT.take(which)
        self.fresh += goal
        last, both = self.hash
        np.multiply(ids.view(np.uint64), _FACTOR, out=last)
        np.add(last, self.before, out=both)
        np.multiply(last, _FACTOR2, out=self.before)


def encode(ids: np.ndarray, size: int, block: int = BLOCK) -> list[bytes]:
    """The blocks of a run of ids below ``size``, each by itself."""
    lanes = -(-len(ids) // block)
    if lanes > LANES:
        step = -(-lanes // -(-lanes // LANES)) * block
        return [b for i in range(0, len(ids), step) for b in encode(ids[i : i + step], size, block)]
    if not lanes:
        return []
    if int(ids.max()) >= size:
        raise ValueError(f"ids must be below {size}")
    table = np.zeros((lanes, block), np.int32)
    table.ravel()[: len(ids)] = ids
    table = np.ascontiguousarray(table.T)
    tail = len(ids) - (lanes - 1) * block
    mix, cum = Mixer(lanes), law(size)[0]
    weight = np.diff(cum)
    low, wide = np.zeros(lanes, np.int64), np.full(lanes, (WIDE << 24) - 1, np.int64)
    # Blocks and their next digits; a digit has a carry above its 24 bits until the end.
    owners, digits = [], []
    begin, part, ended = mix.begin, mix.part, None
    for k in range(block if lanes > 1 else tail):
        if k == tail:  # the last block is over; what its lane goes on with is not kept
            ended = int(low[-1]), len(owners)
        mix.predict()
        mix.meet(table[k])
        own = table[k].astype(np.int64)
        slot = own & ((1 << ZERO) - 1)
        np.multiply(cum.take(own), mix.unit, out=begin[0])
        np.multiply(weight.take(own), mix.unit, out=part[0])
        begin[1] += slot * part[1]
        slot += mix.base0
        which = (mix.zero.take(slot) == table[k]).view(np.uint8)
        hit = (mix.held < 4).view(np.uint8)
        hit *= _ORDERS
        np.maximum(which, hit[0], out=which)
        np.maximum(which, hit[1], out=which)
        which = which.astype(np.int64)
        pick = which * lanes
        pick += mix.lane
        r = wide >> TOTAL
        low += r * begin.take(pick)
        np.multiply(r, part.take(pick), out=wide)
        mix.learn(own, table[k], slot, which)
        while len(i := np.flatnonzero(wide < WIDE)):
            x = low[i]
            owners.append(i.astype(np.uint16))
            digits.append((x >> 32).astype(np.uint32))
            low[i] = (x & (WIDE - 1)) << 24
            wide[i] <<= 24
    if ended:
        low[-1], n = ended
        for j in range(n, len(owners)):
            if owners[j][-1] == lanes - 1:
                owners[j], digits[j] = owners[j][:-1], digits[j][:-1]
    # The number in the range that has no more digits.
    owners.append(mix.lane.astype(np.uint16))
    digits.append((low + (WIDE - 1) >> 32).astype(np.uint32))
    owner = np.concatenate(owners)
    flat = np.concatenate(digits).take(np.argsort(owner, kind="stable"))
    # A block's first digit has no carry.
    while (carry := flat >> 24).any():
        flat &= (1 << 24) - 1
        flat[:-1] += carry[1:]
    data = flat.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
    ends = 3 * np.cumsum(np.bincount(owner, minlength=lanes))
    return [data[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]


def decode(blocks: list[bytes], n_ids: int, size: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks."""
    lanes = len(blocks)
    if lanes > LANES:
        step = -(-lanes // -(-lanes // LANES))
        return np.concatenate([decode(blocks[i : i + step], min(step * block, n_ids - i * block), size, block) for i in range(0, lanes, step)])
    if not lanes:
        return np.empty(0, np.int64)
    cum, lookup = law(size)
    weight = np.diff(cum)
    # Seven bytes begin a block's number, each digit adds three; zeros follow its end.
    room = max(map(len, blocks)) // 3 + 4
    data = np.frombuffer(b"".join(b[: 3 * room].ljust(3 * room + 7, b"\0") for b in blocks), np.uint8).reshape(lanes, -1)
    # Without a sign, what a damaged block turns into stays in bounds; so does a last block after its end.
    code = np.zeros(lanes, np.uint64)
    for k in range(7):
        code = code << np.uint64(8) | data[:, k]
    d = data[:, 7:].reshape(lanes, room, 3).astype(np.uint32)
    digits = (d[:, :, 0] << 16 | d[:, :, 1] << 8 | d[:, :, 2]).ravel()
    at = np.arange(lanes, dtype=np.int64) * room
    end = at + room - 1
    tail = n_ids - (lanes - 1) * block
    mix = Mixer(lanes)
    begin, part, known = mix.begin, mix.part, mix.known
    wide = np.full(lanes, (WIDE << 24) - 1, np.uint64)
    out = np.zeros((block, lanes), np.int32)
    for k in range(block if lanes > 1 else tail):
        mix.predict()
        r = wide >> _TOTAL
        target = code // r
        target = np.minimum(target, ONE - 1, out=target).view(np.int64)
        which = np.add.reduce((target >= begin[1:]).view(np.uint8), axis=0, dtype=np.int64)
        i = np.flatnonzero(which == 0)
        unit = mix.unit[i]
        found = lookup.take(target[i] // unit)
        known[0][i] = found
        begin[0][i] = cum.take(found) * unit
        part[0][i] = weight.take(found) * unit
        i = np.flatnonzero(which == 1)
        each, first = part[1][i], begin[1][i]
        slot = np.minimum((target[i] - first) // each, (1 << ZERO) - 1)
        known[1][i] = mix.zero.take(slot + mix.base0[i])
        begin[1][i] = first + slot * each
        np.right_shift(mix.entry, 2, out=known[2:])
        pick = which * lanes
        pick += mix.lane
        ids = known.take(pick)
        code -= r * begin.take(pick).view(np.uint64)
        np.multiply(r, part.take(pick).view(np.uint64), out=wide)
        low = ids.astype(np.int32)
        mix.meet(low)
        slot = ids & ((1 << ZERO) - 1)
        slot += mix.base0
        mix.learn(ids, low, slot, which)
        while len(i := np.flatnonzero(wide < WIDE)):
            w = at[i]
            code[i] = code[i] << _DIGIT | digits[w]
            at[i] = np.minimum(w + 1, end[i])
            wide[i] <<= _DIGIT
        out[k] = low
    return out.T.ravel()[:n_ids].astype(np.int64)


def pack_container(docs: list[int | None], sizes: np.ndarray, ids: np.ndarray, size: int) -> bytes:
    """One container: magic, head, index, blocks; every part with its crc32."""
    known = np.array([d is not None for d in docs], np.uint8)
    index = zlib.compress(np.array([d or 0 for d in docs], "<i8").tobytes() + known.tobytes() + sizes.astype("<u4").tobytes(), 1)
    blocks = encode(ids, size)
    head = struct.pack("<IQII", len(docs), len(ids), len(blocks), size)
    raw = ids.astype("<u4")
    out = [MAGIC, head, struct.pack("<I", zlib.crc32(head)), struct.pack("<II", len(index), zlib.crc32(index)), index]
    # A block's checksum is that of its ids, so it holds for coder and bytes alike.
    for i, b in enumerate(blocks):
        out += [struct.pack("<II", len(b), zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK].tobytes())), b]
    return b"".join(out)


def open_container(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, sizes and ids of a container; ValueError if anything is damaged."""
    head = data[8:28]
    if data[:8] != MAGIC or zlib.crc32(head) != struct.unpack("<I", data[28:32])[0]:
        raise ValueError("not a container of ids, or a damaged head")
    n_docs, n_ids, n_blocks, size = struct.unpack("<IQII", head)
    at, parts, crcs = 32, [], []
    for _ in range(1 + n_blocks):
        if at + 8 > len(data):
            raise ValueError("a container that is cut off")
        length, crc = struct.unpack("<II", data[at : at + 8])
        parts.append(data[at + 8 : at + 8 + length])
        crcs.append(crc)
        at += 8 + length
    if zlib.crc32(parts[0]) != crcs[0]:
        raise ValueError("damaged index")
    index = zlib.decompress(parts[0])
    docs = np.frombuffer(index, "<i8", n_docs).tolist()
    known = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    sizes = np.frombuffer(index, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    ids = decode(parts[1:], n_ids, size)
    raw = ids.astype("<u4")
    for k, crc in enumerate(crcs[1:]):
        if zlib.crc32(raw[k * BLOCK : (k + 1) * BLOCK].tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    return [d if k else None for d, k in zip(docs, known)], sizes, ids


def containers(docs: DataFrame, vocabulary: str, end_id: int = END_ID, size: int = CONTAINER) -> DataFrame:
    """(part, seq, n_ids, data): the containers of all documents in ascending id order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = tokens.encoder(vocabulary, "byte")
        docs, sizes, ids, total, seq = [], [], [], 0, 0

        def row():
            data = pack_container(docs, np.array(sizes), np.concatenate(ids), coder.size)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "data"])

        for b in batches:
            for lo, hi in tokens.slices(b.column(1)):
                flat, starts = coder.batch(b.column(1).slice(lo, hi - lo))
                for doc, i, j in zip(b.column(0).slice(lo, hi - lo).to_pylist(), starts[:-1], starts[1:]):
                    docs.append(doc)
                    sizes.append(int(j - i) + 1)
                    ids.append(np.append(flat[i:j], np.uint32(end_id)))
                    total += sizes[-1]
                    if total >= size:
                        yield row()
                        docs, sizes, ids, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield row()

    base = own_columns(docs, "doc_id", "text")
    ordered = base.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return mapped(ordered, run, "part int, seq int, n_ids long, data binary")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in written containers."""
    # Sums of PARTS parts each, as many numbers as the writing job had parts by PARTS, are added up here; all else where it lies.
    sums = written(files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("block", F.expr(f"part div {PARTS}")), "sums")
    base, at = [], 0
    for r in sums.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect():
        base.append((r.block, at))
        at += r.n
    blocks = files.sparkSession.createDataFrame(base, "block long, base long")
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("block").orderBy("part")) - F.col("n")).join(blocks, "block").select("part", (F.col("before") + F.col("base")).alias("before"))
    own = files.select("part", "seq", "n_ids").withColumn("own", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = written(own.join(before, "part").select("part", "seq", (F.col("before") + F.col("own")).alias("start")), "starts")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1)):
                docs, sizes, ids = open_container(data.as_buffer().to_pybytes())
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return mapped(files.select("part", "seq", "data").join(small_or_shuffled(starts, F.lit(3)), ["part", "seq"]).select("start", "data"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Containers are written to the shared folder and read back."""
    return read(written(containers(docs, vocabulary, end_id), "ids"))
