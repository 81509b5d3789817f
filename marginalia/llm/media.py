"""Operator 7: media columns over content-addressed payloads in tar shards.

A payload is stored once, under its digest, as a PNG image of 8-bit red, green
and blue samples, 64 pixels (192 bytes) a row.  Tasks write tar shards to the
shared folder; an index of (digest, shard, offset, length) is a table, written
before anything reads it.  Rows carry the digest and find their bytes through
the index: a range read of the first bytes alone fills width and height, a read
of the whole fills the rest.

Which document of equal ones stores the payload is settled before the write.
The ids that need not store are sent to all tasks only if they are few
(``SMALL`` at most); beyond it they are taken away by a shuffled join.

Each case has a result: null text counts as empty and is stored as one row of
spaces; equal payloads have one entry and equal values; repeated rows get a row
each; no documents give no shards and no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from .common import mapped, new_path, own_columns, written

ROW = 192
#: Bytes of stored media in a shard, about; the last payload may go beyond.
SHARD = 64 << 20
#: Ids that are broadcast at most.
SMALL = 1_000_000
#: A header-only read takes these bytes: signature and IHDR.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX = "digest string, shard string, offset long, length long"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text with spaces up to a positive multiple of ``ROW``."""
    n = F.octet_length(text)
    want = F.greatest(F.ceil(n / ROW), F.lit(1)) * ROW
    return F.concat(text.cast("binary"), F.repeat(F.lit(" "), (want - n).cast("int")).cast("binary"))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """An RGB image with ``ROW`` bytes a row, unfiltered."""
    rows = len(payload) // ROW
    raw = b"".join(b"\0" + payload[i : i + ROW] for i in range(0, len(payload), ROW))
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 4)) + _chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int]:
    """Width and height from the first ``HEADER`` bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    if (depth, colour) != (8, 2):
        raise ValueError("not 8-bit RGB")
    return width, height


def from_png(media: bytes) -> bytes:
    """The samples of an unfiltered image; checksums are compared."""
    header(media[:HEADER])
    at, data = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = zlib.decompress(b"".join(data))
    if any(raw[i] for i in range(0, len(raw), ROW + 1)):
        raise ValueError("filtered rows")
    return b"".join(raw[i + 1 : i + 1 + ROW] for i in range(0, len(raw), ROW + 1))


def tar_header(name: str, size: int) -> bytes:
    """The 512 bytes before a member, with fixed owner and time."""
    import tarfile

    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def _store(uri: str):
    """The file system and path of the shared folder, whatever kind it is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)


def write_shards(payloads: DataFrame, folder: str) -> DataFrame:
    """Writes (digest, payload) rows into tar shards and returns the index.

    A shard is named by chance, so a task that runs twice writes other shards;
    only those of the run whose index rows were committed are ever read.
    """

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for digest, payload in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.tar", 0
                    out = store.open_output_stream(f"{root}/{name}")
                media = to_png(payload.as_buffer().to_pybytes())
                out.write(tar_header(digest + ".png", len(media)))
                out.write(media + bytes(-len(media) % 512))
                rows.append((digest, name, at + 512, len(media)))
                at += 512 + len(media) + -len(media) % 512
                if at >= SHARD:
                    out.write(bytes(1024))
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return mapped(payloads.select("digest", "payload"), run, INDEX)


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height) by range reads of ``HEADER`` bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(d, *header(head)) for d, head in _ranges(b, folder, HEADER)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32()))], ["digest", "width", "height"])

    return mapped(index.select("digest", "shard", "offset", "length"), run, "digest string, width int, height int")


def _ranges(batch, folder: str, most: int | None = None) -> Iterator[tuple[str, bytes]]:
    """The first ``most`` bytes (None: all) of each entry of an index batch; a shard is opened once for neighbours."""
    store, root = _store(folder)
    name, f = None, None
    for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
        if shard != name:
            if f is not None:
                f.close()
            name, f = shard, store.open_input_file(f"{root}/{shard}")
        yield digest, f.read_at(length if most is None else min(most, length), offset)
    if f is not None:
        f.close()


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """Everything about each stored payload: width and height by range reads of headers, the rest from all bytes read back."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = []
            heads = [header(head) for _, head in _ranges(b, folder, HEADER)]
            for (width, height), (digest, media) in zip(heads, _ranges(b, folder)):
                payload = from_png(media)
                if len(payload) != 3 * width * height:
                    raise ValueError(f"{digest}: the header and the samples differ")
                s = np.frombuffer(payload, np.uint8)
                # Mean of each colour and of the steps between samples, in thousandths.
                colours = [int(s[i::3].sum(dtype=np.int64)) * 1000 // len(s[i::3]) for i in range(3)]
                steps = int(np.abs(np.diff(s.astype(np.int16))).sum(dtype=np.int64)) * 1000 // (len(s) - 1)
                feature = ":".join(map(str, (width, height, *colours, steps)))
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, width, height))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
                names = [f.split(" ")[0] for f in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return mapped(index.select("digest", "shard", "offset", "length"), run, FEATURES)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, digest, n_bytes and what the stored payload says, for every document."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shards")
    text = F.coalesce("text", F.lit(""))
    base = own_columns(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    rows = written(base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(padded(F.col("text")), 256).alias("digest")), "digests")
    # Written first, so that the join can split a frequent digest.
    keeper = written(rows.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("keeper"), F.count("*").alias("n")).filter("n > 1"), "keepers")
    others = written(rows.join(keeper, "digest").filter(F.coalesce("doc_id", F.lit(-(1 << 63))) != F.col("keeper")).select("doc_id").distinct(), "others")
    few = others.limit(SMALL + 1).count() <= SMALL
    # An id that repeats with other texts may lose one of them here; what is missing is stored below.
    first = base.join(F.broadcast(others) if few else others, "doc_id", "left_anti")
    payloads = lambda d: d.select(F.sha2(padded(F.col("text")), 256).alias("digest"), padded(F.col("text")).alias("payload"))
    index = written(write_shards(payloads(first), folder), "index")
    missing = rows.select("digest").distinct().join(index.select("digest"), "digest", "left_anti")
    if not missing.isEmpty():
        rest = payloads(base).join(missing, "digest", "left_semi").groupBy("digest").agg(F.first("payload").alias("payload"))
        index = index.unionByName(written(write_shards(rest, folder), "index"))
    # Exactly one entry per digest, though repeated rows may have stored a payload twice.
    one = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    dealt = one.repartition(F.col("shard"), F.expr("offset div 4194304")).sortWithinPartitions("shard", "offset")
    known = written(read_features(dealt, folder), "features")
    return rows.join(known, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "width", "height")
