"""What the operators share: the shared folder, written tables, column hygiene."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session, or the folder given to
    ``setCheckpointDir``.  A folder of one machine is taken only in local mode,
    where the driver is the cluster; elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"{sc.getConf().get('spark.local.dir', '/tmp')}/spark-marginalia-{uuid.uuid4().hex}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between Spark and a Python worker.  Executors pool the memory of several
#: batches outside the heap, and each worker holds some: small ones leave room for the heap.
BATCH = "2m"


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that long texts come a few at a time.

    A task gives free memory back when it is over, as its worker lives on.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Returns this process's free memory to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; free memory stays with the process


def give_back_heaps(spark: SparkSession) -> None:
    """The same for the heaps of the executors: a task for each core asks for a collection, after which free heap is returned.

    A heap does not shrink by itself while the next job asks for little, and then
    stands beside what that job's Python workers need.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


_KEPT: dict = {}


def kept(key, make: Callable):
    """``make()``, remembered by this Python worker until another key is asked for.

    Workers are used again by other jobs; so one holds the tables of one
    operator at a time, and gives the memory of the one before back.
    """
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator needs, so that others cannot clash."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def crc_of_id(col: str | Column = "doc_id") -> Column:
    """crc32 of the id written as decimal text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary"))


#: Bytes of labelled texts that fitting takes at most.
FITTING = 48 << 20


def pick_labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int, most: int = FITTING) -> list[tuple]:
    """(doc_id, text, label) of labelled documents for fitting, picked by a hash of the id and sorted.

    There are ``limit`` at most, of ``most`` bytes in all, the first one aside: in
    the order of the hash, the first text that does not fit ends them, so that
    long texts are picked as often as short ones.  Null labels and null ids are left out;
    of several labels of one document the largest counts.  The ids are picked
    before any text moves, so a broadcast of ``limit`` ids at most is what joins
    them to the texts, which the driver reads in a second step.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = own_columns(docs, "doc_id", "text")
    picked = written(texts.join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label"), "labelled")
    lengths = picked.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id", "text").alias("key")).orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    taken, left, all_of_them = [], most, True
    for r in lengths.toLocalIterator():  # ``limit`` rows of numbers, unless ids repeat
        if taken and r.n > left:
            all_of_them = False
            break
        taken.append(r.key)
        left -= r.n
    if not all_of_them:
        picked = picked.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in taken], "key long")), F.xxhash64("doc_id", "text") == F.col("key"), "left_semi")
    return sorted((r.doc_id, r.text, r.label) for r in picked.collect())
