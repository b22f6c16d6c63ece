"""What the corpus operators share: tables, shared storage, words and model hand-over."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most, so that a batch of long texts fits a worker.
BATCH_ROWS = 1024

#: Rows of a key beyond which it is not dealt by hash, and how many such keys there are at most.
HOT_ROWS, HOT_KEYS = 1000, 100_000
#: Rows of a few numbers each, 32 MB or so, that are sent to every task at most.
BROADCAST_ROWS = 500_000

#: Stored tables after each of which the driver collects its garbage.
TABLES_HELD = 4

#: Words are runs of digits, a-z and everything beyond ASCII, after lower-casing A-Z.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One of fewer files than there are cores is dealt out, as a file may be one task."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found if len(found.inputFiles()) >= cores else found.repartition(cores)


def sliced(batches, rows: int = BATCH_ROWS):
    """Arrow batches or arrays in parts of at most `rows` rows, so that memory follows the part and not the batch."""
    for batch in batches:
        for at in range(0, max(1, len(batch)), rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Gives memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(work: Callable) -> Callable:
    """A function of batches, after which its worker keeps no memory that it does not use: workers outlive their tasks,
    and what they keep adds to that of the stages after."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def collect_driver(spark: SparkSession) -> None:
    """Lets the driver drop what it has of queries that ended: their plans, broadcast blocks and shuffle files go only
    when its heap is collected, and a heap that is not grows with the queries of a stage until it is full."""
    gc.collect()
    spark._jvm.System.gc()


_OWN_DIRS: dict[str, str] = {}
_TABLES = itertools.count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of the warehouse,
    or, in local mode, where all is one machine, a temporary folder. No setting of the session is changed."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            local = spark.sparkContext.master.startswith("local")
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="lumengrid-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lumengrid-tables"
        found = _OWN_DIRS[app]
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage and survives lost executors.

    The files go when the session's JVM ends, or by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumengrid-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if next(_TABLES) % TABLES_HELD == 0:
        collect_driver(spark)
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a stored table that nothing reads any more."""
    system, place = _file_system(df.sparkSession, df.stored_at)
    system.delete(place, True)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def word_blocks(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of about `size` bytes, in order."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE), 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class WordHashes:
    """64-bit hashes of words. Hashing a word again takes less time than finding it among remembered ones."""

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def bucket(*cols: str | Column, buckets: int, salt: int = 0) -> Column:
    """A bucket from 0 on that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols, F.lit(salt)), F.lit(buckets))


def struct_array(fields: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def runs(batches, keys: list[str]):
    """(key, table) for each run of rows with equal keys; rows must come sorted by them. A run may span batches."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for at in range(1, len(rows) + 1):
            if at < len(rows) and rows[at] == rows[begin]:
                continue
            if held and rows[begin] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = rows[begin]
            held.append(batch.slice(begin, at - begin))
            begin = at
    if held:
        yield current, pa.Table.from_batches(held)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def few(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for sending to every task where its rows, of fixed width, are counted to be at most `bound`."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows left joined with found, which has one row a key; its column `size` tells how many of rows have the key.

    Keys that many rows have would put them in one task: those keys, at most HOT_KEYS, are sent to every task instead.
    Rows with a null key find nothing and are not dealt by it.
    """
    total, most = found.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    others = [c for c in found.columns if c not in keys]
    blank = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in others]
    out = rows.where(~known).select(*rows.columns, *blank)
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if most <= limit:
        return rows.where(known).join(found, keys, "left").select(*rows.columns, *others).unionByName(out)
    hot, mark = found.where(F.col(size) > limit), free_name(rows, "is_hot")
    marked = rows.where(known).join(F.broadcast(hot.withColumn(mark, F.lit(True))), keys, "left")
    out = out.unionByName(marked.where(F.col(mark)).select(*rows.columns, *others))
    cold = marked.where(F.col(mark).isNull()).select(*rows.columns)
    return out.unionByName(cold.join(found.where(F.col(size) <= limit), keys, "left").select(*rows.columns, *others))
