"""What the operators share: column access by position, tables in the shared folder, size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of Parquet, that a join sends to every executor; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20
#: Rows of an Arrow batch are cut by bytes where texts are long.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where that is unset and everything runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = f"file://{tempfile.mkdtemp(prefix='sparkvec-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    # With its file system named: tasks that write files of their own must not take it for a local path.
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    where = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + where[5:] if where.startswith("file:/") and not where.startswith("file://") else where


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Folders of stored() tables, in the order of their making.
STORED: list[str] = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: what follows survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, what)
    place_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    place_.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place_)  # what no drop_stored() has removed goes with the driver
    df.write.option("compression", "zstd").parquet(path)
    STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, paths: list[str]) -> None:
    """Removes stored() tables that nothing reads any more."""
    for where in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        STORED.remove(where)


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: names that clash, in any case, stop mattering."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> int:
    """The position of the column of exactly this name (else the only one equal to it in another case)."""
    if name in df.columns:
        return df.columns.index(name)
    like = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(like) != 1:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return like[0]


def take(df: DataFrame, **names: str) -> DataFrame:
    """take(df, key="doc_id"): just these columns under these new names."""
    at = {new: place(df, old) for new, old in names.items()}
    plain = numbered(df)
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def row_id(df: DataFrame, key: str, text: str):
    """A 64-bit identity of (key, text) that any recomputation repeats; exact repeats of a row share it.

    Null keys and null texts are hashed as markers, so that they differ from each other and from values.
    """
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\x00null")), F.coalesce(F.col(text), F.lit("\x00null")))


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of the size of df; for stored() tables that of their files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast where it is small, else as it is (the join then shuffles both sides)."""
    return F.broadcast(df) if bytes_of(df) <= limit else df


def parts(spark: SparkSession) -> int:
    """How many ways exchanged data is split: what the cluster is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidy() -> None:
    """Gives freed memory back: Python workers live on, beside other tasks and the JVM."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy_batches(work):
    """work for mapInArrow, tidied up after."""

    def run(batches):
        yield from work(batches)
        tidy()

    return run


def tidy_group(work):
    """work for applyInArrow, tidied up after each group."""

    def run(table):
        out = work(table)
        del table
        tidy()
        return out

    return run


def cut(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def longs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """int64 values; nulls as the smallest value."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(cut(column).cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), dtype=np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def blobs(array: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """`array` cut into pieces of counts[i] values, as bytes."""
    raw, width = np.ascontiguousarray(array).tobytes(), array.dtype.itemsize
    ends = np.cumsum(counts) * width
    return [raw[e - c * width : e] for e, c in zip(ends.tolist(), np.asarray(counts).tolist())]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0]..starts[0]+counts[0]-1, starts[1].., one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - first, counts)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, n))
