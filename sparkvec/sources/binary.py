"""Binary vector files as Spark data sources: register(spark), then spark.read.format("npy") or ("sparsebin").

npy        two-dimensional float32 arrays: rows become vec_id, vector. Splits are
           byte ranges of the fixed-stride body; column-major files are read whole.
sparsebin  little-endian: u32 number of vectors; each u32 n, n u32 components, n f32
           values. vec_id, components, values. A folder of such files is one
           collection, in the order of their names. Records vary in length, so one
           pass finds where the splits of a file begin that is too large for one.
           Option "limit": the first vectors only.
Option "rows": vectors of a split.
"""

from __future__ import annotations

import ast
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Bytes of a split of a sparse file, and of a file that write_sparse() makes, about; bytes of vectors in a batch of rows.
SPLIT_BYTES, BATCH_BYTES = 16 << 20, 4 << 20


def _place(path: str):
    """(file system, path within it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, path = _place(path)
    return system.open_input_file(path)


def npy_header(f) -> tuple[int, tuple[int, ...], bool]:
    """(start of the body, shape, column-major)."""
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    size = struct.unpack("<H", f.read(2))[0] if magic[6] == 1 else struct.unpack("<I", f.read(4))[0]
    head = ast.literal_eval(f.read(size).decode("latin1"))
    if head["descr"] != "<f4" or len(head["shape"]) != 2:
        raise ValueError(f"{head['descr']} of shape {head['shape']}: two-dimensional 32-bit floats are needed")
    return f.tell(), head["shape"], head["fortran_order"]


class Split(InputPartition):
    def __init__(self, first: int, count: int, start: int, path: str = "", size: int = 0):
        super().__init__(first)
        self.first, self.count, self.start, self.path, self.size = first, count, start, path, size


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.float32()))


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        with _open(self.path) as f:
            start, (n, dim), major = npy_header(f)
        step = max(1, n) if major else self.rows
        return [Split(i, min(step, n - i), start + i * dim * 4) for i in range(0, n, step)]

    def read(self, split):
        with _open(self.path) as f:
            start, (n, dim), major = npy_header(f)
            f.seek(split.start)
            raw = f.read(split.count * dim * 4)
        if len(raw) < split.count * dim * 4:
            raise ValueError(f"{self.path} ends early")
        x = np.frombuffer(raw, dtype="<f4")
        x = x.reshape(dim, n).T if major else x.reshape(split.count, dim)
        ids = np.arange(split.first, split.first + split.count, dtype=np.int64)
        for lo in range(0, split.count, 8192):
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 8192]), _vectors(np.ascontiguousarray(x[lo : lo + 8192]))], names=["vec_id", "vector"])


class Npy(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "vec_id long, vector array<float>"

    def reader(self, schema):
        return NpyReader(self.options["path"], int(self.options.get("rows", 65_536)))


class SparseReader(DataSourceReader):
    def __init__(self, path: str, rows: int, limit: int | None, wide: bool):
        self.path, self.rows, self.limit, self.wide = path, rows, limit, wide

    def _files(self) -> list[tuple[str, int]]:
        """(path within the file system, bytes) of the files."""
        from pyarrow import fs

        system, path = _place(self.path)
        about = system.get_file_info(path)
        if about.type is not fs.FileType.Directory:
            return [(path, about.size or 0)]
        files = system.get_file_info(fs.FileSelector(path))
        return [(x.path, x.size) for x in sorted(files, key=lambda x: x.base_name) if x.is_file and x.base_name[0] not in "._"]

    def partitions(self):
        system, splits, before = _place(self.path)[0], [], 0
        for path, size in self._files():
            if self.limit is not None and before >= self.limit:
                break
            with system.open_input_file(path) as f:
                raw = f.read(4)
                if len(raw) < 4:
                    raise ValueError(f"{path} ends early")
                n = struct.unpack("<I", raw)[0]
                n = n if self.limit is None else min(n, self.limit - before)
                if n <= self.rows and size <= SPLIT_BYTES + 4:
                    splits += [Split(before, n, 4, path, size - 4)] if n else []
                else:
                    splits += self._walk(f, path, before, n)
            before += n
        return splits

    def _walk(self, f, path: str, before: int, n: int) -> list[Split]:
        """The splits of a file of n vectors."""
        splits, at, start, first = [], 4, 4, 0
        for i in range(n):
            f.seek(at)
            raw = f.read(4)
            if len(raw) < 4:
                raise ValueError(f"{path} ends early")
            size = 4 + 8 * struct.unpack("<I", raw)[0]
            if i > first and (i - first == self.rows or at + size - start > SPLIT_BYTES):
                splits.append(Split(before + first, i - first, start, path, at - start))
                start, first = at, i
            at += size
        return splits + ([Split(before + first, n - first, start, path, at - start)] if n > first else [])

    def read(self, split):
        if split is None:  # Spark's, where there are no splits
            return
        with _place(self.path)[0].open_input_file(split.path) as f:
            f.seek(split.start)
            raw = f.read(split.size)
        words = np.frombuffer(raw, dtype="<u4", count=len(raw) // 4)
        at, counts, done, lo = 0, [], 0, 0
        for i in range(split.count):
            if at >= len(words) or at + 1 + 2 * (n := int(words[at])) > len(words):
                raise ValueError(f"{split.path} ends early")
            counts.append(n)
            at += 1 + 2 * n
            if 4 * (at - lo) >= BATCH_BYTES or i == split.count - 1:
                yield self._batch(words[lo:at], np.array(counts, dtype=np.int64), split.first + done)
                done, lo, counts = i + 1, at, []

    def _batch(self, words: np.ndarray, count: np.ndarray, first: int) -> pa.RecordBatch:
        own = _component_places(count)
        c, v = words[own].astype(np.int64), words[own + np.repeat(count, count)].view("<f4")
        row = np.repeat(np.arange(len(count)), count)
        if not self.wide and len(c) and c.max() > 0xFFFF:
            raise ValueError(f"component {c.max()} of vector {first + row[c.argmax()]} doesn't fit into 16 bits")
        falls = np.flatnonzero((np.diff(c) <= 0) & (np.diff(row) == 0))
        if len(falls):
            raise ValueError(f"the components of vector {first + row[falls[0]]} don't ascend")
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (c, v.astype(np.float32))]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(count)), pa.int64()), *lists], names=["vec_id", "components", "values"])


def _component_places(count: np.ndarray) -> np.ndarray:
    """Where the components of records of `count` entries are, in words of 32 bits."""
    size = 1 + 2 * count
    start = np.cumsum(size) - size + 1
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def write_sparse(df: DataFrame, path: str) -> None:
    """components and values as a new folder of sparse files, in the order of the partitions of df and of the rows in them."""

    def work(batches):
        from pyspark import TaskContext

        system, folder = _place(path)
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def put():
            name = f"part-{task:06d}-{number:06d}.bin"
            count = np.concatenate([n for n, _ in held])
            system.create_dir(folder)
            own = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as f:
                f.write(np.array([len(count)], "<u4").tobytes())
                for _, words in held:
                    f.write(words.tobytes())
            system.move(own, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "vectors": [len(count)]})

        for batch in batches:
            c, v = batch.column("components"), batch.column("values")
            count, values = (np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (c, v))
            c, v = c.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
            if (count != values).any():
                raise ValueError("components and values differ in number")
            if len(c) and (c.min() < 0 or c.max() > 0xFFFFFFFF):
                raise ValueError("component out of range")
            ends, entries, lo = np.cumsum(4 + 8 * count), np.concatenate([[0], np.cumsum(count)]), 0
            while lo < len(count):
                base = ends[lo] - 4 - 8 * count[lo]
                hi = max(int(np.searchsorted(ends, base + SPLIT_BYTES - size, side="right")), lo + (not held))
                if hi > lo:
                    n, mine = count[lo:hi], slice(entries[lo], entries[hi])
                    words = np.empty(int(n.sum()) * 2 + len(n), dtype="<u4")
                    words[np.cumsum(1 + 2 * n) - 1 - 2 * n] = n
                    own = _component_places(n)
                    words[own], words[own + np.repeat(n, n)] = c[mine], v[mine].astype("<f4").view("<u4")
                    held.append((n, words))
                    size += int(ends[hi - 1] - base)
                if hi < len(count):
                    yield put()
                    number, held, size = number + 1, [], 0
                lo = hi
        if held:
            yield put()

    rows = df.select(F.col("components").cast("array<long>").alias("components"), F.col("values").cast("array<float>").alias("values"))
    if not rows.mapInArrow(work, "name string, vectors long").agg(F.sum("vectors")).first()[0]:
        system, folder = _place(path)
        system.create_dir(folder)


class Sparse(DataSource):
    @classmethod
    def name(cls):
        return "sparsebin"

    def schema(self):
        return "vec_id long, components array<long>, values array<float>"

    def reader(self, schema):
        limit = self.options.get("limit")
        return SparseReader(self.options["path"], int(self.options.get("rows", 65_536)), None if limit is None else int(limit), self.options.get("component", "u32") == "u32")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Npy)
    spark.dataSource.register(Sparse)


def read_npy(spark: SparkSession, path: str):
    register(spark)
    return spark.read.format("npy").load(path)


def read_sparse(spark: SparkSession, path: str, limit: int | None = None, component: str = "u32"):
    register(spark)
    reader = spark.read.format("sparsebin").option("component", component)
    return (reader if limit is None else reader.option("limit", limit)).load(path)


def from_dense_buffer(spark: SparkSession, data: np.ndarray, n: int):
    """A flat buffer of n equal rows."""
    data = np.asarray(data, dtype=np.float32)
    if n < 0 or (n and len(data) % n) or (not n and len(data)):
        raise ValueError(f"{len(data)} values don't make {n} rows")
    x = data.reshape(n, -1) if n else np.zeros((0, 1), dtype=np.float32)
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n), pa.int64()), "vector": _vectors(x)}))


def from_token_buffer(spark: SparkSession, data: np.ndarray, offsets: np.ndarray, dim: int):
    """A flat buffer of token vectors, and where each document begins in it, counted in values."""
    data, offsets = np.asarray(data, dtype=np.float32), np.asarray(offsets, dtype=np.int64)
    if not len(offsets) or offsets[0] != 0 or offsets[-1] != len(data) or (np.diff(offsets) < 0).any():
        raise ValueError("offsets must rise from 0 to the buffer's length")
    if dim < 1 or (offsets % dim).any():
        raise ValueError(f"documents are not made of whole tokens of {dim} values")
    tokens = _vectors(data.reshape(-1, dim))
    column = pa.ListArray.from_arrays(pa.array((offsets // dim).astype(np.int32)), tokens)
    return spark.createDataFrame(pa.table({"doc_id": pa.array(np.arange(len(offsets) - 1), pa.int64()), "tokens": column}))


def hdf5_to_npy(source: str, target: str, dataset: str | None = None, rows: int = 8192) -> None:
    """Copies a two-dimensional HDF5 dataset to an npy file, `rows` at a time; h5py has to be there."""
    import h5py

    with h5py.File(source) as f:
        names: list[str] = []
        f.visititems(lambda name, item: names.append(name) if isinstance(item, h5py.Dataset) else None)
        if dataset is None:
            if len(names) != 1:
                raise ValueError(f"name one of the datasets {names}")
            dataset = names[0]
        data = f[dataset]
        if data.ndim != 2:
            raise ValueError(f"{dataset} is not two-dimensional")
        out = np.lib.format.open_memmap(target, mode="w+", dtype=np.float32, shape=data.shape)
        for i in range(0, data.shape[0], rows):
            out[i : i + rows] = data[i : i + rows]
        out.flush()
