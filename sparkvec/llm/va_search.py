"""Exact top-k search with vector-approximation files.

Every row is a query; its k nearest other rows by squared Euclidean distance are
found exactly. Each dimension is cut into 256 cells of equal width between its
least and largest value; a row's approximation is the cell of each of its values
(a byte a dimension) and its distance from the middle of its cells. Rows are packed into
blocks; of each block two files are written to the shared folder, one of
approximations and one of exact vectors. The work of one task is a block
of queries against a group of data blocks:

1. Scan: the approximations alone are read. One matrix product of queries and cell middles
   gives, with the stored distances from the middles, a lower and an upper bound of every
   distance (triangle inequality; widened by what the product may be off by,
   which grows with the dimension). The k-th least upper bound met so far bounds the k-th distance;
   rows whose lower bound exceeds it are out.
2. The exact vectors of the others are read from their file in lower-bound order, some
   for each query at a time, until the next lower bound exceeds the k-th exact distance.

The k best of every task are then cut to the k best of each query. Only names of files and these
results are exchanged; a task holds one block of approximations at a time, and nothing is broadcast but the cell borders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvec.llm.common import cut, longs, new_path, stored, take
from sparkvec.llm.files import Shard, settle

BLOCK = 8192
#: Queries whose bounds are held at once.
CHUNK = 512
#: Data blocks that a task scans at most.
GROUP = 8
CELLS = 256
#: Exact vectors that are read for a query between two looks at the bound.
FETCH = 12
#: Bytes between two wanted vectors that are read along rather than skipped.
GAP = 4096
#: Values up to here have squares and sums of squares that 32-bit floats hold.
NARROW = 1e15


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in dimension order in double precision."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j].astype(np.float64) - b[:, j].astype(np.float64)
        out += d * d
    return out


class Grid:
    """The cells of all dimensions."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.width = low, np.maximum((high - low) / CELLS, 1e-30)
        self.kind = np.float32 if max(np.abs(low).max(), np.abs(high).max()) < NARROW else np.float64

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.low) / self.width), 0, CELLS - 1).astype(np.uint8)

    def middles(self, code: np.ndarray) -> np.ndarray:
        return (self.low + (code + 0.5) * self.width).astype(np.float32)

    def radii(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How far rows are from the middles of their cells, rounded up."""
        r = np.sqrt(exact(x, self.middles(code))) * (1 + 1e-12)
        return np.nextafter(r.astype(np.float32), np.float32(np.inf))


class Products:
    """Squared distances of some queries to the cell middles of a block, and what they may be off by."""

    def __init__(self, q: np.ndarray, grid: Grid, code: np.ndarray):
        m, q = grid.middles(code).astype(grid.kind), q.astype(grid.kind)
        self.qq, self.mm = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", m, m)
        self.square = q @ m.T
        self.square *= -2
        self.square += self.mm[None, :]
        self.square += self.qq[:, None]
        # Each of d products and sums is off by half a unit in the last place at most, of no more than (qq + mm) / 2.
        self.unit = float(np.finfo(grid.kind).eps) * (q.shape[1] + 8)

    def bounds(self, row: np.ndarray, col: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of these distances (not squared)."""
        s, r = self.square[row, col].astype(np.float64), radius[col].astype(np.float64)
        slack = self.unit * (self.qq[row].astype(np.float64) + self.mm[col]) + 1e-30
        near = np.sqrt(np.maximum(s - slack, 0)) * (1 - 1e-12) - r
        return np.maximum(near, 0), np.sqrt(np.maximum(s + slack, 0)) * (1 + 1e-12) + r

    def within(self, limit: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all whose lower bound may be `limit` at most."""
        top = (limit + float(radius.max())) ** 2 * (1 + 1e-9) + self.unit * (self.qq.astype(np.float64) + float(self.mm.max())) * 2 + 1e-30
        return np.nonzero(self.square <= np.nextafter(top.astype(self.square.dtype), np.inf, dtype=self.square.dtype)[:, None])


def least(k: int, held: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """held (queries, k), with these values put among them: the k least of each row, in order."""
    if not len(row):
        return held
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    use = place < k
    more = np.full(held.shape, np.inf)
    more[row[use], place[use]] = value[use]
    return np.sort(np.concatenate([held, more], axis=1), axis=1)[:, :k]


class Best:
    """The k best rows so far of each query."""

    def __init__(self, n: int, k: int):
        self.distance, self.ident = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, distance: np.ndarray, ident: np.ndarray) -> None:
        """distance and ident: some candidates for each of `rows`, infinite where there is none."""
        d = np.concatenate([self.distance[rows], distance], axis=1)
        i = np.concatenate([self.ident[rows], ident], axis=1)
        order = np.lexsort((i, d), axis=1)[:, : self.distance.shape[1]]
        self.distance[rows], self.ident[rows] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


class Scan:
    """Some queries: what the approximations leave of the data blocks."""

    def __init__(self, q: np.ndarray, k: int, grid: Grid):
        self.q, self.k, self.grid = q, k, grid
        self.upper = np.full((len(q), k), np.inf)  # the k least upper bounds
        self.kept: list[tuple[np.ndarray, ...]] = []

    def block(self, number: int, code: np.ndarray, radius: np.ndarray, own: int | None) -> None:
        """own: the row of this block that is the first query itself, the next one the second."""
        p = Products(self.q, self.grid, code)
        if own is not None:
            at = np.arange(len(self.q))
            p.square[at, own + at] = np.inf
        if np.isinf(self.upper[:, -1]).any():  # nothing bounds all queries yet: the k that look nearest do
            near = np.argpartition(p.square, self.k - 1, axis=1)[:, : self.k] if len(code) > self.k else np.tile(np.arange(len(code)), (len(self.q), 1))
            row, col = np.repeat(np.arange(len(self.q)), near.shape[1]), near.ravel()
            there = np.isfinite(p.square[row, col])
            row, col = row[there], col[there]
            limit = least(self.k, self.upper, row, p.bounds(row, col, radius)[1])[:, -1]
        else:
            limit = self.upper[:, -1]
        row, col = p.within(limit, radius)
        there = np.isfinite(p.square[row, col])
        row, col = row[there], col[there]
        lower, upper = p.bounds(row, col, radius)
        use = lower <= limit[row]
        row, col, lower, upper = row[use], col[use], lower[use], upper[use]
        self.upper = least(self.k, self.upper, row, upper)
        self.kept.append((row, np.full(len(row), number), col, lower))

    def survivors(self) -> tuple[np.ndarray, ...]:
        """(query, block number, row, lower bound) in the order of query and lower bound."""
        row, number, col, lower = (np.concatenate(x) for x in zip(*self.kept))
        use = lower <= self.upper[row, -1]
        row, number, col, lower = row[use], number[use], col[use], lower[use]
        order = np.lexsort((lower, row))
        return row[order], number[order], col[order], lower[order]

    def finish(self, vectors, idents: list[np.ndarray]) -> Best:
        """vectors(block number, rows): exact vectors, read in lower-bound order until the k-th distance is certain."""
        best = Best(len(self.q), self.k)
        row, number, col, lower = self.survivors()
        at = np.searchsorted(row, np.arange(len(self.q)))
        end = np.searchsorted(row, np.arange(len(self.q)), side="right")
        while True:
            open_ = np.flatnonzero(at < end)
            # Certain: no candidate left, or the next lower bound is beyond the k-th exact distance.
            open_ = open_[lower[at[open_]] ** 2 <= best.distance[open_, -1] * (1 + 1e-9)]
            if not len(open_):
                return best
            take_ = at[open_][:, None] + np.arange(FETCH)[None, :]
            there = take_ < end[open_][:, None]
            pick = take_[there]
            d, ident = np.full(there.shape, np.inf), np.full(there.shape, np.iinfo(np.int64).max)
            got, who = np.empty(len(pick)), np.empty(len(pick), dtype=np.int64)
            query = np.repeat(open_, there.sum(axis=1))
            for b in np.unique(number[pick]).tolist():
                mine = np.flatnonzero(number[pick] == b)
                rows, back = np.unique(col[pick[mine]], return_inverse=True)
                got[mine] = exact(self.q[query[mine]], vectors(b, rows)[back])
                who[mine] = idents[b][col[pick[mine]]]
            d[there], ident[there] = got, who
            best.add(open_, d, ident)
            at[open_] = np.minimum(at[open_] + FETCH, end[open_])


def _open(folder: str, name: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    return system.open_input_file(f"{root}/{name}")


def read_vectors(file, dim: int, rows: np.ndarray) -> np.ndarray:
    """These rows (ascending) of a file of float32 vectors; near ones by one read."""
    width = 4 * dim
    out = np.empty((len(rows), dim), dtype=np.float32)
    edge = np.flatnonzero(np.diff(rows) * width > GAP) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)]):
        first, last = int(rows[a]), int(rows[b - 1])
        raw = file.read_at((last - first + 1) * width, first * width)
        out[a:b] = np.frombuffer(raw, dtype=np.float32).reshape(-1, dim)[rows[a:b] - first]
    return out


def _border(batches):
    """Least and largest value of each dimension in a task, with the numbers of rows and of the least and most dimensions."""
    low = high = None
    n, sizes = 0, set()
    for batch in batches:
        if not batch.num_rows:
            continue
        x = cut(batch.column("vector"))
        sizes |= set(pc.unique(pc.list_value_length(x)).to_pylist())
        n += len(x)
        if len(sizes) > 1:
            continue
        v = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        low = v.min(axis=0) if low is None else np.minimum(low, v.min(axis=0))
        high = v.max(axis=0) if high is None else np.maximum(high, v.max(axis=0))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([min(sizes)], pa.int32()), pa.array([max(sizes)], pa.int32()), pa.array([low.astype(float)], pa.list_(pa.float64())), pa.array([high.astype(float)], pa.list_(pa.float64()))], names=["n", "short", "long", "low", "high"])


def _pack(grid: Grid, folder: str):
    def work(table: pa.Table) -> pa.Table:
        ids = longs(table.column("id"))
        v = cut(table.column("vector")).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float32)
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        first = np.append(True, ids[1:] != ids[:-1])
        if not first.all():  # of several vectors of one id the least
            order = np.lexsort((*v.T[::-1], ids))
            ids, v = ids[order][first], v[order][first]
        code = grid.cells(v)
        block = table.column("block")[0].as_py()
        names = []
        for kind, parts_ in (("cells", (code, grid.radii(v, code), ids)), ("exact", (v,))):
            file = Shard(f"{folder}/{kind}", f"{block:08d}", f".{kind}")
            for part in parts_:
                file.write(part.tobytes())
            names.append(file.close())
        return pa.table({"block": pa.array([block], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "cells": [names[0]], "exact": [names[1]]})

    return work


def _approximations(folder: str, name: str, n: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, distances from their middles, ids) of a block."""
    with _open(f"{folder}/cells", name) as f:
        raw = f.read()
    return np.frombuffer(raw, np.uint8, n * dim).reshape(n, dim), np.frombuffer(raw, np.float32, n, n * dim), np.frombuffer(raw, np.int64, n, n * dim + 4 * n)


def _search(grid: Grid, folder: str, k: int):
    dim = len(grid.low)

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with _open(f"{folder}/exact", r["q_exact"]) as f:
                    q = np.frombuffer(f.read(), dtype=np.float32).reshape(-1, dim)
                q_ids = _approximations(folder, r["q_cells"], r["q_n"], dim)[2]
                starts = range(0, len(q), CHUNK)
                scans = [Scan(q[lo : lo + CHUNK], k, grid) for lo in starts]
                ids = []
                for number, b in enumerate(r["data"]):
                    code, radius, own_ids = _approximations(folder, b["cells"], b["n"], dim)
                    ids.append(own_ids)
                    for lo, scan in zip(starts, scans):
                        scan.block(number, code, radius, lo if b["block"] == r["q_block"] else None)
                files = [_open(f"{folder}/exact", b["exact"]) for b in r["data"]]
                for lo, scan in zip(starts, scans):
                    best = scan.finish(lambda b, rows, files=files: read_vectors(files[b], dim, rows), ids)
                    found = np.isfinite(best.distance)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[lo : lo + CHUNK], found.sum(axis=1))), pa.array(best.ident[found]), pa.array(best.distance[found])], names=["query_id", "vec_id", "distance"])
                for f in files:
                    f.close()

    return work


def top_k(vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, rank, distance: the k nearest other vectors of each vector.

    Squared Euclidean distance in double precision over the float values; ties
    go to the lower id. Rows with a null id, a null or empty vector, or a value
    that is null, not a number or infinite take no part; vectors of another
    length than the longest raise. Of several rows with one id the least vector
    (value by value) is used. Tables of fewer than k + 1 ids give
    what there is. Other columns are ignored.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    own = take(vectors, id=key, vector=vector).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    inf = float("inf")
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(inf)))
    own = own.where(F.col("id").isNotNull() & (F.size("vector") > 0) & sound)
    border = stored(own.select("vector").mapInArrow(_border, "n long, short int, long int, low array<double>, high array<double>"), "borders")
    total = border.agg(F.sum("n").alias("n"), F.min("short").alias("short"), F.max("long").alias("long")).first()
    if not total.n:
        return spark.createDataFrame([], "query_id long, vec_id long, rank int, distance double")
    if total.short != total.long:
        raise ValueError("the vectors have several lengths")
    ends = border.select(F.posexplode(F.arrays_zip("low", "high")).alias("d", "v")).groupBy("d").agg(F.min("v.low").alias("low"), F.max("v.high").alias("high")).orderBy("d").collect()
    grid = Grid(np.array([r.low for r in ends]), np.array([r.high for r in ends]))
    blocks = max(1, -(-total.n // BLOCK))
    folder = new_path(spark, "vectors")
    # Blocks are of like size, whatever the ids are.
    packed = own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_pack(grid, folder), "block int, n int, cells string, exact string")
    packed = stored(packed, "blocks")
    for kind in ("cells", "exact"):
        settle(f"{folder}/{kind}", packed, kind)
    # Some groups of data blocks, so that there is work for all cores, and a task's scan stays short.
    groups = max(min(blocks, -(-3 * spark.sparkContext.defaultParallelism // blocks)), -(-blocks // GROUP))
    data = packed.groupBy(F.pmod("block", F.lit(groups)).alias("group")).agg(F.sort_array(F.collect_list(F.struct("block", "n", "cells", "exact"))).alias("data"))
    q = packed.select(F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("cells").alias("q_cells"), F.col("exact").alias("q_exact"))
    pairs = q.crossJoin(data).repartition(min(blocks * groups, 100_000))
    found = pairs.select("q_block", "q_n", "q_cells", "q_exact", "data").mapInArrow(_search(grid, folder, k), "query_id long, vec_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "distance")
