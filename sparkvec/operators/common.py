"""What the operators share: size checks, scoring by blocks, sums in a tree, Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that one side of a join may have to be sent to every executor.
BROADCAST_BYTES = 64 << 20


#: States of query blocks that a task keeps; those beyond are made again for each batch.
STATES = 8
#: Bytes of rows that are boxed together.
BOX_BYTES = 4 << 20
#: Partial sums that one task adds up.
FAN_IN = 64
SCORES = "query_id long, doc_id long, score double"


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of a plan's size; behind filters it is that of the table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _width(column: Column, kind: T.DataType) -> Column:
    """The bytes of a value, about."""
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.ArrayType | T.StructType | T.StringType | T.BinaryType):
            return F.lit(16) + F.aggregate(F.transform(column, lambda x: _width(x, inner).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.lit(16) + F.size(column) * F.lit(8 if isinstance(inner, T.LongType | T.DoubleType) else 4)
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(16) + F.length(column) if isinstance(kind, T.StringType | T.BinaryType) else F.lit(8)


def measured(df: DataFrame) -> int:
    """The bytes of the rows of df, by looking at them."""
    widths = [F.coalesce(_width(F.col(f"`{f.name}`"), f.dataType).cast("long"), F.lit(8)) for f in df.schema]
    return df.select(F.sum(sum(widths[1:], widths[0]))).first()[0] or 0


def small(df: DataFrame, limit: int | None = None, most: int | None = None) -> bool:
    """Whether df may be sent to every executor. most: bytes that it is known not to exceed. A plan that Spark takes for large is measured."""
    limit = BROADCAST_BYTES if limit is None else limit
    if most is not None and most <= limit:
        return True
    return bytes_of(df) <= limit or (most is None and measured(df) <= limit)


def sized(df: DataFrame, limit: int | None = None, most: int | None = None) -> DataFrame:
    """df marked for broadcast if it is small; a join shuffles it otherwise."""
    return F.broadcast(df) if small(df, limit, most) else df


def boxed(df: DataFrame, name: str, rows: int) -> DataFrame:
    """df with up to `rows` rows, and some megabytes, in a row of one binary column."""

    def work(batches):
        for batch in batches:
            step = max(1, min(rows, batch.num_rows * BOX_BYTES // max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_arrays([pa.array([in_box(batch.slice(lo, step))], pa.binary())], names=[name])

    return df.mapInArrow(work, f"{name} binary")


def in_box(piece: pa.RecordBatch | pa.Table) -> bytes:
    """The rows of a slice alone; pickled, a slice would take along all that it is a slice of."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, piece.schema) as out:
        out.write(piece)
    return sink.getvalue().to_pybytes()


def unboxed(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def scores(docs: DataFrame, queries: DataFrame, block: int, prepare, score) -> DataFrame:
    """query_id, doc_id, score: what score(prepare(some queries), a batch of docs) yields, for all queries and docs.

    Small queries are in the closure, and docs stream past them. Otherwise boxes of queries and of docs meet pair by pair.
    """
    if small(queries):
        table = queries.toArrow().combine_chunks()
        pieces = [in_box(table.slice(lo, block)) for lo in range(0, table.num_rows, block)]

        def work(batches):
            states = [prepare(unboxed(p)) for p in pieces[:STATES]]
            for batch in batches:
                for i in range(len(pieces) if batch.num_rows else 0):
                    yield from score(states[i] if i < STATES else prepare(unboxed(pieces[i])), batch)

        return docs.mapInArrow(work, SCORES)

    def pairs(batches):
        for batch in batches:
            for q, d in zip(batch.column("q"), batch.column("d")):
                state = prepare(unboxed(q.as_py()))
                for piece in unboxed(d.as_py()).to_batches():
                    yield from score(state, piece)

    return boxed(queries, "q", block).crossJoin(boxed(docs, "d", 10_000)).select("q", "d").mapInArrow(pairs, SCORES)


def tree_sum(partial: DataFrame, names: tuple[str, ...], tasks: int) -> Row:
    """The sums of binary columns of doubles over all rows (task, *names), in the order of tasks, some FAN_IN at a time."""
    kind = "task long, " + ", ".join(f"{n} binary" for n in names)

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("task").to_numpy(), kind="stable")
        columns = {n: table.column(n).to_pylist() for n in names}
        sums = {n: pa.array([sum(np.frombuffer(columns[n][i], dtype=np.float64) for i in order.tolist()).tobytes()], pa.binary()) for n in names}
        return pa.table({"task": table.column("task").slice(0, 1), **sums})

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        team = F.floor(F.col("task") / FAN_IN).cast("long")
        partial = partial.withColumn("task", team).groupBy("task").applyInArrow(lambda t: add(t), kind)
    return partial.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: add(t), kind).first()


def task_number() -> pa.Array:
    from pyspark import TaskContext

    return pa.array([TaskContext.get().partitionId()], pa.int64())


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of equal lengths as a float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.float32)


def fold_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed like functions.distance.dot, bit for bit."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return out


def fold_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j].astype(np.float64) - b[:, j].astype(np.float64)
        out += d * d
    return out


def best_rows(score: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the entries of each column that may be among its k largest, scores being off by `slack` at most."""
    if score.shape[0] <= k:
        row, col = np.indices(score.shape)
        return col.ravel(), row.ravel()
    kth = np.partition(score, score.shape[0] - k, axis=0)[score.shape[0] - k]
    row, col = np.nonzero(score >= (kth - 2 * slack)[None, :])
    return col, row
