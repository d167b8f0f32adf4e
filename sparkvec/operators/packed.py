"""Packed sparse vectors: components renumbered, delta-coded in bytes, values as 8-bit fixed point.

A packed vector is little-endian: the number of components (u16), a bit a
component (set where its gap takes two bytes), the gaps, the values (1/64
each), zeros up to a multiple of 8 bytes. One that doesn't fit in that form, by a gap
of over 16 bits or more than 65,534 components, begins with 65,535 and the number as u32, and has two bits
a component, the bytes of its gap less 1. Renumbering brings frequent components
together, so that most gaps take a byte; it changes no score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.operators.common import scores
from sparkvec.operators.search import SPARSE_BLOCK, SparseQueries, local_best, rank, result
from sparkvec.schema import Metric

MOST = 65_534
#: Components of a larger dimension that are renumbered: those that are most frequent. The others keep their order behind them.
HEAD = 1 << 16
#: Components that are packed or unpacked at once, about.
ENTRIES = 1 << 19
#: Below this many vectors a twentieth is no sample worth taking.
SAMPLE_LEAST = 50_000


def train_mapping(docs: DataFrame, dim: int, order: str = "frequency") -> np.ndarray:
    """new number of each component below dim; a permutation.

    frequency: by falling frequency, then by component. cooccurrence: components that occur in the same documents get
    close numbers: they are ordered by two min-hashes of the documents that they are in, then by falling frequency.
    """
    if order not in ("frequency", "cooccurrence"):
        raise ValueError("the order is frequency or cooccurrence")
    if dim > 1 << 16:
        raise ValueError("packed vectors have 16-bit components")
    t = _frequencies(docs, order).toArrow()  # at most 65,536 rows
    at = t.column("c").to_numpy().astype(np.int64)
    count, keys = np.zeros(dim, dtype=np.int64), [np.arange(dim)]
    count[at] = t.column("n").to_numpy()
    keys.append(-count)
    for name in ("h1", "h0") if order == "cooccurrence" else ():
        h = np.full(dim, np.iinfo(np.int64).max)
        h[at] = t.column(name).to_numpy()
        keys.append(h)
    order_ = np.lexsort(keys)
    mapping = np.empty(dim, dtype=np.int64)
    mapping[order_] = np.arange(dim)
    return mapping


class HeadMapping:
    """A permutation of the components below dim (2^32 at most): those in head get the numbers 0, 1, ... in its order, the others follow in theirs."""

    def __init__(self, head: np.ndarray, dim: int, back: bool = False):
        self.head, self.dim, self.back = np.asarray(head, dtype=np.int64), dim, back
        self.place = np.argsort(self.head, kind="stable")
        self.sorted = self.head[self.place]

    def __len__(self) -> int:
        return self.dim

    def __getitem__(self, c: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.asarray(c)
        if self.back:
            other = c - len(self.head)
            other += np.searchsorted(self.sorted - np.arange(len(self.head)), other, side="right")
            return np.where(c < len(self.head), self.head[np.minimum(c, len(self.head) - 1)], other)
        at = np.searchsorted(self.sorted, c)
        mine = np.minimum(at, len(self.head) - 1)
        return np.where(self.sorted[mine] == c, self.place[mine], c + len(self.head) - at)

    def inverse(self) -> HeadMapping:
        return HeadMapping(self.head, self.dim, not self.back)


def train_head(docs: DataFrame, dim: int, order: str = "frequency") -> HeadMapping:
    """train_mapping() of any dimension, of which only the HEAD most frequent components come to the driver."""
    if order not in ("frequency", "cooccurrence"):
        raise ValueError("the order is frequency or cooccurrence")
    if dim > 1 << 32:
        raise ValueError("components have 32 bits")
    t = _frequencies(docs, order).orderBy(F.desc("n"), "c").limit(HEAD).toArrow()
    keys = [t.column(x).to_numpy() * sign for x, sign in [("c", 1), ("n", -1), *((h, 1) for h in ("h1", "h0") if order == "cooccurrence")]]
    return HeadMapping(t.column("c").to_numpy()[np.lexsort(keys)], dim)


def train(docs: DataFrame, dim: int, order: str = "frequency") -> np.ndarray | HeadMapping:
    """A mapping for any dimension: of all components where they have 16 bits, else of the most frequent."""
    return train_mapping(docs, dim, order) if dim <= 1 << 16 else train_head(docs, dim, order)


def _frequencies(docs: DataFrame, order: str) -> DataFrame:
    """c, n, and by cooccurrence h0, h1, of each component, from a twentieth of many vectors."""
    n = docs.count()
    if n // 20 >= SAMPLE_LEAST:
        docs = docs.where(F.pmod(F.xxhash64("vec_id"), F.lit(20)) == 0)
    hashes = [F.min(F.xxhash64(F.lit(i), "vec_id")).alias(f"h{i}") for i in (0, 1)]
    return docs.select("vec_id", F.explode("components").alias("c")).groupBy("c").agg(F.count("*").alias("n"), *(hashes if order == "cooccurrence" else []))


def inverse(mapping: np.ndarray | HeadMapping) -> np.ndarray | HeadMapping:
    if isinstance(mapping, HeadMapping):
        return mapping.inverse()
    out = np.empty(len(mapping), dtype=np.int64)
    out[mapping] = np.arange(len(mapping))
    return out


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each row of `count` entries."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def pack_rows(components: np.ndarray, values: np.ndarray, count: np.ndarray, mapping: np.ndarray | HeadMapping) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of packed vectors whose components and values stand one after another, `count` of each."""
    row, j = np.repeat(np.arange(len(count)), count), _within(count)
    new = mapping[components]
    order = np.lexsort((new, row))
    new = new[order]
    gaps = np.where(j == 0, new, new - np.concatenate([[0], new[:-1]]))
    long = (count > MOST) | (np.bincount(row, weights=gaps > 65_535, minlength=len(count)) > 0)
    flag = 1 + long.astype(np.int64)  # bits a component
    more = (gaps > 255).astype(np.int64) + (gaps > 65_535) + (gaps > 0xFFFFFF)
    extra = np.bincount(row, weights=more, minlength=len(count)).astype(np.int64)
    head, bits = np.where(long, 6, 2), (count * flag + 7) // 8
    size = head + bits + 2 * count + extra
    size += -size % 8
    offsets = np.concatenate([[0], np.cumsum(size)])
    base, out = offsets[:-1], np.zeros(offsets[-1], dtype=np.uint8)
    short = np.where(long, 0xFFFF, count)
    out[base], out[base + 1] = short & 255, short >> 8
    for i in range(4):
        out[base[long] + 2 + i] = count[long] >> 8 * i & 255
    bit = j * flag[row]
    np.add.at(out, (base + head)[row] + bit // 8, (more << (bit & 7)).astype(np.uint8))
    at = (base + head + bits)[row] + j + _before(more, extra, count)
    for i in range(4):
        wide = more >= i
        out[at[wide] + i] = gaps[wide] >> 8 * i & 255
    out[(base + head + bits + count + extra)[row] + j] = np.clip(np.rint(values[order].astype(np.float64) * 64), 0, 255)
    return out, offsets


def _before(more: np.ndarray, extra: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bytes of gaps beyond their first ones, so far and within the row."""
    return np.cumsum(more) - more - np.repeat(np.concatenate([[0], np.cumsum(extra)])[:-1], count)


def _counts(data: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of components, whether in the long form) of packed vectors that begin at `base`."""
    count = data[base].astype(np.int64) | data[base + 1].astype(np.int64) << 8
    long = count == 0xFFFF
    count[long] = sum(data[base[long] + 2 + i].astype(np.int64) << 8 * i for i in range(4))
    return count, long


def unpack_rows(data: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(renumbered components, values, number of each row's) of packed vectors that begin at `base`."""
    count, long = _counts(data, base)
    flag, head = 1 + long.astype(np.int64), np.where(long, 6, 2)
    row, j = np.repeat(np.arange(len(count)), count), _within(count)
    bit = j * flag[row]
    more = data[(base + head)[row] + bit // 8].astype(np.int64) >> (bit & 7) & (2 * flag - 1)[row]
    extra = np.bincount(row, weights=more, minlength=len(count)).astype(np.int64)
    bits = (count * flag + 7) // 8
    at = (base + head + bits)[row] + j + _before(more, extra, count)
    gaps = data[at].astype(np.int64)
    for i in range(1, 4):
        wide = more >= i
        gaps[wide] |= data[at[wide] + i].astype(np.int64) << 8 * i
    total = np.cumsum(gaps)
    first = np.cumsum(count) - count
    new = total - np.repeat(np.concatenate([[0], total])[first], count)
    return new, data[(base + head + bits + count + extra)[row] + j].astype(np.float32) / 64, count


def pack_one(components: np.ndarray, values: np.ndarray, mapping: np.ndarray | HeadMapping) -> bytes:
    return pack_rows(np.asarray(components), np.asarray(values), np.array([len(components)]), mapping)[0].tobytes()


def unpack_one(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(renumbered components, values)."""
    return unpack_rows(np.frombuffer(raw, dtype=np.uint8), np.zeros(1, dtype=np.int64))[:2]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)


def _steps(count: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with some ENTRIES components each."""
    out, ends, lo = [], np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - count[lo] + ENTRIES, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def _packed(batch: pa.RecordBatch):
    """(vec_id, *unpack_rows()) of some rows (vec_id, packed) at a time; nulls are refused."""
    column = batch.column("packed")
    if column.null_count:
        raise ValueError("a packed vector is null")
    column = column.cast(pa.large_binary())
    base = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column)]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    for lo, hi in _steps(_counts(data, base)[0]):
        yield batch.column("vec_id").slice(lo, hi - lo), *unpack_rows(data, base[lo:hi])


def pack(docs: DataFrame, mapping: np.ndarray | HeadMapping) -> DataFrame:
    """vec_id, packed, n_components."""

    def work(batches):
        for batch in batches:
            (c, count), (v, n) = _flat(batch.column("components")), _flat(batch.column("values"))
            if (count != n).any():
                raise ValueError("components and values differ in number")
            if len(c) and (c.min() < 0 or c.max() >= len(mapping)):
                raise ValueError("component out of range")
            entries = np.concatenate([[0], np.cumsum(count)])
            for lo, hi in _steps(count):
                mine = slice(entries[lo], entries[hi])
                raw, offsets = pack_rows(c[mine], v[mine], count[lo:hi], mapping)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(lo, hi - lo), packed.cast(pa.binary()), pa.array(count[lo:hi], pa.int32())], names=["vec_id", "packed", "n_components"])

    return docs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("components").cast("array<long>").alias("components"), "values").mapInArrow(work, "vec_id long, packed binary, n_components int")


def unpack(packed: DataFrame, mapping: np.ndarray | HeadMapping) -> DataFrame:
    """vec_id, components, values, in the order of the original components."""
    back = inverse(mapping)

    def work(batches):
        for batch in batches:
            for ids, new, values, count in _packed(batch):
                old = back[new]
                order = np.lexsort((old, np.repeat(np.arange(len(count)), count)))
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(old[order], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(values[order], pa.float32()))], names=["vec_id", "components", "values"])

    return packed.select("vec_id", "packed").mapInArrow(work, "vec_id long, components array<long>, values array<float>")


def top_k(packed: DataFrame, queries: DataFrame, mapping: np.ndarray | HeadMapping, k: int) -> DataFrame:
    """query_id, doc_id, rank, score by dot product; queries are sparse and not packed."""
    own = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("components").cast("array<long>").alias("components"), F.col("values").cast("array<float>").alias("values"))
    if own.where((F.array_min("components") < 0) | (F.array_max("components") >= len(mapping))).limit(1).count():
        raise ValueError("component out of range")

    def prepare(table):
        c = table.column("components").combine_chunks()
        new = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_flat(c)[1])]).astype(np.int32)), pa.array(mapping[c.flatten().to_numpy(zero_copy_only=False)], pa.int64()))
        return SparseQueries(table.column("query_id").to_numpy(), new, table.column("values").combine_chunks())

    def score(state, batch):
        for ids, *rows in _packed(batch):
            yield from local_best(state.products(*rows), np.asarray(ids.to_numpy(zero_copy_only=False)), state.q_id, k, Metric.DOT)

    return result(rank(scores(packed.select(F.col("vec_id").cast("long").alias("vec_id"), "packed"), own, SPARSE_BLOCK, prepare, score), k, Metric.DOT))


@dataclass(frozen=True)
class PackedEncoder:
    """The mapping of components, as an encoder of sparse collections; dot product only."""

    mapping: np.ndarray | HeadMapping

    @staticmethod
    def fit(docs: DataFrame, dim: int, order: str = "frequency") -> PackedEncoder:
        return PackedEncoder(train(docs, dim, order))

    def encode(self, docs: DataFrame) -> DataFrame:
        return pack(docs, self.mapping)

    def decode(self, packed: DataFrame) -> DataFrame:
        return unpack(packed, self.mapping)

    def top_k(self, packed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return top_k(packed, queries, self.mapping, k)

    def space_bytes(self) -> int:
        """The mapping in 16 bits a component, 32 for each of the most frequent of a larger dimension, and the dimension."""
        return 16 + (4 * len(self.mapping.head) if isinstance(self.mapping, HeadMapping) else 2 * len(self.mapping)) + 8

    def state(self) -> dict[str, np.ndarray]:
        if isinstance(self.mapping, HeadMapping):
            return {"head": self.mapping.head, "dim": np.array([self.mapping.dim])}
        return {"mapping": self.mapping}

    @staticmethod
    def from_state(state: dict[str, np.ndarray]) -> PackedEncoder:
        return PackedEncoder(HeadMapping(state["head"], int(state["dim"][0])) if "head" in state else state["mapping"])
