"""Sparse top-k for many queries: boxes of queries meet inverted boxes of documents, both files in a shared folder.

A task has one box of queries at a time, reads the boxes of documents that may share a component with it, one by one, and keeps the k
best documents of each query, so nothing but those is shuffled and memory is that of two boxes. For the dot product, boxes
without a common range of components are passed over: all their products are 0, and of those only the k lowest ids can matter.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.operators.common import BOX_BYTES, SCORES
from sparkvec.schema import Metric

#: Components with the same number in a mask (64 a range), and bits of a mask; numbers beyond go round.
RANGE, BITS = 64, 1 << 16
#: Products, and pairs of a query and a document, that are held at once.
HELD = 1 << 21


def _put(path: str, arrays: list[np.ndarray]) -> None:
    from sparkvec.sources.binary import _place

    system, place = _place(path)
    with system.open_output_stream(place) as f:
        f.write(np.array([len(a) for a in arrays], np.int64).tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).data)


def _get(path: str, kinds: tuple) -> list[np.ndarray]:
    from sparkvec.sources.binary import _place

    system, place = _place(path)
    with system.open_input_file(place) as f:
        raw = f.read()
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)), kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


#: Queries: ids, number of entries, components, values. Documents, by id: ids, norms, components, where the entries of each begin, their documents, their values.
QUERY, DOCUMENT = (np.int64, np.int64, np.int64, np.float32), (np.int64, np.float64, np.int64, np.int64, np.int64, np.float32)


def _query_box(ids, count, c, v):
    return [ids, count, c, v]


def _document_box(ids, count, c, v):
    row = np.repeat(np.arange(len(ids)), count)
    norm = np.bincount(row, weights=v.astype(np.float64) ** 2, minlength=len(ids))
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[by_id] = np.arange(len(ids))
    order = np.argsort(c, kind="stable")
    used, first = np.unique(c[order], return_index=True)
    return [ids[by_id], norm[by_id], used, np.append(first, len(c)), place[row[order]], v[order]]


def _mask(c: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[c // RANGE % BITS] = 1
    return np.packbits(bits)


def _write(df: DataFrame, key: str, folder: str, box, lowest: int) -> pa.Table:
    """Writes boxes of df; name, mask and the `lowest` lowest ids of each."""

    def work(batches):
        held, size = [], 0

        def put():
            ids, count, c, v = (np.concatenate(x) for x in zip(*held))
            path = f"{folder}/{uuid.uuid4().hex}"
            _put(path, box(ids, count, c, v))
            return pa.RecordBatch.from_pydict({"name": [path], "mask": [_mask(c).tobytes()], "low": [np.sort(ids)[:lowest].tobytes()]})

        for batch in batches:
            ids = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            count, values = (np.asarray(pc.fill_null(pc.list_value_length(batch.column(x)), 0)).astype(np.int64) for x in ("components", "values"))
            c, v = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("components", "values"))
            if (count != values).any():
                raise ValueError("components and values differ in number")
            entries, lo = np.concatenate([[0], np.cumsum(count)]), 0
            ends = np.cumsum(16 + 12 * count)
            while lo < len(ids):
                base = ends[lo] - 16 - 12 * count[lo]
                hi = max(int(np.searchsorted(ends, base + BOX_BYTES - size, side="right")), lo + (not held))
                if hi > lo:
                    mine = slice(entries[lo], entries[hi])
                    held.append((ids[lo:hi], count[lo:hi], c[mine], v[mine]))
                    size += int(ends[hi - 1] - base)
                if hi < len(ids):
                    yield put()
                    held, size = [], 0
                lo = hi
        if held:
            yield put()

    rows = df.select(F.col(key).cast("long").alias(key), F.col("components").cast("array<long>").alias("components"), F.col("values").cast("array<float>").alias("values"))
    return rows.mapInArrow(work, "name string, mask binary, low binary").toArrow()


def _best(row, ids, score, k: int, metric: Metric):
    """The k best of each row; ties go to the lower id."""
    order = np.lexsort((ids, -score if metric.larger_is_better else score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def _meet(query, document, k: int, metric: Metric):
    """(row of the query, id, score) of the k best documents of a box for each query of a box; some queries at a time."""
    _, count, c, v = query
    ids, norm, used, first, place, value = document
    v, row = v.astype(np.float64), np.repeat(np.arange(len(count)), count)
    at = np.minimum(np.searchsorted(used, c), max(len(used) - 1, 0))
    hit = np.flatnonzero(used[at] == c) if len(used) else np.zeros(0, dtype=np.int64)
    start, length, hit_row = first[at[hit]], first[at[hit] + 1] - first[at[hit]], row[hit]
    cost = np.cumsum(np.bincount(hit_row, weights=length, minlength=len(count)) + len(ids))
    lo = 0
    while lo < len(count):
        hi = max(int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + HELD, side="right")), lo + 1)
        a, b = np.searchsorted(hit_row, [lo, hi])
        n = length[a:b]
        entry = np.repeat(start[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat((hit_row[a:b] - lo) * len(ids), n) + place[entry]
        # The products of a pair are added in the order of the query's components.
        score = np.bincount(cell, weights=np.repeat(v[hit[a:b]], n) * value[entry], minlength=(hi - lo) * len(ids)).reshape(hi - lo, len(ids))
        if metric is Metric.L2:
            mine = (row >= lo) & (row < hi)
            score = np.bincount(row[mine] - lo, weights=v[mine] ** 2, minlength=hi - lo)[:, None] + norm[None, :] - 2.0 * score
        if np.isnan(score).any():
            raise ValueError("a vector holds a value that is not a number")
        good = score if metric.larger_is_better else -score
        if len(ids) > k:
            kth = np.partition(good, len(ids) - k, axis=1)[:, len(ids) - k, None]
            ties = good == kth
            keep = (good > kth) | (ties & (np.cumsum(ties, axis=1) <= k))
        else:
            keep = np.ones(good.shape, dtype=bool)
        r, d = np.nonzero(keep)
        yield r + lo, ids[d], score[r, d]
        lo = hi


def top_scores(docs: DataFrame, queries: DataFrame, k: int, metric: Metric) -> DataFrame:
    """query_id, doc_id, score of the k best sparse documents of each query; any number of both."""
    from sparkvec.sources.binary import _place
    from sparkvec.sources.store import shared_folder

    spark = docs.sparkSession
    if k <= 0:
        return spark.createDataFrame([], SCORES)
    folder = shared_folder(spark)
    for kind in ("docs", "queries"):
        system, place = _place(f"{folder}/{kind}")
        system.create_dir(place)
    d, q = _write(docs, "vec_id", f"{folder}/docs", _document_box, k), _write(queries, "query_id", f"{folder}/queries", _query_box, 0)
    names, own = d.column("name").to_pylist(), q.column("name").to_pylist()
    if not names or not own:
        return spark.createDataFrame([], SCORES)
    masks = np.frombuffer(b"".join(d.column("mask").to_pylist()), np.uint64).reshape(len(names), -1)
    low = [np.frombuffer(x, np.int64) for x in d.column("low").to_pylist()]

    def work(batches):
        for i in (i for batch in batches for i in batch.column("id").to_pylist()):
            query = _get(own[i], QUERY)
            near = np.ones(len(names), dtype=bool) if metric is Metric.L2 else (masks & _mask(query[2]).view(np.uint64)).any(axis=1)
            rows = np.arange(len(query[0]))
            far = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *(low[j] for j in np.flatnonzero(~near))]))[:k]
            best = np.repeat(rows, len(far)), np.tile(far, len(rows)), np.zeros(len(rows) * len(far))
            for j in np.flatnonzero(near):
                for found in _meet(query, _get(names[j], DOCUMENT), k, metric):
                    best = tuple(np.concatenate(x) for x in zip(best, found))
                    if len(best[0]) > 4 * k * len(rows):
                        best = _best(*best, k, metric)
            row, ids, score = _best(*best, k, metric)
            yield pa.RecordBatch.from_arrays([pa.array(query[0][row], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "doc_id", "score"])

    return spark.range(0, len(own), 1, len(own)).mapInArrow(work, SCORES)
