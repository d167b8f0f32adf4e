"""Removal of repeated passages by a hash-compared suffix sort.

A window is `length` consecutive words (words are separated by white space;
case and punctuation count, the kind of white space doesn't). A window repeats
when an earlier document, in the order of (doc_id, row), holds the same words,
or the same document holds them at least `length` words earlier. All words of
repeating windows are removed, so that the first occurrence stays.

The suffixes of the whole corpus that start at words are sorted, but only those
that can share `length` words with another need to meet:

1. Each window has an anchor, the least hash of its `gram`-word grams. Equal
   windows have equal anchors at equal offsets, and an anchor serves a run of
   some twenty windows. Only anchors are exchanged; one that occurs once in the
   corpus ends here, with all its windows.
2. For an anchor that occurs again, the words of its run of windows are sent to
   the anchor's partition.
3. There, the suffixes at equal offsets of equal anchors are mergesorted. Two
   suffixes are compared through prefix polynomial hashes: a binary search over
   the length finds their longest common extension in O(log length) steps, and
   the word behind it decides. All runs of one level are merged at once.
   Neighbours with an extension of `length` words are repeats; their words are
   then compared themselves. Where that shows a hash collision, the suffixes of that anchor and
   offset are matched by their words instead, so a collision neither makes nor hides a repeat.
4. Repeats are merged into spans by document.

A hot passage is not special: its suffixes are sorted like any others, and what
a partition holds of it is its words around each occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvec.llm import textnp
from sparkvec.llm.common import blobs, list_array, longs, numbered, parts, place, ranges, row_id, runs, sized, stored, take, tidy_batches, tidy_group

#: Bytes of words that a map task gathers before it sends them on.
FLUSH = 12 << 20
#: 64-bit numbers that describe a run of windows: anchor, doc_id, row, first window, windows, offset of the anchor
#: in the first window, and by how much the offset falls from window to window: 1, or 0 where the anchor moves along.
HEAD = 7
#: Suffixes that are sorted side by side.
SORTED = 1 << 18


def window_anchors(words: textnp.Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, position, hash) of each anchor; positions are word numbers."""
    n = len(words)
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if n < length:
        return none
    valid = np.flatnonzero(words.doc[: n - length + 1] == words.doc[length - 1 :])
    if not len(valid):
        return none
    m = n - gram + 1
    with np.errstate(over="ignore"):
        h = np.zeros(m, dtype=np.uint64)
        for j in range(gram):
            h = h * np.uint64(textnp.WORD_BASE) + words.hash[j : j + m]
    h = textnp.mix64(h)
    bits = np.uint64(max(16, int(n).bit_length()))
    best = ((h >> bits) << bits) | np.arange(m, dtype=np.uint64)  # of equal grams the first
    size, width = 1, length - gram + 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    at = (best[valid] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start, count = runs(at, words.doc[valid])
    return valid[start], count, at[start], h[at[start]]


def _anchors(length: int, gram: int):
    def work(batches):
        for batch in batches:
            rows = longs(batch.column("row"))
            out = []
            for lo, words in textnp.steps(batch.column("text"), "solid", lower=False):
                _, _, at, h = window_anchors(words, length, gram)
                d = words.doc[at]
                out.append((h.view(np.int64), rows[lo + d], at - words.first[d]))
            if out:
                h, row, at = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(row), pa.array(at.astype(np.int32))], names=["anchor", "row", "at"])

    return work


def _sent(length: int, gram: int, split: int):
    def work(batches):
        held: list[tuple[np.ndarray, list[bytes]]] = []
        size = 0

        def flush():
            nonlocal held, size
            heads = np.concatenate([x[0] for x in held])
            texts = [t for x in held for t in x[1]]
            held, size = [], 0
            part = ((heads[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(split)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            start, count = runs(part[order])
            joined = [b"\n".join(texts[i] for i in order[s : s + c].tolist()) + b"\n" for s, c in zip(start.tolist(), count.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(part[order][start].astype(np.int32)), pa.array(blobs(heads[order].reshape(-1), count * HEAD), pa.binary()), pa.array(joined, pa.binary())], names=["part", "heads", "words"])

        for batch in batches:
            ids, rows = longs(batch.column("key")), longs(batch.column("row"))
            wanted = batch.column("at")
            for lo, words in textnp.steps(batch.column("text"), "solid", lower=False):
                first, count, at, h = window_anchors(words, length, gram)
                docs = len(words.offsets) - 1
                lists = wanted.slice(lo, docs)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(docs), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                mine = np.sort((of << 32) + flat)
                d = words.doc[at]
                key = (d << 32) + at - words.first[d]
                use = mine[np.minimum(np.searchsorted(mine, key), len(mine) - 1)] == key if len(mine) else np.zeros(len(key), dtype=bool)
                first, count, at, h, d = first[use], count[use], at[use], h[use], d[use]
                if not len(first):
                    continue
                # Where a gram follows itself (one word again and again), each window has an anchor of its own: one run all the same.
                moves = np.zeros(len(first), dtype=bool)
                moves[1:] = (count[1:] == 1) & (count[:-1] == 1) & (h[1:] == h[:-1]) & (at[1:] == at[:-1] + 1) & (first[1:] == first[:-1] + 1) & (d[1:] == d[:-1])
                s = np.flatnonzero(~moves)
                n = np.diff(np.append(s, len(first)))
                first, at, h, d, count, falls = first[s], at[s], h[s], d[s], np.where(n > 1, n, count[s]), (n == 1).astype(np.int64)
                # All words with one space behind each: slices of this are what is sent.
                wide = words.end - words.start + 1
                ends = np.cumsum(wide)
                source = np.minimum(ranges(words.start, wide), len(words.data) - 1)
                plain = words.data[source]
                plain[ends - 1] = 32
                raw = plain.tobytes()
                begin = ends - wide
                heads = np.stack([h.view(np.int64), ids[lo + d], rows[lo + d], first - words.first[d], count, at - first, falls], axis=1)
                texts = [raw[a:b] for a, b in zip(begin[first].tolist(), (ends[first + count + length - 2] - 1).tolist())]
                held.append((heads, texts))
                size += sum(map(len, texts))
                if size >= FLUSH:
                    yield from flush()
        if size:
            yield from flush()

    return work


class Suffixes:
    """Word sequences with prefix polynomial hashes: compares the suffixes that start at given words by their first `length` words."""

    def __init__(self, word_hash: np.ndarray, length: int):
        self.word, self.length = word_hash, length
        self.prefix = textnp.prefix_hash(word_hash, textnp.WORD_BASE)
        self.inverse = textnp.powers(textnp.WORD_BASE, len(self.prefix))[1]

    def same(self, x: np.ndarray, y: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[x + size] - self.prefix[x]) * self.inverse[x] == (self.prefix[y + size] - self.prefix[y]) * self.inverse[y]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common extension, up to `length` words, by binary search."""
        out = np.where(self.same(x, y, self.length), self.length, 0)
        todo = np.flatnonzero(out == 0)
        lo, hi = np.zeros(len(todo), dtype=np.int64), np.full(len(todo), self.length, dtype=np.int64)
        xs, ys = x[todo], y[todo]
        while len(lo) and (hi - lo > 1).any():  # equal for lo words, different for hi
            mid = (lo + hi) >> 1
            eq = self.same(xs, ys, mid)
            lo, hi = np.where(eq, mid, lo), np.where(eq, hi, np.maximum(mid, lo + 1))
        out[todo] = lo
        return out

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x < y, x = y)."""
        ext = self.extension(x, y)
        equal = ext >= self.length
        ext = np.where(equal, 0, ext)
        return (self.word[x + ext] < self.word[y + ext]) & ~equal, equal

    def sort(self, items: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Mergesorts items[start:start+count] of every bucket, stably; all merges of a level run side by side."""
        items = items.copy()
        width = 1
        live = np.flatnonzero(count > 1)
        while len(live):
            s, c = start[live], count[live]
            first = np.repeat(s, c)
            here = ranges(s, c)
            p = here - first
            size = np.repeat(c, c)
            block = p // width
            left = (block & 1) == 0
            a = np.minimum(np.where(left, block + 1, block - 1) * width, size)
            b = np.minimum(a + width, size)
            me = items[here]
            lo, hi = a.copy(), b.copy()
            todo = np.flatnonzero(lo < hi)
            while len(todo):
                mid = (lo[todo] + hi[todo]) >> 1
                lt, eq = self.less(items[first[todo] + mid], me[todo])
                before = lt | (eq & ~left[todo])  # of equals, those of the left run come first
                lo[todo] = np.where(before, mid + 1, lo[todo])
                hi[todo] = np.where(before, hi[todo], mid)
                todo = todo[lo[todo] < hi[todo]]
            to = first + (block >> 1) * (2 * width) + (p - block * width) + (lo - a)
            items[to] = me
            width *= 2
            live = live[c > width]
        return items


def repeats(heads: np.ndarray, raw: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Repeated windows among runs of windows, as (row, first word, last word + 1, doc_id of the first occurrence).

    heads: HEAD numbers a run; raw: its words with single spaces, a line a run.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    order = np.lexsort((heads[:, 3], heads[:, 2], heads[:, 1]))  # by document and place
    fresh = np.ones(len(order), dtype=bool)  # a row that is there twice counts once
    if len(order) > 1:
        fresh[1:] = (heads[order][1:, [0, 2, 3]] != heads[order][:-1, [0, 2, 3]]).any(axis=1)
    order = order[fresh]
    offsets = np.concatenate([[0], ends + 1])
    words = textnp.WordSpans(data, offsets, "solid")
    head = heads[order]
    base = words.first[:-1][order]
    n = head[:, 4]
    seg = np.repeat(np.arange(len(order)), n)
    step = ranges(np.zeros(len(order), dtype=np.int64), n)
    item = base[seg] + step
    bits = int(length).bit_length()
    bucket = ((head[:, 0].view(np.uint64)[seg] >> np.uint64(bits)) << np.uint64(bits)) | (head[:, 5][seg] - step * head[:, 6][seg]).astype(np.uint64)
    o = np.argsort(bucket, kind="stable")
    start, count = runs(bucket[o])
    again = count > 1
    o = o[ranges(start[again], count[again])]
    count = count[again]
    start = np.cumsum(count) - count
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    if not len(o):
        return none
    suffixes = Suffixes(words.hash, length)
    # What is sorted are word numbers; `back` leads from them to the suffixes. A window of a run is no window of another.
    back = np.full(len(words) + 1, -1, dtype=np.int64)
    back[item[o]] = o
    ties = []
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + SORTED)))
        a, b = start[lo], start[hi - 1] + count[hi - 1]
        w = suffixes.sort(item[o[a:b]], start[lo:hi] - a, count[lo:hi])
        tie = np.zeros(len(w), dtype=bool)
        tie[1:] = suffixes.extension(w[1:], w[:-1]) >= length
        tie[start[lo:hi] - a] = False
        leader = np.maximum.accumulate(np.where(tie, 0, np.arange(len(w))))
        ties.append((back[w[tie]], back[w[leader[tie]]]))
        lo = hi
    x, y = (np.concatenate(z) for z in zip(*ties))
    # The words themselves, for stretches of windows whose first occurrence advances with them.
    o2 = np.lexsort((step[x], seg[x]))
    x, y = x[o2], y[o2]
    cut = np.ones(len(x), dtype=bool)
    cut[1:] = (seg[x][1:] != seg[x][:-1]) | (seg[y][1:] != seg[y][:-1]) | (step[x][1:] != step[x][:-1] + 1) | (step[y][1:] != step[y][:-1] + 1)
    s = np.flatnonzero(cut)
    e = np.append(s[1:], len(x)) - 1 if len(s) else s
    xa, ya = words.start[item[x[s]]].tolist(), words.start[item[y[s]]].tolist()
    xb, yb = words.end[item[x[e]] + length - 1].tolist(), words.end[item[y[e]] + length - 1].tolist()
    wrong = {int(bucket[x[j]]) for i, (a, b, c, d) in enumerate(zip(xa, xb, ya, yb)) if raw[a:b] != raw[c:d] for j in range(int(s[i]), int(e[i]) + 1)}
    if wrong:  # hashes collided: these suffixes are compared by their words alone, and what a collision hid is found again
        redo = np.isin(bucket, np.fromiter(wrong, dtype=np.uint64))
        use = ~redo[x]
        first: dict[tuple[int, bytes], int] = {}
        more = []
        for z in np.flatnonzero(redo).tolist():
            u = int(item[z])
            window = raw[words.start[u] : words.end[u + length - 1]]
            leader = first.setdefault((int(bucket[z]), window), z)
            if leader != z:
                more.append((z, leader))
        x = np.concatenate([x[use], np.array([m[0] for m in more], dtype=x.dtype)])
        y = np.concatenate([y[use], np.array([m[1] for m in more], dtype=y.dtype)])
    row_x, row_y = head[seg[x], 2], head[seg[y], 2]
    at_x, at_y = head[seg[x], 3] + step[x], head[seg[y], 3] + step[y]
    apart = (row_x != row_y) | (at_x >= at_y + length)
    row, at, source = row_x[apart], at_x[apart], head[seg[y], 1][apart]
    return merged(row, at, at + length, source)


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of a row as one, with the least source."""
    if not len(row):
        return row, start, end, source
    o = np.lexsort((start, row))
    row, start, end, source = row[o], start[o], end[o], source[o]
    # Ends made comparable across rows: each row has its own level.
    level = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]).astype(np.int64)])) * (int(end.max()) + 2)
    top = np.maximum.accumulate(end + level)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (start + level)[1:] > top[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], start[at], (top - level)[last], np.minimum.reduceat(source, at)


_SPANS = "row long, start_word long, end_word long, source long"


def _sort(length: int):
    def work(table: pa.Table) -> pa.Table:
        heads = np.frombuffer(b"".join(table.column("heads").to_pylist()), dtype=np.int64).reshape(-1, HEAD)
        found = repeats(heads, b"".join(table.column("words").to_pylist()), length)
        return pa.table(dict(zip(("row", "start_word", "end_word", "source"), found)))

    return work


def _merge(table: pa.Table) -> pa.Table:
    cols = [longs(table.column(c)) for c in ("row", "start_word", "end_word", "source")]
    return pa.table(dict(zip(("row", "start_word", "end_word", "source"), merged(*cols))))


def spans(docs: DataFrame, length: int = 50, gram: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, start_word, end_word, source of the spans to remove (stored)."""
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    split = 16 * parts(docs.sparkSession)  # a group is what one sort holds
    own = take(docs, key=key, text=text).withColumn("row", row_id(docs, "key", "text")).withColumn("key", F.col("key").cast("long"))
    anchors = own.select("row", "text").mapInArrow(tidy_batches(_anchors(length, gram)), "anchor long, row long, at int")
    twice = anchors.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1")
    wanted = stored(twice.groupBy("row").agg(F.collect_list("at").alias("at")), "anchors")
    sent = own.join(sized(wanted), "row").select("key", "row", "text", "at").mapInArrow(tidy_batches(_sent(length, gram, split)), "part int, heads binary, words binary")
    found = sent.groupBy("part").applyInArrow(tidy_group(_sort(length)), _SPANS)
    whole = found.withColumn("part", F.pmod(F.hash("row"), F.lit(split))).groupBy("part").applyInArrow(_merge, _SPANS)
    return stored(whole, "spans")


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans that repeat earlier ones: doc_id, start_word, end_word, n_words, source_doc_id.

    Words are numbered from 0; end_word is the first word behind the span;
    source_doc_id is the least document that holds some window of the span
    first. Null, empty and shorter texts have no windows. Null doc_ids come
    before all others and stay null; the doc_id -2**63 reads as null. Rows repeated with doc_id and text are one
    document. Other columns are ignored.
    """
    own = take(docs, key=key, text=text)
    names = own.select(row_id(own, "key", "text").alias("row"), F.col("key").cast("long").alias("doc_id")).dropDuplicates(["row"])
    found = spans(docs, length, gram, key, text)
    null = F.lit(-(1 << 63)).cast("long")
    return found.join(names, "row").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.when(F.col("source") != null, F.col("source")).alias("source_doc_id"))


def cut_text(text: str, starts: list[int], ends: list[int], kind: str = "solid") -> str:
    """text without the given spans of words and what separates them from the next word."""
    raw = text.encode()
    words = textnp.Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), kind, hashed=False)
    begin = np.append(words.start, len(raw))
    out, at = [], 0
    for s, e in sorted(zip(starts, ends)):
        out.append(raw[at : begin[s]])
        at = max(at, begin[e])
    out.append(raw[at:])
    return b"".join(out).decode()


def _rewrite(text: str, starts: str, ends: str, kind: str):
    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            s, e = batch.column(starts).to_pylist(), batch.column(ends).to_pylist()
            old = batch.column(at)
            new = [cut_text(old[i].as_py(), s[i], e[i], kind) for i in range(len(s))]
            cols = [pa.array(new, old.type) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return work


def remove_spans(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars", kind: str = "solid") -> DataFrame:
    """docs with the word spans of `found` (row, start_word, end_word) cut out; rows left without words go.

    The column `chars`, where there is one, is set to the new text's length. All other rows and columns stay as they are.
    """
    names = docs.columns
    tx = place(docs, text)
    whole = numbered(docs)
    whole = whole.withColumn("row", row_id(whole, f"c{place(docs, key)}", f"c{tx}"))
    lists = stored(found.groupBy("row").agg(F.collect_list("start_word").alias("starts"), F.collect_list("end_word").alias("ends")), "cuts")
    lists = sized(lists)
    hit = whole.join(lists, "row")
    new = hit.mapInArrow(_rewrite(f"c{tx}", "starts", "ends", kind), hit.schema).drop("row", "starts", "ends").where(F.col(f"c{tx}").rlike(r"\S"))
    if chars in names:
        at = place(docs, chars)
        new = new.withColumn(f"c{at}", F.length(f"c{tx}").cast(docs.schema[at].dataType))
    new = new.select(*[f"c{i}" for i in range(len(names))])
    return whole.join(lists, "row", "left_anti").drop("row").unionByName(new).toDF(*names)


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without repeated windows; see remove_spans() for what stays."""
    return remove_spans(docs, spans(docs, length, gram, key, text), key, text)
