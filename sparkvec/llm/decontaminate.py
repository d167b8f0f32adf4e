"""Benchmark decontamination with a generalised suffix automaton.

The test items are normalised to words (lower case, runs of letters and
digits) and entered into one suffix automaton whose transitions are words. A
document's words are streamed through it: at each word the automaton's state
and length give the longest stretch that ends there and occurs in some item. A
stretch leaks when it has at least `min_words` words, or as many words as the shortest
item that holds it *needs*: `min_cover` of them and `cover_words` at least, or all of them where
the item is shorter than that. At each word the longest leaking stretch that ends
there is known from the state and its suffix links; what lies within another one is left out.

Before streaming, n-grams that no item holds are found with vectorised hashing. They
break every stretch, so only stretches of known n-grams that are long
enough to leak pass through the automaton; the others can't contain one.

A benchmark of up to PART_WORDS words is one automaton, built in each task. A larger one is
dealt into parts of about that size by hashes of its items. The stretches of known n-grams then travel to every part, a part's
automaton is built in its own tasks, and what all parts found is brought together
by document; no process holds more than one part. The limits mean the same for any number of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvec.llm import textnp
from sparkvec.llm.common import longs, parts, row_id, stored, take, tidy_batches, tidy_group
from sparkvec.llm.suffix_dedup import remove_spans

#: Words of one automaton (some 450 bytes each).
PART_WORDS = 250_000
#: Bits of the filter for each word of the benchmark, and the least number of them.
FILTER_LOAD, FILTER_LEAST = 16, 1 << 22
_FOUND = "row long, start_word long, end_word long, item_words long, item_id long, has_id boolean"


class SuffixAutomaton:
    """All stretches of several word sequences; a state knows the shortest item that holds its stretches."""

    def __init__(self, items: list[tuple[int, list[int]]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.item: list[tuple[int, int]] = [(0, 0)]  # (words of the item, number of the item)
        for number, words in items:
            last, own = 0, (len(words), number)
            for w in words:
                last = self._extend(last, w, own)
        # A stretch of a state also ends where those of the states that link to it end.
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if up > 0 and self.item[state] < self.item[up]:
                self.item[up] = self.item[state]

    def _new(self, length: int, item: tuple[int, int]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.item.append(item)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._new(self.length[p] + 1, self.item[q])
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: int, own: tuple[int, int]) -> int:
        if (q := self.next[p].get(w)) is not None:  # an earlier item has this stretch
            if self.length[q] != self.length[p] + 1:
                q = self._split(p, q, w)
            self.item[q] = min(self.item[q], own)
            return q
        new = self._new(self.length[p] + 1, own)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def stretches(self, words: list[int]):
        """(end, length, state) of the longest stretch that ends at each word, where there is one."""
        state = size = 0
        for i, w in enumerate(words, 1):
            while state > 0 and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            follow = self.next[state].get(w)
            if follow is None:
                state = size = 0
                continue
            state, size = follow, size + 1
            yield i, size, state

    def limit(self, least) -> None:
        """least(words of an item): the words from which a stretch of it leaks."""
        self.least = [least(n) for n, _ in self.item]
        # The nearest suffix whose longest stretch leaks (0: none); links lead to shorter stretches.
        self.up = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            p = self.link[state]
            self.up[state] = p if p > 0 and self.length[p] >= self.least[p] else self.up[max(p, 0)]

    def leaking(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(first word, last word + 1, state) of the leaking stretches that lie in no other one."""
        out: list[tuple[int, int, int]] = []
        for end, size, state in self.stretches(words):
            if size < self.least[state]:
                state = self.up[state]
                size = self.length[state]
            if size:
                begin = end - size
                while out and out[-1][0] >= begin:
                    out.pop()
                if not out or out[-1][1] < end:
                    out.append((begin, end, state))
        return out


def item_words(texts: list[str | None]) -> list[list[int]]:
    """The word hashes of each text."""
    out: list[list[int]] = []
    for _, words in textnp.steps(pa.array(texts, pa.string())):
        h = words.hash.tolist()
        out += [h[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
    return out


def needs(size: int, min_words: int, min_cover: float, cover_words: int) -> int:
    """The words from which a stretch of an item of `size` words leaks."""
    return min(min_words, max(int(np.ceil(min_cover * size - 1e-9)), min(cover_words, size)))


class Known:
    """The n-grams of the benchmark, as a filter that may know too many."""

    def __init__(self, n: int, bits: np.ndarray, least: int):
        self.n, self.bits, self.least = n, bits, least
        self.shift = np.uint64(64 - int(len(bits) * 8).bit_length() + 1)

    @staticmethod
    def empty(n: int, words: int, least: int) -> Known:
        size = 1 << int(max(FILTER_LEAST, FILTER_LOAD * words) - 1).bit_length()
        return Known(n, np.zeros(size // 8, dtype=np.uint8), least)

    def add(self, words: textnp.Words) -> None:
        at = words.ngrams(self.n)[1] >> self.shift
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def stretches(self, words: textnp.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, last word + 1) of the longest stretches of known n-grams that have enough words."""
        at, h = words.ngrams(self.n)
        at_bit = h >> self.shift
        has = (self.bits[(at_bit >> np.uint64(3)).astype(np.int64)] >> (at_bit & np.uint64(7)).astype(np.uint8)) & 1
        hit = np.zeros(len(words) + 1, dtype=np.int8)
        hit[at] = has
        if self.n == 1:  # stretches of words end with their document
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit])) | np.isin(np.arange(len(words) + 1), words.first))
            start = edge[hit[edge] > 0]
            end = np.append(edge, len(words))[np.searchsorted(edge, start, side="right")]
        else:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
            start, end = edge[::2], edge[1::2] + self.n - 1
        use = end - start >= self.least
        return start[use], end[use]


def _candidates(known: Known):
    """(row, doc's first word of the stretch, its word hashes) of the stretches of known n-grams."""
    def work(batches):
        for batch in batches:
            rows = longs(batch.column("row"))
            for lo, words in textnp.steps(batch.column("text")):
                start, end = known.stretches(words)
                doc = words.doc[start]
                yield rows[lo + doc], start - words.first[doc], [words.hash[s:e] for s, e in zip(start.tolist(), end.tolist())]

    return work


def _automaton(items: list[tuple[int | None, np.ndarray]], limits: tuple) -> tuple[SuffixAutomaton, list]:
    """The automaton of (id, word hashes) and the ids; of items of one length the least id comes first, null ids last."""
    items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0))
    automaton = SuffixAutomaton([(i, w.tolist()) for i, (_, w) in enumerate(items)])
    automaton.limit(lambda n: needs(n, *limits))
    return automaton, [k for k, _ in items]


def _batch(out: list[tuple]) -> pa.Table:
    cols = list(zip(*out)) if out else [[]] * 6
    return pa.table([pa.array(c, pa.bool_() if i == 5 else pa.int64()) for i, c in enumerate(cols)], names=["row", "start_word", "end_word", "item_words", "item_id", "has_id"])


def _through(automaton: SuffixAutomaton, ids: list, rows, firsts, hashes) -> list[tuple]:
    out = []
    for row, first, words in zip(rows, firsts, hashes):
        for a, b, state in automaton.leaking(words.tolist()):
            size, number = automaton.item[state]
            out.append((int(row), int(first) + a, int(first) + b, size, ids[number], ids[number] is not None))
    return out


def _find(known: Known, items: list, limits: tuple):
    def work(batches):
        automaton, ids = _automaton(items, limits)
        for rows, firsts, hashes in _candidates(known)(batches):
            yield from _batch(_through(automaton, ids, rows, firsts, hashes)).to_batches()

    return work


def _send(known: Known):
    def work(batches):
        for rows, firsts, hashes in _candidates(known)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(firsts, pa.int64()), pa.array([h.tobytes() for h in hashes], pa.binary())], names=["row", "first", "words"])

    return work


def _part(limits: tuple):
    def work(stretches: pa.Table, items: pa.Table) -> pa.Table:
        if not stretches.num_rows or not items.num_rows:
            return _batch([])
        hashes = lambda column: [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]
        automaton, ids = _automaton(list(zip(items.column("key").to_pylist(), hashes(items.column("words")))), limits)
        return _batch(_through(automaton, ids, stretches.column("row").to_pylist(), stretches.column("first").to_pylist(), hashes(stretches.column("words"))))

    return work


def _hashed(batches):
    for batch in batches:
        words = [np.array(w, dtype=np.uint64).tobytes() for w in item_words(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(words, pa.binary()), pa.array([len(w) // 8 for w in words], pa.int64())], names=["key", "words", "size"])


def _filter(n: int, total: int, least: int):
    def work(batches):
        known = Known.empty(n, total, least)
        for batch in batches:
            for _, w in textnp.steps(batch.column("text")):
                known.add(w)
        yield pa.RecordBatch.from_arrays([pa.array([known.bits.tobytes()], pa.binary())], names=["bits"])

    return work


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, min_cover: float = 0.6, cover_words: int = 8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """row, start_word, end_word, item_id of the stretches to remove, each once."""
    if min_words < 1 or cover_words < 1 or not 0 < min_cover:
        raise ValueError("the limits must be positive")
    limits = (min_words, min_cover, cover_words)
    plain = take(benchmark, key=item_key, text=item_text).withColumn("key", F.col("key").cast("long"))
    items = stored(plain.mapInArrow(_hashed, "key long, words binary, size long").where("size > 0"), "items")
    sizes = [r[0] for r in items.select("size").distinct().collect()]
    total = items.agg(F.sum("size")).first()[0] or 0
    own = take(docs, key=key, text=text).select(row_id(docs, "key", "text").alias("row"), "text")
    if not sizes:
        return docs.sparkSession.createDataFrame([], "row long, start_word long, end_word long, item_id long")
    # Needs don't fall with an item's length, so the shortest item needs least.
    least = needs(min(sizes), *limits)
    n = min(2, least)
    known = Known.empty(n, total, least)
    filters = plain.coalesce(max(1, min(parts(docs.sparkSession), total // part_words))).mapInArrow(_filter(n, total, least), "bits binary")
    for r in filters.toLocalIterator():  # one at a time
        known.bits |= np.frombuffer(r.bits, dtype=np.uint8)
    many = -(-total // part_words)
    if many == 1:
        listed = [(r.key, np.frombuffer(r.words, dtype=np.uint64)) for r in items.collect()]
        found = own.mapInArrow(tidy_batches(_find(known, listed, limits)), _FOUND)
    else:
        salts = parts(docs.sparkSession)
        part = F.pmod(F.xxhash64("words"), F.lit(many)).cast("int")
        sent = own.mapInArrow(tidy_batches(_send(known)), "row long, first long, words binary")
        sent = sent.withColumn("salt", F.pmod(F.xxhash64("row", "first"), F.lit(salts)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        dealt = items.withColumn("part", part).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = sent.groupBy("part", "salt").cogroup(dealt.select("key", "words", "part", "salt").groupBy("part", "salt")).applyInArrow(_part(limits), _FOUND)
    # Within a document: what lies in another stretch goes; of equal stretches the one of the shortest item stays.
    before = Window.partitionBy("row").orderBy("start_word", F.desc("end_word"), "item_words", F.desc("has_id"), "item_id").rowsBetween(Window.unboundedPreceding, -1)
    far = found.withColumn("far", F.max("end_word").over(before)).where("far IS NULL OR end_word > far")
    return far.select("row", "start_word", "end_word", "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, min_cover: float = 0.6, cover_words: int = 8, key: str = "doc_id", text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, start_word, end_word, n_words, item_id of the stretches of benchmark items in documents.

    Words are runs of letters and digits, numbered from 0; item_id is that of
    the shortest item (then the least id) that holds the stretch. Stretches of a document may
    overlap, but none lies within another. An item of fewer than cover_words words leaks where all of it is there: an item
    of one word makes a leak of each such word. Coverage is that of one unbroken stretch. The benchmark may be of any
    size; one item of very many words is held whole by one task. Null and empty texts and items have no words. Rows repeated with
    doc_id and text are one document; null doc_ids stay null. Other columns are
    ignored. An item without an id counts, with a null item_id.
    """
    own = take(docs, key=key, text=text)
    rows = own.withColumn("row", row_id(own, "key", "text"))
    found = leaks(rows.select("key", "text"), benchmark, min_words, min_cover, cover_words, "key", "text", part_words=part_words)
    names = rows.select("row", F.col("key").cast("long").alias("doc_id")).dropDuplicates(["row"])
    return found.join(names, "row").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, min_cover: float = 0.6, cover_words: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without these stretches; rows left without any text go, all else stays as it is."""
    found = stored(leaks(docs, benchmark, min_words, min_cover, cover_words, key, text).select("row", "start_word", "end_word").distinct(), "leaks")
    return remove_spans(docs, found, key, text, kind="norm")
