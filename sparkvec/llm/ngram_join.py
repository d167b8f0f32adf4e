"""N-gram Jaccard join by T-occurrence search (after DivideSkip).

Every document is a query and a candidate. A document is the set of its word
n-grams (lower case; words are runs of letters and digits). Two documents match
when the Jaccard coefficient of their sets is at least `threshold`; that is so
exactly when they share at least T = threshold / (1 + threshold) * (|x| + |y|)
n-grams, so the join looks for documents which occur T times on the query's
inverted lists. Nothing is capped, and but for the hash collisions below nothing is approximate:

1. One pass cuts each document into its n-gram hashes and sends them, packed
   in binary rows, to as many hash ranges as there are shuffle partitions.
   Documents with equal sets share one signature and travel as one class.
2. Each range sorts its postings into inverted lists. Lists of one class drop
   out; equal lists become one list with a weight.
3. A class stays only while the weights of its lists reach the overlap that
   any match needs (threshold * |x|); that is known from sums alone, before any
   list is sent on. The lists of those that stay are ordered by length; the
   longest, as many as cannot reach that overlap by themselves, are its *long*
   lists. The first list that two matching classes share in the common order
   is short for both, and what either has from that list on reaches the overlap
   that sets of their sizes need. So the classes on a list, ordered by size,
   fall into stretches that no match leaves; classes that no chain of such
   stretches joins never match, and chains are searched apart.
4. A chain of many classes is cut into blocks, and each two blocks are a task's
   work: what a task holds doesn't grow with the chain. In a task, candidates
   are looked up on the short lists, by size and by what is left of both; each
   candidate is then counted in all lists, and those that reach T are kept
   with their exact overlap.

Matching is up to hash collisions: 48-bit n-gram hashes cut to 32 bits within
a range, so a pair of sets with a and b n-grams gains an n-gram by chance with
probability below a * b / 2**32 / ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvec.llm import textnp
from sparkvec.llm.common import STORED, blobs, cut, drop_stored, list_array, longs, numbered, parts, place, ranges, row_id, runs, sized, stored, take, tidy_batches, tidy_group

#: Postings that a map task gathers before it writes them out by range.
FLUSH = 1 << 21
#: Postings of a block of a chain, and classes from which a chain is cut into up to SPREAD blocks though it holds fewer: tasks are the parallelism.
BLOCK_POSTINGS, BLOCK_CLASSES, SPREAD = 1_500_000, 700, 8
#: Pairs of classes that are marked at a time, and postings or candidates that are opened.
MARKED, OPENED = 1 << 23, 1 << 20
#: Documents of a class that all_pairs() holds in one row; two such rows are one row's work.
BLOCK = 1000

#: What a text with at least one word has (textnp.WORD_BYTE).
WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"
_EXCHANGE = "part int, signatures binary, counts binary, grams binary, ids binary, rows binary, sizes binary"
_PACKED = "sig long, size long, members long, n long, lists binary, weights binary"
_LISTS = "kind int, list long, weight long, members array<long>, weights binary, doc_id long, row long, size long"


def gram_sets(words: textnp.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 48-bit hash) of the distinct n-grams, sorted; a document of 1..n-1 words has one gram of all its words."""
    at, h = words.ngrams(n)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n - 1):
                has = count[short] > j
                extra[has] = extra[has] * np.uint64(textnp.WORD_BASE) + words.hash[words.first[short[has]] + j]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, textnp.mix64(extra)])
    key = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def _exchange(n: int, split: int):
    def work(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size
            sig = np.concatenate([x[0] for x in held])
            ids, rows, count = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            doc = np.repeat(np.arange(len(sig)), count)
            gram = np.concatenate([x[4] for x in held])
            held, size = [], 0
            part = (gram * np.uint64(split)) >> np.uint64(48)
            order = np.argsort(part.astype(np.uint16 if split < 65536 else np.uint64), kind="stable")
            part, doc, gram = part[order].astype(np.int64), doc[order], gram[order].astype(np.uint32)
            start, length = runs(part)
            at, per = runs(part, doc)
            of = np.searchsorted(start, at, side="right") - 1
            # A count is one byte; a document with more n-grams in a range is there again.
            again = -(-per // 255)
            last = np.cumsum(again) - 1
            at, of, short = np.repeat(at, again), np.repeat(of, again), per - 255 * (again - 1)
            per = np.full(len(at), 255, dtype=np.uint8)
            per[last] = short
            docs = np.bincount(of, minlength=len(start))
            empty = [b""] * len(start)
            cols = [part[start], blobs(sig[doc[at]], docs), blobs(per, docs), blobs(gram, length), empty, empty, empty]
            # The documents themselves go to the partition of their signature.
            home = ((sig >> np.uint64(16)) * np.uint64(split)) >> np.uint64(48)
            order = np.argsort(home, kind="stable")
            s, c = runs(home[order])
            none = [b""] * len(s)
            cols2 = [home[order][s].astype(np.int64), blobs(sig[order], c), none, none, blobs(ids[order], c), blobs(rows[order], c), blobs(count[order].astype(np.int64), c)]
            for use in (cols, cols2):
                yield pa.RecordBatch.from_arrays([pa.array(use[0], pa.int32()), *[pa.array(x, pa.binary()) for x in use[1:]]], names=["part", "signatures", "counts", "grams", "ids", "rows", "sizes"])

        for batch in batches:
            ids, rows = longs(batch.column("key")), longs(batch.column("row"))
            for lo, words in textnp.steps(batch.column("text")):
                doc, gram = gram_sets(words, n)
                docs = len(words.offsets) - 1
                count = np.bincount(doc, minlength=docs)
                mixed = textnp.mix64(gram)
                ends = np.concatenate([[0], np.cumsum(count)])
                with np.errstate(over="ignore"):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
                    sig = textnp.mix64(total[ends[1:]] - total[ends[:-1]] + count.astype(np.uint64))
                has = count > 0
                held.append((sig[has], ids[lo : lo + docs][has], rows[lo : lo + docs][has], count[has], gram))
                size += len(gram)
                if size >= FLUSH:
                    yield from flush()
        if size:
            yield from flush()

    return work


def _to_lists(split: int):
    """One range: its postings to weighted inverted lists (kind 1) and each class's weight in them (kind 2); its documents (kind 0)."""
    names_ = ["kind", "list", "weight", "members", "weights", "doc_id", "row", "size"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names_, kinds)))

    def rows(m: int, **given) -> pa.Table:
        return pa.Table.from_arrays([given[n] if n in given else pa.nulls(m, k) for n, k in zip(names_, kinds)], schema=schema)

    def work(table: pa.Table) -> pa.Table:
        def cat(name, kind):
            return np.frombuffer(b"".join(part.column(name).to_pylist()), dtype=kind)

        used = pc.greater(pc.binary_length(table.column("counts")), 0)
        part = table.filter(used)
        sig, per, gram = cat("signatures", np.uint64), cat("counts", np.uint8), cat("grams", np.uint32)
        out = [schema.empty_table()]
        if len(gram):
            names, number = np.unique(sig, return_inverse=True)
            key = gram.astype(np.uint64)
            key <<= np.uint64(32)
            key |= np.repeat(number.astype(np.uint32), per)
            del gram, number, sig, part
            key.sort()
            key = key[np.append(True, key[1:] != key[:-1])]
            d = key.astype(np.uint32).astype(np.int32)
            start, length = runs((key >> np.uint64(32)).astype(np.uint32))
            del key
            keep = length > 1
            start, length = start[keep], length[keep]
            if len(start):
                weight_of = np.bincount(d[ranges(start, length)], minlength=len(names))
                with np.errstate(over="ignore"):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(textnp.mix64(names)[d], dtype=np.uint64)])
                    ident = textnp.mix64(total[start + length] - total[start] + length.astype(np.uint64))
                _, first, weight = np.unique(ident, return_index=True, return_counts=True)
                start, length, ident = start[first], length[first], ident[first]
                m = len(first)
                out.append(rows(m, kind=pa.array(np.ones(m, np.int32)), list=pa.array(ident.view(np.int64)), weight=pa.array(weight.astype(np.int64)), members=list_array(names[d[ranges(start, length)]].view(np.int64), length, pa.int64())))
                has = np.flatnonzero(weight_of)
                home = (((names[has] >> np.uint64(16)) * np.uint64(split)) >> np.uint64(48)).astype(np.int64)
                order = has[np.argsort(home, kind="stable")]
                s, c = runs(np.sort(home))
                m = len(s)
                out.append(rows(m, kind=pa.array(np.full(m, 2, np.int32)), list=pa.array(np.sort(home)[s]), members=list_array(names[order].view(np.int64), c, pa.int64()), weights=pa.array(blobs(weight_of[order].astype(np.uint32), c), pa.binary())))
            del d
        part = table.filter(pc.invert(used))
        sig = cat("signatures", np.uint64).view(np.int64)
        m = len(sig)
        if m:
            out.append(rows(m, kind=pa.array(np.zeros(m, np.int32)), list=pa.array(sig), doc_id=pa.array(cat("ids", np.int64)), row=pa.array(cat("rows", np.int64)), size=pa.array(cat("sizes", np.int64))))
        return pa.concat_tables(out)

    return work


def _totals(table: pa.Table) -> pa.Table:
    """The weights of the classes of one home, added up over all ranges."""
    sig = cut(table.column("members")).flatten().to_numpy(zero_copy_only=False)
    weight = np.frombuffer(b"".join(table.column("weights").to_pylist()), dtype=np.uint32)
    names, number = np.unique(sig, return_inverse=True)
    return pa.table({"sig": names, "total": np.bincount(number, weights=weight, minlength=len(names)).astype(np.int64)})


def needed(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The overlap from which the Jaccard coefficient of sets of a and b elements reaches the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def rests(count: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each posting, the weight of it and of all later ones of its class."""
    total = np.concatenate([[0], np.cumsum(weight)])
    return total[np.repeat(np.cumsum(count), count)] - total[:-1]


def largest(rest: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """The size of the largest set that can match one of `size` elements if the first list they share leaves it `rest`."""
    return np.floor(np.minimum((rest + 1e-6) * (1 + threshold) / threshold - size, size / threshold + 1e-6)).astype(np.int64)


def _pack(threshold: float):
    """Postings to classes: lists and weights in the common order, of the classes whose weights reach the overlap that any match needs."""

    def work(table: pa.Table) -> pa.Table:
        sig, lst, weight, length, size, members = (table.column(c).to_numpy() for c in ("sig", "list", "weight", "length", "size", "members"))
        order = np.lexsort((lst, length, sig))
        sig, lst, weight, size, members = sig[order], lst[order], weight[order], size[order], members[order]
        start, count = runs(sig)
        if len(start):
            keep = np.add.reduceat(weight, start) >= np.ceil(threshold * size[start] - 1e-9)
            start, count = start[keep], count[keep]
        at = ranges(start, count)
        return pa.table({"sig": sig[start], "size": size[start], "members": members[start], "n": count.astype(np.int64), "lists": pa.array(blobs(lst[at], count), pa.binary()), "weights": pa.array(blobs(weight[at].astype(np.uint32), count), pa.binary())})

    return work


def _cat(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _short(threshold: float):
    """The short lists of classes, with the largest size that a match may have whose first shared list is this one."""

    def work(batches):
        for batch in batches:
            sig, size, count = (longs(batch.column(c)) for c in ("sig", "size", "n"))
            lst, weight = _cat(batch.column("lists"), np.int64), _cat(batch.column("weights"), np.uint32).astype(np.int64)
            of = np.repeat(np.arange(len(sig)), count)
            rest = rests(count, weight)
            use = np.flatnonzero(rest >= np.ceil(threshold * size[of] - 1e-9))
            for lo in range(0, len(use), OPENED):
                at = use[lo : lo + OPENED]
                own = of[at]
                yield pa.RecordBatch.from_pydict({"list": lst[at], "sig": sig[own], "size": size[own], "most": largest(rest[at], size[own], threshold)})

    return work


def _stretches(table: pa.Table) -> pa.Table:
    """A spanning forest of the classes that a stretch of some list joins."""
    lst, sig, size, most = (table.column(c).to_numpy() for c in ("list", "sig", "size", "most"))
    order = np.lexsort((sig, size, lst))
    lst, sig, size, most = lst[order], sig[order], size[order], most[order]
    _, number = np.unique(lst, return_inverse=True)
    # The largest size that any class so far on the list may meet.
    room = np.int64(max(most.max(initial=0), size.max(initial=0)) + 1)
    number = number * room
    reach = np.maximum.accumulate(np.maximum(most, 0) + number)
    joined = 1 + np.flatnonzero((number[1:] == number[:-1]) & (reach[:-1] >= number[1:] + size[1:]))
    nodes, root = components(sig[joined - 1], sig[joined])
    differ = nodes != root
    return pa.table({"a": nodes[differ], "b": root[differ]})


def search(size, count, lst, weight, right, threshold):
    """Yields (x, others, overlaps) for the matching pairs of classes: x is one class by number, others are distinct.

    The postings (lst, weight) stand class by class, in the common order.
    right: None for all pairs, else whether a class is of the right side, which meets the left side only.
    """
    m = len(size)
    _, lst = np.unique(lst, return_inverse=True)
    lst = lst.astype(np.int32)
    weight = weight.astype(np.int64)
    start = np.cumsum(count) - count
    of = np.repeat(np.arange(m, dtype=np.int32), count)
    rest = rests(count, weight)
    short = np.flatnonzero(rest >= np.ceil(threshold * size - 1e-9)[of])
    short = short[np.lexsort((size[of[short]], lst[short]))]
    cls = of[short]
    own, most, at = size[cls], largest(rest[short], size[cls], threshold), lst[short].astype(np.int64) << 32
    del of, rest, short
    key, end = at + own, at + np.maximum(most, 0)
    if right is None:
        plans = [(np.arange(len(cls)), np.arange(1, len(cls) + 1), np.searchsorted(key, end, side="right"), np.arange(len(cls)))]
    else:  # the smaller asks; of two of one size the left one
        l, r = np.flatnonzero(~right[cls]), np.flatnonzero(right[cls])
        plans = [(l, np.searchsorted(key[r], key[l], side="left"), np.searchsorted(key[r], end[l], side="right"), r), (r, np.searchsorted(key[l], key[r], side="right"), np.searchsorted(key[l], end[r], side="right"), l)]
    del key, end, at
    mark = np.zeros(int(lst.max(initial=-1)) + 1, dtype=np.int64)
    for who, lo, hi, place_ in plans:
        use = np.flatnonzero(hi > lo)
        use = use[np.argsort(cls[who[use]], kind="stable")]
        who, lo, n = who[use], lo[use], (hi - lo)[use]
        asks = cls[who]
        rows = max(1, MARKED // max(1, m))
        for first in range(0, m, rows):
            i, stop = np.searchsorted(asks, [first, first + rows])
            if i == stop:
                continue
            met = np.zeros(rows * m, dtype=bool)
            cost = np.cumsum(n[i:stop])
            j = 0
            while j < len(cost):
                k = max(j + 1, int(np.searchsorted(cost, (cost[j - 1] if j else 0) + OPENED, side="right")))
                a, c = who[i + j : i + k], n[i + j : i + k]
                b = place_[ranges(lo[i + j : i + k], c)]
                fits = most[b] >= np.repeat(own[a], c)
                met[(np.repeat((cls[a].astype(np.int64) - first) * m, c) + cls[b])[fits]] = True
                j = k
            found = np.flatnonzero(met)
            del met
            x, y = found // m + first, found % m
            for s, c in zip(*runs(x)):
                one, ys = int(x[s]), y[s : s + c]
                mine = lst[start[one] : start[one] + count[one]]
                mark[mine] = weight[start[one] : start[one] + count[one]]
                sums = []
                cost = np.cumsum(count[ys])
                j = 0
                while j < len(ys):
                    k = max(j + 1, int(np.searchsorted(cost, (cost[j - 1] if j else 0) + OPENED, side="right")))
                    c_ = count[ys[j:k]]
                    sums.append(np.add.reduceat(mark[lst[ranges(start[ys[j:k]], c_)]], np.cumsum(c_) - c_))
                    j = k
                mark[mine] = 0
                overlap = np.concatenate(sums)
                good = overlap + 0.5 >= needed(size[one], size[ys], threshold)
                if good.any():
                    yield one, ys[good], overlap[good]


def _opened(table: pa.Table) -> tuple:
    """The arguments of search(): a group holds whole chains (block -1), a block, or two."""
    size, count, block = (table.column(c).to_numpy() for c in ("size", "n", "block"))
    right = block != block.min() if len(block) and block.min() != block.max() else None
    return size, count, _cat(table.column("lists"), np.int64), _cat(table.column("weights"), np.uint32), right


def _search(threshold: float):
    """All matching pairs of a group."""

    def work(table: pa.Table) -> pa.Table:
        sig, size = (table.column(c).to_numpy() for c in ("sig", "size"))
        if len(sig) and (table.column("lo").to_numpy() != table.column("hi").to_numpy()).any() and pc.count_distinct(table.column("block")).as_py() < 2:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "overlap", "size_a", "size_b")})  # the other block is empty
        none = [np.zeros(0, dtype=np.int64)]
        a, b, met = [], [], []
        for x, ys, overlap in search(*_opened(table), threshold):
            a.append(np.full(len(ys), x))
            b.append(ys)
            met.append(overlap)
        a, b = np.concatenate(a or none), np.concatenate(b or none)
        return pa.table({"a": sig[a], "b": sig[b], "overlap": np.concatenate(met or none), "size_a": size[a], "size_b": size[b]})

    return work


def _search_stars(threshold: float):
    """For each class of a group that matches another: the least class that matches join it to here, and the number of documents that it matches."""

    def work(table: pa.Table) -> pa.Table:
        sig, members = (table.column(c).to_numpy() for c in ("sig", "members"))
        links = np.zeros(len(sig), dtype=np.int64)
        root = np.arange(len(sig))
        a, b, held = [], [], 0

        def join():
            nonlocal root
            nodes, least = components(np.concatenate([root[np.concatenate(a)], root]), np.concatenate([root[np.concatenate(b)], np.arange(len(sig))]))
            root = least  # all classes are nodes: their numbers are their places

        if not (len(sig) and (table.column("lo").to_numpy() != table.column("hi").to_numpy()).any() and pc.count_distinct(table.column("block")).as_py() < 2):
            for x, ys, _ in search(*_opened(table), threshold):
                links[x] += members[ys].sum()
                links[ys] += members[x]
                a.append(np.full(len(ys), x))
                b.append(ys)
                held += len(ys)
                if held >= OPENED:
                    join()
                    a, b, held = [], [], 0
            if held:
                join()
        has = links > 0
        return pa.table({"sig": sig[has], "root": sig[root[has]], "links": links[has]})

    return work


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the graph with the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            return nodes, nodes[parent]
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def _forest(table: pa.Table) -> pa.Table:
    nodes, root = components(longs(table.column("a")), longs(table.column("b")))
    differ = nodes != root
    return pa.table({"a": nodes[differ], "b": root[differ]})


#: Edges of a spanning forest that one task may finish (about 100 bytes each while it does).
ONE_TASK = 2_000_000


def chains(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(sig, chain): the least node of the component, for each node of the edges a-b.

    Partitions replace their edges by stars of their own components. What is left is finished by one
    task as soon as it fits into it; otherwise rounds, in which each node's partition sees all its edges,
    go on until every edge leads to the root of its star.
    """
    split = parts(edges.sparkSession)
    edges = edges.where("a <> b")

    def stars_of(e: DataFrame, key) -> DataFrame:
        return e.withColumn("part", key).groupBy("part").applyInArrow(_forest, "a long, b long")

    by_a = F.pmod(F.hash("a"), F.lit(split))
    edges = stored(stars_of(edges, by_a), "forest")
    while edges.count() > one_task:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = stored(stars_of(both, by_a).distinct(), "forest")
        several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not several and not edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi").limit(1).count():
            break
    else:
        edges = stars_of(edges, F.lit(0))
    stars = edges.select(F.col("a").alias("sig"), F.col("b").alias("chain"))
    return stars.unionByName(stars.select(F.col("chain").alias("sig"), "chain").distinct())


def shared_out(packed: DataFrame, label: DataFrame, postings: int = BLOCK_POSTINGS, classes: int = BLOCK_CLASSES) -> DataFrame:
    """packed with the group that searches each class: (part, lo, hi) with the class's own block.

    A chain of up to `classes` classes and `postings` postings is searched as a whole, with others (block -1).
    A larger one has a group for each two of its blocks; a class goes to the groups of its block.
    """
    split = parts(packed.sparkSession)
    sizes = packed.select("sig", "n").join(sized(label), "sig").groupBy("chain").agg(F.sum("n").alias("postings"), F.count("*").alias("classes"))
    blocks = F.greatest(F.ceil(F.col("postings") / postings), F.least(F.lit(SPREAD), F.ceil(F.col("classes") / classes))).cast("int")
    large = stored(sizes.select("chain", blocks.alias("blocks")).where("blocks > 1"), "large")
    work = packed.join(sized(label), "sig").join(sized(large), "chain", "left")
    whole = work.where("blocks is null").select(F.pmod(F.hash("chain"), F.lit(split)).cast("long").alias("part"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(-1).alias("block"), *packed.columns)
    cut_ = work.where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut_ = cut_.select(F.col("chain").alias("part"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *packed.columns)
    return whole.unionByName(cut_).repartition(split, "part", "lo", "hi")


def grouped(docs: DataFrame, n: int, threshold: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(classes, work) of the join over all rows of docs: classes as in matches(), work as in shared_out()."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n positive")
    spark = docs.sparkSession
    own = take(docs, key=key, text=text).withColumn("row", row_id(docs, "key", "text")).withColumn("key", F.col("key").cast("long"))
    split = min(60_000, parts(spark))
    sent = own.mapInArrow(tidy_batches(_exchange(n, split)), _EXCHANGE)
    lists = stored(sent.groupBy("part").applyInArrow(tidy_group(_to_lists(split)), _LISTS), "lists")
    done = [STORED[-1]]
    classes = stored(lists.where("kind = 0").select(F.col("list").alias("sig"), "doc_id", "row", "size"), "classes")
    sizes = classes.groupBy("sig").agg(F.max("size").alias("size"), F.count("*").alias("members"))
    least = F.ceil(F.lit(threshold) * F.col("size") - 1e-9)
    totals = lists.where("kind = 2").select("list", "members", "weights").groupBy("list").applyInArrow(_totals, "sig long, total long")
    # Most classes share too little with all others together to match any of them.
    alive = stored(totals.join(sizes, "sig").where(F.col("total") >= least).select("sig", "size", "members"), "alive")
    done.append(STORED[-1])
    posts = lists.where("kind = 1").select("list", "weight", F.explode("members").alias("sig")).join(sized(alive.select("sig")), "sig", "left_semi")
    posts = posts.repartition("list").groupBy("list", "sig").agg(F.sum("weight").alias("weight"))
    posts = posts.withColumn("length", F.count("*").over(Window.partitionBy("list"))).where("length > 1").join(sized(alive), "sig")
    home = posts.withColumn("home", F.pmod(F.hash("sig"), F.lit(split))).groupBy("home")
    packed = stored(home.applyInArrow(tidy_group(_pack(threshold)), _PACKED), "packed")
    drop_stored(spark, done)
    short = packed.select("sig", "size", "n", "lists", "weights").mapInArrow(_short(threshold), "list long, sig long, size long, most long")
    joined = short.withColumn("part", F.pmod(F.hash("list"), F.lit(split))).groupBy("part").applyInArrow(tidy_group(_stretches), "a long, b long")
    return classes, shared_out(packed, stored(chains(joined), "chains"))


def matches(docs: DataFrame, n: int = 3, threshold: float = 0.5, key: str = "doc_id", text: str = "text"):
    """(classes, pairs) of the join over all rows of docs.

    classes: sig, doc_id, row, size for each document with at least one word.
    pairs: a, b, overlap, size_a, size_b for each two different classes that match.
    """
    classes, work = grouped(docs, n, threshold, key, text)
    return classes, work.groupBy("part", "lo", "hi").applyInArrow(tidy_group(_search(threshold)), "a long, b long, overlap long, size_a long, size_b long")


def teams(docs: DataFrame, n: int = 3, threshold: float = 0.5, key: str = "doc_id", text: str = "text"):
    """(classes, label, links): classes as in matches(), (sig, team) and (sig, links) of each class that matches another.

    team: a class of those that chains of matches join; links: the number of
    documents of other classes that match. Pairs never leave the tasks that find them.
    """
    classes, work = grouped(docs, n, threshold, key, text)
    stars = stored(work.groupBy("part", "lo", "hi").applyInArrow(tidy_group(_search_stars(threshold)), "sig long, root long, links long"), "stars")
    label = chains(stars.select(F.col("sig").alias("a"), F.col("root").alias("b"))).withColumnRenamed("chain", "team")
    return classes, label, stars.groupBy("sig").agg(F.sum("links").alias("links"))


def jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Matching documents: doc_id, match_id, overlap, jaccard.

    Documents of equal n-gram sets are one class, named by its least doc_id
    (null ids last). There is a row for each further member of a class (class,
    member; jaccard 1) and a row for each two classes that match, lower id
    first: with the members of both classes that is every matching pair.

    Null, empty and word-less texts have no n-grams and match nothing. Rows
    repeated with the same doc_id and text are members like any other, so a
    doc_id may match itself. Null ids stay null; the doc_id -2**63 reads as null. Other columns are ignored.
    """
    classes, pairs = matches(docs, n, threshold, key, text)
    ordered = Window.partitionBy("sig").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    ranked = classes.withColumn("doc_id", F.when(F.col("doc_id") == F.lit(-(1 << 63)), F.lit(None)).otherwise(F.col("doc_id"))).withColumn("n", F.row_number().over(ordered)).withColumn("head", F.first("doc_id").over(ordered))
    ranked = stored(ranked, "classes")
    same = ranked.where("n > 1").select(F.col("head").alias("doc_id"), F.col("doc_id").alias("match_id"), F.col("size").alias("overlap"), F.lit(1.0).alias("jaccard"))
    heads = ranked.where("n = 1").select("sig", "doc_id")
    a, b = heads.toDF("a", "id_a"), heads.toDF("b", "id_b")
    both = pairs.join(a, "a").join(b, "b")
    swap = F.coalesce(F.col("id_a") > F.col("id_b"), F.col("id_a").isNull())
    near = both.select(F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("doc_id"), F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("match_id"), "overlap", (F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))).alias("jaccard"))
    return same.unionByName(near)


def linked(docs: DataFrame, n: int = 3, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, class_id, links.

    class_id is the least doc_id (nulls last) of the documents that chains of
    matches join to this one, links the number of other rows that match it
    itself: copies and near copies alike, all of them. Pairs are counted where
    they are found and never written, so rows grow as docs do.

    Null, empty and word-less texts match nothing: a class of their own, 0 links.
    Repeated rows and null ids are as in jaccard_join(); the doc_id -2**63 reads as null.
    """
    classes, label, links = teams(docs, n, threshold, key, text)
    classes = classes.select("sig", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")).alias("doc_id"))
    label = stored(label, "teams")
    heads = classes.join(sized(label), "sig").groupBy("team").agg(F.min("doc_id").alias("class_id"))
    found = stored(label.join(links, "sig").join(sized(heads), "team").select("sig", "class_id", "links"), "found")
    same = Window.partitionBy("sig")
    own = classes.withColumn("head", F.min("doc_id").over(same)).withColumn("copies", F.count("*").over(same) - 1)
    # Found or not is told by links: a class of null ids alone has a null for its name.
    met = own.join(sized(found), "sig", "left").select("doc_id", F.when(F.col("links").isNull(), F.col("head")).otherwise(F.col("class_id")).alias("class_id"), (F.col("copies") + F.coalesce("links", F.lit(0))).alias("links"))
    none = take(docs, key=key, text=text).where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select(F.col("key").cast("long").alias("doc_id"))
    none = none.select(F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")).alias("doc_id"))
    return met.unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def all_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.5, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Every pair of matching documents: doc_id, match_id, overlap, jaccard.

    One row for each two rows of docs that match, lower id first (null ids
    last): each two members of a class, and each member of a class with each
    member of every class that matches it. The number of pairs grows with the
    square of a class; only blocks of its ids are exchanged, pairs are not.

    Texts without words, repeated rows and null ids are as in jaccard_join(); the doc_id -2**63 reads as null.
    """
    classes, pairs = matches(docs, n, threshold, key, text)
    ordered = Window.partitionBy("sig").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    ranked = classes.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id"))).withColumn("n", F.row_number().over(ordered) - 1)
    members = ranked.withColumn("block", F.floor(F.col("n") / block)).groupBy("sig", "block").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "doc_id"))).alias("ids"))
    members = stored(members, "members")
    a, b = members.toDF("a", "block_a", "size_a", "ids_a"), members.toDF("b", "block_b", "size_b", "ids_b")
    # A class meets itself where two of its documents are in one block, or in two.
    several = members.where("block > 0 or size(ids) > 1").select(F.col("sig").alias("a")).distinct()
    same = a.join(several, "a", "left_semi").join(b, (F.col("a") == F.col("b")) & (F.col("block_a") <= F.col("block_b"))).withColumn("overlap", F.col("size_a"))
    near = pairs.select("a", "b", "overlap").join(a, "a").join(b, "b")
    names = ["a", "b", "block_a", "block_b", "overlap", "size_a", "size_b", "ids_a", "ids_b"]
    met = same.select(names).unionByName(near.select(names)).repartition(parts(docs.sparkSession), "a", "b", "block_a", "block_b")
    met = met.withColumn("x", F.explode("ids_a")).drop("ids_a").withColumn("y", F.explode("ids_b")).where("a <> b or x.n < y.n")
    x, y = F.col("x.doc_id"), F.col("y.doc_id")
    swap = F.coalesce(x > y, x.isNull())
    return met.select(F.when(swap, y).otherwise(x).alias("doc_id"), F.when(swap, x).otherwise(y).alias("match_id"), "overlap", (F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))).alias("jaccard"))


def keep_one(docs: DataFrame, n: int = 3, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose group of matching documents (by chains of matches) holds a lesser (doc_id, row).

    Rows without words all stay; of a row repeated exactly one stays. All columns are kept as they are.
    """
    classes, label, _ = teams(docs, n, threshold, key, text)
    teamed = classes.join(label, "sig", "left").withColumn("team", F.coalesce("team", "sig"))
    order = Window.partitionBy("team").orderBy(F.col("doc_id") == F.lit(-(1 << 63)), "doc_id", "row")
    ranked = teamed.withColumn("n", F.row_number().over(order)).groupBy("row").agg(F.min("n").alias("n"))
    gone = stored(ranked.where("n > 1").select("row"), "gone")
    names = docs.columns
    at, tx = place(docs, key), place(docs, text)
    whole = numbered(docs)
    whole = whole.withColumn("row", row_id(whole, f"c{at}", f"c{tx}"))
    kept = whole.join(sized(gone), "row", "left_anti")
    # The first of a group may be there more than once.
    twice = stored(classes.groupBy("row").count().where("count > 1").select("row"), "twice")
    if twice.limit(1).count():
        again = kept.join(sized(twice), "row", "left_semi").dropDuplicates(["row"])
        kept = kept.join(sized(twice), "row", "left_anti").unionByName(again)
    return kept.drop("row").toDF(*names)
