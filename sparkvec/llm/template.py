"""Content extraction by equivalence-class template deduction (after EXALG).

The pages of a host are tokens: tags and words, each in the role that its path
of open tags gives it. A token's occurrence vector has its number of occurrences in
every page of the host. Tokens of equal vectors form an equivalence class; a
class is *large and frequent* with at least `min_size` tokens, a tag among them, in at least `support`
of the pages (and two of them; words that are to be template count in three or more), and *valid* if its
tokens come in one order, tuple after tuple, in every page that has them. Of a class that comes once a page those tokens count that
keep one order everywhere; so one page out of order doesn't cost the others their template.

The valid class of most pages (then one that comes once a page, then the largest) is the root. Its tokens cut each
page into gaps; a token in two different gaps is two different tokens from there on,
and within every gap classes are found in the same way, so templates nest to any depth: lists of tuples, and lists within them.
What the tokens of the nested classes leave in the gaps are the slots, named by the gaps that lead there
and by the tuples, if it lies in lists.

1. Pages are dealt to tasks by host, large hosts in groups of PAGES pages. The roles frequent in some group are the host's
   candidates: any role that is frequent in the host is so in some group. Nothing but them goes on.
2. Each page becomes its *shape*, the sequence of its candidates, and the texts between them.
3. Equal shapes are counted, and the classes of a host are found from its distinct shapes,
   which have the same equal vectors and orders as its pages.
4. A page's slots follow from its shape; no page is parsed again.

Hosts never meet as pages. One task holds the distinct shapes of a host (4 bytes a candidate).
Candidates and templates go to all tasks while small, and are joined by host beyond that.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm import textnp
from sparkvec.llm.common import BROADCAST_BYTES, blobs, bytes_of, cut, parts, ranges, row_id, runs, sized, stored, take, tidy_batches

TAG = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S | re.I)
CLASS = re.compile(rb"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset(b"area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open one of their kind.
ENDS = frozenset(b"p li td th tr dt dd option".split())
STEP_BYTES = 1 << 20
ODD = 0x9E3779B97F4A7C15


def number(name: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little")


NOTHING, OPEN, VOIDS, CLOSE = range(4)
#: Inline elements that don't keep an open one from being ended.
INLINE = frozenset(b"b i em strong span a".split())


def describe(tag: bytes) -> tuple[int, bytes, int, bool]:
    """(what it does, name, number of its token, whether it ends an open one of its kind) of a tag."""
    m = TAG.fullmatch(tag)
    if m is None or m.group(3) is None:
        return NOTHING, b"", 0, False
    name = m.group(3).lower()
    if m.group(2):  # named like what it closes
        return CLOSE, name, number(b"/" + name), False
    token = name
    if b"class" in m.group(4) and (c := CLASS.search(m.group(4))):
        token += b"." + (c.group(1) or c.group(2) or c.group(3) or b"")
    return VOIDS if name in VOID or m.group(4).endswith(b"/") else OPEN, name, number(token), name in ENDS


class Tokens:
    """Tags and words of some pages in order: page, start, end, role, word (else a tag)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, known: dict[bytes, tuple]):
        raw = data.tobytes()
        starts, ends, roles, after = [], [], [], []
        add_start, add_end, add_role, add_after, find, mask = starts.append, ends.append, roles.append, after.append, TAG.finditer, textnp.MASK
        if len(known) > 50_000:
            known.clear()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            open_, paths, path = [], [], 0
            add_start(a)
            add_end(a)
            add_role(0)
            add_after(0)
            for m in find(raw, a, b):
                s, e = m.span()
                tag = raw[s:e]
                if (what := known.get(tag)) is None:
                    what = describe(tag)
                    if e - s < 200:
                        known[tag] = what
                kind, name, own, ends_one = what
                role = 0
                if kind:
                    if kind == CLOSE:  # the path of what it closes; it ends all that is open within
                        if open_ and open_[-1] == name:
                            open_.pop()
                            path = paths.pop()
                        elif name in open_:
                            at = len(open_) - 1 - open_[::-1].index(name)
                            path = paths[at]
                            del open_[at:], paths[at:]
                    elif ends_one:
                        for i in range(len(open_) - 1, -1, -1):
                            if open_[i] == name:
                                path = paths[i]
                                del open_[i:], paths[i:]
                                break
                            if open_[i] not in INLINE:
                                break
                    inner = (path * ODD + own) & mask
                    role = inner | 1
                    if kind == OPEN:
                        open_.append(name)
                        paths.append(path)
                        path = inner
                add_start(s)
                add_end(e)
                add_role(role)
                add_after(path)
        start, end = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
        role, after_ = np.array(roles, dtype=np.uint64), np.array(after, dtype=np.uint64)
        plain = data.copy()
        plain[ranges(start, end - start)] = 32
        words = textnp.Words(plain, offsets, "solid")
        path = after_[np.searchsorted(start, words.start, side="right") - 1]
        with np.errstate(over="ignore"):
            word_role = textnp.mix64(words.hash ^ (path * np.uint64(ODD))) & ~np.uint64(1)
        tag = role != 0
        page = np.searchsorted(offsets, start[tag], side="right") - 1
        order = np.argsort(np.concatenate([start[tag], words.start]), kind="stable")
        self.raw = raw
        self.page = np.concatenate([page, words.doc])[order]
        self.start, self.end = np.concatenate([start[tag], words.start])[order], np.concatenate([end[tag], words.end])[order]
        self.role = np.concatenate([role[tag], word_role])[order]
        self.word = np.concatenate([np.zeros(int(tag.sum()), dtype=bool), np.ones(len(words), dtype=bool)])[order]


def steps(column: pa.Array):
    """Yields (first page, number of pages, Tokens)."""
    data, offsets = textnp.buffers(cut(column))
    known: dict[bytes, tuple] = {}
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, side="right")) - 1))
        yield lo, hi - lo, Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], known)
        lo = hi


#: Pages of a host that look for its candidates together.
PAGES = 1024
#: Pages that a word must be in to be part of a template.
WORD_PAGES = 3


class Hosts:
    """Numbers for host names within a task."""

    def __init__(self):
        self.names: list = []
        self.at: dict = {}

    def __call__(self, column) -> np.ndarray:
        out = []
        for h in column.to_pylist():
            if h not in self.at:
                self.at[h] = len(self.names)
                self.names.append(h)
            out.append(self.at[h])
        return np.array(out, dtype=np.int64)

    def array(self, numbers: np.ndarray) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(numbers.astype(np.int32)), pa.array(self.names, pa.string())).cast(pa.string())


def _grouped(host: np.ndarray, role: np.ndarray, count: np.ndarray):
    """host, role and the sum of the counts, once for each (host, role)."""
    order = np.lexsort((role, host))
    host, role = host[order], role[order]
    start, _ = runs(host, role)
    if not len(start):
        return host, role, count
    return host[start], role[start], np.add.reduceat(count[order], start)


def _frequent(support: float):
    def work(batches):
        hosts, held, pages = Hosts(), [], []
        for batch in batches:
            own = hosts(batch.column("host"))
            pages.append(own)
            for lo, n, t in steps(batch.column("html")):
                order = np.lexsort((t.role, t.page))
                start, _ = runs(t.page[order], t.role[order])
                at = order[start]
                held.append(_grouped(own[lo + t.page[at]], t.role[at], np.ones(len(at), dtype=np.int64)))
                if len(held) > 16:
                    held = [_grouped(*[np.concatenate(x) for x in zip(*held)])]
        if not held:
            return
        host, role, count = _grouped(*[np.concatenate(x) for x in zip(*held)])
        n = np.bincount(np.concatenate(pages), minlength=len(hosts.names))
        good = count >= support * n[host]
        yield pa.RecordBatch.from_arrays([hosts.array(host[good]), pa.array(role[good].view(np.int64))], names=["host", "role"])

    return work


def _lists(table: pa.Table) -> pa.Table:
    """The candidates of a host as one row of bytes, sorted."""
    roles = np.unique(np.array(table.column("role").to_numpy(), dtype=np.int64).view(np.uint64))
    return pa.table({"host": table.column("host").slice(0, 1), "roles": pa.array([roles.tobytes()], pa.binary())})


def _member(host: np.ndarray, role: np.ndarray, of: dict[int, np.ndarray]) -> np.ndarray:
    """For each token, its place in its host's sorted candidates, or -1."""
    out = np.full(len(role), -1, dtype=np.int64)
    order = np.argsort(host, kind="stable")
    start, count = runs(host[order])
    for s, c in zip(start.tolist(), count.tolist()):
        mine = order[s : s + c]
        known = of[int(host[mine[0]])]
        if len(known):
            p = np.minimum(np.searchsorted(known, role[mine]), len(known) - 1)
            out[mine] = np.where(known[p] == role[mine], p, -1)
    return out


def beside(df: DataFrame, side: DataFrame, column: str) -> tuple[DataFrame, dict | None]:
    """df with its host's value of side (stored) as a column, or, while side is small, that as a dict and a column of nulls."""
    if bytes_of(side) <= BROADCAST_BYTES:
        return df.withColumn(column, F.lit(None).cast(side.schema[column].dataType)), {r.host: r[column] for r in side.collect()}
    return df.join(side, "host", "left"), None


def _values(batch, own: np.ndarray, column: str, known: dict | None, hosts: Hosts, of: dict, read) -> None:
    """Reads the value of each new host of a batch once."""
    for i in np.unique(own, return_index=True)[1].tolist():
        h = int(own[i])
        if h not in of:
            of[h] = read(batch.column(column)[i].as_py() if known is None else known.get(hosts.names[h]))


def _shapes(known: dict | None):
    def work(batches):
        hosts, of = Hosts(), {}
        for batch in batches:
            own = hosts(batch.column("host"))
            _values(batch, own, "roles", known, hosts, of, lambda raw: np.frombuffer(raw or b"", dtype=np.uint64))
            for lo, n, t in steps(batch.column("html")):
                host = own[lo + t.page]
                place = _member(host, t.role, of)
                fixed = place >= 0
                count = np.bincount(t.page[fixed], minlength=n)
                # Texts of a page: before its first candidate, that one (if it is a word), behind it, and so on.
                size = 2 * count + 1
                first = np.cumsum(size) - size
                seen = np.cumsum(fixed) - fixed  # candidates before each token
                before = np.cumsum(count) - count
                group = first[t.page] + 2 * (seen - before[t.page]) + fixed
                use = np.flatnonzero(t.word)
                start, end, group = t.start[use], t.end[use], group[use]
                last = np.append(group[1:] != group[:-1], True) if len(use) else np.zeros(0, dtype=bool)
                wide = end - start + ~last
                data = np.frombuffer(t.raw, dtype=np.uint8)[np.minimum(ranges(start, wide), len(t.raw) - 1)].copy()
                stop = np.cumsum(wide)
                data[stop[~last] - 1] = 32
                total = int(size.sum())
                offsets = np.zeros(total + 1, dtype=np.int64)
                np.add.at(offsets, group + 1, wide)
                texts = pa.LargeStringArray.from_buffers(total, pa.py_buffer(np.cumsum(offsets)), pa.py_buffer(data)).cast(pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, total).astype(np.int32)), texts)
                shape = blobs(place[fixed].astype(np.int32), count)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, n), batch.column("host").slice(lo, n), pa.array(shape, pa.binary()), lists], names=["key", "host", "shape", "texts"])

    return work


class Deduction:
    """The template of some shapes, each there as often as its weight."""

    def __init__(self, shapes: list[np.ndarray], weights: np.ndarray, tag: np.ndarray, support: float, min_size: int):
        self.shapes, self.weights, self.tag, self.support, self.min_size = shapes, np.asarray(weights, dtype=np.int64), tag, support, min_size
        self.root = self.grow(np.arange(len(shapes)), np.zeros(len(shapes), dtype=np.int64), np.array([len(x) for x in shapes], dtype=np.int64))

    def grow(self, shape: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict | None:
        """The class that cuts these pieces of shapes, as {"tokens": in order, "gaps": {gap: the class within it}}."""
        size = hi - lo
        has = size > 0
        if not has.any():
            return None
        weight = self.weights[shape]
        token = np.concatenate([self.shapes[i][a:b] for i, a, b in zip(shape[has].tolist(), lo[has].tolist(), hi[has].tolist())]).astype(np.int64)
        piece = np.repeat(np.arange(len(shape)), size)
        at = ranges(lo, size)
        found = self.best(token, piece, at, weight, int(weight.sum()))
        if found is None:
            return None
        tokens, mine = found
        m = len(tokens)
        # Cut every piece at the class's tokens.
        p, x = piece[mine], at[mine]
        count = np.bincount(p, minlength=len(shape))
        nth = np.arange(len(p)) - (np.cumsum(count) - count)[p]
        begin = np.concatenate([lo, x + 1])
        stop = np.concatenate([hi, hi[p]])
        none = count == 0
        first = np.cumsum(count) - count
        stop[: len(lo)][~none] = x[first[~none]]
        follows = np.flatnonzero(np.append(p[1:] == p[:-1], False)) if len(p) else np.zeros(0, dtype=np.int64)
        stop[len(lo) + follows] = x[follows + 1]
        gap = np.concatenate([np.zeros(len(lo), dtype=np.int64), nth % m + 1])
        of = np.concatenate([shape, shape[p]])
        kids = {}
        for g in range(m + 1):
            pick = np.flatnonzero((gap == g) & (stop > begin))
            if len(pick):
                # Empty pieces of a gap are pieces too: what is in few of them is not frequent.
                every = np.flatnonzero(gap == g)
                kid = self.grow(of[every], begin[every], stop[every])
                if kid is not None:
                    kids[g] = kid
        return {"tokens": tokens.tolist(), "gaps": kids}

    def best(self, token: np.ndarray, piece: np.ndarray, at: np.ndarray, weight: np.ndarray, total: int):
        """(tokens in order, which of the given tokens are theirs) of the first valid class, or None."""
        order = np.lexsort((piece, token))
        start, count = runs(token[order], piece[order])
        tok, pc_ = token[order][start], piece[order][start]
        with np.errstate(over="ignore"):
            vector = textnp.mix64(pc_.astype(np.uint64) + np.uint64(1)) * count.astype(np.uint64)
        s, _ = runs(tok)
        with np.errstate(over="ignore"):
            name, vec = tok[s], np.add.reduceat(vector, s)
        present = np.add.reduceat(weight[pc_], s)
        several = np.maximum.reduceat(count, s) > 1
        good = (present >= self.support * total) & (present >= np.where(self.tag[name], 2, WORD_PAGES))
        name, vec, present, several = name[good], vec[good], present[good], several[good]
        order = np.lexsort((name, vec))
        s, c = runs(vec[order])
        classes = [order[a : a + n] for a, n in zip(s.tolist(), c.tolist()) if n >= self.min_size and self.tag[name[order[a : a + n]]].any()]
        classes.sort(key=lambda x: (-present[x[0]], several[x[0]], -len(x), name[x[0]]))
        for x in classes:
            valid = self.valid(name[x], bool(several[x[0]]), token, piece, at)
            if valid is not None:
                return valid
        return None

    def valid(self, names: np.ndarray, several: bool, token: np.ndarray, piece: np.ndarray, at: np.ndarray):
        mine = np.flatnonzero(np.isin(token, names))
        m = len(names)
        seq = token[mine]
        if several:
            tokens = seq[:m]
            if len(np.unique(tokens)) < m or not (seq.reshape(-1, m) == tokens).all():  # counts are equal: tuples never cross pieces
                return None
            return tokens, mine
        # Once a piece: a row of places for each piece that has the class, in the order of the first.
        tokens = seq[:m]
        rank = np.argsort(np.argsort(tokens, kind="stable"), kind="stable")
        by = np.argsort(token[mine].reshape(-1, m), axis=1, kind="stable")
        places = np.take_along_axis(at[mine].reshape(-1, m), by, axis=1)[:, rank]
        keep, last = [0], places[:, 0]
        if (places[:, 1:] > places[:, :-1]).all():
            return tokens, mine
        for j in range(1, m):
            if (places[:, j] > last).all():
                keep.append(j)
                last = places[:, j]
        tokens = tokens[keep]
        if len(tokens) < self.min_size or not self.tag[tokens].any():
            return None
        return tokens, mine[np.isin(seq, tokens)]


def slots_of(root: dict | None, shape: np.ndarray) -> list[tuple[str, list[int], int, int]]:
    """(slot, tuples, first, last) of the gaps of a page in order; its texts from 2 * first to 2 * last are theirs."""
    out: list[tuple[str, list[int], int, int]] = []

    def walk(node: dict | None, lo: int, hi: int, path: tuple, tuples: tuple) -> None:
        if node is None:
            out.append((".".join(map(str, path)), list(tuples), lo, hi))
            return
        own = node.get("set")
        if own is None:
            own = node["set"] = frozenset(node["tokens"])
            node["gaps"] = {int(g): kid for g, kid in node["gaps"].items()}
        m, n, begin, gap = len(own), 0, lo, 0
        for i in range(lo, hi):
            if listed[i] in own:
                walk(node["gaps"].get(gap), begin, i, (*path, gap), (*tuples, -(-n // m)))
                n, begin, gap = n + 1, i + 1, n % m + 1
        walk(node["gaps"].get(gap), begin, hi, (*path, gap), (*tuples, -(-n // m)))

    listed = shape.tolist()
    walk(root, 0, len(listed), (), ())
    return out


def _deduce(support: float, min_size: int, tags: dict | None):
    def work(table: pa.Table) -> pa.Table:
        raw = table.column("roles")[0].as_py() if tags is None else tags[table.column("host")[0].as_py()]
        roles = np.frombuffer(raw or b"", dtype=np.uint64)
        shapes = [np.frombuffer(x, dtype=np.int32) for x in table.column("shape").to_pylist()]
        order = sorted(range(len(shapes)), key=lambda i: shapes[i].tobytes())  # whatever order they come in
        n = table.column("n").to_numpy()
        root = Deduction([shapes[i] for i in order], n[order], (roles & np.uint64(1)) == 1, support, min_size).root
        return pa.table({"host": table.column("host").slice(0, 1), "template": pa.array([json.dumps(root)], pa.string())})

    return work


def _fill(known: dict | None):
    def work(batches):
        hosts, of = Hosts(), {}
        done: dict[tuple[int, bytes], list] = {}
        kind = pa.list_(pa.struct([("slot", pa.string()), ("tuple", pa.list_(pa.int32())), ("text", pa.string())]))
        for batch in batches:
            own = hosts(batch.column("host"))
            _values(batch, own, "template", known, hosts, of, lambda raw: json.loads(raw) if raw else None)
            out = []
            for h, shape, texts in zip(own.tolist(), batch.column("shape").to_pylist(), batch.column("texts").to_pylist()):
                found = done.get((h, shape))
                if found is None:
                    if len(done) > 20_000:
                        done.clear()
                    found = done[h, shape] = slots_of(of[h], np.frombuffer(shape, dtype=np.int32))
                slots = []
                for slot, tuples, a, b in found:
                    text = " ".join(x for x in texts[2 * a : 2 * b + 1] if x)
                    if text:
                        slots.append({"slot": slot, "tuple": tuples, "text": text})
                out.append(slots)
            name = pa.array([hosts.names[h] or None for h in own.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), name, pa.array(out, kind)], names=["page_id", "host", "slots"])

    return work


def extract(pages: DataFrame, support: float = 0.5, min_size: int = 2, min_pages: int = 2, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, slots of every page: slots is a list of (slot, tuple, text) in page order.

    slot is the path of gaps that leads to the text: "3" is gap 3 of the host's root class (0: before its first token),
    "3.1" gap 1 of the class within that, and so on. tuple has, for each class of the path, the number of its tuple that the
    text is in or behind (from 1; 0: before the first), so (slot, tuple) names a piece of a page. Only slots with
    words are there. Comments, scripts and styles are no tokens; entities stay as they are.
    Pages of hosts with fewer than min_pages pages or without a template are one
    slot "" with all their words. A null or malformed url has the host null,
    whose pages make one group; null and empty html has no slots. Rows repeated
    with page_id and html weigh as often as they are there. Other columns are ignored.
    """
    spark = pages.sparkSession
    own = take(pages, key=key, url=url, html=html)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    own = own.select(F.col("key").cast("long").alias("key"), host.alias("host"), F.col("html").cast("string").alias("html"), row_id(own, "key", "html").alias("row"))
    sizes = stored(own.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages), "hosts")
    group = F.pmod(F.xxhash64("row"), F.ceil(F.col("pages") / PAGES)).alias("group")
    dealt = own.join(sized(sizes), "host").select("host", "html", group).repartition(parts(spark), "host", "group")
    found = dealt.select("host", "html").mapInArrow(tidy_batches(_frequent(support)), "host string, role long").distinct()
    roles = stored(found.groupBy("host").applyInArrow(_lists, "host string, roles binary"), "roles")
    with_roles, known = beside(own.select("key", "host", "html"), roles, "roles")
    pieces = stored(with_roles.mapInArrow(tidy_batches(_shapes(known)), "key long, host string, shape binary, texts array<string>"), "shapes")
    counted = pieces.where(F.length("shape") > 0).groupBy("host", "shape").agg(F.count("*").alias("n"))
    # A page without candidates counts as one all the same: what is frequent is so among all pages.
    bare = pieces.where(F.length("shape") == 0).join(sized(roles.select("host")), "host", "left_semi").groupBy("host", "shape").agg(F.count("*").alias("n"))
    counted = counted.unionByName(bare)
    if known is None:
        counted = counted.join(roles, "host")
    templates = stored(counted.groupBy("host").applyInArrow(_deduce(support, min_size, known), "host string, template string"), "templates")
    with_templates, ready = beside(pieces, templates, "template")
    return with_templates.mapInArrow(tidy_batches(_fill(ready)), "page_id long, host string, slots array<struct<slot:string,tuple:array<int>,text:string>>")
