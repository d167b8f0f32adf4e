"""Templates, archives, vector search, token shards and the pipeline: brute-force versions, round trips, odd rows."""

import gzip
import hashlib
import re

import numpy as np
import pytest

from sparkvec.llm import queries, sentencepiece_codec, sstable, template, va_search, warc
from sparkvec.llm.common import new_path, table, take

SF = "/root/testdata/sf0.001"


# HTML
def page(title, items, body, tail="</body></html>"):
    rows = "".join(f"<li><b>item</b> {i}" for i in items)
    return f"<html><head><title>{title}</title><script>x('<p>')</script></head><body><ul>{rows}</ul><!-- c --><div class='m'>By me: {body}</div>{tail}"


def test_template_and_slots(spark):
    pages = [(i, f"http://User@Host.example:80/p{i}", page(f"T{i} a", range(i + 1), f"text {i} é")) for i in range(6)] + [(9, "http://host.example/x", page("T9", [1], "last", tail=""))]
    got = {r.page_id: r for r in template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {r.host for r in got.values()} == {"host.example"}
    texts = lambda i: [s.text for s in got[i].slots]
    assert texts(2) == ["T2 a", "0", "1", "2", "text 2 é"] and texts(9) == ["T9", "1", "last"]
    slots = [(s.slot, s.tuple) for s in got[2].slots]
    assert len({x for x, _ in slots[1:4]}) == 1 and [t[-1] for _, t in slots[1:4]] == [1, 2, 3] and "." in slots[1][0]
    assert [s.slot for s in got[5].slots if s.text.startswith("text")] == [slots[-1][0]] and slots[0][0] != slots[-1][0]


def test_one_page_out_of_order_leaves_the_template(spark):
    make = lambda i, a, b: f"<html><body><div class='x'>Left {a}</div><p>Right {b}</p><i>end</i></body></html>"
    pages = [(i, "http://h/", make(i, f"a{i}", f"b{i}")) for i in range(5)] + [(7, "http://h/", "<html><body><p>Right b7</p><div class='x'>Left a7</div><i>end</i></body></html>")]
    got = {r.page_id: {s.text for s in r.slots} for r in template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(f"a{i}" in " ".join(got[i]).split() and "end" not in " ".join(got[i]).split() for i in (0, 1, 7)) and len(got[0]) > 1


# A version of its own of the whole method, by plain counting: tokens are (path, name) of tags and (path, word) of words.
TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|[^<\s]+", re.S | re.I)


def plain_tokens(html):
    """[(role, is a tag, text)] with the rules of closing that the operator states."""
    out, open_ = [], []
    for m in TOKEN.finditer(html):
        t = m.group(0)
        if not t.startswith("<"):
            out.append((("w", tuple(open_), t), False, t))
            continue
        tag = re.fullmatch(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(.*)>", t, re.S)
        if m.group(1) or not tag:
            continue
        name = tag.group(2).lower()
        if tag.group(1):
            if name in [n for n, _ in open_]:
                while open_.pop()[0] != name:
                    pass
            out.append((("t", tuple(open_), "/" + name), True, ""))
            continue
        if name in "p li td th tr dt dd option".split():
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
                if open_[i][0] not in "b i em strong span a".split():
                    break
        c = re.search(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", tag.group(3))
        own = name + ("." + next(g for g in (*c.groups(), "") if g is not None) if c else "")
        out.append((("t", tuple(open_), own), True, ""))
        if name not in "area base br col embed hr img input link meta source track wbr".split() and not tag.group(3).endswith("/"):
            open_.append((name, own))
    return out


def plain_slots(pages, support=0.5):
    """{(page, slot, tuple): text} of the pages of a host."""
    found = {}
    whole = [plain_tokens(h) for h in pages]
    frequent = {r for r in {x[0] for w in whole for x in w} if sum(any(x[0] == r for x in w) for w in whole) >= support * len(pages)}

    def solve(pieces, path):  # pieces: (page, tuples, tokens)
        n = len(pieces)
        counts = {}
        for i, (_, _, tokens) in enumerate(pieces):
            for role, tag, _ in tokens:
                if role in frequent:
                    counts.setdefault((role, tag), [0] * n)[i] += 1
        classes = {}
        for (role, tag), v in counts.items():
            have = sum(x > 0 for x in v)
            if have >= support * n and have >= (2 if tag else 3):
                classes.setdefault(tuple(v), []).append((role, tag))
        best = None
        for v, members in classes.items():
            if len(members) < 2 or not any(tag for _, tag in members):
                continue
            roles = {r for r, _ in members}
            seqs = [[r for r, _, _ in t if r in roles] for _, _, t in pieces]
            seqs = [s for s in seqs if s]
            m = len(roles)
            order = seqs[0][:m]
            if max(v) > 1:
                if len(set(order)) < m or any(s != order * (len(s) // m) for s in seqs):
                    continue
            else:  # those that keep one order, from the first on
                kept = order[:1]
                for r in order[1:]:
                    if all(s.index(r) > s.index(kept[-1]) for s in seqs):
                        kept.append(r)
                tags = {r for r, tag in members if tag}
                if len(kept) < 2 or not tags & set(kept):
                    continue
                order = kept
            rank = (sum(x > 0 for x in v), max(v) == 1, m)
            assert best is None or rank != best[0] or path is None, "a tie"
            if best is None or rank > best[0]:
                best = (rank, order)
        if best is None:
            for page, tuples, tokens in pieces:
                text = " ".join(x for _, _, x in tokens if x)
                if text:
                    found[page, path, tuples] = text
            return
        order = best[1]
        gaps = {}
        for page, tuples, tokens in pieces:
            held, gap, number = [], 0, 0
            for x in tokens:
                if x[0] in order:
                    gaps.setdefault(gap, []).append((page, (*tuples, number), held))
                    gap = order.index(x[0]) + 1
                    number += gap == 1
                    held = []
                else:
                    held.append(x)
            gaps.setdefault(gap, []).append((page, (*tuples, number), held))
        for gap, inner in gaps.items():
            if any(any(x[0] in frequent for x in t) for _, _, t in inner):
                solve(inner, (*path, gap))
            else:
                for page, tuples, tokens in inner:
                    if text := " ".join(x for _, _, x in tokens if x):
                        found[page, (*path, gap), tuples] = text

    solve([(i, (), w) for i, w in enumerate(whole)], ())
    return found


def slots_by_name(rows, place):
    return {(place[r.page_id], tuple(int(x) for x in s.slot.split(".") if x), tuple(s.tuple)): s.text for r in rows for s in r.slots}


def test_slots_match_brute_force(spark):
    """All pages of the host with most pages, slot by slot; the same whatever tasks they are in."""
    docs = table(spark, "/root/testdata/sf0.01", "pages")
    rows = docs.collect()
    by_host = {}
    for r in rows:
        by_host.setdefault(r.url.split("/")[2].lower(), []).append(r)
    mine = sorted(by_host.values(), key=len)[-6:-4]  # some dozen pages each
    chosen = spark.createDataFrame([r for m in mine for r in m], docs.schema)
    got = template.extract(chosen).collect()
    again = template.extract(chosen.repartition(60)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    for m in mine:
        place = {r.page_id: i for i, r in enumerate(m)}
        want = plain_slots([r.html for r in m])
        assert slots_by_name([r for r in got if r.page_id in place], place) == want and len(want) > 3 * len(m)


def test_few_roles_are_candidates_wherever_pages_are(spark, monkeypatch):
    monkeypatch.setattr(template, "PAGES", 20)
    pages = spark.createDataFrame([(i, f"http://h{i % 2}/", page(f"T{i}", range(i % 3), " ".join(f"w{i}x{j}" for j in range(40)))) for i in range(120)], "page_id long, url string, html string")
    kept = []
    real = template.beside
    monkeypatch.setattr(template, "beside", lambda df, side, column: (kept.append(side), real(df, side, column))[1])
    rows = template.extract(pages.repartition(40)).collect()
    assert len(rows) == 120 and max(len(r.roles) // 8 for r in kept[0].collect()) < 60
    monkeypatch.setattr(template, "BROADCAST_BYTES", -1)
    assert sorted(map(str, template.extract(pages).collect())) == sorted(map(str, rows))


def test_templates_on_odd_rows(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, None, "<p>y"), (3, "http://a/", None), (4, "nonsense", ""), (None, "http://b/", "<b>" + "w " * 50_000), (5, "http://c/", "<a <<p> ><x"), (6, "http://c/", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS slots", "3 AS key").toDF("page_id", "url", "html", "host", "HTML", "key")
    got = template.extract(df).collect()
    assert len(got) == len(rows) and {r.page_id: len(r.slots) for r in got}[3] == 0
    assert {r.host for r in got if r.page_id in (2, 4)} == {None}
    assert template.extract(df.limit(0)).count() == 0


# WARC
HTTP = b"HTTP/1.1 404 Not Found\r\nContent-Type: application/pdf\r\n\r\n"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("a", "response", "u1", "2024-02-01", "sha1:X", HTTP, b"one", None), ("b", "response", "u2", "2024-01-01", "sha1:X", None, b"one", None), ("c", "revisit", "u3", "2024-03-01", "sha1:X", HTTP, None, None),
        ("d", "revisit", "u4", None, None, None, None, "a"), ("e", "revisit", "u5", None, "sha1:Q", None, None, "zz"), ("f", "response", None, None, None, None, b"two", None), ("f", "response", None, None, None, None, b"two", None),
        (None, "metadata", "u\r\nX: y", None, None, None, None, None), ("g", "RESPONSE", "u", "2024-01-01", None, None, None, None), ("h", None, None, None, None, None, b"z", None),
    ]
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], warc.RECORD)


def test_revisits_are_resolved_and_written(spark, records):
    folder = new_path(spark, "warc")
    index = warc.write(records.selectExpr("*", "1 AS kind", "2 AS row"), folder).collect()
    made = sorted((r.record_id, r.type or "", r.original or "") for r in index)
    assert made == [("", "metadata", ""), ("a", "revisit", "b"), ("b", "response", ""), ("c", "revisit", "b"), ("d", "revisit", "b"), ("e", "revisit", ""), ("f", "response", ""), ("f", "revisit", "f"), ("g", "response", ""), ("h", "", "")]
    back = {(r.record_id, r.type): r for r in warc.read(spark, folder).collect()}
    assert len(back) == len(made)
    assert bytes(back["b", "response"].payload) == b"one" and back["b", "response"].http is None and back["c", "revisit"].refers_to == "b" and back["a", "revisit"].payload is None
    assert bytes(back["a", "revisit"].http) == HTTP and back["f", "response"].date is None and back["b", "response"].date == "2024-01-01"
    for r in index:
        row = warc.fetch(folder, r.shard, r.place, r.size)
        assert row[0] == r.record_id
    shard = folder[len("file://") :] + "/" + index[0].shard
    assert gzip.open(shard).read().startswith(b"WARC/1.1\r\n")
    assert warc.write(records.limit(0), new_path(spark, "warc")).count() == 0


def test_equal_headers_and_different_payloads(spark):
    """Each digest is that of its own payload, and HTTP blocks come back as they were."""
    payloads = [b"", b"x", b"yy", "é".encode() * 300_000, b"\x00\xff\r\n\r\nWARC/1.0", b"yy"]
    rows = [("same", "response", "u", "d", None, bytearray(HTTP), bytearray(p), None) for p in payloads]
    folder = new_path(spark, "warc")
    index = warc.write(spark.createDataFrame(rows, warc.RECORD).repartition(3), folder)
    assert sorted(r.type for r in index.collect()) == ["response"] * 5 + ["revisit"]
    for r in index.collect():
        row = warc.fetch(folder, r.shard, r.place, r.size)
        assert row[5] == HTTP and (row[1] == "revisit" or row[4] == r.digest == "sha256:" + hashlib.sha256(row[6]).hexdigest())
    got = sorted(bytes(r.payload) for r in warc.read(spark, folder).collect() if r.payload is not None)
    assert got == sorted(set(payloads))


def test_a_recrawl_agrees_with_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(db.execute(queries.OP6_REVISITS_SQL).fetchall(), key=str)
    assert sorted(map(tuple, queries.op6_warc_revisits(spark, SF).collect()), key=str) == want
    assert sum(r[1] == "revisit" for r in want) > len(want) / 4


def test_archives_of_others(spark, tmp_path):
    """Several records in a member, names in any case, lines that go on, headers that are no UTF-8."""
    one = b"WARC/1.0\r\nwarc-type:resource\r\nWARC-RECORD-ID: <r1>\r\nX: a\r\n b\r\nWARC-Target-URI: \xff\r\ncontent-length:3\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r2>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (len(HTTP) + 2) + HTTP + b"hi\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one + two) + gzip.compress(two))
    got = sorted((r.record_id, r.type, bytes(r.payload), r.http and bytes(r.http)) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == [("<r1>", "resource", b"abc", None), ("<r2>", "response", b"hi", HTTP), ("<r2>", "response", b"hi", HTTP)]
    assert [h.get("x") for _, _, h, _ in warc.parse_records(gzip.compress(one))] == ["a b"]


def test_broken_archives_are_no_silent_loss(spark, tmp_path):
    one, two = (warc.record_bytes(str(i), "response", "u", None, "d", None, bytes(np.random.default_rng(i).integers(0, 256, 3_000_000, dtype=np.uint8)), None) for i in range(2))
    assert [h["x-source-record"] for _, _, h, _ in warc.parse_records(one + two)] == ["0", "1"]
    short = gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")
    for raw in (one + two[:-9], b"junk", one + b"junk", short, gzip.compress(b"WARC/1.0\r\n\r\n"), gzip.compress(b"no record")):
        with pytest.raises(warc.Broken):
            list(warc.parse_records(raw))
    (tmp_path / "a.warc.gz").write_bytes(one + two[:-9])
    with pytest.raises(Exception):
        warc.read(spark, str(tmp_path)).collect()
    assert [r.type for r in warc.read(spark, str(tmp_path), broken="row").collect()] == ["response", "broken"]


# vectors
def brute(rows, k):
    out = []
    for i, v in rows:
        d = sorted((sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(np.float32(v), np.float32(w))), j) for j, w in rows if j != i)
        out += [(i, j, n + 1, x) for n, (x, j) in enumerate(d[:k])]
    return sorted(out)


def test_vector_files_are_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(va_search, "BLOCK", 16)
    monkeypatch.setattr(va_search, "CHUNK", 5)
    random = np.random.default_rng(4)
    rows = [(i, random.integers(0, 3, 5).astype(float).tolist()) for i in range(70)]
    got = va_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4)
    assert va_search.top_k(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), k=4).count() == 6


@pytest.mark.parametrize("dim,scale", [(9, 1.0), (700, 1e3), (5, 1e30), (3, 1e-25)])
def test_bounds_hold(dim, scale):
    random = np.random.default_rng(0)
    x = (random.normal(size=(200, dim)) * scale + scale * 50).astype(np.float32)
    grid = va_search.Grid(x.min(axis=0).astype(float), x.max(axis=0).astype(float))
    code = grid.cells(x)
    radius = grid.radii(x, code)
    p = va_search.Products(x, grid, code)
    row, col = (i.ravel() for i in np.indices((200, 200)))
    near, far = p.bounds(row, col, radius)
    true = np.sqrt(va_search.exact(x[row], x[col]))
    assert (near <= true * (1 + 1e-12)).all() and (far >= true * (1 - 1e-12)).all()
    limit = np.sort(true.reshape(200, 200), axis=1)[:, 5]
    r, c = p.within(limit, radius)
    met = set(zip(r.tolist(), c.tolist()))
    assert all((i, j) in met for i, j in zip(*np.nonzero(true.reshape(200, 200) <= limit[:, None])))


def test_few_exact_vectors_are_read():
    """Two blocks: the scan sees cells alone, and what it leaves is little more than the k nearest."""
    random = np.random.default_rng(6)
    x = random.normal(size=(2, 2000, 16)).astype(np.float32)
    both = x.reshape(-1, 16)
    grid = va_search.Grid(both.min(axis=0).astype(float), both.max(axis=0).astype(float))
    scan = va_search.Scan(x[0, :300], 10, grid)
    for b in range(2):
        code = grid.cells(x[b])
        scan.block(b, code, grid.radii(x[b], code), 0 if b == 0 else None)
    pairs = len(scan.survivors()[0])
    reads = []

    def vectors(b, rows):
        reads.append(len(rows))
        return x[b][rows]

    best = scan.finish(vectors, [np.arange(2000), np.arange(2000, 4000)])
    d = ((x[0, :300, None, :].astype(float) - both[None]) ** 2).sum(axis=2)
    d[np.arange(300), np.arange(300)] = np.inf
    assert (best.ident == np.argsort(d, axis=1)[:, :10]).all()
    assert pairs < 2 * 300 * 10 and sum(reads) <= pairs < 0.01 * d.size


def test_exact_vectors_are_read_at_their_places(tmp_path):
    x = np.random.default_rng(2).normal(size=(5000, 3)).astype(np.float32)
    (tmp_path / "v").write_bytes(x.tobytes())
    with va_search._open(f"file://{tmp_path}", "v") as f:
        for rows in ([0], [4999], [1, 2, 3, 2000, 4990, 4999], list(range(5000))):
            assert (va_search.read_vectors(f, 3, np.array(rows)) == x[rows]).all()


def test_vectors_on_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 0.0]), (6, [None, 1.0]), (7, [5.0, 0.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS vector", "3 AS block")
    assert sorted(map(tuple, va_search.top_k(df, 5).collect())) == [(1, 2, 1, 0.0), (1, 7, 2, 16.0), (2, 1, 1, 0.0), (2, 7, 2, 16.0), (7, 1, 1, 16.0), (7, 2, 2, 16.0)]
    assert va_search.top_k(df.limit(0)).count() == 0
    several = spark.createDataFrame([(1, [3.0, 0.0]), (1, [1.0, 9.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, va_search.top_k(several).collect())) == [(1, 2, 1, 5.0), (2, 1, 1, 5.0)]
    with pytest.raises(ValueError):
        va_search.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


# token shards
def test_shards_hold_every_document(spark, monkeypatch):
    more = [(5, "dup text"), (5, ""), (None, "null id"), (-7, None), (-(1 << 63) + 1, "least"), ((1 << 63) - 1, "most " * 40_000)]
    docs = take(table(spark, SF, "documents"), doc_id="doc_id", text="text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "1 AS key", "2 AS shard")
    folder = new_path(spark, "shards")
    manifest = sstable.write(docs, folder, shards=3)
    want = sorted((r.doc_id, tuple(r.ids)) for r in sentencepiece_codec.encode(docs).where("doc_id is not null").collect())
    keys = docs.select("doc_id").unionByName(spark.createDataFrame([(10**12,), (None,)], "doc_id long"))
    assert sorted((r.doc_id, tuple(r.ids)) for r in sstable.look_up(keys, manifest, folder).collect()) == want
    names = sorted(r[0] for r in manifest.select("shard").distinct().collect())
    scanned = [(k, tuple(t.tolist())) for n in names for k, t in sstable.Reader(folder, n).scan()]
    assert sorted(scanned) == want and [k for k, _ in scanned] == sorted(k for k, _ in scanned)
    assert sum(sstable.Reader(folder, n).entries for n in names) == len(want) and manifest.where("not exact").count() == 0
    monkeypatch.setattr(sstable, "sized", lambda df: df)  # very many shards
    assert sorted((r.doc_id, tuple(r.ids)) for r in sstable.look_up(keys, manifest, folder).collect()) == want
    assert sstable.write(docs.limit(0), new_path(spark, "shards")).count() == 0


def test_filter_and_damage(tmp_path):
    folder = f"file://{tmp_path}"
    w = sstable.Writer(folder, "t", 2)
    for i in range(0, 4000, 2):
        w.add(i, bytes(200))
    name = w.close()
    r = sstable.Reader(folder, name)
    assert all(r.may_hold(i) for i in range(0, 4000, 2)) and sum(r.may_hold(i) for i in range(1, 4000, 2)) < 100
    assert len(r.keys) > 3 and len(r.get(2002)) == 1 and r.get(2001) == [] and r.get(-1) == []
    raw = bytearray((tmp_path / name).read_bytes())
    raw[40] ^= 1
    (tmp_path / name).write_bytes(raw)
    with pytest.raises(ValueError):
        sstable.Reader(folder, name).get(0)
    (tmp_path / "x.sst").write_bytes(b"short")
    with pytest.raises(ValueError):
        sstable.Reader(folder, "x.sst")
