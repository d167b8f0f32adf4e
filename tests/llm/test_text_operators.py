"""The operators on documents: brute-force versions, and odd rows."""

import re

import numpy as np
import pyarrow as pa
import pytest

from sparkvec.llm import decontaminate, importance, language_id, ngram_join, queries, sentencepiece_codec, suffix_dedup, textnp
from sparkvec.llm.common import table, take

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns whose names clash."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, base, "en", "a", 5), (1, base, "en", "a", 5), (2, base, None, None, None), (None, base, "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0),
        (5, "   \n\t ", "en", "a", 3), (6, long, "en", "a", len(long)), (7, long + " tail", "en", "a", len(long)), (None, None, None, None, None), (8, "word", "de", "b", 4), (9, "word", "de", "b", 4),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    names = [*df.columns, "row", "C0", "TEXT", "sig", "key"]
    return df.selectExpr("*", "1 AS r", "'x' AS c", "'y' AS t", "2 AS s", "'k' AS k").toDF(*names)


def cols(df):
    return take(df, doc_id="doc_id", text="text")


def grams(text, n):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def test_words_and_hashes():
    texts = ["Hello, wörld! a-b", "", None, "x  x", "日本 ok"]
    got = [[], [], [], [], []]
    hashes = {}
    for lo, w in textnp.steps(pa.array(texts), limit=8):
        for i, (s, e, d) in enumerate(zip(w.start, w.end, w.doc)):
            word = bytes(w.data[s:e]).decode()
            got[lo + d].append(word)
            assert hashes.setdefault(word, w.hash[i]) == w.hash[i]
    assert got == [["hello", "wörld", "a", "b"], [], [], ["x", "x"], ["日本", "ok"]]
    assert len(set(hashes.values())) == len(hashes)


def test_jaccard_join_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    sets = {i: grams(t, 3) for i, t in rows}
    heads = {}
    for i in sorted(sets):
        heads.setdefault(sets[i], i)
    want = {(heads[s], i): len(s) for i, s in sets.items() if s and heads[s] != i}
    reps = sorted(i for s, i in heads.items() if s)
    for n, a in enumerate(reps):
        for b in reps[n + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 2 * o >= len(sets[a] | sets[b]):
                want[a, b] = o
    got = {(r.doc_id, r.match_id): r.overlap for r in ngram_join.jaccard_join(table(spark, SF, "documents")).collect()}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_divide_skip_on_dense_overlaps(spark, threshold):
    random = np.random.default_rng(3)
    rows = [(i, " ".join(random.choice(list("abcdefgh"), size=random.integers(1, 9)))) for i in range(60)]
    sets = {i: grams(t, 2) for i, t in rows}
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), n=2, threshold=threshold).collect()
    heads = {}
    for i in sorted(sets):
        heads.setdefault(sets[i], i)
    reps = sorted(heads.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    assert {(r.doc_id, r.match_id) for r in got if r.jaccard < 1 or sets[r.doc_id] != sets[r.match_id]} == want


def test_all_pairs_match_brute_force(spark):
    documents = table(spark, SF, "documents")
    texts = [r.text for r in documents.collect()]
    texts = texts[:120] + [t for t in texts[:6] for _ in range(7)] + [texts[0] + " and a tail"] * 3
    sets = [grams(t, 3) for t in texts]
    want = sorted((a, b, len(x & y)) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and x & y and 2 * len(x & y) >= len(x | y))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (3, ngram_join.BLOCK):
        got = ngram_join.all_pairs(rows, block=block).collect()
        assert sorted((r.doc_id, r.match_id, r.overlap) for r in got) == want
        assert all(r.jaccard == r.overlap / len(sets[r.doc_id] | sets[r.match_id]) for r in got)
    # Copies that are no heads meet each other, and near copies of their class.
    assert (121, 122, len(sets[0])) in want and any(a == 121 and b >= len(texts) - 3 for a, b, _ in want)


def test_all_pairs_on_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.match_id) for r in ngram_join.all_pairs(odd).collect()), key=str)
    assert got == sorted([(1, 1), (1, 2), (1, 2), (1, None), (1, None), (2, None), (6, 7), (8, 9)], key=str)
    assert ngram_join.all_pairs(odd.limit(0)).count() == 0


def test_linked_matches_brute_force(spark):
    texts = lined(90) + ["just one", "just one", "no match to be found", "", None, " ?! "]
    sets = [grams(t, 3) for t in texts]
    near = [[b for b, y in enumerate(sets) if a != b and x & y and 2 * len(x & y) >= len(x | y)] for a, x in enumerate(sets)]
    team = list(range(len(texts)))
    for _ in texts:
        team = [min([team[a], *(team[b] for b in near[a])]) for a in range(len(texts))]
    got = sorted(map(tuple, ngram_join.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    # A row a document, though there are more links.
    assert got == [(a, team[a], len(near[a])) for a in range(len(texts))] and sum(map(len, near)) > 2 * len(texts)


def test_linked_on_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.class_id, r.links) for r in ngram_join.linked(odd).collect()), key=str)
    assert got == sorted([(1, 1, 3), (1, 1, 3), (2, 1, 3), (None, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (None, None, 0), (8, 8, 1), (9, 8, 1)], key=str)
    assert ngram_join.linked(odd.limit(0)).count() == 0


def test_ngram_pairs_agree_with_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(db.execute(queries.OP3_SQL).fetchall())
    assert sorted(map(tuple, queries.op3_ngram_join(spark, SF).collect())) == want and len(want) > 5


def test_chains_agree_for_any_number_of_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    few, many = (sorted(map(tuple, ngram_join.chains(edges, n).collect())) for n in (10**6, 0))
    assert few == many and {c for _, c in few} == {0, 100}


def lined(documents, lines=9, of=6):
    """Texts of some lines of a small pool: one chain, and many pairs that match."""
    random = np.random.default_rng(11)
    pool = [" ".join(f"p{i}w{j}" for j in range(9)) for i in range(lines)]
    return [" ".join(pool[k] for k in random.permutation(lines)[: random.integers(2, of + 1)]) + f" tail{i % 40}" for i in range(documents)]


def test_a_large_chain_is_searched_by_blocks(spark, monkeypatch):
    texts = lined(90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [grams(t, 3) for t in texts]
    want = sorted((a, b, len(x & y)) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and x & y and 2 * len(x & y) >= len(x | y))
    kept = sorted(r.doc_id for r in ngram_join.keep_one(docs).collect())
    whole = ngram_join.shared_out
    monkeypatch.setattr(ngram_join, "shared_out", lambda packed, label: whole(packed, label, postings=400, classes=20))
    _, work = ngram_join.grouped(docs, 3, 0.5, "doc_id", "text")
    groups = work.groupBy("part", "lo", "hi").count().collect()
    classes = len(set(sets))
    # No task holds the chain; all its blocks meet, each two once.
    blocks = max(r.hi for r in groups) + 1
    assert blocks > 2 and len([r for r in groups if r.lo >= 0]) == blocks * (blocks + 1) // 2 and max(r["count"] for r in groups) < classes * 0.8
    assert sorted((r.doc_id, r.match_id, r.overlap) for r in ngram_join.all_pairs(docs).collect()) == want and len(want) > 100
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == kept and len(kept) < len(texts)


def test_near_duplicates_on_odd_rows(spark, odd):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in cols(kept).collect())
    assert [(n, i) for n, i, _ in ids] == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 8), (True, 0)]
    pairs = {(r.doc_id, r.match_id) for r in ngram_join.jaccard_join(odd).collect()}
    assert pairs == {(1, 1), (1, 2), (1, None), (6, 7), (8, 9)}
    assert ngram_join.keep_one(odd.limit(0)).count() == 0 and ngram_join.jaccard_join(odd.limit(0)).count() == 0


def repeats(rows, length):
    seen, out = {}, []
    for i, text in sorted(rows):
        w, spans = (text or "").split(), []
        for j in range(len(w) - length + 1):
            k = tuple(w[j : j + length])
            first = seen.setdefault(k, (i, j))
            if first != (i, j) and (first[0] != i or j >= first[1] + length):
                if spans and j <= spans[-1][2]:
                    spans[-1][2], spans[-1][3] = j + length, min(spans[-1][3], first[0])
                else:
                    spans.append([i, j, j + length, first[0]])
        out += spans
    return sorted(map(tuple, out))


@pytest.mark.parametrize("length,gram", [(50, 8), (6, 3), (4, 1)])
def test_repeated_spans_match_brute_force(spark, length, gram):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows += [(10_001, "tick " * 40), (10_002, "a b " * 30), (10_003, "tick " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in suffix_dedup.repeated_spans(docs, length, gram).collect())
    assert got == repeats(rows, length)


def test_mergesort_by_hashes():
    random = np.random.default_rng(1)
    words = random.integers(0, 3, 4000).astype(np.uint64)
    s = suffix_dedup.Suffixes(words, 7)
    items = random.permutation(3900)
    start, count = np.array([0, 1000, 1001, 2500]), np.array([1000, 1, 1499, 1400])
    done = s.sort(items, start, count)
    for a, n in zip(start, count):
        want = sorted(items[a : a + n].tolist(), key=lambda i: tuple(words[i : i + 7]))
        assert done[a : a + n].tolist() == want  # stable


def test_collisions_are_verified(monkeypatch):
    """All hashes collide: repeats are found by their words, those behind a collision too."""
    monkeypatch.setattr(textnp, "mix64", lambda x: x & np.uint64(1) if x.dtype == np.uint64 else x)
    heads = np.array([[5, i, i, 0, 1, 0, 1] for i in range(5)], dtype=np.int64)
    found = suffix_dedup.repeats(heads, b"a b c\nx y z\na b c\nx y z\nq q q\n", 3)
    assert [x.tolist() for x in found] == [[2, 3], [0, 0], [3, 3], [0, 1]]


def test_spans_on_odd_rows(spark, odd):
    got = sorted(map(tuple, suffix_dedup.repeated_spans(odd, length=10, gram=3).collect()), key=str)
    assert got == sorted([(1, 0, 12, 12, None), (2, 0, 12, 12, None), (7, 0, 60_000, 60_000, 6)], key=str)
    assert suffix_dedup.repeated_spans(odd.limit(0)).count() == 0


def test_passages_on_odd_rows(spark, odd):
    new = suffix_dedup.remove_repeats(odd, length=10, gram=3)
    assert new.columns == odd.columns
    left = {(r.doc_id, r.text, r.n_chars) for r in take(new, doc_id="doc_id", text="text", n_chars="n_chars").collect()}
    # The null id comes first and keeps its text whole; what repeats it leaves 0 words and goes; of 7 only the new word stays.
    assert sorted(i for i, _, _ in left if i is not None) == [3, 4, 5, 6, 7, 8, 9]
    assert ("tail", 4) in {(t, n) for i, t, n in left if i == 7}
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def longest(words, items):
    """(end, length) of the longest stretch of some item that ends at each word."""
    subs = {tuple(it[a:b]) for it in items for a in range(len(it)) for b in range(a + 1, len(it) + 1)}
    lengths = [max((n for n in range(1, e + 1) if tuple(words[e - n : e]) in subs), default=0) for e in range(1, len(words) + 1)]
    return [(e, n) for e, n in enumerate(lengths, 1) if n]


def leaking(words, items, limits):
    """(start, end, words of the item, number of the item) of what leaks and lies in no other such stretch, by trying all stretches."""
    found = {}
    for a in range(len(words)):
        for b in range(a + 1, len(words) + 1):
            for number, it in enumerate(items):
                n, size = b - a, len(it)
                enough = n >= limits[0] or (n >= limits[1] * size and n >= min(limits[2], size))
                if enough and any(it[j : j + n] == words[a:b] for j in range(size - n + 1)):
                    found[a, b] = min(found.get((a, b), (99, 99)), (size, number))
    return sorted((a, b, *who) for (a, b), who in found.items() if not any(c <= a and b <= d and (c, d) != (a, b) for c, d in found))


def test_automaton_matches_brute_force():
    random = np.random.default_rng(5)
    for limits in [(5, 0.6, 3), (4, 0.3, 9), (9, 1.0, 1)] * 15:
        items = [random.integers(0, 3, random.integers(1, 9)).tolist() for _ in range(4)]
        words = random.integers(0, 4, 30).tolist()
        a = decontaminate.SuffixAutomaton(list(enumerate(items)))
        got = list(a.stretches(words))
        assert [(e, n) for e, n, _ in got] == longest(words, items)
        for e, n, state in got:
            inside = [(len(it), i) for i, it in enumerate(items) if any(it[j : j + n] == words[e - n : e] for j in range(len(it)))]
            assert a.item[state] == min(inside)
        a.limit(lambda n: decontaminate.needs(n, *limits))
        assert [(x, y, *a.item[state]) for x, y, state in a.leaking(words)] == leaking(words, items, limits)


@pytest.mark.parametrize("part_words", [7, 10**6])
def test_leaks_match_brute_force_in_any_number_of_parts(spark, part_words):
    """Items of one word up to many, over several parts."""
    random = np.random.default_rng(8)
    for least, limits in [(1, (6, 0.6, 3)), (2, (5, 0.5, 4)), (3, (4, 0.6, 3))]:
        items = [random.integers(0, 5, random.integers(least, 10)).tolist() for _ in range(9)]
        docs = [random.integers(0, 6, random.integers(0, 25)).tolist() for _ in range(30)]
        frame = lambda rows, name: spark.createDataFrame([(i, " ".join(f"w{x}" for x in r)) for i, r in enumerate(rows)], f"{name} long, text string")
        got = sorted(map(tuple, decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id"), *limits, part_words=part_words).collect()))
        want = sorted((d, a, b, b - a, who) for d, words in enumerate(docs) for a, b, _, who in leaking(words, items, limits))
        assert got == want and got


def test_leaks_agree_with_their_sql_on_short_items(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    items = spark.createDataFrame([(1, "what is the capital of france"), (2, "tell me: what is the capital of france and of no other country in the whole wide world"), (3, "Paris!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So what is the capital of France, I ask"), (2, "is the capital of france"), (3, "paris, paris"), (4, "ask: What is the capital of France and of no country")], "doc_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated(docs, items, min_words=10, min_cover=0.6, cover_words=8).collect()))
    assert got == [(1, 1, 7, 6, 1), (3, 0, 1, 1, 3), (3, 1, 2, 1, 3), (4, 1, 10, 9, 2)] or got == [(1, 1, 7, 6, 1), (3, 0, 1, 1, 3), (3, 1, 2, 1, 3), (4, 1, 7, 6, 1)]
    db = duckdb.connect()
    for name, df in (("benchmark", items), ("documents", docs)):
        db.register(name, df.toArrow())
    assert sorted(db.execute(queries.OP4_SQL).fetchall()) == got


def test_contamination_limits(spark):
    docs = spark.createDataFrame([(1, "so: The QUICK brown fox jumps over a lazy dog today"), (2, "quick brown fox"), (3, "alpha beta gamma delta"), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the quick brown fox jumps, over a lazy dog!"), (2, "alpha beta gamma delta epsilon"), (3, None), (None, "")], "item_id long, text string")
    found = sorted(map(tuple, decontaminate.contaminated(docs, bench, min_words=5, min_cover=0.8, cover_words=4).collect()))
    assert found == [(1, 1, 10, 9, 1), (3, 0, 4, 4, 2)]
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, 5, 0.8, 4).collect()}
    assert clean == {1: "so: today", 2: "quick brown fox", 4: None, 5: ""}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_on_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    new = decontaminate.decontaminate(odd, bench)
    assert new.columns == odd.columns
    assert sorted(r.text for r in cols(new).where("doc_id in (1, 2)").collect()) == ["one two "] * 3 and new.count() == odd.count()


def unigram_model() -> bytes:
    """A small unigram model file, made by hand."""
    import struct

    def field(number, kind, payload):
        return bytes([number << 3 | kind]) + payload

    def text(number, raw):
        return field(number, 2, bytes([len(raw)]) + raw)

    out = b""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -2.0, 1), ("▁hello", -3.0, 1), ("▁world", -3.5, 1), ("lo", -4.0, 1), ("l", -5.0, 1), ("o", -5.1, 1), ("▁h", -4.5, 1), ("e", -5.2, 1), ("▁w", -6.0, 1)]
    for piece, score, kind in pieces:
        body = text(1, piece.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        out += text(1, body)
    trainer = field(3, 0, b"\x01") + bytes([35 << 3 & 127 | 128, 2]) + b"\x01"
    return out + text(2, trainer) + text(3, field(3, 0, b"\x01") + field(4, 0, b"\x00"))


@pytest.mark.parametrize("unigram", [False, True])
def test_codec_has_the_ids_of_sentencepiece(unigram):
    import sentencepiece

    raw = unigram_model() if unigram else open(sentencepiece_codec.MODEL, "rb").read()
    codec, full = sentencepiece_codec.Codec(raw), sentencepiece_codec.build(sentencepiece_codec.parse(raw))
    reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["", "hello world", "  hello   hello\n\tworld é ﬁ ", "日本語 😀 hello", " ", "   ", "lolo " * 300, "<s> </s>" if unigram else "<s> </s> <0x41>", "a▁b", None]
    ids, counts, exact, parity = codec.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends, counts):
        want = reference.encode(t or "")
        assert ids[e - n : e].tolist() == want == full.encode(t or "", add_special_tokens=False).ids, t
        assert full.decode(want) == (t or "").replace("▁", " ")
    assert exact.all() and parity.all()


def test_encoding_round_trip(spark, odd):
    encoded = sentencepiece_codec.encode(odd).cache()
    assert encoded.count() == odd.count() and encoded.where("not exact or not parity").count() == 0
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in sentencepiece_codec.decode(encoded).collect())
    assert back == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in cols(odd).collect())
    assert sentencepiece_codec.encode(odd.limit(0)).count() == 0


def test_a_piece_beyond_white_space_is_refused():
    with pytest.raises(ValueError):
        sentencepiece_codec.parse(b"\x0a\x07\x0a\x05a\xe2\x96\x81b")


def test_a_user_piece_beyond_white_space_is_refused():
    with pytest.raises(ValueError):
        sentencepiece_codec.parse(b"\x0a\x09\x0a\x05a\xe2\x96\x81b\x18\x04")


def test_parity_of_words_of_spaces_is_looked_at():
    codec = sentencepiece_codec.Codec(unigram_model())
    real, texts = codec.reference, pa.array(["hello", "hello ", "hello   ", "   ", " "])
    assert codec.encode(texts)[3].all()

    class Other:
        def encode(self, x, **options):
            return [0] if isinstance(x, str) and x != "a" else real.encode(x, **options)

    codec.clear()
    codec.reference = Other()
    assert codec.encode(texts)[3].tolist() == [True, False, False, False, False]


def test_quality_keeps_good_text(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = importance.select(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), importance.F.col("doc_id") == importance.F.col("id"))
    share = {(r.quality, r.toxic): r.kept for r in got.groupBy("quality", "toxic").agg(importance.F.avg(importance.F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1, 0] > 0.95 and share[0, 0] < 0.05 and share[1, 1] < 0.4


def test_quality_is_the_exact_top_k(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = importance.select(docs, labels, fraction=0.6).collect()
    kept = sorted(r.score for r in rows if r.kept)
    assert len(kept) == 120 and kept[0] >= max(r.score for r in rows if not r.kept) - 1 / importance.STEPS


def plain_weights(texts, good, smooth=0.5, sure=1.0, standard=1000.0, prior=20):
    """Log weights by counting the n-grams themselves."""
    import math
    from collections import Counter

    lists = []
    for t in texts:
        w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+|[^\sa-z0-9\x80-\U0010ffff]+", (t or "").lower())
        lists.append(w + [("same",) if a == b else (a, b) for a, b in zip(w, w[1:])])
    raw = Counter(g for x in lists for g in x)
    target = Counter(g for i, x in enumerate(lists) if i in good for g in x)
    part = sum(target.values()) / sum(raw.values())

    def ratio(g):
        t, e = target[g] + smooth, raw[g] * part + smooth
        r, doubt = math.log(t / e), sure * math.sqrt(1 / t + 1 / e)
        return math.copysign(max(abs(r) - doubt, 0), r)

    return [sum(map(ratio, x)) * standard / (len(x) + prior) for x in lists]


def test_weights_match_brute_force(spark):
    """Good and bad text of few words, so that no two n-grams share a bucket."""
    random = np.random.default_rng(9)
    fine, bad = "the of and river stone, quiet".split(), "BUY now!! win cash the, of".split()
    texts = [" ".join(random.choice(bad if i % 3 == 0 else fine, size=random.integers(0, 120))) for i in range(60)] + ["so so so so", "", None, "é!é?"]
    good = {i for i in range(60) if i % 3}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.log_weight for r in importance.weights(docs, labels)[0].collect()}
    want = plain_weights(texts, good)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4, abs=1e-4)
    assert max(want) > 50 and min(want) < -50  # what the target prefers counts as well


def test_counts_add_up_in_two_rounds(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    few, many = (sorted((r.row, r.log_weight) for r in importance.weights(d, labels)[0].collect()) for d in (docs, docs.repartition(70)))
    assert few == many


def test_the_kept_share_is_that_of_all_labels(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    assert importance.weights(docs, labels, max_labels=3)[1] == 0.87
    assert importance.select(docs, labels, max_labels=3).where("kept").count() == 174


def test_quality_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 1, 0), (8, 0, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    kept = importance.keep_good(odd, labels, fraction=1.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert importance.classify(odd.limit(0), labels).count() == 0
    assert importance.classify(odd, labels.limit(0)).count() == odd.count()
    assert importance.classify(odd, labels, fraction=0.0).count() == 0


def test_languages_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language_id.train(train, per_language=200)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = language_id.identify(test, model).join(test.select("doc_id", "lang"), "doc_id")
    assert got.where("language = lang").count() > 0.97 * test.count()


def test_languages_are_learnt_from_whole_texts(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").where("lang in ('de', 'en') and length(text) > 300").orderBy("doc_id").limit(200).collect()
    head = "Terms of use, all rights reserved. " * 200  # the same in each text
    rows = [(r.doc_id, head + r.text * 40, r.lang) for r in docs[:100]]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs[100:]], "doc_id long, text string, lang string")
    got = language_id.identify(test, model).join(test.select("doc_id", "lang"), "doc_id")
    assert got.where("language = lang").count() > 0.95 * test.count() and test.select("lang").distinct().count() == 2


def test_scores_are_means_of_weights():
    random = np.random.default_rng(2)
    weights = random.normal(size=(1 << language_id.BITS, 3))
    texts = ["abc", "", "é", "x", "hello there"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = language_id.sums(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, weights)
    for t, row in zip(raw, got):
        alone = [h for _, _, h in language_id.grams(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))]
        all_ = np.concatenate(alone)
        assert row == pytest.approx(weights[all_].mean(axis=0) if len(all_) else np.zeros(3))


def test_votes_match_brute_force():
    """Families and one-versus-one wins by counting grams and machines one by one, ties included."""
    random = np.random.default_rng(3)
    texts = [bytes(random.integers(97, 104, random.integers(1, 60)).astype(np.uint8)) for _ in range(90)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    names = ["da", "de", "en", "es", "fr", "it", "xx"]
    model = language_id.Hierarchy(language_id.vectors(*language_id.counted(pa.array([t.decode() for t in texts]))), [names[i % 7] for i in range(90)])

    def bucket(gram):
        h = (int.from_bytes(gram, "big") + (len(gram) << 24)) * 2654435761 % 2**32
        return (h ^ h >> 15) * 2246822519 % 2**32 >> 18

    families = {"germanic": names[:3], "romance": names[3:6], "xx": ["xx"]}
    assert model.members == families
    for shift in (0.0, None):  # None: all machines undecided
        if shift is None:
            model.table, model.bias = model.table * 0, model.bias * 0
        got = model.predict(data, offsets)
        for t, family, language in zip(texts, got[0], got[1]):
            grams = [bucket(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]
            out = lambda c: sum(model.table[g, c] for g in grams) / len(grams) + model.bias[c]  # noqa: B023, E731
            best = max(range(3), key=lambda i: (round(out(model.of_family[i]), 9), -i))
            assert family == sorted(families)[best]
            mine = families[family]
            wins, sums = dict.fromkeys(mine, 0), dict.fromkeys(mine, 0.0)
            for i, j, c in model.pairs[family]:
                s = out(c)
                wins[mine[i] if s >= 0 else mine[j]] += 1
                sums[mine[i]] += s
                sums[mine[j]] -= s
            assert language == max(mine, key=lambda m: (wins[m], round(sums[m], 9), -mine.index(m)))
    assert language_id.family_of("pt-BR") == "romance" and language_id.family_of("tlh") == "tlh" and language_id.family_of("tlh", {"klingon": ("tlh",)}) == "klingon"


def test_machines_reach_the_least_loss():
    """The primal objective against that of projected gradient ascent on the dual."""
    random = np.random.default_rng(1)
    x = random.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * random.normal(size=60) > 0, 1.0, -1.0)
    wide = np.hstack([x, np.ones((60, 1))])
    gram = (wide @ wide.T) * np.outer(y, y)
    alpha, step = np.zeros(60), 1 / np.linalg.norm(gram, 2)
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, 1)
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (wide @ w)).sum()
    best = loss((alpha * y) @ wide)
    assert loss(language_id.train_svm(x, y, rounds=200).astype(float)) < best * 1.01 and loss(language_id.train_svm(x, y).astype(float)) < best * 1.2


def test_language_on_odd_rows(spark, odd):
    model = language_id.train(odd.toDF(*[f"x{i}" for i in range(len(odd.columns))]).selectExpr("x1 AS text", "x2 AS lang"))
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == odd.count() and {r.language for r in rows} == {"en", "de", "und"}
    none = language_id.identify(odd, language_id.Hierarchy([], [])).collect()
    assert {r.language for r in none} == {"und"}
