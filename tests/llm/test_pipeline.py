"""The pipeline: each stage's rows and texts against versions of their own, and odd rows through all stages."""

import re

import pytest
from test_text_operators import grams, repeats

import corpus_pipeline
from sparkvec.llm import importance, queries, sentencepiece_codec
from sparkvec.llm.common import STORED, stored, table, take

SF = "/root/testdata/sf0.001"


def without(text, spans, word):
    """text without spans of words and what separates them from the next word."""
    places = [m.start() for m in re.finditer(word, text.lower())] + [len(text)]
    gone = {i for s, e in spans for i in range(places[s], places[e])}
    return "".join(c for i, c in enumerate(text) if i not in gone)


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def cut_rows(before, spans, word):
    """Texts after the cut; those without anything left go."""
    out = {i: without(t, spans[i], word) if i in spans else t for i, t in before.items()}
    return {i: t for i, t in out.items() if i not in spans or t.strip()}


def test_stages_match_brute_force(spark):
    duckdb = pytest.importorskip("duckdb")
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = table(spark, SF, "documents")
    texts = rows_of(docs)
    # Some more documents that share a passage of 70 words.
    good = sorted((r.doc_id for r in table(spark, SF, "labels").collect() if r.quality and not r.toxic and len(texts[r.doc_id].split()) > 230), key=lambda i: len(texts[i]))
    pieces = [texts[i].split() for i in good[:12]]
    passage = " ".join(texts[good[-1]].split()[100:170])
    more = [(10_000 + i, f"{' '.join(p[:60])} {passage} {' '.join(q[-60:])}", "en", "web", 0) for i, (p, q) in enumerate(zip(pieces, pieces[1:]))]
    names, out, whole, schema = docs.columns, {}, docs, docs.schema
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out[name] = docs
        if name == "quality":  # what is added comes behind the draw
            docs = stored(docs.unionByName(spark.createDataFrame(more, schema)), "more")
    assert all(out[n].columns == names for n, _ in corpus_pipeline.STAGES[:-1])
    # quality: as many rows as the labels have good ones, those of the largest scores.
    labels = table(spark, SF, "labels").collect()
    scored = importance.select(whole, table(spark, SF, "labels")).collect()
    share = sum(r.quality > 0 and not r.toxic for r in labels) / len(labels)
    best = sorted(scored, key=lambda r: -r.score)[: -int(-share * len(texts) // 1)]
    kept = rows_of(out["quality"])
    assert kept == {i: texts[i] for i in {r.doc_id for r in best}} and 0 < len(kept) < len(texts)
    kept |= {i: t for i, t, *_ in more}
    # near duplicates: the least id of each group that pairs connect.
    sets, team = {i: grams(t, 3) for i, t in kept.items()}, {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and sets[a] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
                low, high = sorted((team[a], team[b]))
                team = {i: low if t == high else t for i, t in team.items()}
    single = {i: t for i, t in kept.items() if team[i] == i}
    assert rows_of(out["near_duplicates"]) == single and len(single) < len(kept)
    # repeated passages
    spans = {}
    for i, s, e, _ in repeats(single.items(), 50):
        spans.setdefault(i, []).append((s, e))
    fresh = cut_rows(single, spans, r"[^ \t\n\r\x0b\x0c]+")
    assert rows_of(out["repeated_passages"]) == fresh and spans
    # benchmark leaks, by the SQL of op4 over what is left.
    db = duckdb.connect()
    db.register("documents", out["repeated_passages"].toArrow())
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    spans = {}
    for i, s, e, _, _ in db.execute(queries.OP4_SQL).fetchall():
        spans.setdefault(i, []).append((s, e))
    clean = cut_rows(fresh, spans, r"(?:[a-z0-9]|[^\x00-\x7f])+")
    assert rows_of(out["benchmark_leaks"]) == clean and spans
    assert out["benchmark_leaks"].where("n_chars <> length(text)").count() == 0
    # tokens
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = {r.doc_id: list(r.ids) for r in out["tokens"].collect()}
    assert got == {i: model.encode(t) for i, t in clean.items()} and out["tokens"].where("not exact or not parity").count() == 0


def test_odd_rows_through_all_stages(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "a", 0), (3, "some words here", "en", "a", 15), (3, "some words here", "en", "a", 15), (4, long, "en", "a", len(long)), (5, " \n", None, "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS row", "2 AS TEXT2")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    names = docs.columns
    # What quality draws is a matter of the rows' noise: the other stages see all rows.
    drawn = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert drawn.columns == names and 0 < drawn.count() <= len(rows) and drawn.subtract(docs).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
    assert sorted((r.doc_id, len(r.text or "")) for r in take(docs, doc_id="doc_id", text="text").where("doc_id is not null").collect()) == [(1, 0), (2, 0), (3, 15), (4, len(long)), (5, 2)] and docs.count() == 6
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == 6 and last.where("not exact or not parity").count() == 0


def test_run_leaves_nothing_but_its_result(spark):
    before = list(STORED)
    rows = corpus_pipeline.run(spark, SF)
    assert len(STORED) == len(before) + 1 and rows.count() > 0
