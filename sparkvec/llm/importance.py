"""Quality classifier by importance resampling of hashed n-grams.

Two generative models over hashed word unigrams and bigrams are counted: one of
the target text (labelled documents of good quality that are not toxic) and one
of the raw text (all documents). The target model is smoothed towards the raw
one, so that a bucket with e expected and t seen target n-grams has the ratio
(t + s) / (e + s). The logarithm of the ratio is drawn towards 0 by `sure` standard
errors of it, so rare n-grams count as neutral, and both what the target prefers and what it avoids counts by what is certain.
A document's log importance weight is the sum of the log ratios of its n-grams, scaled to a
document of `standard` n-grams, so that long and short documents compare. The
documents to keep are drawn without replacement in proportion to their weights
by Gumbel top-k: Gumbel noise, a function of the row, is added to each log weight
and the k largest sums stay.

Both models have a fixed number of buckets, whatever the input. The labels are
read up to `max_labels` rows (least hashes of doc_id first) to fit the models; the
share to keep is that of all labels, and every other count covers all documents.
Tasks send their counts in pieces, which are added up in two rounds, so that no task
adds more than about the square root of their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm import textnp
from sparkvec.llm.common import longs, numbered, place, row_id, sized, stored, take, tidy_batches

BITS = 20
MAX_LABELS = 500_000
#: Log weights are ordered with this many steps to one.
STEPS = 1 << 10
#: Buckets that are sent and added up together.
PIECE = 1 << 12
#: N-grams of average target text that are added to every document: short ones have less to show.
PRIOR = 20


def features(words: textnp.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket) of each unigram and bigram; all bigrams of one word twice are one."""
    at, h2 = words.ngrams(2)
    h2[words.hash[at] == words.hash[at + 1]] = np.uint64(0x5851F42D4C957F2D)
    shift = np.uint64(64 - BITS)
    one = (words.hash >> shift).astype(np.int64)
    two = (textnp.mix64(h2 ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> shift).astype(np.int64)
    return np.concatenate([words.doc, words.doc[at]]), np.concatenate([one, two])


def _count(batches):
    from pyspark import TaskContext

    raw, target = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    seen = False
    for batch in batches:
        good = longs(batch.column("good")) > 0
        for lo, words in textnp.steps(batch.column("text"), "punct"):
            seen = True
            doc, bucket = features(words)
            raw += np.bincount(bucket, minlength=len(raw))
            mine = good[lo + doc]
            if mine.any():
                target += np.bincount(bucket[mine], minlength=len(raw))
    if not seen:
        return
    # Counts leave in pieces of the bucket range, which are added up apart from each other.
    at = np.arange(0, len(raw), PIECE)
    task = np.full(len(at), TaskContext.get().partitionId(), dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array((at // PIECE).astype(np.int32)), pa.array(task), *[pa.array([c[i : i + PIECE].tobytes() for i in at], pa.binary()) for c in (raw, target)]], names=["piece", "task", "raw", "target"])


def _add(table: pa.Table) -> pa.Table:
    out = {"piece": table.column("piece").slice(0, 1), "task": table.column("task").slice(0, 1)}
    for name in ("raw", "target"):
        out[name] = pa.array([sum(np.frombuffer(x, dtype=np.int64) for x in table.column(name).to_pylist()).tobytes()], pa.binary())
    return pa.table(out)


def log_ratios(raw: np.ndarray, target: np.ndarray, smooth: float, sure: float) -> np.ndarray:
    """The log ratio of the target model to the raw model by bucket, `sure` standard errors nearer to 0."""
    total, good = raw.sum(), target.sum()
    if not good or not total:
        return np.zeros(len(raw), dtype=np.float32)
    expected = raw * (good / total)
    ratio = np.log((target + smooth) / (expected + smooth))
    doubt = sure * np.sqrt(1 / (target + smooth) + 1 / (expected + smooth))
    return (np.sign(ratio) * np.maximum(np.abs(ratio) - doubt, 0)).astype(np.float32)


def _weigh(ratio: np.ndarray, standard: float):
    def work(batches):
        for batch in batches:
            rows = longs(batch.column("row"))
            weight = np.zeros(len(rows))
            for lo, words in textnp.steps(batch.column("text"), "punct"):
                doc, bucket = features(words)
                docs = len(words.offsets) - 1
                total = np.bincount(doc, weights=ratio[bucket], minlength=docs)
                weight[lo : lo + docs] = total * (standard / (np.bincount(doc, minlength=docs) + PRIOR))
            # Noise from the row alone: another attempt of this task draws the same.
            u = ((textnp.mix64(rows.view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("key"), pa.array(weight), pa.array(-np.log(-np.log(u)))], names=["row", "doc_id", "log_weight", "noise"])

    return work


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counting in ever finer buckets; None if there are fewer rows."""
    lo, hi = -(1 << 63), (1 << 63) - 1
    while lo < hi:
        width = max(1, -(-(hi - lo + 1) // 4096))
        inside = df.where(F.col(column).between(lo, hi))
        # Offsets from lo stay exact as decimals, whatever the width.
        bucket = F.floor((F.col(column).cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).cast("long")
        counts = {r[0]: r[1] for r in inside.groupBy(bucket.alias("b")).count().collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= counts[b]
        else:
            return None
    return lo


def weights(docs: DataFrame, labels: DataFrame, smooth: float = 0.5, sure: float = 1.0, standard: float = 1000.0, max_labels: int = MAX_LABELS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, float]:
    """(row, doc_id, log_weight, noise of each row of docs, share of good documents among the labels)."""
    spark = docs.sparkSession
    known = take(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    good = (F.col("quality") > 0) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = known.select(F.col("doc_id").cast("long").alias("id"), good.cast("int").alias("good")).where("id is not null and good is not null")
    known = stored(known.groupBy("id").agg(F.min("good").alias("good")), "labels")
    share = known.agg(F.avg("good")).first()[0]  # of all labels; only the models are fitted to at most max_labels
    known = stored(known.orderBy(F.xxhash64("id")).limit(max_labels), "fitted")
    own = take(docs, key=key, text=text).withColumn("key", F.col("key").cast("long"))
    marked = own.join(sized(known.where("good = 1").select("id", "good"), 64 << 20), F.col("key") == F.col("id"), "left")
    kind = "piece int, task long, raw binary, target binary"
    counted = marked.select("text", "good").mapInArrow(tidy_batches(_count), kind)
    teams = int(np.ceil(np.sqrt(max(1, marked.rdd.getNumPartitions()))))
    if teams > 8:
        counted = counted.withColumn("task", F.pmod("task", F.lit(teams))).groupBy("piece", "task").applyInArrow(_add, kind)
    pieces = counted.groupBy("piece").applyInArrow(_add, kind).collect()
    raw, target = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    for p in pieces:  # a fixed number of pieces, whatever the input
        at = p.piece * PIECE
        raw[at : at + PIECE] = np.frombuffer(p.raw, dtype=np.int64)
        target[at : at + PIECE] = np.frombuffer(p.target, dtype=np.int64)
    ratio = log_ratios(raw, target, smooth, sure)
    scored = own.withColumn("row", row_id(own, "key", "text")).mapInArrow(tidy_batches(_weigh(ratio, standard)), "row long, doc_id long, log_weight double, noise double")
    return stored(scored, "weights"), 1.0 if share is None else share


def select(docs: DataFrame, labels: DataFrame, fraction: float | None = None, smooth: float = 0.5, sure: float = 1.0, standard: float = 1000.0, temperature: float = 1.0, max_labels: int = MAX_LABELS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, log_weight, score, kept of each row of docs (stored).

    kept: the row is among the k largest scores, with k = fraction of all rows
    (rounded up; by default the share of good documents among the labels). The
    score is log_weight / temperature plus Gumbel noise; scores are ordered in steps of 1/1024, then by 30 bits of
    the row, and rows that tie in both stay or go together. Rows repeated with doc_id and text have one score and one fate too,
    so where the k-th score is theirs more than k rows stay.
    Null and empty texts have the log weight 0, that of average raw text; a very long text counts as a whole.
    Without any labelled target document all weights are equal. Null ids stay null.
    """
    scored, share = weights(docs, labels, smooth, sure, standard, max_labels, key, text)
    scored = scored.withColumn("score", F.col("log_weight") / F.lit(temperature) + F.col("noise"))
    clipped = F.greatest(F.lit(-(2.0**20)), F.least(F.lit(2.0**20), F.col("score")))
    order = F.floor(clipped * STEPS).cast("long") * F.lit(1 << 30) + F.pmod(F.col("row"), F.lit(1 << 30))
    scored = scored.withColumn("order", order)
    k = int(np.ceil((share if fraction is None else fraction) * scored.count() - 1e-9))
    least = kth_largest(scored, "order", k) if k else None
    kept = F.lit(k > 0) if least is None else F.col("order") >= F.lit(least)
    return scored.select("row", "doc_id", "log_weight", "score", kept.alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, log_weight, score of the rows of docs that are drawn; see select() for the options and the cases."""
    return select(docs, labels, **options).where("kept").select("doc_id", "log_weight", "score")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    gone = select(docs, labels, key=key, text=text, **options).where("not kept").select("row").distinct()
    names = docs.columns
    whole = numbered(docs)
    whole = whole.withColumn("row", row_id(whole, f"c{place(docs, key)}", f"c{place(docs, text)}"))
    return whole.join(sized(stored(gone, "gone")), "row", "left_anti").drop("row").toDF(*names)
