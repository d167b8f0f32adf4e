"""Language identification by hierarchical discrimination.

First the language family, then, among the closely related languages within it,
one linear support vector machine for each two of them; the language with most
wins is predicted (of equals, the one with the larger sum of margins, then the first by name). Families are
told apart by one linear machine each against the rest.

Features are the shares of the hashed byte 1- to 3-grams of the lower-cased text,
counted over all of it. A machine's output is then the mean of its weights over
a text's grams, so prediction is a table look-up and a segment sum.

Training takes at most `per_language` different texts of each labelled language (least
hashes first), each as a whole: the tasks count the grams, and the counts go to the
driver; this is the only thing that doesn't look at all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvec.llm import textnp
from sparkvec.llm.common import cut, take

#: Families of closely related languages, by the codes that labels may use.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"), "celtic": ("br", "cy", "ga", "gd"), "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"), "iranian": ("fa", "ku", "ps", "tg"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "sd", "si", "ur"), "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"), "malayic": ("fil", "id", "jv", "mg", "ms", "su", "tl"), "bantu": ("ny", "rw", "sn", "st", "sw", "xh", "zu"), "sinitic": ("yue", "zh"),
}
BITS = 14
#: Factor of the shares, which the machines' bias and step sizes are made for.
SCALE = 30.0
UNKNOWN = "und"
STEP_BYTES = 1 << 20


def family_of(language: str, families: dict[str, tuple[str, ...]] | None = None) -> str:
    """The family of a language; a variety ("pt-BR") has that of its language, and a language that no family lists is one of its own."""
    plain = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in (FAMILIES if families is None else families).items() if language in members or plain in members), language)


def grams(data: np.ndarray, offsets: np.ndarray):
    """For n of 1, 2, 3: (first gram of each document, bucket of each n-gram within a document)."""
    code = np.zeros(len(data), dtype=np.uint32)
    size = np.diff(offsets)
    for n in (1, 2, 3):
        code = (code[: max(0, len(data) - n + 1)] << np.uint32(8)) | data[n - 1 :]
        h = (code + np.uint32(n << 24)) * np.uint32(2654435761)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
        count = np.maximum(size - n + 1, 0)
        if n > 1:  # not across documents
            inside = np.ones(len(h) + n, dtype=bool)
            for j in range(1, n):
                cut_at = offsets[1:-1] - j
                inside[cut_at[cut_at >= 0]] = False
            h = h[inside[: len(h)]]
        yield np.cumsum(count) - count, count, h


def sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean row of `table` over all grams of each document; zeros for empty ones."""
    total, number = np.zeros((len(offsets) - 1, table.shape[1])), np.zeros(len(offsets) - 1)
    for first, count, h in grams(data, offsets):
        has = np.flatnonzero(count)
        if len(has):
            total[has] += np.add.reduceat(table[h], first[has], axis=0)
            number += count
    return total / np.maximum(number, 1)[:, None]


def pieces(column: pa.Array):
    """Yields (first document, bytes, offsets) of about STEP_BYTES each, lower-cased."""
    data, offsets = textnp.buffers(pc.utf8_lower(cut(column)))
    lo, docs = 0, len(offsets) - 1
    while lo < docs:
        hi = min(docs, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, side="right")) - 1))
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def counted(column: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """The buckets (uint16) that each whole text has grams in, and how many (int64)."""
    buckets, counts = [], []
    for _, data, offsets in pieces(column):
        keys = [np.repeat(np.arange(len(count)), count) << BITS | h for _, count, h in grams(data, offsets)]
        key, number = np.unique(np.concatenate(keys), return_counts=True)
        ends = np.searchsorted(key, np.arange(len(offsets)) << BITS)
        key = (key & ((1 << BITS) - 1)).astype(np.uint16)
        buckets += [key[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        counts += [number[a:b].astype(np.int64).tobytes() for a, b in zip(ends, ends[1:])]
    return buckets, counts


def vectors(buckets: list[bytes], counts: list[bytes]) -> np.ndarray:
    """Dense feature rows of a few texts, for training, from their counted()."""
    out = np.zeros((len(buckets), 1 << BITS), dtype=np.float32)
    for row, at, number in zip(out, buckets, counts):
        row[np.frombuffer(at, dtype=np.uint16)] = np.frombuffer(number, dtype=np.int64)
    return out / np.maximum(out.sum(axis=1), 1)[:, None] * SCALE


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = 12, c: float = 1.0) -> np.ndarray:
    """Weights and bias of a linear SVM with hinge loss, by dual coordinate descent in a fixed random order."""
    n = len(y)
    x = np.hstack([x, np.ones((n, 1), dtype=np.float32)])
    w, alpha, square = np.zeros(x.shape[1], dtype=np.float32), np.zeros(n), np.einsum("ij,ij->i", x, x)
    random = np.random.default_rng(7)
    for _ in range(rounds):
        for i in random.permutation(n):
            g = y[i] * float(x[i] @ w) - 1
            new = min(c, max(0.0, alpha[i] - g / square[i]))
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class Hierarchy:
    """The trained machines: families against the rest, then pairs of languages within each family."""

    def __init__(self, x: np.ndarray, languages: list[str], families: dict[str, tuple[str, ...]] | None = None):
        lang = np.array(languages, dtype=object)
        family = np.array([family_of(v, families) for v in languages], dtype=object)
        self.families = sorted(set(family))
        self.members = {f: sorted(set(lang[family == f])) for f in self.families}
        columns: list[np.ndarray] = []

        def add(rows: np.ndarray, positive: np.ndarray) -> int:
            columns.append(train_svm(x[rows], np.where(positive[rows], 1.0, -1.0)))
            return len(columns) - 1

        everything = np.arange(len(lang))
        two = len(self.families) == 2
        self.of_family = [add(everything, family == f) for f in self.families[: 1 if two else None]] if len(self.families) > 1 else []
        self.pairs = {f: [(i, j, add(np.flatnonzero((lang == a) | (lang == b)), lang == a)) for i, a in enumerate(m) for j, b in enumerate(m) if i < j] for f, m in self.members.items()}
        weights = np.stack(columns, axis=1).astype(np.float64) if columns else np.zeros(((1 << BITS) + 1, 0))
        self.table, self.bias = weights[:-1] * SCALE, weights[-1]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(family, language, margin of the language's weakest win) of each text."""
        score = sums(data, offsets, self.table) + self.bias
        n = len(offsets) - 1
        if len(self.families) == 2:
            which = np.where(score[:, self.of_family[0]] >= 0, 0, 1)
        elif self.of_family:
            which = np.argmax(score[:, self.of_family], axis=1)
        else:
            which = np.zeros(n, dtype=np.int64)
        language, margin = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        family = np.array(self.families or [UNKNOWN], dtype=object)[which]
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(which == k)
            members = self.members[f]
            wins, total, least = (np.zeros((len(rows), len(members))) for _ in range(3))
            least[:] = np.inf
            for i, j, column in self.pairs[f]:
                s = score[rows, column]
                wins[:, i] += s >= 0
                wins[:, j] += s < 0
                total[:, i] += s
                total[:, j] -= s
                least[:, i] = np.minimum(least[:, i], np.where(s >= 0, s, np.inf))
                least[:, j] = np.minimum(least[:, j], np.where(s < 0, -s, np.inf))
            best = np.argmax(wins + total / (1 + np.abs(total).sum(axis=1, keepdims=True)) * 0.5, axis=1)
            language[rows] = np.array(members, dtype=object)[best]
            got = least[np.arange(len(rows)), best]
            margin[rows] = np.where(np.isfinite(got), got, 0)
        return family, language, margin


def _counted(batches):
    for batch in batches:
        buckets, counts = counted(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("language"), batch.column("h"), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["language", "h", "buckets", "counts"])


def train(docs: DataFrame, per_language: int = 400, text: str = "text", language: str = "lang", families: dict[str, tuple[str, ...]] | None = None) -> Hierarchy:
    """A Hierarchy from labelled rows: at most per_language rows a language, whole texts, whose grams are counted in the tasks; families: instead of FAMILIES."""
    own = take(docs, text=text, language=language).where("language is not null and text is not null and length(text) > 0").withColumn("h", F.xxhash64("text"))
    # The hashes alone are ranked; texts are read again, and only those below the last hash that is taken.
    order = Window.partitionBy("language").orderBy("h")
    limits = own.select("language", "h").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).groupBy("language").agg(F.max("h").alias("last")).collect()
    few = F.coalesce(*[F.when((F.col("language") == r.language) & (F.col("h") <= r.last), True) for r in limits], F.lit(False))
    chosen = own.where(few).select("language", "h", "text").mapInArrow(_counted, "language string, h long, buckets binary, counts binary")
    rows = chosen.groupBy("language", "h").agg(F.min(F.struct("buckets", "counts")).alias("grams")).orderBy("language", "h").collect()
    return Hierarchy(vectors([r.grams.buckets for r in rows], [r.grams.counts for r in rows]), [r.language for r in rows], families)


def _predict(model: Hierarchy):
    def work(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            texts = batch.column("text")
            for _, data, offsets in pieces(texts):
                for held, got in zip(out, model.predict(data, offsets)):
                    held.extend(got.tolist())
            empty = np.asarray(pc.fill_null(pc.binary_length(texts), 0)) == 0
            family = [UNKNOWN if e else f for e, f in zip(empty, out[0])]
            language = [UNKNOWN if e else f for e, f in zip(empty, out[1])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(np.where(empty, 0, out[2]).astype(np.float64))], names=["doc_id", "family", "language", "margin"])

    return work


def identify(docs: DataFrame, model: Hierarchy, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, family, language, margin of every row.

    Null and empty texts are "und" with margin 0; so is everything where no
    language was trained. Null and repeated ids and repeated rows stay as they are, very long texts count as a whole, and other
    columns (the labels too) are ignored. The margin of the only language of a family is 0.
    """
    own = take(docs, key=key, text=text).withColumn("key", F.col("key").cast("long"))
    return own.mapInArrow(_predict(model), "doc_id long, family string, language string, margin double")
