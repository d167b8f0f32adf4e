"""Vectorised text primitives shared by the text operators.

Everything works on the raw UTF-8 buffers of an Arrow string column: words are
byte spans, word identities are 64-bit hashes, and n-grams and windows are
derived from prefix sums, so no per-word Python object is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
#: Odd multipliers of the byte and the word polynomials, with their inverses modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
#: Text bytes that one vectorised step looks at (a longer document is one step).
STEP_BYTES = 1 << 20
#: Documents of a step at most: their numbers fit into 16 bits.
STEP_DOCS = 60_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and the inverse powers, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """S with S[i] = sum of values[j] * base**j for j < i (modulo 2**64)."""
    p, _ = powers(base, max(1, len(values)))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The hash of values[start:end], wherever it stands."""
    _, inv = powers(base, max(1, len(prefix)))
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * inv[start]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    raw = np.frombuffer(column.buffers()[1] or b"", dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(raw) == 0:
        raw = np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[raw[0] : raw[-1]]
    return data, raw - raw[0]


def _table(inside) -> np.ndarray:
    return np.array([inside(c) for c in range(256)], dtype=bool)


#: Word bytes: ASCII letters and digits and every byte of a multi-byte character.
WORD_BYTE = _table(lambda c: c >= 128 or chr(c).isalnum())
#: Bytes that are not ASCII white space.
SOLID_BYTE = _table(lambda c: c not in b" \t\n\r\x0b\x0c")

#: Word bytes and, with "punct", runs of other solid bytes, by kind.
KINDS = {"norm": WORD_BYTE.astype(np.uint8), "solid": SOLID_BYTE.astype(np.uint8), "punct": np.where(WORD_BYTE, 1, np.where(SOLID_BYTE, 2, 0)).astype(np.uint8)}


class Words:
    """The words of several documents: runs of letters and digits ("norm"), of these or of punctuation ("punct"), or of anything but white space ("solid").

    start, end: byte spans in `data`; doc: the document's number; first: n+1
    offsets of each document's words; hash: 64-bit identities.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str = "norm", hashed: bool = True):
        inside = KINDS[kind][data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[offsets] = True
        cut = np.flatnonzero(edge)
        keep = inside[cut[:-1]] > 0 if len(data) else np.zeros(0, dtype=bool)
        self.data, self.offsets = data, offsets
        self.start = cut[:-1][keep] if len(data) else np.zeros(0, dtype=np.int64)
        self.end = cut[1:][keep] if len(data) else np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = mix64(span_hash(prefix_hash(_BYTE_VALUE[data], BYTE_BASE), self.start, self.end, BYTE_BASE)) if hashed else None

    def __len__(self) -> int:
        return len(self.start)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of every n-gram that lies within one document."""
        if len(self) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        m = len(self) - n + 1
        with np.errstate(over="ignore"):
            h = np.zeros(m, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(WORD_BASE) + self.hash[j : j + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, mix64(h[at])


def steps(column: pa.Array, kind: str = "norm", lower: bool = True, limit: int = STEP_BYTES, hashed: bool = True):
    """Yields (number of the first document, Words) over runs of documents of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if lower:
        column = pc.utf8_lower(column)
    data, offsets = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column), lo + STEP_DOCS)
        yield lo, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], kind, hashed)
        lo = hi


class WordSpans:
    """start, end, first and hash like Words, of many documents: made step by step, so that little is held besides."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str, limit: int = STEP_BYTES):
        start, end, first, hashes = [], [], [np.zeros(1, dtype=np.int64)], []
        lo = words = 0
        while lo < len(offsets) - 1:
            hi = min(len(offsets) - 1, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1))
            part = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], kind)
            start.append(part.start + offsets[lo])
            end.append(part.end + offsets[lo])
            hashes.append(part.hash)
            first.append(part.first[1:] + words)
            words += len(part)
            lo = hi
        none = [np.zeros(0, dtype=np.int64)]
        self.start, self.end, self.first = np.concatenate(start or none), np.concatenate(end or none), np.concatenate(first)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)

    def __len__(self) -> int:
        return len(self.start)
