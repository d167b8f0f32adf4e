"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed by a small protobuf reader. From it a tokenizers
pipeline is rebuilt: the normaliser (character map, white space rules, dummy
prefix), the metaspace marker, the model (unigram scores, or the merges that a
BPE model's scores stand for), byte fallback, and the decoder.

No piece of a usable model has the marker behind another character (this is
checked), so no token crosses from a word into the white space behind it, and
a text may be cut there without changing its tokens. A task therefore cuts its
texts with numpy, encodes each distinct word once, in multithreaded batches of
the tokenizers library, and looks all others up by hash. Parity is verified for
every document: each distinct word is also encoded by the sentencepiece library
itself, and every document's tokens are decoded and compared with its
normalised text, byte by byte, which would also reveal a hash collision.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparkvec.llm import textnp
from sparkvec.llm.common import cut, list_array, ranges, take, tidy_batches

MODEL = os.environ.get("SPARKVEC_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
STEP_BYTES = 1 << 18


def fields(raw: bytes):
    """(number, value) of a protobuf message; nested messages, strings and packed fields as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            raise ValueError(f"field kind {kind} in the model file")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # extra white space is dropped

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse(raw: bytes) -> Model:
    """The parts of a SentencePiece model file that encoding needs."""
    model = Model([])
    for number, value in fields(raw):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback = spec.get(3, 1), bool(spec.get(35, 0))
            if spec.get(24, 0):
                raise ValueError("models with the white space marker as a suffix are not supported")
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if model.kind not in (1, 2):
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    if any(p[2] in (NORMAL, USER) and MARK in p[0].lstrip(MARK) for p in model.pieces):
        raise ValueError("a piece goes on behind white space; texts can't be cut at it")
    return model


def build(model: Model, normalise: bool = True):
    """A tokenizers.Tokenizer equal to the model; without the normaliser it takes words with markers."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {p[0]: i for i, p in enumerate(model.pieces)}
    if model.kind == 1:
        # Control pieces are no text: under names that no text holds they keep their ids.
        named = [(f"\U0010fffd{p}" if kind in (CONTROL, UNUSED) else p, s) for p, s, kind in model.pieces]
        core = Tokenizer(models.Unigram(named, unk_id=model.unknown, byte_fallback=model.byte_fallback))
    else:
        ranked = []
        usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
        for p, score, kind in model.pieces:
            if kind == NORMAL and len(p) > 1:
                ranked += [(-score, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        ranked.sort()
        core = Tokenizer(models.BPE(ids, [(a, b) for *_, a, b in ranked], unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    if normalise:
        rules = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            rules += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        rules += [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)]
        core.normalizer = normalizers.Sequence(rules)
    core.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    core.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] * model.dummy_prefix)])
    return core


class Codec:
    """Encodes columns of texts; keeps the words that it has met. Without `verify`, parity is not looked at."""

    def __init__(self, raw: bytes, threads: int = 2, keep: int = 1_000_000, verify: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = parse(raw)
        self.core, self.keep, self.verify = build(self.model, False), keep, verify
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.normal = build(self.model).normalizer if self.model.charsmap else None
        pieces = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.piece_size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)  # sorted; start and size follow it
        self.start, self.size, self.equal = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.pool = np.zeros(0, dtype=np.int32)

    def normalised(self, column: pa.Array) -> pa.Array:
        """The texts as the model sees them, with spaces for markers; null as empty."""
        column = pc.fill_null(cut(column), "").cast(pa.large_string())
        if self.normal:
            return pa.array([self.normal.normalize_str(t).replace(MARK, " ") for t in column.to_pylist()], pa.large_string())
        column = pc.replace_substring(column, MARK, " ")
        if self.model.squeeze:
            column = pc.replace_substring_regex(pc.utf8_trim(column, " "), " {2,}", " ")
        if self.model.dummy_prefix:
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        return column

    def _alone(self, word: str) -> tuple[np.ndarray, bool]:
        ids = self.core.encode(word.replace(" ", MARK), add_special_tokens=False).ids
        if word == " " and self.model.dummy_prefix:  # alone it would be the prefix: compared behind a letter
            return np.array(ids, dtype=np.int32), self.reference.encode("a") + ids == self.reference.encode("a ")
        return np.array(ids, dtype=np.int32), ids == self.reference.encode(word[int(self.model.dummy_prefix) :])

    def _tokens(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each word, whether sentencepiece has the same ids) of the words data[start:end]."""
        wide = end - start
        # Words that begin with a space and go on are encoded some hundreds to a text; a token never spans two of them.
        sound = (data[start] == 32) & (data[end - 1] != 32)
        which = np.flatnonzero(sound)
        groups = np.arange(0, len(which), 256)
        size = np.zeros(len(start), dtype=np.int64)
        equal = np.zeros(len(start), dtype=bool)
        flat, pieces = np.zeros(0, dtype=np.int32), {}
        alone = np.flatnonzero(~sound).tolist()
        if len(which):
            w = wide[which]
            raw = data[ranges(start[which], w)].tobytes()
            ends = np.cumsum(w)
            cuts = np.append((ends - w)[groups], ends[-1]).tolist()
            texts = [raw[i:j].decode() for i, j in zip(cuts, cuts[1:])]
            found = [e.ids for e in self.core.encode_batch_fast([t.replace(" ", MARK) for t in texts], add_special_tokens=False)]
            skip = int(self.model.dummy_prefix)
            other = self.reference.encode([t[skip:] for t in texts], num_threads=1) if self.verify else found
            got = [np.array(x, dtype=np.int32) for x in found]
            whole = np.array([int(self.piece_size[x].sum()) for x in got]) == np.diff(cuts)  # unknown tokens have no length
            alike = np.array([a == b for a, b in zip(found, other)])
            fine = np.repeat(whole & alike, np.diff(np.append(groups, len(which))))
            alone += which[~fine].tolist()
            flat = np.concatenate([np.zeros(0, dtype=np.int32), *[x for x, ok in zip(got, whole & alike) if ok]])
            which = which[fine]
            at = np.searchsorted(np.cumsum(self.piece_size[flat]), np.cumsum(wide[which]), side="left") + 1
            size[which] = np.diff(np.concatenate([[0], at]))
            equal[which] = True
        for i in alone:
            pieces[i], equal[i] = self._alone(data[start[i] : end[i]].tobytes().decode())
            size[i] = len(pieces[i])
        ids = np.zeros(int(size.sum()), dtype=np.int32)
        first = np.cumsum(size) - size
        ids[ranges(first[which], size[which])] = flat
        for i, x in pieces.items():
            ids[first[i] : first[i] + len(x)] = x
        return ids, size, equal

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Stores the ids of new words; hashes are sorted."""
        if len(self.hash) > self.keep:
            self.clear()
        new, size, equal = self._tokens(data, start, end)
        at = np.searchsorted(self.hash, hashes)
        self.start = np.insert(self.start, at, len(self.pool) + np.cumsum(size) - size)
        self.size, self.equal, self.hash = np.insert(self.size, at, size), np.insert(self.equal, at, equal), np.insert(self.hash, at, hashes)
        self.pool = np.concatenate([self.pool, new])

    def encode(self, column: pa.Array):
        """(ids, tokens of each text, exact, parity): exact: decoding gives the normalised text; parity: each word's ids are those of sentencepiece."""
        column = self.normalised(column)
        data, offsets = textnp.buffers(column)
        docs = len(offsets) - 1
        ids, counts, exact, parity = [], [], [], []
        lo = 0
        while lo < docs:
            hi = min(docs, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, side="right")) - 1))
            part = self._step(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for held, x in zip((ids, counts, exact, parity), part):
                held.append(x)
            lo = hi
        kinds = (np.int32, np.int64, bool, bool)
        return tuple(np.concatenate(x) if x else np.zeros(0, dtype=k) for x, k in zip((ids, counts, exact, parity), kinds))

    def _step(self, data: np.ndarray, offsets: np.ndarray):
        docs = len(offsets) - 1
        space = data == 32
        first = np.zeros(len(data) + 1, dtype=bool)
        first[1:-1] = space[1:] & ~space[:-1]
        first[offsets] = True
        cuts = np.flatnonzero(first)
        start, end = cuts[:-1], cuts[1:]
        if not len(data):
            start = end = np.zeros(0, dtype=np.int64)
        h = textnp.mix64(textnp.span_hash(textnp.prefix_hash(textnp._BYTE_VALUE[data], textnp.BYTE_BASE), start, end, textnp.BYTE_BASE))
        names, at, word = np.unique(h, return_index=True, return_inverse=True)
        for again in (False, True):  # the second time after the store was emptied to make room
            place = np.minimum(np.searchsorted(self.hash, names), max(0, len(self.hash) - 1))
            missing = self.hash[place] != names if len(self.hash) else np.ones(len(names), dtype=bool)
            if not missing.any():
                break
            self._learn(data, start[at[missing]], end[at[missing]], names[missing])
        place = np.searchsorted(self.hash, names)
        if len(names) and (self.hash[np.minimum(place, len(self.hash) - 1)] != names).any():
            self.clear()
            self._learn(data, start[at], end[at], names)
            place = np.searchsorted(self.hash, names)
        size = self.size[place][word]
        ids = self.pool[ranges(self.start[place][word], size)]
        of = np.searchsorted(start, offsets)
        total = np.concatenate([[0], np.cumsum(size)])
        counts = total[of[1:]] - total[of[:-1]]
        wrong = np.concatenate([[0], np.cumsum(~self.equal[place][word])])
        parity = wrong[of[1:]] == wrong[of[:-1]]
        exact = self._same(ids, counts, data, offsets)
        return ids, counts, exact, parity

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, with the space of the dummy prefix."""
        return self.piece_bytes[ranges(self.piece_start[ids], self.piece_size[ids])]

    def _same(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.concatenate([[0], np.cumsum(self.piece_size[ids])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        equal = size[ends[1:]] - size[ends[:-1]] == np.diff(offsets)
        if equal.all():
            bad = np.flatnonzero(self.decoded(ids) != data)
            equal[np.searchsorted(offsets, bad, side="right") - 1] = False
            return equal
        for i in np.flatnonzero(equal):
            equal[i] = np.array_equal(self.decoded(ids[ends[i] : ends[i + 1]]), data[offsets[i] : offsets[i + 1]])
        return equal


def _encode(raw: bytes, threads: int):
    def work(batches):
        codec = Codec(raw, threads)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                ids, counts, exact, parity = codec.encode(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("key"), list_array(ids, counts, pa.int32()), pa.array(counts.astype(np.int32)), pa.array(exact), pa.array(parity)], names=["doc_id", "ids", "n_tokens", "exact", "parity"])

    return work


def encode(docs: DataFrame, model: str = MODEL, threads: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, exact, parity of each row.

    exact: the ids decode to the normalised text; parity: the ids are those of
    the sentencepiece library. Null and empty texts have no ids and are exact.
    Characters that the model lacks become bytes, or the unknown token in models
    without byte fallback (not exact then). Null doc_ids and repeated rows stay
    as they are; other columns are ignored.
    """
    from pyspark.sql import functions as F

    with open(model, "rb") as f:
        raw = f.read()
    parse(raw)
    own = take(docs, key=key, text=text).withColumn("key", F.col("key").cast("long"))
    return own.mapInArrow(tidy_batches(_encode(raw, threads)), "doc_id long, ids array<int>, n_tokens int, exact boolean, parity boolean")


def _decode(raw: bytes):
    def work(batches):
        core = build(parse(raw))
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = core.decode_batch([x or [] for x in batch.column(at).to_pylist()], skip_special_tokens=True)
            null = batch.column(at).is_null()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pc.if_else(null, pa.scalar(None, pa.string()), pa.array(texts, pa.string()))], names=["doc_id", "text"])

    return work


def decode(encoded: DataFrame, model: str = MODEL, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ids; null ids give a null text."""
    from pyspark.sql import functions as F

    with open(model, "rb") as f:
        raw = f.read()
    own = take(encoded, key=key, ids=ids).withColumn("key", F.col("key").cast("long")).withColumn("ids", F.col("ids").cast("array<int>"))
    return own.mapInArrow(_decode(raw), "doc_id long, text string")
