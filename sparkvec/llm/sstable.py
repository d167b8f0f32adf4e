"""Token ids as sorted-string-table shards.

Documents are range-partitioned and sorted by identifier, encoded, and written
as one table a partition, so shards have disjoint key ranges. A shard is

    data blocks | index | Bloom filter | footer

A data block holds entries in key order: the length of the prefix shared with
the previous key, the rest of the key, and the token ids (16 bits each where the vocabulary
allows it). Every 16th entry has its whole key, and the block ends with the
places of these restarts, for binary search within it. Blocks are compressed
and carry a checksum. The sparse index has the last key, place and size of
each block; the Bloom filter answers most look-ups of absent keys; the footer
of fixed size says where they are. A look-up reads the footer, the filter,
the index, and one block (more where a key repeats).
"""

from __future__ import annotations

import array
import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm import textnp
from sparkvec.llm.common import longs, new_path, parts, sized, stored, take, tidy_batches
from sparkvec.llm.files import Shard, file_size, read_range, settle
from sparkvec.llm.sentencepiece_codec import MODEL, Codec, parse

MAGIC = b"SVTOKEN1"
BLOCK_BYTES = 64 << 10
#: Characters of text that a shard is made for.
SHARD_CHARS = 64 << 20
RESTART = 16
FOOTER = "<QQQQQQBB6x8s"  # index, its size, filter, its size, entries, bits, hashes, token width, magic
BITS_A_KEY = 10
HASHES = 7


def key_bytes(doc_id: int) -> bytes:
    """Eight bytes that sort like the number."""
    return (doc_id + (1 << 63)).to_bytes(8, "big")


def key_number(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each id, by double hashing."""
    with np.errstate(over="ignore"):
        a = textnp.mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        b = textnp.mix64(a) | np.uint64(1)
        return (a[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


class Writer:
    """One shard; keys must come in order."""

    def __init__(self, folder: str, stem: str, width: int):
        self.file, self.width = Shard(folder, stem, ".sst"), width
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.ids = array.array("q")

    def add(self, doc_id: int, tokens: bytes) -> int:
        """Returns the number of the block that the entry is in."""
        key = key_bytes(doc_id)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()
        shared = 0
        if self.entries % RESTART:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(8 - shared) + varint(len(tokens)) + key[shared:] + tokens
        self.entries, self.last = self.entries + 1, key
        self.ids.append(doc_id)
        return len(self.index)

    def _flush(self) -> None:
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        packed = zlib.compress(raw, 1)
        at = self.file.write(struct.pack("<I", zlib.crc32(packed)) + packed)
        self.index.append((self.last, at, self.file.size - at))
        self.block, self.restarts, self.entries = bytearray(), [], 0

    def close(self) -> str:
        if self.entries:
            self._flush()
        index = b"".join(k + struct.pack("<QI", at, size) for k, at, size in self.index)
        index_at = self.file.write(index)
        bits = max(64, BITS_A_KEY * len(self.ids))
        bloom = np.zeros(bits, dtype=bool)
        if len(self.ids):
            bloom[bloom_places(np.frombuffer(self.ids, dtype=np.int64), bits).ravel().astype(np.int64)] = True
        raw = np.packbits(bloom, bitorder="little").tobytes()
        bloom_at = self.file.write(raw)
        self.file.write(struct.pack(FOOTER, index_at, len(index), bloom_at, len(raw), len(self.ids), bits, HASHES, self.width, MAGIC))
        return self.file.close()


class Reader:
    """Look-ups in one shard."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name
        size = file_size(folder, name)
        if size < struct.calcsize(FOOTER):
            raise ValueError(f"{name} is no shard")
        at, length, bloom_at, bloom_size, self.entries, self.bits, _, self.width, magic = struct.unpack(FOOTER, read_range(folder, name, size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{name} is no shard")
        raw = read_range(folder, name, at, length)
        self.keys = [raw[i : i + 8] for i in range(0, length, 20)]
        self.places = [struct.unpack_from("<QI", raw, i + 8) for i in range(0, length, 20)]
        self.bloom = np.frombuffer(read_range(folder, name, bloom_at, bloom_size), dtype=np.uint8)

    def may_hold(self, doc_id: int) -> bool:
        p = bloom_places(np.array([doc_id]), self.bits)[0].astype(np.int64)
        return bool(((self.bloom[p >> 3] >> (p & 7)) & 1).all())

    def block(self, number: int) -> tuple[bytes, tuple[int, ...]]:
        raw = read_range(self.folder, self.name, *self.places[number])
        if zlib.crc32(raw[4:]) != struct.unpack_from("<I", raw)[0]:
            raise ValueError(f"block {number} of {self.name} is damaged")
        raw = zlib.decompress(raw[4:])
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 - 4 * n
        return raw[:end], struct.unpack_from(f"<{n}I", raw, end)

    def entries_from(self, raw: bytes, at: int):
        """(key, tokens) of a block from a restart on."""
        key = b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw[at : at + size], dtype=f"<u{self.width}")
            at += size

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The token ids of every entry of this key, none if it is absent."""
        if not self.entries or not self.may_hold(doc_id):
            return []
        key, found = key_bytes(doc_id), []
        number = bisect.bisect_left(self.keys, key)
        while number < len(self.keys):
            raw, restarts = self.block(number)
            first = bisect.bisect_left(restarts, key, key=lambda at: raw[at + 2 + (len(varint(read_varint(raw, at + 2)[0]))) :][:8])
            for k, tokens in self.entries_from(raw, restarts[max(0, first - 1)]):
                if k > key:
                    return found
                if k == key:
                    found.append(tokens)
            number += 1
        return found

    def scan(self):
        """(doc_id, token ids) of all entries."""
        for number in range(len(self.keys)):
            for k, tokens in self.entries_from(self.block(number)[0], 0):
                yield key_number(k), tokens


def _write(folder: str, raw: bytes, width: int):
    def work(batches):
        from pyspark import TaskContext

        codec = Codec(raw, 1, verify=False)
        writer, out = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                ids, counts, exact, _ = codec.encode(piece.column("text"))
                if writer is None:
                    writer = Writer(folder, f"tokens-{TaskContext.get().partitionId():06d}", width)
                flat, size = ids.astype(f"<u{width}").tobytes(), counts * width
                ends = np.cumsum(size)
                keys = longs(piece.column("key"))
                blocks = [writer.add(k, flat[e - n : e]) for k, e, n in zip(keys.tolist(), ends.tolist(), size.tolist())]
                out.append((keys, np.array(blocks, dtype=np.int32), counts, exact))
        if writer is None:
            return
        name = writer.close()
        for keys, blocks, counts, exact in out:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([name] * len(keys)), pa.array(blocks), pa.array(counts.astype(np.int64)), pa.array(exact)], names=["doc_id", "shard", "block", "n_tokens", "exact"])

    return work


def write(docs: DataFrame, folder: str, model: str = MODEL, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token ids of docs to shards in `folder`; doc_id, shard, block, n_tokens, exact of each entry.

    exact: decoding the tokens gives the normalised text. Parity with sentencepiece is what sentencepiece_codec.encode() looks at.

    Null and empty texts are entries without tokens. Rows with a null doc_id have
    no key and are left out. Repeated doc_ids are as many entries under one key,
    in the order of their texts. Other columns are ignored. Without `shards`, there are so many that one is
    made of about SHARD_CHARS characters at most; one document is never divided.
    """
    with open(model, "rb") as f:
        raw = f.read()
    width = 2 if len(parse(raw).pieces) <= 1 << 16 else 4
    own = take(docs, key=key, text=text).withColumn("key", F.col("key").cast("long")).where("key is not null")
    # As many shards as there are partitions of exchanged data, more where they would get too large.
    shards = shards or max(parts(docs.sparkSession), -(-(own.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS))
    own = own.repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    manifest = stored(own.mapInArrow(tidy_batches(_write(folder, raw, width)), "doc_id long, shard string, block int, n_tokens long, exact boolean"), "manifest")
    settle(folder, manifest)
    return manifest


def _look_up(folder: str):
    def work(table: pa.Table) -> pa.Table:
        ids, lists = [], []
        reader = None
        for k, shard in zip(table.column("key").to_pylist(), table.column("shard").to_pylist()):
            if reader is None or reader.name != shard:
                reader = Reader(folder, shard)
            for tokens in reader.get(k):
                ids.append(k)
                lists.append(tokens.astype(np.int32))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(lists, pa.list_(pa.int32()))})

    return work


def look_up(keys: DataFrame, manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """doc_id and ids of the entries of the distinct keys; absent and null keys have no rows."""
    spans = stored(manifest.groupBy("shard").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "spans")  # a row a shard
    own = take(keys, key=key).select(F.col("key").cast("long").alias("key")).where("key is not null").distinct()
    # Ranges are disjoint but for keys that end one shard and begin the next, so a few rows of `spans` hold a key.
    near = sized(spans)
    if near is spans:  # very many shards: keys and ranges meet by the cells of an even grid
        ends = spans.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).first()
        step = F.lit((ends.high - ends.low) / max(1, ends.n) + 1)
        cell = lambda c: F.floor((F.col(c).cast("double") - F.lit(float(ends.low))) / step).cast("long")
        grid = spans.withColumn("cell", F.explode(F.sequence(cell("low") - 1, cell("high") + 1)))
        hit = own.withColumn("cell", cell("key")).join(grid, "cell").where(F.col("key").between(F.col("low"), F.col("high"))).drop("cell")
    else:
        hit = own.join(near, F.col("key").between(F.col("low"), F.col("high")))
    return hit.groupBy("shard").applyInArrow(_look_up(folder), "doc_id long, ids array<int>")


def token_shards(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """write() to a new folder of the shared one."""
    return write(docs, new_path(docs.sparkSession, "tokens"), model)
