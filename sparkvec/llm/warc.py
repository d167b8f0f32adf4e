"""Web archives: reading records, resolving revisits, writing deduplicated archives.

A record is a row of record_id, type, url, date, digest, http, payload, refers_to.
`http` is the HTTP header block as it was stored, with its empty line; it is null where a record
has none. Responses have a payload; revisits have none and stand for an earlier
response of the same payload digest. Resolution works on headers alone:

1. Headers (no payloads) are shuffled by payload digest. The first response of
   a digest, in the order of (date, record_id, row), is its original. It is found by
   aggregation, so a digest that very many records share is no hot spot.
2. Revisits join the original of their digest; one whose digest is missing or
   unknown joins the response it refers to by id. Further responses of a digest
   become revisits of the original. A revisit without any original stays as it is,
   unresolved.
3. Each task writes the records of its partition to an archive with fresh WARC headers:
   new record ids, Content-Length and digests, each record a gzip member of its
   own; HTTP blocks stay as they are. Only *changes* are sent to the payloads: the
   responses that become revisits, and the originals of revisits. What stays a response needs no
   look-up. Changes up to BROADCAST_BYTES go to every task; beyond that,
   the payloads are shuffled once to meet them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvec.llm.common import new_path, sized, stored, take
from sparkvec.llm.files import Shard, read_range, settle

SPACE = uuid.UUID("6f1f8f9e-3a0a-5d7c-9b1e-0c7a5f2d9e11")
#: Written where a record has no date, beside a line that says so: archives must have one.
DATE = "1970-01-01T00:00:00Z"
COLUMNS = ("record_id", "type", "url", "date", "digest", "http", "payload", "refers_to")
RECORD = "record_id string, type string, url string, date string, digest string, http binary, payload binary, refers_to string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 20
#: Bytes of records that read() holds before it hands them on.
BATCH_BYTES = 8 << 20


def digest_of(payload) -> "F.Column":
    return F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))


def from_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A response for each page; null html is an empty payload. Pages come without HTTP headers: theirs say what a page is and no more."""
    own = take(pages, key=key, url=url, html=html)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # Page numbers in this form sort like the numbers.
    name = F.when(F.col("key").isNull(), F.lit("page-")).otherwise(F.concat(F.lit("page-"), F.lpad(F.col("key").cast("string"), 20, "0")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    return own.select(name.alias("record_id"), F.lit("response").alias("type"), "url", F.lit(None).cast("string").alias("date"), digest_of(payload).alias("digest"), http.alias("http"), payload.alias("payload"), F.lit(None).cast("string").alias("refers_to"))


def prepared(records: DataFrame) -> DataFrame:
    """The record's columns, with kind (type in lower case), made (the digest) and row (what tells records apart)."""
    own = take(records, **{c: c for c in COLUMNS if c != "http" or "http" in [n.lower() for n in records.columns]})
    if "http" not in own.columns:
        own = own.withColumn("http", F.lit(None).cast("binary"))
    kind = F.lower(F.col("type"))
    whole = digest_of(F.coalesce("payload", F.lit("").cast("binary")))
    made = F.when(F.col("digest").isNull() & (kind == "response"), whole).otherwise(F.col("digest"))
    return own.withColumn("kind", kind).withColumn("made", made).withColumn("row", identity()).withColumn("record_id", F.coalesce("record_id", F.lit("")))


def identity():
    """128 bits of all of a record, payload and HTTP block included."""
    names = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("record_id", "type", "url", "date", "digest", "refers_to")]
    blocks = [F.coalesce(F.md5(c), F.lit("-")) for c in ("http", "payload")]
    return F.md5(F.concat_ws("\x00", *names, *blocks))


def changes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, original of the records that are or become revisits of something; row of the originals that are there more than once).

    Both are tables of the shared folder. original: the record_id of the response that a revisit stands for. Types other than
    response and revisit (in any case) don't change. A response without a digest gets that of its payload, and
    a null payload counts as empty. Null record_ids are read as "".
    """
    heads = stored(prepared(records).select("record_id", F.col("kind").alias("type"), F.coalesce("date", F.lit("")).alias("date"), F.col("made").alias("digest"), "refers_to", "row"), "headers")
    answers = heads.where("type = 'response'")
    best = answers.groupBy("digest").agg(F.min(F.struct("date", "record_id", "row")).alias("head"))
    known = heads.where("type IN ('response', 'revisit')").join(best, "digest", "left")
    original = F.when((F.col("type") == "revisit") | (F.col("row") != F.col("head.row")), F.col("head.record_id"))
    known = known.withColumn("original", original)
    # By id, for revisits whose digest leads nowhere: to the original of what they refer to.
    lost = (F.col("type") == "revisit") & F.col("original").isNull()
    target = answers.join(best, "digest").groupBy(F.col("record_id").alias("id")).agg(F.min("head.record_id").alias("by_id"))
    changed = known.where(~lost).select("row", "original").unionByName(known.where(lost).join(target, F.col("refers_to") == F.col("id")).select("row", F.col("by_id").alias("original")))
    changed = stored(changed.where("original IS NOT NULL").groupBy("row").agg(F.min("original").alias("original")), "changes")
    twice = stored(answers.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row").join(changed.select("row"), "row", "left_anti"), "twice")
    return changed, twice


def fresh_id(record_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, record_id)}>"


def record_bytes(record_id: str, kind: str | None, url: str | None, date: str | None, digest: str | None, http: bytes | None, payload: bytes, original: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member. The block is the HTTP block, if there is one, and the payload, which revisits leave out."""
    # Lines of a header can't hold line breaks.
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)
    lines = ["WARC/1.1", f"WARC-Record-ID: {fresh_id(record_id)}", f"WARC-Date: {clean(date or DATE)}", f"X-Source-Record: {clean(record_id)}"]
    if kind is not None:
        lines.append(f"WARC-Type: {clean(kind)}")
    if not date:
        lines.append("X-Source-Date: none")
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean(url)}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: {clean(digest)}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        if original is not None:
            lines += [f"WARC-Refers-To: {fresh_id(original)}", f"X-Source-Refers-To: {clean(original)}"]
        payload = b""
    block = (http or b"") + payload
    media = "application/octet-stream" if http is None else "application/http; msgtype=response"
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Broken(ValueError):
    """What is not, or not wholly, an archive."""


def members(source):
    """(place, size, bytes) of each gzip member of a file object; the whole file is never held."""
    at, rest = 0, source.read(STEP)
    while rest:
        unpacker, data, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not rest:
                raise Broken(f"the member at {at} ends early")
            try:
                data.append(unpacker.decompress(rest))
            except zlib.error as e:
                raise Broken(f"the member at {at} can't be unpacked: {e}") from None
            used += len(rest)
            rest = unpacker.unused_data or source.read(STEP)
        used -= len(unpacker.unused_data)
        yield at, used, b"".join(data)
        at += used
        rest = rest or source.read(STEP)


def parse_records(source):
    """(place, size, header, block) of each record of an archive (a file object or bytes); place and size are its member's.

    A member may hold several records. Names of header lines are lower-cased; a line that begins with white space goes on with the one before.
    What is broken raises Broken.
    """
    import io

    for at, size, data in members(io.BytesIO(source) if isinstance(source, bytes | bytearray) else source):
        pos = 0
        while pos < len(data):
            if not data[pos : pos + 5] == b"WARC/":
                raise Broken(f"no record begins at byte {pos} of the member at {at}")
            end = data.find(b"\r\n\r\n", pos)
            if end < 0:
                raise Broken(f"the header in the member at {at} ends early")
            header: dict[str, str] = {}
            name = ""
            for line in data[pos:end].decode("utf-8", "replace").split("\r\n")[1:]:
                if line[:1] in (" ", "\t") and name:
                    header[name] += " " + line.strip()
                    continue
                name, colon, value = line.partition(":")
                name = name.strip().lower()
                if colon:
                    header[name] = value.strip()
            if not re.fullmatch(r"\d+", header.get("content-length", "")):
                raise Broken(f"a record in the member at {at} has no length")
            length = int(header["content-length"])
            if end + 4 + length > len(data):
                raise Broken(f"the block in the member at {at} ends early")
            yield at, size, header, data[end + 4 : end + 4 + length]
            pos = end + 4 + length
            while data[pos : pos + 2] == b"\r\n":
                pos += 2


def to_row(header: dict, block: bytes) -> tuple:
    kind, http, payload = header.get("warc-type"), None, block
    if header.get("content-type", "").lower().startswith("application/http"):
        head, line, payload = block.partition(b"\r\n\r\n")
        http = head + line
    if kind is not None and kind.lower() == "revisit":
        payload = None
    date = None if header.get("x-source-date") == "none" else header.get("warc-date")
    return (header.get("x-source-record", header.get("warc-record-id")), kind, header.get("warc-target-uri"), date, header.get("warc-payload-digest"), http, payload, header.get("x-source-refers-to", header.get("warc-refers-to")))


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n in ("http", "payload") else pa.string()) for n, c in zip(COLUMNS, cols)], names=list(COLUMNS))


def read(spark: SparkSession, path: str, broken: str = "raise") -> DataFrame:
    """The records of all .warc.gz archives under a path; each archive is streamed by one task.

    A broken archive raises; with broken="row" its records up to there are followed by one of type "broken",
    with the file as its url and the reason as its payload.
    """
    if broken not in ("raise", "row"):
        raise ValueError("broken is raise or row")

    def work(batches):
        from pyarrow import fs

        for batch in batches:
            for file in batch.column("path").to_pylist():
                system, place = fs.FileSystem.from_uri(file if not re.match(r"file:/(?!/)", file) else "file://" + file[5:])
                held, size = [], 0
                with system.open_input_file(place) as source:
                    try:
                        for _, _, header, block in parse_records(source):
                            held.append(to_row(header, block))
                            size += len(block)
                            if size >= BATCH_BYTES:
                                yield _record_batch(held)
                                held, size = [], 0
                    except Broken as e:
                        if broken == "raise":
                            raise Broken(f"{file}: {e}") from None
                        held.append((None, "broken", file, None, None, None, str(e).encode(), None))
                yield _record_batch(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInArrow(work, RECORD)


def _write(folder: str):
    def work(batches):
        from pyspark import TaskContext

        shard, out = None, []
        for batch in batches:
            if shard is None and batch.num_rows:
                shard = Shard(folder, f"records-{TaskContext.get().partitionId():06d}", ".warc.gz")
            for r in batch.to_pylist():
                raw = record_bytes(r["record_id"], r["kind"], r["url"], r["date"], r["made"], r["http"], r["payload"] or b"", r["original"])
                out.append((r["record_id"], r["kind"], r["made"], r["original"], shard.write(raw), len(raw)))
        if shard is None:
            return
        name = shard.close()
        cols = list(zip(*out))
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds)], pa.array([name] * len(out))], names=["record_id", "type", "digest", "original", "place", "size", "shard"])

    return work


def write(records: DataFrame, folder: str) -> DataFrame:
    """Resolves and writes records; record_id, type, digest, original, place, size, shard of each.

    Every row of records is one record of the archives. Rows that are equal throughout are copies:
    of a response that is an original one stays it, the others become revisits of it. Records with equal headers and
    different payloads are different records, each with its own digest. A digest that a record
    brings is kept and trusted. A missing date reads back as missing, and empty and very long payloads are like
    any others. See changes() for nulls and unresolved revisits. Extra columns are not written.
    """
    changed, twice = changes(records)
    own = prepared(records)
    if twice.limit(1).count():  # copies alone are numbered: the other payloads stay where they are
        turn = F.row_number().over(Window.partitionBy("row").orderBy("record_id"))
        again = own.join(sized(twice), "row", "left_semi").withColumn("original", F.when(turn > 1, F.col("record_id")))
        plain = own.join(sized(twice), "row", "left_anti").join(sized(changed), "row", "left")
        joined = plain.unionByName(again)
    else:
        joined = own.join(sized(changed), "row", "left")
    kind = F.when(F.col("original").isNotNull(), "revisit").otherwise(F.col("kind"))
    lean = joined.withColumn("kind", kind).select("record_id", "kind", "url", "date", "made", "http", F.when(~F.coalesce(F.col("kind") == "revisit", F.lit(False)), F.col("payload")).alias("payload"), "original")
    index = stored(lean.mapInArrow(_write(folder), "record_id string, type string, digest string, original string, place long, size long, shard string"), "index")
    settle(folder, index)
    return index


def fetch(folder: str, shard: str, place: int, size: int) -> tuple:
    """The record at a place of an archive."""
    return to_row(*next(parse_records(read_range(folder, shard, place, size)))[2:])


def deduplicated_pages(pages: DataFrame) -> DataFrame:
    """Archives pages in a new shared folder: page_id, type, digest, original_page_id.

    Pages of equal html are one response, that with the least page_id, and revisits of it.
    Null page_ids stay null, and come before all others; null html is an empty page. Rows repeated
    throughout are copies: one of them stays a response.
    """
    index = write(from_pages(pages), new_path(pages.sparkSession, "archives"))
    number = lambda c: F.when(F.length(c) > 5, F.substring(c, 6, 20).cast("long"))
    return index.select(number("record_id").alias("page_id"), "type", "digest", number("original").alias("original_page_id"))


def recrawled(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of pages seen three times: responses, a second response of every third page, a revisit by digest of every fifth and one by id of every seventh."""
    first = from_pages(pages, key, url, html).withColumn("date", F.lit("2024-01-01T00:00:00Z")).withColumn("n", F.substring("record_id", 6, 20).cast("long"))
    none = F.lit(None).cast("binary")
    later = first.where("n % 3 = 0").withColumn("record_id", F.concat("record_id", F.lit("-second"))).withColumn("date", F.lit("2024-02-01T00:00:00Z"))
    seen = first.withColumn("type", F.lit("revisit")).withColumn("payload", none).withColumn("date", F.lit("2024-03-01T00:00:00Z"))
    by_digest = seen.where("n % 5 = 0").withColumn("record_id", F.concat("record_id", F.lit("-digest")))
    by_id = seen.where("n % 7 = 0").withColumn("refers_to", F.col("record_id")).withColumn("record_id", F.concat("record_id", F.lit("-id"))).withColumn("digest", F.lit(None).cast("string"))
    return first.unionByName(later).unionByName(by_digest).unionByName(by_id).drop("n")


def deduplicated_recrawl(pages: DataFrame) -> DataFrame:
    """Archives recrawled(pages): record_id, type, digest, original of each record."""
    return write(recrawled(pages), new_path(pages.sparkSession, "archives")).select("record_id", "type", "digest", "original")
