"""WARC archives in Zstandard frames: a dictionary in a leading skippable frame, then one frame for each record."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: magic numbers of Zstandard frames, and the fields that each record must have.
FRAME, DICTIONARY, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Spark's text writer puts a separator after each row. This one is an empty skippable frame, which readers pass over.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"

#: Bytes of payload for an archive, about; pages the dictionary is trained on, at most; bytes of each; the dictionary's.
ARCHIVE_BYTES, SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 256, 16 << 10, 32 << 10
#: Equal payloads shorter than this aren't worth a revisit.
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def train(pages: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE_PAGES pages, those whose page_id has the smallest hash. Ids come to the driver
    first, so that no task sends pages that aren't in the sample."""
    ids = pages.where("page_id is not null").select("page_id").orderBy(F.xxhash64(F.col("page_id").cast("string")), "page_id").limit(SAMPLE_PAGES)
    picked = pages.where(F.col("page_id").isin([r[0] for r in ids.collect()]))
    first = F.substring(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"), 1, SAMPLE_BYTES)
    samples = [bytes(r[0]) for r in picked.select(first).limit(SAMPLE_PAGES).collect()]
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short
        return (b"".join(samples) + b"<!DOCTYPE html><html><head><title>")[-DICTIONARY_BYTES:]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit one that has the response's headers but not the payload."""
    name = lambda i: f"<urn:page:{i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        first = True
        for b in batches:
            out = [struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary] if first and b.num_rows else []
            first &= not b.num_rows
            for page_id, url, html, digest, to in zip(*(b.column(i) for i in range(5))):
                out.append(frames.compress(record(page_id.as_py(), url.as_py(), html.as_py(), digest.as_py(), to.as_py())))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return run


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of pages (page_id, url, html, ...) to archives under the path, which must not exist.

    Of equal payloads of REVISIT_BYTES or more the one with the smallest page_id is a response and the others revisit
    it; a null page_id never is the response unless no other is. Rows that repeat a response's page_id and payload are
    responses too, as a record can't revisit its own id. A null html is an empty payload, a null url leaves the
    field out; rows are written as often as they occur. Any file system that Spark can write to will do.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    named = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    archives = max(1, -(-total // ARCHIVE_BYTES))
    long = named.where(F.col("n") >= REVISIT_BYTES)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1 and refers_to is not null").drop("k")
    again = long.join(firsts, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = rows.withColumn("digest", F.sha2("html", 256)).repartition(archives, "page_id", "digest")
    again = again.repartition(archives, "page_id", "digest")
    joined = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    frames = joined.mapInArrow(_write(train(pages)), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 0).option("compression", "none").text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at the place ends, from its header and its blocks' headers."""
    start, flags = at, data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise ArchiveError(f"the frame at byte {start} is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ArchiveError(f"the frame at byte {start} is cut off")
    return at


def records(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, record) of each frame of an archive that begins with its dictionary; other skippable frames are passed over."""
    data, at, reader = memoryview(archive), 0, None
    while at < len(data):
        if len(data) - at < 8:
            raise ArchiveError(f"{len(data) - at} bytes too many at byte {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if reader is None:
            if magic != DICTIONARY or at + 8 + size > len(data):
                raise ArchiveError("an archive must begin with its dictionary")
            own = bytes(data[at + 8 : at + 8 + size])
            if own[:4] == struct.pack("<I", FRAME):
                own = zstandard.ZstdDecompressor().decompress(own)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
            at += 8 + size
        elif magic in SKIPPABLE:
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(data, at)
            try:
                yield at, reader.decompressobj().decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise ArchiveError(f"the frame at byte {at} can't be decoded: {e}") from e
            at = end
        else:
            raise ArchiveError(f"no frame at byte {at}")


def _fields(head: bytes, first: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(first):
        raise ArchiveError(f"{lines[0][:20]!r} isn't a header")
    pairs = [x.partition(b":") for x in lines[1:]]
    if any(not colon for _, colon, _ in pairs):
        raise ArchiveError("a header line has no colon")
    return {k.decode("ascii").lower(): v.strip().decode() for k, _, v in pairs}


def _number(uri: str | None) -> int | None:
    n = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n.lstrip("-").isdigit() else None


def parse(data: bytes) -> dict:
    """The checked content of a record: headers complete, lengths and the payload's digest right."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    f = _fields(head, b"WARC/1.")
    if not sep or any(k not in f for k in REQUIRED):
        raise ArchiveError("a record lacks " + ", ".join(k for k in REQUIRED if k not in f))
    n = int(f["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"a block of {n} bytes is followed by {len(rest) - n}")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(_fields(http, b"HTTP/1.")["content-length"])
    digest = f.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = f["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ArchiveError(f"{f['warc-record-id']}: the payload isn't what its headers say")
    if kind == "revisit" and (payload or "warc-refers-to" not in f):
        raise ArchiveError(f"{f['warc-record-id']}: a revisit has a payload or refers to nothing")
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"a record of type {kind}")
    return {"page_id": _number(f["warc-record-id"]), "url": f.get("warc-target-uri"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": _number(f.get("warc-refers-to"))}


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("place", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            rows, held = [], 0
            data = content.as_py()
            for place, raw in records(data) if data else ():
                try:
                    rows.append(parse(raw) | {"archive": path, "place": place})
                except ValueError as e:
                    raise ArchiveError(f"{path}, byte {place}: {e}") from e
                held += len(raw)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under the path; a broken one fails the job and names archive and byte.

    payload is null for a revisit; payload_bytes and payload_digest are the full payload's. An empty file has no records.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, archive string, place long")
