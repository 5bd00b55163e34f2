"""Dictionary-compressed WARC writer and reader.

Records are compressed one by one, each a Zstandard frame of its own, with a
dictionary trained from a sample of the records. A leading skippable frame of
every file holds the dictionary. Equal payloads are archived once; later pages
become revisit records. Which page is the first is settled on digests alone,
before payloads move.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy
from .scratch import Scratch

DICTIONARY_MAGIC = 0x184D2A5D
#: Records that the dictionary is trained from, bytes of each, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 32_768, 65_536
ROTATE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("5f2c7b1e-7f0e-4d55-9a53-0d6f4b6f3c11")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for repeated rows of a page: their records say the same."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}/{digest}')}>"


def _one_line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def build_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None = None, first_url: str | None = None, revisit: bool = False) -> bytes:
    """A WARC/1.1 response record, or a revisit record that refers to the first page with the payload."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first_id, digest)}", f"Refers-To-Page-ID: {first_id}"]
        if first_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_one_line(first_url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; their tail as it is where they are too few to train on; b'' from none."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records).as_bytes() if len(records) >= 8 else b"".join(records)[-size:]
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_stream(path)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def first_pages(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Rows of (page_id, url, html) with payload and, where several pages have it, first_id and first_url of the first.

    The first page is the one with the smallest non-null page_id. Digests are
    combined in every task before the shuffle, so a payload that a third of all
    pages share is a row per task. Payloads under ``min_bytes`` have no first.

    Only digests are shuffled to find the repeated payloads, which are written:
    few of them are broadcast to the pages by their known size, and no payload
    moves; many are joined by a shuffle, which adaptive execution can split.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    repeated = rows.filter("sha is not null").groupBy("sha").agg(first, F.count("*").alias("n")).filter("n > 1 and first is not null")
    firsts = scratch.table(repeated.select("sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "firsts")
    return rows.join(firsts, "sha", "left").select("page_id", "url", "payload", "first_id", "first_url")


INDEX = "path string, offset long, length long, page_id long, record_type string"


def write_archives(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, rotate: int = ROTATE_BYTES) -> DataFrame:
    """Write a record per page and return the index: path, offset, length, page_id, record_type.

    A null html is an empty payload. Of equal payloads of at least
    ``min_bytes`` bytes the page with the smallest page_id (repeated rows of it
    too) is a response, others revisit it; a null page_id is never the first
    where another page has the payload. An empty table gives an empty index.

    Tasks stream their rows into files of about ``rotate`` bytes in the shared
    folder; names are unique to the attempt, and the index, committed by Spark,
    names only files of attempts that succeeded. The dictionary, of bounded
    size, is trained on the driver from at most SAMPLE_RECORDS records, those
    with the smallest digests.
    """
    # about twice the sample by its digest first, so that tasks do not each send a whole one
    share = min(1.0, 2 * SAMPLE_RECORDS / max(1, pages.count()))
    place = F.conv(F.substring("sha", 1, 8), 16, 10).cast("double") / float(1 << 32)
    known = pages.filter("html is not null").select("page_id", "url", F.sha1("html").alias("sha"), F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    sample = known.filter(place < share).orderBy("sha", "page_id", "url").limit(SAMPLE_RECORDS)
    records = [build_record(r["page_id"], r["url"], r["html"].encode()) for r in sample.collect()]
    dictionary = train_dictionary(records)
    folder = scratch.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_content_size=True)
        attempt, out, at, n = uuid.uuid4().hex, None, 0, 0
        for batch in batches:
            index = []
            for page_id, url, payload, first_id, first_url in zip(*(c for c in batch.columns)):
                page_id, url, payload, first_id, first_url = (x.as_py() for x in (page_id, url, payload, first_id, first_url))
                if out is None or at >= rotate:
                    if out is not None:
                        out.close()
                    path = f"{folder}/{attempt}-{n:05d}.warc.zst"
                    out, n = _open(path, "w"), n + 1
                    head = dictionary_frame(dictionary)
                    out.write(head)
                    at = len(head)
                revisit = first_id is not None and first_id != page_id
                frame = compressor.compress(build_record(page_id, url, payload, first_id, first_url, revisit))
                out.write(frame)
                index.append((path, at, len(frame), page_id, "revisit" if revisit else "response"))
                at += len(frame)
            columns = list(zip(*index)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "offset", "length", "page_id", "record_type"])
        if out is not None:
            out.close()

    return scratch.table(first_pages(pages, scratch, min_bytes).withColumns({c: F.col(c).cast("long") for c in ("page_id", "first_id")}).mapInArrow(tidy(write), INDEX), "index")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an archive, one held at a time."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        return
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(stream.read(size))).stream_reader(stream, read_across_frames=True, read_size=1 << 20)
    held = b""
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = reader.read(1 << 16)
            if not more:
                if held:
                    raise ValueError("a record is cut off")
                return
            held += more
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:20]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        start, parts = end + 4, [held]
        have = len(held)
        while have < start + length + 4:
            more = reader.read(max(1 << 16, start + length + 4 - have))
            if not more:
                raise ValueError("a record is cut off")
            parts.append(more)
            have += len(more)
        held = b"".join(parts) if len(parts) > 1 else held
        yield headers, held[start : start + length]
        held = held[start + length + 4 :]


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def read_archives(index: DataFrame) -> DataFrame:
    """A row per record of the files that the index names, from the files alone.

    Block digests and, of responses, payload digests are checked; a record that
    disagrees raises ValueError. Files are dealt out to tasks and streamed.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _open(path, "r") as stream:
                    for headers, block in read_records(stream):
                        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"block digest of {headers['WARC-Record-ID']} in {path}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} in {path}")
                        page, first = headers.get("Page-ID"), headers.get("Refers-To-Page-ID")
                        rows.append((page and int(page), size, digest, kind, first and int(first)))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], READ.names)

    return index.select("path").distinct().repartition("path").mapInArrow(read, READ)
