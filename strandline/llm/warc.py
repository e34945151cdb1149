"""WARC archives with a Zstandard dictionary.

An archive starts with a skippable frame that holds a dictionary trained on a bounded sample of its own records; every
record after it is a frame of its own. Payloads equal to that of a later page are stored once, as a response, and revisited
by the others. Archives are read by their frames alone, without an index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import mounted, prepare, shared_folder, store, write_whole

# Fixed values of the published formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 1 << 16
SAMPLE_BYTES = 1 << 21  # records from which an archive's dictionary is trained
RECORD_SAMPLE_BYTES = 1 << 14  # of one record
ARCHIVE_BYTES = 1 << 27  # of compressed records, after which a task starts its next archive
LEVEL = 6
READ_BYTES = 1 << 16
MIN_REVISIT_BYTES = 1000
MANIFEST = "path string, n_records bigint, n_bytes bigint"
ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_OUT = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()),
])


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with their payload's digest and, for revisits, the page they refer to.

    Of equal payloads of at least min_revisit_bytes the largest page_id responds. A null html is an empty payload. Rows that
    repeat the largest page_id all respond; a null page_id responds only where its payload has no other. The table of
    payloads with copies is stored first, so the planner knows its size.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha1(html).alias("payload_digest"),
    )
    copies = (
        rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    found = rows.join(store(copies, "payload-copies"), ["payload_digest", "payload_bytes"], "left")
    return found.select(
        "page_id", "url", "html", "payload_digest",
        F.when(F.col("page_id").eqNullSafe(F.col("response_id")), None).otherwise(F.col("response_id")).alias("refers_to"),
    )


def _record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the response's HTTP header, and so its length, but no payload."""
    head = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    )
    body = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_uri(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url) if url else 'urn:unknown'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_uri(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary from sample records; their raw bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of plan_records as archives; returns the manifest. The folder must be mounted on all machines.

    A task holds one archive's compressed records and the sample. A task that runs again writes its archives again under
    the same names. No rows, no archive.
    """
    prepare(records.sparkSession)
    path = mounted(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        task = TaskContext.get()
        os.makedirs(path, exist_ok=True)
        done: list[tuple[str, int, int]] = []

        def rows() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    yield _record(page_id, url, html.encode("utf-8", "replace"), digest, refers_to, date)

        def archive(first: bytes, rest: Iterator[bytes]) -> None:
            held, size = [first], min(len(first), RECORD_SAMPLE_BYTES)
            while size < SAMPLE_BYTES and (record := next(rest, None)) is not None:
                held.append(record)
                size += min(len(record), RECORD_SAMPLE_BYTES)
            dictionary = train_dictionary([r[:RECORD_SAMPLE_BYTES] for r in held])
            raw = dictionary.as_bytes()
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
            parts = [struct.pack("<II", SKIPPABLE_DICTIONARY, len(raw)) + raw]
            parts += map(packer.compress, held)
            held.clear()
            total = sum(map(len, parts))
            while total < ARCHIVE_BYTES and (record := next(rest, None)) is not None:
                parts.append(packer.compress(record))
                total += len(parts[-1])
            name = f"{path}/part-{task.partitionId():06d}-{len(done):04d}.warc.zst"
            write_whole(name, parts, task.taskAttemptId())
            done.append((name, len(parts) - 1, total))

        source = rows()
        while (first := next(source, None)) is not None:
            archive(first, source)
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "n_records", "n_bytes"), map(list, zip(*done)))))

    columns = records.select("page_id", "url", "html", "payload_digest", "refers_to")
    return store(columns.mapInArrow(write, MANIFEST), "warc-manifest")


def frames(path: str) -> Iterator[bytes]:
    """The records of an archive in order, decoded with the dictionary of its leading frame."""
    with open(path, "rb") as file:
        magic, size = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE_DICTIONARY:
            raise ValueError(f"{path} does not start with a dictionary")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(file.read(size)))
        data = file.read(READ_BYTES)
        while data:
            frame, parts = reader.decompressobj(), []
            while not frame.eof:
                if not data:
                    raise ValueError(f"{path} ends inside a record")
                parts.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else file.read(READ_BYTES)
            yield b"".join(parts)
            data = data or file.read(READ_BYTES)


def _page_id(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def parse_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest in hex, type, page referred to); raises where a payload is damaged."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = body[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return _page_id(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page_id(refers) if refers else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row a record of the archives named in a manifest, one archive after the other in a task."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for record in frames(path):
                    rows.append(parse_record(record))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)

    tasks = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    return manifest.select("path").repartition(tasks, "path").mapInArrow(read, ROWS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a new shared folder and read them back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages), folder))
