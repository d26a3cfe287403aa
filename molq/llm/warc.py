"""WARC archives: one gzip member per record, written and read in sequence by tasks.

Writing: records with equal payloads of at least ``revisit_from`` bytes are one group; the one with
the largest id is a ``response`` with its payload, the others are ``revisit`` records that name it and
carry only the HTTP header. Every task appends its records to archives of bounded size in the shared
folder; a repeated task attempt writes new files, and only those named in the stored listing count.

Reading: each archive is streamed in blocks through an incremental zlib decompressor. A record is framed
by its header and Content-Length, a member ends with its record, and digests are verified.

The project publishes tables, not web pages, so the functions take any id, address and content column.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.llm.common import in_small_batches, rows_of, shared_folder, stored

REVISIT_FROM = 1000
ARCHIVE_BYTES = 64_000_000
READ_BYTES = 1 << 20
BLOCK_BYTES = 1 << 16
MOST_TASKS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:molq:record:{}>"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(number: int, url: str | None, payload: bytes, refers_to: int | None, level: int = 2) -> bytes:
    """One record as a gzip member of its own."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", RECORD_ID.format(number)),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block))]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", RECORD_ID.format(refers_to)), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", len(block)))) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def read_members(source) -> Iterator[bytes]:
    """The members of a gzip file one by one, from a stream that is read in blocks."""
    waiting, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        # What is left of a block is copied once per member, so blocks are small.
        waiting = waiting or source.read(BLOCK_BYTES)
        if not waiting:
            break
        parts.append(unpack.decompress(waiting))
        waiting = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if any(parts) or unpack.unconsumed_tail:
        raise ValueError("the archive ends inside a record")


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of one record; framing is checked."""
    head, found, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is not framed by its length")
    return fields, rest[:size]


def _number(record_id: str) -> int:
    return int(record_id.rstrip(">").rpartition(":")[2])


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, fs, base = TaskContext.get(), *_filesystem(folder)
        fs.create_dir(base, recursive=True)
        names, counts, out, size = [], [], None, 0
        for batch in batches:
            for number, url, content, refers_to in rows_of(batch, "id", "url", "content", "refers_to"):
                if out is None or size >= archive_bytes:
                    if out:
                        out.close()
                    name = f"{task.partitionId():06d}-{len(names):04d}-{uuid.uuid4().hex}.warc.gz"
                    out, size = fs.open_output_stream(f"{base}/{name}", compression=None), 0
                    names.append(f"{folder}/{name}")
                    counts.append(0)
                data = record_bytes(number, url, (content or "").encode("utf-8", "surrogatepass"), refers_to)
                out.write(data)
                size += len(data)
                counts[-1] += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    return write


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        for archive, expected in rows_of(batch, "archive", "records"):
            fs, path = _filesystem(archive)
            found, held, seen = [], 0, 0
            with fs.open_input_stream(path, compression=None) as source:
                for member in read_members(source):
                    fields, block = parse_record(member)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.decode().lower().partition("content-length: ")[2].split("\r\n")[0])
                    full = fields["warc-type"] == "response"
                    if _sha1(block) != fields["warc-block-digest"] or full and (
                            len(payload) != length or _sha1(payload) != fields["warc-payload-digest"]):
                        raise ValueError(f"digest of {fields['warc-record-id']} does not hold")
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    refers = fields.get("warc-refers-to")
                    found.append((_number(fields["warc-record-id"]), fields.get("warc-target-uri"), length, digest,
                                  fields["warc-type"], _number(refers) if refers else None, payload if full else None))
                    held, seen = held + len(member), seen + 1
                    if held >= 8 * READ_BYTES:
                        yield rows(found)
                        found, held = [], 0
            if seen != expected:
                raise ValueError(f"{archive} holds {seen} records, not {expected}")
            yield rows(found)


def write_archives(pages: DataFrame, id_col: str = "record_id", url_col: str = "url", content_col: str = "content",
                   revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of ``pages``; returns the stored listing (archive, records).

    Ids are integers. Null content is an empty payload; a null URL leaves the field out. A row without id
    raises an error, since a record needs a name. Payloads below ``revisit_from`` bytes are always
    responses. Rows that repeat an id and payload: one of them is the response, as the id says only that much.
    """
    rows = in_small_batches(pages).select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(content_col).alias("content"))
    rows = rows.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a record needs an id")).cast("bigint")))
    large = F.octet_length("content") >= revisit_from
    digest = F.when(large, F.unhex(F.sha2("content", 256)))
    # Only ids and digests meet by digest. Contents meet the rows that repeat a payload by id and digest, which
    # spreads copies and small payloads alike, or not at all where those rows are few enough to broadcast.
    ids = stored(rows.select("id", digest.alias("digest")).where("digest is not null"), "digests")
    groups = ids.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = stored(ids.join(groups, "digest").where("refers_to <> id").distinct(), "revisits")
    dealt = rows.withColumn("digest", digest).join(revisits, ["id", "digest"], "left").select("id", "url", "content", "refers_to")
    folder = shared_folder(pages.sparkSession, "warc")
    return stored(dealt.mapInArrow(_writer(folder, archive_bytes), "archive string, records bigint"), "warc-listing")


def read_archives(listing: DataFrame) -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record.

    ``payload_digest`` is bare lower-case hex SHA-1 of the full payload, ``payload_bytes`` its length; the
    payload itself is null for revisits. Broken framing, digests or counts raise an error.
    """
    # A number of its own, so that Spark does not put the small listing into few tasks: one task per archive.
    archives = listing.repartitionByRange(max(1, min(listing.count(), MOST_TASKS)), "archive")
    return archives.mapInArrow(_reader, "id bigint, url string, payload_bytes bigint, payload_digest string, "
                                        "record_type string, refers_to bigint, payload binary")
