"""WARC archives with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Pages with equal payloads of some size are stored once: the page of the largest id as a
response, the others as revisit records that refer to it. The reader loads the dictionary
from the first frame, decodes one frame at a time, and checks headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import open_file_system, shared_folder
from filelake.session import cut_lineage

# Fixed values of the formats.
_DICTIONARY_FRAME = 0x184D2A5D
_ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
# The dictionary is fitted on so many pages at most, so many characters of each.
SAMPLE_PAGES = 256
SAMPLE_CHARS = 16_384
DICTIONARY_BYTES = 64 << 10
_CHUNK = 1 << 20


class Record(NamedTuple):
    kind: str
    record_id: str
    headers: dict[str, str]
    block: bytes


def encode_record(kind: str, record_id: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> Record:
    """Parse one record; raises ``ValueError`` where a header or a length is wrong."""
    head, gap, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    if len(headers) != len(lines) - 1 or not {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= headers.keys():
        raise ValueError("wrong or missing WARC headers")
    length = int(headers["Content-Length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ValueError("wrong length of a WARC record")
    return Record(headers["WARC-Type"], headers["WARC-Record-ID"].strip("<>"), headers, body[:length])


def _page_uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _page_of(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c if c.isprintable() and c != " " else "%20" for c in url or "")
    headers = {"WARC-Target-URI": target} if target else {}
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is None:
        return encode_record("response", _page_uri(page_id), headers, http + payload)
    headers |= {"WARC-Refers-To": f"<{_page_uri(refers_to)}>", "WARC-Profile": _PROFILE}
    return encode_record("revisit", _page_uri(page_id), headers, http)


def read_page(record: Record) -> dict:
    """What the archive says of a page; raises ``ValueError`` where payload and headers disagree."""
    http, gap, payload = record.block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    size, digest = int(fields["Content-Length"]), record.headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if not gap:
        raise ValueError("no HTTP headers")
    if record.kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload differs from its headers")
    elif record.kind != "revisit" or payload or record.headers.get("WARC-Profile") != _PROFILE:
        raise ValueError("unexpected record")
    refers = record.headers.get("WARC-Refers-To")
    return {
        "page_id": _page_of(record.record_id),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": record.kind,
        "refers_to": _page_of(refers) if refers else None,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    data = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", _DICTIONARY_FRAME, len(data)) + data


def read_frames(stream) -> Iterator[bytes]:
    """Decoded frames of an archive, one at a time; raises ``ValueError`` if it ends within a frame."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == _DICTIONARY_FRAME:
        data = stream.read(struct.unpack("<I", head[4:])[0])
        if data.startswith(_ZSTD_FRAME):
            data = zstandard.ZstdDecompressor().decompress(data)
        dictionary, head = zstandard.ZstdCompressionDict(data), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = head or stream.read(_CHUNK)
    while rest:
        if not rest.startswith(_ZSTD_FRAME[: len(rest)]):
            raise ValueError("not a Zstandard frame")
        part, out = decoder.decompressobj(), []
        while not part.eof:
            if not rest:
                rest = stream.read(_CHUNK)
                if not rest:
                    raise ValueError("archive ends within a frame")
            out.append(part.decompress(rest))
            rest = part.unused_data if part.eof else b""
        yield b"".join(out)
        rest = rest or stream.read(_CHUNK)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; empty if the sample is too small to train on."""
    rows = pages.where("html is not null").select(F.substring("html", 1, SAMPLE_CHARS).alias("h")).limit(SAMPLE_PAGES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["h"].encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` with ``digest`` and ``refers_to``, the response's page for pages that revisit it."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    slim = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = slim.join(groups, "digest").where("top is not null and not (page_id <=> top)").select("page_id", "digest", "top").distinct()
    links = links.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("top").alias("refers_to"))
    return rows.join(links, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left").drop("p", "d")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages (page_id, url, html)``; gives ``path, records`` of the archives.

    A task writes archives of about ``file_bytes``; when it runs again it uses new names, and
    only archives in the result count.
    """
    dictionary = train_dictionary(pages)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_file_system(folder)
        fs.create_dir(root)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(dict_data=known).compress
        out, name, records, size = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, records, size = f"pages-{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}")
                    if dictionary:
                        out.write(dictionary_frame(dictionary))
                    out.write(compress(encode_record("warcinfo", f"urn:uuid:{uuid.uuid4()}", {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                data = compress(page_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    columns = mark_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return cut_lineage(columns.mapInArrow(task, "path string, records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per page record of ``archives (path, records)``, decoded and checked."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                folder, _, name = path.rpartition("/")
                fs, root = open_file_system(folder)
                rows, count = [], 0
                with fs.open_input_stream(f"{root}/{name}") as stream:
                    for data in read_frames(stream):
                        record = decode_record(data)
                        if record.kind == "warcinfo":
                            continue
                        rows.append(read_page(record))
                        count += 1
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if count != records:
                    raise ValueError(f"{path}: {count} records, {records} were written")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.repartition(max(1, archives.count()), "path").mapInArrow(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, one row per page.

    A NULL html is an empty payload. Rows that repeat both the largest page id and the payload
    are each written as response. A NULL page id is smaller than any other; if a group has
    no other, all its rows are responses. An empty table gives no row; columns other than
    ``page_id, url, html`` are ignored, and so may ``url`` be NULL.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder))
