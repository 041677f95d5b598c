"""WARC archives of pages: written record by record with an index, read back by coalesced byte ranges.

Each record is a gzip member of its own, so any byte range of the index can be read alone. A page whose payload
equals that of an earlier one is a revisit record: the headers of its response, without the payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.llm.shared_files import Reader, new_file, runs
from exhume.session import Scratch

#: Payloads below this many bytes are never stored as revisits.
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
# Fixed value: the profile's name in the WARC format.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, payload_digest string, record_type string"


def payloads(pages: DataFrame, html: str = "html") -> Column:
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): the least page_id of an equal payload, null for the response itself.

    A null page_id comes after all others; rows that repeat the least page_id are all responses.
    """
    page = pages.select("page_id", "url", payloads(pages).alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("long", F.octet_length("payload") >= least)
    # only payloads that several pages have are joined back; counts are summed before the exchange
    shared = page.filter("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = page.join(shared.select("digest", "first"), "digest", "left")
    later = F.col("long") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))


def _line(text: str) -> str:
    """Header values stay on their line."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit's block ends after the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _line(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if revisit else None,
        "WARC-Profile": SAME_PAYLOAD if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _number(urn: str | None) -> int | None:
    digits = (urn or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def parse(data: bytes) -> dict:
    """Fields of one record; the digest of a stored payload is taken anew and must agree with the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    named = fields["WARC-Payload-Digest"].partition(":")[2]
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != named):
        raise ValueError("a record's payload does not have the digest of its header")
    uri = fields.get("WARC-Target-URI")
    return {
        "page_id": _number(fields["WARC-Record-ID"]), "url": None if uri is None else _unline(uri), "record_type": fields["WARC-Type"],
        "refers_to": _number(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": named,
        "payload": payload if response else None,
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of all rows of ``pages`` (page_id, url, html) below ``folder``; returns the staged index, a row per record.

    One file per task. A null html is an empty payload, a null url has no target; rows may repeat, and each has its
    record; an empty table has no file. Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = stream = None
        offset = 0
        for batch in batches:
            if stream is None:
                uri, stream = new_file(folder, ".warc.gz")
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                first = refers_to.as_py()
                plain = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), first)
                packer = zlib.compressobj(3, wbits=31)
                data = packer.compress(plain) + packer.flush()
                stream.write(data)
                rows.append((offset, len(data), "response" if first is None else "revisit"))
                offset += len(data)
            offsets, lengths, kinds = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(rows), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column("page_id"), batch.column("url"), batch.column("digest"), pa.array(kinds, pa.string())],
                ["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"],
            )
        if stream is not None:
            stream.close()

    return Scratch(pages.sparkSession).write(with_revisits(pages).mapInArrow(write, INDEX))


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def read_records(selected: DataFrame) -> DataFrame:
    """The records of index rows: sorted by file and offset, neighbours in one read. ``payload`` is null for revisits."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            files = batch.column("file").to_pylist()
            spans = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            for a, b in runs(files):
                rows, size = [], 0
                for data in reader.read(files[a], spans[a:b]):
                    rows.append(parse(zlib.decompress(data, wbits=31)))
                    size += rows[-1]["payload_bytes"]
                    if size > 16 << 20:  # a batch of bounded size, whatever the selection is
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
        reader.close()

    ordered = selected.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, RECORD)
