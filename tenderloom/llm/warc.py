"""Dictionary-compressed WARC archives: a writer and a reader.

Each task writes its pages to archives of bounded size. The records at the head of an archive train a Zstandard
dictionary; it stands in a skippable frame at the very start of the file, and every record after it is a frame of its own,
compressed with that dictionary, so any record can be read with the head of the file and its own bytes. Archives are
written through a file system taken from the folder's address, under a name that no other attempt of the task uses, and
only the archives of attempts that Spark counted as done are in the manifest. A repeated task leaves a file that nobody
reads.

Of pages with equal payloads of at least `MIN_PAYLOAD` bytes, the one with the smallest id is a response record and the
others are revisit records that refer to it. The payload digests are counted with map-side aggregation and joined back
from a stored table, so adaptive execution can split a digest that very many pages share.

Null pages count as empty payloads. A null address becomes the record's own id; control characters in addresses are
percent-encoded. Rows that repeat an id are archived one by one, and all rows with the smallest id of their payload are
responses. Null ids come after all others; if all ids of a payload are null, all its rows are responses. An empty table
gives no archive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches
from tenderloom.session import frozen, shared_folder

MIN_PAYLOAD = 100
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _address(url: str | None, record: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else record


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. Revisits keep the length and digest of the full payload in their head, and no payload."""
    name = f"urn:page:{'' if page_id is None else page_id}"
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {_address(url, name)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """The heads of a record and its payload, checked against length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    payload = block[len(HTTP_HEAD):]
    if fields["WARC-Type"] == "response":
        found = hashlib.sha256(payload).hexdigest()
        if f"sha256:{found}" != fields["WARC-Payload-Digest"] or len(payload) != int(fields["X-Payload-Length"]):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"fields": fields, "payload": payload}


def _number(urn: str) -> int | None:
    digits = urn.strip("<>").removeprefix("urn:page:")
    return int(digits) if digits else None


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary; with too little to train on, the records themselves are the dictionary."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(sum(map(len, records)) // 8, 1024)), records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY_BYTES]


def archives(records: Iterator[bytes], limit: int = ARCHIVE_BYTES) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Archives as streams of byte strings, each of at most about `limit` bytes before compression."""
    import zstandard

    ended = False
    while not ended:
        first, size = [], 0
        for record in records:
            first.append(record)
            size += len(record)
            if size >= SAMPLE_BYTES:
                break
        else:
            ended = True
        if not first:
            return
        # long records are no models for others and would make the training slow
        raw = dictionary_of([r[:65536] for r in first])

        def stream() -> Iterator[bytes]:
            nonlocal ended, size
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
            yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
            for record in first:
                yield compressor.compress(record)
            while size < limit and not ended:
                record = next(records, None)
                if record is None:
                    ended = True
                else:
                    size += len(record)
                    yield compressor.compress(record)

        yield stream()


def read_archive(file: io.BufferedIOBase) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(file.read(size))
    held, decoder = b"", None
    while True:
        if not held:
            held = file.read(1 << 20)
            if not held:
                if decoder is not None:
                    raise ValueError("an archive ends inside a record")
                return
        if decoder is None:
            decoder, parts = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
        parts.append(decoder.decompress(held))
        held = b""
        if decoder.eof:
            held, decoder = decoder.unused_data, None
            yield b"".join(parts)


def _opened(address: str):
    from pyarrow import fs

    if "://" not in address and not address.startswith("file:"):
        return fs.LocalFileSystem(), address
    return fs.FileSystem.from_uri(address.replace("file:///", "file:/").replace("file:/", "file:///", 1))


def with_references(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), html.alias("html"),
                        F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("size"))
    firsts = rows.where(F.col("size") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = frozen(firsts.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("shared"), "first"))
    joined = rows.join(firsts, rows["digest"] == firsts["shared"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages of `with_references`; the manifest: path, records, bytes of every archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0

        def records() -> Iterator[bytes]:
            nonlocal written
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    written += 1
                    yield record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)

        files, root = _opened(folder)
        rows = []
        for archive in archives(records(), limit):
            path, before, size = f"{root}/{uuid.uuid4().hex}.warc.zst", written, 0
            with files.open_output_stream(path) as out:
                for part in archive:
                    out.write(part)
                    size += len(part)
            rows.append((path.rpartition("/")[2], size))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "bytes"])

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, bytes long")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url from the records of the listed archives."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{path}") as file:
                    for data in read_archive(file):
                        fields = read_record(data)["fields"]
                        refers = fields.get("WARC-Refers-To")
                        rows.append((_number(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                                     fields["WARC-Type"], _number(refers) if refers else None, fields["WARC-Target-URI"]))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return manifest.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    folder = f"{shared_folder(spark)}/tenderloom/warc-{uuid.uuid4().hex}"
    files, root = _opened(folder)
    files.create_dir(root, recursive=True)
    return folder


def archived(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> tuple[DataFrame, str]:
    """Writes archives; the stored manifest and the folder they are in."""
    folder = folder or archive_folder(pages.sparkSession)
    return frozen(write_archives(with_references(pages, id_column, url_column, html_column), folder)), folder
