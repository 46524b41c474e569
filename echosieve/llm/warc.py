"""WARC archives of pages: written one gzip member per record, read back sequentially.

Copies are found by SHA-1 digest first (counts are combined before the shuffle, and only ids and
digests move): the page with the least id of equal payloads is the ``response``, the others are
``revisit`` records without the payload.  Each task writes archives of its own to the shared
folder and reports them; a task that is run again writes new files, and only the reported ones
are read.  The reader inflates in pieces, frames each record by its Content-Length, and checks
block and payload digests as the bytes pass, so its memory does not depend on a record's size
unless the payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import same
from echosieve.workspace import Workspace

ARCHIVE_BYTES = 256 << 20
PIECE = 1 << 18
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string, digest_ok boolean, payload binary"
)


def _open(path: str):
    """``(filesystem, path)``; without a scheme the path is local."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record: headers, an HTTP block, two line ends."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if revisit else head + payload
    target = "".join(c if " " < c < "\x7f" or c > "\xa0" else f"%{ord(c):02X}" for c in url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target or "about:blank"),
        ("WARC-Payload-Digest", "sha1:" + _digest(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", "sha1:" + _digest(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", f"<{ID}{'' if refers_to is None else refers_to}>"),
        ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get().partitionId()
        out, done = None, []

        def close():
            out.close()
            done.append((f"{folder}/{name}", count, size))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "revisit", "refers_to")]
            for row in zip(*columns):
                page_id, url, html, revisit, refers_to = (v.as_py() for v in row)
                if out is None:
                    name = f"{task:06d}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    count = size = 0
                data = record(page_id, url, (html or "").encode(), refers_to, revisit)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "records", "bytes"), zip(*done))))

    return run


def write_archives(
    pages: DataFrame, work: Workspace, page_id: str = "page_id", url: str = "url",
    html: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write ``pages``; returns ``(file, records, bytes)`` of the archives.

    A null html is an empty payload.  Of payloads of ``least_bytes`` or more that are equal, rows
    with the least id are responses and the others revisit it; null ids come last.  Every row
    gives a record, repeated ones too.  Other columns are not stored.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    eligible = rows.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    firsts = eligible.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").drop("n")
    revisits = work.table(
        eligible.join(firsts, "digest").filter(~same(F.col("page_id"), F.col("first")))
        .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct(),
        "revisits",
    )
    marked = rows.join(
        revisits, same(F.col("page_id"), F.col("_id")) & (F.col("digest") == F.col("_digest")), "left"
    ).select(
        "page_id", "url", "html", F.col("_digest").isNotNull().alias("revisit"),
        F.col("first").alias("refers_to"),
    )
    written = marked.mapInArrow(
        _write(work.path("archives"), archive_bytes), "file string, records long, bytes long"
    )
    return work.table(written, "archive-list")


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member, to be used up in order."""
    rest = stream.read(PIECE)
    while rest:
        inflater = zlib.decompressobj(31)

        def pieces():
            nonlocal rest
            while not inflater.eof:
                if not rest:
                    rest = stream.read(PIECE)
                    if not rest:
                        raise ValueError("the archive ends within a record")
                piece = inflater.decompress(rest, PIECE)
                rest = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
                if piece:
                    yield piece

        yield pieces()
        rest = rest or stream.read(PIECE)


def _head(buffer: bytearray, pieces: Iterator[bytes]) -> list[bytes]:
    """Lines up to an empty one, taken off ``buffer``, which grows as far as needed."""
    while (end := buffer.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("a record without an end of its headers")
        buffer += piece
    lines = bytes(buffer[:end]).split(b"\r\n")
    del buffer[:end + 4]
    return lines


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode().partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _number(urn: str | None):
    inside = (urn or "").strip("<>").removeprefix(ID)
    return int(inside) if inside else None


def read_record(pieces: Iterator[bytes], keep_payload: bool = False) -> tuple:
    """A row of ``RECORDS`` from the pieces of one member."""
    buffer = bytearray()
    version, *lines = _head(buffer, pieces)
    if not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(lines)
    left = int(fields["content-length"])
    whole, payload, kept = hashlib.sha1(), hashlib.sha1(), bytearray()
    size = 0
    http_lines = _head(buffer, pieces)  # lies within the block
    head = b"\r\n".join(http_lines) + b"\r\n\r\n"
    http = _fields(http_lines[1:])
    whole.update(head)
    left -= len(head)
    while True:
        part = bytes(buffer[:left])
        del buffer[:left]
        whole.update(part)
        payload.update(part)
        size, left = size + len(part), left - len(part)
        if keep_payload:
            kept += part
        if not left:
            break
        buffer += next(pieces, b"")
        if not buffer:
            raise ValueError("a record shorter than its Content-Length")
    for piece in pieces:
        buffer += piece
    if buffer != b"\r\n\r\n":
        raise ValueError("a record longer than its Content-Length")
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    sound = fields["warc-block-digest"].removeprefix("sha1:") == _digest(whole.digest())
    if kind == "response":
        sound = sound and digest == _digest(payload.digest()) and size == int(http["content-length"])
    return (
        _number(fields.get("warc-record-id")), int(http["content-length"]), digest, kind,
        _number(fields.get("warc-refers-to")), fields.get("warc-target-uri"), sound,
        bytes(kept) if keep_payload and kind == "response" else None,
    )


def _read(keep_payload: bool, names: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = dict(zip(names, (
            pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(),
            pa.binary(),
        )))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names
            )

        for batch in batches:
            for file in batch.column("file").to_pylist():
                store, path = _open(file)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for pieces in _members(stream):
                        rows.append(read_record(pieces, keep_payload))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) == 1000 or held >= 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return run


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the listed archives, a task reading whole files one after another.

    A broken frame raises an error; a digest that does not fit gives ``digest_ok`` false.  An
    empty list gives no rows.
    """
    files = max(archives.count(), 1)
    names = [part.split()[0] for part in RECORDS.split(", ")]
    spread = archives.select("file").repartition(files)
    return spread.mapInArrow(_read(keep_payload, names), RECORDS)
