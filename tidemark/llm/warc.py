"""WARC archives: records from pages, and a normaliser for monolithic gzip files.

A monolithic file is one gzip stream over all of its records, so nothing in it can be read without inflating all that
comes before. The normaliser inflates each file once, as a stream, and writes every record as a gzip member of its own;
a sidecar index holds offset and length of each member with the record's type and id, so readers seek. A task holds a few
blocks of a file, not a record: contents are copied block by block by their Content-Length. Files that already consist of
members are read alike.

Records keep equal payloads once: of records with equal payloads of at least `least` bytes the one with the largest
page_id is a `response`, the others are `revisit` records that refer to it. A revisit has the HTTP head of its response,
with the full payload's length, and the payload's digest, but no payload.

Null html is an empty payload; null url writes no target. A null page_id is never the largest: such a record revisits
the largest other id, or is a response if there is none. Repeated rows with the largest id are all responses. Control
characters in a url are percent-encoded. Other columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, keep, new_folder

LEAST = 1000
#: A file takes no further record once its records have so many bytes.
FILE_BYTES = 256 << 20
BLOCK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-page:(null|-?\d+)>")


class FormatError(ValueError):
    pass


def _page(urn: str) -> int | None:
    m = _ID.fullmatch(urn)
    if not m:
        raise FormatError(f"not a page's id: {urn}")
    return None if m[1] == "null" else int(m[1])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit if it refers to another page's."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class _Inflated:
    """A gzip file of one or more members as a stream of plain bytes."""

    def __init__(self, file):
        self.file, self.inflate, self.held, self.ended = file, zlib.decompressobj(31), bytearray(), False
        self.raw = b""

    def _more(self) -> bool:
        while not self.ended:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                self.inflate = zlib.decompressobj(31)
                if not self.raw and not (raw := self.file.read(BLOCK)):
                    self.ended = True
                    break
                self.raw = self.raw or raw
            elif self.inflate.unconsumed_tail:
                self.raw = self.inflate.unconsumed_tail
            else:
                self.raw = self.raw or self.file.read(BLOCK)
                if not self.raw:
                    raise FormatError("the gzip stream ends early")
            got, self.raw = self.inflate.decompress(self.raw, BLOCK), b""
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with the mark; empty at the end of the file."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held:
                    raise FormatError("the last record is cut off")
                return b""
        return self._take(found + len(mark))

    def blocks(self, n: int):
        """The next n bytes, in blocks."""
        while n:
            if not self.held and not self._more():
                raise FormatError("the last record is cut off")
            part = self._take(min(n, len(self.held)))
            n -= len(part)
            yield part

    def _take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise FormatError(f"not a record: {lines[0][:40]}")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def write_monolithic(pages: DataFrame, folder: str, least: int = LEAST, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as whole-file gzip streams; returns the kept list of files (path)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # Only payloads that occur more than once are looked up; the wide side can be split where a payload is frequent.
    first = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null").select("digest", "best")
    marked = rows.join(first, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))

    def write(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, size, paths = None, 0, []
        for batch in batches:
            for p, u, h, r in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    paths.append(f"{root}/{uuid.uuid4().hex}.warc.gz")
                    out, size, z = fs.open_output_stream(paths[-1], compression=None), 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(p.as_py(), u.as_py(), h.as_py().encode(), r.as_py())
                size += len(data)
                out.write(z.compress(data))
                if size >= FILE_BYTES:
                    out.write(z.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return keep(marked.mapInArrow(write, "path string"), "files")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each file (path) with a member per record and a sidecar index; returns the kept list (path, index_path)."""

    def rewrite(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for path in batch.column(0).to_pylist():
                name = f"{root}/{uuid.uuid4().hex}"
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(f"{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{name}.idx", compression=None) as index:
                    plain, at = _Inflated(source), 0
                    while head := plain.until(b"\r\n\r\n"):
                        fields = _fields(head)
                        z, begin = zlib.compressobj(6, zlib.DEFLATED, 31), at
                        for part in itertools.chain([head], plain.blocks(int(fields["content-length"]) + 4)):
                            at += _put(out, z.compress(part))
                        at += _put(out, z.flush())
                        index.write(f"{begin} {at - begin} {fields['warc-type']} {fields['warc-record-id']}\n".encode())
                done.append((f"{name}.warc.gz", f"{name}.idx"))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["path", "index_path"])

    return keep(_spread(files).mapInArrow(rewrite, "path string, index_path string"), "files")


def _put(out, data: bytes) -> int:
    out.write(data)
    return len(data)


def _spread(files: DataFrame) -> DataFrame:
    """A task per file, as far as a few thousand tasks go."""
    return files.repartition(max(1, min(files.count(), 5000)), "path")


def read_records(files: DataFrame) -> DataFrame:
    """Read archives member by member through their indexes: page_id, payload_bytes, payload_digest (hex), record_type,
    refers_to. The digest of a response is computed again and must be the record's."""

    def read(batches):
        for batch in batches:
            for path, index_path in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                fs, _ = file_system(path)
                with fs.open_input_stream(index_path, compression=None) as f:
                    entries = [x.split(" ") for x in f.read().decode().splitlines()]
                with fs.open_input_file(path) as source:
                    for a in range(0, len(entries), 1000):
                        rows = []
                        for offset, length, kind, urn in entries[a : a + 1000]:
                            source.seek(int(offset))
                            data = zlib.decompress(source.read(int(length)), 31)
                            head, _, block = data.partition(b"\r\n\r\n")
                            fields = _fields(head + b"\r\n\r\n")
                            http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
                            n = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                            digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                            if kind != fields["warc-type"] or urn != fields["warc-record-id"]:
                                raise FormatError(f"the index of {path} is not that of its records")
                            if kind == "response" and (n != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
                                raise FormatError(f"the payload of {urn} is not what its record says")
                            rows.append((_page(urn), n, digest, kind, _page(fields["warc-refers-to"]) if kind == "revisit" else None))
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _spread(files).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write pages, normalise the files, and read the archives back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_records(normalise(write_monolithic(pages, f"{folder}/whole", **options), f"{folder}/records"))
