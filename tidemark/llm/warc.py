"""WARC archives in seekable Zstandard bundles (operator 8).

A bundle is a series of independent Zstandard frames of whole WARC records,
then a skippable frame that maps record identifiers to (frame, offset in the
frame, length), then the seek table of the Zstandard seekable format, also a
skippable frame: any Zstandard tool reads the bundle as plain WARC, and one
record is read with three ranged reads.

Bundles are written with ``pyarrow.fs`` below a folder that driver and
executors share, each under a name of its own attempt, so a task that runs
again leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, discard, if_few, remove, scratch, small_batches, table

#: Payloads under so many bytes are never deduplicated.
MIN_BYTES = 100
#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle does.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 25
LEVEL = 3
#: Bytes of pages (about) that a writing task should have at least.
TASK_BYTES = 1 << 23
#: Fixed values of the Zstandard frame formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own."""
    uri = "".join(c if c.isprintable() and c not in " <>" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or f"urn:page:{page_id}")
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(body)}", "Content-Type: text/html; charset=utf-8",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of the records of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        first, *lines = frame[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record: {first[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        yield fields, frame[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def opened(path: str, write: bool) -> pa.NativeFile:
    """A stream of a file below a folder that executors share, whatever its scheme."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if not write:
        return system.open_input_file(place)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(place.rpartition("/")[0], recursive=True)
    return system.open_output_stream(place, compression=None)


class BundleWriter:
    """Collects records into frames and writes one bundle."""

    def __init__(self, path: str) -> None:
        self.out, self.path, self.size = opened(path, True), path, 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self.open: list[bytes] = []
        self.offset = 0

    def add(self, record_id: str, data: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, length) of the record."""
        if self.open and self.offset + len(data) > FRAME_BYTES:
            self.end_frame()
        at = len(self.frames), self.offset, len(data)
        self.index.append((record_id.encode(), *at))
        self.open.append(data)
        self.offset += len(data)
        return at

    def end_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.offset))
            self.size += len(packed)
            self.open, self.offset = [], 0

    def close(self) -> None:
        self.end_frame()
        entries = b"".join(struct.pack("<H", len(i)) + i + struct.pack("<IQQ", f, o, n) for i, f, o, n in self.index)
        entries = self.zstd.compress(entries)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(entries)) + entries)
        seek = b"".join(struct.pack("<II", *x) for x in [*self.frames, (len(entries) + 8, 0)])
        footer = struct.pack("<IBI", len(self.frames) + 1, 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek) + len(footer)) + seek + footer)
        self.out.close()


class BundleReader:
    """Reads a bundle by its seek table; closes its file at the end of a ``with`` block."""

    def __enter__(self) -> BundleReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def __init__(self, path: str) -> None:
        self.file = opened(path, False)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_MAGIC or flags:
            raise ValueError(f"{path}: no seek table")
        self.file.seek(size - 9 - 8 * n)
        raw = self.file.read(8 * n)
        at, self.frames = 0, []
        for i in range(n):
            packed, plain = struct.unpack_from("<II", raw, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.file.seek(at)
        return self.zstd.decompress(self.file.read(packed), max_output_size=max(plain, 1)) if plain else b""

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i, (_, _, plain) in enumerate(self.frames):
            if plain:
                yield from parse(self.frame(i))

    def index(self) -> dict[str, tuple[int, int, int]]:
        """record identifier -> (frame, offset in the frame, length)."""
        at, packed, _ = self.frames[-1]
        self.file.seek(at + 8)
        raw, out, i = self.zstd.decompress(self.file.read(packed - 8)), {}, 0
        while i < len(raw):
            (n,) = struct.unpack_from("<H", raw, i)
            out[raw[i + 2 : i + 2 + n].decode()] = struct.unpack_from("<IQQ", raw, i + 2 + n)
            i += 2 + n + 20
        return out

    def read(self, record_id: str) -> tuple[dict[str, str], bytes]:
        """One record, by its identifier."""
        frame, offset, n = self.index()[record_id]
        return next(parse(self.frame(frame)[offset : offset + n]))


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, revisit, refers_to: which records revisit which.

    Of the pages with equal payloads of at least ``MIN_BYTES`` bytes the one
    with the smallest page_id is the response (rows that repeat it are
    responses too); a null page_id is a response only if all of them are null.
    Digests alone decide, in a table of their own.  The revisits are then
    broadcast to the pages if they are few (counted), so that no payload is
    shuffled; else both sides are shuffled by page and digest.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    digests = cut(rows.where(F.octet_length("html") >= MIN_BYTES).select("page_id", F.unhex(digest).alias("d")), "digests")
    shared = digests.groupBy(F.col("d").alias("s")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = cut(digests.join(shared, F.col("d") == F.col("s")).where("first is not null and not (page_id <=> first)").select(F.col("page_id").alias("p"), "d", "first").distinct(), "revisits")
    discard(digests)
    again = if_few(again)
    rows = rows.withColumn("digest", digest)
    joined = rows.join(again, rows.page_id.eqNullSafe(again.p) & (F.unhex(rows.digest) == again.d), "left")
    return joined.select("page_id", "url", "html", "digest", F.col("d").isNotNull().alias("revisit"), F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as bundles below ``folder``; returns the index (record_id, page_id, bundle, frame, offset, length)."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, bundle, number = f"{task.partitionId():06d}-{uuid.uuid4().hex[:12]}", None, 0
        for b in batches:
            found = []
            for i in range(b.num_rows):
                r = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}
                if bundle is None:
                    bundle = BundleWriter(f"{folder}/{name}-{number:04d}.warc.zst")
                key = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{number}/{len(bundle.index)}')}"
                at = bundle.add(key, record(key, r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["digest"], r["refers_to"], r["revisit"]))
                found.append((key, r["page_id"], bundle.path, *at))
                if bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    bundle, number = None, number + 1
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["record_id", "page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    planned = plan(pages)
    # many small partitions would be as many small bundles
    sizes = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n = max(pages.sparkSession.sparkContext.defaultParallelism, -(-sizes // TASK_BYTES))
    return cut(planned.coalesce(n).mapInArrow(run, "record_id string, page_id long, bundle string, frame int, offset long, length long"), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload_bytes, stored): every record of the bundles of an index, read whole.

    ``stored`` is the SHA-256 of the payload that is there: null for a revisit.
    """
    bundles = index.select("bundle").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "digest", "payload_bytes", "stored"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        rows: list[tuple] = []
        for b in batches:
            for path in b.column(0).to_pylist():
                with BundleReader(path) as bundle:
                    for fields, payload in bundle.records():
                        again = fields["WARC-Type"] == "revisit"
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                        rows.append((number("Page-ID"), fields["WARC-Type"], number("Refers-To-Page-ID"), fields["WARC-Payload-Digest"].removeprefix("sha256:"), None if again else len(payload), None if again else hashlib.sha256(payload).hexdigest()))
                        if len(rows) >= 4096:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)

    return bundles.mapInArrow(run, "page_id long, record_type string, refers_to long, digest string, payload_bytes long, stored string")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, written and read back.

    Null html is an empty payload.  A revisit takes its size from the response
    that it refers to; a payload that doesn't have its digest is an error.
    Without a ``folder`` the bundles are deleted once they have been read.
    """
    spark, own = pages.sparkSession, folder is None
    folder = folder or scratch(spark, "warc")
    index = write_archives(pages, folder)
    back = cut(read_archives(index), "warc-records")
    if own:  # nobody was given the folder's name
        discard(index)
        remove(spark, folder)
    fine = back.withColumn("payload_digest", F.when(F.col("stored").isNull() | (F.col("stored") == F.col("digest")), F.col("digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))))
    plain = fine.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kept = plain.where("page_id is not null").select(F.col("page_id").alias("id"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("size")).distinct()
    again = fine.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    resolved = again.join(kept, (again.refers_to == kept.id) & (again.payload_digest == kept.d), "left")
    return plain.unionByName(resolved.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page."""
    return archive(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
