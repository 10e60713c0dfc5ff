"""WARC archives compressed with an embedded Zstandard dictionary (.warc.zst).

An archive begins with a skippable frame that holds the dictionary, itself a Zstandard frame; each record that follows is a frame of
its own, compressed with that dictionary, so that a reader can begin at any record. The dictionary is trained on a
bounded sample of pieces, chosen by hash from all over the payloads to be archived. Archives are rows of a table with their bytes, written by
Spark into the shared folder, so that a task that is run again replaces its files as a whole; `export` has the executors write them as files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stage

SKIPPABLE, LEVEL = 0x184D2A5D, 3
ARCHIVE_BYTES = 16 << 20
#: Pieces of PIECE bytes that the dictionary is trained on, about SAMPLE of them.
SAMPLE, PIECE, DICTIONARY = 3000, 4 << 10, 112_640
SMALL = 1000
#: Bytes handed to the decompressor at once; what it leaves over is read again.
CHUNK = 16 << 10
DATE = "2000-01-01T00:00:00Z"


def train_dictionary(payloads: DataFrame, sample: int = SAMPLE) -> bytes:
    """A dictionary of about `sample` pieces of the distinct payloads, chosen by a hash of payload and place; none gives b''."""
    pieces = F.ceil(F.octet_length("payload") / PIECE).cast("int")
    total = payloads.agg(F.sum(pieces)).first()[0] or 0
    grid = 1 << 30
    chosen = F.filter(F.sequence(F.lit(0), pieces - 1), lambda i: F.pmod(F.xxhash64("sha1", i), F.lit(grid)) < F.lit(grid * min(sample, total) // max(total, 1)))
    some = payloads.where("octet_length(payload) > 0").select("sha1", "payload", F.explode(chosen).alias("i"))
    # Copies of one payload choose the same pieces, which count once.
    rows = some.select("sha1", "i", F.substring("payload", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("x")).dropDuplicates(["sha1", "i"]).toArrow()
    samples = [bytes(x) for x in rows.sort_by([("sha1", "ascending"), ("i", "ascending")]).column("x").to_pylist()]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples to train on
        return b""


def _header(lines: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"


def urn(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, size: int, sha1: bytes, refers_to) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    lines.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()))
    if revisit:
        lines += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(lines) + block + b"\r\n\r\n"


class Archive:
    """An archive in memory, at most ARCHIVE_BYTES and one record long."""

    def __init__(self, dictionary: bytes) -> None:
        self.dictionary = dictionary
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.clear()

    def clear(self) -> None:
        self.parts: list[bytes] = []
        if self.dictionary:
            frame = zstandard.ZstdCompressor(level=19).compress(self.dictionary)
            self.parts.append(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
        body = b"software: kinfold\r\nformat: WARC File Format 1.1\r\n"
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-info:0>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
        self.parts.append(self.packer.compress(_header(info) + body + b"\r\n\r\n"))
        self.size = sum(map(len, self.parts))

    def add(self, data: bytes) -> None:
        frame = self.packer.compress(data)
        self.parts.append(frame)
        self.size += len(frame)


def _write(dictionary: bytes):
    def run(batches):
        from pyspark import TaskContext

        archive, number, held = Archive(dictionary), 0, 0
        part = TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:04d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held], pa.int64()), pa.array([b"".join(archive.parts)], pa.large_binary()).cast(pa.binary())], names=["name", "records", "content"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "size", "sha1", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, size, sha1, refers_to = (c[i].as_py() for c in columns)
                archive.add(record(page_id, url, payload, size, bytes.fromhex(sha1), refers_to))
                held += 1
                if archive.size >= ARCHIVE_BYTES:
                    yield done()
                    archive.clear()
                    number, held = number + 1, 0
        if held:
            yield done()

    return run


def write_warc(pages: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """Archive every row of pages (page_id, url, html); returns the table of archives: name, records, content.

    A null html is an empty payload; null ids and urls are archived without them. Of equal payloads of SMALL bytes or more the
    largest page_id is the response and the others are revisits that refer to it; rows that repeat the largest id are
    responses all. Equal means equal SHA-1 and length. Without a non-null id in a group, all are responses.
    An empty table gives no archive. Other columns are ignored.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    if dictionary is None:
        dictionary = train_dictionary(rows.select("sha1", "payload"))
    kept = (
        rows.where(f"size >= {SMALL}").groupBy("sha1", "size")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    kept = stage(kept, "originals")
    copies = kept.agg(F.sum("n")).first()[0] or 0
    told = join_hot(rows, kept, ["sha1", "size"], "n", copies, "left").withColumn("refers_to", F.when((F.col("page_id") != F.col("original")) | F.col("page_id").isNull(), F.col("original")))
    bare = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    out = told.select("page_id", "url", bare.alias("payload"), "size", "sha1", "refers_to")
    return stage(out.mapInArrow(_write(dictionary), "name string, records long, content binary"), "warc")


def frames(content: bytes | pa.Buffer) -> Iterator[bytes]:
    """The uncompressed frames of an archive, with the dictionary from its leading frame; an archive cut short is an error."""
    content, at, dictionary = memoryview(content), 0, None
    magic, size = struct.unpack_from("<II", content) if len(content) >= 8 else (0, 0)
    if magic == SKIPPABLE:
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(content):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(content):
                raise ValueError("the archive ends within a record")
            piece = content[at : at + CHUNK]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers, by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode().split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    return headers, rest[: int(headers["content-length"])]


def _read(strict: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if len(x) > len("<urn:x-page:>") else None

    def row(data: bytes) -> tuple | None:
        headers, block = parse(data)
        kind = headers["warc-type"]
        if kind == "warcinfo":
            return None
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.lower().split(b"content-length:")[1].split(b"\r\n")[0])
        digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2])
        intact = True
        if kind == "response":  # what was read counts, not what the headers say
            filed, size, digest = (size, digest), len(payload), hashlib.sha1(payload).digest()
            intact = filed == (size, digest)
            if strict and not intact:
                raise ValueError(f"the payload of {headers['warc-record-id']} isn't what its headers say")
        refers = number(headers["warc-refers-to"]) if kind == "revisit" else None
        return number(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest.hex(), kind, refers, intact

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = [r for data in frames(content.as_buffer()) if (r := row(data))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=names)

    return run


def read_warc(archives: DataFrame, strict: bool = True) -> DataFrame:
    """A row for each record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact.

    Size and digest of a response are worked out from the payload that was read; one that differs from its headers is an error
    or, without strict, has intact false. A revisit has no payload, so it gives the size and digest that it is filed under.
    """
    return archives.select("content").mapInArrow(
        _read(strict), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    )


def export(archives: DataFrame, folder: str) -> int:
    """Write archives as files into a folder that all executors reach (a path or URI that Arrow's file systems know); returns how many.

    Each task writes beside the target and renames, so that a task that is run again, or twice, leaves whole files.
    """
    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                aside = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}.inprogress"
                with system.open_output_stream(aside, compression=None) as out:
                    out.write(content.as_buffer())
                system.move(aside, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return archives.select("name", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
