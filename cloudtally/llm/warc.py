"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Every row becomes one gzip member with one record. Rows with equal payloads share one response
record, that of the largest id; the others are revisit records that refer to it. Tasks write
files of bounded size under the given folder and tell which files are complete, so what a lost or
repeated task left behind is never read.

The reader walks from member to member (or, in plain files, from record to record) with a bounded buffer.
After a failed check (broken compression, a bad header, a wrong length or digest) it searches
for the next place where a valid member or version line begins, goes on from there, and reports the
bytes between as a gap with the reason. Nothing before or behind the damage is lost.

A null payload counts as empty and rows repeat freely; equal ids give equal record ids, and rows with a null
id revisit one with an id, or are responses where none of their payload has one. A record needs the memory of its own payload, a file that of one record. What a
Spark cell can hold is written and read back; a reader with a smaller ``longest`` takes longer records for damage.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.functions.skew import sized_join
from cloudtally.llm import arrow
from cloudtally.runtime import durable, new_folder

FILE_BYTES = 16 << 20
CHUNK = 1 << 16
LONGEST_RECORD = (1 << 31) - 1
READ_TASKS = 20_000
LONGEST_HEADER = 1 << 16
VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str | int | None], payload: bytes) -> bytes:
    """One record; fields without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": len(payload)}).items() if v is not None)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def squeeze(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# --- reading ----------------------------------------------------------------------------------


class Damaged(Exception):
    """Why what begins here is no valid record."""


class Short(Exception):
    """The data end too early, by so many bytes at least."""

    def __init__(self, need: int) -> None:
        super().__init__(need)
        self.need = need


class Buffer:
    """The part of a stream that is looked at, and its place in the stream.

    A byte array grows at its end and shrinks at its start without being copied each time.
    """

    def __init__(self, stream) -> None:
        self.stream, self.data, self.place, self.ended = stream, bytearray(), 0, False

    def more(self, need: int = CHUNK) -> bool:
        got = b"" if self.ended else self.stream.read(max(need, CHUNK))
        self.ended = not got
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.place += n


def parse(data: bytes | bytearray, at: int = 0, longest: int = LONGEST_RECORD) -> tuple[dict[str, str], bytes, int]:
    """Fields, payload and length of the record that begins at ``at``; raises Damaged, or Short
    where the data end too early."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        if len(data) - at > LONGEST_HEADER:
            raise Damaged("endless header")
        raise Short(CHUNK)
    if end - at > LONGEST_HEADER:
        raise Damaged("endless header")
    fields: dict[str, str] = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("bad length")
    size = int(fields["content-length"])
    if size > longest:
        raise Damaged("too long")
    stop = end + 4 + size
    if len(data) < stop + 4:
        raise Short(stop + 4 - len(data))
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("wrong length")
    payload = bytes(data[end + 4 : stop])
    told = fields.get("warc-block-digest", "")
    if told and told != f"sha1:{digest(payload)}":
        raise Damaged("wrong digest")
    return fields, payload, stop + 4 - at


def _member(buffer: Buffer, longest: int) -> tuple[bytes, int]:
    """Content and length of the gzip member at the start of the buffer."""
    unpack, content, at = zlib.decompressobj(31), bytearray(), 0
    most = longest + LONGEST_HEADER
    try:
        while not unpack.eof:
            if at == len(buffer.data) and not buffer.more():
                raise Damaged("cut off")
            content += unpack.decompress(buffer.data[at : at + CHUNK], most)
            if unpack.unconsumed_tail or len(content) > most:
                raise Damaged("too long")
            at = min(at + CHUNK, len(buffer.data))
    except zlib.error as e:
        raise Damaged("broken compression") from e
    return content, at - len(unpack.unused_data)


def _next(buffer: Buffer, longest: int) -> tuple[str, list | tuple]:
    """The records at the start of the buffer, and how many bytes they take."""
    if buffer.data.startswith(MAGIC):
        content, size = _member(buffer, longest)
        found, at = [], 0
        while at < len(content):
            try:
                fields, payload, n = parse(content, at, longest)
            except Short:
                raise Damaged("cut off") from None
            found.append((fields, payload))
            at += n
        return found, size
    while True:
        try:
            fields, payload, size = parse(buffer.data, 0, longest)
            return [(fields, payload)], size
        except Short as e:
            if not buffer.more(e.need):
                raise Damaged("cut off") from None


def _search(buffer: Buffer) -> int:
    """Where behind the first byte a member or a record may begin next."""
    at = 1
    while True:
        hits = [p for p in (buffer.data.find(MAGIC, at), buffer.data.find(VERSION, at)) if p >= 0]
        if hits:
            return min(hits)
        at = max(at, len(buffer.data) - len(VERSION) + 1)
        if not buffer.more():
            return len(buffer.data)


def salvage(stream, longest: int = LONGEST_RECORD) -> Iterator[tuple]:
    """("record", place, length, fields, payload) and ("gap", place, length, reason, None) in file order."""
    buffer, gap = Buffer(stream), None
    while buffer.data or buffer.more():
        while len(buffer.data) < len(VERSION) and buffer.more():
            pass
        try:
            found, size = _next(buffer, longest)
        except Damaged as e:
            gap = gap or (buffer.place, str(e))
            buffer.skip(_search(buffer))
            continue
        if gap:
            yield "gap", gap[0], buffer.place - gap[0], gap[1], None
            gap = None
        for fields, payload in found:
            yield "record", buffer.place, size, fields, payload
        buffer.skip(size)
    if gap:
        yield "gap", gap[0], buffer.place - gap[0], gap[1], None


READ = "file string, kind string, place long, length long, reason string, fields map<string,string>, payload binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    names = ["file", "kind", "place", "length", "reason", "fields", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    columns = list(zip(*found, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read(files: DataFrame, longest: int = LONGEST_RECORD) -> DataFrame:
    """Records and gaps of the archives named in column ``file``; each file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                system, path = pafs.FileSystem.from_uri(uri)
                held, size = [], 0
                with system.open_input_stream(path) as stream:
                    for kind, place, length, told, payload in salvage(stream, longest):
                        fields = list(told.items()) if kind == "record" else None
                        held.append((uri, kind, place, length, None if fields is not None else told, fields, payload))
                        size += len(payload or b"")
                        if size > arrow.SLICE_BYTES:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    return files.select("file").mapInArrow(run, READ)


# --- writing ----------------------------------------------------------------------------------


def _uri(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (id, url, payload) to WARC files in ``folder``; returns the names of the files.

    Payloads of at least ``min_bytes`` are stored once.
    """
    told = pages.select(
        F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce("payload", F.lit(b"")).alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    many = F.when(F.length("payload") >= min_bytes, F.col("sha"))
    repeated = (
        told.select("id", many.alias("sha")).filter("sha is not null").groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    )
    keep = F.when(F.length("payload") >= min_bytes, F.col("first"))
    # few payloads repeat: while their digests are few, payloads stay where they are
    rows = sized_join(told, repeated.select("sha", "first"), ["sha"]).select(
        "id", "url", F.col("sha"), F.when(keep.isNotNull() & ~F.col("id").eqNullSafe(keep), keep).alias("refers"), "payload"
    )
    base = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(base)
        system.create_dir(root, recursive=True)
        done, out, size, name = [], None, 0, ""
        for batch in batches:
            for part in arrow.slices(batch, "payload"):
                for row in part.to_pylist():
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, size = system.open_output_stream(f"{root}/{name}", compression=None), 0
                    payload, again = row["payload"], row["refers"] is not None
                    sha = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                    fields = {
                        "WARC-Type": "revisit" if again else "response",
                        "WARC-Record-ID": f"<urn:page:{row['id']}>",
                        "WARC-Target-URI": (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A") or None,
                        "WARC-Payload-Digest": f"sha1:{sha}",
                        "WARC-Payload-Length": len(payload),
                        "WARC-Block-Digest": f"sha1:{digest(b'')}" if again else f"sha1:{sha}",
                        "WARC-Refers-To": f"<urn:page:{row['refers']}>" if again else None,
                        "WARC-Profile": PROFILE if again else None,
                    }
                    size += out.write(squeeze(record(fields, b"" if again else payload)))
                    if size >= file_bytes:
                        out.close()
                        done.append(f"{base}/{name}")
                        out = None
        if out is not None:
            out.close()
            done.append(f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    return durable(rows.mapInArrow(run, "file string"))


def round_trip(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    files = archive(pages, new_folder(pages.sparkSession), min_bytes, file_bytes)
    return read(files.repartition(max(1, min(files.count(), READ_TASKS))))
