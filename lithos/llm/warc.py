"""WARC records in ZIP-packaged archives: a writer, and a reader by directory and range."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
TARGET = 64 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: str, url: str | None, payload: bytes, name: str, refers_to: str | None) -> bytes:
    """A WARC 1.1 record, one gzip member. A revisit holds no payload."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Payload-Digest: sha1:{name}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {page_id}", "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    body = b"" if kind == "revisit" else payload
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


# ---- ZIP -------------------------------------------------------------------

_LOCAL, _CENTRAL, _END, _END64, _FIND64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
_FULL = 0xFFFFFFFF


def local_header(name: bytes, size: int, crc: int, zip64: bool) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
    n = _FULL if zip64 else size
    return _LOCAL + struct.pack("<HHHHHIIIHH", 45 if zip64 else 20, 0, 0, 0, 33, crc, n, n, len(name), len(extra)) + name + extra


def directory(members: list[tuple[bytes, int, int, int]], at: int, zip64: bool) -> bytes:
    """Central directory and ends for members ``(name, size, crc, offset)``, to be written at ``at``."""
    out = b""
    for name, size, crc, offset in members:
        extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if zip64 else b""
        n, o = (_FULL, _FULL) if zip64 else (size, offset)
        out += _CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if zip64 else 20, 0, 0, 0, 33, crc, n, n, len(name), len(extra), 0, 0, 0, 0, o) + name + extra
    length, count = len(out), len(members)
    if zip64:
        out += _END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, at) + _FIND64 + struct.pack("<IQI", 0, at + length, 1)
        return out + _END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, _FULL, _FULL, 0)
    return out + _END + struct.pack("<HHHHIIH", 0, 0, count, count, length, at, 0)


Reader = Callable[[int, int], bytes]


def central_directory(read: Reader, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file: name to (method, offset of the data, packed size), from its directories only.

    ``read(offset, length)`` reads a range. The end record is looked for in
    the last 64 KB, its ZIP64 form behind its locator; sizes and offsets that
    do not fit in 32 bits come from the ZIP64 extra fields.
    """
    tail_at = max(0, size - 65557 - 20)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail)):
        end = tail.rfind(_END, 0, end)  # the mark stands in a note
    if end < 0:
        raise ValueError("no ZIP file")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == _FIND64 and (count == 0xFFFF or length == _FULL or at == _FULL):
        (end64,) = struct.unpack_from("<Q", tail, end - 12)
        head = read(end64, 56)
        if head[:4] != _END64:
            raise ValueError("broken ZIP64 end record")
        count, length, at = struct.unpack_from("<QQQ", head, 32)
    raw, found, i = read(at, length), {}, 0
    for _ in range(count):
        if raw[i : i + 4] != _CENTRAL:
            raise ValueError("broken ZIP directory")
        method, packed, plain = struct.unpack_from("<H8xII", raw, i + 10)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", raw, i + 28)
        (offset,) = struct.unpack_from("<I", raw, i + 42)
        name = raw[i + 46 : i + 46 + n_name].decode()
        j, stop = i + 46 + n_name, i + 46 + n_name + n_extra
        while j + 4 <= stop:
            tag, n = struct.unpack_from("<HH", raw, j)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", raw, j + 4))
                plain = next(wide) if plain == _FULL else plain
                packed = next(wide) if packed == _FULL else packed
                offset = next(wide) if offset == _FULL else offset
            j += 4 + n
        found[name] = (method, offset, packed)
        i += 46 + n_name + n_extra + n_note
    out = {}
    for name, (method, offset, packed) in found.items():
        head = read(offset, 30)
        if head[:4] != _LOCAL:
            raise ValueError("broken ZIP member")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        out[name] = (method, offset + 30 + n_name + n_extra, packed)
    return out


class ArchiveWriter:
    """One ZIP file with a stored member of gzip records and a stored index.

    Records are streamed to the file; only the index is held. The size of
    the first member is known at its end, so the data go first to the file
    behind a ZIP64 local header whose sizes a data descriptor completes.
    """

    def __init__(self, folder: str) -> None:
        self.store, root = open_store(folder)
        self.store.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.wacz"
        self.file = self.store.open_output_stream(f"{root}/{self.name}")
        self.rows: list[str] = []
        self.crc = self.size = 0
        name = DATA.encode()
        # bit 3: sizes follow the data; the directory has them too
        head = _LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, _FULL, _FULL, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 0, 0)
        self.file.write(head)
        self.start = len(head)

    def add(self, member: bytes) -> None:
        self.rows.append(json.dumps({"offset": self.size, "length": len(member)}))
        self.file.write(member)
        self.crc = zlib.crc32(member, self.crc)
        self.size += len(member)

    def close(self) -> tuple[str, int, int]:
        """The file's name, records and bytes."""
        at = self.start + self.size
        note = b"PK\7\x08" + struct.pack("<IQQ", self.crc, self.size, self.size)
        index = "".join(x + "\n" for x in self.rows).encode()
        crc = zlib.crc32(index)
        head = local_header(INDEX.encode(), len(index), crc, True)
        members = [(DATA.encode(), self.size, self.crc, 0), (INDEX.encode(), len(index), crc, at + len(note))]
        end_at = at + len(note) + len(head) + len(index)
        end = directory(members, end_at, True)
        self.file.write(note + head + index + end)
        self.file.close()
        return self.name, len(self.rows), end_at + len(end)


def write_archives(pages: DataFrame, folder: str, target: int = TARGET) -> DataFrame:
    """Archives in ``folder`` from ``(page_id, url, payload binary, digest, refers_to)``: ``(archive, records, bytes)``.

    A row with refers_to is a revisit. Each task writes files of about
    ``target`` bytes under names of its own; those of a task that failed or
    ran twice are in no returned row, so nothing reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, writer = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, name, refers = (batch.column(c)[i].as_py() for c in range(5))
                writer = writer or ArchiveWriter(folder)
                page = "" if page is None else str(page)
                writer.add(record("revisit" if refers is not None else "response", page, url, payload, name, None if refers is None else str(refers)))
                if writer.size >= target:
                    out.append(writer.close())
                    writer = None
        if writer:
            out.append(writer.close())
        names, records, sizes = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    return materialize(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, records long, bytes long"), "manifest")


RANGE = 2_000


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)`` of all records; ids as strings.

    Archives are read in ranges of 2,000 records, each by any task. A range
    reads the ZIP directories, its part of the stored index and then its
    records from the stored member, by offset; nothing is unpacked to disk.
    """
    ranges = archives.select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(RANGE).cast("long"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name, size, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    read = lambda at, n: file.read_at(n, at)  # noqa: B023,E731
                    members = central_directory(read, size)
                    method, at, length = members[INDEX]
                    data_method, data_at, _ = members[DATA]
                    if method or data_method:
                        raise ValueError(f"{name}: members must be stored")
                    index = read(at, length).split(b"\n")[first : first + RANGE]
                    cols: list[list] = [[] for _ in range(7)]
                    held = 0
                    for line in index:
                        if not line:
                            continue
                        entry = json.loads(line)
                        fields, body = parse_record(read(data_at + entry["offset"], entry["length"]))
                        kind = fields["WARC-Type"]
                        url = fields.get("WARC-Target-URI")
                        row = (fields["X-Page-ID"] or None, None if url is None else json.loads(f'"{url}"'), None if kind == "revisit" else body, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, fields.get("X-Refers-To-Page"))
                        if kind == "response" and digest(body) != row[4]:
                            raise ValueError(f"{name}: digest of record at {entry['offset']} differs")
                        for c, x in zip(cols, row, strict=True):
                            c.append(x)
                        held += len(body)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
                            cols, held = [[] for _ in range(7)], 0
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    # a stated number, for ranges are small rows that adaptive planning would put in one task
    n = archives.agg(F.coalesce(F.sum(F.ceil(F.col("records") / RANGE)), F.lit(0))).first()[0]
    spread = ranges.repartition(max(1, min(int(n), 10_000)), F.col("archive"), F.col("first"))
    return spread.mapInArrow(run, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)`` of ``pages (page_id, url, html)``.

    Payload: the html in UTF-8, null: empty. Of equal payloads of ``least``
    bytes and more, the row of the smallest page_id is the response, and
    refers_to of the others is that page_id; null page_ids come last. Rows
    that repeat the smallest page_id with an equal payload stay responses.
    Only page_ids and digests are grouped, and digests that occur once drop
    out before the join.
    """
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("hex", F.sha1("payload"))
    first = base.filter(F.length("payload") >= least).groupBy("hex").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("hex", "first")
    first = materialize(first, "first")
    joined = base.join(first, "hex", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", base32("hex").alias("digest"), refers.alias("refers_to"))


def base32(hex_col: str):  # noqa: ANN201
    """Upper-case base 32 of a hex digest of 40 digits: five digits are four characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(8):
        n = F.conv(F.substring(hex_col, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """The records of ``read_archives`` after ``write_archives`` of all ``pages``; page ids in their own type.

    Empty pages give no record and no row; rows of equal page_id come back each. A
    payload of any length is one record, held by one task.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    manifest = write_archives(with_revisits(pages, least), folder)
    back = read_archives(manifest, folder)
    return back.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
