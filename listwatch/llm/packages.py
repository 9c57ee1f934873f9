"""Web archives in ZIP packages: written in tasks, and read by ranges.

A package is a ZIP file with stored members: ``archive/data.warc.gz``, one compressed member per WARC record,
and ``indexes/index.cdxj``, a line per record with its place.  Reading takes three small steps.  The end of the
file names the central directory (through the ZIP64 records, if there are any), the directory names the
members and where they begin, and the index names the records.  Every record is then one range of the
file, so records are read in parallel, in any selection, and nothing is extracted.

Files are opened through ``pyarrow.fs``, in tasks, under the shared folder.
"""

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from listwatch.llm.common import staged
from listwatch.session import scratch_dir

#: Reads bytes: (offset, length) -> bytes, fewer at the end of the file.
Reader = Callable[[int, int], bytes]

# Fixed values of the ZIP format: signatures, header sizes, markers of fields that the ZIP64 records hold.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_BYTES, LOCATOR_BYTES, CENTRAL_BYTES, LOCAL_BYTES, COMMENT_BYTES = 22, 20, 46, 30, 0xFFFF
WIDE_16, WIDE_32, WIDE_EXTRA = 0xFFFF, 0xFFFFFFFF, 1

# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


class Damaged(ValueError):
    """A package or record that does not follow its format."""


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or uri, and the path in it."""
    if re.match("file:|/", path):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Member:
    """A member of a package; ``start`` is where its bytes begin in the file."""

    name: str
    stored: bool
    start: int
    size: int


def _exactly(read: Reader, offset: int, length: int) -> bytes:
    data = read(offset, length)
    if len(data) != length:
        raise Damaged(f"{length} bytes wanted at {offset}, {len(data)} there")
    return data


def _directory_place(read: Reader, size: int) -> tuple[int, int, int]:
    """(offset, size, shift) of the central directory; shift is what was put before the whole package."""
    tail_at = max(0, size - END_BYTES - COMMENT_BYTES)
    tail = _exactly(read, tail_at, size - tail_at)
    at = len(tail) - END_BYTES
    # A comment may hold the signature too: the record that ends with the file counts.
    while at >= 0 and not (tail[at: at + 4] == END and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - END_BYTES):
        at = tail.rfind(END, 0, at + 3) if at else -1
    if at < 0:
        raise Damaged("no end of central directory")
    length, offset = struct.unpack_from("<II", tail, at + 12)
    ends = tail_at + at
    if ends >= LOCATOR_BYTES and (locator := read(ends - LOCATOR_BYTES, LOCATOR_BYTES))[:4] == LOCATOR64:
        there = struct.unpack_from("<Q", locator, 8)[0]
        # What stands before the package moves the record; it ends at its locator unless it has extensions.
        for place in (there, ends - LOCATOR_BYTES - 56):
            record = read(place, 56)
            if len(record) == 56 and record[:4] == END64:
                length, offset = struct.unpack_from("<QQ", record, 40)
                return offset, length, place - offset - length
        raise Damaged("no ZIP64 end of central directory")
    return offset, length, ends - offset - length


def directory(read: Reader, size: int) -> list[Member]:
    """The members that the central directory names, in its order."""
    offset, length, shift = _directory_place(read, size)
    if shift < 0:
        raise Damaged("central directory beyond the end")
    central, at, found = _exactly(read, offset + shift, length), 0, []
    while at < len(central):
        if central[at: at + 4] != CENTRAL or at + CENTRAL_BYTES > len(central):
            raise Damaged(f"no directory entry at {at}")
        flags, method = struct.unpack_from("<HH", central, at + 8)
        packed, full, name, extra, comment = struct.unpack_from("<IIHHH", central, at + 20)
        local = struct.unpack_from("<I", central, at + 42)[0]
        names = at + CENTRAL_BYTES
        text = central[names: names + name].decode("utf-8" if flags & 0x800 else "cp437")
        packed, local = _widened(central[names + name: names + name + extra], full, packed, local)
        header = _exactly(read, local + shift, LOCAL_BYTES)
        if header[:4] != LOCAL:
            raise Damaged(f"no member at {local + shift}")
        begins = local + shift + LOCAL_BYTES + sum(struct.unpack_from("<HH", header, 26))
        if begins + packed > offset + shift:
            raise Damaged(f"member {text} beyond the directory")
        found.append(Member(text, method == 0 and not flags & 1, begins, packed))
        at = names + name + extra + comment
    return found


def _widened(extra: bytes, full: int, packed: int, local: int) -> tuple[int, int]:
    """Packed size and offset, from the ZIP64 field where the entry's own are full."""
    at = 0
    while at + 4 <= len(extra):
        tag, length = struct.unpack_from("<HH", extra, at)
        if tag == WIDE_EXTRA:
            values = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            try:
                full = next(values) if full == WIDE_32 else full
                packed = next(values) if packed == WIDE_32 else packed
                local = next(values) if local == WIDE_32 else local
            except StopIteration:
                raise Damaged("ZIP64 field too short") from None
        at += 4 + length
    return packed, local


def index_lines(read: Reader, members: list[Member]) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record that the stored indexes name."""
    data = {m.name.rpartition("/")[2]: m for m in members if m.stored and m.name.startswith("archive/")}
    for index in (m for m in members if m.stored and m.name.startswith("indexes/") and m.name.endswith(".cdxj")):
        for line in _exactly(read, index.start, index.size).split(b"\n"):
            if line.strip():
                try:
                    fields = json.loads(line[line.index(b"{"):])
                    member, offset, length = data[fields["filename"]], int(fields["offset"]), int(fields["length"])
                except (ValueError, KeyError) as error:
                    raise Damaged(f"index line {line[:80]!r}") from error
                if offset < 0 or length < 0 or offset + length > member.size:
                    raise Damaged(f"record at {offset} beyond {member.name}")
                yield member.start + offset, length


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    status: dict[str, str]
    payload: bytes


def parse_record(data: bytes) -> Record:
    """A WARC record from its compressed range: header fields in lower case, HTTP fields, payload."""
    try:
        data = zlib.decompress(data, 31)
    except zlib.error as error:
        raise Damaged("record does not decompress") from error
    head, found, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = _fields(lines[1:])
    if not found or not lines[0].startswith("WARC/") or len(block) < int(fields.get("content-length", -1)) or "content-length" not in fields:
        raise Damaged("no whole WARC record")
    block = block[: int(fields["content-length"])]
    if not fields.get("content-type", "").startswith("application/http"):
        return Record(fields, {}, block)
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(fields, _fields(http.decode("utf-8", "replace").split("\r\n")[1:]), payload)


def _fields(lines: list[str]) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + squeeze.flush()


class Package:
    """One package being written; records go straight to the file, index lines are held until the end."""

    def __init__(self, folder: str, captured: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        files, inner = filesystem(self.path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        self.stream = files.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.captured, self.offset, self.lines = captured, 0, []
        self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", captured),
                           ("Content-Type", "application/warc-fields")], b"software: listwatch\r\n"))

    def _put(self, record: bytes) -> None:
        self.data.write(record)
        self.offset += len(record)

    def add(self, name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> None:
        """A response with its payload, or a revisit that keeps only the payload's length and digest."""
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        kind = "response" if refers_to is None else "revisit"
        url = None if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))))
        record = _record([
            ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", self.captured), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", None if refers_to is None else REVISIT),
            ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
            ("Content-Type", "application/http;msgtype=response")], http + (payload if refers_to is None else b""))
        where = {"url": url, "mime": "text/html" if refers_to is None else "warc/revisit", "status": "200", "digest": f"sha1:{digest}",
                 "length": len(record), "offset": self.offset, "filename": DATA.rpartition("/")[2]}
        self.lines.append(f"{url or '-'} {re.sub('[^0-9]', '', self.captured)} {json.dumps(where)}\n")
        self._put(record)

    def close(self) -> tuple[str, int]:
        """Path and number of records."""
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.lines)))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({
            "profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": n.rpartition("/")[2], "path": n} for n in (DATA, INDEX)]}))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines)


@dataclass(frozen=True)
class WarcPackages:
    """Writes pages to packages and reads packages.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one with the smallest id is a
    response and the others revisit it; a null id comes last, and of rows that repeat both id and
    payload one counts as the smallest.  A page with a shorter payload is always a response.  Null html is
    an empty payload, a null url gives a record without one.  Other columns are ignored, whatever their
    names.  An empty table makes no package.

    A package is closed after ``package_bytes``; a task holds one record and the index lines of one package.
    Files have new names on every attempt, and only those that ``write`` returns belong to the result, so a
    task that is run again does no harm.
    """

    revisit_bytes: int = 0
    package_bytes: int = 64 << 20
    captured: str = "2000-01-01T00:00:00Z"
    id: str = "page_id"
    url: str = "url"
    html: str = "html"

    def write(self, pages: DataFrame, folder: str | None = None) -> DataFrame:
        """(path, records) of the packages written under ``folder``, by default a new one in the scratch folder."""
        spark = pages.sparkSession
        folder = folder or scratch_dir(spark, "packages")
        html = F.coalesce(F.col(self.html), F.lit(""))
        rows = pages.select(F.col(self.id).alias("id"), F.col(self.url).alias("url"), html.alias("html"), F.sha2(html, 256).alias("key"))
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "payloads")
        order = F.struct(F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("row").alias("row"))
        groups = (rows.where(F.octet_length("html") >= self.revisit_bytes).groupBy("key")
                  .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
        # Both sides are plain scans, so copies of a hot payload are split at run time.
        groups = staged(groups.select("key", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")), "groups")
        name = lambda i, row: F.concat_ws("/", F.coalesce(F.col(i).cast("string"), F.lit("")), F.col(row).cast("string"))
        refers = F.when((F.col("row") != F.col("first_row")) & (F.octet_length("html") >= self.revisit_bytes), name("first_id", "first_row"))
        found = rows.join(groups, "key", "left").select(name("id", "row").alias("name"), "url", "html", refers.alias("refers_to"))

        def pack(batches):
            package = None
            for batch in batches:
                for row in batch.to_pylist():
                    package = package or Package(folder, self.captured)
                    payload = row["html"].encode()
                    package.add(quote(row["name"], safe="/"), row["url"], payload, payload_digest(payload),
                                row["refers_to"] and quote(row["refers_to"], safe="/"))
                    if package.offset >= self.package_bytes:
                        yield _batch(["path", "records"], [package.close()])
                        package = None
            if package:
                yield _batch(["path", "records"], [package.close()])

        return staged(found.mapInArrow(pack, "path string, records long"), "manifest")

    def places(self, packages: DataFrame) -> DataFrame:
        """path, at, length and problem of every record that the indexes of the packages (path) name.

        A package that cannot be read gives one row with a problem and no place.
        """
        def locate(batches):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    try:
                        with _opened(path) as file:
                            size = file.size()
                            read = lambda at, length: file.read_at(max(0, min(length, size - at)), min(at, size))  # noqa: B023, E731
                            found = list(index_lines(read, directory(read, size)))
                    except (Damaged, OSError, struct.error, UnicodeDecodeError) as error:
                        yield _batch(["path", "at", "length", "problem"], [(path, None, None, str(error))])
                        continue
                    for i in range(0, len(found), 10_000):
                        yield _batch(["path", "at", "length", "problem"], [(path, a, n, None) for a, n in found[i: i + 10_000]])

        return packages.select("path").mapInArrow(locate, "path string, at long, length long, problem string")

    def read(self, places: DataFrame, payload: bool = True) -> DataFrame:
        """Every record at ``places``: path, at, type, name, uri, refers_to, payload_bytes, payload_digest, problem, payload.

        ``name`` and ``refers_to`` are ids as text, null where there is none.  The length and digest of a
        response are those of its payload and must be what the record says; a revisit only says them.
        Without ``payload`` that column is null.  Damaged records have a problem.
        """
        columns = ["path", "at", "type", "name", "uri", "refers_to", "payload_bytes", "payload_digest", "problem", "payload"]

        def fetch(batches):
            path = file = None
            for batch in batches:
                out, held = [], 0
                for row in batch.to_pylist():
                    if row["problem"] is not None:
                        out.append((row["path"], row["at"], *[None] * 6, row["problem"], None))
                        continue
                    try:
                        if path != row["path"]:
                            if file:
                                file.close()
                            path, file = None, None
                            file, path = _opened(row["path"]), row["path"]
                        found = _described(parse_record(file.read_at(row["length"], row["at"])), payload)
                    except (Damaged, OSError, ValueError) as error:
                        found = (*[None] * 6, str(error), None)
                    out.append((row["path"], row["at"], *found))
                    held += len(found[-1] or b"")
                    if held >= 1 << 24:
                        yield _batch(columns, out)
                        out, held = [], 0
                if out:
                    yield _batch(columns, out)
            if file:
                file.close()

        # Neighbours in a file stay together; a large package is still dealt to many tasks.  The rows are small
        # and the ranges are not, so the number of tasks is given and not merged by the size of the rows.
        tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = places.repartition(tasks, F.col("path"), F.floor(F.col("at") / (4 << 20)))
        return spread.mapInArrow(fetch, "path string, at long, type string, name string, uri string, refers_to string, "
                                        "payload_bytes long, payload_digest string, problem string, payload binary")


def _described(record: Record, payload: bool) -> tuple:
    fields, kind = record.fields, record.fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    size, problem = int(record.status.get("content-length", len(record.payload))), None
    if kind == "response":
        own = payload_digest(record.payload)
        problem = None if (digest or own) == own and size == len(record.payload) else "payload is not what the record says"
        size, digest = len(record.payload), own
    return (kind, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), _page(fields.get("warc-refers-to")), size, digest,
            problem, record.payload if payload else None)


def _page(uri: str | None) -> str | None:
    """The page's id in a record's name."""
    found = re.fullmatch("<urn:page:(.*)/[0-9]+>", uri or "")
    return unquote(found[1]) or None if found else None


def _opened(path: str) -> pa.NativeFile:
    files, inner = filesystem(path)
    return files.open_input_file(inner)


TYPES = {"at": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "records": pa.int64(), "payload": pa.binary()}


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], TYPES.get(n, pa.string())) for i, n in enumerate(names)], names)
