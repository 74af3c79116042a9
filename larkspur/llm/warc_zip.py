"""WARC archives packaged in ZIP files: distributed writing, and reading by ranges.

A task writes packages into the shared folder: ``archive/data.warc.gz`` (one gzip member a
record) and ``indexes/index.cdxj`` (key, time stamp and JSON a record), both stored without further
compression. Every attempt writes under its own name, and only the packages of finished
tasks are listed in the checkpointed manifest, so retries and lost executors leave nothing
half-written in sight.

The reader never extracts: it reads the end of the file, parses the central directory
(ZIP64 too), finds the stored members through their local headers, reads the index and
fetches the records' ranges, neighbouring ranges in one read of bounded size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bound_batches, slices
from larkspur.llm.shared import checkpoint_folder, cut_lineage, look_up

LEAST_SHARED = 100
ROLL_RECORDS = 50_000
ROLL_BYTES = 1 << 30
READ_BYTES = 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVES, INDEXES = (".warc.gz", ".warc"), (".cdxj", ".cdx.json")
STAMP, KEYED = "2000-01-01T00:00:00Z", "20000101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str):
    """(pyarrow file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


# Records


def record_id(page: str | None, digest: str) -> str:
    """The id of a response: of its page and payload, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}')}>"


def record(kind: str, page: str | None, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC record; a revisit leaves its payload out, keeps length and digest, and names the response's record and page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page if kind == "response" else f"revisit|{page}|{url}", digest)),
        ("WARC-Date", STAMP),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m.group()):02X}", url)))
    if page is not None:
        head.append(("X-Page-ID", page))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page-ID", refers)]
    body = http if kind == "revisit" else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def _head(data: bytes) -> tuple[dict[str, str], bytes]:
    top, _, rest = data.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in top.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, rest


@dataclass
class Read:
    """A record as read back; what a record doesn't say is null."""

    kind: str
    page: str | None
    url: str | None
    payload: bytes | None
    payload_bytes: int | None
    digest: str | None
    refers: str | None


def parse_record(data: bytes) -> Read:
    """Parse one decompressed record of any type; ValueError if lengths or digests don't agree.

    A response's payload is what follows the HTTP head (the whole block of other types). It is
    null for revisits, whose length comes from their HTTP head, or is null without one. SHA-256
    and SHA-1 digests (hexadecimal or base32) are verified; without one, the payload's SHA-256
    is reported. ``refers`` is the page of this package's own revisits, else the record id.
    """
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, rest = _head(data)
    size, kind = int(head.get("content-length", "-1")), head.get("warc-type", "")
    if len(rest) != size + 4:
        raise ValueError("the record's length differs from its Content-Length")
    block, http = rest[:size], {}
    if "http" in head.get("content-type", "").lower() and block.startswith(b"HTTP/"):
        http, block = _head(block)
    stated = http.get("content-length", "")
    n = int(stated) if stated.isdigit() else None
    method, _, digest = head.get("warc-payload-digest", "").partition(":")
    page, url = head.get("x-page-id"), head.get("warc-target-uri")
    if kind == "revisit":
        return Read(kind, page, url, None, n, digest or None, head.get("x-refers-to-page-id", head.get("warc-refers-to")))
    if n is not None and len(block) != n and "transfer-encoding" not in http:
        raise ValueError("the payload differs from its length")
    made = {"sha256": hashlib.sha256, "sha1": hashlib.sha1}.get(method.lower().replace("-", ""))
    if made and digest.lower() not in (made(block).hexdigest(), base64.b32encode(made(block).digest()).decode().lower()):
        raise ValueError("the payload differs from its digest")
    return Read(kind, page, url, block, len(block), digest or hashlib.sha256(block).hexdigest(), None)


# Packages


class Package:
    """A ZIP package being written: the archive streams out, its index is kept until the end."""

    def __init__(self, uri: str):
        fs, path = _store(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self._out = uri, fs.open_output_stream(path)
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_STORED)
        self._archive = self._zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, data: bytes, **about) -> None:
        packed = gzip.compress(data, 1, mtime=0)
        self._archive.write(packed)
        known = {"offset": self.at, "length": len(packed), "filename": ARCHIVE.rpartition("/")[2], **about}
        self.index.append(f"{about.get('page') or '-'} {KEYED} {json.dumps(known)}")
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self._archive.close()
        self._zip.writestr(zipfile.ZipInfo(INDEX), "".join(line + "\n" for line in self.index))
        self._zip.close()
        self._out.close()
        return self.uri, len(self.index), self.at


@dataclass
class Member:
    """An entry of a central directory."""

    name: str
    method: int
    size: int
    packed: int
    header: int


class ZipReader:
    """Range reads of stored members of a ZIP package."""

    def __init__(self, uri: str):
        fs, path = _store(uri)
        self.file = fs.open_input_file(path)
        self.length = self.file.size()
        self.members = {m.name: m for m in self._directory()}

    def read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the package ends early")
        return data

    def _directory(self) -> list[Member]:
        tail = min(self.length, 22 + 0xFFFF + 20)
        data = self.read(self.length - tail, tail)
        at = data.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data):
            at = data.rfind(b"PK\x05\x06", 0, at)  # that one stood in a comment
        if at < 0:
            raise ValueError("no end of a central directory")
        count, size, start = struct.unpack_from("<HII", data, at + 10)
        if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
            mark = self.length - tail + at - 20
            if mark >= 0 and (found := self.read(mark, 20))[:4] == b"PK\x06\x07":
                end = self.read(struct.unpack_from("<Q", found, 8)[0], 56)
                if end[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of a central directory")
                count, size, start = struct.unpack_from("<QQQ", end, 32)
        data, at, out = self.read(start, size), 0, []
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a damaged central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, k)
                if tag == 1:  # the 64-bit values of those fields that are full, in this order
                    big = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    full = big.pop(0) if full == 0xFFFFFFFF else full
                    packed = big.pop(0) if packed == 0xFFFFFFFF else packed
                    header = big.pop(0) if header == 0xFFFFFFFF else header
                k += 4 + n
            out.append(Member(name, method, full, packed, header))
            at += 46 + n_name + n_extra + n_comment
        return out

    def start(self, member: Member) -> int:
        """Where a stored member's bytes begin."""
        if member.method != 0:
            raise ValueError(f"{member.name} isn't stored")
        head = self.read(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a damaged local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n_name + n_extra

    def find(self, endings: tuple[str, ...]) -> list[Member]:
        """The members with names of such endings, in the directory's order."""
        return [m for m in self.members.values() if m.name.lower().endswith(endings)]

    def index(self, member: Member | None = None) -> list[dict]:
        """Entries (offset, length and what else is known) of an index member, the first by default.

        A line holds a JSON object, behind a key and a time stamp where there are such.
        """
        member = member or next(iter(self.find(INDEXES)), None)
        if member is None:
            raise ValueError("the package has no index")
        lines = self.read(self.start(member), member.size).decode().splitlines()
        entries = [json.loads(line[line.index("{") :]) for line in lines if "{" in line]
        return [e | {"offset": int(e["offset"]), "length": int(e["length"])} for e in entries]

    def records(self, entries: list[dict] | None = None, block: int = READ_BYTES) -> Iterator[Read]:
        """Records by index entries (all of them by default), in their order.

        An entry's ``filename`` names the end of its archive member's name; without one it is
        in the first archive.
        """
        archives = self.find(ARCHIVES)
        if not archives:
            raise ValueError("the package has no archive")
        if entries is None:
            entries = [e for m in self.find(INDEXES) for e in self.index(m)]
        for name, some in groupby(entries, key=lambda e: e.get("filename")):
            member = next((m for m in archives if name and m.name.endswith(name)), archives[0])
            yield from self._records(member, list(some), block)

    def _records(self, member: Member, entries: list[dict], block: int) -> Iterator[Read]:
        base = self.start(member)
        held, first = b"", 0
        for i, e in enumerate(entries):
            start, size = e["offset"], e["length"]
            if start + size > member.size:
                raise ValueError("an index entry beyond its archive")
            if not first <= start <= start + size <= first + len(held):
                end, k = start + size, i + 1  # read on over neighbouring entries
                while k < len(entries) and entries[k]["offset"] == end and end + entries[k]["length"] - start <= block:
                    end += entries[k]["length"]
                    k += 1
                held, first = self.read(base + start, end - start), start
            data = held[start - first : start - first + size]
            yield parse_record(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data)

    def close(self) -> None:
        self.file.close()


# Spark


def classify(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """(id, url, payload, digest, refers): what each row's record will be; refers is null for responses."""
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.col(f"`{url_col}`").cast("string") if url_col else F.lit(None).cast("string")).alias("url"),
        payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    large = rows.where(F.octet_length("payload") >= LEAST_SHARED)
    shared = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    rows = look_up(rows, shared.select("digest", "first"), ["digest"], "id")
    return rows.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Write a record for every row into packages under ``folder``; (path, n_records, n_bytes) of each package.

    ``folder`` must be a place that every executor can write and read (a path or a URI that
    pyarrow can open). Of rows with equal payloads of 100 bytes or more, the ones with the
    smallest id are responses (all of them, where rows are repeated), the others revisit it.
    """
    bound_batches(pages.sparkSession)
    rows = classify(pages, id_col, html_col, url_col)
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("refers").cast("string").alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, made = None, []
        for whole in batches:
            for batch in slices(whole, 2):
                for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if package is None:
                        package = Package(f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip")
                    kind = "response" if refers is None else "revisit"
                    data = record(kind, page, url, payload.encode("utf-8", "surrogatepass"), digest, refers)
                    package.add(data, type=kind, digest=digest, page=page)
                    if len(package.index) >= ROLL_RECORDS or package.at >= ROLL_BYTES:
                        made.append(package.close())
                        package = None
        if package is not None:
            made.append(package.close())
        if made:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "n_records", "n_bytes"), map(list, zip(*made)))))

    return cut_lineage(rows.mapInArrow(write, "path string, n_records bigint, n_bytes bigint"))


READ_FIELDS = "id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def read_archives(manifest: DataFrame, with_payload: bool = False, rows: int = 1000) -> DataFrame:
    """The records of packages (path), read by ranges; payloads only if asked for (null for revisits)."""
    schema = pa.schema([
        ("id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                package, held, size = ZipReader(path), [], 0
                for r in package.records():
                    held.append((r.page, r.url, r.payload_bytes, r.digest, r.kind, r.refers, r.payload if with_payload else None))
                    size += r.payload_bytes if with_payload else 0
                    if len(held) >= rows or size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                package.close()

    return manifest.select("path").mapInArrow(read, READ_FIELDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", folder: str | None = None) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every row, as read back from its archive.

    Null pages have an empty payload; payloads under 100 bytes are always responses; rows
    with a null id refer to others but, beside rows with an id, are referred to by none;
    repeated rows get a record each; an empty table writes no package and gives an empty
    table; other columns are ignored.
    """
    folder = folder or f"{checkpoint_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    read = read_archives(write_archives(pages, folder, id_col, html_col, url_col))
    kind = pages.schema[id_col].dataType
    return read.select(
        F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d FROM p),
r AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS f FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM r
"""
