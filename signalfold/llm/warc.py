"""Web archives (WARC) in ZIP packages: written by tasks, and read by ranges without extraction.

A package is a ZIP file of stored members: `archive/data.warc.gz` (a gzip member for each record), `indexes/index.cdxj` (a line
for each record: key of the address, time, and offset and length in its member) and `datapackage.json` (sizes and digests).
A task writes packages of about PACKAGE_BYTES as a stream, each under a name of its own, and returns their names; these
become the table of a set of packages, which Spark commits, so that files of lost tasks are in no set and a repeated task
harms nothing. The folder must be one that all machines open through pyarrow's file systems (file, s3, hdfs).

Payloads that repeat: records of equal payloads (by SHA-256) of at least `min_bytes` are grouped by narrow rows; the one with the
smallest page_id is a response, the others are revisits that name it. Only rows that revisit are joined to the pages, by the
place of the row in its file: broadcast while they are few, else by a shuffle.

Reading takes the end of the file, its central directory (that of ZIP64 where sizes or counts ask for it) and the local header of
each stored member; the index members give the ranges of the records, neighbours together up to RANGE_BYTES; members that
no index covers are walked through once. The ranges are dealt out evenly, so that one large package is read by many tasks, and
each is one read of the file. Digests are checked; a package that is damaged, encrypted or has compressed archive members is an error.

Defined cases: a null payload is empty; null urls are `about:blank`; a null page_id comes after all others and stays null; of rows that
repeat page_id and payload one is the response, and the others revisit it; empty payloads are equal ones; long payloads are
records of their own size; an empty table makes no package and an empty result; page_id may be of any type that its
text gives back; other columns are ignored, whatever their names.
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
from datetime import UTC, datetime
from functools import partial
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold.llm.store import broadcast_if_small, heavy_light_join, map_batches, materialize, place, read_from_files, scratch_path, ship, slices, width

#: Bytes of records after which a package is closed, and of neighbouring records that are read at once.
PACKAGE_BYTES, RANGE_BYTES, RANGE_RECORDS = 128 << 20, 1 << 20, 256
#: Names in a package, and the profile of records without payload (fixed values).
ARCHIVE, INDEX, DESCRIPTION = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file of Spark's."""
    return pafs.FileSystem.from_uri(re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", uri)))


# -- ZIP -----------------------------------------------------------------------------------------------
@dataclass
class Member:
    name: str
    method: int
    flags: int
    start: int  # of its data in the file
    size: int  # of its data as stored


class Package:
    """The directory of a ZIP file that allows reads of ranges (`file`: seek and read)."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}

    def read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(size)
        if len(out) != size:
            raise ValueError("the package ends within what it lists")
        return out

    def _end(self) -> tuple[int, int, int, int]:
        """(members, size and offset of the central directory, where the directory's end record begins)."""
        tail = self.read(max(0, self.size - 65_557), min(self.size, 65_557))
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22].ljust(2, b"\xff"), "little") != len(tail):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("not a ZIP file")
        count, size, offset = struct.unpack_from("<10xHII", tail, at)
        where = self.size - len(tail) + at
        locator = self.read(where - 20, 20) if where >= 20 else b""
        if locator[:4] == b"PK\6\7":
            # As the locator says, or before it where something stands before the first member.
            for record in (struct.unpack_from("<8xQ", locator)[0], where - 76):
                if 0 <= record <= where - 76 and self.read(record, 4) == b"PK\6\6":
                    count, size, offset = struct.unpack("<32xQQQ", self.read(record, 56))
                    return count, size, offset, record
            raise ValueError("the ZIP64 directory is not where it should be")
        return count, size, offset, where

    def _directory(self) -> Iterator[Member]:
        count, size, offset, where = self._end()
        shift = where - size - offset  # what stands before the first member
        if shift < 0:
            raise ValueError("the directory does not fit the file")
        data, at = self.read(offset + shift, size), 0
        for _ in range(count):
            sign, flags, method, packed, plain, n, extra, comment, local = struct.unpack_from("<4s4xHH8xIIHHH8xI", data, at)
            if sign != b"PK\1\2":
                raise ValueError("the directory is damaged")
            name = data[at + 46:at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            more, end = at + 46 + n, at + 46 + n + extra
            while more + 4 <= end:
                kind, length = struct.unpack_from("<HH", data, more)
                if kind == 1:  # ZIP64: those of the three numbers that did not fit
                    values = list(struct.unpack_from(f"<{min(length, 24) // 8}Q", data, more + 4))
                    plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                    local = values.pop(0) if local == 0xFFFFFFFF else local
                more += 4 + length
            at = end + comment
            head = self.read(local + shift, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError(f"{name} is not where the directory says")
            begin = local + shift + 30 + sum(struct.unpack_from("<HH", head, 26))
            yield Member(name, method, flags, begin, packed)

    def archives(self) -> list[Member]:
        out = [m for m in self.members.values() if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))]
        for m in out:
            if m.method or m.flags & 1:
                raise ValueError(f"{m.name} is not stored as it is")
        return out

    def lines(self, member: Member) -> Iterator[bytes]:
        """Lines of an index member, read piece by piece."""
        if member.method not in (0, 8) or member.flags & 1:
            raise ValueError(f"{member.name} can't be read")
        pieces = (self.read(member.start + at, min(RANGE_BYTES, member.size - at)) for at in range(0, member.size, RANGE_BYTES))
        pieces = _inflated(pieces, -15) if member.method == 8 else pieces
        rest = b""
        for piece in _inflated(pieces, 31) if member.name.endswith(".gz") else pieces:
            *whole, rest = (rest + piece).split(b"\n")
            yield from whole
        if rest:
            yield rest


def _inflated(pieces: Iterator[bytes], kind: int) -> Iterator[bytes]:
    """What deflated pieces give, also where one gzip member follows another."""
    step = zlib.decompressobj(kind)
    for piece in pieces:
        while piece:
            yield step.decompress(piece)
            piece = step.unused_data if step.eof and kind > 0 else b""
            if step.eof and kind > 0:
                step = zlib.decompressobj(kind)


def indexed(package: Package) -> dict[str, np.ndarray]:
    """archive member -> (offset, length) of its records, as the index members say."""
    found: dict[str, list] = {}
    for m in package.members.values():
        if m.name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", m.name):
            for line in package.lines(m):
                brace = line.find(b"{")
                if brace >= 0:
                    facts = json.loads(line[brace:])
                    found.setdefault(facts["filename"].rpartition("/")[2], []).append((int(facts["offset"]), int(facts["length"])))
    return {name: np.unique(np.array(x, np.int64), axis=0) for name, x in found.items()}


def walked(package: Package, member: Member) -> np.ndarray:
    """(offset, length) of the records of a member without an index, by reading it through."""
    return np.array(list(_gzip_members(package, member) if member.name.endswith(".gz") else _plain_records(package, member)), np.int64).reshape(-1, 2)


def _gzip_members(package: Package, member: Member) -> Iterator[tuple[int, int]]:
    at = begin = 0
    step = zlib.decompressobj(31)
    while at < member.size:
        piece = package.read(member.start + at, min(RANGE_BYTES, member.size - at))
        left = piece
        while left:
            step.decompress(left, RANGE_BYTES)
            while step.unconsumed_tail and not step.eof:
                step.decompress(step.unconsumed_tail, RANGE_BYTES)
            if not step.eof:
                break
            left = step.unused_data
            end = at + len(piece) - len(left)
            yield begin, end - begin
            begin, step = end, zlib.decompressobj(31)
        at += len(piece)


def _plain_records(package: Package, member: Member) -> Iterator[tuple[int, int]]:
    at = 0
    while at < member.size:
        size = min(1 << 16, member.size - at)
        while (end := (head := package.read(member.start + at, size)).find(b"\r\n\r\n")) < 0 and size < member.size - at:
            size = min(size * 2, member.size - at)
        if end < 0:
            raise ValueError(f"{member.name} ends within a record")
        length = end + 8 + int(_fields(head[:end])["content-length"])
        yield at, length
        at += length


# -- WARC ----------------------------------------------------------------------------------------------
def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(name: str, url: str, payload: bytes, date: str, digest: str, refers: str | None = None) -> bytes:
    """A response record, or with `refers` (the name of a response) a revisit of it, which has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers is not None:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{refers}>"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    type: str
    name: str
    url: str
    date: str
    digest: str | None
    refers: str | None
    payload: bytes | None
    payload_bytes: int


def parsed(data: bytes) -> Record:
    """A record from its bytes (inflated); the payload of a response is held against its digest."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        raise ValueError("not a WARC record")
    f = _fields(data[:end])
    block = data[end + 4:end + 4 + int(f["content-length"])]
    if len(block) != int(f["content-length"]):
        raise ValueError("the record is cut")
    kind, digest, payload, size = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:") or None, block, len(block)
    if f.get("content-type", "").startswith("application/http"):
        stop = block.find(b"\r\n\r\n")
        payload = block[stop + 4:] if stop >= 0 else b""
        size = len(payload)
        if kind == "revisit":
            payload, size = None, int(_fields(block[:stop] if stop >= 0 else block).get("content-length", 0))
    if kind == "response" and digest is not None and sha1(payload) != digest:
        raise ValueError("the payload is not what its digest says")
    named = lambda k: f[k].strip("<>") if k in f else None
    return Record(kind, named("warc-record-id") or "", named("warc-target-uri") or "", f.get("warc-date", ""), digest, named("warc-refers-to"), payload, size)


def key_of(url: str) -> str:
    """The address as an index sorts it: the host's parts from last to first, then the path."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return re.sub(r"\s", "%20", url)
    return re.sub(r"\s", "%20", ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else ""))


# -- writing -------------------------------------------------------------------------------------------
class _Writer:
    """One package, written as a stream."""

    def __init__(self, fs: pafs.FileSystem, folder: str, date: str):
        self.path, self.date, self.lines, self.resources = f"{folder}/{uuid.uuid4().hex}.wacz", date, [], []
        self.stream = fs.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.at, self.digest = self.zip.open(self._named(ARCHIVE), "w", force_zip64=True), 0, hashlib.sha256()

    def _named(self, name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def add(self, name: str, url: str, payload: bytes, refers: str | None) -> None:
        digest = sha1(payload)
        data = gzip.compress(record(name, url, payload, self.date, digest, refers), 6, mtime=0)
        self.member.write(data)
        self.digest.update(data)
        facts = {"url": url, "mime": "text/html" if refers is None else "warc/revisit", "status": "200", "digest": f"sha1:{digest}", "length": str(len(data)), "offset": str(self.at), "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{key_of(url)} {re.sub('[^0-9]', '', self.date)[:14]} {json.dumps(facts)}\n")
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.resources.append({"name": "data.warc.gz", "path": ARCHIVE, "hash": f"sha256:{self.digest.hexdigest()}", "bytes": self.at})
        index = "".join(sorted(self.lines)).encode()
        self.zip.writestr(self._named(INDEX), index)
        self.resources.append({"name": "index.cdxj", "path": INDEX, "hash": f"sha256:{hashlib.sha256(index).hexdigest()}", "bytes": len(index)})
        self.zip.writestr(self._named(DESCRIPTION), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": self.resources}))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.at


def _write(it: Iterator[pa.RecordBatch], folder: str, date: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (name, url, payload, refers) to packages; gives (path, records, bytes) of each."""
    writer, done = None, []
    for whole in it:
        for b in slices(whole, 2):
            for name, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    fs, base = opened(folder)
                    writer = _Writer(fs, base, date)
                writer.add(name, url, payload, refers)
                if writer.at >= most:
                    done.append(writer.close())
                    writer = None
    if writer is not None:
        done.append(writer.close())
    names = [folder.rstrip("/") + "/" + path.rpartition("/")[2] for path, _, _ in done]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([n for _, _, n in done], pa.int64())], names=["path", "records", "bytes"])


def _name(page, file, row):
    """The name of a row's record: its page_id and its place."""
    return F.concat(F.lit(_URN), F.coalesce(F.url_encode(page.cast("string")), F.lit("")), F.when(page.isNull(), ":null:").otherwise("::"), F.hex(file), F.lit("-"), row.cast("string"))


def _revisits(narrow: DataFrame, min_bytes: int) -> DataFrame:
    """(file, row, refers) of the rows whose payload another row's record holds."""
    sized = narrow.where(F.col("n") >= min_bytes)
    best = F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "file", "row"))
    groups = sized.groupBy("key").agg(best.alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = materialize(groups.select("key", "size", *(F.col(f"best.{c}").alias(f"keep_{c}") for c in ("page_id", "file", "row"))), "equal-payloads")
    found = heavy_light_join(sized, groups, ["key"], "size").where("file <> keep_file or row <> keep_row")
    return materialize(found.select("file", "row", _name(F.col("keep_page_id"), F.col("keep_file"), F.col("keep_row")).alias("refers")), "revisits")


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, date: datetime | None = None, payload: str = "html") -> DataFrame:
    """Write pages (page_id, url and a payload) as packages into the folder `out`; returns the table of these: path, records, bytes."""
    spark = pages.sparkSession
    ship(spark)
    pages = pages if read_from_files(pages) else materialize(pages, "pages")
    file, row = place(pages)
    rows = pages.select(F.col("page_id"), F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"), file.alias("file"), row.alias("row"))
    narrow = materialize(rows.select("page_id", F.unhex(F.sha2("payload", 256)).alias("key"), F.octet_length("payload").alias("n"), "file", "row"), "payloads")
    again = _revisits(narrow, min_bytes)
    joined = rows.join(broadcast_if_small(again), ["file", "row"], "left")
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")  # a field is one line
    named = joined.select(_name(F.col("page_id"), F.col("file"), F.col("row")).alias("name"), url.alias("url"), "payload", "refers")
    fs, base = opened(f"{out}/packages")
    fs.create_dir(base, recursive=True)
    when = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    made = map_batches(named, partial(_write, folder=f"{out}/packages", date=when, most=package_bytes), "path string, records long, bytes long")
    made.write.parquet(f"{out}/set")
    return spark.read.schema("path string, records long, bytes long").parquet(f"{out}/set")


# -- reading -------------------------------------------------------------------------------------------
def _ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of packages to the ranges of their records: (path, start, lengths), neighbours together."""
    for b in it:
        for path in b.column(0).to_pylist():
            fs, at = opened(path)
            with fs.open_input_file(at) as file:
                package = Package(file, file.size())
                index = indexed(package)
                rows = []
                for m in package.archives():
                    known = index.get(m.name.rpartition("/")[2])
                    rows += list(_runs(m, walked(package, m) if known is None else known))
            for i in range(0, len(rows), 1024):
                part = rows[i:i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.list_(pa.int64())), pa.array([r[2] for r in part])], names=["path", "start", "lengths", "packed"])


def _runs(member: Member, places: np.ndarray) -> Iterator[tuple[int, list[int], bool]]:
    start = end = 0
    lengths: list[int] = []
    for offset, length in places.tolist():
        if offset + length > member.size:
            raise ValueError(f"the index leads out of {member.name}")
        if lengths and (offset != end or end - start + length > RANGE_BYTES or len(lengths) >= RANGE_RECORDS):
            yield member.start + start, lengths, member.name.endswith(".gz")
            lengths = []
        if not lengths:
            start = offset
        lengths.append(length)
        end = offset + length
    if lengths:
        yield member.start + start, lengths, member.name.endswith(".gz")


_READ = {"type": pa.string(), "name": pa.string(), "url": pa.string(), "date": pa.string(), "digest": pa.string(), "refers": pa.string(), "payload_bytes": pa.int64()}


def _read(it: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    types = _READ | ({"payload": pa.binary()} if with_payload else {})
    file, own = None, None
    try:
        for b in it:
            for path, start, lengths, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != own:
                    if file is not None:
                        file.close()
                    fs, at = opened(path)
                    file, own = fs.open_input_file(at), path
                file.seek(start)
                data, at, rows = file.read(sum(lengths)), 0, []
                for n in lengths:
                    piece = data[at:at + n]
                    try:
                        rows.append(parsed(gzip.decompress(piece) if packed else piece))
                    except (ValueError, KeyError, EOFError, OSError, zlib.error) as e:
                        raise ValueError(f"{path} at {start + at}: {e}") from e
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([getattr(r, k) for r in rows], t) for k, t in types.items()], names=list(types))
    finally:
        if file is not None:
            file.close()


def read_archives(spark: SparkSession, packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of packages (a table with their `path`): type, name, url, date, digest, refers, payload_bytes and, if asked for, payload."""
    ship(spark)
    paths = packages.select("path").repartition(width(spark))
    ranges = paths.mapInArrow(_ranges, "path string, start long, lengths array<long>, packed boolean").repartition(width(spark))
    made = "type string, name string, url string, date string, digest string, refers string, payload_bytes long" + (", payload binary" if with_payload else "")
    return ranges.mapInArrow(partial(_read, with_payload=with_payload), made)


def page_of(name, kind: str):
    """The page_id that a record's name holds."""
    text = F.substring_index(F.substring(name, len(_URN) + 1, 1 << 30), ":", 1)
    return F.when(~F.contains(name, F.lit(":null:")), F.url_decode(text)).cast(kind)


def archived(pages: DataFrame, out: str | None = None, **options) -> DataFrame:
    """Write pages as packages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    packages = write_archives(pages, out or scratch_path(spark, "archives"), **options)
    return read_archives(spark, packages).select(
        page_of(F.col("name"), kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page_of(F.col("refers"), kind).alias("refers_to"))
