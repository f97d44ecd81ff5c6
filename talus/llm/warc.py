"""WARC records in ZIP packages, written and read back by byte ranges.

Each task writes one package: a stored member ``archive/data.warc.gz`` of records
compressed one by one, and a stored member ``indexes/index.cdxj`` with a line a
record.  The reader finds the central directory from the package's end, follows
the ZIP64 records where there are any, locates the members' data, reads the
index, and fetches records by their ranges; nothing is extracted.

Scale: packages are as many as tasks.  Their list, not their contents, is a
table; a package that a lost or repeated task left behind is not in it.  Digests
alone are shuffled to find the payloads that several pages have; those few are
named to the tasks that write, so that no payload is shuffled (beyond ``FEW`` of
them, payloads are dealt by digest).  For reading, places in packages are dealt
out anew, by package and region, to as many tasks as the bytes ask for.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut, discard, scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records of one region are read by one task: at most so many bytes, and fewer while there are cores for more regions.
REGION, TASKS = 16 << 20, 4
DATE = "2024-01-01T00:00:00Z"

# Signatures and the mark of a field whose value is in the ZIP64 extra.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL = 0xFFFFFFFF


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names, and the path on it."""
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The id of a page's record; rows that repeat have one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", None if url is None else urllib.parse.quote(url, safe=";/?:@&=+$,#%!~*'()[]")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("WARC-Refers-To-Page-ID", str(refers_to) if revisit else None),
        ("WARC-Page-ID", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    named = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + named.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named fields, HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *named = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in named)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


class _Sink:
    """A write-only stream that counts, as zipfile asks of streams that can't seek."""

    def __init__(self, stream: object) -> None:
        self.stream = stream

    def write(self, data: bytes) -> int:
        self.stream.write(data)  # type: ignore[attr-defined]
        return len(data)

    def flush(self) -> None:
        pass


def write_package(path: str, records: Iterator[tuple[int | None, bytes]]) -> int:
    """Write records, given with their page ids, as one package; how many there were."""
    store, place = open_store(path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    index: list[str] = []
    with store.open_output_stream(place) as stream, zipfile.ZipFile(_Sink(stream), "w", zipfile.ZIP_STORED, allowZip64=True) as package:  # type: ignore[arg-type]
        at = 0
        with package.open(zipfile.ZipInfo(ARCHIVE, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
            for page_id, data in records:
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = pack.compress(data) + pack.flush()
                member.write(packed)
                index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(packed)}))
                at += len(packed)
        package.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "".join(f"{x}\n" for x in index))
    return len(index)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int


def directory(file: fs.RandomAccessFile | object) -> list[Member]:
    """The members that a package's central directory lists, by its end records."""
    size = file.size()  # type: ignore[attr-defined]
    read = lambda at, n: bytes(file.read_at(n, at))  # type: ignore[attr-defined]
    tail_at = max(0, size - 65557)  # an end record and the longest comment
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack("<10xHLL", tail[end : end + 20])
    locator = read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] == LOCATOR64:
        end64 = read(struct.unpack("<8xQ", locator[:16])[0], 56)
        if end64[:4] != END64:
            raise ValueError("the ZIP64 end record is not where its locator says")
        n, length, start = struct.unpack("<32xQQQ", end64)
    data, at, found = read(start, length), 0, []
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, packed, whole, names, extras, comments, header = struct.unpack("<10xH8xLLHHH8xL", data[at : at + 46])
        name = data[at + 46 : at + 46 + names].decode()
        extra, x = data[at + 46 + names : at + 46 + names + extras], 0
        while x + 4 <= len(extra):
            kind, width = struct.unpack("<HH", extra[x : x + 4])
            if kind == 1:  # values in this order, of the fields that are full
                values = iter(struct.unpack(f"<{width // 8}Q", extra[x + 4 : x + 4 + width // 8 * 8]))
                whole = next(values) if whole == FULL else whole
                packed = next(values) if packed == FULL else packed
                header = next(values) if header == FULL else header
            x += 4 + width
        found.append(Member(name, method, packed, whole, header))
        at += 46 + names + extras + comments
    return found


def stored_at(file: object, member: Member) -> int:
    """Where a stored member's data begins."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; ranges can't be read from it")
    head = bytes(file.read_at(30, member.header))  # type: ignore[attr-defined]
    if head[:4] != LOCAL:
        raise ValueError("no local header where the directory says")
    names, extras = struct.unpack("<26xHH", head)
    return member.header + 30 + names + extras


def _write(base: str) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, n = f"{base}/{uuid.uuid4().hex}.wacz", 0

        def records() -> Iterator[tuple[int | None, bytes]]:
            for frame in frames:
                for page_id, url, html, size, sha1, response, first in zip(*(frame[c].tolist() for c in ("page_id", "url", "html", "size", "sha1", "response", "first")), strict=True):
                    own = None if page_id is None else int(page_id)
                    payload = (html or "").encode() if response else b""
                    yield own, record(own, url, payload, int(size), base32(sha1), not response, None if first is None else int(first))

        source = records()
        ahead = next(source, None)
        if ahead is not None:
            n = write_package(path, (x for part in ([ahead], source) for x in part))
            yield pd.DataFrame({"path": [path], "n": [n]})

    return run


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path in frame["path"]:
            store, place = open_store(path)
            with store.open_input_file(place) as file:
                members = {m.name: m for m in directory(file)}
                start, index = stored_at(file, members[ARCHIVE]), members[INDEX]
                lines = bytes(file.read_at(index.size, stored_at(file, index))).splitlines()
            rows = [json.loads(x) for x in lines]
            for i in range(0, len(rows), 10_000):
                part = rows[i : i + 10_000]
                yield pd.DataFrame({"path": path, "at": [start + r["offset"] for r in part], "length": [r["length"] for r in part]})


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, rows in frame.groupby("path", sort=False):
            store, place = open_store(str(path))
            with store.open_input_file(place) as file:
                for at, length in zip(rows["at"].tolist(), rows["length"].tolist(), strict=True):
                    fields, http, payload = parse(zlib.decompress(bytes(file.read_at(length, at)), 31))
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base32(hashlib.sha1(payload).hexdigest()) != digest:
                        raise ValueError(f"a payload in {path} at {at} is not what its digest says")
                    size = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
                    page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                    if refers is not None and fields["warc-refers-to"] != record_id(int(refers), digest):
                        raise ValueError(f"a revisit in {path} at {at} refers to another record than its page's")
                    out.append((None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)))
        types = {"page_id": "Int64", "payload_bytes": "int64", "payload_digest": "object", "record_type": "object", "refers_to": "Int64"}
        yield pd.DataFrame({name: pd.Series([row[i] for row in out], dtype=kind) for i, (name, kind) in enumerate(types.items())})


def write_packages(pages: DataFrame, base: str, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``base``; the packages: path, n.

    Of pages with equal payloads of at least ``least`` bytes, the one with the
    largest page_id is a response and the others revisit it.
    """
    html: Column = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html"))
    # Only digests that several rows have matter; no payload is in this part.
    first = rows.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    first = cut(first.select(F.col("sha1").alias("of"), "first"))
    first = F.broadcast(first) if first.count() <= FEW else first
    typed = rows.join(first, F.col("sha1") == F.col("of"), "left")
    typed = typed.withColumn("response", F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")))
    # Ids travel as text: pandas would make floats of whole numbers beside nulls.
    named = [F.when(F.col("response"), None).otherwise(F.col("first")).cast("string").alias("first"), F.col("page_id").cast("string").alias("page_id")]
    kept = typed.select("url", F.when(F.col("response"), F.col("html")).alias("html"), "size", "sha1", "response", *named)
    return cut(kept.mapInPandas(_write(base), "path string, n long"))


def _sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = []
        for path in frame["path"]:
            store, place = open_store(path)
            found.append(store.get_file_info(place).size)
        yield pd.DataFrame({"path": frame["path"], "bytes": found})


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of ``packages`` (path): page_id, payload_bytes, payload_digest, record_type, refers_to."""
    sized = cut(packages.select("path").mapInPandas(_sizes, "path string, bytes long"))
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = packages.sparkSession.sparkContext.defaultParallelism
    region = max(1, min(REGION, total // (TASKS * cores)))
    # Counts of partitions are given, as rows of a few bytes stand for whole records.
    found = sized.repartition(max(1, min(n, TASKS * cores)), "path").mapInPandas(_index, "path string, at long, length long")
    dealt = found.withColumn("region", F.floor(F.col("at") / region))
    dealt = dealt.repartition(max(1, 2 * math.ceil(total / region)), "path", "region").sortWithinPartitions("path", "at")
    return dealt.select("path", "at", "length").mapInPandas(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, base: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns play no part) as packages and read every record back.

    Result, a row per input row: page_id, payload_bytes, payload_digest (base32
    SHA-1), record_type, refers_to (a revisit's response, else null).

    Null html is an empty payload.  Rows that repeat the largest page_id of a
    payload are all responses.  A null page_id is kept and never the largest;
    payloads that only such rows have are responses.  An empty table writes
    nothing.  Packages stay below ``base``; without one, they are in the shared
    folder until they have been read.
    """
    if base is not None:
        return read_packages(write_packages(pages, base, least))
    base = scratch(pages.sparkSession, "warc")
    found = cut(read_packages(write_packages(pages, base, least)))
    discard(pages.sparkSession, base)
    return found
