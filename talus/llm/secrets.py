"""Secret scans that unwrap nested encodings until nothing new appears.

A text is the first entry of a worklist.  Each layer is scanned, then the layer
with its URL escapes decoded, that with its Unicode escapes decoded, its base64
runs (over several lines too) and compressed data become further layers, with a
map back to places in the whole text.  Decoded bytes are read whatever they hold.
A digest of every layer seen breaks cycles.  Each text is handled by itself, in
one pass over the table.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import contextlib
import hashlib
import io
import itertools
import lzma
import re
import tempfile
import urllib.parse
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

KINDS = ("assign", "access", "hex")
#: Unpacked data is read in steps, scanned in parts of about ``CHUNK`` bytes; parts overlap where no line ends them.
STEP, CHUNK, OVERLAP = 1 << 20, 1 << 24, 1 << 16

# What a secret looks like.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so this finds the runs of 24 or more

URL_BYTES = re.compile(r"%(?:00|1[fF]%8[bB]|[fF][dD]7zXZ|01|5[eE]|9[cC]|[dD][aA])|BZh[1-9]")
URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_=-])")
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++(?:={1,2}|[ \t]*+\r?\n[ \t]*+={1,2}(?!=))?")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}|={1,2}")
BREAK = re.compile(rb"[^A-Za-z0-9+/_=\s-]|[A-Za-z0-9+/_=-][ \t]+[A-Za-z0-9+/_=-]")
STANDARD = str.maketrans("-_", "+/")
WIDE_LITTLE, WIDE_BIG = (re.compile(rb"(?:%b){12,}" % pair, re.DOTALL) for pair in (rb"[^\0]\0", rb"\0[^\0]"))
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|x[\x01\x5e\x9c\xda]")
ROW = re.compile(rb"[\t\n\r\x20-\x7e]{12}|(?:[\t\n\r\x20-\x7e]\0){12}|(?:\0[\t\n\r\x20-\x7e]){12}")
URL_RUN = re.compile(r"[^\s\"'<>]+")
#: The fewest characters that a secret, or what encodes one, has.
LEAST = 12

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def scan(text: str) -> list[Span]:
    """Secrets of one layer as they stand, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _unpacker(data: bytes) -> object | None:
    """What unpacks data that begins so."""
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def _inflated(file: IO[bytes]) -> Iterator[bytes]:
    """Pieces of what the streams that ``file`` begins with unpack to, one stream after another, up to damage or the end."""
    data = file.read(STEP)
    while (unpack := _unpacker(data)) is not None:
        try:
            while not unpack.eof:  # type: ignore[attr-defined]
                piece = unpack.decompress(data, STEP)  # type: ignore[attr-defined]
                if piece:
                    yield piece
                data = getattr(unpack, "unconsumed_tail", b"")
                if not data and not unpack.eof and getattr(unpack, "needs_input", not piece) and not (data := file.read(STEP)):  # type: ignore[attr-defined]
                    return
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        data = unpack.unused_data.lstrip(b"\0")  # type: ignore[attr-defined]  # streams may be padded
        while len(data) < 8 and (more := file.read(STEP)):
            data = (data + more).lstrip(b"\0")


def _unpacks(head: bytes) -> bool:
    """Whether data that begins so may unpack; no longer head is needed to tell noise."""
    if (unpack := _unpacker(head)) is None:
        return False
    try:
        unpack.decompress(head, STEP)  # type: ignore[attr-defined]
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return False
    return True


def _parts(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Long data in parts of bounded size, cut after a line that no secret and no base64 goes beyond."""
    held = bytearray()
    for piece in pieces:
        held += piece
        if len(held) < CHUNK:
            continue
        at = held.rfind(b"\n")
        while at >= 0 and not BREAK.search(held, held.rfind(b"\n", 0, at) + 1, at):
            at = held.rfind(b"\n", 0, at)
        if at >= 0:
            yield bytes(held[: at + 1])
            del held[: at + 1]
        elif len(held) >= 4 * CHUNK:  # no such line: parts that overlap
            yield bytes(held)
            del held[:-OVERLAP]
    yield bytes(held)


def _unpacked(data: bytes) -> Iterator[bytes]:
    """``data`` in parts, unpacked until nothing unpacks; data that unpacks to nothing is read as it is."""
    seen: set[bytes] = set()
    with contextlib.ExitStack() as files:
        level: IO[bytes] = io.BytesIO(data)
        while True:
            pieces, first = _inflated(level), b""
            while len(first) < 8 and (piece := next(pieces, b"")):
                first += piece
            if not first:
                level.seek(0)
                yield from _parts(iter(lambda: level.read(STEP), b""))  # noqa: B023
                return
            pieces = itertools.chain([first], pieces)
            if _unpacker(first) is None:
                yield from _parts(pieces)
                return
            digest, inner = hashlib.blake2b(), files.enter_context(tempfile.SpooledTemporaryFile(CHUNK))
            for piece in pieces:
                digest.update(piece)
                inner.write(piece)
            if digest.digest() in seen:  # unpacks to itself
                return
            seen.add(digest.digest())
            inner.seek(0)
            level.close()
            level = inner


def _readable(data: bytes) -> Iterator[str]:
    """The readings of bytes: as UTF-8, else Latin-1, and what of them may be UTF-16; whether they are noise is left to the patterns."""
    for part in _unpacked(data):
        if len(part) < LEAST:
            continue
        try:
            yield part.decode()
        except UnicodeDecodeError:
            yield part.decode("latin-1")
        if b"\0" in part:
            # Rows of Latin-1 characters in UTF-16, wherever they begin; a form feed between them is in no pattern.
            for wide, at in ((WIDE_LITTLE, 0), (WIDE_BIG, 1)):
                if rows := [m[0][at::2] for m in wide.finditer(part)]:
                    yield b"\f".join(rows).decode("latin-1")


def _escaped(piece: str) -> str:
    if piece[0] == "&":
        code = int(piece[3:-1], 16) if piece[2] in "xX" else int(piece[2:-1])
    else:
        code = int(piece.strip("\\ux{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


Layer = tuple[str, Sequence[int] | None, int, int]  # text, where each character starts and the last ends; or the region all of it is from


def _place(layer: Layer, start: int, end: int) -> tuple[int, int]:
    _, starts, lo, hi = layer
    return (starts[start], starts[end]) if starts is not None else (lo, hi)


def _url_decoded(piece: str) -> tuple[str, list[int]]:
    """The characters of a row of URL escapes, and where in it each begins; bytes that are not UTF-8 are read as Latin-1."""
    chars = urllib.parse.unquote_to_bytes(piece).decode(errors="surrogateescape")
    sizes = [len(c.encode(errors="surrogateescape")) for c in chars]
    text = "".join(chr(ord(c) - 0xDC00) if 0xDC80 <= ord(c) <= 0xDCFF else c for c in chars)
    return text, [3 * at for at in itertools.accumulate(sizes[:-1], initial=0)]


def _rewritten(layer: Layer, pattern: re.Pattern[str], decode: Callable[[str], tuple[str, list[int]]]) -> Layer:
    """The whole layer with the matches of ``pattern`` decoded, so that a keyword and an escaped value stay together."""
    text, starts, lo, hi = layer
    out: list[str] = []
    places: list[int] = []
    at = 0
    for m in pattern.finditer(text):
        made, offsets = decode(m[0])
        out += [text[at : m.start()], made]
        if starts is not None:
            places.extend(starts[at : m.start()])
            places.extend(starts[m.start() + o] for o in offsets)
        at = m.end()
    out.append(text[at:])
    if starts is not None:
        places.extend(starts[at:])
    return "".join(out), places if starts is not None else None, lo, hi


def _escaped_bytes(layer: Layer, run: re.Match[str]) -> Iterator[Layer]:
    """Layers of a run whose URL escapes give compressed data or UTF-16."""
    data = urllib.parse.unquote_to_bytes(run[0])
    place = _place(layer, run.start(), run.end())
    starts = {m.start() for m in MAGIC.finditer(data) if _unpacks(data[m.start() : m.start() + (1 << 12)])}
    for start in sorted(starts | ({0} if b"\0" in data else set())):
        for inner in _readable(data[start:]):
            yield inner, None, *place


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and content of base64 over several lines: lines of equal width and a last one no wider."""
    for m in BASE64_LINES.finditer(text):
        runs = [(r.start(), r.end()) for r in BASE64_LINE.finditer(text, m.start(), m.end())]
        width = [e - s for s, e in runs]
        i = 0
        while i < len(runs):
            j = i
            while j + 1 < len(runs) and width[j + 1] == width[i]:
                j += 1
            last = j + 1 if j + 1 < len(runs) and width[j + 1] < width[i] else j
            # The first line of all may follow other text in its line, and then be of any width.
            begin = text.rfind("\n", 0, runs[0][0]) + 1
            froms = [i] if i != 1 or not text[begin : runs[0][0]].strip() else [i, 0]
            for k in froms:
                if last > k:
                    yield runs[k][0], runs[last][1], "".join(text[s:e] for s, e in runs[k : last + 1])
            i = j + 1


def _base64(run: str) -> bytes | None:
    """The bytes that a run encodes, if it may encode any."""
    body = run.rstrip("=")
    if len(run) < LEAST or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode((body + "=" * (-len(body) % 4)).translate(STANDARD), validate=True)
    except (binascii.Error, ValueError):
        return None


def _decodings(run: str) -> Iterator[tuple[int, bytes]]:
    """What a run may encode from any of its places, as other characters (those of a path) may lead up to it.

    Of the bytes of each of the four alignments: all, if any row of them is as
    long as the shortest secret in characters of an encoding, and what unpacks.
    With each, the place in the run from which it is decoded.
    """
    body = run.rstrip("=")
    for offset in range(min(4, len(body) - LEAST + 1)):
        part = body[offset : len(body) - ((len(body) - offset) % 4 == 1)]
        if (data := _base64(part)) is None:
            continue
        if _unpacks(data[: 1 << 12]):
            yield offset, data  # with what its streams are followed by
            continue
        if ROW.search(data):
            yield offset, data
        for m in MAGIC.finditer(data):
            if _unpacks(data[m.start() : m.start() + (1 << 12)]):
                yield offset + m.start() // 3 * 4, data[m.start() :]


def _layers(layer: Layer) -> Iterator[Layer]:
    text = layer[0]
    if "%" in text and URL_ESCAPES.search(text):
        yield _rewritten(layer, URL_ESCAPES, _url_decoded)
        for m in URL_RUN.finditer(text):
            if "%" in m[0] and URL_BYTES.search(m[0]):
                yield from _escaped_bytes(layer, m)
    if ("\\" in text or "&#" in text) and UNICODE_ESCAPES.search(text):
        yield _rewritten(layer, UNICODE_ESCAPES, lambda s: (_escaped(s), [0]))
    whole: set[int] = set()  # where wrapped compressed data begins
    for start, end, run in _wrapped(text):
        if (data := _base64(run)) is not None:
            place = _place(layer, start, end)
            for inner in _readable(data):
                yield inner, None, *place
                if _unpacker(data) is not None:
                    whole.add(start)
    for m in BASE64_RUN.finditer(text):
        if m.start() in whole:
            continue  # its first line alone would unpack to a part of it
        for at, data in _decodings(m[0]):
            place = _place(layer, m.start() + at, m.end())
            for inner in _readable(data):
                yield inner, None, *place


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """The secrets of a whole text as it stands, and those with all layers', both sorted.

    A secret found in an escaped layer spans the characters it was made from; one
    found in base64 or compressed data spans the encoded run.
    """
    text = text or ""
    base = scan(text)
    found, seen = set(base), {hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()}
    ours = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]  # those of a kind don't overlap
    work: list[Iterator[Layer]] = []
    whole = range(len(text) + 1)
    work.append(_layers((text, whole, 0, len(text))))
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        key = hashlib.blake2b(layer[0].encode(errors="surrogatepass") + repr((layer[2:], layer[1] is None)).encode(), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        for start, kind, end in scan(layer[0]):
            lo, hi = _place(layer, start, end)
            if (lo, kind, hi) in found:
                continue
            at = bisect.bisect_right(ours[kind], (lo, len(text) + 1)) - 1
            s, e = ours[kind][at] if at >= 0 else (0, -1)
            if not (hi <= e and text[s:e] == layer[0][start:end]):  # not the same one that stands there already
                found.add((lo, kind, hi))
        work.append(_layers(layer))
    return base, sorted(found)


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text; other columns play no part).

    Result, a row per input row: doc_id, n_assign, n_access, n_hex and
    base_sha256 of the secrets as they stand, and spans with all layers' too.

    A null text is read as empty and has none.  Repeated rows stay repeated; a
    null doc_id is kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [spans(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(1 for x in base if x[1] == k) for base, _ in rows], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([listed(x) for _, x in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str | None, mark: str = "[SECRET]") -> str | None:
    """A text with its secrets' spans replaced; spans that overlap become one mark."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in spans(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret masked and n_chars, where there is one, counted anew; rows and other columns as they were.

    A null text stays null and an empty one empty; rows that repeat stay repeated;
    an empty table gives no rows.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [masked(t.as_py(), mark) for t in batch.column(names.index("text"))]
            yield batch.set_column(names.index("text"), pa.field("text", pa.string()), pa.array(texts, pa.string()))

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
