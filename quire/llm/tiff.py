"""TIFF pages as rows (operator 4).

:func:`read_pages` walks the image directories of TIFF files in a binary column and gives one
row per page with its samples. It reads both byte orders, 8-bit and bilevel samples, strips
and tiles, chunky and planar samples, uncompressed, PackBits, LZW and deflate data, and undoes
horizontal differencing. :func:`write_pages` stores a payload as grey 8-bit pages in one file:
rows of WIDTH samples, at most PAGE_ROWS rows a page, in strips or tiles.

Defined results: a null or empty file, or one that is no TIFF, is cut off or claims a page of more than
MOST_SAMPLES samples, gives one row with
page null and the reason in ``error``, and null digests; a null or empty text is a payload of 64 zero bytes; equal
files and repeated rows give equal rows; a long text has as many pages as it needs, in one file in memory; columns other than
those named are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
PAGE_ROWS = 4096
STRIP_ROWS = 512
TILE = 64
#: Samples of a page at most, as they are held in memory at once; a few bytes of a bad file can claim any number.
MOST_SAMPLES = 1 << 28

# Fixed values of the TIFF 6.0 format: tags, compressions, and bytes of each field type.
IMAGE_WIDTH, IMAGE_LENGTH, BITS_PER_SAMPLE, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_BYTE_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


class NotTiff(ValueError):
    """What was read is no whole TIFF file."""


# ---- compressions ----


def packbits_pack(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_unpack(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_pack(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    bits, filled, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, filled
        bits, filled = bits << width | code, filled + width
        while filled >= 8:
            filled -= 8
            out.append(bits >> filled & 255)
        bits &= (1 << filled) - 1

    put(256, 9)
    table: dict[tuple[int, int], int] = {}
    following, width, prefix = 258, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
        elif (code := table.get((prefix, byte))) is not None:
            prefix = code
        else:
            put(prefix, width)
            table[prefix, byte] = following
            following, prefix = following + 1, byte
            if following == 4094:
                put(prefix, width)
                put(256, width)
                table, following, width, prefix = {}, 258, 9, -1
            elif following >= (1 << width):
                width += 1
    if prefix >= 0:
        put(prefix, width)
        if following + 1 >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if filled:
        out.append(bits << (8 - filled) & 255)
    return bytes(out)


def lzw_unpack(data: bytes, size: int) -> bytes:
    out = bytearray()
    table: list[bytes] = []
    width, bits, filled, last = 9, 0, 0, b""
    for byte in data:
        bits, filled = bits << 8 | byte, filled + 8
        if filled < width:
            continue
        filled -= width
        code = bits >> filled
        bits &= (1 << filled) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise NotTiff("LZW data begin without a clear code")
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise NotTiff("LZW data hold a code that is not yet defined")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def pack(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_pack(data)
    if compression == LZW:
        return lzw_pack(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    raise NotTiff(f"compression {compression}")


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = packbits_unpack(data, size)
    elif compression == LZW:
        out = lzw_unpack(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise NotTiff(f"deflate: {e}") from e
    else:
        raise NotTiff(f"compression {compression}")
    if len(out) < size:
        raise NotTiff("a strip or tile is too short")
    return out[:size]


# ---- writing ----


def _differences(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def write_pages(payload: bytes, *, compression: int = DEFLATE, predictor: int = 2, tiled: bool = False, order: str = "<") -> bytes:
    """A TIFF of grey 8-bit pages, WIDTH samples wide; payload is a multiple of WIDTH bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for top in range(0, len(samples), PAGE_ROWS):
        page = samples[top : top + PAGE_ROWS]
        step = TILE if tiled else STRIP_ROWS
        offsets, sizes = [], []
        for row in range(0, len(page), step):
            part = page[row : row + step]
            if tiled and len(part) < TILE:
                part = np.vstack([part, np.zeros((TILE - len(part), WIDTH), np.uint8)])
            if predictor == 2:
                part = _differences(part)
            # PackBits runs end with a row.
            data = b"".join(pack(line.tobytes(), compression) for line in part) if compression == PACKBITS else pack(part.tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        fields = [(IMAGE_WIDTH, 4, [WIDTH]), (IMAGE_LENGTH, 4, [len(page)]), (BITS_PER_SAMPLE, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES_PER_PIXEL, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [TILE]), (TILE_LENGTH, 4, [TILE]), (TILE_OFFSETS, 4, offsets), (TILE_BYTE_COUNTS, 4, sizes)] if tiled else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [STRIP_ROWS]), (STRIP_BYTE_COUNTS, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---- reading ----


@dataclass
class Page:
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    samples: bytes = field(repr=False)


def _directory(raw: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(order + "H", raw, at)
    found: dict[int, list[int]] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        size = TYPE_BYTES.get(kind, 1) * n
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", raw, place)
        if kind in (1, 3, 4):
            found[tag] = list(struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }".replace(" ", ""), raw, place))
    return found, struct.unpack_from(order + "I", raw, at + 2 + 12 * count)[0]


def _page(raw: bytes, tags: dict[int, list[int]]) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in tags:
            return tags[tag][0]
        if default is None:
            raise NotTiff(f"tag {tag} is missing")
        return default

    width, height, channels = one(IMAGE_WIDTH), one(IMAGE_LENGTH), one(SAMPLES_PER_PIXEL, 1)
    bits, compression, predictor = one(BITS_PER_SAMPLE, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if bits not in (1, 8) or predictor not in (1, 2) or (predictor == 2 and bits != 8):
        raise NotTiff(f"{bits} bits a sample with predictor {predictor}")
    if TILE_OFFSETS in tags:
        across, down = one(TILE_WIDTH), one(TILE_LENGTH)
        offsets, sizes = tags[TILE_OFFSETS], tags[TILE_BYTE_COUNTS]
    else:
        across, down = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, sizes = tags[STRIP_OFFSETS], tags[STRIP_BYTE_COUNTS]
    if min(width, height, channels, across, down) < 1 or width * height * channels > MOST_SAMPLES or across * down * channels > MOST_SAMPLES:
        raise NotTiff(f"a page of {width} x {height} x {channels} samples in parts of {across} x {down}")
    planes = channels if one(PLANAR, 1) == 2 else 1
    each = channels // planes
    out = np.zeros((planes, height, width * each), np.uint8)
    columns, lines = -(-width // across), -(-height // down)
    for k in range(planes * columns * lines):
        plane, (line, column) = k // (columns * lines), divmod(k % (columns * lines), columns)
        top, left = line * down, column * across
        rows = down if TILE_OFFSETS in tags else min(down, height - top)
        stride = (across * each * bits + 7) // 8
        if offsets[k] + sizes[k] > len(raw):
            raise NotTiff("a strip or tile lies outside the file")
        part = np.frombuffer(unpack(raw[offsets[k] : offsets[k] + sizes[k]], compression, rows * stride), np.uint8).reshape(rows, stride)
        if bits == 1:
            part = np.unpackbits(part, axis=1)[:, : across * each]
        elif predictor == 2:
            part = np.cumsum(part.reshape(rows, across, each), axis=1, dtype=np.uint8).reshape(rows, stride)
        high, wide = min(rows, height - top), min(across, width - left)
        out[plane, top : top + high, left * each : (left + wide) * each] = part[:high, : wide * each]
    return Page(width, height, channels, bits, compression, out.tobytes())


def decode(raw: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    try:
        order = {b"II": "<", b"MM": ">"}[raw[:2]]
        magic, at = struct.unpack_from(order + "HI", raw, 2)
        if magic != 42:
            raise NotTiff("no TIFF header")
        seen = set()
        while at:
            if at in seen:
                raise NotTiff("the directories form a ring")
            seen.add(at)
            tags, following = _directory(raw, at, order)
            yield _page(raw, tags)
            at = following
    except NotTiff:
        raise
    except (KeyError, IndexError, ValueError, OverflowError, struct.error) as e:
        raise NotTiff(f"cut off or no TIFF: {e}") from e


PAGE_SCHEMA = "page int, width int, height int, channels int, bits int, compression int, samples binary, error string"


def read_pages(files: DataFrame, *, key: str, media: str) -> DataFrame:
    """A row for each page of each file: key, then PAGE_SCHEMA."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(),) * 6 + (pa.binary(), pa.string())
        names = [key, "page", "width", "height", "channels", "bits", "compression", "samples", "error"]
        for batch in batches:
            for k, raw in enumerate(batch.column(media)):
                rows: list[tuple] = []
                try:
                    for number, p in enumerate(decode(raw.as_py() or b"")):
                        rows.append((number, p.width, p.height, p.channels, p.bits, p.compression, p.samples, None))
                except NotTiff as e:
                    rows = [(None,) * 7 + (str(e),)]
                at = pa.array([k] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(at), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))] if rows else [batch.column(key).take(at), *(pa.array([], t) for t in types)], names)

    return files.select(key, media).mapInArrow(run, f"`{key}` {kind}, {PAGE_SCHEMA}")


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of WIDTH."""
    return text + b"\0" * (WIDTH - len(text) % WIDTH if not text or len(text) % WIDTH else 0)


def texts_as_tiff(docs: DataFrame, **layout) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a TIFF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for lo in range(0, len(column), 256):
                raw = [x or b"" for x in column.slice(lo, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_pages(payload_of(x), **layout) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(samples: np.ndarray, pages: int) -> str:
    """Pages, mean, spread and entropy of the samples, and the mean of four bands, as one string."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    entropy = float(-(share * np.log2(share)).sum())
    total = int((counts * np.arange(256)).sum())
    square = int((counts * np.arange(256) ** 2).sum())
    mean = total / len(samples)
    bands = [float(b.mean()) for b in np.array_split(samples, 4)]
    return f"pages={pages};mean={mean:.4f};sd={max(square / len(samples) - mean * mean, 0) ** 0.5:.4f};entropy={entropy:.4f};bands=" + ",".join(f"{b:.3f}" for b in bands)


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"


def digests(media: DataFrame) -> DataFrame:
    """What is read back from each file of ``media`` (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
        types = (pa.int64(),) * 3 + (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        for batch in batches:
            rows = []
            for doc, n, raw in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), strict=True):
                raw = raw.as_py()
                try:
                    found = list(decode(raw or b""))
                except NotTiff:
                    rows.append((doc.as_py(), n.as_py(), *(None,) * 7))
                    continue
                payload = b"".join(p.samples for p in found)
                rows.append((doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(np.frombuffer(payload, np.uint8), len(found)), len(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST_SCHEMA)
