"""Compound (OLE) and zip containers as rows: inventories and streams.

Bytes come through Spark's binaryFile reader, so any store that Spark reads will do; Python
only takes a container apart.
"""

from __future__ import annotations

import io
import itertools
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import METADATA_FONTS, noisy, normalized, readable, without_controls
from ..operators.sequences import take_until

# Fixed values of the compound file format.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
#: What reading a damaged file may raise.
BROKEN = (ValueError, struct.error, IndexError, KeyError, OverflowError, EOFError, RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error)
#: Rows that Python makes at once.
ROWS = 1000
TYPES = {1: "storage", 2: "stream", 5: "root"}


class Compound:
    """A compound file: entries (path, name, type, size) and the bytes of a stream."""

    def __init__(self, raw: bytes):
        if raw[:8] != SIGNATURE:
            raise ValueError("no compound file")
        self.raw = raw
        major, shift, mini = struct.unpack_from("<H2xHH", raw, 26)
        self.sector, self.mini = 1 << shift, 1 << mini
        directory, self.cutoff, mini_fat, _, difat, _ = struct.unpack_from("<I4xIIIII", raw, 48)
        fat_sectors = list(struct.unpack_from("<109I", raw, 76))
        seen = set()
        while difat not in (FREE, END):
            if difat in seen:
                raise ValueError("the sector lists form a ring")
            seen.add(difat)
            more = struct.unpack_from(f"<{self.sector // 4}I", raw, (difat + 1) * self.sector)
            fat_sectors += more[:-1]
            difat = more[-1]
        self.fat = [x for s in fat_sectors if s not in (FREE, END) for x in struct.unpack_from(f"<{self.sector // 4}I", raw, (s + 1) * self.sector)]
        self.entries = self._directory(self._chain(directory))
        mini_raw = self._chain(mini_fat) if mini_fat not in (FREE, END) else b""
        self.mini_fat = list(struct.unpack(f"<{len(mini_raw) // 4}I", mini_raw))
        self.mini_stream = self._chain(self.entries[0]["start"]) if self.entries else b""

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at not in (FREE, END) and at < len(self.fat) and at not in seen:
            seen.add(at)
            out.append(self.raw[(at + 1) * self.sector : (at + 2) * self.sector])
            at = self.fat[at]
        return b"".join(out)

    def _directory(self, raw: bytes) -> list[dict]:
        slots = []
        for lo in range(0, len(raw) - 127, 128):
            size, kind = struct.unpack_from("<HB", raw, lo + 64)
            left, right, child = struct.unpack_from("<III", raw, lo + 68)
            start, length = struct.unpack_from("<IQ", raw, lo + 116)
            slots.append({"name": raw[lo : lo + max(size - 2, 0)].decode("utf-16-le", "replace"), "kind": kind, "left": left, "right": right, "child": child, "start": start, "size": length & 0xFFFFFFFF})
        out: list[dict] = []
        stack = [(0, "")] if slots else []
        seen = set()
        while stack:
            number, above = stack.pop()
            if number >= len(slots) or number in seen:
                continue
            seen.add(number)
            s = slots[number]
            path = f"{above}/{s['name']}" if above else s["name"]
            out.append({"path": path, "name": s["name"], "type": TYPES.get(s["kind"], "unknown"), "size": 0 if s["kind"] == 1 else s["size"], "start": s["start"]})
            stack += [(s["right"], above), (s["left"], above), (s["child"], path)]
        return out

    def stream(self, entry: dict) -> bytes:
        if entry["size"] >= self.cutoff or entry["type"] == "root":
            return self._chain(entry["start"])[: entry["size"]]
        out, at = [], entry["start"]
        while at not in (FREE, END) and at < len(self.mini_fat) and len(out) <= len(self.mini_fat):
            out.append(self.mini_stream[at * self.mini : (at + 1) * self.mini])
            at = self.mini_fat[at]
        return b"".join(out)[: entry["size"]]


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def batches_of(rows: Iterator[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ROWS at most, each given on before the next one is made; an empty one where there are none."""
    rows = iter(rows)
    while True:
        part = list(itertools.islice(rows, ROWS))
        columns = zip(*part, strict=True) if part else ((),) * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
        if len(part) < ROWS:
            return


def _mapped(files: DataFrame, schema: str, rows_of) -> DataFrame:
    """The rows of each file, however many files come at once and rows a file has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = zip(batch.column("path"), batch.column("content"), strict=True)
            yield from batches_of(((path.as_py(), *r) for path, content in named for r in rows_of(content.as_py() or b"")), kinds)

    empty = files.sparkSession.createDataFrame([], schema).toArrow()
    kinds = empty.schema
    return files.mapInArrow(run, schema)


ENTRY_SCHEMA = "doc_id string, entry_no int, path string, name string, type string, size bigint"


def entries(files: DataFrame) -> DataFrame:
    """A row for each entry of each container, compound or zip; other files have none."""

    def rows_of(raw: bytes) -> Iterator[tuple]:
        try:
            if raw[:8] == SIGNATURE:
                found = [(e["path"], e["name"], e["type"], e["size"]) for e in Compound(raw).entries]
            else:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    found = [(i.filename, i.filename.rstrip("/").rsplit("/", 1)[-1], "storage" if i.is_dir() else "stream", i.file_size) for i in z.infolist()]
        except BROKEN:
            found = []
        for number, (path, name, kind, size) in enumerate(found):
            yield number, path.removesuffix("/") or "/", name, kind, size

    return _mapped(files, ENTRY_SCHEMA, rows_of)


def write_inventory(found: DataFrame, path: str) -> None:
    """The inventory as JSON lines."""
    found.write.mode("overwrite").json(path)


def canonical_streams(files: DataFrame, path: str = "Root Entry/Quill/QuillSub/CONTENTS", least: int = 1024) -> DataFrame:
    """doc_id and content: the named stream, else the first larger one called CONTENTS."""

    def rows_of(raw: bytes) -> Iterator[tuple]:
        try:
            box = Compound(raw)
        except BROKEN:
            return
        named = [e for e in box.entries if e["path"] == path] or [e for e in box.entries if e["name"] == "CONTENTS" and e["size"] > least]
        if named:
            yield (box.stream(named[0]),)

    return _mapped(files, "doc_id string, content binary", rows_of)


def canonical_paragraphs(streams: DataFrame, marker: str | None = None, fonts: tuple[str, ...] = METADATA_FONTS) -> DataFrame:
    """Readable paragraphs of UTF-16 streams, from the marker on and before the first noise."""
    text = F.decode("content", "UTF-16LE")
    if marker:
        at = F.instr(text, marker)
        text = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    parts = F.transform(F.split(F.translate(without_controls(text), "\n", "\r"), "\r+"), normalized)
    kept = F.filter(take_until(F.col("parts"), lambda p: noisy(p, fonts)), readable)
    return streams.select("doc_id", parts.alias("parts")).select("doc_id", F.posexplode(kept).alias("para_no", "text"))
