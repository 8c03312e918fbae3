"""Export archives of any size: a ZIP whose members are deflated in the tasks that hold their rows.

Deflate streams that end on a byte can be put end to end, and CRC-32 of joined parts follows from those of the parts. So
each partition of a section deflates its rows as a piece for each format (CSV, JSON, HTML) into the shared folder and
tells its lengths and checksum. From these, one row a piece, the places of all pieces in the archive are known. On a
mounted target the pieces are then copied to their places by tasks side by side; elsewhere one task streams them in
order. The driver writes what lies between: the members' heads and frames and the central directory.

Defined cases: a section without rows gives members with their frames only; order within a section is that of its
partitions, so sort it before; offsets are 64 bits wide throughout; the manifest names for each member its rows, bytes, CRC-32
and a SHA-256 over the SHA-256 of its pieces; a lost task leaves pieces that no row names; the archive gets its name when it is
whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.expressions import html_escape
from granary.sources.sinks import BASE_FIELDS, BOM, check_schema, csv_record
from granary.sources.stages import new_folder, stage

FORMATS = ("csv", "json", "html")
#: What stands between two rows of a format; CSV records bring their own line end.
_BETWEEN = {"csv": b"", "json": b",", "html": b""}
_POLYNOMIAL = 0xEDB88320  # of CRC-32, its bits reversed: a fixed value
_BLOCK = 1 << 20
_PIECES = "section string, format string, part int, file string, n_rows long, n_bytes long, packed long, crc long, sha256 string"
_ARROW = pa.schema([("section", pa.string()), ("format", pa.string()), ("part", pa.int32()), ("file", pa.string()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("packed", pa.int64()), ("crc", pa.int64()), ("sha256", pa.string())])


def _product(a: int, b: int) -> int:
    """The product of two polynomials over GF(2) modulo CRC-32's, bit 31 being the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, second_length: int) -> int:
    """CRC-32 of two parts put together, from their own and the length of the second."""
    shift, power, n = 1 << 31, 1 << 23, second_length  # x**0; x**8, a byte
    while n:
        if n & 1:
            shift = _product(power, shift)
        power, n = _product(power, power), n >> 1
    return _product(shift, first) ^ second


def deflated(data: bytes) -> bytes:
    """Raw deflate of some bytes, ended on a byte and open for more."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush(zlib.Z_FULL_FLUSH)


_END = zlib.compressobj(6, zlib.DEFLATED, -15).flush(zlib.Z_FINISH)


class _Piece:
    """One partition's rows in one format, deflated into a file as they come."""

    def __init__(self, path: str, between: bytes):
        self.system, place = fs.FileSystem.from_uri(path)
        self.path, self.out, self.between = path, self.system.open_output_stream(place), between
        self.z, self.rows, self.bytes, self.packed, self.crc, self.digest = zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0, 0, 0, hashlib.sha256()

    def add(self, rows: list[str]) -> None:
        if rows:
            data = (self.between if self.rows else b"") + self.between.join(r.encode() for r in rows)
            self.rows, self.bytes, self.crc = self.rows + len(rows), self.bytes + len(data), zlib.crc32(data, self.crc)
            self.digest.update(data)
            self._put(self.z.compress(data))

    def _put(self, packed: bytes) -> None:
        self.packed += len(packed)
        self.out.write(packed)

    def closed(self, section: str, kind: str, part: int) -> dict:
        self._put(self.z.flush(zlib.Z_FULL_FLUSH))
        self.out.close()
        return {"section": section, "format": kind, "part": part, "file": self.path, "n_rows": self.rows, "n_bytes": self.bytes, "packed": self.packed, "crc": self.crc, "sha256": self.digest.hexdigest()}


def _pieces(section: str, rows: DataFrame, folder: str) -> DataFrame:
    columns = check_schema(rows, tuple(c for c in rows.columns if c not in BASE_FIELDS))
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    text = rows.select(
        F.concat(csv_record(columns), F.lit("\n")).alias("csv"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>\n")).alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        pieces = None
        for b in batches:
            if b.num_rows:
                pieces = pieces or {k: _Piece(f"{folder}/{section}-{part}-{own}.{k}", _BETWEEN[k]) for k in FORMATS}
                for k, column in zip(FORMATS, b.columns):
                    pieces[k].add(column.to_pylist())
        if pieces:
            yield pa.RecordBatch.from_pylist([p.closed(section, k, part) for k, p in pieces.items()], _ARROW)

    return text.mapInArrow(run, _PIECES)


@dataclass
class _Member:
    """A member while the archive is laid out: what the driver writes itself, and where the pieces go."""

    name: str
    at: int
    bytes: int = 0
    packed: int = 0
    crc: int = 0
    own: list[tuple[int, bytes]] = field(default_factory=list)

    def add(self, n_bytes: int, packed: int, crc: int) -> int:
        """Appends a part; returns its place in the archive."""
        place = self.at + 30 + len(self.name.encode()) + 20 + self.packed
        self.bytes, self.packed, self.crc = self.bytes + n_bytes, self.packed + packed, joined_crc(self.crc, crc, n_bytes)
        return place

    def write(self, data: bytes, packed: bytes | None = None) -> None:
        packed = deflated(data) if packed is None else packed
        self.own.append((self.add(len(data), len(packed), zlib.crc32(data)), packed))

    def head(self) -> bytes:
        """The local header: sizes in a 64-bit field."""
        extra = struct.pack("<HHQQ", 1, 16, self.bytes, self.packed)
        return struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 8, 0, 33, self.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name.encode()), len(extra)) + self.name.encode() + extra

    def entry(self) -> bytes:
        """The entry in the central directory."""
        extra = struct.pack("<HHQQQ", 1, 24, self.bytes, self.packed, self.at)
        return struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 8, 0, 33, self.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name.encode()), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + self.name.encode() + extra

    @property
    def end(self) -> int:
        return self.at + 30 + len(self.name.encode()) + 20 + self.packed


def _frame(kind: str, columns: list[str], manifest: dict) -> tuple[bytes, bytes]:
    if kind == "csv":
        return (BOM + ",".join(columns) + "\r\n").encode(), b""
    if kind == "json":
        return ('{"manifest":' + json.dumps(manifest, ensure_ascii=False) + ',"columns":' + json.dumps(columns) + ',"rows":[').encode(), b"]}"
    return ("<!doctype html><meta charset=utf-8><table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>\n").encode(), b"</table>\n"


def write_archive(sections: dict[str, DataFrame], target: str, manifest: dict) -> None:
    """Writes ``target`` with section.csv, section.json and section.html for each section, and manifest.json."""
    spark: SparkSession = next(iter(sections.values())).sparkSession
    folder = new_folder(spark, "archive-pieces")
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place)
    found = None
    for name, rows in sections.items():
        own = _pieces(name, rows, folder)
        found = own if found is None else found.unionByName(own)
    pieces = stage(found, "archive")
    members, places, checksums, at = [], [], {}, 0
    listed = pieces.orderBy("section", "format", "part").collect()  # one row a piece
    for name, rows in sections.items():
        for kind in FORMATS:
            head, foot = _frame(kind, check_schema(rows, tuple(c for c in rows.columns if c not in BASE_FIELDS)), manifest)
            m, own = _Member(f"{name}.{kind}", at), [p for p in listed if p["section"] == name and p["format"] == kind]
            m.write(head)
            for k, p in enumerate(own):
                if k and _BETWEEN[kind]:
                    m.write(_BETWEEN[kind])
                places.append((p["file"], m.add(p["n_bytes"], p["packed"], p["crc"]), p["packed"]))
            m.write(foot, deflated(foot) + _END)
            digest = hashlib.sha256("".join(p["sha256"] for p in own).encode()).hexdigest()
            checksums[m.name] = {"rows": sum(p["n_rows"] for p in own), "bytes": m.bytes, "crc32": f"{m.crc:08x}", "pieces_sha256": digest}
            members.append(m)
            at = m.end
    last, text = _Member("manifest.json", at), json.dumps({**manifest, "members": checksums}, ensure_ascii=False).encode()
    last.write(text, deflated(text) + _END)
    members.append(last)
    directory = b"".join(m.entry() for m in members)
    tail = directory + struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(directory), last.end)
    tail += struct.pack("<IIQI", 0x07064B50, 0, last.end + len(directory), 1) + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    written = [(m.at, m.head()) for m in members] + [x for m in members for x in m.own] + [(last.end, tail)]
    _assemble(spark, target, written, places)


def _assemble(spark: SparkSession, target: str, written: list[tuple[int, bytes]], places: list[tuple[str, int, int]]) -> None:
    target = target if "://" in target else f"file://{os.path.abspath(target)}"
    system, place = fs.FileSystem.from_uri(target)
    staged = f"{place}.staged-{uuid.uuid4().hex}"
    if isinstance(system, fs.LocalFileSystem):
        with open(staged, "wb") as f:
            for at, data in written:
                f.seek(at)
                f.write(data)

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    own, source = fs.FileSystem.from_uri(r["file"])
                    with own.open_input_stream(source) as f, open(staged, "r+b") as out:
                        out.seek(r["at"])
                        while block := f.read(_BLOCK):
                            out.write(block)
                yield b

        if places:
            table = spark.createDataFrame(places, "file string, at long, packed long")
            table.repartition(min(len(places), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(copy, "file string, at long, packed long").write.format("noop").mode("overwrite").save()
    else:

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out_system, out_place = fs.FileSystem.from_uri(target + staged[len(place) :])
            with out_system.open_output_stream(out_place) as out:
                for b in batches:
                    for r in b.to_pylist():
                        if r["data"] is not None:
                            out.write(r["data"])
                            continue
                        own, source = fs.FileSystem.from_uri(r["file"])
                        with own.open_input_stream(source) as f:
                            while block := f.read(_BLOCK):
                                out.write(block)
                    yield b

        kind = "at long, file string, data binary"
        rows = [(at, None, data) for at, data in written] + [(at, file, None) for file, at, _ in places]
        spark.createDataFrame(sorted(rows, key=lambda r: r[0]), kind).coalesce(1).sortWithinPartitions("at").mapInArrow(stream, kind).write.format("noop").mode("overwrite").save()
    system.move(staged, place)
