"""ESRI shapefiles as a Spark data source: ``spark.read.format("shapefile")`` and ``df.write.format("shapefile")``.

A table has the geometry as ``wkt`` and the attributes of the .dbf as columns. Reading, the
index file (.shx) gives the records' places, so tasks read splits of ``records`` (65,536 unless
given) records each; a file without an index is one split. Writing, each task writes files of
its own for each type of geometry under a hidden name; the commit gives them their names, an
abort deletes them, so a failed or repeated task leaves nothing.

POINT, MULTIPOINT, LINESTRING, MULTILINESTRING, POLYGON and MULTIPOLYGON of two coordinates
are taken; a null or empty geometry is a null shape. Lines and polygons of one part come back
as single ones. Outer rings run clockwise, as the format wants; a hole goes to the outer
ring around it. Names of attributes have at most 10 characters and texts 254 bytes, the
format's own bounds; what is longer is an error, not cut.
"""

from __future__ import annotations

import datetime
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the formats.
NULL, POINT, LINE, POLYGON, MULTIPOINT = 0, 1, 3, 5, 8
FILE_CODE, VERSION, HEADER_BYTES = 9994, 1000, 100
DBF_VERSION, DBF_END_OF_HEADER, DBF_END = 3, 0x0D, 0x1A
NAMES = {POINT: "point", LINE: "line", POLYGON: "polygon", MULTIPOINT: "multipoint"}
RECORDS = 65_536
TEXT_BYTES, NAME_CHARS = 254, 10

Ring = list[tuple[float, float]]


def _files(path: str):
    """The file system of ``path`` and the path in it, wherever it is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def signed_area(ring: Ring) -> float:
    """Above 0 if the ring runs anticlockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _around(ring: Ring, x: float, y: float) -> bool:
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            hit = not hit
    return hit


def _text(places: Ring) -> str:
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in places) + ")"


def to_wkt(kind: int, parts: list[Ring]) -> str | None:
    """WKT of a shape; the rings of a polygon are sorted into outer ones and their holes."""
    if kind == NULL or not parts:
        return None
    if kind == POINT:
        return "POINT " + _text(parts[0])
    if kind == MULTIPOINT:
        return "MULTIPOINT " + _text([p for ring in parts for p in ring])
    if kind == LINE:
        return "LINESTRING " + _text(parts[0]) if len(parts) == 1 else "MULTILINESTRING (" + ", ".join(map(_text, parts)) + ")"
    outer = [[r] for r in parts if signed_area(r) <= 0] or [[r] for r in parts]
    for hole in parts if len(outer) < len(parts) else ():
        if signed_area(hole) > 0:
            next((o for o in outer if _around(o[0], *hole[0])), outer[-1]).append(hole)
    rings = ["(" + ", ".join(map(_text, o)) + ")" for o in outer]
    return "POLYGON " + rings[0] if len(rings) == 1 else "MULTIPOLYGON (" + ", ".join(rings) + ")"


def from_wkt(wkt: str | None) -> tuple[int, list[Ring]]:
    """Type and parts of a geometry; outer rings clockwise, holes the other way."""
    if wkt is None or not wkt.strip() or wkt.strip().upper().endswith("EMPTY"):
        return NULL, []
    kind = wkt.split("(")[0].strip().upper()
    rings = [[tuple(map(float, p.split()[:2])) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", wkt)]
    if kind == "POINT":
        return POINT, rings
    if kind == "MULTIPOINT":
        return MULTIPOINT, [[p for r in rings for p in r]]
    if kind in ("LINESTRING", "MULTILINESTRING"):
        return LINE, rings
    if kind in ("POLYGON", "MULTIPOLYGON"):
        out = []
        for polygon in re.findall(r"\((\([^()]+\)(?:\s*,\s*\([^()]+\))*)\)", wkt):
            for k, r in enumerate(re.findall(r"\(([^()]+)\)", polygon)):
                ring = [tuple(map(float, p.split()[:2])) for p in r.split(",")]
                out.append(ring if (signed_area(ring) > 0) == (k > 0) else ring[::-1])
        return POLYGON, out
    raise ValueError(f"a geometry of this kind has no shape: {kind}")


def shape_bytes(kind: int, parts: list[Ring]) -> bytes:
    if kind == NULL:
        return struct.pack("<i", NULL)
    places = [p for part in parts for p in part]
    flat = struct.pack(f"<{2 * len(places)}d", *(v for p in places for v in p))
    if kind == POINT:
        return struct.pack("<i", POINT) + flat
    xs, ys = zip(*places, strict=True)
    head = struct.pack("<i4d", kind, min(xs), min(ys), max(xs), max(ys))
    if kind == MULTIPOINT:
        return head + struct.pack("<i", len(places)) + flat
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    return head + struct.pack(f"<2i{len(parts)}i", len(parts), len(places), *starts) + flat


def shape_of(content: bytes) -> tuple[int, list[Ring]]:
    (kind,) = struct.unpack_from("<i", content)
    if kind == NULL:
        return NULL, []
    if kind == POINT:
        return POINT, [[struct.unpack_from("<2d", content, 4)]]
    if kind not in (LINE, POLYGON, MULTIPOINT):
        raise ValueError(f"shapes of type {kind} aren't read")
    at, starts = 40, [0]
    if kind == MULTIPOINT:
        (n,) = struct.unpack_from("<i", content, 36)
    else:
        n_parts, n = struct.unpack_from("<2i", content, 36)
        starts, at = list(struct.unpack_from(f"<{n_parts}i", content, 44)), 44 + 4 * n_parts
    flat = struct.unpack_from(f"<{2 * n}d", content, at if kind != MULTIPOINT else 40)
    places = list(zip(flat[::2], flat[1::2], strict=True))
    return kind, [places[a:b] for a, b in zip(starts, [*starts[1:], n], strict=True)]


@dataclass
class Field:
    """A column of a .dbf."""

    name: str
    kind: str
    size: int
    decimals: int

    def spark(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if self.kind == "N" and not self.decimals and self.size <= 20 else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def read(self, raw: bytes):
        text = raw.decode("utf-8", "replace").strip(" \0")
        if self.kind == "C":
            return text or None
        if not text or text[0] in "*?":
            return None
        if self.kind in "NF":
            return int(text) if isinstance(self.spark(), T.LongType) else float(text)
        if self.kind == "L":
            return text in "YyTt"
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if self.kind == "D" else text

    def write(self, value) -> bytes:
        if value is None:
            return (b"?" if self.kind == "L" else b" ") * self.size
        if self.kind == "C":
            raw = value.encode()
            if len(raw) > self.size:
                raise ValueError(f"{self.name}: a text of {len(raw)} bytes; {self.size} is the most")
            return raw.ljust(self.size)
        text = {"L": lambda: "T" if value else "F", "D": lambda: value.strftime("%Y%m%d")}.get(self.kind, lambda: repr(value))()
        return text.encode().rjust(self.size)


def field_for(column: T.StructField) -> Field:
    if len(column.name.encode()) > NAME_CHARS:
        raise ValueError(f"{column.name}: names of attributes have at most {NAME_CHARS} characters")
    if isinstance(column.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Field(column.name, "N", 20, 0)
    if isinstance(column.dataType, (T.FloatType, T.DoubleType)):
        return Field(column.name, "F", 24, 15)
    kinds = {T.StringType: ("C", TEXT_BYTES), T.BooleanType: ("L", 1), T.DateType: ("D", 8)}
    for type_, (kind, size) in kinds.items():
        if isinstance(column.dataType, type_):
            return Field(column.name, kind, size, 0)
    raise ValueError(f"{column.name}: a {column.dataType.simpleString()} can't be an attribute")


def dbf_fields(raw) -> tuple[list[Field], int, int]:
    """Fields, bytes of the header and of a record, from an open .dbf."""
    head = raw.read(32)
    header, record = struct.unpack_from("<2H", head, 8)
    rest, fields = raw.read(header - 32), []
    for k in range(0, len(rest) - 31, 32):
        if rest[k] == DBF_END_OF_HEADER:
            break
        name = rest[k : k + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append(Field(name, chr(rest[k + 11]), rest[k + 16], rest[k + 17]))
    return fields, header, record


@dataclass
class Split(InputPartition):
    path: str
    first: int
    records: int | None  # None: no index, all of them


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, records: int, schema: T.StructType):
        self.path, self.records, self.columns = path, records, [f.name for f in schema]

    def partitions(self) -> list[Split]:
        out = []
        for shp in shapefiles(self.path):
            files, at = _files(shp)
            index = files.get_file_info(at[:-4] + ".shx")
            if not index.is_file:
                out.append(Split(shp, 0, None))
                continue
            n = (index.size - HEADER_BYTES) // 8
            out += [Split(shp, k, min(self.records, n - k)) for k in range(0, n, self.records)]
        return out or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[tuple]:
        if not split.path:
            return
        files, at = _files(split.path)
        with files.open_input_file(at) as shp:
            dbf = files.open_input_file(at[:-4] + ".dbf") if files.get_file_info(at[:-4] + ".dbf").is_file else None
            fields, header, size = dbf_fields(dbf) if dbf else ([], 0, 0)
            for k, content in enumerate(self._contents(files, at, shp, split)):
                row = {"wkt": to_wkt(*shape_of(content))}
                if dbf:
                    dbf.seek(header + (split.first + k) * size)
                    raw, place = dbf.read(size), 1
                    for f in fields:
                        row[f.name] = f.read(raw[place : place + f.size])
                        place += f.size
                yield tuple(row.get(c) for c in self.columns)
            if dbf:
                dbf.close()

    @staticmethod
    def _contents(files, at: str, shp, split: Split) -> Iterator[bytes]:
        if split.records is None:
            end, place = shp.size(), HEADER_BYTES
            while place + 8 <= end:
                shp.seek(place)
                _, words = struct.unpack(">2i", shp.read(8))
                yield shp.read(2 * words)
                place += 8 + 2 * words
            return
        with files.open_input_file(at[:-4] + ".shx") as shx:
            shx.seek(HEADER_BYTES + 8 * split.first)
            raw = shx.read(8 * split.records)
        for k in range(0, len(raw), 8):
            offset, words = struct.unpack_from(">2i", raw, k)
            shp.seek(2 * offset + 8)
            yield shp.read(2 * words)


def shapefiles(path: str) -> list[str]:
    """The .shp files of a folder, or the one that ``path`` names."""
    from pyarrow import fs

    if path.lower().endswith(".shp"):
        return [path]
    files, at = _files(path)
    found = sorted(i.path for i in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if i.path.lower().endswith(".shp") and not i.base_name.startswith((".", "_")))
    prefix = path[: path.index(at)] if "://" in path and at in path else ""
    return [prefix + p for p in found]


class _Part:
    """The three files that a task writes for one type of geometry."""

    def __init__(self, files, at: str, kind: int, fields: list[Field]):
        self.kind, self.fields, self.at, self.files, self.n = kind, fields, at, files, 0
        self.out = {e: files.open_output_stream(f"{at}.{e}.body") for e in ("shp", "shx", "dbf")}
        self.offset, self.box = HEADER_BYTES, None

    def add(self, kind: int, parts: list[Ring], values: tuple) -> None:
        self.n += 1
        content = shape_bytes(kind, parts)
        self.out["shp"].write(struct.pack(">2i", self.n, len(content) // 2) + content)
        self.out["shx"].write(struct.pack(">2i", self.offset // 2, len(content) // 2))
        self.out["dbf"].write(b" " + b"".join(f.write(v) for f, v in zip(self.fields, values, strict=True)))
        self.offset += 8 + len(content)
        for x, y in (p for part in parts for p in part):
            b = self.box or (x, y, x, y)
            self.box = (min(b[0], x), min(b[1], y), max(b[2], x), max(b[3], y))

    def close(self) -> None:
        """Put the headers, which need the sizes, before the bodies."""
        size = 1 + sum(f.size for f in self.fields)
        header = 33 + 32 * len(self.fields)
        shp = lambda n: struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", VERSION, self.kind, *(self.box or (0.0,) * 4), 0, 0, 0, 0)
        named = b"".join(struct.pack("<11sc4x2B14x", f.name.encode(), f.kind.encode(), f.size, f.decimals) for f in self.fields)
        dbf = struct.pack("<4BI2H20x", DBF_VERSION, 124, 1, 1, self.n, header, size) + named + bytes([DBF_END_OF_HEADER])
        ends = {"shp": (shp(self.offset), b""), "shx": (shp(HEADER_BYTES + 8 * self.n), b""), "dbf": (dbf, bytes([DBF_END]))}
        for e, (head, tail) in ends.items():
            self.out[e].close()
            with self.files.open_output_stream(f"{self.at}.{e}") as out, self.files.open_input_stream(f"{self.at}.{e}.body") as body:
                out.write(head)
                while chunk := body.read(1 << 20):
                    out.write(chunk)
                out.write(tail)
            self.files.delete_file(f"{self.at}.{e}.body")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ShapefileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.columns = [f.name for f in schema]
        if "wkt" not in self.columns:
            raise ValueError("the geometry must be in a column named wkt")
        self.fields = [field_for(f) for f in schema if f.name != "wkt"]

    def write(self, iterator) -> Written:
        from pyarrow import fs

        files, at = _files(self.path)
        files.create_dir(at)
        parts: dict[int, _Part] = {}
        task, wkt = uuid.uuid4().hex, self.columns.index("wkt")

        def put(kind, shape, values):
            if kind not in parts:
                parts[kind] = _Part(files, f"{at}/.{NAMES[kind]}-{task}", kind, self.fields)
            parts[kind].add(kind if shape else NULL, shape, values)

        try:
            for row in iterator:
                kind, shape = from_wkt(row[wkt])
                values = tuple(v for k, v in enumerate(row) if k != wkt)
                # a null shape may be in a file of any type
                put(kind if kind != NULL else next(iter(parts), POINT), shape, values)
            for p in parts.values():
                p.close()
        except BaseException:
            for name in (i.path for i in files.get_file_info(fs.FileSelector(at)) if task in i.base_name):
                files.delete_file(name)
            raise
        return Written([f"{NAMES[k]}-{task}" for k in parts])

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _files(self.path)
        files.create_dir(at)
        if self.overwrite:
            for old in shapefiles(self.path):
                for e in ("shp", "shx", "dbf"):
                    if files.get_file_info(name := _files(old)[1][:-4] + "." + e).is_file:
                        files.delete_file(name)
        for name in (n for m in messages if m for n in m.names):
            for e in ("shx", "dbf", "shp"):  # the one that readers look for last
                files.move(f"{at}/.{name}.{e}", f"{at}/{name}.{e}")

    def abort(self, messages: list[Written | None]) -> None:
        files, at = _files(self.path)
        for name in (n for m in messages if m for n in m.names):
            for e in ("shp", "shx", "dbf"):
                if files.get_file_info(f"{at}/.{name}.{e}").is_file:
                    files.delete_file(f"{at}/.{name}.{e}")


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        fields: dict[str, T.StructField] = {"wkt": T.StructField("wkt", T.StringType())}
        for shp in shapefiles(self.options["path"]):
            files, at = _files(shp)
            if files.get_file_info(at[:-4] + ".dbf").is_file:
                with files.open_input_file(at[:-4] + ".dbf") as dbf:
                    for f in dbf_fields(dbf)[0]:
                        fields.setdefault(f.name, T.StructField(f.name, f.spark()))
        return T.StructType(list(fields.values()))

    def reader(self, schema: T.StructType) -> ShapefileReader:
        return ShapefileReader(self.options["path"], int(self.options.get("records", RECORDS)), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Shapefile)
