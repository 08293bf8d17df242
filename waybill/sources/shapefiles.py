"""Features of zipped shapefiles, part by part.

Archives are split by file, so many archives are many tasks; inside one, shapes and their attributes are read side by side
as streams and given on in batches of bounded size.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of a batch that a task holds at once, besides one feature.
_POINTS = 200_000

#: Shape types by layout, in two dimensions, with heights, with measures.
POINT, LINES, POINTS = (1, 11, 21), (3, 13, 23, 5, 15, 25), (8, 18, 28)

SCHEMA = "file string, member string, feature int, part int, properties map<string,string>, points array<struct<lon: double, lat: double>>, error string"

_ARROW = pa.schema([
    ("file", pa.string()), ("member", pa.string()), ("feature", pa.int32()), ("part", pa.int32()), ("properties", pa.map_(pa.string(), pa.string())),
    ("points", pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))), ("error", pa.string()),
])


class Unreadable(Exception):
    """What of an archive cannot be read, in words."""


def rows(spark: SparkSession, path: str, layer: str, least_points: int = 2) -> DataFrame:
    """(file, member, feature, part, properties, points) of layer ``layer`` in the zip archives at ``path``.

    The layer is the member whose name ends with ``layer`` and .shp; of several, one that is no superseded version 1.0, then
    one whose name does not speak of UTF, then the first by name. Texts are UTF-8 if the name speaks of UTF, else cp932; bytes
    that are neither become replacement characters. Properties are texts without NULs and outer blanks, empty ones null.
    Features count from 0 with deleted ones, which have no rows; parts of fewer points than ``least_points``, shapes without
    points and patches give none either. Of a damaged archive the features before the damage are here; what is wrong with it
    is in ``rejects``.
    """
    return _read(spark, path, layer, least_points).where("error is null").drop("error")


def rejects(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(file, error) of the archives that ``rows`` does not give whole: no zip, no such layer, no attributes, cut or malformed."""
    return _read(spark, path, layer, 1).where("error is not null").select("file", "error")


def _read(spark: SparkSession, path: str, layer: str, least_points: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                held, n = [], 0
                for row in _archive(file.as_py(), content.as_py(), layer, least_points):
                    held.append(row)
                    n += 1 + len(row["points"] or ())
                    if n >= _POINTS:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held, n = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def member(names: list[str], layer: str) -> str | None:
    """The layer's member without its ending, of all names in an archive."""
    found = [n for n in names if n.endswith(f"{layer}.shp")]
    return min(found, key=lambda n: ("v1.0" in n.lower(), "utf" in n.lower(), n))[:-4] if found else None


def _archive(file: str, content: bytes, layer: str, least_points: int) -> Iterator[dict]:
    base = None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            base = member(z.namelist(), layer)
            if base is None:
                raise Unreadable(f"no {layer}.shp")
            if f"{base}.dbf" not in z.namelist():
                raise Unreadable(f"no {base}.dbf")
            with z.open(f"{base}.shp") as shp, z.open(f"{base}.dbf") as dbf:
                attributes = _attributes(dbf, "utf-8" if "utf" in base.lower() else "cp932")
                for k, (parts, properties) in enumerate(zip(_shapes(shp), attributes)):
                    for p, points in enumerate(parts if properties is not None else ()):
                        if len(points) >= least_points:
                            own = [{"lon": x, "lat": y} for x, y in points]
                            yield {"file": file, "member": base, "feature": k, "part": p, "properties": list(properties.items()), "points": own}
    except (Unreadable, zipfile.BadZipFile, struct.error) as e:
        yield {"file": file, "member": base, "points": None, "error": str(e) or type(e).__name__}


def _exactly(stream, n: int, what: str) -> bytes:
    got = stream.read(n)
    if len(got) < n:
        raise Unreadable(f"{what} cut")
    return got


def _shapes(shp) -> Iterator[list[list[tuple[float, float]]]]:
    """The parts of each shape."""
    _exactly(shp, 100, "header of shapes")
    while head := shp.read(8):
        if len(head) < 8:
            raise Unreadable("shapes cut")
        body = _exactly(shp, 2 * struct.unpack(">ii", head)[1], "shapes")
        (kind,) = struct.unpack_from("<i", body)
        if kind in POINT:
            yield [[struct.unpack_from("<dd", body, 4)]]
        elif kind in LINES:
            n_parts, n = struct.unpack_from("<ii", body, 36)
            starts = struct.unpack_from(f"<{n_parts}i", body, 44)
            points = list(struct.iter_unpack("<dd", _slice(body, 44 + 4 * n_parts, 16 * n)))
            yield [points[a:b] for a, b in zip(starts, (*starts[1:], n))]
        elif kind in POINTS:
            yield [list(struct.iter_unpack("<dd", _slice(body, 40, 16 * struct.unpack_from("<i", body, 36)[0])))]
        else:
            yield []


def _slice(body: bytes, at: int, n: int) -> bytes:
    if n < 0 or at + n > len(body):
        raise Unreadable("shape with more points than its record holds")
    return body[at : at + n]


def _attributes(dbf, encoding: str) -> Iterator[dict[str, str | None] | None]:
    """The attributes of each record, None of a deleted one."""
    head = _exactly(dbf, 32, "header of attributes")
    n, head_size, size = struct.unpack_from("<IHH", head, 4)
    described = _exactly(dbf, head_size - 32, "header of attributes")
    fields = []
    for at in range(0, len(described) - 31, 32):
        if described[at] == 0x0D:
            break
        fields.append((described[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), described[at + 16]))
    for _ in range(n):
        record, at, own = _exactly(dbf, size, "attributes"), 1, {}
        for name, width in fields:
            own[name] = record[at : at + width].decode(encoding, "replace").replace("\0", "").strip() or None
            at += width
        yield None if record[:1] == b"*" else own
