"""A data source for GeoTIFF rasters, and a writer of small ones.

spark.read.format("geotiff").load(path) gives (path, width, height, count, crs, transform, bands); path is a file, a folder or a
pattern on a file system that every executor can open: a local or mounted one, or by its URI any that Arrow knows (s3, gs, hdfs). Read are baseline TIFFs in strips or tiles, plain or deflated, whole numbers or floats of 8
to 64 bits, with or without horizontal differencing.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, width int, height int, count int, crs string, transform array<double>, bands array<array<double>>"

# fixed: TIFF tags and field types
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_W, _TILE_H, _TILES, _TILE_COUNTS, _FORMAT, _SCALE, _TIE, _MATRIX, _KEYS = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735
_FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
_GEOGRAPHIC, _PROJECTED = 2048, 3072


def _tags(b: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}[b[:2]]
    if struct.unpack(order + "H", b[2:4])[0] != 42:
        raise ValueError("not a baseline TIFF")
    (at,) = struct.unpack(order + "I", b[4:8])
    (n,) = struct.unpack(order + "H", b[at : at + 2])
    out = {}
    for k in range(n):
        e = at + 2 + 12 * k
        tag, kind, count = struct.unpack(order + "HHI", b[e : e + 8])
        if kind not in _FIELDS:
            continue
        code, size = _FIELDS[kind]
        total = size * count
        start = e + 8 if total <= 4 else struct.unpack(order + "I", b[e + 8 : e + 12])[0]
        raw = b[start : start + total]
        out[tag] = (raw,) if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", raw)
    return order, out


def read_geotiff(b: bytes) -> dict:
    """Size, coordinate system, grid and bands of a file's bytes."""
    order, t = _tags(b)
    w, h, n = t[_WIDTH][0], t[_HEIGHT][0], t.get(_SAMPLES, (1,))[0]
    bits, kind = t.get(_BITS, (1,))[0], t.get(_FORMAT, (1,))[0]
    if bits not in (8, 16, 32, 64) or t.get(_COMPRESSION, (1,))[0] not in (1, 8, 32946):
        raise ValueError("this kind of TIFF is not read")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
    apart = t.get(_PLANAR, (1,))[0] == 2
    if _TILES in t:
        bw, bh, where, length = t[_TILE_W][0], t[_TILE_H][0], t[_TILES], t[_TILE_COUNTS]
    else:
        bw, bh, where, length = w, t.get(_ROWS, (h,))[0], t[_STRIPS], t[_COUNTS]
    across, down, per = -(-w // bw), -(-h // bh), 1 if apart else n
    out = np.zeros((n, down * bh, across * bw))
    for k, (band, y, x) in enumerate(product(range(n if apart else 1), range(down), range(across))):
        raw = b[where[k] : where[k] + length[k]]
        if t.get(_COMPRESSION, (1,))[0] != 1:
            raw = zlib.decompress(raw)
        rows = min(bh, h - y * bh) if _TILES not in t else bh
        block = np.frombuffer(raw, dtype)[: rows * bw * per].reshape(rows, bw, per)
        if t.get(_PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        target = slice(band, band + 1) if apart else slice(0, n)
        out[target, y * bh : y * bh + rows, x * bw : (x + 1) * bw] = np.moveaxis(block, 2, 0)
    keys = t.get(_KEYS, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = geo.get(_PROJECTED) or geo.get(_GEOGRAPHIC)
    grid = None
    if _MATRIX in t:
        m = t[_MATRIX]
        grid = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif _SCALE in t and _TIE in t:
        (sx, sy), (i, j, _, x, y, _) = t[_SCALE][:2], t[_TIE][:6]
        grid = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
    return {"width": w, "height": h, "count": n, "crs": f"EPSG:{code}" if code else None, "transform": grid, "bands": out[:, :h, :w]}


def write_geotiff(bands: np.ndarray, transform: list[float] | None = None, epsg: int | None = None, compress: bool = False) -> bytes:
    """A TIFF of (bands, height, width) of any numpy number type, one strip a band."""
    n, h, w = bands.shape
    le = bands.astype(bands.dtype.newbyteorder("<"))
    strips = [zlib.compress(x.tobytes()) if compress else x.tobytes() for x in le]
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    fields: list[tuple[int, int, tuple]] = [
        (_WIDTH, 4, (w,)), (_HEIGHT, 4, (h,)), (_BITS, 3, (bands.dtype.itemsize * 8,) * n), (_COMPRESSION, 3, (8 if compress else 1,)), (262, 3, (1,)),
        (_STRIPS, 4, (0,) * n), (_SAMPLES, 3, (n,)), (_ROWS, 4, (h,)), (_COUNTS, 4, tuple(map(len, strips))), (_PLANAR, 3, (2,)), (_FORMAT, 3, (kind,) * n),
    ]
    if transform is not None:
        a, _, c, _, e, f = transform
        fields += [(_SCALE, 12, (a, -e, 0.0)), (_TIE, 12, (0.0, 0.0, 0.0, c, f, 0.0))]
    if epsg is not None:
        flat = epsg == 4326
        fields.append((_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if flat else 1, _GEOGRAPHIC if flat else _PROJECTED, 0, 1, epsg)))
    fields.sort()
    at = 8 + 2 + 12 * len(fields) + 4
    late, entries = b"", []
    offsets = []
    size = lambda k, v: _FIELDS[k][1] * len(v)
    extra = sum(size(k, v) for _, k, v in fields if size(k, v) > 4)
    for x in strips:
        offsets.append(at + extra + sum(map(len, strips[: len(offsets)])))
    for tag, k, v in fields:
        v = tuple(offsets) if tag == _STRIPS else v
        raw = struct.pack(f"<{len(v)}{_FIELDS[k][0]}", *v)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, k, len(v), at + len(late)))
            late += raw
        else:
            entries.append(struct.pack("<HHI", tag, k, len(v)) + raw.ljust(4, b"\0"))
    return b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(fields)) + b"".join(entries) + struct.pack("<I", 0) + late + b"".join(strips)


def _at(path: str) -> tuple:
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The TIFF files of a file, a folder (with all below) or a pattern in a folder's file names, as they are opened again."""
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    folder, _, name = path.rpartition("/")
    pattern = any(c in name for c in "*?[")
    system, at = _at(folder if pattern else path)
    from pyarrow import fs

    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=not pattern)) if f.type == fs.FileType.File]
        found = [f for f in found if not pattern or fnmatch.fnmatchcase(f.rpartition("/")[2], name)]
    else:
        found = [at] if info.type == fs.FileType.File else []
    return sorted(scheme + f for f in found if f.lower().endswith((".tif", ".tiff")))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        system, at = _at(partition.value)
        with system.open_input_stream(at) as f:
            r = read_geotiff(f.read())
        yield partition.value, r["width"], r["height"], r["count"], r["crs"], r["transform"], [x.ravel().tolist() for x in r["bands"]]


class GeoTiff(DataSource):
    """The source's registration."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rasters of a file, folder or pattern; missing bands are for predict_floods to see."""
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").load(path)
