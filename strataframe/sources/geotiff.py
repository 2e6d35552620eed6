"""A Python data source for GeoTIFF files: strips or tiles, one value type, deflate, LZW or neither.

``spark.read.format("geotiff").load(path)`` gives (r, c, b1, b2, ...) and one
partition for each group of strips or tiles; nodata is null.  Strips and tiles
that filters on ``r`` and ``c`` leave out aren't read; ``bands`` names the bands
wanted.  ``write_geotiff`` writes one file per tile of a raster.  Offsets, scales
and colour maps are left to columns.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .files import PUSHDOWN, Window, opened

# TIFF tags and field types.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTO, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR, _FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339
_TILE_WIDTH, _TILE_ROWS, _TILE_OFFSETS, _TILE_COUNTS = 322, 323, 324, 325
_SCALE, _TIEPOINT, _GEOKEYS, _NODATA = 33550, 33922, 34735, 42113
_KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}
_DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_CODES = {v: k for k, v in _DTYPES.items()}


def read_header(path: str) -> dict:
    """Tags of the first image: numbers, tuples of numbers, or text."""
    system, place = opened(path)
    with system.open_input_file(place) as f:
        data = f.read(1 << 20)
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        at = struct.unpack_from(order + "I", data, 4)[0]
        if at + 2 > len(data):  # the directory lies behind the image
            f.seek(0)
            data = f.read()
    tags: dict = {"order": order}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in _KINDS:
            continue
        letter, size = _KINDS[kind]
        where = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        values = struct.unpack_from(f"{order}{count}{letter}", data, where)
        tags[tag] = values[0].rstrip(b"\0").decode() if kind == 2 else values if count > 1 else values[0]
    return tags


def unpacked(data: bytes) -> bytes:
    """Bytes behind LZW codes: first bit first, one bit wider one code early, cleared by 256, ended by 257."""
    known = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, last, width, held, bits = known[:], [], b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = known[:], b"", 9
            continue
        now = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + now[:1])
        out.append(now)
        last = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


_UNPACK = {1: bytes, 5: unpacked, 8: zlib.decompress, 32946: zlib.decompress}


class _Blocks(InputPartition):
    def __init__(self, numbers: list[int]):
        self.numbers = numbers


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int, wanted: list[int]):
        self.path, self.per_task, self.wanted = path, per_task, wanted
        self.tags = tags = read_header(path)
        self.window = Window()
        if tags.get(_COMPRESSION, 1) not in _UNPACK or tags.get(_PREDICTOR, 1) not in (1, 2) or tags.get(_PLANAR, 1) != 1:
            raise ValueError(f"compression {tags.get(_COMPRESSION, 1)}, predictor {tags.get(_PREDICTOR, 1)} or planes apart can't be read")
        self.tiled = _TILE_OFFSETS in tags
        self.wide, self.tall = (tags[_TILE_WIDTH], tags[_TILE_ROWS]) if self.tiled else (tags[_WIDTH], min(tags.get(_ROWS, tags[_HEIGHT]), tags[_HEIGHT]))
        self.across = -(-tags[_WIDTH] // self.wide)

    def _tuple(self, tag: int, default=()) -> tuple:
        value = self.tags.get(tag, default)
        return value if isinstance(value, tuple) else (value,)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.window.narrow(filters)
        return filters  # Spark checks each pixel again

    def partitions(self) -> list[InputPartition]:
        n = len(self._tuple(_TILE_OFFSETS if self.tiled else _OFFSETS))
        inside = lambda k: self.window.meets("r", k // self.across * self.tall, (k // self.across + 1) * self.tall - 1) and self.window.meets("c", k % self.across * self.wide, (k % self.across + 1) * self.wide - 1)
        numbers = [k for k in range(n) if inside(k)]
        return [_Blocks(numbers[k : k + self.per_task]) for k in range(0, len(numbers), self.per_task)] or [_Blocks([])]

    def block(self, f, k: int) -> tuple[int, int, np.ndarray]:
        """First row and column of a strip or tile, and its pixels (rows, columns, bands) that lie on the image."""
        tags, bands = self.tags, self.tags.get(_SAMPLES, 1)
        dtype = np.dtype(tags["order"] + _DTYPES[self._tuple(_FORMAT, (1,))[0], self._tuple(_BITS)[0]])
        top, left = k // self.across * self.tall, k % self.across * self.wide
        f.seek(self._tuple(_TILE_OFFSETS if self.tiled else _OFFSETS)[k])
        raw = _UNPACK[tags.get(_COMPRESSION, 1)](f.read(self._tuple(_TILE_COUNTS if self.tiled else _COUNTS)[k]))
        rows = self.tall if self.tiled else min(self.tall, tags[_HEIGHT] - top)
        values = np.frombuffer(raw, dtype)[: rows * self.wide * bands].reshape(rows, self.wide, bands)
        if tags.get(_PREDICTOR, 1) == 2:
            values = np.cumsum(values, axis=1, dtype=dtype.newbyteorder("="))
        return top, left, values[: tags[_HEIGHT] - top, : tags[_WIDTH] - left]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        nodata = float(self.tags[_NODATA]) if _NODATA in self.tags else None
        system, place = opened(self.path)
        with system.open_input_file(place) as f:
            for k in partition.numbers:
                top, left, block = self.block(f, k)
                values = block[:, :, [b - 1 for b in self.wanted]].astype(np.float64)
                missing = np.isnan(values) | ((values == nodata) if nodata is not None else False)
                r, c = np.divmod(np.arange(values.shape[0] * values.shape[1]), values.shape[1])
                columns = [pa.array(r + top), pa.array(c + left)] + [pa.array(values[:, :, i].ravel(), mask=missing[:, :, i].ravel()) for i in range(len(self.wanted))]
                yield pa.RecordBatch.from_arrays(columns, ["r", "c", *(f"b{b}" for b in self.wanted)])


class GeoTiff(DataSource):
    """Options: ``path``; ``bands``, numbers from 1 by commas (all); ``strips``, strips or tiles of a task (64)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def wanted(self) -> list[int]:
        bands, given = read_header(self.options["path"]).get(_SAMPLES, 1), self.options.get("bands")
        wanted = [int(b) for b in given.split(",")] if given else list(range(1, bands + 1))
        if not all(1 <= b <= bands for b in wanted):
            raise ValueError(f"bands must lie within 1 and {bands}")
        return wanted

    def schema(self) -> StructType:
        return StructType([StructField("r", LongType()), StructField("c", LongType()), *(StructField(f"b{b}", DoubleType()) for b in self.wanted())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("strips", 64)), self.wanted())


def register(spark: SparkSession) -> None:
    """Makes the format known and lets filters through to it."""
    spark.dataSource.register(GeoTiff)
    spark.conf.set(PUSHDOWN, "true")


def encode(values: np.ndarray, pixel: float, left: float, top: float, epsg: int, nodata: float | None = None, rows: int = 64, tile: int = 0, predictor: bool = False, pack: tuple = (8, zlib.compress)) -> bytes:
    """Bytes of a GeoTIFF of (rows, columns, bands): strips of ``rows``, or tiles of ``tile`` pixels (a multiple of 16).

    ``predictor`` keeps differences along lines, for whole numbers; ``pack`` is a code of compression and what does it.
    """
    height, width, bands = values.shape
    form, bits = _CODES[values.dtype.str[1:]]
    if predictor and values.dtype.kind == "f" or tile % 16:
        raise ValueError("differences need whole numbers, tiles a multiple of 16 pixels")
    padded = np.pad(values, ((0, -height % tile), (0, -width % tile), (0, 0)), mode="edge") if tile else values
    tall, wide = (tile, tile) if tile else (rows, width)
    blocks = [padded[y : y + tall, x : x + wide] for y in range(0, len(padded), tall) for x in range(0, padded.shape[1], wide)]
    if predictor:
        blocks = [np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])) for b in blocks]
    strips = [pack[1](np.ascontiguousarray(b).astype(values.dtype.newbyteorder("<")).tobytes()) for b in blocks]
    where, sizes = (_TILE_OFFSETS, _TILE_COUNTS) if tile else (_OFFSETS, _COUNTS)
    tags: list[tuple[int, int, tuple]] = [
        (_WIDTH, 4, (width,)), (_HEIGHT, 4, (height,)), (_BITS, 3, (bits,) * bands), (_COMPRESSION, 3, (pack[0],)), (_PHOTO, 3, (1,)), (where, 4, tuple(range(len(strips)))),
        (_SAMPLES, 3, (bands,)), (sizes, 4, tuple(map(len, strips))), (_PLANAR, 3, (1,)), (_FORMAT, 3, (form,) * bands),
        (_SCALE, 12, (pixel, pixel, 0.0)), (_TIEPOINT, 12, (0.0, 0.0, 0.0, left, top, 0.0)), (_GEOKEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)),
    ]
    tags += [(_TILE_WIDTH, 3, (tile,)), (_TILE_ROWS, 3, (tile,))] if tile else [(_ROWS, 4, (rows,))]
    tags += [(_PREDICTOR, 3, (2,))] if predictor else []
    if nodata is not None:
        text = f"{nodata:g}\0".encode()
        tags.append((_NODATA, 2, (text,)))
    tags.sort()
    lengths = {tag: len(v[0]) if kind == 2 else struct.calcsize(_KINDS[kind][0]) * len(v) for tag, kind, v in tags}
    body = 8 + 2 + 12 * len(tags) + 4
    places, at = {}, body
    for tag, _, _ in tags:
        if lengths[tag] > 4:
            places[tag], at = at, at + lengths[tag] + lengths[tag] % 2
    starts = []
    for strip in strips:
        starts.append(at)
        at += len(strip)
    out, extra = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag, kind, values_ in tags:
        values_ = tuple(starts) if tag == where else values_
        data = values_[0] if kind == 2 else struct.pack(f"<{len(values_)}{_KINDS[kind][0]}", *values_)
        out += struct.pack("<HHI", tag, kind, len(data) if kind == 2 else len(values_))
        if tag in places:
            out += struct.pack("<I", places[tag])
            extra += data + b"\0" * (len(data) % 2)
        else:
            out += data.ljust(4, b"\0")
    return out + b"\0" * 4 + extra + b"".join(strips)


def write_geotiff(df: DataFrame, folder: str, bands: list[str], size: int = 1024, dtype: str = "f4", pixel: float = 20.0, left: float = 0.0, top: float = 0.0, epsg: int = 32643, nodata: float = -9999.0) -> list[str]:
    """Writes one file per square tile of ``size`` pixels and returns their paths; missing pixels are nodata.

    A tile is what one task holds in memory, however large the raster.
    """

    def write(key: tuple, frame) -> "pa.Table":
        import pandas as pd

        tx, ty = key
        values = np.full((int(frame.r.max()) - ty * size + 1, int(frame.c.max()) - tx * size + 1, len(bands)), nodata, dtype)
        for b, name in enumerate(bands):
            values[frame.r.to_numpy() - ty * size, frame.c.to_numpy() - tx * size, b] = frame[name].fillna(nodata).to_numpy()
        path = f"{folder}/{tx:03d}_{ty:03d}.tif"
        system, place = opened(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        with system.open_output_stream(place) as f:
            f.write(encode(values, pixel, left + tx * size * pixel, top - ty * size * pixel, epsg, nodata))
        return pd.DataFrame({"path": [path]})

    placed = df.select("r", "c", *bands, F.floor(F.col("c") / size).alias("tx"), F.floor(F.col("r") / size).alias("ty"))
    return sorted(r.path for r in placed.groupBy("tx", "ty").applyInPandas(write, "path string").collect())
