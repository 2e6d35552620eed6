"""A Python data source for raw hyperspectral cubes with a text header.

``spark.read.format("cube").load(path)`` gives (r, c, spectrum) of one cube, or of all cubes of a
folder, whose headers may name the line that each begins with.  Only wanted bands are in the
spectrum, and only their bytes are read where the order of the file lets them be told apart: by band
and by line.  Lines that filters on ``r`` leave out aren't read either.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from ..functions import hyperspectral
from .files import PUSHDOWN, Window, opened

# The header's codes of value types.
_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
#: Pixels of a batch.
BATCH = 1 << 15


@dataclass(frozen=True)
class Header:
    samples: int
    lines: int
    bands: int
    order: str
    dtype: str
    skip: int
    wavelengths: tuple[float, ...]
    nodata: float | None
    first_line: int

    @classmethod
    def parse(cls, text: str) -> "Header":
        fields = {k.strip().lower(): v.strip() for k, v in re.findall(r"(?m)^([^=\n{}]+)=\s*(\{[^}]*\}|[^\n]*)", text)}
        order = fields.get("interleave", "bsq").lower()
        code = int(fields["data type"])
        if order not in ("bsq", "bil", "bip") or code not in _TYPES:
            raise ValueError(f"no cube of interleave {order!r} and data type {code}")
        waves = [float(x) for x in re.findall(_NUMBER, fields.get("wavelength", ""))]
        waves = [w * 1000 for w in waves] if waves and max(waves) < 30 else waves
        bands = int(fields["bands"])
        if waves and len(waves) != bands:
            raise ValueError(f"{bands} bands but {len(waves)} wavelengths")
        nodata = fields.get("data ignore value")
        return cls(
            int(fields["samples"]), int(fields["lines"]), bands, order, (">" if fields.get("byte order") == "1" else "<") + _TYPES[code],
            int(fields.get("header offset", 0)), tuple(waves), None if nodata is None else float(nodata), int(float(fields.get("y start", 1))) - 1,
        )

    def text(self) -> str:
        code = next(k for k, v in _TYPES.items() if v == self.dtype[1:])
        rows = {"samples": self.samples, "lines": self.lines, "bands": self.bands, "header offset": self.skip, "data type": code, "interleave": self.order, "byte order": int(self.dtype[0] == ">"), "y start": self.first_line + 1}
        rows |= {} if self.nodata is None else {"data ignore value": f"{self.nodata:g}"}
        rows |= {"wavelength": "{" + ", ".join(map(repr, self.wavelengths)) + "}"} if self.wavelengths else {}
        return "ENVI\n" + "".join(f"{k} = {v}\n" for k, v in rows.items())


def _headers(path: str) -> list[str]:
    """Headers by name: of one cube, or all of a folder."""
    system, place = opened(path)
    if system.get_file_info(place).type == fs.FileType.Directory:
        return sorted(i.path for i in system.get_file_info(fs.FileSelector(place)) if i.path.endswith(".hdr"))
    stem = place.removesuffix(".hdr")
    sides = [f"{stem}.hdr", f"{stem.rpartition('.')[0] or stem}.hdr"]
    found = [s for s in sides if system.get_file_info(s).type == fs.FileType.File]
    return found[:1]


def _header(system: fs.FileSystem, place: str) -> Header:
    with system.open_input_file(place) as f:
        return Header.parse(f.read().decode("utf-8", "ignore"))


def read_header(path: str) -> Header:
    """The header of a cube, or the first one of a folder."""
    if not (found := _headers(path)):
        raise FileNotFoundError(f"no header (.hdr) at {path}")
    return _header(opened(path)[0], found[0])


def _data_of(system: fs.FileSystem, header: str) -> str:
    stem = header.removesuffix(".hdr")
    for end in ("", ".bin", ".img", ".dat", ".raw", ".bil", ".bsq", ".bip"):
        if system.get_file_info(stem + end).type == fs.FileType.File:
            return stem + end
    raise FileNotFoundError(f"no values beside {header}")


def read_lines(f, header: Header, bands: list[int], first: int, last: int) -> np.ndarray:
    """(lines, samples, bands) from an open file: lines first to last, the latter not included."""
    h, dtype, n = header, np.dtype(header.dtype), last - first

    def values(at: int, count: int) -> np.ndarray:
        f.seek(h.skip + at * dtype.itemsize)
        return np.frombuffer(f.read(count * dtype.itemsize), dtype)

    if h.order == "bip":
        return values(first * h.samples * h.bands, n * h.samples * h.bands).reshape(n, h.samples, h.bands)[:, :, bands]
    out = np.empty((n, h.samples, len(bands)), dtype)
    if h.order == "bsq":
        for k, b in enumerate(bands):
            out[:, :, k] = values((b * h.lines + first) * h.samples, n * h.samples).reshape(n, h.samples)
        return out
    runs = np.split(np.arange(len(bands)), np.flatnonzero(np.diff(bands) != 1) + 1)
    for line in range(n):
        for run in runs:  # neighbouring bands of a line lie side by side
            got = values(((first + line) * h.bands + bands[run[0]]) * h.samples, len(run) * h.samples)
            out[line][:, run] = got.reshape(len(run), h.samples).T
    return out


class _Lines(InputPartition):
    def __init__(self, header: str, first: int, last: int | None):
        self.header, self.first, self.last = header, first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, bands: list[int], lines: int):
        self.path, self.bands, self.lines = path, bands, lines
        self.window = Window()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.window.narrow(filters)
        return filters  # Spark checks each row again

    def partitions(self) -> list[InputPartition]:
        found = _headers(self.path)
        if len(found) != 1:
            return [_Lines(h, 0, None) for h in found]
        h = read_header(self.path)
        starts = [k for k in range(0, h.lines, self.lines) if self.window.meets("r", h.first_line + k, h.first_line + min(h.lines, k + self.lines) - 1)]
        return [_Lines(found[0], k, min(h.lines, k + self.lines)) for k in starts] or [_Lines(found[0], 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        h = _header(system, partition.header)
        first = max(partition.first, self.window.low["r"] - h.first_line)
        last = min(h.lines if partition.last is None else partition.last, self.window.high["r"] - h.first_line + 1)
        step = max(1, BATCH // h.samples)
        if first >= last:
            return
        with system.open_input_file(_data_of(system, partition.header)) as f:
            for at in range(first, last, step):
                end = min(last, at + step)
                raw = read_lines(f, h, self.bands, at, end).astype(np.float64)
                missing = ~np.isfinite(raw) | ((raw == h.nodata) if h.nodata is not None else False)
                pixels = (end - at) * h.samples
                r, c = np.divmod(np.arange(pixels), h.samples)
                offsets = pa.array(np.arange(pixels + 1, dtype=np.int32) * len(self.bands))
                spectrum = pa.ListArray.from_arrays(offsets, pa.array(raw.ravel(), mask=missing.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(r + at + h.first_line), pa.array(c), spectrum], ["r", "c", "spectrum"])


class Cube(DataSource):
    """Options: ``path``; ``bands``, numbers from 0 by commas (those that minerals need, else all); ``lines`` of a task (256)."""

    @classmethod
    def name(cls) -> str:
        return "cube"

    def schema(self) -> str:
        return "r long, c long, spectrum array<double>"

    def reader(self, schema) -> DataSourceReader:
        header = read_header(self.options["path"])
        given = self.options.get("bands")
        bands = [int(b) for b in given.split(",")] if given else hyperspectral.needed_bands(list(header.wavelengths)) if header.wavelengths else []
        bands = bands or list(range(header.bands))
        if min(bands) < 0 or max(bands) >= header.bands:
            raise ValueError(f"bands must lie within 0 and {header.bands - 1}")
        return _Reader(self.options["path"], bands, int(self.options.get("lines", 256)))


def register(spark: SparkSession) -> None:
    """Makes the format known and lets filters through to it."""
    spark.dataSource.register(Cube)
    spark.conf.set(PUSHDOWN, "true")


def write_cubes(df: DataFrame, folder: str, spectrum: str, wavelengths: list[float], width: int, lines: int = 256, order: str = "bil", dtype: str = "f4", nodata: float = 0.0) -> DataFrame:
    """Writes one cube for each block of ``lines`` lines, and gives (path, pixels) of the files when it is run.

    A task holds one block.  Pixels that aren't there, null spectra and null values become ``nodata``.
    """
    axes = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[order]
    waves = tuple(float(w) for w in wavelengths)

    def write(key, frame):
        import pandas as pd

        block = int(key[0])
        there = frame[frame["s"].notna()]
        values = np.full((int(frame.r.max()) - block * lines + 1, width, len(waves)), nodata, dtype)
        if len(there):
            rows = np.stack([np.array([nodata if x is None else x for x in s], np.float64) for s in there.s])
            values[there.r.to_numpy() - block * lines, there.c.to_numpy()] = np.where(np.isnan(rows), nodata, rows)
        header = Header(width, len(values), len(waves), order, "<" + dtype, 0, waves, nodata, block * lines)
        system, place = opened(f"{folder}/{block:06d}")
        system.create_dir(place.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{place}.bin") as f:
            f.write(np.ascontiguousarray(values.transpose(axes)).tobytes())
        with system.open_output_stream(f"{place}.hdr") as f:
            f.write(header.text().encode())
        return pd.DataFrame({"path": [f"{folder}/{block:06d}.hdr"], "pixels": [len(frame)]})

    placed = df.select("r", "c", F.col(spectrum).alias("s"), F.floor(F.col("r") / lines).alias("_block"))
    return placed.groupBy("_block").applyInPandas(write, "path string, pixels long")
