"""Tiled rasters, cubes by file, overview pyramids, warps between systems."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import hyperspectral
from strataframe.operators import cubes, pyramid, scenes, warp
from strataframe.sources import cubes as files
from strataframe.sources import geotiff


def packed(data: bytes) -> bytes:
    """LZW codes of bytes, first bit first, a bit wider one code early."""
    table, bits, now = {bytes((k,)): k for k in range(256)}, [], b""
    width = lambda n: 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put = lambda code, w: bits.append(format(code, f"0{w}b"))
    put(256, 9)
    size = 258
    for k in range(len(data)):
        more = now + data[k : k + 1]
        if more in table:
            now = more
            continue
        put(table[now], width(size))
        table[more], size, now = size, size + 1, data[k : k + 1]
        if size == 4094:
            put(table[now], 12)
            put(256, 12)
            table, size, now = {bytes((j,)): j for j in range(256)}, 258, b""
    if now:
        put(table[now], width(size))
        size += 1
    put(257, width(size))
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def test_lzw_of_short_long_and_uniform_bytes():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"aaaaaaa" * 900, rng.integers(0, 4, 40000).astype("u1").tobytes(), rng.integers(0, 256, 20000).astype("u1").tobytes()):
        assert geotiff.unpacked(packed(data)) == data


@pytest.mark.parametrize("tile", [0, 32])
@pytest.mark.parametrize("pack", [(8, zlib.compress), (5, packed), (1, bytes)])
@pytest.mark.parametrize("predictor", [False, True])
def test_layouts_of_geotiff(spark, tmp_path, tile, pack, predictor):
    geotiff.register(spark)
    values = np.random.default_rng(0).integers(0, 65000, (70, 45, 3)).astype("u2")
    (tmp_path / "x.tif").write_bytes(geotiff.encode(values, 20.0, 0.0, 0.0, 32643, rows=13, tile=tile, predictor=predictor, pack=pack))
    back = spark.read.format("geotiff").option("bands", "3,1").option("strips", 2).load(str(tmp_path / "x.tif"))
    assert back.columns == ["r", "c", "b3", "b1"]
    got = back.toPandas()
    assert len(got) == 70 * 45
    assert (values[got.r, got.c, 2] == got.b3).all() and (values[got.r, got.c, 0] == got.b1).all()


def test_window_reads_its_tiles_alone(spark, tmp_path):
    geotiff.register(spark)
    values = np.arange(64 * 96).reshape(64, 96, 1).astype("i4")
    data = geotiff.encode(values, 20.0, 0.0, 0.0, 32643, tile=32)
    path = tmp_path / "x.tif"
    path.write_bytes(data)
    tags = geotiff.read_header(str(path))
    spoiled = bytearray(data)
    for k, (at, n) in enumerate(zip(tags[324], tags[325], strict=True)):
        if k != 4:  # second row of tiles, second column
            spoiled[at : at + n] = b"\xff" * n
    path.write_bytes(bytes(spoiled))
    whole = spark.read.format("geotiff").load(str(path))
    inside = whole.filter("r >= 40 and r < 50 and c > 33 and c <= 60")
    got = {(x.r, x.c): x.b1 for x in inside.collect()}
    assert got == {(r, c): float(r * 96 + c) for r in range(40, 50) for c in range(34, 61)}
    assert whole.filter("r = 63 and c = 32").first().b1 == 63 * 96 + 32 and whole.filter("r > 64").count() == 0


WAVES = [700.0 + 10 * k for k in range(175)]


def shape_of(mineral: str) -> np.ndarray:
    """A flat spectrum with the main absorption of a mineral, and those that its checks ask for."""
    out = np.full(len(WAVES), 0.5)
    dips = [hyperspectral.MAIN[mineral]] if mineral in hyperspectral.MAIN else []
    dips += [f for m, f, sense, _ in hyperspectral.CHECKS if m == mineral and sense == ">="]
    for _, centre, _ in dips:
        out *= 1 - 0.4 * np.exp(-(((np.array(WAVES) - centre) / 18) ** 2))
    return out


def write(folder, values, order, nodata=0.0, byte_order=0, skip=0):
    lines, samples, bands = values.shape
    axes = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[order]
    h = files.Header(samples, lines, bands, order, "<>"[byte_order] + values.dtype.str[1:], skip, tuple(WAVES[:bands]), nodata, 0)
    folder.mkdir()
    (folder / "a.hdr").write_text(h.text())
    (folder / "a.img").write_bytes(b"x" * skip + values.transpose(axes).astype(h.dtype).tobytes())
    return h


def test_three_orders_give_the_same_rows_and_maps(spark, tmp_path):
    kinds = ["kaolinite"] * 4 + ["calcite"] * 3 + ["flat"] * 2
    cube = np.stack([np.stack([shape_of(k)] * 5) for k in kinds])
    cube = (cube * 10000).round().astype("u2")
    cube[0, 0] = 0  # no data
    cube[8, 4, 150] = 0
    maps = []
    for k, order in enumerate(("bsq", "bil", "bip")):
        write(tmp_path / order, cube, order, byte_order=k % 2, skip=7 * k)
        got = cubes.mineral_map(spark, str(tmp_path / order / "a.img")).orderBy("r", "c")
        maps.append([tuple(x) for x in got.collect()])
    assert maps[0] == maps[1] == maps[2] and len(maps[0]) == 45
    names = list(hyperspectral.MAIN)
    code = {(x[0], x[1]): x[2] for x in maps[0]}
    assert code[0, 0] == 0 and code[0, 1] == names.index("kaolinite") + 2 and code[5, 2] == names.index("calcite") + 2 and code[8, 0] == 1
    areas = {x.mineral: x for x in cubes.mineral_areas(cubes.mineral_map(spark, str(tmp_path / "bil"))).collect()}
    assert areas["kaolinite"].pixels == 19 and areas["calcite"].pixels == 15 and areas["alunite"].pixels == 0
    assert abs(areas["calcite"].km2 - 15 * 0.0009) < 1e-12
    whole = {(r, c): cubes.hyperspectral.needed_bands(WAVES) and cube[r, c] * 1e-4 for r in range(9) for c in range(5)}
    rows = spark.createDataFrame([(r, c, [float(v) for v in s]) for (r, c), s in whole.items()], "r long, c long, s array<double>")
    full = {(x.r, x.c): x.kaolinite for x in hyperspectral.with_depths(rows, "s", WAVES).collect()}
    at = 3 + [m for m in names if m in cubes.mineral_map(spark, str(tmp_path / "bil")).columns].index("kaolinite")
    assert all(abs(x[at] - full[x[0], x[1]]) < 1e-9 for x in maps[0] if x[2])


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        self.taken += n
        return super().read(n)


def test_only_wanted_bands_and_lines_are_read(tmp_path):
    cube = np.random.default_rng(0).integers(0, 999, (20, 6, 30)).astype("i2")
    for order, bytes_ in (("bsq", 5 * 6 * 3 * 2), ("bil", 5 * 6 * 3 * 2), ("bip", 5 * 6 * 30 * 2)):
        h = write(tmp_path / order, cube, order, skip=11)
        f = Counted((tmp_path / order / "a.img").read_bytes())
        got = files.read_lines(f, h, [3, 4, 17], 10, 15)
        assert (got == cube[10:15][:, :, [3, 4, 17]]).all() and f.taken == bytes_


def test_filters_on_lines_reach_cubes(spark, tmp_path):
    files.register(spark)
    cube = np.arange(20 * 3 * 2).reshape(20, 3, 2).astype("f4") + 1
    write(tmp_path / "x", cube, "bil")
    with open(tmp_path / "x" / "a.img", "r+b") as f:
        f.truncate(12 * 3 * 2 * 4)  # the rest of the file is gone
    read = spark.read.format("cube").option("bands", "1").option("lines", 4).load(str(tmp_path / "x"))
    got = {(x.r, x.c): x.spectrum for x in read.filter("r between 5 and 9").collect()}
    assert got == {(r, c): [float(cube[r, c, 1])] for r in range(5, 10) for c in range(3)}
    assert read.filter("r < 0").count() == 0


def test_folder_of_cubes_holds_missing_pixels(spark, tmp_path):
    waves = WAVES[:12]
    df = spark.createDataFrame([(r, c, [float(r + k) + 1 if k != 3 else None for k in range(12)] if c != 1 else None) for r in range(10) for c in range(3)], "r long, c long, s array<double>")
    made = files.write_cubes(df, f"file://{tmp_path}/out", "s", waves, 4, lines=4, order="bip", nodata=-5.0).collect()
    assert sorted(x.pixels for x in made) == [6, 12, 12]
    files.register(spark)
    got = {(x.r, x.c): x.spectrum for x in spark.read.format("cube").option("bands", "0,3,11").load(f"file://{tmp_path}/out").collect()}
    assert len(got) == 40 and got[9, 2] == [10.0, None, 21.0] and got[5, 1] == [None] * 3 and got[4, 3] == [None] * 3
    assert list(files.read_header(f"{tmp_path}/out").wavelengths) == waves
    with pytest.raises(FileNotFoundError):
        files.read_header(f"{tmp_path}/none")


def test_headers_with_micrometres_and_faults():
    text = "ENVI\ndescription = {\n a, b}\nsamples = 2\nlines = 3\nbands = 2\ndata type = 4\nwavelength = { 0.7,\n 2.2 }\n"
    assert files.Header.parse(text).wavelengths == (700.0, 2200.0) and files.Header.parse(text).order == "bsq"
    for broken in (text.replace("data type = 4", "data type = 6"), text.replace("bands = 2", "bands = 3"), text + "interleave = odd\n"):
        with pytest.raises(ValueError):
            files.Header.parse(broken)


def raster(spark, rows, cols, missing=0):
    rng = np.random.default_rng(rows)
    cells = [(r, c, None if rng.random() < missing else float(rng.integers(0, 1000)), int(rng.integers(0, 5))) for r in range(rows) for c in range(cols) if rng.random() >= missing]
    return spark.createDataFrame(cells, "r long, c long, v double, k int")


def test_pyramid_is_single_steps_from_one_shuffle(spark, tmp_path):
    raster(spark, 64, 32).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    made = pyramid.pyramid(df, 4, ["v"], ["k"])
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 3 and plan.count("hashpartitioning(") - plan.count("ReusedExchange") == 1
    step = df
    for level in range(1, 5):
        step = scenes.overview(step, 2, ["v"], ["k"])
        want = {(x.r, x.c): (round(x.v, 9), x.k) for x in step.collect()}
        assert {(x.r, x.c): (round(x.v, 9), x.k) for x in made.filter(F.col("level") == level).collect()} == want


def test_pyramid_of_gaps_ties_and_nothing(spark):
    df = raster(spark, 21, 13, 0.3)
    for level in (1, 2, 3):
        want = {(x.r, x.c): (x.v and round(x.v, 9), x.k) for x in scenes.overview(df, 2**level, ["v"], ["k"]).collect()}
        got = pyramid.pyramid(df, 3, ["v"], ["k"]).filter(F.col("level") == level).collect()
        assert {(x.r, x.c): (x.v and round(x.v, 9), x.k) for x in got} == want
    assert pyramid.pyramid(df.filter("r < 0"), 2, ["v"], []).count() == 0
    assert pyramid.factors(5000, 300) == [2, 4, 8, 16] and pyramid.factors(400, 300) == []
    with pytest.raises(ValueError):
        pyramid.pyramid(df, 0, ["v"], [])


WEST, EAST = warp.Grid(32642, 765000.0, 4010000.0, 25.0, 150, 130), warp.Grid(32643, 228000.0, 4011000.0, 20.0, 260, 240)


def there(target, source, r, c):
    x, y = warp.carried(target.left + (c + 0.5) * target.pixel, target.top - (r + 0.5) * target.pixel, target.epsg, source.epsg)
    return (source.top - y) / source.pixel, (x - source.left) / source.pixel


@pytest.mark.parametrize("tolerance", [0.05, 1e-9])
def test_places_between_exact_points(spark, tolerance):
    got = warp.located(spark, WEST, EAST, tolerance=tolerance).toPandas()
    assert len(got) == 150 * 130 and not got.duplicated(["r", "c"]).any()
    row, col = there(WEST, EAST, got.r.to_numpy(), got.c.to_numpy())
    worst = max(np.abs(row - got.row).max(), np.abs(col - got.col).max())
    assert worst <= max(tolerance, 1e-6)


def test_coordinates_agree_with_columns_and_come_back(spark):
    from strataframe.functions import geo

    lon, lat = np.array([75.3, 73.2, 77.9]), np.array([35.9, 0.2, -41.0])
    for south in (False, True):
        x, y = geo.metres_of(lon, lat, 43, south)
        back = geo.degrees_of(x, y, 43, south)
        assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9
    east, north = geo.to_utm(F.lit(75.3), F.lit(35.9), F.lit(43))
    one = spark.range(1).select(east, north).first()
    assert np.allclose(tuple(one), [v[0] for v in geo.metres_of(lon, lat, 43)], atol=1e-6)
    with pytest.raises(ValueError):
        warp.carried(lon, lat, 4326, 3857)


def test_bilinear_and_nearest_values_of_another_zone(spark):
    plane = spark.range(EAST.width * EAST.height).select(F.floor(F.col("id") / EAST.width).alias("r"), (F.col("id") % EAST.width).alias("c")).withColumn("v", F.col("r") * 3.0 + F.col("c") * 2.0)
    got = warp.warped(plane, "v", EAST, WEST).toPandas()
    row, col = there(WEST, EAST, got.r.to_numpy(), got.c.to_numpy())
    within = (row > 0.5) & (row < EAST.height - 0.5) & (col > 0.5) & (col < EAST.width - 0.5)
    assert within.sum() > 1000 and np.abs((row - 0.5) * 3 + (col - 0.5) * 2 - got.v)[within].max() < 0.5
    outside = (row < -1) | (row > EAST.height + 1) | (col < -1) | (col > EAST.width + 1)
    assert len(got) == 150 * 130 and got.v[outside].isna().all()
    near = warp.warped(plane, "v", EAST, WEST, "nearest").toPandas()
    row, col = there(WEST, EAST, near.r.to_numpy(), near.c.to_numpy())
    safe = (np.abs(row % 1 - 0.5) < 0.4) & (np.abs(col % 1 - 0.5) < 0.4) & (row > 0) & (row < EAST.height) & (col > 0) & (col < EAST.width)
    assert (np.floor(row) * 3 + np.floor(col) * 2 == near.v)[safe].all()


def test_averages_keep_sums_and_leave_missing_out(spark):
    coarse = warp.Grid(4326, 71.0, 37.0, 0.01, 400, 400)
    df = raster(spark, 60, 50, 0.1).withColumn("v", F.when(F.col("c") == 7, float("nan")).otherwise(F.col("v")))
    made = warp.averaged(df, "v", EAST, coarse)
    kept = df.filter("v is not null and not isnan(v)").agg(F.sum("v"), F.count("v")).first()
    got = made.agg(F.sum(F.col("v") * F.col("n")), F.sum("n")).first()
    assert abs(got[0] - kept[0]) < 1e-6 and got[1] == kept[1] and made.count() > 3
    whole = warp.warped(df, "v", EAST, warp.Grid(4326, 71.97, 36.21, 0.01, 5, 5), "average")
    assert whole.count() == 25 and warp.averaged(df.filter("r < 0"), "v", EAST, coarse).count() == 0
