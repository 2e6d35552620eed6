"""A region as a folder of tables, and the steps that fill it.

Each step reads the tables before it and writes its own, tile by tile; one that
is there already is left alone unless ``force`` is set, so that a run that broke
off goes on where it stopped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import classes, geo, scalars, spectral
from ..functions.classes import BANDS, GEM_WEIGHTS, MINERAL_WEIGHTS
from ..operators import learning, lineaments, neighbourhood, polygons, prospect, prospecting, scenes, spatial, statistics, targets
from ..operators.halos import raster_size
from ..sinks import tiles, vectors


@dataclass
class Region:
    """Where a region lies and its tables are; map coordinates are UTM metres."""

    spark: SparkSession
    folder: str
    left: float
    top: float
    zone: int
    width: int
    pixel: float = 20.0
    tile: int = 1024

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").drop("tile_key")

    def has(self, name: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.folder}/{name}")
            return True
        except AnalysisException:
            return False

    def _step(self, name: str, make, force: bool) -> DataFrame:
        if force or not self.has(name):
            tiles.write_tiles(make(), f"{self.folder}/{name}", self.tile)
        return self.table(name)

    def acquire(self, observations: DataFrame, dem: DataFrame, force: bool = False) -> DataFrame:
        """Temporal composite of scene observations (r, c, bands, scl) on elevation (r, c, dem)."""

        def make() -> DataFrame:
            made = scenes.composite(observations, ["r", "c"], list(BANDS))
            scaled = made.select("r", "c", F.col("code").alias("scl"), *[F.when(F.col(b) > 0, F.col(b) / 10000.0).alias(b) for b in BANDS])
            return scaled.join(dem, ["r", "c"], "left")

        return self._step("composite", make, force)

    def surface(self) -> DataFrame:
        """The composite with ``lc`` and ``usable``."""
        df = self.table("composite").withColumn("lc", spectral.landcover(F.col("scl")))
        return df.withColumn("usable", spectral.valid(spectral.scl_masked(F.col("scl"))) & (F.col("lc") == 0))

    def classify(self, model: PipelineModel, smooth: int = 3, force: bool = False) -> DataFrame:
        """Rock class by a fitted model where rock is seen, mask codes elsewhere, smoothed."""

        def make() -> DataFrame:
            df = self.surface()
            rock = model.transform(df.filter("usable")).select("r", "c", (F.col("prediction") + 1).cast("int").alias("rock"))
            label = F.when(F.col("lc") != 0, F.col("lc")).otherwise(F.coalesce("rock", F.lit(255)))
            labelled = df.join(rock, ["r", "c"], "left").select("r", "c", label.alias("raw"))
            return neighbourhood.majority(labelled, "raw", smooth, "label").select("r", "c", F.col("label").cast("int").alias("label"))

        return self._step("classes", make, force)

    def analyze(self, force: bool = False) -> DataFrame:
        """Alteration score and dominant index of each pixel."""
        return self._step("alteration", lambda: prospect.alteration_score(self.surface(), F.col("usable")).select("r", "c", "score", "dominant"), force)

    def alteration_targets(self, threshold: float = 75.0, least: int = 25) -> DataFrame:
        found = targets.component_statistics(targets.connected(self.table("alteration").filter(F.col("score") >= threshold), self.width), "score", "dominant", least)
        x, y = F.col("x") * self.pixel + self.left, F.lit(self.top) - F.col("y") * self.pixel
        lon, lat = geo.from_utm(x, y, F.lit(self.zone))
        return found.withColumns({"x": x, "y": y}).withColumns({"lon": lon, "lat": lat})

    def gems(self, lithology: DataFrame | None = None, force: bool = False) -> DataFrame:
        """Scores of the four gem models on bedrock, sharpened by a rock map (r, c, label) if there is one."""

        def make() -> DataFrame:
            df = neighbourhood.with_slope_and_aspect(self.surface(), pixel=self.pixel).withColumn("_rock", F.col("usable") & prospect.bedrock()).drop("usable")
            df = df.withColumnRenamed("_rock", "usable")
            df = df.withColumn("lithology", F.lit(0)) if lithology is None else df.join(lithology.select("r", "c", F.col("label").alias("lithology")), ["r", "c"], "left").fillna(0, ["lithology"])
            evidence = prospect.with_lithology(prospect.gem_evidence(df, F.col("usable")), F.col("usable"), "lithology", pixel=self.pixel)
            return prospect.gem_scores(evidence).select("r", "c", *GEM_WEIGHTS)

        return self._step("gems", make, force)

    def lineaments(self, length_m: float = 600.0, force: bool = False) -> DataFrame:
        """(r, c, line, straight, angle) from the relief of the composite."""
        cells = max(9, round(length_m / self.pixel) | 1)
        return self._step("lineaments", lambda: lineaments.lines(self.table("composite").select("r", "c", "dem"), cells, pixel=self.pixel), force)

    def minerals(self, lines: DataFrame | None = None, layers: DataFrame | None = None, force: bool = False) -> DataFrame:
        """Scores of the three mineral models.

        ``lines`` are cells (r, c) of lineaments; without them those of the relief are used.
        ``layers`` (r, c, and any of quartz_index_raw, clay_depth, iron_depth) switch
        weights to the quartz index and, where there is cover, to absorption depths.
        """

        def make() -> DataFrame:
            cells = (lines if lines is not None else self.lineaments().filter("line")).select("r", "c").distinct().withColumn("line", F.lit(True))
            df = self.surface().join(cells, ["r", "c"], "left").withColumn("line", F.coalesce("line", F.lit(False)))
            there = set(layers.columns) if layers is not None else set()
            df = df.join(layers, ["r", "c"], "left") if layers is not None else df
            size = raster_size(self.table("composite"))
            df = lineaments.density(df, "line", round(1000 / self.pixel), self.pixel, "density", size)
            df = spatial.distances(df, {"distance": "line"}, self.pixel)
            depths = {k: v for k, v in (("hyper_clay", "clay_depth"), ("hyper_iron", "iron_depth")) if v in there}
            evidence = prospect.mineral_evidence(df, F.col("usable"), "density", "distance", "quartz_index_raw" if "quartz_index_raw" in there else None, depths)
            return prospect.mineral_scores(evidence, size).select("r", "c", *MINERAL_WEIGHTS)

        return self._step("minerals", make, force)

    def prospects(self, table: str, models: list[str], points: DataFrame | None = None, **parameters) -> prospecting.Prospects:
        """Targets, areas and success rates from a table of scores; ``points`` are known occurrences (key, lon, lat, model).

        Targets get map coordinates, longitude and latitude.
        """
        scored = self.table(table).join(self.surface().select("r", "c", "usable", "dem"), ["r", "c"])
        placed = None
        if points is not None:
            x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.lit(self.zone))
            placed = spatial.to_cell(points, x, y, self.left, self.top, self.pixel)
        made = prospecting.prospects(scored, models, self.width, placed, pixel=self.pixel, **parameters)
        x, y = F.col("x") * self.pixel + self.left, F.lit(self.top) - F.col("y") * self.pixel
        lon, lat = geo.from_utm(x, y, F.lit(self.zone))
        return prospecting.Prospects(made.models, made.targets.withColumns({"lon": F.round(lon, 6), "lat": F.round(lat, 6), "x": x, "y": y}))

    def gem_analysis(self, points: DataFrame | None = None, **parameters) -> prospecting.Prospects:
        self.gems(self.table("classes") if self.has("classes") else None)
        return self.prospects("gems", list(GEM_WEIGHTS), points, **parameters)

    def mineral_analysis(self, points: DataFrame | None = None, **parameters) -> prospecting.Prospects:
        self.minerals()
        return self.prospects("minerals", list(MINERAL_WEIGHTS), points, **parameters)

    def polygons(self, least: int = 25, masks: bool = False) -> DataFrame:
        """(tile, class_id, lithology, pixels, area_ha, rings) of the class map, patches split at the edges of tiles.

        Patches of fewer than ``least`` pixels go to their largest neighbour first; without
        ``masks`` only rocks make polygons.  Rings are in longitude and latitude.
        """
        shown = {**classes.ROCKS, **(classes.MASKS if masks else {})}
        df = self.table("classes").filter(F.col("label").isin(*shown)).select("r", "c", "label")
        if least > 1:
            df = targets.sieve(df, "label", self.width, least, "_kept").select("r", "c", F.col("_kept").alias("label"))
        made = polygons.polygonise(df, "label", self.width, self.tile)
        first = made.withColumns({"_r": F.floor(F.col("component") / self.width), "_c": F.col("component") % self.width})
        tile = F.concat_ws("_", *[F.lpad(F.floor(F.col(x) / self.tile).cast("string"), 3, "0") for x in ("_c", "_r")])
        placed = first.withColumn("rings", polygons.in_map(F.col("rings"), self.left, self.top, self.pixel))
        degrees = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(*geo.from_utm(p[0], p[1], F.lit(self.zone)))))
        name = scalars.lookup(F.col("label"), shown, "")
        return placed.select(tile.alias("tile"), F.col("label").cast("int").alias("class_id"), name.alias("lithology"), "pixels", (F.col("pixels") * (self.pixel**2 / 1e4)).alias("area_ha"), degrees.alias("rings"))

    def export_polygons(self, folder: str, least: int = 25, masks: bool = False) -> None:
        """Writes the polygons as GeoJSON features, one a line, each task a file."""
        vectors.write_polygons(self.polygons(least, masks), folder)

    def statistics(self) -> DataFrame:
        return statistics.area_statistics(self.table("classes"), "label", self.pixel)

    def query(self, points: DataFrame) -> DataFrame:
        """Class and elevation at (key, lon, lat)."""
        x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.lit(self.zone))
        placed = spatial.to_cell(points, x, y, self.left, self.top, self.pixel)
        return placed.join(self.table("classes"), ["r", "c"], "left").join(self.table("composite").select("r", "c", "dem"), ["r", "c"], "left")

    def validate(self, points: DataFrame) -> DataFrame:
        """Accuracy of the class map at observations (key, lon, lat, class_id)."""
        met = self.query(points).filter("label between 1 and 7")
        return statistics.accuracy(statistics.confusion(met, "class_id", "label", list(range(1, 8))))

    def train(self, labels: DataFrame, trees: int = 50) -> PipelineModel:
        """Random forest from labels (r, c, label 1 to 7) on usable pixels away from contacts."""
        inside = neighbourhood.inside_class(labels, "label", "inside").filter("inside")
        df = self.surface().filter("usable").join(inside.select("r", "c", "label"), ["r", "c"]).withColumn("y", (F.col("label") - 1).cast("double"))
        return learning.forest(df, list(BANDS), "y", trees=trees)
