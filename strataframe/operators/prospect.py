"""Alteration, gem and mineral scores, landslide susceptibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import BANDS, EPS, GEM_WEIGHTS, HAZARD_CUTS, HAZARD_WEIGHTS, HYPER_WEIGHTS, MINERAL_WEIGHTS, SLOPE_KNOTS, VEIN_WEIGHTS_WITH_QUARTZ, WEAKNESS
from ..functions.scalars import clip, digitize, interpolate, lookup, mean_of
from ..functions.spectral import alteration_parts, alteration_ratios
from .halos import Kernel, mean, with_kernels
from .spatial import distances
from .statistics import robust_scales, with_row
from .targets import settled


def alteration_score(df: DataFrame, usable: Column) -> DataFrame:
    """Adds ``score`` (0 to 100) and ``dominant`` (1 to 4), both 0 where rock isn't seen."""
    df = settled(df)  # read for medians and for the score
    stats = robust_scales(df.filter(usable), alteration_ratios())
    names = {k: (f"{k}_median", f"{k}_scale") for k in alteration_ratios()}
    here, combined, dominant = alteration_parts(names)
    made = with_row(df, stats).withColumns({"_ok": usable & here, "_v": combined, "dominant": dominant})
    made = with_kernels(made.drop(*[c for pair in names.values() for c in pair]), [mean("_m", "_v", 3)])
    score = F.when(F.col("_ok"), clip(F.col("_m") / 3.0 * 100, 0.0, 100.0)).otherwise(0.0)
    return made.withColumn("score", score).withColumn("dominant", F.when(F.col("_ok"), F.col("dominant")).otherwise(0)).drop("_ok", "_v", "_m")


def _positive(z: Column) -> Column:
    return clip(z / 3.0, 0.0, 1.0)


def gem_evidence(df: DataFrame, usable: Column, also: Sequence[Kernel] = (), size: tuple[int, int] | None = None) -> DataFrame:
    """Adds carbonate, felsic, mafic, mgoh and texture memberships, 0 where not usable.

    ``also`` are other kernels whose columns are wanted: they share the one shuffle.
    """
    raw = {
        "brightness": mean_of(BANDS), "iron_ratio": F.col("red") / (F.col("blue") + EPS),
        "ferrous": F.col("swir2") / (F.col("nir") + EPS) + F.col("green") / (F.col("red") + EPS), "swir_ratio": F.col("swir1") / (F.col("swir2") + EPS),
    }
    made = df.withColumns({f"_{k}": v for k, v in raw.items()}).withColumn("_square", F.col("_brightness") * F.col("_brightness"))
    made = with_kernels(made, [mean("_m1", "_brightness", 5), mean("_m2", "_square", 5), *also], size).withColumn("_texture", F.col("_m2") - F.col("_m1") * F.col("_m1"))
    keys = ["brightness", "iron_ratio", "ferrous", "swir_ratio", "texture"]
    made = settled(made)  # read three times: for medians, for deviations and for the evidence
    stats = robust_scales(made.filter(usable), {k: F.col(f"_{k}") for k in keys}, 1e-4)
    z = {k: (F.col(f"_{k}") - F.col(f"{k}_median")) / F.col(f"{k}_scale") for k in keys}
    swir, bright, iron, ferr = (_positive(z[k]) for k in ("swir_ratio", "brightness", "iron_ratio", "ferrous"))
    dark = clip((1 - z["brightness"]) / 2, 0.0, 1.0)
    evidence = {
        "carbonate": clip(z["swir_ratio"] / 2.0, 0.0, 1.0) * clip((z["brightness"] + 1) / 2, 0.0, 1.0) * (1 - iron),
        "felsic": bright * (1 - swir) * (1 - ferr) * (1 - iron),
        "mafic": ferr * dark,
        "mgoh": swir * dark,
        "texture": _positive(z["texture"]),
    }
    made = with_row(made, stats)
    more = [m for kernel in also for m in kernel.makes]
    return made.select(*df.columns, *more, *[F.when(usable, v).otherwise(0.0).alias(k) for k, v in evidence.items()])


def bedrock(least: float = 15.0) -> Column:
    """Whether a slope (radians) is so steep that rock crops out rather than sediment."""
    return F.degrees("slope") >= least


def with_lithology(evidence: DataFrame, usable: Column, lithology: str, contact_m: float = 80.0, pixel: float = 20.0) -> DataFrame:
    """Gem evidence sharpened by a rock map, and the contacts between strong evidence.

    The map's rocks raise their evidence to at least 0.6, 0.4 and 0.5; nothing is left on alluvium.
    A contact falls off with the mean distance to strong cells of both kinds; without
    either kind there is none.
    """
    ok = usable & (F.col(lithology) != 7)
    raised = {"carbonate": (1, 0.6), "felsic": (4, 0.4), "mafic": (5, 0.5)}
    made = evidence.withColumns({k: F.greatest(F.col(k), F.when(F.col(lithology) == rock, least).otherwise(0.0)) for k, (rock, least) in raised.items()})
    made = made.withColumns({f"_strong_{k}": (F.col(k) > 0.6) & ok for k in raised})
    made = distances(made, {f"_d_{k}": f"_strong_{k}" for k in raised}, pixel)
    near = lambda a: F.coalesce(F.exp(-(F.col(f"_d_{a}") + F.col("_d_mafic")) / (2 * contact_m)), F.lit(0.0))
    made = made.withColumns({"carb_contact": near("carbonate"), "felsic_contact": near("felsic")})
    layers = ("carbonate", "felsic", "mafic", "mgoh", "texture", "carb_contact", "felsic_contact")
    return made.withColumns({k: F.when(ok, F.col(k)).otherwise(0.0) for k in layers}).drop(*[f"{x}{k}" for k in raised for x in ("_strong_", "_d_")])


def _weighted(parts: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.col(name) * weight
    return total / sum(parts.values())


def smoothed_scores(df: DataFrame, raw: dict[str, Column], size: tuple[int, int] | None = None) -> DataFrame:
    """Adds a score of 0 to 100 for each model: the 3 x 3 mean of its evidence, 0.7 giving 100."""
    made = with_kernels(df.withColumns({f"_{m}": v for m, v in raw.items()}), [mean(m, f"_{m}", 3) for m in raw], size)
    return made.withColumns({m: clip(F.col(m) * 100 / 0.7, 0.0, 100.0) for m in raw}).drop(*[f"_{m}" for m in raw])


def gem_scores(evidence: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    return smoothed_scores(evidence, {m: _weighted(parts) for m, parts in GEM_WEIGHTS.items()}, size)


def mineral_evidence(df: DataFrame, usable: Column, density: str, distance: str, quartz: str | None = None, depths: dict[str, str] | None = None) -> DataFrame:
    """Adds memberships of clay, iron oxide, gossan, silica, lineament density and nearness.

    ``quartz`` names a column of the thermal quartz index: then ``quartz_index`` is added.
    ``depths`` names columns of absorption depths of ``hyper_clay`` and ``hyper_iron``, null
    where there is no cover: then these and ``hyper_cover`` are added.
    """
    raw = {k: v for k, v in alteration_ratios().items() if k != "ferrous"} | {"brightness": mean_of(BANDS), "lineament": F.col(density)}
    if quartz:
        raw["quartz_index"] = F.col(quartz)
    made = settled(df.withColumns({f"_{k}": v for k, v in raw.items()}))
    stats = robust_scales(made.filter(usable), {k: F.col(f"_{k}") for k in raw}, 1e-4)
    pos = {k: _positive(F.coalesce((F.col(f"_{k}") - F.col(f"{k}_median")) / F.col(f"{k}_scale"), F.lit(0.0))) for k in raw}
    evidence = {
        "clay": pos["clay"], "iron_oxide": pos["iron_oxide"], "gossan": pos["gossan"], "silica": pos["brightness"] * (1 - pos["iron_oxide"]),
        "lineament": pos["lineament"], "proximity": F.coalesce(F.exp(-F.col(distance) / 100.0), F.lit(0.0)),
    }
    if quartz:
        evidence["quartz_index"] = pos["quartz_index"]
    # A depth of 0.02 is a trace, 0.12 is strong.
    evidence |= {k: clip((F.coalesce(F.col(v), F.lit(0.0)) - 0.02) / 0.10, 0.0, 1.0) for k, v in (depths or {}).items()}
    cover = [F.coalesce(*[F.col(v) for v in depths.values()]).isNotNull().alias("hyper_cover")] if depths else []
    return with_row(made, stats).select(*df.columns, *[F.when(usable, v).otherwise(0.0).alias(k) for k, v in evidence.items()], *cover)


def mineral_scores(evidence: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """Scores of the mineral models from the evidence there is.

    With ``quartz_index`` veins go by it; where ``hyper_cover`` holds, iron and copper go by depths.
    Veins need their host rock too, so that their score is scaled by it.
    """
    has_quartz = "quartz_index" in evidence.columns
    raw = {}
    for model, parts in MINERAL_WEIGHTS.items():
        raw[model] = _weighted(VEIN_WEIGHTS_WITH_QUARTZ if model == "vein" and has_quartz else parts)
        depths = HYPER_WEIGHTS.get(model)
        if depths and "hyper_cover" in evidence.columns and set(depths) <= set(evidence.columns):
            raw[model] = F.when(F.col("hyper_cover"), _weighted(depths)).otherwise(raw[model])
    raw["vein"] = raw["vein"] * clip(F.col("quartz_index" if has_quartz else "silica") + 0.4, 0.0, 1.0)
    return smoothed_scores(evidence, raw, size)


def landslide(df: DataFrame, lithology: str, slope_degrees: Column, relief: Column, river_distance: Column, ndvi: Column) -> DataFrame:
    """Adds ``hazard_index`` (0 to 1) and ``hazard`` (1 very low to 5 very high)."""
    factors = {
        "slope": interpolate(slope_degrees, SLOPE_KNOTS),
        "relief": clip(relief / 400.0, 0.0, 1.0),
        "river": F.coalesce(F.exp(-river_distance / 400.0), F.lit(0.0)),
        "lithology": lookup(F.col(lithology), WEAKNESS, 0.5),
        "bare": 1 - clip((F.coalesce(ndvi, F.lit(0.0)) - 0.1) / 0.5, 0.0, 0.7),
    }
    index = F.lit(0.0)
    for name, weight in HAZARD_WEIGHTS.items():
        index = index + factors[name] * weight
    return df.withColumn("hazard_index", index / sum(HAZARD_WEIGHTS.values())).withColumn("hazard", digitize(F.col("hazard_index"), HAZARD_CUTS) + 1)
