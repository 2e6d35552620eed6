"""Per-pixel spectral algebra over columns blue, green, red, nir, swir1, swir2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classes import ALTERATION_WEIGHTS, BANDS, EPS, SCL_MASKED, SENSORS, SHADOW, SNOW, VEGETATION, WATER
from .scalars import clip, finite, first_largest, is_finite, mean_of


def ratio(a: Column, b: Column) -> Column:
    return a / (b + EPS)


def normalized_difference(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + EPS)


def _band(name: str) -> Column:
    return finite(F.col(name))


def to_reflectance(dn: Column, sensor: str) -> Column:
    """Digital number to reflectance, held in 0 to 1.5; ``reflectance`` is left as it is."""
    if sensor == "reflectance":
        return dn
    scale, offset = SENSORS[sensor]
    return clip(dn * scale + offset, 0.0, 1.5)


def spectral_indices() -> dict[str, Column]:
    b, g, r, n, s1, s2 = (_band(x) for x in BANDS)
    raw = {
        "ndvi": normalized_difference(n, r), "clay": ratio(s1, s2), "iron": ratio(r, b), "ferrous": ratio(s1, n),
        "ferric": ratio(r, g), "brightness": (b + g + r + n + s1 + s2) / 6, "bare": normalized_difference(s1, n),
    }
    return {k: clip(v, -10.0, 10.0) for k, v in raw.items()}


def alteration_ratios() -> dict[str, Column]:
    b, g, r, n, s1, s2 = (_band(x) for x in BANDS)
    return {"clay": ratio(s1, s2), "iron_oxide": ratio(r, b), "ferrous": ratio(s2, n) + ratio(g, r), "gossan": ratio(s1, r)}


def cluster_features() -> dict[str, Column]:
    """Spectral shape, log brightness and indices: 14 features that shading hardly moves."""
    bright = mean_of(BANDS) + EPS
    return {f"shape_{x}": _band(x) / bright for x in BANDS} | {"log_bright": F.log(bright)} | spectral_indices()


def quartz_index(e10: Column, e11: Column, e12: Column) -> Column:
    """Null unless both outer emissivities are above zero."""
    return F.when((e10 > 0) & (e12 > 0), e11 * e11 / (e10 * e12))


def scl_masked(scl: Column) -> Column:
    return F.coalesce(scl, F.lit(0)).isin(*SCL_MASKED)


def qa_masked(qa: Column) -> Column:
    """Any of the bits 0 to 4; a missing value counts as fill."""
    return F.coalesce(qa, F.lit(1)).bitwiseAND(F.lit(31)) != 0


def hot_cloud(threshold: float = 0.08) -> Column:
    """Haze: bright in blue, flat towards the short-wave infrared, and no snow."""
    b, g, r, s1 = F.col("blue"), F.col("green"), F.col("red"), F.col("swir1")
    return (b - 0.5 * r - threshold > 0) & (b > 0.2) & (s1 < 1.35 * b) & (normalized_difference(g, s1) < 0.4)


def valid(cloud: Column) -> Column:
    """All bands finite, not all zero, and no cloud."""
    there = F.lit(True)
    for x in BANDS:
        there = there & is_finite(F.col(x))
    return there & (mean_of(BANDS) > 0) & ~cloud


def landcover(scl: Column | None = None, cos_i: Column | None = None) -> Column:
    """0 for bare ground, else the class that hides the rock; scene codes rank first, shadow last.

    Finite bands are bound once: filters copy this expression, and generated code that
    repeats them is too long to be compiled.
    """

    def cover(v: Column) -> Column:
        b, g, r, n, s1, s2 = (v[x] for x in BANDS)
        ndsi, ndvi, ndwi = normalized_difference(g, s1), normalized_difference(n, r), normalized_difference(g, n)
        dark = (b + g + r + n + s1 + s2) / 6 < 0.035
        if cos_i is not None:
            dark = dark | (cos_i < 0.02)
        out = F.when((ndsi > 0.4) & (g > 0.15) & (n > 0.11), SNOW).when(((ndsi > 0.1) & (n < 0.10)) | ((ndwi > 0.15) & (n < 0.15)), WATER)
        return out.when(ndvi > 0.45, VEGETATION).when(dark, SHADOW).otherwise(0)

    bands = F.struct(*[_band(x).alias(x) for x in BANDS])
    out = F.get(F.transform(F.array(bands), cover), F.lit(0))
    return out if scl is None else F.when(scl == 6, WATER).when(scl == 11, SNOW).otherwise(out)


def alteration_parts(stats: dict[str, tuple[str, str]]) -> tuple[Column, Column, Column]:
    """(usable here, weighted anomaly, dominant index 1 to 4) from the columns of medians and scales."""
    g, r, n, s1 = (_band(x) for x in ("green", "red", "nir", "swir1"))
    usable = (mean_of(BANDS) >= 0.08) & (normalized_difference(g, s1) <= 0.15)
    green = normalized_difference(n, r) > 0.25
    weighted = []
    for name, value in alteration_ratios().items():
        median, scale = stats[name]
        z = clip((value - F.col(median)) / F.col(scale), 0.0, 10.0)
        z = z if name == "iron_oxide" else F.when(green, 0.0).otherwise(z)
        weighted.append(z * ALTERATION_WEIGHTS[name])
    total = weighted[0] + weighted[1] + weighted[2] + weighted[3]
    return usable, total / sum(ALTERATION_WEIGHTS.values()), first_largest(weighted)
