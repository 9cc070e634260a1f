"""Pixel-wise column expressions; all stay inside whole-stage code generation."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import clamp, clamp_or_null

# Rec.709 luminance weights (fixed values).
REC709 = (0.2126, 0.7152, 0.0722)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.lit(REC709[0]) * r + F.lit(REC709[1]) * g + F.lit(REC709[2]) * b


def saturation_hsv(r: Column, g: Column, b: Column) -> Column:
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    return (hi - lo) / F.greatest(hi, F.lit(1e-6))


def saturation_hsl(r: Column, g: Column, b: Column) -> Column:
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    low = (hi + lo) * 0.5 <= 0.5
    s = F.when(low, (hi - lo) / F.greatest(hi + lo, F.lit(1e-7))).otherwise((hi - lo) / F.greatest(F.lit(2.0) - hi - lo, F.lit(1e-7)))
    return F.when(hi - lo > 1e-7, clamp(s)).otherwise(F.lit(0.0))


def chroma_proxy(r: Column, g: Column, b: Column) -> Column:
    mean = (F.abs(r) + F.abs(g) + F.abs(b)) / 3.0
    return (F.greatest(r, g, b) - F.least(r, g, b)) / F.greatest(mean, F.lit(0.02))


def chromaticity(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    pos = [F.greatest(c, F.lit(0.0)) for c in (r, g, b)]
    total = F.greatest(pos[0] + pos[1] + pos[2], F.lit(1e-6))
    return tuple(c / total for c in pos)


def opponent_hue(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Angle and strength of (B-G, R-G)."""
    rg, bg = r - g, b - g
    return F.atan2(bg, rg), F.sqrt(rg * rg + bg * bg)


def hue_degrees(r: Column, g: Column, b: Column) -> Column:
    """Hue sector formula; 0 for grey. The last channel that holds the maximum decides."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = F.greatest(hi - lo, F.lit(1e-7))
    sector = (
        F.when(b == hi, (r - g) / d + 4.0)
        .when(g == hi, (b - r) / d + 2.0)
        .otherwise(F.pmod((g - b) / d, F.lit(6.0)))
    )
    return F.when(hi - lo > 1e-7, F.pmod(sector * 60.0, F.lit(360.0))).otherwise(F.lit(0.0))


def hue_mask(hue: Column, center: float, width: float, feather: float) -> Column:
    """Soft membership of a hue on a circular interval."""
    d = F.abs(F.pmod(hue, F.lit(360.0)) - F.lit(float(center) % 360.0))
    d = F.least(d, F.lit(360.0) - d)
    outer = max(5.0, min(90.0, float(width)))
    inner = outer * (1.0 - max(0.05, min(1.0, float(feather))))
    t = clamp((d - inner) / (outer - inner))
    return F.lit(1.0) - t * t * (F.lit(3.0) - F.lit(2.0) * t)


def circular_delta(a: Column, b: Column) -> Column:
    """Smallest absolute difference of two angles in radians."""
    return F.abs(F.atan2(F.sin(a - b), F.cos(a - b)))


def mtf(v: Column, shadows: Column, midtones: Column, highlights: Column) -> Column:
    """Closed-form midtone transfer, pinned at both ends; null where it is unstable."""
    n = clamp((v - shadows) / F.greatest(highlights - shadows, F.lit(1e-12)))
    den = (F.lit(2.0) * midtones - 1.0) * n - midtones
    body = F.when(F.abs(den) >= 1e-12, clamp_or_null((midtones - 1.0) * n / den))
    return F.when(v <= shadows, F.lit(0.0)).when(v >= highlights, F.lit(1.0)).otherwise(body)


def mtf_midpoint(source: Column, target: float) -> Column:
    """Midtone that maps ``source`` to ``target``."""
    s = clamp(source, 1e-6, 0.999999)
    t = max(1e-6, min(0.999999, float(target)))
    return s * (1.0 - t) / (s * (1.0 - 2.0 * t) + t)


def screen(base: Column, layer: Column, intensity: Column, alpha: Column | None = None) -> Column:
    term = clamp(layer * intensity)
    out = F.lit(1.0) - (F.lit(1.0) - base) * (F.lit(1.0) - term)
    if alpha is None:
        return out
    a = clamp(alpha)
    return base * (F.lit(1.0) - a) + out * a


def dualband_channels(r: Column, g: Column, b: Column) -> dict[str, Column]:
    h, o = clamp(r), clamp((g + b) * 0.5)
    return {"H": h, "O": o, "S": clamp((h + o) * 0.5)}


# Palettes of a two-line image (fixed values): which channel feeds R, G, B.
PALETTES = {"HSO": "HSO", "SHO": "SHO", "OSH": "OSH", "OHS": "OHS", "HOS": "HOS", "HOO": "HOO"}


def room(target: Column, part: Column, most: Column) -> Column:
    """Largest factor up to ``most`` that keeps target + part * factor inside 0..1."""
    return F.when(part > 1e-7, F.least(most, (F.lit(1.0) - target) / part)).when(part < -1e-7, F.least(most, target / -part)).otherwise(most)


def piecewise(v: Column, points: Column) -> Column:
    """Linear interpolation on ascending ``points`` (array of struct x, y); ends are held.

    The points are a short curve carried with the row or a literal, so the lookup is
    a fold over the array and needs neither a join nor a Python function.
    """
    n = F.size(points)
    first, last = points[0], F.element_at(points, -1)
    pairs = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    inside = F.aggregate(
        pairs, F.lit(None).cast("double"),
        lambda acc, s: F.when((v >= s["x0"]) & (v < s["x1"]), s["y0"] + (s["y1"] - s["y0"]) / (s["x1"] - s["x0"]) * (v - s["x0"])).otherwise(acc),
    )
    return F.when(v < first["x"], first["y"]).when(v >= last["x"], last["y"]).otherwise(inside)


def curve(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def valid_curve(points: Column) -> Column:
    """At least two points in [0,1], x strictly rising, y not falling."""
    n = F.size(points)
    inside = F.forall(points, lambda p: p["x"].between(0.0, 1.0) & p["y"].between(0.0, 1.0) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    rising = F.forall(
        F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (b["x"] > a["x"]) & (b["y"] >= a["y"])),
        lambda ok: ok,
    )
    return (n >= 2) & inside & rising


def safe_gain(rgb: tuple[Column, ...], mapped_luma: Column, headroom: float = 0.995) -> list[Column]:
    """One gain per pixel so that the luminance becomes ``mapped_luma`` and no channel leaves the headroom."""
    luma = luminance(*rgb)
    gain = F.when(luma > 1e-12, mapped_luma / luma).otherwise(F.lit(0.0))
    parts = [c * gain for c in rgb]
    peak = F.greatest(*parts)
    shrink = F.when(peak > headroom, F.lit(headroom) / peak).otherwise(F.lit(1.0))
    return [F.least(F.greatest(p * shrink, F.lit(0.0)), F.lit(headroom)) for p in parts]
