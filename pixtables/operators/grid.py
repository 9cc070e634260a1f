"""Pixel-grid operators: dense grids, separable windows, gradients.

All windows are partitioned by one image row or one image column, never by the
image, so the size of a window partition is bounded by the side of an image.
Repeated blurs take an image of declared small size as one row of arrays.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import images_fit


def dense_grid(px: DataFrame, size: DataFrame, fill: dict[str, Column], key: str = "image_id") -> DataFrame:
    """Every (y, x) of each image; missing pixels take the ``fill`` expressions.

    ``size`` has one row per image with ``h``, ``w`` and whatever ``fill`` reads.
    """
    rows = size.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    joined = cells.join(px, [key, "y", "x"], "left")
    out = [F.coalesce(F.col(c), e).alias(c) for c, e in fill.items()]
    return joined.select(key, "y", "x", "h", "w", *out)


def _slide(df: DataFrame, key: Sequence[str], line: str, axis: str, extent: str, cols: dict[str, str], r: int, fn) -> DataFrame:
    """One separable pass with mirrored ends (the edge row itself is not repeated)."""
    a, n = F.col(axis), F.col(extent)
    images = F.array_compact(
        F.array(
            a,
            F.when((a >= 1) & (a <= r), -a),
            F.when((a <= n - 2) & (a >= n - 1 - r), F.lit(2) * (n - 1) - a),
        )
    )
    w = W.partitionBy(*key, line).orderBy("_p").rowsBetween(-r, r)
    widened = df.withColumn("_p", F.explode(images))
    for src, dst in cols.items():
        widened = widened.withColumn(dst, fn(F.col(src)).over(w))
    return widened.where((F.col("_p") >= 0) & (F.col("_p") < n)).withColumn(axis, F.col("_p").cast("int")).drop("_p")


def box_blur(df: DataFrame, cols: dict[str, str], r: int, key: Sequence[str] = ("image_id",)) -> DataFrame:
    """Mean over (2r+1)^2 pixels with mirrored borders; ``cols`` maps source to result column."""
    mid = {c: f"_h_{d}" for c, d in cols.items()}
    out = _slide(df, key, "y", "x", "w", mid, r, F.avg)
    out = _slide(out, key, "x", "y", "h", {f"_h_{d}": d for d in cols.values()}, r, F.avg)
    return out.drop(*mid.values())


def _line_means(at: np.ndarray, n: int, v: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each pixel of one line and its two neighbours among those that exist, ends mirrored; null pixels take no part."""
    low, high = np.flatnonzero(at == 1), np.flatnonzero(at == n - 2)
    src = np.concatenate([np.arange(len(at)), low, high])
    order = np.argsort(np.concatenate([at, np.full(len(low), -1), np.full(len(high), n)]), kind="stable")
    v, ok = (np.concatenate([[0], c[src[order]], [0]]) for c in (np.where(ok, v, 0.0), ok))
    total, count = 0.0 + v[:-2] + v[1:-1] + v[2:], ok[:-2].astype(int) + ok[1:-1] + ok[2:]
    back = np.argsort(order)[: len(at)]
    return total[back] / np.maximum(count[back], 1), count[back] > 0


def _plane_means(v: np.ndarray) -> np.ndarray:
    """The same along the first axis of a full grid without nulls."""
    if len(v) == 1:
        return 0.0 + v
    v = np.concatenate([v[1:2], v, v[-2:-1]])
    return (0.0 + v[:-2] + v[1:-1] + v[2:]) / 3


def _blurred(y: np.ndarray, x: np.ndarray, h: int, w: int, v: np.ndarray, ok: np.ndarray, passes: Sequence[int]) -> list[np.ndarray]:
    """Values of an image's pixels after each number of passes; null as a masked entry."""
    out = []
    if ok.all() and len(y) == h * w and (np.bincount(y * w + x, minlength=h * w) == 1).all():
        grid = np.empty((h, w))
        grid[y, x] = v
        for i in range(1, max(passes) + 1):
            grid = _plane_means(_plane_means(grid.T).T)
            if i in passes:
                out.append(np.ma.array(grid[y, x], mask=False))
        return out
    for i in range(1, max(passes) + 1):
        for line, at, n in ((y, x, w), (x, y, h)):
            new, there = np.empty(len(v)), np.empty(len(v), bool)
            for k in np.unique(line):
                own = np.flatnonzero(line == k)
                new[own], there[own] = _line_means(at[own], n, v[own], ok[own])
            v, ok = new, there
        if i in passes:
            out.append(np.ma.array(v, mask=~ok))
    return out


def repeated_blur(df: DataFrame, col: str, passes: dict[int, str], key: Sequence[str] = ("image_id",)) -> DataFrame:
    """The rows of ``df`` (y, x, h, w) with ``col`` after some numbers of 3 x 3 means, as ``box_blur`` taken so often.

    An image of declared small size is one row of arrays and passes Python once, whatever the number of passes.
    """
    key = list(key)
    if not images_fit(df.sparkSession):
        out, cur = df, col
        for i in range(1, max(passes) + 1):
            new = passes.get(i, f"_blur_{i}")
            out = box_blur(out, {cur: new}, 1, key)
            out, cur = (out.drop(cur) if cur.startswith("_blur_") else out), new
        return out
    wanted, names = sorted(passes), [passes[i] for i in sorted(passes)]
    kind = pa.list_(pa.float64())

    @F.arrow_udf(f"struct<{','.join(f'{n}:array<double>' for n in names)}>")
    def blurred(rows: pa.Array) -> pa.Array:
        out = [[] for _ in names]
        for row in rows:
            z = row.values
            y, x = (z.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("y", "x"))
            v = z.field("v")
            found = _blurred(y, x, z.field("h")[0].as_py(), z.field("w")[0].as_py(), v.fill_null(0.0).to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False), wanted)
            for o, f in zip(out, found):
                o.append(pa.array(f.data, pa.float64(), mask=np.ma.getmaskarray(f)))
        sizes = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays(o), type=kind) for o in out], names=names)

    rest = [c for c in df.columns if c not in key]
    inside = (F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") >= 0) & (F.col("x") < F.col("w"))
    images = df.where(inside).groupBy(*key).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    sent = F.transform("_rows", lambda p: F.struct(p.y.alias("y"), p.x.alias("x"), p.h.alias("h"), p.w.alias("w"), p[col].cast("double").alias("v")))
    images = images.select(*key, "_rows", blurred(sent).alias("_s"))
    pixels = images.select(*key, F.explode(F.arrays_zip("_rows", *[F.col(f"_s.{n}").alias(n) for n in names])).alias("_z"))
    return pixels.select(*[c if c in key else F.col(f"_z._rows.{c}").alias(c) for c in df.columns], *[F.col(f"_z.{n}").alias(n) for n in names])


def morph(df: DataFrame, cols: dict[str, str], passes: int, grow: bool, key: Sequence[str] = ("image_id",)) -> DataFrame:
    """Binary dilation (``grow``) or erosion with a square of side 2*passes+1."""
    fn = F.max if grow else F.min
    out = df
    for src, dst in cols.items():
        wx = W.partitionBy(*key, "y").orderBy("x").rangeBetween(-passes, passes)
        wy = W.partitionBy(*key, "x").orderBy("y").rangeBetween(-passes, passes)
        out = out.withColumn("_t", fn(F.col(src)).over(wx)).withColumn(dst, fn(F.col("_t")).over(wy)).drop("_t")
    return out


def step_back(df: DataFrame, col: str, axis: str, key: Sequence[str] = ("image_id",)) -> Column:
    """Value of the preceding pixel on the axis, null where that pixel is missing."""
    line = "y" if axis == "x" else "x"
    w = W.partitionBy(*key, line).orderBy(axis).rangeBetween(-1, -1)
    return F.max(F.col(col)).over(w)


def abs_gradient(df: DataFrame, col: str, out: str, key: Sequence[str] = ("image_id",)) -> DataFrame:
    """|v - left| + |v - upper|; a missing neighbour counts as no change."""
    dx = F.coalesce(F.abs(F.col(col) - step_back(df, col, "x", key)), F.lit(0.0))
    dy = F.coalesce(F.abs(F.col(col) - step_back(df, col, "y", key)), F.lit(0.0))
    return df.withColumn("_dx", dx).withColumn(out, F.col("_dx") + dy).drop("_dx")
