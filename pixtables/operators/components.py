"""Connected components on pixel grids, and what follows from them.

Mask pixels are dealt over square tiles, so an image of any size is many small tasks. Inside a tile touching
pixels are joined at once over Arrow batches. Tiles then meet only along their borders: components of two tiles
that touch there are the edges of a graph that is smaller than the image by the area of a tile, and its
labels are found by alternating large-star and small-star steps, which settle in a logarithmic number of rounds.
Images that fit into a tile have no such edge and take no round.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import saved

C = F.col
TILE = 256


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n items under the links a - b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def tile_roots(group: np.ndarray, y: np.ndarray, x: np.ndarray, corners: bool = True) -> np.ndarray:
    """Row of the first pixel (in the order of y, x) of each pixel's component in its group.

    Rows are ordered by group, y, x and distinct; y and x lie within a tile.
    """
    side = int(max(y.max(), x.max())) + 2 if len(y) else 1  # one column free, so that lines do not touch
    at = (group * (side + 1) + y) * side + x
    links = []
    for step in (1, side - 1, side, side + 1) if corners else (1, side):
        to = np.searchsorted(at, at + step)
        to[to == len(at)] = 0
        hit = np.flatnonzero(at[to] == at + step)
        links.append((hit, to[hit]))
    return joined(len(at), np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links]))


def _tiles(tile: int, named: int, out: pa.Schema, corners: bool):
    """Sorted mask pixels (keys, ty, tx, y, x, carried) -> the same and ``n``, the number of the component's first pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def labelled(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            y, x = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
            root = tile_roots(np.cumsum(first) - 1, np.mod(y, tile), np.mod(x, tile), corners)
            n = pa.array(y[root] * 2**32 + x[root], pa.int64())
            yield from t.drop_columns(["_ty", "_tx"]).append_column("n", n).select(out.names).cast(out).to_batches(max_chunksize=20_000)

        def begins(t: pa.Table) -> np.ndarray:
            first = np.zeros(t.num_rows, bool)
            first[0] = True
            for c in t.column_names[:named]:
                col = t.column(c).combine_chunks()
                a, b = col.slice(1), col.slice(0, len(col) - 1)
                same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
                first[1:] |= ~same
            return first

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < tile * tile // 4:
                continue
            first = begins(held)
            last = int(np.flatnonzero(first)[-1])  # the last tile may go on in the next batch
            if last:
                yield from labelled(held.slice(0, last), first[:last])
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from labelled(held, begins(held))

    return run


def _star_step(edges: DataFrame, keys: Sequence[str], large: bool) -> DataFrame:
    """One step over edges (keys, a, b) with a > b: large-star hangs the greater neighbours of a node on the least of its
    neighbours, small-star the smaller ones and the node itself."""
    both = edges.select(*keys, C("a").alias("u"), C("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(*keys, C("b").alias("u"), C("a").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, [*keys, "u"])
    if large:
        out = moved.where(C("v") > C("u")).select(*keys, C("v").alias("a"), C("m").alias("b"))
    else:
        out = moved.select(*keys, C("v").alias("a"), C("m").alias("b")).unionByName(least.select(*keys, C("u").alias("a"), C("m").alias("b")))
    return out.where(C("a") != C("b")).distinct()


def stars_of(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, a, b: each node that is not the least of its component, and the least one. edges(keys, a, b)."""
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(20,0)"))).first()
    edges = saved(edges.where(C("a") != C("b")).select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(edges)
    while seen[0]:
        edges = saved(_star_step(_star_step(edges, keys, True), keys, False), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges


def connected_components(grid: DataFrame, keys: Sequence[str], on: Column, width: int | Column, carry: Mapping[str, Column] | None = None, tile: int = TILE, corners: bool = True) -> DataFrame:
    """8-neighbour (without ``corners`` 4-neighbour) label (smallest ``y*width+x`` of the component) of every mask pixel: keys, y, x, label and the carried columns.

    Pixels of one image are distinct; images may differ in size, ``width`` may be a column of the grid, and a
    null in ``on`` is no mask.
    """
    keys, carry = list(keys), dict(carry or {})
    px = grid.where(F.coalesce(on, F.lit(False))).select(*keys, F.floor(C("y") / tile).alias("_ty"), F.floor(C("x") / tile).alias("_tx"), "y", "x", *[c.alias(n) for n, c in carry.items()], (F.lit(width) if isinstance(width, int) else width).alias("_width"))
    place = [*keys, "_ty", "_tx"]
    schema = T.StructType([f for f in px.schema if f.name not in ("_ty", "_tx")] + [T.StructField("n", T.LongType())])
    named = px.repartition(*[C(c) for c in place]).sortWithinPartitions(*place, "y", "x").mapInArrow(_tiles(tile, len(place), to_arrow_schema(schema), corners), schema)
    local = saved(named, "tiles")
    # neighbours across the border of a tile; both lie on it
    edge = lambda c: (C(c) % tile == 0) | (C(c) % tile == tile - 1)
    border = local.where(edge("y") | edge("x")).select(*keys, "y", "x", "n")
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), *([(1, -1), (1, 1)] if corners else []))]))
    ask = border.select(*keys, "y", "x", C("n").alias("a"), steps.alias("s"))
    ask = ask.select(*keys, "a", C("y").alias("_y"), C("x").alias("_x"), (C("y") + C("s.dy")).alias("y"), (C("x") + C("s.dx")).alias("x"))
    ask = ask.where((F.floor(C("y") / tile) != F.floor(C("_y") / tile)) | (F.floor(C("x") / tile) != F.floor(C("_x") / tile)))
    stars = stars_of(ask.join(border, [*keys, "y", "x"]).select(*keys, "a", C("n").alias("b")), keys)
    root = local.join(stars.select(*keys, C("a").alias("n"), C("b").alias("_root")), [*keys, "n"], "left").withColumn("n", F.coalesce("_root", "n"))
    label = F.floor(C("n") / 2**32) * C("_width") + F.pmod(C("n"), F.lit(2**32))
    return root.select(*keys, "y", "x", label.cast(grid.schema["y"].dataType).alias("label"), *carry)


def areas(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def edge_fill(grid: DataFrame, keys: Sequence[str], on: Column, height: int | Column, width: int | Column) -> DataFrame:
    """Mask pixels whose component touches the image border; height and width may be columns of the grid."""
    border = (C("y") == 0) | (C("x") == 0) | (C("y") == height - 1) | (C("x") == width - 1)
    lab = connected_components(grid, keys, on, width, {"_border": border})
    touching = lab.where("_border").select(*keys, "label").distinct()
    return lab.join(touching, [*keys, "label"], "left_semi").select(*keys, "y", "x")
