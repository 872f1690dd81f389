"""Any-resolution images: which grid of tiles an image gets, and how many tokens it makes.

All are built-in expressions over the image's width and height.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_resolution(width: Column, height: Column, sizes: Sequence[tuple[int, int]]) -> Column:
    """The (width, height) of ``sizes`` that keeps most of the image's pixels when it is
    scaled to fit, then wastes least; ties go to the first. Null without an image."""

    def rated(place: int, w: int, h: int) -> Column:
        scale = F.least(F.lit(w) / width, F.lit(h) / height)
        fitted = F.floor(width * scale) * F.floor(height * scale)
        kept = F.least(fitted, (width * height).cast("long"))
        return F.struct(kept.alias("kept"), (kept - w * h).alias("waste"), F.lit(-place).alias("place"), F.lit(w).alias("width"), F.lit(h).alias("height"))

    best = F.array_max(F.array(*[rated(i, w, h) for i, (w, h) in enumerate(sizes)]))
    return F.when((width > 0) & (height > 0), F.struct(best["width"].alias("width"), best["height"].alias("height")))


def grid_shape(width: Column, height: Column, sizes: Sequence[tuple[int, int]], tile: int) -> Column:
    """(columns, rows) of tiles of the image's best resolution."""
    best = best_resolution(width, height, sizes)
    return F.when(best.isNotNull(), F.struct(F.floor(best["width"] / tile).cast("int").alias("columns"), F.floor(best["height"] / tile).cast("int").alias("rows")))


def unpadded(columns: Column, rows: Column, width: Column, height: Column) -> Column:
    """(columns, rows) of a feature map without the margins that padding the image to the
    map's shape has made; a margin is cut alike on both sides."""
    wide = width * rows > height * columns  # wider than the map: margins above and below
    inner_rows, inner_columns = F.floor(height * columns / width), F.floor(width * rows / height)
    cut = lambda whole, inner: whole - 2 * F.floor((whole - inner) / 2)
    return F.struct(F.when(wide, columns).otherwise(cut(columns, inner_columns)).cast("int").alias("columns"), F.when(wide, cut(rows, inner_rows)).otherwise(rows).cast("int").alias("rows"))


def token_count(width: Column, height: Column, sizes: Sequence[tuple[int, int]], tile: int, patch: int) -> Column:
    """Tokens of an image: those of the whole image in one tile, and of its unpadded grid with
    a newline after each row."""
    side = tile // patch
    grid = grid_shape(width, height, sizes, tile)
    shape = unpadded(grid["columns"] * side, grid["rows"] * side, width, height)
    return (side * side + (shape["columns"] + 1) * shape["rows"]).cast("long")
