"""What paper and ink of a text region look like: colours for an overlay, found by aggregation over pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.operators.raster import argb, channel, luminance, luminance_byte, otsu_threshold

#: Pixels and rectangles meet by cells of so many pixels a side.
CELL = 32
#: Pixels within so much of the paper's usual brightness count as paper; beyond this difference between corners the fill is a gradient.
BAND, FLAT_DELTA = 12, 4
#: Around a corner: how far outside the region, and how far along its sides, paper is looked for.
OUTSIDE, ALONG, BESIDE = 6, 8, 4
WHITE, BLACK = 0xFFFFFFFF, 0xFF000000


def pixels(images: DataFrame, order: str = "rgba") -> DataFrame:
    """img, x, y, color of each pixel of images (img, width, height, data); ``order``: of the four bytes of a pixel. A row with null x and an error
    if the size doesn't fit the data. Images are read one at a time."""
    at = [order.index(c) for c in "argb"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w, h, data = row["width"], row["height"], row["data"]
                if data is None or w is None or h is None or w < 0 or h < 0 or len(data) != w * h * 4:
                    found = f"expected {w} x {h} x 4 bytes, got {None if data is None else len(data)}"
                    yield pa.RecordBatch.from_pydict({"img": [row["img"]], "x": [None], "y": [None], "color": [None], "error": [found]}, schema)
                    continue
                c = np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.int64)
                n = np.arange(w * h)
                for s in range(0, w * h, 1 << 20):
                    k = n[s : s + (1 << 20)]
                    color = sum(c[k, a] << (24 - 8 * i) for i, a in enumerate(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row["img"])), pa.array((k % w).astype(np.int32)), pa.array((k // w).astype(np.int32)), pa.array(color), pa.nulls(len(k), pa.string())], schema=schema)

    schema = pa.schema([("img", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("color", pa.int64()), ("error", pa.string())])
    return images.select(F.col("img").cast("long").alias("img"), "width", "height", "data").mapInArrow(read, "img long, x int, y int, color long, error string")


def image_bytes(pixels_: DataFrame, images: DataFrame, order: str = "rgba") -> DataFrame:
    """img, data from pixels (img, x, y, color) of images (img, width, height): what ``pixels`` takes apart. A pixel that isn't there is white."""
    shifts = [{"a": 24, "r": 16, "g": 8, "b": 0}[c] for c in order]
    grid = images.select("img", "width", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("n")).select("img", (F.col("n") % F.col("width")).cast("int").alias("x"), F.floor(F.col("n") / F.col("width")).cast("int").alias("y"), "n")
    full = grid.join(pixels_.select("img", "x", "y", "color"), ["img", "x", "y"], "left").withColumn("color", F.coalesce("color", F.lit(WHITE).cast("long")))
    hexed = F.lpad(F.hex(sum((F.shiftright("color", s).bitwiseAND(F.lit(255)) * (1 << (24 - 8 * i)) for i, s in enumerate(shifts)), F.lit(0).cast("long"))), 8, "0")
    rows = full.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("n", hexed.alias("h")))).alias("p"))
    return rows.select("img", F.unhex(F.array_join(F.transform("p", lambda p: p["h"]), "")).alias("data"))


def clamp_rect(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:
    """struct(l, t, r, b) inside the image, at least one pixel wide and high; null for an image without pixels."""
    left, top = F.least(l, width - 1), F.least(t, height - 1)
    right, bottom = F.least(F.greatest(r, left + 1), width), F.least(F.greatest(b, top + 1), height)
    return F.when((width > 0) & (height > 0), F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b")))


def mean_color(r: Column, g: Column, b: Column, n: Column) -> Column:
    """Of channel sums; whole numbers, null of nothing."""
    return F.when(n > 0, argb(F.floor(r / n), F.floor(g / n), F.floor(b / n)))


def corner_mean(corners: list[Column]) -> Column:
    return argb(*[F.floor(sum((channel(c, k) for c in corners), F.lit(0)) / 4) for k in (2, 1, 0)])


def max_channel_delta(a: Column, b: Column) -> Column:
    return F.greatest(*[F.abs(channel(a, k) - channel(b, k)) for k in range(3)])


def around(pixels_: DataFrame, rects: DataFrame, margin: int) -> DataFrame:
    """Pixels (img, x, y, color) within ``margin`` of each rect (rect_id, img, l, t, r, b and others), with its columns. They meet by image and cell."""
    cells = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - margin) / CELL), F.floor((F.col(b) + margin - 1) / CELL)))
    spread = rects.where("l < r and t < b").select("*", cells("l", "r").alias("cx")).select("*", cells("t", "b").alias("cy"))
    own = pixels_.select("img", "x", "y", "color", F.floor(F.col("x") / CELL).alias("cx"), F.floor(F.col("y") / CELL).alias("cy"))
    near = F.col("x").between(F.col("l") - margin, F.col("r") + margin - 1) & F.col("y").between(F.col("t") - margin, F.col("b") + margin - 1)
    return own.join(spread, ["img", "cx", "cy"]).where(near).drop("cx", "cy")


def autodetect_paint(pixels_: DataFrame, images: DataFrame, rects: DataFrame) -> DataFrame:
    """rect_id, flat, tl, tr, bl, br, background, foreground of each rect (rect_id, img, l, t, r, b) in pixels (img, x, y, color); images: img, width, height.

    Otsu's threshold parts paper and ink; the surroundings tell which is bright. Paper's colour at a corner is the mean of the pixels around it, outside the
    rect, that are as bright as paper mostly is; ink is the extreme twentieth of its side. A rect narrower than two pixels has the
    colour of its surroundings, one of an unknown image white, with a contrast for ink.
    """
    white, black = F.lit(WHITE).cast("long"), F.lit(BLACK).cast("long")
    known = rects.join(images.select("img", "width", "height"), "img", "left").withColumn("c", clamp_rect(*[F.col(c) for c in "ltrb"], F.col("width"), F.col("height")))
    held = known.where("c is not null").select("rect_id", "img", "c.*", "width", "height")
    inside = F.col("x").between(F.col("l"), F.col("r") - 1) & F.col("y").between(F.col("t"), F.col("b") - 1)
    near = around(pixels_, held, OUTSIDE).withColumns({"lum": luminance_byte(F.col("color")), "inside": inside})
    sums = lambda cond: [F.coalesce(F.sum(F.when(cond, channel(F.col("color"), k))), F.lit(0)).alias(c) for k, c in ((2, "r"), (1, "g"), (0, "b"))] + [F.count_if(cond).alias("n")]
    x, y = F.col("x"), F.col("y")
    beside = y.between(F.col("t"), F.col("b") - 1) & (x.between(F.col("l") - BESIDE, F.col("l") - 1) | x.between(F.col("r"), F.col("r") + BESIDE - 1))
    over = x.between(F.col("l"), F.col("r") - 1) & (y.between(F.col("t") - BESIDE, F.col("t") - 1) | y.between(F.col("b"), F.col("b") + BESIDE - 1))
    surround = near.groupBy("rect_id").agg(F.struct(*sums(beside | over)).alias("s")).select("rect_id", F.coalesce(mean_color(*[F.col(f"s.{c}") for c in "rgbn"]), white).alias("surround"))
    # one row for each brightness of a rect: all that follows on ink needs no pixel again
    levels = near.where("inside").groupBy("rect_id", "lum").agg(*[F.sum(channel(F.col("color"), k)).alias(c) for k, c in ((2, "r"), (1, "g"), (0, "b"))], F.count(F.lit(1)).alias("n"))
    threshold = otsu_threshold(near.where("inside").select("rect_id", "lum"), "rect_id", "lum")
    base = threshold.join(surround, "rect_id").withColumn("bright", luminance_byte(F.col("surround")) > F.col("threshold"))
    met = levels.join(base, "rect_id")
    paper_side = F.when(F.col("bright"), F.col("lum") > F.col("threshold")).otherwise(F.col("lum") <= F.col("threshold"))
    middle = F.when(F.col("bright"), F.floor((F.col("threshold") + 1 + 255) / 2)).otherwise(F.floor(F.col("threshold") / 2)).cast("int")
    found = met.groupBy("rect_id", "threshold", "surround", "bright").agg(F.min(F.when(paper_side, F.struct(-F.col("n"), "lum"))).alias("p"), F.array_sort(F.collect_list(F.when(~paper_side, F.struct(F.when(F.col("bright"), F.col("lum")).otherwise(-F.col("lum")).alias("key"), "lum", "r", "g", "b", "n")))).alias("ink"))
    # the ink's levels from its extreme on, until a twentieth of it is reached
    goal = F.greatest(F.lit(1).cast("long"), F.floor(F.aggregate("ink", F.lit(0).cast("long"), lambda a, v: a + v["n"]) / 20))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in "rgbn"])
    take = lambda a, v: F.when(a["n"] < F.col("goal"), F.struct(*[(a[c] + v[c]).alias(c) for c in "rgbn"])).otherwise(a)
    found = found.withColumn("goal", goal).withColumn("i", F.aggregate("ink", zero, take))
    ink = F.coalesce(mean_color(*[F.col(f"i.{c}") for c in "rgbn"]), F.when(F.col("bright"), black).otherwise(white))
    found = found.select("rect_id", "surround", F.coalesce("p.lum", middle).alias("peak"), ink.alias("foreground"))
    left = x.between(F.col("l") - OUTSIDE, F.least(F.col("l") + ALONG, F.col("r")) - 1)
    right = x.between(F.greatest(F.col("r") - ALONG, F.col("l")), F.least(F.col("r") + OUTSIDE, F.col("width")) - 1)
    top = y.between(F.col("t") - OUTSIDE, F.least(F.col("t") + ALONG, F.col("b")) - 1)
    bottom = y.between(F.greatest(F.col("b") - ALONG, F.col("t")), F.least(F.col("b") + OUTSIDE, F.col("height")) - 1)
    paper = near.where("not inside").join(found.select("rect_id", "peak"), "rect_id").where(F.abs(F.col("lum") - F.col("peak")) <= BAND)
    corners = paper.groupBy("rect_id").agg(*[F.struct(*sums(c)).alias(k) for k, c in (("tl", left & top), ("tr", right & top), ("bl", left & bottom), ("br", right & bottom))])
    out = held.where("r - l >= 2 and b - t >= 2").select("rect_id").join(found, "rect_id").join(corners, "rect_id", "left")
    out = out.select("rect_id", "foreground", *[F.coalesce(mean_color(*[F.col(f"{k}.{c}") for c in "rgbn"]), F.col("surround")).alias(k) for k in ("tl", "tr", "bl", "br")])
    four = [F.col(k) for k in ("tl", "tr", "bl", "br")]
    out = out.withColumn("background", corner_mean(four))
    flat = F.greatest(*[max_channel_delta(c, F.col("background")) for c in four]) <= FLAT_DELTA
    wide = out.select("rect_id", flat.alias("flat"), *[F.when(flat, F.col("background")).otherwise(c).alias(k) for k, c in zip(("tl", "tr", "bl", "br"), four)], "background", "foreground")
    rest = known.join(wide.select("rect_id"), "rect_id", "left_anti").join(surround, "rect_id", "left").select("rect_id", F.when(F.col("c").isNull(), white).otherwise(F.coalesce("surround", white)).alias("bg"))
    return wide.unionByName(rest.select("rect_id", F.lit(True).alias("flat"), *[F.col("bg").alias(k) for k in ("tl", "tr", "bl", "br", "background")], F.when(luminance(F.col("bg")) > 0.5, black).otherwise(white).alias("foreground")))


def region_paint(mode: str, pixels_: DataFrame, images: DataFrame, rects: DataFrame) -> DataFrame:
    """Like ``autodetect_paint``; the modes ``black_on_white`` and ``white_on_black`` don't look at the pixels."""
    fixed = {"black_on_white": (WHITE, BLACK), "white_on_black": (BLACK, WHITE)}
    if mode not in fixed:
        return autodetect_paint(pixels_, images, rects)
    paper, ink = (F.lit(c).cast("long") for c in fixed[mode])
    return rects.select("rect_id", F.lit(True).alias("flat"), *[paper.alias(k) for k in ("tl", "tr", "bl", "br", "background")], ink.alias("foreground"))


def prepare_overlay(lines: DataFrame, translated: DataFrame, pixels_: DataFrame, images: DataFrame, mode: str = "auto", vertical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(blocks, fills) of lines (img, block, line, text, l, t, r, b) and translated (img, block, translated).

    blocks: img, block, source, translated, l, t, r, b, background, foreground, lines: those of the first line, or of the whole block where text runs
    down. fills: what ``raster.bilinear_fill`` paints over the old text. Colours are those of the image as it came, also where regions touch.
    """
    keys = ["img", "block"] if vertical else ["img", "block", "line"]
    boxes = lines.groupBy(*keys).agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")).withColumn("rect_id", F.struct(*keys))
    paint = region_paint(mode, pixels_, images, boxes.select("rect_id", "img", "l", "t", "r", "b"))
    painted = boxes.join(paint, "rect_id")
    fills = painted.select("img", "rect_id", "l", "t", "r", "b", "tl", "tr", "bl", "br")
    colors = painted.select(*keys, "background", "foreground")
    met = lines.join(colors, keys)
    entry = F.struct("line", "text", "l", "t", "r", "b", "background", "foreground")
    by = met.groupBy("img", "block").agg(F.array_sort(F.collect_list(entry)).alias("lines"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))
    first = F.get("lines", F.lit(0))
    blocks = by.join(translated, ["img", "block"], "left").select("img", "block", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("source"), "translated", "l", "t", "r", "b", first["background"].alias("background"), first["foreground"].alias("foreground"), "lines")
    return blocks, fills
