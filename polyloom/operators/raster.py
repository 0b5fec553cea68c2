"""Pixels as rows: brightness, threshold, colours around a region, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel(argb: Column, k: int) -> Column:
    """0 blue, 1 green, 2 red, 3 alpha of a colour in a long."""
    return F.shiftright(argb, 8 * k).bitwiseAND(F.lit(255))


def argb(r: Column, g: Column, b: Column) -> Column:
    """An opaque colour."""
    return F.lit(0xFF000000).cast("long") + r.cast("long") * 65536 + g.cast("long") * 256 + b.cast("long")


def luminance(color: Column) -> Column:
    """From 0 to 1."""
    return 0.299 * (channel(color, 2) / 255.0) + 0.587 * (channel(color, 1) / 255.0) + 0.114 * (channel(color, 0) / 255.0)


def luminance_byte(color: Column) -> Column:
    return F.least(F.lit(255), F.shiftright(29 * channel(color, 0) + 150 * channel(color, 1) + 77 * channel(color, 2), 8).cast("int"))


def otsu_threshold(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, threshold: the level from 0 to 255 that best separates the values of each key; the lowest of equal ones, 127 if all values are equal.

    One aggregation to at most 256 rows for each key; the cumulative sums run over those.
    """
    h = values.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy(key).orderBy("t"), Window.partitionBy(key)
    h = h.select(key, "t", F.sum("n").over(upto).alias("below"), F.sum(F.col("t") * F.col("n")).over(upto).alias("low"), F.sum("n").over(whole).alias("all"), F.sum(F.col("t") * F.col("n")).over(whole).alias("sum"))
    above = F.col("all") - F.col("below")
    gap = F.col("low") / F.col("below") - (F.col("sum") - F.col("low")) / F.nullif(above, F.lit(0).cast("long"))
    spread = F.when(above > 0, F.col("below") * above * gap * gap)
    best = h.withColumn("spread", spread).groupBy(key).agg(F.min(F.when(F.col("spread").isNotNull(), F.struct(-F.col("spread"), F.col("t").alias("t")))).alias("best"))
    return best.select(key, F.coalesce(F.col("best.t"), F.lit(127).cast("long")).cast("int").alias("threshold"))


def surrounding_color(pixels: DataFrame, rects: DataFrame, margin: int = 4) -> DataFrame:
    """rect_id, color: the mean of the pixels (img, x, y, color) in bands beside, above and below each rect (rect_id, img, l, t, r, b); white if there are none."""
    x, y = F.col("x"), F.col("y")
    beside = y.between(F.col("t"), F.col("b") - 1) & (x.between(F.col("l") - margin, F.col("l") - 1) | x.between(F.col("r"), F.col("r") + margin - 1))
    over = x.between(F.col("l"), F.col("r") - 1) & (y.between(F.col("t") - margin, F.col("t") - 1) | y.between(F.col("b"), F.col("b") + margin - 1))
    mean = lambda k: F.floor(F.sum(channel(F.col("color"), k)) / F.count(F.lit(1)))
    got = rects.join(pixels, "img").where(beside | over).groupBy("rect_id").agg(argb(mean(2), mean(1), mean(0)).alias("color"))
    return rects.select("rect_id").join(got, "rect_id", "left").select("rect_id", F.coalesce("color", F.lit(0xFFFFFFFF).cast("long")).alias("color"))


def bilinear_fill(rects: DataFrame) -> DataFrame:
    """rect_id, x, y, color of all pixels of each rect (rect_id, l, t, r, b) between its corner colours tl, tr, bl, br."""
    grid = rects.where("r > l and b > t").select("*", F.explode(F.sequence(F.col("t"), F.col("b") - 1)).alias("y")).select("*", F.explode(F.sequence(F.col("l"), F.col("r") - 1)).alias("x"))
    v = (F.col("y") - F.col("t")) / F.greatest(F.col("b") - F.col("t") - 1, F.lit(1))
    u = (F.col("x") - F.col("l")) / F.greatest(F.col("r") - F.col("l") - 1, F.lit(1))

    def at(k: int) -> Column:
        tl, tr, bl, br = (channel(F.col(c), k) for c in ("tl", "tr", "bl", "br"))
        left, right = tl + (bl - tl) * v, tr + (br - tr) * v
        return F.floor(F.least(F.greatest(left + (right - left) * u, F.lit(0.0)), F.lit(255.0)))

    return grid.select("rect_id", "x", "y", argb(at(2), at(1), at(0)).alias("color"))


def overlay_colors(mode: Column, background: Column) -> Column:
    """struct(background, foreground): fixed modes, else the sampled background with a contrasting foreground."""
    black, white = F.lit(0xFF000000).cast("long"), F.lit(0xFFFFFFFF).cast("long")
    pair = lambda bg, fg: F.struct(bg.alias("background"), fg.alias("foreground"))
    return F.when(mode == "black_on_white", pair(white, black)).when(mode == "white_on_black", pair(black, white)).otherwise(pair(background, F.when(luminance(background) > 0.5, black).otherwise(white)))


def real_background(color: Column) -> Column:
    """The colour, if it is one: not unset, white or transparent."""
    return F.when(~color.isin(0, 1, 0xFFFFFFFF) & (channel(color, 3) != 0), color)


def block_colors(mode: Column, sampled: Column, style_bg: Column, style_fg: Column) -> Column:
    """struct(background, foreground) of a block. sampled: such a struct from a screenshot, or null.

    Without a screenshot a fixed mode decides. Else the style's background, then the sampled one, then a contrast to the style's foreground; the
    style's foreground goes before the sampled one.
    """
    black, white = F.lit(0xFF000000).cast("long"), F.lit(0xFFFFFFFF).cast("long")
    pair = lambda bg, fg: F.struct(bg.alias("background"), fg.alias("foreground"))
    bg, fg = real_background(style_bg), F.when(channel(style_fg, 3) != 0, style_fg)
    fixed = F.when(sampled.isNull() & (mode == "white_on_black"), pair(black, white)).when(sampled.isNull() & (mode == "black_on_white"), pair(white, black))
    return fixed.when(bg.isNotNull(), pair(bg, F.coalesce(fg, sampled["foreground"], black))).when(sampled.isNotNull(), pair(sampled["background"], F.coalesce(fg, sampled["foreground"]))).when(fg.isNotNull(), pair(F.when(luminance(fg) > 0.5, black).otherwise(white), fg)).otherwise(pair(white, black))
