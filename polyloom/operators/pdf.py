"""Pages of characters, operators, fonts and rectangles as rows: styles, hits, widths, and text fitted into what it replaces."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyloom.operators.layout import font_style, math_kind, nearest_rects, opaque_runs, skip_line, wrap_widths
from polyloom.plans.folds import fold_groups

BLACK = 0xFF000000
EPS = 1e-4

# ---- characters ----


def style_runs(chars: DataFrame, blank: Column | None = None) -> DataFrame:
    """line, run, text, style, l, t, r, b from chars (line, ord, c, x, style, and the line's l, t, r, b).

    A run ends where a character that isn't blank has another style than the last such one; blanks have no style of their own. It reaches
    from its first character to the next run's, the last one to the line's end. A line of blanks is one run without a style. Blank is what
    ``blank`` says, white space if it is not given.
    """
    order = Window.partitionBy("line").orderBy("ord")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(~(F.col("c").rlike(r"\p{IsWhite_Space}") if blank is None else blank), F.struct("style"))
    last = F.last(seen, ignorenulls=True).over(past)
    begins = (seen.isNotNull() & last.isNotNull() & ~seen["style"].eqNullSafe(last["style"])).cast("int")
    runs = chars.withColumn("seen", seen).withColumn("begins", begins).withColumn("run", F.sum("begins").over(order).cast("int"))
    by = runs.groupBy("line", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "c"))), lambda x: x["c"]), "").alias("text"), F.min(F.when(F.col("seen").isNotNull(), F.struct("ord", "style"))).alias("s"), F.min(F.struct("ord", "x"))["x"].alias("x"), *[F.first(k).alias(k) for k in "ltrb"])
    nxt = F.lead("x").over(Window.partitionBy("line").orderBy("run"))
    return by.select("line", "run", "text", F.col("s.style").alias("style"), F.col("x").cast("int").alias("l"), "t", F.ceil(F.coalesce(nxt, F.col("r").cast("double"))).cast("int").alias("r"), "b")


def page_fragments(chars: DataFrame, width: int) -> DataFrame:
    """page, ord, text, style, l, t, r, b, opaque, group of the fragments of pages, from chars (page, block, line, ord, c, x, font, style, l, t, r, b).

    Lines are classed by their fonts; a run of lines with formulas is opaque; lines that stay verbatim are left out; the others are cut where the style
    changes. The group grows by one wherever the block changes or opaque text begins or ends.
    """
    keyed = chars.withColumn("at", F.struct("page", "block"))
    kinds = opaque_runs(math_kind(keyed.select(F.col("at").alias("block"), "line", "c", "font")), "block", "line").select(F.col("block").alias("at"), "line", "opaque")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "c"))), lambda x: x["c"]), "")
    lines = keyed.groupBy("at", "line").agg(text.alias("text"), F.first("l").alias("l"), F.first("r").alias("r"))
    kept = lines.join(kinds, ["at", "line"], "left").withColumn("opaque", F.coalesce("opaque", F.lit(False))).where(F.col("opaque") | ~skip_line(F.col("text"), F.col("l"), F.col("r"), F.lit(width))).select("at", "line", "opaque")
    runs = style_runs(keyed.join(kept.select("at", "line"), ["at", "line"], "left_semi").withColumn("line", F.struct("at", "line")))
    met = runs.select(F.col("line.at").alias("at"), F.col("line.line").alias("line"), "run", "text", "style", *"ltrb").join(kept, ["at", "line"])
    order = Window.partitionBy("at.page").orderBy("at", "line", "run")
    change = F.coalesce((F.lag("at").over(order) != F.col("at")) | (F.lag("opaque").over(order) != F.col("opaque")), F.lit(False))
    out = met.withColumn("change", change.cast("int"))
    return out.select(F.col("at.page").alias("page"), (F.row_number().over(order) - 1).alias("ord"), "text", "style", *"ltrb", "opaque", F.sum("change").over(order).cast("int").alias("group"))


def outer_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(l, t, r, b) of whole numbers around a rectangle, not below zero."""
    down, up = (lambda c: F.floor(F.greatest(c, F.lit(0.0))).cast("int")), (lambda c: F.ceil(F.greatest(c, F.lit(0.0))).cast("int"))
    return F.struct(down(x0).alias("l"), down(y0).alias("t"), up(x1).alias("r"), up(y1).alias("b"))


def letterbox(width: Column, height: Column, size: Column) -> Column:
    """struct(scale, pad_x, pad_y) with which a page fills a square of ``size`` pixels, in the middle."""
    scale = F.least(size / width, size / height)
    return F.struct(scale.alias("scale"), ((size - width * scale) * 0.5).alias("pad_x"), ((size - height * scale) * 0.5).alias("pad_y"))


# ---- geometry ----


def user_rect(rotation: Column, l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1) on the page itself of a rectangle as shown, after a rotation by 0, 90, 180 or 270 degrees; the page begins at (0, 0)."""
    four = lambda a, b_, c, d: F.struct(F.least(a, b_).cast("double").alias("x0"), F.least(c, d).cast("double").alias("y0"), F.greatest(a, b_).cast("double").alias("x1"), F.greatest(c, d).cast("double").alias("y1"))
    return F.when(rotation == 90, four(t, b, l, r)).when(rotation == 180, four(width - r, width - l, t, b)).when(rotation == 270, four(width - b, width - t, height - r, height - l)).otherwise(four(l, r, height - b, height - t))


def _on(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (px >= F.least(ax, bx) - EPS) & (px <= F.greatest(ax, bx) + EPS) & (py >= F.least(ay, by) - EPS) & (py <= F.greatest(ay, by) + EPS)


def segments_meet(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether two segments have a point in common, within ``EPS``."""
    cross = lambda ox, oy, px, py, qx, qy: (px - ox) * (qy - oy) - (py - oy) * (qx - ox)
    d1, d2 = cross(ax, ay, bx, by, cx, cy), cross(ax, ay, bx, by, dx, dy)
    d3, d4 = cross(cx, cy, dx, dy, ax, ay), cross(cx, cy, dx, dy, bx, by)
    flat = lambda d, px, py, *s: (F.abs(d) <= EPS) & _on(px, py, *s)
    a, c = (ax, ay, bx, by), (cx, cy, dx, dy)
    return flat(d1, cx, cy, *a) | flat(d2, dx, dy, *a) | flat(d3, ax, ay, *c) | flat(d4, bx, by, *c) | (((d1 > 0) != (d2 > 0)) & ((d3 > 0) != (d4 > 0)))


def segment_meets_rect(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a segment has an end in a rectangle or crosses one of its sides."""
    inside = lambda x, y: x.between(x0, x1) & y.between(y0, y1)
    sides = ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))
    out = inside(ax, ay) | inside(bx, by)
    for s in sides:
        out = out | segments_meet(ax, ay, bx, by, *s)
    return out


def shows_hit(shows: DataFrame, rects: DataFrame, page: str) -> DataFrame:
    """page, show, rect: for each piece of text (page, show, x, y to end_x, end_y) the rect (page, rect, x0, y0, x1, y1) that it touches with the nearest left edge; of equal ones the least id."""
    place = ["x", "y", "end_x", "end_y"]
    near = (F.least("x", "end_x") <= F.col("x1") + EPS) & (F.greatest("x", "end_x") >= F.col("x0") - EPS)
    return nearest_rects(shows, rects, page, "show", place, near & segment_meets_rect(*[F.col(c) for c in (*place, "x0", "y0", "x1", "y1")]))


def replaced_ops(ops: DataFrame, hits: DataFrame, page: str) -> DataFrame:
    """``ops`` (page, show and others) with action: ``advance`` (the text goes, its advance stays) where ``hits`` has the show, else ``keep``."""
    return ops.join(hits.select(page, "show", "rect"), [page, "show"], "left").withColumn("action", F.when(F.col("rect").isNull(), "keep").otherwise("advance"))


def block_styles(samples: DataFrame, key: str, rects: DataFrame | None = None) -> DataFrame:
    """key, font, r, g, b, size, x, y, n from samples (key, font, r, g, b, size, x, y from the top).

    The most frequent font (of equal ones the least), the mean colour, the size at half of the sorted ones, and the topmost and then leftmost place; its
    x is the least left edge among the block's ``rects`` (key, x0), if it has any.
    """
    by = samples.groupBy(key).agg(F.mode("font", True).alias("font"), *[F.avg(c).alias(c) for c in "rgb"], F.sort_array(F.collect_list("size")).alias("sizes"), F.min(F.struct("y", "x")).alias("top"), F.count(F.lit(1)).alias("n"))
    left = by.select(key, F.lit(None).cast("double").alias("left")) if rects is None else rects.groupBy(key).agg(F.min("x0").alias("left"))
    return by.join(left, key, "left").select(key, "font", "r", "g", "b", F.element_at("sizes", (F.floor(F.size("sizes") / 2) + 1).cast("int")).alias("size"), F.coalesce("left", "top.x").alias("x"), F.col("top.y").alias("y"), "n")


# ---- fonts ----


def string_widths(strings: DataFrame, widths: DataFrame, defaults: DataFrame) -> DataFrame:
    """id, width, glyphs, spaces of strings (id, font, codes) in thousandths, from widths (font, code, width) and defaults (font, default_width); 500 for an unknown font."""
    codes = strings.select("id", "font", F.explode_outer("codes").alias("code"))
    met = codes.join(widths, ["font", "code"], "left").join(defaults, "font", "left")
    each = F.when(F.col("code").isNotNull(), F.coalesce("width", "default_width", F.lit(500.0))).otherwise(0.0)
    return met.groupBy("id").agg(F.sum(each).alias("width"), F.count("code").alias("glyphs"), F.count_if(F.col("code") == 32).alias("spaces"))


def show_advance(width: Column, glyphs: Column, spaces: Column, adjusted: Column, size: Column, char_spacing: Column, word_spacing: Column, scaling: Column) -> Column:
    """How far a piece of text moves the pen: widths and adjustments in thousandths of the size, spacing for each sign and each blank, all of it stretched."""
    return ((width - adjusted) * size / 1000 + char_spacing * glyphs + word_spacing * spaces) * scaling


def is_text_show(op: Column) -> Column:
    return op.isin("Tj", "TJ", "'", '"')


Matrix = tuple[float, float, float, float, float, float]
_ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _after(m: Matrix, n: Matrix) -> Matrix:
    """``m`` first, then ``n``."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def shows_of(ops: list[dict]) -> list[dict]:
    """Where each piece of text of one page is shown, from its operators in order (op, nums, name, width, glyphs, spaces, adjusted)."""
    ctm, fill, font, stack = _ONE, (0.0, 0.0, 0.0), None, []
    text = line = _ONE
    size, chars, words, scaling, leading = 0.0, 0.0, 0.0, 1.0, 0.0
    out = []

    def move(x: float, y: float) -> None:
        nonlocal text, line
        text = line = _after((1.0, 0.0, 0.0, 1.0, x, y), line)

    for o in ops:
        op, n = o["op"], list(o["nums"] or [])
        if op == "q":
            stack.append((ctm, fill, font))
        elif op == "Q" and stack:
            ctm, fill, font = stack.pop()
        elif op == "cm" and len(n) >= 6:
            ctm = _after(tuple(n[:6]), ctm)
        elif op == "BT":
            text = line = _ONE
        elif op == "Tf":
            font, size = o["name"] or font, n[0] if n else size
        elif op in ("Tc", "Tw", "Tz", "TL") and n:
            chars, words, scaling, leading = n[0] if op == "Tc" else chars, n[0] if op == "Tw" else words, n[0] / 100 if op == "Tz" else scaling, n[0] if op == "TL" else leading
        elif op == "rg" and len(n) >= 3:
            fill = tuple(n[:3])
        elif op == "g" and n:
            fill = (n[0],) * 3
        elif op == "k" and len(n) >= 4:
            fill = tuple((1 - v) * (1 - n[3]) for v in n[:3])
        elif op == "Tm" and len(n) >= 6:
            text = line = tuple(n[:6])
        elif op in ("Td", "TD") and len(n) >= 2:
            move(n[0], n[1])
            leading = -n[1] if op == "TD" else leading
        elif op == "T*":
            move(0.0, -leading)
        elif op in ("Tj", "TJ", "'", '"'):
            if op == '"' and len(n) >= 2:
                words, chars = n[0], n[1]
            if op in ("'", '"'):
                move(0.0, -leading)
            go = ((o["width"] or 0.0) - (o["adjusted"] or 0.0)) * size / 1000 + chars * (o["glyphs"] or 0) + words * (o["spaces"] or 0)
            go *= scaling
            m = _after(text, ctm)
            end = (m[0] * go + m[4], m[1] * go + m[5])
            out.append({"ord": o["ord"], "x": m[4], "y": m[5], "end_x": end[0], "end_y": end[1], "advance": go, "font": font, "size": size, "r": fill[0], "g": fill[1], "b": fill[2]})
            text = _after((1.0, 0.0, 0.0, 1.0, go, 0.0), text)
    return out


def text_shows(ops: DataFrame) -> DataFrame:
    """page, ord, x, y, end_x, end_y, advance, font, size, r, g, b of each text operator of ops (page, ord, op, nums, name, width, glyphs, spaces, adjusted), a page at a time.

    What ``string_widths`` says of an operator's strings is joined before: the fold only keeps the state that operators leave behind.
    """
    return fold_groups(ops, "page", ["op", "nums", "name", "width", "glyphs", "spaces", "adjusted"], ["ord"], shows_of, "ord int, x double, y double, end_x double, end_y double, advance double, font string, size double, r double, g double, b double")


def font_flags(name: Column, flags: Column) -> Column:
    """struct(bold, italic, monospace) from a font's name or from its flags (bits 18, 6 and 0), whichever says so."""
    bit = lambda k: F.coalesce(F.shiftright(flags, k).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    by_name = font_style(F.coalesce(name, F.lit("")))
    return F.struct((bit(18) | by_name["bold"]).alias("bold"), (bit(6) | by_name["italic"]).alias("italic"), (bit(0) | by_name["monospace"]).alias("monospace"))


def descriptor_flags(bold: Column, italic: Column, monospace: Column) -> Column:
    """The flags to write for a font of letters."""
    on = lambda c, k: F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    return on(monospace, 0) + F.lit(1 << 5) + on(italic, 6) + on(bold, 18)


def subset_tag(slot: Column) -> Column:
    """Six letters for the number of an embedded font, the lowest digit first."""
    return F.concat(*[F.char(F.lit(65) + F.floor(slot / 26**k) % 26) for k in range(6)])


def width_units(advance: Column, units_per_em: Column) -> Column:
    """An advance in thousandths of the size."""
    return F.round(advance * 1000.0 / units_per_em).cast("long")


def used_glyphs(texts: DataFrame, glyphs: DataFrame, font: str) -> DataFrame:
    """font, gid, c, advance of the glyphs (font, c, gid, advance) that the texts (font, text) of each font need; one sign for each glyph, the least."""
    need = texts.select(font, F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct()
    return need.join(glyphs, [font, "c"]).groupBy(font, "gid").agg(F.min("c").alias("c"), F.min("advance").alias("advance"))


def unicode_map(glyphs: DataFrame, font: str) -> DataFrame:
    """font, entries, chunks: lines ``<gid> <utf16>`` for a map from glyphs to signs, and how many sections of at most 100 they take."""
    line = F.concat(F.lit("<"), F.lpad(F.hex("gid"), 4, "0"), F.lit("> <"), F.hex(F.encode("c", "UTF-16BE")), F.lit(">"))
    by = glyphs.groupBy(font).agg(F.array_sort(F.collect_list(F.struct("gid", line.alias("line")))).alias("x"))
    return by.select(font, F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("entries"), F.ceil(F.size("x") / 100).cast("int").alias("chunks"))


def measured(texts: DataFrame, glyphs: DataFrame, metrics: DataFrame, font: str) -> DataFrame:
    """id, width of texts (id, font, text, size) from glyphs (font, c, advance) and metrics (font, units_per_em, fallback, em): without units, signs times size times em."""
    signs = texts.select("id", font, "size", F.explode_outer(F.filter(F.split("text", ""), lambda c: c != "")).alias("c")).groupBy("id", font, "size", "c").agg(F.count("c").alias("n"))
    met = signs.join(metrics, font, "left").join(glyphs.select(font, "c", "advance"), [font, "c"], "left")
    each = F.when(F.col("units_per_em").isNull(), F.col("n") * F.col("size") * F.coalesce("em", F.lit(0.5))).otherwise(F.col("n") * F.coalesce("advance", "fallback") * F.col("size") / F.col("units_per_em"))
    return met.groupBy("id").agg(F.coalesce(F.sum(each), F.lit(0.0)).alias("width"))


def font_for_flags(wanted: DataFrame, fonts: DataFrame) -> DataFrame:
    """id, font of wanted (id, bold, italic) among fonts (ord, bold, italic, font): the exact one, else a regular one, else the first."""
    pick = lambda cond: F.min(F.when(cond, F.struct("ord", "font")))["font"]
    f = fonts.select("ord", "font", F.col("bold").alias("fb"), F.col("italic").alias("fi"))
    table = f.agg(*[pick((F.col("fb") == b) & (F.col("fi") == i)).alias(f"f{int(b)}{int(i)}") for b in (False, True) for i in (False, True)], F.min(F.struct("ord", "font"))["font"].alias("any"))
    # one row, whatever the number of fonts
    four = F.create_map(*[x for b in "01" for i in "01" for x in (F.lit(b + i), F.col(f"f{b}{i}"))])
    one = table.select(F.struct(four.alias("m"), F.coalesce("f00", "any").alias("rest")).alias("t"))
    key = F.concat(F.col("bold").cast("int").cast("string"), F.col("italic").cast("int").cast("string"))
    return wanted.select("id", key.alias("k"), one.scalar().alias("t")).select("id", F.coalesce(F.try_element_at("t.m", F.col("k")), F.col("t.rest")).alias("font"))


def unused_fonts(installed: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """The fonts of each page that none of its operators names."""
    return installed.join(used.select(*keys).distinct(), keys, "left_anti")


def located(fonts: DataFrame, locate: Callable[[str], str | None], name: str = "font") -> DataFrame:
    """``fonts`` with path by a callable that knows where fonts are; each distinct name is asked once, one that isn't known has null."""

    @F.pandas_udf("string")
    def find(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else locate(n))

    return fonts.join(fonts.select(name).distinct().withColumn("path", find(name)), name, "left")


# ---- text to write ----


def wrap_to_fit(text: str, widths: list[float], height: float, size: float, em: float, tries: int = 6, leading: float = 1.15, shrink: float = 0.85, least: float = 4.0) -> tuple[float, list[str]]:
    """(size, lines): the text wrapped at a size that shrinks until its lines fit the height, or that is the least, or the tries are used up."""
    for _ in range(tries):
        lines = wrap_widths(text, widths, size, em)
        if size * leading * len(lines) <= height or size <= least:
            return size, lines
        size *= shrink
    size = max(size, least)
    return size, wrap_widths(text, widths, size, em)


def wrapped(em: float):
    """``wrap_to_fit`` on columns: text, widths, height, size."""

    @F.pandas_udf("struct<size:double,lines:array<string>>")
    def run(text: pd.Series, widths: pd.Series, height: pd.Series, size: pd.Series) -> pd.DataFrame:
        got = [wrap_to_fit(t, list(w), h, s, em) for t, w, h, s in zip(text, widths, height, size)]
        return pd.DataFrame({"size": [g[0] for g in got], "lines": [g[1] for g in got]})

    return run


CLOSING = ",.)]}:;?!"


def styled_words(words: DataFrame) -> DataFrame:
    """line, seg, text, style from the styled characters of lines: words (line, word, ord, c, style), in order.

    A word is cut where letters or digits meet other signs. The style of a part of letters is that of most of its characters (of equal ones
    the first's), of other parts that of the first. Neighbours of one style are one segment; a blank between words stays with the one before, and none comes before closing punctuation.
    """
    order = Window.partitionBy("line").orderBy("word", "ord")
    alpha = F.col("c").rlike(r"[\p{L}\p{N}]")
    new = F.coalesce((F.lag("word").over(order) != F.col("word")) | (F.lag("alpha").over(order) != F.col("alpha")), F.lit(True))
    parts = words.withColumn("alpha", alpha).withColumn("new", new).withColumn("part", F.sum(F.col("new").cast("int")).over(order))
    votes = parts.groupBy("line", "part", "alpha", "word", "style").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = votes.groupBy("line", "part", "word").agg(F.min(F.struct(F.when(F.col("alpha"), -F.col("n")).otherwise(F.lit(0).cast("long")), "first", "style"))["style"].alias("style"))
    text = parts.groupBy("line", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "c"))), lambda x: x["c"]), "").alias("text"))
    by_part = Window.partitionBy("line").orderBy("part")
    met = best.join(text, ["line", "part"])
    gap = F.coalesce((F.lag("word").over(by_part) != F.col("word")) & ~F.substring("text", 1, 1).isin(*CLOSING), F.lit(False))
    # the blank belongs to the part before it
    met = met.withColumn("gap", gap).withColumn("text", F.concat("text", F.when(F.coalesce(F.lead("gap").over(by_part), F.lit(False)), " ").otherwise("")))
    change = F.lag("part").over(by_part).isNotNull() & ~F.lag("style").over(by_part).eqNullSafe(F.col("style"))
    runs = met.withColumn("change", change.cast("int")).withColumn("seg", F.sum("change").over(by_part).cast("int"))
    return runs.groupBy("line", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"), F.first("style").alias("style"))


def following_obstacles(blocks: DataFrame, page: str) -> DataFrame:
    """page, block, obstacle_x: where what follows a block on its row begins; blocks (page, block, l, t, r, b, opaque) in order, places from the top.

    Only blocks not higher than 45 points have a row. Of those behind, the ones that begin right of it and touch its height count, up to the first that begins below it or isn't opaque.
    """

    def fold(rows: list[dict]) -> list[dict]:
        out = []
        for i, a in enumerate(rows):
            found = []
            for b in rows[i + 1 :] if a["b"] - a["t"] <= 45 else []:
                if b["t"] > a["b"] + 2:
                    break
                if b["b"] < a["t"] - 2 or b["l"] <= a["l"]:
                    continue
                found.append(b["l"])
                if not b["opaque"]:
                    break
            if found:
                out.append({"block": a["block"], "obstacle_x": min(found)})
        return out

    return fold_groups(blocks, page, ["l", "t", "r", "b", "opaque"], ["block"], fold, "block int, obstacle_x double")


def line_widths(anchors: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """key, line, width that a line has from its anchor to the right edge: anchors (key, line, x), boxes (key, right, fallback, first_x, obstacle_x).

    The first line may begin at first_x, the last ends before obstacle_x; none is wider than fallback or narrower than a quarter of it.
    """
    last = F.max("line").over(Window.partitionBy(key))
    met = anchors.withColumn("last", last).join(boxes, key)
    left = F.when((F.col("line") == 0) & F.col("first_x").isNotNull(), F.col("first_x")).otherwise(F.col("x"))
    right = F.when((F.col("line") == F.col("last")) & F.col("obstacle_x").isNotNull(), F.least("obstacle_x", "right")).otherwise(F.col("right"))
    return met.select(key, "line", F.least(F.greatest(right - left, F.col("fallback") * 0.25), F.col("fallback")).alias("width"))
