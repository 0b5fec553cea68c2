"""Positioned fragments to lines and blocks, one page at a time; rules on lines of a page; geometry."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyloom.plans.folds import fold_groups

FRAGMENTS = "page int, ord int, text string, l int, t int, r int, b int, style string, layout_group int, translation_group int, cluster_group int, opaque boolean"
_MARKERS, _BULLETS = "-–—•∙◦", "●•▪◦"


def looks_like_prose(text: str) -> bool:
    return len(text.split()) >= 4 or sum(c.isalpha() for c in text) >= 32 or any(c in text for c in ",.;:")


def _joined(frags: list[dict]) -> str:
    return " ".join(f["text"].strip() for f in frags)


def _same_line(block: list[dict], f: dict, height: int, gap: int) -> bool:
    if gap <= -(-height * 4 // 5):
        return True
    if gap > 3 * height:
        return False
    text, follows = _joined(block).strip(), f["text"].strip()
    if text and looks_like_prose(text):
        return True
    if len(text.encode()) <= 5 and re.fullmatch(r"[0-9.()]*", text) and any(c.isalpha() for c in follows):
        return gap <= height if text.isdigit() else True
    return False


def _clusters(frags: list[dict]) -> list[list[dict]]:
    """Greedy, in the given order: the first block on the same line takes a fragment, else the first one just above it."""
    heights = sorted(f["b"] - f["t"] for f in frags)
    height = max(1, heights[len(heights) // 4])
    blocks: list[tuple[list[dict], list[int], tuple]] = []
    fresh = False
    for f in frags:
        text = f["text"].strip()
        if text and all(c in _BULLETS for c in text) and f["r"] - f["l"] <= 2:
            fresh = True
            continue
        same = after = None
        for block, (l, t, r, b), groups in blocks if not fresh else []:
            if groups != (f["layout_group"], f["cluster_group"]):
                continue
            rows, cols = min(b, f["b"]) - max(t, f["t"]), min(r, f["r"]) - max(l, f["l"])
            if rows > 0 and _same_line(block, f, height, max(0, -cols)):
                same = block
                break
            wide = max(r - l, f["r"] - f["l"]) >= max(10 * height, 90)
            if after is None and max(0, f["t"] - b) <= height * 3 // 4 and cols > 0 and text[:1] not in set(_MARKERS) and wide and looks_like_prose(_joined(block)):
                after = block
        if same is None and after is None:
            blocks.append(([f], [f["l"], f["t"], f["r"], f["b"]], (f["layout_group"], f["cluster_group"])))
        else:
            chosen = after if same is None else same
            box = next(x[1] for x in blocks if x[0] is chosen)
            chosen.append(f)
            box[:] = [min(box[0], f["l"]), min(box[1], f["t"]), max(box[2], f["r"]), max(box[3], f["b"])]
        fresh = False
    return [b[0] for b in blocks]


def _lines(frags: list[dict]) -> list[list[dict]]:
    heights = sorted(f["b"] - f["t"] for f in frags)
    near = max(1, 0.35 * max(1, heights[len(heights) // 2]))
    lines: list[tuple[list[dict], list[int]]] = []
    for f in frags:
        for members, box in lines:
            if min(box[1], f["b"]) > max(box[0], f["t"]) or abs((box[0] + box[1]) / 2 - (f["t"] + f["b"]) / 2) <= near:
                members.append(f)
                box[:] = [min(box[0], f["t"]), max(box[1], f["b"])]
                break
        else:
            lines.append(([f], [f["t"], f["b"]]))
    return [sorted(m, key=lambda f: f["l"]) for m, _ in sorted(lines, key=lambda x: x[1][0])]


def _space(left: dict, right: dict) -> bool:
    a, b = left["text"], right["text"]
    if not a or not b or a[-1].isspace() or b[0].isspace() or b[0] in ",.)]}:;?!":
        return False
    return right["l"] - left["r"] > 1


def _line_text(line: list[dict]) -> str:
    return "".join((" " if i and _space(line[i - 1], f) else "") + f["text"] for i, f in enumerate(line))


def blocks_of(frags: list[dict]) -> list[dict]:
    """text, l, t, r, b, opaque, spans (start, end, style), segments (start, end, group) of each block of one page; positions in characters."""
    out = []
    for cluster in _clusters(frags) if frags else []:
        lines = _lines(cluster)
        cuts = [i + 1 for i in range(len(lines) - 1) if re.match(r"\d+\.\s", _line_text(lines[i]).strip()) and _line_text(lines[i]).strip()[-1] not in ".;:" and re.match(r"\d+\.\d", _line_text(lines[i + 1]).strip())]
        for a, b in zip([0, *cuts], [*cuts, len(lines)]):
            text, spans, segments, start = "", [], [], 0
            group = lines[a][0]["translation_group"]
            for n, line in enumerate(lines[a:b]):
                text += "\n" if n else ""
                for i, f in enumerate(line):
                    if f["translation_group"] != group:
                        segments += [(start, len(text), group)] * (len(text) > start)
                        group, start = f["translation_group"], len(text)
                    text += " " if i and _space(line[i - 1], f) else ""
                    at = len(text)
                    text += f["text"]
                    if f["style"] is not None:
                        spans.append((at, len(text), f["style"]))
            segments += [(start, len(text), group)] * (len(text) > start)
            parts = [f for line in lines[a:b] for f in line]
            for wrong in ("\u0338=", "\u0338 =", "=\u0338"):
                text = text.replace(wrong, "\u2260")
            out.append({"text": text, "l": min(f["l"] for f in parts), "t": min(f["t"] for f in parts), "r": max(f["r"] for f in parts), "b": max(f["b"] for f in parts), "opaque": all(f["opaque"] for f in parts), "spans": spans, "segments": segments})
    return out


def layout_blocks(fragments: DataFrame) -> DataFrame:
    """page, block, text, l, t, r, b, opaque, spans, segments from ``FRAGMENTS``, a page at a time."""
    def fold(rows: list[dict]) -> list[dict]:
        named = lambda keys, items: [dict(zip(keys, x)) for x in items]
        return [{**b, "block": i, "spans": named(("start", "end", "style"), b["spans"]), "segments": named(("start", "end", "group"), b["segments"])} for i, b in enumerate(blocks_of(rows))]

    columns = [c.split()[0] for c in FRAGMENTS.split(", ")][1:]
    return fold_groups(fragments, "page", columns, ["ord"], fold, "block int, text string, l int, t int, r int, b int, opaque boolean, spans array<struct<start:int,end:int,style:string>>, segments array<struct<start:int,end:int,group:int>>")


# ---- lines and fonts ----

MATH = ("CMBSY", "CMEX", "CMMI", "CMSY", "EUFM", "EUSM", "MSAM", "MSBM")
PLAIN = ("CMBX", "CMCSC", "CMFF", "CMFI", "CMITT", "CMR", "CMSL", "CMSS", "CMTEX", "CMTI", "CMTT", "CMU", "CMVTT")


def font_stem(name: Column) -> Column:
    """Without the tag of a subset."""
    return F.regexp_replace(name, r"^.*\+", "")


def font_class(name: Column) -> Column:
    """math, text or other."""
    stem = F.upper(font_stem(name))
    return F.when(stem.rlike("^(" + "|".join(MATH) + ")"), "math").when(stem.rlike("^(" + "|".join(PLAIN) + ")"), "text").otherwise("other")


def font_style(name: Column) -> Column:
    """struct(bold, italic, monospace) from a font's name."""
    low = F.lower(F.regexp_replace(name, r"^[^+]{6}\+", ""))
    words = {"bold": "bold|heavy|black", "italic": "italic|oblique", "monospace": "consolas|lucidaconsole|courier|firacode|fixedsys|hack|inconsolata|menlo|monaco|mono|sourcecodepro"}
    return F.struct(*[low.rlike(p).alias(k) for k, p in words.items()])


def math_kind(chars: DataFrame) -> DataFrame:
    """block, line, kind (Strong, Weak, Prose) from chars (block, line, c, font)."""
    seen = ~F.col("c").rlike(r"\p{IsWhite_Space}")
    cls = font_class(F.col("font"))
    by = chars.where(seen).groupBy("block", "line").agg(F.count_if(cls == "math").alias("m"), F.count_if(cls == "text").alias("t"), F.bool_or((F.col("c") == "�") & F.upper(font_stem(F.col("font"))).startswith("CMEX")).alias("stretch"))
    strong = F.col("stretch") | ((F.col("m") > 0) & (F.col("m") + F.col("t") >= 3) & (2 * F.col("m") >= F.col("m") + F.col("t")))
    return by.select("block", "line", F.when(strong, "Strong").when((F.col("m") > 0) & (F.col("t") == 0), "Weak").otherwise("Prose").alias("kind"))


def opaque_runs(lines: DataFrame, block: str, line: str) -> DataFrame:
    """``lines`` with opaque: whether the run of neighbouring lines that aren't Prose has a Strong one."""
    prose = F.col("kind") == "Prose"
    run = F.sum(prose.cast("int")).over(Window.partitionBy(block).orderBy(line))
    strong = F.bool_or(F.col("kind") == "Strong").over(Window.partitionBy(block, "run"))
    return lines.withColumn("run", run).withColumn("opaque", ~prose & strong).drop("run")


def skip_line(text: Column, left: Column, right: Column, width: Column) -> Column:
    """Whether a line stays verbatim: blank, or like a formula by symbols, underscores or centring; real words, ``;`` and dotted names veto."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    veto = text.contains(";") | text.rlike(r"[a-z]\.[a-z]") | (n(r"\p{L}{4,}") >= 2)
    words, symbols = n(r"[^\s\p{Z}]+"), n("[=<>∑Σσ≤≥→←↔]")
    centre = F.abs((left + right) / 2 - width / 2) < width * 0.05
    pads = (left + F.greatest(width - right, F.lit(0))) / 2
    even = (pads <= 0) | (F.abs(left - F.greatest(width - right, F.lit(0))) < pads * 0.3)
    formula = (centre & even & (symbols > 0) & (words <= 8)) | ((symbols >= 2) & (n(r"\p{L}") < 24)) | ((n("_") >= 2) & (words <= 8))
    return (words == 0) | (~veto & formula)


# ---- geometry ----


def matrix_mul(a: Column, b: Column) -> Column:
    """``a`` after ``b``, as arrays of six."""
    g = lambda m, i: F.get(m, F.lit(i))
    return F.array(g(b, 0) * g(a, 0) + g(b, 1) * g(a, 2), g(b, 0) * g(a, 1) + g(b, 1) * g(a, 3), g(b, 2) * g(a, 0) + g(b, 3) * g(a, 2), g(b, 2) * g(a, 1) + g(b, 3) * g(a, 3), g(b, 4) * g(a, 0) + g(b, 5) * g(a, 2) + g(a, 4), g(b, 4) * g(a, 1) + g(b, 5) * g(a, 3) + g(a, 5))


def transform(m: Column, x: Column, y: Column) -> Column:
    g = lambda i: F.get(m, F.lit(i))
    return F.struct((g(0) * x + g(2) * y + g(4)).alias("x"), (g(1) * x + g(3) * y + g(5)).alias("y"))


def inverse(m: Column) -> Column:
    """Null for a singular matrix."""
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    det = a * d - b * c
    return F.when(F.abs(det) >= 1e-9, F.array(d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det))


def to_display(rotation: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A point of the page as shown, from the top left, after a rotation by 0, 90, 180 or 270 degrees; width and height are those of the unrotated page."""
    pair = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.when(rotation == 90, pair(y, x)).when(rotation == 180, pair(width - x, y)).when(rotation == 270, pair(height - y, width - x)).otherwise(pair(x, height - y))


def quantiles(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, lower, upper_median, p75, mode: the elements at a quarter, a half and three quarters of the sorted values; of equal modes the least."""
    at = lambda q: F.element_at("v", (F.floor(F.size("v") * q) + 1).cast("int"))
    return values.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"), F.mode(value, True).alias("mode")).select(key, at(0.25).alias("lower"), at(0.5).alias("upper_median"), at(0.75).alias("p75"), "mode")


def wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, broken at spaces as late as can be; longer words stand alone. A fold in the JVM."""
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("lines"), F.lit(None).cast("string").alias("now"))

    def step(acc, word):
        longer = F.concat_ws(" ", acc["now"], word)
        fits = acc["now"].isNull() | (F.char_length(longer) <= width)
        return F.struct(F.when(fits, acc["lines"]).otherwise(F.array_append(acc["lines"], acc["now"])).alias("lines"), F.when(fits, longer).otherwise(word).alias("now"))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, zero, step, lambda a: F.when(a["now"].isNull(), a["lines"]).otherwise(F.array_append(a["lines"], a["now"])))


def nearest_rects(rows: DataFrame, rects: DataFrame, page: str, row: str, place: list[str], hit: Column) -> DataFrame:
    """page, row, rect: for each of ``rows`` (page, row, and ``place``, x among it) the rect (page, rect, x0, y0, x1, y1) with ``hit`` whose left edge is nearest to x; of equal ones the least id.

    Rects of one shape are one, that of the least id, and rows at one place are looked up once. So what meets are a page's places and shapes that differ,
    however often each occurs. Places and shapes that all differ still meet pair by pair on their page.
    """
    shapes = rects.groupBy(page, "x0", "y0", "x1", "y1").agg(F.min(F.struct("rect"))["rect"].alias("rect"))
    met = rows.select(page, *place).distinct().join(shapes, page).where(hit)
    best = met.groupBy(page, *place).agg(F.min(F.struct(F.abs(F.col("x") - F.col("x0")), "rect")).alias("best"))
    return rows.join(best, [page, *place]).groupBy(page, row).agg(F.min("best").alias("best")).select(page, row, F.col("best.rect").alias("rect"))


def rects_hit(marks: DataFrame, rects: DataFrame, page: str) -> DataFrame:
    """page, mark, rect: for each mark (page, mark, x, y) the rect (page, rect, x0, y0, x1, y1) around it with the nearest left edge; of equal ones the least id."""
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return nearest_rects(marks, rects, page, "mark", ["x", "y"], inside)


def prune_links(annotations: DataFrame, removed: DataFrame, page: str) -> DataFrame:
    """``annotations`` (page, subtype, x0, y0, x1, y1) without links that strictly overlap a removed rect (page, a0, b0, a1, b1). Links of one shape are one to look up, and so are rects."""
    shape = [page, "x0", "y0", "x1", "y1"]
    gone = (F.col("x0") < F.col("a1")) & (F.col("x1") > F.col("a0")) & (F.col("y0") < F.col("b1")) & (F.col("y1") > F.col("b0"))
    r = removed.select(F.col(page).alias("__page"), "a0", "b0", "a1", "b1").distinct()
    hit = annotations.where("subtype = 'Link'").select(shape).distinct().join(r, (F.col(page) == F.col("__page")) & gone, "left_semi")
    pruned = hit.select(*[F.col(c).alias(f"__{c}") for c in shape], F.lit("Link").alias("__subtype"))
    return annotations.join(pruned, [F.col(c) == F.col(f"__{c}") for c in (*shape, "subtype")], "left_anti")


# ---- lines to write on ----


def baseline_threshold(sizes: list[float]) -> float:
    good = sorted(s for s in sizes if 0 < s < float("inf"))
    return max(1.0, 0.55 * good[len(good) // 2]) if good else 1.0


def anchors(samples: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Where the lines of a block begin, from samples (x, y from the top, font size) of its old text, top to bottom.

    A line takes what lies within the threshold of its first sample; of three lines and more, those nearer than half of the usual gap
    (the one at three quarters of the sorted gaps) are one, so that a raised or lowered sign has no line of its own.
    """
    least = baseline_threshold([s[2] for s in samples])
    lines: list[list[tuple[float, float]]] = []
    for y, x in sorted((y, x) for x, y, _ in samples):
        if not lines or y - lines[-1][0][0] >= least:
            lines.append([])
        lines[-1].append((y, x))
    out = []
    for line in lines:
        y, x = min(line, key=lambda p: p[1])
        out.append((x, y))
    if len(out) >= 3:
        gaps = sorted(abs(a[1] - b[1]) for a, b in zip(out, out[1:]))
        apart, kept = max(least, gaps[len(gaps) * 3 // 4] / 2), out[:1]
        for a in out[1:]:
            if abs(a[1] - kept[-1][1]) >= apart:
                kept.append(a)
        out = kept
    return out


def line_anchors(samples: DataFrame) -> DataFrame:
    """block, line, x, y from samples (block, x, y, size), a block at a time."""

    def fold(rows: list[dict]) -> list[dict]:
        return [{"line": i, "x": x, "y": y} for i, (x, y) in enumerate(anchors([(r["x"], r["y"], r["size"]) for r in rows]))]

    return fold_groups(samples, "block", ["x", "y", "size"], ["y"], fold, "line int, x double, y double")


def wrap_widths(text: str, widths: list[float], size: float, em: float) -> list[str]:
    """Lines for the widths given (the last holds for all that follow) at ``em`` times ``size`` for a character; a longer word is cut."""
    lines: list[str] = []
    room = lambda: max(1, int(widths[min(len(lines), len(widths) - 1)] / (size * em) + 1e-9))
    for hard in text.split("\n"):
        now = ""
        for word in hard.split():
            if len(f"{now} {word}".strip()) <= room():
                now = f"{now} {word}".strip()
                continue
            if now:
                lines.append(now)
            while len(word) > room():
                n = room()
                lines.append(word[:n])
                word = word[n:]
            now = word
        if now:
            lines.append(now)
    return lines or [""]


def fit(text: str, widths: list[float], size: float, em: float, lines: int) -> tuple[float, list[str]]:
    """(size, lines): a text of one line shrinks to at least seven tenths before it is wrapped; one of more shrinks by tenths until it has no more lines than before, not below 4."""
    if lines <= 1:
        width = len(text) * em * size
        at = size if width <= widths[0] * 1.05 or not width else max(size * widths[0] / width, size * 0.7, 4.0)
        return (at, [text]) if len(text) * em * at <= widths[0] * 1.05 else (at, wrap_widths(text, widths, at, em))
    got = wrap_widths(text, widths, size, em)
    while len(got) > lines and size > 4:
        size = max(4.0, size * 0.9)
        got = wrap_widths(text, widths, size, em)
    return size, got


def fitted(em: float):
    """``fit`` on columns: text, widths, size, lines."""

    @F.pandas_udf("struct<size:double,lines:array<string>>")
    def run(text: pd.Series, widths: pd.Series, size: pd.Series, lines: pd.Series) -> pd.DataFrame:
        got = [fit(t, list(w), s, em, n) for t, w, s, n in zip(text, widths, size, lines)]
        return pd.DataFrame({"size": [g[0] for g in got], "lines": [g[1] for g in got]})

    return run
