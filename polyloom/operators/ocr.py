"""Recognised words to lines and blocks. What depends on the state of the line before is a fold over one image at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyloom.plans.folds import fold_groups

WORDS = "img long, ord int, text string, confidence double, l int, t int, r int, b int, first boolean, end_line boolean, end_para boolean"


def confident(text: Column, confidence: Column, least: int, relax: bool = False) -> Column:
    """Words of one character need five points more, unless relaxed."""
    bar = min(least, 60) if relax else least
    ok = confidence >= bar
    return ok if relax else ok & ~((F.char_length(text) == 1) & (confidence < min(bar + 5, 100)))


def confidence_filter(words: DataFrame, least: int, relax: bool = False) -> DataFrame:
    """The confident ``words``; what a dropped word said of a line's begin goes to the next kept one, of its end to the one before."""
    order = Window.partitionBy("img").orderBy("ord")
    keep = confident(F.col("text"), F.col("confidence"), least, relax)
    w = words.withColumn("keep", keep).withColumn("upto", F.sum(F.col("keep").cast("int")).over(order))
    w = w.withColumn("before", F.col("upto") - F.col("keep").cast("int"))
    begins, ends = Window.partitionBy("img", "before"), Window.partitionBy("img", "upto")
    w = w.withColumns({"first": F.bool_or("first").over(begins), "end_line": F.bool_or("end_line").over(ends), "end_para": F.bool_or("end_para").over(ends)})
    return w.where("keep").select(*words.columns)


def merge_hyphens(words: list[dict]) -> list[dict]:
    """A word that ends its line with ``-`` takes in the first of the next line; the word after those begins the rest of that line.

    ``wide`` is the width that the joined word would have on one line.
    """
    out, i = [], 0
    while i < len(words):
        w, nxt = words[i], words[i + 1] if i + 1 < len(words) else None
        below = nxt and nxt["l"] < w["l"] and nxt["t"] > w["t"]
        if nxt is None or not w["end_line"] or not w["text"].endswith("-") or not (nxt["first"] or below):
            out.append(w)
            i += 1
            continue
        out.append({**w, "text": w["text"].rstrip("-") + nxt["text"], "confidence": min(w["confidence"], nxt["confidence"]), "end_line": True, "end_para": nxt["end_para"], "wide": w["r"] - w["l"] + nxt["r"] - nxt["l"]})
        if i + 2 < len(words):
            after = words[i + 2]
            out.append({**after, "l": min(nxt["l"], after["l"]), "t": min(nxt["t"], after["t"]), "r": max(nxt["r"], after["r"]), "b": max(nxt["b"], after["b"]), "first": True, "wide": after["r"] - after["l"]})
        i += 3
    return out


def lines_of(words: list[dict], join: str = " ") -> list[dict]:
    """block, line, text, l, t, r, b of each line of one image's words in order."""
    lines: list[dict] = []
    block, now, last_right = 0, None, 0

    def close():
        nonlocal now
        if now and now["text"].strip():
            lines.append({**now, "block": block})
        now = None

    for w in merge_hyphens(words):
        if not w["text"].strip():
            continue
        if now is None or w["first"] or w["r"] < now["l"]:
            close()
            now = {k: w[k] for k in ("text", "l", "t", "r", "b")}
        else:
            width = w.get("wide", w["r"] - w["l"]) / max(len(w["text"]), 1)
            if width > 0 and max(0, w["l"] - last_right) / width >= 3:
                close()
                block += 1
                now = {k: w[k] for k in ("text", "l", "t", "r", "b")}
            else:
                now = {"text": now["text"] + join + w["text"], "l": min(now["l"], w["l"]), "t": min(now["t"], w["t"]), "r": max(now["r"], w["r"]), "b": max(now["b"], w["b"])}
        if w["end_line"]:
            close()
        if w["end_para"] and lines and lines[-1]["block"] == block and now is None:
            block += 1
        last_right = w["r"]
    close()
    number = {b: i for i, b in enumerate(dict.fromkeys(x["block"] for x in lines))}
    return [{**x, "block": number[x["block"]], "line": i} for i, x in enumerate(lines)]


def text_lines(words: DataFrame, least: int, join: str = " ", relax: bool = False) -> DataFrame:
    """img, block, line, text, l, t, r, b: one image's words at a time."""
    kept = confidence_filter(words, least, relax)

    columns = [c.split()[0] for c in WORDS.split(", ")][1:]
    return fold_groups(kept, "img", columns, ["ord"], lambda rows: lines_of(rows, join), "block int, line int, text string, l int, t int, r int, b int")


def text_blocks(lines: DataFrame) -> DataFrame:
    """img, block, text (lines joined by spaces), source (by line feeds), l, t, r, b, layout hint (mean line height)."""
    by = lines.groupBy("img", "block").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.avg(F.col("b") - F.col("t")).alias("line_height"))
    texts = F.transform("ls", lambda x: x["text"])
    return by.select("img", "block", F.array_join(F.filter(F.transform(texts, F.trim), lambda x: x != ""), " ").alias("text"), F.array_join(texts, "\n").alias("source"), "l", "t", "r", "b", "line_height")
