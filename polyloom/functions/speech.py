"""Speech: paragraphs, segments and pause splits as expressions, and the recursive plan around a phonemizer."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from polyloom.functions.text import WS, bound, unicode_trim

END, CLAUSE = ".?!。？！", ",;:、，；：،"
#: A side of a split has at least so many characters, and a quarter of all. Longer phoneme strings are split.
LEAST_SIDE, MOST_DIRECT = 12, 100
_BREAK = "\x01"


def paragraphs(text: Column) -> Column:
    """Blank lines end a paragraph, and so does a line that ends a sentence; other lines are joined by one space."""
    lines = F.regexp_replace(unicode_trim(text), rf"[{WS}&&[^\n]]*\n[{WS}&&[^\n]]*", "\n")
    marked = F.regexp_replace(F.regexp_replace(lines, r"\n{2,}", _BREAK), rf"(?<=[{END}])\n", _BREAK)
    return F.filter(F.split(F.replace(marked, F.lit("\n"), F.lit(" ")), _BREAK), lambda p: p != "")


def segments(paragraph: Column) -> Column:
    """Pieces that end with sentence marks before white space; a capital needn't follow."""
    pieces = F.transform(F.split(paragraph, rf"(?<=[{END}]){WS}+"), unicode_trim)
    return F.filter(pieces, lambda s: s != "")


def best_pause_split(text: Column) -> Column:
    """struct(first, second) at the clause mark that leaves the sides most alike; null if none leaves both long enough."""
    n = F.char_length(text)
    lead, trail = (n - F.char_length(F.regexp_replace(text, p, "")) for p in (rf"\A{WS}+", rf"{WS}+\z"))
    given = F.struct(F.split(text, f"[{CLAUSE}]").alias("pieces"), n.alias("n"), lead.alias("lead"), trail.alias("trail"), F.greatest(F.lit(LEAST_SIDE), F.floor(n / 4)).alias("least"))

    def chosen(x: Column) -> Column:
        # a mark's place is the end of the piece before it; lengths alone decide, so that only the chosen sides are cut out
        pieces = x["pieces"]
        ends = F.aggregate(pieces, F.array(F.lit(-1)), lambda a, p: F.array_append(a, F.element_at(a, -1) + F.char_length(p) + 1))
        blanks = F.transform(pieces, lambda p: F.char_length(p) - F.char_length(F.regexp_replace(p, rf"\A{WS}+", "")))
        marks = F.zip_with(F.slice(ends, F.lit(2), F.size(pieces) - 1), F.slice(blanks, F.lit(2), F.size(pieces) - 1), lambda i, skip: F.struct(i.alias("i"), (i + 1 - x["lead"]).alias("first"), (x["n"] - x["trail"] - i - 1 - skip).alias("second")))
        good = F.filter(marks, lambda m: (m["first"] >= x["least"]) & (m["second"] >= x["least"]))
        return F.array_min(F.transform(good, lambda m: F.struct(F.abs(m["first"] - m["second"]).alias("balance"), F.abs(x["n"] / 2 - m["i"]).alias("off"), m["i"].alias("i"))))

    def cut(best: Column) -> Column:
        first = unicode_trim(F.substring(text, F.lit(1), best["i"] + 1))
        return F.when(best.isNotNull(), F.struct(first.alias("first"), unicode_trim(F.substring(text, best["i"] + 2, n)).alias("second")))

    return bound(bound(given, chosen), cut)


def pcm(sample: Column) -> Column:
    """A float sample as 16 bits: clamped, halves away from zero."""
    return F.round(F.least(F.greatest(sample, F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int")


def silence_samples(rate: Column, ms: Column) -> Column:
    """How many zeros a pause takes: at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(rate.cast("long") * F.greatest(F.lit(1), ms) / 1000))


def duration_ms(samples: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.floor(samples * 1000 / rate)).otherwise(F.lit(0).cast("long"))


def speed(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.5)), F.lit(2.0))


# ---- the plan, which asks a phonemizer as it goes ----

Phonemize = Callable[[str], list[tuple[str, str]]]
_PAUSE = {"none": None, "sentence": 0, "paragraph": 0}


def _py_paragraphs(text: str) -> list[str]:
    lines = "\n".join(x.strip() for x in text.strip().split("\n"))
    return [p.replace("\n", " ") for p in re.split(rf"\n{{2,}}|(?<=[{END}])\n", lines) if p]


def _py_segments(paragraph: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(rf"(?<=[{END}])\s+", paragraph)) if s]


def _py_split(text: str) -> tuple[str, str] | None:
    least, best = max(LEAST_SIDE, len(text) // 4), None
    for i in (m.start() for m in re.finditer(f"[{CLAUSE}]", text)):
        a, b = text[: i + 1].strip(), text[i + 1 :].strip()
        if min(len(a), len(b)) >= least:
            key = (abs(len(a) - len(b)), abs(len(text) / 2 - i), i)
            best = min(best or (key, a, b), (key, a, b))
    return best and best[1:]


def _plan(text: str, phonemize: Phonemize) -> list[list]:
    parts = [_py_segments(p) for p in _py_paragraphs(text)]
    flat = [(s, "sentence" if k + 1 < len(ss) else "paragraph" if i + 1 < len(parts) else "none") for i, ss in enumerate(parts) for k, s in enumerate(ss)]
    if len(flat) > 1:
        out = []
        for s, boundary in flat:
            piece = _plan(s, phonemize)
            if piece:
                piece[-1][2] = _PAUSE[boundary]
            out += piece
        return out
    sounds = [(c, b) for c, b in phonemize(text) if c.strip()]
    if not sounds:
        return []
    if len(sounds) > 1:
        return [[c, True, _PAUSE[b]] for c, b in sounds]
    if len(sounds[0][0]) > MOST_DIRECT and (sides := _py_split(text)):
        rest = _plan(sides[1], phonemize)
        if rest:
            return [[sides[0], False, 0], *rest]
    return [[text, False, None]]


def plan_text(text: str, phonemize: Phonemize) -> list[tuple[str, bool, int | None]]:
    """(content, is_phonemes, pause_after_ms) of each chunk to be spoken. ``phonemize`` gives (phonemes, boundary after) pairs."""
    out = _plan(text, phonemize)
    if out:
        out[-1][2] = None
    return [tuple(x) for x in out]


def plan_chunks(phonemize: Phonemize):
    """``plan_text`` on a column, in batches; null text gives no chunks."""

    @F.pandas_udf("array<struct<content:string,is_phonemes:boolean,pause_after_ms:int>>")
    def plan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"content": c, "is_phonemes": p, "pause_after_ms": ms} for c, p, ms in plan_text(t, phonemize)])

    return plan
