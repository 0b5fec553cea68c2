"""Column functions on text: trimming, passthrough, sentences with offsets, escapes, names. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"
#: Digits, white space, punctuation and dashes only. Symbols such as $ or + are not punctuation.
PASSTHROUGH = rf"\A[\p{{N}}{WS}\p{{P}}·•–—―]+\z"
#: What a strict decimal parser takes: no type suffixes, no hexadecimals, no spaces.
NUMBER = r"\A[+-]?((?i:inf|infinity|nan)|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\z"
MARK = "\x01"


def unicode_trim(c: Column) -> Column:
    """Without Unicode white space at both ends; ``trim`` knows spaces only."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def is_blank(c: Column) -> Column:
    return unicode_trim(c) == ""


def is_passthrough(c: Column) -> Column:
    """True for text that no translation would change; a blank text isn't asked."""
    return c.rlike(PASSTHROUGH)


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def text_class(c: Column) -> Column:
    """``blank``, ``passthrough`` or ``translatable``."""
    return F.when(is_blank(c), "blank").when(is_passthrough(c), "passthrough").otherwise("translatable")


def split_sentences(c: Column) -> Column:
    """Sentences: a boundary is white space after ``.``, ``!`` or ``?`` and before a capital. Blank text has none; a text without boundary is one."""
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(F.split(c, rf"(?<=[.!?]){WS}+(?=\p{{Lu}})"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sentence_spans(c: Column) -> Column:
    """Array of struct(k, start, text): the sentences with their character offsets."""
    pieces = F.split(F.regexp_replace(c, rf"(?<=[.!?])({WS}+)(?=\p{{Lu}})", MARK + "$1" + MARK), MARK)

    def each(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda a, p: F.array_append(a, F.element_at(a, -1) + F.char_length(p)))
        count = F.floor((F.size(parts) - 1) / 2).cast("int")
        return bound(ends, lambda e: F.transform(F.sequence(F.lit(0), count), lambda k: F.struct(k.alias("k"), F.get(e, k * 2).alias("start"), F.get(parts, k * 2).alias("text"))))

    return F.when(is_blank(c), F.array().cast("array<struct<k:int,start:int,text:string>>")).otherwise(bound(pieces, each))


def recombine(pieces: Column) -> Column:
    """Sentences of a text, joined by one space; none give the empty text."""
    return F.array_join(pieces, " ")


def xml_escape(c: Column) -> Column:
    """``&`` first, then ``<`` and ``>``."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_escape_attribute(c: Column) -> Column:
    return F.replace(xml_escape(c), F.lit('"'), F.lit("&quot;"))


def xml_unescape(c: Column) -> Column:
    """The five named entities, ``&`` last; others stay."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def file_name(c: Column) -> Column:
    """Runs of other characters than letters, digits, ``_``, ``.`` and ``-`` become ``_``; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_.-]+", "_"), r"\A_+|_+\z", "")


def region_flag(c: Column) -> Column:
    """Two letters as regional indicators; anything else gives null."""
    up = F.upper(c)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(up.rlike(r"\A[A-Z]{2}\z"), F.translate(up, letters, "".join(chr(0x1F1E6 + i) for i in range(26))))


#: Characters of the Windows 1252 page beyond Latin-1.
_WINANSI = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def winansi(c: Column) -> Column:
    """Characters that a Windows 1252 font can show; others become ``?``."""
    return F.regexp_replace(c, rf"[^\x20-\x7E -ÿ{_WINANSI}]", "?")


def language_family(code: Column) -> Column:
    """The part before ``-`` or ``_``, in lower case."""
    return F.lower(F.element_at(F.split(code, "[-_]"), 1))


def voice_display_name(name: Column) -> Column:
    """``af_new-star`` is ``New Star``: the two-letter prefix goes, parts begin with a capital, the rest is unchanged."""
    parts = F.filter(F.split(F.regexp_replace(name, "^[a-z]{2}_", ""), "[_-]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p)))), " ")


def word_expand(text: Column, start: Column, end: Column, extra: str = "") -> Column:
    """struct(start, end): the first word that the range [start, end) touches, in characters; null if none.

    A word is a run of letters and digits, and of ``extra``.
    """
    word = rf"[\p{{L}}\p{{N}}{extra}]"
    inside = F.substring(text, start + 1, end - start)
    skip = F.char_length(F.regexp_extract(inside, rf"\A[^\p{{L}}\p{{N}}{extra}]*", 0))
    at = start + skip
    before = F.when(skip == 0, F.char_length(F.regexp_extract(F.substring(text, F.lit(1), start), rf"{word}*\z", 0))).otherwise(0)
    after = F.char_length(F.regexp_extract(F.substring(text, at + 1, F.char_length(text)), rf"\A{word}*", 0))
    return F.when((start < end) & (at < end), F.struct((at - before).alias("start"), (at + after).alias("end")))
