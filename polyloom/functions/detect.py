"""Language detection: a pluggable batch kernel, and a built-in detector from function words that is plain expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from polyloom.functions.text import bound, is_blank

#: Function words by language. A word may be in several profiles.
PROFILES: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "nicht", "ein", "eine", "dem", "im"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "this", "by", "from"),
    "es": ("el", "la", "de", "que", "los", "del", "las", "por", "con", "una", "su", "para", "es", "al", "lo", "como", "más", "un"),
    "fr": ("le", "les", "des", "du", "est", "une", "dans", "qui", "par", "pour", "sur", "au", "pas", "avec", "et", "ce", "il", "la"),
}
RELIABLE_PERCENT = 50


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def profile_counts(text: Column) -> Column:
    """struct with, for each language, the number of the text's words that are in its profile."""
    return bound(words(text), lambda ws: F.struct(*[F.size(F.filter(ws, lambda w: w.isin(*p))).alias(code) for code, p in PROFILES.items()]))


def _detect(counts: Column, hint: str | None = None) -> Column:
    """From counts; the best first, of equal ones the lesser code. A hint adds one to its language, but finds nothing by itself."""
    n = {code: counts[code] + (1 if code == hint else 0) for code in PROFILES}
    total = sum(n.values(), F.lit(0))
    top = F.array_min(F.array(*[F.struct((-n[code]).alias("minus"), F.lit(code).alias("language")) for code in sorted(n)]))
    confidence = F.floor(-top["minus"] * 100 / F.nullif(total, F.lit(0))).cast("int")
    return F.when(sum((counts[code] for code in PROFILES), F.lit(0)) > 0, F.struct(top["language"].alias("language"), (confidence >= RELIABLE_PERCENT).alias("is_reliable"), confidence.alias("confidence")))


def detect_language(text: Column, hint: str | None = None) -> Column:
    """struct(language, is_reliable, confidence): confidence is the winner's share of all counts in percent; null without any known word."""
    return bound(profile_counts(text), lambda counts: _detect(counts, hint))


def detect_robust(text: Column, available: list[str], hint: str | None = None) -> Column:
    """The detected code if reliable and available; else the first available code that is reliably detected when hinted; else null. Blank: null."""

    def code_of(counts: Column) -> Column:
        first = _detect(counts, hint)
        tries = [F.when(first["is_reliable"] & first["language"].isin(*available), first["language"])] if available else []
        for code in available:
            if code != hint:
                again = _detect(counts, code)
                tries.append(F.when(again["is_reliable"] & (again["language"] == code), F.lit(code)))
        return F.coalesce(*tries, F.lit(None).cast("string"))

    return F.when(is_blank(text), None).otherwise(bound(profile_counts(text), code_of))


def kernel_detector(classify: Callable[[list[str | None]], list[tuple[str, bool, int] | None]]):
    """A detector from a batch function, for a model that isn't part of the library: same result type as ``detect_language``."""

    @F.pandas_udf("struct<language:string,is_reliable:boolean,confidence:int>")
    def detect(texts: pd.Series) -> pd.DataFrame:
        got = [x or (None, None, None) for x in classify(texts.tolist())]
        return pd.DataFrame(got, columns=["language", "is_reliable", "confidence"])

    return detect
