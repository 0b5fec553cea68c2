"""Which voice speaks: names to families, what is offered, the default, and what a request comes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.functions.text import language_family, voice_display_name

#: First letters of the voices of a language family, in order of preference.
PREFIXES = {"zh": "z", "pt": "p", "ko": "j", "ja": "j", "it": "i", "hi": "h", "fr": "f", "es": "e", "en": "ab"}
MANY = "kokoro"


def _rank(name: Column, language: Column) -> Column:
    """From 0, the place of the name's first letter among the family's; null if it isn't there."""
    letters = F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), language_family(language))
    return F.nullif(F.instr(F.coalesce(letters, F.lit("")), F.substring(name, 1, 1)), F.lit(0)) - 1


def visible(voices: DataFrame) -> DataFrame:
    """model, name, speaker_id, display_name from voices (model, engine, language, ord, name, speaker_id). Of an engine of many languages only the family's, or all if it has none."""
    rank = F.when(F.col("engine") == MANY, _rank(F.col("name"), F.col("language")))
    some = voices.select("model", rank.alias("rank")).groupBy("model").agg(F.count("rank").alias("matches"))
    met = voices.withColumn("rank", rank).join(some, "model")
    return met.where((F.col("matches") == 0) | F.col("rank").isNotNull()).select("model", "name", "speaker_id", voice_display_name(F.col("name")).alias("display_name"))


def default(voices: DataFrame) -> DataFrame:
    """model, name, speaker_id: of an engine of many languages the first voice by preference of its family, else the first of all; none for other engines."""
    best = F.min(F.struct(F.coalesce(_rank(F.col("name"), F.col("language")), F.lit(99)).alias("rank"), "ord", "name", "speaker_id"))
    return voices.where(F.col("engine") == MANY).groupBy("model").agg(best.alias("b")).select("model", "b.name", "b.speaker_id")


def requested(asked: DataFrame, voices: DataFrame) -> DataFrame:
    """id, name, speaker_id for asked (id, model, wanted, wanted_id): by name, else by number, else the default, else an unnamed speaker of that number; else null."""
    v = voices.select("model", "ord", "name", "speaker_id")
    first = lambda cond: F.min(F.when(cond, F.struct("ord", "name", "speaker_id")))
    met = asked.join(v, "model", "left").groupBy("id", "model", "wanted", "wanted_id").agg(first((F.col("wanted") != "") & (F.col("name") == F.col("wanted"))).alias("a"), first(F.col("speaker_id") == F.col("wanted_id")).alias("b"))
    d = default(voices).select("model", F.struct(F.lit(0).alias("ord"), "name", "speaker_id").alias("c"))
    unnamed = F.when(F.col("wanted_id").isNotNull(), F.struct(F.lit(0).alias("ord"), F.concat(F.lit("speaker_"), F.col("wanted_id").cast("string")).alias("name"), F.col("wanted_id").alias("speaker_id")))
    return met.join(d, "model", "left").select("id", F.coalesce("a", "b", "c", unnamed).alias("x")).select("id", "x.name", "x.speaker_id")
