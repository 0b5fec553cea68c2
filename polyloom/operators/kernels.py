"""Batch kernels for models that live outside the library, and a lexicon that stands in for them.

``apply_kernel`` runs a kernel on distinct texts only: duplicates and rows that need no
inference never reach Python, and results join back on the text.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Translate = Callable[[list[str]], list[str]]


class ModelCache:
    """Models of a worker process by route key, such as ``en-es``; the one used longest ago goes first when ``most`` are held."""

    def __init__(self, most: int = 4):
        self.most, self._held = most, {}

    def model(self, load: Callable[[str], Translate], key: str) -> Translate:
        found = self._held.pop((load, key), None)
        self._held[(load, key)] = found = load(key) if found is None else found
        while len(self._held) > self.most:
            del self._held[next(iter(self._held))]
        return found

    def keys(self) -> list[str]:
        return [key for _, key in self._held]

    def evict(self, key: str) -> None:
        self._held = {k: v for k, v in self._held.items() if k[1] != key}

    def evict_involving(self, language: str) -> None:
        """Every model from or to a language, those of several steps too."""
        touches = lambda key: any(language in step.split("-", 1) for step in key.split(","))
        self._held = {k: v for k, v in self._held.items() if not touches(k[1])}

    def clear(self) -> None:
        self._held = {}


_cache = ModelCache()


def _loaded(load: Callable[[str], Translate], key: str) -> Translate:
    """One model for each route in a worker process."""
    return _cache.model(load, key)


def evict(key: str | None = None, language: str | None = None) -> None:
    """From this process: the model of a key, those of a language, or all. Workers drop theirs with the process or as others take their place."""
    if key is not None:
        _cache.evict(key)
    if language is not None:
        _cache.evict_involving(language)
    if key is None and language is None:
        _cache.clear()


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    """How many partitions of a kernel's rows run side by side, and how many models and cached translations a worker may hold."""

    workers: int = 4
    cache: int = 8192

    @classmethod
    def of(cls, spark: SparkSession) -> EngineConfig:
        """From ``spark.polyloom.workers`` and ``spark.polyloom.cache``; what isn't a number above zero counts as unset."""

        def number(key: str, default: int) -> int:
            value = spark.conf.get(key, "")
            return int(value) if value and value.isdigit() and int(value) > 0 else default

        return cls(number("spark.polyloom.workers", cls.workers), number("spark.polyloom.cache", cls.cache))


def warm(spark: SparkSession, load: Callable[[str], Translate], keys: list[str], workers: int | None = None) -> int:
    """Loads the models of ``keys`` in as many tasks as there are workers; how many loaded. What fails to load counts as not loaded."""
    n = workers or EngineConfig.of(spark).workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for key in batch.column(0).to_pylist():
                try:
                    _loaded(load, key)
                    good.append(key)
                except Exception:  # noqa: BLE001  a native kernel's failure isn't the job's
                    continue
            yield pa.RecordBatch.from_pydict({"key": pa.array(good, pa.string())})

    rows = spark.createDataFrame([(w, k) for w in range(n) for k in keys], "worker int, key string").repartition(n, "worker").select("key")
    return rows.mapInArrow(run, "key string").distinct().count()


def identity(_key: str) -> Translate:
    return list


def apply_kernel(rows: DataFrame, load: Callable[[str], Translate], key: str = "route", text: str = "text", out: str = "translated", skip: Column | None = None) -> DataFrame:
    """``rows`` with ``out`` and ``kernel_error``.

    load(route) gives the batch function of a route such as ``en-es``; it is called once in a worker. Rows where ``skip``
    holds, and null texts, keep their text. A batch that raises has nulls and the message; the job goes on.
    Distinct texts stay spread as the shuffle that found them left them, by route and text, so that a route with most of the texts has as many
    tasks as any; within a task those of a route lie together. Results join back on a hash of the text, which is then compared.
    """
    passed = (F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))) | F.col(text).isNull() | (F.col(text) == "")
    distinct = rows.where(~passed).select(F.col(key).alias("__key"), F.col(text).alias("__text")).distinct().sortWithinPartitions("__key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for route, part in batch.groupby("__key", dropna=False):
                try:
                    yield part.assign(__out=_loaded(load, route)(part["__text"].tolist()), __error=None)
                except Exception as e:  # noqa: BLE001  a native kernel's failure becomes a value
                    yield part.assign(__out=None, __error=f"{type(e).__name__}: {e}")

    done = distinct.mapInPandas(run, "__key string, __text string, __out string, __error string")
    same = F.coalesce(F.col(text) == F.col("__text"), F.lit(False))  # no key of the join: keys are hashed, texts only compared where hashes meet
    met = rows.join(done, (F.col(key) == F.col("__key")) & (F.xxhash64(F.col(text)) == F.xxhash64("__text")) & same & ~passed, "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(passed, F.col(text)).otherwise(F.col("__out")).alias(out), F.col("__error").alias("kernel_error"))


#: A few words to a pivot language: what the built-in lexicon translates. Others stay.
LEXICON: dict[str, dict[str, str]] = {
    "de": {"der": "the", "die": "the", "das": "the", "und": "and", "ist": "is", "von": "of", "zu": "to", "mit": "with", "nicht": "not", "für": "for"},
    "es": {"el": "the", "la": "the", "los": "the", "de": "of", "que": "that", "por": "by", "con": "with", "para": "for", "un": "a", "es": "is"},
    "fr": {"le": "the", "la": "the", "les": "the", "de": "of", "et": "and", "est": "is", "dans": "in", "pour": "for", "avec": "with", "une": "a"},
}


def lexicon_translate(text: Column, language: Column) -> Column:
    """Word by word, between single spaces, as map lookups in the JVM: no Python in the plan."""
    table = F.create_map(*[F.lit(x) for code, words in LEXICON.items() for w, t in words.items() for x in (f"{code}:{w}", t)])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, F.concat(language, F.lit(":"), w)), w)), " ")
