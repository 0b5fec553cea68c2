"""Routing of mixed texts: each distinct text is blank, passes through, or joins the batch of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyloom.functions.detect import detect_robust
from polyloom.functions.text import text_class

SAME, UNDETECTED, NOTHING = "ALREADY_TARGET_LANGUAGE", "COULD_NOT_DETECT", "NO_TRANSLATABLE_TEXT"


def unique_texts(inputs: DataFrame, text: str = "text", ord_: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct texts, each at its first ordinal (within ``by``)."""
    return inputs.groupBy(*by, text).agg(F.min(ord_).alias(ord_))


def route(inputs: DataFrame, target: str, available: list[str], forced: str | None = None, text: str = "text", ord_: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """by, ord, text, class, language, state for each distinct text that isn't blank.

    state: ``passthrough``, ``same`` (as the target), ``undetected`` or ``batch``. A forced language puts all
    translatable text in one batch, the target's own language included.
    """
    kind = text_class(F.col(text))
    found = unique_texts(inputs.where(F.col(text).isNotNull()), text, ord_, by).withColumn("class", kind).where("class <> 'blank'")
    language = F.lit(forced) if forced else detect_robust(F.col(text), available)
    found = found.withColumn("language", F.when(F.col("class") == "translatable", language))
    state = F.when(F.col("class") == "passthrough", "passthrough")
    if not forced:
        state = state.when(F.col("language").isNull(), "undetected").when(F.col("language") == target, "same")
    return found.withColumn("state", state.otherwise("batch"))


def batches(routed: DataFrame, ord_: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """The rows in batches with batch_ord: languages in the order of their first text."""
    first = F.min(ord_).over(Window.partitionBy(*by, "language"))
    return routed.where("state = 'batch'").withColumn("first", first).withColumn("batch_ord", F.dense_rank().over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("first")) - 1).drop("first")


def batch_plan(routed: DataFrame, ord_: str = "ord") -> DataFrame:
    """language, first, texts of each batch, with batch_ord. Only one row for each language is ranked."""
    sizes = routed.where("state = 'batch'").groupBy("language").agg(F.min(ord_).alias("first"), F.count(F.lit(1)).alias("texts"))
    return sizes.withColumn("batch_ord", F.row_number().over(Window.orderBy("first")) - 1)


def nothing_reason(counts_same: Column, counts_undetected: Column, counts_useful: Column) -> Column:
    """Why there is nothing to translate; null if there is something. Both kinds of failure together say: no translatable text."""
    same, lost = F.coalesce(counts_same, F.lit(0)) > 0, F.coalesce(counts_undetected, F.lit(0)) > 0
    return F.when(F.coalesce(counts_useful, F.lit(0)) > 0, None).when(same & ~lost, SAME).when(~same & lost, UNDETECTED).otherwise(NOTHING)


def reasons(inputs: DataFrame, routed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by and nothing_reason for every group of inputs, those of blank texts included."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    counts = routed.groupBy(*by).agg(n("same").alias("n_same"), n("undetected").alias("n_undetected"), n("batch", "passthrough").alias("n_useful"))
    return inputs.select(*by).distinct().join(counts, list(by), "left").select(*by, nothing_reason(F.col("n_same"), F.col("n_undetected"), F.col("n_useful")).alias("nothing_reason"))
