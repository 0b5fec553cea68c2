"""Styled spans across a translation: projection through alignments, words they touch, runs that merge."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the cells in which positions meet spans by equality.
CELL = 64
#: Rows of all tables together that one task of a shuffle is to hold; the memory of a task follows from it, whatever the size of the input.
TASK_ROWS = 500_000


def _cells(spans: DataFrame, key: str) -> DataFrame:
    return spans.where("start < end").select(key, "start", "end", "style", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))).alias("cell"))


def parts_for(*tables: DataFrame) -> int:
    """Partitions in which a task holds about ``TASK_ROWS`` rows of ``tables``, which are counted."""
    return max(1, math.ceil(sum(t.count() for t in tables) / TASK_ROWS))


def projection_parts(spans: DataFrame, alignments: DataFrame, key: str) -> int:
    return parts_for(_cells(spans, key), alignments)


def project(spans: DataFrame, alignments: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """key, start, end, style in the target, from spans (key, start, end, style) in the source and alignments (key, sb, se, tb, te).

    An alignment takes the style of the first span (by start, end, style) that covers its source's midpoint; others are left out. Spans
    are spread over cells of ``CELL`` characters, so the join is by key and cell and long texts don't meet all against all. An alignment is in one cell, so its spans are compared where they
    meet. parts: of the shuffle; if not given, both tables are counted for it.
    """
    parts = parts or projection_parts(spans, alignments, key)
    cells = _cells(spans, key).repartition(parts, key, "cell")
    a = alignments.withColumn("mid", F.floor((F.col("sb") + F.col("se")) / 2)).withColumn("cell", F.floor(F.col("mid") / CELL)).repartition(parts, key, "cell")
    met = a.join(cells, [key, "cell"]).where((F.col("mid") >= F.col("start")) & (F.col("mid") < F.col("end")))
    first = met.groupBy(key, "cell", "sb", "se", "tb", "te").agg(F.min(F.struct("start", "end", "style")).alias("s"))
    return first.select(key, F.col("tb").alias("start"), F.col("te").alias("end"), F.col("s.style").alias("style"))


def merge(spans: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Spans (key, start, end, style) of one style that touch or overlap, as one. parts: of the shuffle; if not given, the spans are counted for it."""
    order = Window.partitionBy(key, "style").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.coalesce((F.col("start") > F.col("reach")).cast("int"), F.lit(1))).over(order)
    return spans.repartition(parts or parts_for(spans), key, "style").withColumn("reach", reach).withColumn("run", run).groupBy(key, "style", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
