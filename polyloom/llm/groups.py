"""Groups of rows with equal content: equal digests first, equal bytes after that.

Two scans. The first keeps digests alone and counts them; the second reads what may be a copy, found by a Bloom
prefilter in the JVM, and compares bytes. Both aggregate before they shuffle, so that a page with a million copies
travels once from each task, and the rows of such a page meet their group's totals without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.plans.bloom import bloom, might_contain
from polyloom.plans.shared import materialize
from polyloom.plans.skew import join_totals


def row_ids(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator needs, under names of its own, so that no other column can clash."""
    return rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def raw_hash() -> Column:
    """What tells rows of a repeated digest from others in the JVM, before anything is computed from their texts."""
    return F.xxhash64("text")


def totals_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, group_size, group_id (the least doc_id) of each key that occurs again."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("group_id")).where("group_size > 1")


def suspects(full: DataFrame, digests: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``full`` whose digest occurs again, and a few that the filter can't clear."""
    n = digests.count()
    again = join_totals(digests.select("raw", *keys), totals.select(*keys, "group_size"), keys, "group_size", n).where("group_size is not null").select("raw").distinct()
    return full.where(might_contain(bloom(materialize(again, "suspects"), "raw"), raw_hash()))


def equal_groups(rows: DataFrame, digest: Callable[[Column], Column], content: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, group_id (the least doc_id of the group), group_size: one row for each row of ``rows``.

    Groups have equal digests and equal ``content``, both functions of a text: bytes are compared inside each bucket of two and
    more, by an aggregation on digest and bytes. Rows of a bucket in which bytes differ, an accident that a wide digest
    makes unheard of, are then grouped by their bytes. A null text equals nothing: null digest, a group of its own.
    """
    base = row_ids(rows, id_col, text_col)
    full = base.where(F.col("text").isNotNull())
    digests = materialize(full.select("doc_id", digest(F.col("text")).alias("digest"), raw_hash().alias("raw")), "digests")
    totals = materialize(totals_of(digests, ["digest"]), "totals")
    again = suspects(full, digests, totals, ["digest"]).select("doc_id", digest(F.col("text")).alias("digest"), content(F.col("text")).alias("content"))
    different = again.select("digest", "content").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    different = materialize(different.select("digest"), "different")
    void = base.where(F.col("text").isNull()).select("doc_id", F.lit(None).cast(digests.schema["digest"].dataType).alias("digest"), F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"))
    met = join_totals(digests.select("doc_id", "digest"), totals, ["digest"], "group_size", digests.count())
    met = met.select("doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    if different.isEmpty():
        return met.unionByName(void)
    apart = again.join(different, "digest", "left_semi")
    own = apart.groupBy(F.col("digest").alias("d"), F.col("content").alias("c")).agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("group_id"))
    apart = apart.join(own, (F.col("digest") == F.col("d")) & (F.col("content") == F.col("c"))).select("doc_id", "digest", "group_id", "group_size")
    return met.join(different, "digest", "left_anti").unionByName(apart).unionByName(void)
