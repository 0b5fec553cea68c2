"""Joins of rows with the totals of their groups, however large a single group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot if it has more than one in 2**HOT_BITS of all rows: there are fewer than 2**HOT_BITS such groups, whatever the input.
HOT_BITS = 16


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], size: str, n_rows: int) -> DataFrame:
    """``rows`` left-joined with ``totals``, which has one row for each key with the number of its rows in ``size``.

    Rows of hot groups meet their totals where they are: the totals of at most 2**HOT_BITS hot groups are broadcast, a few megabytes by
    construction. Only rows of other groups are shuffled, none of which has more than one in 2**HOT_BITS of all rows. Keys aren't null.
    """
    hot = F.col(size) > (n_rows >> HOT_BITS)
    named = lambda prefix: [F.col(c).alias(prefix + c) if c in keys else F.col(c) for c in totals.columns]
    on = lambda prefix: [F.col(k) == F.col(prefix + k) for k in keys]
    rest = [c for c in totals.columns if c not in keys]
    met = rows.join(F.broadcast(totals.where(hot).select(*named("__hot_"))), on("__hot_"), "left")
    found = met.where(F.col(f"__hot_{keys[0]}").isNotNull()).select(*rows.columns, *rest)
    others = met.where(F.col(f"__hot_{keys[0]}").isNull()).select(*rows.columns)
    cold = others.join(totals.where(~hot).select(*named("__cold_")), on("__cold_"), "left").select(*rows.columns, *rest)
    return found.unionByName(cold)
