"""Sequential folds over small groups: a group is one row with an array, and Arrow brings thousands of them to Python at once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def fold_groups(rows: DataFrame, key: str, columns: list[str], order: list[str], fold: Callable[[list[dict]], list[dict]], result: str) -> DataFrame:
    """key and the fields of ``result`` (a DDL list) for each dict that ``fold`` gives for a group's rows in order.

    Unlike a call of Python for each group, the cost is by row; a group has to fit in memory either way.
    """
    kind = f"array<struct<{result}>>"
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(groups: pa.Array) -> pa.Array:
        return pa.array([fold(g) for g in groups.to_pylist()], arrow)

    fields = [*order, *(c for c in columns if c not in order)]
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    return packed.select(key, run("rows").alias("out")).select(key, F.inline("out"))
