"""What the families of queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    """A SQL literal that Spark and DuckDB both read."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(columns: str, rows: list[tuple]) -> str:
    """A SELECT of literal rows; ``columns`` are ``name type`` pairs, as in a schema."""
    pairs = [c.split() for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    kinds = {"string": "varchar", "long": "bigint"}
    return "select " + ", ".join(f"cast({n} as {kinds.get(t, t)}) as {n}" for n, t in pairs) + f" from (values {body}) as v({', '.join(n for n, _ in pairs)})"


def values_df(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)
