"""Tables written to the cluster's shared folder, so that lineage is cut in a way that outlives executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where a session on one machine names none (tests), a fresh temporary one.

    A cluster's executors don't share a folder of the driver's machine: there, an unset ``spark.checkpoint.dir`` is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="polyloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Unlike a local checkpoint, the result survives the loss of any executor; unlike a
    cached table it is columnar, so later reads prune columns and know their size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
