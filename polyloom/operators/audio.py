"""Pauses in recordings: tumbling windows, runs of silence, metrics of a file, and files that stand out in their language."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL_SCALE, FLOOR_DB = 32767, -120.0


def dbfs(mean_square: Column, peak: Column) -> Column:
    """Level in dB below ``peak``; of nothing or pure silence the floor."""
    return F.when(mean_square > 0, 20 * F.log10(F.greatest(F.sqrt(mean_square) / peak, F.lit(1e-12)))).otherwise(F.lit(FLOOR_DB))


def silence_windows(samples: DataFrame, rate: int, threshold_db: float = -38.0, window_ms: float = 20.0) -> DataFrame:
    """file, w, start, end (frames), silent, frames (of the file) from ``samples`` (file, ord from 0, sample), one channel.

    One aggregation by window; only its rows, a window's worth fewer, meet in a window function by file.
    """
    size = max(1, round(rate * window_ms / 1000))
    x = F.col("sample").cast("long")
    by = samples.groupBy("file", F.floor(F.col("ord") / size).alias("w")).agg(F.sum(x * x).alias("squares"), F.count(F.lit(1)).alias("n"), F.max(F.abs(x)).alias("most"))
    whole = Window.partitionBy("file")
    by = by.withColumns({"frames": F.sum("n").over(whole), "peak": F.greatest(F.lit(FULL_SCALE), F.max("most").over(whole))})
    return by.select("file", "w", (F.col("w") * size).alias("start"), F.least(F.col("frames"), (F.col("w") + 1) * size).alias("end"), (dbfs(F.col("squares") / F.col("n"), F.col("peak")) < threshold_db).alias("silent"), "frames")


def silence_runs(windows: DataFrame, rate: int, min_pause_ms: float = 140.0) -> DataFrame:
    """file, start_sec, end_sec of runs of silent windows that are long enough."""
    least = max(1, round(rate * min_pause_ms / 1000))
    islands = windows.where("silent").withColumn("island", F.col("w") - F.row_number().over(Window.partitionBy("file").orderBy("w")))
    runs = islands.groupBy("file", "island").agg(F.min("start").alias("s"), F.max("end").alias("e")).where(F.col("e") - F.col("s") >= least)
    return runs.select("file", (F.col("s") / rate).alias("start_sec"), (F.col("e") / rate).alias("end_sec"))


def silence_metrics(windows: DataFrame, runs: DataFrame, rate: int) -> DataFrame:
    """file, duration_sec, silence_sec, leading_sec, trailing_sec, internal_sec, internal_count, voiced_ratio."""
    total = windows.groupBy("file").agg((F.max("frames") / rate).alias("duration_sec"))
    met = total.join(runs, "file", "left").withColumn("len", F.col("end_sec") - F.col("start_sec"))
    lead, trail = F.col("start_sec") <= 0.001, F.col("end_sec") >= F.col("duration_sec") - 0.001
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0.0))
    by = met.groupBy("file", "duration_sec").agg(some(F.lit(True)).alias("silence_sec"), some(lead).alias("leading_sec"), some(trail).alias("trailing_sec"), some(~lead & ~trail).alias("internal_sec"), F.count_if(~lead & ~trail).alias("internal_count"))
    return by.withColumn("voiced_ratio", F.coalesce(F.greatest(F.lit(0.0), F.col("duration_sec") - F.col("silence_sec")) / F.nullif("duration_sec", F.lit(0.0)), F.lit(0.0)))


def pause_outliers(metrics: DataFrame, factor: float = 1.35) -> DataFrame:
    """``metrics`` with language -> file, language, flags: what is unlike the medians of its language. Languages of one file have no rows, nor have files without a flag."""
    names = ("duration_sec", "internal_sec", "internal_count", "leading_sec", "trailing_sec", "voiced_ratio")
    med = metrics.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[F.median(c).alias("m_" + c) for c in names]).where("n >= 2")
    x, m = F.col, lambda c: F.col("m_" + c)
    ratio = x("duration_sec") / F.nullif(m("duration_sec"), F.lit(0.0))
    over = lambda c, *more: x(c) > F.greatest(*more)
    flags = {
        "long": ratio > factor, "short": ratio < 1 / factor,
        "pause_time": over("internal_sec", m("internal_sec") * 1.8, m("internal_sec") + 0.35), "pause_count": over("internal_count", m("internal_count") * 1.8, m("internal_count") + 2),
        "lead": over("leading_sec", F.lit(0.5), m("leading_sec") * 1.8, m("leading_sec") + 0.2), "trail": over("trailing_sec", F.lit(0.5), m("trailing_sec") * 1.8, m("trailing_sec") + 0.2),
        "low_voice": x("voiced_ratio") < F.least(m("voiced_ratio") * 0.88, m("voiced_ratio") - 0.08),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return metrics.join(med, "language").select("file", "language", F.array_join(found, ",").alias("flags")).where("flags <> ''")


def wav_samples(data: bytes) -> tuple[np.ndarray, int, int]:
    """(samples, channels, rate) of a WAV file of 8, 16 or 32 bits; 8 bits are moved to zero."""
    with wave.open(io.BytesIO(data)) as f:
        width, raw = f.getsampwidth(), f.readframes(f.getnframes())
        kinds = {1: "<u1", 2: "<i2", 4: "<i4"}
        if width not in kinds:
            raise ValueError(f"samples of {8 * width} bits")
        out = np.frombuffer(raw, kinds[width]).astype(np.int64)
        return (out - 128 if width == 1 else out), f.getnchannels(), f.getframerate()


def wav_bytes(samples: list[int], rate: int) -> bytes:
    """One channel of 16 bits as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(struct.pack(f"<{len(samples)}h", *samples))
    return out.getvalue()
