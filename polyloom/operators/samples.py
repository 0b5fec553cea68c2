"""Voice samples in batches: which files a pack needs, what is spoken, and a page that lists the results."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyloom.functions.text import file_name, region_flag
from polyloom.operators.catalog import Snapshot, first_by


def plain_name(c: Column) -> Column:
    """Every character but ASCII letters, digits, ``_``, ``.`` and ``-`` becomes ``_``, each for itself."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")


def path_of_url(url: Column) -> Column:
    """What follows the host, or a leading slash; null for anything else, and for a bare host."""
    return F.nullif(F.when(url.rlike("^https?://[^/]*/"), F.regexp_extract(url, "^https?://[^/]*/(.*)$", 1)).when(url.startswith("/"), F.regexp_extract(url, "^/(.*)$", 1)), F.lit(""))


def local_files(files: DataFrame, present: DataFrame) -> DataFrame:
    """``files`` (install_path, url and others) with local_path: the install path if it is among ``present`` (path), else the path of the url if that is, else null."""
    have = lambda k: present.select(F.col("path").alias(k)).distinct()
    met = files.withColumn("__u", path_of_url(F.col("url"))).join(have("__p"), F.col("install_path") == F.col("__p"), "left").join(have("__q"), F.col("__u") == F.col("__q"), "left")
    return met.withColumn("local_path", F.coalesce("__p", "__q")).drop("__u", "__p", "__q")


def find_file(snapshot: Snapshot, packs: DataFrame, matches: Column, present: DataFrame) -> DataFrame:
    """pack_id, found_in, name, local_path, error: the first file of each of packs (pack_id), or of what it needs, for which ``matches`` holds.

    Own files come before those of dependencies, those in the order of their ids. error: a file that isn't there, or none that matches.
    """
    met = packs.select(F.col("pack_id").alias("root")).join(snapshot.reach, "root").join(snapshot.catalog.files.where(matches), "pack_id")
    best = first_by(met.withColumn("far", F.col("pack_id") != F.col("root")), ["root"], "far", "pack_id", "ord")
    got = local_files(best, present)
    out = packs.select(F.col("pack_id").alias("root")).join(got.select("root", F.col("pack_id").alias("found_in"), "name", "local_path"), "root", "left")
    error = F.when(F.col("found_in").isNull(), "no matching file").when(F.col("local_path").isNull(), "file isn't there")
    return out.select(F.col("root").alias("pack_id"), "found_in", "name", "local_path", error.alias("error"))


def support_file(snapshot: Snapshot, kind: str, name: str, present: DataFrame) -> DataFrame:
    """language, local_path of a support file of a kind for each language that has one."""
    c = snapshot.catalog
    packs = c.packs.where((F.col("feature") == "support") & (F.col("kind") == kind) & F.col("language").isNotNull()).select("pack_id", "language")
    met = local_files(packs.join(c.files.where(F.col("name") == name), "pack_id"), present).where("local_path is not null")
    return first_by(met, ["language"], "pack_id").select("language", "local_path")


def joined_samples(chunks: DataFrame, rate: int) -> DataFrame:
    """id, samples of spoken chunks (id, k, samples, pause_ms), in order, each followed by its pause in zeros; a pause of null or 0 is none."""
    zeros = F.when(F.coalesce("pause_ms", F.lit(0)) > 0, F.array_repeat(F.lit(0), F.floor(F.lit(rate) * F.col("pause_ms") / 1000).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    by = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.concat("samples", zeros).alias("s")))).alias("x"))
    return by.select("id", F.flatten(F.transform("x", lambda v: v["s"])).alias("samples"))


def truncated_pcm(sample: Column) -> Column:
    """A float sample as 16 bits, cut towards zero; what is out of range is at the end of it."""
    return F.least(F.greatest(F.when(sample < 0, F.ceil(sample * 32767)).otherwise(F.floor(sample * 32767)), F.lit(-32768)), F.lit(32767)).cast("int")


def process(packs: DataFrame, make: Callable[[dict], bytes], workers: int = 8) -> DataFrame:
    """pack_id, data, error of each pack (with its columns as a dict) by ``make``, in ``workers`` partitions; a failure is an error of that pack alone."""

    schema = pa.schema([("pack_id", pa.string()), ("data", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    rows.append({"pack_id": row["pack_id"], "data": make(row), "error": None})
                except Exception as e:  # noqa: BLE001  one sample's failure doesn't stop the batch
                    rows.append({"pack_id": row["pack_id"], "data": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return packs.repartition(workers, "pack_id").mapInArrow(run, "pack_id string, data binary, error string")


def totals(processed: DataFrame) -> DataFrame:
    """succeeded, failed."""
    return processed.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def audio_href(voices: DataFrame, present: DataFrame) -> DataFrame:
    """``voices`` (language, voice, quality) with href: the first of the two names of their sample that is among ``present`` (path)."""
    quality = F.coalesce(F.nullif("quality", F.lit("")), F.lit("default"))
    name = lambda f: F.concat("language", F.lit("/"), f(F.col("voice")), F.lit("_"), f(quality), F.lit(".ogg"))
    have = lambda k: present.select(F.col("path").alias(k)).distinct()
    met = voices.withColumns({"__a": name(file_name), "__b": name(plain_name)}).join(have("__p"), F.col("__a") == F.col("__p"), "left").join(have("__q"), F.col("__b") == F.col("__q"), "left")
    return met.withColumn("href", F.coalesce("__p", "__q")).drop("__a", "__b", "__p", "__q")


def site_rows(snapshot: Snapshot, present: DataFrame) -> DataFrame:
    """language, name, region, label, ord, voice, quality, engine, href of every voice; languages and regions without one have no rows."""
    c = snapshot.catalog
    packs = c.packs.where("feature = 'tts'").select("pack_id", F.coalesce("voice", F.lit("")).alias("voice"), F.coalesce("quality", F.lit("")).alias("quality"), F.coalesce("engine", F.lit("")).alias("engine"))
    met = c.regions.join(packs, "pack_id").join(c.languages.select("code", "name"), "code").withColumnRenamed("code", "language")
    label = F.trim(F.concat_ws(" ", region_flag(F.col("region")), "display_name"))
    order = Window.partitionBy("language", "region").orderBy("pack_id")
    rows = met.select("language", "name", "region", label.alias("label"), (F.row_number().over(order) - 1).alias("ord"), "voice", "quality", "engine")
    return audio_href(rows, present)


def render_site(rows: DataFrame, title: str = "Voices") -> str:
    """One page from ``site_rows``: a catalog's voices, so few that they are read at once."""
    out, language, region = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>"], None, None
    for r in rows.orderBy("name", "language", "region", "ord").toLocalIterator():
        if r["language"] != language:
            language, region = r["language"], None
            out.append(f"<h2>{html.escape(r['name'] or language)}</h2>")
        if r["region"] != region:
            region = r["region"]
            out.append(f"<h3>{html.escape(r['label'])}</h3>")
        audio = f'<audio controls src="{html.escape(r["href"])}"></audio>' if r["href"] else "<em>no sample</em>"
        out.append(f"<p>{html.escape(' '.join(x for x in (r['voice'], r['quality'], r['engine']) if x))} {audio}</p>")
    return "\n".join(out)
