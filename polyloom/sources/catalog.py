"""A language catalog in JSON, read into flat tables that queries can join."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMAT_VERSION = 2
_FILE = "struct<name:string,sizeBytes:bigint,installPath:string,url:string,sourcePath:string,archiveFormat:string,extractTo:string,deleteAfterExtract:boolean,installMarkerPath:string,installMarkerVersion:int>"
_PACK = f"struct<feature:string,`from`:string,`to`:string,language:string,languages:array<string>,engine:string,locale:string,region:string,voice:string,quality:string,numSpeakers:int,defaultSpeakerId:int,dictionaryCode:string,kind:string,files:array<{_FILE}>,dependsOn:array<string>>"
_LANGUAGE = "struct<meta:struct<code:string,name:string,shortName:string,script:string>,assets:struct<translate:array<string>,ocr:map<string,string>,dictionary:string,support:array<string>>,tts:struct<defaultRegion:string,regions:map<string,struct<displayName:string,voices:array<string>>>>>"
SCHEMA = f"formatVersion int, generatedAt bigint, dictionaryVersion int, languages map<string,{_LANGUAGE}>, packs map<string,{_PACK}>"


@dataclass(frozen=True)
class Catalog:
    """languages: code, name, script, default_region. packs: pack_id and its attributes. files, deps: by pack and ordinal.

    roots: code, feature, pack_id, ord, what a language asks for. regions: code, region, display_name, pack_id of a voice.
    installed: install_path. markers: marker_path, version.
    """

    languages: DataFrame
    packs: DataFrame
    files: DataFrame
    deps: DataFrame
    roots: DataFrame
    regions: DataFrame
    installed: DataFrame | None = None
    markers: DataFrame | None = None

    def with_installed(self, installed: DataFrame, markers: DataFrame) -> Catalog:
        return replace(self, installed=installed, markers=markers)


def _or_null(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def parse_catalog(documents: DataFrame, json_col: str = "json") -> Catalog:
    """The tables of the catalogs in ``documents``, usually one row. Invalid JSON, or another format version, gives no rows."""
    doc = documents.select(F.from_json(F.col(json_col), SCHEMA).alias("c")).where(f"c.formatVersion = {FORMAT_VERSION}")
    lang = doc.select(F.explode("c.languages").alias("code", "v"))
    pack = doc.select(F.explode("c.packs").alias("pack_id", "v"))
    packs = pack.select("pack_id", "v.feature", F.col("v.from").alias("from_code"), F.col("v.to").alias("to_code"), _or_null("v.language").alias("language"), F.col("v.dictionaryCode").alias("dictionary_code"), _or_null("v.kind").alias("kind"), _or_null("v.engine").alias("engine"), _or_null("v.region").alias("region"), _or_null("v.voice").alias("voice"), _or_null("v.quality").alias("quality"), F.col("v.defaultSpeakerId").alias("default_speaker_id"))
    files = pack.select("pack_id", F.posexplode("v.files").alias("ord", "f")).select("pack_id", "ord", "f.name", F.col("f.installPath").alias("install_path"), "f.url", F.col("f.sizeBytes").alias("size_bytes"), F.col("f.sourcePath").alias("source_path"), F.col("f.archiveFormat").alias("archive_format"), F.col("f.installMarkerPath").alias("marker_path"), F.col("f.installMarkerVersion").alias("marker_version"))
    deps = pack.select("pack_id", F.posexplode("v.dependsOn").alias("ord", "dep_id"))
    regions = lang.select("code", F.explode("v.tts.regions").alias("region", "r")).select("code", "region", F.coalesce(_or_null("r.displayName"), "region").alias("display_name"), F.col("r.voices").alias("voices"))
    default = F.col("region") == F.col("default_region")
    listed = lambda feature, c: lang.select("code", F.lit(feature).alias("feature"), F.posexplode(c).alias("ord", "pack_id"))
    voices = regions.join(lang.select("code", F.col("v.tts.defaultRegion").alias("default_region")), "code").select("code", F.coalesce(~default, F.lit(True)).alias("other"), "region", F.posexplode("voices").alias("p", "pack_id"))
    voices = voices.withColumn("ord", F.row_number().over(Window.partitionBy("code").orderBy("other", "region", "p")) - 1)
    roots = listed("translation", "v.assets.translate").unionByName(listed("support", "v.assets.support"))
    roots = roots.unionByName(lang.select("code", F.explode("v.assets.ocr").alias("engine", "pack_id")).where("engine = 'tesseract'").select("code", F.lit("ocr").alias("feature"), F.lit(0).alias("ord"), "pack_id"))
    roots = roots.unionByName(lang.where("v.assets.dictionary is not null").select("code", F.lit("dictionary").alias("feature"), F.lit(0).alias("ord"), F.col("v.assets.dictionary").alias("pack_id")))
    roots = roots.unionByName(voices.groupBy("code", "pack_id").agg(F.min("ord").alias("ord")).select("code", F.lit("tts").alias("feature"), "ord", "pack_id"))
    languages = lang.select("code", F.col("v.meta.name").alias("name"), F.col("v.meta.script").alias("script"), F.col("v.tts.defaultRegion").alias("default_region"))
    return Catalog(languages, packs, files, deps, roots, regions.select("code", "region", "display_name", F.explode("voices").alias("pack_id")))


def catalog_errors(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """error: what makes a catalog unfit as a whole: no JSON, another format version, or a language whose recognition pack is missing or oddly named. No rows: it is good."""
    parsed = documents.select(F.from_json(F.col(json_col), SCHEMA).alias("c"))
    head = parsed.where(F.coalesce(F.col("c.formatVersion") != FORMAT_VERSION, F.lit(True))).select(F.when(F.col("c.formatVersion").isNull(), "no catalog").otherwise(F.concat(F.lit("format version "), F.col("c.formatVersion").cast("string"))).alias("error"))
    good = parsed.where(F.col("c.formatVersion") == FORMAT_VERSION).select("c.packs", F.explode("c.languages").alias("code", "v"))
    pack = F.try_element_at("packs", F.coalesce(F.try_element_at("v.assets.ocr", F.lit("tesseract")), F.lit("")))
    name = F.get(pack["files"], F.lit(0))["name"]
    odd = good.where(~F.coalesce(name.endswith(".traineddata"), F.lit(False))).select(F.concat(F.lit("recognition pack of "), "code").alias("error"))
    return head.unionByName(odd)


def read_catalog(spark: SparkSession, path: str, strict: bool = True) -> Catalog:
    """The tables of the catalog in a file. ``strict``: an error if any part of it is unfit; else unfit catalogs give no rows, and odd languages stay."""
    text = spark.read.text(path, wholetext=True)
    if strict and (wrong := [r["error"] for r in catalog_errors(text, "value").limit(20).collect()]):
        raise ValueError("; ".join(sorted(wrong)))
    return parse_catalog(text, "value")


def best_catalog(bundled: Column, disk: Column) -> Column:
    """struct(choice, error) from two JSON texts: the newer valid one, at a tie the one on disk; error if neither is valid."""
    head = lambda c: F.from_json(c, "formatVersion int, generatedAt bigint")
    ok = lambda c: F.coalesce((head(c)["formatVersion"] == FORMAT_VERSION) & head(c)["generatedAt"].isNotNull(), F.lit(False))
    newer = head(disk)["generatedAt"] >= head(bundled)["generatedAt"]
    choice = F.when(ok(bundled) & ok(disk), F.when(newer, "disk").otherwise("bundled")).when(ok(bundled), "bundled").when(ok(disk), "disk")
    return F.struct(choice.alias("choice"), F.when(choice.isNull(), F.when(disk.isNull(), "Bundled catalog invalid").otherwise("Both catalogs invalid")).alias("error"))
