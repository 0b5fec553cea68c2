"""Questions to a language catalog: closures, install states, routes, and what to download or delete.

Everything is relational over the closure of dependencies; plans are returned, never carried out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyloom.plans.shared import materialize
from polyloom.sources.catalog import Catalog


def closure(deps: DataFrame, roots: DataFrame) -> DataFrame:
    """root, pack_id: all that each of ``roots`` (pack_id) reaches over ``deps`` (pack_id, dep_id), itself included.

    Paths double in each round, so the rounds are the logarithm of the deepest chain; cycles end like any other.
    Ids without a pack are kept.
    """
    edges = deps.select("pack_id", "dep_id").distinct()
    nodes = edges.select("pack_id").union(edges.select("dep_id")).union(roots.select("pack_id")).distinct()
    reach = materialize(edges.select(F.col("pack_id").alias("root"), F.col("dep_id").alias("pack_id")).union(nodes.select(F.col("pack_id").alias("root"), "pack_id")).distinct(), "reach")
    before = reach.count()
    while True:
        onward = reach.select(F.col("root").alias("pack_id"), F.col("pack_id").alias("next"))
        reach = materialize(reach.join(onward, "pack_id").select("root", F.col("next").alias("pack_id")).distinct(), "reach")
        after = reach.count()
        if after == before:
            return reach.join(roots.select(F.col("pack_id").alias("root")).distinct(), "root", "left_semi")
        before = after


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in that order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


class Snapshot:
    """A catalog with what is installed. Each property is a table; those that others build on are written once."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    @cached_property
    def reach(self) -> DataFrame:
        c = self.catalog
        return materialize(closure(c.deps, c.packs.select("pack_id").union(c.roots.select("pack_id"))), "closure")

    @cached_property
    def missing(self) -> DataFrame:
        """The files that aren't there: by their marker, if they have path and version of one, else by their own path."""
        c = self.catalog
        marked = F.col("marker_path").isNotNull() & F.col("marker_version").isNotNull()
        by_marker = c.files.where(marked).join(c.markers.select("marker_path", F.col("version").alias("marker_version")).distinct(), ["marker_path", "marker_version"], "left_anti")
        return by_marker.unionByName(c.files.where(~marked).join(c.installed, "install_path", "left_anti"))

    @cached_property
    def status(self) -> DataFrame:
        """pack_id, installed, missing_files, missing_deps. A pack is installed if nothing in its closure is missing or unknown."""
        c = self.catalog
        gone = self.missing.groupBy("pack_id").agg(F.count(F.lit(1)).alias("missing_files"))
        unknown = c.deps.select(F.col("dep_id").alias("pack_id")).join(c.packs, "pack_id", "left_anti")
        broken = gone.select("pack_id").union(unknown).distinct()
        bad = self.reach.join(broken, "pack_id", "left_semi").select(F.col("root").alias("pack_id")).distinct()
        bad_deps = c.deps.join(bad.union(unknown).select(F.col("pack_id").alias("dep_id")), "dep_id", "left_semi").groupBy("pack_id").agg(F.count(F.lit(1)).alias("missing_deps"))
        out = c.packs.select("pack_id").join(gone, "pack_id", "left").join(bad_deps, "pack_id", "left").join(bad.withColumn("bad", F.lit(True)), "pack_id", "left")
        return materialize(out.select("pack_id", F.col("bad").isNull().alias("installed"), F.coalesce("missing_files", F.lit(0)).alias("missing_files"), F.coalesce("missing_deps", F.lit(0)).alias("missing_deps")), "status")

    @cached_property
    def _installed(self) -> DataFrame:
        return self.status.where("installed").select("pack_id")

    def core_roots(self) -> DataFrame:
        """code, pack_id: translation (not of English), recognition and support."""
        return self.catalog.roots.where("feature in ('ocr', 'support') or (feature = 'translation' and code <> 'en')").select("code", "pack_id").distinct()

    def sizes(self) -> DataFrame:
        """pack_id, own_bytes, size_bytes: with all it needs, a path counted once."""
        files = self.catalog.files
        own = files.groupBy("pack_id").agg(F.sum("size_bytes").alias("own_bytes"))
        held = first_by(self.reach.join(files, "pack_id"), ["root", "install_path"], "pack_id", "ord").groupBy(F.col("root").alias("pack_id")).agg(F.sum("size_bytes").alias("size_bytes"))
        out = self.catalog.packs.select("pack_id").join(own, "pack_id", "left").join(held, "pack_id", "left")
        return out.select("pack_id", F.coalesce("own_bytes", F.lit(0)).alias("own_bytes"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))

    def language_sizes(self) -> DataFrame:
        """code, and bytes by feature: summed root by root, so that what two roots share counts for each."""
        met = self.catalog.roots.where("feature in ('translation', 'tts', 'dictionary')").join(self.sizes(), "pack_id")
        by = met.groupBy("code").agg(*[F.coalesce(F.sum(F.when(F.col("feature") == f, F.col("size_bytes"))), F.lit(0)).alias(f + "_bytes") for f in ("translation", "tts", "dictionary")])
        return self.catalog.languages.select("code").join(by, "code", "left").fillna(0)

    def availability(self) -> DataFrame:
        """code, has_from_english, has_to_english, ocr_files, dictionary_files, tts_files. English translates to itself."""
        c = self.catalog
        packs = c.packs.where("feature = 'translation'").join(self._installed, "pack_id", "left_semi")
        to = packs.where("from_code = 'en'").select(F.col("to_code").alias("code"), F.lit(True).alias("a")).distinct()
        back = packs.where("to_code = 'en'").select(F.col("from_code").alias("code"), F.lit(True).alias("b")).distinct()
        held = c.roots.join(self._installed, "pack_id", "left_semi").groupBy("code").agg(*[F.bool_or(F.col("feature") == f).alias(f) for f in ("ocr", "dictionary", "tts")])
        out = c.languages.join(to, "code", "left").join(back, "code", "left").join(held, "code", "left")
        no, english = F.lit(False), F.col("code") == "en"
        return out.select("code", (english | F.coalesce("a", no)).alias("has_from_english"), (english | F.coalesce("b", no)).alias("has_to_english"), *[F.coalesce(f, no).alias(f + "_files") for f in ("ocr", "dictionary", "tts")])

    def downloads(self, roots: DataFrame, key: str) -> DataFrame:
        """key, pack_id, install_path, url, size_bytes, decompress: what is missing for each key of ``roots`` (key, pack_id), a path once."""
        met = roots.select(key, F.col("pack_id").alias("root")).join(self.reach, "root").join(self.missing, "pack_id")
        tasks = first_by(met, [key, "install_path"], "pack_id", "ord").join(self.catalog.packs.select("pack_id", "feature"), "pack_id")
        zipped = (F.col("feature") == "translation") & F.coalesce("source_path", "url").endswith(".gz")
        return tasks.select(key, "pack_id", "install_path", "url", "size_bytes", zipped.alias("decompress"))

    def plan_download(self) -> DataFrame:
        """code, part (core, dictionary, tts) and tasks; tts is the default voice, the first of the default region."""
        roots = self.catalog.roots
        parts = {"core": self.core_roots(), "dictionary": roots.where("feature = 'dictionary'").select("code", "pack_id"), "tts": roots.where("feature = 'tts' and ord = 0").select("code", "pack_id")}
        tasks = [self.downloads(r, "code").withColumn("part", F.lit(k)) for k, r in parts.items()]
        return tasks[0].unionByName(tasks[1]).unionByName(tasks[2])

    def overview(self) -> DataFrame:
        """code, sizes, and whether core and dictionary are complete: some size, and nothing to download."""
        tasks = self.plan_download().groupBy("code").agg(F.bool_or(F.col("part") == "core").alias("core"), F.bool_or(F.col("part") == "dictionary").alias("dictionary"))
        voices = self.catalog.roots.where("feature = 'tts'").join(self.status, "pack_id").groupBy("code").agg(F.count(F.lit(1)).alias("voices"), F.count_if("installed").alias("installed_voices"))
        met = self.language_sizes().join(tasks, "code", "left").join(voices, "code", "left")
        no = F.lit(False)
        return met.select("code", "translation_bytes", "tts_bytes", "dictionary_bytes", ((F.col("translation_bytes") > 0) & ~F.coalesce("core", no)).alias("core_installed"), ((F.col("dictionary_bytes") > 0) & ~F.coalesce("dictionary", no)).alias("dictionary_installed"), F.coalesce("voices", F.lit(0)).alias("voices"), F.coalesce("installed_voices", F.lit(0)).alias("installed_voices"))

    def deletions(self, targets: DataFrame, keep: DataFrame) -> DataFrame:
        """code, kind, path: the files of what ``targets`` (code, pack_id) reach and ``keep`` (code, pack_id) don't, and folders of archives."""
        spread = lambda rows: rows.select("code", F.col("pack_id").alias("root")).join(self.reach, "root").select("code", "pack_id").distinct()
        gone = spread(targets).join(spread(keep), ["code", "pack_id"], "left_anti").join(self.catalog.files, "pack_id")
        files = gone.select("code", F.lit("file").alias("kind"), F.col("install_path").alias("path"))
        folders = gone.where("archive_format = 'zip'").select("code", F.lit("directory").alias("kind"), F.regexp_extract("marker_path", "^(.*)/[^/]*$", 1).alias("path")).where("path <> ''")
        return files.union(folders).distinct()

    def _others(self, roots: DataFrame) -> DataFrame:
        """For each code, the installed ones among the roots of all other codes."""
        mine, theirs = self.catalog.languages.select("code"), roots.join(self._installed, "pack_id", "left_semi").withColumnRenamed("code", "other")
        return mine.join(theirs, F.col("code") != F.col("other")).select("code", "pack_id").distinct()

    def plan_delete(self, part: str) -> DataFrame:
        """code, kind, path for each language: ``core``, ``dictionary`` or ``tts``. What other languages have installed and need stays."""
        roots = self.core_roots() if part == "core" else self.catalog.roots.where(F.col("feature") == part).select("code", "pack_id")
        targets = roots.join(self._installed, "pack_id", "left_semi") if part == "tts" else roots
        keep = self._others(roots)
        if part == "dictionary":
            keep = keep.join(roots, ["code", "pack_id"], "left_anti")
        return self.deletions(targets, keep)

    def plan_delete_superseded(self, selected: DataFrame) -> DataFrame:
        """code, kind, path: installed voices of each code but the ``selected`` (code, pack_id) one."""
        voices = self.catalog.roots.where("feature = 'tts'").select("code", "pack_id")
        old = voices.join(self._installed, "pack_id", "left_semi").join(selected.select("code"), "code", "left_semi").join(selected, ["code", "pack_id"], "left_anti")
        keep = self._others(voices).union(selected.join(self._installed, "pack_id", "left_semi").select("code", "pack_id"))
        return self.deletions(old, keep)

    def support_by_kind(self) -> DataFrame:
        """kind, packs, files, bytes: the support packs of a kind, with all they need."""
        roots = self.catalog.packs.where("feature = 'support' and kind is not null").select("kind", F.col("pack_id").alias("root"))
        files = first_by(roots.join(self.reach, "root").join(self.catalog.files, "pack_id"), ["kind", "install_path"], "pack_id", "ord").groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
        return roots.groupBy("kind").agg(F.count(F.lit(1)).alias("packs")).join(files, "kind", "left").fillna(0)

    def routes(self) -> DataFrame:
        """from_code, to_code, steps (array of keys): what can be translated now; through English if neither end is English."""
        packs = self.catalog.packs.where("feature = 'translation'").join(self._installed, "pack_id", "left_semi").select("from_code", "to_code").distinct()
        key = lambda a, b: F.concat_ws("-", a, b)
        same = self.catalog.languages.select(F.col("code").alias("from_code"), F.col("code").alias("to_code"), F.expr("cast(array() as array<string>)").alias("steps"))
        one = packs.where("from_code = 'en' or to_code = 'en'").select("from_code", "to_code", F.array(key("from_code", "to_code")).alias("steps"))
        on = packs.where("from_code = 'en'").select(F.col("to_code").alias("onto"))
        two = packs.where("to_code = 'en'").join(on, F.col("from_code") != F.col("onto")).select("from_code", F.col("onto").alias("to_code"), F.array(key("from_code", "to_code"), key("to_code", "onto")).alias("steps"))
        return same.unionByName(one).unionByName(two)

    def can_swap(self) -> DataFrame:
        """from_code, to_code of pairs whose packs exist both ways, installed or not."""
        packs = self.catalog.packs.where("feature = 'translation'").select("from_code", "to_code").distinct()
        return packs.join(packs.select(F.col("to_code").alias("from_code"), F.col("from_code").alias("to_code")), ["from_code", "to_code"], "left_semi")

    def directions(self) -> DataFrame:
        """pack_id, model, lex, src_vocab, tgt_vocab of complete translation packs: of the vocabularies in order of name the first and the second, or the only one."""
        name = F.col("name")
        got = self.catalog.files.groupBy("pack_id").agg(F.min(F.when(name.startswith("model."), name)).alias("model"), F.min(F.when(name.startswith("lex."), name)).alias("lex"), F.sort_array(F.collect_list(F.when(name.contains("vocab"), name))).alias("v"))
        met = self.catalog.packs.where("feature = 'translation'").select("pack_id").join(got, "pack_id").where("model is not null and lex is not null and size(v) > 0")
        return met.select("pack_id", "model", "lex", F.get("v", F.lit(0)).alias("src_vocab"), F.coalesce(F.get("v", F.lit(1)), F.get("v", F.lit(0))).alias("tgt_vocab"))

    def voice_picker(self) -> DataFrame:
        """code, region, display_name, first (whether it's the default region), pack_id, voice. Regions come default first, then by code; those without known voices have no rows."""
        c = self.catalog
        packs = c.packs.where("feature = 'tts'").select("pack_id", F.coalesce("voice", "pack_id").alias("voice"))
        met = c.regions.join(packs, "pack_id").join(c.languages.select("code", "default_region"), "code")
        return met.select("code", "region", "display_name", F.coalesce(F.col("region") == F.col("default_region"), F.lit(False)).alias("first"), "pack_id", "voice")


    def language_list(self) -> DataFrame:
        """The languages in the order of their codes."""
        return self.catalog.languages.orderBy("code")

    def language_info(self) -> DataFrame:
        """code, name, script, tess_name, tess_bytes, dictionary_code, error: what a language's recognition and dictionary packs say of it.

        tess_name is that of the first file of the recognition pack without its ending; the dictionary's code, or the language's own. error
        tells what is wrong with the recognition pack: a catalog with any such error isn't to be used.
        """
        c = self.catalog
        ocr = c.roots.where("feature = 'ocr'").select("code", "pack_id").join(c.packs.select("pack_id", F.lit(True).alias("there")), "pack_id", "left")
        ocr = ocr.join(c.files.groupBy("pack_id").agg(F.min_by("name", "ord").alias("first"), F.sum("size_bytes").alias("tess_bytes")), "pack_id", "left").drop("pack_id")
        words = c.roots.where("feature = 'dictionary'").join(c.packs.select("pack_id", "dictionary_code"), "pack_id").select("code", "dictionary_code")
        met = c.languages.join(ocr, "code", "left").join(words, "code", "left")
        good = F.col("first").endswith(".traineddata")
        error = F.when(F.col("there").isNull(), "no recognition pack").when(F.col("first").isNull(), "recognition pack without files").when(~good, F.concat(F.lit("odd file name "), "first"))
        return met.select("code", "name", "script", F.when(good, F.regexp_replace("first", "[.]traineddata$", "")).alias("tess_name"), F.coalesce("tess_bytes", F.lit(0)).alias("tess_bytes"), F.coalesce("dictionary_code", "code").alias("dictionary_code"), error.alias("error"))

    def voice_files(self) -> DataFrame:
        """code, pack_id, engine, model_path, aux_path, speaker_id of the first installed voice of each language whose model and whose engine's other file are among its files and those it needs."""
        c = self.catalog
        first = first_by(c.roots.where("feature = 'tts'").join(self._installed, "pack_id", "left_semi"), ["code"], "ord").select("code", "pack_id")
        voice = first.join(c.packs.select("pack_id", F.coalesce("engine", F.lit("piper")).alias("engine"), F.col("default_speaker_id").alias("speaker_id")), "pack_id")
        files = voice.withColumnRenamed("pack_id", "root").join(self.reach, "root").join(c.files.select("pack_id", "ord", "name", "install_path"), "pack_id")
        name = F.col("name")
        model = name.endswith(".onnx")
        aux = F.when(F.col("engine") == "kokoro", name.endswith(".bin")).when(F.col("engine") == "mms", name.endswith("tokens.txt")).when(F.col("engine").isin("coqui_vits", "sherpa_vits"), name == "config.json").otherwise(name.endswith(".onnx.json"))
        place = F.struct((F.col("pack_id") != F.col("root")).alias("far"), "pack_id", "ord", "install_path")
        found = files.groupBy("code", F.col("root").alias("pack_id"), "engine", "speaker_id").agg(F.min(F.when(model, place)).alias("m"), F.min(F.when(aux, place)).alias("a"))
        return found.where("m is not null and a is not null").select("code", "pack_id", "engine", F.col("m.install_path").alias("model_path"), F.col("a.install_path").alias("aux_path"), "speaker_id")

    def speech_assets(self, base: str) -> DataFrame:
        """``voice_files`` with full paths, of those whose files are really there, and data_root if the phonemizer's data are; Japanese has dict_path if its dictionary is."""
        root, have = base.rstrip("/"), self.catalog.installed.select("install_path").distinct()
        met = self.voice_files().join(have, F.col("model_path") == F.col("install_path"), "left_semi").join(have, F.col("aux_path") == F.col("install_path"), "left_semi")
        data = self.catalog.installed.where("install_path like 'bin/espeak-ng-data/%'").limit(1).agg((F.count(F.lit(1)) > 0).alias("data")).scalar()
        dictionary = self.catalog.installed.where("install_path = 'bin/mucab.bin'").limit(1).agg((F.count(F.lit(1)) > 0).alias("d")).scalar()
        full = lambda c: F.concat(F.lit(root + "/"), c)
        return met.select("code", "engine", full("model_path").alias("model_path"), full("aux_path").alias("aux_path"), "speaker_id", F.when(data, F.lit(root + "/bin")).alias("data_root"), F.when(data & dictionary & (F.col("code") == "ja"), F.lit(root + "/bin/mucab.bin")).alias("dict_path"))

    def plan_delete_support(self, kind: str) -> DataFrame:
        """kind, path: the files of the support packs of a kind, and folders of archives. Unlike other deletions it doesn't follow what they need, nor spare what others do."""
        gone = self.catalog.packs.where((F.col("feature") == "support") & (F.col("kind") == kind)).select("pack_id").join(self.catalog.files, "pack_id")
        files = gone.select(F.lit("file").alias("kind"), F.col("install_path").alias("path"))
        folders = gone.where("archive_format = 'zip'").select(F.lit("directory").alias("kind"), F.regexp_extract("marker_path", "^(.*)/[^/]*$", 1).alias("path")).where("path <> ''")
        return files.union(folders).distinct()

    def plan_totals(self) -> DataFrame:
        """code, part, tasks, bytes of each download plan; a part without a pack has no row, one with all there has none to load."""
        roots = self.catalog.roots
        parts = self.core_roots().select("code", F.lit("core").alias("part")).union(roots.where("feature = 'dictionary'").select("code", F.lit("dictionary"))).union(roots.where("feature = 'tts' and ord = 0").select("code", F.lit("tts"))).distinct()
        sums = self.plan_download().groupBy("code", "part").agg(F.count(F.lit(1)).alias("tasks"), F.sum("size_bytes").alias("bytes"))
        return parts.join(sums, ["code", "part"], "left").fillna(0, ["tasks", "bytes"])

    def lookup(self, table: str, key: str, value) -> DataFrame:
        """The rows of one of the catalog's tables with a key, such as ``lookup("packs", "pack_id", "x")``."""
        return getattr(self.catalog, table).where(F.col(key) == value)


def pack_batch(packs: DataFrame, feature: str, engine: str | None = None, limit: int | None = None, language: str | None = None) -> DataFrame:
    """The packs of a feature in the order in which a batch takes them: language, voice, quality, id."""
    rows = packs.where(F.col("feature") == feature)
    rows = rows if language is None else rows.where(F.col("language") == language)
    rows = rows if engine is None else rows.where(F.coalesce("engine", F.lit("piper")) == engine)
    order = [F.coalesce(c, F.lit("")) for c in ("language", "voice", "quality")]
    out = rows.orderBy(*order, "pack_id")
    return out if limit is None else out.limit(limit)


def resolve_speaker(asked: DataFrame, voices: DataFrame) -> DataFrame:
    """asked (pack_id, name, default_id), voices (pack_id, voice, speaker_id) -> pack_id, name, speaker_id, error.

    In turn: the exact name, the name without case and marks, the default, ``neutral``, ``default``, the only voice.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    best = lambda cond: F.min(F.when(cond, F.col("speaker_id")))
    met = asked.join(voices, "pack_id", "left").groupBy("pack_id", "name", "default_id").agg(best(F.col("voice") == F.col("name")).alias("a"), best(plain("voice") == plain("name")).alias("b"), best(F.col("voice") == "neutral").alias("c"), best(F.col("voice") == "default").alias("d"), F.when(F.count("voice") == 1, F.min("speaker_id")).alias("e"))
    got = F.coalesce("a", "b", "default_id", "c", "d", "e")
    return met.select("pack_id", "name", got.alias("speaker_id"), F.when(got.isNull(), "no voice").alias("error"))
