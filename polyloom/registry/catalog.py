"""Catalog queries over a small catalog that both engines see: as JSON here, as literal rows in SQL."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from polyloom.functions.text import voice_display_name as display_name
from polyloom.operators import catalog as c
from polyloom.registry.base import values_df, values_sql
from polyloom.sources.catalog import best_catalog, parse_catalog

_LANGS = [("en", "English", "Latn", "us"), ("es", "Spanish", "Latn", "mx"), ("fr", "French", "Latn", None), ("ja", "Japanese", "Jpan", "jp"), ("xx", "Empty", "Latn", None)]
# pack_id, feature, from, to, language, dictionary_code, kind, engine, region, voice, quality, default speaker, dependencies
_PACKS = [
    ("mt-en-es", "translation", "en", "es", None, None, None, None, None, None, None, None, ["mt-core"]),
    ("mt-es-en", "translation", "es", "en", None, None, None, None, None, None, None, None, ["mt-core"]),
    ("mt-en-fr", "translation", "en", "fr", None, None, None, None, None, None, None, None, ["mt-core", "mt-fr-vocab"]),
    ("mt-fr-en", "translation", "fr", "en", None, None, None, None, None, None, None, None, ["mt-core", "mt-fr-vocab"]),
    ("mt-ja-en", "translation", "ja", "en", None, None, None, None, None, None, None, None, ["mt-core", "lost"]),
    ("mt-core", "support", None, None, None, None, "runtime", None, None, None, None, None, ["mt-base"]),
    ("mt-base", "support", None, None, None, None, "runtime", None, None, None, None, None, []),
    ("mt-fr-vocab", "support", None, None, "fr", None, None, None, None, None, None, None, []),
    ("filter", "support", None, None, None, None, "adblock", None, None, None, None, None, ["mt-base"]),
    ("rules", "support", None, None, "es", None, "adblock", None, None, None, None, None, ["mt-base"]),
    ("scan-en", "ocr", None, None, "en", None, None, "tesseract", None, None, None, None, []),
    ("scan-es", "ocr", None, None, "es", None, None, "tesseract", None, None, None, None, []),
    ("words-en", "dictionary", None, None, "en", "en", None, None, None, None, None, None, []),
    ("words-es", "dictionary", None, None, "es", "es", None, None, None, None, None, None, ["words-en"]),
    ("say-en-1", "tts", None, None, "en", None, None, "piper", "us", "en_amy-low", "low", 7, ["phonemes"]),
    ("say-en-2", "tts", None, None, "en", None, None, "kokoro", "gb", "af_new-star", None, None, ["phonemes"]),
    ("say-es-1", "tts", None, None, "es", None, None, None, "es", "es_carlos", "high", 8, ["phonemes"]),
    ("say-es-2", "tts", None, None, "es", None, None, "piper", "mx", "es_rosa_maria", "medium", None, ["phonemes"]),
    ("phonemes", "support", None, None, None, None, "speech", None, None, None, None, None, []),
]
# pack_id, ord, name, install_path, url, size, source_path, archive_format, marker_path, marker_version
_FILES = [
    ("mt-en-es", 0, "model.enes.bin", "mt/model.enes.bin", "u/1.gz", 20, None, None, None, None), ("mt-en-es", 1, "lex.enes.bin", "mt/lex.enes.bin", "u/2", 21, "s/2.gz", None, None, None), ("mt-en-es", 2, "vocab.a.spm", "mt/vocab.a.spm", "u/3", 22, None, None, None, None), ("mt-en-es", 3, "vocab.z.spm", "mt/vocab.z.spm", "u/4", 23, None, None, None, None),
    ("mt-es-en", 0, "model.esen.bin", "mt/model.esen.bin", "u/5", 24, None, None, None, None), ("mt-es-en", 1, "lex.esen.bin", "mt/lex.esen.bin", "u/6", 25, None, None, None, None), ("mt-es-en", 2, "vocab.b.spm", "mt/vocab.b.spm", "u/7", 26, None, None, None, None),
    ("mt-en-fr", 0, "model.enfr.bin", "mt/model.enfr.bin", "u/8", 30, None, None, None, None), ("mt-en-fr", 1, "lex.enfr.bin", "mt/lex.enfr.bin", "u/9", 31, None, None, None, None), ("mt-en-fr", 2, "vocab.f.spm", "mt/vocab.f.spm", "u/10", 32, None, None, None, None),
    ("mt-fr-en", 0, "model.fren.bin", "mt/model.fren.bin", "u/11", 33, None, None, None, None), ("mt-fr-en", 1, "vocab.f.spm", "mt/vocab.f.spm", "u/10", 32, None, None, None, None),
    ("mt-ja-en", 0, "model.jaen.bin", "mt/model.jaen.bin", "u/12", 34, None, None, None, None),
    ("mt-core", 0, "core.bin", "mt/core.bin", "u/13.gz", 40, None, None, None, None), ("mt-base", 0, "base.bin", "mt/base.bin", "u/14", 41, None, None, None, None), ("mt-fr-vocab", 0, "fr.bin", "mt/fr.bin", "u/15", 42, None, None, None, None),
    ("filter", 0, "list.txt", "filter/list.txt", "u/16", 43, None, None, None, None), ("rules", 0, "rules.zip", "filter/rules.zip", "u/26", 44, None, "zip", "filter/rules/.done", 1), ("scan-en", 0, "eng.traineddata", "scan/eng.data", "u/17", 10, None, None, None, None), ("scan-es", 0, "spa.data", "scan/spa.data", "u/18", 11, None, None, None, None),
    ("words-en", 0, "en.dict", "words/en.dict", "u/19", 12, None, None, None, None), ("words-es", 0, "es.dict", "words/es.dict", "u/20", 13, None, None, None, None),
    ("say-en-1", 0, "amy.onnx", "say/amy.onnx", "u/21", 50, None, None, None, None), ("say-en-1", 1, "amy.onnx.json", "say/amy.onnx.json", "https://h.org/say/amy.json", 1, None, None, None, None), ("say-en-2", 0, "star.zip", "say/star.zip", "u/22", 51, None, "zip", "say/star/.done", 2), ("say-es-1", 0, "carlos.onnx", "say/carlos.onnx", "u/23", 52, None, None, None, None), ("say-es-2", 0, "rosa.onnx", "say/rosa.onnx", "u/24", 53, None, None, None, None), ("say-es-2", 1, "rosa.onnx.json", "say/rosa.onnx.json", "/say/rosa.json", 2, None, None, None, None),
    ("phonemes", 0, "data.zip", "say/data.zip", "u/25", 54, None, "zip", "say/data/.done", 3),
]
_ASSETS = {"en": ([], "scan-en", "words-en", []), "es": (["mt-es-en", "mt-en-es"], "scan-es", "words-es", ["filter"]), "fr": (["mt-fr-en", "mt-en-fr"], None, None, ["mt-fr-vocab"]), "ja": (["mt-ja-en"], None, None, []), "xx": ([], None, None, [])}
_REGIONS = [("en", "gb", "Britain", "say-en-2"), ("en", "us", "United States", "say-en-1"), ("es", "es", "es", "say-es-1"), ("es", "mx", "Mexico", "say-es-2")]
_INSTALLED = ["mt/model.enes.bin", "mt/lex.enes.bin", "mt/vocab.a.spm", "mt/vocab.z.spm", "mt/model.esen.bin", "mt/lex.esen.bin", "mt/vocab.b.spm", "mt/core.bin", "mt/base.bin", "mt/fr.bin", "mt/model.enfr.bin", "mt/lex.enfr.bin", "mt/vocab.f.spm", "scan/eng.data", "words/es.dict", "say/amy.onnx", "say/amy.onnx.json", "say/carlos.onnx", "say/rosa.onnx", "say/rosa.json", "say/rosa.onnx.json", "filter/list.txt", "bin/espeak-ng-data/phontab"]
_MARKERS = [("say/star/.done", 1), ("say/data/.done", 3)]


def fixture_json() -> str:
    """The catalog as it comes from a server."""
    camel = dict(name=2, installPath=3, url=4, sizeBytes=5, sourcePath=6, archiveFormat=7, installMarkerPath=8, installMarkerVersion=9)
    packs = {}
    for p in _PACKS:
        fields = {"feature": p[1], "from": p[2], "to": p[3], "language": p[4], "dictionaryCode": p[5], "kind": p[6], "engine": p[7], "region": p[8], "voice": p[9], "quality": p[10], "defaultSpeakerId": p[11]}
        packs[p[0]] = {k: v for k, v in fields.items() if v is not None} | {"files": [{k: f[i] for k, i in camel.items() if f[i] is not None} for f in _FILES if f[0] == p[0]], "dependsOn": p[12]}
    languages = {}
    for code, name, script, default in _LANGS:
        translate, ocr, dictionary, support = _ASSETS[code]
        regions: dict = {}
        for k, region, shown, pack in _REGIONS:
            if k == code:
                regions.setdefault(region, {"displayName": "" if shown == region else shown, "voices": []})["voices"].append(pack)
        languages[code] = {"meta": {"code": code, "name": name, "shortName": name, "script": script}, "assets": {"translate": translate, "ocr": {"tesseract": ocr} if ocr else {}, "dictionary": dictionary, "support": support}, "tts": {"defaultRegion": default, "regions": regions} if regions else None}
    return json.dumps({"formatVersion": 2, "generatedAt": 5, "dictionaryVersion": 1, "languages": languages, "packs": packs})


def _snapshot(spark: SparkSession) -> c.Snapshot:
    tables = parse_catalog(values_df(spark, "json string", [(fixture_json(),)]))
    return c.Snapshot(tables.with_installed(values_df(spark, "install_path string", [(x,) for x in _INSTALLED]), values_df(spark, "marker_path string, version int", _MARKERS)))


def _roots() -> list[tuple]:
    out = []
    for code, (translate, ocr, dictionary, support) in _ASSETS.items():
        out += [(code, "translation", i, p) for i, p in enumerate(translate)] + [(code, "support", i, p) for i, p in enumerate(support)]
        out += [(code, "ocr", 0, ocr)] * bool(ocr) + [(code, "dictionary", 0, dictionary)] * bool(dictionary)
        default = dict((x[0], x[3]) for x in _LANGS)[code]
        voices = sorted((r != default, r, p) for k, r, _, p in _REGIONS if k == code)
        out += [(code, "tts", i, v[2]) for i, v in enumerate(voices)]
    return out


def _on(method):
    return lambda spark, sf_dir: method(_snapshot(spark))


_VOICES = [("af_new-star",), ("en_amy-low",), ("es_rosa_maria",), ("plain",), ("x_y",), ("ab_éa-b",)]
_HEADS = [("{\"formatVersion\":2,\"generatedAt\":5}", d) for d in (None, "{\"formatVersion\":2,\"generatedAt\":5}", "{\"formatVersion\":2,\"generatedAt\":4}", "{\"formatVersion\":1,\"generatedAt\":9}", "no json")] + [("{\"formatVersion\":3,\"generatedAt\":5}", d) for d in (None, "{\"formatVersion\":2,\"generatedAt\":1}", "{}")]
_SPEAKERS = [("p", "Amy Low", None), ("p", "bob", None), ("p", "none", 9), ("p", "none", None), ("q", "none", None), ("r", "none", None), ("s", "x", None), ("t", "x", None)]
_SPEAKER_IDS = [("p", "amy-low", 1), ("p", "bob", 2), ("p", "BOB", 3), ("p", "neutral", 4), ("q", "default", 5), ("q", "z", 6), ("r", "only", 7), ("t", "one", 1), ("t", "two", 2)]
_SELECTED = [("en", "say-en-1"), ("es", "say-es-2")]


def best_catalog_choice(spark, sf_dir):
    return values_df(spark, "n int, bundled string, disk string", [(i, *h) for i, h in enumerate(_HEADS)]).select("n", best_catalog(F.col("bundled"), F.col("disk")).alias("b")).select("n", "b.choice", "b.error")


QUERIES = {
    "catalog_closure": _on(lambda s: s.reach),
    "pack_sizes": _on(lambda s: s.sizes()),
    "language_sizes": _on(lambda s: s.language_sizes()),
    "pack_status": _on(lambda s: s.status),
    "availability": _on(lambda s: s.availability()),
    "language_overview": _on(lambda s: s.overview()),
    "plan_download": _on(lambda s: s.plan_download()),
    "plan_delete_language": _on(lambda s: s.plan_delete("core")),
    "plan_delete_dictionary": _on(lambda s: s.plan_delete("dictionary")),
    "plan_delete_tts": _on(lambda s: s.plan_delete("tts")),
    "plan_delete_superseded": lambda spark, sf_dir: _snapshot(spark).plan_delete_superseded(values_df(spark, "code string, pack_id string", _SELECTED)),
    "support_by_kind": _on(lambda s: s.support_by_kind()),
    "support_download": _on(lambda s: s.downloads(s.catalog.packs.where("feature = 'support' and kind is not null").select("kind", "pack_id"), "kind")),
    "routes_matrix": _on(lambda s: s.routes().select("from_code", "to_code", F.array_join("steps", ",").alias("steps"))),
    "can_translate": _on(lambda s: s.catalog.languages.select(F.col("code").alias("from_code")).crossJoin(s.catalog.languages.select(F.col("code").alias("to_code"))).join(s.routes().select("from_code", "to_code", F.lit(True).alias("ok")), ["from_code", "to_code"], "left").select("from_code", "to_code", F.coalesce("ok", F.lit(False)).alias("can_translate"))),
    "can_swap": _on(lambda s: s.can_swap()),
    "translation_directions": _on(lambda s: s.directions()),
    "voice_picker": _on(lambda s: s.voice_picker()),
    "voice_display_name": lambda spark, sf_dir: values_df(spark, "name string", _VOICES).select("name", display_name(F.col("name")).alias("shown")),
    "pack_batch_select": _on(lambda s: c.pack_batch(s.catalog.packs, "tts", "piper", 2).select("pack_id", "language", "voice")),
    "resolve_speaker": lambda spark, sf_dir: c.resolve_speaker(values_df(spark, "pack_id string, name string, default_id int", _SPEAKERS), values_df(spark, "pack_id string, voice string, speaker_id int", _SPEAKER_IDS)),
    "best_catalog_choice": best_catalog_choice,
}

# ---- SQL ----

_CTE = "with recursive " + ",\n".join(
    f"{name} as ({sql})"
    for name, sql in {
        "languages": values_sql("code string, name string, script string, default_region string", _LANGS),
        "packs": values_sql("pack_id string, feature string, from_code string, to_code string, language string, dictionary_code string, kind string, engine string, region string, voice string, quality string, default_speaker_id int", [p[:12] for p in _PACKS]),
        "deps": values_sql("pack_id string, dep_id string", [(p[0], d) for p in _PACKS for d in p[12]]),
        "files": values_sql("pack_id string, ord int, name string, install_path string, url string, size_bytes long, source_path string, archive_format string, marker_path string, marker_version int", _FILES),
        "roots": values_sql("code string, feature string, ord int, pack_id string", _roots()),
        "regions": values_sql("code string, region string, display_name string, pack_id string", _REGIONS),
        "installed": values_sql("install_path string", [(x,) for x in _INSTALLED]),
        "markers": values_sql("marker_path string, version int", _MARKERS),
        "reach": "select pack_id as root, pack_id from packs union select r.root, d.dep_id from reach r join deps d on d.pack_id = r.pack_id",
        "missing": "select * from files f where case when marker_path is not null and marker_version is not null then not exists (select 1 from markers m where m.marker_path = f.marker_path and m.version = f.marker_version) else install_path not in (select install_path from installed) end",
        "bad": "select distinct root as pack_id from reach where pack_id in (select pack_id from missing) or pack_id not in (select pack_id from packs)",
        "status": "select pack_id, pack_id not in (select pack_id from bad) as installed, (select count(*) from missing m where m.pack_id = p.pack_id) as missing_files, (select count(*) from deps d where d.pack_id = p.pack_id and (d.dep_id in (select pack_id from bad) or d.dep_id not in (select pack_id from packs))) as missing_deps from packs p",
        "here": "select pack_id from status where installed",
        "sizes": "select p.pack_id, coalesce((select sum(size_bytes) from files f where f.pack_id = p.pack_id), 0)::bigint as own_bytes, coalesce((select sum(s) from (select f.install_path, min_by(size_bytes, f.pack_id) as s from reach r join files f on f.pack_id = r.pack_id where r.root = p.pack_id group by 1)), 0)::bigint as size_bytes from packs p",
        "lsizes": "select code, " + ", ".join(f"coalesce((select sum(size_bytes) from roots r join sizes s using (pack_id) where r.code = l.code and feature = '{f}'), 0)::bigint as {f}_bytes" for f in ("translation", "tts", "dictionary")) + " from languages l",
        "core": "select distinct code, pack_id from roots where feature in ('ocr', 'support') or (feature = 'translation' and code <> 'en')",
        "wants": "select code, 'core' as part, pack_id as root from core union all select code, 'dictionary', pack_id from roots where feature = 'dictionary' union all select code, 'tts', pack_id from roots where feature = 'tts' and ord = 0",
        "tasks": "select code, part, m.install_path, min(m.pack_id) as pack_id from wants w join reach r on r.root = w.root join missing m on m.pack_id = r.pack_id group by all",
        "plan": "select code, part, t.pack_id, install_path, url, size_bytes, feature = 'translation' and coalesce(source_path, url) like '%.gz' as decompress from tasks t join files f using (pack_id, install_path) join packs p using (pack_id)",
        "dirs": "select from_code as f, to_code as t from packs where feature = 'translation' and pack_id in (select pack_id from here)",
        "routes": "select code as from_code, code as to_code, '' as steps from languages union all select f, t, f || '-' || t from dirs where 'en' in (f, t) union all select a.f, b.t, a.f || '-' || a.t || ',' || b.f || '-' || b.t from dirs a join dirs b on a.t = 'en' and b.f = 'en' and a.f <> b.t",
    }.items()
)


def _delete_sql(roots: str, targets: str, keep: str) -> str:
    """roots, targets, keep: SELECTs of code, pack_id."""
    return f"""{_CTE}, rts as ({roots}), tgt as ({targets}), kp as ({keep}),
gone as (select distinct t.code, r.pack_id from tgt t join reach r on r.root = t.pack_id where not exists (select 1 from kp k join reach q on q.root = k.pack_id where k.code = t.code and q.pack_id = r.pack_id))
select distinct code, 'file' as kind, install_path as path from gone join files using (pack_id)
union select distinct code, 'directory', regexp_extract(marker_path, '^(.*)/[^/]*$', 1) from gone join files using (pack_id) where archive_format = 'zip' and regexp_extract(marker_path, '^(.*)/[^/]*$', 1) <> ''"""


_OTHERS = "select l.code, r.pack_id from languages l join rts r on r.code <> l.code where r.pack_id in (select pack_id from here)"
_OF = lambda f: f"select code, pack_id from roots where feature = '{f}'"
_PLAIN = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
_HEAD = lambda x: f"coalesce(try_cast(try_cast({x} as json) ->> 'formatVersion' as int) = 2 and (try_cast({x} as json) ->> 'generatedAt') is not null, false)"

ORACLES = {
    "catalog_closure": f"{_CTE} select root, pack_id from reach",
    "pack_sizes": f"{_CTE} select * from sizes",
    "language_sizes": f"{_CTE} select * from lsizes",
    "pack_status": f"{_CTE} select * from status",
    "availability": f"{_CTE} select code, code = 'en' or exists (select 1 from dirs where f = 'en' and t = code) as has_from_english, code = 'en' or exists (select 1 from dirs where t = 'en' and f = code) as has_to_english, " + ", ".join(f"exists (select 1 from roots r join here using (pack_id) where r.code = l.code and r.feature = '{f}') as {f}_files" for f in ("ocr", "dictionary", "tts")) + " from languages l",
    "language_overview": f"{_CTE} select code, translation_bytes, tts_bytes, dictionary_bytes, translation_bytes > 0 and not exists (select 1 from tasks t where t.code = l.code and part = 'core') as core_installed, dictionary_bytes > 0 and not exists (select 1 from tasks t where t.code = l.code and part = 'dictionary') as dictionary_installed, (select count(*) from roots r where r.code = l.code and feature = 'tts') as voices, (select count(*) from roots r join here using (pack_id) where r.code = l.code and feature = 'tts') as installed_voices from lsizes l",
    "plan_download": f"{_CTE} select * from plan",
    "plan_delete_language": _delete_sql("select * from core", "select * from rts", _OTHERS),
    "plan_delete_dictionary": _delete_sql(_OF("dictionary"), "select * from rts", _OTHERS + " except select code, pack_id from rts"),
    "plan_delete_tts": _delete_sql(_OF("tts"), "select * from rts where pack_id in (select pack_id from here)", _OTHERS),
    "plan_delete_superseded": _delete_sql(_OF("tts"), f"select r.code, r.pack_id from rts r join ({values_sql('code string, pack_id string', _SELECTED)}) s on s.code = r.code and s.pack_id <> r.pack_id where r.pack_id in (select pack_id from here)", f"{_OTHERS} union select code, pack_id from ({values_sql('code string, pack_id string', _SELECTED)}) where pack_id in (select pack_id from here)"),
    "support_by_kind": f"{_CTE}, k as (select kind, pack_id as root from packs where feature = 'support' and kind is not null), u as (select kind, install_path, min_by(size_bytes, f.pack_id) as s from k join reach using (root) join files f on f.pack_id = reach.pack_id group by all) select kind, (select count(*) from k where k.kind = u.kind) as packs, count(*) as files, sum(s)::bigint as bytes from u group by kind",
    "support_download": f"{_CTE}, k as (select kind, pack_id as root from packs where feature = 'support' and kind is not null), t as (select kind, install_path, min(m.pack_id) as pack_id from k join reach r using (root) join missing m on m.pack_id = r.pack_id group by all) select t.kind, t.pack_id, install_path, url, size_bytes, feature = 'translation' and coalesce(source_path, url) like '%.gz' as decompress from t join files using (pack_id, install_path) join packs p using (pack_id)",
    "routes_matrix": f"{_CTE} select * from routes",
    "can_translate": f"{_CTE} select a.code as from_code, b.code as to_code, exists (select 1 from routes r where r.from_code = a.code and r.to_code = b.code) as can_translate from languages a, languages b",
    "can_swap": f"{_CTE} select distinct a.from_code, a.to_code from packs a join packs b on a.from_code = b.to_code and a.to_code = b.from_code and a.feature = 'translation' and b.feature = 'translation'",
    "translation_directions": f"{_CTE}, g as (select pack_id, min(name) filter (name like 'model.%') as model, min(name) filter (name like 'lex.%') as lex, list_sort(list(name) filter (name like '%vocab%')) as v from files join packs using (pack_id) where feature = 'translation' group by 1) select pack_id, model, lex, v[1] as src_vocab, coalesce(v[2], v[1]) as tgt_vocab from g where model is not null and lex is not null and len(v) > 0",
    "voice_picker": f"{_CTE} select r.code, r.region, display_name, coalesce(r.region = default_region, false) as first, p.pack_id, coalesce(voice, p.pack_id) as voice from regions r join packs p on p.pack_id = r.pack_id and feature = 'tts' join languages l on l.code = r.code",
    "voice_display_name": f"select name, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(name, '^[a-z]{{2}}_', ''), '[_-]'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), ' ') as shown from ({values_sql('name string', _VOICES)})",
    "pack_batch_select": f"{_CTE} select pack_id, language, voice from packs where feature = 'tts' and coalesce(engine, 'piper') = 'piper' order by language, voice, quality, pack_id limit 2",
    "resolve_speaker": f"with a as ({values_sql('pack_id string, name string, default_id int', _SPEAKERS)}), v as ({values_sql('pack_id string, voice string, speaker_id int', _SPEAKER_IDS)}), m as (select a.pack_id, a.name, coalesce(min(speaker_id) filter (voice = name), min(speaker_id) filter ({_PLAIN('voice')} = {_PLAIN('name')}), default_id, min(speaker_id) filter (voice = 'neutral'), min(speaker_id) filter (voice = 'default'), case when count(voice) = 1 then min(speaker_id) end) as speaker_id from a left join v on v.pack_id = a.pack_id group by a.pack_id, a.name, default_id) select *, case when speaker_id is null then 'no voice' end as error from m",
    "best_catalog_choice": f"with h as ({values_sql('n int, bundled string, disk string', [(i, *h) for i, h in enumerate(_HEADS)])}), k as (select *, {_HEAD('bundled')} as b, {_HEAD('disk')} as d from h), g as (select n, disk, case when b and d then case when (disk::json ->> 'generatedAt')::int >= (bundled::json ->> 'generatedAt')::int then 'disk' else 'bundled' end when b then 'bundled' when d then 'disk' end as choice from k) select n, choice, case when choice is null then case when disk is null then 'Bundled catalog invalid' else 'Both catalogs invalid' end end as error from g",
}
