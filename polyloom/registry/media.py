"""Speech, audio, recognised words and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyloom.functions import speech as s
from polyloom.functions.text import split_sentences
from polyloom.operators import audio, ocr, raster, voices
from polyloom.registry.base import table, values_df, values_sql
from polyloom.registry.text import _SENT, _TRIM, _WSET

_NO_LF = r"[\t\x0B\f\r\x85\p{Z}]"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def speech_paragraphs(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(s.paragraphs(F.col("text"))).alias("p", "paragraph"))


def speech_segments(spark, sf_dir):
    """With the boundary after each: sentence, paragraph, or none after the last."""
    paragraphs = s.paragraphs(F.col("text"))
    flat = _turns(spark, sf_dir).select("conv_id", "turn", F.size(paragraphs).alias("np"), F.posexplode(paragraphs).alias("p", "paragraph"))
    flat = flat.select("conv_id", "turn", "np", "p", F.posexplode(s.segments(F.col("paragraph"))).alias("k", "segment"), F.size(s.segments(F.col("paragraph"))).alias("ns"))
    boundary = F.when(F.col("k") + 1 < F.col("ns"), "sentence").when(F.col("p") + 1 < F.col("np"), "paragraph").otherwise("none")
    return flat.select("conv_id", "turn", "p", "k", "segment", boundary.alias("boundary"))


def _letters(text: str) -> list[tuple[str, str]]:
    """Stands in for a phonemizer: the letters in lower case."""
    return [("".join(c for c in text.lower() if c.isalpha()), "none")]


def speech_chunks(spark, sf_dir):
    chunks = s.plan_chunks(_letters)(F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(chunks).alias("k", "c")).select("conv_id", "turn", "k", "c.content", "c.is_phonemes", "c.pause_after_ms")


def best_pause_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("k", "sentence")).where(F.char_length("sentence") >= 24)
    return rows.select("doc_id", "k", F.inline(F.array_compact(F.array(s.best_pause_split(F.col("sentence"))))))  # not a filter: that would split each twice


def pcm_convert(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", s.pcm(F.col("value") / 10 - 1).alias("sample"), s.pcm(F.lit(1) - F.col("value") / 8).alias("mirrored"))


_RATES = [(r, m) for r in (0, 8000, 22050, 48000) for m in (-5, 0, 1, 40, 333)]


def pcm_silence(spark, sf_dir):
    return values_df(spark, "rate int, ms int", _RATES).select("rate", "ms", s.silence_samples(F.col("rate"), F.col("ms")).alias("samples"), s.duration_ms(s.silence_samples(F.col("rate"), F.col("ms")), F.col("rate")).alias("duration_ms"))


def _samples(spark, sf_dir):
    """A recording for each user: the events in order are samples; every third stretch of thirty is nearly silent."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    ord_ = F.col("n") - 1
    return e.select("file", ord_.alias("ord"), F.when(F.floor((ord_ + F.col("file") * 7) / 30) % 3 == 0, ord_ % 5).otherwise(F.floor(F.col("value") * 300)).cast("int").alias("sample"))


RATE = 100


def silence_runs(spark, sf_dir):
    return audio.silence_runs(audio.silence_windows(_samples(spark, sf_dir), RATE), RATE)


def _metrics(spark, sf_dir):
    w = audio.silence_windows(_samples(spark, sf_dir), RATE)
    return audio.silence_metrics(w, audio.silence_runs(w, RATE), RATE)


def silence_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select("file", *[F.round(c, 6).alias(c) for c in m.columns[1:] if c != "internal_count"], "internal_count")


def pause_outliers(spark, sf_dir):
    return audio.pause_outliers(_metrics(spark, sf_dir).withColumn("language", F.col("file") % 7))


def _words(spark, sf_dir):
    """Words of each benchmark text on a page: ten in a line, three lines in a paragraph, some of little confidence."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("img"), F.posexplode(F.split("text", " ")).alias("ord", "text")).where("text <> ''")
    o, n = F.col("ord"), F.char_length("text")
    left, top = (o % 10) * 100, F.floor(o / 10).cast("int") * 30
    return w.select("img", "ord", "text", ((F.col("img") * 31 + o * 17) % 100).cast("double").alias("confidence"), left.alias("l"), top.alias("t"), (left + n * 8).alias("r"), (top + 20).alias("b"), (o % 10 == 0).alias("first"), (o % 10 == 9).alias("end_line"), (o % 30 == 29).alias("end_para"))


def ocr_confidence_filter(spark, sf_dir):
    return ocr.confidence_filter(_words(spark, sf_dir), 40).select("img", "ord", "text", "first", "end_line", "end_para")


def ocr_lines(spark, sf_dir):
    return ocr.text_lines(_words(spark, sf_dir), 40)


def ocr_blocks(spark, sf_dir):
    return ocr.text_blocks(ocr.text_lines(_words(spark, sf_dir), 40))


def _pixels(spark, sf_dir):
    """Images from orders' lines: one of 64 columns for each part of the order key."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    rgb = lambda m: (F.col("l_partkey") * m + line * 37) % 256
    return table(spark, sf_dir, "lineitem").select((k % 50).alias("img"), (F.floor(k / 50) % 64).alias("x"), (F.floor(k / 3200) * 8 + line).alias("y"), raster.argb(rgb(7), rgb(11), rgb(13)).alias("color"))


def luminance(spark, sf_dir):
    c = F.col("color")
    return _pixels(spark, sf_dir).groupBy("img").agg(F.count(F.lit(1)).alias("pixels"), F.sum(raster.luminance_byte(c)).alias("brightness"), F.count_if(raster.luminance(c) > 0.5).alias("bright"), F.max(raster.channel(c, 2)).alias("most_red"))


def otsu_threshold(spark, sf_dir):
    return raster.otsu_threshold(_pixels(spark, sf_dir).withColumn("v", raster.luminance_byte(F.col("color"))), "img", "v")


_RECTS = [(1, 0, 5, 2, 20, 6), (2, 1, 0, 0, 64, 3), (3, 2, 60, 1, 64, 9), (4, 999, 1, 1, 2, 2)]


def corner_paint(spark, sf_dir):
    return raster.surrounding_color(_pixels(spark, sf_dir), values_df(spark, "rect_id int, img long, l int, t int, r int, b int", _RECTS))


_FILLS = [(1, 0, 0, 5, 4, 4278190080, 4294967295, 4286611584, 4294901760), (2, 3, 3, 4, 4, 4278255360, 4278190335, 4278190080, 4278190080), (3, 0, 0, 0, 9, 1, 1, 1, 1), (4, 2, 0, 18, 1, 4278190080, 4294967295, 4278190080, 4278190080)]
_FILL_COLS = "rect_id int, l int, t int, r int, b int, tl long, tr long, bl long, br long"


def bilinear_fill(spark, sf_dir):
    return raster.bilinear_fill(values_df(spark, _FILL_COLS, _FILLS))


_COLORS = [(i, m, c) for i, (m, c) in enumerate((m, c) for m in ("auto", "black_on_white", "white_on_black") for c in (4278190080, 4294967295, 4286611584, 4278255360))]


def overlay_colors(spark, sf_dir):
    return values_df(spark, "n int, mode string, color long", _COLORS).select("n", raster.overlay_colors(F.col("mode"), F.col("color")).alias("c")).select("n", "c.background", "c.foreground")


_BLOCKS = [(i, m, s, b, f) for i, (m, s, b, f) in enumerate((m, s, b, f) for m in ("auto", "black_on_white", "white_on_black") for s in (None, 4286611584) for b in (None, 1, 16777215, 4278190335) for f in (None, 255, 4294901760))]
_BLOCK_COLS = "n int, mode string, seen long, bg long, fg long"


def block_colors(spark, sf_dir):
    """All combinations of mode, screenshot and style."""
    seen = F.when(F.col("seen").isNotNull(), F.struct(F.col("seen").alias("background"), (F.col("seen") + 1).alias("foreground")))
    return values_df(spark, _BLOCK_COLS, _BLOCKS).select("n", raster.block_colors(F.col("mode"), seen, F.col("bg"), F.col("fg")).alias("c")).select("n", "c.background", "c.foreground")


_VOICES = [("k-en", "kokoro", "en-US", i, n, i * 10) for i, n in enumerate(("jf_aya", "bf_emma", "af_new-star", "am_adam"))] + [("k-xx", "kokoro", "xx", 0, "jf_aya", 1), ("k-xx", "kokoro", "xx", 1, "zf_mei", 2), ("p-de", "piper", "de_DE", 0, "thorsten_low", 5)]
_VOICE_COLS = "model string, engine string, language string, ord int, name string, speaker_id int"
_ASKED = [(1, "k-en", "bf_emma", None), (2, "k-en", "nobody", 30), (3, "k-en", "", None), (4, "p-de", None, 7), (5, "p-de", None, None), (6, "p-de", "thorsten_low", 9), (7, "lost", None, 3)]
_ASKED_COLS = "id int, model string, wanted string, wanted_id int"


def visible_voices(spark, sf_dir):
    return voices.visible(values_df(spark, _VOICE_COLS, _VOICES))


def default_voice(spark, sf_dir):
    return voices.default(values_df(spark, _VOICE_COLS, _VOICES))


def requested_voice(spark, sf_dir):
    return voices.requested(values_df(spark, _ASKED_COLS, _ASKED), values_df(spark, _VOICE_COLS, _VOICES))


QUERIES = {f.__name__: f for f in (speech_paragraphs, speech_segments, speech_chunks, best_pause_split, pcm_convert, pcm_silence, silence_runs, silence_metrics, pause_outliers, ocr_confidence_filter, ocr_lines, ocr_blocks, luminance, otsu_threshold, corner_paint, bilinear_fill, overlay_colors, block_colors, visible_voices, default_voice, requested_voice)}

# ---- SQL ----

_PARA = f"list_filter(string_split(replace(regexp_replace(regexp_replace(regexp_replace({_TRIM('text')}, '{_NO_LF}*\\n{_NO_LF}*', chr(10), 'g'), '\\n{{2,}}', chr(1), 'g'), '([{s.END}])\\n', '\\1' || chr(1), 'g'), chr(10), ' '), chr(1)), lambda p: p <> '')"
_SEG = lambda c: f"list_filter(list_transform(string_split(regexp_replace({c}, '([{s.END}])[{_WSET}\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_TRIM('s')}), lambda s: s <> '')"
_SAMPLES = f"with e as (select user_id as file, value, row_number() over (partition by user_id order by event_id) - 1 as ord from events), x as (select file, ord, case when ((ord + file * 7) // 30) % 3 = 0 then ord % 5 else floor(value * 300) end::int as sample from e), w as (select file, ord // 2 as w, sum(sample::bigint * sample) as sq, count(*) as n, max(abs(sample)) as most from x group by all), v as (select file, w, sq, n, sum(n) over f as frames, greatest(32767, max(most) over f) as peak from w window f as (partition by file)), d as (select file, w, w * 2 as s, least(frames, (w + 1) * 2) as e, frames from v where case when sq > 0 then 20 * log10(greatest(sqrt(sq / n) / peak, 1e-12)) else -120 end < -38), r as (select file, min(s) / {RATE}.0 as start_sec, max(e) / {RATE}.0 as end_sec from (select *, w - row_number() over (partition by file order by w) as g from d) group by file, g having max(e) - min(s) >= 14)"
_METRICS = f"{_SAMPLES}, t as (select file, count(*) / {RATE}.0 as duration_sec from x group by file), m as (select t.file, duration_sec, start_sec <= 0.001 as lead, end_sec >= duration_sec - 0.001 as trail, end_sec - start_sec as len from t left join r using (file)), a as (select file, duration_sec, coalesce(sum(len), 0) as silence_sec, coalesce(sum(len) filter (lead), 0) as leading_sec, coalesce(sum(len) filter (trail), 0) as trailing_sec, coalesce(sum(len) filter (not lead and not trail), 0) as internal_sec, count(*) filter (not lead and not trail) as internal_count from m group by file, duration_sec), z as (select *, greatest(0, duration_sec - silence_sec) / duration_sec as voiced_ratio from a)"
_WORDS = "with t as (select item_id as img, unnest(string_split(text, ' ')) as text, unnest(range(0, len(string_split(text, ' ')))) as ord from benchmark), w as (select *, ((img * 31 + ord * 17) % 100)::double as confidence, ord % 10 = 0 as first, ord % 10 = 9 as end_line, ord % 30 = 29 as end_para from t where text <> '')"
_PIX = "with p as (select l_orderkey % 50 as img, (l_orderkey // 50) % 64 as x, (l_orderkey // 3200) * 8 + l_linenumber as y, (l_partkey * 7 + l_linenumber * 37) % 256 as r, (l_partkey * 11 + l_linenumber * 37) % 256 as g, (l_partkey * 13 + l_linenumber * 37) % 256 as b from lineitem)"
_ARGB = lambda r, g, b: f"(4278190080 + ({r})::bigint * 65536 + ({g})::bigint * 256 + ({b})::bigint)"
_CH = lambda c, k: f"(({c} >> {8 * k}) & 255)"


def _mix(k: int) -> str:
    tl, tr, bl, br = (_CH(c, k) for c in ("tl", "tr", "bl", "br"))
    v, u = "((y - t) / greatest(b - t - 1, 1))", "((x - l) / greatest(r - l - 1, 1))"
    left, right = f"({tl} + ({bl} - {tl}) * {v})", f"({tr} + ({br} - {tr}) * {v})"
    return f"floor(least(greatest({left} + ({right} - {left}) * {u}, 0.0), 255.0))"


_OVER = lambda c, *more: f"{c} > greatest({', '.join(more)})"
_FLAGS = {
    "long": "duration_sec / m_duration_sec > 1.35", "short": "duration_sec / m_duration_sec < 1 / 1.35", "pause_time": "internal_sec > greatest(m_internal_sec * 1.8, m_internal_sec + 0.35)", "pause_count": "internal_count > greatest(m_internal_count * 1.8, m_internal_count + 2)",
    "lead": "leading_sec > greatest(0.5, m_leading_sec * 1.8, m_leading_sec + 0.2)", "trail": "trailing_sec > greatest(0.5, m_trailing_sec * 1.8, m_trailing_sec + 0.2)", "low_voice": "voiced_ratio < least(m_voiced_ratio * 0.88, m_voiced_ratio - 0.08)",
}

_RANKED = f"with v as ({values_sql(_VOICE_COLS, _VOICES)}), r as (select *, case when engine = 'kokoro' then nullif(instr(case split_part(language, '-', 1) " + " ".join(f"when '{k}' then '{p}'" for k, p in voices.PREFIXES.items()) + " else '' end, name[1]), 0) end as rank from v), df as (select model, arg_min({'n': name, 's': speaker_id}, {'a': coalesce(rank, 99), 'b': ord}) as d from r where engine = 'kokoro' group by model)"
_LUM = f"0.299::double * ({_CH('fg', 2)} / 255.0::double) + 0.587::double * ({_CH('fg', 1)} / 255.0::double) + 0.114::double * ({_CH('fg', 0)} / 255.0::double)"

ORACLES = {
    "block_colors": f"with b as ({values_sql(_BLOCK_COLS, _BLOCKS)}), c as (select n, mode, seen, case when bg not in (0, 1, 4294967295) and bg >> 24 <> 0 then bg end as bg, case when fg >> 24 <> 0 then fg end as fg from b), k as (select *, case when seen is null and mode <> 'auto' then mode when bg is not null then 'bg' when seen is not null then 'seen' when fg is not null then 'fg' else 'black_on_white' end as via from c) select n, case via when 'white_on_black' then 4278190080 when 'black_on_white' then 4294967295 when 'bg' then bg when 'seen' then seen else case when {_LUM} > 0.5 then 4278190080 else 4294967295 end end as background, case via when 'white_on_black' then 4294967295 when 'black_on_white' then 4278190080 when 'bg' then coalesce(fg, seen + 1, 4278190080) when 'seen' then coalesce(fg, seen + 1) else fg end as foreground from k",
    "visible_voices": f"{_RANKED} select model, name, speaker_id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(name, '^[a-z]{{2}}_', ''), '[_-]'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), ' ') as display_name from r qualify rank is not null or count(rank) over (partition by model) = 0",
    "default_voice": f"{_RANKED} select model, d.n as name, d.s as speaker_id from df",
    "requested_voice": f"{_RANKED}, a as ({values_sql(_ASKED_COLS, _ASKED)}), m as (select id, wanted_id, d, min(v.name) filter (wanted <> '' and v.name = wanted) as an, min(v.speaker_id) filter (wanted <> '' and v.name = wanted) as ai, min(v.name) filter (v.speaker_id = wanted_id) as bn, min(v.speaker_id) filter (v.speaker_id = wanted_id) as bi from a left join v on v.model = a.model left join df on df.model = a.model group by all) select id, coalesce(an, bn, d.n, 'speaker_' || wanted_id) as name, coalesce(ai, bi, d.s, wanted_id) as speaker_id from m",
    "speech_paragraphs": f"select conv_id, turn, unnest(range(0, len(ps)))::int as p, unnest(ps) as paragraph from (select conv_id, turn, {_PARA} as ps from conversations)",
    "speech_segments": f"with a as (select conv_id, turn, {_PARA} as ps from conversations), b as (select conv_id, turn, len(ps) as np, unnest(range(0, len(ps)))::int as p, unnest(ps) as paragraph from a), c as (select *, {_SEG('paragraph')} as ss from b), d as (select conv_id, turn, np, p, len(ss) as ns, unnest(range(0, len(ss)))::int as k, unnest(ss) as segment from c) select conv_id, turn, p, k, segment, case when k + 1 < ns then 'sentence' when p + 1 < np then 'paragraph' else 'none' end as boundary from d",
    "best_pause_split": f"with q as (select doc_id, unnest(range(0, len(x)))::int as k, unnest(x) as t from (select doc_id, {_SENT('text')} as x from documents)), c as (select doc_id, k, t, length(t) as n, unnest(range(0, length(t))) as i from q where length(t) >= 24), p as (select doc_id, k, n, i, {_TRIM('t[1:i + 1]')} as a, {_TRIM('t[i + 2:]')} as b from c where contains('{s.CLAUSE}', t[i + 1])), g as (select * from p where length(a) >= greatest(12, n // 4) and length(b) >= greatest(12, n // 4)) select doc_id, k, arg_min(a, key) as first, arg_min(b, key) as second from (select *, {{'x': abs(length(a) - length(b)), 'y': abs(n / 2 - i), 'z': i}} as key from g) group by doc_id, k",
    "pcm_convert": "select event_id, round(least(greatest(value / 10 - 1, -1.0), 1.0) * 32767)::int as sample, round(least(greatest(1 - value / 8, -1.0), 1.0) * 32767)::int as mirrored from events",
    "pcm_silence": f"with v as ({values_sql('rate int, ms int', _RATES)}), n as (select *, greatest(1, rate::bigint * greatest(1, ms) // 1000) as samples from v) select rate, ms, samples, case when rate > 0 then samples * 1000 // rate else 0 end as duration_ms from n",
    "silence_runs": f"{_SAMPLES} select * from r",
    "silence_metrics": f"{_METRICS} select file, " + ", ".join(f"round({c}, 6) as {c}" for c in ("duration_sec", "silence_sec", "leading_sec", "trailing_sec", "internal_sec", "voiced_ratio")) + ", internal_count from z",
    "pause_outliers": f"{_METRICS}, l as (select *, file % 7 as language from z), g as (select language, {', '.join(f'median({c}) as m_{c}' for c in ('duration_sec', 'internal_sec', 'internal_count', 'leading_sec', 'trailing_sec', 'voiced_ratio'))} from l group by language having count(*) >= 2), o as (select file, language, concat_ws(',', " + ", ".join(f"case when {c} then '{k}' end" for k, c in _FLAGS.items()) + ") as flags from l join g using (language)) select * from o where flags <> ''",
    "ocr_confidence_filter": f"{_WORDS}, k as (select *, confidence >= 40 and not (length(text) = 1 and confidence < 45) as keep from w), u as (select *, sum(keep::int) over (partition by img order by ord) as upto, sum(keep::int) over (partition by img order by ord) - keep::int as before from k), f as (select img, ord, text, keep, bool_or(first) over (partition by img, before) as first, bool_or(end_line) over (partition by img, upto) as end_line, bool_or(end_para) over (partition by img, upto) as end_para from u) select img, ord::int as ord, text, first, end_line, end_para from f where keep",
    "luminance": f"{_PIX} select img, count(*) as pixels, sum(least(255, (29 * b + 150 * g + 77 * r) >> 8))::bigint as brightness, count(*) filter (0.299::double * (r / 255.0::double) + 0.587::double * (g / 255.0::double) + 0.114::double * (b / 255.0::double) > 0.5) as bright, max(r) as most_red from p group by img",
    "otsu_threshold": f"{_PIX}, h as (select img, least(255, (29 * b + 150 * g + 77 * r) >> 8) as t, count(*) as n from p group by all), c as (select img, t, sum(n) over u as w, sum(t * n) over u as s, sum(n) over a as total, sum(t * n) over a as tsum from h window u as (partition by img order by t), a as (partition by img)), v as (select img, t, w::double * (total - w) * (s / w - (tsum - s) / (total - w)) * (s / w - (tsum - s) / (total - w)) as spread from c where w < total) select i.img, coalesce((select arg_min(t, {{'a': -spread, 'b': t}}) from v where v.img = i.img), 127)::int as threshold from (select distinct img from p) i",
    "corner_paint": f"{_PIX}, q as ({values_sql('rect_id int, img long, l int, t int, rr int, bb int', _RECTS)}), m as (select rect_id, {_ARGB('sum(r) // count(*)', 'sum(g) // count(*)', 'sum(b) // count(*)')} as color from q join p on p.img = q.img and ((y >= t and y < bb and (x between l - 4 and l - 1 or x between rr and rr + 3)) or (x >= l and x < rr and (y between t - 4 and t - 1 or y between bb and bb + 3))) group by rect_id) select rect_id, coalesce(color, 4294967295) as color from q left join m using (rect_id)",
    "bilinear_fill": f"with f as ({values_sql(_FILL_COLS, _FILLS)}), yy as (select *, unnest(range(t, b))::int as y from f where r > l and b > t), g as (select *, unnest(range(l, r))::int as x from yy) select rect_id, x, y, {_ARGB(_mix(2), _mix(1), _mix(0))} as color from g",
    "overlay_colors": f"with c as ({values_sql('n int, mode string, color long', _COLORS)}), l as (select *, 0.299::double * ({_CH('color', 2)} / 255.0::double) + 0.587::double * ({_CH('color', 1)} / 255.0::double) + 0.114::double * ({_CH('color', 0)} / 255.0::double) as lum from c) select n, case mode when 'black_on_white' then 4294967295 when 'white_on_black' then 4278190080 else color end as background, case mode when 'black_on_white' then 4278190080 when 'white_on_black' then 4294967295 else case when lum > 0.5 then 4278190080 else 4294967295 end end as foreground from l",
}
