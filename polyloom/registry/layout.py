"""HTML scopes, spans, page layout, geometry and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyloom.functions import text as t
from polyloom.functions.translit import transliterate
from polyloom.operators import html, layout, spans
from polyloom.registry.base import table, values_df, values_sql
from polyloom.registry.text import _TRIM


def html_scopes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.plain_scopes(F.col("html"))).alias("scope", "text"))


def html_scope_leaves(spark, sf_dir):
    return html.html_scopes(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "scope", "text", F.size("ends").alias("leaves"))


def html_rebuild_identity(spark, sf_dir):
    """Pages taken apart and put together with a translation that changes nothing: their scopes are the same again."""
    again = table(spark, sf_dir, "pages").withColumn("html", html.rebuilt()(F.col("html")))
    return again.select("page_id", F.posexplode(html.plain_scopes(F.col("html"))).alias("scope", "text"))


def _spans(spark, sf_dir):
    """Spans and alignments by arithmetic: every document has two styles, and an alignment for each ten characters, moved and stretched. Lengths are spread before they become rows, so that no task writes more than its share."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n")).where("n_chars > 30")
    rows = d.agg(F.sum(F.floor(F.col("n") / 25) + F.floor(F.col("n") / 10) + 2)).first()[0] or 0
    d = d.repartition(rows // (4 * spans.TASK_ROWS) + 1, "doc_id")
    k = F.col("k")
    s = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 25).cast("int"))).alias("k")).select("doc_id", (k * 25).cast("long").alias("start"), (k * 25 + 5 + k % 4 * 10).cast("long").alias("end"), F.when(k % 3 == 0, "bold").otherwise("italic").alias("style"))
    a = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 10).cast("int"))).alias("k")).select("doc_id", (k * 10).cast("long").alias("sb"), (k * 10 + 7).cast("long").alias("se"), (k * 12).cast("long").alias("tb"), (k * 12 + 12 - k % 2 * 3).cast("long").alias("te"))
    return s, a


def span_projection(spark, sf_dir):
    return spans.project(*_spans(spark, sf_dir), "doc_id")


def span_merge(spark, sf_dir):
    s, a = _spans(spark, sf_dir)
    parts = spans.projection_parts(s, a, "doc_id")
    return spans.merge(spans.project(s, a, "doc_id", parts), "doc_id", parts)


def word_expand(spark, sf_dir):
    """For each benchmark text, ranges of three characters from every place on."""
    r = table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1)).alias("at"))
    return r.select("item_id", "at", t.word_expand(F.col("text"), F.col("at"), F.col("at") + 3).alias("w")).select("item_id", "at", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def _fragments(spark, sf_dir):
    """Words of each benchmark text set as lines on a page of two columns."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("page"), F.posexplode(F.split("text", " ")).alias("ord", "text")).where("text <> ''")
    o, line = F.col("ord"), F.floor(F.col("ord") / 8).cast("int")
    left, top = (o % 8) * 60 + (line % 2) * 2, line * 14 + F.floor(line / 5).cast("int") * 40
    return w.select("page", "ord", "text", left.cast("int").alias("l"), top.cast("int").alias("t"), (left + 56).cast("int").alias("r"), (top + 12).cast("int").alias("b"), F.when(o % 6 == 0, "bold").alias("style"), F.lit(0).alias("layout_group"), F.floor(o / 11).cast("int").alias("translation_group"), F.lit(0).alias("cluster_group"), (o < 0).alias("opaque"))


def layout_blocks(spark, sf_dir):
    return layout.layout_blocks(_fragments(spark, sf_dir)).select("page", "block", "text", "l", "t", "r", "b", "opaque", F.size("spans").alias("spans"), F.size("segments").alias("segments"))


def block_quantiles(spark, sf_dir):
    return layout.quantiles(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")


def math_runs_opaque(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "Strong").when(F.col("event_type").isin("view", "click"), "Weak").otherwise("Prose")
    return layout.opaque_runs(table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id")


_FONTS = [(i, n) for i, n in enumerate(["ABCDEF+CMMI10", "CMSY7", "CMR10", "QWERTY+CMBX12", "Helvetica", "Arial-BoldItalicMT", "ABCDEF+Courier-Oblique", "XYZ+Fira-SemiBold", "cmex10", "CMU-Serif", "MSBM5", "RobotoMono", ""])]


def font_class(spark, sf_dir):
    return values_df(spark, "n int, name string", _FONTS).select("n", layout.font_class(F.col("name")).alias("kind"), layout.font_style(F.col("name")).alias("s")).select("n", "kind", "s.bold", "s.italic", "s.monospace")


_CHARS = [(b, i, c, f) for b, i, cs, f in [(0, 0, "ab c", "CMR10"), (0, 1, "x=y", "CMMI10"), (0, 2, "i", "CMMI7"), (0, 3, " �", "AAAAAA+CMEX10"), (1, 0, "xy", "CMMI10"), (1, 0, "=2", "CMR10"), (1, 1, "zz", "Arial"), (1, 2, "n", "CMMI5"), (1, 2, "words", "CMR10")] for c in cs]


def math_line_kinds(spark, sf_dir):
    return layout.math_kind(values_df(spark, "block int, line int, c string, font string", _CHARS))


_LINES = ["a = b + c", "x_i_j = 3", "if p.view = q then", "f(x) = y; g < h", "E = mc → F = ma", "plain words here", "", "sum ≤ total of many words"]


def pdf_skip_rules(spark, sf_dir):
    """Lines of the documents, and some formulas, at places that depend on their length."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).union(values_df(spark, "line string", [(x,) for x in _LINES]))
    n = F.char_length("line")
    left, right = F.greatest(F.lit(0), 300 - n * 3), 300 + n * 3 + n % 5 * 10
    skip = layout.skip_line(F.col("line"), left, right, F.lit(600))
    return lines.groupBy(skip.alias("skip")).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"))


def geometry_transform(spark, sf_dir):
    """A turn, a shift and a scaling of each part's size and price, and back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), (F.col("p_partkey") % 4 * 90).alias("turn"))
    m = layout.matrix_mul(F.array(*[F.lit(float(v)) for v in (2, 0, 0, 4, 8, -16)]), F.array(*[F.lit(float(v)) for v in (0, 1, -1, 0, 32, 64)]))
    out = layout.transform(m, F.col("x"), F.col("y"))
    back = layout.transform(layout.inverse(m), out["x"], out["y"])
    shown = layout.to_display(F.col("turn"), F.col("x"), F.col("y"), F.lit(612.0), F.lit(792.0))
    return p.select("p_partkey", out["x"].alias("u"), out["y"].alias("v"), back["x"].alias("x"), back["y"].alias("y"), shown["x"].alias("shown_x"), shown["y"].alias("shown_y"))


def rect_hits_nearest(spark, sf_dir):
    """Each part is a mark on one of 25 pages, each supplier a rectangle."""
    marks = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("page"), F.col("p_partkey").alias("mark"), (F.col("p_partkey") * 37 % 600).alias("x"), (F.col("p_partkey") * 53 % 800).alias("y"))
    k = F.col("s_suppkey")
    rects = table(spark, sf_dir, "supplier").select((k % 25).alias("page"), k.alias("rect"), (k * 29 % 400).alias("x0"), (k * 31 % 500).alias("y0"), (k * 29 % 400 + 250).alias("x1"), (k * 31 % 500 + 300).alias("y1"))
    return layout.rects_hit(marks, rects, "page")


def link_prune(spark, sf_dir):
    k = F.col("p_partkey")
    notes = table(spark, sf_dir, "part").select((k % 25).alias("page"), k.alias("note"), F.when(k % 3 == 0, "Text").otherwise("Link").alias("subtype"), (k * 37 % 600).alias("x0"), (k * 53 % 800).alias("y0"), (k * 37 % 600 + 20).alias("x1"), (k * 53 % 800 + 10).alias("y1"))
    s = F.col("s_suppkey")
    gone = table(spark, sf_dir, "supplier").select((s % 25).alias("page"), (s * 29 % 400).alias("a0"), (s * 31 % 500).alias("b0"), (s * 29 % 400 + 100).alias("a1"), (s * 31 % 500 + 60).alias("b1"))
    return layout.prune_links(notes, gone, "page")


def font_union(spark, sf_dir):
    """The characters that each font (a language's) has to hold, over all texts."""
    chars = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where(~F.col("c").rlike(r"^[\p{IsWhite_Space}]?$")).distinct()
    return chars.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("chars"), F.count(F.lit(1)).alias("n"))


def wrap_lines(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(layout.wrap(F.col("text"), 40)).alias("line", "text"))


_TRANSLIT = [("Cyrl", "Привет мир"), ("Cyrl", "Ёлка, щука!"), ("Cyrl", "абвгд ЖШЧ"), ("Grek", "αβγ"), ("Latn", "hello é"), ("Cyrl", "abc"), ("Cyrl", "  "), ("Thai", "สวัสดี"), (None, "мир")]


def translit_cyrl_grek(spark, sf_dir):
    return values_df(spark, "n int, script string, text string", [(i, *x) for i, x in enumerate(_TRANSLIT)]).select("n", transliterate(F.col("text"), F.col("script")).alias("latin"))


def line_anchors(spark, sf_dir):
    """Items of an order are signs of a block: three on a line, some of them raised."""
    k = F.col("l_linenumber")
    y = F.floor(k / 3) * 12 + F.when(F.col("l_partkey") % 5 == 0, 3).otherwise(0)
    return layout.line_anchors(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), (F.col("l_suppkey") % 50).cast("double").alias("x"), y.cast("double").alias("y"), F.lit(10.0).alias("size")))


def fit_lines(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", layout.fitted(0.5)("text", F.array(F.lit(300.0), F.lit(200.0)), F.lit(11.0), (F.col("item_id") % 4 + 1).cast("int")).alias("f"))
    return b.select("item_id", F.round("f.size", 6).alias("size"), F.size("f.lines").alias("lines"), F.array_join("f.lines", "\n").alias("text"))


QUERIES = {f.__name__: f for f in (html_scopes, html_scope_leaves, html_rebuild_identity, span_projection, span_merge, word_expand, layout_blocks, block_quantiles, math_runs_opaque, font_class, math_line_kinds, pdf_skip_rules, geometry_transform, rect_hits_nearest, link_prune, font_union, wrap_lines, translit_cyrl_grek, line_anchors, fit_lines)}

# ---- SQL ----

_X1 = "regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', chr(1), 'g')"
_X2 = f"regexp_replace({_X1}, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|</?(html|head|body)( [^>]*)?>', '', 'g')"
_X3 = f"regexp_replace(regexp_replace({_X2}, '</?(a|b|br)( [^>]*)?>', chr(2), 'g'), '<[^>]*>', chr(1), 'g')"
_STEP = lambda x: f"regexp_replace({x}, '([^\\s\\x01\\x02])\\x02+([^\\s\\x01\\x02])', '\\1 \\2', 'g')"
_X4 = f"replace(replace(replace(replace(replace({_STEP(_STEP(_X3))}, chr(2), ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_SCOPES = f"select page_id, unnest(range(0, len(s)))::int as scope, unnest(s) as text from (select page_id, list_filter(string_split({_X4}, chr(1)), lambda x: {_TRIM('x')} <> '') as s from pages)"
_SP = "with d as (select doc_id, n_chars::bigint as n from documents where n_chars > 30), s as (select doc_id, k * 25 as st, k * 25 + 5 + k % 4 * 10 as en, case when k % 3 = 0 then 'bold' else 'italic' end as style from (select doc_id, unnest(range(0, n // 25 + 1)) as k from d)), a as (select doc_id, k * 10 as sb, k * 10 + 7 as se, k * 12 as tb, k * 12 + 12 - k % 2 * 3 as te from (select doc_id, unnest(range(0, n // 10 + 1)) as k from d)), p as (select doc_id, tb as start, te as \"end\", arg_min(style, {'a': st, 'b': en, 'c': style}) as style from a join s using (doc_id) where (sb + se) // 2 >= st and (sb + se) // 2 < en group by doc_id, sb, se, tb, te)"
_STEM = "upper(regexp_replace(name, '^.*\\+', ''))"
_W = "[\\p{L}\\p{N}]"

ORACLES = {
    "html_scopes": _SCOPES,
    "html_rebuild_identity": _SCOPES,
    "span_projection": f"{_SP} select doc_id, start, \"end\", style from p",
    "span_merge": f"{_SP}, o as (select *, coalesce((start > max(\"end\") over (partition by doc_id, style order by start, \"end\" rows between unbounded preceding and 1 preceding))::int, 1) as new from p), g as (select *, sum(new) over (partition by doc_id, style order by start, \"end\") as run from o) select doc_id, style, min(start) as start, max(\"end\") as \"end\" from g group by doc_id, style, run",
    "word_expand": f"with r as (select item_id, text, unnest(range(0, length(text))) as pos from benchmark where text <> ''), s as (select *, pos + length(regexp_extract(text[pos + 1:pos + 3], '^[^\\p{{L}}\\p{{N}}]*')) as f from r) select item_id, pos::int as \"at\", case when f < pos + 3 then (f - case when f = pos then length(regexp_extract(text[1:pos], '{_W}*$')) else 0 end)::int end as start, case when f < pos + 3 then (f + length(regexp_extract(text[f + 1:], '^{_W}*')))::int end as \"end\" from s",
    "block_quantiles": "with l as (select l_orderkey, list_sort(list(l_quantity)) as v from lineitem group by 1), m as (select l_orderkey, arg_min(q, {'a': -n, 'b': q}) as mode from (select l_orderkey, l_quantity as q, count(*) as n from lineitem group by all) group by 1) select l_orderkey, v[len(v) // 4 + 1] as lower, v[len(v) // 2 + 1] as upper_median, v[len(v) * 3 // 4 + 1] as p75, mode from l join m using (l_orderkey)",
    "math_runs_opaque": "with k as (select user_id, event_id, case when event_type = 'error' then 'Strong' when event_type in ('view', 'click') then 'Weak' else 'Prose' end as kind from events), r as (select *, sum((kind = 'Prose')::int) over (partition by user_id order by event_id) as run from k) select user_id, event_id, kind, kind <> 'Prose' and bool_or(kind = 'Strong') over (partition by user_id, run) as opaque from r",
    "font_class": f"with f as ({values_sql('n int, name string', _FONTS)}), g as (select n, {_STEM} as stem, lower(regexp_replace(name, '^[^+]{{6}}\\+', '')) as low from f) select n, case when regexp_matches(stem, '^({'|'.join(layout.MATH)})') then 'math' when regexp_matches(stem, '^({'|'.join(layout.PLAIN)})') then 'text' else 'other' end as kind, regexp_matches(low, 'bold|heavy|black') as bold, regexp_matches(low, 'italic|oblique') as italic, regexp_matches(low, 'consolas|lucidaconsole|courier|firacode|fixedsys|hack|inconsolata|menlo|monaco|mono|sourcecodepro') as monospace from g",
    "math_line_kinds": f"with c as ({values_sql('block int, line int, c string, font string', _CHARS)}), g as (select block, line, count(*) filter (regexp_matches(stem, '^({'|'.join(layout.MATH)})')) as m, count(*) filter (regexp_matches(stem, '^({'|'.join(layout.PLAIN)})')) as t, bool_or(c = '�' and stem like 'CMEX%') as x from (select *, upper(regexp_replace(font, '^.*\\+', '')) as stem from c where c <> ' ') group by all) select block, line, case when x or (m > 0 and m + t >= 3 and 2 * m >= m + t) then 'Strong' when m > 0 and t = 0 then 'Weak' else 'Prose' end as kind from g",
    "pdf_skip_rules": f"with l as (select unnest(string_split(text, chr(10))) as line from documents union all {values_sql('line string', [(x,) for x in _LINES])}), n as (select line, length(line) as n, greatest(0, 300 - length(line) * 3) as l, 300 + length(line) * 3 + length(line) % 5 * 10 as r, len(regexp_extract_all(line, '[^\\s\\p{{Z}}]+')) as words, len(regexp_extract_all(line, '[=<>∑Σσ≤≥→←↔]')) as symbols, len(regexp_extract_all(line, '\\p{{L}}')) as letters, len(regexp_extract_all(line, '_')) as under, len(regexp_extract_all(line, '\\p{{L}}{{4,}}')) as long from l), k as (select n, words = 0 or (not (contains(line, ';') or regexp_matches(line, '[a-z]\\.[a-z]') or long >= 2) and ((abs((l + r) / 2 - 300) < 30 and ((l + greatest(600 - r, 0)) / 2 <= 0 or abs(l - greatest(600 - r, 0)) < (l + greatest(600 - r, 0)) / 2 * 0.3) and symbols > 0 and words <= 8) or (symbols >= 2 and letters < 24) or (under >= 2 and words <= 8))) as skip from n) select skip, count(*) as n, sum(n)::bigint as chars from k group by skip",
    "geometry_transform": "with p as (select p_partkey, p_size::double as x, (p_partkey % 97)::double as y, p_partkey % 4 * 90 as turn from part) select p_partkey, -2 * y + 72 as u, 4 * x + 240 as v, x, y, case turn when 90 then y when 180 then 612 - x when 270 then 792 - y else x end as shown_x, case turn when 90 then x when 180 then y when 270 then 612 - x else 792 - y end as shown_y from p",
    "rect_hits_nearest": "with m as (select p_partkey % 25 as page, p_partkey as mark, p_partkey * 37 % 600 as x, p_partkey * 53 % 800 as y from part), r as (select s_suppkey % 25 as page, s_suppkey as rect, s_suppkey * 29 % 400 as x0, s_suppkey * 31 % 500 as y0 from supplier) select page, mark, arg_min(rect, {'a': abs(x - x0), 'b': rect}) as rect from m join r using (page) where x between x0 and x0 + 250 and y between y0 and y0 + 300 group by page, mark",
    "link_prune": "with n as (select p_partkey % 25 as page, p_partkey as note, case when p_partkey % 3 = 0 then 'Text' else 'Link' end as subtype, p_partkey * 37 % 600 as x0, p_partkey * 53 % 800 as y0, p_partkey * 37 % 600 + 20 as x1, p_partkey * 53 % 800 + 10 as y1 from part), g as (select s_suppkey % 25 as page, s_suppkey * 29 % 400 as a0, s_suppkey * 31 % 500 as b0 from supplier) select * from n where not (subtype = 'Link' and exists (select 1 from g where g.page = n.page and x0 < a0 + 100 and x1 > a0 and y0 < b0 + 60 and y1 > b0))",
    "font_union": "with c as (select distinct lang, unnest(string_split(text, '')) as c from documents) select lang, string_agg(c, '' order by c) as chars, count(*) as n from c where c <> '' and not regexp_matches(c, '^[\\s\\p{Z}]$') group by lang",
    "translit_cyrl_grek": "select * from (values (0, 'Privet mir'), (1, 'Ëlka, ŝuka!'), (2, 'abvgd ŽŠČ'), (3, 'abg'), (4, null), (5, null), (6, null), (7, null), (8, null)) as v(n, latin)",
    "wrap_lines": "with recursive w as (select item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as ws from benchmark), f(item_id, ws, i, lines, now) as (select item_id, ws, 1::bigint, []::varchar[], null::varchar from w union all select item_id, ws, i + 1, case when now is null or length(now) + 1 + length(ws[i]) <= 40 then lines else list_append(lines, now) end, case when now is null then ws[i] when length(now) + 1 + length(ws[i]) <= 40 then now || ' ' || ws[i] else ws[i] end from f where i <= len(ws)), d as (select item_id, list_append(lines, now) as ls from f where i = len(ws) + 1 and now is not null) select item_id, unnest(range(0, len(ls)))::int as line, unnest(ls) as text from d",
}
