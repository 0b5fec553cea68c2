"""Single cases of overlay paint, page text, alignments, caches and samples."""

from __future__ import annotations

import json
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from polyloom.operators import alignment, html, images, kernels, layout, paint, pdf, samples, spans
from polyloom.registry import more
from polyloom.registry.catalog import _snapshot, fixture_json
from polyloom.sources.catalog import catalog_errors, read_catalog


def test_inline_tags_do_not_split():
    _, scopes = html.parse("<p>One <em>two</em> <ruby>x<rb>y</rb></ruby> three</p><p>a <strike>b</strike></p>")
    assert [s.text for s in scopes] == ["One two x y three", "a ", "b"] and len(html.INLINE) == 38


def test_model_cache():
    made = []
    load = lambda key: made.append(key) or key.upper()
    cache = kernels.ModelCache(3)
    for key in ("en-es", "es-en", "en-es", "en-fr", "fr-en"):
        cache.model(load, key)
    assert made == ["en-es", "es-en", "en-fr", "fr-en"] and cache.keys() == ["en-es", "en-fr", "fr-en"]
    cache.evict("en-fr")
    cache.evict_involving("es")
    assert cache.keys() == ["fr-en"]
    cache.clear()
    assert cache.keys() == []


def test_engine_settings(spark):
    def loads_good_keys(key):
        if key == "bad":
            raise OSError("no such model")
        return list

    assert kernels.EngineConfig.of(spark) == kernels.EngineConfig(4, 8192)
    spark.conf.set("spark.polyloom.workers", "2")
    spark.conf.set("spark.polyloom.cache", "-5")
    try:
        assert kernels.EngineConfig.of(spark) == kernels.EngineConfig(2, 8192)
        assert kernels.warm(spark, loads_good_keys, ["a-b", "bad", "c-d"]) == 2 and kernels.warm(spark, loads_good_keys, []) == 0
    finally:
        spark.conf.unset("spark.polyloom.workers")
        spark.conf.unset("spark.polyloom.cache")


def test_texts_of_one_route_are_spread(spark):
    rows = spark.range(20_000).select(F.col("id"), F.lit("en-es").alias("route"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(-1, "en-es", None), (-2, "en-es", "text 5"), (-3, None, "x")], "id long, route string, text string"))
    got = kernels.apply_kernel(rows, lambda _key: lambda ts: [f"{len(ts)}:{t.upper()}" for t in ts])
    out = {r["id"]: r["translated"] for r in got.collect()}
    assert len(out) == 20_003 and out[-1] is None and out[-2].endswith(":TEXT 5") and out[5].endswith(":TEXT 5") and out[-3] is None
    assert max(int(v.split(":")[0]) for v in out.values() if v) < 15_000  # no batch has the whole route


@pytest.mark.parametrize("seed", range(3))
def test_composed_alignments(spark, seed):
    r = np.random.default_rng(seed)
    spans = lambda n: sorted((int(a), int(a + r.integers(1, 30)), int(b), int(b + r.integers(1, 30))) for a, b in zip(r.integers(0, 900, n), r.integers(0, 900, n)))
    first, second = list(dict.fromkeys(spans(40))), list({(s[0], s[1], s[2], s[3]): s for s in spans(40)}.values())
    table = lambda rows: spark.createDataFrame([(1, *x) for x in rows], "k int, sb int, se int, tb int, te int")
    got = sorted(tuple(x)[1:] for x in alignment.compose(table(first), table(second), "k").collect())
    assert got == sorted(alignment.chain(first, second)) and len(got) > 3


def test_aligned_texts_of_several_sentences(spark):
    upper = lambda key: lambda ts: [(f"<{t}>" if key == "a-b" else t + "!", [(0, len(t), 1, len(t) + 1)] if key == "a-b" else [(0, len(t), 0, len(t))]) for t in ts]
    rows = spark.createDataFrame([(1, "a-b", "One. Two."), (2, "a-b,b-c", "One."), (3, "a-b", "  "), (4, "a-b", None), (5, "", "Same. Text")], "id int, route string, text string")
    got = {r["id"]: (r["translated"], [tuple(x) for x in r["alignments"]]) for r in alignment.translate_aligned(rows, upper).collect()}
    assert got[1] == ("<One.> <Two.>", [(0, 4, 1, 5), (5, 9, 8, 12)]) and got[2] == ("<One.>!", [(0, 4, 0, 6)])
    assert got[3] == got[4] == ("", []) and got[5][0] == "Same. Text" and len(got[5][1]) == 9
    bad = alignment.translate_aligned(rows.where("id = 1"), lambda key: 1 / 0).first()
    assert bad["translated"] is None and "ZeroDivisionError" in bad["error"]


def slow_paint(px, w, h, rect):
    """By loops over pixels."""
    l, t, r, b = rect
    l, t = min(l, w - 1), min(t, h - 1)
    r, b = min(max(r, l + 1), w), min(max(b, t + 1), h)
    ch = lambda c: ((c >> 16) & 255, (c >> 8) & 255, c & 255)
    lum = lambda c: min(255, (77 * ch(c)[0] + 150 * ch(c)[1] + 29 * ch(c)[2]) >> 8)
    mean = lambda cs, other: other if not cs else 0xFF000000 + sum((sum(ch(c)[i] for c in cs) // len(cs)) << (16 - 8 * i) for i in range(3))
    near = [px[x, y] for (x, y) in px if (t <= y < b and (l - 4 <= x < l or r <= x < r + 4)) or (l <= x < r and (t - 4 <= y < t or b <= y < b + 4))]
    surround = mean(near, 0xFFFFFFFF)
    inside = [px[x, y] for x in range(l, r) for y in range(t, b)]
    hist = [0] * 256
    for c in inside:
        hist[lum(c)] += 1
    n, total = len(inside), sum(i * k for i, k in enumerate(hist))
    best, thr, wb, sb = 0.0, 127, 0, 0
    for i in range(256):
        wb += hist[i]
        sb += i * hist[i]
        if not wb or wb == n:
            continue
        v = float(wb) * (n - wb) * (sb / wb - (total - sb) / (n - wb)) ** 2
        if v > best:
            best, thr = v, i
    bright = lum(surround) > thr
    side = range(thr + 1, 256) if bright else range(thr + 1)
    peak = max(side, key=lambda i: (hist[i], -i))
    ink = list(range(thr + 1)) if bright else list(range(255, thr, -1))
    goal, run, cut = max(1, sum(hist[i] for i in ink) // 20), 0, None
    for i in ink:
        run += hist[i]
        if run >= goal:
            cut = i
            break
    core = [c for c in inside if cut is not None and (lum(c) <= cut if bright else lum(c) >= cut)]
    xs = (range(max(l - 6, 0), min(l + 8, r)), range(max(r - 8, l), min(r + 6, w)))
    ys = (range(max(t - 6, 0), min(t + 8, b)), range(max(b - 8, t), min(b + 6, h)))
    corners = [mean([px[x, y] for x in xs[i] for y in ys[j] if not (l <= x < r and t <= y < b) and abs(lum(px[x, y]) - peak) <= 12], surround) for j in (0, 1) for i in (0, 1)]
    back = 0xFF000000 + sum((sum(ch(c)[i] for c in corners) // 4) << (16 - 8 * i) for i in range(3))
    flat = max(abs(a - z) for c in corners for a, z in zip(ch(c), ch(back))) <= 4
    return flat, *([back] * 4 if flat else corners), back, mean(core, 0xFF000000 if bright else 0xFFFFFFFF)


def test_paint_equals_loops_over_pixels(spark):
    r = np.random.default_rng(2)
    w, h = 70, 40
    px = {(x, y): 0xFF000000 + sum(int(v) << s for v, s in zip(np.clip((30 if r.random() < 0.2 else 220 - x) + r.integers(-9, 9, 3), 0, 255), (16, 8, 0))) for x in range(w) for y in range(h)}
    rects = [(k, 1, *x) for k, x in enumerate([(5, 5, 30, 15), (0, 0, 70, 40), (40, 20, 69, 39), (66, 36, 90, 90), (10, 10, 12, 12), (33, 3, 60, 9)])]
    pixels = spark.createDataFrame([(1, x, y, c) for (x, y), c in px.items()], "img long, x int, y int, color long")
    got = paint.autodetect_paint(pixels, spark.createDataFrame([(1, w, h)], "img long, width int, height int"), spark.createDataFrame(rects, "rect_id int, img long, l int, t int, r int, b int"))
    assert {x["rect_id"]: tuple(x)[1:] for x in got.select("rect_id", "flat", "tl", "tr", "bl", "br", "background", "foreground").collect()} == {k: slow_paint(px, w, h, rest) for k, _, *rest in rects}


def test_wrap_to_fit():
    text = "several words that have to be fitted into a small box"
    assert pdf.wrap_to_fit(text, [1000.0], 20.0, 10.0, 0.5) == (10.0, [text])
    size, lines = pdf.wrap_to_fit(text, [100.0], 30.0, 10.0, 0.5)
    assert size == pytest.approx(8.5) and size * 1.15 * len(lines) <= 30 and " ".join(lines) == text
    assert pdf.wrap_to_fit(text, [30.0], 1.0, 10.0, 0.5)[0] == 4.0 and pdf.wrap_to_fit(text, [30.0], 1.0, 3.0, 0.5)[0] == 3.0


def test_page_fragments(spark):
    """A line of prose in two styles, a formula between two lines of prose, and a line that stays verbatim."""
    lines = [(0, 0, "Some words here and there,", "CMR10"), (0, 1, "x=y+z", "CMMI10"), (0, 2, "more words after it, again", "CMR10"), (1, 0, "a_b_c = d", "Arial")]
    chars = [(1, b, n, i, c, 10.0 + 5 * i, f, "bold" if c.isalpha() and i < 4 and f == "CMR10" else "plain", 10, 20 * n, 400, 20 * n + 12) for b, n, text, f in lines for i, c in enumerate(text)]
    schema = "page int, block int, line int, ord int, c string, x double, font string, style string, l int, t int, r int, b int"
    got = [tuple(r[k] for k in ("ord", "text", "style", "opaque", "group")) for r in pdf.page_fragments(spark.createDataFrame(chars, schema), 600).orderBy("ord").collect()]
    assert got == [(0, "Some ", "bold", False, 0), (1, "words here and there,", "plain", False, 0), (2, "x=y+z", "plain", True, 1), (3, "more ", "bold", False, 2), (4, "words after it, again", "plain", False, 2)]


def test_recognisers_are_made_once_for_each_spec(spark):
    cache = images.EngineCache(lambda folder, spec: (folder, spec))
    for key in (("f", "a", "x"), ("f", "a", "x"), ("f", "b", "x"), ("f", "b", "y")):
        cache.engine(*key)
    assert cache.made == 3

    def load(_folder, spec):
        if spec == "bad":
            raise OSError("no data")
        return lambda data, w, h, mode: [{"text": f"{spec}{len(data)}", "confidence": 90.0, "left": 0, "top": 0, "right": w, "bottom": h, "begins_para": True, "end_para": True, "end_line": True}]

    rows = spark.createDataFrame([(1, 2, 1, b"12345678", "deu+eng", "auto"), (2, 1, 1, b"1234", "bad", "auto")], "img long, width int, height int, data binary, spec string, mode string")
    got = {r["img"]: (r["text"], r["error"]) for r in images.recognise(rows, load).collect()}
    assert got == {1: ("deu+eng8", None), 2: (None, "OSError: no data")}


def test_samples_in_batches(spark):
    packs = spark.createDataFrame([(f"p{i}", i) for i in range(20)], "pack_id string, n long")
    done = samples.process(packs, lambda row: bytes(row["n"] % 5) if row["n"] != 7 else 1 / 0)
    assert tuple(samples.totals(done).first()) == (19, 1) and "ZeroDivisionError" in done.where("pack_id = 'p7'").first()["error"]
    urls = ["https://h.org/a/b.bin", "http://h/x", "/y/z", "https://h.org", "ftp://h/x", "plain", None]
    assert [r["p"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(samples.path_of_url(F.col("u")).alias("p")).collect()] == ["a/b.bin", "x", "y/z", None, None, None, None]


def test_sample_page(spark):
    page = samples.render_site(samples.site_rows(_snapshot(spark), spark.createDataFrame([("en/en_amy-low_low.ogg",)], "path string")))
    assert page.count("<h2>") == 2 and page.count("<h3>") == 4 and page.count("<audio") == 1 and page.index("English") < page.index("Spanish")


def test_unfit_catalogs_are_errors(spark, tmp_path):
    wrong = sorted(r["error"] for r in catalog_errors(spark.createDataFrame([(fixture_json(),), ("no json",), ('{"formatVersion": 3}',)], "json string")).collect())
    assert wrong == ["format version 3", "no catalog", "recognition pack of es", "recognition pack of fr", "recognition pack of ja", "recognition pack of xx"]
    (tmp_path / "c.json").write_text(fixture_json())
    with pytest.raises(ValueError, match="recognition pack of es"):
        read_catalog(spark, str(tmp_path / "c.json"))
    assert read_catalog(spark, str(tmp_path / "c.json"), strict=False).languages.count() == 5
    good = json.loads(fixture_json())
    good["languages"] = {"en": good["languages"]["en"]}
    (tmp_path / "d.json").write_text(json.dumps(good))
    assert read_catalog(spark, str(tmp_path / "d.json")).languages.count() == 1


def test_image_texts(spark):
    words = spark.createDataFrame([(1, 0, "der", 95.0, 0, 0, 20, 10, True, False, False), (1, 1, "Hund", 95.0, 24, 0, 50, 10, False, True, True), (2, 0, "x", 10.0, 0, 0, 9, 9, True, True, True)], images.WORDS)
    lines, blocks = images.image_texts(words, "de", "de", lambda rows: rows)
    assert [(r["img"], r["text"]) for r in lines.collect()] == [(1, "der Hund")] and [(r["img"], r["translated"], r["error"]) for r in blocks.collect()] == [(1, "der Hund", None)]


def crowded(spark, m=6_000):
    """30,000 pieces of text at 60 places of one page, and ``m`` rects of 45 shapes: 180 million pairs at 6,000."""
    n = F.col("id")
    shows = spark.range(30_000).select(F.lit(1).alias("page"), n.alias("show"), (n % 10 * 7.5).alias("x"), (n % 6 * 9.25).alias("y"), (n % 10 * 7.5 + n % 4 * 5).alias("end_x"), (n % 6 * 9.25 - n % 3).alias("end_y"))
    rects = spark.range(m).select(F.lit(1).alias("page"), (m - n).alias("rect"), (n % 9 * 8.0).alias("x0"), (n % 5 * 10.0).alias("y0"), (n % 9 * 8.0 + 9).alias("x1"), (n % 5 * 10.0 + 4).alias("y1"))
    return shows, rects


def shapes_of(rects):
    return rects.groupBy("x0", "y0", "x1", "y1").agg(F.min("rect").alias("rect")).collect()


def test_crowded_pages_are_hit_by_places_and_shapes(spark):
    shows, rects = crowded(spark)
    began = time.monotonic()
    got = {r["show"]: r["rect"] for r in pdf.shows_hit(shows, rects, "page").collect()}
    assert time.monotonic() - began < 60
    few = spark.createDataFrame([(1, s["rect"], s["x0"], s["y0"], s["x1"], s["y1"]) for s in shapes_of(rects)], "page int, rect long, x0 double, y0 double, x1 double, y1 double")
    pairs = shows.where("show < 60").crossJoin(few.drop("page")).where(pdf.segment_meets_rect(*[F.col(c) for c in ("x", "y", "end_x", "end_y", "x0", "y0", "x1", "y1")])).collect()
    want = {k: min((abs(p["x"] - p["x0"]), p["rect"]) for p in pairs if p["show"] == k)[1] for k in {p["show"] for p in pairs}}
    assert 0 < len(want) < 60 and got == {k: want[k % 60] for k in range(30_000) if k % 60 in want}


@pytest.mark.parametrize("page, texts", [("<p>one &amp</p>", ["one &"]), ("<p>AT&T x &notit; &#65 &#x42;</p>", ["AT&T x ¬it; A B"]), ("<p>a&lt<b>b&copy;</b>&nbsp</p><pre>R&D &amp x</pre>&", ["a< b©\xa0", "&"])])
def test_references_stay_as_they_are_written(page, texts):
    tokens, scopes = html.parse(page)
    assert [s.text for s in scopes] == texts and html.serialize(tokens) == page
    assert html.translate_fragment(page, html.identity_kernel) == page.replace("<b>b", "<b> b")
    assert html.translate_fragment("<p>one &amp</p>", lambda ts: [("un &", [(0, 5, 0, 4)]) for _ in ts]) == "<p>un &amp;</p>"


def test_rebuilt_pages_keep_references_without_a_semicolon(spark):
    html_ = "<html><body><h1>uno &amp;&amp</h1><p><b>x&quot;</b>y &amp</p></body></html>"
    page = spark.createDataFrame([(html_,)], "html string")
    scopes = lambda df: df.select(html.plain_scopes(F.col("html"))).first()[0]
    assert scopes(page.withColumn("html", html.rebuilt()(F.col("html")))) == scopes(page) == ["uno &&amp", 'x" y &amp']


def test_line_breaks_in_words_have_their_style(spark, tmp_path):
    texts = [(1, "ab end.\nAt ththly the"), (2, "a b\n c\td\u2003e \n"), (3, " \n "), (4, "")]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    con.sql(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    got = more.QUERIES["style_runs"](spark, str(tmp_path))
    want = con.sql(more.ORACLES["style_runs"]).select(*got.columns).fetchall()
    assert len(want) > 4 and sorted(map(tuple, got.collect())) == sorted(want)


def test_white_space_is_blank_unless_told(spark):
    chars = spark.createDataFrame([(1, i, c, float(i), s, 0, 0, 9, 1) for i, (c, s) in enumerate([("a", "bold"), ("\n", "plain"), ("b", "bold")])], "line int, ord int, c string, x double, style string, l int, t int, r int, b int")
    assert [r["text"] for r in pdf.style_runs(chars).collect()] == ["a\nb"]
    assert sorted(r["text"] for r in pdf.style_runs(chars, F.lit(False)).collect()) == ["\n", "a", "b"]


def test_crowded_pages_of_marks_and_links(spark):
    """30,000 marks or links at 60 places and 60,000 rects of 45 shapes: 1.8 * 10^9 pairs."""
    shows, rects = crowded(spark, 60_000)
    places, few = shows.where("show < 60").collect(), shapes_of(rects)
    hits = {p["show"]: [(p["x"] - s["x0"], s["rect"]) for s in few if s["x0"] <= p["x"] <= s["x1"] and s["y0"] <= p["y"] <= s["y1"]] for p in places}
    began = time.monotonic()
    got = {r["mark"]: r["rect"] for r in layout.rects_hit(shows.select("page", F.col("show").alias("mark"), "x", "y"), rects, "page").collect()}
    assert time.monotonic() - began < 60
    assert 0 < sum(map(bool, hits.values())) < 60 and got == {k: min(hits[k % 60])[1] for k in range(30_000) if hits[k % 60]}
    links = shows.select("page", F.col("show").alias("note"), F.when(F.col("show") % 7 == 0, "Text").otherwise("Link").alias("subtype"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1).alias("x1"), (F.col("y") + 1).alias("y1"))
    gone = rects.select("page", *[F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), ("a0", "b0", "a1", "b1"))])
    kept = {r["note"] for r in layout.prune_links(links, gone, "page").collect()}
    over = {p["show"]: any(p["x"] < s["x1"] and p["x"] + 1 > s["x0"] and p["y"] < s["y1"] and p["y"] + 1 > s["y0"] for s in few) for p in places}
    assert kept == {k for k in range(30_000) if k % 7 == 0 or not over[k % 60]} and time.monotonic() - began < 120


def test_tasks_of_spans_have_bounded_rows(spark, monkeypatch):
    """However many rows: a task's share doesn't grow with the input, and the result doesn't depend on the shares."""
    monkeypatch.setattr(spans, "TASK_ROWS", 1_000, raising=False)
    k, d = F.col("id"), F.floor(F.col("id") / 50)
    al = spark.range(20_000).select(d.alias("k"), (k % 50 * 10).alias("sb"), (k % 50 * 10 + 7).alias("se"), (k % 50 * 12).alias("tb"), (k % 50 * 12 + 12 - k % 2 * 3).alias("te"))
    sp = spark.range(8_000).select(F.floor(k / 20).alias("k"), (k % 20 * 25).alias("start"), (k % 20 * 25 + 5 + k % 4 * 10).alias("end"), F.when(k % 3 == 0, "bold").otherwise("italic").alias("style"))
    projected = spans.project(sp, al, "k")
    merged = spans.merge(projected, "k")
    for df in (projected, merged):
        assert max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 3_000
    rows = lambda df: sorted(tuple(r.asDict()[c] for c in ("k", "style", "start", "end")) for r in df.collect())
    assert rows(merged) == rows(spans.merge(spans.project(sp, al, "k", 1), "k", 1)) and len(rows(merged)) > 1_000
