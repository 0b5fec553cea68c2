"""Text: classes, sentences, detection, routing, line translation, escapes, dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyloom.functions import detect as d
from polyloom.functions import text as t
from polyloom.operators import dictionary, kernels, routing
from polyloom.registry.base import table, values_df, values_sql

AVAILABLE = ["de", "en", "es", "fr"]

# ---- SQL parts ----

_WS = r"[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]"
_WSET = r"\t\n\x0B\f\r\x85\p{Z}"
_TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '\\A[{_WSET}]+', ''), '[{_WSET}]+\\z', '')"
_PASS = lambda c: f"regexp_full_match({c}, '[\\p{{N}}{_WSET}\\p{{P}}·•–—―]+')"
_CLASS = lambda c: f"case when {_TRIM(c)} = '' then 'blank' when {_PASS(c)} then 'passthrough' else 'translatable' end"
#: Sentences with sentinels, since this regular expression library has no lookaround; twice, as boundaries may touch.
_SENT = lambda c: f"case when {_TRIM(c)} = '' then [] else string_split(regexp_replace({c}, '([.!?])[{_WSET}]+(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) end"


def _counts_sql(table_: str, key: str) -> str:
    """key, text, and n_de .. n_fr: words in each profile."""
    cols = ", ".join(f"len(list_filter(ws, lambda w: list_contains([{', '.join(repr(w) for w in p)}], w))) as n_{code}" for code, p in d.PROFILES.items())
    return f"select {key}, text, {cols} from (select {key}, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '') as ws from {table_}) "


def _detect_sql(hint: str | None = None) -> tuple[str, str]:
    """(language, confidence) expressions over n_de .. n_fr."""
    n = {c: f"(n_{c} + {1 if c == hint else 0})" for c in d.PROFILES}
    total = " + ".join(n.values())
    top = "greatest(" + ", ".join(n.values()) + ")"
    lang = "case " + " ".join(f"when {n[c]} = {top} then '{c}'" for c in sorted(n)) + " end"
    known = " + ".join(f"n_{c}" for c in d.PROFILES)
    return f"case when {known} > 0 then {lang} end", f"case when {known} > 0 then floor({top} * 100.0 / ({total}))::int end"


def _robust_sql(available: list[str]) -> str:
    lang, conf = _detect_sql()
    tries = [f"case when {conf} >= {d.RELIABLE_PERCENT} and {lang} in ({', '.join(repr(a) for a in available)}) then {lang} end"]
    for a in available:
        lang, conf = _detect_sql(a)
        tries.append(f"case when {conf} >= {d.RELIABLE_PERCENT} and {lang} = '{a}' then '{a}' end")
    return f"case when {_TRIM('text')} = '' then null else coalesce({', '.join(tries)}) end"


_ROUTED = f"""routed as (
  select source, text, ord, class, case when class = 'translatable' then lang end as language,
    case when class = 'passthrough' then 'passthrough' when lang is null then 'undetected' when lang = 'en' then 'same' else 'batch' end as state
  from (select *, {_robust_sql(AVAILABLE)} as lang from (select c.*, u.source, u.ord, {_CLASS('c.text')} as class from ({_counts_sql('(select distinct text, text as k from documents where text is not null)', 'k')}) c
    join (select source, text, min(doc_id) as ord from documents group by source, text) u on u.text = c.k)) where class <> 'blank')"""

# ---- queries ----


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(table(spark, sf_dir, "documents").select("source", "text", F.col("doc_id").alias("ord")), "en", AVAILABLE, by=("source",))


def corpus_routing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _routed(spark, sf_dir).withColumn("n", F.size(t.split_sentences(F.col("text"))))
    return rows.groupBy("state", "language").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("sentences"))


def unique_texts(spark, sf_dir):
    return routing.unique_texts(table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("ord")))


_EXTRA_LINES = ["123", " -- ", "", "   ", "$5", "a1", "…", "١٢٣", "12:30 — 13:00", "1 + 1", "10%", "Nº 5", " 7 ", "«»"]


def passthrough_class(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).union(table(spark, sf_dir, "benchmark").select("text")).union(values_df(spark, "line string", [(x,) for x in _EXTRA_LINES]))
    return lines.groupBy(t.text_class(F.col("line")).alias("class")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


_NUMBERS = ["1", "1.0", "1.", ".5", "-3", "+2.5e10", "1e-5", "inf", "-Infinity", "NaN", "1.0f", "1d", " 1 ", "0x1A", "1,000", "e5", ".", "", "--1", "1_000", "infinit", "12.34.5"]


def numeric_text_guard(spark, sf_dir):
    given = values_df(spark, "text string", [(x,) for x in _NUMBERS])
    amounts = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderstatus")).alias("text")).union(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string")))
    return given.union(amounts).groupBy("text").agg(F.first(t.is_number(F.col("text"))).alias("is_number"), F.count(F.lit(1)).alias("n"))


def split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(t.sentence_spans(F.col("text"))))


def sentence_stats_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", t.split_sentences(F.col("text")).alias("s"))
    per = docs.select("lang", F.size("s").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("chars"))
    return per.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("sentences"), F.sum("chars").alias("chars"), F.max("n").alias("most"))


def recombine_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.recombine(t.split_sentences(F.col("text"))).alias("text"))


def align_rebase(spark, sf_dir):
    """Word alignments of each benchmark sentence with itself, moved to their place in the recombined text."""
    spans = table(spark, sf_dir, "benchmark").select("item_id", F.inline(t.sentence_spans(F.col("text"))))
    before = Window.partitionBy("item_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("tgt_start", F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)))
    word = F.split("text", " ")
    starts = F.aggregate(F.transform(word, lambda w: F.char_length(w) + 1), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    each = F.transform(word, lambda w, i: F.struct(i.alias("w"), F.get(starts, i).alias("b"), (F.get(starts, i) + F.char_length(w)).alias("e")))
    rows = placed.select("item_id", "k", "start", "tgt_start", F.inline(each))
    return rows.select("item_id", "k", "w", (F.col("start") + F.col("b")).cast("int").alias("src_begin"), (F.col("start") + F.col("e")).cast("int").alias("src_end"), (F.col("tgt_start") + F.col("b")).cast("int").alias("tgt_begin"), (F.col("tgt_start") + F.col("e")).cast("int").alias("tgt_end"))


def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", d.detect_language(F.col("text")).alias("x")).select("doc_id", "lang", F.col("x.language").alias("language"), F.col("x.is_reliable").alias("is_reliable"), F.col("x.confidence").alias("confidence"))


def detect_robust(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", d.detect_robust(F.col("text"), ["es", "fr"]).alias("code"))


def batch_routing_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("ord"))
    return routing.batch_plan(routing.route(docs, "en", AVAILABLE)).withColumnRenamed("first", "first_ord")


def nothing_reason_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text", F.col("doc_id").alias("ord"))
    cases = docs.where("lang = 'en'").select(F.concat(F.lit("en-only "), "source").alias("source"), "text", "ord").union(docs.select("source", "text", "ord")).union(values_df(spark, "source string, text string, ord long", _REASON_ROWS))
    return routing.reasons(cases, routing.route(cases, "en", AVAILABLE, by=("source",)), ("source",))


_REASON_ROWS = [("blank", "  ", 1), ("blank", "", 2), ("numbers", "123", 1), ("unknown", "xyzzy plugh", 1), ("mixed", "xyzzy plugh", 1), ("mixed", "the cat and the dog", 2), ("english", "the cat and the dog", 1)]


def mixed_translate_lexicon(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    routed = routing.route(turns, "en", AVAILABLE)
    text = F.when(F.col("state") == "passthrough", F.col("text")).otherwise(kernels.lexicon_translate(F.col("text"), F.col("language")))
    return routed.where("state in ('passthrough', 'batch')").select("ord", "state", "language", text.alias("translated"))


def translate_text_lines(spark, sf_dir):
    """Line by line: blank lines stay as they are, numbers too, others go through the lexicon of French."""
    line = lambda x: F.when(t.is_blank(x) | t.is_number(x), x).otherwise(kernels.lexicon_translate(x, F.lit("fr")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.unicode_trim(F.col("text")).alias("text"))
    return turns.select("conv_id", "turn", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("translated"))


def dictionary_lookup(spark, sf_dir):
    """Words of the conversations in a dictionary of the documents' words: exact, else in lower case if that differs."""
    tokens = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    entries = table(spark, sf_dir, "documents").select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    asked = table(spark, sf_dir, "conversations").select(F.explode(tokens).alias("query")).distinct()
    return dictionary.lookup(asked, entries)


def identity_alignments(spark, sf_dir):
    each = F.transform(F.sequence(F.lit(0), F.char_length("text") - 1), lambda i: F.struct(i.alias("src_begin"), (i + 1).alias("src_end"), i.alias("tgt_begin"), (i + 1).alias("tgt_end")))
    return table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.inline(each))


def xml_escape(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    e = t.xml_escape(F.col("html"))
    return pages.select("page_id", F.md5(e).alias("escaped"), F.md5(t.xml_escape_attribute(F.col("html"))).alias("attribute"), (t.xml_unescape(e) == F.col("html")).alias("round_trip"), F.md5(t.xml_unescape(F.col("html"))).alias("unescaped"))


def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.file_name(F.concat(F.lit("/"), "p_name", F.lit(" #"), "p_brand", F.lit("?"))).alias("file_name"))


def region_flag(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", t.region_flag(F.substring("n_name", 1, 2)).alias("flag"), t.region_flag(F.col("n_name")).alias("none"))


def winansi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.winansi(F.concat(F.col("text"), F.lit(" € “x” → ✓ 日本")))).alias("encoded"))


def script_profile(spark, sf_dir):
    n = lambda p: F.regexp_count("text", F.lit(p)).alias
    return table(spark, sf_dir, "documents").select("doc_id", n(r"\p{Lu}")("upper"), n(r"\p{Ll}")("lower"), n(r"\p{N}")("numbers"), n(r"\p{P}")("punctuation"), n(r"\p{IsCyrillic}")("cyrillic"), n(r"\p{IsGreek}")("greek"))


QUERIES = {f.__name__: f for f in (corpus_routing_summary, unique_texts, passthrough_class, numeric_text_guard, split_sentences, sentence_stats_by_lang, recombine_sentences, align_rebase, detect_language, detect_robust, batch_routing_plan, nothing_reason_by_source, mixed_translate_lexicon, translate_text_lines, dictionary_lookup, identity_alignments, xml_escape, sanitize_name, region_flag, winansi, script_profile)}

_LANG, _CONF = _detect_sql()
_LEX = lambda c, lang: f"array_to_string(list_transform(string_split({c}, ' '), lambda w: coalesce(case " + " ".join(f"when {lang} = '{code}' then case w " + " ".join(f"when '{a}' then '{b}'" for a, b in ws.items()) + " end" for code, ws in kernels.LEXICON.items()) + " end, w)), ' ')"
_TOKENS = "list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda w: w <> '')"
_ESC = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_UNESC = "replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
_SPANS = lambda t_, key: f"""parts as (select {key}, string_split(regexp_replace(text, '([.!?])([{_WSET}]+)(\\p{{Lu}})', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1)) as ps from {t_} where {_TRIM('text')} <> ''),
flat as (select {key}, unnest(range(0, len(ps))) as i, unnest(ps) as p from parts),
spans as (select {key}, (i // 2)::int as k, coalesce(sum(length(p)) over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0)::int as start, p as text, i from flat qualify i % 2 = 0)"""  # noqa: E731

ORACLES = {
    "corpus_routing_summary": f"with {_ROUTED} select state, language, count(*) as texts, sum(len({_SENT('text')}))::bigint as sentences from routed group by state, language",
    "unique_texts": "select text, min(doc_id) as ord from documents group by text",
    "passthrough_class": f"with l as (select unnest(string_split(text, chr(10))) as line from documents union all select text from benchmark union all {values_sql('line string', [(x,) for x in _EXTRA_LINES])}) select {_CLASS('line')} as class, count(*) as n_lines, sum(length(line))::bigint as n_chars from l group by 1",
    "numeric_text_guard": f"with v as ({values_sql('text string', [(x,) for x in _NUMBERS])} union all select 'c' || o_orderstatus from orders union all select l_linenumber::varchar from lineitem) select text, any_value(regexp_full_match(text, '[+-]?((?i:inf|infinity|nan)|([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)')) as is_number, count(*) as n from v group by text",
    "split_sentences": f"with {_SPANS('documents', 'doc_id')} select doc_id, k, start, text from spans",
    "sentence_stats_by_lang": f"with s as (select lang, {_SENT('text')} as s from documents) select lang, count(*) as docs, sum(len(s))::bigint as sentences, sum(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0))::bigint as chars, max(len(s))::int as most from s group by lang",
    "recombine_sentences": f"select doc_id, array_to_string({_SENT('text')}, ' ') as text from documents",
    "align_rebase": f"""with {_SPANS('benchmark', 'item_id')},
placed as (select *, coalesce(sum(length(text) + 1) over (partition by item_id order by k rows between unbounded preceding and 1 preceding), 0) as tgt from spans),
w as (select item_id, k, start, tgt, unnest(range(0, len(string_split(text, ' '))))::int as w, unnest(string_split(text, ' ')) as word from placed),
o as (select *, coalesce(sum(length(word) + 1) over (partition by item_id, k order by w rows between unbounded preceding and 1 preceding), 0) as b from w)
select item_id, k, w, (start + b)::int as src_begin, (start + b + length(word))::int as src_end, (tgt + b)::int as tgt_begin, (tgt + b + length(word))::int as tgt_end from o""",
    "detect_language": f"select doc_id, lang, {_LANG} as language, {_CONF} >= {d.RELIABLE_PERCENT} as is_reliable, {_CONF} as confidence from ({_counts_sql('documents', 'doc_id, lang')})",
    "detect_robust": f"select doc_id, {_robust_sql(['es', 'fr'])} as code from ({_counts_sql('documents', 'doc_id')})",
    "batch_routing_plan": f"with {_ROUTED}, u as (select text, language, min(ord) as ord from routed where state = 'batch' group by text, language), b as (select language, min(ord) as first_ord, count(*) as texts from u group by language) select language, first_ord, texts, (row_number() over (order by first_ord) - 1)::int as batch_ord from b",
    "nothing_reason_by_source": f"""with cases as (select 'en-only ' || source as source, text from documents where lang = 'en' union all select source, text from documents union all select source, text from ({values_sql('source string, text string, ord long', _REASON_ROWS)})),
u as (select distinct source, text from cases), c as (select source, {_CLASS('text')} as class, {_robust_sql(AVAILABLE)} as lang from ({_counts_sql('u', 'source')})),
n as (select source, count(*) filter (class = 'translatable' and lang = 'en') as s, count(*) filter (class = 'translatable' and lang is null) as m, count(*) filter (class = 'passthrough' or (class = 'translatable' and lang <> 'en')) as g from c group by source)
select source, case when g > 0 then null when s > 0 and m = 0 then 'ALREADY_TARGET_LANGUAGE' when s = 0 and m > 0 then 'COULD_NOT_DETECT' else 'NO_TRANSLATABLE_TEXT' end as nothing_reason from n""",
    "mixed_translate_lexicon": f"""with u as (select text, min(conv_id * 1000 + turn) as ord from conversations group by text),
c as (select *, {_CLASS('text')} as class, {_robust_sql(AVAILABLE)} as lang from ({_counts_sql('u', 'ord')}))
select ord, case when class = 'passthrough' then 'passthrough' else 'batch' end as state, case when class = 'translatable' then lang end as language, case when class = 'passthrough' then text else {_LEX('text', 'lang')} end as translated from c where class = 'passthrough' or (class = 'translatable' and lang <> 'en')""",
    "translate_text_lines": f"select conv_id, turn, array_to_string(list_transform(string_split({_TRIM('text')}, chr(10)), lambda x: case when {_TRIM('x')} = '' or regexp_full_match(x, '[+-]?[0-9.]+') then x else {_LEX('x', chr(39) + 'fr' + chr(39))} end), chr(10)) as translated from conversations",
    "dictionary_lookup": f"with e as (select word, count(*) as n from (select unnest({_TOKENS}) as word from documents) group by word), q as (select distinct unnest({_TOKENS}) as query from conversations) select query, coalesce(a.word, b.word) as entry, coalesce(a.n, b.n) as n from q left join e a on a.word = query left join e b on b.word = lower(query) and lower(query) <> query where coalesce(a.word, b.word) is not null",
    "identity_alignments": "select item_id, unnest(range(0, length(text)))::int as src_begin, unnest(range(1, length(text) + 1))::int as src_end, unnest(range(0, length(text)))::int as tgt_begin, unnest(range(1, length(text) + 1))::int as tgt_end from benchmark where text <> ''",
    "xml_escape": f"select page_id, md5({_ESC.format(c='html')}) as escaped, md5(replace({_ESC.format(c='html')}, '\"', '&quot;')) as attribute, true as round_trip, md5({_UNESC.format(c='html')}) as unescaped from pages",
    "sanitize_name": "select p_partkey, regexp_replace(regexp_replace('/' || p_name || ' #' || p_brand || '?', '[^\\p{L}\\p{N}_.-]+', '_', 'g'), '^_+|_+$', '', 'g') as file_name from part",
    "region_flag": "select n_nationkey, chr(ascii(upper(n_name[1])) + 127397) || chr(ascii(upper(n_name[2])) + 127397) as flag, case when length(n_name) = 2 then chr(ascii(upper(n_name[1])) + 127397) || chr(ascii(upper(n_name[2])) + 127397) end as \"none\" from nation",
    "winansi": f"select doc_id, md5(regexp_replace(text || ' € “x” → ✓ 日本', '[^ -~ -ÿ{t._WINANSI}]', '?', 'g')) as encoded from documents",
    "script_profile": "select doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::int as {n}" for n, p in (("upper", "\\p{Lu}"), ("lower", "\\p{Ll}"), ("numbers", "\\p{N}"), ("punctuation", "\\p{P}"), ("cyrillic", "\\p{Cyrillic}"), ("greek", "\\p{Greek}"))) + " from documents",
}
