"""Translation of texts, lines and pages through batch kernels: split, infer distinct sentences once, join back in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.functions.detect import detect_robust
from polyloom.functions.text import is_blank, is_number, split_sentences, unicode_trim
from polyloom.operators.kernels import Translate, apply_kernel
from polyloom.operators.layout import layout_blocks
from polyloom.operators.routing import NOTHING, SAME, UNDETECTED

Load = Callable[[str], Translate]


def pivoted(load: Load) -> Load:
    """A loader that takes keys of several steps, such as ``es-en,en-fr``, and runs them one after the other. No step: the text as it is."""

    def chain(key: str) -> Translate:
        steps = [load(k) for k in key.split(",") if k]

        def run(texts: list[str]) -> list[str]:
            for step in steps:
                texts = step(texts)
            return texts

        return run

    return chain


def translate_sentences(rows: DataFrame, load: Load, key: str = "id", route: str = "route", text: str = "text") -> DataFrame:
    """key, translated, error. Every distinct sentence of a route goes through the kernel once; a text's sentences are joined by one space. Blank texts never reach it."""
    parts = rows.select(key, route, F.posexplode_outer(split_sentences(F.col(text))).alias("k", "sentence"))
    done = apply_kernel(parts, load, route, "sentence", "out")
    by = done.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "out")))).alias("p"), F.max("kernel_error").alias("error"))
    return by.select(key, F.when(F.col("error").isNull(), F.array_join(F.transform("p", lambda x: x["out"]), " ")).alias("translated"), "error")


def translate_texts(rows: DataFrame, routes: DataFrame, load: Load) -> DataFrame:
    """id, translated, error for rows (id, text, from_code, to_code); routes: from_code, to_code, steps (joined by commas).

    Texts are trimmed. Of a pair of one language, and for numbers, the text stays; blank lines stay where they are. A pair without a route
    gives an error and no text.
    """
    base = rows.select("id", unicode_trim(F.col("text")).alias("text"), "from_code", "to_code").join(routes.withColumnRenamed("steps", "route"), ["from_code", "to_code"], "left")
    plain = (F.col("from_code") == F.col("to_code")) | is_number(F.col("text")) | (F.col("text") == "")
    lines = base.where(~plain & F.col("route").isNotNull()).select("id", "route", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("lid", F.struct("id", "n"))
    done = translate_sentences(lines.where(~is_blank(F.col("line"))), pivoted(load), "lid", "route", "line")
    met = lines.join(done, "lid", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("translated", "line").alias("t")))).alias("ls"), F.max("error").alias("e"))
    whole = met.select("id", F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("t"), "e")
    out = base.join(whole, "id", "left")
    error = F.when(plain, None).when(F.col("route").isNull(), F.concat(F.lit("missing route "), F.concat_ws("-", "from_code", "to_code"))).otherwise(F.col("e"))
    return out.select("id", F.when(error.isNull(), F.when(plain, F.col("text")).otherwise(F.col("t"))).alias("translated"), error.alias("error"))


def translate_pages(fragments: DataFrame, target: str, available: list[str], load: Load, forced: str | None = None) -> DataFrame:
    """page, block, text, translated, state, reason of every block of every page (``layout.FRAGMENTS``).

    A page's language is that of its blocks together. state: ``translate``, ``identity`` (target language already), ``empty`` with a reason.
    Opaque blocks keep their text. Segments of all pages share the kernel's batches, one for each language.
    """
    blocks = layout_blocks(fragments)
    joined = blocks.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), " ").alias("all"))
    language = F.lit(forced) if forced else detect_robust(F.col("all"), [*available, target])
    pages = joined.withColumn("lang", language).select("page", "lang", F.when(is_blank(F.col("all")), NOTHING).when(F.col("lang").isNull(), UNDETECTED).when(F.col("lang") == target, SAME).alias("reason"))
    state = F.when(F.col("reason").isNull(), "translate").when(F.col("reason") == SAME, "identity").otherwise("empty")
    met = blocks.join(pages, "page").withColumn("state", state).withColumn("route", F.concat_ws("-", "lang", F.lit(target)))
    seg = met.where("state = 'translate' and not opaque").select("page", "block", "route", "text", F.posexplode("segments").alias("n", "s"))
    seg = seg.withColumn("piece", F.translate(F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), "\n", " "))
    done = apply_kernel(seg, load, "route", "piece", "out").groupBy("page", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "out"))), lambda x: x["out"]), "").alias("out"))
    return met.join(done, ["page", "block"], "left").select("page", "block", "text", F.coalesce("out", "text").alias("translated"), "state", "reason")
