"""Alignments: pairs of character spans in a source and in its translation, moved, chained and found by kernels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyloom.functions.text import sentence_spans
from polyloom.operators.kernels import apply_kernel
from polyloom.operators.routing import route

SPANS = "array<struct<sb:int,se:int,tb:int,te:int>>"
#: A batch function that gives (translated, [(source begin, end, target begin, end)...]) of each text.
Aligned = Callable[[list[str]], list[tuple[str, list[tuple[int, int, int, int]]]]]


def identity(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text, each character beside itself."""
    return text, [(i, i + 1, i, i + 1) for i in range(len(text))]


def rebase(pieces: DataFrame, key: str) -> DataFrame:
    """key, translated, alignments (in order of the target) from pieces (key, k, start, translated, spans) of a text.

    Pieces are joined by one space, which belongs to no alignment; spans move by their piece's place in the source and in the joined text.
    """
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.char_length("translated") + 1).over(before), F.lit(0)))
    moved = F.transform("spans", lambda s: F.struct((s["tb"] + F.col("at")).cast("int").alias("tb"), (s["te"] + F.col("at")).cast("int").alias("te"), (s["sb"] + F.col("start")).cast("int").alias("sb"), (s["se"] + F.col("start")).cast("int").alias("se")))
    by = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "translated", moved.alias("m")))).alias("p"))
    spans = F.transform(F.flatten(F.transform("p", lambda p: p["m"])), lambda s: F.struct(s["sb"].alias("sb"), s["se"].alias("se"), s["tb"].alias("tb"), s["te"].alias("te")))
    return by.select(key, F.array_join(F.transform("p", lambda p: p["translated"]), " ").alias("translated"), spans.alias("alignments"))


def compose(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, sb, se, tb, te through a text between: ``first`` (key, sb, se, tb, te) into it, ``second`` out of it.

    Each span of ``second`` takes the least span of the source that holds all it meets in the text between; what meets nothing is left out. Spans
    meet by cells of the text between, so that long texts don't meet all against all.
    """
    cell = 64
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    a = first.where("tb < te").select(key, "sb", "se", F.col("tb").alias("mb"), F.col("te").alias("me"), cells("tb", "te").alias("c"))
    b = second.where("sb < se").select(key, F.col("sb").alias("nb"), F.col("se").alias("ne"), "tb", "te", cells("sb", "se").alias("c"))
    met = b.join(a, [key, "c"]).where("mb < ne and nb < me")
    return met.groupBy(key, "nb", "ne", "tb", "te").agg(F.min("sb").alias("sb"), F.max("se").alias("se")).select(key, "sb", "se", "tb", "te")


def translate_aligned(rows: DataFrame, load: Callable[[str], Aligned], key: str = "id", route_: str = "route", text: str = "text") -> DataFrame:
    """key, translated, alignments, error of rows (key, route, text). Routes of several steps (``es-en,en-fr``) chain their alignments, sentences are split once on the source's side.

    Every distinct sentence of a route goes through its kernel once. A blank text gives an empty one, and its kernel isn't called.
    """

    def encoded(step_key: str) -> Callable[[list[str]], list[str]]:
        import json

        steps = [load(k) for k in step_key.split(",") if k]

        def run(texts: list[str]) -> list[str]:
            done = [identity(t) for t in texts] if not steps else steps[0](texts)
            for step in steps[1:]:
                nxt = step([t for t, _ in done])
                done = [(t2, chain(s1, s2)) for (_, s1), (t2, s2) in zip(done, nxt)]
            return [json.dumps({"t": t, "s": [dict(zip(("sb", "se", "tb", "te"), s)) for s in sorted(spans, key=lambda s: (s[2], s[3]))]}) for t, spans in done]

        return run

    parts = rows.select(key, route_, F.inline_outer(sentence_spans(F.col(text))))
    done = apply_kernel(parts.where("text is not null"), encoded, route_, "text", "out")
    read = F.from_json("out", f"t string, s {SPANS}")
    pieces = done.select(key, "k", "start", F.coalesce(read["t"], F.lit("")).alias("translated"), F.coalesce(read["s"], F.expr(f"cast(array() as {SPANS})")).alias("spans"), "kernel_error")
    errors = pieces.groupBy(key).agg(F.max("kernel_error").alias("error"))
    whole = rebase(pieces, key).join(errors, key)
    out = rows.select(key).join(whole, key, "left")
    ok = F.col("error").isNull()
    return out.select(key, F.when(ok, F.coalesce("translated", F.lit(""))).alias("translated"), F.when(ok, F.coalesce("alignments", F.expr(f"cast(array() as {SPANS})"))).alias("alignments"), "error")


def chain(first: list[tuple[int, int, int, int]], second: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``compose`` for one text, in a kernel."""
    out = []
    for nb, ne, tb, te in second:
        met = [(sb, se) for sb, se, mb, me in first if mb < ne and nb < me]
        if met:
            out.append((min(m[0] for m in met), max(m[1] for m in met), tb, te))
    return out


def translate_mixed(inputs: DataFrame, routes: DataFrame, target: str, available: list[str], load: Callable[[str], Aligned], forced: str | None = None) -> DataFrame:
    """ord, text, state, language, translated, alignments, error for each distinct text of inputs (ord, text) that has a translation.

    Texts that pass through stay, aligned with themselves; others go in the batch of their language over ``routes`` (from_code, to_code, steps). A language
    without a route has no rows, as has a forced language equal to the target (its route has no step).
    """
    routed = route(inputs, target, available, forced)
    same = routed.where("state = 'passthrough'").select("ord", "text", "state", F.lit(None).cast("string").alias("language"), F.col("text").alias("translated"), F.expr("transform(sequence(0, char_length(text) - 1), i -> struct(i as sb, i + 1 as se, i as tb, i + 1 as te))").cast(SPANS).alias("alignments"), F.lit(None).cast("string").alias("error"))
    steps = routes.where((F.col("to_code") == target) & (F.col("steps") != "")).select(F.col("from_code").alias("language"), F.col("steps").alias("route"))
    batch = routed.where("state = 'batch'").select("ord", "text", "state", "language").join(steps, "language")
    done = translate_aligned(batch.select(F.col("ord").alias("id"), "route", "text"), load)
    met = batch.join(done, F.col("ord") == F.col("id"))
    return same.unionByName(met.select("ord", "text", "state", "language", "translated", "alignments", "error"))
