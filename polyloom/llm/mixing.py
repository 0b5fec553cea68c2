"""Mixing sources to target weights by iterative proportional fitting.

Token counts by (source, language, topic) are raked to the three marginals' targets, never above what
there is; a document is then sampled with its cell's probability.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.plans.shared import materialize

#: Target shares of tokens where the categories are known beforehand. A category that isn't named keeps its own share beside the named ones.
TARGETS = {"lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}, "topic": {"prose": 0.9, "tabular": 0.035, "legal": 0.02, "marked": 0.03, "shouted": 0.005}}
#: Where they aren't, a category's target is in proportion to its share of tokens to this power: below 1, the small ones gain.
TEMPERATURES = {"source": 0.5}
MARGINALS = ("source", "lang", "topic")
#: Tokens to keep, of all.
KEEP = 0.7
#: Sweeps end when none moves a cell by more than this share of its tokens, after ``MOST_SWEEPS`` in any case.
TOLERANCE, MOST_SWEEPS = 1e-12, 2000
SEED = 17
WORD = "[^ \\t\\n\\f\\r]+"
MARK = "[#$%&*@~^=+<>{}_/]"
#: Words that legal notices have, in lower case.
LEGAL = ("license", "licence", "copyright", "warrant")
#: The first that holds is the topic; see ``topic``.
TOPICS = ("legal", "shouted", "tabular", "numeric", "marked", "prose")


def topic(text: Column) -> Column:
    """The kind of text, from all of it: legal notices by their words, capitals only, three cells or more between bars or tabs, a fifth or more
    of digits, a sixteenth or more of signs that prose hasn't, or prose. Null text: prose."""
    n = F.char_length(text)
    cells = (n - F.char_length(F.replace(F.replace(text, F.lit("\t"), F.lit("")), F.lit("|"), F.lit(""))))
    legal = functools.reduce(operator.or_, (F.lower(text).contains(w) for w in LEGAL))
    shouted = text.rlike("[A-Z]") & ~text.rlike("[a-z]")
    return F.when(legal, "legal").when(shouted, "shouted").when(cells >= 3, "tabular").when((n > 0) & (F.regexp_count(text, F.lit("[0-9]")) * 5 >= n), "numeric").when((n > 0) & (F.regexp_count(text, F.lit(MARK)) * 16 >= n), "marked").otherwise("prose")


def uniform(id_: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id (for a null id, from the text): the same in every run, however the rows are spread."""
    key = F.coalesce(id_.cast("string"), F.concat(F.lit("text:"), text), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def goals(have: np.ndarray, want: np.ndarray, total: float) -> np.ndarray:
    """``total`` in proportion to ``want``, none above what it has; what those can't take goes to the others, so that all marginals ask for the same total."""
    out, asked = np.zeros(len(have)), np.flatnonzero(want > 0)
    order = asked[np.argsort(have[asked] / want[asked], kind="stable")]
    left, shares = total, want[order].sum()
    for i in order:  # those that have least for their share are used up first
        level = left / shares if shares > 0 else 0.0
        if level * want[i] <= have[i]:
            out[asked] = np.minimum(have[asked], level * want[asked])
            return out
        left, shares = left - have[i], shares - want[i]
    out[asked] = have[asked]
    return out


def rake(cells: pd.DataFrame, targets: dict[str, dict] | None = None, temperatures: dict[str, float] = TEMPERATURES, keep: float = KEEP) -> pd.DataFrame:
    """``cells`` (source, lang, topic, tokens) with probability, sweeps, residual.

    targets: for a marginal, shares by category, of 1 in all; categories it doesn't name keep their shares of tokens, and then all are scaled to
    1. A marginal without targets goes by its power in ``temperatures`` (1 without). A category can't get more than it has.
    residual: the greatest gap, over all categories, between what it gets and its goal, as a share of all tokens to keep.
    It is above zero where the marginals contradict each other given what there is.
    """
    cells = cells.sort_values(list(MARGINALS), na_position="first", kind="stable").reset_index(drop=True)
    n = cells["tokens"].to_numpy(float)
    m, total = n.copy(), n.sum()
    parts = []
    for c in MARGINALS:
        code, names = pd.factorize(cells[c], use_na_sentinel=False)
        have = np.bincount(code, n, len(names))
        share = have / max(total, 1)
        given = (targets or {}).get(c)
        want = share ** temperatures.get(c, 1.0) if given is None else np.array([float(given.get(None if pd.isna(x) else x, s)) for x, s in zip(names, share)])
        parts.append((code, len(names), goals(have, np.where(have > 0, want, 0), keep * total)))
    sweeps = 0
    for sweeps in range(1, MOST_SWEEPS + 1):
        before = m
        for code, k, goal in parts:
            now = np.bincount(code, m, k)
            m = m * (goal / np.where(now > 0, now, 1))[code]
        m = np.minimum(m, n)
        if not len(m) or (np.abs(m - before) / np.maximum(n, 1)).max() <= TOLERANCE:
            break
    residual = max((np.abs(np.bincount(code, m, k) - goal).max() for code, k, goal in parts if k), default=0.0) / max(keep * total, 1)
    return cells.assign(probability=[min(1.0, a / b) if b > 0 else 1.0 for a, b in zip(m, n)], sweeps=sweeps, residual=float(residual))


def _described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"), topic(text).alias("topic"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).alias("tokens"), uniform(F.col(f"`{id_col}`"), text).alias("u"))


def probabilities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, dict] | None = TARGETS, temperatures: dict[str, float] = TEMPERATURES, keep: float = KEEP) -> DataFrame:
    """source, lang, topic, tokens, probability, sweeps, residual of each cell that occurs. Documents are summed up to cells before the shuffle; the cells are
    raked in one task, at some 100 bytes each: ten million of them, such as a million sources in ten combinations, take about a gigabyte."""
    cells = _described(docs, id_col, text_col, source_col, lang_col).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    return cells.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: rake(pdf[["source", "lang", "topic", "tokens"]], targets, temperatures, keep), "source string, lang string, topic string, tokens long, probability double, sweeps int, residual double")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **options) -> DataFrame:
    """One row for each document: doc_id, source, lang, topic, tokens, probability, sampled.

    Null sources and languages are categories of their own. A text without words has no tokens: it
    weighs nothing, and shares its cell's probability (1 if the cell has no tokens). Repeated rows fall alike, by their id; rows
    without an id by their text. Other columns are ignored. Empty input: empty result.
    """
    columns = (id_col, text_col, source_col, lang_col)
    # written, so that its size is known and the join is chosen by it
    cells = materialize(probabilities(docs, *columns, **options), "cells").select(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("topic").alias("t"), "probability")
    met = _described(docs, *columns).join(cells, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")) & (F.col("topic") == F.col("t")))
    return met.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), (F.col("u") < F.col("probability")).alias("sampled"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **options) -> DataFrame:
    """The sampled rows of ``docs``, all columns kept."""
    cells = materialize(probabilities(docs, id_col, text_col, source_col, lang_col, **options), "cells").select(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("topic").alias("t"), "probability")
    whole = docs.select(F.struct("*").alias("row"))  # as one column, so that no name of the caller's can clash
    id_, text, source, lang = (F.col(f"row.`{c}`") for c in (id_col, text_col, source_col, lang_col))
    met = whole.withColumns({"topic": topic(text), "u": uniform(id_, text)}).join(cells, source.eqNullSafe(F.col("s")) & lang.eqNullSafe(F.col("l")) & (F.col("topic") == F.col("t")))
    return met.where("u < probability").select("row.*")


def mixture_sql() -> str:
    """The sweeps as a recursion that ends by the same rule."""

    def want(c: str) -> str:
        if c in TARGETS:
            return f"case c {' '.join(f'when {k!r} then {v}' for k, v in TARGETS[c].items())} else h / total end"
        return f"pow(h / total, {TEMPERATURES.get(c, 1.0)})"

    sides = ", ".join(f"""h_{c} as (select {c} as c, sum(n) as h, any_value(total) as total from tot group by {c}),
w_{c} as (select c, h, total, case when h > 0 then {want(c)} else 0 end as w from h_{c}),
o_{c} as (select *, (total * {KEEP} - coalesce(sum(h) over (order by h / w, c nulls first rows between unbounded preceding and 1 preceding), 0)) / (sum(w) over (order by h / w desc, c desc nulls last rows between unbounded preceding and current row)) as level from w_{c} where w > 0),
g_{c} as (select w.c, case when w.w > 0 then least(w.h, coalesce(l.level, 1e300) * w.w) else 0 end as g from w_{c} w left join (select arg_min(level, {{'a': h / w, 'b': c is not null, 'c': c}}) as level from o_{c} where level * w <= h) l on true)""" for c in MARGINALS)
    inner = "select * from r where k < {} and moved > {}".format(MOST_SWEEPS, TOLERANCE)
    old = "m"
    for i, c in enumerate(MARGINALS):
        inner = f"select *, {old} * g_{c} / coalesce(nullif(sum({old}) over (partition by {c}), 0), 1) as m{i} from ({inner})"
        old = f"m{i}"
    cols = "source, lang, topic, n"
    marg = ", ".join(f"g_{c}" for c in MARGINALS)
    return f"""
with recursive d as (select doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^ \t\n\f\r]+')), 0) as tokens,
  case when {" or ".join(f"contains(lower(text), '{w}')" for w in LEGAL)} then 'legal'
    when regexp_matches(text, '[A-Z]') and not regexp_matches(text, '[a-z]') then 'shouted'
    when length(text) - length(replace(replace(text, chr(9), ''), '|', '')) >= 3 then 'tabular'
    when length(text) > 0 and len(regexp_extract_all(text, '[0-9]')) * 5 >= length(text) then 'numeric'
    when length(text) > 0 and len(regexp_extract_all(text, '{MARK}')) * 16 >= length(text) then 'marked' else 'prose' end as topic,
  ('0x' || substr(md5(doc_id || ':{SEED}'), 1, 13))::bigint / pow(2.0, 52) as u from documents),
cells as (select source, lang, topic, sum(tokens)::double as n from d group by all),
tot as (select *, greatest(sum(n) over (), 1) as total from cells),
{sides},
r as (select {cols}, n as m, a.g as g_source, b.g as g_lang, e.g as g_topic, 0 as k, 1.0::double as moved from tot
  join g_source a on a.c is not distinct from source join g_lang b on b.c is not distinct from lang join g_topic e on e.c = topic
  union all
  select {cols}, least({old}, n) as m, {marg}, k + 1, max(abs(least({old}, n) - m) / greatest(n, 1)) over () as moved from ({inner})),
p as (select source as s, lang as l, topic as t, case when n > 0 then least(1.0, m / n) else 1.0 end as probability from r where k = (select max(k) from r))
select doc_id, source, lang, topic, tokens::int as tokens, round(probability, 6) as probability, u < probability as sampled
from d join p on source is not distinct from s and lang is not distinct from l and topic = t"""
