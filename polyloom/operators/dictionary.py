"""Word look-up: a dictionary is a table, and asking it is a join."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.functions.text import unicode_trim


def dictionary_path(root: Column, code: Column) -> Column:
    """Where the dictionary of a code is installed; null without a code."""
    return F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/dictionaries/"), code, F.lit(".dict"))


def lookup(asked: DataFrame, entries: DataFrame, query: str = "query", word: str = "word", by: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` with the columns of ``entries`` (word and others, one row for each word of each ``by``), for those that are found.

    The query is trimmed; a blank or null one finds nothing. The exact word comes first, then the one in lower case, only where that
    differs. Two equi-joins on the word: Catalyst broadcasts a small dictionary and shuffles a large one.
    """
    q = asked.withColumn("__q", unicode_trim(F.col(query))).where("__q <> ''").withColumn("__l", F.lower("__q"))
    rest = [c for c in entries.columns if c not in (*by, word)]
    side = lambda k: entries.select(*[F.col(c).alias(f"__{c}{k}") for c in by], F.struct(F.col(word), *rest).alias(f"__e{k}"))
    on = lambda k, c: [F.col(b) == F.col(f"__{b}{k}") for b in by] + [F.col(c) == F.col(f"__e{k}.{word}")]
    both = lambda conds: functools.reduce(operator.and_, conds)
    met = q.join(side(1), both(on(1, "__q")), "left").join(side(2), both([*on(2, "__l"), F.col("__l") != F.col("__q")]), "left")
    found = met.withColumn("__e", F.coalesce("__e1", "__e2")).where("__e is not null")
    return found.select(*[F.col(f"`{c}`") for c in asked.columns], F.col(f"__e.{word}").alias("entry"), *[F.col(f"__e.{c}") for c in rest])
