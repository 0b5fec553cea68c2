"""Line deduplication by distinct-site spread: lines that many sites carry are boilerplate; one copy of each stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.functions.text import bound
from polyloom.plans.bloom import bloom, might_contain
from polyloom.plans.shared import materialize

#: A line is boilerplate if at least so many sites carry it and it has at least so many characters.
MIN_SITES, MIN_CHARS = 10, 20
LOG_REGISTERS = 10
#: Estimates this close to MIN_SITES, relatively, are replaced by exact counts: over four standard errors (1.04 / 32 each).
MARGIN = 0.15


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h, site, doc, content, pos of each line that is long enough."""
    split = docs.select("doc", "site", F.xxhash64("text").alias("content"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.where(F.char_length(F.trim("line")) >= min_chars).select(_line_hash(F.col("line")).alias("h"), "site", "doc", "content", "pos")


def _own(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{site_col}`").alias("site")).where("text is not null")


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """h, sites, first for each boilerplate line: its hash, its number of sites, and the place of the copy that stays.

    Sites are counted by HyperLogLog sketches that merge as partial aggregates do; where the estimate is within
    ``MARGIN`` of ``min_sites``, by distinct count. A null site is no site. first: struct of doc, content, pos, the least.
    """
    lines = _lines(_own(docs, id_col, text_col, site_col), min_chars)
    place = F.struct(F.col("doc").isNull().alias("no"), "doc", "content", "pos")
    seen = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"), F.min(place).alias("first"), F.count("site").alias("n")).where(F.col("n") >= min_sites)
    seen = materialize(seen.select("h", F.hll_sketch_estimate("sketch").alias("sites"), "first").where(F.col("sites") >= min_sites * (1 - MARGIN)), "spread")
    unsure = seen.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("h")
    may = bloom(unsure, "h")
    exact = lines.where(might_contain(may, F.col("h")) & F.col("site").isNotNull()).select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("exact"))
    sure = seen.where(F.col("sites") > min_sites * (1 + MARGIN))
    settled = seen.join(unsure, "h", "left_semi").join(exact, "h").where(F.col("exact") >= min_sites).select("h", F.col("exact").alias("sites"), "first")
    return sure.unionByName(settled)


def _dropped(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """(doc, content, drop: positions that go) for each text that loses a line."""
    may = bloom(found, "h")
    lines = _lines(_own(docs, id_col, text_col, site_col), min_chars)
    hits = lines.where(might_contain(may, F.col("h"))).join(found, "h")
    stays = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("content") == F.col("first.content")) & (F.col("pos") == F.col("first.pos"))
    return hits.where(~stays).groupBy("doc", "content").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each text that loses lines: doc_id, removed (how many), kept, text (what is left)."""
    out = without_boilerplate(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{site_col}`").alias("source")), "doc_id", "text", "source", min_sites, min_chars, changed_only=True)
    return out.select("doc_id", "removed", "kept", "text")


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, changed_only: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of its texts, all columns kept.

    Lines are what line feeds separate, compared without blanks at their ends; shorter ones than ``min_chars`` stay. Of each
    boilerplate line one copy stays, in the row of the least (doc_id, hash of the text), at its first place there; exact
    repetitions of that row keep it too. A text of which no line is left goes with its row. Null and empty
    texts stay as they are. A null site doesn't count. Empty input: empty result. Columns that describe the text, such as a length, aren't computed again.
    changed_only: just the changed rows, with removed and kept, rows without text included.
    """
    found = materialize(boilerplate(docs, id_col, text_col, site_col, min_sites, min_chars).select("h", "first"), "boilerplate")
    drops = materialize(_dropped(docs, found, id_col, text_col, site_col, min_chars), "drops")
    whole = docs.select(F.struct("*").alias("row"))  # as one column, so that no name of the caller's can clash
    id_, text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")
    may = bloom(drops.select(F.xxhash64("doc", "content").alias("k")), "k")
    suspect = F.coalesce(might_contain(may, F.xxhash64(id_, F.xxhash64(text))), F.lit(False)) & text.isNotNull()
    met = whole.where(suspect).withColumn("own", F.xxhash64(text)).join(drops, id_.eqNullSafe(F.col("doc")) & (F.col("own") == F.col("content")), "inner" if changed_only else "left")
    # set difference and look-up, both linear in the lines; the text is split once
    left = bound(F.split(text, "\n"), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drop")), lambda i: F.get(ls, i)))
    rest = F.array_join(left, "\n")
    if changed_only:
        return met.select(id_.alias("doc_id"), F.size("drop").alias("removed"), F.size(left).alias("kept"), rest.alias("text"))
    met = met.withColumn("text", F.when(F.col("drop").isNull(), text).otherwise(rest))
    met = met.where(F.col("drop").isNull() | ~F.col("text").rlike(r"\A\s*\z"))
    return whole.where(~suspect).select("row.*").unionByName(met.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]))


def removed_sql(min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> str:
    """Exact distinct counts throughout. The order of places needs the content only among rows that share an id, which the tables don't have."""
    return f"""
with d as (select doc_id, source, string_split(text, chr(10)) as ls from documents where text is not null),
l as (select doc_id, source, unnest(ls) as line, unnest(range(0, len(ls))) as pos from d),
k as (select doc_id, source, trim(line, ' ') as line, pos from l where length(trim(line, ' ')) >= {min_chars}),
b as (select line, min({{'d': doc_id, 'p': pos}}) as first from k group by line having count(distinct source) >= {min_sites}),
g as (select k.doc_id, list(k.pos) as gone from k join b using (line) where not (k.doc_id = b.first.d and k.pos = b.first.p) group by k.doc_id)
select doc_id, len(gone)::int as removed, (len(ls) - len(gone))::int as kept,
  array_to_string(list_filter(list_transform(range(0, len(ls)), lambda i: case when list_contains(gone, i) then null else ls[i + 1] end), lambda x: x is not null), chr(10)) as text
from g join d using (doc_id)"""
