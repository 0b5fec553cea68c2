"""Packing by powers of two: each document is cut into pieces of binary length; equal lengths share a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm.groups import row_ids

#: A token is a word with the white space before it; white space at the end of a text is a token of its own.
#: So the pieces of a document, joined in order, are the document.
TOKEN = r"[ \t\n\f\r]*[^ \t\n\f\r]+|[ \t\n\f\r]+\z"
MAX_LENGTH = 2048
#: Tokens of a batch, on average. Batches of one bucket differ in size as throws of dice do.
BATCH_TOKENS = 1 << 16


def _cuts(max_length: int) -> int:
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    return max_length.bit_length() - 1


def buckets(docs: DataFrame, max_length: int = MAX_LENGTH, text_col: str = "text") -> DataFrame:
    """length, bucket_pieces: how many pieces of each length the documents give, from their token counts alone. At most log2(max_length) + 1 rows."""
    bits = _cuts(max_length)
    n = F.regexp_count(F.col(f"`{text_col}`"), F.lit(TOKEN)).cast("long")
    counts = docs.select(n.alias("n")).agg(F.sum(F.floor(F.col("n") / max_length)).alias(f"k{bits}"), *[F.sum(F.shiftright("n", k).bitwiseAND(F.lit(1))).alias(f"k{k}") for k in range(bits)])
    rows = F.array(*[F.struct(F.lit(1 << k).alias("length"), F.coalesce(F.col(f"k{k}"), F.lit(0)).cast("long").alias("bucket_pieces")) for k in range(bits + 1)])
    return counts.select(F.inline(rows)).where("bucket_pieces > 0")


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """``pieces``, each with its bucket and batch: doc_id, piece, start, length, text, bucket_pieces, batch.

    Pieces of one length are a bucket of bucket_pieces; (length, batch) names a batch of it, about ``batch_tokens`` tokens without padding. A
    piece's batch comes from a hash of its document's id and its number, so documents spread over the batches, equally in
    every run, and nothing is sorted or counted piece by piece. Pieces of rows that share an id (or have none) fall alike. See ``pieces`` for
    nulls, repeated rows and empty texts. The counts, a row for each length, are all that is broadcast.
    """
    sizes = F.broadcast(buckets(docs, max_length, text_col))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    many = F.greatest(F.lit(1), F.ceil(F.col("bucket_pieces") * F.col("length") / batch_tokens))
    return pieces(docs, max_length, id_col, text_col).join(sizes, "length").select("doc_id", "piece", "start", "length", "text", "bucket_pieces", F.floor(draw * many).cast("int").alias("batch"))


def write_batches(packed: DataFrame, path: str) -> None:
    """Parquet by length, the pieces of a batch together in one file: what a trainer reads bucket by bucket."""
    packed.repartition("length", "batch").sortWithinPartitions("length", "batch").write.partitionBy("length").parquet(path)


def pieces(docs: DataFrame, max_length: int = MAX_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), start and length in tokens, text.

    n tokens become n // max_length pieces of max_length, then one piece for each binary digit of the rest,
    longest first, so no piece has text of two documents.
    A null or empty text has no pieces; blank text is one token. Repeated rows give their pieces again,
    and a null doc_id is kept. Other columns are ignored. No shuffle, no Python.
    """
    bits = _cuts(max_length)
    n = F.size("tokens")
    full = F.when(n >= max_length, F.transform(F.sequence(F.lit(0), F.floor(n / max_length).cast("int") - 1), lambda i: F.struct((i * max_length).alias("start"), F.lit(max_length).alias("length")))).otherwise(F.expr("cast(array() as array<struct<start:int,length:int>>)"))
    rest = F.transform(F.array(*[F.lit(k) for k in reversed(range(bits))]), lambda k: F.struct((n - F.call_function("mod", n, F.call_function("shiftleft", F.lit(2), k))).alias("start"), n.bitwiseAND(F.call_function("shiftleft", F.lit(1), k)).alias("length")))
    rest = F.filter(rest, lambda x: x["length"] > 0)
    cut = row_ids(docs, id_col, text_col).where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    cuts = F.transform(F.concat(full, rest), lambda p, i: F.struct(i.alias("piece"), p["start"].alias("start"), p["length"].alias("length"), F.array_join(F.slice("tokens", p["start"] + 1, p["length"]), "").alias("text")))
    return cut.select("doc_id", F.inline(cuts))


def pack_sql(table: str = "documents", max_length: int = MAX_LENGTH, batch_tokens: int = BATCH_TOKENS) -> str:
    bits = max_length.bit_length() - 1
    token = TOKEN.replace(r"\t", "\t").replace(r"\n", "\n").replace(r"\f", "\f").replace(r"\r", "\r")
    return f"""
with t as (select doc_id, regexp_extract_all(text, '{token}') as tok from {table} where text is not null),
n as (select doc_id, tok, len(tok) as n from t),
p as (select doc_id, tok, list_concat(
  list_transform(range(0, n // {max_length}), lambda i: {{'s': i * {max_length}, 'l': {max_length}::bigint}}),
  list_filter(list_transform(range({bits - 1}, -1, -1), lambda k: {{'s': n - n % (2::bigint << k), 'l': n & (1::bigint << k)}}), lambda x: x.l > 0)) as ps from n),
u as (select doc_id, tok, unnest(range(0, len(ps))) as i, unnest(ps) as p from p),
x as (select doc_id, i::int as piece, p.s::int as start, p.l::int as length, array_to_string(tok[p.s + 1 : p.s + p.l], '') as text, count(*) over (partition by p.l) as bucket_pieces from u)
select *, floor(('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || piece), 1, 13))::bigint / pow(2.0, 52) * greatest(1, ceil(bucket_pieces * length / {batch_tokens})))::int as batch from x"""
