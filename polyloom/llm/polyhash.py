"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes, in words of three bytes, are the coefficients of a polynomial, evaluated at
four points modulo four primes below 2**31. For a text A followed by B,
``h(A B) = h(A) * r**words(B) + h(B)``: chunks are hashed independently and combined in any
grouping, so one huge document costs no more memory than one chunk. Equal fingerprints of
equal length are confirmed chunk by chunk.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.llm.groups import raw_hash, row_ids, suspects, totals_of
from polyloom.plans.shared import materialize
from polyloom.plans.skew import join_totals

PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
POINTS = np.array([1103515245, 1566083941, 742938285, 1812433253], np.uint64)
#: Bytes of a chunk, a multiple of three: a chunk boundary is a word boundary.
CHUNK = 3 * 16384
BLOCK = 256


def powers(point: int, prime: int, n: int) -> np.ndarray:
    """1, r, r**2 ... r**(n-1) mod prime, by doubling."""
    out = np.ones(1, np.uint64)
    top = np.uint64(point % prime)
    p = np.uint64(prime)
    while len(out) < n:
        out = np.concatenate([out, out * top % p])
        top = top * top % p
    return out[:n]


_TABLES = [(powers(int(r), int(p), BLOCK)[::-1].copy(), pow(int(r), BLOCK, int(p))) for r, p in zip(POINTS, PRIMES)]


def chunk_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, r**words) of each byte string ``data[offsets[i]:offsets[i+1]]``: two arrays of shape (n, 4)."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    words = (sizes + 2) // 3
    blocks = np.maximum(1, (words + BLOCK - 1) // BLOCK)
    ends = np.cumsum(blocks) * BLOCK * 3
    # zeros before a text don't change its value: whole blocks, right-aligned, the last word filled with zeros
    padded = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    starts = ends - words * 3
    if len(data):
        padded[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]
    w = padded.reshape(-1, 3).astype(np.uint64)
    w = ((w[:, 0] << np.uint64(16)) | (w[:, 1] << np.uint64(8)) | w[:, 2]).reshape(-1, BLOCK)
    first, most = np.cumsum(blocks) - blocks, int(blocks.max()) if n else 0
    at = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(w))  # blocks that follow in the same text
    out, shift = np.zeros((n, 4), np.uint64), np.zeros((n, 4), np.uint64)
    for k, (table, step) in enumerate(_TABLES):
        p = PRIMES[k]
        h = (w * table).sum(1) % p
        h = h * powers(step, int(p), most)[at] % p if n else h
        out[:, k] = np.add.reduceat(h, first) % p if n else 0
        for length in np.unique(words):
            shift[words == length, k] = pow(int(POINTS[k]), int(length), int(p))
    return out, shift


def combine(a: tuple, b: tuple) -> tuple:
    """Of (hash, shift) pairs of two neighbours, that of the whole; associative."""
    (ha, sa), (hb, sb) = a, b
    return (ha * sb + hb) % PRIMES, sa * sb % PRIMES


def fingerprint_bytes(data: bytes, chunk: int = CHUNK) -> tuple[int, ...]:
    """Four residues, from chunks of any multiple of three bytes."""
    cuts = np.array([*range(0, len(data), chunk), len(data)], np.int64)
    cuts = cuts if len(cuts) > 1 else np.array([0, 0])
    hashes, shifts = chunk_hashes(np.frombuffer(data, np.uint8), cuts)
    whole = (np.zeros(4, np.uint64), np.ones(4, np.uint64))
    for pair in zip(hashes, shifts):
        whole = combine(whole, pair)
    return tuple(int(x) for x in whole[0])


def chunks(text: Column) -> Column:
    """Array of the text's bytes in chunks; one empty chunk for an empty text."""
    data = F.encode(text, "UTF-8")
    last = F.floor(F.greatest(F.octet_length(text) - 1, F.lit(0)) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * CHUNK + 1, F.lit(CHUNK)))


def _hash_chunks():
    @F.arrow_udf("array<struct<h0:bigint,h1:bigint,h2:bigint,h3:bigint,s0:bigint,s1:bigint,s2:bigint,s3:bigint>>")
    def hash_chunks(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8) if len(flat) else np.zeros(0, np.uint8)
        parts = []
        at = 0
        while at < len(flat):  # at most some megabytes at once
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 2_000_000, "right")) - 1)
            parts.append(np.hstack(chunk_hashes(data, offsets[at : to + 1])))
            at = to
        both = np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, 8), np.int64)
        items = pa.StructArray.from_arrays([pa.array(both[:, i]) for i in range(8)], ["h0", "h1", "h2", "h3", "s0", "s1", "s2", "s3"])
        counts = [0, *np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items, mask=column.is_null() if column.null_count else None)

    return hash_chunks


def _combined(parts: Column) -> Column:
    """The whole text's two longs, from its chunks' pairs, by length-shifted arithmetic."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"h{k}") for k in range(4)])
    whole = F.aggregate(parts, zero, lambda a, c: F.struct(*[((a[f"h{k}"] * c[f"s{k}"] + c[f"h{k}"]) % F.lit(int(PRIMES[k]))).alias(f"h{k}") for k in range(4)]))
    return F.struct((F.shiftleft(whole["h0"], 31) + whole["h1"]).alias("a"), (F.shiftleft(whole["h2"], 31) + whole["h3"]).alias("b"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that have copies: doc_id, group_id (the least doc_id of the group), group_size, is_first.

    Copies have the same bytes. Only rows whose fingerprint and length occur again are read a second time; their chunks stream
    through an aggregation by fingerprint, length and position, which compares them with each other and leaves one of equal
    ones before anything is shuffled. A bucket with one chunk at each position is a group. In a bucket with more, an accident that
    fingerprints of 124 bits make unheard of, rows are compared position by position with one row, those that differ
    anywhere among themselves in another round. No comparison holds more than a chunk of each row.
    Null text: no copy of anything. Empty texts are copies of each other. A null doc_id is kept and is
    never the group's least unless all are null. Rows repeated with the same id are copies of each other,
    is_first is true for each row that has the least id. Other columns are ignored. Empty input: empty result.
    """
    base = row_ids(docs, id_col, text_col).where(F.col("text").isNotNull())
    key = ["f", "n"]
    n, parts = F.octet_length("text").alias("n"), _hash_chunks()(chunks(F.col("text"))).alias("parts")
    hashed = base.select("doc_id", raw_hash().alias("raw"), n, parts).select("doc_id", "raw", "n", _combined(F.col("parts")).alias("f"))
    hashed = materialize(hashed, "polyhash")
    totals = materialize(totals_of(hashed, key), "totals")
    again = suspects(base, hashed, totals, key).select("doc_id", n, parts, chunks(F.col("text")).alias("c"))
    again = again.select("doc_id", "n", _combined(F.col("parts")).alias("f"), "c")
    places = again.select(*key, F.posexplode("c").alias("pos", "chunk")).distinct().groupBy(*key, "pos").agg(F.count(F.lit(1)).alias("chunks"))
    different = materialize(places.where("chunks > 1").select(*key).distinct(), "different")
    met = join_totals(hashed.select("doc_id", *key), totals, key, "group_size", hashed.count()).where("group_size is not null")
    found = [met.select("doc_id", *key, "group_id", "group_size")]
    if not different.isEmpty():
        found[0] = found[0].join(different, key, "left_anti")
        # written, so that the rows' numbers stay what they are whatever is computed again
        todo = materialize(again.join(different, key, "left_semi").withColumn("row", F.monotonically_increasing_id()), "collided").select("doc_id", "row", *key, F.posexplode("c").alias("pos", "chunk"))
        while not todo.isEmpty():
            verdict = materialize(_compared(todo), "compared")
            own = totals_of(verdict.where("same"), key)
            found.append(verdict.where("same").select("doc_id", *key).join(own, key).select("doc_id", *key, "group_id", "group_size"))
            todo = todo.join(verdict.where("not same").select("row"), "row", "left_semi")
    return functools.reduce(DataFrame.unionByName, found).select("doc_id", "group_id", "group_size", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("is_first"))


def _compared(todo: DataFrame) -> DataFrame:
    """doc_id, row, n, f, same: whether each of the row's chunks equals that of the first row of its bucket. Rows alone in a bucket go."""
    firsts = todo.groupBy("f", "n", "pos").agg(F.min_by("chunk", "row").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = todo.join(firsts, ["f", "n", "pos"])
    return met.groupBy("f", "n", "row").agg(F.any_value("doc_id").alias("doc_id"), F.bool_and(F.col("chunk") == F.col("first")).alias("same"))
