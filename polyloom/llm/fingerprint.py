"""Document fingerprints: a wide digest of the canonical text, and groups of documents that share it."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm.groups import equal_groups


def canonical(text: str) -> str:
    """NFKC, case folding, NFKC again (folding can undo it), runs of Unicode white space to one space, ends trimmed."""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def digest_of(text: str) -> bytes:
    return xxhash.xxh3_128_digest(canonical(text).encode("utf-8", "surrogatepass"))


def _digests():
    @F.arrow_udf("binary")
    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else digest_of(t) for t in texts.to_pylist()], pa.binary())

    return digests


def _contents():
    @F.arrow_udf("binary")
    def contents(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else canonical(t).encode("utf-8", "surrogatepass") for t in texts.to_pylist()], pa.binary())

    return contents


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (32 hex digits), group_id, group_size.

    group_id is the least doc_id among the rows whose canonical bytes are equal; equal digests
    alone don't suffice, the bytes are compared inside each bucket of two or more.
    Null text: null fingerprint, a group of its own. Empty and blank texts are equal to each other.
    Null doc_id: the row keeps its null id; a group of only such rows has a null group_id.
    Repeated rows are members like any other. Other columns, whatever their names, are ignored.
    Empty input: empty result.
    """
    found = equal_groups(docs, lambda t: _digests()(t), lambda t: _contents()(t), id_col, text_col)
    return found.select("doc_id", F.lower(F.hex("digest")).alias("fingerprint"), "group_id", "group_size")
