"""The queries of this subpackage, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyloom.llm.fingerprint import fingerprints
from polyloom.llm.lines import removed_lines, removed_sql
from polyloom.llm.mixing import mixture, mixture_sql
from polyloom.llm.packing import pack, pack_sql
from polyloom.llm.pii import personal_data
from polyloom.llm.polyhash import exact_duplicates
from polyloom.llm.revisits import crawl_records, resolve_revisits, revisits_sql
from polyloom.llm.secrets import secret_findings
from polyloom.llm.simhash import near_groups
from polyloom.llm.toxicity import toxic_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"))


def llm_fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_fingerprints(spark, sf_dir).select("doc_id", "group_id", "group_size")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(_table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(crawl_records(_table(spark, sf_dir, "pages")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents")).drop("content")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mixing": op2_mixing,
    "op3_secrets": op3_secrets,
    "op4_personal_data": op4_personal_data,
    "op5_toxicity": op5_toxicity,
    "op6_exact_duplicates": op6_exact_duplicates,
    "op7_revisits": op7_revisits,
    "op8_packing": op8_packing,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_line_dedup": op10_line_dedup,
    "llm_fingerprint_groups": llm_fingerprint_groups,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixture_sql(),
    "op10_line_dedup": removed_sql(),
    "llm_fingerprint_groups": """
with c as (select doc_id, replace(lower(nfc_normalize(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 'ß', 'ss') as canon from documents)
select doc_id, min(doc_id) over (partition by canon) as group_id, count(*) over (partition by canon) as group_size from c""",
    "op6_exact_duplicates": """
with g as (select doc_id, min(doc_id) over (partition by text) as group_id, count(*) over (partition by text) as group_size from documents where text is not null)
select doc_id, group_id, group_size, doc_id = group_id as is_first from g where group_size > 1""",
    "op7_revisits": revisits_sql(),
    "op8_packing": pack_sql(),
}
