"""Extensions without a counterpart in the reference: relational queries over the star schema, streams, and kernels end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from polyloom.operators import kernels, translate
from polyloom.plans.shared import shared_dir
from polyloom.registry.base import table, values_df
from polyloom.registry.layout import _fragments
from polyloom.registry.text import _CLASS, _LEX, _SENT, _TRIM, _counts_sql, _robust_sql
from polyloom.streaming import routing as streams

AVAILABLE = ["de", "en", "es", "fr"]


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def star_join_revenue(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    met = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return met.groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(_revenue()), 2).alias("revenue"))


def customers_without_orders(spark, sf_dir):
    """Those without an urgent one: every customer has some order here."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def lineitem_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def top_orders_by_customer(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rank"))
    return o.where("rank <= 3")


def event_sessions(spark, sf_dir):
    """Events of a user less than half an hour apart are one session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w))
    e = e.withColumn("session", F.sum(F.when(F.col("gap") < 1_800_000_000, 0).otherwise(1)).over(w))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def stream_classes(spark, sf_dir):
    """All documents through a stream, and what it wrote."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/documents.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = source.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    query = streams.start(streams.classified(stream.select("doc_id", "text"), AVAILABLE), f"{base}/out", f"{base}/state")
    query.awaitTermination()
    return spark.read.schema("doc_id long, text string, class string, language string").option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*").groupBy("class", "language").agg(F.count(F.lit(1)).alias("n"))


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def lexicon_kernel(key: str):
    """The lexicon as a batch function, as a model would be."""
    words = kernels.LEXICON.get(key.split("-")[0], {})
    return lambda texts: [" ".join(words.get(w, w) for w in t.split(" ")) for t in texts]


_ROUTES = [(a, b, ",".join([f"{a}-en"] * (a != "en") + [f"en-{b}"] * (b != "en"))) for a in AVAILABLE for b in ("en", "fr") if a != b]


def translate_texts_kernel(spark, sf_dir):
    """Turns of the conversations by a batch kernel, through English where need be; a language without a route gives an error."""
    k = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(k.alias("id"), "text", F.element_at(F.array(*[F.lit(x) for x in ("de", "es", "fr", "xx")]), (k % 4 + 1).cast("int")).alias("from_code"), F.when(k % 3 == 0, "fr").otherwise("en").alias("to_code"))
    return translate.translate_texts(rows, values_df(spark, "from_code string, to_code string, steps string", _ROUTES), lexicon_kernel)


def translate_pages_kernel(spark, sf_dir):
    return translate.translate_pages(_fragments(spark, sf_dir), "en", AVAILABLE, lexicon_kernel)


QUERIES = {f.__name__: f for f in (star_join_revenue, customers_without_orders, lineitem_rollup, top_orders_by_customer, event_sessions, stream_classes, translate_texts_kernel, translate_pages_kernel)}

ORACLES = {
    "star_join_revenue": "select r_name, o_orderpriority, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
    "customers_without_orders": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "lineitem_rollup": "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)",
    "top_orders_by_customer": "select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders qualify rank <= 3",
    "event_sessions": "with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events), s as (select *, sum(case when gap < 1800000000 then 0 else 1 end) over (partition by user_id order by ts, event_id)::bigint as session from g) select user_id, session, count(*) as n, min(event_id) as first_event from s group by 1, 2",
    "translate_texts_kernel": f"with b as (select conv_id * 1000 + turn as id, {_TRIM('text')} as text, case (conv_id * 1000 + turn) % 4 when 0 then 'de' when 1 then 'es' when 2 then 'fr' else 'xx' end as f, case when (conv_id * 1000 + turn) % 3 = 0 then 'fr' else 'en' end as t from conversations), p as (select *, f = t or text = '' or regexp_full_match(text, '[+-]?[0-9.]+') as plain from b) select id, case when plain then text when f <> 'xx' then array_to_string(list_transform(string_split(text, chr(10)), lambda l: case when {_TRIM('l')} = '' then l else array_to_string(list_transform({_SENT('l')}, lambda s: {_LEX('s', 'f')}), ' ') end), chr(10)) end as translated, case when not plain and f = 'xx' then 'missing route ' || f || '-' || t end as error from p",
    "stream_classes": f"with c as (select *, {_CLASS('text')} as class, {_robust_sql(AVAILABLE)} as lang from ({_counts_sql('documents', 'doc_id')})) select class, case when class = 'translatable' then lang end as language, count(*) as n from c group by 1, 2",
}
