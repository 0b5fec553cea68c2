"""Not-modified revisits of a web archive, resolved to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that don't select content.
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=.*)?$"
#: A 304 describes these of its own message, not of the stored response; hop-by-hop headers never carry over.
OWN_HEADERS = ("content-length", "content-encoding", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, default port, ``www.``, fragment, trailing slash and tracking parameters; parameters sorted."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(plain, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), "(:80|:443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _tag(headers: Column) -> Column:
    """The entity tag, compared weakly."""
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url_key, response_id, status, headers, payload_digest, payload_bytes.

    ``records``: record_id, url, ts, kind ('response' or 'revisit'), headers (map, lower-case names),
    payload_digest, payload_bytes and, if known, http_status (a number); others are ignored. With http_status, only
    responses of 200 answer a revisit: parts (206), redirects, errors and null don't. Without it, the caller has to leave them out.

    status: ``resolved``; ``mismatch`` if the latest earlier response has another entity tag, or, where
    either side has no tag, another last-modified; ``unverified`` if no validator is on both sides;
    ``no_response`` if none is earlier; ``unplaced`` for a null url or ts. Earlier means strictly; of
    responses at one time the greatest record_id counts. Headers are the response's, with the revisit's
    permitted ones in their place, as sorted ``name: value`` lines, for resolved and unverified rows only.
    Repeated rows resolve alike. Null headers count as none. Payloads don't travel: only their digest does.
    """
    none = F.expr("cast(map() as map<string,string>)")
    full = F.col("http_status") == 200 if "http_status" in records.columns else F.lit(True)
    base = records.select("record_id", "url", "ts", "kind", F.coalesce("headers", none).alias("headers"), "payload_digest", "payload_bytes", full.alias("full")).withColumn("url_key", canonical_url(F.col("url")))
    whole = F.col("url").isNotNull() & F.col("ts").isNotNull()
    answer = F.when((F.col("kind") == "response") & F.col("full"), F.struct("record_id", "headers", "payload_digest", "payload_bytes"))
    # at one time revisits come first: a response is earlier only if strictly so
    order = Window.partitionBy("url_key").orderBy("ts", F.col("kind") == "response", F.col("record_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.where(whole).withColumn("r", F.last(answer, ignorenulls=True).over(order)).where("kind = 'revisit'")
    mine, theirs = F.col("headers"), F.col("r.headers")
    tags, dates = _tag(mine) == _tag(theirs), mine["last-modified"] == theirs["last-modified"]
    status = F.when(F.col("r").isNull(), "no_response").when(F.coalesce(tags, dates).isNull(), "unverified").when(F.coalesce(tags, dates), "resolved").otherwise("mismatch")
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(F.map_filter(mine, lambda m, _: ~m.isin(*OWN_HEADERS))), k)), F.map_filter(mine, lambda k, _: ~k.isin(*OWN_HEADERS)))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    good = F.col("status").isin("resolved", "unverified")
    out = placed.withColumn("status", status).select("record_id", "url_key", "ts", F.col("r.record_id").alias("response_id"), "status", F.when(good, lines).alias("headers"), F.when(good, F.col("r.payload_digest")).alias("payload_digest"), F.when(good, F.col("r.payload_bytes")).alias("payload_bytes"))
    lost = base.where(~whole & (F.col("kind") == "revisit")).select("record_id", "url_key", "ts", *[F.lit(None).cast(out.schema[c].dataType).alias(c) if c != "status" else F.lit("unplaced").alias("status") for c in out.columns[3:]])
    return out.unionByName(lost)


def crawl_records(pages: DataFrame) -> DataFrame:
    """An archive's records, derived from the pages alone: each page is a response; two thirds are visited again.

    Some second visits carry another tag, some a date only, some come before the first, and their
    URLs are spelled in other ways. ``pages``: page_id, url, html. A null url or html gives records with a null url or digest;
    repeated pages give their records again. Empty pages: no records.
    """
    p = pages.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").alias("size"))
    ts = F.lit(1700000000) + F.col("page_id") * 7919 % 1000000
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    name = lambda *kv: F.create_map(*[F.lit(x) if i % 2 == 0 else x for i, x in enumerate(kv)])
    first = p.select((F.col("page_id") * 2).alias("record_id"), "url", ts.alias("ts"), F.lit("response").alias("kind"), name("content-type", F.lit("text/html"), "content-length", F.col("size").cast("string"), "etag", tag, "last-modified", date, "cache-control", F.lit("max-age=60")).alias("headers"), F.col("digest").alias("payload_digest"), F.col("size").alias("payload_bytes"))
    id_ = F.col("page_id")
    again_url = F.when(id_ % 4 == 0, F.concat(F.regexp_replace("url", "[#].*$", ""), F.lit("#again"))).when(id_ % 4 == 1, F.regexp_replace("url", "^http://", "https://www.")).otherwise(F.col("url"))
    again_ts = F.when(id_ % 11 == 0, ts - 5000000).otherwise(ts + 86400 * (1 + id_ % 5))
    again_tag = F.when(id_ % 7 == 0, F.lit('"changed"')).when(id_ % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    second = p.where(id_ % 3 != 0).select((id_ * 2 + 1).alias("record_id"), again_url.alias("url"), again_ts.alias("ts"), F.lit("revisit").alias("kind"), F.map_filter(name("content-length", F.lit("0"), "etag", again_tag, "last-modified", date, "cache-control", F.lit("max-age=90"), "age", (id_ % 50).cast("string")), lambda _, v: v.isNotNull()).alias("headers"), F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("int").alias("payload_bytes"))
    return first.withColumn("http_status", F.lit(200)).unionByName(second.withColumn("http_status", F.lit(304)))


def revisits_sql() -> str:
    canon = """regexp_extract(rest, '^[^/?]*')"""
    host = f"regexp_replace(regexp_replace(regexp_replace(lower({canon}), '^[^@]*@', ''), '(:80|:443)$', ''), '^www\\.', '')"
    own = ", ".join(f"'{h}'" for h in OWN_HEADERS)
    return f"""
with p as (select page_id, url, md5(html) as digest, strlen(html) as size, 1700000000 + page_id * 7919 % 1000000 as t0, '"' || substr(md5(html), 1, 16) || '"' as tag, 'day ' || (page_id % 365) as lm from pages),
rec as (
  select page_id * 2 as record_id, url, t0 as ts, 'response' as kind, tag as etag, lm, digest, size, 0 as age from p
  union all
  select page_id * 2 + 1, case when page_id % 4 = 0 then regexp_replace(url, '[#].*$', '') || '#again' when page_id % 4 = 1 then regexp_replace(url, '^http://', 'https://www.') else url end,
    case when page_id % 11 = 0 then t0 - 5000000 else t0 + 86400 * (1 + page_id % 5) end, 'revisit',
    case when page_id % 7 = 0 then '"changed"' when page_id % 5 = 0 then null else 'W/' || tag end, lm, null, null, page_id % 50 from p where page_id % 3 <> 0),
c as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') as rest from rec),
q as (select *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{TRACKING}'))) as kept from c),
k as (select *, {host} || regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)?', 1), '/+$', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url_key from q),
j as (select *, last_value(case when kind = 'response' then {{'id': record_id, 'etag': etag, 'lm': lm, 'digest': digest, 'size': size}} end ignore nulls) over (partition by url_key order by ts, (kind = 'response')::int, record_id rows between unbounded preceding and current row) as r from k),
s as (select *, coalesce(regexp_replace(etag, '^W/', '') = r.etag, lm = r.lm) as same from j where kind = 'revisit'),
o as (select *, case when r is null then 'no_response' when same is null then 'unverified' when same then 'resolved' else 'mismatch' end as status from s)
select record_id, url_key, ts, r.id as response_id, status,
  case when status in ('resolved', 'unverified') then 'age: ' || age || chr(10) || 'cache-control: max-age=90' || chr(10) || 'content-length: ' || r.size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || coalesce(etag, r.etag) || chr(10) || 'last-modified: ' || lm end as headers,
  case when status in ('resolved', 'unverified') then r.digest end as payload_digest, case when status in ('resolved', 'unverified') then r.size end::int as payload_bytes
from o"""
