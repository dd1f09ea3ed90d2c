"""Web archive records: what a not-modified revisit stands for.

A revisit of the profile "server not modified" has no body. It is resolved to the latest earlier full response of the same
canonical URL, if the validators agree: equal entity tags, compared weakly, or without one on the revisit equal modification dates.
Its headers are those of the response, with the ones that a 304 answer may update taken from the revisit.

The as-of join runs in slots of the record sequence, which hold a bounded number of records whatever their
URLs: inside a slot a window finds the response, and one row for each URL and slot carries the last response into later slots. A URL with
a third of all records is so spread over all slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.storage import require

SLOT_RECORDS, MOST_SLOTS = 50_000, 4096
#: Header fields that a 304 answer may update in a stored response.
UPDATED_BY_304 = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """url without scheme, fragment, tracking parameters and slashes at the end of its path; its host in lower case, without a leading www. or m.

    Parameters are taken one by one: those named utm_... or ref go, others stay in their order. A leading label is part of the host where only one more follows it.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^(www|m)[.]([^.]+[.].+)$", "$2")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)(=|$)"))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def slot_size(records: DataFrame) -> int:
    """Records of a slot: SLOT_RECORDS, or more where there would be over MOST_SLOTS slots, so that one URL's carried rows stay few too."""
    first, last = records.agg(F.min("seq"), F.max("seq")).first()
    return SLOT_RECORDS if first is None else max(SLOT_RECORDS, -(-(last - first + 1) // MOST_SLOTS))


def resolve_revisits(records: DataFrame, slot_records: int | None = None) -> DataFrame:
    """The revisits among records, with the response that each stands for.

    records: record_id and seq (long; records are ordered by seq, then record_id), url, kind ("response" or "revisit"; others are
    ignored), headers (map from lower-case names) and digest (of the body). seq must be dense enough that slot_records (by default slot_size()) consecutive values hold few records.
    Returns for each revisit record_id, url, canonical, refers_to, state ("resolved", "changed" where validators differ, "missing" without an earlier
    response), digest and headers (merged where resolved, else those of the revisit). Rows with null record_id, seq or url can't be
    ordered or looked up: a revisit of that kind is missing, a response is passed over. Repeated rows give repeated results; extra columns are ignored; an empty table gives none.
    """
    require(records, "record_id", "seq", "url", "kind", "headers", "digest")
    slot_records = slot_records or slot_size(records)
    rows = records.select("record_id", "seq", "url", "kind", "headers", "digest", canonical_url(F.col("url")).alias("canonical"), F.floor(F.col("seq") / slot_records).alias("slot"))
    rows = rows.where(F.col("kind").isin("response", "revisit"))
    placed = F.col("record_id").isNotNull() & F.col("seq").isNotNull() & F.col("url").isNotNull()
    answer = F.when((F.col("kind") == "response") & placed, F.struct("seq", "record_id", "headers", "digest"))
    known = rows.where(placed)

    last = known.groupBy("canonical", "slot").agg(F.max_by(answer, F.when(answer.isNotNull(), F.struct("seq", "record_id"))).alias("last"))
    earlier = Window.partitionBy("canonical").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canonical", "slot", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    before = Window.partitionBy("canonical", "slot").orderBy("seq", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = known.withColumn("here", F.last(answer, ignorenulls=True).over(before)).where("kind = 'revisit'")
    met = found.join(carried, ["canonical", "slot"]).withColumn("full", F.coalesce("here", "carried")).drop("here", "carried")
    lost = rows.where(~placed & (F.col("kind") == "revisit")).withColumn("full", F.lit(None).cast(met.schema["full"].dataType))
    both = met.unionByName(lost.select(*met.columns))

    tag, dated = F.col("headers")["etag"], F.col("headers")["last-modified"]
    agrees = F.when(tag.isNotNull(), _strong(tag) == _strong(F.col("full.headers")["etag"])).otherwise(dated == F.col("full.headers")["last-modified"])
    state = F.when(F.col("full").isNull(), "missing").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("changed")
    permitted = F.map_filter("headers", lambda k, _: k.isin(*UPDATED_BY_304))
    kept = F.map_filter(F.col("full.headers"), lambda k, _: ~F.array_contains(F.map_keys(permitted), k))
    return both.withColumn("state", state).select(
        "record_id",
        "url",
        "canonical",
        F.when(F.col("state") == "resolved", F.col("full.record_id")).alias("refers_to"),
        "state",
        F.when(F.col("state") == "resolved", F.col("full.digest")).alias("digest"),
        F.when(F.col("state") == "resolved", F.map_concat(kept, permitted)).otherwise(F.col("headers")).alias("headers"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log made from pages (page_id, url, html): each page's response, and a later or earlier revisit of its URL.

    By a checksum of the URL, one revisit in five bears an outdated tag and one in five a modification date only.
    """
    check = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 6), 16, 10).cast("long")
    tag = F.substring(F.sha2("html", 256), 1, 16)
    dated = F.concat(F.lit("day "), (F.length("html") % 365).cast("string"))
    shift = (check % 7) * 100 - 150
    full = F.create_map(F.lit("etag"), tag, F.lit("last-modified"), dated, F.lit("date"), F.concat(F.lit("at "), F.col("page_id").cast("string")), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("server"), F.lit("a"))
    short = F.create_map(F.lit("date"), F.concat(F.lit("at "), (F.col("page_id") + shift).cast("string")), F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("server"), F.lit("b"), F.lit("last-modified"), dated)
    tagged = F.when(check % 5 == 0, F.map_concat(short, F.create_map(F.lit("etag"), F.lit("outdated")))).when(check % 5 == 1, short).otherwise(F.map_concat(short, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))))
    of = lambda kind, k, at, headers: F.struct((F.col("page_id") * 2 + k).alias("record_id"), at.alias("seq"), F.lit(kind).alias("kind"), headers.alias("headers"))
    both = F.array(of("response", 0, F.col("page_id"), full), of("revisit", 1, F.col("page_id") + shift, tagged))
    return pages.select("url", F.sha2("html", 256).alias("digest"), F.explode(both).alias("r")).select("r.*", "url", F.when(F.col("r.kind") == "response", F.col("digest")).alias("digest"))


ORACLE = """
WITH p AS (
  SELECT page_id, url, html, num AS c, substr(sha256(html), 1, 16) AS tag, 'day ' || (length(html) % 365) AS dated, (num % 7) * 100 - 150 AS shift,
    regexp_replace(split_part(url, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM (SELECT *, CAST('0x' || substr(md5(url), 1, 6) AS BIGINT) AS num FROM pages)),
r AS (
  SELECT page_id * 2 AS record_id, page_id AS seq, 'response' AS kind, url, u, tag AS etag, dated, 'at ' || page_id AS date, CAST(octet_length(encode(html)) AS VARCHAR) AS length, sha256(html) AS digest FROM p
  UNION ALL
  SELECT page_id * 2 + 1, page_id + shift, 'revisit', url, u, CASE WHEN c % 5 = 0 THEN 'outdated' WHEN c % 5 = 1 THEN NULL ELSE tag END, dated, 'at ' || (page_id + shift), '0', NULL FROM p),
q AS (SELECT *, lower(split_part(split_part(u, '?', 1), '/', 1)) AS host, rtrim(substr(split_part(u, '?', 1), length(split_part(split_part(u, '?', 1), '/', 1)) + 1), '/') AS path,
  list_filter(string_split(CASE WHEN contains(u, '?') THEN substr(u, strpos(u, '?') + 1) ELSE '' END, '&'), x -> x <> '' AND NOT regexp_full_match(split_part(x, '=', 1), 'utm_[a-z]+|ref')) AS parameters FROM r),
k AS (SELECT *, CASE WHEN split_part(host, '.', 1) IN ('www', 'm') AND split_part(host, '.', 3) <> '' THEN substr(host, strpos(host, '.') + 1) ELSE host END || path
  || CASE WHEN len(parameters) > 0 THEN '?' || array_to_string(parameters, '&') ELSE '' END AS canonical FROM q),
w AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'record_id': record_id, 'etag': etag, 'dated': dated, 'digest': digest, 'length': length} END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY seq, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM k)
SELECT record_id, url, canonical, CASE WHEN ok THEN f.record_id END AS refers_to, CASE WHEN f IS NULL THEN 'missing' WHEN ok THEN 'resolved' ELSE 'changed' END AS state,
  CASE WHEN ok THEN f.digest END AS digest, date AS header_date, CASE WHEN ok THEN f.length ELSE length END AS header_length, CASE WHEN ok THEN 'a' ELSE 'b' END AS header_server
FROM (SELECT *, f IS NOT NULL AND CASE WHEN etag IS NULL THEN dated = f.dated ELSE etag = f.etag END AS ok FROM w WHERE kind = 'revisit')
"""
