"""Not-modified revisits in web archives.

A revisit record says that a page had not changed; what it looked like stands in the latest earlier
full response for the same address.  Records are range-sorted by canonical address and time.  Within
a range the latest response so far is a running value; across ranges it is carried in a table of two
rows per range, as only a range's last address can go on in the next.  So an address with a third of
all records is spread over as many ranges as its records fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import partitions, stage

# Headers that a 304 answer updates in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning")
BASE = ("warc_date", "record_id", "etag", "modified")  # what tells full responses of one address apart, in their order
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|sessionid|sid)(=.*)?$"


def canonical(url: Column) -> Column:
    """The form of an address under which captures are the same: no scheme, user, default port,
    leading `www.`, fragment, tracking parameter or closing slash; lower-case host, sorted query."""
    rest = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"#(?s:.*)$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?((?s:.*))$", 1)
    kept = F.filter(F.array_sort(F.split(query, "&")), lambda p: (p != "") & ~p.rlike(TRACKING))
    joined = F.concat_ws("&", kept)
    return F.concat(host, path, F.lit("/"), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last one listed counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(low, lambda e, i: ~F.exists(F.slice(low, i + 2, F.greatest(F.size(low), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def opaque(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Every record with what it resolves to: record_id, canonical, verdict, refers_to, headers, payload.

    `records` has record_id, url, warc_date (any type that orders), warc_type, status,
    headers (map of texts) and payload.  Full responses are those of type `response` with status 200
    and a payload; revisits have type `revisit`.  The verdict is

    * `full` for full responses, `other` for all that is neither;
    * `resolved` where the latest full response before the revisit (by date; at one date the greatest
      record_id) agrees with it: the entity tags match weakly or, if either lacks one, the dates of
      last modification are equal, or the revisit has neither to compare;
    * `changed` where they disagree, `missing` where there is no earlier full response.

    A resolved revisit gets the response's payload, and the response's headers updated by its own
    permitted ones; other records keep their own.  refers_to is the response's record_id, also for
    `changed`.  Null addresses and null dates resolve nothing (`missing`) and are resolved to by
    nothing; null headers count as none.  Other columns are not looked at.

    Every row is returned once, also where rows or record_ids repeat: each revisit is judged by its
    own address, date and validators.  Of full responses with one address, date and record_id the one
    with the greatest entity tag, then date of last modification, counts, and of those that have
    these in common too the least payload, then the least headers.
    """
    n = partitions(records.sparkSession)
    heads = lower_names(F.col("headers"))
    rows = records.select("record_id", canonical(F.col("url")).alias("canonical"), "warc_date", "warc_type", "status",
                          heads.alias("headers"), "payload")
    rows = rows.withColumn("etag", opaque(F.element_at("headers", "etag"))).withColumn("modified", F.element_at("headers", "last-modified"))
    full = F.coalesce((F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull(), F.lit(False))
    revisit = F.coalesce(F.col("warc_type") == "revisit", F.lit(False))
    dated = F.col("canonical").isNotNull() & F.col("warc_date").isNotNull()
    key = ("canonical", "warc_date", "record_id", "etag", "modified")  # all that a verdict depends on
    narrow = rows.where(dated & (full | revisit)).select(*key, full.alias("is_full")).distinct()
    # at one date revisits come before responses
    order = ("warc_date", "is_full", "record_id", "etag", "modified")
    ranged = narrow.repartitionByRange(n, "canonical", *order).withColumn("range", F.spark_partition_id())
    ranged = stage(ranged)
    value = F.when(F.col("is_full"), F.struct(*BASE))
    ends = stage(ranged.groupBy("range").agg(
        F.min("canonical").alias("first"), F.max("canonical").alias("last"),
        F.max(F.when(F.col("is_full"), F.struct("canonical", *BASE))).alias("top"),
    ))
    # the response that a range's last address ends with, if it has one there
    of_last = F.when(F.col("top.canonical") == F.col("last"), F.struct(*[f"top.{c}" for c in BASE]))
    marks = ends.select(F.col("first").alias("at"), "range", F.lit(0).alias("closes"), F.lit(None).cast(_type(ranged)).alias("value")).union(
        ends.select(F.col("last").alias("at"), "range", F.lit(1).alias("closes"), of_last.cast(_type(ranged))))
    carried = marks.withColumn("carry", F.last("value", ignorenulls=True).over(
        Window.partitionBy("at").orderBy("range", "closes").rowsBetween(Window.unboundedPreceding, -1)))
    carried = stage(carried.where("closes = 0 and carry is not null").select(F.col("at").alias("canonical"), "range", "carry"))
    so_far = F.last(value, ignorenulls=True).over(
        Window.partitionBy("range", "canonical").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    found = (
        ranged.withColumn("own", so_far).where("not is_full")
        .join(carried, ["range", "canonical"], "left").withColumn("base", F.coalesce("own", "carry"))
    )
    tags, dates = F.col("etag") == F.col("base.etag"), F.col("modified") == F.col("base.modified")
    agree = F.coalesce(tags, dates, F.col("etag").isNull() & F.col("modified").isNull())
    verdict = F.when(F.col("base").isNull(), "missing").when(agree, "resolved").otherwise("changed")
    found = found.select(*[F.col(c).alias(f"own_{c}") for c in key], verdict.alias("verdict"), F.col("base").alias("base"))
    asked = rows.where(revisit).join(found, _same(key, "own_"), "left").withColumn("verdict", F.coalesce("verdict", F.lit("missing")))
    asked = asked.withColumn("refers_to", F.col("base.record_id"))
    entries = F.array_sort(F.map_entries("headers"))
    sources = rows.where(full & dated).groupBy(*[F.col(c).alias(f"base_{c}") for c in key]).agg(
        F.min(F.struct("payload", entries.alias("entries"))).alias("source"))
    sources = sources.withColumn("base_headers", F.map_from_entries("source.entries")).withColumn("base_payload", F.col("source.payload"))
    fresh = F.map_filter("headers", lambda k, v: k.isin(*permitted))
    kept = F.map_filter("base_headers", lambda k, v: ~F.map_contains_key(fresh, k))
    names = ("record_id", "canonical", "verdict", "refers_to", "headers", "payload")
    whole = _same(("canonical",), "base_") & _same(BASE, "base_", "base.")
    resolved = asked.where("verdict = 'resolved'").drop("payload").join(sources, whole).withColumn(
        "headers", F.map_concat(kept, fresh)).withColumnRenamed("base_payload", "payload")
    unasked = rows.where(~revisit).withColumn("verdict", F.when(full, "full").otherwise("other")).withColumn(
        "refers_to", F.lit(None).cast(rows.schema["record_id"].dataType))
    return resolved.select(*names).union(asked.where("verdict != 'resolved'").select(*names)).union(unasked.select(*names))


def _same(names: tuple[str, ...], prefix: str, of: str = "") -> Column:
    """Equal in all of some columns, where nulls equal each other."""
    same = F.lit(True)
    for c in names:
        same &= F.col(of + c).eqNullSafe(F.col(prefix + c))
    return same


def _type(ranged: DataFrame) -> str:
    of = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    return f"struct<{','.join(f'{c}:{of[c]}' for c in BASE)}>"


def page_captures(pages: DataFrame) -> DataFrame:
    """Archive records made from `pages`, one per row: the front page of the site's section, captured
    at the time page_id.  One capture in four is a full response that holds the page; the others are
    revisits.  The entity tag names the edition, 64 captures long, so later revisits find it changed.
    """
    section = F.regexp_extract("url", r"^([^:]*://[^/]*/[^/]*)", 1)
    edition = F.floor(F.col("page_id") / 64).cast("string")
    is_full = F.pmod(F.col("page_id"), F.lit(4)) == 0
    headers = F.create_map(
        F.lit("ETag"), F.concat(F.when(is_full, "").otherwise("W/"), F.lit('"'), edition, F.lit('"')),
        F.lit("Date"), F.col("page_id").cast("string"),
        F.lit("Content-Length"), F.when(is_full, F.length("html").cast("string")).otherwise("0"),
    )
    return pages.select(
        F.col("page_id").alias("record_id"), section.alias("url"), F.col("page_id").alias("warc_date"),
        F.when(is_full, "response").otherwise("revisit").alias("warc_type"), F.when(is_full, 200).otherwise(304).alias("status"),
        headers.alias("headers"), F.when(is_full, F.coalesce("html", F.lit(""))).alias("payload"),
    )
