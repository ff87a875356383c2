"""Not-modified revisits in WARC captures, resolved to the responses they stand for.

A crawler that is told a page has not changed stores a ``revisit`` record with
the validators and headers of the short answer, but no body. It stands for the
latest earlier full response of the same canonical URL. Here records are parsed
from their text, revisits find that response by an as-of join, validators are
compared, and the headers a short answer may update are merged into the stored
ones.

As-of join. Records are range partitioned by (URL, time), so a URL with any share
of the records spreads over many slices. A window looks back inside a slice; what
comes from before it is the latest response of the slices before, one row per URL
and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import column, free_name
from matchloom.session import cut_lineage

#: Header fields of a short answer that say nothing about the stored body or belong to one connection.
NOT_MERGED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
_SITE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*"


def canonical_url(url: Column) -> Column:
    """A URL without scheme, user, ``www.`` or ``m.``, default port, fragment, tracking parameters and last slashes.

    The host is lower-cased and the other parameters are sorted.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    site = F.lower(F.regexp_replace(F.regexp_extract(plain, _SITE, 0), r"^[^:]*://", ""))
    host = F.regexp_replace(F.regexp_replace(site, r"^(?:[^@]*@)?(?:www[0-9]*\.|m\.)?", ""), ":(?:80|443)$", "")
    rest = F.regexp_replace(plain, _SITE, "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), "/+$", "")
    query = F.filter(
        F.split(F.regexp_replace(rest, r"^[^?]*\??", ""), "&"),
        lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]+|gclid|fbclid)="),
    )
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def fields(block: Column) -> Column:
    """Header lines after the first as a map with lower-case names; the first of equal names counts."""
    pairs = F.transform(
        F.filter(F.slice(F.split(block, "\r?\n"), 2, 100_000_000), lambda line: line.contains(":")),
        lambda line: F.struct(
            F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"),
            F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"),
        ),
    )
    # one element, so that the pairs are made once for all their uses
    maps = F.transform(
        F.array(F.struct(pairs.alias("all"), F.transform(pairs, lambda p: p["name"]).alias("names"))),
        lambda s: F.map_from_entries(F.filter(s["all"], lambda p, i: F.array_position(s["names"], p["name"]) == i + 1)),
    )
    return F.coalesce(maps[0], F.create_map().cast("map<string,string>"))


def _head(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*?)(?:\r?\n\r?\n|\z)", 1)


def parse_records(df: DataFrame, record: str, out: str = "warc") -> DataFrame:
    """Add a struct ``out`` with what the text of a WARC record says.

    ``type``, ``id``, ``url``, ``time``, ``digest``, ``status``, ``headers`` and
    ``payload``. A text that is no record, or null, gives nulls.
    """
    text = column(record)
    head, block, top = (free_name(df.columns, n) for n in ("_head", "_block", "_top"))
    parsed = (
        df.withColumn(head, F.when(text.startswith("WARC/"), fields(_head(text))))
        .withColumn(block, F.when(F.col(head).isNotNull(), after_blank(text)))
        .withColumn(top, F.when(F.col(block).startswith("HTTP/"), _head(F.col(block))))
    )
    value = lambda name: F.try_element_at(head, F.lit(name))
    return parsed.select(
        *[column(c) for c in df.columns],
        F.struct(
            value("warc-type").alias("type"),
            value("warc-record-id").alias("id"),
            value("warc-target-uri").alias("url"),
            F.try_to_timestamp(value("warc-date")).alias("time"),
            value("warc-payload-digest").alias("digest"),
            F.regexp_extract(F.col(top), r"^HTTP/\S+ (\d{3})", 1).try_cast("int").alias("status"),
            F.when(F.col(top).isNotNull(), fields(F.col(top))).alias("headers"),
            F.when(F.col(top).isNotNull(), after_blank(F.col(block))).alias("payload"),
        ).alias(out),
    )


def after_blank(text: Column) -> Column:
    """What follows the first empty line."""
    return F.regexp_replace(text, r"(?s)\A.*?(?:\r?\n\r?\n|\z)", "")


def latest_before(events: DataFrame) -> DataFrame:
    """For every event, ``found``: the latest earlier event of its ``url`` that is ``full``.

    Events have ``url``, ``time``, ``uid`` and ``full``; of events at one time the
    smaller ``uid`` is the earlier. ``found`` is a ``uid`` or null.
    """
    sliced = cut_lineage(
        events.select("url", "time", "uid", "full").repartitionByRange("url", "time", "uid").withColumn("slice", F.spark_partition_id())
    )
    order = Window.partitionBy("slice", "url").orderBy("time", "uid").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("full"), F.col("uid"))
    inside = sliced.withColumn("found", F.last(full, ignorenulls=True).over(order))
    last = sliced.where("full").groupBy("url", "slice").agg(F.max(F.struct("time", "uid")).alias("last"))
    spans = sliced.groupBy("url", "slice").agg(F.count(F.lit(1)).alias("n")).drop("n")
    earlier = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(
        spans.join(last, ["url", "slice"], "left")
        .withColumn("carried", F.last("last.uid", ignorenulls=True).over(earlier))
        .where("carried is not null")
        .select("url", "slice", "carried")
    )
    inside = cut_lineage(inside.select("url", "slice", "uid", "found"))
    return inside.join(carried, ["url", "slice"], "left").select("uid", F.coalesce("found", "carried").alias("found"))


def _validated(old: Column, new: Column, old_digest: Column, new_digest: Column) -> Column:
    """``resolved`` if validators agree, ``mismatch`` if they differ, ``unverified`` if none is given twice."""
    weak = lambda headers: F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")
    dated = lambda headers: F.try_element_at(headers, F.lit("last-modified"))
    checks = F.filter(
        F.array(new_digest == old_digest, weak(new) == weak(old), dated(new) == dated(old)), lambda c: c.isNotNull()
    )
    return (
        F.when(F.size(checks) == 0, "unverified").when(F.forall(checks, lambda c: c), "resolved").otherwise("mismatch")
    )


def merged(old: Column, new: Column) -> Column:
    """Stored headers updated by those of the short answer that may be."""
    allowed = F.map_filter(new, lambda name, _: ~name.isin(*NOT_MERGED))
    kept = F.map_filter(old, lambda name, _: ~F.map_contains_key(allowed, name))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit with the response it stands for.

    ``records`` has ``id``, ``type``, ``url``, ``time``, ``status``, ``headers``,
    ``digest`` and ``payload``, as from ``parse_records``; further columns are
    left out. A full response has type ``response`` and a status other than 304
    and 206. The result has ``id``, ``url``, ``canonical``, ``refers_to`` (id of
    the response), ``outcome``, ``headers`` and ``payload``. The outcome is
    ``resolved``, ``unverified``, ``mismatch`` or ``missing``; for the last two
    headers are the revisit's own and the payload is null. Records without URL
    or time are neither found nor resolved. Repeated revisits come back
    repeated; an empty table gives no rows.
    """
    kept = cut_lineage(
        records.select("id", "type", "url", "time", "status", "headers", "digest", "payload")
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("canonical", canonical_url(F.col("url")))
    )
    full = (F.col("type") == "response") & ~F.coalesce(F.col("status"), F.lit(0)).isin(206, 304)
    events = kept.where(F.col("canonical").isNotNull() & F.col("time").isNotNull() & (full | (F.col("type") == "revisit")))
    found = latest_before(events.select(F.col("canonical").alias("url"), "time", "uid", full.alias("full")))
    found = cut_lineage(found.where("found is not null"))
    asked = kept.where("type = 'revisit'").select("uid", "id", "url", "canonical", "headers", "digest").join(found, "uid", "left")
    asked = cut_lineage(asked)
    stored = kept.where(full).select(
        F.col("uid").alias("found"), F.col("id").alias("refers_to"), F.col("headers").alias("old"),
        F.col("digest").alias("old_digest"), F.col("payload").alias("old_payload"),
    )
    outcome = F.when(F.col("refers_to").isNull() & F.col("old").isNull(), "missing").otherwise(
        _validated(F.col("old"), F.col("headers"), F.col("old_digest"), F.col("digest"))
    )
    good = F.col("outcome").isin("resolved", "unverified")
    none = F.create_map().cast("map<string,string>")
    return (
        asked.join(stored, "found", "left")
        .withColumn("outcome", outcome)
        .select(
            "id", "url", "canonical", "refers_to", "outcome",
            F.when(good, merged(F.coalesce("old", none), F.coalesce("headers", none))).otherwise(F.coalesce("headers", none)).alias("headers"),
            F.when(good, F.col("old_payload")).alias("payload"),
        )
    )


def as_records(pages: DataFrame, after: int) -> DataFrame:
    """WARC texts of a crawl of ``pages`` that asks for each page again.

    Page ``n`` is captured in second ``n``, in full, with the hash of its text as
    entity tag. It is asked for again ``after`` seconds later and has not changed.
    """
    date = lambda seconds: F.date_format(F.timestamp_seconds(1_700_000_000 + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    html, tag = F.coalesce("html", F.lit("")), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))

    def text(kind: str, seconds: Column, status: str, headers: list[tuple[str, Column]], body: Column) -> Column:
        top = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.concat(F.lit(f"{kind}-"), F.col("page_id"))), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date(seconds))]
        line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return F.concat(
            F.lit("WARC/1.1\r\n"), *[line(*x) for x in top], F.lit(f"\r\nHTTP/1.1 {status}\r\n"), *[line(*x) for x in headers], F.lit("\r\n"), body
        )

    first = text("response", F.col("page_id"), "200 OK", [
        ("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length(html).cast("string")), ("ETag", tag), ("Date", date(F.col("page_id"))),
    ], html)
    second = text("revisit", F.col("page_id") + after, "304 Not Modified", [
        ("ETag", F.concat(F.lit("W/"), tag)), ("Date", date(F.col("page_id") + after)), ("Content-Length", F.lit("0")), ("Cache-Control", F.lit("max-age=60")),
    ], F.lit(""))
    return pages.select(F.explode(F.array(first, second)).alias("record"))
