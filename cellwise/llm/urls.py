"""URL lists with a history: validity intervals and an as-of join with dated captures.

Only DataFrame functions. A list is a table of dated events: at ``effective_at`` a pattern
(a host or a domain with all below it) is added or removed. Events become intervals; a
capture is judged by the entries valid at its own fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.session import broadcast_checked, freeze

BUCKET_SECONDS = 30 * 86_400


def host(url: str | Column) -> Column:
    """Host of a URL in lower case, without user, port and closing dot; null where it has none."""
    url = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def domains(name: str | Column) -> Column:
    """The host and every domain above it, the longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (pattern, category, valid_from, valid_to) of list events.

    ``entries``: pattern, category, action (add or remove), effective_at. An entry lasts until
    the pattern's next event of that category; valid_to is null while none follows. Of events
    of one moment a removal counts last. Null patterns and times are ignored.
    """
    events = entries.select(F.lower("pattern").alias("pattern"), "category", "action", F.col("effective_at").cast("timestamp").alias("valid_from")).filter("pattern IS NOT NULL AND valid_from IS NOT NULL").distinct()
    order = Window.partitionBy("pattern", "category").orderBy("valid_from", "action")
    dated = events.withColumn("valid_to", F.lead("valid_from").over(order))
    return dated.filter("action = 'add' AND (valid_to IS NULL OR valid_to > valid_from)").select("pattern", "category", "valid_from", "valid_to")


def _bucket(moment: Column) -> Column:
    return F.floor(F.unix_timestamp(moment) / BUCKET_SECONDS)


def listed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_at) judged at fetch time.

    page_id, url, fetched_at, host, blocked, pattern (the longest that applies; of equals the
    category first in order decides), category and valid_from, a row for every capture.

    The as-of join is an equality on (domain, stretch of time) with the interval test beside
    it: intervals are laid over stretches of 30 days, so the captures of a host with a third
    of the corpus spread over the stretches, and adaptive execution can split what is left.
    The list side is broadcast when a count shows that it is small. Distinct moments of hosts
    and the list's intervals are written once, so the captures are read twice: for the moments
    and for the result.

    Null URLs, URLs without a host and null times are never blocked. Repeated captures are
    judged alike and all returned. An empty list blocks nothing.
    """
    rows = captures.select("page_id", F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at")).withColumn("host", host("url"))
    seen = freeze(rows.filter("host IS NOT NULL AND fetched_at IS NOT NULL").select("host", "fetched_at").distinct())
    keys = seen.withColumn("stretch", _bucket(F.col("fetched_at"))).withColumn("pattern", F.explode(domains("host")))
    last = F.lit(seen.agg(F.max(_bucket(F.col("fetched_at")))).first()[0]).cast("long")
    until = F.coalesce(_bucket(F.col("valid_to")), last)
    intervals = (
        freeze(validity(entries)).withColumn("first_stretch", _bucket(F.col("valid_from"))).withColumn("until", F.least(until, last))
        .filter("first_stretch <= until").withColumn("stretch", F.explode(F.sequence("first_stretch", "until")))
        .select("pattern", "stretch", "category", "valid_from", "valid_to")
    )
    active = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = keys.join(broadcast_checked(intervals), ["pattern", "stretch"]).filter(active)
    best = hits.groupBy("host", "fetched_at").agg(F.min(F.struct((-F.length("pattern")).alias("short"), "pattern", "category", "valid_from")).alias("hit"))
    joined = rows.join(best, ["host", "fetched_at"], "left")
    return joined.select(
        "page_id", "url", "fetched_at", "host", F.col("hit").isNotNull().alias("blocked"),
        F.col("hit.pattern").alias("pattern"), F.col("hit.category").alias("category"), F.col("hit.valid_from").alias("valid_from"),
    )
