"""URL filters over time: dated list entries become validity intervals, and captures are judged as of their fetch.

An entry adds a pattern to a list or removes it from a day on. Per list and pattern the entries in order of days make
intervals [from, to) in which the pattern is active. A capture is listed by every interval that holds its fetch day and
whose pattern is its host, a parent domain of it, or its URL without scheme, query and fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts that the rows of one pattern, or of one host and day, are dealt to.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host without port; empty for what is not a URL or null."""
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_of(url: Column) -> Column:
    """Host and path without scheme, port, query, fragment and closing slash."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.coalesce(F.regexp_replace(path, "/+$", ""), F.lit("")))


def parents_of(host: Column) -> Column:
    """The host and its parent domains down to the last label; no more than its labels, so a bounded handful."""
    parts = F.split(host, "\\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "."))
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, from_day, to_day) from entries (list, kind 'domain' or 'page', pattern, day date, action).

    Of several entries of a day the removal counts last. A repeated action changes nothing: an interval ends with the
    next removal. to_day is null while active. Entries with a null list, kind, pattern, day or action are left out.
    """
    e = entries.select("list", "kind", F.lower("pattern").alias("pattern"), F.col("day").cast("date").alias("day"), "action").dropna()
    daily = e.where("action in ('add', 'remove')").groupBy("list", "kind", "pattern", "day").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("removed"))
    own = Window.partitionBy("list", "kind", "pattern").orderBy("day")  # an entry's own history: as many rows as days it changed on
    turns = daily.withColumn("before", F.lag("removed").over(own)).where("before is null or before <> removed")
    return turns.withColumn("to_day", F.lead("day").over(own)).where("removed = 0").select("list", "kind", "pattern", F.col("day").alias("from_day"), "to_day")


def judge(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per row of captures: id, url, host, day, blocked, n_lists, list, pattern, since.

    list, pattern and since tell the longest active pattern (ties: first list by name); null if none. Hosts and days are
    judged once however many captures share them, and pages likewise, so a hot host costs a row a day. A null URL, what is
    no URL and a null fetch time are never listed and join nothing. Where rows meet patterns or judgements, they are dealt
    to SALTS parts of their key, so that neither a top-level domain nor a hot host and day is one task's work. Captures
    may repeat; other columns are not read.
    """
    rows = captures.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("host"), page_of(F.col(url_col)).alias("page"), F.col(time_col).cast("date").alias("day"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int").alias("salt")
    spans = intervals(entries).select("*", parts)
    good = F.coalesce((F.col("host") != "") & F.col("day").isNotNull(), F.lit(False))
    asked = (
        rows.where(good).groupBy("host", "day").count().select("day", F.lit("domain").alias("kind"), F.col("host").alias("of"), F.explode(parents_of(F.col("host"))).alias("pattern"))
    )
    pages = rows.where(good & (F.col("page") != F.col("host"))).groupBy("page", "day").count().select("day", F.lit("page").alias("kind"), F.col("page").alias("of"), F.col("page").alias("pattern"))
    alive = (F.col("day") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day")))
    hits = asked.union(pages).select("*", salt("of", "day")).join(spans, ["kind", "pattern", "salt"]).where(alive)
    hits = hits.select("kind", "of", "day", F.struct((-F.length("pattern")).alias("n"), F.col("list").alias("list"), F.col("pattern").alias("pattern"), F.col("from_day").alias("since")).alias("hit"))
    best = hits.groupBy("kind", "of", "day").agg(F.min("hit").alias("hit"), F.collect_set("hit.list").alias("lists"))
    by_host = best.where("kind = 'domain'").select(F.col("of").alias("host"), "day", F.col("hit").alias("h1"), F.col("lists").alias("l1"), parts)
    by_page = best.where("kind = 'page'").select(F.col("of").alias("page"), "day", F.col("hit").alias("h2"), F.col("lists").alias("l2"), parts)
    none = F.array().cast("array<string>")
    judged = rows.where(good).select("*", salt(id_col, "page")).join(by_host, ["host", "day", "salt"], "left").join(by_page, ["page", "day", "salt"], "left")
    judged = judged.select(id_col, url_col, "host", "day", F.least("h1", "h2").alias("hit"), F.size(F.array_union(F.coalesce("l1", none), F.coalesce("l2", none))).alias("n_lists"))
    out = judged.union(rows.where(~good).select(id_col, url_col, "host", "day", F.lit(None).cast(judged.schema["hit"].dataType), F.lit(0)))
    return out.select(id_col, url_col, "host", "day", (F.col("n_lists") > 0).alias("blocked"), "n_lists", "hit.list", "hit.pattern", "hit.since")


__all__ = ["host_of", "intervals", "judge", "page_of", "parents_of"]
