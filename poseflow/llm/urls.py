"""URL filters by dated lists: which entries were active when a page was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..tables import Scratch

#: Scheme, user information (up to the last @), then a host in brackets or one that ends at a port or path.
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)"
#: Hosts that have no domains above them: IPv6 in brackets, and IPv4.
ADDRESS = r"^(\[.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def normal_name(name: Column) -> Column:
    """A host or entry in lower case without white space around it and without dots before and after it; null where nothing is left."""
    out = F.regexp_replace(F.lower(name), r"^[\s.]+|[\s.]+$", "")
    return F.when(out != "", out)


def host_of(url: Column) -> Column:
    """The host of a URL as `normal_name`; null where it has none."""
    return normal_name(F.regexp_extract(F.lower(F.trim(url)), HOST, 1))


def suffixes(host: Column) -> Column:
    """The host and the domains above it, down to the last label; an address alone."""
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(every)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(entry, since, until): from each addition to the next removal; until is null while the entry stands.

    entries: entry, day (date), active (true: added, false: removed). An addition of an active entry and a removal of an inactive one change nothing. Of
    several events of one day the addition counts last. Entries are compared as `normal_name` gives them, so `B.com.` is `b.com`. Rows with a null
    or empty entry, or a null day or action, are ignored. Repeated rows count once; other columns are not read.
    """
    named = entries.select(normal_name(F.col("entry").cast("string")).alias("entry"), F.col("day").cast("date").alias("day"), "active")
    rows = named.where("entry is not null and day is not null and active is not null").groupBy("entry", "day").agg(F.max("active").alias("active"))
    by = Window.partitionBy("entry").orderBy("day")
    changes = rows.withColumn("before", F.coalesce(F.lag("active").over(by), F.lit(False))).where("active <> before")
    return changes.withColumn("until", F.lead("day").over(by)).where("active").select("entry", F.col("day").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """captures with host, blocked, matched_entry and active_since: an entry matches a host that it equals or is a domain of,
    and blocks a capture fetched from the day it was added until the day before its removal; of several, the
    longest is given. Hosts and entries are compared in lower case, without dots at their ends; addresses match as a whole.

    Each distinct host and day is judged once: its host and domains join the entries' validity intervals, which are laid
    out by month so that a capture meets only the intervals of its own month. The verdicts are a saved table, which
    captures join by host and day, so a host with a third of the captures is a skewed join, which adaptive execution
    splits. Captures without a host or day are not blocked. Repeated captures stay. Empty entries block nothing. Columns of
    captures with the four names are replaced; other columns stay.
    """
    scratch = Scratch(captures.sparkSession, "url-filter")
    own = captures.withColumn("host", host_of(F.col(url_col).cast("string"))).withColumn("__day", F.col(day_col).cast("date"))
    keys = scratch.save(own.where("host is not null and __day is not null").select("host", F.col("__day").alias("day")).distinct(), "keys")
    early, last = keys.agg(F.min("day"), F.max("day")).first()
    intervals = validity_intervals(entries)
    if last is None:
        intervals, early, last = intervals.where("false"), "1970-01-01", "1970-01-01"
    month = lambda c: F.trunc(c, "month")
    final = F.least(F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    begin = F.greatest(F.col("since"), F.lit(early).cast("date"))
    laid = intervals.where(begin <= final).withColumn("month", F.explode(F.sequence(month(begin), month(final), F.expr("interval 1 month"))))
    laid = scratch.save(laid.select(F.col("entry").alias("suffix"), "month", "since", "until"), "intervals")
    asked = keys.select("host", "day", month(F.col("day")).alias("month"), F.explode(suffixes(F.col("host"))).alias("suffix"))
    met = asked.join(laid, ["suffix", "month"]).where("day >= since and (until is null or day < until)")
    verdicts = met.groupBy("host", "day").agg(F.max_by(F.struct("suffix", "since"), F.length("suffix")).alias("k"))
    verdicts = scratch.save(verdicts.select("host", F.col("day").alias("__day"), F.col("k.suffix").alias("matched_entry"), F.col("k.since").alias("active_since")), "verdicts")
    out = own.drop("matched_entry", "active_since", "blocked").join(verdicts, ["host", "__day"], "left")
    return out.withColumn("blocked", F.col("matched_entry").isNotNull()).drop("__day")


def fetched(page_id: Column) -> Column:
    """Pages carry no fetch time: these dates of 2024 follow from the page's number."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id * 37, F.lit(366)).cast("int"))


def derived_list(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts and domains: each is added on a day given by its length and count of pages,
    most are removed later, and some added again."""
    names = pages.select(F.explode(suffixes(host_of(F.col("url")))).alias("entry")).groupBy("entry").agg(F.count("*").alias("n"))
    names = names.where("instr(entry, '.') > 0").withColumn("k", F.col("n") * 31 + F.length("entry") * 17)
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    added = names.where("k % 3 <> 0").select("entry", day(F.col("k") % 200).alias("day"), F.lit(True).alias("active"))
    removed = names.where("k % 3 <> 0 and k % 4 <> 0").select("entry", day(F.col("k") % 200 + 20 + F.col("k") % 60).alias("day"), F.lit(False).alias("active"))
    again = names.where("k % 3 <> 0 and k % 5 = 0").select("entry", day(F.col("k") % 200 + 100).alias("day"), F.lit(True).alias("active"))
    return added.union(removed).union(again)
