"""URL filters by a temporal list join.

A list is a log of dated entries (kind, value, action, at): `add` puts a value on the list, `remove` takes it off. The
log of each value becomes validity intervals, only its changes counting. A capture (url, fetched_at) is judged by an
as-of join against them: of each value that its host or a domain above it has on the list, the last interval that began
by the fetch time is looked up, and holds if it hasn't ended.

A verdict hangs on host and time only. Hosts are first joined with the list, each once, whatever the number of its
captures; what a host finds are the changes of its listed values, in order of time. Distinct pairs of host and time are
then joined with their host's changes, a host's pairs dealt out to parts, and each takes the last ones by its time.

Kinds: `host` (this host alone), `domain` (this domain and all below it). Of several active entries the host's comes
first, then the longest domain. At one instant `remove` comes after `add`; an entry holds from its instant on.

Defined cases: a null, empty or unparsable url, or a null time, isn't blocked; entries with a null field are ignored;
values are compared in lower case without a dot at the end; repeated entries count once; repeated captures each give a
row. Other columns are kept, but those named like a result column (host, blocked, listed_kind, listed_value,
listed_since) are replaced. Without entries nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, with_values

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """The lower-case host of an absolute URL; null without one."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(".")), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, value, since, until (null: open) of the times at which values are listed."""
    log = entries.select("kind", F.rtrim(F.lower("value"), F.lit(".")).alias("value"), "action", "at").dropna().where(F.col("action").isin("add", "remove")).distinct()
    order = Window.partitionBy("kind", "value").orderBy("at", "action")
    changes = log.withColumn("before", F.lag("action", 1, "remove").over(order)).where("action <> before")
    return changes.withColumn("until", F.lead("at").over(order)).where("action = 'add' and (until is null or until > at)").select("kind", "value", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_at, ...) with host, blocked, and the entry's listed_kind, listed_value, listed_since."""
    captures = captures.drop("host", "blocked", "listed_kind", "listed_value", "listed_since").withColumn("host", host(F.col("url")))
    asked = table(captures.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct())
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("value")))
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")))
    keys = asked.select("host").distinct().select("host", F.inline(F.concat(own, domains)))
    keys = keys.select("host", F.concat_ws(":", "kind", "value").alias("key"))
    # the intervals of one value, as many as its changes in the log
    span = F.struct("since", "until", "kind", "value")
    spans = intervals(entries).groupBy(F.concat_ws(":", "kind", "value").alias("key")).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # per host: the intervals of each of its listed values, the values in order of precedence
    rank = F.struct(F.col("key").startswith("host:"), F.length("key")).alias("rank")
    listed = with_values(keys, "key", "host", spans, "inner").groupBy("host").agg(F.sort_array(F.collect_list(F.struct(rank, "spans")), asc=False).alias("listed"))
    known = with_values(asked, "host", "fetched_at", listed, "inner")
    last = lambda x: F.try_element_at(F.filter(x["spans"], lambda s: s["since"] <= F.col("fetched_at")), F.lit(-1))
    as_of = F.filter(F.transform("listed", last), lambda s: s.isNotNull() & (s["until"].isNull() | (s["until"] > F.col("fetched_at"))))
    best = known.select("host", "fetched_at", F.try_element_at(as_of, F.lit(1)).alias("x")).where("x is not null")
    best = best.select("host", "fetched_at", F.col("x.kind").alias("listed_kind"), F.col("x.value").alias("listed_value"), F.col("x.since").alias("listed_since"))
    return captures.join(best, ["host", "fetched_at"], "left").withColumn("blocked", F.col("listed_kind").isNotNull())
