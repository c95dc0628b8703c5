"""The queries opN_<name> of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstok, language, minhash, mixing, packed_ids, packing, periods, private, radix, suffixes, urls, vectors, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"), 50)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 3, 85)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at a time that its id gives, against a list of the pages' own hosts and domains: an MD5 says
    which are listed, when they are added, removed and added again."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=n)
    captures = pages.withColumn("fetched_at", day((F.col("page_id") * 7919 % 365).cast("int")))
    hosts = pages.select(urls.host(F.col("url")).alias("host")).where("host is not null").distinct()
    domains = hosts.select(F.lit("domain").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("value")).where("value <> ''").distinct()
    values = hosts.select(F.lit("host").alias("kind"), F.col("host").alias("value")).union(domains).withColumn("sum", F.md5("value"))
    digit = lambda i, n: F.conv(F.substring("sum", i, n), 16, 10).cast("int")
    listed = values.where(F.substring("sum", 1, 1) < F.lit("6"))
    start = digit(2, 2)
    log = [listed.select("kind", "value", F.lit("add").alias("action"), day(start).alias("at")), listed.select("kind", "value", F.lit("remove").alias("action"), day(start + 30).alias("at")), listed.where(F.substring("sum", 4, 1) < F.lit("8")).select("kind", "value", F.lit("add").alias("action"), day(start + 90).alias("at"))]
    return urls.judge(captures, log[0].union(log[1]).union(log[2])).select("page_id", "host", "fetched_at", "blocked", "listed_kind", "listed_value", "listed_since")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.round_trip(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.exact_groups(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), 4096)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), 0.95, 4.0, 1.0)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of the base kinds' spans, and all spans."""
    found = private.personal_data(_table(spark, sf_dir, "documents"))
    said = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    of = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds)))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in private.BASE]
    digest = F.sha2(F.array_join(F.slice(said, F.lit(1), of(*private.BASE)), ","), 256)  # the base kinds come first
    return found.select("doc_id", *counts, digest.alias("base_sha256"), F.array_join(said, ",").alias("spans"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): in a tenth of the texts, by their id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.select("*", F.size("words").alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of each text with planted periods, and digests of all runs and of the collapsed text."""
    found = periods.periodic_runs(with_planted_periods(_table(spark, sf_dir, "documents")), 12)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"], r["period"]))), 1)
    found = found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, longest).alias("top"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = lambda name: F.col(f"top.{name}")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top("start").alias("start"), (-top("size")).alias("length"), top("period").alias("period"),
        F.floor(-top("size") * 1000 / top("period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    found = (op1_embedding_near_dedup, op2_repeated_passages, op3_minhash_near_dedup, op4_url_filter, op5_token_ids, op6_exact_dedup, op7_warc)
    found += (op8_language_id, op9_packing, op10_mixing, op11_tokenizer_alignment, op12_personal_data, op13_periodic_runs)
    return {f.__name__: f for f in found}


_SQUEEZED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

SQL = {
    "op4_url_filter": r"""
with pages_at as (
  select page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') as host,
         timestamp '2024-01-01' + to_days(cast(page_id * 7919 % 365 as int)) as fetched_at
  from pages),
hosts as (select distinct host from pages_at where host is not null),
vals as (
  select 'host' as kind, host as value from hosts
  union select 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) from hosts where regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''),
listed as (select kind, value, md5(value) as s, cast('0x' || substr(md5(value), 2, 2) as int) as d from vals where substr(md5(value), 1, 1) < '6'),
spans as (
  select kind, value, timestamp '2024-01-01' + to_days(d) as since, timestamp '2024-01-01' + to_days(d + 30) as until from listed
  union all
  select kind, value, timestamp '2024-01-01' + to_days(d + 90), null from listed where substr(s, 4, 1) < '8'),
hits as (
  select p.page_id, s.kind, s.value, s.since,
         row_number() over (partition by p.page_id order by (s.kind = 'host') desc, length(s.value) desc) as n
  from pages_at p join spans s
    on (p.host = s.value or (s.kind = 'domain' and ends_with(p.host, '.' || s.value)))
   and s.since <= p.fetched_at and (s.until is null or p.fetched_at < s.until))
select p.page_id, p.host, p.fetched_at, h.kind is not null as blocked, h.kind as listed_kind, h.value as listed_value, h.since as listed_since
from pages_at p left join hits h on h.page_id = p.page_id and h.n = 1""",
    "op6_exact_dedup": f"""
with d as (select doc_id, length(coalesce(text, '')) as signs, {_SQUEEZED} as plain from documents),
g as (select plain, count(*) as n, first(doc_id order by signs desc, doc_id) as keep_id from d group by plain)
select d.doc_id, g.keep_id, g.n as group_size, d.doc_id = g.keep_id as kept, sha256(d.plain) as text_sha256
from d join g using (plain)""",
    "op7_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select payload_digest, max(page_id) as head from p where payload_bytes >= 1000 group by 1)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when p.page_id < g.head then 'revisit' else 'response' end as record_type,
       case when p.page_id < g.head then g.head end as refers_to
from p left join g on g.payload_digest = p.payload_digest and p.payload_bytes >= 1000""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
