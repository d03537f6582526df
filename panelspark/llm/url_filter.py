"""URL filters as a temporal list join, in Spark SQL functions only.

List entries are dated: ``entries`` holds (pattern_kind, pattern, action, listed_at), where action is "block",
"allow" or "remove". Per pattern, entries in time order become validity intervals [valid_from, valid_to); a
"remove" only ends the one before. Each capture is decided by the entries that were active when it was fetched:
its host, each parent domain of the host and the host's first path segment are asked for, and the latest entry at
or before the fetch counts per pattern (the as-of join); among patterns the longest decides, and "allow" wins over
"block" at equal length.

A hot host doesn't gather in a task: lookups are first reduced to distinct (pattern, instant) pairs with partial
aggregation, and the as-of join sorts them inside (pattern, day) buckets, of which only the last entry goes on to the
next; the verdicts of distinct (patterns, instant) are joined back.

Defined results: a null, empty or unparsable URL or a null fetch time is "unknown" and not kept out; entries with
null fields are ignored; of entries of one pattern at one instant "allow" counts before "remove" before "block";
repeated rows are repeated in the result; without entries all captures are "none"; extra columns of the inputs
never reach the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.asof import asof_backward

from .common import table

#: An action's place when one pattern has several entries at one instant.
ORDER = "CASE action WHEN 'allow' THEN 0 WHEN 'remove' THEN 1 ELSE 2 END"


def host(url: Column) -> Column:
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(authority, r"\.+$", "")


def patterns(url: Column) -> Column:
    """The keys that list entries can have for this URL: host and parent domains ("d:"), host and first path segment ("p:")."""
    name = host(url)
    labels = F.split(name, r"\.")
    # parent domains of two labels or more, up to the whole host
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), n)), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(n - k, F.lit(0)) + 1, k), ".")))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)", 1)
    path = F.when(segment != "", F.array(F.concat(F.lit("p:"), name, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(F.concat(F.lit("d:"), name)), domains, path)))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (null: open): one row for each instant at which a pattern's entry changes."""
    known = entries.select("pattern", "action", "listed_at").dropna().where(F.col("action").isin("block", "allow", "remove"))
    one = known.groupBy("pattern", "listed_at").agg(F.min_by("action", F.expr(ORDER)).alias("action"))
    until = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    return one.select("pattern", "action", F.col("listed_at").alias("valid_from"), until.alias("valid_to"))


def decide(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """id, url, fetched_at, host, verdict (block, allow, none, unknown) and the pattern and interval that decided."""
    rows = captures.select(F.col(id_col), F.col(url_col).alias("url"), F.col(at_col).alias("fetched_at"))
    keyed = rows.withColumn("host", host(F.col("url"))).withColumn("patterns", patterns(F.col("url")))
    asked = keyed.where(F.col("fetched_at").isNotNull()).select(F.explode("patterns").alias("pattern"), "fetched_at").distinct()
    met = asof_backward(asked, intervals(entries), ["pattern"], "fetched_at", "valid_from", ["action", "valid_to"], bucket_days=1)
    active = met.where("action <> 'remove'").withColumnRenamed("matched_valid_from", "valid_from")
    # back to the captures: (host, path, instant) decide alike, so they are decided once
    what = keyed.where(F.col("fetched_at").isNotNull()).select("patterns", "fetched_at").distinct()
    met = what.withColumn("pattern", F.explode("patterns")).join(active, ["pattern", "fetched_at"])
    best = F.max_by(F.struct("action", "pattern", "valid_from", "valid_to"), F.struct(F.length("pattern"), F.col("action") == "allow", "pattern"))
    decided = met.groupBy("patterns", "fetched_at").agg(best.alias("best"))
    out = keyed.join(decided, ["patterns", "fetched_at"], "left")
    unknown = (F.size("patterns") == 0) | F.col("fetched_at").isNull() | F.col("url").isNull()
    verdict = F.when(unknown, "unknown").otherwise(F.coalesce("best.action", F.lit("none")))
    return out.select(id_col, "url", "fetched_at", "host", verdict.alias("verdict"), F.col("best.pattern").alias("pattern"), "best.valid_from", "best.valid_to")


#: The pages table has no fetch times and no lists; both are derived from its rows by these rules.
FETCHED = "timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id * 37, 360) AS int), 0, 0, 0)"
RULES = """
SELECT 'd:' || host AS pattern, 'block' AS action, first_day + make_dt_interval(30, 0, 0, 0) AS listed_at FROM hosts WHERE host RLIKE 'casino|bets|pills|spam'
UNION ALL SELECT 'd:' || host, 'block', first_day + make_dt_interval(60, 0, 0, 0) FROM hosts WHERE n % 3 = 0
UNION ALL SELECT 'd:' || host, 'remove', first_day + make_dt_interval(200, 0, 0, 0) FROM hosts WHERE n % 3 = 0
UNION ALL SELECT 'd:' || host, 'block', first_day + make_dt_interval(300, 0, 0, 0) FROM hosts WHERE n % 2 = 0
UNION ALL SELECT 'p:' || host || '/en', 'allow', first_day + make_dt_interval(90, 0, 0, 0) FROM hosts WHERE n % 2 = 1
UNION ALL SELECT 'd:' || regexp_extract(host, '[^.]+[.][^.]+$', 0), 'block', timestamp'2024-11-01 00:00:00' FROM hosts WHERE host LIKE '%.example.org'
"""


def captures_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    hosts = captures.select(host(F.col("url")).alias("host"), "fetched_at").where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.min("fetched_at").alias("first_day"))
    return captures, spark.sql(RULES.replace("FROM hosts", "FROM {hosts}"), hosts=hosts)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(*captures_and_entries(spark, sf_dir))


OP1_SQL = r"""
WITH captures AS (
  SELECT page_id, url, timestamp '2024-01-01' + to_days(((page_id * 37) % 360)::INT) AS fetched_at,
    regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)', 1) AS segment FROM pages),
hosts AS (SELECT host, count(*) AS n, min(fetched_at) AS first_day FROM captures WHERE host <> '' GROUP BY 1),
raw AS (
  SELECT 'd:' || host AS pattern, 'block' AS action, first_day + to_days(30) AS listed_at FROM hosts WHERE regexp_matches(host, 'casino|bets|pills|spam')
  UNION ALL SELECT 'd:' || host, 'block', first_day + to_days(60) FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT 'd:' || host, 'remove', first_day + to_days(200) FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT 'd:' || host, 'block', first_day + to_days(300) FROM hosts WHERE n % 2 = 0
  UNION ALL SELECT 'p:' || host || '/en', 'allow', first_day + to_days(90) FROM hosts WHERE n % 2 = 1
  UNION ALL SELECT 'd:' || regexp_extract(host, '[^.]+[.][^.]+$', 0), 'block', timestamp '2024-11-01' FROM hosts WHERE host LIKE '%.example.org'),
one AS (SELECT pattern, listed_at, arg_min(action, CASE action WHEN 'allow' THEN 0 WHEN 'remove' THEN 1 ELSE 2 END) AS action FROM raw GROUP BY 1, 2),
spans AS (SELECT pattern, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to FROM one),
keys AS (
  SELECT DISTINCT page_id, fetched_at, pattern FROM (
    SELECT page_id, fetched_at, 'd:' || array_to_string(list_slice(string_split(host, '.'), -k, -1), '.') AS pattern
      FROM captures, range(1, 256) t(k) WHERE host <> '' AND (k = len(string_split(host, '.')) OR (k >= 2 AND k <= len(string_split(host, '.'))))
    UNION ALL SELECT page_id, fetched_at, 'p:' || host || segment FROM captures WHERE host <> '' AND segment <> '')),
best AS (
  SELECT page_id, s.action, s.pattern, s.valid_from, s.valid_to FROM keys k JOIN spans s ON k.pattern = s.pattern AND s.action <> 'remove' AND s.valid_from <= k.fetched_at AND (s.valid_to IS NULL OR k.fetched_at < s.valid_to)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(s.pattern) DESC, s.action = 'allow' DESC, s.pattern DESC) = 1)
SELECT c.page_id, c.url, c.fetched_at, c.host, CASE WHEN c.host = '' OR c.url IS NULL THEN 'unknown' ELSE coalesce(b.action, 'none') END AS verdict, b.pattern, b.valid_from, b.valid_to
FROM captures c LEFT JOIN best b USING (page_id)
"""
