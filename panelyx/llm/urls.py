"""URL filters: host-suffix and path-prefix expressions, equi-join on short hash prefixes, full digests confirm.

Semantics. Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?",
"#" or the end. A null url or one without "://" has an empty host and path and fits no rule. A rule fits its host and
every subdomain of it if the path starts with the rule's path. Of several fitting rules the longest text (host + path)
wins; among rules of the same text a block beats an allow. Without a rule the verdict is `default` ("allow").

Edge cases: null ids are kept, repeated rows each get their row, an empty table gives an empty result, other columns of
the input are ignored. Very long paths are handled whole: only prefixes of lengths that some rule has are expanded, so
an URL gives at most (labels of its host, at most the most labels of any rule) x (distinct path lengths of the rules)
expressions, whatever its length.

The verdict is found once for each distinct (host, path), so that a popular page costs one set of expressions, and
joined back; the rule table is broadcast only while it has at most BROADCAST_RULES rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Hex digits of the digest that the equi-join compares.
PREFIX_DIGITS = 8
#: A rule table of at most so many rows (about 200 bytes each) is broadcast.
BROADCAST_RULES = 10_000

#: The rules of the query, (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """rules: (verdict, host, path). Returns id, host, path, rule, verdict; one row for each row of pages."""
    spark = pages.sparkSession
    rules = rules.select("verdict", "host", "path", F.concat("host", "path").alias("rule"))
    n_rules, labels, lengths = rules.agg(F.count("*"), F.max(F.size(F.split("host", r"\."))), F.collect_set(F.char_length("path"))).first()
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not n_rules:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rules = rules.withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).select("prefix", "digest", "rule", "verdict")
    if n_rules <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    parts = F.split("host", r"\.")
    suffixes = F.expr(f"transform(sequence(1, least(size(parts), {labels})), n -> array_join(slice(parts, size(parts) - n + 1, n), '.'))")
    prefixes = F.filter(F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]), lambda x: x.isNotNull())
    distinct = urls.filter("host <> '' or path <> ''").select("host", "path").distinct()
    shown = (
        distinct.withColumn("parts", parts)
        .select("host", "path", suffixes.alias("suffixes"), prefixes.alias("prefixes"))
        .select("host", "path", F.explode(F.flatten(F.transform("suffixes", lambda s: F.transform(F.col("prefixes"), lambda p: F.concat(s, p))))).alias("shown"))
        .withColumn("digest", F.sha2("shown", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    fits = shown.alias("u").join(rules.alias("r"), "prefix").filter("u.digest = r.digest")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.char_length("r.rule").alias("n"), (F.col("r.verdict") == "block").alias("block"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path,
  (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM r
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM u
"""
