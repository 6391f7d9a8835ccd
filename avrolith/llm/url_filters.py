"""URL filters by hash-prefix lookup.

A rule is a host and a path prefix with a verdict. It fits its host and all
subdomains if the URL's path starts with the rule's path; of fitting rules the
longest (host and path together, then host) wins, and of equal rules 'block'.

Every distinct URL is expanded into host suffixes times path prefixes; suffixes are
taken only of as many labels, and prefixes only at the lengths, as occur among the rules, so
that a URL of any length has no more expressions than there are such pairs. The expressions are
joined with the rules on the first 8 hex digits of SHA-256 and confirmed by the full digest.

Skew: verdicts are computed once per distinct URL and brought back by
lookup_join, so a URL or host with a third of all rows is expanded once. Rules
are broadcast only while their number is at most BROADCAST_RULES; beyond, distinct expressions,
counted before they are shuffled, are joined, and what fits comes back by lookup_join: an
expression that most URLs have (as com/) meets its rule once.

Defined results: a null URL or one without '://' has empty host and path and
gets the default verdict; repeated rows each get a row; an empty table gives an
empty result. Only the id and URL columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avrolith.llm.common import lookup_join, materialize, shuffle_partitions

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BROADCAST_RULES = 100_000
DEFAULT_VERDICT = "allow"
HASH_PREFIX = 8


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(v, h.lower(), p) for v, h, p in rules], "verdict string, host string, path string")


def split_url(url):
    """Columns host (A-Z lower-cased) and path of a URL column."""
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    has = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, lower).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (null if none fits), verdict."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url")).withColumn("__spread", F.xxhash64("page_id"))
    counts = base.where("__url is not null").groupBy("__url").agg(F.count(F.lit(1)).alias("__n"))
    host, path = split_url("__url")
    # dealt anew, as the work begins here: few bytes of URLs would be put into few tasks
    counts = counts.repartition(shuffle_partitions(pages.sparkSession), "__url")
    urls = materialize(counts.select("__url", "__n", host.alias("host"), path.alias("path")), "distinct-urls")

    rules = rules.select("verdict", "host", "path").where("host is not null and path is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
    expr = F.concat(F.length("host").cast("string"), F.lit(":"), "host", "path")
    rules = rules.select(F.sha2(expr, 256).alias("r_digest"), F.substring(F.sha2(expr, 256), 1, HASH_PREFIX).alias("r_prefix"), F.concat("host", "path").alias("rule"), F.length("host").alias("r_host"), "verdict", F.length("path").alias("r_len"), F.size(F.split("host", r"\.")).alias("r_labels"))
    rules = materialize(rules, "rules")
    # as many as path lengths and numbers of labels occur
    lengths, labels = (sorted(r[0] for r in rules.select(c).distinct().collect()) for c in ("r_len", "r_labels"))
    rules = rules.drop("r_len", "r_labels")

    numbers = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    grid = urls.where("host <> ''").withColumn("dots", F.expr("length(host) - length(replace(host, '.', ''))")).withColumn("labels", numbers(labels)).withColumn("lengths", numbers(lengths))
    suffixes = F.expr("transform(filter(labels, n -> n <= dots + 1), n -> substring_index(host, '.', -n))")
    grid = grid.withColumn("prefixes", F.expr("transform(filter(lengths, n -> n <= length(path)), n -> substring(path, 1, n))"))
    hosts = grid.select("__url", "prefixes", F.explode(suffixes).alias("s"))
    parts = hosts.select("__url", "s", F.explode("prefixes").alias("p"))
    keyed = parts.withColumn("digest", F.sha2(F.concat(F.length("s").cast("string"), F.lit(":"), "s", "p"), 256))
    keyed = keyed.select("__url", "digest", F.substring("digest", 1, HASH_PREFIX).alias("prefix"))
    same = (F.col("prefix") == F.col("r_prefix")) & (F.col("digest") == F.col("r_digest"))
    if rules.count() <= BROADCAST_RULES:
        hits = keyed.join(F.broadcast(rules), same)
    else:
        keyed = materialize(keyed, "expressions")
        distinct = keyed.groupBy("prefix", "digest").agg(F.count(F.lit(1)).alias("n"))
        fits = materialize(distinct.join(rules, same).select("digest", "n", "rule", "r_host", "verdict"), "fits")
        hits = lookup_join(keyed.withColumn("spread", F.xxhash64("__url")), fits, ["digest"], "n", keyed.count(), "spread")
    best = hits.groupBy("__url").agg(F.max(F.struct(F.length("rule").alias("n"), "r_host", "verdict", "rule")).alias("best"))

    judged = urls.join(best, "__url", "left").select("__url", "__n", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    judged = materialize(judged, "urls")
    total = base.count()
    found = lookup_join(base.where("__url is not null"), judged, ["__url"], "__n", total, "__spread")
    missing = base.where("__url is null").select("page_id", F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return found.select("page_id", "host", "path", "rule", "verdict").unionByName(missing)


ORACLE = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS rn
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, parts.host, parts.path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND fits.rn = 1
"""
