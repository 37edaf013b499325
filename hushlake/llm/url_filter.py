"""URL filter: host-suffix and path-prefix expressions looked up by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower

#: The rules of the registered query: (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule string")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty without :// or for null."""
    after = F.substring_index(url, "://", 1)
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(after) + 4)).otherwise("")
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or end; empty without :// or for null."""
    after = F.substring_index(url, "://", 1)
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(after) + 4)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = 8, broadcast_rules: int = 100_000) -> DataFrame:
    """Judges each row's URL: id, host, path, rule, verdict.

    rules: (verdict 'allow' or 'block', rule host/path). A rule fits its host and all subdomains
    when the path starts with the rule's path; the longest rule wins, 'block' among equal ones;
    where none fits, rule is null and the verdict is ``default``.

    Distinct (host, path) pairs are expanded only into expressions of shapes (host labels, path
    length) that rules have, and equi-joined on the first ``prefix_hex`` digits of the SHA-256 of
    the expression; the full digest confirms. The rules are broadcast up to ``broadcast_rules``
    rows, else the join shuffles on the prefix. Null, empty or malformed URLs have host and path ''
    and the default verdict, and take no part in any join, however many they are; an empty rule fits nothing. Repeated rows are judged alike and all kept;
    empty tables give empty results.
    """
    host = F.substring_index("rule", "/", 1)
    rules = rules.select("verdict", "rule", F.sha2("rule", 256).alias("digest"), F.size(F.split(host, r"\.")).alias("labels"), (F.length("rule") - F.length(host)).alias("chars")).filter("rule is not null")
    shapes = sorted((r[0], r[1]) for r in rules.select("labels", "chars").distinct().collect())
    judged = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    names = F.split("host", r"\.")
    forms = [F.when((F.size(names) >= n) & (F.length("path") >= k), F.concat(F.array_join(F.slice(names, -n, n), "."), F.substring("path", 1, k))) for n, k in shapes]
    blank = (F.col("host") == "") & (F.col("path") == "")
    odd, judged = judged.filter(blank), judged.filter(~blank)
    distinct = judged.select("host", "path").distinct()
    asked = distinct.select("host", "path", F.explode(F.array_compact(F.array(*forms))).alias("expression")) if forms else distinct.select("host", "path", F.lit(None).cast("string").alias("expression"))
    asked = asked.select("host", "path", F.sha2("expression", 256).alias("asked")).withColumn("prefix", F.substring("asked", 1, prefix_hex))
    known = rules.select("verdict", "rule", "digest", F.substring("digest", 1, prefix_hex).alias("prefix"))
    if rules.count() <= broadcast_rules:
        known = F.broadcast(known)
    order = F.struct(F.length("rule"), F.col("verdict") == "block", "rule")
    found = asked.join(known, "prefix").filter("asked = digest").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("hit"))
    out = judged.join(found, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
    return out.union(odd.select("id", "host", "path", F.lit(None).cast("string"), F.lit(default)))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rule_table(spark, RULES))


OP9_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""
