"""URL filters by host-suffix and path-prefix expressions.

Every distinct URL is expanded into the expressions (host suffix, path prefix) that a rule could
name, expressions meet rules in an equi-join on a short hash prefix, and a match counts only if the
full digests agree. The number of expressions per URL depends on the rules alone: suffixes with as
many labels as some rule's host has, prefixes as long as some rule's path is.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and gets
the default verdict. Of the rules that fit, the longest (host and path together) wins, then the
longer host, then block before allow; rules with a null host or path fit nothing, a null verdict
counts as block. Repeated URLs and pages are judged alike and each keeps its row. An empty table
gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faintline.llm.common import ascii_lower, table, without

DIGITS = 8  # of the hash prefix that is joined on: 32 bits
ADDED = ["host", "path", "rule", "verdict"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from there up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(ascii_lower(host), empty), F.coalesce(path, empty)


def _digest(host: Column, path: Column) -> Column:
    # a host has no slash, so the parts cannot run into each other
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def prepare_rules(rules: DataFrame) -> DataFrame:
    """``short, digest, precedence``: one row per (host, path); precedence holds both lengths and the verdict."""
    host, path = ascii_lower(F.col("host")), F.col("path")
    block = F.when(F.lower(F.col("verdict")) == "allow", 0).otherwise(1).cast("long")
    total = (F.length(host) + F.length(path)).cast("long")
    return (
        rules.select(_digest(host, path).alias("digest"), (F.shiftleft(total, 32) + F.length(host) * 2 + block).alias("precedence"))
        .filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.max("precedence").alias("precedence"))
        .withColumn("short", F.substring("digest", 1, DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Pages with ``host, path, rule, verdict``. ``rules``: host, path, verdict (allow or block)."""
    named = rules.filter("host is not null and path is not null")
    # the distinct label counts and path lengths: bounded by the longest rule, not by their number
    counts, lengths = named.agg(
        F.sort_array(F.collect_set(_labels(F.col("host")))), F.sort_array(F.collect_set(F.length("path")))
    ).first()
    address = F.col(f"`{url}`") if url in pages.columns else F.col(url)
    host, path = host_and_path(address)
    matched = None
    if counts:
        urls = pages.select(address.alias("__llm_url")).filter("__llm_url is not null").distinct()
        own_host, own_path = host_and_path(F.col("__llm_url"))
        parts = urls.select("__llm_url", own_host.alias("h"), own_path.alias("p")).filter("h != ''")
        suffixes = F.transform(
            F.filter(F.array(*[F.lit(n) for n in counts]), lambda n: n <= _labels(F.col("h"))),
            lambda n: F.call_function("substring_index", F.col("h"), F.lit("."), -n),
        )
        prefixes = F.transform(
            F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("p")),
            lambda n: F.substring(F.col("p"), 1, n),
        )
        digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
        probes = parts.select("__llm_url", F.explode(digests).alias("probe")).withColumn("short", F.substring("probe", 1, DIGITS))
        matched = (
            probes.join(prepare_rules(named), "short")
            .filter(F.col("probe") == F.col("digest"))
            .groupBy("__llm_url")
            .agg(F.max("precedence").alias("__llm_best"))
            .withColumn("__llm_check", F.crc32(F.col("__llm_url").cast("binary")))
        )
    rows = without(pages, [c for c in ADDED if c != url])
    rows = rows.select("*", address.alias("__llm_own"), F.crc32(address.cast("binary")).alias("__llm_own_check"))
    if matched is None:
        judged = rows.withColumn("__llm_best", F.lit(None).cast("long"))
    else:
        # two keys, so that both sides are dealt for this join and a very common URL can be split
        judged = rows.join(
            matched,
            (F.col("__llm_own_check") == F.col("__llm_check")) & (F.col("__llm_own") == F.col("__llm_url")),
            "left",
        ).drop("__llm_url", "__llm_check")
    best = F.col("__llm_best")
    low = best % (1 << 32)
    host_length = F.floor(low / 2).cast("int")
    path_length = (F.shiftright(best, 32) - host_length).cast("int")
    own = F.col("__llm_own")
    host, path = host_and_path(own)
    rule = F.concat(F.substring(host, F.length(host) - host_length + 1, host_length), F.substring(path, F.lit(1), path_length))
    verdict = F.when(best.isNull(), F.lit(default)).when(low % 2 == 1, F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumns({"host": host, "path": path, "rule": F.when(best.isNotNull(), rule), "verdict": verdict}).drop(
        "__llm_best", "__llm_own", "__llm_own_check"
    )


RULES = "SELECT * FROM VALUES ('org','/','allow'),('example.org','/es/','block'),('example.org','/en/1','block'),('com','/fr/','allow'),('com','/de/','block') AS rules(host, path, verdict)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ["page_id", "url"])
    return judge_urls(pages, spark.sql(RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org','/','allow'),('example.org','/es/','block'),('example.org','/en/1','block'),('com','/fr/','allow'),('com','/de/','block')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS n,
  translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.n, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.k = 1
"""
