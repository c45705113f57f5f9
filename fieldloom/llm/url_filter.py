"""URL filters by expressions and hash prefixes.

A rule is a host and a path prefix with a verdict.  Every URL is expanded into
the expressions (host suffix, path prefix) that a rule could have, each
expression is reduced to a 32-bit prefix of its SHA-256, an equi-join on the
prefixes finds candidates, and the full digest confirms them.  The rule with
the longest host, then the longest path, wins; among equals block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most (labels, path length) shapes that a rule table may have: both come from URLs, so both are short.
MAX_SHAPES = 20_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or the end, A-Z lower-cased) and path (then up to ? or #)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict.

    rules has host, path and verdict (allow or block).  A rule fits its host
    and all subdomains, where the URL's path starts with the rule's.  Every
    row is kept, repeated ones too.  A null URL, or one without ://, has an
    empty host and path; where no rule fits, rule is null and the verdict is
    default.  Columns of urls named host, path, rule or verdict are replaced.
    An empty rule table gives the default everywhere.

    The distinct (host, path) pairs are expanded, so a hot URL is judged once;
    Spark broadcasts the rules only where their size is under its threshold.
    """
    host, path = url_parts(F.col(url))
    urls = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path}) if url not in ("host", "path") else urls.withColumns({"host": host, "path": path})
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host is not null")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    labels = F.size(F.split("rule_host", r"\."))
    shapes = [tuple(r) for r in rules.select(labels, F.length("rule_path")).distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"the rules have over {MAX_SHAPES} shapes of labels and path length")
    keyed = rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("prefix", _prefix(F.col("digest")))

    pairs = urls.select("host", "path").distinct()
    n = F.size(F.split("host", r"\."))
    by_path: dict[int, list[int]] = {}
    for count, length in shapes:
        by_path.setdefault(length, []).append(count)
    options = [F.struct(F.lit(c).alias("labels"), F.lit(length).alias("chars")) for length, counts in sorted(by_path.items()) for c in sorted(counts)]
    if not options:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    fits = F.filter(F.array(*options), lambda o: (o.labels <= n) & (o.chars <= F.length("path")))
    made = pairs.select("host", "path", F.explode(fits).alias("o")).select("host", "path", F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("o.labels")).alias("suffix"), F.substr(F.col("path"), F.lit(1), F.col("o.chars")).alias("start"))
    made = made.withColumn("url_digest", _digest(F.col("suffix"), F.col("start"))).withColumn("prefix", _prefix(F.col("url_digest")))
    hits = made.join(keyed, "prefix").where("url_digest = digest")
    won = free_name(urls, "won")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.length("rule_host"), F.length("rule_path"))).alias(won))
    out = urls.join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.col(won)["rule"], "verdict": F.coalesce(F.col(won)["verdict"], F.lit(default))}).drop(won)
