"""URL filter by host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that a rule for it could have: its host and the host's
parents, each with the prefixes of its path. The expressions meet the rules by an equi-join on a
short hash prefix; the full digests confirm. The longest expression that fits decides.

The path prefixes have the lengths that occur among the rules, so any rule path is possible and
not only whole folders. A host of very many labels makes as many expressions; nothing is cut off.

Rules are joined by size as Spark sees it, without a broadcast hint: a table of millions of rules is
shuffled by hash prefix. No prefix is hot on the rules' side, and rows that share one on the other
side are split by the join.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; a URL
without a rule is allowed. Of rules that are equally long, the longer host wins, then allow. Equal
rules count once. Repeated pages get equal results; each keeps its other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.ranking import aggregate_apart
from muster.llm.common import LOWER, UPPER, let

DEFAULT = "allow"
PREFIX_BITS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"^(?s).*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Distinct ``(host, path)`` structs of the host's suffixes and the path's prefixes."""
    def combine(labels: Column) -> Column:
        hosts = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
        sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
        return F.flatten(F.transform(hosts, lambda h: F.transform(
            sizes, lambda n: F.struct(h.alias("host"), F.substring(path, F.lit(1), n).alias("path")))))

    return let(F.split(host, r"\."), combine)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Every page with ``host``, ``path``, ``rule`` (host and path of the rule, or null) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). Own columns of the results'
    names are replaced.
    """
    rules = rules.where("host <> '' and path is not null and verdict in ('allow', 'block')").groupBy("host", "path").agg(
        F.min("verdict").alias("verdict"))  # allow before block
    # Distinct lengths only: at most as many as the longest rule path has characters.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = host_and_path(F.col(url))
    results = ["host", "path", "rule", "verdict"]
    others = [c for c in pages.columns if c not in results]
    # Repeated URLs are judged once.
    distinct = aggregate_apart(pages.select(F.coalesce(F.col(url), F.lit("")).alias("u")), ["u"], F.count(F.lit(1)).alias("n"))
    parsed = distinct.select("u", *[c.alias(n) for c, n in zip(host_and_path(F.col("u")), ("host", "path"))])
    spread = parsed.select("u", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
    digest = F.sha2(F.concat_ws("\n", "host", "path"), 256)
    listed = rules.select("host", "path", "verdict", digest.alias("digest"))
    listed = listed.withColumn("prefix", F.substring("digest", 1, PREFIX_BITS // 4))
    tried = spread.select("u", F.sha2(F.concat_ws("\n", "e.host", "e.path"), 256).alias("full"))
    tried = tried.withColumn("prefix", F.substring("full", 1, PREFIX_BITS // 4))
    fits = tried.join(listed, "prefix").where("full = digest")
    rank = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                    (F.col("verdict") == "allow").alias("first"))
    best = aggregate_apart(fits, ["u"], F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), rank).alias("best"))
    page = pages.select(F.struct(*others).alias("__page"), F.coalesce(F.col(url), F.lit("")).alias("u"),
                        host.alias("__host"), path.alias("__path"))
    return page.join(best, "u", "left").select(
        "__page.*", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))
