"""URL rules by a sort-merge range join, in DataFrame functions only.

A url becomes canonical keys: its host with the labels reversed and each ended by a dot (``net.example.``), then
its path; one key for the host and one for each parent domain, because a rule holds for all subdomains. A rule's
key is a prefix, so it covers the interval of keys from itself up to its successor. Prefix intervals are nested or
apart: sorted by their ends, the open ones form a stack. A rule's parent in the stack is the longest rule that is a prefix of it, found once on
the rules; opening an interval makes the rule the active one and closing it makes its parent the active one again.

Bounds and url keys are sorted together into ranges; within a range the last bound before a key tells the
active rule, and the last bound of each range is carried into the ranges after it. A busy host's keys lie in several ranges,
and equal keys, also those that many hosts have of a common parent, are swept as one and joined back by key.

Of all rules that fit the longest (host and path together) wins, then the longer host; of rules with the same host and path a
blocking one wins. Without a rule the verdict is ``allow``. Host and path of a null url or one without ``://`` are empty,
which no rule fits. Repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalspark.llm.arrow import ascii_lower
from evalspark.scratch import materialize

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(labels: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _utf8(text: Column) -> Column:
    """Text that sorts by its bytes in any engine."""
    return F.hex(F.encode(text, "UTF-8"))


def bounds(rules: DataFrame) -> DataFrame:
    """``key, closing, rule, verdict``: the active rule from each bound of an interval on."""
    named = rules.select(reversed_host(F.split(ascii_lower("host"), r"\.")).alias("h"), F.coalesce("path", F.lit("")).alias("p"),
                         ascii_lower("host").alias("host"), "verdict").filter("host is not null and host <> ''")
    one = named.groupBy("h", "p", "host").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v"))
    one = one.select("host", "p", _utf8(F.concat("h", F.lit("/"), "p")).alias("key"), F.concat("host", "p").alias("rule"),
                     F.col("v.verdict").alias("verdict"))
    # all prefixes of a rule's path are prefixes of its key; two characters stand for each byte
    at = F.explode(F.sequence(F.lit(0), F.octet_length("p") - 1)).alias("cut")
    shorter = one.filter("p <> ''").select("key", F.col("p"), at).select(
        F.col("key").alias("child"), F.expr("substring(key, 1, length(key) - 2 * (octet_length(p) - cut))").alias("key"))
    parent = (shorter.join(one.select("key", "host", "p", "rule", "verdict"), "key").groupBy("child")
              .agg(F.max_by(F.struct("host", "p", "rule", "verdict"), F.length("key")).alias("parent")))
    both = one.join(parent, one["key"] == parent["child"], "left")
    opened = both.select("key", F.lit(False).alias("closing"), F.length("key").alias("depth"), F.struct("host", "p", "rule", "verdict").alias("active"))
    closed = both.select(F.concat("key", F.lit("G")).alias("key"), F.lit(True).alias("closing"), F.length("key").alias("depth"),
                         F.col("parent").alias("active"))
    return opened.unionByName(closed)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages``."""
    urls = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    suffix = F.expr("transform(sequence(1, size(labels)), i -> slice(labels, i, size(labels)))")
    keys = (urls.filter("host <> ''").select("host", "path").distinct()
            .withColumn("labels", labels).select("host", "path", F.explode(suffix).alias("tail"))
            .select("host", "path", _utf8(F.concat(reversed_host(F.col("tail")), F.lit("/"), "path")).alias("key")))
    keys = materialize(keys, "url-parents")
    edges = bounds(rules)
    # at one key: intervals close before others open, inner ones first; then the urls come
    order = F.struct("key", F.when(F.col("closing"), 0).when(F.col("depth").isNotNull(), 1).otherwise(2).alias("kind"),
                     F.when(F.col("closing"), -F.col("depth")).otherwise(F.col("depth")).alias("depth"))
    line = edges.unionByName(keys.select("key").distinct(), allowMissingColumns=True).withColumn("at", order).drop("key", "closing", "depth")
    line = line.repartitionByRange("at").withColumn("part", F.spark_partition_id())
    line = materialize(line, "url-keys")
    edge = F.col("at.kind") < 2
    inside = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    swept = line.withColumn("last", F.last(F.when(edge, F.struct("active")), True).over(inside))
    # one row per range: what is active at its end if it has a bound, else what was before
    ends = line.filter(edge).groupBy("part").agg(F.max_by(F.struct("active"), "at").alias("end"))
    parts = line.select("part").distinct().join(ends, "part", "left")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("part", F.last("end", True).over(before).alias("carried"))
    met = (swept.filter("at.kind = 2").join(carried, "part").withColumn("active", F.coalesce("last", "carried")["active"])
           .filter("active is not null").select(F.col("at.key").alias("key"), "active"))
    size = F.struct(F.length("active.rule").alias("n"), F.length("active.host").alias("h"))
    # many hosts share a parent's key; each key has one verdict, and the join is one that AQE can split
    best = keys.join(met, "key").groupBy("host", "path").agg(F.max_by("active", size).alias("active"))
    return urls.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("active.rule").alias("rule"),
        F.coalesce("active.verdict", F.lit(default)).alias("verdict"))
