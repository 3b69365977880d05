"""URL filters as a sort-merge range join of nested rules.

Keys put the host's labels in reverse order, each closed by a zero byte: `com.example.www.`.  A
host and all its subdomains are then one interval of keys, and so are the paths below a prefix of
one host.  Intervals of prefixes are nested or apart, never crossed.  `sweep` sorts points and the
ends of intervals together and carries along, at each end, the stack of rules that are open from
there on; a point takes the last stack before it.

Hosts are swept first (the stack is the chain of open hosts, at most one per label), then
(open host, path) pairs, where the top of the stack is the longest path prefix.  The work is cut
into slices of equal size by a range partitioning; one row per slice carries the stack across.
Only distinct (host, path) pairs are swept, so a hot URL is one row.

Defined cases: a null URL or one without `://` has empty host and path; an empty rule host fits every
host; a null rule host or path counts as empty; of rules alike in host and path `block` wins; the
longest rule (host and path together, then host) decides, and without a rule the default does;
repeated rows and null page_ids keep their rows; empty tables work; columns of any other name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.session import cut_lineage

TOP = "FF"  # a byte above every byte of UTF-8


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(url, parts, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, parts, 2)


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a zero byte; empty for an empty host."""
    closed = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\0"), F.lit("\0"))
    return F.when(host == "", F.lit("")).otherwise(closed).cast("binary")


def path_key(host: Column, path: Column) -> Column:
    return F.concat(F.concat(host, F.lit("\0")).cast("binary"), path.cast("binary"))


def sweep(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (key, ...) with the stack of the last mark (key, stack) at or before each; null before the first."""
    both = points.withColumns({"is_point": F.lit(1), "stack": F.lit(None).cast(marks.schema["stack"].dataType)}).unionByName(
        marks.select("key", "stack").withColumn("is_point", F.lit(0)), allowMissingColumns=True
    )
    cut = cut_lineage(both.repartitionByRange("key", "is_point").withColumn("slice", F.spark_partition_id()), "sweep")
    # what is open where a slice begins: one row per slice
    ends = cut.filter("is_point = 0").groupBy("slice").agg(F.max(F.struct("key", "stack")).alias("last"))
    opened = (
        cut.select("slice").distinct().join(ends, "slice", "left")
        .select("slice", F.last("last", ignorenulls=True).over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    )
    here = Window.partitionBy("slice").orderBy("key", "is_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.withColumn("open", F.last("stack", ignorenulls=True).over(here)).filter("is_point = 1")
        .join(opened, "slice").withColumn("stack", F.coalesce("open", "before.stack")).drop("is_point", "slice", "open", "before")
    )


def host_marks(rules: DataFrame) -> DataFrame:
    """Where a rule host's interval begins and ends, and the rule hosts open from there on (outermost first)."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.")
    # all suffixes of a host that are rule hosts themselves, shortest first
    outer = (
        hosts.select("host", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))))).alias("outer"))
        .join(hosts.select(F.col("host").alias("outer")), "outer")
        .groupBy("host").agg(F.sort_array(F.collect_set(F.struct(F.length("outer").alias("n"), "outer"))).alias("chain"))
        .select("host", F.transform("chain", lambda c: c["outer"]).alias("chain"))
    )
    key = host_key(F.col("host"))
    return outer.select(key.alias("key"), F.col("chain").alias("stack")).union(
        outer.select(F.concat(key, F.unhex(F.lit(TOP))), F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0))))
    )


def path_marks(rules: DataFrame) -> DataFrame:
    """The same for path prefixes below one rule host; only the longest open prefix is carried."""
    paths = rules.select("host", "path").distinct()
    outer = (
        paths.filter("path != ''")
        .select("host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substr(F.col("path"), F.lit(1), n))).alias("outer"))
        .join(paths.select("host", F.col("path").alias("outer")), ["host", "outer"])
        .groupBy("host", "path").agg(F.max_by("outer", F.length("outer")).alias("outer"))
    )
    key = path_key(F.col("host"), F.col("path"))
    kind = "array<string>"
    return paths.select(key.alias("key"), F.array("path").alias("stack")).union(
        paths.join(outer, ["host", "path"], "left")
        .select(F.concat(key, F.unhex(F.lit(TOP))), F.when(F.col("outer").isNull(), F.array().cast(kind)).otherwise(F.array("outer")))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict; pages: page_id, url; rules: host, path, verdict."""
    rules = (
        rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is after allow
    )
    host, path = host_and_path(F.col("url"))
    asked = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    distinct = cut_lineage(asked.select("host", "path").distinct(), "urls")

    hosts = distinct.select("host").distinct().select("host", host_key(F.col("host")).alias("key"))
    open_hosts = sweep(hosts, host_marks(rules)).select("host", F.explode("stack").alias("rule_host"))
    pairs = distinct.join(open_hosts, "host").select("host", "path", "rule_host", path_key(F.col("rule_host"), F.col("path")).alias("key"))
    fits = (
        sweep(pairs, path_marks(rules)).select("host", "path", "rule_host", F.explode("stack").alias("rule_path"))
        # an open prefix of another host may reach here only by an odd byte; the texts decide
        .filter(F.expr("startswith(path, rule_path) AND (rule_host = '' OR host = rule_host OR endswith(host, concat('.', rule_host)))"))
        .join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"), ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"),
            F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict"))).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return asked.join(fits, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
