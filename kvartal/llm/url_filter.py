"""Url verdicts by a sort-merge range join of canonical keys with nested rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvartal.llm.common import lower_ascii, over_parts, placed
from kvartal.operators.joins import lookup_join

RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT = "allow"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lowered) and path up to ``?`` or ``#``; else both empty."""
    after = F.when(
        F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")
    ).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return (
        lower_ascii(F.regexp_extract(after, "^[^/?#]*", 0)),
        F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1),
    )


def canonical(host: Column) -> Column:
    """Labels in reverse, each closed by a dot: a host and its subdomains share a prefix.

    The keys with prefix ``net.`` are exactly those from ``net.`` up to ``net/``, the
    character after the dot.
    """
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """Where the stack of active rules changes: _key, and the stack from there on.

    A rule's host opens at its key and closes at the key's successor. The stack of a host
    holds the rules of all hosts above it, found by an equi-join on its label prefixes.
    """
    hosts = rules.select(canonical(lower_ascii("host")).alias("_key"), "host", "path", "verdict").distinct()
    keys = hosts.select("_key").distinct()
    labels = F.split(F.expr("left(_key, length(_key) - 1)"), "\\.", -1)
    above = keys.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(labels)))).select(
        F.col("_key").alias("_of"),
        F.concat(F.array_join(F.slice(labels, 1, F.col("_n")), "."), F.lit(".")).alias("_key"),
    )
    stacks = above.join(hosts, "_key").groupBy("_of").agg(
        F.collect_list(F.struct("host", "path", "verdict")).alias("_open"),
        F.collect_list(F.when(F.col("_key") != F.col("_of"), F.struct("host", "path", "verdict"))).alias("_closed"),
    )
    closing = F.concat(F.expr("left(_of, length(_of) - 1)"), F.lit("/"))
    return stacks.select(F.col("_of").alias("_key"), F.col("_open").alias("_stack")).unionByName(
        stacks.select(closing.alias("_key"), F.col("_closed").alias("_stack"))
    )


def sweep(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host -> stack of the rules whose interval it lies in, by one sweep over the sorted keys.

    Each partition of the range sort starts with the stack that the last change before it
    left; that carry is one row per partition.
    """
    events = rule_events(rules)
    empty = F.lit(None).cast(events.schema["_stack"].dataType)
    rows = placed(
        events.select("_key", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("host"), "_stack")
        .unionByName(hosts.select(canonical(F.col("host")).alias("_key"), F.lit(1).alias("_kind"), "host", empty.alias("_stack"))),
        ["_key", "_kind"],
        "url-sweep",
    )
    last, before = over_parts(
        rows.groupBy("_part").agg(
            F.max_by("_stack", F.when(F.col("_kind") == 0, F.col("_row"))).alias("_left")
        )
    )
    opening = last.select("_part", F.last("_left", ignorenulls=True).over(before).alias("_opening"))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(F.broadcast(opening), "_part")  # one row per partition
        .withColumn("_active", F.coalesce(F.last("_stack", ignorenulls=True).over(inside), "_opening"))
        .where("_kind = 1").select("host", F.col("_active").alias("_rules"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Verdict of every page: page_id, host, path, rule, verdict.

    A rule fits its host and the subdomains if the path starts with its path; the longest one
    (host and path together, then host) wins; of equal ones an allowing one. No rule: rule
    is null and the verdict is ``default``. A null url, or one without ``://``, has an empty host
    and path. Rows with the same id are judged apart; an empty table gives no rows.
    Only page_id and url are read. A host's pages may be any share of all: the hosts
    are reduced to one row each before the sweep, and the join back is one Spark can split.
    """
    slim = pages.select("page_id", F.col("url").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    split = slim.select("page_id", host.alias("host"), path.alias("path"))
    active = sweep(split.select("host").distinct(), rules)
    fitting = F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(
        F.transform(
            fitting,
            lambda r: F.struct(
                (F.length(r["host"]) + F.length(r["path"])).alias("size"),
                F.length(r["host"]).alias("host_size"),
                F.when(r["verdict"] == "allow", 1).otherwise(0).alias("order"),
                F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"),
            ),
        )
    )
    return (
        lookup_join(split, active, ["host"])
        .withColumn("_best", best)
        .select(
            "page_id", "host", "path", F.col("_best.rule").alias("rule"),
            F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        )
    )
