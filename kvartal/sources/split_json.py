"""One large JSON document read by many tasks.

The file is cut at every comma, so Spark splits it like a file of lines and no task sees the
whole document. A fragment does not know whether it starts inside a string, nor how deep: it
is read for both cases, each split adds up what its fragments do to the depth in both cases, and a
prefix over the splits (one row each) settles which case was the true one. The commas at depth 1
then end the document's members, those at depth 2 end the institutions, wherever the splits fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvartal.session import materialise

SEPARATOR = ","
MEMBER = "institutions"
# Name of a member, and the first character of its value.
NAME = r'^\s*\{?\s*"((?:[^"\\]|\\.)*+)"\s*:\s*(\S?)'
ROOT = r"^\s*\{"
BLANK, NULL = r"\A\s*\z", r"\A\s*null\s*\z"
# Members that every row of the result repeats.
ENVELOPE = ("schema_version", "scraped_at", "city")


def _count(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, split, place, text, and what the fragment does: ``quotes`` passed, and its change of depth
    if it starts outside a string (``out``) or inside one (``in``)."""
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"),
    )
    # Backslashes stand in strings only, and take the next character with them: the comma too.
    bare = F.regexp_replace(F.concat("text", F.lit(SEPARATOR)), r"(?s)\\.", "")
    parts = F.split(bare, '"', -1)

    def depth(odd: int) -> Column:
        outside = F.array_join(F.filter("_parts", lambda _, i: i % 2 == odd), "")
        return _count(outside, "[{") - _count(outside, "]}")

    return pieces.withColumn("_parts", parts).select(
        "file", "split", "place", "text", (F.size("_parts") - 1).cast("long").alias("quotes"),
        depth(0).cast("long").alias("out"), depth(1).cast("long").alias("in"),
    )


def _running(partition: list[str], order: str, upto: int) -> Window:
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)


def _sum(column: str, window: Window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _with_state(fragments: DataFrame) -> DataFrame:
    """Add ``inside`` (a string is open) and ``depth`` after each fragment's comma."""
    split = ["file", "split"]
    passed = _sum("quotes", _running(split, "place", -1)) % 2
    local = fragments.withColumn("_passed", passed)
    # Both cases: the split starts outside (0) or inside (1) a string.
    for case in (0, 1):
        local = local.withColumn(f"_change{case}", F.when(F.col("_passed") == case, F.col("out")).otherwise(F.col("in")))
    totals = local.groupBy(*split).agg(
        F.sum("quotes").alias("quotes"), *(F.sum(f"_change{case}").alias(f"_change{case}") for case in (0, 1))
    )
    before = _running(["file"], "split", -1)
    entries = totals.withColumn("_inside", _sum("quotes", before) % 2).withColumn(
        "_change", F.when(F.col("_inside") == 0, F.col("_change0")).otherwise(F.col("_change1"))
    )
    entries = entries.select(*split, "_inside", _sum("_change", before).alias("_depth"))
    change = F.when(F.col("_inside") == 0, F.col("_change0")).otherwise(F.col("_change1"))
    settled = local.join(entries, split).withColumn("_change", change)
    return settled.select(
        *split, "place", "text", ((F.col("_inside") + F.col("_passed") + F.col("quotes")) % 2).alias("inside"),
        (F.col("_depth") + _sum("_change", _running(split, "place", 0))).alias("depth"),
    )


def _parts(states: DataFrame) -> DataFrame:
    """file, member, part, text: the fragments between commas at depth 1 or 2, joined again.

    ``member`` and ``part`` count the commas of depth 1 and 2 before.
    """
    ends = states.withColumn("_m", ((F.col("inside") == 0) & (F.col("depth") == 1)).cast("long")).withColumn(
        "_p", ((F.col("inside") == 0) & (F.col("depth") == 2)).cast("long")
    )
    split = ["file", "split"]
    totals = ends.groupBy(*split).agg(F.sum("_m").alias("_m"), F.sum("_p").alias("_p"))
    before = _running(["file"], "split", -1)
    offsets = totals.select(*split, _sum("_m", before).alias("_m0"), _sum("_p", before).alias("_p0"))
    inside = _running(split, "place", -1)
    placed = ends.join(offsets, split).select(
        "file", "place", "split", "text", (F.col("_m0") + _sum("_m", inside)).alias("member"),
        (F.col("_p0") + _sum("_p", inside)).alias("part"),
    )
    return placed.groupBy("file", "member", "part").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("split", "place", "text"))), lambda f: f["text"]), SEPARATOR
        ).alias("text")
    )


def _envelopes(parts: DataFrame, members: DataFrame) -> DataFrame:
    """file, own, shared: the document without its institutions, and the members every row repeats."""
    listed = (F.col("name") == MEMBER) & (F.col("opens") == "[")
    # A listed member is told in short; the others keep their text, in any number of parts.
    short = members.where(listed).select("file", "member", F.lit(f'"{MEMBER}":[]').alias("text"), "name")
    others = (
        parts.join(members.where(~F.coalesce(listed, F.lit(False))).select("file", "member", "name", "last"), ["file", "member"])
        .groupBy("file", "member").agg(
            F.first("name").alias("name"), F.first("last").alias("last"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), SEPARATOR).alias("text"),
        )
    )
    text = F.when(F.col("member") == 0, F.regexp_replace("text", ROOT, "")).otherwise(F.col("text"))
    text = F.when(F.col("last"), F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    rows = others.select("file", "member", text.alias("text"), "name").unionByName(short)
    joined = lambda keep: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("member", "text")))), lambda m: m["text"]), SEPARATOR
    )
    return rows.groupBy("file").agg(
        F.concat(F.lit("{"), joined(F.lit(True)), F.lit("}")).alias("own"),
        joined(F.col("name").isin(*ENVELOPE)).alias("shared"),
    )


def read_snapshot_splits(spark: SparkSession, path: str) -> DataFrame:
    """``doc, raw`` like the lines of a snapshot: a row for each document itself, with an empty list of
    institutions, and one for each institution in the document's envelope.

    ``doc`` is the file and the institution's place (from 1), so it sorts like the document.
    Institutions come as the whole-file reader has them. A document that isn't valid JSON is one
    row that isn't either. A file holds one document; members of any other name stay in the
    document's own row. The rows of one institution meet in one task, never those of a document.
    """
    fragments = materialise(_fragments(spark, path), "json-fragments")
    states = materialise(_with_state(fragments), "json-states")
    parts = materialise(_parts(states), "json-parts")

    ends = states.groupBy("file").agg(
        F.max_by(F.struct("inside", "depth"), F.struct("split", "place")).alias("_end")
    )
    heads = parts.groupBy("file", "member").agg(
        F.min_by("text", "part").alias("_head"), F.min("part").alias("first"), F.max("part").alias("final")
    )
    name = F.regexp_extract("_head", NAME, 1)
    last = F.col("member") == F.max("member").over(Window.partitionBy("file"))
    members = heads.select(
        "file", "member", "first", "final", last.alias("last"),
        F.get(F.json_object_keys(F.concat(F.lit('{"'), name, F.lit('":0}'))), 0).alias("name"),
        F.regexp_extract("_head", NAME, 2).alias("opens"),
    )
    members = materialise(members, "json-members")  # a row per member of a document

    listed = members.where((F.col("name") == MEMBER) & (F.col("opens") == "["))
    # Of members with one name the last one counts, as for any reader.
    listed = listed.groupBy("file").agg(F.max_by(F.struct("member", "first", "final"), "member").alias("_m")).select("file", "_m.*")
    elements = parts.join(listed, ["file", "member"])
    text = F.when(F.col("part") == F.col("first"), F.regexp_replace("text", r"(?s)^[^\[]*\[", "")).otherwise(F.col("text"))
    text = F.when(F.col("part") == F.col("final"), F.regexp_replace(text, r"\][\s}]*$", "")).otherwise(text)
    elements = elements.select("file", "part", (F.col("part") - F.col("first") + 1).alias("place"), text.alias("text"))
    elements = elements.where((F.col("place") > 1) | ~F.col("text").rlike(BLANK))
    value = F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), 0)
    elements = elements.select("file", "place", "text", value.isNull().alias("_broken"))

    envelopes = _envelopes(parts, members).join(ends, "file")
    broken = elements.where(F.col("_broken") & ~F.col("text").rlike(NULL)).select("file").distinct().withColumn("_broken", F.lit(True))
    valid = (F.col("_end.inside") == 0) & (F.col("_end.depth") == 0) & F.col("_broken").isNull()
    valid = valid & F.json_object_keys("own").isNotNull()
    envelopes = materialise(
        envelopes.join(broken, "file", "left").select("file", "own", "shared", F.coalesce(valid, F.lit(False)).alias("valid")),
        "json-envelopes",
    )
    place = lambda n: F.concat_ws("-", "file", F.lpad(n.cast("string"), 19, "0")).alias("doc")
    itself = envelopes.select(place(F.lit(0)), F.when(F.col("valid"), F.col("own")).otherwise(F.lit("{")).alias("raw"))
    raw = F.concat(F.lit("{"), F.when(F.col("shared") != "", F.concat("shared", F.lit(","))).otherwise(F.lit("")), F.lit(f'"{MEMBER}":['), "text", F.lit("]}"))
    each = elements.join(envelopes.where("valid").select("file", "shared"), "file").select(place(F.col("place")), raw.alias("raw"))
    return itself.unionByName(each)
