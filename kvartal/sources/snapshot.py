"""Snapshot documents: raw JSON kept per element, so that a large document spreads out early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "schema_version string, scraped_at string, city string, institutions array<string>"
INSTITUTION = (
    "external_id string, name string, kind string, source_url string, "
    "address_entries array<string>, address string, district_code string, has_infant_group boolean"
)
ENTRY = "street string, number string"

# ISO-8601 with a mandatory zone.
ZONED_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})\z"


def zoned_timestamp(text: Column) -> Column:
    return F.when(text.rlike(ZONED_TIME), F.try_to_timestamp(text))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc`` (its path) and ``raw`` (its whole text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc"), F.col("value").alias("raw")
    )


def read_snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, each a document: ``doc`` (file and place) and ``raw``. Blank lines are none.

    The form for a snapshot too large for one task: its institutions are spread over lines that
    repeat the envelope, and Spark splits the file. ``doc`` sorts like the lines of a file. Write
    the rows before using them twice: the place is numbered while reading.
    """
    place = F.concat_ws(
        "-", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0"),
        F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0"),
    )
    lines = spark.read.text(path).select(place.alias("doc"), F.col("value").alias("raw"))
    return lines.where(F.trim("raw") != "")


def envelopes(docs: DataFrame) -> DataFrame:
    """``doc, schema_version, scraped_at, city`` of every document."""
    top = F.from_json("raw", ENVELOPE)
    return docs.select(
        "doc",
        top["schema_version"].try_cast("int").alias("schema_version"),
        zoned_timestamp(top["scraped_at"]).alias("scraped_at"),
        top["city"].alias("city"),
    )


def raw_institutions(docs: DataFrame) -> DataFrame:
    """One row per institution, still JSON text: ``doc, scraped_at, inst_pos, inst_raw``.

    Rows are spread by position before the costly parse, so one large document does not
    keep a single task busy.
    """
    top = F.from_json("raw", ENVELOPE)
    return (
        docs.select(
            "doc",
            zoned_timestamp(top["scraped_at"]).alias("scraped_at"),
            # Outer, since an inner explode brings a filter that parses the document again.
            F.posexplode_outer(top["institutions"]).alias("inst_pos", "inst_raw"),
        )
        .where(F.col("inst_pos").isNotNull())
        .repartition("doc", "inst_pos")
    )


def institutions(raw: DataFrame) -> DataFrame:
    """Typed institution rows, entries still JSON text."""
    row = F.from_json("inst_raw", INSTITUTION)
    return raw.select("doc", "scraped_at", "inst_pos", row.alias("_row")).select(
        "doc", "scraped_at", "inst_pos", "_row.*"
    )


def explode_entries(insts: DataFrame, carry: tuple[str, ...] = ("external_id", "kind")) -> DataFrame:
    """institution x address entry, institution key repeated, both positions kept.

    The entries of one large institution are spread by position as well.
    """
    return (
        insts.select(
            "doc", "inst_pos", *carry,
            F.posexplode_outer("address_entries").alias("entry_pos", "entry_raw"),
        )
        .where(F.col("entry_pos").isNotNull())
        .repartition("doc", "inst_pos", "entry_pos")
        .withColumn("_entry", F.from_json("entry_raw", ENTRY))
        .select(
            "doc", "inst_pos", "entry_pos", *carry,
            F.col("_entry.street").alias("street"), F.col("_entry.number").alias("number"),
        )
    )
