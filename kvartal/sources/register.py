"""The address register: a windows-1251 report of fixed-width lines.

The report is read as a splittable text source. Its lines are classified one by one; the
section header and the street a line belongs to are carried down the file by
``carry_forward``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.functions.text import WS, WS_CHARS, lstrip, search_key, strip
from kvartal.operators.carry import CHUNK_BITS, carry_forward
from kvartal.schemas import DISTRICT_CODES, MAX_LENGTHS
from kvartal.session import materialise

CHARSET = "cp1251"
_HIGH_BYTES = bytes(b for b in range(0x80, 0x100) if b != 0x98)
LATIN_1 = _HIGH_BYTES.decode("latin-1")
CYRILLIC = _HIGH_BYTES.decode(CHARSET)
UNDEFINED = "\x98"  # the one byte the charset leaves undefined

# The report's line shapes.
NUMBER_COLUMN = 38
TITLE_WORD = "код"
COLUMN_TITLES = rf"(?iu)^{WS}*код{WS}+име{WS}"
PAGE_TITLE = "КЛАСИФИКАТОР"
PAGE_DATE = r"^\d{2}\.\d{2}\.\d{4}\z"
PAGE_DATE_LENGTH = 10
HEADER_WORD = "секция"
HEADER = (
    rf"(?isu)област{WS}+(\d{{2}}){WS}+(\S.*?\S){WS}+община{WS}+(\d{{2}}){WS}+(\S.*?\S){WS}+"
    rf"район{WS}+(\d{{2}})_(\S.*?\S){WS}+(\d{{4,6}}){WS}+(\S.*?\S){WS}+секция{WS}+(\d+){WS}*\z"
)
FIELD_SEP = "\uffff"  # outside the charset, so never inside a line
HEADER_FIELDS = FIELD_SEP.join(("$5", "$6", "$7", "$8", "$9"))
DATA_CODE = rf"^{WS}+(\d{{4,6}}){WS}+"
_CELL = rf"\d+[А-Я]?(?:{WS}+[А-Я0-9]+)?"
CELL_LIST = rf"^{WS}*{_CELL}{WS}*(?:,{WS}*{_CELL}{WS}*)*,?\z"
INNER_BREAK = r"[\x0b\x0c\x1c-\x1e]"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Decoded lines: ``file, block, place, sub, line``.

    Bytes are read one to one as ISO-8859-1, by the one text reader that both splits large
    files and takes a charset, and then mapped to the report's charset. ``block`` is the
    split's offset in the file, ``place`` the row's place in its task, ``sub`` the piece
    after breaks the reader does not know. An undefined byte fails the read.
    """
    raw = (
        spark.read.schema("text string")
        .options(
            encoding="ISO-8859-1", sep="\uffff", quote="", escape="", comment="",
            maxCharsPerColumn="-1",
        )
        .csv(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            "text",
        )
    )
    decoded = F.when(
        F.col("text").contains(UNDEFINED),
        F.raise_error(F.concat(F.lit("not a windows-1251 file: "), F.col("file"))),
    ).otherwise(F.translate("text", LATIN_1, CYRILLIC))
    return raw.select(
        "file", "block", "place",
        F.posexplode_outer(F.split(decoded, INNER_BREAK)).alias("sub", "line"),
    )


def write_report(lines: DataFrame, path: str) -> None:
    """Write the column ``line`` as a report in the register's charset, in the given order."""
    lines.select(F.translate("line", CYRILLIC, LATIN_1).alias("text")).write.options(
        encoding="ISO-8859-1", sep="\uffff", quote="", escape="", emptyValue="",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)


def normal_code(code: Column) -> Column:
    """Five digits: the last five, or padded with zeros."""
    return F.lpad(F.right(code, F.lit(5)), 5, "0")


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add ``header``, ``street`` and ``cells`` (NULL unless the line is of that class).

    Each step is a column of its own: Spark then evaluates every pattern once per line.
    """
    line, text, lower = F.col("line"), F.col("_text"), F.col("_lower")
    steps = lines.withColumns({"_text": strip(line), "_lower": F.lower(line)})
    # Plain tests come first: the patterns are dear, and the lines they look for are rare.
    furniture = (
        (text == "")
        | (text.startswith("-") & (F.translate(text, "-" + WS_CHARS, "") == ""))
        | (lower.contains(TITLE_WORD) & line.rlike(COLUMN_TITLES))
        | line.contains(PAGE_TITLE)
        | ((F.length(text) == PAGE_DATE_LENGTH) & text.rlike(PAGE_DATE))
    )
    is_header = lower.contains(HEADER_WORD) & line.rlike(HEADER)
    steps = steps.withColumn(
        "_class", F.when(furniture, "furniture").when(is_header, "header")
    ).withColumn(
        "_code",
        F.when(
            F.col("_class").isNull() & F.substring(text, 1, 1).between("0", "9"),
            F.regexp_extract(line, DATA_CODE, 0),
        ),
    )
    width = F.length("_code")
    name_width = F.greatest(F.lit(NUMBER_COLUMN) - width, F.lit(0))
    steps = steps.withColumns({
        "_name": F.when(width > 0, strip(F.substring(line, width + 1, name_width))),
        "_numbers": F.when(
            (width > 0) | line.startswith(" " * NUMBER_COLUMN),
            strip(F.substring(line, NUMBER_COLUMN + 1, 1 << 30)),
        ),
    })
    listed = F.col("_numbers").rlike(CELL_LIST)
    steps = steps.withColumn(
        "_class",
        F.when(F.col("_class").isNotNull(), F.col("_class"))
        .when((F.col("_name") != "") & listed, "street")
        .when(line.startswith(" " * NUMBER_COLUMN) & listed, "more"),
    )
    fields = F.split(F.regexp_replace(line, f"(?s)^.*?{HEADER}", HEADER_FIELDS), FIELD_SEP)
    steps = steps.withColumn("_fields", F.when(F.col("_class") == "header", fields))
    field = F.col("_fields")
    header = F.struct(
        field[0].alias("district_code"), strip(field[1]).alias("district_name"),
        normal_code(field[2]).alias("settlement_code"),
        strip(field[3]).alias("settlement_name"), field[4].alias("section_no"),
        search_key(strip(field[3])).alias("settlement_key"),
    )
    # A key goes letter by letter, so both halves are made here, once a header and once a street.
    street = F.struct(
        normal_code(strip(F.col("_code"))).alias("street_code"),
        F.col("_name").alias("street_raw"), search_key(F.col("_name")).alias("street_key"),
    )
    return steps.select(
        *lines.columns,
        F.when(F.col("_class") == "header", header).alias("header"),
        F.when(F.col("_class") == "street", street).alias("street"),
        F.when(F.col("_class").isin("street", "more"), F.col("_numbers")).alias("cells"),
    )


def cell_parts(rows: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """Digits, suffix and entrance of ``_cell``, a stripped cell of a line that CELL_LIST has passed.

    Such a cell needs no pattern of its own: digits, at most one capital, and behind white space the rest.
    """
    rows = rows.withColumn("_rest", F.ltrim("_cell", F.lit("0123456789")))
    digits = F.substring("_cell", F.lit(1), F.length("_cell") - F.length("_rest"))
    first = F.substring("_rest", 1, 1)
    suffix = F.when(first.between("А", "Я"), first).otherwise("")
    return rows, digits, suffix, lstrip(F.when(suffix == "", F.col("_rest")).otherwise(F.substring("_rest", 2, 1 << 30)))


def parse_report(
    lines: DataFrame, file: str = "file", place: tuple[str, ...] = ("block", "place", "sub")
) -> DataFrame:
    """Register rows of the report, with the place of their line and ``reject_reason``.

    A header starts a section and ends the current street. A line of numbers below a street
    belongs to it; a malformed street line does not end it. Numbers before the first header,
    or before the first street of a section, are dropped. ``reject_reason`` is
    ``out_of_range`` for values the register cannot hold, else NULL.
    """
    *outer, row_no = place[:-1] if len(place) > 1 else place
    # Written once: every later pass reads the same lines with the same places, without their
    # text. Other lines go only now: earlier, the filter would be pushed below the staged
    # columns of classify_lines and evaluate all of their patterns anew.
    classified = materialise(
        classify_lines(lines).select(file, *place, "header", "street", "cells"), "report-lines"
    )
    known = (
        classified.where("header IS NOT NULL OR street IS NOT NULL OR cells IS NOT NULL")
        .withColumn("_chunk", F.shiftright(F.col(row_no).cast("long"), CHUNK_BITS))
        .withColumnsRenamed({"header": "_header", "street": "_street"})
    )
    at = F.struct(*place)
    carried = carry_forward(
        known,
        file, place, (*outer, "_chunk"),
        {
            "section": F.when(F.col("_header").isNotNull(), F.struct("_header.*", at.alias("at"))),
            "current": F.when(F.col("_street").isNotNull(), F.struct("_street.*", at.alias("at"))),
        },
    )
    inside = carried.where(
        F.col("cells").isNotNull() & (F.col("current.at") > F.col("section.at"))
    )
    cell = F.explode_outer(F.split("cells", ",")).alias("_cell")
    norm = F.concat("section.settlement_key", F.lit(" "), "current.street_key")
    rows = (
        inside.select(
            file, *place, "section", F.col("current.street_code").alias("street_code"),
            F.col("current.street_raw").alias("street_raw"), norm.alias("search_norm"), cell,
        )
        .withColumn("_cell", strip(F.col("_cell")))
        .where(F.col("_cell") != "")
    )
    rows, digits, suffix, entrance = cell_parts(rows)
    number = digits.try_cast("smallint")
    section_no = F.col("section.section_no").try_cast("smallint")
    too_wide = number.isNull() | section_no.isNull() | (
        F.length(entrance) > MAX_LENGTHS["register"]["entrance"]
    )
    return rows.select(
        file, *place, "street_code", "street_raw", "search_norm", number.alias("number_int"),
        suffix.alias("number_suffix"), entrance.alias("entrance"),
        F.col("section.district_code").alias("district_code"),
        F.col("section.district_name").alias("district_name"),
        F.col("section.settlement_code").alias("settlement_code"),
        section_no.alias("section_no"),
        F.when(too_wide, "out_of_range").alias("reject_reason"),
    )


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Report file to register rows with ``reject_reason``."""
    return parse_report(read_report(spark, path))


def checked(rows: DataFrame) -> DataFrame:
    """Give a reason to rows the register's other columns cannot hold: district, or a name's width."""
    widths = MAX_LENGTHS["register"]
    too_long = F.lit(False)
    for column in ("district_name", "street_raw", "search_norm"):
        if column in widths:
            too_long = too_long | F.coalesce(F.length(column) > widths[column], F.lit(False))
    known = F.coalesce(F.col("district_code").isin(*DISTRICT_CODES), F.lit(False))
    return rows.withColumn(
        "reject_reason",
        F.coalesce(
            "reject_reason", F.when(~known, "unknown_district"), F.when(too_long, "too_long")
        ),
    )


def load_summary(register: DataFrame) -> DataFrame:
    """One row: ``rows_loaded, streets_parsed``."""
    return register.agg(
        F.count("*").alias("rows_loaded"),
        F.count_distinct("street_code").alias("streets_parsed"),
    )
