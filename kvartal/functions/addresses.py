"""Expressions for house numbers, street strings and one-line addresses.

Each rule set is a chain of columns, one ``dict`` per step. Steps are added one after the
other: a step used several times is then evaluated once per row, not once per use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.functions.text import WS, alternatives, lstrip, search_key
from kvartal.schemas import LOCALITY_PREFIXES, PREFIX_CODES

# The house-number shape and the street-type markers.
HOUSE_NUMBER = rf"^([0-9]+)([А-Я])?(?:{WS}+вх\.([А-Я]|[0-9]{{1,4}}))?\n?\z"
TYPE_MARKERS = ("УЛ.", "БУЛ.", "ПЛ.", "Ж.К.", "КВ.")

# Groups of one match, joined by a character that no accepted text holds.
_SEP = "\uffff"
_NUMBER_GROUPS = f"{_SEP}$1{_SEP}$2{_SEP}$3"


def add_steps(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    for step in steps:
        df = df.withColumns(step)
    return df


def house_number_steps(text: Column) -> tuple[dict[str, Column], ...]:
    """Steps to ``number_int, number_suffix, entrance`` and ``_number_reason``.

    The reason is NULL when accepted, else ``unparseable`` or ``out_of_range``.
    """
    clean = F.translate(text, _SEP, "x")  # not a digit, so still rejected
    parts = F.col("_parts")
    accepted = F.col("number_int").isNotNull()
    return (
        {"_parts": F.split(F.regexp_replace(clean, HOUSE_NUMBER, _NUMBER_GROUPS), _SEP)},
        {"number_int": F.get(parts, 1).try_cast("smallint")},
        {
            "number_suffix": F.when(accepted, F.nullif(F.get(parts, 2), F.lit(""))),
            "entrance": F.when(accepted, F.nullif(F.get(parts, 3), F.lit(""))),
            "_number_reason": F.when(
                ~accepted, F.when(F.size(parts) > 1, "out_of_range").otherwise("unparseable")
            ),
        },
    )


def street_steps(
    text: Column, localities: Sequence[str] = LOCALITY_PREFIXES
) -> tuple[dict[str, Column], ...]:
    """Steps to ``city, type_marker, street_part, search_norm, raw_name``; all NULL if rejected.

    The locality is a whole prefix: the text ends there, or a space follows. A street without
    a type marker is a locality of its own: its whole text is the city.
    """
    # One use of the text: a filter on the outcome copies this step into its condition.
    base = F.nullif(
        F.regexp_extract(text, rf"^({alternatives(localities)})(?: |\z)", 1), F.lit("")
    )
    known, marked = F.col("_base").isNotNull(), F.col("type_marker").isNotNull()
    rest = F.col("_rest")
    marker = F.coalesce(*(F.when(rest.startswith(m), F.lit(m)) for m in TYPE_MARKERS))
    return (
        {"_base": base},
        {"_rest": lstrip(F.substring(text, F.length("_base") + 1, F.length(text)))},
        {"type_marker": marker},
        {
            "city": F.when(marked, F.col("_base")).when(known, text),
            "street_part": F.when(
                marked, lstrip(F.substring(rest, F.length("type_marker") + 1, F.length(rest)))
            ).when(known, ""),
            "search_norm": F.when(known, search_key(text)),
            "raw_name": F.when(known, text),
        },
    )


STREET_TEMPS = ("_base", "_rest")
NUMBER_TEMPS = ("_parts", "_number_reason")


def last_word_steps(text: Column) -> tuple[dict[str, Column], ...]:
    """Steps to ``_head, _tail``, cut at the last space; both NULL without a space."""
    found = text.contains(" ")
    return (
        {"_tail": F.when(found, F.substring_index(text, " ", -1))},
        {"_head": F.substring(text, F.lit(1), F.length(text) - F.length("_tail") - 1)},
    )


def code_by_prefix(text: Column, prefixes: Sequence[tuple[str, str]] = PREFIX_CODES) -> Column:
    """Code of the first ``(prefix, code)`` the text starts with, else NULL."""
    return F.coalesce(*(F.when(text.startswith(prefix), F.lit(code)) for prefix, code in prefixes))


def address_label(street: Column, number: Column, suffix: Column, entrance: Column) -> Column:
    """One-line label: street, number with suffix, and the entrance if there is one."""
    return F.concat(
        street, F.lit(" "), number.cast("string"), F.coalesce(suffix, F.lit("")),
        F.coalesce(F.concat(F.lit(" вх."), F.nullif(entrance, F.lit(""))), F.lit("")),
    )
