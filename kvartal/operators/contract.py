"""Contract checks on snapshot documents: violations are rows, not exceptions.

Members are looked at as variants, so a number or ``null`` in place of a string is seen
as what it is. Nothing is coerced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.schemas import DISTRICT_CODES, KINDS, SCHEMA_VERSION
from kvartal.sources.snapshot import zoned_timestamp

# The members each level may hold.
ENVELOPE_KEYS = ("schema_version", "scraped_at", "city", "institutions")
INSTITUTION_KEYS = (
    "external_id", "name", "kind", "source_url", "address_entries", "address",
    "district_code", "has_infant_group",
)
ENTRY_KEYS = ("street", "number")
HTTPS_URL = r"(?i)^https://[^/\s?#]+[^\s]*\z"

ENVELOPE = (
    "schema_version variant, scraped_at variant, city variant, institutions array<string>"
)
VIOLATION = "struct<path:string,rule:string>"

Path = Callable[[str | Column], Column]


class UnsupportedVersion(ValueError):
    """A document states a schema version this library does not read."""


class ContractViolation(ValueError):
    """A document breaks the contract; nothing may be written."""


class _Member:
    """One JSON member: whether it is there, its JSON type and its text."""

    def __init__(self, key: str, path: Path):
        self.path = path(key)
        self.present = F.col(f"_{key}_present")
        self.value = F.col(f"_{key}")
        self.type = F.col(f"_{key}_type")
        self.text = F.col(f"_{key}_text")

    def broken(self, condition: Column, rule: str) -> Column:
        return F.when(condition, F.struct(self.path.alias("path"), F.lit(rule).alias("rule")))

    @property
    def null(self) -> Column:
        return self.type == "VOID"

    def required(self) -> Column:
        return self.broken(~self.present, "required")

    def typed(self, name: str) -> Column:
        return self.broken(self.present & (self.type != name), "type")

    def string(self) -> list[Column]:
        return [
            self.required(),
            self.typed("STRING"),
            self.broken((self.type == "STRING") & (self.text == ""), "empty"),
        ]

    def one_of(self, values: Sequence[str], optional: bool) -> Column:
        valid = (self.type == "STRING") & self.text.isin(*values)
        if optional:
            valid = valid | self.null
        return self.broken(self.present & ~valid, "enum")


def _with_members(rows: DataFrame, values: dict[str, Column], known: Sequence[str]) -> DataFrame:
    """The members of an object as columns, then their types and texts and which of the known ones
    are there, each evaluated once."""
    rows = rows.withColumns({f"_{key}": value for key, value in values.items()})
    members = {
        f"_{key}_{part}": column
        for key in values
        for part, column in (
            ("type", F.coalesce(F.schema_of_variant(f"_{key}"), F.lit("VOID"))),
            ("text", F.try_variant_get(f"_{key}", "$", "string")),
        )
    }
    return rows.withColumns(members | {f"_{key}_present": F.array_contains("keys", key) for key in known})


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def _found(at: Column, rule: str, rules: Sequence[Column], known: Sequence[str], path: Path) -> Column:
    """The rules that one object breaks, plus one per unknown member; only ``rule`` where it is no object at all.

    Whether there is any is asked first: that is compiled, the array with its lambdas is not.
    """
    whole = F.array(F.struct(at.alias("path"), F.lit(rule).alias("rule")))
    others = F.array_except("keys", F.array(*map(F.lit, known)))
    unknown = F.transform(others, lambda k: F.struct(path(k).alias("path"), F.lit("unknown_key").alias("rule")))
    broken = reduce(Column.__or__, (r.isNotNull() for r in rules), F.size(others) > 0)
    return (
        F.when(F.col("keys").isNull(), whole)
        .when(broken, F.concat(F.filter(F.array(*rules), lambda r: r.isNotNull()), F.coalesce(unknown, _none())))
        .otherwise(_none())
    )


def _below(at: Column) -> Path:
    def path(key: str | Column) -> Column:
        return F.concat(at, F.lit("."), F.lit(key) if isinstance(key, str) else key)

    return path


def _spread(rows: DataFrame, place: Sequence[str], index: str, parts: str) -> DataFrame:
    """One row for what was found in a row itself, and one for each of its parts, over the cluster.

    The row itself has index 0 and travels only if something was found; parts count from 1.
    Outer explode: for an inner one Spark adds a filter that evaluates the array twice.
    """
    kind = rows.schema[parts].dataType
    each = F.concat(F.array(F.lit(None).cast(kind.elementType)), F.coalesce(parts, F.array().cast(kind)))
    return (
        rows.select(*place, "found", F.posexplode_outer(each).alias(index, "raw"))
        .where((F.col(index) > 0) | (F.size("found") > 0))
        .select(*place, index, F.when(F.col(index) == 0, F.col("found")).otherwise(_none()).alias("found"), "raw")
        .repartition(*place, index)
    )


def _object(rows: DataFrame, value: Column, members: Sequence[str], known: Sequence[str]) -> DataFrame:
    """A variant as an object: ``keys`` (NULL if it is none), some members, and which known ones are there.

    Text with a repeated member, at any depth, is none.
    """
    parsed = rows.withColumn("_v", value).withColumn("_map", F.try_variant_get("_v", "$", "map<string,variant>"))
    return _with_members(
        parsed.withColumn("keys", F.map_keys("_map")),
        {key: F.try_element_at("_map", F.lit(key)) for key in members}, known,
    )


def _documents(docs: DataFrame, versions: bool) -> DataFrame:
    """``doc, found, institutions`` of every document, the latter still JSON text."""
    top = docs.select(
        "doc", F.json_object_keys("raw").alias("keys"), F.from_json("raw", ENVELOPE).alias("top")
    ).select("doc", "keys", "top.*")
    rows = _with_members(top, {key: F.col(key) for key in ENVELOPE_KEYS[:3]}, ENVELOPE_KEYS)

    def path(key: str | Column) -> Column:
        return F.lit(key) if isinstance(key, str) else key

    version, scraped, city = (_Member(key, path) for key in ENVELOPE_KEYS[:3])
    listed = F.col("_institutions_present")
    place = F.lit("institutions").alias("path")
    rules = [
        version.required(),
        scraped.required(),
        scraped.broken(
            scraped.present & ((scraped.type != "STRING") | zoned_timestamp(scraped.text).isNull()),
            "zoned_timestamp",
        ),
        *city.string(),
        F.when(~listed, F.struct(place, F.lit("required").alias("rule"))),
        F.when(listed & F.col("institutions").isNull(), F.struct(place, F.lit("type").alias("rule"))),
    ]
    if versions:
        rules.append(version.broken(version.present & ~_supported(version.value), "unsupported"))
    found = _found(F.lit("$"), "invalid_json", rules, ENVELOPE_KEYS, path)
    return rows.select("doc", "institutions", found.alias("found"))


def _institutions(rows: DataFrame) -> DataFrame:
    """``doc, i, found, entries``: the envelope's findings (i = 0) or those of institution i."""
    at = F.concat(F.lit("institutions["), (F.col("i") - 1).cast("string"), F.lit("]"))
    path = _below(at)
    m = {key: _Member(key, path) for key in INSTITUTION_KEYS}
    url, address, district = m["source_url"], m["address"], m["district_code"]
    listed = m["address_entries"]
    rules = [
        *m["external_id"].string(),
        *m["name"].string(),
        m["kind"].required(),
        m["kind"].one_of(KINDS, optional=False),
        url.required(),
        url.broken(url.present & ((url.type != "STRING") | ~url.text.rlike(HTTPS_URL)), "https_url"),
        listed.required(),
        listed.broken(listed.present & F.col("entries").isNull(), "type"),
        address.broken(~address.null & (address.type != "STRING"), "type"),
        address.broken((address.type == "STRING") & (address.text == ""), "empty"),
        district.one_of(DISTRICT_CODES, optional=True),
        m["has_infant_group"].required(),
        m["has_infant_group"].typed("BOOLEAN"),
        # The one rule across members.
        district.broken(
            (m["kind"].type == "STRING") & (m["kind"].text == "nursery") & district.null,
            "nursery_needs_district",
        ),
    ]
    # The list's type is that of no other member. Entries stay as parsed.
    scalars = [key for key in INSTITUTION_KEYS if key != "address_entries"]
    entries = F.try_variant_get(
        F.try_element_at("_map", F.lit("address_entries")), "$", "array<variant>"
    )
    parsed = _object(rows, F.try_parse_json("raw"), scalars, INSTITUTION_KEYS).withColumn("entries", entries)
    own = _found(at, "type", rules, INSTITUTION_KEYS, path)
    return parsed.select(
        "doc", "i", "entries", F.when(F.col("i") == 0, F.col("found")).otherwise(own).alias("found")
    )


def _entries(rows: DataFrame) -> DataFrame:
    """``doc, found``: what came with the row (j = 0) or the findings of entry j."""
    at = F.concat(
        F.lit("institutions["), (F.col("i") - 1).cast("string"), F.lit("].address_entries["),
        (F.col("j") - 1).cast("string"), F.lit("]"),
    )
    path = _below(at)
    rules = [rule for key in ENTRY_KEYS for rule in _Member(key, path).string()]
    own = _found(at, "type", rules, ENTRY_KEYS, path)
    return _object(rows, F.col("raw"), ENTRY_KEYS, ENTRY_KEYS).select(
        "doc", F.when(F.col("j") == 0, F.col("found")).otherwise(own).alias("found")
    )


def contract_violations(docs: DataFrame, versions: bool = False) -> DataFrame:
    """``doc, path, rule`` for every broken rule of every document (``doc, raw``).

    One pass: a document is cut into institutions, each parsed once where it arrives, and an institution
    into entries, and what was found further up travels along. With ``versions`` an
    unread schema version is a broken rule too.
    """
    institutions = _institutions(_spread(_documents(docs, versions), ["doc"], "i", "institutions"))
    found = _entries(_spread(institutions, ["doc", "i"], "j", "entries"))
    return (
        found.select("doc", F.explode_outer("found").alias("_f"))
        .where(F.col("_f").isNotNull())
        .select("doc", "_f.path", "_f.rule")
    )


def _supported(version: Column) -> Column:
    supported = (F.schema_of_variant(version) == "BIGINT") & (
        F.try_variant_get(version, "$", "bigint") == SCHEMA_VERSION
    )
    return F.coalesce(supported, F.lit(False))


def unsupported_versions(docs: DataFrame) -> DataFrame:
    """``doc, schema_version`` where the version is stated and is not the supported number."""
    version = F.from_json("raw", "schema_version variant")["schema_version"]
    stated = F.coalesce(F.array_contains(F.json_object_keys("raw"), "schema_version"), F.lit(False))
    return docs.where(stated & ~_supported(version)).select(
        "doc", F.to_json(version).alias("schema_version")
    )


def refused_documents(docs: DataFrame) -> DataFrame:
    """``doc`` of every document that may not be written: unread version or any violation."""
    return contract_violations(docs, versions=True).select("doc").distinct()


def require_valid(docs: DataFrame) -> None:
    """Stop before any write: first on an unread version, then on any violation."""
    for row in unsupported_versions(docs).limit(1).collect():
        raise UnsupportedVersion(f"{row.doc}: schema_version {row.schema_version}")
    for row in contract_violations(docs).limit(1).collect():
        raise ContractViolation(f"{row.doc}: {row.path}: {row.rule}")
