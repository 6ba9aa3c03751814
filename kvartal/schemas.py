"""Table schemas, closed value sets and the settlement dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Closed sets of the data model.
KINDS = ("nursery", "kindergarten", "preschool")
DISTRICT_CODES = ("01", "02", "03", "04", "05")
LOCALITY_TYPES = ("city", "village")
SCHEMA_VERSION = 2
CITY_CODE = "10135"

# Fixed values: (code, name, locality type, raw-name prefixes), in matching order.
SETTLEMENTS = (
    ("10135", "ГР.ВАРНА", "city", ("ГР.ВАРНА", "ГР. ВАРНА")),
    ("35701", "С.КАМЕНАР", "village", ("С.КАМЕНАР", "С. КАМЕНАР")),
    ("72709", "С.ТОПОЛИ", "village", ("С.ТОПОЛИ", "С. ТОПОЛИ")),
    ("30497", "С.ЗВЕЗДИЦА", "village", ("С.ЗВЕЗДИЦА", "С. ЗВЕЗДИЦА")),
    ("38354", "С.КОНСТАНТИНОВО", "village", ("С.КОНСТАНТИНОВО", "С. КОНСТАНТИНОВО")),
    ("35211", "С.КАЗАШКО", "village", ("С.КАЗАШКО", "С. КАЗАШКО")),
)
MUNICIPALITY_CODE = "06"
MUNICIPALITY_NAME = "ВАРНА"

LOCALITY_PREFIXES = tuple(p for _, _, _, prefixes in SETTLEMENTS for p in prefixes)
PREFIX_CODES = tuple((p, code) for code, _, _, prefixes in SETTLEMENTS for p in prefixes)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _L = T.StringType(), T.LongType()

INSTITUTIONS = _struct(
    ("id", _L), ("external_id", _S), ("name", _S), ("kind", _S), ("source_url", _S),
    ("address", _S), ("district_code", _S), ("has_infant_group", T.BooleanType()),
    ("last_seen_at", T.TimestampType()),
)
STREETS = _struct(
    ("id", _L), ("city", _S), ("raw_name", _S), ("street_part", _S), ("type_marker", _S),
    ("search_norm", _S),
)
ADDRESSES = _struct(
    ("id", _L), ("street_id", _L), ("number_int", T.ShortType()), ("number_suffix", _S),
    ("entrance", _S), ("district_code", _S), ("settlement_code", _S),
)
ADDRESS_INSTITUTIONS = _struct(("address_id", _L), ("institution_id", _L))
REGISTER = _struct(
    ("street_code", _S), ("street_raw", _S), ("search_norm", _S), ("number_int", T.ShortType()),
    ("number_suffix", _S), ("entrance", _S), ("district_code", _S), ("district_name", _S),
    ("settlement_code", _S), ("section_no", T.ShortType()),
)
SETTLEMENT_DIM = _struct(
    ("code", _S), ("name", _S), ("locality_type", _S), ("municipality_code", _S),
    ("municipality_name", _S), ("source", _S),
)

TABLES = {
    "institutions": INSTITUTIONS,
    "streets": STREETS,
    "addresses": ADDRESSES,
    "address_institutions": ADDRESS_INSTITUTIONS,
    "register": REGISTER,
}

# Longest value each text column may hold.
MAX_LENGTHS = {
    "institutions": {
        "external_id": 16, "name": 256, "kind": 16, "source_url": 512, "address": 256,
        "district_code": 2,
    },
    "streets": {
        "city": 64, "raw_name": 256, "street_part": 256, "type_marker": 8, "search_norm": 256,
    },
    "addresses": {
        "number_suffix": 2, "entrance": 4, "district_code": 2, "settlement_code": 5,
    },
    "register": {
        "street_code": 5, "street_raw": 256, "search_norm": 256, "number_suffix": 2,
        "entrance": 4, "district_code": 2, "district_name": 64, "settlement_code": 5,
    },
    "settlements": {
        "code": 5, "name": 64, "locality_type": 16, "municipality_code": 2,
        "municipality_name": 64, "source": 32,
    },
}


def settlements_dim(spark: SparkSession) -> DataFrame:
    """The six settlements of the municipality: a constant, safe to broadcast."""
    rows = [
        (code, name, locality, MUNICIPALITY_CODE, MUNICIPALITY_NAME, "grao_kads")
        for code, name, locality, _ in SETTLEMENTS
    ]
    return spark.createDataFrame(rows, SETTLEMENT_DIM)
