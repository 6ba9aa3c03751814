from pyspark.sql import functions as F

from kvartal.functions.addresses import address_label
from kvartal.operators import dedupe, standardise


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_house_numbers(spark):
    good = {
        "7": (7, None, None), "0016": (16, None, None), "8\n": (8, None, None),
        "33Б": (33, "Б", None), "05Ж вх.2": (5, "Ж", "2"), "210 вх.Г": (210, None, "Г"),
        "64 вх.0911": (64, None, "0911"), "32767": (32767, None, None),
    }
    unreadable = ("", "вх", "15D", "15б", "15 вх.", " 15", "15вх.А", "15 вх.09115", "15\n\n", "५")
    too_large = ("32768", "40000Я", "8" * 25)
    cases = {
        **{n: (*parts, None) for n, parts in good.items()},
        **{n: (None, None, None, "unparseable") for n in unreadable},
        **{n: (None, None, None, "out_of_range") for n in too_large},
    }
    df = spark.createDataFrame([(n,) for n in cases], "number string")
    got = {r[0]: tuple(r[1:]) for r in standardise.standardise_numbers(df).collect()}
    assert got == cases


def test_streets(spark):
    cases = {
        "ГР.ВАРНА УЛ.ЛЮЛЯК": ("ГР.ВАРНА", "УЛ.", "ЛЮЛЯК", None),
        "С. ТОПОЛИ БУЛ.ИЗТОК": ("С. ТОПОЛИ", "БУЛ.", "ИЗТОК", None),
        "С.КАЗАШКО  УЛ.   БОР": ("С.КАЗАШКО", "УЛ.", "БОР", None),
        "ГР. ВАРНА Ж.К.": ("ГР. ВАРНА", "Ж.К.", "", None),
        "ГР.ВАРНА МЕСТНОСТ ПОЛЯНА": ("ГР.ВАРНА МЕСТНОСТ ПОЛЯНА", None, "", None),
        "С. ТОПОЛИ": ("С. ТОПОЛИ", None, "", None), "С. ТОПОЛИ ": ("С. ТОПОЛИ ", None, "", None),
        **{other: (None, None, None, "unknown_locality") for other in (
            "С. ТОПОЛИ\tБУЛ.Z", "С.КАЗАШКОУЛ.Х", "ГР.ПЛОВДИВ УЛ.ЛИПА",
        )},
    }
    df = spark.createDataFrame([(s,) for s in cases], "street string")
    got = standardise.standardise_streets(df).select(
        "street", "city", "type_marker", "street_part", "reject_reason"
    )
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == cases


def test_search_keys(spark):
    cases = {
        "С. ТОПОЛИ УЛ.ЛЮЛЯК": "s. topoli ul.lyulyak", "ДЪЖД": "dazhd", "ЧАЙКА 7-ы": "chayka 7-ы",
        "ЩЪРКЕЛ": "shtarkel", "Ж.К.ШИПКА Xy": "zh.k.shipka xy", "ЙОВ ЦАР": "yov tsar",
    }
    df = spark.createDataFrame([(s,) for s in cases], "text string")
    assert dict(rows(standardise.add_search_key(df, "text"))) == cases


def test_locality_is_reported_before_number_and_rejects_are_kept(spark):
    df = spark.createDataFrame(
        [("ГР.СОФИЯ УЛ.Х", "bad"), ("ГР.ВАРНА УЛ.Х", "bad"), ("ГР.ВАРНА УЛ.Х", "99999"),
         ("ГР.ВАРНА УЛ.Х", "5")],
        "street string, number string",
    )
    entries = standardise.standardise_entries(df)
    counts = dict(rows(standardise.quarantine_counts(entries)))
    assert counts == {"unknown_locality": 1, "unparseable": 1, "out_of_range": 1}
    assert standardise.accepted(entries).count() == 1
    assert standardise.quarantined(entries).count() == 3


def test_one_line_addresses(spark):
    cases = {
        None: (None, None, "no_address"), "": (None, None, "no_address"),
        "GARBAGE": (None, None, "parse_failed"), "ГР.СОФИЯ УЛ.Х 5": (None, None, "parse_failed"),
        "ГР.ВАРНА УЛ.Х 41 вх.А": (None, None, "parse_failed"),
        "ГР.ВАРНА УЛ.Х 99": ("gr.varna ul.h", 99, None),
        "ГР.ВАРНА УЛ.Х ": (None, None, "parse_failed"),
    }
    df = spark.createDataFrame([(s,) for s in cases], "address string")
    got = standardise.parse_one_line_addresses(df).select(
        "address", "search_norm", "number_int", "parse_reason"
    )
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == cases


def test_classify_by_prefix_needs_no_space(spark):
    df = spark.createDataFrame(
        [("С. КАМЕНАР УЛ. Х",), ("С.КАМЕНАРИЦА",), ("UNKNOWN PLACE",)], "raw_name string"
    )
    got = dict(rows(standardise.classify_by_prefix(df, "raw_name")))
    assert got == {"С. КАМЕНАР УЛ. Х": "35701", "С.КАМЕНАРИЦА": "35701", "UNKNOWN PLACE": None}


def test_dedupe(spark):
    df = spark.createDataFrame(
        [("a", None, 1, "x"), ("a", None, 2, "y"), ("a", "k", 3, "z")],
        "key string, part string, pos int, value string",
    )
    last = dedupe.dedupe_last_wins(df, ("key", "part"), ("pos",))
    first = dedupe.dedupe_first_wins(df, ("key", "part"), ("pos",))
    assert sorted(r.value for r in last.collect()) == ["y", "z"]
    assert sorted(r.value for r in first.collect()) == ["x", "z"]
    assert dedupe.distinct_edges(df, ("key",), ("part",)).count() == 2
    assert rows(dedupe.null_count(df, "part", "n")) == [(2,)]


def test_address_label(spark):
    df = spark.createDataFrame(
        [("УЛ.Х", 5, "А", "1"), ("УЛ.Х", 5, None, None), ("УЛ.Х", 5, None, "")],
        "s string, n int, x string, e string",
    )
    label = address_label(*(F.col(c) for c in "snxe"))
    assert rows(df.select(label)) == [("УЛ.Х 5А вх.1",), ("УЛ.Х 5",), ("УЛ.Х 5",)]
