"""Substring search for many strings at once, by positional trigram postings.

A text contains a string only where its rarest trigram stands. Postings are kept for the trigrams
that the strings ask for, and their counts rank them. Where a string's rarest trigram stands, the piece
of the text around it is cut out, once for all strings of that length, and looked up among the strings.
Strings of one or two characters have no trigram: they are met with the characters and pairs of
the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.operators.joins import lookup_join
from kvartal.session import materialise

GRAM = 3


def positional_grams(text: Column, size: int = GRAM) -> Column:
    """``at`` (from 1) and ``gram`` of every run of ``size`` characters."""
    return F.transform(
        F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))),
        lambda i: F.struct(i.alias("at"), F.substring(text, i, F.lit(size)).alias("gram")),
    )


def _postings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, id, at: where the wanted trigrams stand."""
    places = texts.select("id", F.explode(positional_grams(F.col("text"))).alias("_g")).select("id", "_g.*")
    # Spark takes exploded rows for no larger than their texts; a semi join never broadcasts its left side.
    return lookup_join(places, wanted.select("gram").distinct(), ["gram"], "left_semi")


def _long(texts: DataFrame, strings: DataFrame) -> DataFrame:
    grams = materialise(
        strings.where(F.length("string") >= GRAM)
        .select("string", F.explode(positional_grams(F.col("string"))).alias("_g")).select("string", "_g.*"),
        "string-grams",
    )
    postings = materialise(_postings(texts, grams), "gram-postings")
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("string").orderBy(F.coalesce("n", F.lit(0)), "at")
    ranked = lookup_join(grams, counts, ["gram"]).withColumn("_rank", F.row_number().over(rarest)).where("_rank = 1")
    # Strings of one length with the gram at one place ask for the same piece of a text: it is cut once for all of them.
    shapes = materialise(
        ranked.select("gram", F.col("at").alias("offset"), F.length("string").alias("length")).distinct(), "gram-shapes"
    )
    spans = postings.join(shapes, "gram").select("id", (F.col("at") - F.col("offset") + 1).alias("start"), "length")
    pieces = spans.where("start > 0").join(texts, "id").select(F.substring("text", F.col("start"), F.col("length")).alias("string"), "id")
    return lookup_join(pieces, strings, ["string"], "left_semi").distinct()


def _short(texts: DataFrame, strings: DataFrame, size: int) -> DataFrame:
    """Strings of ``size`` characters; the empty one stands in every text."""
    own = F.array(F.lit("")) if size == 0 else F.array_distinct(
        F.transform(F.coalesce(positional_grams(F.col("text"), size), F.array().cast("array<struct<at:int,gram:string>>")), lambda g: g["gram"])
    )
    parts = texts.select("id", F.explode(own).alias("string"))
    asked = strings.where(F.length("string") == size)
    return lookup_join(parts, asked, ["string"], "left_semi").select("string", "id")


def substring_matches(rows: DataFrame, strings: DataFrame, text: str = "search_norm") -> DataFrame:
    """``string, id``: which of the strings stand in which row's text, once each.

    The same pairs as ``contains`` for every string and row. A NULL text contains nothing, a NULL
    string is in nothing; strings are taken once however often they are asked for.
    """
    texts = rows.select("id", F.col(text).alias("text")).where(F.col("text").isNotNull())
    asked = materialise(strings.select("string").dropna().distinct(), "strings")
    return reduce(DataFrame.unionByName, [_long(texts, asked), *(_short(texts, asked, n) for n in range(GRAM))])


def search_addresses(streets: DataFrame, addresses: DataFrame, searches: DataFrame) -> DataFrame:
    """Addresses whose street key contains a search's ``string``, and of its house ``number`` if it has one.

    ``searches``: search_id, string, number. Every search at once; the streets are matched first.
    """
    found = substring_matches(streets, searches).withColumnRenamed("id", "street_id")
    asked = searches.join(found, "string").join(streets.select(F.col("id").alias("street_id"), "raw_name"), "street_id")
    number = F.col("number").isNull() | (F.col("number") == F.col("number_int"))
    return asked.join(addresses, "street_id").where(number).select(
        "search_id", "id", "raw_name", "number_int", "number_suffix", "entrance", "district_code"
    )
