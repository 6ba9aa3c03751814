"""Benchmark contamination by a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.llm.common import lower_ascii
from kvartal.session import materialise

WINDOW = 13
# A document is contaminated when hit words are at least one in this many.
SHARE = 20
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
EMPTY_SHA256 = "sha2('', 256)"


def words(text: Column) -> Column:
    """A-Z lowered, then runs of ASCII letters, digits and all non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def postings(docs: DataFrame, terms: DataFrame, label: str = "postings") -> DataFrame:
    """Positional inverted index of the documents for ``terms`` (one row each): term, doc key, position.

    The training table is read once and nothing of it is shuffled unless the terms outgrow
    Spark's broadcast threshold, which is checked against the written size of the terms.
    """
    tokens = docs.select("_id", "_hash", F.posexplode(words(F.col("text"))).alias("position", "term"))
    index = tokens.join(terms, "term").select("term", "_id", "_hash", "position")
    return materialise(index.sortWithinPartitions("term"), label)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """_item (row key), item_id, _words, _size (of a window), _starts for items that have words.

    ``_starts``: where each of the item's different windows stands first. A window that an item
    repeats is looked for once.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("_words")).where("size(_words) > 0").distinct()
    items = items.withColumn("_size", F.least(F.lit(size), F.size("_words"))).withColumn(
        "_item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.array_join("_words", " "))
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - F.col("_size")), lambda i: F.array_join(F.slice("_words", i + 1, F.col("_size")), " ")
    )
    starts = (
        items.select("_item", F.posexplode(windows).alias("_start", "_window"))
        .groupBy("_item", "_window").agg(F.min("_start").alias("_start"))
        .groupBy("_item").agg(F.sort_array(F.collect_list("_start")).alias("_starts"))
    )
    return items.join(starts, "_item")


def rarest_places(items: DataFrame, counts: DataFrame, terms: int = 2) -> DataFrame:
    """The places (_item, _place, term) of each different window's ``terms`` rarest words, by corpus count.

    A word that a window repeats counts at its first place only; a window with fewer distinct
    words gives all it has.
    """
    windows = items.select("_item", "_size", "_words", F.explode("_starts").alias("_window"))
    spread = windows.select("_item", "_window", F.posexplode(F.slice("_words", F.col("_window") + 1, F.col("_size"))).alias("_at", "term"))
    first = spread.groupBy("_item", "_window", "term").agg(F.min(F.col("_at") + F.col("_window")).alias("_place"))
    counted = first.join(counts, "term", "left").withColumn("_count", F.coalesce("_count", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_item", "_window").orderBy("_count", "term"))
    return (
        counted.withColumn("_rank", rank).where(F.col("_rank") <= terms)
        .groupBy("_item", "_window").agg(F.collect_list(F.struct("term", "_place")).alias("_anchors"))
    )


def corpus_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, _count: how often each of ``terms`` stands in all documents."""
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return tokens.join(terms, "term").groupBy("term").agg(F.count("*").alias("_count"))


def diagonals(docs: DataFrame, benchmark_items: DataFrame) -> DataFrame:
    """Candidates (_id, _hash, _item, _shift): a window's rarest terms all stand at their offsets.

    The lists of the windows' rarest terms are adjusted by the terms' place in the item, so
    that one occurrence of an item lies on one shift, and intersected by counting per shift.
    """
    vocabulary = materialise(benchmark_items.select(F.explode("_words").alias("term")).distinct(), "terms")
    counts = materialise(corpus_counts(docs, vocabulary), "term-counts")
    windows = materialise(rarest_places(benchmark_items, counts), "anchors")
    places = materialise(
        windows.select("_item", F.explode("_anchors").alias("_a")).select("_item", "_a.term", "_a._place").distinct(),
        "places",
    )
    index = postings(docs, places.select("term").distinct())
    shifted = (
        index.join(places, "term")
        .withColumn("_shift", F.col("position") - F.col("_place"))
        .groupBy("_id", "_hash", "_item", "_shift").agg(F.collect_set("_place").alias("_found"))
    )
    # At least one window of the item has all its anchors on this shift.
    wanted = windows.groupBy("_item").agg(
        F.collect_set(F.array_sort(F.transform("_anchors", lambda a: a["_place"]))).alias("_wanted")
    )
    return (
        shifted.join(wanted, "_item")
        .where(F.exists("_wanted", lambda w: F.size(F.array_except(w, "_found")) == 0))
        .select("_id", "_hash", "_item", "_shift")
    )


def _with_key(docs: DataFrame) -> DataFrame:
    """Rows with the same id and text share a key, and their result."""
    return docs.withColumn("_id", F.col("doc_id")).withColumn("_hash", F.xxhash64("text"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """All documents with their exact window matches: input columns and ``_matches``.

    ``_matches``: per item and shift, the windows whose words all stand in the document; a window
    that the item repeats is told by its first place.
    """
    items = materialise(item_windows(benchmark, size), "items")
    keyed = _with_key(docs)
    found = diagonals(keyed.select("_id", "_hash", "text"), items)
    # An item goes with a document once, however many shifts are to be compared.
    shifts = found.groupBy("_id", "_hash", "_item").agg(F.collect_list("_shift").alias("_shifts"))
    candidates = materialise(
        shifts.join(items, "_item")
        .groupBy("_id", "_hash")
        .agg(F.collect_list(F.struct("item_id", "_words", "_size", "_starts", "_shifts")).alias("_candidates")),
        "candidates",
    )
    # One join form at every size: its cost follows the documents, not the number of candidates.
    joined = keyed.join(
        candidates.withColumnsRenamed({"_id": "_cid", "_hash": "_chash"}).hint("shuffle_merge"),
        F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_hash") == F.col("_chash")),
        "left",
    ).withColumn("_doc_words", words(F.col("text")))

    def windows(c: Column, shift: Column) -> Column:
        return F.filter(
            c["_starts"],
            lambda i: (i + shift >= 0)
            & (F.slice("_doc_words", F.greatest(i + shift, F.lit(0)) + 1, c["_size"]) == F.slice(c["_words"], i + 1, c["_size"])),
        )

    def of_item(c: Column) -> Column:
        return F.transform(
            c["_shifts"],
            lambda shift: F.struct(
                c["item_id"].alias("item_id"), c["_size"].alias("size"), shift.alias("shift"), windows(c, shift).alias("starts")
            ),
        )

    matches = F.filter(F.flatten(F.transform("_candidates", of_item)), lambda m: F.size(m["starts"]) > 0)
    return joined.withColumn("_matches", F.when(F.col("_candidates").isNotNull(), matches)).drop("_cid", "_chash", "_candidates")


def _judged(docs: DataFrame, benchmark: DataFrame, size: int, share: int) -> DataFrame:
    matched = phrase_matches(docs, benchmark, size)
    spans = F.flatten(
        F.transform(
            "_matches",
            lambda m: F.transform(
                m["starts"], lambda i: F.struct((i + m["shift"]).alias("start"), (i + m["shift"] + m["size"]).alias("stop"))
            ),
        )
    )
    # Spans in order: each adds what lies behind all before it.
    hit = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda sofar, span: F.struct(
            (sofar["n"] + F.greatest(F.lit(0), span["stop"] - F.greatest(span["start"], sofar["reach"]))).alias("n"),
            F.greatest(sofar["reach"], span["stop"]).alias("reach"),
        ),
        lambda sofar: sofar["n"],
    )
    ids = F.array_sort(F.array_distinct(F.transform("_matches", lambda m: F.coalesce(m["item_id"].cast("string"), F.lit("")))))
    none = F.col("_matches").isNull()
    return (
        matched.withColumn("_n_words", F.size("_doc_words").cast("long"))
        .withColumn("_n_hit", F.when(none, F.lit(0)).otherwise(hit).cast("long"))
        .withColumn("_ids", F.when(none, F.expr("cast(array() AS array<string>)")).otherwise(ids))
        .withColumn("_contaminated", (F.col("_n_hit") > 0) & (F.col("_n_hit") * share >= F.col("_n_words")))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean. Benchmark rows that repeat count once; a null
    item_id is written as an empty one. Rows with the same doc_id are judged apart. An empty
    documents table gives no rows, an empty benchmark none that is hit.
    """
    return _judged(docs.select("doc_id", "text"), benchmark, size, share).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
        F.size("_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("_ids", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows that ``contamination`` calls clean, with all their columns, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest"), "doc_id", "text")
    clean = _judged(packed, benchmark, size, share).where("NOT _contaminated")
    return clean.select(*("text" if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """query_id, doc_id, start, stop: all words of a query within ``within`` words.

    ``queries``: query_id, text. Each occurrence of the query's rarest word gives the shortest
    span that holds it and every other word, the first of equally short ones. A query of one
    distinct word matches each occurrence. Candidates are occurrences that have the second
    rarest word near enough, from the index; their surroundings are then compared word by word.
    """
    within = max(within, 0)
    keyed = _with_key(docs.select("doc_id", "text"))
    terms = queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).distinct()
    vocabulary = materialise(terms.select("term").distinct(), "terms")
    counts = materialise(corpus_counts(keyed, vocabulary), "term-counts")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("_count", F.lit(0)), "term"))
    rare = terms.join(counts, "term", "left").withColumn("_rank", rank).where("_rank <= 2")
    sizes = rare.groupBy("query_id").agg(F.max("_rank").alias("_terms"))
    rare = materialise(rare.join(sizes, "query_id"), "rare-terms")
    index = postings(keyed, rare.select("term").distinct())
    listed = index.join(rare, "term")
    order = Window.partitionBy("query_id", "_id", "_hash").orderBy("position")
    second = F.when(F.col("_rank") == 2, F.col("position"))
    before = F.last(second, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(second, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = F.when(
        F.coalesce(F.col("position") - F.col("_before"), F.lit(2**31)) <= F.coalesce(F.col("_after") - F.col("position"), F.lit(2**31)),
        F.col("_before"),
    ).otherwise(F.col("_after"))
    candidates = (
        listed.withColumn("_before", before).withColumn("_after", after).where("_rank = 1")
        .withColumn("_near", F.when(F.col("_terms") == 1, F.col("position")).otherwise(near))
        .where(F.abs(F.col("_near") - F.col("position")) < within)
        .select("query_id", "_id", "_hash", "position").distinct()
        .join(terms.groupBy("query_id").agg(F.collect_list("term").alias("_wanted")), "query_id")
        .groupBy("_id", "_hash").agg(F.collect_list(F.struct("query_id", "position", "_wanted")).alias("_candidates"))
    )
    joined = keyed.join(
        candidates.withColumnsRenamed({"_id": "_cid", "_hash": "_chash"}).hint("shuffle_merge"),
        F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_hash") == F.col("_chash")),
    ).withColumn("_doc_words", words(F.col("text")))

    def span(c: Column) -> Column:
        def from_start(i: Column) -> Column:
            near = F.slice("_doc_words", i + 1, within)
            places = F.transform(c["_wanted"], lambda term: F.array_position(near, term))
            length = F.greatest(F.array_max(places), (c["position"] - i + 1).cast("long"))
            return F.struct(F.when(F.array_min(places) > 0, length).alias("length"), i.alias("start"))

        starts = F.sequence(F.greatest(F.lit(0), c["position"] - within + 1), c["position"])
        return F.array_min(F.filter(F.transform(starts, from_start), lambda x: x["length"].isNotNull()))

    spans = F.transform("_candidates", lambda c: F.struct(c["query_id"].alias("query_id"), span(c).alias("span")))
    return (
        joined.select("doc_id", F.explode(F.filter(spans, lambda m: m["span"].isNotNull())).alias("_m"))
        .select("_m.query_id", "doc_id", "_m.span.start", (F.col("_m.span.start") + F.col("_m.span.length") - 1).cast("int").alias("stop"))
    )
