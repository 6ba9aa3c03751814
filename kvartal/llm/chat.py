"""Chat formatting: final messages from an event log, a reversible template, a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvartal.operators.joins import lookup_join

# The template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNT_ROLE = "assistant"
# A control string is an opener, any number of backslashes, and one of these endings;
# escaping adds a backslash after the opener, so a plain control string never stays in a text.
CONTROL = "(\\||/?s>|/?INST\\])"
ESCAPE = ("([<\\[])(\\\\*)" + CONTROL, "$1\\\\$2$3")
UNESCAPE = ("([<\\[])\\\\(\\\\*)" + CONTROL, "$1$2$3")
# Rows gathered at once; longer conversations and messages are put together from blocks.
BLOCK = 256

EVENTS = "conv_id long, message_id string, sequence long, kind string, role string, text string"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _escape_role(role: Column) -> Column:
    percent = F.replace(escape(role), F.lit("%"), F.lit("%25"))
    return F.replace(percent, F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    lines = F.replace(role, F.lit("%0A"), F.lit("\n"))
    return unescape(F.replace(lines, F.lit("%25"), F.lit("%")))


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold an event log into final messages: conv_id, message_id, sequence, role, text.

    Kinds: ``message`` (a whole text), ``delta`` (streamed, appended), ``edit`` (replaces the
    text) and ``regenerate`` (starts it anew). A message's text is its last event that is not
    a delta and all deltas after it, by sequence; equal sequences go by kind, longest name
    first, then text, and a delta as old as that event still counts. Its place is its first
    event's sequence, its role the first role given. Null texts are empty; null conversations
    or message ids are one of their own. A message streamed in very many deltas is joined in
    blocks of sequences first, so no task meets more rows than blocks.
    """
    key = ["conv_id", "message_id"]
    delta = F.col("kind") == "delta"
    heads = events.groupBy(*key).agg(
        F.max(F.when(delta, None).otherwise(F.col("sequence"))).alias("_last"),
        F.min("sequence").alias("_first"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("sequence", "role")))["role"].alias("_role"),
        F.max(F.when(delta, None).otherwise(F.struct("sequence", F.length("kind"), F.coalesce("text", F.lit("")))))["col3"].alias("_whole"),
    )
    deltas = events.where(delta).withColumn("_block", F.floor(F.col("sequence") / BLOCK))
    later = lookup_join(deltas, heads.select(*key, "_last"), key).where(
        "_last IS NULL OR sequence >= _last OR sequence IS NULL"
    )

    def joined(rows: DataFrame, by: list[str], place: str, text: str) -> Column:
        return F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda r: r[text]), ""
        )

    blocks = (
        later.withColumn("_text", F.coalesce("text", F.lit("")))
        .groupBy(*key, "_block").agg(joined(later, key, "sequence", "_text").alias("_text"))
    )
    tails = blocks.groupBy(*key).agg(joined(blocks, key, "_block", "_text").alias("_tail"))
    return lookup_join(heads, tails.withColumnRenamed("_tail", "_deltas"), key).select(
        *key, F.col("_first").alias("sequence"), F.col("_role").alias("role"),
        F.concat(F.coalesce("_whole", F.lit("")), F.coalesce("_deltas", F.lit(""))).alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    Turns go by sequence, role, text, message_id. ``loss_mask`` lists the spans (start, length in
    code points) of the assistant's texts. Null roles and texts are empty. Turns are first
    joined in blocks of sequences, then blocks into the conversation: a conversation that
    holds a large share of all rows is spread over the blocks, and only finished text meets.
    """
    head = F.concat(F.lit(OPEN), _escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turns = messages.select(
        "conv_id", F.floor(F.col("sequence") / BLOCK).alias("_block"), "sequence",
        F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"), "message_id",
        F.concat(head, body, F.lit(CLOSE)).alias("_piece"),
        F.when(
            F.col("role") == LEARNT_ROLE,
            F.array(F.struct(F.length(head).cast("long").alias("start"), F.length(body).cast("long").alias("length"))),
        ).otherwise(F.expr("cast(array() AS array<struct<start: bigint, length: bigint>>)")).alias("_spans"),
    )

    def put_together(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        """Join the pieces of each group in order and shift their spans to where they end up."""
        lists = rows.groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct(*order, "_piece", "_spans"))).alias("_list")
        )
        ends = F.aggregate(
            "_list", F.expr("array(0L)"),
            lambda sums, r: F.concat(sums, F.array(F.element_at(sums, -1) + F.length(r["_piece"]))),
        )
        shifted = F.flatten(
            F.transform(
                "_list",
                lambda r, i: F.transform(
                    r["_spans"],
                    lambda s: F.struct((s["start"] + F.get("_ends", i)).alias("start"), s["length"].alias("length")),
                ),
            )
        )
        return lists.withColumn("_ends", ends).select(
            *by, F.array_join(F.transform("_list", lambda r: r["_piece"]), "").alias("_piece"), shifted.alias("_spans")
        )

    blocks = put_together(turns, ["conv_id", "_block"], ["sequence", "_role", "_text", "message_id"])
    whole = put_together(blocks, ["conv_id"], ["_block"])
    return whole.select("conv_id", F.col("_piece").alias("formatted"), F.col("_spans").alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and learnt (text under the mask), parsed from the output alone."""
    parts = F.filter(F.split("formatted", "<\\|im_start\\|>", -1), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        # What follows the role's line, without the closing string.
        text = F.substring(part, line + 1, F.length(part) - line - F.lit(len(CLOSE)))
        return F.struct(
            _unescape_role(F.substring(part, F.lit(1), line - 1)).alias("role"), unescape(text).alias("text")
        )

    learnt = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), learnt.alias("learnt"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The rows of a plain conversation table as whole messages; repeated rows stay apart."""
    copies = Window.partitionBy("conv_id", "turn", "role", "text").orderBy("turn")
    return conversations.select("conv_id", "turn", "role", "text").withColumn(
        "_copy", F.row_number().over(copies)
    ).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.to_json(F.struct("turn", "role", F.xxhash64("text").alias("hash"), "_copy")).alias("message_id"),
        F.col("turn").cast("long").alias("sequence"),
        F.lit("message").alias("kind"), "role", "text",
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings of other templates."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of ``read_back``."""
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
