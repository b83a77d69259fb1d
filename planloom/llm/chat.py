"""Chat formatting with rotating perspectives (operator 5), DataFrame functions only.

Every participant of a dialogue is the assistant once: their messages become the assistant's, those of
others become messages of named users, and system messages stay. A message is written as

    <|role|>text<|end|>\\n      with role  system, assistant  or  user:name

and the loss mask holds the spans (characters, end exclusive) of the assistant's texts with their end mark.

A dialogue is written in parts of PART_TURNS messages, so one conversation may hold any share of the rows:
messages are numbered by range partitioning and offsets, no task needs a whole conversation, and a
part is a bounded group. Every part is rendered for every participant of the whole dialogue, also where the
participant is silent in it, and the places of the mask run on from part to part. So the parts of a perspective,
put together in order, are the dialogue as if it had been rendered at once.

Defined results: messages go by (turn, role, hash of text), nulls first, so ties have an order; a null
text is empty; a null role is a participant called "unknown"; messages of a null conv_id are one conversation;
a conversation of system messages only has no perspective; marks that stand in a text or name are escaped
with a backslash after their "<", so that they cannot pass for real ones. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.session import cut_lineage, join_small

PART_TURNS = 64
#: Parts whose lengths are summed together first.
BLOCK_PARTS = 1000
SYSTEM = "system"
END = "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with n, their number within the conversation from 0."""
    spark = messages.sparkSession
    shaped = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "speaker", "text_key"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the rows of a partition have consecutive numbers from a multiple of 2^33 on
    placed = cut_lineage(shaped.withColumn("text_key", F.xxhash64("text")).repartitionByRange(partitions, *order)
                         .sortWithinPartitions(*order, "text").withColumn("id", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("id", 33))
    # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(placed.groupBy("part").agg(F.count("*").alias("n"))
                          .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    in_part = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = join_small(placed, offsets, "part").withColumn("at", F.col("offset") + in_part)
    firsts = cut_lineage(placed.groupBy("conv_id").agg(F.min("at").alias("first"))
                         .withColumnRenamed("conv_id", "_conv_id"))
    joined = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv_id")))
    return joined.select("conv_id", "turn", "speaker", "text", (F.col("at") - F.col("first")).alias("n"))


def _rendered(perspective: Column, messages: Column) -> Column:
    """struct(text, n_chars, mask) of messages (n, speaker, text) seen by ``perspective``."""
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("length"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc, x):
        own = x["speaker"] == perspective
        role = (F.when(x["speaker"] == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant"))
                .otherwise(F.concat(F.lit("user:"), escape(x["speaker"]))))
        head = F.concat(F.lit("<|"), role, F.lit("|>"))
        body = F.concat(escape(x["text"]), F.lit(END))
        start = acc["length"] + F.length(head)
        end = start + F.length(body)
        span = F.struct(start.alias("start"), end.alias("end"))
        mask = F.when(own, F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"])
        return F.struct(F.concat(acc["parts"], F.array(F.concat(head, body, F.lit("\n")))).alias("parts"),
                        (end + 1).alias("length"), mask.alias("mask"))

    return F.aggregate(messages, empty, step, lambda acc: F.struct(
        F.array_join(acc["parts"], "").alias("text"), acc["length"].alias("n_chars"), acc["mask"].alias("mask")))


def _offsets(lengths: DataFrame) -> DataFrame:
    """(no_id, conv, assistant, part, offset): characters of a perspective before each part, by sums over blocks of parts."""
    key = ["no_id", "conv", "assistant"]
    before = lambda *more: Window.partitionBy(*key, *more).rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda name, window: F.coalesce(F.sum(name).over(window), F.lit(0).cast("bigint"))
    blocks = lengths.withColumn("block", F.floor(F.col("part") / BLOCK_PARTS))
    starts = blocks.groupBy(*key, "block").agg(F.sum("n_chars").alias("n")).select(
        *key, "block", sum_before("n", before().orderBy("block")).alias("start"))
    inside = blocks.withColumn("inside", sum_before("n_chars", before("block").orderBy("part")))
    return inside.join(starts, [*key, "block"]).select(*key, "part", (F.col("start") + F.col("inside")).alias("offset"))


def perspectives(messages: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, assistant, text, n_chars, n_turns, mask): every part of a dialogue for every participant of it."""
    rows = numbered(messages).select(F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0).cast("bigint")).alias("conv"),
                                     "speaker", "text", "n")
    speakers = rows.where(F.col("speaker") != SYSTEM).select("no_id", "conv", F.col("speaker").alias("assistant")).distinct()
    parts = rows.groupBy("no_id", "conv", F.floor(F.col("n") / part_turns).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("n", "speaker", "text"))).alias("messages"))
    made = parts.join(cut_lineage(speakers), ["no_id", "conv"]).withColumn("made", _rendered(F.col("assistant"), F.col("messages")))
    offsets = cut_lineage(_offsets(made.select("no_id", "conv", "assistant", "part", F.col("made.n_chars").cast("bigint").alias("n_chars"))))
    moved = F.transform("made.mask", lambda x: F.struct((x["start"] + F.col("offset")).alias("start"), (x["end"] + F.col("offset")).alias("end")))
    return made.join(offsets, ["no_id", "conv", "assistant", "part"]).select(
        F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), "part", "assistant", "made.text", "made.n_chars",
        F.size("messages").alias("n_turns"), moved.alias("mask"))
