"""Chat formatting with multi-party perspective rotation, in DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that speaker as assistant and
the others as named users; spans of code points mark the assistant's words, which a trainer scores.

A dialogue comes in parts of ``turns_per_part`` turns, so that no row grows with a conversation's
length, whatever its turn numbers are.  Turns are dealt in ranges of their order over all
conversations; a turn's place in its conversation is its place in the range plus the counts of the
ranges before, so neither a conversation nor a turn number of very many rows is one task's work.
Parts meet the speakers by ranges of parts, too.  ``part_start`` is a part's place in the whole
rendering: the sum of the parts before it in its range of parts, and of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .common import stage, table

SYSTEM, END = "system", "<|end|>\n"


def _header(speaker: Column, me: Column) -> Column:
    other = F.when(speaker == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
    return F.when(speaker == me, F.lit("<|assistant|>\n")).otherwise(other)


def _up_to(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``conv``, their conversation as a struct, and ``place``, their number from 0 in its order.

    A struct equals another also where both hold null, so a null conv_id joins like any other.
    """
    order = ("conv", "turn", "who", "said")
    turns = turns.withColumn("conv", F.struct("conv_id"))
    dealt = stage(turns.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "turns")
    sizes = dealt.groupBy("conv", "slice").agg(F.count("*").alias("size"))
    before = sizes.select("conv", "slice", F.coalesce(F.sum("size").over(_up_to("conv", "slice")), F.lit(0)).alias("ahead"))
    local = F.row_number().over(Window.partitionBy("conv", "slice").orderBy("turn", "who", "said"))
    return dealt.withColumn("local", local).join(before, ["conv", "slice"]).withColumn("place", F.col("ahead") + F.col("local") - 1)


def rotate(conversations: DataFrame, turns_per_part: int = 64, parts_per_range: int = 1024) -> DataFrame:
    """(conv_id, speaker, part, part_start, n_turns, n_rows, n_target, mask, text) for each participant and part.

    ``mask`` is an array<struct<start, end>> of the assistant's words and end marks in the part's
    ``text``.  Roles other than ``system`` are participants; a conversation without one has no rows.
    A null role is the speaker ``unknown``, a null text is empty, a null turn stands first as -1, and
    rows of null conv_id are one conversation.  Equal turns of a conversation are in order of speaker
    and text; rows that agree in all four columns are one turn, and ``n_rows`` counts them.  Template
    marks inside texts and names are broken up, so that a text can't forge a header.  An empty table
    gives no rows.
    """
    plain = lambda c, absent: F.replace(F.coalesce(F.col(c), F.lit(absent)), F.lit("<|"), F.lit("< |"))
    own = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), plain("role", "unknown").alias("who"), plain("text", "").alias("said"))
    turns = _numbered(own.groupBy("conv_id", "turn", "who", "said").agg(F.count("*").alias("n")))
    parts = (
        turns.groupBy("conv", F.floor(F.col("place") / turns_per_part).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "who", "said"))).alias("turns"), F.sum("n").alias("n_rows"))
        .withColumn("range", F.floor(F.col("part") / parts_per_range))
    )
    # A conversation's speakers, once for every range of its parts.
    last = turns.groupBy("conv").agg(F.floor(F.max("place") / (turns_per_part * parts_per_range)).alias("last"))
    speakers = turns.filter(F.col("who") != SYSTEM).select("conv", F.col("who").alias("speaker")).distinct()
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("range")
    seen = parts.join(speakers.join(last, "conv").select("conv", "speaker", ranges), ["conv", "range"])
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_header(t["who"], F.col("speaker")))
        end = begin + F.length(t["said"]) + len(END) - 1  # the mark's line break is not a target
        mine = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["who"] == F.col("speaker"), F.concat(state["mask"], mine)).otherwise(state["mask"]).alias("mask"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(_header(t["who"], F.col("speaker")), t["said"], F.lit(END))), "")
    done = seen.select("conv", "speaker", "range", "part", "n_rows", F.size("turns").alias("n_turns"), F.aggregate("turns", empty, add).alias("state"), text.alias("text"))
    sums = done.groupBy("conv", "speaker", "range").agg(F.sum("state.at").alias("length"))
    starts = sums.select("conv", "speaker", "range", F.coalesce(F.sum("length").over(_up_to("conv", "speaker", "range")), F.lit(0)).alias("range_start"))
    inside = F.coalesce(F.sum("state.at").over(_up_to("conv", "speaker", "range", "part")), F.lit(0))
    placed = done.withColumn("inside", inside).join(starts, ["conv", "speaker", "range"])
    return placed.select(
        F.col("conv.conv_id").alias("conv_id"), "speaker", "part", (F.col("range_start") + F.col("inside")).alias("part_start"),
        "n_turns", "n_rows", F.size("state.mask").alias("n_target"), F.col("state.mask").alias("mask"), "text",
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every participant's rendering of whole ``conversations``, the mask as text."""
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS who,
    replace(coalesce(text, ''), '<|', '< |') AS said, count(*) AS n
  FROM conversations GROUP BY ALL),
d AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn, who, said) - 1) // 64 AS BIGINT) AS part FROM t),
s AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
h AS (
  SELECT d.conv_id, s.speaker, part, turn, who, said, n,
    CASE WHEN who = speaker THEN '<|assistant|>' || chr(10) WHEN who = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || who || '|>' || chr(10) END AS head
  FROM d JOIN s ON d.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
  SELECT *, head || said || '<|end|>' || chr(10) AS piece,
    coalesce(sum(length(head) + length(said) + 8) OVER (
      PARTITION BY conv_id, speaker, part ORDER BY turn, who, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM h),
g AS (
  SELECT conv_id, speaker, part, CAST(count(*) AS INT) AS n_turns, CAST(sum(n) AS BIGINT) AS n_rows,
    CAST(count(*) FILTER (who = speaker) AS INT) AS n_target,
    coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(said) + 7 AS BIGINT), ','
      ORDER BY turn, who, said) FILTER (who = speaker), '') AS mask,
    string_agg(piece, '' ORDER BY turn, who, said) AS text
  FROM p GROUP BY conv_id, speaker, part)
SELECT conv_id, speaker, part, CAST(coalesce(sum(length(text)) OVER (
    PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part_start,
  n_turns, n_rows, n_target, mask, text FROM g
"""
