"""Chat formatting after cumulative snapshots are collapsed, with DataFrame functions only.

Loggers write a conversation again after every turn, so most logged
conversations are prefixes of a longer one.  Every turn gets a rolling hash of
its conversation up to there: the sum of a hash of (position, role, text).  A
conversation whose whole hash equals the hash of a proper prefix of another one
is dropped by an anti join; of equal conversations the least conv_id stays.
Only then are texts met again: the turns of those that are left are rendered in
the chat format.  Until there a turn travels as its hashes.

A conversation may hold a third of all turns: its turns are numbered over sorted
ranges, summed in blocks of ``BLOCK_TURNS`` of them, and block totals are carried
over, so no conversation is gathered, whatever its turn numbers are.  A text that
many turns share is one row when it is looked up.  Hashes are 128 bits wide, the
rolling ones in four sums of 32-bit parts that cannot overflow.

Defined cases: turns go by number, nulls first, then by role and text hash; a
null role is ``unknown`` and a null text empty; repeated rows are repeated
turns; rows without conv_id form one conversation; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .turns import with_position

BLOCK_TURNS = 256
PARTS = ("s1", "s2", "s3", "s4")
#: The chat format of one turn.
BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEFORE_ROLE), role, F.lit(AFTER_ROLE), text, F.lit(AFTER_TEXT))


def _halves(x: Column) -> list[Column]:
    return [x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32)]


def _said() -> dict[str, Column]:
    """Two hashes and the rendered text of a turn."""
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    return {"a": F.xxhash64(role, text), "b": F.xxhash64(text, F.lit(BLOCK_TURNS), role), "rendered": rendered(role, text)}


def prefixes(turns: DataFrame) -> DataFrame:
    """key (a struct of conv_id, in which null equals null), position (from 1), n_turns, hashes a and b,
    and the rolling hash ``PARTS`` of every turn."""
    said = _said()
    light = turns.select("conv_id", "turn", said["a"].alias("a"), said["b"].alias("b"))
    at = with_position(light, "conv_id", [F.col("turn"), F.col("a"), F.col("b")])
    terms = _halves(F.xxhash64("position", "a", "b")) + _halves(F.xxhash64("b", F.lit(BLOCK_TURNS), "position", "a"))
    block = F.struct("conv_id", F.floor((F.col("position") - 1) / BLOCK_TURNS).alias("n")).alias("block")
    in_block = Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    placed = at.select(block, "position", "a", "b").repartition("block")
    summed = placed.select("*", *(F.sum(t).over(in_block).alias(p) for p, t in zip(PARTS, terms)))
    # The last sum of a block is its total; blocks of a conversation are one row for each ``BLOCK_TURNS`` turns.
    ends = placed.groupBy("block").agg(F.count("*").alias("n"), *(F.sum(t).alias(p) for p, t in zip(PARTS, terms)))
    whole = Window.partitionBy("block.conv_id")
    earlier = whole.orderBy("block.n").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "block",
        F.sum("n").over(whole).alias("n_turns"),
        *(F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"{p}_before") for p in PARTS),
    )
    return summed.join(carried, "block").select(
        F.struct("block.conv_id").alias("key"), "position", "n_turns", "a", "b", *((F.col(p) + F.col(f"{p}_before")).alias(p) for p in PARTS)
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """Rendered turns of the conversations that are no prefix of another one."""
    every = written(prefixes(turns), "chat-turns")
    whole = every.where("position = n_turns").groupBy("position", *PARTS).agg(F.min("key.conv_id").alias("conv_id"))
    # A first turn that a third of the conversations share is one row after the combine.
    inner = every.where("position < n_turns").groupBy("position", *PARTS).agg(F.lit(1).alias("seen"))
    kept = whole.join(inner, ["position", *PARTS], "left_anti").select(F.struct("conv_id").alias("key"))
    left = every.join(kept, "key", "left_semi").select("key", "position", "n_turns", "a", "b")
    said = _said()
    texts = turns.select(*(c.alias(n) for n, c in said.items())).groupBy("a", "b").agg(F.first("rendered").alias("rendered"))
    return left.join(texts, ["a", "b"]).select("key.conv_id", "position", "n_turns", "rendered")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, '{BEFORE_ROLE}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)
           AS rendered, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS position,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations),
w AS (SELECT conv_id, list(rendered ORDER BY position) AS turns, count(*) AS n FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:position - 1] AS turns FROM w JOIN t USING (conv_id) WHERE position > 1),
k AS (SELECT min(conv_id) AS conv_id FROM w WHERE turns NOT IN (SELECT turns FROM p) GROUP BY turns)
SELECT conv_id, position, n_turns, rendered FROM t JOIN k USING (conv_id)
"""
