"""Chat formatting by perspective rotation.

A dialogue of several parties is rendered once for each participant: that speaker's turns become
the assistant's and are the ones trained on, the others' become turns of named users, and system
turns stay what they are. The result has one row a turn and perspective: its rendered segment and
the characters of it that the loss covers, with offsets in the whole rendered dialogue.

Positions and offsets are running sums along a dialogue. They are taken in two levels, chunks of
consecutive turns and turns of a chunk, so a dialogue of any length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
CHUNK = 256
#: What begins a mark of the format, and what it is written as where a turn or a name has it.
MARK, ESCAPED = "<|", "< |"


def rotate_perspectives(turns: DataFrame, context_roles: Sequence[str] = CONTEXT_ROLES, chunk: int = CHUNK) -> DataFrame:
    """conv_id, perspective, seq (from 0), turn, role_as, name, segment, trained, seg_start,
    mask_start, mask_end (code points; the masked span is empty where not trained).

    ``turns`` has conv_id, turn, role and text. Participants are a dialogue's distinct roles but
    for null and ``context_roles``; turns with those roles are shown to every perspective as
    ``system``. A dialogue without participants has no rows. Rows without conv_id are left out.
    A null text is shown as empty and trained on as such. Marks of the format in a text or a name are
    broken by a space, line ends in a name are spaces, so no turn forges another. Turns go in order of turn (null last),
    then role, then text; equal rows are each kept. Further columns are ignored.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("raw"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(ESCAPED)).alias("text")).where(F.col("conv_id").isNotNull())
    who = t.where(F.col("role").isNotNull() & ~F.col("role").isin(*context_roles)).select("conv_id", F.col("role").alias("perspective")).distinct()
    context = F.col("role").isNull() | F.col("role").isin(*context_roles)
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    seg = (
        t.join(who, "conv_id")
        .withColumn("role_as", F.when(context, "system").when(own, "assistant").otherwise("user"))
        .withColumn("name", F.when(F.col("role_as") == "user", F.col("role")))
        .withColumn("header", F.concat(F.lit("<|im_start|>"), F.col("role_as"), F.coalesce(F.concat(F.lit(" name="), F.replace(F.replace("name", F.lit(MARK), F.lit(ESCAPED)), F.lit("\n"), F.lit(" "))), F.lit("")), F.lit("\n")))
        .withColumn("segment", F.concat("header", "text", F.lit("<|im_end|>\n")))
        .withColumn("trained", F.col("role_as") == "assistant")
        .withColumn("part", F.coalesce(F.floor(F.col("turn") / F.lit(chunk)), F.lit(2**62)).cast("long"))
        .withColumn("len", F.length("segment").cast("long"))
    )
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("raw").asc_nulls_first()]
    within = Window.partitionBy("conv_id", "perspective", "part").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        seg.groupBy("conv_id", "perspective", "part").agg(F.sum("len").alias("part_len"), F.count(F.lit(1)).alias("part_n"))
        .withColumn("part_start", F.coalesce(F.sum("part_len").over(along), F.lit(0)))
        .withColumn("part_seq", F.coalesce(F.sum("part_n").over(along), F.lit(0)))
        .drop("part_len", "part_n")
    )
    return (
        seg.join(parts, ["conv_id", "perspective", "part"])
        .withColumn("seq", (F.col("part_seq") + F.row_number().over(within) - 1).cast("long"))
        .withColumn("seg_start", (F.col("part_start") + F.coalesce(F.sum("len").over(before), F.lit(0))).cast("long"))
        .withColumn("mask_start", (F.col("seg_start") + F.length("header")).cast("long"))
        .withColumn("mask_end", (F.col("mask_start") + F.when(F.col("trained"), F.length("text") + F.lit(len("<|im_end|>"))).otherwise(F.lit(0))).cast("long"))
        .select("conv_id", "perspective", "seq", "turn", "role_as", "name", "segment", "trained", "seg_start", "mask_start", "mask_end")
    )
