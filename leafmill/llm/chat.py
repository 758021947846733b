"""Chat formatting: the dialogue from the perspective of every participant.  Native columns only.

For each speaker of a conversation the turns are rendered in order with that speaker as
assistant and everyone else as a named user; system turns stay system and have no
perspective of their own.  ``mask_spans`` are the character ranges [start, end) that a model
trains on: the assistant's turns with their end markers.

Conversations are rendered in parts of ``part_turns`` consecutive turns, counted by row, so
that equal and missing turn numbers do not make a part larger; the parts of a perspective, put
together in order of their number, are the whole dialogue.  Every part is rendered for every
participant of the whole conversation.  ``context`` renders the system turns before a part
(each text once), for those who use a part alone; it is empty in the first one, and
``mask_spans`` do not count it.  Turns are numbered by a sort that can spill; what is gathered is a part,
the participants and the distinct system turns of a conversation.

Defined cases: a null role is the speaker ``unknown``, a null text is empty, a null turn
sorts as turn 0, null conversation ids form one conversation; turns with equal numbers sort
by role and text, and repeated rows are repeated turns; ``<|`` inside texts and names is
broken up so that it cannot pass for a marker; a conversation with system turns only has no
perspective; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
PART_TURNS = 512


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, system_role: str = "system") -> DataFrame:
    """conv_id, part, speaker, n_turns, n_trained, context, rendered, mask_spans for every perspective."""
    role = _plain(F.coalesce(F.col("role").cast("string"), F.lit("unknown")))
    number = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    rows = turns.select("conv_id", number.alias("turn"), role.alias("role"), _plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1)
    placed = placed.select("conv_id", "role", "text", "at", F.floor(F.col("at") / part_turns).alias("part"))
    parts = placed.groupBy("conv_id", "part").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("own_turns"),
        F.collect_set(F.when(F.col("role") != system_role, F.col("role"))).alias("roles"),
        F.sort_array(F.collect_list(F.when(F.col("role") == system_role, F.struct("at", "text")))).alias("rules"),
    )
    whole, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("rules", F.array_distinct("rules.text"))
    parts = parts.select(
        "conv_id", "part", "own_turns", F.array_distinct(F.flatten(F.collect_list("roles").over(whole))).alias("speakers"),
        F.array_distinct(F.flatten(F.collect_list("rules").over(before))).alias("carried"),
    )
    context = F.array_join(F.transform("carried", lambda x: F.concat(F.lit("<|system|>\n"), x, F.lit(END))), "")
    seen = parts.select("conv_id", "part", context.alias("context"), F.col("own_turns").alias("turns"), F.explode("speakers").alias("speaker"))

    def marker(r: Column) -> Column:
        return F.when(r == F.col("speaker"), F.lit("<|assistant|>\n")).when(r == system_role, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), r, F.lit("|>\n")))

    pieces = seen.withColumn("pieces", F.transform("turns", lambda t: F.struct(marker(t["role"]).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("own"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + F.length(p["head"])
        last = first + F.length(p["body"])
        span = F.concat(first.cast("string"), F.lit("-"), last.cast("string"))
        return F.struct(last.alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    own = F.filter("pieces", lambda p: p["own"])
    return pieces.select(
        "conv_id", F.col("part").cast("long").alias("part"), "speaker", F.size("turns").cast("long").alias("n_turns"), F.size(own).cast("long").alias("n_trained"), "context",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.aggregate("pieces", start, step)["spans"], ",").alias("mask_spans"),
    )
