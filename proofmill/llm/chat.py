"""Chat formatting by perspective rotation.

For each participant of a dialogue (each role but ``system``) the dialogue is rendered once, with that
speaker as the assistant, the others as users under their names, and a mask of the character spans that
the model is to learn: the speaker's own words with the mark that ends them.

Turns stand in the order of turn number (null last), role and text, nulls as empty, repeats one after the other. Long
dialogues are rendered in parts: a part holds turns whose numbers share a run of ``part_turns``, and as many at
most, so no task gathers a whole dialogue however long it is, and the parts of a dialogue in order hold every turn.
The first system turn of a dialogue opens each later part that has no system turn, as context that ``n_turns`` and ``first_turn``
leave out, so a part can be learnt from by itself; ``repeat_system=False`` leaves parts as they are.
A null role is named ``unknown``. Marks inside a text or a role are broken by a backslash, and line ends in a
role are written as escapes, so no mark and no turn can be forged. A
dialogue of the system alone has no participant and no row. Rows of a null dialogue id form one dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, STOP = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"
PART_TURNS = 256


def unforged(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rendered(turn: Column, speaker: Column) -> tuple[Column, Column]:
    """Head and body of one turn seen by the speaker."""
    role = turn["role"]
    shown = F.replace(F.replace(unforged(role), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    name = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), shown))
    return F.concat(F.lit(BEGIN), name, F.lit("\n")), F.concat(turn["text"], F.lit(STOP))


def rotate(turns: DataFrame, key: str = "conv_id", part_turns: int = PART_TURNS, repeat_system: bool = True) -> DataFrame:
    """``conv_id, speaker, first_turn, part, n_turns, text, mask``; mask has ``start-end`` spans, end excluded."""
    safe = unforged(F.coalesce(F.col("text"), F.lit("")))
    rows = turns.select(
        F.struct(F.col(key).alias("id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"), safe.alias("text"),
    ).withColumn("run", F.floor(F.col("turn") / part_turns))
    order = Window.partitionBy("conv", "run").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("part", F.floor(F.col("at") / part_turns).cast("int"))
    parts = placed.groupBy("conv", "run", "part").agg(
        F.array_sort(F.collect_list(F.struct("at", "turn", "role", "text"))).alias("turns")
    )
    is_system = F.col("role") == SYSTEM
    opening = F.struct(F.col("turn").isNull().alias("late"), "turn", "text")
    speakers = rows.groupBy("conv").agg(
        F.array_sort(F.collect_set(F.when(~is_system, F.col("role")))).alias("speakers"), F.min(F.when(is_system, opening)).alias("opening")
    )
    first = F.element_at("turns", 1)["turn"]
    after = ~F.exists("turns", lambda t: t["role"] == SYSTEM) & ~F.col("opening.late") & (first.isNull() | (first > F.col("opening.turn")))
    context = F.struct(F.lit(-1).alias("at"), F.col("opening.turn").alias("turn"), F.lit(SYSTEM).alias("role"), F.col("opening.text").alias("text"))
    seen = parts.join(speakers, "conv").withColumn("own_turns", F.size("turns")).withColumn("first_turn", first)
    if repeat_system:
        seen = seen.withColumn("turns", F.when(after, F.concat(F.array(context), "turns")).otherwise(F.col("turns")))
    seen = seen.withColumn("speaker", F.explode("speakers"))
    speaker = F.col("speaker")
    pieces = F.transform("turns", lambda t: F.struct(
        rendered(t, speaker)[0].alias("head"), rendered(t, speaker)[1].alias("body"), (t["role"] == speaker).alias("own")
    ))
    lengths = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + 1)
    begins = F.transform("pieces", lambda p, i: F.aggregate(F.slice("lengths", 1, i), F.lit(0), lambda a, x: a + x))
    spans = F.transform(
        F.filter(F.zip_with("pieces", "begins", lambda p, b: F.struct(p.alias("p"), (b + F.length(p["head"])).alias("from"))), lambda s: s["p"]["own"]),
        lambda s: F.concat(s["from"].cast("string"), F.lit("-"), (s["from"] + F.length(s["p"]["body"])).cast("string")),
    )
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "\n"), F.lit("\n"))
    return (
        seen.withColumn("pieces", pieces).withColumn("lengths", lengths).withColumn("begins", begins)
        .select(
            F.col("conv.id").alias(key), "speaker", "first_turn", "part",
            F.col("own_turns").alias("n_turns"), text.alias("text"), F.array_join(spans, " ").alias("mask"),
        )
    )
