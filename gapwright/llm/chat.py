"""Preference pairs as one prompt and two masked completions, DataFrame operations only (operator 6).

Turns stay rows until the end, so a conversation of any length is never one task's group: the first turn at which two
conversations differ is a minimum over turns, and each turn renders by itself. assemble() makes whole strings of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._workspace import materialise

#: Fixed marks of a rendered turn. The same marks inside a text are broken up, so that no text can end its turn.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def _text(column: str) -> Column:
    return F.replace(F.coalesce(F.col(column), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def one_turn(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text): one row for each id and turn; of several, the smallest role and then text. Null is empty;
    rows with a null id or turn belong to no conversation and are left out."""
    said = F.struct(F.coalesce(F.col(role_col), F.lit("")).alias("role"), _text(text_col).alias("text"))
    rows = turns.where(F.col(id_col).isNotNull() & F.col(turn_col).isNotNull())
    return rows.groupBy(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn")).agg(F.min(said).alias("m")).select("id", "turn", "m.role", "m.text")


def preference_segments(chosen: DataFrame, rejected: DataFrame, id_col: str = "id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, part, turn, role, segment, loss_start, loss_end): rendered turns of each id that both tables hold or one does.

    Turns of both sides meet by their numbers, so both must count alike; gaps are no matter. part is prompt for the longest
    common prefix of turns, which is rendered once, else chosen or rejected. Code points
    from loss_start up to loss_end of the segment carry loss: the text and end mark of assistant turns of completions; in
    other segments both are 0. Equal conversations are all prompt. Empty tables give no rows.
    """
    sides = (one_turn(t, id_col, turn_col, role_col, text_col) for t in (chosen, rejected))
    a, b = (t.select("id", "turn", F.struct("role", "text").alias(n)) for t, n in zip(sides, "ab", strict=True))
    both = a.join(b, ["id", "turn"], "full")
    first = both.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("id").agg(F.min("turn").alias("split"))
    told = both.join(first, "id", "left").withColumn("split", F.coalesce("split", F.lit((1 << 63) - 1)))
    shared = F.array(F.struct(F.lit("prompt").alias("part"), F.col("a").alias("said")))
    apart = F.array(F.struct(F.lit("chosen").alias("part"), F.col("a").alias("said")), F.struct(F.lit("rejected").alias("part"), F.col("b").alias("said")))
    parts = told.select("id", "turn", F.explode(F.when(F.col("turn") < F.col("split"), shared).otherwise(apart)).alias("p")).where(F.col("p.said").isNotNull())
    header = F.concat(F.lit(START), F.col("p.said.role"), F.lit("\n"))
    body = F.concat(F.col("p.said.text"), F.lit(END))
    learns = (F.col("p.part") != "prompt") & (F.col("p.said.role") == LEARNED)
    start = F.when(learns, F.char_length(header)).otherwise(0).cast("long")
    end = F.when(learns, F.char_length(header) + F.char_length(body)).otherwise(0).cast("long")
    return parts.select("id", F.col("p.part").alias("part"), "turn", F.col("p.said.role").alias("role"), F.concat(header, body, F.lit("\n")).alias("segment"), start.alias("loss_start"), end.alias("loss_end"))


def assemble(segments: DataFrame) -> DataFrame:
    """(id, prompt, chosen, rejected, chosen_loss, rejected_loss): whole strings and the loss spans in the completions.

    A row holds a conversation pair, so a pair must fit in a cell; longer ones are used as segments.
    """
    def joined(part: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "segment", "loss_start", "loss_end"))))
        return rows.alias(f"_{part}")

    def spans(part: str) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
        def step(acc: Column, s: Column) -> Column:
            one = F.array(F.struct((acc["at"] + s["loss_start"]).alias("start"), (acc["at"] + s["loss_end"]).alias("end")))
            return F.struct((acc["at"] + F.char_length(s["segment"])).alias("at"), F.when(s["loss_end"] > 0, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))
        return F.aggregate(F.col(f"_{part}"), zero, step, lambda acc: acc["out"]).alias(f"{part}_loss")

    rows = segments.groupBy("id").agg(*(joined(p) for p in ("prompt", "chosen", "rejected")))
    texts = [F.array_join(F.transform(f"_{p}", lambda s: s["segment"]), "").alias(p) for p in ("prompt", "chosen", "rejected")]
    return rows.select("id", *texts, spans("chosen"), spans("rejected"))


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) of a table of plain conversations: chosen is a conversation up to its last assistant turn,
    rejected is the same with the last answer of the neighbour (conv_id with the lowest bit flipped; none: empty).
    Conversations without an assistant turn are the same on both sides. Null ids and turns are left out, of repeated turns one
    stays, null texts are empty, other columns are not read, an empty table gives empty ones."""
    rows = materialise(one_turn(turns), "turns")
    last = rows.where(F.col("role") == LEARNED).groupBy("id").agg(F.max_by("text", "turn").alias("answer"), F.max("turn").alias("last"))
    other = last.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("answer").alias("other"))
    marked = rows.join(last.select("id", "last").join(other, "id", "left"), "id", "left").where("last is null or turn <= last")
    text = F.when(F.col("turn") == F.col("last"), F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    return marked.select("id", "turn", "role", "text"), marked.select("id", "turn", "role", text.alias("text"))
