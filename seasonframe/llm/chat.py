"""Chat formatting with Spark expressions only: sorted turn structs, merged blocks, a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template.
ROLE, TEXT, MORE, END = "<|role|>", "<|text|>", "<|more|>", "<|end|>\n"

# What may not stand unescaped inside a role or text: our own "<|" and the marks of common chat templates.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"

# Turns per first-level group: bounds the array that one fold copies.
CHUNK = 64


def escape(text: Column) -> Column:
    r"""Put one more backslash behind the bracket of every control string ("<|" becomes "<\|").

    A control string holds no second bracket, so matches never overlap and `unescape` undoes exactly this.
    """
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _merge(turns: Column) -> Column:
    """Fold turns into blocks (role, texts): a turn with the role of the block before joins that block."""
    kind = "array<struct<role:string,texts:array<string>>>"

    def step(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        grown = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(blocks) > 0) & (F.get(blocks, F.size(blocks) - 1)["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(grown))) \
            .otherwise(F.concat(blocks, F.array(fresh))).cast(kind)

    return F.aggregate(turns, F.array().cast(kind), step)


def format_chat(rows: DataFrame, loss_role: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """One row per conv_id: `formatted` and `segments`, the same text in pieces with a loss flag each.

    Turns are ordered by (turn, role, text), nulls first. Adjacent turns of one role share a block
    `<|role|>R<|text|>A<|more|>B<|end|>`; every turn can be read back. The loss mask covers the texts of
    `loss_role`, not the marks around them.

    Turns are first gathered per (conversation, `chunk` turn numbers) and folded there, so a long
    conversation is sorted and merged by many tasks; the last step puts finished blocks side by side.
    One conversation ends as one string, which is the operator's output and so Spark's limit on a value.

    Null texts and roles are empty; rows with a null conv_id form one conversation; repeated rows are turns
    of their own; an empty table gives no rows; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select(
        "conv_id", F.floor(F.col("turn") / chunk).alias("_chunk"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("_turn"))
    folded = turns.groupBy("conv_id", "_chunk").agg(F.array_sort(F.collect_list("_turn")).alias("_turns")).select(
        "conv_id", F.struct(F.col("_chunk").alias("chunk"), _merge(F.col("_turns")).alias("blocks")).alias("_part"))
    blocks = folded.groupBy("conv_id").agg(F.array_sort(F.collect_list("_part")).alias("_parts")).select(
        "conv_id", F.flatten(F.transform("_parts", lambda p: p["blocks"])).alias("_blocks"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def render(block: Column, i: Column) -> Column:
        before = F.get(F.col("_blocks"), i - 1)["role"]
        header = F.concat(F.when(i > 0, END).otherwise(""), F.lit(ROLE), escape(block["role"]), F.lit(TEXT))
        opening = F.when(before == block["role"], F.lit(MORE)).otherwise(header)
        return F.flatten(F.transform(block["texts"], lambda t, j: F.array(
            segment(F.when(j == 0, opening).otherwise(MORE), F.lit(False)),
            segment(escape(t), block["role"] == loss_role))))

    pieces = F.concat(F.flatten(F.transform("_blocks", render)), F.array(segment(F.lit(END), F.lit(False))))
    return blocks.select("conv_id", pieces.alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made of, unescaped and in order."""
    def quoted(mark: str) -> str:
        return mark.replace("|", r"\|")

    blocks = F.split(formatted, quoted(END))

    def turns(block: Column) -> Column:
        parts = F.split(block, quoted(TEXT))
        role = unescape(F.substring(F.get(parts, F.lit(0)), len(ROLE) + 1, 1 << 30))
        return F.transform(F.split(F.get(parts, F.lit(1)), quoted(MORE)),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
