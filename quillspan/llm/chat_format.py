"""Chat formatting with Spark expressions only.

Format of a conversation: one block for each run of turns of one role,

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

Control strings inside roles and texts are escaped by doubling the bar: `<|` becomes `<||`, so the
only `<|` followed by another character than `|` are the template's own; a line end in a role becomes
`<|n|>`. Undoing is exact for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, ROLE_LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|n|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ROLE_LINE))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ROLE_LINE), F.lit("\n")))


def format_conversations(turns: DataFrame, loss_role: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, blocks, formatted and loss_mask.

    Turn structs are collected and sorted by turn, then role, then text, so ties have one order;
    repeated rows are turns of their own; a null turn comes first. Null role or text is the empty
    string; a null conversation id is a conversation. Neighbouring turns of one role share a block.
    loss_mask has, for every text in order, the formatted characters since the text before it (gap),
    its own (length) and whether it counts for the loss. An empty table gives an empty result; other
    columns are ignored. A conversation is one output value, so its turns meet in one task."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    first = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]))
    starts = sorted_turns.withColumn("starts", first)

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", start + 1, stop - start), lambda t: escape(t["text"]))
        return F.struct(_role_out(F.col("turns")[start]["role"]).alias("role"), texts.alias("texts"))

    blocks = starts.select("conv_id", F.transform("starts", block).alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(f"{START}"), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END))), "")

    def runs(b: Column, k: Column) -> Column:
        head = F.length(b["role"]) + len(START) + 1 + F.when(k > 0, len(END)).otherwise(0)
        return F.transform(b["texts"], lambda t, i: F.struct(F.when(i > 0, len(SEP)).otherwise(head).alias("gap"), F.length(t).alias("length"), (b["role"] == _role_out(F.lit(loss_role))).alias("loss")))

    return blocks.select("conv_id", "blocks", formatted.alias("formatted"), F.flatten(F.transform("blocks", runs)).alias("loss_mask"))


def read_back(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Add `segments`: role, text (unescaped) and raw (as formatted) of each turn, parsed from the output."""

    def texts(part: Column) -> Column:
        body = F.substring(part, F.lit(len(START) + 1), F.length(part))
        at = F.instr(body, "\n")
        role = _role_in(F.substring(body, F.lit(1), at - 1))
        return F.transform(F.split(F.substring(body, at + 1, F.length(body)), r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), t.alias("raw")))

    parts = F.split(F.col(formatted), r"<\|im_end\|>\n", -1)
    parsed = df.withColumn("_parts", F.slice(parts, F.lit(1), F.size(parts) - 1))
    return parsed.withColumn("segments", F.flatten(F.transform("_parts", texts))).drop("_parts")


def digest(df: DataFrame) -> DataFrame:
    """What can be read back from format_conversations(): turns, the text under the loss mask, lengths.

    loss_mask_fits says that the mask's lengths are those of the segments in the output."""
    read = read_back(df)
    turn_lines = F.array_join(F.transform("segments", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(F.arrays_zip("segments", "loss_mask"), lambda z: z["loss_mask"]["loss"]), lambda z: z["segments"]["text"]), "")
    fits = F.size("segments") == F.size("loss_mask")
    fits = fits & F.forall(F.arrays_zip("segments", "loss_mask"), lambda z: F.length(z["segments"]["raw"]) == z["loss_mask"]["length"])
    out = read.withColumns({"_turns": turn_lines, "_loss": loss, "loss_mask_fits": fits})
    return out.select(
        "conv_id",
        F.size("segments").cast("long").alias("n_turns"),
        F.sha2("_turns", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("blocks").cast("long").alias("n_blocks"),
        "loss_mask_fits",
    )
