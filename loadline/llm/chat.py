"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

Prefix sums of turn tokens deal a conversation's turns into windows: with ``stride`` = budget
- system turn - history, turns that start in the same stride and end in it share a window; a
turn that crosses its stride's end gets a window of its own.  Every window starts with the
conversation's system turn and with the turns before it that fit in ``history`` tokens.  Loss
falls on assistant texts where they are new; the repeated ones are masked.

A turn is written ``<turn role=R>`` LF text ``</turn>`` LF.  Inside role and text a backslash
becomes ``\\b``, ``<`` ``\\l``, ``>`` ``\\g`` and ``#`` ``\\h``, so no text can hold a marker and
``read_turns`` gets every text back.

Tokens are runs of letters or digits, single other signs, and ``MARKUP`` a turn.

Defined cases: null text or role is empty; null turn sorts first; equal turn numbers sort by
role, then text; repeated rows are turns of their own; a null conv_id is one conversation;
the first turn is the system turn if its role is system, later ones are ordinary turns; a
window with one turn may exceed the budget if that turn does; a system turn that leaves less
than a quarter of the budget still leaves new turns that quarter; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import prefix_sums

MARKUP = 4
END = "</turn>\n"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("#", "\\h"))


def escaped(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def turn_table(conversations: DataFrame) -> DataFrame:
    """Turns with their token count and the tokens before them in the conversation."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + MARKUP)
    return prefix_sums(turns, ["turn", "role", "text"], "tokens", "before", ("conv_id",), "turns")


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """(conv_id, stride_no, alone, n_repeat, formatted, loss_spans, tokens), a row a window.

    ``loss_spans`` are (start, end) in code points of ``formatted``; the first ``n_repeat``
    turns repeat earlier ones.  (stride_no, alone) orders the windows of a conversation.
    """
    turns = turn_table(conversations).withColumn(
        "turn_text", F.concat(F.lit("<turn role="), escaped(F.col("role")), F.lit(">\n"), escaped(F.col("text")), F.lit(END)))
    turns = turns.withColumn("is_system", (F.col("before") == 0) & (F.col("role") == "system"))
    system = turns.filter("is_system").select(
        F.col("conv_id").alias("_conv"), F.col("tokens").alias("system_tokens"), F.col("turn_text").alias("system_text"))
    turns = turns.join(system.drop("system_text"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    own = F.coalesce("system_tokens", F.lit(0))
    turns = turns.withColumns({
        "stride": F.greatest(F.lit(budget - history) - own, F.lit(max(1, budget // 4))),
        "at": F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("before") - own)})
    turns = turns.withColumn("stride_no", F.expr("at div stride"))
    turns = turns.withColumn("alone", F.when(F.col("is_system"), 0).otherwise(
        (F.col("at") + F.col("tokens") > (F.col("stride_no") + 1) * F.col("stride")).cast("int")))
    key = ["conv_id", "stride_no", "alone"]
    shape = [*key, "kind", "before", "tokens", "turn_text",
             F.char_length(F.concat(F.lit("<turn role="), escaped(F.col("role")), F.lit(">\n"))).alias("head"),
             ((F.col("role") == "assistant") & (F.col("kind") == 2)).alias("loss")]
    new = turns.withColumn("kind", F.lit(2)).select(*shape)
    starts = turns.filter("NOT is_system").groupBy(*key).agg(F.min("at").alias("start"))
    cell = F.expr(f"start div {max(1, history)}")
    past = turns.filter(f"NOT is_system AND tokens <= {history}").select(
        F.col("conv_id").alias("_conv"), "at", "before", "tokens", "turn_text", "role",
        F.explode(F.sequence(F.expr(f"(at + tokens) div {max(1, history)}"), F.expr(f"(at + {history}) div {max(1, history)}"))).alias("_cell"))
    repeated = starts.withColumn("cell", cell).join(
        past, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("cell") == F.col("_cell"))
        & (F.col("at") + F.col("tokens") <= F.col("start")) & (F.col("at") + history >= F.col("start")))
    repeated = repeated.withColumn("kind", F.lit(1)).select(*shape)
    heads = starts.filter("stride_no > 0 OR alone > 0").join(system, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        *key, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("before"), F.col("system_tokens").alias("tokens"),
        F.col("system_text").alias("turn_text"), F.lit(0).alias("head"), F.lit(False).alias("loss"))
    pieces = new.unionByName(repeated).unionByName(heads)
    windows = pieces.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("kind", "before", "tokens", "head", "loss", "turn_text"))).alias("turns"),
        F.sum((F.col("kind") < 2).cast("int")).alias("n_repeat"), F.sum("tokens").alias("tokens"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start: long, end: long>>)").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        end = done.at + F.char_length(turn.turn_text)
        span = F.struct((done.at + turn["head"]).cast("long").alias("start"), (end - len(END)).cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(turn.loss, F.array_append(done.spans, span)).otherwise(done.spans).alias("spans"))

    return windows.select(*key, "n_repeat", F.array_join(F.col("turns.turn_text"), "").alias("formatted"),
                          F.aggregate("turns", start, step, lambda x: x.spans).alias("loss_spans"), "tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, read from the formatted text alone: turns (role, text) and the loss text.

    One row holds one conversation, as its digest needs it whole.
    """
    parts = F.split("formatted", END)
    new = F.slice(parts, F.col("n_repeat") + 1, F.size(parts) - 1 - F.col("n_repeat"))
    turns = F.transform(new, lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len("<turn role=") + 1)), ">\n", 1)).alias("role"),
        unescaped(F.substr(p, F.char_length(F.substring_index(p, ">\n", 1)) + 3)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    read = windows.select("conv_id", "stride_no", "alone", turns.alias("turns"), loss.alias("loss"),
                          F.char_length("formatted").alias("chars"))
    rows = F.sort_array(F.collect_list(F.struct("stride_no", "alone", "turns", "loss")))
    return read.groupBy("conv_id").agg(rows.alias("w"), F.sum("chars").alias("formatted_chars")).select(
        "conv_id", F.flatten("w.turns").alias("turns"), F.array_join(F.flatten("w.loss"), "").alias("loss"), "formatted_chars")
