"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

A turn is written as  ``<|turn|>ROLE<|text|>TEXT<|end|>``.  Inside roles and texts a backslash becomes two and every control
string gets a backslash after its first character, so that no control string of this or of another common template survives;
``unescape`` takes the backslashes away again.  Each assistant turn makes an example of its own: everything before it is
context, and only its text is under the loss mask.  All examples of a conversation are prefixes of one string, so this string
is kept once, in the row of the conversation, and an example is a pair of offsets into it; ``examples`` cuts them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: First characters of control strings, and what must follow to make one.
CONTROL = r"<(?=\||/?s>|</?SYS>>|/SYS>>|SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``formatted``, and ``targets``, for each assistant turn the offsets of its text in it.

    An offset counts code points from 0; ``start`` is where the masked text begins and ``stop`` where it ends.  Turns stand
    by turn (null first), then role, then text; null roles and texts are empty.  A null conversation id is an id of its own;
    repeated rows are repeated turns.  An empty table gives no rows.
    """
    t = only(df, **{conv: "conv", turn: "turn", role: "role", text: "text"})
    t = t.select("conv", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    head = t.select("conv", F.struct(F.col("t.turn"), F.col("t.role"), F.col("t.text"), F.concat(F.lit(TURN), escape(F.col("t.role")), F.lit(TEXT)).alias("head"), escape(F.col("t.text")).alias("body")).alias("t"))
    whole = head.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    sized = whole.select(
        "conv",
        F.concat_ws("", F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END)))).alias("formatted"),
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"))).alias("sizes"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn_no:int,start:int,stop:int>>").alias("found"), F.lit(0).alias("no"))

    def fold(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["h"]
        mine = F.array(F.struct(acc["no"].alias("turn_no"), start.alias("start"), (start + x["b"]).alias("stop")))
        return F.struct((start + x["b"] + len(END)).alias("at"), F.when(x["role"] == "assistant", F.concat(acc["found"], mine)).otherwise(acc["found"]).alias("found"), (acc["no"] + 1).alias("no"))

    return sized.select(F.col("conv").alias(conv), "formatted", F.aggregate("sizes", zero, fold, lambda a: a["found"]).alias("targets"))


def examples(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per assistant turn: ``prompt`` (all before its text, untrained) and ``reply`` (the text under the mask)."""
    one = formatted.select(F.col(conv), "formatted", F.explode("targets").alias("x"))
    cut = lambda a, n: F.col("formatted").substr(a + F.lit(1), n)
    return one.select(conv, F.col("x.turn_no").alias("target_turn"), cut(F.lit(0), F.col("x.start")).alias("prompt"), cut(F.col("x.start"), F.col("x.stop") - F.col("x.start")).alias("reply"), F.lit(END).alias("closing"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    body = lambda x: F.split(F.substring(x, len(TURN) + 1, 2**31 - 1), r"<\|text\|>")
    return F.transform(parts, lambda x: F.transform(F.array(body(x)), lambda y: F.struct(unescape(y[0]).alias("role"), unescape(y[1]).alias("text")))[0])


def summaries(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from the output: turns, their digest, the examples' text under the mask and their total length.

    A conversation without assistant turns has no example, so its mask is empty and its length 0.
    """
    turns = formatted.select(conv, "formatted", "targets", read_turns(F.col("formatted")).alias("turns"))
    body = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    read = turns.select(conv, "formatted", F.explode_outer("targets").alias("x"), F.size("turns").cast("long").alias("n_turns"), F.sha2(body.cast("binary"), 256).alias("turns_sha256"))
    prompt, reply = F.col("formatted").substr(F.lit(1), F.col("x.start")), F.col("formatted").substr(F.col("x.start") + 1, F.col("x.stop") - F.col("x.start"))
    each = read.select(conv, "n_turns", "turns_sha256", "x.turn_no", F.length(prompt).alias("p"), F.length(reply).alias("r"), unescape(reply).alias("text"))
    found = F.sort_array(F.collect_list(F.when(F.col("turn_no").isNotNull(), F.struct("turn_no", "text"))))
    whole = each.groupBy(conv, "n_turns", "turns_sha256").agg(found.alias("replies"), F.coalesce(F.sum(F.col("p") + F.col("r") + len(END)), F.lit(0)).cast("long").alias("formatted_chars"))
    loss = F.concat_ws("", F.transform("replies", lambda x: x["text"]))
    return whole.select(conv, "n_turns", "turns_sha256", loss.alias("loss"), "formatted_chars").select(conv, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
