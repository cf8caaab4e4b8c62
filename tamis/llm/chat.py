"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context and only its text is trainable. Turns behind the
last assistant turn become one example more, with nothing trainable, so that the output holds every turn.

A turn is written `### role: text </turn>` and a line feed. Only what could be read as a control string is escaped inside roles and texts: a
backslash goes behind the first character of `### ` (also of `###` at the end), of `</turn>` and, in roles, of `: `. Where backslashes stand at
that place already they stay and one is added, so that taking one away gives the text back. All other text is written as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", " </turn>\n"
#: Control strings, cut behind their first character: its pattern, and that of the rest.
CONTROLS = (("#", r"##(?= |\z)"), ("<", "/turn>"))
IN_ROLES = ((":", " "),)


def escaped(text: Column, controls: tuple = CONTROLS) -> Column:
    for first, rest in controls:
        text = F.regexp_replace(text, rf"{first}(\\*)({rest})", rf"{first}\\$1$2")
    return text


def unescaped(text: Column, controls: tuple = CONTROLS) -> Column:
    for first, rest in controls:
        text = F.regexp_replace(text, rf"{first}\\(\\*)({rest})", f"{first}$1$2")
    return text


def expand(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, example (from 1), text, loss_start, loss_end (code points of the reply inside text;
    both null in the example of trailing turns), last (whether it is its conversation's last example).

    One shuffle, by conversation; a conversation's turns meet in one row, as its formatted text has to, and the examples of a conversation
    are then made from that row one by one. Their total length grows with the square of the number of turns, as the method asks. Turns go
    by number, a null number first; ties by role, then text, repeated rows one by one. A null text or role is empty; rows of a null conv_id are one
    conversation. Extra columns are left out. No rows give none.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", (F.col("role") == target).alias("own"), role.alias("role"), text.alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.coalesce("own", F.lit(False)).alias("own")))).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda x: F.struct(x["own"].alias("own"), escaped(x["role"], CONTROLS + IN_ROLES).alias("role"), escaped(x["text"]).alias("text"))).alias("t"))
    piece = F.transform("t", lambda x: F.concat(F.lit(HEAD), x["role"], F.lit(COLON), x["text"], F.lit(END)))
    convs = convs.select("conv_id", F.transform("t", lambda x: F.struct(x["own"].alias("own"), F.length(x["text"]).alias("n"))).alias("t"), piece.alias("pieces"))
    at = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.get("t", i - 1)["own"] | (i == F.size("t")))
    convs = convs.withColumn("at", at).select("conv_id", "t", "pieces", F.size("at").alias("k"), F.posexplode("at").alias("example", "i"))
    made = convs.select("conv_id", (F.col("example") + 1).alias("example"), F.array_join(F.slice("pieces", F.lit(1), F.col("i")), "").alias("text"), F.get("t", F.col("i") - 1).alias("t"), (F.col("example") + 1 == F.col("k")).alias("last"))
    end = F.when(F.col("t.own"), F.length("text") - len(END))
    return made.select("conv_id", "example", "text", (end - F.col("t.n")).alias("loss_start"), end.alias("loss_end"), "last")


def read_back(examples: DataFrame) -> DataFrame:
    """Examples -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, as the formatted texts and masks have them;
    a row for each conversation, a null conv_id included, and none for no examples. A conversation without a reply has an empty loss text."""
    piece = lambda x: F.substring(x, len(HEAD) + 1, 2**31 - 1)
    turns = F.split("text", END, -1)
    parsed = F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda x: F.concat(
        unescaped(F.substring_index(piece(x), COLON, 1), CONTROLS + IN_ROLES), F.lit("\n"),
        unescaped(F.substr(piece(x), F.length(F.substring_index(piece(x), COLON, 1)) + len(COLON) + 1)), F.lit("\n")))
    reply = F.when(F.col("loss_end").isNotNull(), unescaped(F.substr(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    rows = examples.select("conv_id", "example", F.length("text").cast("long").alias("n"), reply.alias("reply"), F.when(F.col("last"), parsed).alias("turns"))
    out = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: F.coalesce(x["reply"], F.lit(""))), "").alias("loss"), F.max_by("turns", F.col("example")).alias("turns"), F.sum("n").alias("formatted_chars"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(F.array_join("turns", "")).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")
