r"""Chat formatting as a relational plan, with Spark expressions only.

Turns are collected as structs and sorted by (turn, role, text); adjacent turns
of one role become one message, whose parts the mark <|next|> keeps apart, so
that reading back gives the turns as they came:

    <|turn|>ROLE<|says|>TEXT<|next|>TEXT<|end|>

Inside roles and texts a backslash is doubled and every control string gets a
backslash behind its first character; removing the backslashes, each with the
character behind it kept, restores the text.

Nulls: null role or text: empty; a null conversation id is a conversation of its
own; null turns come first. Repeated turns stay. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinvec.llm.common import prefix_sums

TURN, SAYS, NEXT, END = "<|turn|>", "<|says|>", "<|next|>", "<|end|>"
#: Control strings of common chat templates; "<|" covers the marks above.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """-> conv_id, formatted, loss_spans array<struct<start, length>> (code points
    of `formatted` that a loss counts: the assistant's texts)."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    starts = F.filter(
        F.transform("a", lambda x, i: F.when((i == 0) | (x.role != F.get("a", i - 1).role), i)), lambda i: i.isNotNull()
    )
    c = c.withColumn("b", starts)
    merged = F.transform(
        "b",
        lambda s, j: F.struct(
            F.get("a", s).role.alias("role"),
            F.transform(F.slice("a", s + 1, F.coalesce(F.get("b", j + 1), F.size("a")) - s), lambda x: x.text).alias("texts"),
        ),
    )
    c = c.withColumn("m", merged)
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "m",
            lambda g: F.concat(
                F.flatten(
                    F.transform(
                        g.texts,
                        lambda x, i: F.array(
                            piece(F.when(i == 0, F.concat(F.lit(TURN), escape(g.role), F.lit(SAYS))).otherwise(F.lit(NEXT)), no),
                            piece(escape(x), g.role == "assistant"),
                        ),
                    )
                ),
                F.array(piece(F.lit(END), no)),
            ),
        )
    )
    c = c.select("conv_id", segments.alias("p")).withColumn("n", F.transform("p", lambda x: F.length(x.s)))
    c = c.withColumn("at", prefix_sums(F.col("n")))
    spans = F.filter(
        F.zip_with("p", "at", lambda x, at: F.struct(at.alias("start"), F.length(x.s).alias("length"), x.loss.alias("loss"))),
        lambda x: x.loss,
    )
    return c.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x.s), "").alias("formatted"),
        F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.length.alias("length"))).alias("loss_spans"),
    )


def _quoted(mark: str) -> str:
    return mark.replace("|", "\\|")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses `formatted` -> adds turns array<struct<role, text>> and loss_texts."""
    formatted = formatted.withColumn("blocks", F.split("formatted", _quoted(TURN), -1))
    blocks = F.slice("blocks", F.lit(2), F.size("blocks"))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda x: F.transform(
                F.split(F.regexp_replace(F.substring_index(x, SAYS, -1), _quoted(END) + r"\z", ""), _quoted(NEXT), -1),
                lambda t: F.struct(unescape(F.substring_index(x, SAYS, 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.length)))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", loss).drop("blocks")
