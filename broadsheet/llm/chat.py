"""Chat formatting with a grammar that a deterministic parser reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turns that one task puts together at a time before a conversation's parts meet.
CHUNK = 256


def escape(text: Column) -> Column:
    r"""One more backslash between < and |, so that no control string is left; unescape() takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def parse_turns(rendered: Column) -> Column:
    """array<struct<role,text>> from rendered text; roles and texts are unescaped.

    Grammar: (START role SEP text END)*, where role and text have no <| in them. What doesn't fit it gives no turn.
    """
    pieces = F.split(rendered, r"<\|im_end\|>", -1)
    pieces = F.filter(pieces, lambda p: p != "")

    def one(piece: Column) -> Column:
        body = F.substring(piece, len(START) + 1, F.length(piece))
        cut = F.instr(body, SEP)
        role = F.substring(body, F.lit(1), cut - 1)
        text = F.substring(body, cut + len(SEP), F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def fits(piece: Column) -> Column:
        return F.startswith(piece, F.lit(START)) & (F.instr(piece, SEP) > 0) & (F.length(piece) - F.length(F.replace(piece, F.lit("<|"), F.lit(""))) == 4)

    return F.transform(F.filter(pieces, fits), one)


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(SEP), text, F.lit(END))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn, with `rendered`: the least escaped form that the parser reads back as the source.

    First nothing is escaped; a turn that the parser doesn't give back as it was gets its conflicting text escaped;
    if that isn't identical either, role and text are. Null roles and texts count as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    levels = [render_turn(role, text), render_turn(role, escape(text)), render_turn(escape(role), escape(text))]
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    # only text with < followed by backslashes and | can fail; the cheap test spares the others the first parse
    risky = F.concat(role, F.lit("\n"), text).rlike(r"<\\*\|")
    best = F.when(~risky, levels[0])
    for x in levels:
        best = best.when(parse_turns(x) == source, x)
    return turns.withColumn("rendered", best.otherwise(F.raise_error(F.lit("a turn can't be read back"))))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: the conversation's turns by turn, then role, then text; nulls first.

    turns: conv_id, turn, role, text; other columns are not read. A null conv_id is a conversation of its own.
    Repeated rows are repeated turns. Parts of a conversation are put together first, so that a long one's rows
    don't all move to one task; its text is one value in the end, as the result has one row for each. An empty
    table gives no rows.
    """
    rows = format_turns(turns.select("conv_id", "turn", "role", "text"))
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "rendered")
    parts = rows.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("part")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    parts = parts.select("conv_id", "part", F.concat_ws("", F.transform("items", lambda x: x["rendered"])).alias("piece"))
    chats = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "piece"))).alias("pieces"))
    return chats.select("conv_id", F.concat_ws("", F.transform("pieces", lambda x: x["piece"])).alias("formatted"))


def read_chats(chats: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns, loss: what the parser recovers, and the unescaped texts under the loss mask, joined."""
    parsed = chats.withColumn("turns", parse_turns(F.col("formatted")))
    own = F.filter("turns", lambda t: t["role"] == trained)
    return parsed.withColumn("loss", F.concat_ws("", F.transform(own, lambda t: t["text"])))
