"""Chat transcripts from event logs.

A log has events (conv_id, seq, turn, kind, role, text). Its events are partitioned by conversation and folded in the
order of seq:

- message: the message of that turn begins, with text; what the turn had before is gone.
- delta: text is appended to the turn's message, which begins empty if there is none.
- edit: the turn's message becomes text, and all messages of later turns are dropped.
- regenerate: the turn's message becomes text (or empty, for deltas to follow), and messages of later turns are dropped.
- delete: the turn's message is dropped.

What is left is rendered in the order of turns. The fold is done by windows over one exchange by conversation: of a turn's
events only those count that come after the last one that sets or drops its message.

Defined cases. Equal events are one event. Events of a conversation with the same seq come in the order of (turn, kind,
role, text), nulls first. Events with a null conv_id, seq or turn, or of an unknown kind, are ignored. A null text is
empty; a message's role is the last one that its events name, "user" if none does. A conversation with no message left has
no row; an empty log has none. Texts may have any length. Further columns are ignored, whatever their names. Rows of a table of
turns that have one (conv_id, turn) are messages of their own (``events_of``). In texts "<|" is written "< |", so that no text can pass for a marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "struct<i:int,turn:bigint,kind:string,role:string,text:string>"
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages of a log."""
    e = events.select("conv_id", "seq", "turn", "kind", "role", "text")
    e = e.where(F.col("conv_id").isNotNull() & F.col("seq").isNotNull() & F.col("turn").isNotNull() & F.col("kind").isin(*KINDS)).repartition("conv_id").distinct()
    kind = F.col("kind")
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "turn", "kind", "role", "text")))
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("turn", F.col("turn").cast("long"))
    e = e.withColumn("dropped", F.max(F.when(kind.isin("edit", "regenerate"), F.col("at"))).over(before))
    own = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("reset", F.greatest(F.coalesce("dropped", F.lit(0)), F.coalesce(F.max(F.when(kind != "delta", F.col("at"))).over(own), F.lit(0))))
    live = (kind.isin("message", "edit", "regenerate") & (F.col("at") == F.col("reset"))) | ((kind == "delta") & (F.col("at") > F.col("reset")))
    e = e.withColumn("role", F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role"))).over(own)["role"]).where(live)
    parts = F.array_sort(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("text"))))
    out = e.groupBy("conv_id", "turn").agg(F.coalesce(F.first("role"), F.lit("user")).alias("role"), parts.alias("parts"))
    return out.select("conv_id", "turn", "role", F.array_join(F.col("parts.text"), "").alias("text"))


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render(final: DataFrame) -> DataFrame:
    """conv_id, n_messages, transcript."""
    line = F.concat(F.lit("<|im_start|>"), _safe(F.col("role")), F.lit("\n"), _safe(F.col("text")), F.lit("<|im_end|>\n"))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    out = final.groupBy("conv_id").agg(lines.alias("lines"))
    return out.select("conv_id", F.size("lines").cast("long").alias("n_messages"), F.array_join(F.col("lines.line"), "").alias("transcript"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A log whose fold gives the turns of a table (conv_id, turn, role, text), with every kind of event.

    Each row is a message of its own, also where rows have the same conv_id and turn, or are equal; such rows come in the
    order of (role, text), nulls first. The turn in the log is the number of the row in its conversation. By that number
    in turn, a message is streamed by lines; written as a draft, answered, and edited, which drops the answer; streamed in
    part, regenerated and streamed by lines; or written as a draft, deleted, and streamed by lines.
    """
    c = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    c = c.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    turn, role, draft = F.col("turn"), F.col("role"), F.coalesce(F.substring("text", 1, 40), F.lit(""))

    def event(i: Column | int, kind: str, text: Column | str, turn: Column = turn, role: Column = role) -> Column:
        at = i if isinstance(i, Column) else F.lit(i)
        return F.struct(at.cast("int").alias("i"), turn.alias("turn"), F.lit(kind).alias("kind"), role.alias("role"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))

    lines = F.coalesce(F.transform(F.split("text", "(?<=\n)"), lambda x, i: event(i + 3, "delta", x)), F.array().cast(f"array<{EVENT}>"))
    answer = event(1, "message", draft, turn + 1, F.lit(None).cast("string"))
    log = (
        F.when(turn % 4 == 1, F.concat(F.array(event(0, "message", "")), lines))
        .when(turn % 4 == 2, F.array(event(0, "message", draft), answer, event(2, "edit", F.col("text"))))
        .when(turn % 4 == 3, F.concat(F.array(event(0, "message", ""), event(1, "delta", draft), event(2, "regenerate", "")), lines))
        .otherwise(F.concat(F.array(event(0, "message", draft), event(1, "delete", ""), event(2, "message", "")), lines))
    )
    out = c.select("conv_id", (turn.cast("decimal(38,0)") * (1 << 32)).alias("seq"), F.explode(log).alias("e"))
    return out.select("conv_id", (F.col("seq") + F.col("e.i")).alias("seq"), "e.turn", "e.kind", "e.role", "e.text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_messages, transcript of a table of turns, by way of a log of them."""
    return render(messages(events_of(conversations)))


SQL = """
select conv_id, count(*) as n_messages,
       string_agg('<|im_start|>' || replace(coalesce(role, 'user'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' order by turn) as transcript
from conversations where conv_id is not null and turn is not null group by conv_id
"""
