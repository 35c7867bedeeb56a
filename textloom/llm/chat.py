"""Chat formatting: event-sourced reconstruction, DataFrame functions only.

A log holds events of ``kind`` message, delta, edit or regenerate.  Logs are dealt by conversation, each message's events
are sorted by ``seq`` and folded (a delta appends; a message or an edit replaces what was there; a regeneration throws it
away and starts again), and the messages are rendered with a template that marks turns and escapes control strings.

Defined results: a null text or role counts as empty; an event that repeats an earlier one's (conversation, message, seq)
wholly is folded once; a table's repeated rows are turns of their own; ties of ``turn`` go by role, then text; a null
conversation is a conversation; an empty table gives no conversation.  Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
_CHUNK = r"<\|im_end\|>\n"
_LOSS = r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """Reversible: afterwards no control string is left."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def events_of(rows: DataFrame) -> DataFrame:
    """A table of whole messages (conv_id, turn, role, text) as a log: one message event a row."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("message", F.row_number().over(order).cast("long")).withColumns({"seq": F.lit(0).cast("long"), "kind": F.lit("message")})


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, message, role, text) of a log (conv_id, message, turn, seq, kind, role, text)."""
    event = F.struct(F.col("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "turn", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    log = log.withColumn("log", F.array_distinct("log"))
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(0)), lambda i: i > 0)
    start = F.greatest(F.coalesce(F.array_max(resets), F.lit(1)), F.lit(1))
    log = log.withColumn("log", F.slice("log", start, F.size("log")))
    role = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != "")
    # what a regeneration says of itself isn't part of the message
    text = F.array_join(F.transform("log", lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"])), "")
    return log.select("conv_id", "turn", "message", F.coalesce(F.get(role, F.lit(0)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted): the messages of each conversation in order, as one training string."""
    turn = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "message", turn.alias("out"))))
    return messages.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted string."""
    chunks = F.split(formatted, _CHUNK)
    bodies = F.transform(F.slice(chunks, F.lit(1), F.size(chunks) - 1), lambda c: F.substr(c, F.lit(len(START) + 1)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substr(body, F.char_length(role) + 2)).alias("text"))

    return F.transform(bodies, turn)


def loss_text(formatted: Column) -> Column:
    """All text under the loss mask (what assistants say), unescaped."""
    return unescape(F.array_join(F.regexp_extract_all(formatted, F.lit(_LOSS), F.lit(1)), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the strings themselves."""
    turns = formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
