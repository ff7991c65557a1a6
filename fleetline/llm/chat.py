"""Chat formatting by a grammar round trip.

``format_chats`` renders each conversation as ``<|im_start|>role\\ntext<|im_end|>\\n``
per turn.  A deterministic parser reads the rendered text back; a turn whose
role or text does not come back identical gets its conflicting content escaped
and is rendered again, and a conversation that still differed would raise.

Grammar of the rendered text::

    chat := turn*
    turn := "<|im_start|>" role "\\n" body "<|im_end|>\\n"
    role, body contain no "<|"; role contains no line feed

Escapes (always undone by the parser): ``<|`` becomes ``<\\|``, and ``<\\|`` with
n backslashes becomes n + 1; in a role a line feed becomes ``<n>`` and ``<\\n>``
with n backslashes becomes n + 1.

Defined results: a null role or text is empty; rows with equal turns are
ordered by role, then text, nulls of ``turn`` first, and repeated rows stay; a
null conv_id is a conversation of its own; an empty table gives no rows; other
columns are ignored.  A conversation is one output row and so is held whole by
one task, as its digest needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind

# The control strings of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.regexp_replace(escape_text(c), r"<(\\*)n>", r"<\\$1n>"), F.lit("\n"), F.lit("<n>"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.regexp_replace(F.replace(c, F.lit("<n>"), F.lit("\n")), r"<\\(\\*)n>", "<$1n>"))


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(CLOSE + "\n"))


def parse_turn(piece: Column) -> Column:
    """The turn that a piece behind an ``OPEN`` holds as struct(role, text), or
    null if it breaks the grammar."""
    role = F.substring_index(piece, "\n", 1)
    after = F.substring(piece, F.length(role) + 2, F.length(piece))
    body = F.substring_index(after, CLOSE, 1)
    whole = F.concat(role, F.lit("\n"), body, F.lit(CLOSE + "\n")) == piece
    clean = ~F.contains(role, F.lit("<|")) & ~F.contains(body, F.lit("<|"))
    return F.when(whole & clean, F.struct(unescape_role(role).alias("role"), unescape_text(body).alias("text")))


def parse_chat(formatted: Column) -> Column:
    """Array of struct(role, text) read from rendered text; a turn that breaks
    the grammar is null, and so is a chat with content before its first turn."""
    pieces = F.split(formatted, r"\Q" + OPEN + r"\E", -1)
    return bind(pieces, lambda p: F.when(
        F.get(p, F.lit(0)) == "", F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), parse_turn)))


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows ``(conv_id, formatted, loss_spans)``: the rendered text and the
    loss mask as code-point spans ``(start, length)`` of the assistant bodies,
    in order, from rows ``(conv_id, turn, role, text)``."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    raw = render_turn(F.col("role"), F.col("text"))
    back = parse_turn(F.substring(raw, len(OPEN) + 1, F.length(raw)))
    # one turn alone shows every conflict: bodies and roles without "<|" cannot join into a marker
    same = F.coalesce(back == F.struct("role", "text"), F.lit(False))
    t = t.withColumn("conflict", ~same)
    t = t.select("conv_id", "turn", "role", "text",
                 F.when(F.col("conflict"), escape_role(F.col("role"))).otherwise(F.col("role")).alias("role_out"),
                 F.when(F.col("conflict"), escape_text(F.col("text"))).otherwise(F.col("text")).alias("body"))
    t = t.withColumn("n_body", F.length("body").cast("long")).withColumn(
        "n_head", (F.length("role_out") + F.lit(len(OPEN) + 1)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("k", F.row_number().over(order)).withColumn(
        "end", F.sum(F.col("n_head") + F.col("n_body") + F.lit(len(CLOSE) + 1)).over(
            order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.lit(len(CLOSE) + 1) - F.col("n_body")
    chats = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "k", "role", "text", render_turn(F.col("role_out"), F.col("body")).alias("out"),
        start.alias("start"), F.col("n_body").alias("length")))).alias("t"))
    chats = chats.select("conv_id", "t", F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = F.when(parse_chat(F.col("formatted")) == source, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("chat does not survive its round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    spans = F.transform(F.filter("t", lambda x: x["role"] == LOSS_ROLE),
                        lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return chats.select("conv_id", checked.alias("formatted"), spans.alias("loss_spans"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the rendered text and the
    loss mask of ``format_chats``."""
    turns = F.array_join(F.transform(parse_chat(F.col("formatted")), lambda x: F.concat(
        x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape_text(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    d = chats.select("conv_id", "formatted", F.size(parse_chat(F.col("formatted"))).cast("long").alias("n_turns"),
                     F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"))
    return d.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
