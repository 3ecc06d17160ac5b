"""Chat formatting with a grammar round trip, with DataFrame functions only.

Grammar of a formatted conversation::

    conversation = { "<|im_start|>" role "\\n" text "<|im_end|>\\n" }

The parser splits at every "<|im_start|>", reads the role up to the first
newline and the text up to the first "<|im_end|>", and undoes the escapes:

* in a text, "<" + n x "\\" + "|" with n > 0 stands for one backslash less;
* in a role, "%3C", "%0A" and "%25" stand for "<", newline and "%".

Each turn is first rendered as it is and parsed again.  If that does not give
back the same role and text, the text is escaped, then the role too, until it
does.  The last form always does: escaped text has no "<|" and an escaped role
has neither "<" nor a newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", "<$1|")


def escape_role(c: Column) -> Column:
    for raw, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def unescape_role(c: Column) -> Column:
    for raw, coded in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def parse(formatted: Column) -> Column:
    """Array of turns: role, text, span (code points of the escaped text), ok."""

    def one(piece: Column) -> Column:
        head = F.substring_index(piece, END, 1)
        role = F.substring_index(head, "\n", 1)
        body = F.substr(head, F.char_length(role) + 2)
        well_formed = (piece == F.concat(head, F.lit(END + "\n"))) & (F.instr(head, "\n") > 0)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape_text(body).alias("text"),
            F.char_length(body).alias("span"),
            (F.char_length(role) + F.lit(len(START) + 1)).alias("before"),
            well_formed.alias("ok"),
        )

    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def _same(formatted: Column, role: Column, text: Column) -> Column:
    turns = parse(formatted)
    first = F.try_element_at(turns, F.lit(1))
    return (F.size(turns) == 1) & F.coalesce(first["ok"] & (first["role"] == role) & (first["text"] == text), F.lit(False))


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``segment``, the rendered turn, and ``escaped`` (0, 1, 2)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # No "<", "%" or newline where it matters: the plain form is known to parse back.
    plain = ~F.contains("text", F.lit("<")) & ~F.contains("role", F.lit("<")) & ~F.contains("role", F.lit("%")) & ~F.contains("role", F.lit("\n"))
    role, text = F.col("role"), F.col("text")
    forms = [_render(role, text), _render(role, escape_text(text)), _render(escape_role(role), escape_text(text))]
    level = F.when(plain | _same(forms[0], role, text), 0).when(_same(forms[1], role, text), 1).otherwise(2)
    rows = rows.withColumn("escaped", level)
    return rows.withColumn("segment", F.when(F.col("escaped") == 0, forms[0]).when(F.col("escaped") == 1, forms[1]).otherwise(forms[2]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, escaped_turns, recovered, round_trip.

    Turns are ordered by (turn, role, text), so ties and repeated rows have one
    order; a null turn comes first.  Null role and null text are empty.  Rows
    with a null conv_id form one conversation.  An empty table gives no rows.
    ``recovered`` is what the parser reads from ``formatted``; ``round_trip``
    says that it equals the source.
    """
    by = format_turns(turns).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segment"))).alias("source"), F.sum((F.col("escaped") > 0).cast("long")).alias("escaped_turns")
    )
    out = by.select(
        "conv_id",
        F.size("source").cast("long").alias("n_turns"),
        F.array_join(F.transform("source", lambda t: t["segment"]), "").alias("formatted"),
        "escaped_turns",
        F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    out = out.withColumn("recovered", parse(F.col("formatted")))
    pairs = F.transform("recovered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return out.withColumn("round_trip", (pairs == F.col("source")) & F.forall("recovered", lambda t: t["ok"])).drop("source")


def loss_text(recovered: Column) -> Column:
    """All text under the loss mask: the assistant turns, in order, nothing between."""
    return F.array_join(F.transform(F.filter(recovered, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def loss_spans(formatted: DataFrame) -> DataFrame:
    """Loss mask of each formatted conversation: conv_id, start, length in code points of ``formatted``."""
    step = F.aggregate(
        "recovered",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["before"] + t["span"] + F.lit(len(END) + 1)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["before"]).alias("start"), t["span"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return formatted.select("conv_id", F.inline(step["spans"]))


def digests(formatted: DataFrame) -> DataFrame:
    """What ``format_conversations`` produced, as digests read back from its output."""
    turns = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("recovered"))
    return formatted.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "escaped_turns",
        "round_trip",
    )
