"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar of a formatted conversation, a plain concatenation of turns:

    conversation := turn*
    turn         := "[INST]" text "[/INST]"              user
                  | "<s>" text "</s>"                    assistant (text is under the loss mask)
                  | "<<SYS>>" text "<</SYS>>"            system
                  | "[ROLE]" role "[:]" text "[/ROLE]"   any other role

A text may hold the control strings themselves. Every conversation is first rendered as it is and
parsed again; only where the recovered turns differ from the source, its texts are escaped and
rendered again. Escaping puts a backslash behind the first bracket of each control string (and of
each string that already looks escaped); the parser takes one away. An escaped text holds no
control string, so the second rendering always parses back; ``round_trip`` says so per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAIL = r"(/?INST\]|/?s>|<SYS>>|</SYS>>|/?ROLE\]|:\])"
_PLAIN = r"([\[<])(\\*)" + _TAIL
_ESCAPED = r"([\[<])\\(\\*)" + _TAIL
_TURN = (
    r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE\].*?\[/ROLE\]"
)
_MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _render_turn(role: Column, text: Column) -> Column:
    other = F.concat(F.lit("[ROLE]"), role, F.lit("[:]"), text, F.lit("[/ROLE]"))
    out = None
    for name, (begin, end) in _MARKS.items():
        turn = F.concat(F.lit(begin), text, F.lit(end))
        out = F.when(role == name, turn) if out is None else out.when(role == name, turn)
    return out.otherwise(other)


def _render(turns: Column, change=lambda x: x) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: _render_turn(F.when(t["role"].isin(*_MARKS), t["role"]).otherwise(change(t["role"])), change(t["text"]))), ""
    )


def _inner(turn: Column, begin: str, end: str) -> Column:
    return F.substring(turn, F.lit(len(begin) + 1), F.length(turn) - len(begin) - len(end))


def _parse_turn(turn: Column) -> Column:
    """struct(role, text) of one matched turn."""
    body = _inner(turn, "[ROLE]", "[/ROLE]")
    cut = F.locate("[:]", body)
    other = F.struct(
        unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"),
        unescape(F.substring(body, cut + 3, F.length(body))).alias("text"),
    )
    out = None
    for name, (begin, end) in _MARKS.items():
        got = F.struct(F.lit(name).alias("role"), unescape(_inner(turn, begin, end)).alias("text"))
        test = turn.startswith(begin)
        out = F.when(test, got) if out is None else out.when(test, got)
    return out.otherwise(other)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, array of struct(role, text)."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), _parse_turn)


def _covers(formatted: Column) -> Column:
    """Whether nothing stands between the turns."""
    return F.regexp_replace(formatted, _TURN, "") == ""


def _canonical(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv, formatted, turns, escaped, round_trip``.

    ``turns`` are read back from ``formatted``. Turns go by ``turn``, ties by role, then text;
    a null turn number comes first, a null role or text counts as empty, repeated rows are turns of
    their own, a null conversation id is a conversation. No rows give no rows.
    """
    clean = rows.select(
        F.col(conv).alias(conv),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    source = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = clean.groupBy(conv).agg(source.alias("source"))
    raw = grouped.withColumn("raw", _render("source"))
    fits = F.coalesce((parse(F.col("raw")) == F.col("source")) & _covers(F.col("raw")), F.lit(False))
    chosen = raw.withColumn("escaped", ~fits).withColumn(
        "formatted", F.when(F.col("escaped"), _render("source", escape)).otherwise(F.col("raw"))
    )
    back = chosen.withColumn("turns", parse(F.col("formatted")))
    return back.select(
        conv,
        "formatted",
        "turns",
        "escaped",
        ((F.col("turns") == F.col("source")) & _covers(F.col("formatted"))).alias("round_trip"),
    )


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digest columns of ``format_conversations``' output, all from what was read back."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return formatted.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(_canonical(F.col("turns")), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "round_trip",
    )
