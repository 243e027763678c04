"""Conversations as marked-up training text that parses back to its turns; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.arrays import running

START, END, ESCAPED = "<|im_start|>", "<|im_end|>", "<|escaped|>"


def _escape(text: Column) -> Column:
    """Reversible, and free of "<|": & to &amp; and then <| to &lt;|."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def _unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return _unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def _render(role: Column, text: Column, escaped: bool) -> Column:
    return F.concat(F.lit(START), _escape_role(role), F.lit(ESCAPED if escaped else ""), F.lit("\n"), _escape(text) if escaped else text, F.lit(END + "\n"))


def _parse_turn(block: Column) -> Column:
    """What stands between one start mark and the next: role, text, and whether the block is well formed."""
    head = F.substring_index(block, "\n", 1)
    rest = F.substring(block, F.length(head) + F.lit(2), F.length(block))
    body = F.substring_index(rest, END, 1)
    marked = F.endswith(head, F.lit(ESCAPED))
    return F.struct(
        _unescape_role(F.when(marked, F.substring(head, F.lit(1), F.length(head) - len(ESCAPED))).otherwise(head)).alias("role"),
        F.when(marked, _unescape(body)).otherwise(body).alias("text"),
        F.equal_null(rest, F.concat(body, F.lit(END + "\n"))).alias("whole"),
    )


def parse(formatted: Column) -> Column:
    """The grammar: turn* with turn = START role [ESCAPED] newline text END newline. Array of (role, text, whole)."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), _parse_turn)


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation, from rows of conv_id, turn, role and text.

    Each turn is rendered plain, parsed again and, where that doesn't give the turn back, rendered escaped. The whole
    conversation is parsed too; if its turns differ from the source, all of them are escaped. loss_spans are code-point
    ranges (start, end, escaped) of assistant texts in `formatted`. Null roles and texts are empty; turns of equal number
    are ordered by role and text, repeated rows stay; an empty table gives an empty one; other columns are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    source = F.array(F.struct(role.alias("role"), text.alias("text"), F.lit(True).alias("whole")))
    plain, escaped = _render(role, text, False), _render(role, text, True)
    by_turn = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), plain.alias("plain"), escaped.alias("escaped"), F.equal_null(parse(plain), source).alias("same"))
    by_turn = by_turn.select("conv_id", F.struct("turn", "role", "text", F.when(F.col("same"), F.col("plain")).otherwise(F.col("escaped")).alias("out"), (~F.col("same")).alias("marked"), "escaped").alias("t"))
    whole = by_turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    wanted = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), F.lit(True).alias("whole")))
    whole = whole.withColumn("same", F.equal_null(parse(F.array_join(F.transform("t", lambda x: x["out"]), "")), wanted))
    out = F.transform("t", lambda x: F.struct(F.when(F.col("same"), x["out"]).otherwise(x["escaped"]).alias("out"), (x["marked"] | ~F.col("same")).alias("marked"), (x["role"] == "assistant").alias("loss")))
    whole = whole.select("conv_id", out.alias("t")).withColumn("formatted", F.array_join(F.transform("t", lambda x: x["out"]), ""))
    # Ends of the turns in code points, then the text's own range: after the header, before the end mark and newline.
    ends = running(F.transform("t", lambda x: F.length(x["out"])))

    def span(x: Column) -> Column:
        turn, end = x["x"], x["end"]
        start = end - F.length(turn["out"]) + F.length(F.substring_index(turn["out"], "\n", 1)) + F.lit(1)
        return F.struct(start.alias("start"), (end - F.lit(len(END) + 1)).alias("end"), turn["marked"].alias("escaped"))

    spans = F.transform(F.filter(F.arrays_zip(F.col("t").alias("x"), ends.alias("end")), lambda x: x["x"]["loss"]), span)
    return whole.select("conv_id", "formatted", spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order, nothing between."""
    piece = lambda s: F.substring(formatted, s["start"] + F.lit(1), s["end"] - s["start"])
    return F.array_join(F.transform(spans, lambda s: F.when(s["escaped"], _unescape(piece(s))).otherwise(piece(s))), "")


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, whole), loss_text and formatted_chars, parsed from the formatted text and its mask."""
    return formatted.select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
