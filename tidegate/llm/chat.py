r"""Conversations as one training text each, from typed content parts; DataFrame functions only.

A turn is a row with a role and an array of parts: ``text``, ``image``, ``audio`` or
``document``. A visitor goes over the parts in order; text is escaped, every other part becomes
a placeholder ``[[kind:turn.part]]`` and leaves an attachment record with its reference and the
number of tokens a model will expand it to. The template of a turn is ::

    ### role: text</turn>\n

Inside texts and roles a backslash, ``#``, ``[``, ``:`` (roles only) and the end mark are escaped
with backslashes, so that no mark can be forged and ``unescape`` gives every text back. The loss
mask lists the places of assistant texts in the formatted text.

One conversation is one text by definition, so its turns meet in one task; each turn is formatted
before that, and places come from a running sum, not from arrays that are copied per turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import col

END = "</turn>"
MARK = "### "
PARTS = (
    "array<struct<type: string, text: string, uri: string, width: int, height: int, "
    "seconds: double, pages: int>>"
)
#: Tokens that a model puts for attachments: per image patch, second of sound and page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256


def escape(text: Column) -> Column:
    """Backslashes doubled, ``#`` and ``[`` behind one, the end mark broken by one."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    out = F.replace(out, F.lit("["), F.lit("\\["))
    return F.replace(out, F.lit(END), F.lit(END.replace("/", "\\/")))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment expands to; unknown sizes count as one patch, second or page."""

    def at_least_one(x: Column) -> Column:
        return F.greatest(F.coalesce(x, F.lit(1)), F.lit(1))

    return (
        F.when(
            part["type"] == "image",
            F.ceil(at_least_one(part["width"]) / PATCH) * F.ceil(at_least_one(part["height"]) / PATCH),
        )
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(1.0)) * PER_SECOND))
        .when(part["type"] == "document", at_least_one(part["pages"]) * PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(parts: Column, turn: Column) -> tuple[Column, Column]:
    """(text, attachments) of a turn: parts flattened in order.

    A null array has no parts, a null part or a text part without text is empty. A part of
    unknown type is an attachment of that type, so that nothing is lost.
    """
    safe = F.coalesce(parts, F.expr(f"cast(array() as {PARTS})"))
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    where = lambda i: F.concat_ws(".", F.coalesce(turn.cast("string"), F.lit("")), i.cast("string"))
    text = F.array_join(
        F.transform(
            safe,
            lambda p, i: F.when(kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
                F.concat(F.lit("[["), escape(kind(p)), F.lit(":"), where(i), F.lit("]]"))
            ),
        ),
        "",
    )
    attachments = F.filter(
        F.transform(
            safe,
            lambda p, i: F.struct(
                where(i).alias("place"), kind(p).alias("type"), p["uri"].alias("uri"), expanded_tokens(p).alias("n_tokens")
            ),
        ),
        lambda a: a["type"] != "text",
    )
    return text, attachments


def text_part(text: Column) -> Column:
    """A plain text as an array of one part."""
    nothing = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.cast("string").alias("text"),
            *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()],
        )
    )


def format_chats(
    df: DataFrame, conv: str, turn: str, role: str, parts: str, learned: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, n_attachment_tokens.

    ``loss_spans`` are (start, end) in code points of ``formatted``. Turns of equal number are
    ordered by role and text, repeated rows stay, null numbers come first, a null conversation id
    is a conversation of its own, a null role is empty.
    """
    who = F.coalesce(col(role).cast("string"), F.lit(""))
    text, attachments = visit(col(parts), col(turn))
    turns = df.select(
        col(conv).alias("conv_id"),
        col(turn).alias("turn"),
        who.alias("role"),
        text.alias("body"),
        attachments.alias("found"),
    )
    head = F.concat(F.lit(MARK), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    pieces = turns.withColumn("head", head).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    size = F.char_length("piece").cast("long")
    placed = pieces.withColumns(
        {
            "nth": F.row_number().over(order),
            "start": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size,
        }
    )
    begin = F.col("start") + F.char_length("head")
    span = F.when(
        F.col("role") == learned,
        F.struct(begin.alias("start"), (begin + F.char_length("body")).alias("end")),
    )
    return placed.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("nth", "piece"))), lambda t: t["piece"]), ""
        ).alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
        F.flatten(
            F.transform(F.sort_array(F.collect_list(F.struct("nth", "found"))), lambda t: t["found"])
        ).alias("attachments"),
        F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda a, f: a + f["n_tokens"])).alias(
            "n_attachment_tokens"
        ),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    whole = F.split(formatted, END + "\n", -1)
    pattern = r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$"
    return F.transform(
        F.slice(whole, 1, F.size(whole) - 1),
        lambda t: F.struct(
            unescape(F.regexp_extract(t, pattern, 1)).alias("role"),
            unescape(F.regexp_extract(t, pattern, 2)).alias("text"),
        ),
    )


def learned_text(formatted: Column, spans: Column) -> Column:
    """Everything under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ),
        "",
    )


def digest_columns(chats: DataFrame) -> DataFrame:
    """What the formatted text says when it is read back."""
    read = chats.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
