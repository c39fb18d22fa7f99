"""Conversations as training text, in Spark expressions only.

A block is ``<|im_start|>role`` newline texts ``<|im_end|>`` newline, where adjacent turns of one
role share a block and ``<|im_sep|>`` parts their texts. A backslash goes before every backslash
and between ``<`` and ``|`` of any text or role, and before a newline of a role, so texts cannot
hold control strings and everything can be read back. The loss covers the assistant's texts,
without control strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.tables import named

# Fixed marks of the format.
START, END, PART = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
ASSISTANT = "assistant"
_WIDE, _LETTER = "UTF-32", b"\0\0\0x"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def format_conversations(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = ASSISTANT
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss`` (spans of code points: start from 0, length).

    Turns are in the order of their number, those without one first; turns of one number are in
    the order of role and text, and repeated rows are turns of their own. A null role or text is
    empty. Rows without a conversation form one. Other columns are not read. The time is
    linear in the turns of a conversation but for sorting them, and rows move once.
    """
    rows = turns.select(
        named(turns, conversation).alias("conv_id"),
        F.struct(
            named(turns, turn).alias("turn"), F.coalesce(named(turns, role), F.lit("")).alias("role"), F.coalesce(named(turns, text), F.lit("")).alias("text")
        ).alias("turn"),
    )
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    # Each turn's own piece depends on its neighbours only: does it begin a block, does it end one?
    count = F.size("turns")
    before = F.transform("turns", lambda t, i: (i > 0) & F.when(i > 0, F.element_at("turns", i)["role"] == t["role"]).otherwise(False))
    with_same = sorted_.withColumn("same", before)

    def piece(t: Column, i: Column) -> Column:
        begins = ~F.element_at("same", i + 1)
        ends = F.when(i + 1 < count, ~F.element_at("same", F.least(i + 2, count))).otherwise(True)
        head = F.when(begins, F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n"))).otherwise(F.lit(PART))
        return F.struct(
            head.alias("head"), escaped(t["text"]).alias("body"), F.when(ends, F.lit(END)).otherwise(F.lit("")).alias("tail"), (t["role"] == trained).alias("trained")
        )

    pieces = with_same.select("conv_id", F.posexplode(F.transform("turns", piece)).alias("at", "piece"))
    # Where a body begins: a running length, kept by the partitioning of the first grouping.
    length = F.length("piece.head") + F.length("piece.body") + F.length("piece.tail")
    before_it = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(before_it), F.lit(0)) + F.length("piece.head")
    placed = pieces.select(
        "conv_id",
        "at",
        F.concat("piece.head", "piece.body", "piece.tail").alias("piece"),
        F.when(F.col("piece.trained"), F.struct(start.cast("int").alias("start"), F.length("piece.body").alias("length"))).alias("span"),
    )
    joined = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "span"))).alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    spans = F.transform(F.filter("pieces", lambda p: p["span"].isNotNull()), lambda p: p["span"])
    return joined.select(F.col("conv_id").alias(conversation), formatted.alias("formatted"), spans.alias("loss"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` needs it for every element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"\Q" + START + r"\E")
    blocks = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def texts(block: Column) -> Column:
        parts_ = F.split(block["body"], r"\Q" + PART + r"\E")
        return F.transform(parts_, lambda t: F.struct(block["role"].alias("role"), unescaped(t).alias("text")))

    def turns(block: Column) -> Column:
        role = F.regexp_extract(block, r"(?s)\A((?:[^\\\n]|\\.)*+)\n", 1)

        def parted(role_: Column) -> Column:
            body = F.substring(block, F.length(role_) + 2, F.length(block) - F.length(role_) - 1 - len(END))
            return F.struct(unescaped(role_).alias("role"), body.alias("body"))

        return _bound(_bound(role, parted), texts)

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, read back."""

    # Four bytes for each code point, so that a span is cut where it stands and not counted off
    # from the start. A letter before it keeps a byte order mark that begins a span.
    def cut(wide: Column) -> Column:
        def text(s: Column) -> Column:
            span = F.substring(wide, 4 * s["start"] + 1, 4 * s["length"])
            return F.substring(F.decode(F.concat(F.lit(_LETTER), span), _WIDE), F.lit(2), s["length"])

        return F.array_join(F.transform(loss, text), "")

    return unescaped(_bound(F.encode(formatted, _WIDE), cut))
