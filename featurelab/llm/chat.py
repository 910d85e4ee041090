"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, only
that reply under the loss.  Written out, the contexts of a conversation grow with the square
of its turns.  ``prefix_targets`` therefore chains them: a row holds the formatted turns since
the previous example of its conversation (``context``), its reply, and the sizes of the whole
context.  ``expanded`` writes every example out whole, in pieces of bounded length, and
``read_back`` reads those.  Turns after the last reply form a closing row without a reply.

An example is a beginning of its conversation's formatted text.  That text is cut into
blocks of ``PIECE`` code points, and examples are joined with the blocks they cover: no task
holds a conversation, however long.

Template: ``<|role|>\\n`` text ``</s>\\n``.  Control strings inside roles and texts get a
backslash after their first character (one more, if there are some), which is taken out
again when reading: the texts come back unchanged and never look like control strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.session import ship_package

from .stage import written

# fixed values: strings that tokenizers of chat models take for control tokens
_CONTROL = r"(?=\||/?s>|/?INST\]|>)"
_ESCAPE = re.compile(r"([<\[|])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[|])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def head(role: str) -> str:
    return f"<|{escape(role)}|>\n"


END = "</s>\n"
EXAMPLE_SCHEMA = ("conv_id long, example long, context_turns long, context_chars long, context string, "
                  "reply string, loss_start long, loss_end long, chars long")


class _Open:
    """The conversation being read: turns not yet in an example."""

    def __init__(self, conv):
        self.conv, self.example, self.turns, self.chars = conv, 0, 0, 0
        self.new: list[str] = []

    def context(self, role: str, text: str) -> None:
        self.new.append(f"{head(role)}{escape(text)}{END}")
        self.turns += 1

    def row(self, role: str | None = None, text: str | None = None) -> tuple:
        context = "".join(self.new)
        before = self.chars + len(context)
        first, body = ("", "") if role is None else (head(role), escape(text))
        reply = "" if role is None else first + body + END
        start, end = (None, None) if role is None else (before + len(first), before + len(first) + len(body))
        out = (self.conv, self.example, self.turns, before, context, None if role is None else reply,
               start, end, before + len(reply))
        self.example += 1
        self.turns += role is not None
        self.chars, self.new = before + len(reply), []
        return out


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held, open_ = [], 0, None
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
    names = [c.split()[0] for c in EXAMPLE_SCHEMA.split(", ")]

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if open_ is None or open_.conv != conv:
                if open_ is not None and open_.new:
                    rows.append(open_.row())
                open_ = _Open(conv)
            if role == "assistant":
                rows.append(open_.row(role, text))
            else:
                open_.context(role, text)
            held += len(text)
            if held > 4 << 20:
                if rows:
                    yield out()
                rows, held = [], 0
    if open_ is not None and open_.new:
        rows.append(open_.row())
    if rows:
        yield out()


def prefix_targets(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per assistant turn, and a closing row (null reply) for turns after the last.

    (conv_id, example from 0, context_turns and context_chars: all preceding turns, context:
    the formatted ones since the previous example, reply: formatted, loss_start and loss_end:
    its text's place in the whole example, chars: length of the whole example.)  Rows of a
    conversation are adjacent and in order.

    Turns go by number (null first; ties by role, then text; repeated rows stay).  Null texts
    and roles count as empty; only the role ``assistant`` is trained on.  Rows with a null
    conv_id form one conversation.  A conversation without a reply gives its closing row
    only; no rows give none.  A conversation is read as a stream: one task holds the turns
    between two replies, not the conversation.
    """
    ship_package(conversations.sparkSession)
    src = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(_expand, EXAMPLE_SCHEMA))


#: Code points of a piece of an example.
PIECE = 1 << 18


def expanded(examples: DataFrame, piece_chars: int = PIECE) -> DataFrame:
    """Every example (of ``prefix_targets``) with its whole text, all preceding turns included:
    (conv_id, example, piece from 0, text, own_start, loss_start, loss_end).

    Examples up to ``piece_chars`` code points are one piece, longer ones follow on in order.
    own_start is where the text goes beyond the previous example's; it and the loss span are
    places in the whole example.  The closing row of a conversation has no loss span.  The
    chained rows are written once; a group holds the parts of one block only."""
    rows = written(examples, "chat").withColumn("own", F.concat("context", F.coalesce("reply", F.lit(""))))
    rows = rows.withColumn("own_start", F.col("chars") - F.length("own")).filter("chars > own_start")
    size, last = F.lit(piece_chars).cast("long"), F.expr(f"(chars - 1) div {piece_chars}")
    at = F.greatest(F.col("block") * size, F.col("own_start"))
    end = F.least((F.col("block") + 1) * size, F.col("chars"))
    parts = (rows.withColumn("block", F.explode(F.sequence(F.expr(f"own_start div {piece_chars}"), last)))
             .select(F.col("conv_id").alias("conv"), "block", at.alias("at"), F.substring(
                 "own", (at - F.col("own_start") + 1).cast("int"), (end - at).cast("int")).alias("part")))
    blocks = parts.groupBy("conv", "block").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("text"))
    covers = rows.select("conv_id", "example", "own_start", "loss_start", "loss_end", "chars",
                         F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    left = F.col("chars") - F.col("piece") * size
    text = F.when(left >= size, F.col("text")).otherwise(F.substring("text", F.lit(1), F.least(left, size).cast("int")))
    return (covers.join(blocks, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("piece") == F.col("block")))
            .select("conv_id", "example", "piece", text.alias("text"), "own_start", "loss_start", "loss_end"))


DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long, n_examples long")


class _Reading:
    """The conversation being read back: its digests, and text whose turn has not ended yet."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars, self.examples = conv, 0, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()
        self.buffer, self.at = "", 0

    def read(self, text: str, at: int, start: int | None, end: int | None) -> None:
        """``text`` stands at ``at``; code points from ``start`` to ``end`` are under the loss."""
        if not self.buffer:
            self.at = at
        self.buffer += text
        done = 0
        while m := _TURN.match(self.buffer, done):
            done = m.end()
            self.turns += 1
            self.said.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            if start is not None:
                lo, hi = max(start - self.at, m.start()), min(end - self.at, m.end())
                if lo < hi:
                    said = unescape(self.buffer[lo:hi])
                    self.loss_chars += len(said)
                    self.loss.update(said.encode())
        self.buffer, self.at = self.buffer[done:], self.at + done

    def row(self) -> tuple:
        return (self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
    kinds = [pa.string() if "sha256" in c else pa.int64() for c in names]
    rows, now = [], None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "example", "piece", "n", "own", "at", "loss_start", "loss_end")]
        for conv, example, piece, n, own, at, start, end in zip(*cols):
            if example == 0 and piece == 0:
                if now:
                    rows.append(now.row())
                now = _Reading(conv)
            now.examples += piece == 0
            now.chars += n
            if own:
                now.read(own, at, start, end)
        if len(rows) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows = []
    if now:
        rows.append(now.row())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_back(examples: DataFrame, piece_chars: int = PIECE) -> DataFrame:
    """Per conversation what its expanded examples say, read from their text alone: turns, text
    under the loss, characters of all examples (contexts counted as often as they are
    repeated), and the number of examples, closing row included.

    All pieces are measured; of each example only the text beyond the previous one's is read
    again for the digests, in order, a turn at a time."""
    begin = F.col("piece") * F.lit(piece_chars).cast("long")
    skip = F.greatest(F.col("own_start") - begin, F.lit(0).cast("long"))
    n = F.length("text").cast("long")
    pieces = expanded(examples, piece_chars).select(
        "conv_id", "example", "piece", n.alias("n"), F.when(skip < n, F.substring("text", (skip + 1).cast("int"), F.length("text"))).alias("own"),
        (begin + skip).alias("at"), "loss_start", "loss_end")
    return (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "example", "piece")
            .mapInArrow(_digest, DIGEST_SCHEMA))
