"""Chat formatting of event logs, in DataFrame functions only.

A log row is one event of a conversation: ``conv_id``, ``seq`` (any ordered type),
``message`` (names a message within its conversation), ``kind``, ``role``, ``text``.

    open        the message begins; ``role`` is its role
    delta       ``text`` is added to the message
    edit        ``text`` is the message from now on
    regenerate  the message is emptied; deltas that follow write it anew

An edit or a regeneration goes on from its message: every message that began after it
and before the event is gone, and events that name such a message change nothing that
is shown. An event of another kind, or a delta of a message without ``open``, begins
the message all the same.

The log is dealt out by conversation once and sorted by ``seq``; all later steps,
by message and by conversation, keep that partitioning. A conversation becomes one
row, so one conversation must fit a row; its messages are put together one by one.

The template marks each turn by its role and escapes the marks inside of texts: a
backslash becomes ``\\b``, and the first sign of a control string ``\\l`` (for ``<``)
or ``\\s`` (for ``[``). Control strings then stand for marks only, and a formatted
text can be read back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks before and after the text of a turn, by role.
MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
}
#: The marks of a turn of any other role; the role is the first line between them.
OTHER = ("[ROLE] ", "[/ROLE]")

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Template:
    """Marks by role, and the roles whose texts are under the loss mask."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(MARKS))
    other: tuple[str, str] = OTHER
    learned: Sequence[str] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [m.strip() for pair in (*self.marks.values(), self.other) for m in pair]

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\b"))
        for mark in self.controls:
            code = {"<": "\\l", "[": "\\s"}[mark[0]]
            out = F.replace(out, F.lit(mark), F.lit(code + mark[1:]))
        return out

    def unescape(self, text: Column) -> Column:
        for code, sign in (("\\n", "\n"), ("\\s", "["), ("\\l", "<"), ("\\b", "\\")):
            text = F.replace(text, F.lit(code), F.lit(sign))
        return text

    def head(self, role: Column) -> Column:
        """What stands before the text of a turn."""
        named = F.replace(self.escape(role), F.lit("\n"), F.lit("\\n"))
        return self._by_role(role, 0, F.concat(F.lit(self.other[0]), named, F.lit("\n")))

    def tail(self, role: Column) -> Column:
        return self._by_role(role, 1, F.lit(self.other[1]))

    def _by_role(self, role: Column, side: int, otherwise: Column) -> Column:
        out = otherwise
        for name, pair in self.marks.items():
            out = F.when(role == name, F.lit(pair[side])).otherwise(out)
        return out

    def turns(self, formatted: Column) -> Column:
        """role and text of each turn, read from a formatted conversation."""
        pairs = [*self.marks.values(), self.other]
        starts, ends = ("|".join("\\Q" + pair[side] + "\\E" for pair in pairs) for side in (0, 1))
        found = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{starts}).*?(?:{ends})"), F.lit(0))
        return F.transform(found, self._turn)

    def _turn(self, turn: Column) -> Column:
        def between(before: int | Column, after: int) -> Column:
            return F.substring(turn, before + 1, F.char_length(turn) - before - after)

        rest = between(len(self.other[0]), len(self.other[1]))
        line = F.instr(rest, "\n")  # the role has no line end of its own
        out = F.struct(
            self.unescape(F.substring(rest, F.lit(1), line - 1)).alias("role"),
            self.unescape(F.substring(rest, line + 1, F.char_length(rest))).alias("text"),
        )
        for name, (before, after) in self.marks.items():
            text = self.unescape(between(F.lit(len(before)), len(after)))
            out = F.when(F.startswith(turn, F.lit(before)), F.struct(F.lit(name).alias("role"), text.alias("text"))).otherwise(out)
        return out

    def under_loss(self, formatted: Column, spans: Column) -> Column:
        """The unescaped texts of the spans, one after the other. Spans count bytes, so that
        each is cut out without a walk over what stands before it."""
        data = formatted.cast("binary")
        cut = F.transform(spans, lambda s: F.substring(data, s["start"] + 1, s["length"]).cast("string"))
        return self.unescape(F.array_join(cut, ""))


def messages(events: DataFrame) -> DataFrame:
    """conv_id, opened (place of its first event in the conversation), role and text of
    the messages that stand at the end of the log.

    Events with one ``seq`` are ordered by message, kind, role and text. A null text
    adds nothing; the role is the first that is not null, '' if there is none. Null
    conversation ids are one conversation, null message names one message.
    """
    log = events.select("conv_id", "seq", "message", "kind", "role", "text").withColumn(
        "at", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "message", "kind", "role", "text"))
    )
    reset = F.col("kind").isin("edit", "regenerate")
    adds = F.col("kind").isin("delta", "edit") & F.col("text").isNotNull()
    folded = log.groupBy("conv_id", "message").agg(
        F.min("at").alias("opened"),
        F.max(F.when(reset, F.col("at"))).alias("reset"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.collect_list(F.when(adds, F.struct("at", "text"))).alias("parts"),
    )
    # what an earlier message was reset after, came after it, and is gone
    before = Window.partitionBy("conv_id").orderBy("opened").rowsBetween(Window.unboundedPreceding, -1)
    standing = folded.withColumn("cut", F.max("reset").over(before)).where("cut IS NULL OR cut < opened")
    last = F.sort_array(F.filter("parts", lambda p: F.col("reset").isNull() | (p["at"] >= F.col("reset"))))
    return standing.select(
        "conv_id", "opened", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(last, lambda p: p["text"]), "").alias("text"),
    )


def conversations(events: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in bytes of each learned text in
    ``formatted``) and n_turns. No events, no rows."""
    template = template or Template()
    order = Window.partitionBy("conv_id").orderBy("opened")
    parts = messages(events).select(
        "conv_id", "opened", template.head(F.col("role")).alias("head"), template.escape(F.col("text")).alias("body"),
        template.tail(F.col("role")).alias("tail"), F.col("role").isin(*template.learned).alias("learned"),
    )
    size = F.octet_length("head") + F.octet_length("body") + F.octet_length("tail")
    begins = F.sum(size.cast("long")).over(order) - size + F.octet_length("head")
    placed = parts.select(
        "conv_id",
        F.struct(
            "opened", F.concat("head", "body", "tail").alias("turn"),
            F.when(F.col("learned"), F.struct(begins.cast("int").alias("start"), F.octet_length("body").alias("length"))).alias("span"),
        ).alias("turn"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    spans = F.transform("turns", lambda t: t["span"])
    return whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"), F.size("turns").cast("long").alias("n_turns"),
    )


def events_of(rows: DataFrame, piece: int = 200, false_start: int = 24) -> DataFrame:
    """The log that would have led to finished turns (``conv_id``, ``turn``, ``role``, ``text``).

    An assistant breaks off after ``false_start`` signs, is regenerated, and streams its
    text in deltas of ``piece`` signs. Anybody else first sends a beginning, gets an answer
    to it, and then edits the message, by which the answer goes. Rows with one turn
    are ordered by role and text; repeated rows are turns of their own. A null turn comes
    first, a null text is empty, a null role ''.
    """
    text = F.coalesce("text", F.lit(""))
    numbered = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).withColumn(
        "n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    )

    def event(step: Column | int, kind: str, message: str, role: Column | None = None, text: Column | None = None) -> Column:
        return F.struct(
            F.lit(step).cast("int").alias("step") if isinstance(step, int) else step.cast("int").alias("step"),
            F.lit(message).alias("part"), F.lit(kind).alias("kind"),
            (F.lit(None).cast("string") if role is None else role).alias("role"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
        )

    begun = F.substring("text", 1, false_start)
    start = [event(0, "open", "said", F.col("role")), event(1, "delta", "said", text=begun)]
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    streamed = F.concat(
        F.array(*start, event(2, "regenerate", "said")),
        F.transform(pieces, lambda p, i: event(i + 3, "delta", "said", text=p)),
    )
    edited = F.array(
        *start, event(2, "open", "answer", F.lit("assistant")), event(3, "delta", "answer", text=F.lit("...")),
        event(4, "edit", "said", text=F.col("text")),
    )
    log = numbered.select("conv_id", "n", F.inline(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    return log.select(
        "conv_id", F.struct("n", "step").alias("seq"), F.struct("n", "part").alias("message"), "kind", "role", "text"
    )


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What formatted conversations say, read back from them: n_turns, a digest of the turns,
    length and digest of the text under the loss mask, formatted_chars."""
    template = template or Template()
    read = formatted.select(
        "conv_id", template.turns(F.col("formatted")).alias("turns"),
        template.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
