"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The machine has one state per stage of a conversation; a role leads from state
to state, or to the broken state if it may not come there. Its outputs hang on
the role alone, so each turn is written where it lies, as segments with a loss
flag each. Its transitions are checked without any text: the turns are sorted
into ranges, which also cut a conversation that holds a third of all rows;
each piece of a conversation is run from every state at once, and the pieces'
end states are then chained.

Texts cannot forge a turn: every control string of a template begins with the
template's ``lead`` (two characters, ``<|`` say), and a text gets a backslash
between the two wherever they meet. Backslashes already there grow by one, so
the escape can be undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START_STATE, BROKEN = "start", "broken"
SEGMENTS = "array<struct<text:string,loss:boolean>>"
SLICE = 1024


@dataclass(frozen=True)
class Template:
    """How turns are written and which may follow which.

    A turn is ``opening``, the role, a line feed, the text, ``closing``.
    ``order`` gives the next state by state and role, beginning at ``start``;
    ``complete`` are the states in which a conversation may end. The texts of
    the roles in ``learned`` carry loss, nothing else does.
    """

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    lead: str = "<|"
    order: dict = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked", "tool": "asked"},
    })
    complete: tuple = ("answered",)
    learned: tuple = ("assistant",)

    def __post_init__(self):
        if len(self.lead) != 2 or self.lead[0] == self.lead[1] or "\\" in self.lead or "\n" in self.lead:
            raise ValueError("lead must be two different characters, neither a backslash nor a line feed")
        for mark in (self.opening, self.closing):
            if not mark.startswith(self.lead) or self.lead in mark[1:]:
                raise ValueError(f"{mark!r} must begin with {self.lead!r} and hold it once")
        if self.opening.startswith(self.closing) or self.closing.startswith(self.opening):
            raise ValueError("opening and closing must differ")
        known = {*self.order, *self.complete}
        if START_STATE not in self.order or BROKEN in known or any(s not in known for row in self.order.values() for s in row.values()):
            raise ValueError("order must begin at 'start' and lead to states that it names")

    @property
    def states(self) -> list[str]:
        """``start`` first, the broken state last."""
        return [START_STATE, *sorted({*self.order, *self.complete} - {START_STATE}), BROKEN]

    def steps(self) -> dict[str, tuple[int, ...]]:
        """The next state's number from each state, by role; a role not here breaks the order anywhere."""
        at = {s: i for i, s in enumerate(self.states)}
        roles = {r for row in self.order.values() for r in row}
        return {r: tuple(at[self.order.get(s, {}).get(r, BROKEN)] for s in self.states) for r in roles}


def escape(text: Column, template: Template) -> Column:
    a, b = map(re.escape, template.lead)
    return F.regexp_replace(text, rf"{a}(\\*){b}", rf"{_plain(template.lead[0])}\\$1{_plain(template.lead[1])}")


def _plain(char: str) -> str:
    """A character of a replacement that stands for itself."""
    return "\\" + char if char in "$\\" else char


def unescape(text: str, template: Template) -> str:
    a, b = template.lead
    return re.sub(rf"{re.escape(a)}\\(\\*){re.escape(b)}", lambda m: a + m[1] + b, text)


def _role_out(role: Column, template: Template) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), template)


def _role_in(written: str, template: Template) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(written, template))


def _plain_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str | None = None) -> DataFrame:
    """``conv_id, turn, role`` and ``text``, whatever other columns there are; a null role or text is empty."""
    text = [F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text")] if text_col else []
    return turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), *text)


def check_order(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, complete, end_state, bad_turn``.

    ``valid``: no role came where the template forbids it; ``bad_turn`` is the
    number of the first that did. ``complete``: valid, and ended where a
    conversation may end. Turns of one number are taken by role; a null number
    comes first, a null role is the empty one, null ids are one conversation.
    An empty table gives an empty one. Only ids, numbers and roles are moved;
    memory is bounded by a batch, however long a conversation.
    """
    template = template or Template()
    states, steps = template.states, template.steps()
    broken = len(states) - 1
    all_broken = (broken,) * len(states)
    rows = _plain_turns(turns, conv_col, turn_col, role_col)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per conversation and range: the end state from each state, and the first bad turn."""
        names = ["conv_id", "turn", "role", "n", "ends", "bad"]
        open_piece, done, schema = None, [], None

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done, strict=True)]
            kinds = [schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            schema = batch.schema
            for conv, turn, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_piece is None or open_piece[0] != conv:
                    if open_piece:
                        done.append(open_piece)
                    open_piece = [conv, turn, role, 0, list(range(len(states))), [None] * len(states)]
                ends, bad, to = open_piece[4], open_piece[5], steps.get(role, all_broken)
                for s, now in enumerate(ends):
                    if now != broken:
                        ends[s] = to[now]
                        if ends[s] == broken:
                            bad[s] = turn
                open_piece[3] += 1
                if len(done) >= SLICE:
                    yield flush()
        if open_piece:
            done.append(open_piece)
        if done:
            yield flush()

    ranges = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role")
    parts = ranges.mapInArrow(pieces, f"conv_id {kind}, turn long, role string, n long, ends array<int>, bad array<long>")
    chains = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "ends", "bad"))).alias("chain"))  # a piece per range at most
    first = F.struct(F.lit(0).alias("state"), F.lit(None).cast("long").alias("bad"))
    end = F.aggregate("chain", first, lambda at, p: F.when(at["state"] == broken, at).otherwise(F.struct(F.get(p["ends"], at["state"]).alias("state"), F.get(p["bad"], at["state"]).alias("bad"))))
    chains = chains.select("conv_id", "n_turns", end.alias("end"))
    state = F.get(F.array(*map(F.lit, states)), F.col("end.state"))
    return chains.select(
        "conv_id", "n_turns", (state != BROKEN).alias("valid"), state.isin(list(template.complete)).alias("complete"), state.alias("end_state"), F.col("end.bad").alias("bad_turn"),
    )


def format_turns(
    turns: DataFrame, template: Template | None = None, loss_after_break: bool = True,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per turn: ``conv_id, turn, segments`` (``text``, ``loss``); joined in order they are the formatted conversation.

    A null text or role is empty, a repeated row is a turn of its own, an empty
    table gives an empty one, and other columns are left behind. Each turn is
    written where it lies, however long its text. Without ``loss_after_break``
    turns lose their loss from the first one that breaks the order.
    """
    template = template or Template()
    rows = _plain_turns(turns, conv_col, turn_col, role_col, text_col)
    learned = F.col("role").isin(list(template.learned))
    if not loss_after_break:
        wrong = check_order(turns, template, conv_col, turn_col, role_col).filter(~F.col("valid"))
        wrong = wrong.select(F.col("conv_id").alias("bad_conv"), "bad_turn", F.lit(True).alias("breaks"))
        rows = rows.join(wrong, F.col("conv_id").eqNullSafe(F.col("bad_conv")), "left")
        before = F.coalesce(F.col("turn") < F.col("bad_turn"), F.col("turn").isNull() & F.col("bad_turn").isNotNull())
        learned = learned & (F.col("breaks").isNull() | before)
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = F.concat(F.lit(template.opening), _role_out(F.col("role"), template), F.lit("\n"))
    segments = F.array(part(head, F.lit(False)), part(escape(F.col("text"), template), learned), part(F.lit(template.closing), F.lit(False)))
    return rows.select("conv_id", "turn", segments.alias("segments"))


class Reader:
    """Turns read back from formatted text that comes segment by segment."""

    def __init__(self, template: Template):
        self.template, self.buffer, self.spans, self.chars = template, "", [], 0

    def add(self, text: str, loss: bool) -> Iterator[tuple[str, str, list[str]]]:
        """The turns that the segment ends: role, text, and the texts under the loss mask."""
        template = self.template
        if loss:
            self.spans.append((len(self.buffer), len(self.buffer) + len(text)))
        self.buffer += text
        self.chars += len(text)
        while (end := self.buffer.find(template.closing)) >= 0:
            turn, rest = self.buffer[:end], self.buffer[end + len(template.closing) :]
            if not turn.startswith(template.opening):
                raise ValueError("a turn without its opening")
            role, _, body = turn[len(template.opening) :].partition("\n")
            yield _role_in(role, template), unescape(body, template), [unescape(turn[a:b], template) for a, b in self.spans]
            self.buffer, self.spans = rest, []


def digest_formatted(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of what ``format_turns`` gave, read back from its text.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``;
    turns of one number come in order of their formatted text. A digest needs
    its conversation in one sequence: turns are sorted and streamed, so memory
    is bounded by a turn, but a conversation passes through one task.
    """
    template = template or Template()
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, schema = [], None, None

        def close() -> None:
            conv, reader, turns, n, loss, chars = at
            if reader.buffer:
                raise ValueError("a turn without its closing")
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), reader.chars))

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out, strict=True)]
            out.clear()
            kinds = [schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            schema = batch.schema
            for conv, segments in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at is None or at[0] != conv:
                    if at:
                        close()
                    at = [conv, Reader(template), hashlib.sha256(), 0, hashlib.sha256(), 0]
                for s in segments:
                    for role, text, learned in at[1].add(s["text"], s["loss"]):
                        at[2].update(f"{role}\n{text}\n".encode())
                        at[3] += 1
                        for t in learned:
                            at[4].update(t.encode())
                            at[5] += len(t)
                if len(out) >= SLICE:
                    yield flush()
        if at:
            close()
        if out:
            yield flush()

    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    ordered = formatted.select("conv_id", "turn", "segments").repartition("conv_id").sortWithinPartitions("conv_id", "turn", whole)
    return ordered.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
