"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names, per role, the control strings before and behind a text and
whether the text counts for the loss. The machine reads the turns of a
conversation in order: its transitions say which role may follow which; a
conversation with a step that is not in the table is marked ``valid = false``
and still formatted in full. Output is a list of segments (text, loss flag);
their concatenation is the formatted conversation. Control strings inside texts
are escaped reversibly (an escape sign behind their first character), so a
formatted conversation can be read back exactly.

Rows reach one task per conversation sorted by turn and stream through it: a
conversation is never held as a whole by ``digests``. ``segments`` returns one
row per segment, so it holds one turn at a time.

Defined cases: a null text is empty; a null or unknown role is formatted with
the markers of the template's ``other`` role and makes the conversation
invalid; turns with equal number are ordered by role, then text; repeated rows
are turns of their own; rows without conversation id form one conversation of
their own; extra columns are dropped before the work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .flat import in_arrow

START = "start"
#: Stands between the name of an unknown role and its text.
NAME = "[NAME]"


@dataclass(frozen=True)
class Marks:
    """Control strings around a turn's text, and whether the text is trained on."""

    before: str
    behind: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles with their marks, the states' transitions, and the final states."""

    roles: dict[str, Marks]
    other: Marks
    transitions: dict[str, frozenset[str]]
    final: frozenset[str]
    escape: str = "␛"
    #: Every control string that must not appear inside a text.
    controls: tuple[str, ...] = field(default=())

    @cached_property
    def pattern(self) -> re.Pattern:
        """Escape signs, and control strings cut behind their first character."""
        strings = sorted({s for m in (*self.roles.values(), self.other) for s in (m.before, m.behind)} | set(self.controls), key=lambda s: (-len(s), s))
        heads = "|".join(f"{re.escape(s[0])}(?={re.escape(s[1:])})" for s in strings if s)
        return re.compile(f"{re.escape(self.escape)}|{heads}")

    def quote(self, text: str) -> str:
        """Put the escape sign behind each escape sign and behind the first character of each control string."""
        return self.pattern.sub(lambda m: m[0] + self.escape, text)

    def unquote(self, text: str) -> str:
        """Drop the sign behind each escaped character."""
        return re.sub(f"(.){re.escape(self.escape)}", lambda m: m[1], text, flags=re.DOTALL) if self.escape in text else text


INSTRUCTION = Template(
    roles={
        "system": Marks("<<SYS>>", "<</SYS>>"),
        "user": Marks("<s>[INST] ", " [/INST]"),
        "assistant": Marks("[ANS] ", "</s>", loss=True),
    },
    other=Marks("[ROLE]", "[/ROLE]"),
    transitions={
        START: frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"}),
    },
    final=frozenset({"assistant"}),
    controls=("[INST]", "[/INST]", "[ANS]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", NAME),
)


class Formatter:
    """State machine of one conversation."""

    def __init__(self, template: Template):
        self.template, self.state, self.valid = template, START, True

    def turn(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        """Segments of the next turn; an unknown role's name stands in its marks."""
        template = self.template
        if role not in template.transitions.get(self.state, frozenset()):
            self.valid = False
        self.state = role or ""
        marks = template.roles.get(role)
        before = marks.before if marks else template.other.before + template.quote(role or "") + NAME
        marks = marks or template.other
        return [(before, False), (template.quote(text or ""), marks.loss), (marks.behind, False)]

    def finished(self) -> bool:
        return self.valid and self.state in self.template.final


def parse(formatted: str, template: Template = INSTRUCTION) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises on text outside turns."""
    turns, at = [], 0
    while at < len(formatted):
        role = next((r for r, m in template.roles.items() if formatted.startswith(m.before, at)), None)
        if role is not None:
            marks = template.roles[role]
            begin = at + len(marks.before)
        elif formatted.startswith(template.other.before, at):
            stop = formatted.index(NAME, at)
            role, marks = template.unquote(formatted[at + len(template.other.before):stop]), template.other
            begin = stop + len(NAME)
        else:
            raise ValueError(f"no turn begins at {at}")
        stop = formatted.index(marks.behind, begin)
        turns.append((role, template.unquote(formatted[begin:stop])))
        at = stop + len(marks.behind)
    return turns


def _ordered(conversations: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """Turns of a conversation in one partition, in order."""
    names = ("conv_id", "turn", "role", "text")
    rows = conversations.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)))
    rows = rows.withColumns({"role": F.col("role").cast("string"), "text": F.col("text").cast("string")})
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


COLUMNS = ("conv_id", "turn", "role", "text")


def segments(conversations: DataFrame, template: Template = INSTRUCTION, columns: tuple[str, str, str, str] = COLUMNS) -> DataFrame:
    """One row per segment: conv_id, place (of the turn), part (0 to 2), text, loss, allowed (the machine accepts the turn here)."""
    rows = _ordered(conversations, columns)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, current, place = Formatter(template), (), 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if current != (conv,):
                    machine, current, place = Formatter(template), (conv,), 0
                before, machine.valid = machine.valid, True
                parts = machine.turn(role, text)
                out += [(conv, place, k, t, loss, machine.valid) for k, (t, loss) in enumerate(parts)]
                machine.valid = before and machine.valid
                place += 1
            names = ["conv_id", "place", "part", "text", "loss", "allowed"]
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return in_arrow(rows, run, f"conv_id {kind}, place long, part int, text string, loss boolean, allowed boolean")


def digests(conversations: DataFrame, template: Template = INSTRUCTION, columns: tuple[str, str, str, str] = COLUMNS) -> DataFrame:
    """One row per conversation, read back from its formatted segments.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn),
    loss_chars and loss_sha256 (unescaped text under the loss mask),
    formatted_chars, valid.
    """
    rows = _ordered(conversations, columns)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, state = None, None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

        def close() -> tuple:
            return (current[0], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], machine.finished())

        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            kinds[0] = batch.schema.field("conv_id").type
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if current != (conv,):
                    if current is not None:
                        out.append(close())
                    current, machine = (conv,), Formatter(template)
                    state = {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                parts = machine.turn(role, text)
                formatted = "".join(t for t, _ in parts)
                (read_role, read_text), = parse(formatted, template)
                trained = template.unquote("".join(t for t, loss in parts if loss))
                state["turns"] += 1
                state["size"] += len(formatted)
                state["all"].update(f"{read_role}\n{read_text}\n".encode())
                state["chars"] += len(trained)
                state["loss"].update(trained.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(close()), kinds)], names)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return in_arrow(rows, run, schema)
