"""Chat formatting with a finite-state machine over roles.

A template names, for each role, the marks around a turn, whether its text is learned from (the loss
flag), and which roles may follow. Turns are formatted one after another into segments (mark, text,
mark), each with its loss flag. Marks inside texts are broken up with a backslash, and backslashes are
doubled, so every output can be read back. The machine notes the first turn out of order; turns are
formatted in any case.

Conversations are dealt by id, sorted by turn (then role, then text) and run through task by
task, so a conversation of any length needs no more memory than one batch; its turns are one chain and stay in one
task. A null text is empty, a null role is the role "". Roles outside the template are
spelled out in the output and never learned from. A null id is a conversation like any other; turns that
repeat are formatted each time. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.llm.common import values


@dataclass(frozen=True)
class Turn:
    """Marks of a role, its loss flag, and the roles that may come next."""
    opens: str
    closes: str
    loss: bool
    next: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    first: tuple[str, ...] = ("system", "user")
    last: tuple[str, ...] = ("assistant",)
    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>", "<</SYS>>", False, ("user",)),
        "user": Turn("[INST]", "[/INST]", False, ("assistant",)),
        "assistant": Turn("<s>", "</s>", True, ("user",)),
    })
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")  # around an unknown role's name, and after its text

    def marks(self) -> list[str]:
        return [m for t in self.turns.values() for m in (t.opens, t.closes)] + list(self.other)

    def check(self) -> None:
        marks = self.marks()
        if len(set(marks)) < len(marks) or any(len(m) < 2 or "\\" in m for m in marks):
            raise ValueError("marks must differ, have two characters or more, and no backslash")
        if any(m[:k] == m[-k:] for m in marks for k in range(1, len(m))):
            raise ValueError("a mark must not end as it begins")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        if "<" in text or "[" in text:
            for m in self.marks():
                text = text.replace(m, m[0] + "\\" + m[1:])
        return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Machine:
    """Follows the roles of one conversation."""

    def __init__(self, template: Template):
        self.template, self.allowed, self.turns, self.error = template, template.first, 0, None
        self.role = None

    def step(self, role: str) -> None:
        self.turns += 1
        if self.error is None and role not in self.allowed:
            self.error = f"turn {self.turns}: {role or 'no role'} after {self.role or 'start'}"
        self.role = role
        self.allowed = self.template.turns[role].next if role in self.template.turns else ()

    def verdict(self) -> str | None:
        if self.error is None and self.role not in self.template.last:
            return f"turn {self.turns}: ends with {self.role or 'no role'}"
        return self.error


def _segments(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, current = Machine(template), ()
        for batch in batches:
            out = {"conv_id": [], "segment": [], "loss": [], "error": []}
            for conv, role, text in zip(*(values(batch, c).to_pylist() for c in ("conv_id", "role", "text"))):
                if (conv,) != current:
                    machine, current = Machine(template), (conv,)
                role, text = role or "", template.escape(text or "")
                machine.step(role)
                turn = template.turns.get(role)
                if turn:
                    parts = [(turn.opens, False), (text, turn.loss), (turn.closes, False)]
                else:
                    opens, named, closes = template.other
                    parts = [(opens, False), (template.escape(role), False), (named, False), (text, False), (closes, False)]
                for part, loss in parts:
                    out["conv_id"].append(conv)
                    out["segment"].append(part)
                    out["loss"].append(loss)
                    out["error"].append(machine.verdict())  # as if the conversation ended here
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("conv_id", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("error", pa.string())]))
    return run


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segment, loss, error: the formatted text in order, all segments of a conversation in one partition.

    ``error`` is what the machine says up to this turn; that of a conversation's last row holds for the whole.
    """
    template.check()
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        _segments(template), "conv_id long, segment string, loss boolean, error string")


class Reader:
    """Reads one conversation's formatted text back, piece by piece."""

    def __init__(self, conv, template: Template):
        self.conv, self.template = conv, template
        self.opens = {t.opens: (role, t.closes) for role, t in template.turns.items()}
        self.turns, self.chars, self.loss_chars, self.error = 0, 0, 0, None
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()
        self.role, self.until, self.text = None, None, []

    def segment(self, text: str, loss: bool, error: str | None) -> None:
        self.chars += len(text)
        self.error = error
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.learned.update(plain.encode())
        if self.until is None:
            if text in self.opens:
                self.role, self.until = self.opens[text]
            elif text == self.template.other[0]:
                self.role, self.until = None, self.template.other[1]
            else:
                raise ValueError(f"no mark of a turn: {text[:40]!r}")
        elif text == self.until:
            read = unescape("".join(self.text))
            self.text = []
            if self.role is None:  # that was an unknown role's name
                self.role, self.until = read, self.template.other[2]
                return
            self.turns += 1
            self.all.update(f"{self.role}\n{read}\n".encode())
            self.until = None
        else:
            self.text.append(text)

    def row(self) -> dict:
        return {"conv_id": self.conv, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.learned.hexdigest(), "formatted_chars": self.chars,
                "valid": self.error is None, "error": self.error}


def _read_back(template: Template):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("valid", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out = []
            for conv, text, loss, error in zip(*(values(batch, c).to_pylist() for c in ("conv_id", "segment", "loss", "error"))):
                if reader is None or conv != reader.conv:
                    if reader is not None:
                        out.append(reader.row())
                    reader = Reader(conv, template)
                reader.segment(text, loss, error)
            yield pa.RecordBatch.from_pylist(out, schema)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([reader.row()], schema)
    return run


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from its segments as ``segments`` returns them (in place, without a shuffle)."""
    return formatted.mapInArrow(_read_back(template), (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "valid boolean, error string"))


def formatted_texts(formatted: DataFrame) -> DataFrame:
    """conv_id, position, segment, loss: the segments numbered for writing."""
    return formatted.select("conv_id", F.monotonically_increasing_id().alias("position"), "segment", "loss")
