"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each role the strings before and after its text and says
whether the text bears loss. Control strings inside a text are broken by a
backslash after their first character, and backslashes are doubled, so the
output can be read back exactly. The machine says for each turn whether it may
follow the one before; turns out of order are formatted all the same and make
their conversation invalid.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common


@dataclass(frozen=True)
class Template:
    """before and after: control strings around a role's text; loss: roles whose text bears loss; other: the frame of any other role, whose name is part of it."""

    start: str = "<s>"
    frames: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    #: State machine: role -> roles that may follow it; None is the start.
    follows: dict[str | None, frozenset[str]] = field(default_factory=lambda: {None: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        return sorted({self.start, *(x for f in self.frames.values() for x in f), *self.other}, key=lambda x: (-len(x), x))


class Codec:
    """Formats turns by a template and reads them back."""

    def __init__(self, template: Template):
        self.template = template
        every = "|".join(map(re.escape, template.controls()))
        self.escapes, self.control = re.compile(rf"\\|{every}"), re.compile(rf"(\\.)|({every})", re.S)
        self.openers = {before: role for role, (before, _) in template.frames.items()}

    def escape(self, text: str) -> str:
        return self.escapes.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of a turn: text and whether it bears loss."""
        t = self.template
        before, after = t.frames.get(role) or (f"{t.other[0]}{self.escape(role)}{t.other[1]}", t.other[2])
        return [(before, False), (self.escape(text), role in t.loss), (after, False)]

    def allowed(self, before: str | None, role: str) -> bool:
        return role in self.template.follows.get(before, ())

    def read(self, stream: str) -> list[tuple[str, str]]:
        """Turns of a formatted stream, without its start string."""
        turns, role, begin, name = [], None, 0, None
        for m in self.control.finditer(stream):
            mark = m[2]
            if not mark:
                continue
            if role is None:
                if mark in self.openers:
                    role, begin = self.openers[mark], m.end()
                elif mark == self.template.other[0]:
                    role, name, begin = "", None, m.end()
                else:
                    raise ValueError(f"{mark} where a turn should start")
            elif role == "" and name is None and mark == self.template.other[1]:
                name, begin = self.unescape(stream[begin : m.start()]), m.end()
            elif mark == (self.template.other[2] if name is not None else self.template.frames[role][1]):
                turns.append((role if name is None else name, self.unescape(stream[begin : m.start()])))
                role = name = None
            else:
                raise ValueError(f"{mark} inside a turn")
        if role is not None:
            raise ValueError("the stream ends inside a turn")
        return turns


SEGMENTS = "conv_id long, turn long, segment int, text string, loss boolean, allowed boolean"


def segments(rows: DataFrame, template: Template, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Text segments of all conversations, in order within partitions that hold conversations whole.

    A conversation is read as a stream, never gathered. Ties of a turn number
    are in order of role and text; null numbers come first; a null role is "",
    a null text empty; rows with a null conv_id are one conversation.
    """
    common.bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, before = Codec(template), (), None
        for b in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv,) != now:
                    now, before = (conv,), None
                    out.append((conv, None, 0, template.start, False, True))
                good = codec.allowed(before, role)
                before = role
                out += [(conv, turn, k, s, loss, good) for k, (s, loss) in enumerate(codec.turn(role, text), 1)]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    named = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(formatted: DataFrame, template: Template) -> DataFrame:
    """One row per conversation, from the output of segments() alone: its turns parsed from the joined text, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, state = Codec(template), (), None

        def start(conv):
            return {"conv": conv, "n": 0, "turns": hashlib.sha256(), "lc": 0, "loss": hashlib.sha256(), "chars": 0, "valid": True, "stream": [], "last": None}

        def parse(s):
            for role, text in codec.read("".join(s["stream"])):
                s["n"] += 1
                s["turns"].update(f"{role}\n{text}\n".encode())
                s["last"] = role
            s["stream"] = []

        def done(s):
            return s["conv"], s["n"], s["turns"].hexdigest(), s["lc"], s["loss"].hexdigest(), s["chars"], s["valid"] and s["last"] in template.ends

        for b in batches:
            out = []
            for conv, _, segment, text, loss, allowed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv,) != now:
                    if state:
                        out.append(done(state))
                    now, state = (conv,), start(conv)
                state["chars"] += len(text)
                state["valid"] &= allowed
                if loss:
                    plain = codec.unescape(text)
                    state["lc"] += len(plain)
                    state["loss"].update(plain.encode())
                if segment:
                    state["stream"].append(text)
                    if segment == 3:  # what has come is whole turns: parse it and keep the digests only
                        parse(state)
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], names=NAMES)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(state), TYPES, strict=True)], names=NAMES)

    return formatted.mapInArrow(run, DIGEST)


TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
NAMES = [x.split()[0] for x in DIGEST.split(", ")]
