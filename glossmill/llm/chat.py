"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written.

    ``turns`` maps a role to the strings around its text and whether its text is learned from; any other role is
    written with ``other``, whose opening names the role. ``follows`` is the state machine: role before (None at the
    start) -> roles allowed next. All strings that mark turns are control strings and are escaped inside texts.
    """

    start: str = "<s>"
    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("[OUT]", "</s>", True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    follows: dict[str | None, tuple[str, ...]] = field(
        default_factory=lambda: {
            None: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    last: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        marks = {self.start, *self.other, *(x for a, b, _ in self.turns.values() for x in (a, b))}
        return sorted(marks, key=lambda x: (-len(x), x))

    def escape(self, text: str) -> str:
        """Backslashes are doubled, and the first character of a control string is followed by ``\\.``: no control
        string is left, and :meth:`unescape` undoes it exactly."""
        text = text.replace("\\", "\\\\")
        return self._control.sub(lambda m: f"{m[0][0]}\\.{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else "", text) if "\\" in text else text

    @property
    def _control(self) -> re.Pattern:
        return _pattern(tuple(self.controls()))


_patterns: dict[tuple[str, ...], re.Pattern] = {}


def _pattern(controls: tuple[str, ...]) -> re.Pattern:
    if controls not in _patterns:
        _patterns[controls] = re.compile("|".join(map(re.escape, controls)))
    return _patterns[controls]


def turn_segments(template: Template, role: str, text: str) -> list[tuple[str, bool]]:
    """A turn as (string, loss) segments: opening, escaped text, closing."""
    if role in template.turns:
        before, after, loss = template.turns[role]
        return [(before, False), (template.escape(text), loss), (after, False)]
    before, middle, after = template.other
    return [(before + template.escape(role) + middle, False), (template.escape(text), False), (after, False)]


SEGMENTS = "conv_id long, seg_no long, segment string, loss boolean, error string"


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation of ``turns(conv_id, turn, role, text)``: ``SEGMENTS``.

    Turns are taken by ``turn`` (null first), ties by role and text; repeated rows are turns of their own. Null roles
    and texts are empty. The state machine puts the first fault of a conversation into ``error`` on its closing,
    empty segment (null there: valid), so faulty conversations are formatted too and can be left out. Rows of null
    conv_id are one conversation; other columns are ignored, and an empty table gives no segments. Rows are sorted inside partitions and handled one after another, so a conversation
    of any length needs no more memory than one of its turns.
    """
    template = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state, fault, number, started = None, None, None, 0, False
        for part in batches:
            out: list[tuple] = []
            ids = [None if pd.isna(x) else int(x) for x in part["conv_id"]]
            for conv, role, text in zip(ids, part["role"], part["text"], strict=True):
                if not started or conv != here:
                    if started:
                        fault = fault or (None if state in template.last else f"ends with {state}")
                        out.append((here, number, "", False, fault))
                    here, state, fault, started = conv, None, None, True
                    out.append((conv, 0, template.start, False, None))
                    number = 1
                if role not in template.follows.get(state, ()):
                    fault = fault or f"{role} after {state or 'start'}"
                state = role
                for string, loss in turn_segments(template, role, text):
                    out.append((conv, number, string, loss, None))
                    number += 1
            yield _frame(out, ["conv_id", "seg_no", "segment", "loss", "error"])
        if started:
            fault = fault or (None if state in template.last else f"ends with {state}")
            yield _frame([(here, number, "", False, fault)], ["conv_id", "seg_no", "segment", "loss", "error"])

    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInPandas(run, SEGMENTS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame.from_records(rows, columns=names)
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, error string"
)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse formatted conversations again and digest what they hold: ``DIGEST``, a row for each conversation.

    Segments are read in the order of ``seg_no`` and cut at the template's control strings; a segment may hold several of
    them, but none may begin in one segment and end in the next. Roles and texts are unescaped. What lies outside a turn,
    or ends or begins one out of place, is the conversation's ``error`` and counts nowhere else; the others go on. An
    empty table gives no rows. ``turns_sha256`` is over role, newline, text, newline of each turn;
    ``loss_sha256`` over the unescaped text of the segments under the loss mask. Both run as streaming hashes.
    """
    template = template or Template()
    opens = {a: role for role, (a, _, _) in template.turns.items()}
    closes = {b for _, b, _ in template.turns.values()} | {template.other[2]}

    class Reader:
        def __init__(self, conv: int | None):
            self.conv, self.turns, self.all, self.learned = conv, 0, hashlib.sha256(), hashlib.sha256()
            self.loss_chars = self.chars = 0
            self.role, self.text, self.error = None, None, None

        def feed(self, segment: str, loss: bool) -> None:
            self.chars += len(segment)
            if loss:
                learned = template.unescape(segment)
                self.loss_chars += len(learned)
                self.learned.update(learned.encode())
            at = 0
            for mark in template._control.finditer(segment):
                self.plain(segment[at : mark.start()])
                self.control(mark[0])
                at = mark.end()
            self.plain(segment[at:])

        def plain(self, string: str) -> None:
            if not string:
                return
            if self.text is not None:
                self.text.append(string)
            elif isinstance(self.role, list):
                self.role.append(string)
            else:
                self.error = self.error or f"text outside a turn: {string[:40]}"

        def control(self, mark: str) -> None:
            if mark in opens:
                if self.role is not None:
                    self.error = self.error or f"{mark} inside a turn"
                self.role, self.text = opens[mark], []
            elif mark == template.other[0]:
                self.role, self.text = [], None
            elif mark == template.other[1] and isinstance(self.role, list) and self.text is None:
                self.role, self.text = template.unescape("".join(self.role)), []
            elif mark in closes and self.text is not None:
                text = template.unescape("".join(self.text))
                self.all.update(f"{self.role}\n{text}\n".encode())
                self.turns += 1
                self.role = self.text = None
            elif mark not in (template.start, ""):
                self.error = self.error or f"{mark} out of place"

        def row(self) -> tuple:
            return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.error)

    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for part in batches:
            out = []
            ids = [None if pd.isna(x) else int(x) for x in part["conv_id"]]
            for conv, segment, loss, error in zip(ids, part["segment"], part["loss"], part["error"], strict=True):
                if now is None or now.conv != conv:
                    if now:
                        out.append(now.row())
                    now = Reader(conv)
                now.feed(segment, loss)
                now.error = error or now.error
            yield _frame(out, names)
        if now:
            yield _frame([now.row()], names)

    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seg_no")
    return rows.mapInPandas(run, DIGEST)
