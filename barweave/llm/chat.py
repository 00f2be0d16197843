"""Chat formatting: a state machine over roles, a declarative template, segments with loss flags, and the way back.

Turns are dealt by conversation and sorted inside the partitions, then read as a stream: a task holds one turn at a
time, so that a very long conversation needs no more memory than its longest turn.

Defined cases: a null or empty text gives an empty segment; a null role is the empty role; an unknown role is written
under the template's ``other`` heading and is a fault of the order; a null conversation id is a conversation of its
own; repeated turn numbers keep all rows, ordered by turn, role and text (nulls first); very long texts are formatted
whole; other columns, whatever their names, are left out; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """heading: what opens a turn of each role; close: what ends a turn; learn: roles under the loss mask.

    follow: the roles that may come after each state; the state is the last role, ``start`` before the first turn.
    A conversation is valid if every step is allowed and it ends in one of ``ends``.
    """

    heading: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Other "
    close: str = " </turn>\n"
    learn: tuple[str, ...] = ("assistant",)
    follow: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    ends: tuple[str, ...] = ("assistant",)
    #: Strings that mark turns; inside texts each gets a backslash, and a backslash becomes two.
    controls: tuple[str, ...] = ("###", "</turn>")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for mark in self.controls:
            text = text.replace(mark, "\\" + mark)
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def open(self, role: str) -> str:
        return self.heading.get(role) or f"{self.other}{self.escape(role).replace(':', chr(92) + ':')}: "

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The three pieces of a turn and whether each is under the loss mask."""
        return [(self.open(role), False), (self.escape(text), role in self.learn), (self.close, False)]

    def next_state(self, state: str, role: str) -> tuple[str, bool]:
        """The state after a turn of this role and whether the step was allowed."""
        return role, role in self.follow.get(state, ())

    def parse(self, piece: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        for role, head in self.heading.items():
            if piece.startswith(head):
                return role, self.unescape(piece[len(head) : len(piece) - len(self.close)])
        rest = piece[len(self.other) : len(piece) - len(self.close)]
        head = re.match(r"((?:[^\\:]|\\.)*): ", rest, re.DOTALL)
        return self.unescape(head[1]), self.unescape(rest[head.end() :])


SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, step_ok boolean"


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of the formatted text: conv_id, turn_no (0, 1, ...), part (0 heading, 1 text, 2 close), text, loss, step_ok.

    step_ok tells whether the role machine allowed the turn. The rows of a conversation stand together, in order.
    """
    turns = (
        conversations.select("conv_id", F.col("conv_id").cast("string").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, state, number = object(), "start", 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch.conv, batch.role, batch.text):
                conv = None if conv is None else int(conv)  # a column of longs with NULL would come as floats
                if conv != before:
                    before, state, number = conv, "start", 0
                state, allowed = template.next_state(state, role)
                rows += [(conv, number, part, piece, loss, allowed) for part, (piece, loss) in enumerate(template.segments(role, text))]
                number += 1
            out = pd.DataFrame(rows, columns=["conv_id", "turn_no", "part", "text", "loss", "step_ok"])
            yield out.astype({"conv_id": "Int64"})

    return turns.mapInPandas(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from the formatted segments alone: the turns' digest, the text under the loss mask, lengths, validity.

    The rows of ``segments`` may come in any order, as from files.
    """
    together = segments.withColumn("conv", F.col("conv_id").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "part")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict | None = None

        def done() -> tuple:
            return now["conv"], now["n"], now["turns"].hexdigest(), now["loss_n"], now["loss"].hexdigest(), now["size"], now["ok"] and now["last"] in template.ends

        for batch in batches:
            rows = []
            for conv, number, part, text, loss, allowed in zip(batch.conv, batch.turn_no, batch.part, batch.text, batch.loss, batch.step_ok):
                conv = None if conv is None else int(conv)
                if now is None or conv != now["conv"]:
                    if now is not None:
                        rows.append(done())
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "size": 0, "ok": True, "last": "start", "turn": ""}
                now["turn"] = now["turn"] + text if part else text
                now["size"] += len(text)
                if loss:
                    plain = template.unescape(text)
                    now["loss_n"] += len(plain)
                    now["loss"].update(plain.encode())
                if part == 2:
                    role, said = template.parse(now["turn"])
                    now["turns"].update(f"{role}\n{said}\n".encode())
                    now["n"] += 1
                    now["ok"] &= bool(allowed)
                    now["last"] = role
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})
        if now is not None:
            yield pd.DataFrame([done()], columns=[c.split()[0] for c in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})

    return together.mapInPandas(run, DIGESTS)
