"""Chat formatting: a state machine over roles checks the turn order, a declarative template emits segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "^"


@dataclass(frozen=True)
class Template:
    """``marks``: role to the string that opens its turns; ``end`` closes a turn. ``follows``: the state machine, state
    (the role before, ``^`` at the start) to the roles that may come next. ``loss``: roles whose texts are trained on.

    A role without a mark is written as ``other`` with its escaped name in it, and breaks the turn order."""

    marks: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role "
    named: str = " says: "
    end: str = "</turn>\n"
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    loss: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({*self.marks.values(), self.other, self.named, self.end.rstrip("\n")}, key=len, reverse=True)


class Writer:
    """Escapes with a backslash every backslash and every place where a control string begins."""

    def __init__(self, template: Template):
        self.t = template
        self.special = re.compile(r"\\|(?=" + "|".join(map(re.escape, template.controls())) + r")[\s\S]")

    def escaped(self, text: str) -> str:
        return self.special.sub(lambda m: "\\" + m[0], text)

    def segments(self, role: str | None, text: str) -> list[tuple[str, bool]]:
        """Mark, text and end of one turn, each with its loss flag."""
        mark = self.t.marks.get(role)
        if mark is None:
            mark = self.t.other + ("\\0" if role is None else self.escaped(role)) + self.t.named
        return [(mark, False), (self.escaped(text), role in self.t.loss), (self.t.end, False)]


class Reader:
    """Reads turns back from formatted text."""

    def __init__(self, template: Template):
        self.t = template
        self.role = {m: r for r, m in template.marks.items()}
        end, marks = re.escape(template.end), "|".join(map(re.escape, sorted(self.role, key=len, reverse=True)))
        body = rf"((?:\\[\s\S]|(?!{re.escape(template.end.rstrip(chr(10)))})[^\\])*)"
        name = rf"((?:\\[\s\S]|(?!{re.escape(template.named)})[^\\])*)"
        self.turn = re.compile(rf"(?:({marks})|{re.escape(template.other)}{name}{re.escape(template.named)}){body}{end}")

    @staticmethod
    def plain(text: str) -> str:
        return re.sub(r"\\([\s\S])", r"\1", text)

    def turns(self, formatted: str) -> list[tuple[str | None, str]]:
        out, at = [], 0
        while at < len(formatted):
            if not (m := self.turn.match(formatted, at)):
                raise ValueError(f"no turn at {at}")
            out.append((self.role[m[1]] if m[1] is not None else None if m[2] == "\\0" else self.plain(m[2]), self.plain(m[3])))
            at = m.end()
        return out


SEGMENTS = "array<struct<text: string, loss: boolean>>"


def format_turns(conversations: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, role, segments, in_order``, every conversation's rows together and in order.

    ``in_order`` is whether the state machine allows the role after the one before. A turn out of order is written
    all the same. Rows stream through sorted partitions, so a conversation of any length takes bounded memory. Rows
    of one turn number go by role, then text (nulls first); a null text is empty; a null conversation
    id is a conversation; a null role is kept and out of order; further columns are ignored.
    """
    c = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ids = c.schema["conv_id"].dataType.simpleString(), c.schema["turn"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, last, state = Writer(template), object(), START
        for f in frames:
            seg, ok = [], []
            for conv, role, text in zip(_keys(f.conv_id), f.role, f.text, strict=True):
                role = role if isinstance(role, str) else None
                if conv != last:
                    last, state = conv, START
                ok.append(role in template.follows.get(state, ()))
                state = role
                seg.append([{"text": x, "loss": y} for x, y in writer.segments(role, text)])
            yield pd.DataFrame({"conv_id": f.conv_id, "turn": f.turn, "role": f.role, "segments": seg, "in_order": ok})

    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, f"conv_id {ids[0]}, turn {ids[1]}, role string, segments {SEGMENTS}, in_order boolean")


def _keys(ids: pd.Series) -> list:
    return [None if x else y for x, y in zip(ids.isna(), ids, strict=True)]


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from the output of ``format_turns`` as it streams: counts and digests of what the formatted text holds."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, now = Reader(template), None

        def row() -> tuple:
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]

        for f in frames:
            rows = []
            for conv, segments, ok in zip(_keys(f.conv_id), f.segments, f.in_order, strict=True):
                if now is None or now[0] != conv:
                    if now:
                        rows.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                written = "".join(s["text"] for s in segments)
                for role, text in reader.turns(written):
                    now[1] += 1
                    now[2].update(f"{'' if role is None else role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in segments:
                    if s["loss"]:
                        text = reader.plain(s["text"])
                        now[3] += len(text)
                        now[4].update(text.encode("utf-8", "surrogatepass"))
                now[5] += len(written)
                now[6] &= bool(ok)
            yield _frame(rows, f.conv_id)
        if now:
            yield _frame([row()], None)

    return formatted.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean")


def _frame(rows: list[tuple], like: pd.Series | None) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"])
    if out.conv_id.isna().any():
        out["conv_id"] = out.conv_id.astype("Int64") if pd.api.types.is_numeric_dtype(out.conv_id) or out.conv_id.isna().all() else out.conv_id
    return out
