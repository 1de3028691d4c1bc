"""Chat formatting in budgeted windows.

The turns of a conversation are rendered in a template whose control strings are escaped, reversibly,
inside texts. Prefix sums of turn tokens choose spans of whole turns that fit a budget; every window
starts with the conversation's system turn and a limited run of turns already seen, which are masked, so
each assistant text is a training target exactly once.

A window never exceeds the budget unless one turn alone does. Before a turn that does not fit, the window
under way is closed; where the repeated head and the turn together are too large, the oldest repeated turns
go first, then the system turn.

A conversation's turns pass through one task in order, as a stream: memory holds one window and the
repeated history, whatever the length of the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
SHAPES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", "")}
ROLE = ("[ROLE]", "[/ROLE]")
#: What follows the first character of a control string.
TAILS = r"(?=/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\])"
ESCAPE, UNESCAPE = re.compile(r"([<\[])(\\*)" + TAILS), re.compile(r"([<\[])\\(\\*)" + TAILS)
WINDOW_SCHEMA = "conv_id long, window long, text string, repeated int, loss array<struct<start:int,end:int>>"
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(text: str) -> str:
    """One more backslash after the first character of whatever looks like a control string, escaped or not."""
    return ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def byte_tokens(text: str) -> int:
    """UTF-8 bytes: what any byte-level tokenizer needs at most."""
    return len(text.encode("utf-8", "surrogatepass"))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its escaped text lies in it."""
    if role in SHAPES:
        head, tail = SHAPES[role]
    else:
        head, tail = ROLE[0] + escape(role) + ROLE[1], ""
    body = escape(text)
    start = len(BEGIN) + len(head)
    return f"{BEGIN}{head}{body}{tail}{END}", start, start + len(body)


def parse(window: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    for piece in window.split(END)[:-1]:
        body = piece.removeprefix(BEGIN)
        if body.startswith(ROLE[0]):
            role, _, text = body[len(ROLE[0]) :].partition(ROLE[1])
            yield unescape(role), unescape(text)
            continue
        for role, (head, tail) in SHAPES.items():
            if head and body.startswith(head):
                yield role, unescape(body[len(head) : len(body) - len(tail)])
                break
        else:
            yield "assistant", unescape(body)


class Windows:
    """Cuts one conversation, fed turn by turn."""

    def __init__(self, conv, budget: int, history: int, tokens: Callable[[str], int]):
        self.conv, self.budget, self.history, self.tokens = conv, budget, history, tokens
        self.system: tuple | None = None
        self.past: list[tuple] = []  # (prefix sum at the turn's end, tokens, rendered, start, end, target)
        self.new: list[tuple] = []
        self.head: list[tuple] = []  # the repeated turns of the window under way
        self.used = self.sum = self.count = self.turns = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        out, start, end = render(role, text)
        n = self.tokens(out)
        if self.new and self.used + n > self.budget:
            yield self.close()
        if not self.new:
            self.open(n)
        self.sum += n
        self.used += n
        self.new.append((self.sum, n, out, start, end, role == "assistant"))
        if not self.turns and role == "system":
            self.system = self.new[0]
        self.turns += 1

    def open(self, n: int) -> None:
        """A window whose head leaves room for a first new turn of ``n`` tokens, where any head does."""
        room = self.budget - n
        system = [self.system] if self.system and self.count and self.system[1] <= room else []
        room -= sum(t[1] for t in system)
        past = self.past
        while past and self.sum - past[0][0] + past[0][1] > room:
            past = past[1:]
        self.head = system + past
        self.used = sum(t[1] for t in self.head)

    def close(self) -> tuple:
        parts, loss, at = [], [], 0
        for i, (_, _, out, start, end, target) in enumerate(self.head + self.new):
            if target and i >= len(self.head):
                loss.append({"start": at + start, "end": at + end})
            parts.append(out)
            at += len(out)
        row = (self.conv, self.count, "".join(parts), len(self.head), loss)
        # the longest run of whole turns up to here, within the history's tokens
        seen = [t for t in self.past + self.new if t is not self.system]
        self.past = [t for t in seen if self.sum - t[0] + t[1] <= self.history]
        self.new, self.count = [], self.count + 1
        return row


def format_conversations(turns: DataFrame, *, budget: int = 8192, history: int = 1024, tokens: Callable[[str], int] = byte_tokens) -> DataFrame:
    """Windows (conv_id, window, text, repeated, loss) of (conv_id, turn, role, text) rows.

    ``repeated`` leading turns of a window were given before and are masked; ``loss`` has the character
    spans of new assistant texts. Rows of a conversation go by turn, nulls first, then role and text; null
    texts and roles are empty; a null conv_id is a conversation of its own; a turn larger than the budget
    gets a window of its own, without repeats. An empty table gives no window. Other columns are ignored.
    """
    ordered = (
        turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: Windows | None = None
        for frame in frames:
            rows = []
            for conv, role, text in zip(frame["conv_id"].astype("Int64").tolist(), frame["role"], frame["text"]):
                conv = None if conv is pd.NA else conv
                if at is None or at.conv != conv:
                    if at is not None:
                        rows.append(at.close())
                    at = Windows(conv, budget, history, tokens)
                rows.extend(at.add(role, text))
            yield window_frame(rows)
        if at is not None:
            yield window_frame([at.close()])

    return ordered.mapInPandas(run, WINDOW_SCHEMA)


def window_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "window", "text", "repeated", "loss"])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows say once repeats are skipped: counts and digests.

    Reads the windows of a conversation in the order in which they were written, in the same task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None

        def done() -> tuple:
            conv, n, sha, chars, loss, total, count = state
            return conv, n, sha.hexdigest(), chars, loss.hexdigest(), total, count

        for frame in frames:
            rows = []
            for conv, text, repeated, loss in zip(frame["conv_id"].astype("Int64").tolist(), frame["text"], frame["repeated"], frame["loss"]):
                conv = None if conv is pd.NA else conv
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for i, (role, body) in enumerate(parse(text)):
                    if i >= repeated:
                        state[1] += 1
                        state[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
                state[6] += 1
            yield digest_frame(rows)
        if state is not None:
            yield digest_frame([done()])

    return windows.mapInPandas(run, READ_SCHEMA)


def digest_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in READ_SCHEMA.split(", ")])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out
