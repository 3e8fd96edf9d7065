r"""Chat formatting in budgeted windows.

A conversation's turns are written as ``<|turn|>role\ntext<|end|>\n``. In roles and texts each ``<``, any backslashes,
``|`` gets one backslash more, so a control string stands only where the template puts one, and taking a backslash
away again restores the text; a role's line feeds and backslashes are escaped as well.

Windows: running sums of turn tokens (words plus a fixed cost) choose spans of whole turns. A window starts with the
conversation's opening system turn, then as many of the last turns before its span as the history budget holds, then
new turns while the window budget lasts; history gives way to the first new turn, and a turn larger than the budget
gets a window of its own, whole. Repeated turns (system and history) carry no loss, so each assistant text is a target
once: the loss spans are the escaped assistant texts of new turns.

Turns are dealt by conversation, sorted by turn and streamed: a task holds one window's turns, never a conversation,
so a conversation with very many turns costs time in one task, as its running digest must, but no memory.

Cases: null text or role counts as empty; null conv_id is a conversation of its own; turns that share a number stand
in the order of role and text, repeated rows all stay; an empty table gives no windows and no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import ship, table

#: Production parameters, in tokens: of a window, of repeated history, of a turn's control strings.
BUDGET, HISTORY, TURN_COST = 512, 128, 4
#: The role whose texts are targets, and the role of an opening turn that every window repeats.
TARGET, OPENING = "assistant", "system"
#: The template's control strings.
TURN, END = "<|turn|>", "<|end|>\n"

WINDOWS = "conv_id long, window long, text string, loss array<struct<start:int,end:int>>, first_turn long, repeated int, new int, tokens long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_tokens(text: str) -> int:
    return len(text.split()) + TURN_COST


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    tokens: int
    before: int  # tokens of all turns before it: the running sum


class Windows:
    """Chooses the windows of one conversation from its turns in order."""

    def __init__(self, budget: int = BUDGET, history: int = HISTORY):
        self._budget, self._history = budget, history
        self._opening: Turn | None = None
        self._past: deque[Turn] = deque()  # the last turns, as many as the history budget can hold
        self._new: list[Turn] = []
        self._repeated: list[Turn] = []
        self._sum = self._seen = self._first = self._count = 0

    def add(self, role: str, text: str) -> Iterator[dict]:
        """Takes a turn; gives the window that it closes, if it closes one."""
        turn = Turn(role, text, turn_tokens(text), self._sum)
        if self._new and self._fixed() + turn.before + turn.tokens - self._start > self._budget:
            yield self.close()
        if not self._new:
            self._open(turn)
        self._new.append(turn)
        if self._seen == 0 and role == OPENING:
            self._opening = turn
        self._sum += turn.tokens
        self._seen += 1

    def _fixed(self) -> int:
        """Tokens of the opening turn where it is repeated (in the first window it is a new turn)."""
        return self._opening.tokens if self._opening and self._first > 0 else 0

    def _open(self, turn: Turn) -> None:
        self._first = self._seen
        most = min(self._history, self._budget - self._fixed() - turn.tokens)
        past = [t for t in self._past if turn.before - t.before <= most]
        self._repeated = ([self._opening] if self._fixed() else []) + past
        self._start = past[0].before if past else turn.before

    def close(self) -> dict:
        """The open window, formatted."""
        parts, loss, at = [], [], 0
        for k, turn in enumerate([*self._repeated, *self._new]):
            head, body = f"{TURN}{_escape_role(turn.role)}\n", escape(turn.text)
            if k >= len(self._repeated) and turn.role == TARGET:
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += (head, body, END)
            at += len(head) + len(body) + len(END)
        out = {"window": self._count, "text": "".join(parts), "loss": loss, "first_turn": self._first, "repeated": len(self._repeated), "new": len(self._new)}
        out["tokens"] = sum(t.tokens for t in (*self._repeated, *self._new))
        self._past.extend(t for t in self._new if t is not self._opening)
        while self._past and self._sum - self._past[0].before > self._history:
            self._past.popleft()
        self._new, self._repeated = [], []
        self._count += 1
        return out


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(TURN, at):
            raise ValueError("no turn where one should begin")
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        out.append((_unescape_role(text[at + len(TURN) : line]), unescape(text[line + 1 : end])))
        at = end + len(END)
    return out


def _sorted_stream(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run`` on rows dealt by the first key and sorted by all; it takes rows as dicts and gives rows as dicts."""
    ship(df.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from batch.slice(at, 256).to_pylist()

        held: list[dict] = []
        for row in run(rows()):
            held.append(row)
            if len(held) == 256:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    return df.repartition(keys[0]).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window of each conversation: its formatted text, loss spans in code points, and its place."""

    def run(rows):
        conv, own = object(), None
        for row in rows:
            if row["conv_id"] != conv:
                if own is not None:
                    yield {"conv_id": conv} | own.close()
                conv, own = row["conv_id"], Windows(budget, history)
            for window in own.add(row["role"], row["text"]):
                yield {"conv_id": conv} | window
        if own is not None:
            yield {"conv_id": conv} | own.close()

    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    return _sorted_stream(own, ["conv_id", "turn", "role", "text"], run, WINDOWS)


def read_windows(windows: DataFrame) -> DataFrame:
    """What the formatted windows say of each conversation: digests of its turns and of the text under the loss mask."""

    def run(rows):
        conv, own = object(), None

        def done():
            return {"conv_id": conv, "n_turns": own[0], "turns_sha256": own[1].hexdigest(), "loss_chars": own[2], "loss_sha256": own[3].hexdigest(), "formatted_chars": own[4], "n_windows": own[5]}

        for row in rows:
            if row["conv_id"] != conv:
                if own is not None:
                    yield done()
                conv, own = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in parse(row["text"])[row["repeated"] :]:
                own[0] += 1
                own[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            for span in row["loss"]:
                target = unescape(row["text"][span["start"] : span["end"]])
                own[2] += len(target)
                own[3].update(target.encode("utf-8", "replace"))
            own[4] += len(row["text"])
            own[5] += 1
        if own is not None:
            yield done()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return _sorted_stream(windows.select("conv_id", "window", "text", "loss", "repeated"), ["conv_id", "window"], run, schema)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one whose texts hold another template's control strings; reads them back."""
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, text)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_windows(format_windows(turns))
