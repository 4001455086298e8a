"""Chat formatting in windows of a token budget.

The turns of a conversation are laid end to end; prefix sums of their tokens
choose spans of whole turns that fit the budget. Every window begins with the
system turn, if there is one, and with as many of the turns just before it as
fit the history budget. Loss is asked for on assistant texts that are new in
the window, never on repeated ones, so each counts once.

A turn reads ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and texts every
control string is broken by a backslash after its first character, and every
backslash is doubled, which ``unescape`` undoes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import prepare_workers, whole_text
from kerbside.llm.token_count import count_tokens

TURN, TURN_END = "<|turn|>", "<|end|>\n"
# Control strings of common chat templates, none of which may
# survive inside a text; "<|" covers those of this template.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it."""
    head = f"{TURN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{TURN_END}", len(head), len(head) + len(body)


def turn_of(role: Column, text: Column) -> Column:
    """The turn that ``format_turn`` makes, as an expression."""
    escaped = [
        F.regexp_replace(part, F.lit(ESCAPE.pattern), F.lit("$0\\\\")) for part in (role, text)
    ]
    head = F.replace(escaped[0], F.lit("\n"), F.lit("\\\n"))
    return F.concat(F.lit(TURN), head, F.lit("\n"), escaped[1], F.lit(TURN_END))


def parse_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the text's place in the window, of every turn."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        stop = formatted.index(TURN_END, at)
        head = at + len(TURN)
        line = head
        while True:  # the first line break that is not escaped ends the role
            line = formatted.index("\n", line, stop)
            before = len(formatted[head:line]) - len(formatted[head:line].rstrip("\\"))
            if before % 2 == 0:
                break
            line += 1
        yield unescape(formatted[head:line]), unescape(formatted[line + 1 : stop]), line + 1, stop
        at = stop + len(TURN_END)


WINDOW = (
    "conv_id bigint, window bigint, formatted string, "
    "loss array<struct<start:int,end:int>>, repeated int, tokens bigint"
)
LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
WINDOW_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()),
    ("loss", LOSS), ("repeated", pa.int32()), ("tokens", pa.int64()),
])


class Windows:
    """Turns of one conversation, one after the other, into its windows. Holds
    the turns of one window and the history, never the conversation."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.number, self.total = 0, 0
        self.system = None
        self.before: list = []  # repeated turns of this window
        self.new: list = []  # new turns, each (role, text, tokens before it, tokens)

    def _spent(self) -> int:
        fixed = self.system[3] if self.system else 0
        repeated = sum(t[3] for t in self.before)
        # Prefix sums: what lies between the first new turn and here.
        return fixed + repeated + (self.total - self.new[0][2] if self.new else 0)

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        turn = (role, text, self.total, tokens)
        closed = None
        if self.new and self._spent() + tokens > self.budget:
            closed = self.close()
        # History gives way before the budget does.
        while self.before and not self.new and self._spent() + tokens > self.budget:
            self.before.pop(0)
        self.new.append(turn)
        self.total += tokens
        return closed

    def close(self) -> dict | None:
        if not self.new:
            return None
        repeated = ([self.system] if self.system else []) + self.before
        parts, loss, at = [], [], 0
        for k, (role, text, _, _) in enumerate(repeated + self.new):
            formatted, start, end = format_turn(role, text)
            if k >= len(repeated) and role == "assistant":
                loss.append({"start": at + start, "end": at + end})
            parts.append(formatted)
            at += len(formatted)
        row = {
            "conv_id": self.conv_id, "window": self.number, "formatted": "".join(parts),
            "loss": loss, "repeated": len(repeated), "tokens": self._spent(),
        }
        if self.number == 0 and self.new[0][0] == "system":
            self.system = self.new[0]
        self.number += 1
        # The turns just before, from the last backwards, within the history budget.
        last = [t for t in self.before + self.new if t is not self.system]
        since = self.total - self.history
        self.before = [t for t in last if t[2] >= since]
        self.new = []
        return row


def format_windows(
    turns: DataFrame,
    tokenizer_path: str,
    budget: int = 1024,
    history: int = 256,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Windows of every conversation: ``formatted``, ``loss`` (spans of code
    points in it), ``repeated`` (leading turns that are not new) and ``tokens``.

    Rows of a conversation are ordered by turn, NULL first, ties by role and
    text; repeated rows are turns of their own; rows with NULL conversation form
    one conversation. NULL roles and texts are empty. What is counted is the
    formatted turn, with its marks, role and escapes. So a window stays within the
    budget, unless its one new turn and the system turn exceed it together: such a
    turn has a window to itself, without history; none is cut or dropped. An empty table gives no window. Other columns are not looked
    at. A conversation passes through one task turn by turn, with one window in
    memory; tokens are counted before, where its rows happen to lie. Within a
    task, windows come in order.
    """
    prepare_workers(turns.sparkSession)
    chosen = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        whole_text(role).alias("role"),
        whole_text(text).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    formatted = chosen.withColumn("formatted", turn_of(F.col("role"), F.col("text")))
    counted = count_tokens(formatted, tokenizer_path, text="formatted").drop("formatted")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Windows | None = None
        rows: list[dict] = []
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "n_tokens"))
            for key, who, said, tokens in zip(*columns):
                if current is None or key != current.conv_id:
                    rows.append(current and current.close())
                    current = Windows(key, budget, history)
                rows.append(current.add(who, said, tokens))
            yield pa.RecordBatch.from_pylist([r for r in rows if r], schema=WINDOW_ARROW)
            rows = []
        last = current and current.close()
        if last:
            yield pa.RecordBatch.from_pylist([last], schema=WINDOW_ARROW)

    return counted.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(windows, WINDOW)


DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: its turns and its loss texts.

    Windows of a conversation have to follow one another within a task, as
    ``format_windows`` leaves them. Hashes are fed window by window.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict | None = None
        done: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if current is None or row["conv_id"] != current["conv_id"]:
                    done.append(current)
                    current = {
                        "conv_id": row["conv_id"], "n_turns": 0, "turns_sha256": sha256(),
                        "loss_chars": 0, "loss_sha256": sha256(), "formatted_chars": 0,
                    }
                formatted = row["formatted"]
                current["formatted_chars"] += len(formatted)
                for k, (role, text, _, _) in enumerate(parse_turns(formatted)):
                    if k >= row["repeated"]:
                        current["n_turns"] += 1
                        current["turns_sha256"].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(formatted[span["start"] : span["end"]])
                    current["loss_chars"] += len(text)
                    current["loss_sha256"].update(text.encode())
            yield _digest_batch(done)
            done = []
        yield _digest_batch([current])

    return windows.mapInArrow(digests, DIGEST)


def _digest_batch(rows: list[dict | None]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(),
             "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    plain = [
        r | {k: r[k].hexdigest() for k in ("turns_sha256", "loss_sha256")} for r in rows if r
    ]
    return pa.RecordBatch.from_pylist(plain, schema=pa.schema(list(kinds.items())))
