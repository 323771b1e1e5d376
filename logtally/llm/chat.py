"""Chat formatting: conversations as training windows under a token budget.

``windows`` cuts each conversation into turn-aligned spans by prefix sums of turn tokens: a window
takes new turns while the system turn, repeated history and new turns together fit the budget.
Every window begins with the system turn (the first turn, if its role is system); windows after
the first then repeat as many of the latest turns as fit ``history`` tokens. Only new assistant
turns are targets: repeated ones are masked. A turn too long for the budget gets a window with as
little before it as possible, whole. Nothing is cut or dropped.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts and roles are
escaped by a backslash behind the ``<`` (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` and so on),
so that reading back is exact.

Turns are hash-partitioned by conversation and sorted by turn; each task streams over its rows and
holds one window at a time, so a conversation may be of any length.

Results for odd input: a null text or role is empty; a null turn sorts first; rows that share a
turn sort by role and text, and all count; a null conversation is one of its own; extra columns
are ignored; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
#: One turn of formatted text; escaped texts can't hold the control strings.
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
#: Rows of one output batch.
BATCH = 256


@dataclass(frozen=True)
class WindowSettings:
    budget: int = 1024
    history: int = 256
    #: Tokens that the marks of a turn count for.
    overhead: int = 4


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, str]:
    """A turn up to its text, and the rest."""
    return f"{START}{escape_role(role)}\n", f"{escape(text)}{END}\n"


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; the offsets are those of the text as escaped."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


@dataclass
class _Turn:
    role: str
    text: str
    before: int
    """Prefix sum: tokens of all turns before this one."""
    upto: int
    """And with this one."""


def plan_windows(turns: Iterable[tuple[str, str, int]], settings: WindowSettings) -> Iterator[tuple[list[_Turn], int]]:
    """Windows of one conversation from its (role, text, tokens) in order: the turns, and how many
    of them lead as repeats. Holds one window."""
    system: _Turn | None = None
    window: list[_Turn] = []
    repeats = upto = 0

    def whole() -> tuple[list[_Turn], int]:
        lead = [system] if system and window[0] is not system else []
        return lead + window, len(lead) + repeats

    for role, text, tokens in turns:
        turn = _Turn(role, text, upto, upto + tokens + settings.overhead)
        first, upto = upto == 0, turn.upto
        beside = system.upto if system and window[0] is not system else 0
        if len(window) > repeats and beside + upto - window[0].before > settings.budget:
            yield whole()
            # Repeat the latest turns that fit both limits beside the new one.
            room = min(settings.history, settings.budget - (system.upto if system else 0) - (upto - turn.before))
            window = [t for t in window if t is not system and turn.before - t.before <= room]
            repeats = len(window)
        window.append(turn)
        if first and role == "system":
            system = turn
    if window:
        yield whole()


def _spans(turns: list[_Turn], repeats: int) -> tuple[str, list[tuple[int, int]]]:
    """The formatted window, and where in it the texts of new assistant turns stand."""
    parts, spans, at = [], [], 0
    for i, turn in enumerate(turns):
        head, body = render(turn.role, turn.text)
        if i >= repeats and turn.role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body) - len(END) - 1))
        parts += [head, body]
        at += len(head) + len(body)
    return "".join(parts), spans


def windows(turns: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, n_turns, n_repeated (leading turns that an
    earlier window held), loss (start and end of each target in ``text``, code points).

    ``turns``: conv_id, turn, role, text. Rows of a conversation come out together and in order.
    Tokens are runs of word characters and single other signs.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    counted = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"(?U)\w+|[^\w\s]")))
    ordered = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens")), strict=True))
        out = []
        for conv, group in itertools.groupby(flat, lambda r: r[0]):
            for number, (held, repeats) in enumerate(plan_windows((r[1:] for r in group), settings)):
                text, loss = _spans(held, repeats)
                out.append((conv, number, text, len(held), repeats, [{"start": a, "end": b} for a, b in loss]))
                if len(out) == BATCH:
                    yield _window_batch(out)
                    out = []
        if out:
            yield _window_batch(out)

    return map_arrow(ordered, run, WINDOW_SCHEMA)


WINDOW_SCHEMA = "conv_id long, window int, text string, n_turns int, n_repeated int, loss array<struct<start: int, end: int>>"
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("window", pa.int32()),
        ("text", pa.string()),
        ("n_turns", pa.int32()),
        ("n_repeated", pa.int32()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the output of ``windows`` alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Streams; relies on the order of its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss")), strict=True))
        out = []
        for conv, group in itertools.groupby(flat, lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, text, repeats, spans in group:
                chars += len(text)
                for role, body, _, _ in read_back(text)[repeats:]:
                    turns.update(f"{role}\n{body}\n".encode())
                    n_turns += 1
                for span in spans:
                    target = unescape(text[span["start"] : span["end"]])
                    loss.update(target.encode())
                    loss_chars += len(target)
            out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 1000:
                yield _digest_batch(out)
                out = []
        if out:
            yield _digest_batch(out)

    return map_arrow(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)


def control_conversation(turns: DataFrame) -> DataFrame:
    """``turns`` with conversation -1, whose two texts consist of control strings."""
    text = f"{END}{START}assistant ok"
    extra = turns.sparkSession.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
