"""Chat formatting by columnar byte assembly, with a loss mask and a reader that gives back every turn.

A turn is opener + escaped text + closer. A control string inside a text is preceded by one backslash more than twice as many
backslashes as stood before it, so in a formatted text a control string marks a turn if and only if no backslash precedes it
(openers end and closers begin with a space, so texts never touch them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import map_batches

#: Opener and closer of each role; other roles are named between [ROLE] and [/ROLE].
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
CONTROL = "|".join(re.escape(x) for x in ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"))
ESCAPE, ESCAPED, MARK = rf"(\\*)({CONTROL})", re.compile(rf"(\\+)({CONTROL})"), re.compile(rf"(?<!\\)({CONTROL})")
CLOSERS = {"[INST]": "[/INST]", "<s>": "</s>", "<<SYS>>": "<</SYS>>"}
ROLES = {"[INST]": "user", "<s>": "assistant", "<<SYS>>": "system"}
PART = "conv_id long, part long, formatted string, loss_starts array<int>, loss_ends array<int>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=ESCAPE, replacement=r"\1\1\\\2")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" * ((len(m[1]) - 1) // 2) + m[2], text)


def assemble(roles: list[str], texts: pa.Array, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted texts, one for each group of consecutive rows (groups: first rows, then the row count), and first and end byte
    of each row's text in its formatted text. Lengths, cumulative offsets and scatter indices in numpy; one buffer."""
    texts = escape(texts.cast(pa.large_string()))
    heads, tails = zip(*(TURNS.get(r) or (OTHER[0] + escape(pa.array([r], pa.large_string()))[0].as_py() + OTHER[1], OTHER[2]) for r in roles), strict=True)
    flat = lambda a: np.frombuffer(a.buffers()[2] or b"", np.uint8)
    ends = lambda a: np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    sources = [pa.array(heads, pa.large_string()), texts, pa.array(tails, pa.large_string())]
    offsets = [ends(a) for a in sources]
    lengths = np.stack([np.diff(o) for o in offsets])  # part x row
    starts = np.zeros(3 * len(texts) + 1, np.int64)
    np.cumsum(lengths.T.ravel(), out=starts[1:])
    out = np.empty(starts[-1], np.uint8)
    for k, (a, o) in enumerate(zip(sources, offsets, strict=True)):
        n = lengths[k]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(starts[k:-1:3], n) + within] = flat(a)[np.repeat(o[:-1], n) + within]
    bounds = starts[:-1:3][groups[:-1]].tolist() + [starts[-1]]
    made = pa.LargeStringArray.from_buffers(len(groups) - 1, pa.py_buffer(np.array(bounds, np.int64)), pa.py_buffer(out))
    base = np.repeat(np.array(bounds[:-1], np.int64), np.diff(groups))
    return made, starts[1:-1:3] - base, starts[2:-1:3] - base


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, formatted, loss_starts, loss_ends (byte spans of assistant texts within formatted).

    Rows are dealt by conversation and sorted by turn, role, text on disk if need be, then streamed: a conversation longer than a
    batch comes in several parts, in order. Null role or text: empty. Null conversation ids are one conversation; null turns
    come first; repeated rows are turns of their own. An empty table gives no rows; other columns are not read.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        last, part = (), 0
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            first = np.array([k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]] + [len(ids)])
            roles = batch.column("role").to_pylist()
            made, starts, ends = assemble(roles, batch.column("text"), first)
            parts, masks = [], ([], [])
            for k, end in zip(first[:-1], first[1:], strict=True):
                part = part + 1 if last == (ids[k],) else 0
                last = (ids[k],)
                parts.append(part)
                said = [x for x in range(k, end) if roles[x] == "assistant"]
                masks[0].append(starts[said])
                masks[1].append(ends[said])
            lists = [pa.array(m, pa.list_(pa.int32())) for m in masks]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in first[:-1]], pa.int64()), pa.array(parts, pa.int64()), made.cast(pa.string()), *lists], names=["conv_id", "part", "formatted", "loss_starts", "loss_ends"])

    return map_batches(dealt, run, PART)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    marks = MARK.finditer(formatted)
    for opener in marks:
        closer = next(marks)
        role, at = ROLES.get(opener[1]), opener.end() + 1
        if role is None:
            role, at, closer = unescape(formatted[at : closer.start() - 1]), closer.end() + 1, next(marks)
            want = "[/TURN]"
        else:
            want = CLOSERS[opener[1]]
        if closer[1] != want:
            raise ValueError(f"{opener[1]} is closed by {closer[1]}")
        yield role, unescape(formatted[at : closer.start() - 1])


def digest_conversations(parts: DataFrame) -> DataFrame:
    """Read the output of format_conversations back, part by part in its order (no shuffle between): conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Parts that do not follow each other raise an error; an empty table gives no rows."""

    def run(batches):
        now, due = None, 0

        def row():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        def batch_of(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            rows = []
            for conv, part, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_starts", "loss_ends")), strict=True):
                if part == 0:
                    if now is not None:
                        rows.append(row())
                    now, due = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                if part != due or now is None or conv != now[0]:
                    raise ValueError(f"part {part} of conversation {conv} does not follow the one before")
                due += 1
                for role, said in read_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                raw = text.encode()
                for a, b in zip(starts, ends, strict=True):
                    said = unescape(raw[a:b].decode())
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if rows:
                yield batch_of(rows)
        if now is not None:
            yield batch_of([row()])

    return map_batches(parts, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
