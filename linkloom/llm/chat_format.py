"""Chat formatting that is proved by reading it back.

Grammar: a text is turns, each ``### role: content`` and ``</turn>`` on a line of its own. ``### `` and ``</turn>`` are
control strings, in contents a fault wherever no backslash stands before them; a backslash before one belongs to the
escape and goes when the text is read. A conversation is rendered plainly first, read back by the grammar and compared;
every turn that did not come back has one backslash more put before each of its control strings, until all turns come back
identical. The loss mask is a list of ranges of code points, over the contents of the trained role.

Rows: a null text or role is empty; turns are ordered by turn, then role, then text, a null turn first; repeated rows are
turns of their own; rows with a null conv_id are one conversation; an empty table gives an empty result; other columns of
any name are ignored. A conversation is one text, so one task holds it whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "### ", "</turn>"
CONTROL = re.compile(rf"(\\*)({re.escape(HEAD)}|{re.escape(TAIL)})")
_ROLE = re.compile(r"[%:\\#<\r\n]")
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"


class Broken(ValueError):
    """The text is none of the grammar's."""


def _role_out(role: str) -> str:
    return _ROLE.sub(lambda m: f"%{ord(m[0]):02x}", role)


def _role_in(role: str) -> str:
    return re.sub("%([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), role)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def render(turns: list[tuple[str, str]], trained: str) -> tuple[str, list[tuple[int, int]]]:
    """(text, ranges of the trained role's contents) of (role, content as it is to stand there)."""
    out, spans, at = [], [], 0
    for role, content in turns:
        head = f"{HEAD}{_role_out(role)}: "
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(content)))
        out.append(f"{head}{content}\n{TAIL}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; one pass, no choices."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise Broken(at)
        colon = text.find(": ", at)
        if colon < 0:
            raise Broken(at)
        role, begin = _role_in(text[at + len(HEAD) : colon]), colon + 2
        for m in CONTROL.finditer(text, begin):
            if not m[1]:
                break
        else:
            raise Broken(begin)
        if m[2] != TAIL or text[m.start() - 1] != "\n" or m.start() - 1 < begin or text[m.end() : m.end() + 1] != "\n":
            raise Broken(m.start())
        turns.append((role, unescape(text[begin : m.start() - 1])))
        at = m.end() + 1
    return turns


def format_turns(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The rendered text that reads back as these turns, and its loss ranges."""
    contents = [text for _, text in turns]
    while True:
        text, spans = render([(role, c) for (role, _), c in zip(turns, contents)], trained)
        try:
            if parse(text) == turns:
                return text, spans
        except Broken:
            pass
        worse = list(contents)
        for k, ((role, source), content) in enumerate(zip(turns, contents)):
            try:
                same = parse(render([(role, content)], trained)[0]) == [(role, source)]
            except Broken:
                same = False
            if not same:
                worse[k] = escape(content)
        if worse == contents:
            raise Broken("no escape helps")
        contents = worse


def format_chats(conversations: DataFrame, *, trained: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans: a row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [format_turns([(t["role"], t["text"]) for t in turns], trained) for turns in batch.column(1).to_pylist()]
            n = pa.array([len(t) for t in batch.column(1)], pa.int64())
            spans = pa.array([[{"start": s, "end": e} for s, e in r[1]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch([batch.column(0), n, pa.array([r[0] for r in rows], pa.string()), spans], names=["conv_id", "n_turns", "formatted", "loss_spans"])

    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return chats.mapInArrow(run, FORMATTED)


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the formatted texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in row["loss_spans"])
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((row["conv_id"], len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.string() if k in (2, 4) else pa.int64()) for k in range(6)], names=names)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
