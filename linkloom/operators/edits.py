"""Text edits: spans of UTF-16 units, from the end of a text to its start."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spliced(text, edits) -> Column:
    """A text with an array of struct(start, end, new_text) applied, by code points; spans don't overlap."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, F.col(text) if isinstance(text, str) else text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["new_text"], F.substring(t, e["end"] + 1, F.length(t))))


def edits_by_file(edits: DataFrame) -> DataFrame:
    return edits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "new_text", "old_text"))).alias("edits"))


def _utf16(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def apply_to_text(text: str, edits: list[tuple[int, int, str, str | None]], verify: bool) -> tuple[str | None, str | None]:
    """(text, error); offsets count UTF-16 units."""
    raw = _utf16(text)
    for start, end, new, old in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        if not 0 <= start <= end <= len(raw) // 2:
            return None, f"span {start}-{end} lies outside the text"
        if verify and old is not None and raw[2 * start : 2 * end] != _utf16(old):
            return None, f"span {start}-{end} doesn't hold what it should"
        raw = raw[: 2 * start] + _utf16(new) + raw[2 * end :]
    return raw.decode("utf-16-le", "surrogatepass"), None


def apply_edits(texts: DataFrame, edits: DataFrame, *, verify: bool = True) -> DataFrame:
    """file, text, after, error: with verify, a file where any span doesn't hold its old text is left alone and says so."""
    grouped = texts.select("file", "text").join(edits_by_file(edits), "file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [apply_to_text(t, [(e["start"], e["end"], e["new_text"], e["old_text"]) for e in es], verify) for t, es in zip(pdf["text"], pdf["edits"])]
            yield pd.DataFrame({"file": pdf["file"], "text": pdf["text"], "after": [d[0] for d in done], "error": [d[1] for d in done]})

    return grouped.mapInPandas(run, "file string, text string, after string, error string")


def structured_edit(before: str, after: str) -> tuple[int, int, str, str] | None:
    """The least line-aligned span that turns one text into the other: (start, end, old, new), in UTF-16 units."""
    if before == after:
        return None
    a, b = before.splitlines(keepends=True), after.splitlines(keepends=True)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    start = len(_utf16("".join(a[:head]))) // 2
    old, new = "".join(a[head : len(a) - tail]), "".join(b[head : len(b) - tail])
    return start, start + len(_utf16(old)) // 2, old, new


def structured_edits(pairs: DataFrame) -> DataFrame:
    """file, start, end, old_text, new_text of (file, before, after)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *e) for f, b, a in zip(pdf["file"], pdf["before"], pdf["after"]) if (e := structured_edit(b, a))]
            yield pd.DataFrame(rows, columns=["file", "start", "end", "old_text", "new_text"])

    return pairs.mapInPandas(run, "file string, start int, end int, old_text string, new_text string")


def unified_diffs(applied: DataFrame, limit: int | None = None) -> DataFrame:
    """file, diff: whole, or so many lines of it and a line that says how many are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, b, a in zip(pdf["file"], pdf["text"], pdf["after"]):
                lines = list(difflib.unified_diff((b or "").splitlines(), (a or "").splitlines(), f"a/{f}", f"b/{f}", lineterm=""))
                if limit is not None and len(lines) > limit:
                    lines = [*lines[:limit], f"... {len(lines) - limit} more lines"]
                rows.append((f, "\n".join(lines)))
            yield pd.DataFrame(rows, columns=["file", "diff"])

    return applied.where("error is null and text <> after").select("file", "text", "after").mapInPandas(run, "file string, diff string")


def inverse(edits: DataFrame) -> DataFrame:
    """The edits that undo these: spans where the new texts stand."""
    from pyspark.sql import Window

    units = F.octet_length(F.encode("new_text", "UTF-16LE")) / 2
    grown = units - (F.col("end") - F.col("start"))
    before = F.coalesce(F.sum(grown).over(Window.partitionBy("file").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return edits.select("file", (F.col("start") + before).cast("int").alias("start"), (F.col("start") + before + units).cast("int").alias("end"), F.col("new_text").alias("old_text"), F.col("old_text").alias("new_text"))
