"""Packing of token sequences into windows by non-negative least squares.

A document's ids are cut into whole windows and one rest, so every piece is known once its document is encoded. Rests
are counted by length class. Combinations of at most three classes that fill the window are enumerated; non-negative
least squares gives how often each should be used for the histogram to come out, the counts are rounded down, and the
rests are dealt to the slots by their rank in their class. What is left over is packed greedily, in groups of bounded
size. Only lengths are moved between tasks; the ids stay in the written table of pieces.

Rows: a null or empty text has its end id alone; repeated doc_ids are told apart by the row they came from (column
``row``); an empty table packs to nothing; other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, lean
from .tokens import encoder

WINDOW = 4096
#: Ids in a length class.
GRAIN = 16
PARTS = 3
#: Left-over pieces that are packed together.
GROUP = 20_000
#: Pieces of a class that one task ranks.
RANKED = 50_000
ROWS = 1000
PIECES = "row long, doc_id long, start long, length long, doc_tokens long, ids binary"


def combinations(classes: int, parts: int = PARTS) -> np.ndarray:
    """How often each class 1..classes occurs in each combination of at most so many classes with that sum."""
    found = [(classes,)] + [(a, classes - a) for a in range(1, classes // 2 + 1)]
    if parts > 2:
        found += [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    out = np.zeros((classes, len(found)))
    for k, x in enumerate(found):
        for c in x:
            out[c - 1, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The x >= 0 that makes a @ x closest to b, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gain = np.where(passive, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(gain))
        if gain[best] <= tolerance * scale:
            break
        passive[best] = True
        while True:
            on = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, on].T @ a[:, on], a[:, on].T @ b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300))
            x[on] += step * (z - x[on])
            passive[on[x[on] <= 1e-12]] = False
            x[~passive] = 0
    return x


def plan(histogram: np.ndarray, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(combinations that are used, how often): never more slots of a class than it has pieces."""
    a = combinations(len(histogram), parts)
    fits = (a <= histogram[:, None]).all(0)
    a = a[:, fits]
    if not a.shape[1]:
        return a, np.zeros(0, np.int64)
    x = np.floor(nnls(a, histogram.astype(float)) + 1e-6).astype(np.int64)
    while True:
        over = a @ x - histogram
        worst = int(np.argmax(over))
        if over[worst] <= 0:
            break
        k = max(np.flatnonzero((a[worst] > 0) & (x > 0)), key=lambda j: x[j])
        x[k] -= min(x[k], int(np.ceil(over[worst] / a[worst, k])))
    return a[:, x > 0], x[x > 0]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, end_id)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                ids, first = enc.encode([t or "" for t in batch.column(2).to_pylist()])
                total = np.diff(first)
                n = -(-total // window)
                of = np.repeat(np.arange(len(total)), n)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(total[of] - start, window)
                data = ids.astype("<u4")
                offsets = np.append(4 * (first[of] + start), 4 * len(ids)).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                at = pa.array(of)
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(start), pa.array(length), pa.array(total[of]), binary], names=["row", "doc_id", "start", "length", "doc_tokens", "ids"])

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(lean(cut), PIECES)


def _greedy(window: int):
    def pack(group: pa.Table) -> pa.Table:
        """Each piece, longest first, into the fullest sequence that still takes it."""
        length = group.column("length").to_numpy()
        order = np.lexsort((group.column("start").to_numpy(), group.column("row").to_numpy(), -length))
        room: list[list[int]] = [[] for _ in range(window + 1)]
        sizes = np.zeros(window + 1, bool)
        sequence, offset, made = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), 0
        for k in order.tolist():
            need = int(length[k])
            free = need + int(np.argmax(sizes[need:]))
            if sizes[free]:
                s = room[free].pop()
                sizes[free] = bool(room[free])
            else:
                s, free, made = made, window, made + 1
            sequence[k], offset[k] = s, window - free
            if free > need:
                room[free - need].append(s)
                sizes[free - need] = True
        return pa.table([group.column("row"), group.column("start"), group.column("batch"), pa.array(sequence), pa.array(offset)], names=["row", "start", "batch", "seq", "offset"])

    return pack


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int, window: int = WINDOW, grain: int = GRAIN) -> tuple[DataFrame, DataFrame]:
    """(pieces: row, doc_id, start, length, doc_tokens, ids; layout: row, start, sequence_id, offset), written tables."""
    spark = docs.sparkSession
    with Workspace(spark, "packing") as ws:
        table = ws.keep(pieces(docs, tokenizer_path, end_id, window), "pieces")
        rests = table.where(F.col("length") < window).select("row", "start", "length", F.ceil(F.col("length") / grain).cast("int").alias("class"))
        classes = window // grain
        counted = {r["class"]: r["n"] for r in rests.groupBy("class").agg(F.count("*").alias("n")).collect()}  # a row for each class
        histogram = np.array([counted.get(c, 0) for c in range(1, classes + 1)], np.int64)
        used, often = plan(histogram)

        # the slots of each class, a combination after another: at most PARTS rows for each that is used
        slots, taken = [], np.zeros(classes, np.int64)
        base = np.cumsum(often) - often
        for k in range(used.shape[1]):
            for c in np.flatnonzero(used[:, k]).tolist():
                m = int(used[c, k])
                slots.append((c + 1, int(taken[c]), int(taken[c] + m * often[k]), m, int(base[k])))
                taken[c] += m * often[k]
        n_planned = int(often.sum())
        salt_n = max(1, -(-int(histogram.max(initial=0)) // RANKED))
        salted = rests.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(salt_n)))
        shares = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("class", "salt").orderBy("row", "start")) - 1)
        ranked = ranked.join(shares.select("class", "salt", before.alias("before")), ["class", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
        ranked = ws.save(ranked.select("row", "start", "length", "class", "rank"), "ranked")
        bounds = spark.createDataFrame(slots or [(0, 0, 0, 1, 0)], "class int, low long, high long, m int, base long")
        # at most PARTS * classes rows, whatever the input: the solution has no more combinations than there are classes
        dealt = ranked.join(F.broadcast(bounds), (ranked["class"] == bounds["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
        dealt = dealt.select("row", "start", "length", "rank", ranked["class"].alias("class"), (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("m"))).alias("sequence_id"))
        inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "start").rowsBetween(Window.unboundedPreceding, -1)
        planned = dealt.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        planned = planned.select("row", "start", "sequence_id", "offset")

        n_left = int(histogram.sum() - taken.sum())
        batches = max(1, -(-n_left // GROUP))
        left = dealt.where("sequence_id is null").withColumn("batch", F.pmod(F.xxhash64("row", "start"), F.lit(batches)).cast("long"))
        greedy = left.select("row", "start", "length", "batch").groupBy("batch").applyInArrow(_greedy(window), "row long, start long, batch long, seq long, offset long")
        greedy = greedy.select("row", "start", (F.lit(n_planned) + F.col("seq") * batches + F.col("batch")).alias("sequence_id"), "offset")
        placed = ws.keep(planned.unionByName(greedy), "placed")
        n_placed = (placed.agg(F.max("sequence_id")).first()[0] or 0) + 1

        full = table.where(F.col("length") == window).select("row", "start").withColumn("sequence_id", F.lit(n_placed) + F.monotonically_increasing_id())
        return table, placed.unionByName(full.withColumn("offset", F.lit(0).cast("long")))


def sequences(table: DataFrame, layout: DataFrame, *, pad_id: int, window: int = WINDOW) -> DataFrame:
    """sequence_id, length, ids (little-endian unsigned 32-bit), padded to the window, or not at all at a power of two."""
    pad = pad_id.to_bytes(4, "little")

    def join(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("offset").to_numpy())
        parts = group.column("ids").to_pylist()
        ids = b"".join(parts[k] for k in order.tolist())
        n = len(ids) // 4
        if n & (n - 1):
            ids += pad * (window - n)
        return pa.table([group.column("sequence_id")[:1], pa.array([n]), pa.array([ids])], names=["sequence_id", "length", "ids"])

    placed = table.select("row", "start", "ids").join(layout, ["row", "start"])
    return placed.groupBy("sequence_id").applyInArrow(join, "sequence_id long, length long, ids binary")
