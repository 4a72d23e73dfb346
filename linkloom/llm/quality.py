"""Quality scores from document statistics by random Fourier features, ridge regression and isotonic calibration.

Each whole text gives a few statistics. Random cosines of the standardised statistics approximate a Gaussian kernel on
them; the normal equations of ridge regression are summed within partitions and then over them, on all labelled rows.
Rows that the regression did not see calibrate its output: pool-adjacent-violators over counts in score bins.

Rows: a null text is an empty one and is scored; rows whose label or doc_id is null teach nothing; a doc_id with several
labels teaches with each; with no usable label every score is 0.5; an empty table gives an empty result; other columns
of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, lean
from .textbytes import NONSPACE, Words, byte_table, chunks, mix, text_buffer

STATISTICS = ["bytes", "words", "word_length", "word_spread", "upper", "digit", "punctuation", "symbol", "bar", "space", "line", "wide", "distinct", "repeated", "top", "short", "long", "sentence", "capital", "symbol_end", "pairs"]
WAVES = 256
PENALTY = 1.0
#: Of rows that may teach, the share that calibrates: one of so many.
CALIBRATION = 4
BINS = 1000
#: Tasks that add up the partitions' sums.
ADDERS = 16

_SYMBOL = ~byte_table(b"#$%&*+/<=>@[\\]^_`{|}~")
_PUNCTUATION = ~byte_table(b"!\"'(),-.:;?")
_SENTENCE = ~byte_table(b".!?")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of a chunk."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    words = Words(data, offsets, NONSPACE)
    n = np.diff(words.first)
    of = words.document()
    length = words.end - words.start
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n, 1)

    def bytes_in(table: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(table[data]), offsets))

    def words_that(true: np.ndarray) -> np.ndarray:
        return np.bincount(of[true], minlength=rows) * per_word

    def between(low: int, high: int) -> np.ndarray:
        table = np.zeros(256, bool)
        table[low : high + 1] = True
        return table

    mean = np.bincount(of, length, rows) * per_word
    spread = np.sqrt(np.maximum(np.bincount(of, length.astype(float) ** 2, rows) * per_word - mean**2, 0))
    same = np.zeros(len(of), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    seed = mix(np.arange(1, rows + 1, dtype=np.uint64))
    own, count = np.unique(words.hash ^ seed[of], return_index=True, return_counts=True)[1:] if len(of) else (np.empty(0, int), np.empty(0, int))
    distinct = np.bincount(of[own], minlength=rows) * per_word
    top = np.zeros(rows)
    np.maximum.at(top, of[own], count)
    pair = words.hash[:-1] * np.uint64(3) + words.hash[1:] ^ seed[of[1:]] if len(of) > 1 else np.empty(0, np.uint64)
    pair, owner = (pair[of[1:] == of[:-1]], of[1:][of[1:] == of[:-1]]) if len(of) > 1 else (pair, of[:0])
    pairs = np.bincount(owner[np.unique(pair, return_index=True)[1]], minlength=rows) / np.maximum(n - 1, 1)
    lines = bytes_in(between(10, 10))
    last = data[words.end - 1] if len(of) else data[:0]
    head = data[words.start] if len(of) else data[:0]
    columns = [
        np.log1p(size), np.log1p(n), mean, spread, bytes_in(between(0x41, 0x5A)) * per_byte, bytes_in(between(0x30, 0x39)) * per_byte, bytes_in(_PUNCTUATION) * per_byte, bytes_in(_SYMBOL) * per_byte,
        bytes_in(between(0x7C, 0x7C)) * per_byte, bytes_in(~NONSPACE) * per_byte, np.log1p(size / (lines + 1)), bytes_in(between(0x80, 0xFF)) * per_byte, distinct, words_that(same), top * per_word,
        words_that(length <= 3), words_that(length >= 12), words_that(_SENTENCE[last]), words_that((head >= 0x41) & (head <= 0x5A)), words_that(_SYMBOL[last]), pairs,
    ]
    return np.stack(columns, 1)


def waves(seed: int = 7, count: int = WAVES) -> tuple[np.ndarray, np.ndarray]:
    """Directions of a Gaussian kernel whose width is the square root of the number of statistics, and phases."""
    random = np.random.default_rng(seed)
    d = len(STATISTICS)
    return random.normal(size=(d, count)) / np.sqrt(d), random.uniform(0, 2 * np.pi, count)


def raised(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The random features, and a constant."""
    w, phase = waves()
    z = np.cos(np.clip((x - mean) / spread, -8, 8) @ w + phase) * np.sqrt(2 / len(phase))
    return np.concatenate([z, np.ones((len(z), 1))], 1)


def isotonic(score: np.ndarray, hits: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The non-decreasing values closest to hits / count, weighted by count, in the order of the scores given."""
    blocks: list[list[float]] = []
    for h, n in zip(hits.tolist(), count.tolist()):
        blocks.append([h, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), h / n) for h, n, k in blocks]) if blocks else np.empty(0)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    at: np.ndarray | None = None
    value: np.ndarray | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(raised(x, self.mean, self.spread) @ self.weights, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.clip(np.interp(raw, self.at, self.value), 0, 1) if self.at is not None and len(self.at) else raw


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, len(STATISTICS)).astype(float)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, as packed 32-bit floats."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            rows = [x.tobytes() for a, b in chunks(offsets) for x in statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype("<f4")]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(measure), "doc_id long, x binary")


def summed(rows: DataFrame, of_batch, size: int) -> np.ndarray:
    """The sum over all rows of the vectors that of_batch gives: within partitions, then over ADDERS tasks, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total, some = total + of_batch(batch), True
        if some:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % ADDERS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for v in batch.column(1).to_pylist():
                total, some = total + np.frombuffer(v), True
        if some:
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    parts = rows.mapInArrow(lean(partial), "k int, v binary").repartition(ADDERS, "k").mapInArrow(add, "k int, v binary").collect()  # ADDERS rows at most
    return sum((np.frombuffer(r["v"]) for r in parts), np.zeros(size))


def fit(rows: DataFrame) -> Model:
    """From rows (x, y 0 or 1, fold): fold 0 calibrates, the others fit."""
    d, m = len(STATISTICS), WAVES + 1
    mine = rows.where("fold <> 0").select("x", "y")

    def moments(batch):
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    total = summed(mine, moments, 1 + 2 * d)
    n = total[0]
    if not n:
        return Model(np.zeros(d), np.ones(d))
    mean = total[1 : 1 + d] / n
    spread = np.sqrt(np.maximum(total[1 + d :] / n - mean**2, 1e-8))

    def equations(batch):
        z = raised(_matrix(batch.column(0)), mean, spread)
        return np.concatenate([(z.T @ z).ravel(), z.T @ batch.column(1).to_numpy()])

    total = summed(mine, equations, m * m + m)
    gram = total[: m * m].reshape(m, m) + PENALTY * np.diag([1.0] * WAVES + [0.0])
    model = Model(mean, spread, np.linalg.lstsq(gram, total[m * m :], rcond=None)[0])

    def binned(batch):
        k = np.minimum((model.raw(_matrix(batch.column(0))) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, batch.column(1).to_numpy(), BINS)])

    total = summed(rows.where("fold = 0").select("x", "y"), binned, 2 * BINS)
    count, hits = total[:BINS], total[BINS:]
    some = np.flatnonzero(count)
    model.at, model.value = (some + 0.5) / BINS, isotonic(some, hits[some], count[some])
    return model


def learn(rows: DataFrame, labels: DataFrame, *, teaches, label: str = "quality") -> Model:
    """From measured rows; teaches: a condition on doc_id that labelled rows must meet to be learnt from."""
    with Workspace(rows.sparkSession, "quality-model") as ws:
        known = labels.where(teaches).where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION))
        return fit(ws.save(rows.join(known, "doc_id").select("x", "y", fold.alias("fold")), "taught"))


def score_quality(docs: DataFrame, labels: DataFrame, *, teaches, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """doc_id, score, predicted of every text; the texts are measured once."""
    with Workspace(docs.sparkSession, "quality") as ws:
        rows = ws.keep(measured(docs), "statistics")
    model = learn(rows, labels, teaches=teaches, label=label)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(1))) if batch.num_rows else np.empty(0)
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(lean(score), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, teaches, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """The rows whose text scores at least the threshold, with all their columns."""
    model = learn(measured(docs), labels, teaches=teaches, label=label)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(place))
            good = [model.score(statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) >= threshold for a, b in chunks(offsets)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.empty(0, bool)))

    return docs.mapInArrow(lean(keep), docs.schema)
