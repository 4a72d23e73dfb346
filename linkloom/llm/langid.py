"""Language identification by string kernels.

The blended spectrum kernel of two texts counts the n-grams of one to three bytes that both hold, over the root of what
each holds. A few texts of each language are landmarks; the Nyström method turns kernel values against them into
features, and kernel ridge regression on these, one language against the rest, gives the scores. A batch of texts is a
0/1 matrix of n-grams, and one product of matrices scores it: landmarks and weights are multiplied beforehand.

N-grams are of the lower-cased text with every run of bytes outside letters as one space, and only those that some
landmark holds count, which is a kernel of its own.

Every language that labels name is learnt, however many there are. Learning takes at most ``per_language`` labelled
texts of each, those with the least hash of their doc_id. Texts of more than ``longest`` characters are taken only after
all others of their language, and only with that many characters from their first letter on. Scoring takes every text
whole.

Rows: a null text, and one without a letter, is ``und`` with score 0; rows whose lang or doc_id is null teach nothing;
with nothing to learn from every row is ``und``; repeated rows are scored alike; an empty table gives an empty result;
other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean
from .textbytes import chunks, text_buffer

PER_LANGUAGE = 300
LANDMARKS = 32
LONGEST = 20_000
#: Bytes of text that are scored together.
CHUNK = 1 << 17
PENALTY = 0.1
UNDECIDED = "und"

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x61:0x7B] = _PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_TWO, _THREE = 1 << 8, (1 << 8) + (1 << 16)
_CODES = _THREE + (1 << 24)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code), with repeats, of the n-grams of one, two and three bytes of the texts of a chunk.

    Where one would reach into the next text, the byte alone stands in its place.
    """
    plain = _PLAIN[data]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 0x20) | (plain[:-1] != 0x20)
    keep[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(np.concatenate(([0], np.cumsum(keep)))[offsets]))
    b = plain[keep].astype(np.int32)
    yield row, b
    if len(b) > 1:
        two = (b[:-1] << 8) | b[1:]
        yield row[:-1], np.where(row[:-1] == row[1:], two + _TWO, b[:-1])
        if len(b) > 2:
            three = (two[:-1] << 8) | b[2:]
            yield row[:-2], np.where(row[:-2] == row[2:], three + _THREE, b[:-2])


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    out = np.diff(np.searchsorted(np.flatnonzero(ascii_letter), offsets)) > 0
    wide = np.diff(np.searchsorted(np.flatnonzero(data >= 0x80), offsets)) > 0
    for k in np.flatnonzero(wide & ~out).tolist():
        out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Classifier:
    languages: list[str]
    codes: np.ndarray
    #: A row for each n-gram and one for the constant, a column for each language.
    weights: np.ndarray

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = len(self.codes)
        if "_table" not in self.__dict__:
            self._table = np.full(_CODES, size, np.int16 if size < 1 << 15 else np.int32)  # the last column is for all others
            self._table[self.codes] = np.arange(size)
        out = np.zeros((len(offsets) - 1, size + 1), np.float32)
        flat, base = out.ravel(), None
        for row, code in grams(data, offsets):
            base = row * (size + 1) if base is None else base[: len(row)]
            flat[base + self._table[code]] = 1
        out[:, size] = 0
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text of a chunk."""
        return self.unit(data, offsets) @ self.weights[:-1] + self.weights[-1]

    def unit(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.presence(data, offsets)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}


def train(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, penalty: float = PENALTY) -> Classifier | None:
    names = sorted(set(languages))
    if not names:
        return None
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    place = {x: k for k, x in enumerate(names)}
    of = np.array([place[x] for x in languages])
    marked = np.concatenate([np.flatnonzero(of == k)[:landmarks] for k in range(len(names))])
    marks, at = text_buffer(pa.array([texts[k] for k in marked], pa.string()))
    made = Classifier(names, np.unique(np.concatenate([code for _, code in grams(marks, at)])), np.empty(0))
    units = lambda data, offsets: (made.unit(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, CHUNK))
    landmark = np.concatenate([*units(marks, at)])
    kernel = np.concatenate([x @ landmark.T for x in units(data, offsets)])
    value, vector = np.linalg.eigh((landmark @ landmark.T).astype(float))
    root = vector / np.sqrt(np.maximum(value, 1e-6 * value.max(initial=1e-300)))  # of the inverse: features are kernel rows times this
    z = kernel @ root
    mean = z.mean(0)
    target = np.eye(len(names))[of]
    w = np.linalg.solve((z - mean).T @ (z - mean) + penalty * np.eye(z.shape[1]), (z - mean).T @ (target - target.mean(0)))
    of_landmark = root @ w
    of_gram = [landmark[:, k : k + 4096].T.astype(float) @ of_landmark for k in range(0, landmark.shape[1], 4096)]
    made.weights = np.concatenate([*of_gram, [target.mean(0) - mean @ w]]).astype(np.float32)
    return made


def sampled(docs: DataFrame, teaches, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> tuple[list[str], list[str]]:
    """At most per_language texts of each language, short ones first, and of longer ones longest characters."""
    rows = docs.where(teaches).where("lang is not null and doc_id is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    least = Window.partitionBy("lang").orderBy("over", F.xxhash64("doc_id"), "doc_id")
    ranked = rows.select("lang", "doc_id", (F.length("text") > longest).alias("over")).withColumn("k", F.row_number().over(least))
    picked = ranked.where(F.col("k") <= per_language).select("lang", "doc_id", "over").distinct()
    picked = docs.sparkSession.createDataFrame(picked.collect(), picked.schema)  # at most per_language rows a language
    own = F.when(F.length("text") > longest, F.substring("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(longest))).otherwise(F.col("text"))
    texts = rows.select("lang", "doc_id", (F.length("text") > longest).alias("over"), own.alias("text"))
    got = texts.join(F.broadcast(picked), ["lang", "doc_id", "over"]).groupBy("doc_id", "lang", "over").agg(F.min("text").alias("text")).orderBy("doc_id", "lang", "over").collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def _predict(model: Classifier | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(texts)
    names, score = np.full(len(texts), UNDECIDED, object), np.zeros(len(texts))
    for a, b in chunks(offsets, CHUNK) if model else ():
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s = model.scores(own, at).astype(float)
        best, some = s.argmax(1), _has_letter(own, at)
        share = np.clip(s, 0, 1)
        share = share.max(1) / np.maximum(share.sum(1), 1e-9)
        names[a:b] = np.where(some, np.array(model.languages, object)[best], UNDECIDED)
        score[a:b] = np.where(some, np.clip(share, 0, 1), 0)
    return names, score


def identify(docs: DataFrame, *, teaches, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, lang_pred, score; teaches: a condition that rows must meet to be learnt from."""
    model = train(*sampled(docs, teaches, per_language))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _predict(model, batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(predict), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, *, teaches, least: float, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows whose language is told with at least that score, with all their columns."""
    model = train(*sampled(docs, teaches, per_language))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _predict(model, batch.column(place))
            yield batch.filter(pa.array((names != UNDECIDED) & (score >= least)))

    return docs.mapInArrow(lean(keep), docs.schema)
