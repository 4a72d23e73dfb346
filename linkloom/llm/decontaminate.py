"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every test item. A text's words go through it, and at each word it knows the
longest run of words ending there that some item has. A run of ``window`` words, or a whole item of fewer, is a leak.

Only words that occur in some item can belong to a match, so a text falls into runs of such words, each of which starts
at the automaton's root. All runs of many texts advance together, one word at a step. Word hashes choose the runs; every
text in which they find a leak is then read again by the words themselves, and so is every text with a word whose hash
several words of the items share, so that a result never rests on a hash.

Items are taken in blocks of bounded size, one pass over the texts for each block, so that what a worker holds does not
grow with the benchmark.

Rows: a null or empty text has no words; a null item none either; items without words leak nowhere; repeated item_ids
count once; an empty benchmark leaks nowhere; other columns of any name are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, lean
from .textbytes import ALNUM, Words, chunks, text_buffer

WINDOW = 10
#: Characters of items in a block.
BLOCK = 1 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


class Automaton:
    """Of word numbers; state 0 is the root. step() and the tables below take many states at once."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        closing: list[list[int]] = [[]]
        self.items = [str(name) for name, _ in items]
        for item, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)), ends, closing)
                ends[last].add(item)
            if words and len(words) < window:
                closing[last].append(item)
        self._settle(ends, closing)

    def _state(self, length: int, follow: dict, link: int, ends: list, closing: list) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        closing.append([])
        return len(self.next) - 1

    def _extend(self, last: int, word: int, ends: list, closing: list) -> int:
        old = self.next[last].get(word)
        if old is not None and self.length[old] == self.length[last] + 1:
            return old
        if old is None:
            made = self._state(self.length[last] + 1, {}, 0, ends, closing)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = made
                at = self.link[at]
            if at >= 0:
                to = self.next[at][word]
                self.link[made] = to if self.length[to] == self.length[at] + 1 else self._clone(at, to, word, ends, closing)
            return made
        return self._clone(last, old, word, ends, closing)

    def _clone(self, at: int, to: int, word: int, ends: list, closing: list) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to], ends, closing)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _settle(self, ends: list[set[int]], closing: list[list[int]]) -> None:
        """Down the suffix links: which state stands for the last ``window`` words, and which short items end here."""
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.at_window = [0] * n
        self.short: list[tuple[int, ...]] = [()] * n
        self.longest_short = [0] * n
        for s in order:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.at_window[s] = s if self.length[up] < self.window else self.at_window[up]
            self.short[s] = (*self.short[up], *closing[s])
            self.longest_short[s] = self.length[s] if closing[s] else self.longest_short[up]
        for s in reversed(order):
            ends[self.link[s]] |= ends[s]
        self.ends = {s: frozenset(ends[s]) for s in order if self.at_window[s] == s}
        self.shortest = min([self.window] + [self.length[s] for s in order if closing[s]])

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """([(first, last) of each hit], items) of a text, one word after another."""
        spans, found, state, length = [], set(), 0, 0
        for i, word in enumerate(words):
            w = self.vocabulary.get(word)
            if w is None:
                state = length = 0
                continue
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            if length >= self.window:
                spans.append((i - self.window + 1, i))
                found |= self.ends[self.at_window[state]]
            whole = state if length == self.length[state] else self.link[state]
            if whole > 0 and self.longest_short[whole]:
                spans.append((i - self.longest_short[whole] + 1, i))
                found.update(self.short[whole])
        return spans, found

    # -- many runs at once

    def tables(self) -> None:
        """Arrays for lock-step walking; made once in each worker."""
        names = "\n".join(self.vocabulary).encode()
        lengths = np.array([len(w.encode()) for w in self.vocabulary], np.int64) + 1
        stops = np.cumsum(lengths)
        h = Words(np.frombuffer(names, np.uint8), np.concatenate(([0], stops[:-1], [len(names)])) if len(stops) else np.zeros(1, np.int64), ALNUM).hash
        self.word_order = np.argsort(h)
        self.word_hash = h[self.word_order]
        same = np.flatnonzero(self.word_hash[1:] == self.word_hash[:-1])
        self.unclear = self.word_order[np.union1d(same, same + 1)]
        bits = 20
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        v = max(1, len(self.vocabulary))
        edges = [(s * v + w, t) for s, follow in enumerate(self.next) for w, t in follow.items()]
        keys, targets = np.array([e[0] for e in edges] or [0], np.int64), np.array([e[1] for e in edges] or [0], np.int64)
        order = np.argsort(keys)
        self.edge, self.target, self.size = keys[order], targets[order], v
        self.links, self.lengths = np.maximum(np.array(self.link), 0), np.array(self.length)
        self.shorts = np.array(self.longest_short)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word by its hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.word_hash):
            maybe = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.word_hash, h[maybe]), len(self.word_hash) - 1)
            same = self.word_hash[at] == h[maybe]
            out[maybe[same]] = self.word_order[at[same]]
        return out

    def suspects(self, number: np.ndarray, document: np.ndarray) -> np.ndarray:
        """The documents that can have a leak."""
        doubtful = document[np.isin(number, self.unclear)] if len(self.unclear) else document[:0]
        known = number >= 0
        begins = known.copy()
        begins[1:] &= ~known[:-1] | (document[1:] != document[:-1])
        ends = known.copy()
        ends[:-1] &= ~known[1:] | (document[1:] != document[:-1])
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that those still running are a prefix
        begin, size = begin[order], (end - begin)[order]
        state, length, leaks = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), np.zeros(len(begin), bool)
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, "left"))  # runs of more than k words
            s, m, w = state[:n], length[:n], number[begin[:n] + k]
            left = np.arange(n)
            while len(left):
                key = s[left] * self.size + w[left]
                at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                found = self.edge[at] == key
                hit = left[found]
                s[hit] = self.target[at[found]]
                m[hit] += 1
                left = left[~found]
                m[left[s[left] == 0]] = 0
                left = left[s[left] > 0]
                s[left] = self.links[s[left]]
                m[left] = self.lengths[s[left]]
            whole = np.where(m == self.lengths[s], s, self.links[s])
            leaks[:n] |= (m >= self.window) | (self.shorts[whole] > 0)
        return np.unique(np.concatenate([document[begin[leaks]], doubtful]))


_made: dict[str, Automaton] = {}


def _automaton(key: str, items: list, window: int) -> Automaton:
    if key not in _made:
        _made.clear()
        _made[key] = Automaton(items, window)
        _made[key].tables()
    return _made[key]


def _mark(hits: bytes | None, n: int, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(a bit for each word of the text, how many are set)"""
    marks = np.unpackbits(np.frombuffer(hits, np.uint8), count=n).astype(bool) if hits else np.zeros(n, bool)
    for first, last in spans:
        marks[first : last + 1] = True
    return np.packbits(marks).tobytes(), int(marks.sum())


def _pass(items: list, window: int, key: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, items, window)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            n_words = np.zeros(batch.num_rows, np.int64)
            hits, found, n_hit = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                n_words[a:b] = np.diff(words.first)
                for k in automaton.suspects(automaton.numbers(words.hash), words.document()).tolist():
                    spans, names = automaton.scan(words_of(batch.column(1)[a + k].as_py()))
                    if spans:
                        hits[a + k], n_hit[a + k] = _mark(hits[a + k], int(n_words[a + k]), spans)
                        found[a + k] = [*(found[a + k] or []), *(automaton.items[i] for i in names)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_words), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.string())), pa.array(n_hit, pa.int64())], names=batch.schema.names)

    return scan


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[str]]]]:
    """Items with words, in blocks of bounded size."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        words = words_of(row["text"])
        if words:
            block.append(("null" if row["item_id"] is None else str(row["item_id"]), words))
            size += len(row["text"])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_words, hits (a bit for each word, from the highest of the first byte; null if none), items, n_hit."""
    return _find(docs.select(F.col("doc_id").cast("long"), "text"), item_blocks(benchmark), window)


def _find(rows: DataFrame, blocks: Iterable[list], window: int) -> DataFrame:
    """The two columns of the rows, a key of any type and a text, and the others of find_leaks()."""
    key = rows.columns[0]
    found = rows.select(key, "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_hit"))
    for k, block in enumerate(blocks):
        if block or k == 0:
            found = found.mapInArrow(lean(_pass(block, window, uuid.uuid4().hex)), found.schema)
    return found


def cut_words(text: str, marks: np.ndarray) -> str:
    """The text without the marked words, a space for each run of them; what stands between other words stays."""
    kept, at, out = [], 0, False
    for i, m in enumerate(WORD.finditer(text.translate(_LOWER))):
        if marks[i]:
            if not out:
                kept.append(text[at : m.start()])
            at, out = m.end(), True
        elif out:
            kept.append(" ")
            out = False
    return "".join([*kept, text[at:]])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """The documents without the words of leaks, and without documents of which leaks are more than that share.

    A cut can bring words together that make another leak, so a text is searched again until none is left; what later
    cuts take counts too. Nothing of this depends on how the items fall into blocks.
    """
    blocks = [block for block in item_blocks(benchmark) if block]
    if len(blocks) > 1:
        return _remove_in_rounds(docs, blocks, window, coverage)
    place = docs.columns.index("text")
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(items: list, key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, items, window)
            for batch in batches:
                data, offsets = text_buffer(batch.column(place))
                changed: dict[int, str | None] = {}
                for a, b in chunks(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                    for k in automaton.suspects(automaton.numbers(words.hash), words.document()).tolist():
                        text, n, gone = batch.column(place)[a + k].as_py(), int(np.diff(words.first)[k]), 0
                        while spans := automaton.scan(own := words_of(text))[0]:
                            marks, size = _mark(None, len(own), spans)
                            text, gone = cut_words(text, np.unpackbits(np.frombuffer(marks, np.uint8))), gone + size
                        if gone:
                            changed[a + k] = text if gone <= coverage * n else None
                if changed:
                    texts = batch.column(place).to_pylist()
                    for k, text in changed.items():
                        texts[k] = text
                    batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
                    if sized is not None:
                        sizes = batch.column(sized).to_pylist()
                        for k, text in changed.items():
                            sizes[k] = len(text or "")
                        batch = batch.set_column(sized, batch.schema.field(sized), pa.array(sizes, batch.schema.field(sized).type))
                    batch = batch.filter(pa.array([changed.get(k, "") is not None for k in range(len(texts))]))
                yield batch

        return run

    return docs.mapInArrow(lean(clean(blocks[0], uuid.uuid4().hex)), docs.schema) if blocks else docs


def _remove_in_rounds(docs: DataFrame, blocks: list[list], window: int, coverage: float) -> DataFrame:
    """remove_leaks() where no worker holds all items: each round finds the leaks of all blocks, and cuts them at once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(text, np.unpackbits(np.frombuffer(hits, np.uint8))) for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    row = F.struct(*[c for c in docs.columns if c != "text"], F.lit(0).alias("text")).alias("row")  # never without a field
    rows = docs.select(F.struct(row, F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("gone")).alias("key"), "text")
    done: list[DataFrame] = []
    with Workspace(docs.sparkSession, "decontamination") as ws:
        while True:
            found = ws.keep(_find(rows, blocks, window).select("key", "text", "n_words", "hits", "n_hit"), f"round-{len(done)}")
            clean = found.where("n_hit = 0")
            kept = {c: clean["key"]["row"][c] for c in docs.columns if c != "text"} | {"text": clean["text"]}
            if done and "n_chars" in kept:
                kept["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
            done.append(clean.select(*[kept[c].alias(c) for c in docs.columns]))
            n, gone = F.coalesce("key.n", "n_words"), F.col("key.gone") + F.col("n_hit")
            leaky = found.where(F.col("n_hit") > 0).where(gone <= F.lit(float(coverage)) * n)
            if leaky.isEmpty():
                break
            leaky = leaky.select(F.struct(F.col("key.row").alias("row"), n.alias("n"), gone.alias("gone")).alias("key"), "text", "hits")
            rows = leaky.mapInArrow(lean(cut), leaky.select("key", "text").schema)
    return reduce(DataFrame.unionAll, done)
