"""Byte-pair encoding of whole texts with the tokenizers library, remembering what each word gave.

Both vocabularies split a text by a pattern and merge within each part alone, so a part's ids never depend on its
neighbours. Parts are found for many texts at once; the library's model encodes each part that a worker has not met. A
part is found by a hash and then compared with the remembered one, character by character, so no id rests on a hash.
Texts with characters whose class differs between Unicode versions go through the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from .textbytes import mix, powers

#: Classes of characters.
OTHER, LETTER, NUMBER, SPACE, UNSURE, END = range(6)
#: Code points from here on go through the library.
_TABLE_SIZE = 0x20000
#: Parts that a worker remembers before it starts afresh.
MEMORY = 1_200_000
#: Characters that are worked on together.
CHUNK = 1 << 18


@lru_cache(1)
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    spaces = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    table = np.full(_TABLE_SIZE, UNSURE, np.uint8)
    for code in range(_TABLE_SIZE):
        now, then = unicodedata.category(chr(code)), unicodedata.ucd_3_2_0.category(chr(code))
        if then[0] == now[0] and now not in ("Cn", "Cs"):
            table[code] = SPACE if code in spaces else kinds.get(now[0], OTHER)
    return table


@lru_cache(1)
def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """encode(texts) gives all ids, end ids included, and the number of the first id of each text."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            described = json.load(f)
        self.lower = "Lowercase" in json.dumps(described["normalizer"])
        self.end_id = end_id
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.letters = {b: x for b, x in enumerate(_byte_letters())}
        self._forget()

    def _forget(self) -> None:
        self.bits = 22
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.known = 1
        self.at = np.zeros(MEMORY + CHUNK + 2, np.int32)
        self.count = np.zeros(MEMORY + CHUNK + 2, np.int32)
        self.pool = np.zeros(1 << 20, self.width)
        self.pool[0], self.count[0], self.used = self.end_id, 1, 1
        self.spelt_at = np.zeros(MEMORY + CHUNK + 2, np.int64)
        self.spelt_n = np.zeros(MEMORY + CHUNK + 2, np.int64)
        self.spelling = np.zeros(1 << 20, np.uint32)
        self.spelt = 0

    # -- parts

    def _starts(self, a: np.ndarray, kind: np.ndarray) -> np.ndarray:
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[0], before[1:] = END, kind[:-1]
        after[-1], after[:-1] = END, kind[1:]
        solid = kind < SPACE
        runs = solid & (kind != before)
        if self.lower:
            start = runs | (kind == NUMBER) | ((kind == SPACE) & (before != SPACE))
        else:
            blank = np.zeros(len(a), bool)
            blank[1:] = a[:-1] == 0x20
            start = (runs & ~blank) | ((kind == SPACE) & ((before != SPACE) | (after < SPACE)))
        start |= kind == END
        quote = np.flatnonzero((a == 0x27) & runs)
        if len(quote):
            if not self.lower:
                quote = quote[(quote == 0) | (a[quote - 1] != 0x20)]
            one, two = a[np.minimum(quote + 1, len(a) - 1)], a[np.minimum(quote + 2, len(a) - 1)]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            start[quote[single] + 1] = False
            start[quote[single] + 2] = True
            start[quote[double] + 1] = False
            start[quote[double] + 2] = False
            start[quote[double] + 3] = True
        return start

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.keys[slot]
        out = np.where(seen == h, self.entry[slot], np.int32(-1))
        left = np.flatnonzero((seen != h) & (seen != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            seen = self.keys[slot[left]]
            same = seen == h[left]
            out[left[same]] = self.entry[slot[left[same]]]
            left = left[~same & (seen != 0)]
        return out

    def _put(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Adds hashes that are distinct and absent."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.entry[slot[won]] = entries[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & mask

    def _learn(self, spans: list[str]) -> np.ndarray:
        """New entries for these parts."""
        model, letters = self.tokenizer.model, self.letters
        found = [[t.id for t in model.tokenize(x.encode().decode("latin-1").translate(letters))] for x in spans]
        n = len(found)
        counts = np.fromiter(map(len, found), np.int32, n)
        flat = np.fromiter((i for x in found for i in x), self.width, int(counts.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        new = np.arange(self.known, self.known + n, dtype=np.int32)
        self.count[new], self.at[new] = counts, self.used + np.cumsum(counts) - counts
        letters = np.frombuffer("".join(spans).encode("utf-32-le", "surrogatepass"), np.uint32)
        while self.spelt + len(letters) > len(self.spelling):
            self.spelling = np.concatenate([self.spelling, np.zeros_like(self.spelling)])
        self.spelling[self.spelt : self.spelt + len(letters)] = letters
        sizes = np.fromiter(map(len, spans), np.int64, n)
        self.spelt_n[new], self.spelt_at[new] = sizes, self.spelt + np.cumsum(sizes) - sizes
        self.used, self.known, self.spelt = self.used + len(flat), self.known + n, self.spelt + len(letters)
        return new

    def _differing(self, a: np.ndarray, begin: np.ndarray, end: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The parts that aren't spelt like their entries."""
        size = end - begin
        wrong = size != self.spelt_n[entry]
        size = np.where(wrong, 0, size)
        stop = np.cumsum(size)
        each = np.arange(stop[-1] if len(stop) else 0)
        at = each + np.repeat(begin - (stop - size), size)
        there = each + np.repeat(self.spelt_at[entry] - (stop - size), size)
        unlike = np.flatnonzero(a[at] != self.spelling[there])
        wrong[np.searchsorted(stop, unlike, "right")] = True
        return np.flatnonzero(wrong)

    # -- texts

    def whole(self, text: str) -> np.ndarray:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array([*ids, self.end_id], self.width)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts, group, size = [], [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= CHUNK:
                self._chunk(group, parts, counts)
                group, size = [], 0
        if group:
            self._chunk(group, parts, counts)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.concatenate(counts) if counts else np.empty(0, np.int64), out=first[1:])
        return np.concatenate(parts) if parts else np.empty(0, self.width), first

    def _chunk(self, texts: list[str], parts: list, counts: list) -> None:
        table = class_table()
        plain = texts
        if self.lower:
            plain = [(t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ")).lower() for t in texts]
        joined = "\0".join([*plain, ""])
        a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = table[np.minimum(a, _TABLE_SIZE - 1)]
        kind[a >= _TABLE_SIZE] = UNSURE
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1) - 1
        kind[ends] = END
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(kind == UNSURE)))
        if self.lower:  # characters that lower-casing replaced
            rare = [k for k, t in enumerate(texts) if not t.isascii() and self._unsure(t)]
            odd = np.union1d(odd, rare).astype(np.int64)
        kind[kind == UNSURE] = OTHER
        begin = np.flatnonzero(self._starts(a, kind))
        end = np.append(begin[1:], len(a))
        if self.lower:
            used = kind[begin] != SPACE
            begin, end = begin[used], end[used]
        final = kind[begin] == END
        power, inverse = powers(len(a) + 1)
        values = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        values ^= values >> np.uint64(29)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(values * power[: len(a)], out=sums[1:])
        h = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        h[h == 0] = 1
        entry = self._find(h)
        entry[final] = 0
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.known + len(new) > MEMORY:
                self._forget()
                new = np.flatnonzero(~final)
            value, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            learnt = self._learn([joined[s:e] for s, e in zip(begin[new[where]].tolist(), end[new[where]].tolist())])
            self._put(value, learnt)
            entry[new] = learnt[back]
        inner = np.flatnonzero(~final)
        wrong = inner[self._differing(a, begin[inner], end[inner], entry[inner])]
        if len(wrong):  # another part of the same hash is remembered
            entry[wrong] = self._learn([joined[s:e] for s, e in zip(begin[wrong].tolist(), end[wrong].tolist())])
        n = self.count[entry].astype(np.int64)
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[entry] - (stop - n), n) + np.arange(stop[-1])]
        last = stop[np.flatnonzero(final)]
        each = np.diff(last, prepend=0)
        if len(odd):
            pieces = np.split(ids, last[:-1])
            for k in odd.tolist():
                pieces[k] = self.whole(texts[k])
                each[k] = len(pieces[k])
            ids = np.concatenate(pieces)
        parts.append(ids)
        counts.append(each)

    @staticmethod
    def _unsure(text: str) -> bool:
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return bool((a >= _TABLE_SIZE).any() or (class_table()[np.minimum(a, _TABLE_SIZE - 1)] == UNSURE).any())


@lru_cache(2)
def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path, end_id)
