"""Jaccard join on word shingles by parity sketches.

A document is the set of its distinct shingles. XOR-ing the hashes of a set into buckets makes a sketch that changes
only where two sets differ: with one bit for each bucket, the Hamming distance of two sketches is at most the size of
their symmetric difference. For a pair of sizes a and b a similarity of p/q bounds that difference by
(a + b)(q - p) / (q + p). So with more blocks of buckets than that bound, two linked sets agree on a block whole
(pigeonhole); sizes fall into bands, each with its own number of blocks, and a set near the end of a band also joins the
next one. Agreement on enough blocks makes candidates, the Hamming distance prunes them, the words of the texts verify
them: hashes find pairs, but no link rests on one.

Equal sequences of words collapse to one node (by a cryptographic digest) before any pair is made; different sequences
can have equal sets ("a a a" and "a a a a"), so sets too small to differ from a linked one meet as well. Blocks go to the
joining tasks as packed arrays, one entry for each block value and scan task, so that a value that a third of all sets
share costs one entry a task. A set meets others on its rarest block values only, as many as pigeonhole asks for. Of the
sets that share a block value, the one that shares the most with others is compared with all of them; only sets that are
still in different components are compared with each other. Links inside a component that is already known are not
searched. A set that many pairs have in common goes once to each task that compares others with it, in portions of
bounded size. Texts are always fetched and removed by a merge join, whatever the size of what is looked for: it grows with
the corpus, so a broadcast that a small corpus allows would be another plan than the one that counts.

Rows: a null or empty text and one without words has an empty set, linked with nothing; a row whose doc_id is null takes
no part and has a null component (in keep_one it does take part); rows that repeat a doc_id are one document if their
texts have equal words, and different documents of the same id otherwise, so that a doc_id can have several components;
ties (equal sets) are linked; a text of any length is one set; an empty table gives an empty result; other columns of any
name are ignored. n_shingles counts distinct 64-bit hashes of shingles within a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, lean, shuffle_partitions
from .textbytes import NONSPACE, Words, chunks, mix, shingles, text_buffer

#: Block values that a scan task holds before it passes them on.
HELD = 1_500_000
#: Bytes of text whose block values one task joins.
JOINED = 64 << 20
#: Sets that one task compares with the same set.
PORTION = 20_000
#: Bits of the sketch that travels with a set's blocks, at most.
SHORT = 1024
_LOW48 = np.uint64((1 << 48) - 1)
PACKED = "part int, kind int, flush long, a binary, b binary, c binary, d binary, e binary, f binary"
FOUND = "kind int, flush long, idx int, key long, part int, node binary, doc_id long, n long, need long, further long, digest binary, sketch binary"


class Bands:
    """Size bands for a similarity of at least p/q."""

    def __init__(self, p: int, q: int):
        if not 2 * p >= q:
            raise ValueError("the bands need a similarity of at least a half")
        self.p, self.q = p, q
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, edges[-1] * 5 * q // (4 * p)))
        self.edge = np.array(edges, np.int64)
        self.differ = 2 * (self.edge[1:] - 1) * (q - p) // (q + p)
        #: A quarter more blocks than needed: hardly a set depends on its empty blocks, and linked sets agree on several.
        #: Where a band allows no difference, one block stands for the whole set.
        self.blocks = np.where(self.differ > 0, self.differ + 3 + self.differ // 4, 1)

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, band, 1 if it isn't the set's own) of each band that each set joins in."""
        own = np.searchsorted(self.edge, n, "right") - 1
        near = np.flatnonzero((n > 0) & (self.q * n >= self.p * self.edge[np.minimum(own + 1, len(self.edge) - 1)]))
        who = np.concatenate([np.flatnonzero(n > 0), near])
        band = np.concatenate([own[n > 0], own[near] + 1])
        further = np.concatenate([np.zeros((n > 0).sum(), np.int64), np.ones(len(near), np.int64)])
        return who, band, further


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    h, first = shingles(Words(data, offsets, NONSPACE), size)
    return [np.unique(h[s:e]) for s, e in zip(first[:-1].tolist(), first[1:].tolist())]


def node_of(text: bytes) -> bytes:
    """128 bits that stand for the words of a text."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """The bits of a set's sketch, a power of two: four for each member, but at most SHORT of these, and one at least.

    With four bits a member hardly two differences fall on one bit, so that the distance is nearly the difference itself.
    """
    power = lambda x: 1 << np.ceil(np.log2(np.maximum(x, 64))).astype(np.int64)
    return np.maximum(power(n), np.minimum(SHORT, power(4 * n)))


def sketches(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all sketches, offsets): bit k is the parity of the hashes whose low bits are k."""
    wide = sketch_bits(n)
    stop = np.cumsum(wide)
    bit = np.repeat(stop - wide, n) + (flat & np.repeat(wide - 1, n).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(bit, minlength=int(stop[-1]) if len(n) else 0) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little"), np.concatenate([[0], stop // 8])


def apart(a: int, a_bits: int, b: int, b_bits: int) -> int:
    """The Hamming distance of two sketches, of which the wider one is folded."""
    while a_bits > b_bits:
        a_bits //= 2
        a = (a >> a_bits) ^ (a & ((1 << a_bits) - 1))
    while b_bits > a_bits:
        b_bits //= 2
        b = (b >> b_bits) ^ (b & ((1 << b_bits) - 1))
    return (a ^ b).bit_count()


def block_values(flat: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, value, need). value of each block: the XOR of the hashes that fall into it, mixed with its place.

    A lane is a set in a band: twice the set, and one more in the next band. need, for each lane: as many of its filled
    blocks agree with a linked set at least.
    """
    need = np.zeros(2 * len(n), np.int32)
    who, band, further = bands.of(n)
    lane = 2 * who + further
    begin = np.cumsum(n) - n
    size = n[who]
    stop = np.cumsum(size)
    each = np.repeat(np.arange(len(who)), size)
    h = flat[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(begin[who], size)]
    blocks = bands.blocks[band].astype(np.uint64)
    at = ((h >> np.uint64(32)) * blocks[each]) >> np.uint64(32)  # rises with the hash, so a block's hashes stand together
    change = np.ones(len(h), bool)
    change[1:] = (at[1:] != at[:-1]) | (each[1:] != each[:-1])
    run = np.flatnonzero(change)
    if not len(run):
        return np.empty(0, np.int64), np.empty(0, np.uint64), need
    of, place, value = each[run], at[run], np.bitwise_xor.reduceat(h, run)
    # a pair that agrees on empty blocks alone differs in every filled one: only sets with too few of these need the empty ones
    filled = np.bincount(of, minlength=len(who))
    # by its own size and that of the largest partner in the band
    partner = np.minimum(bands.edge[band + 1] - 1, bands.q * n[who] // bands.p)
    need[lane] = np.maximum(filled - (n[who] + partner) * (bands.q - bands.p) // (bands.q + bands.p), 0)
    for k in np.flatnonzero(filled <= bands.differ[band]).tolist():
        gaps = np.setdiff1d(np.arange(int(blocks[k]), dtype=np.uint64), place[of == k])
        of, place, value = np.concatenate([of, np.full(len(gaps), k)]), np.concatenate([place, gaps]), np.concatenate([value, np.zeros(len(gaps), np.uint64)])
    return lane[of], mix(value + place * np.uint64(0x9E3779B97F4A7C15) + (band[of].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)), need


def _scan(size: int, p: int, q: int, parts: int):
    bands = Bands(p, q)

    def flush(ids: list, digest: list, nodes: list, ns: list, who: list, values: list, needs: list, bits: list) -> Iterator[pa.RecordBatch]:
        doc_id, digest, node, n = pa.concat_arrays(ids), b"".join(digest), np.concatenate(nodes), np.concatenate(ns)
        name = np.ascontiguousarray(node).view("V16").ravel()
        _, first, back = np.unique(name, return_index=True, return_inverse=True)
        idx = first[back].astype("<i4")
        who, values, need = np.concatenate(who), np.concatenate(values), np.concatenate(needs)
        own = idx == np.arange(len(idx))
        new = own[who // 2]  # equal sets speak once
        who, values = who[new].astype("<i4"), values[new]
        order = np.argsort(values)
        who, values = who[order], values[order]
        name = int(np.bitwise_xor.reduce(mix(node[:, 0] + np.arange(len(n), dtype=np.uint64))).view(np.int64))
        head = np.ones(len(values), bool)
        head[1:] = values[1:] != values[:-1]
        size_of = np.diff(np.append(np.flatnonzero(head), len(values)))
        shared = np.repeat(size_of > 1, size_of)
        rows = [(abs(name) % parts, 0, [idx, node, np.concatenate([n.astype("<i8"), need.astype("<i8")]), _ids(doc_id), digest, b"".join(bits)])]
        here = np.flatnonzero(shared)
        for k in range(0, len(here), 100_000):
            x = here[k : k + 100_000]
            rows.append(((abs(name) + k) % parts, 1, [values[x], who[x], None, None, None, None]))
        values, who = values[head], who[head]
        part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            x = slice(edge[k], edge[k + 1])
            low = (values[x] & _LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((k, 2, [low, who[x].astype("<u2") if len(n) <= 1 << 15 else who[x], None, None, None, None]))
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            columns = [pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int32()), pa.array([name] * len(some), pa.int64())]
            columns += [pa.array([x[j] if x[j] is None or isinstance(x[j], bytes) else x[j].tobytes() for _, _, x in some], pa.binary()) for j in range(6)]
            yield pa.record_batch(columns, names=["part", "kind", "flush", "a", "b", "c", "d", "e", "f"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(8)]
        docs = total = 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            digest = batch.column(1).to_pylist()
            for a, b in chunks(offsets):
                sets = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate(sets)
                lane, values, need = block_values(flat, n, bands)
                nodes = np.frombuffer(b"".join(node_of(data[x:y].tobytes()) for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist())), np.uint64).reshape(-1, 2)
                for x, y in zip(held, (batch.column(0).slice(a, b - a), b"".join(digest[a:b]), nodes, n, lane + 2 * docs, values, need, sketches(flat, n)[0].tobytes())):
                    x.append(y)
                docs, total = docs + len(n), total + len(values)
                if total >= HELD or docs > 30_000:
                    yield from flush(*held)
                    held, docs, total = [[] for _ in range(8)], 0, 0
        if docs:
            yield from flush(*held)

    return scan


def _ids(doc_id: pa.Array) -> bytes:
    """doc_ids as longs; a null is the least one."""
    return doc_id.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype("<i8").tobytes()


def _sixteen(data: bytes) -> pa.Array:
    n = len(data) // 16
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(data)])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents, and (value, set) of each block value that several sets share. Parts come one after another."""
    fields = [("kind", pa.int32()), ("flush", pa.int64()), ("idx", pa.int32()), ("key", pa.int64()), ("part", pa.int32()), ("node", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("need", pa.int64()), ("further", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())]

    def row(kind, size, **given):
        columns = []
        for name, t in fields:
            x = given.get(name, kind if name == "kind" else None)
            columns.append(pa.nulls(size, t) if x is None else pa.array(np.full(size, x), t) if np.isscalar(x) else x if isinstance(x, pa.Array) else pa.array(x, t))
        return pa.record_batch(columns, names=[name for name, _ in fields])

    def joined(part: int, got: list) -> Iterator[pa.RecordBatch]:
        values = np.concatenate([v for v, _, _ in got])
        who = np.concatenate([w for _, w, _ in got])
        flush = np.repeat(np.array([f for _, _, f in got], np.int64), [len(v) for v, _, _ in got])
        order = np.argsort(values, kind="stable")
        values = values[order]
        same = np.zeros(len(values), bool)
        same[1:] = values[1:] == values[:-1]
        same[:-1] |= same[1:]
        order, values = order[same], values[same]
        for k in range(0, len(order), 200_000):
            x = order[k : k + 200_000]
            yield row(1, len(x), flush=flush[x], idx=who[x], key=values[k : k + 200_000].astype(np.int64), part=part)

    part, got = -1, []
    for batch in batches:
        for x in batch.to_pylist():
            if x["kind"] == 0:
                ids, idx = np.frombuffer(x["d"], "<i8"), np.frombuffer(x["a"], "<i4")
                numbers = np.frombuffer(x["c"], "<i8")
                n, need = numbers[: len(ids)], numbers[len(ids) :]
                wide = sketch_bits(n) // 8
                stop = np.cumsum(wide)
                own = idx == np.arange(len(idx))
                bits = [x["f"][e - w : e] if o else None for e, w, o in zip(stop.tolist(), wide.tolist(), own.tolist())]
                yield row(0, len(ids), flush=x["flush"], idx=idx, node=_sixteen(x["b"]), doc_id=pa.array(ids, pa.int64(), mask=ids == -(1 << 63)), n=n, need=need[0::2], further=need[1::2], digest=_sixteen(x["e"]), sketch=pa.array(bits, pa.binary()))
            elif x["kind"] == 1:
                values, who = np.frombuffer(x["a"], "<u8"), np.frombuffer(x["b"], "<i4")
                # named as below: by the lower bits, and by the part that the upper ones choose
                yield row(1, len(who), flush=x["flush"], idx=who, key=(values & _LOW48).astype(np.int64), part=None, n=(values >> np.uint64(32)).astype(np.int64))
            else:
                if x["part"] != part and got:
                    yield from joined(part, got)
                    got = []
                part = x["part"]
                low = np.zeros((len(x["a"]) // 6, 8), np.uint8)
                low[:, :6] = np.frombuffer(x["a"], np.uint8).reshape(-1, 6)
                who = np.frombuffer(x["b"], "<u2" if len(x["b"]) == 2 * len(low) else "<i4").astype(np.int32)
                got.append((low.view("<u8").ravel(), who, x["flush"]))
    if got:
        yield from joined(part, got)


def beside(pairs: DataFrame, payload: DataFrame, parts: int) -> DataFrame:
    """a, salt, b and the payload of b for each pair (a, b), with a row of the payload of a (b is null) before them.

    payload: nid and other columns. The rows of one a stand together, in portions of at most about PORTION rows.
    """
    extra = [c for c in payload.columns if c != "nid"]
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / PORTION).alias("portions"))
    many = pairs.join(portions.where("portions > 1"), "a", "left")  # few rows: sets that more than PORTION others meet
    dealt = many.select("a", F.coalesce(F.pmod(F.xxhash64("b"), "portions"), F.lit(0)).cast("int").alias("salt"), "b")
    middles = portions.select("a", F.explode(F.sequence(F.lit(0), (F.col("portions") - 1).cast("int"))).alias("salt"))
    with_b = dealt.join(payload.withColumnRenamed("nid", "b"), "b").select("a", "salt", "b", *extra)
    with_a = middles.join(payload.withColumnRenamed("nid", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), *extra)
    return with_a.unionByName(with_b).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())


def _near(p: int, q: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose sizes and sketches allow a link."""
        size = bits = 0
        sketch = 0
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for a, b, n, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "n", "sketch"))):
                value, wide = int.from_bytes(data, "little"), 8 * len(data)
                if b is None:
                    size, sketch, bits = n, value, wide
                elif q * min(n, size) >= p * max(n, size) and (q + p) * apart(sketch, bits, value, wide) <= (q - p) * (n + size):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return near


def shingle_set(text: bytes, size: int) -> set:
    """The shingles themselves."""
    w = text.lower().split()
    return set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()


def _folded(p: int, q: int):
    bands = Bands(p, q)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each sketch as longs, folded to the width that all sets of its band have, for its own band and the next."""
        for batch in batches:
            nid, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("nid", "n"))
            out = []
            for k, data in enumerate(batch.column(batch.schema.get_field_index("sketch")).to_pylist()):
                own = int(np.searchsorted(bands.edge, n[k], "right")) - 1
                for lane in (0, 1):
                    bits = min(SHORT, int(sketch_bits(np.array([p * bands.edge[own + lane] // q]))[0]), 8 * len(data))
                    parts = np.frombuffer(data, "<u8").reshape(-1, bits // 64)
                    out.append((nid[k], lane, int(n[k]), np.bitwise_xor.reduce(parts, axis=0).view(np.int64)))
            ids, lanes, sizes, arrays = zip(*out) if out else ((), (), (), ())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lanes, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["nid", "lane", "n", "short"])

    return folded


def _linked(size: int, p: int, q: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose texts are as similar as asked for."""
        middle: set = set()
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for a, b, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "text"))):
                shown = shingle_set(text.encode(), size)
                if b is None:
                    middle = shown
                else:
                    common = len(middle & shown)
                    if q * common >= p * (len(middle) + len(shown) - common):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return linked


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, label): the least node that links reach, for every node with a link.

    Labels spread along links and then follow their own labels, so the rounds grow with the logarithm of a path.
    """
    both = ws.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = ws.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("offer"))
        nearer = labels.join(offered, labels["node"] == offered["a"]).select("node", F.least("label", "offer").alias("to"), F.col("label").alias("was"))
        ahead = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        moved = ws.save(nearer.join(ahead, "to", "left").select("node", F.least("to", F.coalesce("next", "to")).alias("label"), "was"), f"{name}-{step}")
        labels = moved.select("node", "label")
        if not moved.where("label <> was").limit(1).count():
            return labels


def link_rows(ws: Workspace, docs: DataFrame, *, size: int, p: int, q: int, nameless: bool) -> DataFrame:
    """doc_id, digest, n, label, component_id of each row of (doc_id, digest, text).

    The rows of a label are those that links of a similarity of at least p/q connect; null for rows that take no part.
    nameless: rows whose doc_id is null take part.
    """
    spark = docs.sparkSession
    weight = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-weight // JOINED))
    packed = docs.select("doc_id", "digest", "text").mapInArrow(lean(_scan(size, p, q, parts)), PACKED)
    found = ws.save(packed.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(lean(_gather), FOUND), "found")
    rows = found.where("kind = 0").select("doc_id", "digest", "node", "n", "flush", "idx", "need", "further", "sketch")
    taking = rows.where(F.col("n") > 0) if nameless else rows.where("n > 0 and doc_id is not null")
    first = F.min(F.struct("digest", "doc_id"))
    nodes = taking.groupBy("node").agg(F.min("doc_id").alias("rep"), first.alias("first")).select("node", "rep", "first.digest", F.col("first.doc_id").alias("first_id"))
    nodes = ws.save(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")

    # the part of a value, where only its upper half is at hand; it names the value together with the lower bits
    part = F.coalesce(F.col("part"), F.shiftrightunsigned(F.col("n") * parts, 32).cast("int"))
    named = found.where("kind = 1").select("flush", F.floor(F.col("idx") / 2).cast("int").alias("idx"), (F.col("idx") % 2).alias("lane"), "key", part.alias("part"))
    known = rows.join(nodes.select("node", "nid"), "node").select("flush", "idx", "nid", "need", "further").distinct()
    need = F.when(F.col("lane") == 0, F.col("need")).otherwise(F.col("further"))
    named = named.join(known, ["flush", "idx"]).select("part", "key", "nid", "lane", need.alias("need"))
    entries = ws.save(named.repartition(parts, "part", "key").distinct(), "entries")
    # a linked set agrees on so many blocks: what agrees on fewer goes
    sizes = entries.groupBy("part", "key").agg(F.count("*").alias("size")).where("size > 1")
    mine = Window.partitionBy("nid", "lane")
    counted = entries.join(sizes, ["part", "key"]).withColumn("blocks", F.count("*").over(mine)).where("blocks >= need")
    # and of more only the rarest are kept: two sets that agree on need blocks meet in those
    placed = counted.withColumn("place", F.row_number().over(mine.orderBy("size", "part", "key")))
    kept = ws.save(placed.where(F.col("place") <= F.col("blocks") - F.greatest("need", F.lit(1)) + 1).select("part", "key", "nid", "lane"), "kept")
    several = kept.groupBy("part", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = ws.save(kept.join(several, ["part", "key"]), "members")

    wanted = ws.save(members.select("nid").distinct().join(nodes, "nid"), "wanted")
    light = rows.where("sketch is not null").select("node", "n", "sketch").join(wanted.select("node", "nid"), "node")
    light = ws.save(light.groupBy("nid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    same = docs["doc_id"].eqNullSafe(wanted["first_id"]) & (docs["digest"] == wanted["digest"])
    texts = ws.save(docs.join(wanted.select("nid", "digest", "first_id").hint("merge"), same).groupBy("nid").agg(F.first("text").alias("text")), "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = ws.save(pairs, f"{name}-pairs")
        near = ws.save(beside(pairs, light, parts).mapInArrow(lean(_near(p, q)), "a long, b long"), f"{name}-near")
        return ws.save(beside(near, texts, parts).mapInArrow(lean(_linked(size, p, q)), "a long, b long"), name)

    # the set of a block value that shares the most block values with others stands in the middle of them
    popular = members.groupBy("nid").agg(F.sum("size").alias("popular"))
    middle = members.join(popular, "nid").groupBy("part", "key").agg(F.max(F.struct("popular", "nid")).getField("nid").alias("a"))
    stars = members.join(middle, ["part", "key"]).where("nid <> a").select("a", F.col("nid").alias("b")).distinct()
    links = verified(stars, "stars")
    labels = components(ws, links, "first")

    labelled = members.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("part", "key", "nid", "lane", F.coalesce("label", "nid").alias("label"))
    mixed = labelled.groupBy("part", "key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("part", "key")
    short = light.mapInArrow(lean(_folded(p, q)), "nid long, lane long, n long, short array<long>")
    open_ = ws.save(labelled.join(mixed, ["part", "key"]).join(short, ["nid", "lane"]), "open")
    a, b = (open_.select("part", "key", *[F.col(c).alias(f"{c}_{s}") for c in ("nid", "label", "n", "short")]) for s in "ab")
    differ = F.aggregate(F.zip_with("short_a", "short_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    may = (q * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b")) & ((q + p) * differ <= (q - p) * (F.col("n_a") + F.col("n_b")))
    pairs = a.join(b, (a["part"] == b["part"]) & (a["key"] == b["key"]) & (F.col("label_a") < F.col("label_b")) & may)
    pairs = pairs.select(F.col("nid_a").alias("a"), F.col("nid_b").alias("b")).distinct()
    more = verified(pairs, "more")
    if not more.isEmpty():
        labels = components(ws, links.union(more), "last")

    labels = nodes.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("node", "rep", F.coalesce("label", "nid").alias("label"))
    labels = ws.save(labels, "labels")
    least = labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    classes = ws.save(labels.join(least, "label").select("node", "label", "component_id"), "classes")
    mine = rows if nameless else rows.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node")))
    return ws.keep(mine.join(classes, "node", "left").select("doc_id", "digest", "n", "label", "component_id"))


def digest_of(text):
    """128 bits of a text, as binary."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def link_sets(docs: DataFrame, *, size: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links of a similarity of at least p/q reach."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), "text")
    with Workspace(docs.sparkSession, "jaccard") as ws:
        rows = link_rows(ws, texts, size=size, p=p, q=q, nameless=False)
        own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, *, size: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """One row of each group that links of a similarity of at least p/q connect, with all columns.

    Of a group the row of the least doc_id stays, of the same doc_id that of the least digest, of rows alike in both any
    one; a null doc_id comes after all others. Rows without words are in no group and stay, however many they are.
    """
    key = [F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest")]
    with Workspace(docs.sparkSession, "jaccard") as ws:
        rows = link_rows(ws, docs.select(*key, "text"), size=size, p=p, q=q, nameless=True).where("label is not null")
        order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
        groups = rows.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1")
        firsts = groups.select("label", "first.doc_id", "first.digest")
        lost = rows.select("label", F.col("doc_id").alias("id"), F.col("digest").alias("d")).join(firsts, "label")
        stays = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("d") == F.col("digest"))
        gone = ws.keep(lost.where(~stays).select("id", "d").distinct(), "gone")
        twice = ws.keep(lost.where(stays).groupBy("id", "d").count().where("count > 1").select("id", "d"), "twice")
        keyed = docs.select(F.struct(*docs.columns).alias("row"), key[0].alias("id_"), key[1].alias("d_"))

        def at(df: DataFrame):
            return keyed["id_"].eqNullSafe(df["id"]) & (keyed["d_"] == df["d"])

        keyed = keyed.join(gone.hint("merge"), at(gone), "left_anti")
        if twice.isEmpty():
            return keyed.select("row.*")
        once = keyed.join(twice.hint("merge"), at(twice), "left_anti").select("row.*")
        one = keyed.join(twice.hint("merge"), at(twice), "left_semi").groupBy("id_", "d_").agg(F.first("row").alias("row")).select("row.*")
        return once.unionByName(one)
