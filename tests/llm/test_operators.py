"""Each operator against its plain version, on rows with nulls, empty and very long texts, ties, repeats and clashing columns."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import ALNUM, crc_of_ids, jaccard_components, leaks, lower, sha
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "node", "key", "part", "n", "lane", "score", "ids", "x", "y", "k", "class", "salt", "batch", "block", "d", "hits", "items", "label", "flush", "idx", "low", "norm", "gated", "base"]


def clashing(df):
    """With columns of the names that operators use inside."""
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["", None, " \n\t ", "one", "Two words", "É è ü — 漢字 😀", "the MIT  License, and the Apache-License of mit license", "General\nPublic License"]
    base = words(rng, 150)
    out += [" ".join(base)] * 3
    for edits in (1, 1, 2, 3, 4, 6, 9):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    for _ in range(40):
        out.append(" ".join(words(rng, rng.randrange(1, 90))))
    long = words(rng, 30_000, 5000)
    out += [" ".join(long), " ".join(long[:-50] + ["x"] * 50), "of " * 9000, "a" * 200_000]
    for n in (2, 3, 4, 11, 12):
        short = words(rng, n)
        out += [" ".join(short), " ".join(short), " ".join([*short[:-1], "other"])]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return clashing(spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], SCHEMA).repartition(3)).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


def ids_of(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, end]


# -- tokens


def thue_morse(a, b, n=1024):
    """Two words of n letters that every power series modulo 2**64 takes for the same."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize(("name", "end"), [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 2)])
def test_remembered_parts_encode_like_the_library(name, end):
    from linkloom.llm.tokens import Encoder

    rng = random.Random(2)
    parts = ["'s", "'ll", "'", " ", "  ", "\n", "é", "É", "Σ", "İ", "12", "²", "漢", "😀", "ſ", "\x00", "\x85", "a", "The", "!", "<|endoftext|>", "́", "ა", "ẞ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    e = Encoder(public_tokenizers.path(name), end)
    ids, first = e.encode(texts)
    assert all(np.array_equal(ids[first[k] : first[k + 1]], e.whole(t)) for k, t in enumerate(texts))


@pytest.mark.parametrize(("name", "end"), [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 2)])
def test_words_that_power_series_confuse_keep_their_ids(name, end):
    from linkloom.llm.tokens import Encoder

    one, other = thue_morse("a", "b")
    e = Encoder(public_tokenizers.path(name), end)
    for texts in ([one, other], [other], [f"x {one} {other} {one}", other, one]):
        ids, first = e.encode(texts)
        assert all(np.array_equal(ids[first[k] : first[k + 1]], e.whole(t)) for k, t in enumerate(texts))


def test_forgetting_changes_nothing(monkeypatch):
    from linkloom.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY", 50)
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 0)
    texts = [f"word{k} other{k * 7} 's" for k in range(300)]
    for t in texts:
        assert np.array_equal(e.encode([t])[0], e.whole(t))


def test_token_output(docs, texts, nothing):
    from linkloom.llm.token_output import ShardReader, read_token_shards, write_token_shards

    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_token_shards(docs, path, end_id=0)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_token_shards(manifest).collect()}
    encode, at, every = ids_of("byte_bpe_50k.json", 0), 0, []
    for d, t in texts:
        ids = encode(t)
        assert got[d] == (at, len(ids), crc_of_ids(ids))
        at += len(ids)
        every += ids
    flat = []
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        reader = ShardReader(r["path"])
        n = -(-r["n_ids"] // 2048)
        own = [x for k in range(n) for x, real in zip(*(a.tolist() for a in reader.sequence(k))) if real]
        assert len(own) == r["n_ids"]
        flat += own
    assert flat == every
    assert read_token_shards(write_token_shards(nothing, path)).count() == 0


def test_packing(docs, texts, nothing):
    from linkloom.llm.packing import pack, sequences

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, layout = pack(docs, path, end_id=2)
    rows = [r.asDict() for r in pieces.join(layout, ["row", "start"]).collect()]
    encode, used = ids_of("word_bpe_49k.json", 2), {}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in texts:
        ids, at = encode(t), 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
    assert sum(r["length"] for r in rows) > 0.9 * 4096 * (len(used) - 1)
    built = {r["sequence_id"]: r for r in sequences(pieces, layout, pad_id=0).collect()}
    assert set(built) == set(used)
    for s, r in built.items():
        n = sum(k for _, k in used[s])
        assert r["length"] == n and len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 4096)
    p, l = pack(nothing, path, end_id=2)
    assert p.count() == l.count() == 0


def test_nnls_meets_its_conditions():
    from linkloom.llm.packing import nnls, plan

    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.random(8) * 10 - 2
        x = nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6
    h = rng.integers(0, 500, 64)
    used, often = plan(h)
    assert ((used @ often) <= h).all() and (used @ often).sum() > 0.8 * h.sum()


# -- pairs and leaks


@pytest.mark.parametrize(("size", "p", "q"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(docs, texts, size, p, q):
    from linkloom.llm.jaccard_join import link_sets

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_sets(docs, size=size, p=p, q=q).collect()}
    assert got == jaccard_components(texts, size, p, q)


def test_jaccard_finds_links_at_the_edge(spark):
    """Pairs right at and right below the threshold, of many sizes; a chain of links; a large group without a middle."""
    from linkloom.llm.jaccard_join import link_sets

    rng, rows = random.Random(9), []
    for n in [*range(10, 60), 99, 100, 181, 182, 400, 777]:
        base = [f"b{n}_{k}" for k in range(n)]
        for extra in (n // 9, n // 9 + 1, n // 10, n // 20):
            rows.append(" ".join(base + [f"e{n}_{extra}_{k}" for k in range(extra)]))
        rows.append(" ".join(base))
    step = [f"c{k}" for k in range(400)]
    for k in range(12):
        rows.append(" ".join(step[8 * k : 8 * k + 200]))
    crowd = [f"g{k}" for k in range(150)]
    for _ in range(120):
        copy = list(crowd)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(150)] = f"h{rng.randrange(10**7)}"
        rows.append(" ".join(copy))
    data = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_sets(spark.createDataFrame(data, "doc_id long, text string"), size=3, p=90, q=100).collect()}
    assert got == jaccard_components(data, 3, 90, 100)


def test_jaccard_links_small_equal_sets_of_different_words(spark):
    """Sets too small to differ from a linked one: other words in another order or number, the same shingles."""
    from linkloom.llm.jaccard_join import link_sets

    rng = random.Random(17)
    data = [(1, "a b a b a"), (2, "b a b a b a"), (3, "c c c"), (4, "c c c c c c"), (5, "x y z x y z x"), (6, "y z x y z x y z"), (7, "d d"), (8, "c c c d")]
    data += [(100 + k, " ".join(rng.choice("pqr") for _ in range(rng.randrange(1, 14)))) for k in range(400)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    for size, p in ((3, 90), (5, 80), (2, 50)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_sets(frame, size=size, p=p, q=100).collect()}
        assert got == jaccard_components(data, size, p, 100), (size, p)


def test_jaccard_odd_rows(spark, nothing):
    from linkloom.llm.jaccard_join import link_sets

    assert link_sets(nothing).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (4, None), (5, "")]
    got = sorted(map(tuple, link_sets(spark.createDataFrame(rows, "doc_id long, text string"), size=3, p=90).collect()), key=str)
    assert got == sorted([(None, 4, None), (3, 4, 3), (3, 4, 3), (9, 4, 3), (4, 0, 4), (5, 0, 5)], key=str)


def test_jaccard_of_words_that_power_series_confuse(spark):
    from linkloom.llm.jaccard_join import link_sets

    one, other = thue_morse("a", "b")
    data = [(1, one), (2, other), (3, f"{one} x y z"), (4, f"{other} x y z"), (5, " ".join([one, other] * 20)), (6, " ".join([one] * 40))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_sets(spark.createDataFrame(data, "doc_id long, text string"), size=3, p=90).collect()}
    assert got == jaccard_components(data, 3, 90, 100)


def test_a_link_rests_on_words_alone():
    """Whatever pairs are proposed, none that differs is linked."""
    import linkloom.llm.jaccard_join as module
    import pyarrow as pa

    data = [(k, " ".join(words(random.Random(k), 30))) for k in range(40)] + [(50, "a b c d"), (51, "A  b C d")]
    seen = module._linked(3, 90, 100)
    rows = [(0, None, data[0][1]), *[(0, k, t) for k, t in data[1:]], (60, None, "a b c d"), (60, 51, "A  b C d")]
    batch = pa.table({"a": [r[0] for r in rows], "b": pa.array([r[1] for r in rows], pa.int64()), "text": [r[2] for r in rows]}).to_batches()
    assert [r for b in seen(iter(batch)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())] == [(60, 51)]


def test_one_row_of_each_group_stays(spark, monkeypatch):
    from linkloom.llm import jaccard_join

    rng = random.Random(21)
    base = words(rng, 200)
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 60, 10)]
    lone = [" ".join(words(rng, 50)) for _ in range(6)]
    rows = [(1, lone[0]), (5, lone[0]), (5, lone[1]), (7, lone[2]), (7, lone[3]), (None, lone[4]), (None, lone[4]), (None, lone[5]), (8, None), (8, ""), (9, lone[5]), (9, lone[5])]
    rows += [(100 + k, t) for k, t in enumerate(near)] + [(None, near[0]), (3, near[-1] + " end")]
    for portion in (20_000, 2):
        monkeypatch.setattr(jaccard_join, "PORTION", portion)
        kept = jaccard_join.keep_one(clashing(spark.createDataFrame(rows, "doc_id long, text string")))
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        assert got == sorted([(1, lone[0]), (5, lone[1]), (7, lone[2]), (7, lone[3]), (None, lone[4]), (8, None), (8, ""), (9, lone[5]), (3, near[-1] + " end")], key=str)
    assert {r["row"] for r in kept.collect()} == {"clash"}
    assert jaccard_join.keep_one(spark.createDataFrame([], "doc_id long, text string, row string")).count() == 0


def test_sketch_distance_never_exceeds_the_difference():
    from linkloom.llm.jaccard_join import Bands, block_values

    rng = np.random.default_rng(1)
    bands = Bands(90, 100)
    for n in (12, 40, 300):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 25 :], rng.integers(0, 1 << 63, n // 25, dtype=np.uint64)]))
        lanes, values, _ = block_values(np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
        mine, theirs = set(values[lanes == 0].tolist()), set(values[lanes == 2].tolist())
        assert mine & theirs


def test_decontamination(spark, docs, texts, nothing):
    from linkloom.llm.decontaminate import find_leaks, remove_leaks

    rng = random.Random(4)
    t = dict(texts)
    items = [(1, t[8][40:200]), (2, None), (3, ""), (4, "One"), (5, "Other"), (6, " ".join(words(rng, 25))), (7, "of of of"), (7, "w1 w2"), (None, "two WORDS"), (8, t[8][300:700])]
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    small = [(d, x) for d, x in texts if len(x or "") < 60_000]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(set(r["items"] or []))) for r in find_leaks(docs, bench).collect()}
    told = [("null" if i is None else i, x) for i, x in items]
    for d, x in small:
        n, hit, found = leaks(x, told)
        assert got[d] == (n, hit, sorted(set(found))), d
    assert find_leaks(nothing, bench).count() == 0
    assert find_leaks(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    left = remove_leaks(docs, bench.where("item_id = 8"))
    assert find_leaks(left, bench.where("item_id = 8")).where("n_hit > 0").count() == 0
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert all(kept[d] == x for d, x in texts if not got[d][1])


def test_leaks_are_found_whatever_words_share_a_hash(monkeypatch):
    from linkloom.llm import decontaminate, textbytes

    monkeypatch.setattr(textbytes, "word_hashes", lambda data, start, end: textbytes.mix((end - start).astype(np.uint64)))
    rng = random.Random(4)
    items = [(str(k), words(rng, n, 5000)) for k, n in enumerate((25, 3, 12, 1))]
    automaton = decontaminate.Automaton(items, 10)
    automaton.tables()
    rows = [" ".join(words(rng, 20, 5000) + w + words(rng, 20, 5000)) for _, w in items] + [" ".join(words(rng, 9, 5000)) for _ in range(10)]
    raw = [r.encode() for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = textbytes.Words(np.frombuffer(b"".join(raw), np.uint8), offsets, textbytes.ALNUM)
    suspects = automaton.suspects(automaton.numbers(found.hash), found.document()).tolist()
    told = [(k, " ".join(w)) for k, w in items]
    assert {k for k, r in enumerate(rows) if leaks(r, told)[1]} <= set(suspects)


def test_automaton_in_blocks_equals_one(spark, docs, monkeypatch):
    from linkloom.llm import decontaminate

    rng = random.Random(8)
    bench = spark.createDataFrame([(k, " ".join(words(rng, 12, 40))) for k in range(60)] + [(99, "w1"), (98, "w2 w3")], "item_id long, text string")
    pick = lambda: sorted((r["doc_id"], r["n_hit"], ",".join(sorted(set(r["items"] or [])))) for r in decontaminate.find_leaks(docs, bench).collect())
    whole = pick()
    monkeypatch.setattr(decontaminate, "BLOCK", 200)
    assert pick() == whole


def test_leaks_go_alike_in_any_blocks(spark, monkeypatch):
    from linkloom.llm import decontaminate

    a, b, rest = ([f"{x}{k}" for k in range(40)] for x in "abz")
    inner = a[:5] + b[:29] + a[5:12]
    texts = [" ".join(rest[:31] + a + b[:29]), " ".join(rest[:35] + inner), " ".join(rest), None, "", " ".join(a), "x " + " ".join(a[:10]) + " y z" * 9]
    docs = clashing(spark.createDataFrame([(k % 5, t, "en", "s", -1) for k, t in enumerate(texts)], SCHEMA))
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, None)], "item_id long, text string").coalesce(1)
    pick = lambda: sorted(map(str, decontaminate.remove_leaks(docs, bench).collect()))
    want = pick()
    for block in (1, 150, 200):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert pick() == want
        assert decontaminate.remove_leaks(docs, bench).columns == docs.columns
    left = [r["text"] for r in decontaminate.remove_leaks(docs, bench.orderBy(F.desc("item_id"))).collect()]
    assert not any(leaks(t, [(1, " ".join(a)), (2, " ".join(b))])[1] for t in left) and len(left) == 4
    assert decontaminate.remove_leaks(docs, bench.limit(0)).count() == len(texts)


# -- chats, search, licenses, pages


def test_chats(spark):
    from linkloom.llm.chat_format import format_chats, format_turns, parse, read_chats

    rng = random.Random(1)
    parts = ["\\", "### ", "</turn>", "\n", "a", "### user: ", "é😀", "%", ":", " ", "#", "</tur", "n>"]
    for _ in range(3000):
        turns = [("".join(rng.choice(parts) for _ in range(rng.randrange(4))), "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(5))]
        assert parse(format_turns(turns)[0]) == turns
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "\\### x </turn>"), (1, 1, "assistant", None), (2, 0, None, "x"), (None, 0, "user", "n"), (3, None, "assistant", "😀" * 70_000), (3, 0, "assistant", "</turn>"), (3, 0, "assistant", "</turn>")]
    chats = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in read_chats(format_chats(chats)).collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    assert format_chats(chats.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [8192, 7])
def test_topk(spark, monkeypatch, blocks):
    from linkloom.llm import topk

    monkeypatch.setattr(topk, "CANDIDATES", blocks)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(k, [round(float(x), 2) for x in rng.normal(size=6) * (1 + k % 3)]) for k in range(60)] + [(k, [0.5] * 6) for k in range(60, 70)]
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (None, [0.1] * 6), (110, [9.0, 9.0])]
    df = clashing(spark.createDataFrame(rows + odd, "id long, v array<float>"))
    got = sorted(map(tuple, topk.search(df, F.col("id") % 10 == 0, k=5).collect()))
    v = {k: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for k, x in rows}
    want = []
    for q in v:
        if q % 10 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_licenses(spark, docs, texts, nothing):
    from linkloom.llm.licenses import GATE, scan

    extra = [(1000, "Licensed under the Apache License, Version 2.0 (the \"License\")"), (1001, "SPDX-License-Identifier: GPL-3.0-or-later"), (1002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (1003, "permit license; mit licenses"), (1004, "MIT License MIT License GNU General Public License v3"), (1005, "All rights reserved. " * 300)]
    df = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in extra], SCHEMA), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in scan(df).collect()}
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for d, t in [*texts, *extra]:
        w, starts, labels = ALNUM.findall(lower(t)), [], set()
        for p, label in phrases.items():
            here = [i for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p] if len(w) < 40_000 else []
            starts += here
            labels |= {label} if here else set()
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))), d
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert (got[1000]["labels"], got[1001]["labels"], got[1002]["labels"], got[1003]["labels"], got[1005]["labels"]) == ("apache", "gpl", "mit", "", "proprietary")
    assert got[1002]["score"] == 1.0 and got[1004]["labels"] == "gpl,mit"
    assert scan(nothing).count() == 0
    from linkloom.llm.licenses import rules

    assert len(rules()) > 200 and all(any(g in r.pattern.replace("licen[sc]e", "license") for g in GATE) for r in rules())


def made_by(rng, parts):
    """A random match of a parsed pattern."""
    out = []
    for op, x in parts:
        match str(op):
            case "LITERAL":
                out.append(chr(x))
            case "ANY":
                out.append("x")
            case "IN":
                kind, y = rng.choice(x)
                out.append(chr(y if str(kind) == "LITERAL" else rng.randint(*y)))
            case "BRANCH":
                out.append(made_by(rng, rng.choice(x[1])))
            case "SUBPATTERN":
                out.append(made_by(rng, x[-1]))
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += [made_by(rng, x[2]) for _ in range(rng.randint(x[0], min(x[1], x[0] + 1)))]
            case _:
                raise ValueError(op)
    return "".join(out)


def test_matches_hold_their_keyword(spark):
    from re import _parser

    from linkloom.llm.licenses import GATE, rules, scan

    rng = random.Random(2)
    for rule in rules():
        parsed = _parser.parse(rule.pattern)
        for match in {made_by(rng, parsed) for _ in range(200)}:
            assert rule.keyword in match and any(g in match for g in GATE), (rule, match)
    told = {"licensed under the GNU Library General Public License": "gpl,lgpl", "under the terms of the GNU Library General Public License as published by": "gpl,lgpl", "released under the PSF license": "python", "licensed under the Open Software Licence 3.0": "osl", "licensed under the Elastic Licence 2.0": "elastic", "released under the Expat license": "mit", "see the X11 License": "mit", "SPDX-License-Identifier: PSF-2.0": "python", "http://www.eclipse.org/org/documents/epl-v10, released": "epl"}
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(told)], SCHEMA)
    assert [r["labels"] for r in scan(docs).orderBy("doc_id").collect()] == list(told.values())


def test_pages(spark):
    from linkloom.llm.html_text import extract, text_of

    assert text_of("<p>One<p>Two <b>b</b>  c<ul><li>a<li>b<ul><li>c</ul></ul>") == "One\n\nTwo b c\n\n- a\n- b\n  - c"
    assert text_of("<table><tr><th>Name<th>V<tr><td>abc<td>1</table>") == "Name | V\nabc  | 1"
    assert text_of("<div>a<div hidden>no</div><span style='display: none'>no</span>b</div>") == "ab"
    assert text_of("<script>var t='</p>'</script>x<style>p{}</style><!-- no --> y &amp; z") == "x y & z"
    assert text_of("<pre>\n a\n   b</pre>c<br>d") == " a\n   b\n\nc\nd"
    assert text_of("<ol start=3><li>x<li>y</ol>") == "3. x\n4. y"
    assert text_of("") == "" and text_of(None) is None and text_of("<") == "<" and text_of("<div" * 50) is not None
    assert text_of("<b>" * 50_000 + "deep") == "deep"
    assert text_of("<table><tr><td>" * 300 + "x").strip() == "x"
    rows = [(1, "<p>a"), (1, "<p>a"), (2, None), (3, ""), (None, "z")]
    got = extract(clashing(spark.createDataFrame(rows, "page_id long, html string"))).collect()
    assert sorted((str(r["page_id"]), str(r["text"])) for r in got) == [("1", "a"), ("1", "a"), ("2", "None"), ("3", ""), ("None", "z")]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_pages_without_head_and_body_tags():
    from linkloom.llm.html_text import text_of

    assert text_of("<head><title>T</title><h1>Hello</h1><p>text") == "Hello\n\ntext"
    assert text_of("<html><head>\n<meta charset=x><style>p{}</style>\n<script>s</script> plain <b>bold</b>") == "plain bold"
    assert text_of("<head><noscript>no</noscript><template><p>no</template><link rel=x><img alt=pic>") == "pic"
    assert text_of("<head>&amp;<p>a</head><p>b") == "&\n\na\n\nb"
    assert text_of("<head><title>T</title></head><body>x") == text_of("<title>T</title>x") == "x"
    assert text_of("<div><head><title>T</title>a<head><title>U</title>b</div>c") == "ab\nc"


def test_pages_lose_no_visible_text():
    from linkloom.llm.html_text import text_of

    assert text_of("<table><form><tr><td>x</td></tr></form></table>") == "x"
    assert text_of("<table><div>x</div></table>") == text_of("<table><tr><form><td>x</table>") == text_of("<table><colgroup><col><tr><td>x</table>") == "x"
    assert text_of("a<table>b<tr>c<td>d<td>e</tr><p>f</p><x-rows hidden><tr><td>g</table>h") == "abc\n\nf\n\nd | e\ng\n\nh"
    assert text_of("<table hidden><tr><td>no</td></tr><div>x</div></table>") == "x"
    assert text_of("<table><tr><td>a</td></tr><table><tr><td>b</table>") == "a\n\nb"
    assert text_of("<table><caption>t<tr><td>a</table>") == "t\na"
    assert text_of("<table><tr><td>a<table>b<tr><td>c</table>d</table>") == "ab\n\nc\n\nd"
    assert text_of("<table><template><tr><td>no</template><tr><td>x</table>") == "x"
    assert text_of("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics><mphantom>no</mphantom></math> holds") == "so x=2 holds"
    rng = random.Random(3)
    tags = [f"<{c}{t}>" for t in ("table", "tr", "td", "tbody", "caption", "colgroup", "div", "form", "p", "b", "ul", "li", "math", "mi", "head", "body", "x-y") for c in ("", "", "/")] + ["<col>", "<br>", "<!-- -->"]
    for _ in range(3000):
        told = [f"t{k}x" for k in range(rng.randrange(1, 9))]
        page = "".join("".join(rng.choice(tags) for _ in range(rng.randrange(5))) + x for x in told)
        got = text_of(page)
        assert all(x in got for x in told), page


# -- classifiers


def test_language(spark):
    from linkloom.llm.langid import identify, keep_known
    from linkloom.llm.queries import crc_mod

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 34 !?", "en", "s", 0), (None, "the of and", "en", "s", 0), (10**6 + 2, "é ü", None, "s", 0), (10**6 + 3, "the and of " * 40_000, "en", "s", 0)], SCHEMA)
    df = clashing(d.unionByName(odd))
    got = identify(df, teaches=crc_mod("doc_id", 4) != 2).join(d, "doc_id").where(crc_mod("doc_id", 4) == 2)
    assert got.where("lang = lang_pred").count() > 0.97 * got.count()
    rows = {r["doc_id"]: r for r in identify(df, teaches=crc_mod("doc_id", 4) != 2).where("doc_id >= 1000000").collect()}
    assert rows[10**6]["lang_pred"] == rows[10**6 + 1]["lang_pred"] == "und" and rows[10**6]["score"] == 0 and rows[10**6 + 3]["lang_pred"] == "en"
    assert keep_known(df, teaches=crc_mod("doc_id", 4) != 2, least=0.3).columns == df.columns
    assert identify(df.limit(0), teaches=F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in identify(df, teaches=F.lit(False)).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    from linkloom.llm.langid import LONGEST, identify

    rng = random.Random(9)
    letters = [chr(0x4E00 + k) for k in range(900)]
    rows = []
    for k in range(72):
        own = letters[12 * k : 12 * k + 12]
        word = lambda own=own: "".join(rng.choice(own) for _ in range(5))
        rows += [(100 * k + i, " ".join(word() for _ in range(30)), f"l{k}", "s", 0) for i in range(2 if k == 71 else 3)]
    long = [(9000 + i, "1 " * LONGEST + "ünï ßöl " * 6000, "long", "s", 0) for i in range(3)]
    docs = clashing(spark.createDataFrame([*rows, *long], SCHEMA))
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, teaches=F.lit(True)).collect()}
    assert got == {r[0]: r[2] for r in [*rows, *long]}


def test_quality(spark):
    from linkloom.llm.quality import isotonic, keep_good, score_quality
    from linkloom.llm.queries import crc_mod

    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "the of and", "en", "s", 0), (10**6 + 2, "x" * 300_000, None, "s", 0), (0, "again", "en", "s", 0)], SCHEMA)
    df = clashing(d.unionByName(odd))
    noisy = clashing(labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (10**7, 1, 0)], "doc_id long, quality int, toxic int")))
    got = score_quality(df, noisy, teaches=crc_mod("doc_id", 5) != 0)
    assert got.count() == df.count() and got.where("score between 0 and 1").count() == df.count()
    held = got.join(labels, "doc_id").where(crc_mod("doc_id", 5) == 0)
    assert held.where("predicted = quality").count() > 0.95 * held.count()
    assert keep_good(df, noisy, teaches=crc_mod("doc_id", 5) != 0).columns == df.columns
    assert {r["score"] for r in score_quality(df, labels.limit(0), teaches=F.lit(True)).collect()} == {0.5}
    assert score_quality(df.limit(0), labels, teaches=F.lit(True)).count() == 0
    x = np.random.default_rng(0).integers(0, 2, 50).astype(float)
    fitted = isotonic(np.arange(50), x, np.ones(50))
    assert (np.diff(fitted) >= -1e-12).all() and abs(fitted.sum() - x.sum()) < 1e-9


def test_pipeline(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        rows = out.collect()
        if name == "near_duplicates":
            want = {k for k, (_, c) in jaccard_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100).items() if c == k}
            assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in bench.collect()]
            assert all(not leaks(r["text"], items)[1] for r in rows if len(r["text"]) < 5000)
        docs = spark.createDataFrame(rows, docs.schema)
    packed = cp.STAGES[-1][1](spark, docs, d)
    encode = ids_of("word_bpe_49k.json", 2)
    total = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {r["doc_id"]: len(encode(r["text"])) for r in docs.collect()}


def test_held_out_folds_are_by_crc(spark):
    from linkloom.llm.queries import crc_mod

    got = spark.range(200).select("id", crc_mod("id", 5).alias("k")).collect()
    assert all(r["k"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
