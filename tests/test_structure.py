"""Operators on small graphs, names and texts, with the cases that a naive build gets wrong."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import scalars as S
from linkloom.operators import contracts, conventions, diagnostics, edits, find, graph, impact, journal, layout, liveness, metrics, mutations, naming, resolve, setops, similarity, tidy
from linkloom.sources import config, extract, tables

BINDINGS = "array<struct<name:string,alias:string,is_type:boolean>>"
REF = f"src string, dst string, specifier string, ref_type string, line int, bindings {BINDINGS}, seq bigint"


def refs(spark, edges, kind="import-named", names=("x",)):
    rows = [(e[0], e[1], f"./{e[1]}", e[2] if len(e) > 2 else kind, 1, [(n, None, False) for n in (e[3] if len(e) > 3 else names)], k) for k, e in enumerate(edges)]
    return spark.createDataFrame(rows, REF)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def nodes(spark, names, column="node"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is not None, x) for x in t))


def hubs(spark, rows):
    return spark.createDataFrame(rows, "barrel string, target string, entry_type string, name string, alias string, specifier string")


def values(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


# -- graph


def test_closure_has_least_depths_and_ends_on_cycles(spark):
    e = refs(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("d", "d")])
    assert pairs(graph.closure(e, nodes(spark, "a")), "node", "depth") == [("a", 0), ("b", 1), ("c", 1)]
    assert pairs(graph.closure(e, nodes(spark, "c"), reverse=True), "node", "depth") == [("a", 1), ("b", 1), ("c", 0)]
    assert pairs(graph.closure(e, nodes(spark, "z")), "node", "depth") == [("z", 0)]


def test_strong_components_match_brute_force(spark):
    rng = random.Random(3)
    for n, m in ((8, 10), (12, 22), (6, 3)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        names = sorted({x for e in edges for x in e})
        reach = {(a, b) for a, b in edges}
        for k, i, j in itertools.product(names, names, names):
            if (i, k) in reach and (k, j) in reach:
                reach.add((i, j))
        want = sorted((a, min([a, *(b for b in names if (a, b) in reach and (b, a) in reach)])) for a in names)
        assert pairs(graph.strong_components(refs(spark, edges)), "node", "component") == want


def test_cycles_and_their_shortest_path(spark):
    e = refs(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("d", "e"), ("e", "f"), ("f", "d"), ("s", "s")])
    assert pairs(graph.cycles(e), "component", "size", "self_loop") == [("a", 2, False), ("d", 3, False), ("s", 1, True)]
    assert pairs(graph.shortest_cycles(e), "component", "path") == [("a", ["a", "b", "a"]), ("d", ["d", "e", "f", "d"]), ("s", ["s", "s"])]
    assert graph.cycles(refs(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_references_pass_through_chains_of_barrels(spark):
    b = hubs(spark, [("b1", "t", "all", None, None, "t"), ("b2", "b1", "all", None, None, "b1")])
    r = refs(spark, [("c", "b2"), ("d", "t"), ("b1", "t", "export-all"), ("b2", "b1", "export-all")])
    got = graph.all_references(r, b, nodes(spark, "t"))
    assert pairs(got, "src", "dst") == [("b1", "t"), ("b2", "t"), ("c", "t"), ("d", "t")]
    assert pairs(graph.affected(r, b, nodes(spark, "t")), "node") == [("b1",), ("b2",), ("c",), ("d",), ("t",)]


def _crowd(spark):
    """A hub that passes on 60 files and is referred to by 50 of them and 40 others, in chains of hubs; some places refer to several files."""
    rng = random.Random(5)
    b = [("h", f"t{k}", "all", None, None, "x") for k in range(60)] + [("g", "h", "all", None, None, "x"), ("h", "g", "all", None, None, "x"), ("i", "t1", "all", None, None, "x")]
    r = [(f"t{k}", "h") for k in range(50)] + [(f"u{k}", rng.choice("hgi")) for k in range(40)] + [(f"v{k}", rng.choice(["t1", "t2", "h", "i", "u3", None])) for k in range(60) for _ in range(3)] + [("t55", "u7"), ("w", "v0")]
    rows = [(s, d, rng.choice(["s1", "s2", None]), "import-named", rng.choice([1, None]), [], k) for k, (s, d) in enumerate(r)]
    return hubs(spark, b), frame(spark, rows, REF), [x[:2] for x in b], rows


def test_references_to_a_crowd_are_not_compared_with_each_other(spark, monkeypatch):
    b, r, passes, rows = _crowd(spark)
    want = {}
    for t in [f"t{k}" for k in range(60)]:
        reach = {t}
        while more := {h for h, x in passes if x in reach} - reach:
            reach |= more
        for s, d, spec, _, line, _, seq in sorted(rows, key=lambda x: (x[1] != t, x[6])):
            if d in reach:
                want.setdefault((t, s, spec, line), (d if d != t else None, seq))
    compared, first = [], graph.first_by_key
    monkeypatch.setattr(graph, "first_by_key", lambda df, *a: compared.append(df) or first(df, *a))
    for portion in (1_000_000, 7):
        monkeypatch.setattr(graph, "PORTION", portion, raising=False)
        got = graph.all_references(r, b, nodes(spark, [f"t{k}" for k in range(60)]))
        found = got.collect()
        assert {(x["dst"], x["src"], x["specifier"], x["line"]): (x["through"], x["seq"]) for x in found} == want and len(found) == len(want)
        assert got.columns == [*r.columns, "target", "through"]
    assert all(df.count() < len(want) / 2 for df in compared)


def test_references_to_a_crowd_are_copied_less_than_they_come_out(spark, monkeypatch):
    b = hubs(spark, [("h", f"t{k}", "all", None, None, "x") for k in range(40)])
    r = refs(spark, [(f"u{k}", "h") for k in range(40)])
    dealt, frame_of = [], type(r)
    repartition = frame_of.repartition
    rows = lambda df: df.select(F.sum(F.size("_targets") if "_targets" in df.columns else F.lit(1))).first()[0] or 0
    monkeypatch.setattr(frame_of, "repartition", lambda self, *a: dealt.append(self) or repartition(self, *a))
    monkeypatch.setattr(graph, "PORTION", 16)
    got = pairs(graph.all_references(r, b, nodes(spark, [f"t{k}" for k in range(40)])), "src", "dst", "through")
    assert got == sorted((f"u{k}", f"t{n}", "h") for k in range(40) for n in range(40))
    assert dealt and sum(map(rows, dealt)) < 40 * 40 * 2 / 3


def test_affected_hands_no_reference_on_to_all_that_a_barrel_stands_for(spark, monkeypatch):
    b, r, passes, rows = _crowd(spark)
    depth, front = {"t1": 0}, {"t1"}
    while front:
        reach = set(front)
        while more := {h for h, x in passes if x in reach} - reach:
            reach |= more
        front = {s for s, d, *_ in rows if d in reach} - set(depth)
        depth |= {s: max(depth.values()) + 1 for s in front}
    saved, save = [], graph.Workspace.save
    monkeypatch.setattr(graph.Workspace, "save", lambda self, df, *a, **k: saved.append(df.count()) or save(self, df, *a, **k))
    got = graph.affected(r, b, nodes(spark, ["t1"]))
    assert dict(pairs(got, "node", "depth")) == depth and got.count() == len(depth)
    assert max(saved) <= len(rows)


def test_dead_chain_starts_at_the_nearest_dead_head(spark):
    imp = frame(spark, [("t", "m"), ("m", "h"), ("m", "g"), ("u", "v"), ("v", "u")], "file string, importer string")
    got = graph.dead_chains(imp, nodes(spark, ["t", "u", "z"]), nodes(spark, ["g", "h"]))
    assert pairs(got, "file", "chain") == [("t", ["g", "m", "t"]), ("u", ["u"]), ("z", ["z"])]


def test_public_names_follow_renames_but_default_never_passes_a_star(spark):
    b = hubs(spark, [("e", "m", "named", "x", "y", "m"), ("e", "s", "all", None, None, "s"), ("e", "n", "namespace", None, "ns", "n")])
    x = frame(spark, [("m", "x"), ("m", "hidden"), ("s", "p"), ("s", "default"), ("n", "q")], "file string, name string")
    got = set(pairs(graph.public_names(nodes(spark, "e"), b, x), "file", "name"))
    assert {("m", "x"), ("s", "p"), ("n", "q")} <= got and not {("m", "hidden"), ("s", "default")} & got


# -- metrics, liveness


def test_coupling_counts_distinct_ends_and_targets_outside(spark):
    r = refs(spark, [("a", "b"), ("a", "b"), ("a", "a"), ("c", "out")])
    files = nodes(spark, ["a", "b", "c", "lone"], "file")
    got = {x["node"]: tuple(x)[1:] for x in metrics.coupling(r, files).select("node", "fan_out", "fan_in", "instability").collect()}
    assert got == {"a": (2, 1, 0.67), "b": (0, 1, 0.0), "c": (1, 0, 1.0), "out": (0, 1, 0.0), "lone": (0, 0, 0.0)}
    assert metrics.over_thresholds(metrics.coupling(r), 2, 2).count() == 0  # strictly above


def test_barrels(spark):
    b = hubs(spark, [("b", "x", "all", None, None, ""), ("b", "x", "named", "n", None, ""), ("c", "b", "namespace", None, "ns", "")])
    r = refs(spark, [("u", "b"), ("u", "b")])
    got = {x["barrel"]: x for x in metrics.barrel_report(b, r).collect()}
    assert (got["b"]["total"], got["b"]["sources"], got["b"]["wildcard"], got["b"]["named"], got["b"]["consumers"]) == (2, 1, 1, 1, 2)
    assert pairs(metrics.chained_barrels(b), "barrel", "target") == [("c", "b")] and pairs(metrics.unused_barrels(metrics.barrel_report(b, r)), "barrel") == [("c",)]
    keys = frame(spark, [("x", "./x"), ("y*", "./*")], "path string, key string")
    assert pairs(metrics.shadowed_barrels(b, keys), "barrel", "key") == [("b", "./x")]


def test_a_default_import_uses_the_whole_module(spark):
    x = frame(spark, [("m", "a", "named"), ("m", "d", "default"), ("n", "a", "named"), ("n", "b", "named"), ("s", "a", "named")], "file string, name string, export_type string")
    r = refs(spark, [("u", "m", "import", ["default"]), ("u", "n", "import-named", ["a"]), ("s", "s", "import-named", ["a"])])
    got = {(f, n): u for f, n, u in pairs(liveness.split_exports(x, r), "file", "name", "used")}
    assert got == {("m", "a"): True, ("m", "d"): True, ("n", "a"): True, ("n", "b"): False, ("s", "a"): True}
    assert pairs(liveness.imported_names(r), "file", "whole") == [("m", True), ("n", False), ("s", False)]


def test_verdicts_orphans_and_transitive_death(spark):
    files = nodes(spark, ["main", "live", "wrap", "help", "conv", "solo"], "file")
    r = refs(spark, [("main", "live"), ("wrap", "help")])
    x = frame(spark, [(f, "x", "named", k) for k, f in enumerate(["live", "wrap", "help", "conv", "solo"])], "file string, name string, export_type string, line int")
    none = nodes(spark, [])
    got = liveness.verdicts(x, r, files, nodes(spark, ["main"]), public=x.where("file = 'solo'"), assumed=nodes(spark, ["conv"]))
    assert pairs(got, "file", "verdict") == [("conv", "assumed-used"), ("help", "transitively-dead"), ("live", "used"), ("solo", "public"), ("wrap", "unused")]
    live = graph.forward_reach(r, nodes(spark, ["main"]), files)
    dead = liveness.transitively_dead(got, r, files, live)
    assert pairs(dead, "file", "dead_importers", "chain") == [("help", ["wrap"], ["wrap", "help"])]
    b = hubs(spark, [])
    assert pairs(liveness.orphan_files(files, x, r, b, nodes(spark, ["conv"])), "file", "self_contained") == [("solo", True), ("wrap", False)]
    assert none.count() == 0


def test_mock_orphans_need_known_exports(spark):
    e = frame(spark, [("t", "m", "a", 1), ("t", "m", "gone", 2), ("t", "m", "__esModule", 3), ("t", "unknown", "z", 4)], "mock_file string, target string, key string, line int")
    x = frame(spark, [("m", "a", "named")], "file string, name string, export_type string")
    assert pairs(liveness.mock_orphans(e, x), "key") == [("gone",)]


# -- diagnostics, journal, sets


def test_delta_keeps_all_rows_of_unseen_keys(spark):
    schema = "file string, code string, message string, line int"
    before, after = frame(spark, [("a", "1", "m", 1), (None, "2", "g", 0)], schema), frame(spark, [("a", "1", "m", 9), ("b", "1", "m", 1), ("b", "1", "m", 2), (None, "2", "g", 0)], schema)
    new, fixed = diagnostics.delta(before, after)
    assert pairs(new, "file", "line") == [("b", 1), ("b", 2)] and fixed.count() == 0
    new, fixed = diagnostics.delta(before, after, moved=F.when(F.col("file") == "a", "b").otherwise(F.col("file")))
    assert pairs(new, "file") == [("a",)]


def test_compiler_output(spark):
    out = frame(spark, [("s", True, "src/a.ts(1,2): error TS2304: Cannot find (x).\r\nnoise\nerror TS5: global"), ("t", True, "boom")], "side string, failed boolean, output string")
    parsed = diagnostics.parse_compiler_output(out)
    assert sorted(map(str, pairs(parsed, "file", "code", "message"))) == sorted(map(str, [("src/a.ts", "TS2304", "Cannot find (x)."), (None, "TS5", "global")]))
    assert pairs(diagnostics.incomplete(out, parsed), "side", "incomplete") == [("s", True), ("t", True)]


def test_journal(spark):
    schema = "id bigint, moved array<struct<old:string,new:string>>, modified array<struct<path:string,sha256:string>>, undone_at string"
    j = frame(spark, [(k, [("o", "n")], [("p", "x")], "now" if k == 25 else None) for k in range(1, 26)], schema)
    kept = journal.append(j, j.limit(0))
    assert kept.count() == 20 and kept.agg(F.min("id")).first()[0] == 6
    entry = journal.to_undo(kept)
    assert entry.first()["id"] == 24
    import hashlib

    files = frame(spark, [("p", b"data")], "path string, content binary")
    assert pairs(journal.undo_conflicts(entry, files), "path", "reason") == [("p", "changed")]
    same = entry.withColumn("modified", F.array(F.struct(F.lit("p").alias("path"), F.lit(hashlib.sha256(b"data").hexdigest()).alias("sha256"))))
    assert journal.undo_conflicts(same, files).count() == 0
    assert pairs(journal.unrelated_changes(entry, frame(spark, [("p",), ("n",), ("q",)], "path string")), "path") == [("q",)]
    assert journal.mark_undone(kept, entry, "t").where("undone_at = 't'").count() == 1


def test_union_keeps_repeats_of_the_first_graph(spark):
    g = lambda rows: frame(spark, rows, "src string, specifier string, line int")
    got = setops.graph_union([g([("a", "s", 1), ("a", "s", 1)]), g([("a", "s", 1), ("b", "s", 1)])])
    assert pairs(got, "src", "graph_seq") == [("a", 0), ("a", 0), ("b", 1)]


# -- similarity


def test_prefix_join_equals_all_pairs(spark):
    rng = random.Random(11)
    sets = [(k, sorted({f"t{int(rng.random() ** 2 * 30)}" for _ in range(rng.randrange(12))})) for k in range(90)]
    df = frame(spark, sets, "id bigint, items array<string>")
    for t in (0.3, 0.5, 0.8, 0.9, 1.0):
        want = []
        for (a, x), (b, y) in itertools.combinations(sets, 2):
            u = len(set(x) | set(y))
            j = 1.0 if not u else len(set(x) & set(y)) / u
            if j >= t:
                want.append((a, b))
        got = pairs(similarity.similar_sets(df, t), "a", "b")
        empties = {k for k, x in sets if not x}
        assert [p for p in got if not set(p) <= empties] == [p for p in sorted(want) if not set(p) <= empties], t


def test_groups_are_stars_in_order(spark):
    p = frame(spark, [(1, 2, 0.9, False), (2, 3, 0.95, False), (3, 4, 0.8, False), (7, 8, 1.0, True), (9, 10, 0.5, False)], "a bigint, b bigint, score double, identical boolean")
    got = pairs(similarity.star_groups(p), "group_id", "member_id", "bucket")
    assert got == [(1, 1, "high"), (1, 2, "high"), (3, 3, "medium"), (3, 4, "medium"), (7, 7, "exact"), (7, 8, "exact")]


def test_groups_of_sets_make_no_pairs_of_equal_ones(spark, monkeypatch):
    rng = random.Random(23)
    kinds = [sorted({f"t{int(rng.random() ** 2 * 12)}" for _ in range(rng.randrange(14))}) for _ in range(40)]
    sets = [(k, rng.choice(kinds)) for k in range(300)]
    df = frame(spark, sets, "id bigint, items array<string>")
    for t in (0.5, 0.7, 0.9):
        want = similarity.star_groups(similarity.similar_sets(df, t).withColumn("identical", F.col("score") >= 1.0))
        want = pairs(want, "group_id", "member_id", "score", "bucket")
        with monkeypatch.context() as m:
            saved, save = [], similarity.Workspace.save
            m.setattr(similarity.Workspace, "save", lambda self, df, *a, **k: saved.append(df.count()) or save(self, df, *a, **k))
            assert pairs(similarity.similar_set_groups(df, t), "group_id", "member_id", "score", "bucket") == want
        assert max(saved) <= 800


def decl(k, name="fooBar", kind="function", body="a b c d e f g h", content=("x", "y"), file=None, ext=(), members=(), guard=False, tokens=None, length=None):
    return (k, file or f"f{k}", name, kind, body, tokens or len(body.split()), length or len(body), 3, False, False, guard, list(content), list(ext), list(members))


DECL = "decl_id bigint, file string, name string, kind string, normalized_body string, token_count int, body_length int, body_lines int, has_directive boolean, is_wrapper boolean, is_type_guard boolean, content_tokens array<string>, extends_names array<string>, member_names array<string>"


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        (decl(1), decl(2), 1.0),
        (decl(1), decl(2, content=("z", "w")), None),
        (decl(1, kind="type", content=()), decl(2, kind="type"), None),
        (decl(1, kind="type", content=(), file="f"), decl(2, kind="type", file="f"), None),
        (decl(1), decl(2, name="quxQuux"), 0.85),
        (decl(1, guard=True), decl(2, guard=True), None),
        (decl(1, kind="interface", ext=["A"]), decl(2, kind="interface", ext=["B"]), None),
        (decl(1, members=["fooBar"], kind="type"), decl(2, kind="type"), None),
        (decl(1, length=100), decl(2, length=49), None),
        (decl(1, tokens=100), decl(2, tokens=74), None),
        (decl(1, kind="interface", members=["a", "b", "c"]), decl(2, kind="interface", members=["d", "e", "f"]), None),
    ],
)
def test_pair_scores(spark, a, b, score):
    got = similarity.similar_pairs(frame(spark, [a, b], DECL)).collect()
    assert (round(got[0]["score"], 6) if got else None) == score
    if score is None:
        low = similarity.similar_pairs(frame(spark, [a, b], DECL), similarity.Options(threshold=0.45)).collect()
        assert all(0.45 <= r["score"] < 0.8 for r in low)


def test_find_similar_filters_and_picks(spark):
    d = frame(spark, [decl(1, file="src/a"), decl(2, file="src/a"), decl(3, file="lib/b")], DECL)
    assert similarity.find_similar(d, similarity.Options(related_to="lib")).count() == 3
    assert similarity.find_similar(d.where("decl_id < 3"), similarity.Options(skip_same_file=True)).count() == 0
    g = similarity.find_similar(d)
    assert pairs(similarity.canonical_members(g, d.withColumn("is_exported", F.col("decl_id") == 3)), "canonical", "duplicate") == [(3, 1), (3, 2)]


def test_groups_of_declarations_make_few_of_their_pairs(spark, monkeypatch):
    rng = random.Random(31)
    bodies = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(6, 14))) for _ in range(5)]

    def one(k):
        body = rng.choice(bodies).split()
        if rng.random() < 0.3:
            body[rng.randrange(len(body))] = rng.choice("abcdef")
        kind = rng.choice(["function"] * 9 + ["type", "interface"])
        content, members = rng.sample("pqrs", rng.randrange(5)), rng.sample(["m", "n", "fooBar"], rng.randrange(3)) if kind == "interface" else []
        return decl(k, rng.choice(["fooBar", "fooQux", "zip"]), kind, " ".join(body), content, f"f{rng.randrange(40)}", ["A"] * rng.randrange(2), members, rng.random() < 0.05, None, rng.randrange(20, 50))

    d = frame(spark, [one(7 * k) for k in range(200)], DECL)
    monkeypatch.setattr(similarity, "FIRST", 64, raising=False)
    monkeypatch.setattr(similarity, "PAIRS", 1000, raising=False)
    for t in (0.5, 0.8):
        o = similarity.Options(threshold=t, max_groups=0)
        made = similarity.similar_pairs(d, o)
        want = pairs(similarity.star_groups(made), "group_id", "member_id", "score", "bucket")
        with monkeypatch.context() as m:
            saved, save = [], similarity.Workspace.save
            m.setattr(similarity.Workspace, "save", lambda self, df, name, **k: saved.append((df.count() if "score" in df.columns else 0)) or save(self, df, name, **k))
            assert pairs(similarity.find_similar(d, o), "group_id", "member_id", "score", "bucket") == want
        assert want and max(saved) < made.count() / 2, (t, len(want), max(saved), made.count())


def test_declarations_without_bigrams_group_past_a_first_unlike_one(spark):
    d = frame(spark, [decl(1, body="x", length=100), decl(2, body="x", length=10), decl(3, body="x", length=10), decl(4)], DECL)
    assert pairs(similarity.find_similar(d), "group_id", "member_id", "bucket") == [(2, 2, "exact"), (2, 3, "exact")]
    assert similarity.find_similar(d.where("decl_id < 0")).count() == 0


# -- naming, layout, conventions


def test_casing_and_words(spark):
    told = {"foo-bar": "kebab-case", "foo_bar": "snake_case", "FooBar": "PascalCase", "fooBar": "camelCase", "foo": "camelCase", "foo.bar": "unknown", "": "unknown"}
    rows = frame(spark, [(k,) for k in told], "stem string")
    assert dict(pairs(rows.select("stem", S.casing("stem").alias("c")), "stem", "c")) == told
    assert values(spark, S.name_words(F.lit("XMLHttpRequest2Go")), S.identifier_words(F.lit("XMLParser_of it"))) == (["xml", "http", "request2", "go"], ["xml", "parser", "of", "it"])
    words = F.array(F.lit("foo"), F.lit("bar"))
    assert values(spark, *[S.to_casing(words, c) for c in (S.KEBAB, S.SNAKE, S.PASCAL, S.CAMEL)]) == ("foo-bar", "foo_bar", "FooBar", "fooBar")


def test_majority_needs_rows_share_and_no_tie(spark):
    rows = [("a", "k")] * 3 + [("a", "s")] + [("b", "k"), ("b", "s"), ("b", "k"), ("b", "s")] + [("c", "k")] * 2 + [("d", "unknown")] * 3 + [("d", "k")] * 2
    assert pairs(naming.majority(frame(spark, rows, "dir string, casing string")), "dir", "casing", "n") == [("a", "k", 3)]
    names = frame(spark, [("d", f"d/{s}.ts", s, k) for s, k in (("foo-bar", "function"), ("baz-qux", "function"), ("a-b", "function"), ("BadName", "function"), ("GoodClass", "class"), ("index", "function"), ("__x-y", "function"))], "dir string, file string, stem string, export_kind string")
    assert pairs(naming.violations(names), "stem", "suggestion", "confidence") == [("BadName", "bad-name", 0.2)]
    assert pairs(naming.conforming_share(names, "kebab-case"), "conforming", "total") == [(3, 5)]
    assert pairs(tidy.name_fixes(naming.violations(names)), "file", "target") == [("d/BadName.ts", "d/bad-name.ts")]


def test_layout(spark):
    assert pairs(layout.common_prefix(frame(spark, [(1, "a/b/c"), (1, "a/b/d"), (1, "a/bx"), (2, "q")], "g int, path string"), "g"), "g", "prefix", "n") == [(1, "a", 3), (2, "q", 1)]
    files = nodes(spark, ["x/f.ts", "y/a/u.ts", "y/b/v.ts", "utils/h.ts", "y/a/u.test.ts"], "file")
    r = refs(spark, [("y/a/u.ts", "x/f.ts"), ("y/b/v.ts", "x/f.ts"), ("y/a/u.ts", "utils/h.ts"), ("y/a/u.test.ts", "y/a/u.ts")])
    assert pairs(layout.misplaced_files(files, r), "file", "suggested_dir", "importer_count") == [("x/f.ts", "y", 2)]
    assert pairs(layout.single_importer(files, r, hubs(spark, [])), "file", "target") == [("utils/h.ts", "y/a/h.ts")]
    w = layout.subject_weights(refs(spark, [("t/q.test.ts", "y/a/u.ts", "import-named", ["a", "b"]), ("t/q.test.ts", "y/a/w.ts", "import-named", []), ("y/a/u.test.ts", "y/a/u.ts")]))
    assert pairs(w, "test", "file", "weight") == [("t/q.test.ts", "y/a/u.ts", 2), ("t/q.test.ts", "y/a/w.ts", 1), ("y/a/u.test.ts", "y/a/u.ts", 1)]
    assert pairs(layout.stranded_tests(w, True), "test", "suggested") == [("t/q.test.ts", "y/a/__tests__/q.test.ts")]
    assert pairs(layout.misnamed_tests(w), "test", "subject") == [("t/q.test.ts", "y/a/u.ts")]
    assert layout.convention_vote(layout.test_places(w).where("place = 'elsewhere'")).first()["use_folder"] is True
    assert layout.convention_vote(layout.test_places(w)).first()["use_folder"] is False


def test_conventions_paths_and_globs(spark):
    told = {"app/x/page.tsx": True, "src/app/robots.ts": True, "src/app/x/robots.ts": False, "packages/app/page.ts": False, "apps/web/app/layout.js": True, "lib/page.ts": False}
    rows = frame(spark, [(k,) for k in told], "file string")
    assert dict(pairs(rows.select("file", conventions.is_convention_file("file").alias("c")), "file", "c")) == told
    v = values(spark, S.within(F.lit("/a/src2/x"), F.lit("/a/src")), S.within(F.lit("a/..cache"), F.lit("a")), S.normalise_path(F.lit("a/./b/../c//d")), S.relative_specifier(F.lit("a/b/c.ts"), F.lit("a/d/index.ts")), S.relative_specifier(F.lit("a/m.ts"), F.lit("a/n.d.ts")), S.strip_extension(F.lit("x.d.ts")), S.package_of(F.lit("@s/p/x")), S.package_of_strict(F.lit("@s")), S.is_test(F.lit("a.spec.tsx")))
    assert v == (False, True, "a/c/d", "../d", "./n", "x", "@s/p", None, True)
    assert values(spark, S.round_half_up(F.lit(0.285)), S.round_half_up(F.lit(0.125)), S.confidence(F.lit(0.4))) == (0.28, 0.13, 0.0)
    assert values(spark, S.matches_path(F.lit("src/a/b.ts"), "src/*/b.ts"), S.matches_path(F.lit("src/a/c/b.ts"), "src/*/b.ts"), S.matches_entrypoint(F.lit("x/y/main.ts"), ["y/*.ts"])) == (True, False, True)
    assert values(spark, S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), F.size(S.bigrams(F.array(F.lit("a"))))) == (1.0, 0)
    assert values(spark, S.preferred_specifier(F.lit("@/ab"), F.lit("./ab"), "shortest"), S.preferred_specifier(F.lit("@/a"), F.lit("./a/b"), "shortest")) == ("./ab", "@/a")


# -- resolution, contracts, impact


def test_resolution(spark):
    files = nodes(spark, ["src/a.ts", "src/d/index.tsx", "lib/v.vue", "src/u/x.ts"], "file")
    al = frame(spark, [("@/*", "src/*", 0), ("@/u/*", "lib/*", 1), ("exact", "src/a.ts", 2)], "alias string, target string, pos int")
    r = frame(spark, [("src/m.ts", s) for s in ("./a", "./a.js", "./d", "../lib/v", "@/u/x", "exact", "react", "./x.css", "./gone", "@/gone")], "src string, specifier string")
    got = {x["specifier"]: (x["dst"], x["outcome"]) for x in resolve.resolve(r, files, al).collect()}
    assert got["./a"] == got["./a.js"] == got["exact"] == ("src/a.ts", "resolved") and got["./d"][0] == "src/d/index.tsx" and got["../lib/v"][0] == "lib/v.vue"
    assert got["@/u/x"][0] == "src/u/x.ts" and got["react"][1] == "external" and got["./x.css"][1] == "asset" and got["./gone"][1] == got["@/gone"][1] == "unresolvable"
    assert pairs(resolve.path_alias(frame(spark, [("src/d/index.tsx",), ("src/a.ts",)], "path string"), al), "path", "specifier") == [("src/a.ts", "@/a"), ("src/d/index.tsx", "@/d")]


def test_owners_outputs_and_subpaths(spark):
    p = frame(spark, [("b", "pk"), ("a", "pk/deep")], "name string, path string")
    assert pairs(resolve.file_package(nodes(spark, ["pk/deep/x.ts"], "file"), p), "owner") == [("a",)]
    listed = frame(spark, [("r/t.json", "f"), ("r/p/t.json", "f")], "config string, file string")
    c = frame(spark, [("r/t.json", 0), ("r/p/t.json", 1)], "config string, seq bigint")
    assert pairs(resolve.file_ownership(listed, c), "config") == [("r/p/t.json",)]
    r = refs(spark, [("u", "dist/a.js"), ("u", "dist/gone.js"), ("u", "src/b.ts")])
    out = frame(spark, [("dist", "src")], "out_dir string, source_dir string")
    assert pairs(resolve.project_outputs(r, out, nodes(spark, ["src/a.ts", "src/b.ts"], "file")), "dst") == [("src/a.ts",), ("src/b.ts",)]
    assert pairs(resolve.prune(r, nodes(spark, ["src/b.ts"])), "dst") == [("dist/a.js",), ("dist/gone.js",)]
    reason = resolve.non_source_reason(F.col("p"), F.lit(True), ["dist"])
    got = frame(spark, [("node_modules/x.js",), ("dist/y.js",), ("z-0123abcd.js",), ("w.ts",)], "p string").select(reason).collect()
    assert [x[0] for x in got] == ["dependency", "out-dir", "hashed-chunk", "git-ignored"]
    t = frame(spark, [("p", "lib/one.ts"), ("p", "lib/two.ts"), ("p", "x/three.ts"), ("p", "four.ts")], "package string, target string")
    sub = frame(spark, [("p", "./one", "lib/one.ts"), ("p", "./hub", "hub.ts"), ("p", "./x/*", "x/*.ts")], "package string, key string, path string")
    got = dict(pairs(resolve.package_specifier(t, sub, frame(spark, [("hub.ts", "lib/two.ts")], "barrel string, target string"), frame(spark, [("p",)], "name string")), "target", "specifier"))
    assert got == {"lib/one.ts": "p/one", "lib/two.ts": "p/hub", "x/three.ts": "p/x/three", "four.ts": "p"}


def test_contracts(spark):
    deps = frame(spark, [("app", "ui"), ("app", "kit"), ("two", "ui")], "consumer string, provider string")
    pol = frame(spark, [("ui", "react", "dependencies", "^1", False, 0), ("ui", "core", "dependencies", "^2", True, 1), ("core", "zod", "peerDependencies", "^3", False, 0), ("core", "ui", "dependencies", "^4", True, 1), ("kit", "react", "dependencies", "^9", False, 0)], "package string, dep string, section string, specifier string, include_closure boolean, seq bigint")
    req = contracts.requirements(deps, pol)
    manifests = frame(spark, [("two", "react", "devDependencies", "^1"), ("two", "core", "dependencies", "^0")], "consumer string, dep string, section string, specifier string")
    changes, conflicts = contracts.settle(req, manifests)
    assert pairs(conflicts, "consumer", "dep") == [("app", "react")]
    assert set(pairs(changes, "consumer", "dep", "action")) == {("app", "core", "add"), ("app", "zod", "add"), ("app", "ui", "add"), ("two", "react", "move"), ("two", "core", "align"), ("two", "zod", "add"), ("two", "ui", "add")}
    after = contracts.apply_changes(manifests, changes.where("consumer = 'two'"))
    assert after.where("dep = 'react'").count() == 1
    assert ("core", "ui", "missing-provider") in pairs(contracts.issues(deps.withColumn("specifier", F.lit("^1")), pol, frame(spark, [("core",)], "name string")), "package", "dep", "code")
    tasks = frame(spark, [("two", "^build")], "consumer string, depends_on string")
    assert pairs(contracts.task_changes(frame(spark, [("app", "ui"), ("two", "ui")], "consumer string, dep string"), tasks), "consumer", "task") == [("app", "ui#build")]


def test_impact_and_dependencies(spark):
    b = lambda n, boundary, missing, ins: values(spark, impact.risk_band(F.lit(n), F.lit(boundary), F.lit(missing), F.lit(ins)))[0]
    assert [b(0, False, 1, 1.0), b(20, False, 0, 1.0), b(5, True, 0, 1.0), b(1, True, 0, 1.0), b(5, False, 0, 1.0), b(1, False, 0, 0.3), b(1, False, 0, None), b(0, False, 0, 0.0)] == ["high", "high", "high", "medium", "medium", "medium", "low", "low"]
    need = frame(spark, [("a",), ("b",), ("own",), ("have",)], "package string")
    source = frame(spark, [("a", "peerDependencies", "^1"), ("a", "dependencies", "^2"), ("b", "devDependencies", "^3")], "name string, section string, specifier string")
    got = impact.dependency_additions(need, source, frame(spark, [("have",)], "name string"), frame(spark, [("own",)], "name string"))
    assert pairs(got, "package", "section", "specifier") == [("a", "dependencies", "^2"), ("own", "dependencies", "workspace:*")]


# -- edits and plans


def test_edits_count_utf16_units_and_undo(spark):
    text = frame(spark, [("f", "a😀bc\nline")], "file string, text string")
    e = frame(spark, [("f", 1, 3, "😀", "XY"), ("f", 4, 4, "", "!")], "file string, start int, end int, old_text string, new_text string")
    done = edits.apply_edits(text, e).first()
    assert done["after"] == "aXYb!c\nline" and done["error"] is None
    back = edits.apply_edits(text.withColumn("text", F.lit(done["after"])), edits.inverse(e)).first()
    assert back["after"] == "a😀bc\nline"
    assert edits.apply_edits(text, e.withColumn("old_text", F.lit("no"))).first()["error"]
    assert edits.structured_edit("a\nb\nc\n", "a\nX\nc\n") == (2, 4, "b\n", "X\n") and edits.structured_edit("a", "a") is None
    assert "+X" in edits.unified_diffs(frame(spark, [("f", "a\nb", "a\nX", None)], "file string, text string, after string, error string")).first()["diff"]


def test_plans(spark):
    files = nodes(spark, ["a/x.ts", "b/y.ts", "c/z.ts"], "file")
    mv = frame(spark, [("a/x.ts", "b/x.ts"), ("gone", "q"), ("c/z.ts", "b/y.ts")], "old string, new string")
    assert pairs(mutations.move_guards(mv, files), "old", "error") == [("c/z.ts", "target-exists"), ("gone", "source-missing")]
    assert mutations.move_guards(frame(spark, [("a/x.ts", "A/x.ts")], "old string, new string"), files.union(nodes(spark, ["A/x.ts"], "file"))).count() == 0
    one = frame(spark, [("a/x.ts", "b/x.ts")], "old string, new string")
    r = frame(spark, [("c/z.ts", "a/x.ts", "../a/x", "import-named", 1, [], 0), ("a/x.ts", "b/y.ts", "../b/y", "import-named", 2, [], 1)], REF)
    pk = frame(spark, [(f, "p") for f in ("a/x.ts", "b/x.ts", "b/y.ts", "c/z.ts", "hub.ts")], "file string, package string")
    h = hubs(spark, [("hub.ts", "a/x.ts", "all", None, None, "./a/x")])
    assert pairs(mutations.move_rewrites(one, r, hubs(spark, []), pk), "file", "new_specifier") == [("b/x.ts", "./y"), ("c/z.ts", "../b/x")]
    assert pairs(mutations.hub_updates(one, h, pk, frame(spark, [("p", "hub.ts")], "package string, barrel string")), "barrel", "action", "specifier") == [("hub.ts", "re-point", "./b/x")]
    assert mutations.move_batches([{"source": "a", "target": "b"}]) == [("a", "b")] and mutations.parse_specifier_pairs(["a=b"]) == [("a", "b")]
    for bad in ([], [{"source": "a"}], [{"source": "a", "target": "b", "x": 1}]):
        with pytest.raises(ValueError):
            mutations.move_batches(bad)
    with pytest.raises(ValueError):
        mutations.parse_specifier_pairs(["a"])
    x = frame(spark, [("m", "old", "named", 1), ("m", "taken", "named", 2)], "file string, name string, export_type string, line int")
    declared = frame(spark, [("u", "fresh")], "file string, name string")
    e, problems = mutations.rename_plan("m", "old", "fresh", x, refs(spark, [("u", "m", "import-named", ["old"])]), declared, hubs(spark, []))
    assert pairs(problems, "file", "problem") == [("u", "name-taken")] and e.count() == 0
    e, problems = mutations.rename_plan("m", "old", "free", x, refs(spark, [("u", "m", "import-named", ["old"])]), declared, hubs(spark, []))
    assert problems.count() == 0 and pairs(e, "file", "kind") == [("m", "declaration"), ("u", "import")]
    rows = frame(spark, [("f", 0, 10, 1, "a . b . c"), ("f", 0, 5, 1, "a.b")], "file string, start int, end int, line int, text string")
    rules = frame(spark, [("a.b.c", "q"), ("a.b", "z")], "from string, to string")
    assert pairs(mutations.transform_matches(rows, rules), "to") == [("q",)]
    plan = mutations.inline_plan(refs(spark, [("u", "hub", "import-named", ["x"]), ("v", "hub", "import-namespace", ["*"]), ("w", "hub", "import-named", ["dup"]), ("y", "hub", "import-named", ["x"]), ("y", "m", "import-named", ["k"])]), hubs(spark, [("hub", "m", "named", "real", "x", ""), ("hub", "p", "all", None, None, ""), ("hub", "q", "all", None, None, "")]), frame(spark, [("p", "dup", "named"), ("q", "dup", "named")], "file string, name string, export_type string"))
    assert pairs(plan, "src", "status") == [("u", "rewrite"), ("v", "skipped-namespace"), ("w", "skipped-ambiguous"), ("y", "conflict")]
    spec = mutations.rename_specifiers(frame(spark, [("u", "./o", "m", 1), ("v", "@/o", "m", 2), ("w", "./o", "m", 3), ("w", "new", "n", 4)], "src string, specifier string, dst string, line int"), frame(spark, [("./o", "new")], "old string, new string"))
    assert pairs(spec, "file", "status") == [("u", "rewrite"), ("v", "rewrite"), ("w", "conflict")]
    free = mutations.free_variables(frame(spark, [("i", 5), ("m", 6), ("p", 7), ("h", 8), ("out", 50)], "name string, at int"), frame(spark, [("i", 4, 9, "inner", False), ("m", 0, 99, "module", False), ("p", 1, 90, "owner", False), ("h", 1, 90, "owner", True)], "name string, start int, end int, level string, from_hook boolean"), (3, 10))
    assert pairs(free, "name", "role") == [("h", "blocked"), ("i", "bound"), ("m", "module"), ("p", "prop")]
    assert pairs(tidy.plan({"unused-exports": frame(spark, [("a",)], "file string")}), "kind") == [("unused-exports",)]
    with pytest.raises(ValueError):
        tidy.plan({"unused-exports": files}, limit=2)


# -- sources


SOURCE = """import def, { a as b, type T } from './m';
import * as ns from "./n"; import './side';
export * from './star'; export * as sp from './space'; export { q as r, default } from './re';
const z = require('./r'); const d = import('./dyn'); // import x from 'no'
jest.mock('./mocked', () => ({ one: 1, two: { x: 1 }, ...rest }));
vi.mock('./ok', () => ({ one: jest.fn(), 'two': 2 }));
export default function main(a: string) {
  return helper(a);
}
export const arrow = (x) => {
  const s = "import y from 'no'";
  return [x, s, 12];
};
export interface Shape extends Base { id: string; name?: number }
"""


def test_scanner(spark):
    got = [(s, k) for s, k, *_ in extract.scan_references(SOURCE)]
    assert got == [("./m", "import-named"), ("./n", "import-namespace"), ("./side", "import-side-effect"), ("./star", "export-all"), ("./space", "export-all-as"), ("./re", "export-from"), ("./r", "require"), ("./dyn", "import-dynamic"), ("./mocked", "jest-mock"), ("./ok", "jest-mock")]
    assert [b["name"] for b in extract.scan_references(SOURCE)[0][5]] == ["default", "a", "T"]
    assert [(n, t) for n, t, *_ in extract.scan_exports(SOURCE)] == [("sp", "namespace"), ("main", "default"), ("arrow", "named"), ("Shape", "named")]
    d = {x["name"]: x for x in extract.scan_declarations(SOURCE)}
    assert set(d) == {"main", "arrow", "Shape"} and d["main"]["is_wrapper"] and d["Shape"]["extends_names"] == ["Base"] and d["Shape"]["member_names"] == ["id"]
    keys = extract.scan_mock_keys(SOURCE)
    assert [(k.get("key"), k.get("skip")) for k in keys] == [(None, "spread"), ("one", None), ("two", None)]
    assert SOURCE[keys[1]["start"] : keys[1]["end"]] == "one: jest.fn()"
    texts = frame(spark, [("f.ts", SOURCE), ("empty.ts", None)], "path string, content string")
    assert extract.references(texts).count() == 10 and extract.exports(texts).count() == 4 and extract.declarations(texts).count() == 3 and extract.mock_keys(texts).count() == 3
    uses = liveness.internal_references(extract.occurrences(texts)).where("name = 'helper'").first()
    assert uses["internal_refs"] == 1
    assert values(spark, S.normalised(F.lit("const a = 'x' + 12; // c\nreturn b"))) == ("const $I = $S + $N; return $I",)


def test_configs_and_workspaces(spark, tmp_path):
    def put(path, content):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content if isinstance(content, str) else json.dumps(content))

    put("pnpm-workspace.yaml", "packages:\n  - 'pk/*'\n  - \"!pk/skip\"\n")
    put("tsconfig.base.json", '{ "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["src/*"], }, /* c */ "strict": true } }')
    put("pk/a/tsconfig.json", {"extends": "../../tsconfig.base.json", "include": ["src"], "references": [{"path": "../b"}]})
    put("pk/a/src/x.ts", "export {}")
    put("pk/a/node_modules/y/tsconfig.json", {})
    put("pk/a/package.json", {"name": "a", "version": "1", "exports": {".": {"import": "./i.js", "require": "./r.js"}, "./x": "./x.js"}, "bin": "cli.js", "dependencies": {"z": "^1", "b": "workspace:*"}, "devDependencies": {}})
    put("pk/skip/package.json", {"name": "skip"})
    found = config.discover(str(tmp_path))
    mine = next(c for c in found if c.path.endswith("pk/a/tsconfig.json"))
    assert len(found) == 2 and mine.options["strict"] and mine.aliases == [("@/*", str(tmp_path / "src/*"))] and not mine.solution
    assert config.config_files(mine) == [str(tmp_path / "pk/a/src/x.ts")]
    assert config.config_tables(spark, found)["aliases"].count() == 2
    root, globs = config.workspace_root(str(tmp_path / "pk/a"))
    packs = config.packages(root, globs)
    assert [p["name"] for p in packs] == ["a"] and config.manager(root) == "npm"
    t = config.package_tables(spark, packs)
    assert pairs(t["entrypoints"], "kind", "key", "target") == [("bin", "a", "cli.js"), ("exports", ".", "./i.js"), ("exports", ".", "./r.js"), ("exports", "./x", "./x.js")]
    assert json.loads(config.write_manifest(packs[0]["manifest"]))["dependencies"] == {"b": "workspace:*", "z": "^1"} and "devDependencies" not in config.write_manifest(packs[0]["manifest"])
    assert config.option("x", {}, {"x": 2}, {"x": 3}) == 2 and config.task_graph(str(tmp_path / "none.json")) is None
    texts = tables.read_sources(spark, str(tmp_path / "pk"))
    assert [r["path"] for r in texts.collect()] == ["a/src/x.ts"]
    pages = frame(spark, [("<script>a</script><script lang='ts' setup>b</script>",), ("<script lang=\"js\">c</script>",), ("none",)], "html string")
    assert [(r["script"], r["lang"]) for r in tables.script_blocks(pages).collect()] == [("b", "ts"), ("c", "js"), (None, None)]


def test_scripts_are_ts_unless_they_say_js(spark):
    pages = frame(spark, [("<p>😀<script>a</script>",), ("<script>a</script><SCRIPT Setup lang=js>b\n</script>",), ("<scripty>x</script>",), (None,)], "html string")
    got = [(r["script"], r["lang"], r["script_at"]) for r in tables.script_blocks(pages).collect()]
    assert got == [("a", "ts", 13), ("b\n", "js", 40), (None, None, None), (None, None, None)]


def test_every_convention_stem_in_both_places(spark):
    rows = frame(spark, [(s,) for s in conventions.STEMS], "s string").select("s", conventions.is_convention_file(F.concat(F.lit("app/x/"), "s", F.lit(".tsx"))).alias("below"), conventions.is_convention_file(F.concat(F.lit("src/app/"), "s", F.lit(".ts"))).alias("root")).collect()
    assert len(rows) == 19 and all(r["root"] for r in rows)
    assert {r["s"] for r in rows if not r["below"]} == {"forbidden", "global-error", "global-not-found", "manifest", "robots", "unauthorized"}


def test_scanning_names_is_linear(spark):
    import time

    text = "a.b; const c = d;\n" * 20_000
    began = time.time()
    roles = extract.scan_occurrences(text)
    assert time.time() - began < 20 and roles[:5] == [("a", "use"), ("b", "member"), ("const", "use"), ("c", "declaration"), ("d", "use")]
    assert extract._place("x\ny\nz", 4) == (3, 1)


def test_equal_sets_and_empty_ones(spark):
    sets = frame(spark, [(1, ["a", "b"]), (2, ["b", "a"]), (3, []), (4, []), (5, []), (6, ["a", "b", "c"]), (7, ["a", "b"])], "id bigint, items array<string>")
    assert pairs(similarity.similar_sets(sets, 0.6), "a", "b", "score") == [(1, 2, 1.0), (1, 6, 2 / 3), (1, 7, 1.0), (2, 6, 2 / 3), (2, 7, 1.0), (3, 4, 1.0), (3, 5, 1.0), (6, 7, 2 / 3)]


def test_moves_across_packages(spark):
    mv = frame(spark, [("pa/m.ts", "pb/src/m.ts")], "old string, new string")
    r = frame(spark, [("pb/u.ts", "pa/m.ts", "pa", "import-named", 1, [], 0), ("pc/v.ts", "pa/m.ts", "pa", "import-named", 2, [], 1)], REF)
    home = frame(spark, [("pa/m.ts", "pa"), ("pb/src/m.ts", "pb"), ("pb/u.ts", "pb"), ("pc/v.ts", "pc")], "file string, package string")
    keys = frame(spark, [("pb", "./m", "pb/src/m.ts")], "package string, key string, path string")
    assert pairs(mutations.move_rewrites(mv, r, hubs(spark, []), home, subpaths=keys), "file", "new_specifier") == [("pb/u.ts", "./src/m"), ("pc/v.ts", "pb/m")]
    assert pairs(mutations.move_rewrites(mv, r, hubs(spark, []), home), "file", "new_specifier") == [("pb/u.ts", "./src/m"), ("pc/v.ts", "pb")]


def test_find(spark):
    files, x = nodes(spark, ["src/Foo.ts", "src/foobar.ts", "x.vue"], "file"), frame(spark, [("src/a.ts", "getFoo"), ("x.vue", "foo")], "file string, name string")
    assert pairs(find.find(files, x, "FOO"), "kind", "name", "exact") == [("export", "getFoo", False), ("file", "Foo.ts", True), ("file", "foobar.ts", False)]


# -- streaming, entry


def test_facts_follow_changed_files(spark, tmp_path):
    from linkloom.streaming.incremental import keep_facts

    source, table = tmp_path / "in", str(tmp_path / "facts")
    schema = "path string, content string, mtime timestamp"
    for k, rows in enumerate([[("a.ts", "import './x'"), ("b.ts", "import './y'")], [("a.ts", "import './z'; import './w'")]]):
        frame(spark, [(p, c, None) for p, c in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        q = keep_facts(spark.readStream.schema(schema).parquet(str(source)), extract.references, table, str(tmp_path / "check"))
        q.awaitTermination()
    assert pairs(spark.read.parquet(table), "src", "specifier") == [("a.ts", "./w"), ("a.ts", "./z"), ("b.ts", "./y")]


def test_a_file_can_lose_all_its_facts(spark, tmp_path):
    from linkloom.streaming.incremental import upsert

    path, schema = str(tmp_path / "facts"), "src string, specifier string"
    key = lambda *names: frame(spark, [(n,) for n in names], "src string")
    for _ in range(2):
        upsert(spark, path, frame(spark, [("a.ts", "./x"), ("b.ts", "./y")], schema), key("a.ts", "b.ts"), "src")
        upsert(spark, path, frame(spark, [], schema), key("a.ts"), "src")
        assert pairs(spark.read.parquet(path), "src") == [("b.ts",)]


def test_entry_without_the_pipeline_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).parents[1]
    shutil.copytree(here / "linkloom", tmp_path / "linkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'metrics_fan_in_out' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
