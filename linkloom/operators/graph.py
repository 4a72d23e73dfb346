"""Reachability over edge tables.

Fixpoints run level by level: a level is a join with the edges and an anti join with what is known, written to a table
in the shared folder, so a plan never grows with the depth. Only a flag comes back to the driver for each level.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Workspace
from ..schema import REEXPORTS
from .setops import first_by_key


def imported_by(refs: DataFrame) -> DataFrame:
    """(file, importers): the distinct files that refer to each."""
    return refs.where("dst is not null").groupBy(F.col("dst").alias("file")).agg(F.array_sort(F.collect_set("src")).alias("importers"))


def closure(edges: DataFrame, seeds: DataFrame, *, reverse: bool = False, keys: tuple[str, ...] = ("node",), limit: int | None = None) -> DataFrame:
    """(*keys, depth): what edges reach from the seeds, which have depth 0. Edges: src and dst, or src_k and dst_k for each key."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    column = (lambda side, k: side) if len(keys) == 1 else (lambda side, k: f"{side}_{k}")
    steps = edges.select(*[F.col(column(near, k)).alias(k) for k in keys], *[F.col(column(far, k)).alias(f"to_{k}") for k in keys]).distinct()
    spark = edges.sparkSession
    with Workspace(spark, "closure") as ws:
        steps = ws.save(steps, "steps")
        known = front = ws.save(seeds.select(*keys).distinct().withColumn("depth", F.lit(0)), "level-0")
        levels, depth = [front], 0
        while limit is None or depth < limit:
            depth += 1
            reached = front.join(steps, list(keys)).select(*[F.col(f"to_{k}").alias(k) for k in keys]).distinct()
            front = ws.save(reached.join(known, list(keys), "left_anti").withColumn("depth", F.lit(depth)), f"level-{depth}")
            if front.isEmpty():
                break
            levels.append(front)
            known = spark.read.schema(front.schema).parquet(*[ws.path(f"level-{k}") for k in range(depth + 1)])
        return ws.keep(known if len(levels) > 1 else levels[0])


def forward_reach(refs: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """(node, depth) along targets inside the graph, from the roots that exist in it."""
    inside = refs.join(files.select(F.col("file").alias("dst")), "dst", "left_semi")
    return closure(inside, roots.join(files.select(F.col("file").alias("node")), "node", "left_semi"))


def direct_reexporters(barrel_entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, barrel), one hop."""
    return barrel_entries.join(targets.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("target").alias("node"), "barrel").distinct()


def reexporter_closure(barrel_entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node): each target and every barrel that passes it on, however often."""
    steps = barrel_entries.select(F.col("target").alias("src"), F.col("barrel").alias("dst")).distinct()
    with Workspace(barrel_entries.sparkSession, "reexport") as ws:
        steps = ws.save(steps, "steps")
        known = front = ws.save(targets.select(F.col("node").alias("target"), "node").distinct(), "level-0")
        depth = 0
        while True:
            depth += 1
            front = ws.save(front.join(steps, F.col("node") == F.col("src")).select("target", F.col("dst").alias("node")).distinct().join(known, ["target", "node"], "left_anti"), f"level-{depth}")
            if front.isEmpty():
                return ws.keep(known)
            known = barrel_entries.sparkSession.read.schema(front.schema).parquet(*[ws.path(f"level-{k}") for k in range(depth + 1)])


#: Rows that one task makes when barrels hand their references on: as many references as targets, the root of it of each.
PORTION = 1 << 22


def _handed_on(refs: DataFrame, reach: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Each reference to a node for each target that the node stands for, with target and through.

    References and targets of a node are dealt to a grid, both by their hashes, so that either is copied only as often as
    the other has parts: what is shuffled grows as the rows that come out over the root of PORTION. Targets of a part are
    one list, which a reference is joined with whole.
    """
    side = max(1, math.isqrt(PORTION))
    per = refs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("r")).join(reach.groupBy("node").agg(F.count("*").alias("t")), "node")
    grid = ws.keep(per.select("node", (F.col("r") * F.col("t")).alias("rows"), *[F.ceil(F.col(n) / side).cast("int").alias(f"_{n}") for n in "rt"]), name)
    # the number of tasks follows the rows that come out, which a broadcast of what goes in would leave to a few
    parts = max(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(grid.agg(F.sum("rows")).first()[0] or 0) // PORTION))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    given = refs.join(grid.select(F.col("node").alias("dst"), "_r", "_t"), "dst")
    given = given.select(*refs.columns, F.pmod(F.xxhash64("src", "specifier", "line"), "_r").cast("int").alias("_i"), each("_t").alias("_j"))
    listed = reach.join(grid.select("node", "_r", "_t"), "node").groupBy("node", "_r", F.pmod(F.xxhash64("target"), "_t").cast("int").alias("_l")).agg(F.collect_list("target").alias("_targets"))
    listed = listed.select(F.col("node").alias("_node"), "_l", "_targets", each("_r").alias("_k"))
    met = given.repartition(parts, "dst", "_i", "_j").join(listed.repartition(parts, "_node", "_k", "_l").hint("merge"), (F.col("dst") == F.col("_node")) & (F.col("_i") == F.col("_k")) & (F.col("_j") == F.col("_l")))
    out = met.select(*refs.columns, F.explode("_targets").alias("target"))
    through = F.when(F.col("dst") != F.col("target"), F.col("dst"))
    return out.select(*[F.col("target").alias(c) if c == "dst" else F.col(c) for c in refs.columns], "target", through.alias("through"))


def all_references(refs: DataFrame, barrel_entries: DataFrame, targets: DataFrame) -> DataFrame:
    """References to each target, its own and those to barrels that pass it on, which then count as to the target.

    One row for each target, source, specifier and line: the first. Rows of one key can only come from references of
    one source, specifier and line to several files; all others are handed on without being compared, the references of
    a barrel in portions, so that neither a window nor one task holds what a large barrel passes on.
    """
    reach = reexporter_closure(barrel_entries, targets)
    with Workspace(refs.sparkSession, "references") as ws:
        place = ["src", "specifier", "line"]
        once = first_by_key(refs.where("dst is not null").repartition(*place), [*place, "dst"], ["seq"])
        over = Window.partitionBy(*place)
        once = ws.keep(once.withColumn("_several", F.min("dst").over(over) < F.max("dst").over(over)), "once")
        alone, several = (once.where(F.col("_several") == x).select(refs.columns) for x in (False, True))
        out = _handed_on(alone, reach, ws, "alone")
        if several.isEmpty():
            return out
        return out.unionByName(first_by_key(_handed_on(several, reach, ws, "several"), ["target", *place], [F.col("through").isNotNull().cast("int"), "seq"]))


def affected(refs: DataFrame, barrel_entries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): the seeds and all that import them, through barrels at every hop.

    A level looks up the barrels that pass on what was reached last, each barrel once, and then who refers to either: so
    every reference is read once, and never handed on to all that a barrel stands for.
    """
    spark = refs.sparkSession
    with Workspace(spark, "affected") as ws:
        uses = ws.save(refs.where("dst is not null").select(F.col("dst").alias("node"), F.col("src").alias("to")).distinct(), "uses")
        passes = ws.save(barrel_entries.select(F.col("target").alias("node"), F.col("barrel").alias("to")).distinct(), "passes")
        front = ws.save(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "level-0")
        known, met, depth = front, None, 0
        levels, asked = [ws.path("level-0")], []
        while True:
            depth += 1
            # what refers to these is not yet known to be reached: the last level, and the barrels that pass it on
            fresh, hop, begin = front.select("node"), 0, len(asked)
            while True:
                fresh = fresh if met is None else fresh.join(met, "node", "left_anti")
                fresh = ws.save(fresh, f"asked-{depth}-{hop}")
                if fresh.isEmpty():
                    break
                asked.append(ws.path(f"asked-{depth}-{hop}"))
                met = spark.read.schema(fresh.schema).parquet(*asked)
                fresh, hop = fresh.join(passes, "node").select(F.col("to").alias("node")).distinct(), hop + 1
            if len(asked) == begin:
                break
            turn = spark.read.schema(fresh.schema).parquet(*asked[begin:])
            reached = turn.join(uses, "node").select(F.col("to").alias("node")).distinct()
            front = ws.save(reached.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)), f"level-{depth}")
            if front.isEmpty():
                break
            levels.append(ws.path(f"level-{depth}"))
            known = spark.read.schema(front.schema).parquet(*levels)
        return ws.keep(known)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each strongly connected component.

    By colours: the largest node that reaches a node colours it; what a colour's own node is reached from inside the
    colour is a component, and leaves. Nodes that nothing enters or that enter nothing are components of their own and
    leave first.
    """
    spark = edges.sparkSession
    with Workspace(spark, "components") as ws:
        edges = ws.save(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        left = ws.save(edges.where("src <> dst"), "left-0")
        done, turn = [], 0
        while True:
            turn += 1
            # what has no way in or no way out can't lie on a cycle
            trimmed = 0
            while True:
                kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
                trimmed += 1
                before, kept = left.count(), ws.save(kept, f"trim-{turn}-{trimmed}")
                left = kept
                if kept.count() == before:
                    break
            if left.isEmpty():
                break
            colours = ws.save(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")), f"colour-{turn}-0")
            step = 0
            while True:
                step += 1
                offered = left.join(colours, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("offer"))
                new = colours.join(offered, colours["node"] == offered["dst"], "left").select("node", F.greatest("colour", "offer").alias("colour"), F.coalesce(F.col("offer") > F.col("colour"), F.lit(False)).alias("moved"))
                new = ws.save(new, f"colour-{turn}-{step}")
                colours = new.select("node", "colour")
                if new.where("moved").isEmpty():
                    break
            same = left.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst")
            found = closure(same, colours.where("node = colour").select("node"), reverse=True).select("node")
            members = ws.save(found.join(colours, "node"), f"found-{turn}")
            done.append(members)
            left = ws.save(left.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), f"left-{turn}")
        if not done:
            return ws.keep(nodes.select("node", F.col("node").alias("component")))
        found = done[0]
        for x in done[1:]:
            found = found.union(x)
        least = found.groupBy("colour").agg(F.min("node").alias("component"))
        named = found.join(least, "colour").select("node", "component")
        return ws.keep(nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, members, self_loop): strongly connected components of more than one node, and self-loops."""
    components = strong_components(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    grouped = components.join(loops, "node", "left").groupBy("component").agg(F.count("*").cast("bigint").alias("size"), F.array_sort(F.collect_list("node")).alias("members"), F.coalesce(F.bool_or("loop"), F.lit(False)).alias("self_loop"))
    return grouped.where("size > 1 or self_loop")


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(component, path): a shortest cycle through the least node of each component with a cycle, first by name."""
    components = strong_components(edges)
    a, b = components.select(F.col("node").alias("src"), "component"), components.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inner = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("component = other").select("component", "src", "dst")
    with Workspace(edges.sparkSession, "cycles") as ws:
        inner = ws.save(inner, "inner")
        paths = ws.save(inner.where("src = component").select("component", F.array("src", "dst").alias("path"), F.col("dst").alias("head")), "paths-0")
        found, step = [], 0
        while not paths.isEmpty():
            step += 1
            closed = paths.where("head = component").groupBy("component").agg(F.min("path").alias("path"))
            found.append(ws.save(closed, f"closed-{step}"))
            open_ = paths.join(found[-1].select("component"), "component", "left_anti")
            longer = open_.join(inner.select("component", F.col("src").alias("head"), F.col("dst").alias("next")), ["component", "head"]).where(~F.array_contains("path", F.col("next")) | (F.col("next") == F.col("component")))
            # of the ways to a node only the first is kept: it is as short as any
            paths = ws.save(longer.groupBy("component", F.col("next").alias("head")).agg(F.min(F.array_append("path", F.col("next"))).alias("path")), f"paths-{step}")
        if not found:
            return ws.keep(inner.select("component", F.array("src").alias("path")).limit(0))
        out = found[0]
        for x in found[1:]:
            out = out.union(x)
        return ws.keep(out)


def dead_importers(refs: DataFrame, live: DataFrame, files: DataFrame) -> DataFrame:
    """(file, importer): importers of each file that are neither the file nor live."""
    pairs = refs.join(files.select(F.col("file").alias("dst")), "dst", "left_semi").where("src <> dst").select(F.col("dst").alias("file"), F.col("src").alias("importer")).distinct()
    return pairs.join(live.select(F.col("node").alias("importer")), "importer", "left_anti").select("file", "importer")


def dead_chains(importers: DataFrame, targets: DataFrame, dead: DataFrame) -> DataFrame:
    """(file, chain): from the nearest importer that is dead by itself down to the file, or the file alone.

    Backwards through dead importers, level by level; of equally long chains the first by names.
    """
    with Workspace(importers.sparkSession, "chains") as ws:
        steps = ws.save(importers.select(F.col("file").alias("head"), F.col("importer").alias("next")), "steps")
        heads = dead.select(F.col("node").alias("head")).distinct().withColumn("dead", F.lit(True))
        open_ = ws.save(targets.select(F.col("node").alias("file"), F.col("node").alias("head"), F.array("node").alias("chain")).distinct(), "open-0")
        all_, seen, found, step = open_, open_.select("file", "head"), [], 0
        while not open_.isEmpty():
            step += 1
            longer = open_.join(steps, "head").where(~F.array_contains("chain", F.col("next"))).select("file", F.col("next").alias("head"), F.concat(F.array("next"), F.col("chain")).alias("chain"))
            best = longer.groupBy("file", "head").agg(F.min("chain").alias("chain")).join(seen, ["file", "head"], "left_anti")
            best = ws.save(best.join(heads, "head", "left").select("file", "head", "chain", F.coalesce("dead", F.lit(False)).alias("dead")), f"best-{step}")
            done = ws.save(best.where("dead").groupBy("file").agg(F.min("chain").alias("chain")), f"done-{step}")
            found.append(done)
            open_ = ws.save(best.join(done.select("file"), "file", "left_anti").select("file", "head", "chain"), f"open-{step}")
            seen = seen.union(open_.select("file", "head"))
        out = found[0] if found else None
        for x in found[1:]:
            out = out.union(x)
        alone = all_.select("file", "chain")
        if out is None:
            return ws.keep(alone)
        return ws.keep(alone.join(out.withColumnRenamed("chain", "long"), "file", "left").select("file", F.coalesce("long", "chain").alias("chain")))


def public_names(entries: DataFrame, barrel_entries: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, name): what entry files let out, followed down re-exports with their renames.

    ``*`` carries every name but default; ``* as ns`` carries everything under a name of its own.
    """
    named = barrel_entries.where("entry_type in ('named', 'default')").select(F.col("barrel").alias("src_file"), F.coalesce("alias", "name").alias("src_name"), F.col("target").alias("dst_file"), F.col("name").alias("dst_name"))
    under = exports.select(F.col("file").alias("target"), F.col("name").alias("n")).distinct()
    star = barrel_entries.where("entry_type = 'all'").select("barrel", "target").distinct()
    # names that pass through chains of stars, each from where it is declared
    with Workspace(exports.sparkSession, "names") as ws:
        passed = front = ws.save(under.select(F.col("target").alias("file"), "n").union(named.select("src_file", "src_name")).distinct(), "passed-0")
        hops, step = [], 0
        while True:
            step += 1
            up = star.join(front.where("n <> 'default'"), F.col("target") == F.col("file")).select(F.col("barrel").alias("src_file"), F.col("n").alias("src_name"), F.col("target").alias("dst_file"), F.col("n").alias("dst_name")).distinct()
            up = ws.save(up, f"hop-{step}")
            hops.append(up)
            front = ws.save(up.select(F.col("src_file").alias("file"), F.col("src_name").alias("n")).distinct().join(passed, ["file", "n"], "left_anti"), f"front-{step}")
            if front.isEmpty():
                break
            passed = passed.union(front)
        space = barrel_entries.where("entry_type = 'namespace'").select("barrel", F.col("alias").alias("ns"), "target").join(passed.select(F.col("file").alias("target"), "n"), "target").select(F.col("barrel").alias("src_file"), F.col("ns").alias("src_name"), F.col("target").alias("dst_file"), F.col("n").alias("dst_name"))
        edges = named.union(space)
        for h in hops:
            edges = edges.union(h)
        seeds = entries.select(F.col("node").alias("file")).join(passed.union(space.select("src_file", "src_name")).distinct(), "file").select("file", F.col("n").alias("name"))
        reached = closure(edges, seeds, keys=("file", "name"))
        return ws.keep(reached.select("file", "name"))


def replace_rows(table: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """An incremental edit: all rows of changed keys give way to the fresh ones."""
    return table.join(changed.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(fresh)


def reexport_rows(refs: DataFrame) -> DataFrame:
    """Barrel entries of references that pass on what they import, a row for each name."""
    rows = refs.where(F.col("ref_type").isin(*REEXPORTS))
    star = rows.where("ref_type = 'export-all'").select(F.col("src").alias("barrel"), F.col("dst").alias("target"), F.lit("all").alias("entry_type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("alias"), "specifier")
    space = rows.where("ref_type = 'export-all-as'").select(F.col("src").alias("barrel"), F.col("dst").alias("target"), F.lit("namespace").alias("entry_type"), F.lit(None).cast("string").alias("name"), F.element_at("bindings", 1)["name"].alias("alias"), "specifier")
    named = rows.where("ref_type = 'export-from'").select(F.col("src").alias("barrel"), F.col("dst").alias("target"), F.explode("bindings").alias("b"), "specifier")
    named = named.select("barrel", "target", F.when(F.col("b.name") == "default", "default").otherwise("named").alias("entry_type"), F.col("b.name").alias("name"), F.col("b.alias").alias("alias"), "specifier")
    return star.unionByName(space).unionByName(named).where("target is not null")
