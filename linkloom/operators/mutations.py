"""Planned changes: moves, renames, specifier rewrites, hub inlining and extraction, as rows. Nothing is written here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import preferred_specifier, relative_specifier
from .graph import all_references
from .resolve import binding_conflicts, inline_bindings, package_specifier, specifier_conflicts

REWRITE = ["file", "line", "old_specifier", "new_specifier"]


# -- moves


def move_guards(moves: DataFrame, files: DataFrame, restricted: DataFrame | None = None) -> DataFrame:
    """(old, new, error): sources that don't exist, targets that do (unless only case differs), two moves to one target, forbidden dependencies."""
    have = files.select(F.col("file").alias("old"), F.lit(True).alias("is_there")).distinct()
    taken = files.select(F.col("file").alias("new"), F.lit(True).alias("taken")).distinct()
    rows = moves.join(have, "old", "left").join(taken, "new", "left")
    same_case = F.lower("old") == F.lower("new")
    error = F.when(F.col("is_there").isNull(), "source-missing").when(F.col("taken") & ~same_case, "target-exists")
    found = rows.withColumn("error", error).where("error is not null").select("old", "new", "error")
    clash = moves.groupBy("new").agg(F.count("*").alias("n")).where("n > 1").select("new")
    found = found.unionByName(moves.join(clash, "new").select("old", "new", F.lit("target-twice").alias("error")))
    if restricted is not None:
        found = found.unionByName(moves.join(restricted.select("old").distinct(), "old").select("old", "new", F.lit("restricted-dependency").alias("error")))
    return found


def move_rewrites(moves: DataFrame, refs: DataFrame, barrel_entries: DataFrame, packages: DataFrame, *, subpaths: DataFrame | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(file, line, old_specifier, new_specifier, through): importers of moved files and imports inside them.

    Inside a package only direct references change, since hubs keep their consumers working once re-pointed; across
    packages, references through hubs change as well: importers of the package that the file moves to take a relative
    path, all others what package_specifier() says. packages: file, package, for old and new paths and importers;
    subpaths (package, key, path) and hubs (barrel, target): what the destination exports.
    """
    home = moves.join(packages.select(F.col("file").alias("old"), F.col("package").alias("from_package")), "old", "left").join(packages.select(F.col("file").alias("new"), F.col("package").alias("to_package")), "new", "left")
    home = home.withColumn("crosses", ~F.col("from_package").eqNullSafe(F.col("to_package"))).select("old", "new", "crosses", "to_package")
    uses = all_references(refs, barrel_entries, moves.select(F.col("old").alias("node")))
    hits = uses.join(home, F.col("dst") == F.col("old")).where("through is null or crosses").where("src <> old")
    spark = moves.sparkSession
    subpaths = subpaths if subpaths is not None else spark.createDataFrame([], "package string, key string, path string")
    passed = hubs if hubs is not None else spark.createDataFrame([], "barrel string, target string")
    asked = home.where("crosses and to_package is not null").select(F.col("to_package").alias("package"), F.col("new").alias("target")).distinct()
    outside = package_specifier(asked, subpaths, passed, asked.select(F.col("package").alias("name")).distinct())
    hits = hits.join(outside.select(F.col("target").alias("new"), F.col("specifier").alias("outside")), "new", "left")
    hits = hits.join(packages.select(F.col("file").alias("src"), F.col("package").alias("at_home")).distinct(), "src", "left")
    away = F.when(F.col("crosses") & ~F.col("at_home").eqNullSafe(F.col("to_package")), F.col("outside"))
    after = hits.select(F.col("src").alias("file"), "line", F.col("specifier").alias("old_specifier"), F.coalesce(away, relative_specifier("src", "new")).alias("new_specifier"), "through")
    own = refs.join(moves, F.col("src") == F.col("old")).where(F.col("specifier").startswith(".")).join(moves.select(F.col("old").alias("dst"), F.col("new").alias("dst_new")), "dst", "left")
    own = own.select(F.col("new").alias("file"), "line", F.col("specifier").alias("old_specifier"), relative_specifier("new", F.coalesce("dst_new", "dst")).alias("new_specifier"), F.lit(None).cast("string").alias("through"))
    return after.unionByName(own).where("old_specifier <> new_specifier").distinct()


def split_bindings(refs: DataFrame, moved_names: DataFrame) -> DataFrame:
    """(src, dst, line, moved, remaining): bindings of imports through a hub, those that moved and the rest."""
    names = moved_names.groupBy("dst").agg(F.collect_set("name").alias("names"))
    rows = refs.join(names, "dst")
    moved = F.expr("filter(bindings, b -> array_contains(names, b.name))")
    rest = F.expr("filter(bindings, b -> not array_contains(names, b.name))")
    return rows.select("src", "dst", "line", moved.alias("moved"), rest.alias("remaining")).where(F.size("moved") > 0)


def hub_updates(moves: DataFrame, barrel_entries: DataFrame, packages: DataFrame, destination_hubs: DataFrame) -> DataFrame:
    """(barrel, action, target, specifier): hubs of the package are re-pointed, others lose the file, and the destination's hub gets it."""
    pk = packages.select("file", "package")
    hits = barrel_entries.join(moves, F.col("target") == F.col("old")).join(pk.select(F.col("file").alias("barrel"), F.col("package").alias("hub_package")), "barrel", "left").join(pk.select(F.col("file").alias("new"), F.col("package").alias("to_package")), "new", "left")
    same = F.col("hub_package").eqNullSafe(F.col("to_package"))
    changed = hits.select("barrel", F.when(same, "re-point").otherwise("remove").alias("action"), F.when(same, F.col("new")).otherwise(F.col("old")).alias("target"), F.when(same, relative_specifier("barrel", "new")).alias("specifier")).distinct()
    have = barrel_entries.select("barrel", F.col("target").alias("new")).distinct()
    added = moves.join(pk.select(F.col("file").alias("new"), "package"), "new").join(destination_hubs.select("package", "barrel"), "package").join(have, ["barrel", "new"], "left_anti")
    repointed = changed.where("action = 're-point'").select("barrel", F.col("target").alias("new"))
    added = added.join(repointed, ["barrel", "new"], "left_anti")
    return changed.unionByName(added.select("barrel", F.lit("add").alias("action"), F.col("new").alias("target"), relative_specifier("barrel", "new").alias("specifier")))


def cross_package_dependencies(moves: DataFrame, externals: DataFrame, workspace: DataFrame, own_package: str) -> tuple[DataFrame, DataFrame]:
    """(internal, external) packages that moved files import, without the target package itself."""
    used = externals.join(moves.select(F.col("old").alias("src")), "src", "left_semi").where(F.col("package") != own_package).select("package").distinct()
    names = workspace.select(F.col("name").alias("package")).distinct()
    return used.join(names, "package", "left_semi"), used.join(names, "package", "left_anti")


def move_batches(moves: list[dict]) -> list[tuple[str, str]]:
    """A batch is a list, not empty, of objects with exactly source and target."""
    if not isinstance(moves, list) or not moves:
        raise ValueError("a batch needs at least one move")
    for m in moves:
        if not isinstance(m, dict) or set(m) != {"source", "target"} or not all(isinstance(x, str) and x for x in m.values()):
            raise ValueError(f"not a move: {m!r}")
    return [(m["source"], m["target"]) for m in moves]


# -- renames


def rename_plan(file: str, old: str, new: str, exports: DataFrame, refs: DataFrame, declared: DataFrame, barrel_entries: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edits: file, line, kind; problems: file, problem). An export must exist; importers that alias it can't conflict."""
    mine = exports.where((F.col("file") == file) & (F.col("name") == old))
    spark = exports.sparkSession
    uses = all_references(refs, barrel_entries, spark.createDataFrame([(file,)], "node string"))
    importers = uses.select("src", "line", F.explode("bindings").alias("b")).where(F.col("b.name") == old).select(F.col("src").alias("file"), "line", F.col("b.alias").alias("alias"))
    clash = binding_conflicts(importers, declared, new).select("file", F.lit("name-taken").alias("problem"))
    taken = exports.where((F.col("file") == file) & (F.col("name") == new)).select("file", F.lit("name-taken").alias("problem"))
    missing = spark.createDataFrame([(file, "export-missing")], "file string, problem string").join(mine.select("file"), "file", "left_anti")
    problems = missing.unionByName(clash).unionByName(taken).distinct()
    edits = mine.select("file", "line", F.lit("declaration").alias("kind")).unionByName(importers.select("file", "line", F.when(F.col("alias").isNull(), "import").otherwise("import-aliased").alias("kind"))).distinct()
    if not force:
        edits = edits.join(problems.select(F.lit(1).alias("x")).limit(1), F.lit(True), "left_anti")
    return edits, problems


# -- specifiers


def normalise_specifiers(refs: DataFrame, aliases: DataFrame, preference: str, root: str = "") -> DataFrame:
    """(file, line, old_specifier, new_specifier, status): rewrites to the preferred form, or conflict where it is imported already.

    aliases: path, specifier. References out of the root or into dependencies stay.
    """
    inside = refs.where("dst is not null").where(~F.col("dst").contains("node_modules/")).where(F.col("dst").startswith(root))
    named = inside.join(aliases.select(F.col("path").alias("dst"), F.col("specifier").alias("alias")), "dst", "left")
    wanted = named.withColumn("new_specifier", preferred_specifier("alias", relative_specifier("src", "dst"), preference)).where("specifier <> new_specifier")
    clash = specifier_conflicts(wanted.select("src", "specifier", "line", "new_specifier", "bindings"), refs).select("src", "line", "new_specifier").distinct().withColumn("clash", F.lit(True))
    out = wanted.join(clash, ["src", "line", "new_specifier"], "left")
    return out.select(F.col("src").alias("file"), "line", F.col("specifier").alias("old_specifier"), "new_specifier", F.when(F.col("clash"), "conflict").otherwise("rewrite").alias("status"))


def parse_specifier_pairs(pairs: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for p in pairs:
        a, eq, b = p.partition("=")
        if not eq or not a or not b or a == b or "=" in b:
            raise ValueError(f"not of the form old=new: {p!r}")
        if any(a == x for x, _ in out):
            raise ValueError(f"{a!r} is named twice")
        out.append((a, b))
    return out


def rename_specifiers(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file, line, old_specifier, new_specifier, status) of (old, new): by the string, else by what it resolves to.

    An equivalent specifier of a relative new one is only reported, since that depends on the importer; where the file
    imports the new specifier already there is a conflict.
    """
    exact = refs.join(pairs, refs["specifier"] == pairs["old"]).select("src", "line", "specifier", "dst", "new", F.lit("exact").alias("by"))
    modules = refs.join(pairs, refs["specifier"] == pairs["old"]).where("dst is not null").select("dst", "new").distinct()
    same = refs.join(modules, "dst").join(pairs.select(F.col("old").alias("specifier")), "specifier", "left_anti").where("specifier <> new").select("src", "line", "specifier", "dst", "new", F.lit("equivalent").alias("by"))
    rows = exact.unionByName(same)
    have = refs.select("src", F.col("specifier").alias("new"), F.lit(True).alias("have")).distinct()
    rows = rows.join(have, ["src", "new"], "left")
    status = F.when(F.col("have"), "conflict").when((F.col("by") == "equivalent") & F.col("new").startswith("."), "missed-equivalent").otherwise("rewrite")
    return rows.select(F.col("src").alias("file"), "line", F.col("specifier").alias("old_specifier"), F.col("new").alias("new_specifier"), status.alias("status"))


# -- hubs


def pure_hubs(statements: DataFrame) -> DataFrame:
    """(file): files whose every statement passes something on. statements: file, kind."""
    return statements.groupBy("file").agg(F.bool_and(F.col("kind") == "re-export").alias("pure")).where("pure").select("file")


def inline_plan(refs: DataFrame, entries: DataFrame, exports: DataFrame, force: bool = False) -> DataFrame:
    """(src, barrel, name, source, source_name, status): rewrite, skipped with its reason, or conflict if the importer has the source already."""
    rows = inline_bindings(refs, entries, exports)
    have = refs.select("src", F.col("dst").alias("source"), F.lit(True).alias("have")).distinct()
    status = F.when(F.col("reason").isNotNull(), F.concat(F.lit("skipped-"), F.col("reason")))
    if not force:
        status = status.when(F.col("have"), "conflict")
    return rows.join(have, ["src", "source"], "left").select("src", "barrel", "name", "source", "source_name", status.otherwise("rewrite").alias("status"))


# -- extraction


def captured_names(used: DataFrame, local: DataFrame, module: DataFrame, safe: tuple[str, ...] = ()) -> DataFrame:
    """(decl_id, names): module-level names that a declaration uses; local ones and safe globals aside."""
    own = used.select("decl_id", "name").distinct().join(local.select("decl_id", "name"), ["decl_id", "name"], "left_anti")
    own = own.where(~F.col("name").isin(*safe)) if safe else own
    kept = own.join(module.select("decl_id", "name"), ["decl_id", "name"], "left_semi")
    return kept.groupBy("decl_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def import_back(refs: DataFrame) -> DataFrame:
    """(file, target): a canonical file that imports a duplicate's file would be imported back by it."""
    return refs.where("dst is not null").select(F.col("src").alias("file"), F.col("dst").alias("target")).distinct()


def free_variables(uses: DataFrame, declarations: DataFrame, subtree: tuple[int, int]) -> DataFrame:
    """(name, role): bound inside the subtree, free from the module, a prop from the owner, or blocked if the owner has it from a hook.

    uses: name, at. declarations: name, start, end (its scope), level module, owner or inner, from_hook.
    """
    low, high = subtree
    inside = uses.where(F.col("at").between(low, high)).select("name").distinct()
    role: Column = F.when((F.col("start") >= low) & (F.col("end") <= high), 0).when(F.col("level") == "owner", F.when(F.col("from_hook"), 3).otherwise(2)).otherwise(1)
    ranked = inside.join(declarations.withColumn("role", role), "name").groupBy("name").agg(F.min("role").alias("r"))
    return ranked.select("name", F.element_at(F.array(*[F.lit(x) for x in ("bound", "module", "prop", "blocked")]), F.col("r") + 1).alias("role"))


# -- declarative transforms


def transform_matches(occurrences: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, start, end, line, from, to): accessors that equal a rule but for white space; of nested ones the outermost."""
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    hits = occurrences.withColumn("k", plain("text")).join(rules.select("from", "to").withColumn("k", plain("from")), "k")
    outer = hits.select("file", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    held = (hits["file"] == outer["file"]) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")) & ((F.col("s") < F.col("start")) | (F.col("e") > F.col("end")))
    return hits.join(outer, held, "left_anti").select("file", "start", "end", "line", "from", "to")
