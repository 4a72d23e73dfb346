"""From specifiers to files, packages and aliases, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dirname, normalise_path, within
from .setops import first_by_key

#: Tried in this order behind a specifier's path.
SUFFIXES = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".json", ".vue", "/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx")
ASSETS = r"\.(css|scss|sass|less|svg|png|jpe?g|gif|webp|avif|ico|woff2?|ttf|eot|mp[34]|wasm|txt|md)(\?.*)?$"


def match_aliases(specifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(specifier, alias, path): the first alias, in their order, that equals a specifier or, ending in /*, starts it.

    Prefixes of each specifier are exploded and joined by equality, so neither side is compared row by row.
    """
    parts = F.split("specifier", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/*")))
    keys = specifiers.select("specifier").distinct().select("specifier", F.explode(F.concat(prefixes, F.array("specifier"), F.array(F.lit("*")))).alias("alias"))
    hits = first_by_key(keys.join(aliases.select("alias", "target", "pos"), "alias"), ["specifier"], ["pos"])
    stem = F.regexp_replace("alias", r"\*$", "")
    rest = F.expr("substring(specifier, length(regexp_replace(alias, '[*]$', '')) + 1)")
    path = F.when(F.col("alias").endswith("*"), F.concat(F.regexp_replace("target", r"\*.*$", ""), rest)).otherwise(F.col("target"))
    return hits.withColumn("stem", stem).select("specifier", "alias", normalise_path(path).alias("path"))


def resolve(refs: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """refs(src, specifier) with ``dst`` and ``outcome``: resolved, asset, external or unresolvable.

    Each specifier gives a path, each path a few candidate files by suffix, and the first that exists wins.
    """
    keys = refs.select("src", "specifier").distinct()
    named = keys.join(match_aliases(keys, aliases), "specifier", "left")
    relative = F.col("specifier").startswith(".")
    path = F.when(relative, normalise_path(F.concat_ws("/", F.when(dirname("src") != "", dirname("src")), F.col("specifier")))).otherwise(F.coalesce("path", F.when(F.col("specifier").startswith("/"), normalise_path("specifier"))))
    pathed = named.select("src", "specifier", path.alias("path"))
    emitted = F.regexp_replace("path", r"\.([cm]?)jsx?$", ".$1ts")
    tries = F.concat(F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(F.col("path"), s)), F.array(emitted, F.regexp_replace("path", r"\.jsx?$", ".tsx")))
    candidates = pathed.where("path is not null").select("src", "specifier", F.posexplode(tries).alias("k", "dst"))
    found = first_by_key(candidates.join(files.select(F.col("file").alias("dst")).distinct(), "dst"), ["src", "specifier"], ["k"]).select("src", "specifier", "dst")
    out = pathed.join(found, ["src", "specifier"], "left")
    outcome = F.when(F.col("dst").isNotNull(), "resolved").when(F.col("specifier").rlike(ASSETS), "asset").when(F.col("path").isNull(), "external").otherwise("unresolvable")
    return refs.join(out.select("src", "specifier", "dst", outcome.alias("outcome")), ["src", "specifier"])


def owners(paths: DataFrame, folders: DataFrame, order: list[str | Column], path: str = "path") -> DataFrame:
    """(path, owner): of the folders that hold a path, the first in a stated order. folders: name, folder and what orders them.

    The ancestors of a path are exploded and joined by equality.
    """
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    keys = paths.select(path).distinct().select(path, F.explode(F.array_append(above, F.lit(""))).alias("folder"))
    return first_by_key(keys.join(folders, "folder"), [path], order).select(path, F.col("name").alias("owner"))


def file_ownership(listed: DataFrame, configs: DataFrame) -> DataFrame:
    """(file, config): of the configurations that list a file, the deepest, then the first found."""
    depth = F.size(F.split("config", "/"))
    rows = listed.join(configs.select("config", "seq"), "config").withColumn("depth", depth)
    return first_by_key(rows, ["file"], [F.desc("depth"), "seq"]).select("file", "config")


def file_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(file, owner): the first package by name that holds a file; not the deepest."""
    return owners(files, packages.select("name", F.col("path").alias("folder")), ["name"], "file")


def path_alias(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, specifier): wildcard aliases before exact ones, then by position; an index file is its folder."""
    plain = F.regexp_replace(F.regexp_replace("path", r"(\.d\.ts|\.[A-Za-z]+)$", ""), r"/index$", "")
    rows = paths.select("path", plain.alias("plain")).distinct()
    star = aliases.where(F.col("target").endswith("*")).select("alias", "pos", F.regexp_replace("target", r"/?\*$", "").alias("folder"))
    parts = F.split("plain", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    under = rows.select("path", "plain", F.explode(F.array_append(above, F.lit(""))).alias("folder")).join(star, "folder")
    tail = F.expr("ltrim('/', substring(plain, length(folder) + 1))")
    wild = under.select("path", F.concat(F.regexp_replace("alias", r"\*$", ""), tail).alias("specifier"), F.lit(0).alias("rank"), "pos")
    exact = rows.join(aliases.where(~F.col("target").endswith("*")).select("alias", "pos", F.regexp_replace(F.regexp_replace("target", r"(\.d\.ts|\.[A-Za-z]+)$", ""), r"/index$", "").alias("plain")), "plain").select("path", F.col("alias").alias("specifier"), F.lit(1).alias("rank"), "pos")
    return first_by_key(wild.unionByName(exact), ["path"], ["rank", "pos"]).select("path", "specifier")


def external_imports(refs: DataFrame) -> DataFrame:
    """(src, package, specifier, line): the first reference of each file to each package outside."""
    from ..functions.scalars import package_of

    bare = refs.where("outcome = 'external'").withColumn("package", package_of("specifier"))
    return first_by_key(bare, ["src", "package"], ["seq"]).select("src", "package", "specifier", "line")


def unresolvable(refs: DataFrame) -> DataFrame:
    """Import and export declarations whose specifier leads nowhere."""
    declared = F.col("ref_type").isin("import", "import-named", "import-namespace", "import-side-effect", "export-from", "export-all", "export-all-as")
    return refs.where(declared & (F.col("outcome") == "unresolvable")).select("src", "specifier", "line", F.concat(F.lit("Cannot find module '"), F.col("specifier"), F.lit("'")).alias("message"))


def package_specifier(targets: DataFrame, subpaths: DataFrame, barrels: DataFrame, packages: DataFrame) -> DataFrame:
    """(target, specifier): how another package imports a file.

    An explicit sub-path beats a barrel of a sub-path that passes the file on (the deepest, then the smallest specifier),
    then the root barrel, a wildcard sub-path, and the bare package.
    """
    named = subpaths.where(~F.col("key").contains("*")).select("package", F.col("path").alias("target"), F.col("key").alias("k"))
    explicit = targets.join(named, ["package", "target"]).select("target", F.concat("package", F.substring("k", 2, 1 << 20)).alias("specifier"), F.lit(0).alias("rank"), F.lit(0).alias("deep"))
    passed = targets.join(barrels, "target").join(subpaths.select("package", F.col("path").alias("barrel"), F.col("key").alias("k")), ["package", "barrel"])
    deep = -F.size(F.split("k", "/"))
    hub = passed.select("target", F.concat("package", F.substring("k", 2, 1 << 20)).alias("specifier"), F.when(F.col("k") == ".", 2).otherwise(1).alias("rank"), deep.alias("deep"))
    star = subpaths.where(F.size(F.split("key", r"\*")) == 2).select("package", F.split("key", r"\*")[0].alias("kh"), F.split("key", r"\*")[1].alias("kt"), F.split("path", r"\*")[0].alias("ph"), F.split("path", r"\*")[1].alias("pt"))
    fits = targets.join(star, "package").where(F.col("target").startswith(F.col("ph")) & F.col("target").endswith(F.col("pt")))
    middle = F.expr("substring(target, length(ph) + 1, length(target) - length(ph) - length(pt))")
    wild = fits.select("target", F.concat("package", F.expr("substring(kh, 2)"), middle, "kt").alias("specifier"), F.lit(3).alias("rank"), F.lit(0).alias("deep"))
    bare = targets.join(packages.select(F.col("name").alias("package")), "package").select("target", F.col("package").alias("specifier"), F.lit(4).alias("rank"), F.lit(0).alias("deep"))
    return first_by_key(explicit.unionByName(hub).unionByName(wild).unionByName(bare), ["target"], ["rank", "deep", "specifier"]).select("target", "specifier")


def project_outputs(refs: DataFrame, outputs: DataFrame, files: DataFrame) -> DataFrame:
    """References into emitted files, pointed at their source if one stem tells it, else dropped; the longest output folder wins.

    outputs: out_dir, source_dir.
    """
    stem = r"(\.d\.(ts|mts|cts)|\.[A-Za-z0-9]+)$"
    sources = files.withColumn("stem", F.regexp_replace("file", stem, "")).groupBy("stem").agg(F.min("file").alias("source"), F.count("*").alias("n")).where("n = 1").select("stem", "source")
    parts = F.split("dst", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    keys = refs.select("dst").where("dst is not null").distinct().select("dst", F.explode(above).alias("out_dir")).join(outputs, "out_dir")
    inside = first_by_key(keys, ["dst"], [F.desc(F.length("out_dir"))])
    moved = inside.withColumn("stem", F.regexp_replace(F.concat(F.col("source_dir"), F.expr("substring(dst, length(out_dir) + 1)")), stem, ""))
    moved = moved.join(sources, "stem", "left").select("dst", "source", F.lit(True).alias("emitted"))
    out = refs.join(moved, "dst", "left").where("emitted is null or source is not null")
    return out.withColumn("dst", F.coalesce("source", "dst")).select(refs.columns)


def prune(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References without the excluded nodes on either side."""
    gone = nodes.select("node").distinct()
    return refs.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select(refs.columns)


def non_source_reason(path: Column, ignored: Column, out_dirs: list[str]) -> Column:
    """Why an ignored file is no source: dependency, output folder, hashed chunk or ignored by git; null if it is one."""
    out = F.lit(False)
    for d in out_dirs:
        out = out | within(path, F.lit(d))
    reason = F.when(path.rlike(r"(^|/)node_modules/"), "dependency").when(out, "out-dir").when(path.rlike(r"[-.][0-9a-f]{8,}\.(c|m)?js$"), "hashed-chunk").otherwise("git-ignored")
    return F.when(ignored, reason)


def generated_boundary(paths: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Paths below a generated folder, with the folder."""
    return owners(paths, boundaries.select(F.col("folder").alias("name"), "folder"), [F.desc(F.length("folder"))]).where("owner is not null")


def dominant_folder(paths: DataFrame) -> DataFrame:
    """One row: the folder with the most excluded files."""
    counted = paths.groupBy(F.regexp_extract("path", r"^([^/]+)", 1).alias("dir")).agg(F.count("*").cast("bigint").alias("n"))
    return counted.agg(F.max(F.struct("n", "dir")).alias("m")).select("m.dir", "m.n")


def specifier_conflicts(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """planned rewrites whose new specifier their file already imports with a binding in common."""
    have = existing.select("src", F.col("specifier").alias("new_specifier"), F.transform("bindings", lambda b: b["name"]).alias("have"))
    names = F.transform("bindings", lambda b: b["name"])
    return planned.join(have, ["src", "new_specifier"]).where(F.arrays_overlap(names, "have")).select(planned.columns).distinct()


def binding_conflicts(importers: DataFrame, declared: DataFrame, new_name: str) -> DataFrame:
    """Importers, not aliasing, whose module scope already has the new name."""
    return importers.where("alias is null").join(declared.where(F.col("name") == new_name).select("file"), "file", "left_semi")


def inline_bindings(refs: DataFrame, entries: DataFrame, exports: DataFrame) -> DataFrame:
    """(src, barrel, name, source, source_name, reason): where a barrel's names really come from.

    Named entries first; else the one wildcard source that exports the name, never for default. What has several sources
    or is a whole-namespace import is blocked, with the reason.
    """
    asked = refs.select("src", F.col("dst").alias("barrel"), "ref_type", F.explode_outer("bindings").alias("b")).select("src", "barrel", "ref_type", F.col("b.name").alias("name"))
    asked = asked.join(entries.select("barrel").distinct(), "barrel", "left_semi").distinct()
    named = entries.where("entry_type in ('named', 'default')").select("barrel", F.coalesce("alias", "name").alias("name"), F.col("target").alias("source"), F.col("name").alias("source_name"))
    star = entries.where("entry_type = 'all'").select("barrel", "target").join(exports.where("export_type <> 'default'").select(F.col("file").alias("target"), "name"), "target").select("barrel", "name", F.col("target").alias("source"), F.col("name").alias("source_name"))
    star = star.join(named.select("barrel", "name"), ["barrel", "name"], "left_anti")
    sources = named.unionByName(star).distinct().groupBy("barrel", "name").agg(F.count("*").alias("n"), F.min(F.struct("source", "source_name")).alias("s"))
    space = entries.where("entry_type = 'namespace'").select("barrel", F.col("alias").alias("name"), F.lit(True).alias("space")).distinct()
    out = asked.join(sources, ["barrel", "name"], "left").join(space, ["barrel", "name"], "left")
    reason = (
        F.when(F.col("ref_type").isin("import-namespace"), "namespace").when(F.col("ref_type") == "import-dynamic", "dynamic").when(F.col("ref_type").isin("require", "require-resolve"), "require")
        .when(F.col("ref_type") == "jest-mock", "mock").when(F.col("ref_type") == "import-side-effect", "side-effect").when(F.col("space"), "namespace").when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous")
    )
    return out.select("src", "barrel", "name", F.when(reason.isNull(), F.col("s.source")).alias("source"), F.when(reason.isNull(), F.col("s.source_name")).alias("source_name"), reason.alias("reason"))

