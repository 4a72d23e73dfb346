"""Reports: operators put together over one set of facts. A report is a dict of DataFrames; nothing runs until one is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import conventions, find, graph, layout, liveness, metrics, naming, resolve, similarity, tidy
from ..sources import config, extract, tables
from .tables import Workspace


@dataclass
class Facts:
    """The tables that reports read. refs carry dst and outcome."""

    files: DataFrame
    refs: DataFrame
    exports: DataFrame
    barrel_entries: DataFrame
    declarations: DataFrame
    mocks: DataFrame
    occurrences: DataFrame
    entrypoints: DataFrame

    @property
    def inside(self) -> DataFrame:
        return self.refs.where("dst is not null")


def extract_facts(spark: SparkSession, folder: str, aliases: DataFrame | None = None) -> Facts:
    """Facts of a source tree, scanned where the files are read and written once."""
    texts = tables.read_sources(spark, folder)
    with Workspace(spark, "facts") as ws:
        files = ws.keep(texts.select(F.col("path").alias("file")), "files")
        if aliases is None:
            found = config.discover(folder.removeprefix("file://"))
            home = folder.removeprefix("file://").rstrip("/") + "/"
            rows = [(a, t.removeprefix(home), k) for k, (a, t) in enumerate(x for c in found for x in c.aliases)]
            aliases = spark.createDataFrame(rows, "alias string, target string, pos int")
        refs = ws.keep(resolve.resolve(extract.references(texts), files, aliases), "refs")
        exports = ws.keep(extract.exports(texts), "exports")
        body = extract.declarations(texts)
        normal = S.normalised("body")
        least = F.when(F.col("kind") == "function", similarity.MIN_TOKENS["function"]).otherwise(similarity.MIN_TOKENS["type"])
        body = body.withColumn("normalized_body", normal).withColumn("token_count", F.size(S.tokens("normalized_body"))).where(F.col("token_count") >= least)
        body = body.withColumn("content_tokens", S.content_tokens("body", F.col("kind"))).withColumn("decl_id", F.monotonically_increasing_id())
        declarations = ws.keep(body.drop("body"), "declarations")
        mocks = resolve.resolve(extract.mock_keys(texts).withColumnRenamed("mock_file", "src"), files, aliases)
        mocks = ws.keep(mocks.where("skip is null").select(F.col("src").alias("mock_file"), F.col("dst").alias("target"), "key", "line", "start", "end"), "mocks")
        occurrences = ws.keep(extract.occurrences(texts).groupBy("file", "name", "role").count(), "occurrences")
        packages = config.packages(folder.removeprefix("file://"), [".", "**"])
        named = [(p["path"], t.removeprefix("./")) for p in packages for _, _, t in config.entrypoints(p["manifest"])]
        home = folder.removeprefix("file://").rstrip("/")
        rows = [(f"{p.removeprefix(home).lstrip('/')}/{t}".lstrip("/"),) for p, t in named]
        entrypoints = spark.createDataFrame(rows, "node string")
    return Facts(files, refs, exports, graph.reexport_rows(refs), declarations, mocks, occurrences, entrypoints)


def audit(facts: Facts, fan_out: int = metrics.FAN_OUT, fan_in: int = metrics.FAN_IN, exports: int = metrics.EXPORTS) -> dict[str, DataFrame]:
    m = metrics.coupling(facts.inside, facts.files, facts.exports)
    return {"metrics": m, "cycles": graph.cycles(facts.inside), "over": metrics.over_thresholds(m, fan_out, fan_in, exports)}


def analyze(facts: Facts, file: str) -> dict[str, DataFrame]:
    """One file: what it imports and exports, who refers to it, which barrels pass it on, what leads nowhere, what is unused."""
    one = facts.files.sparkSession.createDataFrame([(file,)], "node string")
    return {
        "imports": facts.refs.where(F.col("src") == file),
        "exports": liveness.split_exports(facts.exports.where(F.col("file") == file), facts.inside),
        "referenced_by": graph.all_references(facts.inside, facts.barrel_entries, one).where(F.col("src") != file),
        "barrels": graph.direct_reexporters(facts.barrel_entries, one),
        "unresolvable": resolve.unresolvable(facts.refs.where(F.col("src") == file)),
    }


def unused(facts: Facts, entrypoint_globs: list[str] = ()) -> dict[str, DataFrame]:
    conv = facts.files.where(conventions.is_convention_file("file") | S.matches_entrypoint("file", list(entrypoint_globs))).select(F.col("file").alias("node"))
    tests = facts.files.where(S.is_test("file")).select(F.col("file").alias("node"))
    # an entry point may name the emitted file: its stem tells the source
    stems = facts.entrypoints.select(S.strip_extension("node").alias("stem")).distinct()
    entries = facts.files.withColumn("stem", S.strip_extension("file")).join(stems, "stem", "left_semi").select(F.col("file").alias("node"))
    public = graph.public_names(entries, facts.barrel_entries, facts.exports)
    roots = liveness.live_roots(entries, conv, tests)
    internal = liveness.internal_references(facts.occurrences.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("count")))))
    found = liveness.verdicts(facts.exports, facts.inside, facts.files, roots, public=public, assumed=conv, internal=internal)
    live = graph.forward_reach(facts.inside, roots, facts.files)
    return {
        "verdicts": found,
        "unused": found.where("verdict = 'unused'"),
        "transitively_dead": liveness.transitively_dead(found, facts.inside, facts.files, live),
        "orphans": liveness.orphan_files(facts.files, facts.exports, facts.inside, facts.barrel_entries, roots),
        "mock_orphans": liveness.mock_orphans(facts.mocks, facts.exports),
    }


def affected(facts: Facts, files: list[str]) -> DataFrame:
    return graph.affected(facts.inside, facts.barrel_entries, facts.files.sparkSession.createDataFrame([(f,) for f in files], "node string")).orderBy("node")


def barrels(facts: Facts) -> dict[str, DataFrame]:
    report = metrics.barrel_report(facts.barrel_entries, facts.inside)
    return {"barrels": report.orderBy(F.desc("total")), "chained": metrics.chained_barrels(facts.barrel_entries), "unused": metrics.unused_barrels(report)}


def similar(facts: Facts, options: similarity.Options = similarity.Options()) -> DataFrame:
    return similarity.find_similar(facts.declarations, options).join(facts.declarations.select(F.col("decl_id").alias("member_id"), "file", "name", "line"), "member_id")


def names(facts: Facts, target: str | None = None) -> DataFrame:
    rows = facts.files.where(~S.is_test("file") & ~conventions.is_convention_file("file")).select("file", S.dirname("file").alias("dir"), S.stem("file").alias("stem"))
    kinds = naming.primary_export_kind(facts.exports.withColumn("stem", S.stem("file")))
    return naming.violations(rows.join(kinds, "file", "left"), target=target)


def organise(facts: Facts, route_roots: list[str] = ()) -> dict[str, DataFrame]:
    weights = layout.subject_weights(facts.inside)
    vote = layout.convention_vote(layout.test_places(weights)).first()["use_folder"]
    return {"misplaced": layout.misplaced_files(facts.files, facts.inside, route_roots=list(route_roots)), "stranded_tests": layout.stranded_tests(weights, vote), "misnamed_tests": layout.misnamed_tests(weights)}


def search(facts: Facts, query: str, kind: str = "all") -> DataFrame:
    return find.find(facts.files, facts.exports, query, kind)


def tidy_up(facts: Facts) -> DataFrame:
    dead = unused(facts)
    changes = {"unused-exports": tidy.removable_exports(dead["verdicts"]), "mock-keys": tidy.mock_key_edits(dead["mock_orphans"]), "naming": tidy.name_fixes(names(facts))}
    return tidy.plan(changes, ("unused-exports", "mock-keys", "naming"))
