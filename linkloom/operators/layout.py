"""Where files lie, against where they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, canonical_name, common_length, dirname, is_test, stem, within

CONVENTION_SHARE = 0.7
#: Folders that are shared on purpose, as a first segment or the second below src.
SHARED = ("common", "components", "config", "hooks", "lib", "services", "shared", "styles", "types", "utils")
TESTS = "__tests__"


def common_prefix(paths: DataFrame, group: str, path: str = "path") -> DataFrame:
    """(group, prefix, n): what all paths of a group start with, segment by segment.

    The least and the greatest path in segment order bound all others, so two partial aggregates suffice, whatever the
    size of a group.
    """
    parts = paths.select(group, F.split(path, "/").alias("p"))
    ends = parts.groupBy(group).agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").cast("bigint").alias("n"))
    return ends.select(group, F.array_join(F.slice("a", F.lit(1), common_length("a", "b")), "/").alias("prefix"), "n")


def basename_collisions(exports: DataFrame) -> DataFrame:
    """(basename, name, signatures, files): names that files of one base name export with different signatures."""
    rows = exports.where("export_type <> 'default' and signature is not null").withColumn("basename", basename("file"))
    several = rows.groupBy("basename").agg(F.countDistinct("file").alias("m")).where("m > 1").select("basename")
    grouped = rows.join(several, "basename").groupBy("basename", "name").agg(F.countDistinct("signature").cast("bigint").alias("signatures"), F.countDistinct("file").cast("bigint").alias("files"))
    return grouped.where("signatures > 1")


def _is_shared(path) -> Column:
    parts = F.split(path, "/")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.coalesce(first.isin(*SHARED) | ((first == "src") & second.isin(*SHARED)), F.lit(False))


def misplaced_files(files: DataFrame, refs: DataFrame, *, route_roots: list[str] = (), root: str = "") -> DataFrame:
    """(file, suggested_dir, importer_count): files that all their importers' folders have elsewhere in common.

    importer_count counts references, not files. Files inside the common folder stay, as do those whose importers have
    only the root in common, shared folders, and what would move into a route tree.
    """
    uses = refs.where(~is_test("src")).where("src <> dst").join(files.select(F.col("file").alias("dst")), "dst", "left_semi")
    folders = uses.select(F.col("dst").alias("file"), dirname("src").alias("path")).distinct()
    lca = common_prefix(folders, "file").select("file", F.col("prefix").alias("suggested_dir"))
    counts = refs.groupBy(F.col("dst").alias("file")).agg(F.count("*").cast("bigint").alias("importer_count"))
    out = lca.join(counts, "file").where(~within("file", "suggested_dir")).where(F.col("suggested_dir") != root).where("suggested_dir <> ''")
    out = out.where(~_is_shared("file")).where(~_is_shared("suggested_dir"))
    for r in route_roots:
        out = out.where(~within("suggested_dir", F.lit(r)))
    return out.select("file", "suggested_dir", "importer_count")


def single_importer(files: DataFrame, refs: DataFrame, barrel_entries: DataFrame) -> DataFrame:
    """(file, importer, target): files with one importer, in another folder, where the name is free; barrels and what they pass on stay."""
    one = refs.where("src <> dst").groupBy(F.col("dst").alias("file")).agg(F.countDistinct("src").alias("n"), F.min("src").alias("importer")).where("n = 1")
    one = one.join(files.select("file"), "file", "left_semi").where(dirname("file") != dirname("importer"))
    one = one.withColumn("target", F.concat_ws("/", F.when(dirname("importer") != "", dirname("importer")), basename("file")))
    hubs = barrel_entries.select(F.col("barrel").alias("file")).union(barrel_entries.select("target"))
    return one.join(files.select(F.col("file").alias("target")), "target", "left_anti").join(hubs, "file", "left_anti").select("file", "importer", "target")


def subject_weights(refs: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(test, file, weight): how much a test imports of each file; bindings count, an import without any counts one."""
    rows = refs.where(is_test("src")).where(~is_test("dst"))
    if exclude is not None:
        rows = rows.join(exclude.select(F.col("file").alias("dst")), "dst", "left_anti")
    weight = F.greatest(F.lit(1), F.size(F.coalesce("bindings", F.array())))
    return rows.groupBy(F.col("src").alias("test"), F.col("dst").alias("file")).agg(F.sum(weight).cast("bigint").alias("weight"))


def subject_folder(weights: DataFrame) -> DataFrame:
    """(test, dir): the folder of all that a test imports, or null."""
    return weights.groupBy("test").agg(F.when(F.min(dirname("file")) == F.max(dirname("file")), F.min(dirname("file"))).alias("dir"))


def convention_vote(tests: DataFrame, share: float = CONVENTION_SHARE) -> DataFrame:
    """One row: tests in a tests folder and beside their subject, and whether the folder is the convention; no vote makes it so."""
    nested = F.count_if(F.col("place") == "tests-folder").cast("bigint")
    beside = F.count_if(F.col("place") == "beside").cast("bigint")
    return tests.agg(nested.alias("nested"), beside.alias("beside")).withColumn("use_folder", F.coalesce(F.try_divide(F.col("nested").cast("double"), (F.col("nested") + F.col("beside")).cast("double")) >= share, F.lit(True)))


def test_places(weights: DataFrame) -> DataFrame:
    """(test, dir, place): in a tests folder of the subject's folder, beside the subject, or elsewhere."""
    here = dirname("test")
    place = F.when(here == F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.lit(TESTS)), "tests-folder").when(here == F.col("dir"), "beside").otherwise("elsewhere")
    return subject_folder(weights).where("dir is not null").withColumn("place", place)


def stranded_tests(weights: DataFrame, use_folder: bool) -> DataFrame:
    """(test, dir, suggested): tests outside the folder of all their subjects."""
    head = F.when(F.col("dir") != "", F.concat(F.col("dir"), F.lit("/"))).otherwise("")
    suggested = F.concat(head, F.lit(f"{TESTS}/" if use_folder else ""), basename("test"))
    return subject_folder(weights).where("dir is not null").where(~within("test", "dir") & (F.col("dir") != "")).withColumn("suggested", suggested)


def misnamed_tests(weights: DataFrame) -> DataFrame:
    """(test, subject): tests named like none of their subjects, with the weightiest of these."""
    own = canonical_name(F.regexp_replace(basename("test"), r"\.(test|spec)\..*$", ""))
    alike = weights.withColumn("alike", own == canonical_name(stem("file")))
    heavy = F.min(F.struct((-F.col("weight")).alias("w"), F.col("file").alias("file")))
    return alike.groupBy("test").agg(F.bool_or("alike").alias("named"), heavy.getField("file").alias("subject")).where("not named").select("test", "subject")
