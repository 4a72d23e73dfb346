"""Dependency contracts: what packages ask of those that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import relative_path
from ..plans.tables import Workspace
from .setops import first_by_key

SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def requirements(deps: DataFrame, policies: DataFrame) -> DataFrame:
    """(consumer, dep, section, specifier, chain, seq): what the policies of a consumer's providers ask for.

    deps: consumer, provider, section, specifier. policies: package, dep, section, specifier, include_closure, seq. A
    policy with include_closure asks, for its dependency, what that one's own policies ask. Each (root provider, source)
    is visited once for a consumer, so cycles end.
    """
    with Workspace(deps.sparkSession, "contracts") as ws:
        policies = ws.save(policies, "policies")
        front = deps.join(policies.select(F.col("package").alias("provider")).distinct(), "provider", "left_semi").select("consumer", F.col("provider").alias("root"), F.col("provider").alias("source"), F.array("consumer", "provider").alias("chain")).distinct()
        front = ws.save(front, "front-0")
        seen, levels, depth = front.select("consumer", "root", "source"), [], 0
        while True:
            asked = front.join(policies, F.col("source") == F.col("package"))
            level = ws.save(asked.select("consumer", "root", "dep", "section", "specifier", "include_closure", F.array_append("chain", F.col("dep")).alias("chain"), F.lit(depth).alias("depth"), "seq"), f"asked-{depth}")
            levels.append(level)
            depth += 1
            reached = level.where("include_closure").select("consumer", "root", F.col("dep").alias("source"), "chain").where("source <> consumer")
            front = first_by_key(reached, ["consumer", "root", "source"], ["chain"]).join(seen, ["consumer", "root", "source"], "left_anti")
            front = ws.save(front.select("consumer", "root", "source", "chain"), f"front-{depth}")
            if front.isEmpty():
                break
            seen = seen.union(front.select("consumer", "root", "source"))
        out = levels[0]
        for x in levels[1:]:
            out = out.union(x)
        return ws.keep(out.where("dep <> consumer").drop("include_closure"))


def settle(required: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, conflicts). changes: consumer, dep, action add, align or move, section, specifier; none where policies disagree."""
    first = first_by_key(required, ["consumer", "dep"], ["depth", "root", "seq"]).select("consumer", "dep", "section", "specifier")
    ways = required.groupBy("consumer", "dep").agg(F.countDistinct("section", "specifier").cast("bigint").alias("ways"), F.array_sort(F.collect_set(F.concat_ws("@", "section", "specifier"))).alias("asked"))
    conflicts = ways.where("ways > 1").select("consumer", "dep", "asked")
    now = first_by_key(manifests.withColumn("o", F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))), ["consumer", "dep"], ["o"]).select("consumer", "dep", F.col("section").alias("now_section"), F.col("specifier").alias("now_specifier"))
    planned = first.join(conflicts, ["consumer", "dep"], "left_anti").join(now, ["consumer", "dep"], "left")
    action = F.when(F.col("now_section").isNull(), "add").when(F.col("now_section") != F.col("section"), "move").when(F.col("now_specifier") != F.col("specifier"), "align")
    changes = planned.withColumn("action", action).where("action is not null").select("consumer", "dep", "action", "section", "specifier")
    return changes.orderBy(F.concat_ws(":", "consumer", "dep")), conflicts


def issues(deps: DataFrame, policies: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, dep, code): policies of an unknown section or without a specifier, on themselves, and closures over nothing."""
    code = F.when(~F.col("section").isin(*SECTIONS), "invalid-section").when(F.col("specifier").isNull() | (F.col("specifier") == ""), "missing-specifier").when(F.col("package") == F.col("dep"), "self-policy")
    bad = policies.withColumn("code", code).where("code is not null").select("package", "dep", "code")
    unknown = policies.where("include_closure").join(packages.select(F.col("name").alias("dep")), "dep", "left_anti").select("package", "dep", F.lit("missing-provider").alias("code"))
    absent = deps.where(F.col("specifier").startswith("workspace:")).join(packages.select(F.col("name").alias("provider")), "provider", "left_anti").select(F.col("consumer").alias("package"), F.col("provider").alias("dep"), F.lit("missing-workspace-package").alias("code"))
    return bad.unionByName(unknown).unionByName(absent).distinct()


def workspace_specifier(current: Column, consumer_protocols: Column, source: Column, consumer_path: Column, provider_path: Column) -> Column:
    """The protocol of the current entry, else the only one the consumer uses, else the source's; file: and link: take relative paths."""
    protocol = lambda c: F.when(c.rlike("^(workspace|file|link):"), F.regexp_extract(c, "^([a-z]+):", 1))
    own = F.array_distinct(F.filter(F.transform(consumer_protocols, protocol), lambda p: p.isNotNull()))
    chosen = F.coalesce(protocol(current), F.when(F.size(own) == 1, F.element_at(own, 1)), protocol(source))
    way = relative_path(consumer_path, provider_path)
    return F.when(chosen.isin("file", "link"), F.concat(chosen, F.lit(":"), way)).when(chosen == "workspace", F.when(current.startswith("workspace:"), current).when(source.startswith("workspace:"), source).otherwise(F.lit("workspace:*"))).otherwise(F.coalesce(current, source))


def task_changes(added: DataFrame, tasks: DataFrame) -> DataFrame:
    """(consumer, task): ``dep#build`` for added dependencies, unless build already waits for all or names it."""
    wanted = added.select("consumer", F.concat(F.col("dep"), F.lit("#build")).alias("task")).distinct()
    waits = tasks.where("depends_on = '^build'").select("consumer").distinct()
    named = tasks.select("consumer", F.col("depends_on").alias("task"))
    return wanted.join(waits, "consumer", "left_anti").join(named, ["consumer", "task"], "left_anti")


def apply_changes(manifests: DataFrame, changes: DataFrame) -> DataFrame:
    """Manifest rows (consumer, dep, section, specifier) with the changes: a name leaves every other section."""
    kept = manifests.join(changes.select("consumer", "dep"), ["consumer", "dep"], "left_anti").select("consumer", "dep", "section", "specifier")
    return kept.unionByName(changes.select("consumer", "dep", "section", "specifier"))
