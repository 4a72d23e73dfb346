"""More registered queries: an operator each over whole test tables, with SQL of another algorithm."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contracts, conventions, edits, graph, impact, journal, layout, liveness, metrics, mutations, naming, resolve, similarity, tidy
from ..sources.tables import read_table as t
from .adapters import KEY_EDGES_SQL, key_edges, node
from .queries import CASED, METRICS_SQL, _cased, _tests, query

BINDINGS = "array<struct<name:string,alias:string,is_type:boolean>>"


def text(*parts):
    """Parts joined; plain strings are literals, and columns are given as columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def bound(*names):
    return F.array(*[F.struct(n.alias("name"), F.lit(None).cast("string").alias("alias"), F.lit(False).alias("is_type")) for n in names])


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


c = F.col

# -- facts and references


@query(f"SELECT dst AS file, string_agg(DISTINCT src, ',' ORDER BY src) AS importers FROM ({KEY_EDGES_SQL}) GROUP BY 1")
def imported_by(spark, d):
    return graph.imported_by(key_edges(spark, d, items=False)).select("file", F.array_join("importers", ",").alias("importers"))


@query("""
SELECT 's' || l_suppkey AS file, string_agg(DISTINCT 'p' || (l_partkey % 10), ',' ORDER BY 'p' || (l_partkey % 10)) AS names, bool_or(l_linenumber = 7 AND l_quantity > 48) AS whole
FROM lineitem GROUP BY 1""")
def imported_names(spark, d):
    kind = F.when((c("l_linenumber") == 7) & (c("l_quantity") > 48), "import").otherwise("import-named")
    refs = t(spark, d, "lineitem").select(node("s", "l_suppkey").alias("dst"), kind.alias("ref_type"), bound(text("p", c("l_partkey") % 10)).alias("bindings"))
    return liveness.imported_names(refs).select("file", F.array_join("names", ",").alias("names"), "whole")


@query("SELECT DISTINCT 'p' || l_partkey AS node, 'o' || l_orderkey AS barrel FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)")
def direct_reexporters(spark, d):
    entries = t(spark, d, "lineitem").select(node("o", "l_orderkey").alias("barrel"), node("p", "l_partkey").alias("target"))
    return graph.direct_reexporters(entries, t(spark, d, "part").select(node("p", "p_partkey").alias("node")))


@query(f"SELECT src, dst FROM ({KEY_EDGES_SQL}) WHERE src NOT IN (SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 1) AND dst NOT IN (SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def pruned_references(spark, d):
    return resolve.prune(key_edges(spark, d, items=False), t(spark, d, "nation").where("n_regionkey = 1").select(node("N", "n_nationkey").alias("node")))


@query(f"SELECT m.*, CAST(coalesce(k, 0) AS BIGINT) AS export_count FROM ({METRICS_SQL}) m LEFT JOIN (SELECT 'N' || c_nationkey AS node, count(*) AS k FROM customer GROUP BY 1) USING (node)")
def export_counts(spark, d):
    return metrics.coupling(key_edges(spark, d), exports=t(spark, d, "customer").select(node("N", "c_nationkey").alias("file")))


@query(f"""
SELECT DISTINCT dst AS file, src AS importer FROM ({KEY_EDGES_SQL}) WHERE dst IN (SELECT 'N' || n_nationkey FROM nation) AND src <> dst AND src NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_acctbal > 0)""")
def dead_importers(spark, d):
    live = t(spark, d, "customer").where("c_acctbal > 0").select(node("C", "c_custkey").alias("node"))
    return graph.dead_importers(key_edges(spark, d, items=False), live, t(spark, d, "nation").select(node("N", "n_nationkey").alias("file")))


@query("""
WITH o AS (SELECT 'N' || c_nationkey AS n, 'C' || c_custkey AS c, 'O' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
near AS (SELECT n, min([c, n]) AS k FROM o WHERE o IS NULL GROUP BY 1), far AS (SELECT n, min([o, c, n]) AS k FROM o WHERE o IS NOT NULL GROUP BY 1),
i AS (SELECT n, string_agg(DISTINCT c, ',' ORDER BY c) AS s FROM o GROUP BY 1)
SELECT 'N' || n_nationkey AS file, i.s AS dead_importers, array_to_string(coalesce(near.k, far.k, ['N' || n_nationkey]), '>') AS chain
FROM nation LEFT JOIN i ON i.n = 'N' || n_nationkey LEFT JOIN near ON near.n = 'N' || n_nationkey LEFT JOIN far ON far.n = 'N' || n_nationkey""")
def transitively_dead(spark, d):
    n = t(spark, d, "nation").select(node("N", "n_nationkey").alias("file"))
    files = n.union(t(spark, d, "customer").select(node("C", "c_custkey"))).union(t(spark, d, "orders").select(node("O", "o_orderkey"))).union(t(spark, d, "supplier").select(node("S", "s_suppkey")))
    live = t(spark, d, "supplier").select(node("S", "s_suppkey").alias("node"))
    found = liveness.transitively_dead(n.withColumn("verdict", F.lit("transitively-dead")), key_edges(spark, d, items=False), files, live)
    return found.select("file", F.array_join("dead_importers", ",").alias("dead_importers"), F.array_join("chain", ">").alias("chain"))


@query("SELECT source AS file, lang AS name, CAST(count(*) AS BIGINT) AS internal_refs FROM documents WHERE n_chars % 3 <> 0 GROUP BY 1, 2")
def internal_references(spark, d):
    role = F.when(c("n_chars") % 3 == 0, "member").otherwise("use")
    return liveness.internal_references(t(spark, d, "documents").select(c("source").alias("file"), c("lang").alias("name"), role.alias("role")))


@query("SELECT 'N' || n_nationkey AS node FROM nation UNION SELECT 'N' || s_nationkey FROM supplier UNION SELECT 'R' || r_regionkey FROM region")
def live_roots(spark, d):
    sets = [("nation", "N", "n_nationkey"), ("supplier", "N", "s_nationkey"), ("region", "R", "r_regionkey")]
    return liveness.live_roots(*[t(spark, d, name).select(node(p, k).alias("node")) for name, p, k in sets])


@query(f"SELECT DISTINCT src AS file, dst AS target FROM ({KEY_EDGES_SQL})")
def import_back(spark, d):
    return mutations.import_back(key_edges(spark, d, items=False))


# -- paths and names

_PATH = "'src/' || lang || '/' || (doc_id % 7) || '/x' || doc_id || '.ts'"


def _paths(spark, d, *more):
    return t(spark, d, "documents").select("doc_id", text("src/", c("lang"), "/", c("doc_id") % 7, "/x", c("doc_id"), ".ts").alias("path"), *more)


@query(f"SELECT doc_id, starts_with({_PATH}, 'src/en/1/') AS inside FROM documents")
def within_folder(spark, d):
    return _paths(spark, d).select("doc_id", S.within("path", F.lit("src/en/1")).alias("inside"))


@query("SELECT doc_id, lang = 'en' AND doc_id % 7 = 3 OR starts_with('x' || doc_id, 'x1') AS entry FROM documents")
def entrypoint_globs(spark, d):
    return _paths(spark, d).select("doc_id", S.matches_entrypoint("path", ["en/3/*.ts", "x1*.ts"]).alias("entry"))


@query("SELECT doc_id, doc_id % 5 IN (0, 1, 2) AS test FROM documents")
def test_files(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in (".test.ts", ".spec.mjsx", ".test.vue", ".testing.ts", ".ts")]), (c("doc_id") % 5 + 1).cast("int"))
    return t(spark, d, "documents").select("doc_id", S.is_test(text("a/b", c("doc_id"), tail)).alias("test"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN NULL WHEN doc_id % 5 = 0 THEN 'dependency' WHEN doc_id % 5 = 1 THEN 'out-dir' WHEN doc_id % 5 = 2 THEN 'hashed-chunk' ELSE 'git-ignored' END AS reason FROM documents")
def non_source_reasons(spark, d):
    path = F.element_at(F.array(*[F.lit(x) for x in ("a/node_modules/p/x.js", "dist/a.js", "c-0123abcd.js", "src/x.ts", "distant/x.js")]), (c("doc_id") % 5 + 1).cast("int"))
    return t(spark, d, "documents").select("doc_id", resolve.non_source_reason(path, c("doc_id") % 2 == 0, ["dist"]).alias("reason"))


@query("""
SELECT 'u' || doc_id AS src, 'src/m' || (doc_id % 50) || '.ts' AS dst FROM documents WHERE doc_id % 3 = 2 OR (doc_id % 3 = 0 AND doc_id % 5 <> 0)""")
def emitted_to_source(spark, d):
    docs, k = t(spark, d, "documents"), c("doc_id") % 50
    dst = F.when(c("doc_id") % 3 == 0, text("dist/m", k, ".js")).when(c("doc_id") % 3 == 1, text("dist/gone", c("doc_id"), ".js")).otherwise(text("src/m", k, ".ts"))
    files = docs.select(text("src/m", k, ".ts").alias("file")).union(docs.where("doc_id % 5 = 0").select(text("src/m", k, ".tsx"))).distinct()
    outputs = rows(spark, [("dist", "src"), ("di", "other")], "out_dir string, source_dir string")
    return resolve.project_outputs(docs.select(node("u", "doc_id").alias("src"), dst.alias("dst")), outputs, files)


@query(f"SELECT DISTINCT {_PATH} AS path, 'src/' || lang || CASE WHEN lang = 'de' AND doc_id % 7 = 2 THEN '/2' ELSE '' END AS owner FROM documents WHERE lang IN ('de', 'fr')")
def generated_files(spark, d):
    return resolve.generated_boundary(_paths(spark, d), rows(spark, [("src/de",), ("src/de/2",), ("src/fr",), ("src/d",)], "folder string"))


@query("SELECT lang AS dir, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 ORDER BY n DESC, dir DESC NULLS LAST LIMIT 1")
def dominant_folder(spark, d):
    return resolve.dominant_folder(t(spark, d, "documents").select(text(c("lang"), "/x/", c("doc_id")).alias("path")))


@query("""
SELECT DISTINCT path, CASE WHEN lang = 'de' THEN '@de/' || (doc_id % 7) || '/x' || doc_id WHEN doc_id % 7 = 0 THEN '@/' || lang || '/0' ELSE '@/' || lang || '/' || (doc_id % 7) || '/x' || doc_id END AS specifier
FROM (SELECT *, CASE WHEN doc_id % 7 = 0 AND lang <> 'de' THEN 'src/' || lang || '/0/index.ts' ELSE 'src/' || lang || '/' || (doc_id % 7) || '/x' || doc_id || '.d.ts' END AS path FROM documents)""")
def path_aliases(spark, d):
    lang, k = c("lang"), c("doc_id") % 7
    path = F.when((k == 0) & (lang != "de"), text("src/", lang, "/0/index.ts")).otherwise(text("src/", lang, "/", k, "/x", c("doc_id"), ".d.ts"))
    aliases = rows(spark, [("@de/*", "src/de/*", 0), ("@/*", "src/*", 1), ("exact", "src/en/1/x1.ts", 2)], "alias string, target string, pos int")
    return resolve.path_alias(t(spark, d, "documents").select(path.alias("path")), aliases)


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/c/' || doc_id WHEN 1 THEN '/x' WHEN 2 THEN '../../' || doc_id ELSE 'a/b' END AS path,
 CASE WHEN doc_id % 3 = 0 THEN '@/a' WHEN doc_id % 3 = 1 THEN './ab' ELSE './abc' END AS specifier, greatest(0, ((doc_id % 100) / 100.0 - 0.5) * 2) > 0.5 AS sure FROM documents""")
def path_forms(spark, d):
    k, m = c("doc_id") % 4, c("doc_id") % 3
    raw = F.when(k == 0, text("a/./b/../c//", c("doc_id"))).when(k == 1, "/../x/.").when(k == 2, text("../a/../../", c("doc_id"))).otherwise("a\\b\\")
    alias = F.when(m == 0, "@/a").when(m == 1, "@/ab").otherwise(F.lit(None).cast("string"))
    relative = F.when(m == 0, "./a/b").when(m == 1, "./ab").otherwise("./abc")
    return t(spark, d, "documents").select("doc_id", S.normalise_path(raw).alias("path"), S.preferred_specifier(alias, relative, "shortest").alias("specifier"), (S.confidence((c("doc_id") % 100) / 100) > 0.5).alias("sure"))


#: The stems in turn, in a route below the root, in the root, in a package called app, and outside.
_STEMS = ["apple-icon", "default", "error", "forbidden", "global-error", "global-not-found", "icon", "layout", "loading", "manifest", "not-found", "opengraph-image", "page", "robots", "route", "sitemap", "template", "twitter-image", "unauthorized", "helper"]
_PLACES = ["src/app/shop/", "app/", "packages/app/", "src/lib/"]


@query(f"""
SELECT o_orderkey, CASE (o_orderkey // 20) % 4 WHEN 0 THEN s NOT IN ('forbidden', 'global-error', 'global-not-found', 'manifest', 'robots', 'unauthorized', 'helper') WHEN 1 THEN s <> 'helper' ELSE false END AS convention
FROM (SELECT o_orderkey, ({_STEMS!r})[o_orderkey % 20 + 1] AS s FROM orders)""")
def convention_stems(spark, d):
    stem = F.element_at(F.array(*[F.lit(s) for s in _STEMS]), (c("o_orderkey") % 20 + 1).cast("int"))
    place = F.element_at(F.array(*[F.lit(p) for p in _PLACES]), (F.floor(c("o_orderkey") / 20) % 4 + 1).cast("int"))
    return t(spark, d, "orders").select("o_orderkey", conventions.is_convention_file(text(place, stem, ".tsx")).alias("convention"))


@query(f"""
WITH x AS (SELECT s, CASE WHEN regexp_matches(s, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 1 ELSE 0 END AS k FROM (SELECT {CASED} AS s FROM part) WHERE NOT regexp_matches(s, '^[a-z0-9]+$') AND NOT starts_with(s, '_'))
SELECT CAST(sum(k) AS BIGINT) AS conforming, CAST(count(*) AS BIGINT) AS total, floor(CAST(sum(k) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS share FROM x""")
def conforming_names(spark, d):
    return naming.conforming_share(_cased(spark, d), "kebab-case")


@query("""
WITH e AS (SELECT 'o' || l_orderkey AS file, l_linenumber AS line, l_returnflag AS kind, CASE WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 0 WHEN l_partkey % 100 = l_orderkey % 100 THEN 1 ELSE 2 END AS r FROM lineitem),
b AS (SELECT file, kind FROM (SELECT *, min(r) OVER (PARTITION BY file) AS m, min(line) OVER (PARTITION BY file) AS l FROM e) WHERE r = m AND (r < 2 OR line = l))
SELECT file, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS export_kind FROM b GROUP BY 1""")
def primary_kinds(spark, d):
    kind = F.when((c("l_linestatus") == "F") & (c("l_linenumber") == 2), "default").otherwise("named")
    exports = t(spark, d, "lineitem").select(node("o", "l_orderkey").alias("file"), text("P", c("l_partkey") % 100).alias("name"), text("p", c("l_orderkey") % 100).alias("stem"), c("l_linenumber").alias("line"), c("l_returnflag").alias("kind"), kind.alias("export_type"))
    return naming.primary_export_kind(exports)


@query("SELECT p_partkey, (p_size % 3 = 0 AND p_partkey % 5 IN (0, 1)) OR (p_size % 3 = 1 AND p_partkey % 5 IN (2, 3)) AS fits FROM part")
def casing_justified(spark, d):
    case = F.when(c("p_size") % 3 == 0, "PascalCase").when(c("p_size") % 3 == 1, "camelCase").otherwise("kebab-case")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("class", "interface", "function", "type", "enum")]), (c("p_partkey") % 5 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", S.casing_fits_export(case, kind).alias("fits"))


# -- resolution and packages


def _resolved(spark, d):
    k = c("doc_id") % 4
    outcome = F.when(k < 2, "external").when(k == 2, "unresolvable").otherwise("resolved")
    specifier = F.when(k == 0, text("@s/p", c("n_chars") % 5, "/deep")).when(k == 1, text("lib", c("n_chars") % 5)).otherwise(text("./m", c("doc_id")))
    kind = F.when(c("doc_id") % 3 == 0, "import-named").when(c("doc_id") % 3 == 1, "export-all").otherwise("require")
    return t(spark, d, "documents").select(c("source").alias("src"), specifier.alias("specifier"), c("doc_id").alias("line"), c("doc_id").alias("seq"), kind.alias("ref_type"), outcome.alias("outcome"))


@query("""
WITH x AS (SELECT source AS src, CASE doc_id % 4 WHEN 0 THEN '@s/p' || (n_chars % 5) ELSE 'lib' || (n_chars % 5) END AS package, doc_id FROM documents WHERE doc_id % 4 < 2)
SELECT src, package, CASE WHEN starts_with(package, '@') THEN package || '/deep' ELSE package END AS specifier, min(doc_id) AS line FROM x GROUP BY 1, 2""")
def external_imports(spark, d):
    return resolve.external_imports(_resolved(spark, d))


@query("SELECT source AS src, './m' || doc_id AS specifier, doc_id AS line, 'Cannot find module ''./m' || doc_id || '''' AS message FROM documents WHERE doc_id % 4 = 2 AND doc_id % 3 <> 2")
def unresolvable_imports(spark, d):
    return resolve.unresolvable(_resolved(spark, d))


@query("""
SELECT DISTINCT o_orderkey AS id, 'C' || o_custkey AS src, 's' || (o_orderkey % 5) AS new_specifier FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderkey % 5 = c_custkey % 5 AND (o_orderkey % 7 = c_custkey % 7 OR o_orderkey % 7 = c_nationkey % 7)""")
def specifier_conflicts(spark, d):
    planned = t(spark, d, "orders").select(c("o_orderkey").alias("id"), node("C", "o_custkey").alias("src"), text("s", c("o_orderkey") % 5).alias("new_specifier"), bound(text("b", c("o_orderkey") % 7)).alias("bindings"))
    have = t(spark, d, "customer").select(node("C", "c_custkey").alias("src"), text("s", c("c_custkey") % 5).alias("specifier"), bound(text("b", c("c_custkey") % 7), text("b", c("c_nationkey") % 7)).alias("bindings"))
    return resolve.specifier_conflicts(planned, have).select("id", "src", "new_specifier")


@query("SELECT 'C' || o_custkey AS file, o_orderkey AS line FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND c_mktsegment = 'BUILDING'")
def binding_conflicts(spark, d):
    importers = t(spark, d, "orders").select(node("C", "o_custkey").alias("file"), c("o_orderkey").alias("line"), F.when(c("o_orderstatus") == "F", "z").alias("alias"))
    declared = t(spark, d, "customer").select(node("C", "c_custkey").alias("file"), c("c_mktsegment").alias("name"))
    return resolve.binding_conflicts(importers, declared, "BUILDING").select("file", "line")


@query("""
WITH s AS (SELECT 'p' || p_size AS package, min(CASE p_partkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' END || '^' || (p_partkey % 100)) AS k FROM part GROUP BY 1),
o AS (SELECT DISTINCT 'p' || (n_nationkey + 10) AS package FROM nation)
SELECT s.package, CASE WHEN o.package IS NOT NULL OR k[1] = '0' THEN 'dependencies' ELSE 'peerDependencies' END AS section, CASE WHEN o.package IS NOT NULL THEN 'workspace:*' ELSE k[2:] END AS specifier
FROM s LEFT JOIN o USING (package) WHERE s.package NOT IN (SELECT 'p' || r_regionkey FROM region) AND (o.package IS NOT NULL OR k IS NOT NULL)""")
def dependency_additions(spark, d):
    p, k = t(spark, d, "part"), c("p_partkey") % 3
    section = F.when(k == 0, "dependencies").when(k == 1, "peerDependencies").otherwise("devDependencies")
    source = p.select(node("p", "p_size").alias("name"), section.alias("section"), text("^", c("p_partkey") % 100).alias("specifier"))
    own = t(spark, d, "nation").select(text("p", c("n_nationkey") + 10).alias("name")).distinct()
    return impact.dependency_additions(p.select(node("p", "p_size").alias("package")), source, t(spark, d, "region").select(node("p", "r_regionkey").alias("name")), own)


@query("""
SELECT DISTINCT 'b' || l_suppkey AS barrel, 'x' || (l_partkey % 100) || CASE WHEN l_linenumber = 1 THEN '/index' ELSE '' END AS target, './k' || p_size AS key
FROM lineitem JOIN (SELECT DISTINCT p_size FROM part) ON l_partkey % 100 = p_size""")
def shadowed_barrels(spark, d):
    entries = t(spark, d, "lineitem").select(node("b", "l_suppkey").alias("barrel"), text("x", c("l_partkey") % 100, F.when(c("l_linenumber") == 1, "/index").otherwise("")).alias("target"))
    keys = t(spark, d, "part").select(text("./k", c("p_size")).alias("key"), text("x", c("p_size"), F.when(c("p_partkey") % 2 == 0, "/index").otherwise("")).alias("path"))
    return metrics.shadowed_barrels(entries, keys.union(keys.select(F.lit("./*"), "path")))


@query("SELECT DISTINCT 'b' || l_suppkey AS barrel, 'b' || (l_partkey % 100) AS target FROM lineitem WHERE l_partkey % 100 IN (SELECT l_suppkey FROM lineitem)")
def chained_barrels(spark, d):
    return metrics.chained_barrels(t(spark, d, "lineitem").select(node("b", "l_suppkey").alias("barrel"), text("b", c("l_partkey") % 100).alias("target")))


_TARGET = "CASE doc_id % 4 WHEN 0 THEN 'one/' WHEN 1 THEN 'two/' WHEN 2 THEN 'star/' ELSE 'none/' END || doc_id || '.ts'"


@query(f"""
SELECT {_TARGET} AS target, 'pk' || (doc_id % 3) || CASE doc_id % 4 WHEN 0 THEN '/one' || doc_id WHEN 1 THEN '/hub' WHEN 2 THEN '/s/' || doc_id ELSE '' END AS specifier FROM documents""")
def package_specifiers(spark, d):
    docs, pk, id_ = t(spark, d, "documents"), text("pk", c("doc_id") % 3), c("doc_id")
    targets = docs.select(pk.alias("package"), F.expr(_TARGET).alias("target"))
    packs = [f"pk{k}" for k in range(3)]
    fixed = rows(spark, [(p, *x) for p in packs for x in (("./hub", "hub.ts"), ("./a/hub2", "hub0.ts"), (".", "index.ts"), ("./s/*", "star/*.ts"))], "package string, key string, path string")
    named = docs.where("doc_id % 4 = 0").select(pk.alias("package"), text("./one", id_).alias("key"), F.expr(_TARGET).alias("path"))
    hubs = docs.where("doc_id % 4 = 1").select(F.lit("hub.ts").alias("barrel"), F.expr(_TARGET).alias("target"))
    hubs = hubs.union(hubs.select(F.lit("index.ts"), "target"))
    return resolve.package_specifier(targets, fixed.union(named), hubs, rows(spark, [(p,) for p in packs], "name string"))


_INLINE_SQL = """
WITH a AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'n' || (l_partkey % 5) AS name, l_linenumber = 7 AS space FROM lineitem),
have AS (SELECT DISTINCT 'o' || l_orderkey AS src FROM lineitem WHERE l_suppkey % 10 = 0),
b AS (SELECT *, CASE WHEN space THEN 'namespace' WHEN name = 'n2' THEN 'ambiguous' WHEN name = 'n4' THEN 'unknown' END AS reason, CASE name WHEN 'n0' THEN 'm0' WHEN 'n1' THEN 'm1' ELSE 'm2' END AS s FROM a)
SELECT src, 'hub' AS barrel, name, CASE WHEN reason IS NULL THEN s END AS source, CASE WHEN reason IS NULL THEN CASE name WHEN 'n0' THEN 'r0' ELSE name END END AS source_name,
 CASE WHEN reason IS NOT NULL THEN 'skipped-' || reason WHEN s = 'm0' AND src IN (SELECT src FROM have) THEN 'conflict' ELSE 'rewrite' END AS status FROM b"""


@query(_INLINE_SQL)
def inline_plans(spark, d):
    lines = t(spark, d, "lineitem")
    refs = lines.select(node("o", "l_orderkey").alias("src"), F.lit("hub").alias("dst"), F.when(c("l_linenumber") == 7, "import-namespace").otherwise("import-named").alias("ref_type"), bound(text("n", c("l_partkey") % 5)).alias("bindings"))
    refs = refs.union(lines.where("l_suppkey % 10 = 0").select(node("o", "l_orderkey"), F.lit("m0"), F.lit("import-named"), bound(F.lit("other"))))
    entries = rows(spark, [("hub", "m0", "named", "r0", "n0"), ("hub", "m1", "all", None, None), ("hub", "m2", "all", None, None)], "barrel string, target string, entry_type string, name string, alias string")
    exports = rows(spark, [("m1", "n1", "named"), ("m1", "n2", "named"), ("m2", "n2", "named"), ("m2", "n3", "named"), ("m2", "n0", "named")], "file string, name string, export_type string")
    return mutations.inline_plan(refs, entries, exports)


# -- contracts


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'workspace:^' || doc_id WHEN 1 THEN 'file:../c' WHEN 2 THEN 'workspace:~' ELSE '^3' END AS specifier FROM documents""")
def workspace_specifiers(spark, d):
    k = c("doc_id") % 4
    current = F.when(k == 0, text("workspace:^", c("doc_id"))).when(k == 3, "^3")
    used = F.when(k == 1, F.array(F.lit("file:../x"), F.lit("file:../y"))).when(k == 2, F.array(F.lit("workspace:*"), F.lit("link:x"))).otherwise(F.array().cast("array<string>"))
    source = F.when(k == 2, "workspace:~").otherwise("^1")
    return t(spark, d, "documents").select("doc_id", contracts.workspace_specifier(current, used, source, F.lit("a/b"), F.lit("a/c")).alias("specifier"))


@query("""
SELECT DISTINCT 'C' || o_custkey AS consumer, 'd' || (o_orderkey % 4) || '#build' AS task FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey >= 5 AND NOT (c_nationkey < 10 AND o_orderkey % 4 = 0)""")
def task_changes(spark, d):
    added = t(spark, d, "orders").select(node("C", "o_custkey").alias("consumer"), text("d", c("o_orderkey") % 4).alias("dep"))
    tasks = t(spark, d, "customer").where("c_nationkey < 10").select(node("C", "c_custkey").alias("consumer"), F.when(c("c_nationkey") < 5, "^build").otherwise("d0#build").alias("depends_on"))
    return contracts.task_changes(added, tasks)


@query("""
SELECT 'c' || c_custkey AS consumer, 'n' || c_nationkey AS dep, CASE WHEN c_nationkey % 5 = 0 THEN 'peerDependencies' ELSE 'dependencies' END AS section, CASE WHEN c_nationkey % 5 = 0 THEN '^new' ELSE '^old' END AS specifier FROM customer""")
def manifest_edits(spark, d):
    cust = t(spark, d, "customer")
    row = lambda w, s, v: cust.where(w).select(node("c", "c_custkey").alias("consumer"), node("n", "c_nationkey").alias("dep"), F.lit(s).alias("section"), F.lit(v).alias("specifier"))
    changed = "c_nationkey % 5 = 0"
    return contracts.apply_changes(row("true", "dependencies", "^old").union(row(changed, "devDependencies", "^older")), row(changed, "peerDependencies", "^new"))


@query("""
SELECT DISTINCT package, dep, code FROM (SELECT 'n' || n_nationkey AS package, CASE WHEN n_nationkey % 6 = 2 THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS dep,
 CASE n_nationkey % 6 WHEN 0 THEN 'invalid-section' WHEN 1 THEN 'missing-specifier' WHEN 2 THEN 'self-policy' END AS code FROM nation) WHERE code IS NOT NULL
UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'missing-provider' FROM nation WHERE n_nationkey % 6 = 3 AND n_regionkey > 2
UNION SELECT 'c' || c_custkey, 'n' || c_nationkey, 'missing-workspace-package' FROM customer WHERE c_custkey % 2 = 0""")
def contract_issues(spark, d):
    k = c("n_nationkey") % 6
    policies = t(spark, d, "nation").select(node("n", "n_nationkey").alias("package"), F.when(k == 2, node("n", "n_nationkey")).otherwise(node("r", "n_regionkey")).alias("dep"), F.when(k == 0, "others").otherwise("dependencies").alias("section"), F.when(k == 1, "").otherwise("^1").alias("specifier"), (k == 3).alias("include_closure"))
    deps = t(spark, d, "customer").select(node("c", "c_custkey").alias("consumer"), node("n", "c_nationkey").alias("provider"), F.when(c("c_custkey") % 2 == 0, "workspace:*").otherwise("^1").alias("specifier"))
    return contracts.issues(deps, policies, t(spark, d, "region").where("r_regionkey <= 2").select(node("r", "r_regionkey").alias("name")))


# -- layout


@query("""
SELECT 'x/f' || o_orderkey || '.ts' AS file, 'c' || o_custkey || '/m.ts' AS importer, 'c' || o_custkey || '/f' || o_orderkey || '.ts' AS target FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus <> 'P' AND o_orderkey % 5 <> 0""")
def single_importers(spark, d):
    o = t(spark, d, "orders")
    file, home = text("x/f", c("o_orderkey"), ".ts"), text("c", c("o_custkey"), "/m.ts")
    refs = o.select(home.alias("src"), file.alias("dst")).union(o.where("o_orderkey % 2 = 0").select(F.lit("z/extra.ts"), file))
    files = o.select(file.alias("file")).union(o.where("o_orderkey % 5 = 0").select(text("c", c("o_custkey"), "/f", c("o_orderkey"), ".ts")))
    return layout.single_importer(files, refs, o.where("o_orderstatus = 'P'").select(F.lit("hub.ts").alias("barrel"), file.alias("target")))


@query("""
SELECT 'x/f' || l_partkey || '.ts' AS file, CASE WHEN min(l_suppkey % 3) = max(l_suppkey % 3) THEN 'y/' || min(l_suppkey % 3) ELSE 'y' END AS suggested_dir, CAST(count(*) AS BIGINT) AS importer_count FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_partkey""")
def misplaced_files(spark, d):
    refs = t(spark, d, "lineitem").select(text("y/", c("l_suppkey") % 3, "/u", c("l_orderkey"), ".ts").alias("src"), text("x/f", c("l_partkey"), ".ts").alias("dst"))
    return layout.misplaced_files(t(spark, d, "part").select(text("x/f", c("p_partkey"), ".ts").alias("file")), refs)


@query("""
SELECT 'o' || l_orderkey || '.test.ts' AS test, 'b' || min(l_partkey % 9) AS dir, 'b' || min(l_partkey % 9) || '/__tests__/o' || l_orderkey || '.test.ts' AS suggested FROM lineitem GROUP BY l_orderkey HAVING min(l_partkey % 9) = max(l_partkey % 9)""")
def stranded_tests(spark, d):
    return layout.stranded_tests(layout.subject_weights(_tests(spark, d)), True)


@query("""
WITH w AS (SELECT 'o' || l_orderkey || '.test.ts' AS test, 'b' || (l_partkey % 9) || '/p' || l_partkey || '.ts' AS file, sum(greatest(1, l_linenumber - 1)) AS w FROM lineitem GROUP BY 1, 2)
SELECT test, file AS subject FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY w DESC, file) AS k FROM w) WHERE k = 1""")
def misnamed_tests(spark, d):
    return layout.misnamed_tests(layout.subject_weights(_tests(spark, d)))


@query("""
SELECT 'x/' || o_orderkey || '.ts' AS file, 'y' || (o_orderkey % 7) || '/' || o_orderkey || '.ts' AS target FROM orders
UNION ALL SELECT 'p' || p_partkey || '.test.ts', 't/p' || p_partkey || '.test.ts' FROM part""")
def relocations(spark, d):
    moved = t(spark, d, "orders").select(text("x/", c("o_orderkey"), ".ts").alias("file"), text("y", c("o_orderkey") % 7).alias("suggested_dir"))
    tests = t(spark, d, "part").select(text("p", c("p_partkey"), ".test.ts").alias("test"), text("t/p", c("p_partkey"), ".test.ts").alias("suggested"))
    return tidy.relocations(moved, tests.union(moved.select("file", F.lit("elsewhere"))))


# -- likeness


@query("SELECT doc_id, CASE WHEN doc_id % 100 >= 85 THEN 'duplicate' WHEN doc_id % 100 >= 70 THEN 'similar' WHEN doc_id % 100 = 7 THEN 'not-comparable' ELSE 'different' END AS relation FROM documents")
def compared_pairs(spark, d):
    score = F.when(c("doc_id") % 100 != 7, (c("doc_id") % 100) / 100.0)
    return similarity.compare_pair(t(spark, d, "documents").select("doc_id", score.alias("score"))).drop("score")


@query("""
WITH m AS (SELECT o_custkey AS g, o_orderkey AS m, o_orderkey % 20 AS f, o_orderkey % 3 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderkey) AS k FROM orders)
SELECT a.g AS group_id, a.m AS canonical, b.m AS duplicate FROM m a JOIN m b ON a.g = b.g AND a.k = 1 AND b.k > 1 WHERE NOT (a.f = b.f AND a.n <> b.n)""")
def canonical_members(spark, d):
    o = t(spark, d, "orders")
    declared = o.select(c("o_orderkey").alias("decl_id"), text("f", c("o_orderkey") % 20).alias("file"), text("n", c("o_orderkey") % 3).alias("name"), (c("o_orderstatus") == "F").alias("is_exported"))
    return similarity.canonical_members(o.select(c("o_custkey").alias("group_id"), c("o_orderkey").alias("member_id")), declared)


# -- changes


@query("""
SELECT conv_id || ':' || turn AS file, 2 AS start, CAST(3 + length(CAST(conv_id AS VARCHAR)) AS INTEGER) AS "end", conv_id || chr(10) AS old_text, turn || chr(10) AS new_text FROM conversations WHERE conv_id <> turn""")
def structured_edits(spark, d):
    pairs = t(spark, d, "conversations").select(text(c("conv_id"), ":", c("turn")).alias("file"), text("h\n", c("conv_id"), "\nt").alias("before"), text("h\n", c("turn"), "\nt").alias("after"))
    return edits.structured_edits(pairs)


@query("""
WITH e AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS n, o_orderkey % 4 AS m FROM orders),
b AS (SELECT *, coalesce(sum(2 * n - m) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e)
SELECT 'c' || o_custkey AS file, CAST(10 * o_orderkey + g AS INTEGER) AS start, CAST(10 * o_orderkey + g + 2 * n AS INTEGER) AS "end", repeat('😀', CAST(n AS BIGINT)) AS old_text, 'q' AS new_text FROM b""")
def inverse_edits(spark, d):
    at = (c("o_orderkey") * 10).cast("int")
    made = t(spark, d, "orders").select(node("c", "o_custkey").alias("file"), at.alias("start"), (at + (c("o_orderkey") % 4).cast("int")).alias("end"), F.repeat(F.lit("😀"), (c("o_orderkey") % 5).cast("int")).alias("new_text"), F.lit("q").alias("old_text"))
    return edits.inverse(made)


def _moved(spark, d):
    return t(spark, d, "customer").select(text("a/c", c("c_custkey"), ".ts").alias("old"), text("b/c", c("c_custkey"), ".ts").alias("new"))


def _uses(spark, d):
    importer = F.when(c("o_orderkey") % 3 == 0, text("b/o", c("o_orderkey"), ".ts")).otherwise(text("u/o", c("o_orderkey"), ".ts"))
    return t(spark, d, "orders").select(importer.alias("src"), text("a/c", c("o_custkey"), ".ts").alias("dst"), text("../a/c", c("o_custkey")).alias("specifier"), F.lit("import-named").alias("ref_type"), (c("o_orderkey") % 11).cast("int").alias("line"), F.lit(None).cast(BINDINGS).alias("bindings"), c("o_orderkey").alias("seq"))


_NO_HUBS = "barrel string, target string, entry_type string, name string, alias string, specifier string"


@query("""
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'b/o' ELSE 'u/o' END || o_orderkey || '.ts' AS file, CAST(o_orderkey % 11 AS INTEGER) AS line, '../a/c' || o_custkey AS old_specifier, CASE WHEN o_orderkey % 3 = 0 THEN './c' ELSE '../b/c' END || o_custkey AS new_specifier FROM orders""")
def move_rewrites(spark, d):
    """Moves inside one package."""
    moves, refs = _moved(spark, d), _uses(spark, d)
    home = moves.select(c("old").alias("file")).union(moves.select("new")).union(refs.select("src")).distinct().withColumn("package", F.lit("p"))
    return mutations.move_rewrites(moves, refs, rows(spark, [], _NO_HUBS), home).drop("through")


@query("""
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'b/o' ELSE 'u/o' END || o_orderkey || '.ts' AS file, CAST(o_orderkey % 11 AS INTEGER) AS line, '../a/c' || o_custkey AS old_specifier,
 CASE WHEN o_orderkey % 3 = 0 THEN './c' || o_custkey WHEN o_custkey % 2 = 0 THEN 'pb/c/c' || o_custkey ELSE 'pb' END AS new_specifier FROM orders""")
def move_rewrites_across(spark, d):
    """Moves from package pa to pb: importers in pb take relative paths, others a sub-path of pb that has the file, or its name."""
    moves, refs = _moved(spark, d), _uses(spark, d)
    files = moves.select(c("old").alias("file")).union(moves.select("new")).union(refs.select("src")).distinct()
    home = files.withColumn("package", F.when(c("file").startswith("a/"), "pa").when(c("file").startswith("b/"), "pb").otherwise("pu"))
    even = t(spark, d, "customer").where("c_custkey % 2 = 0")
    keys = even.select(F.lit("pb").alias("package"), text("./c/c", c("c_custkey")).alias("key"), text("b/c", c("c_custkey"), ".ts").alias("path"))
    return mutations.move_rewrites(moves, refs, rows(spark, [], _NO_HUBS), home, subpaths=keys).drop("through")


@query("""
SELECT 'a/h' || c_nationkey || '.ts' AS barrel, 're-point' AS action, 'b/c' || c_custkey || '.ts' AS target, '../b/c' || c_custkey AS specifier FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT 'z/h' || c_nationkey || '.ts', 'remove', 'a/c' || c_custkey || '.ts', NULL FROM customer WHERE c_nationkey % 2 = 1
UNION ALL SELECT 'b/index.ts', 'add', 'b/c' || c_custkey || '.ts', './c' || c_custkey FROM customer""")
def hub_updates(spark, d):
    moves, cust = _moved(spark, d), t(spark, d, "customer")
    hub = text(F.when(c("c_nationkey") % 2 == 0, "a/h").otherwise("z/h"), c("c_nationkey"), ".ts")
    entries = cust.select(hub.alias("barrel"), text("a/c", c("c_custkey"), ".ts").alias("target"))
    files = moves.select(c("new").alias("file")).union(entries.select("barrel")).distinct()
    home = files.withColumn("package", F.when(c("file").startswith("z/"), "q").otherwise("p"))
    return mutations.hub_updates(moves, entries, home, rows(spark, [("p", "b/index.ts")], "package string, barrel string"))


@query("""
SELECT 'o' || o_orderkey AS src, 'h' || (o_custkey % 10) AS dst, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'x,y' END AS moved, CASE WHEN o_orderkey % 3 = 0 THEN 'z' ELSE '' END AS remaining FROM orders WHERE o_custkey % 10 < 5""")
def split_bindings(spark, d):
    names = F.when(c("o_orderkey") % 3 == 0, bound(F.lit("x"), F.lit("z"))).otherwise(bound(F.lit("x"), F.lit("y")))
    refs = t(spark, d, "orders").select(node("o", "o_orderkey").alias("src"), text("h", c("o_custkey") % 10).alias("dst"), F.lit(1).alias("line"), names.alias("bindings"))
    moved = rows(spark, [(f"h{k}", n) for k in range(5) for n in "xy"], "dst string, name string")
    return mutations.split_bindings(refs, moved).select("src", "dst", F.array_join("moved.name", ",").alias("moved"), F.array_join("remaining.name", ",").alias("remaining"))


@query("SELECT DISTINCT 'n' || c_nationkey AS package, c_nationkey < 10 AS internal FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey <> 3")
def moved_dependencies(spark, d):
    used = t(spark, d, "customer").select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("package"))
    moves = t(spark, d, "orders").select(node("c", "o_custkey").alias("old"))
    own = t(spark, d, "nation").where("n_nationkey < 10").select(node("n", "n_nationkey").alias("name"))
    inside, outside = mutations.cross_package_dependencies(moves, used, own, "n3")
    return inside.withColumn("internal", F.lit(True)).union(outside.withColumn("internal", F.lit(False)))


@query("""
SELECT 'a/c' || c_custkey || '.ts' AS old, 'b/c' || (c_custkey - c_custkey % 2) || '.ts' AS new, 'target-twice' AS error FROM customer WHERE (c_custkey - c_custkey % 2) IN (SELECT c_custkey - c_custkey % 2 FROM customer GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'a/c' || c_custkey || '.ts', 'b/c' || (c_custkey - c_custkey % 2) || '.ts', 'source-missing' FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'a/c' || c_custkey || '.ts', 'b/c' || (c_custkey - c_custkey % 2) || '.ts', 'restricted-dependency' FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def move_guards(spark, d):
    cust = t(spark, d, "customer")
    old, new = text("a/c", c("c_custkey"), ".ts"), text("b/c", c("c_custkey") - c("c_custkey") % 2, ".ts")
    moves = cust.select(old.alias("old"), new.alias("new"))
    return mutations.move_guards(moves, cust.where("c_nationkey <> 3").select(old.alias("file")), cust.where("c_mktsegment = 'MACHINERY'").select(old.alias("old")))


@query("""
WITH m AS (SELECT 'o' || o_orderkey AS file, o_orderkey AS line, o_orderstatus = 'F' AS aliased FROM orders)
SELECT file, CAST(line AS INTEGER) AS line, CASE WHEN aliased THEN 'import-aliased' ELSE 'import' END AS kind FROM m UNION ALL SELECT 'm', 1, 'declaration'""")
def rename_edits(spark, d):
    alias = F.when(c("o_orderstatus") == "F", "z")
    names = F.array(F.struct(F.lit("old").alias("name"), alias.alias("alias"), F.lit(False).alias("is_type")))
    refs = t(spark, d, "orders").select(node("o", "o_orderkey").alias("src"), F.lit("m").alias("dst"), F.lit("./m").alias("specifier"), c("o_orderkey").cast("int").alias("line"), names.alias("bindings"), c("o_orderkey").alias("seq"))
    exports = rows(spark, [("m", "old", 1), ("m", "other", 2)], "file string, name string, line int")
    return mutations.rename_plan("m", "old", "fresh", exports, refs, rows(spark, [("o1", "busy")], "file string, name string"), rows(spark, [], "barrel string, target string"))[0]


@query("""
SELECT 'u/o' || o_orderkey || '.ts' AS file, o_orderkey AS line, '../a/c' || o_custkey || '.js' AS old_specifier, CASE WHEN o_custkey % 2 = 0 THEN '@c' || o_custkey ELSE '../a/c' || o_custkey END AS new_specifier, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'conflict' ELSE 'rewrite' END AS status FROM orders""")
def normalised_specifiers(spark, d):
    o = t(spark, d, "orders")
    src, x = text("u/o", c("o_orderkey"), ".ts"), bound(F.lit("x"))
    refs = o.select(src.alias("src"), text("a/c", c("o_custkey"), ".ts").alias("dst"), text("../a/c", c("o_custkey"), ".js").alias("specifier"), c("o_orderkey").alias("line"), x.alias("bindings"))
    refs = refs.union(o.where("o_orderstatus = 'F'").select(src, F.lit(None).cast("string"), text("@c", c("o_custkey")), F.lit(0), x))
    aliases = t(spark, d, "customer").where("c_custkey % 2 = 0").select(text("a/c", c("c_custkey"), ".ts").alias("path"), text("@c", c("c_custkey")).alias("specifier"))
    return mutations.normalise_specifiers(refs, aliases, "alias")


@query("""
SELECT 'o' || o_orderkey AS file, o_orderkey AS line, CASE WHEN o_orderkey % 3 = 0 THEN './c' ELSE '@/c' END || o_custkey AS old_specifier, 'new' || o_custkey AS new_specifier, CASE WHEN o_orderstatus = 'F' THEN 'conflict' ELSE 'rewrite' END AS status
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)""")
def renamed_specifiers(spark, d):
    o = t(spark, d, "orders")
    refs = o.select(node("o", "o_orderkey").alias("src"), F.when(c("o_orderkey") % 3 == 0, text("./c", c("o_custkey"))).otherwise(text("@/c", c("o_custkey"))).alias("specifier"), node("m", "o_custkey").alias("dst"), c("o_orderkey").alias("line"))
    refs = refs.union(o.where("o_orderstatus = 'F'").select(node("o", "o_orderkey"), node("new", "o_custkey"), F.lit(None).cast("string"), F.lit(0)))
    pairs = t(spark, d, "customer").select(text("./c", c("c_custkey")).alias("old"), node("new", "c_custkey").alias("new"))
    return mutations.rename_specifiers(refs, pairs)


@query("""
WITH u AS (SELECT DISTINCT l_orderkey AS o, 'p' || (l_partkey % 30) AS n FROM lineitem), l AS (SELECT DISTINCT l_orderkey AS o, 'p' || (l_suppkey % 30) AS n FROM lineitem)
SELECT o AS decl_id, string_agg(n, ',' ORDER BY n) AS names FROM (SELECT * FROM u EXCEPT SELECT * FROM l) WHERE n NOT IN ('p1', 'p2') AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = o AND ('p' || (o_custkey % 30) = n OR 'p' || (o_custkey % 7) = n)) GROUP BY 1""")
def captured_names(spark, d):
    lines, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    used, local = (lines.select(c("l_orderkey").alias("decl_id"), text("p", c(k) % 30).alias("name")) for k in ("l_partkey", "l_suppkey"))
    module = o.select(c("o_orderkey").alias("decl_id"), text("p", c("o_custkey") % 30).alias("name")).union(o.select("o_orderkey", text("p", c("o_custkey") % 7)))
    return mutations.captured_names(used, local, module, ("p1", "p2")).select("decl_id", F.array_join("names", ",").alias("names"))


@query("""
SELECT 'v' || c_nationkey AS name, CASE WHEN c_nationkey < 5 THEN 'bound' WHEN c_nationkey < 10 THEN 'module' WHEN c_nationkey < 15 THEN 'prop' ELSE 'blocked' END AS role FROM customer WHERE c_custkey BETWEEN 10 AND 1000 GROUP BY c_nationkey""")
def free_variables(spark, d):
    n = c("n_nationkey")
    declared = t(spark, d, "nation").select(node("v", "n_nationkey").alias("name"), F.when(n < 5, 20).otherwise(0).alias("start"), F.when(n < 5, 30).otherwise(9999).alias("end"), F.when(n < 5, "inner").when(n < 10, "module").otherwise("owner").alias("level"), (n >= 15).alias("from_hook"))
    return mutations.free_variables(t(spark, d, "customer").select(node("v", "c_nationkey").alias("name"), c("c_custkey").alias("at")), declared, (10, 1000))


@query("""
SELECT 'o' || l_orderkey AS file, CAST(l_linenumber AS INTEGER) AS line, CASE WHEN l_linenumber % 2 = 1 THEN 'x.y' ELSE 'x.y.z' END AS "from", CASE WHEN l_linenumber % 2 = 1 THEN 'A' ELSE 'B' END AS "to"
FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber = m""")
def transform_matches(spark, d):
    n = c("l_linenumber").cast("int")
    found = t(spark, d, "lineitem").select(node("o", "l_orderkey").alias("file"), n.alias("start"), (F.lit(20) - n).alias("end"), n.alias("line"), F.when(n % 2 == 1, "x . y").otherwise("x.y .z").alias("text"))
    return mutations.transform_matches(found, rows(spark, [("x.y", "A"), ("x.y.z", "B")], "from string, to string")).select("file", "line", "from", "to")


@query("SELECT o_clerk AS file FROM (SELECT 'o' || o_custkey AS o_clerk, bool_and(o_orderstatus <> 'P') AS p FROM orders GROUP BY 1) WHERE p")
def pure_hubs(spark, d):
    return mutations.pure_hubs(t(spark, d, "orders").select(node("o", "o_custkey").alias("file"), F.when(c("o_orderstatus") == "P", "other").otherwise("re-export").alias("kind")))


@query("""
SELECT 'p' || p_partkey AS path, CASE WHEN p_size % 4 = 1 THEN 'missing' ELSE 'changed' END AS reason FROM part WHERE p_size % 4 IN (1, 2)
UNION ALL SELECT '../p' || p_partkey, 'outside' FROM part WHERE p_size % 4 = 3""")
def undo_conflicts(spark, d):
    p, k = t(spark, d, "part"), c("p_size") % 4
    path = text(F.when(k == 3, "../p").otherwise("p"), c("p_partkey"))
    entry = p.select(F.array(F.struct(path.alias("path"), F.sha2(c("p_name"), 256).alias("sha256"))).alias("modified"))
    return journal.undo_conflicts(entry, p.where(k != 1).select(path.alias("path"), F.when(k == 2, F.lit("other")).otherwise(c("p_name")).alias("content")))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'now' WHEN p_size % 3 = 0 THEN 'then' END AS undone_at FROM part")
def marked_undone(spark, d):
    kept = t(spark, d, "part").select(c("p_partkey").alias("id"), F.when((c("p_size") % 2 == 1) & (c("p_size") % 3 == 0), "then").alias("undone_at"), "p_size")
    return journal.mark_undone(kept, kept.where("p_size % 2 = 0"), "now").select("id", "undone_at")


@query("SELECT 'p' || p_partkey AS path FROM part WHERE p_size % 3 = 2")
def unrelated_changes(spark, d):
    p, path, k = t(spark, d, "part"), node("p", "p_partkey"), c("p_size") % 3
    entry = p.where(k < 2).select(F.when(k == 0, F.array(F.struct(path.alias("path")))).otherwise(F.array().cast("array<struct<path:string>>")).alias("modified"), F.when(k == 1, F.array(F.struct(path.alias("new")))).otherwise(F.array().cast("array<struct<new:string>>")).alias("moved"))
    return journal.unrelated_changes(entry, p.select(path.alias("path")))
