"""Registered queries: operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contracts, conventions, diagnostics, edits, find, graph, impact, journal, layout, liveness, metrics, naming, resolve, setops, similarity, tidy
from ..sources import tables
from ..sources.tables import read_table
from .adapters import ITEM_EDGES_SQL, KEY_EDGES_SQL, event_steps, key_edges, node
from .tables import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


METRICS_SQL = f"""
WITH e AS (SELECT DISTINCT src, dst FROM ({ITEM_EDGES_SQL})),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
o AS (SELECT src AS node, count(*) AS fan_out FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY 1)
SELECT node, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in,
 floor(coalesce(CAST(coalesce(fan_out, 0) AS DOUBLE) / nullif(coalesce(fan_in, 0) + coalesce(fan_out, 0), 0), 0) * 100 + 0.5) / 100 AS instability
FROM n LEFT JOIN o USING (node) LEFT JOIN i USING (node)"""


# -- metrics


@query(METRICS_SQL)
def metrics_fan_in_out(spark, d):
    return metrics.coupling(key_edges(spark, d))


@query(f"SELECT * FROM ({METRICS_SQL}) WHERE fan_out > 10 OR fan_in > 10")
def threshold_hubs(spark, d):
    return metrics.over_thresholds(metrics.coupling(key_edges(spark, d)))


@query("""
SELECT CAST(user_id AS VARCHAR) AS barrel, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT event_id % 7) AS BIGINT) AS sources,
 CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS wildcard, CAST(count(*) FILTER (event_type IN ('view', 'purchase')) AS BIGINT) AS named,
 CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS namespaces, CAST(count(*) FILTER (value > 50) AS BIGINT) AS consumers
FROM events GROUP BY user_id""")
def barrel_counts(spark, d):
    e = read_table(spark, d, "events").withColumn("barrel", F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "click", "all").when(F.col("event_type").isin("view", "purchase"), "named").when(F.col("event_type") == "signup", "namespace").otherwise("other")
    entries = e.select("barrel", (F.col("event_id") % 7).cast("string").alias("target"), kind.alias("entry_type"))
    return metrics.barrel_report(entries, e.where("value > 50").select(F.col("barrel").alias("dst")))


# -- reachability


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({KEY_EDGES_SQL})),
r(node, depth) AS (SELECT 'R0', 0 UNION SELECT e.src, r.depth + 1 FROM e JOIN r ON e.dst = r.node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def affected_region(spark, d):
    return graph.closure(key_edges(spark, d, items=False), spark.createDataFrame([("R0",)], "node string"), reverse=True)


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({ITEM_EDGES_SQL})),
r(node, depth) AS (SELECT 'O' || min(o_orderkey), 0 FROM orders UNION SELECT e.dst, r.depth + 1 FROM e JOIN r ON e.src = r.node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def forward_reach(spark, d):
    edges = key_edges(spark, d)
    files = edges.select(F.col("src").alias("file")).union(edges.select("dst")).distinct()
    root = read_table(spark, d, "orders").agg(F.min("o_orderkey").alias("o_orderkey")).select(node("O", "o_orderkey").alias("node"))
    return graph.forward_reach(edges, root, files)


STEPS_SQL = """SELECT 'e' || (event_id % 97) AS src, 'e' || (next % 97) AS dst FROM
 (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL"""


@query(f"""
WITH RECURSIVE s AS ({STEPS_SQL}), e AS (SELECT src, dst FROM s GROUP BY 1, 2 HAVING count(*) >= 3),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, least(node, coalesce(m, node)) AS component FROM n LEFT JOIN (SELECT x.a AS node, min(x.b) AS m FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1) USING (node)""")
def scc_event_flow(spark, d):
    steps = event_steps(spark, d).groupBy("src", "dst").count().where("count >= 3")
    return graph.strong_components(steps)


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({KEY_EDGES_SQL})),
t AS (SELECT 'R' || r_regionkey AS file FROM region),
r(file, head, chain, n) AS (SELECT file, file, [file], 1 FROM t UNION ALL SELECT r.file, e.src, list_prepend(e.src, r.chain), n + 1 FROM r JOIN e ON e.dst = r.head),
dead AS (SELECT src AS head FROM e EXCEPT SELECT dst FROM e),
c AS (SELECT file, n, array_to_string(chain, '>') AS chain, row_number() OVER (PARTITION BY file ORDER BY n, chain) AS k FROM r JOIN dead USING (head) WHERE n > 1)
SELECT t.file, coalesce(c.chain, t.file) AS chain FROM t LEFT JOIN c ON c.file = t.file AND k = 1""")
def dead_chain(spark, d):
    edges = key_edges(spark, d, items=False).distinct()
    importers = edges.select(F.col("dst").alias("file"), F.col("src").alias("importer"))
    dead = edges.select(F.col("src").alias("node")).subtract(edges.select("dst"))
    targets = read_table(spark, d, "region").select(node("R", "r_regionkey").alias("node"))
    return graph.dead_chains(importers, targets, dead).select("file", F.array_join("chain", ">").alias("chain"))


@query("""
WITH RECURSIVE b AS (SELECT 'R' || n_regionkey AS barrel, 'N' || n_nationkey AS target, n_nationkey % 3 = 0 AS star, n_name AS as_name FROM nation),
x AS (SELECT 'N' || n_nationkey AS file, n_name AS name FROM nation UNION ALL SELECT 'N' || n_nationkey, 'default' FROM nation),
e AS (SELECT barrel AS sf, as_name AS sn, target AS df, 'default' AS dn FROM b WHERE NOT star UNION SELECT b.barrel, x.name, b.target, x.name FROM b JOIN x ON x.file = b.target WHERE b.star AND x.name <> 'default'),
s AS (SELECT DISTINCT sf AS file, sn AS name FROM e)
SELECT file, name FROM s UNION SELECT df, dn FROM e""")
def public_api_states(spark, d):
    n = read_table(spark, d, "nation")
    star = F.col("n_nationkey") % 3 == 0
    entries = n.select(node("R", "n_regionkey").alias("barrel"), node("N", "n_nationkey").alias("target"), F.when(star, "all").otherwise("default").alias("entry_type"), F.when(~star, "default").alias("name"), F.when(~star, F.col("n_name")).alias("alias"), F.lit("x").alias("specifier"))
    exports = n.select(node("N", "n_nationkey").alias("file"), F.col("n_name").alias("name")).union(n.select(node("N", "n_nationkey"), F.lit("default")))
    return graph.public_names(read_table(spark, d, "region").select(node("R", "r_regionkey").alias("node")), entries, exports)


REFS_SQL = """SELECT 'O' || o_orderkey AS src, 'C' || o_custkey AS dst, 's' || (o_orderkey % 5) AS specifier, o_orderkey % 11 AS line, o_orderkey AS seq FROM orders
 UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 's' || (c_custkey % 5), c_custkey % 11, c_custkey FROM customer"""


def _refs(spark, d):
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    refs = o.select(node("O", "o_orderkey").alias("src"), node("C", "o_custkey").alias("dst"), F.concat(F.lit("s"), F.col("o_orderkey") % 5).alias("specifier"), (F.col("o_orderkey") % 11).cast("bigint").alias("line"), F.col("o_orderkey").alias("seq"))
    return refs.union(c.select(node("C", "c_custkey"), node("N", "c_nationkey"), F.concat(F.lit("s"), F.col("c_custkey") % 5), (F.col("c_custkey") % 11).cast("bigint"), F.col("c_custkey")))


def _hubs(spark, d):
    """Nations pass on customers, and regions nations."""
    c, n = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    return c.select(node("N", "c_nationkey").alias("barrel"), node("C", "c_custkey").alias("target")).union(n.select(node("R", "n_regionkey"), node("N", "n_nationkey")))


HUBS_SQL = "SELECT 'N' || c_nationkey AS barrel, 'C' || c_custkey AS target FROM customer UNION SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation"


@query(f"""
WITH RECURSIVE h AS ({HUBS_SQL}), r(target, node) AS (SELECT 'C' || c_custkey, 'C' || c_custkey FROM customer UNION SELECT r.target, h.barrel FROM r JOIN h ON h.target = r.node)
SELECT target, node FROM r""")
def reexporter_closure(spark, d):
    targets = read_table(spark, d, "customer").select(node("C", "c_custkey").alias("node"))
    return graph.reexporter_closure(_hubs(spark, d), targets)


@query(f"""
WITH RECURSIVE h AS ({HUBS_SQL}), f AS ({REFS_SQL}),
r(target, node) AS (SELECT 'C' || c_custkey, 'C' || c_custkey FROM customer UNION SELECT r.target, h.barrel FROM r JOIN h ON h.target = r.node),
u AS (SELECT r.target, f.src, f.specifier, f.line, f.seq, CASE WHEN r.node <> r.target THEN r.node END AS through FROM f JOIN r ON f.dst = r.node),
k AS (SELECT *, row_number() OVER (PARTITION BY target, src, specifier, line ORDER BY CASE WHEN through IS NULL THEN 0 ELSE 1 END, seq) AS k FROM u)
SELECT target AS dst, src, specifier, CAST(line AS BIGINT) AS line, through FROM k WHERE k = 1""")
def all_references(spark, d):
    targets = read_table(spark, d, "customer").select(node("C", "c_custkey").alias("node"))
    return graph.all_references(_refs(spark, d), _hubs(spark, d), targets).select("dst", "src", "specifier", "line", "through")


@query(f"""
WITH RECURSIVE h AS ({HUBS_SQL}), f AS ({REFS_SQL}),
t AS (SELECT DISTINCT dst AS node FROM f UNION SELECT target FROM h),
r(target, node) AS (SELECT node, node FROM t UNION SELECT r.target, h.barrel FROM r JOIN h ON h.target = r.node),
e AS (SELECT DISTINCT f.src, r.target AS dst FROM f JOIN r ON f.dst = r.node),
a(node) AS (SELECT 'C20' UNION SELECT e.src FROM a JOIN e ON e.dst = a.node)
SELECT node FROM a""")
def affected_through_hubs(spark, d):
    return graph.affected(_refs(spark, d), _hubs(spark, d), spark.createDataFrame([("C20",)], "node string")).select("node")


# -- liveness


@query("""
WITH used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01')
SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM used) AND p_size <> 1""")
def unused_parts(spark, d):
    part = read_table(spark, d, "part")
    lines = read_table(spark, d, "lineitem").where("l_returnflag = 'R' and l_shipdate >= timestamp '1998-01-01' and l_shipdate < timestamp '1999-01-01'")
    exports = part.select(F.col("p_brand").alias("file"), F.col("p_partkey").cast("string").alias("name"), F.lit("named").alias("export_type"), "p_partkey", "p_brand", "p_size")
    owner = part.select("p_partkey", F.col("p_brand").alias("dst"))
    binding = F.array(F.struct(F.col("l_partkey").cast("string").alias("name"), F.lit(None).cast("string").alias("alias"), F.lit(False).alias("is_type")))
    refs = lines.select("l_partkey").distinct().join(owner, F.col("l_partkey") == F.col("p_partkey")).select("dst", F.lit("import-named").alias("ref_type"), binding.alias("bindings"))
    return liveness.split_exports(exports, refs).where("not used and p_size <> 1").select("p_partkey", "p_brand")


@query("""
WITH used AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1996-01-01')
SELECT 'C' || c_custkey AS file, NOT (c_nationkey < 12) AS self_contained FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM used) AND c_mktsegment <> 'BUILDING'""")
def orphans_self_contained(spark, d):
    c = read_table(spark, d, "customer")
    o = read_table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate < timestamp '1996-01-01'")
    files = c.select(node("C", "c_custkey").alias("file")).union(read_table(spark, d, "nation").select(node("N", "n_nationkey")))
    exports = c.select(node("C", "c_custkey").alias("file"))
    refs = o.select(node("O", "o_orderkey").alias("src"), node("C", "o_custkey").alias("dst"), F.lit("a").alias("specifier"), F.lit(1).alias("line"), F.lit("import-named").alias("ref_type"), F.col("o_orderkey").alias("seq"))
    refs = refs.union(c.where("c_nationkey < 12").select(node("C", "c_custkey"), node("N", "c_nationkey"), F.lit("b"), F.lit(1), F.lit("import-named"), F.col("c_custkey")))
    hubs = spark.createDataFrame([], "barrel string, target string")
    exempt = c.where("c_mktsegment = 'BUILDING'").select(node("C", "c_custkey").alias("node"))
    return liveness.orphan_files(files, exports, refs, hubs, exempt)


@query("""
WITH x AS (SELECT DISTINCT l_suppkey AS s, CAST(l_partkey % 997 AS VARCHAR) AS k FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT 's' || l_suppkey AS target, 'o' || l_orderkey AS mock_file, CAST(l_partkey % 997 AS VARCHAR) AS key, CAST(l_linenumber AS INTEGER) AS line
FROM lineitem WHERE l_linenumber % 2 = 0 AND l_suppkey IN (SELECT s FROM x) AND NOT EXISTS (SELECT 1 FROM x WHERE s = l_suppkey AND k = CAST(l_partkey % 997 AS VARCHAR))""")
def mock_orphans(spark, d):
    """Odd lines export, even lines mock."""
    lines = read_table(spark, d, "lineitem")
    key = (F.col("l_partkey") % 997).cast("string")
    exports = lines.where("l_linenumber % 2 = 1").select(node("s", "l_suppkey").alias("file"), key.alias("name"), F.lit("named").alias("export_type")).distinct()
    entries = lines.where("l_linenumber % 2 = 0").select(node("s", "l_suppkey").alias("target"), node("o", "l_orderkey").alias("mock_file"), key.alias("key"), F.col("l_linenumber").cast("int").alias("line"))
    return liveness.mock_orphans(entries, exports)


VERDICTS_SQL = """
WITH x AS (SELECT 'C' || c_custkey AS file, c_mktsegment AS name, c_custkey % 13 = 0 AS assumed, c_custkey % 7 = 0 AS public FROM customer),
u AS (SELECT DISTINCT 'C' || o_custkey AS file FROM orders WHERE o_orderkey % 4 = 0),
live AS (SELECT DISTINCT 'C' || o_custkey AS file FROM orders WHERE o_orderstatus = 'F')
SELECT x.file, x.name, CASE WHEN assumed THEN 'assumed-used' WHEN public THEN 'public' WHEN u.file IS NULL THEN 'unused' WHEN live.file IS NOT NULL THEN 'used' ELSE 'transitively-dead' END AS verdict
FROM x LEFT JOIN u ON u.file = x.file LEFT JOIN live ON live.file = x.file"""


@query(VERDICTS_SQL)
def export_verdicts(spark, d):
    """Every order imports its customer, one in four for its names and the others for side effects."""
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders")
    exports = c.select(node("C", "c_custkey").alias("file"), F.col("c_mktsegment").alias("name"), F.lit("named").alias("export_type"))
    refs = o.select(node("O", "o_orderkey").alias("src"), node("C", "o_custkey").alias("dst"), F.when(F.col("o_orderkey") % 4 == 0, "import-namespace").otherwise("import-side-effect").alias("ref_type"), F.lit(None).cast("array<struct<name:string,alias:string,is_type:boolean>>").alias("bindings"))
    files = exports.select("file").union(refs.select("src"))
    roots = o.where("o_orderstatus = 'F'").select(node("O", "o_orderkey").alias("node"))
    public = exports.join(c.where("c_custkey % 7 = 0").select(node("C", "c_custkey").alias("file")), "file", "left_semi")
    assumed = c.where("c_custkey % 13 = 0").select(node("C", "c_custkey").alias("node"))
    return liveness.verdicts(exports, refs, files, roots, public=public, assumed=assumed).select("file", "name", "verdict")


@query(f"SELECT verdict AS kind, CAST(count(*) AS BIGINT) AS n FROM ({VERDICTS_SQL}) GROUP BY 1")
def finding_counts(spark, d):
    v = export_verdicts(spark, d)
    return setops.count_kinds(v.select(F.col("verdict").alias("kind"), "file"))


# -- diagnostics and journal

EARLY, LATE = "2024-01-02", "2024-01-29"


@query(f"""
WITH a AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{EARLY}'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '{EARLY}')
SELECT event_id, user_id, event_type FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.event_type = a.event_type)""")
def diag_delta_new(spark, d):
    e = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return diagnostics.delta(e.where(F.col("ts") < EARLY), e.where(F.col("ts") >= EARLY), key=["user_id", "event_type"])[0].drop("ts")


@query(f"""
WITH b AS (SELECT * FROM events WHERE ts < TIMESTAMP '{LATE}'), a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '{LATE}')
SELECT event_id, user_id, event_type FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.user_id = a.user_id AND b.event_type = a.event_type)""")
def diag_delta_fixed(spark, d):
    e = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return diagnostics.delta(e.where(F.col("ts") < LATE), e.where(F.col("ts") >= LATE), key=["user_id", "event_type"])[1].drop("ts")


@query("""
SELECT 'x' AS side, 'src/f' || (event_id % 40) || '.ts' AS file, 'TS' || (2000 + user_id % 90) AS code, 'Bad ' || event_type || '.' AS message FROM events WHERE event_id % 3 = 0
UNION ALL SELECT 'x', NULL, 'TS5000', 'No ' || event_type FROM events WHERE event_id % 3 = 1""")
def compiler_output(spark, d):
    e = read_table(spark, d, "events")
    line = F.concat(F.lit("src/f"), F.col("event_id") % 40, F.lit(".ts("), F.col("event_id"), F.lit(",7): error TS"), F.lit(2000) + F.col("user_id") % 90, F.lit(": Bad "), "event_type", F.lit("."))
    text = F.when(F.col("event_id") % 3 == 0, line).when(F.col("event_id") % 3 == 1, F.concat(F.lit("error TS5000: No "), "event_type")).otherwise("Found errors.")
    outputs = e.select(F.lit("x").alias("side"), F.concat(text, F.lit("\r\n  at somewhere\n")).alias("output"))
    return diagnostics.parse_compiler_output(outputs).drop("raw")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def journal_last20(spark, d):
    return journal.retain(read_table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


# -- search and paths


@query("SELECT p_partkey, p_name, lower(p_name) = 'red' AS exact FROM part WHERE contains(lower(p_name), 'red')")
def find_parts(spark, d):
    return find.find_names(read_table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "RED")


@query("SELECT 'file' AS kind, url AS file FROM pages WHERE contains(lower(regexp_replace(url, '^.*/', '')), '12') UNION ALL SELECT 'export', CAST(doc_id AS VARCHAR) FROM documents WHERE contains(lower(source), '12')")
def find_files_and_exports(spark, d):
    files = read_table(spark, d, "pages").select(F.col("url").alias("file"))
    exports = read_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("source").alias("name"))
    return find.find(files, exports, "12").select("kind", "file")


@query("SELECT page_id, url FROM pages WHERE url LIKE 'https://%' AND regexp_matches(url, '^https://[^/]*/en/[^/]*$')")
def related_path(spark, d):
    return find.related(read_table(spark, d, "pages").select("page_id", "url"), "url", "https://*/en/*")


@query(r"""
WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS p FROM pages),
m AS (SELECT host, min(p) AS a, max(p) AS b, count(*) AS n FROM p GROUP BY 1),
i AS (SELECT host, a, b, n, unnest(generate_series(1, least(len(a), len(b)))) AS k FROM m),
d AS (SELECT host, min(k) FILTER (a[k] <> b[k]) AS k, min(least(len(a), len(b))) AS l FROM i GROUP BY 1)
SELECT m.host, array_to_string(a[1:coalesce(k - 1, l)], '/') AS prefix, CAST(n AS BIGINT) AS n FROM m JOIN d USING (host)""")
def path_lca(spark, d):
    plain = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "")
    return layout.common_prefix(read_table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), plain.alias("path")), "host")


OWNERS = [("zeta", "shop"), ("beta", "shop/en"), ("alpha", "shop"), ("gamma", "shop/fr/1"), ("delta", "")]
_PATH = "'shop/' || lang || '/' || (doc_id % 3) || '/x' || doc_id"


@query(f"""
WITH o(name, folder) AS (VALUES {', '.join(f"('{n}', '{f}')" for n, f in OWNERS)}), p AS (SELECT DISTINCT {_PATH} AS path FROM documents)
SELECT path, name AS owner FROM (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY length(folder) DESC, name) AS k FROM p JOIN o ON folder = '' OR path = folder OR starts_with(path, folder || '/')) WHERE k = 1""")
def ownership_deepest(spark, d):
    paths = read_table(spark, d, "documents").select(F.concat(F.lit("shop/"), "lang", F.lit("/"), F.col("doc_id") % 3, F.lit("/x"), "doc_id").alias("path"))
    return resolve.owners(paths, spark.createDataFrame(OWNERS, "name string, folder string"), [F.desc(F.length("folder")), "name"])


@query(ORACLES["ownership_deepest"].replace("length(folder) DESC, name", "name"))
def ownership_first(spark, d):
    paths = read_table(spark, d, "documents").select(F.concat(F.lit("shop/"), "lang", F.lit("/"), F.col("doc_id") % 3, F.lit("/x"), "doc_id").alias("file"))
    return resolve.file_package(paths, spark.createDataFrame(OWNERS, "name string, path string")).select(F.col("file").alias("path"), "owner")


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), e AS (SELECT DISTINCT page_id, href FROM l)
SELECT href AS node, CAST(count(*) AS BIGINT) AS fan_in FROM e GROUP BY 1""")
def page_links_fan_in(spark, d):
    links = read_table(spark, d, "pages").select(F.concat(F.lit("page:"), "page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))
    return metrics.coupling(links).where("fan_in > 0").select("node", "fan_in")


@query(r"""
WITH b AS (SELECT page_id, html, regexp_extract(html, '(?is)<script(?:\s[^>]*)?\s*>.*?</script>') AS b FROM pages WHERE regexp_matches(html, '(?is)<script(?:\s[^>]*)?\s*>.*?</script>')),
o AS (SELECT *, strpos(b, '>') AS k, html[:strpos(html, b) - 1] AS head FROM b)
SELECT page_id, b[k + 1:length(b) - 9] AS script, CASE WHEN regexp_matches(b[:k], '(?i)\blang=["'']?js') THEN 'js' ELSE 'ts' END AS lang,
 CAST(length(head) + len(regexp_extract_all(head, '[\x{10000}-\x{10FFFF}]')) + k AS INTEGER) AS script_at FROM o""")
def script_blocks(spark, d):
    return tables.script_blocks(read_table(spark, d, "pages")).where("script is not null").select("page_id", "script", "lang", "script_at")


# -- naming and layout


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, CAST(sum(n) AS BIGINT) AS total, max(n) AS top FROM c GROUP BY 1),
w AS (SELECT c.source, min(c.lang) AS lang, count(*) AS ties, any_value(total) AS total, any_value(top) AS top FROM c JOIN t USING (source) WHERE n = top GROUP BY 1)
SELECT source, lang, CAST(top AS BIGINT) AS n, total, CAST(top AS DOUBLE) / total AS share FROM w WHERE ties = 1 AND total >= 3 AND CAST(top AS DOUBLE) / total >= 0.6""")
def naming_majority(spark, d):
    return naming.majority(read_table(spark, d, "documents").select("source", "lang"), "source", "lang")


@query(f"SELECT doc_id, d.source, d.lang, m.lang AS expected FROM documents d JOIN ({ORACLES['naming_majority']}) m USING (source) WHERE d.lang <> m.lang")
def naming_outliers(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.join(naming.majority(docs, "source", "lang").select("source", F.col("lang").alias("expected")), "source").where("lang <> expected").select("doc_id", "source", "lang", "expected")


CASED = "CASE p_partkey % 5 WHEN 0 THEN replace(lower(p_name), ' ', '-') WHEN 1 THEN replace(lower(p_name), ' ', '_') WHEN 2 THEN replace(upper(p_name), ' ', '') WHEN 3 THEN 'x' || replace(upper(p_name), ' ', '') ELSE p_name END"


def _cased(spark, d):
    return read_table(spark, d, "part").select("p_partkey", F.expr(CASED).alias("stem"))


@query(f"""
SELECT p_partkey, CASE WHEN regexp_matches(s, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches(s, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake_case'
 WHEN regexp_matches(s, '^[A-Z][A-Za-z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(s, '^[a-z][A-Za-z0-9]*$') THEN 'camelCase' ELSE 'unknown' END AS casing FROM (SELECT p_partkey, {CASED} AS s FROM part)""")
def casing_detect(spark, d):
    return _cased(spark, d).select("p_partkey", S.casing("stem").alias("casing"))


@query(rf"""
SELECT p_partkey, array_to_string(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda x: x <> ''), '|') AS words
FROM (SELECT p_partkey, {CASED} AS s FROM part)""")
def name_tokens(spark, d):
    return _cased(spark, d).select("p_partkey", F.array_join(S.name_words("stem"), "|").alias("words"))


@query(rf"""
SELECT p_partkey, array_to_string(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_ ]+', ' ', 'g'))), ' '), lambda x: x <> ''), '|') AS words
FROM (SELECT p_partkey, {CASED} AS s FROM part)""")
def identifier_tokens(spark, d):
    return _cased(spark, d).select("p_partkey", F.array_join(S.identifier_words("stem"), "|").alias("words"))


@query("""
WITH r AS (SELECT p_name AS basename, p_type AS name, p_brand AS signature, p_size % 5 AS file FROM part), s AS (SELECT basename FROM r GROUP BY 1 HAVING count(DISTINCT file) > 1)
SELECT basename, name, CAST(count(DISTINCT signature) AS BIGINT) AS signatures, CAST(count(DISTINCT file) AS BIGINT) AS files FROM r WHERE basename IN (SELECT basename FROM s) GROUP BY 1, 2 HAVING count(DISTINCT signature) > 1""")
def basename_collisions(spark, d):
    p = read_table(spark, d, "part")
    rows = p.select(F.concat((F.col("p_size") % 5).cast("string"), F.lit("/"), "p_name").alias("file"), F.col("p_type").alias("name"), F.lit("named").alias("export_type"), F.col("p_brand").alias("signature"))
    return layout.basename_collisions(rows)


@query("""
WITH v AS (SELECT CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS nested, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS beside FROM events)
SELECT nested, beside, coalesce(CAST(nested AS DOUBLE) / nullif(nested + beside, 0) >= 0.7, true) AS use_folder FROM v""")
def convention_vote(spark, d):
    place = F.when(F.col("event_type") == "click", "tests-folder").when(F.col("event_type") == "view", "beside").otherwise("elsewhere")
    return layout.convention_vote(read_table(spark, d, "events").select(place.alias("place")))


@query("""SELECT 'o' || l_orderkey || '.test.ts' AS test, 'b' || (l_partkey % 9) || '/p' || l_partkey || '.ts' AS file, CAST(sum(greatest(1, l_linenumber - 1)) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2""")
def subject_weight(spark, d):
    return layout.subject_weights(_tests(spark, d))


def _tests(spark, d):
    lines = read_table(spark, d, "lineitem")
    return lines.select(F.concat(F.lit("o"), "l_orderkey", F.lit(".test.ts")).alias("src"), F.concat(F.lit("b"), F.col("l_partkey") % 9, F.lit("/p"), "l_partkey", F.lit(".ts")).alias("dst"), F.when(F.col("l_linenumber") > 1, F.array_repeat(F.lit("x"), F.col("l_linenumber").cast("int") - 1)).alias("bindings"))


@query("SELECT 'o' || l_orderkey || '.test.ts' AS test, CASE WHEN min(l_partkey % 9) = max(l_partkey % 9) THEN 'b' || min(l_partkey % 9) END AS dir FROM lineitem GROUP BY 1")
def subject_folder(spark, d):
    return layout.subject_folder(layout.subject_weights(_tests(spark, d)))


# -- unions, keys, impact, contracts


@query("""
WITH g AS (SELECT 0 AS g, l_orderkey AS a, l_partkey % 20 AS b, l_linenumber AS c FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT 1, l_orderkey, l_partkey % 20, l_linenumber FROM lineitem WHERE l_linestatus = 'F')
SELECT 'o' || a AS src, 's' || b AS specifier, CAST(c AS INTEGER) AS line, CAST(g AS INTEGER) AS graph_seq FROM (SELECT *, min(g) OVER (PARTITION BY a, b, c) AS m FROM g) WHERE g = m""")
def graph_union_dedupe(spark, d):
    lines = read_table(spark, d, "lineitem")
    rows = lambda w: lines.where(w).select(node("o", "l_orderkey").alias("src"), F.concat(F.lit("s"), F.col("l_partkey") % 20).alias("specifier"), F.col("l_linenumber").cast("int").alias("line"))
    return setops.graph_union([rows("l_returnflag <> 'N'"), rows("l_linestatus = 'F'")])


@query("SELECT l_orderkey, l_partkey, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def duplicate_keys_first(spark, d):
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    return setops.first_by_key(lines, ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("""
WITH u AS (SELECT s_nationkey AS n, count(*) AS k, bool_or(s_nationkey % 5 <> 0) AS b FROM supplier GROUP BY 1)
SELECT 'N' || n_nationkey AS node, CAST(coalesce(k, 0) AS BIGINT) AS importers, coalesce(b, false) AS boundary,
 CASE WHEN n_nationkey % 11 = 3 OR coalesce(k, 0) >= 20 OR (coalesce(b, false) AND k >= 5) THEN 'high' WHEN coalesce(b, false) OR coalesce(k, 0) >= 5 OR (coalesce(k, 0) > 0 AND (n_nationkey % 10) / 10.0 <= 0.3) THEN 'medium' ELSE 'low' END AS risk
FROM nation LEFT JOIN u ON n = n_nationkey""")
def impact_risk(spark, d):
    s, n = read_table(spark, d, "supplier"), read_table(spark, d, "nation")
    refs = s.select(node("S", "s_suppkey").alias("src"), node("N", "s_nationkey").alias("dst"), F.lit("x").alias("specifier"), F.lit(1).alias("line"), F.col("s_suppkey").alias("seq"))
    packages = s.select(node("S", "s_suppkey").alias("file"), F.lit("a").alias("package")).union(n.select(node("N", "n_nationkey"), F.when(F.col("n_nationkey") % 5 == 0, "a").otherwise("b")))
    m = n.select(node("N", "n_nationkey").alias("node"), ((F.col("n_nationkey") % 10) / 10).alias("instability"))
    missing = n.where("n_nationkey % 11 = 3").select(node("N", "n_nationkey").alias("node"), F.lit(1).cast("bigint").alias("n_missing"))
    hubs = spark.createDataFrame([], "barrel string, target string")
    return impact.impact(refs, hubs, n.select(node("N", "n_nationkey").alias("node")), packages, m, missing).select("node", "importers", "boundary", "risk")


CONTRACT_SQL = """
WITH RECURSIVE deps AS (SELECT DISTINCT 'c' || (c_custkey % 40) AS consumer, 'n' || c_nationkey AS provider FROM customer),
pol AS (SELECT 'n' || n_nationkey AS package, 'r' || n_regionkey AS dep, 'dependencies' AS section, '^' || (n_nationkey % 2) AS specifier, n_nationkey % 4 = 0 AS clo FROM nation
 UNION ALL SELECT 'r' || r_regionkey, 'lib', 'peerDependencies', '^9', false FROM region),
q(consumer, root, dep, section, specifier, clo, depth) AS (
 SELECT d.consumer, d.provider, p.dep, p.section, p.specifier, p.clo, 0 FROM deps d JOIN pol p ON p.package = d.provider
 UNION SELECT q.consumer, q.root, p.dep, p.section, p.specifier, p.clo, q.depth + 1 FROM q JOIN pol p ON p.package = q.dep WHERE q.clo)
"""


def _contract(spark, d):
    c, n, r = (read_table(spark, d, t) for t in ("customer", "nation", "region"))
    deps = c.select(F.concat(F.lit("c"), F.col("c_custkey") % 40).alias("consumer"), node("n", "c_nationkey").alias("provider")).distinct()
    policies = n.select(node("n", "n_nationkey").alias("package"), node("r", "n_regionkey").alias("dep"), F.lit("dependencies").alias("section"), F.concat(F.lit("^"), F.col("n_nationkey") % 2).alias("specifier"), (F.col("n_nationkey") % 4 == 0).alias("include_closure"), F.lit(0).alias("seq"))
    policies = policies.union(r.select(node("r", "r_regionkey"), F.lit("lib"), F.lit("peerDependencies"), F.lit("^9"), F.lit(False), F.lit(0)))
    return contracts.requirements(deps, policies)


@query(CONTRACT_SQL + "SELECT consumer, root, dep, section, specifier, CAST(depth AS INTEGER) AS depth FROM q")
def contract_closure(spark, d):
    return _contract(spark, d).select("consumer", "root", "dep", "section", "specifier", "depth")


@query(CONTRACT_SQL + "SELECT consumer, dep, array_to_string(list_sort(list(DISTINCT section || '@' || specifier)), ',') AS asked FROM q GROUP BY 1, 2 HAVING count(DISTINCT section || '@' || specifier) > 1")
def contract_conflicts(spark, d):
    empty = spark.createDataFrame([], "consumer string, dep string, section string, specifier string")
    return contracts.settle(_contract(spark, d), empty)[1].select("consumer", "dep", F.array_join("asked", ",").alias("asked"))


@query(CONTRACT_SQL + ", m AS (SELECT consumer, dep, min(section) AS section, min(specifier) AS specifier, count(DISTINCT section || '@' || specifier) AS w FROM q GROUP BY 1, 2) SELECT consumer, dep, 'add' AS action, section, specifier FROM m WHERE w = 1")
def contract_changes(spark, d):
    empty = spark.createDataFrame([], "consumer string, dep string, section string, specifier string")
    return contracts.settle(_contract(spark, d), empty)[0]


@query("""
WITH u AS (SELECT DISTINCT 'n' || s_nationkey AS node, CASE WHEN s_suppkey % 2 = 0 THEN '@s/p' || (s_suppkey % 7) ELSE 'q' || (s_suppkey % 7) END AS package FROM supplier),
h AS (SELECT 'n' || n_nationkey AS node, 'q' || (n_nationkey % 7) AS package FROM nation)
SELECT node, package FROM u EXCEPT SELECT node, package FROM h""")
def missing_deps(spark, d):
    s, n = read_table(spark, d, "supplier"), read_table(spark, d, "nation")
    imports = s.select(node("n", "s_nationkey").alias("node"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("@s/p"), F.col("s_suppkey") % 7, F.lit("/sub/x"))).otherwise(F.concat(F.lit("q"), F.col("s_suppkey") % 7, F.lit("/y"))).alias("specifier"))
    declared = n.select(node("n", "n_nationkey").alias("node"), F.concat(F.lit("q"), F.col("n_nationkey") % 7).alias("name"), F.lit("dependencies").alias("section"))
    return impact.missing_dependencies(imports, declared)


# -- tokens and similarity


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM documents),
g AS (SELECT doc_id, len(t) AS n, list_distinct(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(CASE WHEN n < 2 THEN 0 ELSE len(g) END AS BIGINT) AS n_bigrams FROM g""")
def doc_bigrams(spark, d):
    w = read_table(spark, d, "documents").select("doc_id", S.words("text").alias("t"))
    return w.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(S.bigrams("t")).cast("bigint").alias("n_bigrams"))


@query("""
WITH k AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), ' ') AS k FROM documents)
SELECT min(doc_id) AS first_id, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY k HAVING count(*) > 1""")
def doc_exact_dups(spark, d):
    k = read_table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(S.words("text"), " "), 256).alias("k"))
    return k.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").cast("bigint").alias("n")).where("n > 1").drop("k")


PAIRS_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM documents),
g AS (SELECT DISTINCT doc_id, t[i] || ' ' || t[i + 1] AS g FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - 1)) AS i FROM w)),
n AS (SELECT w.doc_id, count(g.g) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY 1),
f AS (SELECT g, doc_id, count(*) OVER (PARTITION BY g) AS df FROM g),
r AS (SELECT g, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM f),
p AS (SELECT r.* FROM r JOIN n USING (doc_id) WHERE k <= n - ceil(n * 0.8 - 1e-9) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id),
s AS (SELECT c.a, c.b, count(*) AS i FROM c JOIN g x ON x.doc_id = c.a JOIN g y ON y.doc_id = c.b AND y.g = x.g GROUP BY 1, 2)
SELECT a, b, CAST(i AS DOUBLE) / (na.n + nb.n - i) AS score FROM s JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE CAST(i AS DOUBLE) / (na.n + nb.n - i) >= 0.8
UNION ALL SELECT (SELECT min(doc_id) FROM n WHERE n = 0), doc_id, CAST(1 AS DOUBLE) FROM n WHERE n = 0 AND doc_id > (SELECT min(doc_id) FROM n WHERE n = 0)"""


def _doc_sets(spark, d):
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.bigrams(S.words("text")).alias("items"))


@query(PAIRS_SQL)
def doc_similar_pairs(spark, d):
    return similarity.similar_sets(_doc_sets(spark, d), 0.8)


@query()
def doc_similar_groups(spark, d):
    return similarity.similar_set_groups(_doc_sets(spark, d), 0.7)


@query()
def similar_declarations(spark, d):
    """Conversation turns as bodies of declarations: all gates, scores, penalties and groups."""
    rows = read_table(spark, d, "conversations").where("text is not null")
    rows = rows.withColumn("body", S.normalised("text"))
    decl = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("decl_id"), F.concat(F.lit("f"), "conv_id").alias("file"), F.concat("role", F.lit("Turn"), "turn").alias("name"), F.lit("function").alias("kind"), F.col("body").alias("normalized_body"), F.size(S.tokens("body")).alias("token_count"), F.length("text").alias("body_length"), F.lit(1).alias("body_lines"), F.lit(False).alias("has_directive"), F.lit(False).alias("is_wrapper"), F.lit(False).alias("is_type_guard"), S.content_tokens("text", F.lit("function")).alias("content_tokens"), F.array().cast("array<string>").alias("extends_names"), F.array().cast("array<string>").alias("member_names"))
    with Workspace(spark, "declarations") as ws:
        decl = ws.keep(decl)  # so that bodies are normalised once
    return similarity.find_similar(decl.where("token_count >= 8"), similarity.Options(threshold=0.8, max_groups=0))


@query("""
WITH bw AS (SELECT item_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM benchmark),
bg AS (SELECT DISTINCT item_id, t[i] || ' ' || t[i + 1] AS g FROM (SELECT item_id, t, unnest(generate_series(1, len(t) - 1)) AS i FROM bw)),
bn AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM documents),
dg AS (SELECT DISTINCT doc_id, t[i] || ' ' || t[i + 1] AS g FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - 1)) AS i FROM dw)),
h AS (SELECT doc_id, item_id, count(*) AS k FROM dg JOIN bg USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(k AS DOUBLE) / n AS share FROM h JOIN bn USING (item_id) WHERE CAST(k AS DOUBLE) / n >= 0.5""")
def benchmark_contamination(spark, d):
    """Documents that hold at least half of an item's bigrams."""
    grams = lambda t, c: read_table(spark, d, t).select(c, F.explode(S.bigrams(S.words("text"))).alias("g"))
    items = grams("benchmark", "item_id")
    size = items.groupBy("item_id").agg(F.count("*").alias("n"))
    hits = grams("documents", "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("k"))
    return hits.join(size, "item_id").select("doc_id", "item_id", (F.col("k").cast("double") / F.col("n")).alias("share")).where("share >= 0.5")


# -- edits


@query("""SELECT conv_id, turn, CASE WHEN length(text) >= 12 THEN substr(text, 1, 2) || '<a>' || substr(text, 6, 3) || '<bc>' || substr(text, 9) ELSE text END AS after FROM conversations""")
def apply_edits(spark, d):
    """Spans count UTF-16 units, so they are measured on the text before them."""
    rows = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    texts = rows.withColumn("file", F.concat_ws(":", "conv_id", "turn"))
    units = lambda n: (F.octet_length(F.encode(F.substring("text", 1, n), "UTF-16LE")) / 2).cast("int")
    long = texts.where(F.length("text") >= 12)
    span = lambda a, b, new: long.select("file", units(a).alias("start"), units(b).alias("end"), F.substring("text", a + 1, b - a).alias("old_text"), F.lit(new).alias("new_text"))
    done = edits.apply_edits(long, span(2, 5, "<a>").union(span(8, 8, "<bc>")))
    return texts.join(done.select("file", "after"), "file", "left").select("conv_id", "turn", F.coalesce("after", "text").alias("after"))


@query("""
SELECT file FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'app/' || o_orderkey || '/page.tsx' WHEN 1 THEN 'packages/app/' || o_orderkey || '/page.tsx' WHEN 2 THEN 'src/app/robots.ts' WHEN 3 THEN 'src/app/x/robots.ts' WHEN 4 THEN 'lib/page.ts' ELSE 'apps/app/app/a/layout.js' END AS file, o_orderkey % 6 AS k FROM orders) WHERE k IN (0, 2, 5)""")
def convention_files(spark, d):
    k = F.col("o_orderkey") % 6
    path = F.when(k == 0, F.concat(F.lit("app/"), "o_orderkey", F.lit("/page.tsx"))).when(k == 1, F.concat(F.lit("packages/app/"), "o_orderkey", F.lit("/page.tsx"))).when(k == 2, "src/app/robots.ts").when(k == 3, "src/app/x/robots.ts").when(k == 4, "lib/page.ts").otherwise("apps/app/app/a/layout.js")
    return read_table(spark, d, "orders").select(path.alias("file")).where(conventions.is_convention_file("file"))


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'unused' AS kind FROM ({VERDICTS_SQL}) WHERE verdict = 'unused' UNION ALL SELECT 'audit' FROM ({METRICS_SQL}) WHERE fan_out > 10 OR fan_in > 10 UNION ALL SELECT 'similar' FROM ({PAIRS_SQL})) GROUP BY 1")
def tidy_report(spark, d):
    unused = export_verdicts(spark, d).where("verdict = 'unused'")
    return setops.count_kinds(tidy.report(unused, doc_similar_pairs(spark, d), threshold_hubs(spark, d)))


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN './t' || page_id WHEN page_id % 3 = 1 THEN '../b/t' || page_id ELSE '../../c/d' END AS specifier FROM pages""")
def relative_specifiers(spark, d):
    k = F.col("page_id") % 3
    target = F.when(k == 0, F.concat(F.lit("x/a/t"), "page_id", F.lit(".d.ts"))).when(k == 1, F.concat(F.lit("x/b/t"), "page_id", F.lit(".tsx"))).otherwise("c/d/index.ts")
    return read_table(spark, d, "pages").select("page_id", S.relative_specifier(F.lit("x/a/m.ts"), target).alias("specifier"))


@query("""
SELECT src, specifier, CASE doc_id % 5 WHEN 0 THEN 'lib/m.ts' WHEN 1 THEN 'src/a/index.tsx' WHEN 3 THEN 'src/u/w.ts' END AS dst, CASE doc_id % 5 WHEN 2 THEN 'external' WHEN 4 THEN 'unresolvable' ELSE 'resolved' END AS outcome
FROM (SELECT doc_id, 'src/f' || doc_id || '.ts' AS src, CASE doc_id % 5 WHEN 0 THEN '../lib/m.js' WHEN 1 THEN './a' WHEN 2 THEN 'react' WHEN 3 THEN '@/u/w' ELSE './gone' END AS specifier FROM documents)""")
def resolve_specifiers(spark, d):
    k = F.col("doc_id") % 5
    specifier = F.when(k == 0, "../lib/m.js").when(k == 1, "./a").when(k == 2, "react").when(k == 3, "@/u/w").otherwise("./gone")
    refs = read_table(spark, d, "documents").select(F.concat(F.lit("src/f"), "doc_id", F.lit(".ts")).alias("src"), specifier.alias("specifier"))
    files = spark.createDataFrame([("lib/m.ts",), ("src/a/index.tsx",), ("src/u/w.ts",), ("src/u/w.js",)], "file string")
    aliases = spark.createDataFrame([("@/*", "src/*", 0), ("@/u/*", "other/*", 1)], "alias string, target string, pos int")
    return resolve.resolve(refs, files, aliases).select("src", "specifier", "dst", "outcome")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return metrics_fan_in_out(spark, folder)


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    from ..streaming.incremental import windowed_counts

    return windowed_counts(read_table(spark, d, "events"))


from . import catalog as catalog  # noqa: E402  the rest of the queries, which it registers here
