"""Exact top-k by inner product with a table of pivots.

Vectors are integers, floor(scale * x). A table holds the distance of every vector to a few pivots. For a query and a
candidate the largest difference of their distances to a pivot is a lower bound of their own distance (triangle
inequality), and with both norms that bounds the inner product from above. Candidates are evaluated in the order of
their bounds until no bound left reaches the k-th score found, so the result is exact.

Candidates are dealt into blocks of bounded size and queries into blocks of their own; every block of candidates meets
every block of queries in a task, and the few best of each meet again by query. A first look at the candidates with the
best bounds of one block gives each query a score to beat everywhere.

Rows: vectors that are null, empty or hold a null or a non-finite component take no part, nor do rows without an id;
vectors of different lengths are never compared; equal scores go to the smaller id, repeated ids by their rows; an empty
table gives an empty result; other columns of any name are ignored. Sums of products must stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

PIVOTS = 32
#: Vectors from which pivots are chosen.
SAMPLE = 1000
QUERIES = 1024
CANDIDATES = 8192
#: Candidates that are evaluated together.
STEP = 256
FOUND = "query_id long, vec_id long, score long"


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest first: each the vector that is farthest from those already chosen."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        chosen.append(int(np.argmax(far)))
    return sample[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def best(q: np.ndarray, q_id: int, q_far: np.ndarray, x: np.ndarray, ids: np.ndarray, far: np.ndarray, norms: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the candidates that can be among the best k and score at least floor."""
    low = np.abs(far - q_far).max(1)
    low -= 1e-6 * (1 + low + q_far.max() + far.max(initial=0))  # more than rounding can amount to
    bound = (q @ q + norms - np.maximum(low, 0) ** 2) / 2
    left = np.flatnonzero((bound >= floor) & (ids != q_id))
    left = left[np.argsort(-bound[left], kind="stable")]
    got, scores, at = np.empty(0, np.int64), np.empty(0), 0
    while at < len(left):
        if bound[left[at]] < floor:
            break
        some = left[at : at + STEP]
        got, scores = np.concatenate([got, ids[some]]), np.concatenate([scores, x[some] @ q])
        if len(scores) > k:
            order = np.lexsort((got, -scores))[:k]
            got, scores = got[order], scores[order]
        if len(scores) >= k:
            floor = max(floor, scores.min())
        at += STEP
    keep = scores >= floor
    return got[keep], scores[keep].astype(np.int64)


def _blocks(vectors: DataFrame, block, name: str) -> DataFrame:
    """One row for each block of vectors of one length: ids and components as bytes."""

    def pack(group: pa.Table) -> pa.Table:
        d = group.column("d")[0].as_py()
        flat = np.concatenate([np.asarray(v, np.float64) for v in group.column("v").to_pylist()])
        return pa.table({"d": pa.array([d], pa.int32()), name: pa.array([group.column(name)[0].as_py()], pa.int64()), "ids": [group.column("id").to_numpy().astype("<i8").tobytes()], "x": [flat.tobytes()]})

    return vectors.withColumn(name, block).groupBy("d", name).applyInArrow(pack, f"d int, {name} long, ids binary, x binary")


def search(vectors: DataFrame, is_query, *, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score; vectors: id, v; is_query: a condition on id."""
    spark = vectors.sparkSession
    whole = F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where("id is not null and v is not null and size(v) > 0").where(finite).select(F.col("id").cast("long").alias("id"), F.size("v").alias("d"), whole.alias("v"))
    with Workspace(spark, "topk") as ws:
        usable = ws.save(usable, "usable")
        counts = {r["d"]: (r["n"], r["q"]) for r in usable.groupBy("d").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()}  # a row for each length
        most = max((n for n, _ in counts.values()), default=0)
        n_blocks, q_blocks = max(1, -(-most // CANDIDATES)), max(1, -(-max((q for _, q in counts.values()), default=0) // QUERIES))
        table = {}
        for d in counts:
            sample = usable.where(F.col("d") == d).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
            table[d] = choose_pivots(np.array([r["v"] for r in sample], float), pivots)

        candidates = ws.save(_blocks(usable, F.pmod(F.xxhash64("id"), F.lit(n_blocks)), "block"), "candidates")
        queries = ws.save(_blocks(usable.where(is_query), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)), "wanted"), "queries")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    d, p = r["d"], table[r["d"]]
                    x, q = (np.frombuffer(r[c]).reshape(-1, d) for c in ("x", "q_x"))
                    ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                    floors = np.frombuffer(r["floors"]) if r["floors"] else np.full(len(q_ids), -np.inf)
                    far, q_far, norms = to_pivots(x, p), to_pivots(q, p), (x**2).sum(1)
                    out = [best(q[j], int(q_ids[j]), q_far[j], x, ids, far, norms, k, floors[j]) for j in range(len(q_ids))]
                    n = [len(s) for _, s in out]
                    yield pa.record_batch([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([i for i, _ in out])), pa.array(np.concatenate([s for _, s in out]))], names=["query_id", "vec_id", "score"])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The k-th score of each query in the one block it looks at."""
            for batch in batches:
                for r in batch.to_pylist():
                    d, p = r["d"], table[r["d"]]
                    x, q = (np.frombuffer(r[c]).reshape(-1, d) for c in ("x", "q_x"))
                    ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                    far, q_far, norms = to_pivots(x, p), to_pivots(q, p), (x**2).sum(1)
                    found = [best(q[j], int(q_ids[j]), q_far[j], x, ids, far, norms, k, -np.inf)[1] for j in range(len(q_ids))]
                    floors = np.array([s.min() if len(s) >= k else -np.inf for s in found], float)
                    yield pa.record_batch([pa.array([d], pa.int32()), pa.array([r["wanted"]], pa.int64()), pa.array([floors.tobytes()], pa.binary())], names=["d", "wanted", "floors"])

        asked = queries.select("d", "wanted", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
        first = asked.withColumn("block", F.pmod("wanted", F.lit(n_blocks))).join(candidates, ["d", "block"])
        floors = ws.save(first.select("d", "wanted", "q_ids", "q_x", "ids", "x").repartition(q_blocks).mapInArrow(look, "d int, wanted long, floors binary"), "floors")
        asked = asked.join(floors, ["d", "wanted"], "left")
        dealt = candidates.withColumn("wanted", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<long>")))
        met = dealt.join(asked, ["d", "wanted"]).repartition(n_blocks * q_blocks if n_blocks * q_blocks < 10_000 else 10_000)
        found = met.select("d", "ids", "x", "q_ids", "q_x", "floors").mapInArrow(meet, FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return ws.keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
