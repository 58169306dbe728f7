"""Approximate nearest neighbours by learned partitions (largest inner product).

Fit, on the driver and on a sample of at most ``sample_rows`` vectors picked by
hash over the whole table: the exact neighbour graph of the sample; a balanced
partition of that graph (seeded by balanced assignment, refined by neighbour
votes under a capacity); a small network with one hidden layer that learns from
a vector the partitions of its neighbours.  Every row of the table is then put
into its most probable partition, and a query goes to its most probable ones,
where all vectors are scored exactly in double precision.  How many those are is
told by the sample too: the fewest with which rows kept from the fit find ``recall``
of their neighbours in it.  Neighbours in the whole table are nearer, so the recall
there is as good or better; vectors with structure need few partitions.

Searching joins two tables by partition.  A partition of more rows than a block
is dealt out to several blocks and its queries go to each, so a partition that
holds a third of all rows is many tasks; a block returns at most ``k`` (and
ties) per query, and these meet once more per query.

Defined results: rows whose vector is null, empty, zero, of another length than
most rows, or holds a null or non-finite component take no part, nor do rows with a null id; of
rows that share an id the least vector counts; ties go to the smaller id; fewer
candidates than ``k`` are all returned; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop, lean, written

_SLACK = 1e-9


@dataclass(frozen=True)
class Router:
    """Softmax over partitions of one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row i: the k rows of largest inner product with row i, itself left out."""
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def _with_capacity(score: np.ndarray, capacity: int) -> np.ndarray:
    """Each row to its best column that still has room; surest rows choose first."""
    n, m = score.shape
    order = np.argsort(-score, axis=1, kind="stable")
    top = np.take_along_axis(score, order[:, :2], 1)
    room, part = np.full(m, capacity), np.zeros(n, np.int64)
    for i in np.argsort(-(top[:, 0] - top[:, -1]), kind="stable"):
        for c in order[i]:
            if room[c]:
                room[c] -= 1
                part[i] = c
                break
    return part


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each vertex, none above ``slack`` times the mean, with few edges between parts."""
    n = len(x)
    capacity = int(np.ceil(slack * n / parts))
    rng = np.random.default_rng(7)
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        part = _with_capacity(x @ centres.T, capacity)
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    votes_to = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (votes_to, part[graph.reshape(-1)]), 1.0)
        np.add.at(votes, (graph.reshape(-1), part[votes_to]), 1.0)
        votes[np.arange(n), part] += 0.5  # stay where it makes no difference
        part = _with_capacity(votes, capacity)
    return part


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, steps: int = 300) -> Router:
    """Adam on cross-entropy against each row's distribution over partitions."""
    rng = np.random.default_rng(11)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d, m = x.shape[1], target.shape[1]
    weights = [rng.normal(0, 1.0, (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, m)), np.zeros(m)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        some = rng.choice(len(x), min(len(x), 1024), replace=False)
        xb, yb = x[some], target[some]
        pre = xb @ weights[0] + weights[1]
        act = np.maximum(pre, 0)
        z = act @ weights[2] + weights[3]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - yb) / len(xb)
        da = (dz @ weights[2].T) * (pre > 0)
        grads = [xb.T @ da, da.sum(0), act.T @ dz, dz.sum(0)]
        for w, g, f, s in zip(weights, grads, first, second):
            f += 0.1 * (g - f)
            s += 0.001 * (g * g - s)
            w -= 0.01 * (f / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Router(*weights)


def fit_router(sample: np.ndarray, parts: int, recall: float, graph_k: int = 16) -> tuple[Router, int]:
    """A router over at most ``parts`` partitions and the number of them a query has to visit.

    It learns from three rows of four; the others tell the probes.  A partition is
    never made for fewer than four rows.
    """
    held = np.arange(len(sample)) % 4 == 3
    x = sample[~held]
    parts = max(1, min(parts, len(x) // 4))
    if not held.any() or parts == 1:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    graph = neighbour_graph(x, graph_k)
    part = balanced_partition(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), graph.shape[1] / 4)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.reshape(-1)]), 1.0)
    router = train_router(x, target / target.sum(1, keepdims=True))
    return router, probes_for(router, sample, np.flatnonzero(held), recall, graph_k)


def probes_for(router: Router, sample: np.ndarray, asked: np.ndarray, recall: float, k: int) -> int:
    """The fewest probes with which rows that the router has not seen find that share of their neighbours in the sample."""
    s = sample[asked] @ sample.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-s, min(k, s.shape[1] - 1) - 1, axis=1)[:, :k]
    order = np.argsort(-router.logits(sample), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
    visit = np.take_along_axis(rank[asked], order[:, 0][near], 1)  # when a query comes to each neighbour's partition
    found = np.cumsum(np.bincount(visit.reshape(-1), minlength=order.shape[1])) / visit.size
    return int(np.searchsorted(found, recall - 1e-12) + 1)


def usable_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (array of double) of the rows that take part, one per id."""
    v = F.col("vec")
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"]
    return rows.where(F.size("vec") == F.lit(usual or 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def sample_vectors(vectors: DataFrame, sample_rows: int) -> np.ndarray:
    """At most ``sample_rows`` vectors, picked by hash of the id over the whole table."""
    n = vectors.count()
    pick = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30))
    few = vectors.withColumn("pick", pick).where(F.col("pick") <= F.lit(int(min(1.0, 1.5 * sample_rows / max(n, 1)) * (1 << 30))))
    rows = few.orderBy("pick", "vec_id").limit(sample_rows).select("vec").collect()
    return np.array([r["vec"] for r in rows], np.float64) if rows else np.zeros((0, 1))


def _matrix(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def best_in_block(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """For each query its k best rows of the block other than its own, scored row by row."""
    out: list[pd.DataFrame] = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ c.T
        s[q_id[a : a + 256, None] == c_id[None, :]] = -np.inf
        if len(c) > k:
            # A product of matrices may round equal vectors apart: keep what is as good within rounding.
            kth = np.maximum(-np.partition(-s, k - 1, axis=1)[:, k - 1 : k], -np.finfo(float).max)
            i, j = np.nonzero(s >= kth - _SLACK * np.maximum(1, np.minimum(np.abs(kth), 1e300)))
        else:
            i, j = np.nonzero(s > -np.inf)
        # Many candidates may tie; they are scored and cut some queries at a time.
        ends = np.searchsorted(i, np.arange(len(s)), "right")
        first = 0
        while first < len(s):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + 65536, "right")))
            some = slice(before, ends[last - 1])
            parts = [slice(b, min(b + 65536, some.stop)) for b in range(some.start, some.stop, 65536)]
            score = np.concatenate([(q[a + i[p]] * c[j[p]]).sum(1) for p in parts] or [[]])
            rows = pd.DataFrame({"query_id": q_id[a + i[some]], "vec_id": c_id[j[some]], "score": score})
            rows = rows.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(rows.groupby("query_id", sort=False).head(k))
            first = last
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest_by_partitions(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    parts: int = 64,
    probes: int | None = None,
    recall: float = 0.93,
    sample_rows: int = 4096,
    block_rows: int = 16384,
    query_rows: int = 2048,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: up to ``k`` nearest found of each query.

    ``is_query`` is a condition on ``vec_id``; ``probes`` sets the partitions a query visits, otherwise told by ``recall``.
    """
    spark = table.sparkSession
    vectors = written(usable_vectors(table, id_col, vec_col), "vectors")
    sample = sample_vectors(vectors, sample_rows)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted, enough = fit_router(sample, parts, recall)
    probes = probes or enough
    router = spark.sparkContext.broadcast(fitted)

    @lean
    def routed(batches):
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), np.float64)
            order = np.argsort(-router.value.logits(x), axis=1, kind="stable") if len(x) else np.zeros((0, 1), np.int64)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": [v.tobytes() for v in x], "q": pdf["q"], "near": list(order[:, :probes])})

    rows = vectors.select("vec_id", "vec", is_query.alias("q"))
    rows = written(rows.mapInPandas(routed, "vec_id long, vec binary, q boolean, near array<int>"), "routed")
    router.destroy()
    drop(vectors)
    candidates = rows.select("vec_id", "vec", F.element_at("near", 1).alias("part"))
    queries = rows.where("q").select("vec_id", "vec", F.explode("near").alias("part"))
    sizes = candidates.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    # One row per partition; their number is a parameter.
    plan = F.broadcast(
        sizes.join(asked, "part").select(
            "part", F.ceil(F.col("n") / block_rows).cast("int").alias("c_blocks"), F.ceil(F.col("m") / query_rows).cast("int").alias("q_blocks")
        )
    )
    own = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = (F.col("vec_id").alias("id"), F.col("vec").alias("v"))
    c = candidates.join(plan, "part").select("part", own("c_blocks", 21).alias("c"), every("q_blocks").alias("q"), *named)
    q = queries.join(plan, "part").select("part", every("c_blocks").alias("c"), own("q_blocks", 22).alias("q"), *named)

    def search(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best_in_block(qs["id"].to_numpy(), _matrix(qs["v"]), cs["id"].to_numpy(), _matrix(cs["v"]), k)

    key = ["part", "c", "q"]
    found = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")


    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
