"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample (``SAMPLE_ROWS``): every inner node
has a random direction and splits at the sample's median along it. Largest
inner product becomes nearest neighbour by one more component that gives all
rows the same norm. Every row is indexed in one leaf of every tree. A query
walks all trees through one priority queue, whose key is the smallest signed
margin on the way to a node, and takes leaves in the order they leave the
queue. How many leaves is found on the sample: as many as reach
``target_recall`` there against brute force. Candidates are the rows of these
leaves, all of them; leaves that hold many rows are searched in blocks. They
are reranked by their exact inner product in double precision, summed in one
fixed order, so that equal vectors tie.

The forest (trees, margins, leaf counts) is bounded by the sample and is what
the driver and broadcasts hold. Defined cases are those of ``vectors``; zero
vectors take no part; vectors of another length than the most frequent one
(the longest, if tied) are searched by a forest of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.llm import vectors
from revscope.llm.common import stored
from revscope.session import table_path

#: Rows that the trees are fitted on, about, and rows of the sample in a leaf.
SAMPLE_ROWS, LEAF_ROWS = 16_384, 256
TREES = 4
#: Queries of the sample that settle how many leaves are visited.
CALIBRATION_QUERIES = 256


@dataclass
class Forest:
    """Complete binary trees; node ``i`` has children ``2 i + 1`` and ``2 i + 2``."""

    depth: int
    reach: float  # the norm all rows are lifted to
    directions: np.ndarray  # trees x nodes x (dim + 1), unit
    thresholds: np.ndarray  # trees x nodes
    visits: int = 0

    def lifted(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.reach**2 - (v * v).sum(1)))
        return np.concatenate([v, rest[:, None]], 1)

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree: rows x trees."""
        x = self.lifted(v)
        out = np.zeros((len(x), len(self.directions)), np.int64)
        for t, (d, th) in enumerate(zip(self.directions, self.thresholds, strict=True)):
            side = x @ d.T > th if len(d) else np.zeros((len(x), 0), bool)
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            for _ in range(self.depth):
                node = 2 * node + 1 + side[rows, node]
            out[:, t] = node - len(d)
        return out

    def walk(self, v: np.ndarray, visits: int) -> list[list[tuple[int, int]]]:
        """For each query the first ``visits`` leaves (tree, leaf) that leave the shared queue."""
        n_inner = 2**self.depth - 1
        scale = np.maximum(1e-300, np.sqrt((v * v).sum(1)))
        x = np.concatenate([v / scale[:, None] * self.reach, np.zeros((len(v), 1))], 1)
        margins = np.einsum("qd,tnd->qtn", x, self.directions, optimize=True) - self.thresholds
        out = []
        for m in margins.tolist():
            queue = [(float("-inf"), t, 0) for t in range(len(m))]
            found: list[tuple[int, int]] = []
            while queue and len(found) < visits:
                key, t, node = heapq.heappop(queue)
                if node >= n_inner:
                    found.append((t, node - n_inner))
                    continue
                gap = m[t][node]  # beyond the threshold: the right child's margin
                heapq.heappush(queue, (max(key, gap), t, 2 * node + 1))
                heapq.heappush(queue, (max(key, -gap), t, 2 * node + 2))
            out.append(found)
        return out


def fit(sample: np.ndarray, reach: float, k: int, target_recall: float, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Forest:
    """Trees over a sample, and the number of leaves that reaches the recall on it."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf_rows))))
    n_inner = 2**depth - 1
    d = rng.normal(size=(trees, n_inner, sample.shape[1] + 1))
    d /= np.maximum(1e-300, np.linalg.norm(d, axis=2, keepdims=True))
    forest = Forest(depth, reach, d, np.zeros((trees, n_inner)), trees * 2**depth)
    x = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(len(x), np.int64)
        for i in range(n_inner):
            mine = np.flatnonzero(node == i)
            if len(mine):
                p = x[mine] @ d[t, i]
                forest.thresholds[t, i] = np.median(p)
                node[mine] = 2 * i + 1 + (p > forest.thresholds[t, i])
    if depth:
        forest.visits = _visits(forest, sample, k, target_recall)
    return forest


def _visits(forest: Forest, sample: np.ndarray, k: int, target: float) -> int:
    at = np.linspace(0, len(sample) - 1, min(CALIBRATION_QUERIES, len(sample))).astype(int)
    s = sample[at] @ sample.T
    s[np.arange(len(at)), at] = -np.inf
    k = min(k, len(sample) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    leaves = forest.leaves(sample)
    first = []
    for q, order in enumerate(forest.walk(sample[at], len(forest.directions) * 2**forest.depth)):
        place = {x: i for i, x in enumerate(order)}
        first += [min(place[t, leaf] for t, leaf in enumerate(leaves[c])) for c in near[q]]
    return int(np.quantile(first, target, method="higher")) + 1


def _rerank(k: int):
    def take(q_ids, q_matrix, ids, matrix) -> pa.RecordBatch:
        qi, q = vectors.matrix(q_ids, q_matrix)
        ci, c = vectors.matrix(ids, matrix)
        out = []
        for a in range(0, len(qi), 128):
            s = q[a:a + 128] @ c.T
            s[qi[a:a + 128, None] == ci] = -np.inf
            if len(ci) > k:  # a product of matrices may round equal vectors apart: keep what could tie
                kth = np.partition(s, len(ci) - k, axis=1)[:, len(ci) - k]
                slack = 1e-12 * (1 + np.sqrt((q[a:a + 128]**2).sum(1)) * np.sqrt((c * c).sum(1).max()))
                row, col = np.nonzero((s >= (kth - slack)[:, None]) & (s > -np.inf))
            else:
                row, col = np.nonzero(s > -np.inf)
            score = (q[a:a + 128][row] * c[col]).sum(1)
            at = vectors.best(row, score, ci[col], k)
            out.append((qi[a:a + 128][row[at]], ci[col[at]], score[at]))
        q_, c_, s_ = map(np.concatenate, zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(q_), pa.array(c_), pa.array(s_, pa.float64())], ["query_id", "vec_id", "score"])

    return take


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 0))


def _search(base: DataFrame, k: int, is_query: Column, target_recall: float) -> DataFrame:
    """Search among rows (id, v) of one dimension."""
    spark = base.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    x = base.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(norm).alias("reach")).first()
    part = min(1.0, SAMPLE_ROWS / max(1, x.n))
    drawn = base.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(part * (1 << 30))).orderBy("id").select("v")
    sample = _matrix(drawn.toArrow())
    if not len(sample):  # so few rows that none was drawn
        sample = _matrix(base.limit(1).select("v").toArrow())
    forest = spark.sparkContext.broadcast(fit(sample, x.reach, k, target_recall))

    def vecs(batch: pa.RecordBatch) -> np.ndarray:
        col = batch.column("v")
        return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.value.leaves(vecs(batch))
            for t in range(leaves.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaves), t, np.int32)), pa.array(leaves[:, t].astype(np.int32)),
                                                  batch.column("id"), batch.column("v")], ["tree", "leaf", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                walks = forest.value.walk(vecs(part), forest.value.visits)
                row = np.repeat(np.arange(len(walks)), [len(w) for w in walks])
                tree, leaf = np.array([x for w in walks for x in w], np.int32).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(leaf), part.column("id").take(pa.array(row)),
                                                  part.column("v").take(pa.array(row))], ["tree", "leaf", "id", "v"])

    schema = "tree int, leaf int, id long, v array<double>"
    indexed = base.select("id", "v").mapInArrow(index, schema)
    sizes = indexed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / vectors.ROWS).alias("parts"))
    # one row for each leaf: bounded by the sample
    rows = vectors.blocks(indexed.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn("part", vectors.block_of(F.col("id"), F.col("parts"))),
                          ["tree", "leaf", "part"], "tree int, leaf int, part long")
    probes = base.filter(is_query).select("id", "v").mapInArrow(probe, schema)
    n_queries = max(1, -(-x.q // vectors.QUERIES))
    asked = vectors.blocks(probes.withColumn("qb", vectors.block_of(F.col("id"), F.lit(n_queries))), ["tree", "leaf", "qb"], "tree int, leaf int, qb long")
    pairs = asked.select("tree", "leaf", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")).join(rows, ["tree", "leaf"])
    found = vectors.over_pairs(pairs, ["q_ids", "q_matrix", "ids", "matrix"], _rerank(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a row found in several trees
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, k: int, is_query: Column, target_recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """About the ``k`` largest inner products of each query: query_id, rank, vec_id, score."""
    base = stored(vectors.points(df, id_col, vec_col).filter(F.exists("v", lambda x: x != 0)), "points")
    dims = [r.dim for r in base.groupBy("dim").count().orderBy(F.col("count").desc(), F.col("dim").desc()).collect()]  # lengths, not rows
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not dims else None
    for d in dims:
        found = _search(base.filter(F.col("dim") == d), k, is_query, target_recall)
        out = found if out is None else out.union(found)
    return out


def op3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(table_path(sf_dir, "embeddings")), 20, F.col("id") % 20 == 0)
