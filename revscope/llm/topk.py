"""Exact top-k inner products of quantised vectors, by distributed histogram selection.

Queries and rows meet as matrix blocks (a stated query set against all rows),
in joins by shuffles: written blocks are small on disk and large in memory, so
no size of theirs may lead to a broadcast. A pass scores everything and adds
up, for each query, a histogram of its scores over all rows; a block of rows
passes on its bins from the top down to the one that holds its own k-th score,
below which the k-th of all rows cannot lie. The bin that holds the k-th
largest score is the next pass's interval, until the bin is one value wide or holds hardly more rows
than wanted. Only then are rows taken out: those at or above the bin, of which
a block passes on the k best at most, ties to the smaller id, and the k best
of these are exact.

Scores are products of integers: exact in doubles below 2**53, else in Python
integers, clipped to 64 bits. Defined cases are those of ``vectors``; a vector
of no components scores 0 against its like.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.llm import vectors
from revscope.llm.common import stored
from revscope.session import table_path

#: Bins of a histogram; rows beyond k that a located bin may hold.
BINS, SLACK = 1024, 64
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantise(v: Column, scale: float) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, as doubles where these are exact, else clipped to 64 bits."""
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if most < _EXACT:
        return q @ c.T
    whole = np.vectorize(int, otypes=[object])
    exact = np.dot(whole(q), whole(c).T) if q.size and c.size else np.zeros((len(q), len(c)), object)
    return np.clip(exact, -_LONG - 1, _LONG)


def _pairs(state: DataFrame, rows: DataFrame, n_query_blocks: int, n_row_blocks: int) -> DataFrame:
    """Blocks of the queries in ``state`` beside every row block of their dimension."""
    q = vectors.blocks(state.withColumn("qb", vectors.block_of(F.col("id"), F.lit(n_query_blocks))), ["dim", "qb"], "dim int, qb long",
                       ("low", "width", "above"))
    q = q.select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), "low", "width",
                 F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_row_blocks - 1).cast("long"))).alias("rb"))
    return q.join(rows.hint("merge"), ["dim", "rb"])


def _histogram(k: int):
    def count(q_ids, q_matrix, low, width, ids, matrix) -> pa.RecordBatch:
        qi, q = vectors.matrix(q_ids, q_matrix)
        ci, c = vectors.matrix(ids, matrix)
        low, width = np.frombuffer(low, "<f8"), np.frombuffer(width, "<f8")
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(qi), 128):
            s = np.asarray(products(q[a:a + 128], c), float)
            lo, w = low[a:a + 128, None], width[a:a + 128, None]
            at = np.floor((s - lo) / w)
            at[(qi[a:a + 128, None] == ci) | (at < 0) | (at >= BINS)] = BINS  # a place beyond the bins
            flat = (at + np.arange(len(s))[:, None] * (BINS + 1)).astype(np.int64).ravel()
            n = np.bincount(flat, minlength=len(s) * (BINS + 1)).reshape(len(s), -1)[:, :BINS]
            higher = n[:, ::-1].cumsum(1)[:, ::-1] - n
            row, col = np.nonzero((n > 0) & (higher < k))
            out.append((qi[a:a + 128][row], col, n[row, col]))
        ids, bins, counts = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bins, pa.int32()), pa.array(counts, pa.int64())], ["id", "bin", "n"])

    return count


def _above(k: int):
    def take(q_ids, q_matrix, low, ids, matrix) -> pa.RecordBatch:
        qi, q = vectors.matrix(q_ids, q_matrix)
        ci, c = vectors.matrix(ids, matrix)
        low = np.frombuffer(low, "<f8")
        out = []
        for a in range(0, len(qi), 128):
            s = products(q[a:a + 128], c)
            keep = (s >= low[a:a + 128, None]) & (qi[a:a + 128, None] != ci)
            row, col = np.nonzero(keep)
            score = s[row, col].astype(np.int64)
            at = vectors.best(row, score, ci[col], k)
            out.append((qi[a:a + 128][row[at]], ci[col[at]], score[at]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in map(np.concatenate, zip(*out, strict=True))], ["query_id", "vec_id", "score"])

    return take


def search(df: DataFrame, k: int, is_query: Column, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``id``; a query is no candidate of its own.
    """
    base = stored(vectors.points(df, id_col, vec_col).withColumn("v", quantise(F.col("v"), scale)), "points")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    facts = base.groupBy("dim").agg(F.max(norm).alias("reach"), F.count("*").alias("n"))
    x = base.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_rows, n_queries = max(1, -(-x.n // vectors.ROWS)), max(1, -(-x.q // vectors.QUERIES))
    rows = stored(vectors.blocks(base.withColumn("rb", vectors.block_of(F.col("id"), F.lit(n_rows))), ["dim", "rb"], "dim int, rb long"), "rows")

    # by Cauchy and Schwarz no score leaves +-(norm of the query * largest norm)
    bound = F.ceil(norm * F.col("reach") * (1 + 1e-9)) + 1
    queries = base.filter(is_query).join(F.broadcast(facts), "dim")  # one row for each vector length
    state = queries.select("id", "dim", "v", "n", (-bound).cast("double").alias("low"),
                           F.ceil((2 * bound + 1) / BINS).cast("double").alias("width"), F.lit(0).cast("double").alias("above"))
    state = stored(state.withColumn("done", F.col("n") <= k + 1), "state")  # so few rows: all are wanted
    while True:
        open_ = state.filter("NOT done")
        if not open_.limit(1).count():
            break
        found = (vectors.over_pairs(_pairs(open_, rows, n_queries, n_rows), ["q_ids", "q_matrix", "low", "width", "ids", "matrix"],
                                    _histogram(k), "id long, bin int, n long")
                 .groupBy("id", "bin").agg(F.sum("n").alias("rows")))
        down = Window.partitionBy("id").orderBy(F.col("bin").desc())
        located = (open_.join(found.hint("merge"), "id").withColumn("upto", F.sum("rows").over(down) + F.col("above"))
                   .filter((F.col("upto") >= k) & (F.col("upto") - F.col("rows") < k))
                   .select("id", "dim", "v", "n", (F.col("low") + F.col("bin") * F.col("width")).alias("low"),
                           F.ceil(F.col("width") / BINS).cast("double").alias("next"), "width",
                           (F.col("upto") - F.col("rows")).alias("above"), "upto"))
        located = located.withColumn("done", (F.col("width") <= 1) | (F.col("upto") <= k + SLACK))
        state = stored(state.filter("done").unionByName(located.select(
            "id", "dim", "v", "n", "low", F.when(F.col("done"), F.col("width")).otherwise(F.col("next")).alias("width"), "above", "done")), "state")

    taken = vectors.over_pairs(_pairs(state, rows, n_queries, n_rows), ["q_ids", "q_matrix", "low", "ids", "matrix"], _above(k),
                               "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return taken.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(table_path(sf_dir, "embeddings")), 20, F.col("id") % 20 == 0)


ORACLE_SQL = """
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM points q JOIN points c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
