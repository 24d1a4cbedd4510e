"""Vector index, exact k-nearest-neighbour search and text encoder (IDX1,
IDX2, SRCH, JOIN5, TOP1, WIN3, FLT5, MTH4).

Index (IDX2): corpus vectors are brought to unit length and packed into
tiles, matrices of at most about ``TILE_ROWS`` rows of one label and one
length. Tiles are numbered densely, by length and label, so all vectors of a
length are a range of tile numbers, and those of a label a range within it.

Search is complete: every question meets every tile it may match. Questions
are packed into tiles too (``TILE_QUESTIONS`` with the same range). Tiles of
either side form blocks of at most ``BLOCK_VALUES`` numbers (fewer where the
tables are small, so that all cores have work), and each pair of blocks is one
group: its questions meet its tiles one after the other by a matrix product,
and only each question's k best rows of the whole block leave. So a vector is
shipped once per opposite block, not once per opposite vector, and the memory
of a task is bounded by one pair of blocks.

Distances are ``1 - cosine``, rounded to 6 places. A zero vector has cosine 0
with everything. Rows or questions without a vector, and vectors that are
empty or hold null or non-finite components, take no part; a question meets
rows of its vector's length only; an empty corpus gives no hits.

Focus (FLT5): a question's focus filters on ``label = lower(focus)``; when no
corpus row has that label the question is searched unfiltered. Rows without a
label are found by unfiltered questions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revscope.functions.text import word_tokens
from revscope.functions.vector import normalize, usable

TILE_ROWS, TILE_QUESTIONS = 4096, 1024
#: Numbers in a block of tiles (32 MB), and the blocks that a smaller table is cut into.
BLOCK_VALUES, LEAST_BLOCKS = 1 << 22, 8
#: Distances nearer than this may be equal when rounded.
SLACK = 2e-6
DIST_DIGITS = 6
#: Documents whose vectors are made in one numpy step.
ENCODE_ROWS = 1024

TILE_SCHEMA = "tile long, label string, n long, ids binary, matrix binary"
LABEL_SCHEMA = "label string, dim int, n long, parts long, first long"


@dataclass
class VectorIndex:
    rows: DataFrame    # row_id, label, vec (unit length), payload columns
    tiles: DataFrame   # TILE_SCHEMA: packed ids and matrices
    labels: DataFrame  # LABEL_SCHEMA: rows, number of tiles and first tile of every label and length
    metadata: dict = field(default_factory=dict)
    encoder: object = None

    def search(self, questions: DataFrame, top_k: int = 5, focus_col: str | None = "focus", k_col: str | None = None) -> DataFrame:
        return search(questions, self, top_k, focus_col, k_col)


def build_index(corpus: DataFrame, vec_col: str = "embedding", label_col: str = "label",
                id_col: str = "row_id", payload: tuple[str, ...] = (), materialize: bool = True,
                tile_rows: int = TILE_ROWS) -> VectorIndex:
    """IDX2: unit vectors packed into tiles of one label."""
    rows = corpus.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("row_id"), F.col(label_col).cast("string").alias("label"),
        normalize(vec_col).alias("vec"), *payload)
    if materialize:
        rows = rows.checkpoint(eager=True)
    counts = (rows.groupBy("label", F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("parts", F.ceil(F.col("n") / tile_rows)))
    # one row per label and length passes through this window
    before = Window.orderBy("dim", F.col("label").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    labels = counts.withColumn("first", F.coalesce(F.sum("parts").over(before), F.lit(0)))
    if materialize:
        labels = labels.checkpoint(eager=True)
    place = labels.select(F.col("label").alias("_label"), "dim", "parts", "first")
    placed = (rows.select("row_id", "label", "vec").join(place, F.col("label").eqNullSafe(F.col("_label")) & (F.size("vec") == F.col("dim")))
              .select((F.col("first") + F.pmod(F.xxhash64("row_id"), F.col("parts"))).alias("tile"), "label", "row_id", "vec"))

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        ids, matrix = _packed(table.column("row_id"), table.column("vec"))
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([table.column("label")[0].as_py()], pa.string()),
             pa.array([table.num_rows], pa.int64()), pa.array([ids], pa.binary()), pa.array([matrix], pa.binary())],
            ["tile", "label", "n", "ids", "matrix"])

    tiles = placed.groupBy("tile").applyInArrow(gather, TILE_SCHEMA)
    if materialize:
        tiles = tiles.checkpoint(eager=True)
    return VectorIndex(rows=rows, tiles=tiles, labels=labels)


def _packed(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> tuple[bytes, bytes]:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy().astype("<i8").tobytes(), flat.astype("<f8").tobytes()


def effective_focus(questions: DataFrame, labels: DataFrame, focus_col: str = "focus") -> DataFrame:
    """FLT5: lower(focus) as ``_eff`` when some corpus row has that label, else null."""
    known = labels.select(F.col("label").alias("_eff")).distinct()
    return questions.withColumn("_lf", F.lower(F.col(focus_col))).join(known, F.col("_lf") == F.col("_eff"), "left").drop("_lf")


def _per_block(tiles: int, rows: int, dim: int) -> int:
    """How many tiles of ``rows`` vectors a block has."""
    return max(1, min(-(-tiles // LEAST_BLOCKS), BLOCK_VALUES // (rows * max(dim, 1))))


def _question_tiles(q: DataFrame, labels: DataFrame, per_block: int, dim: int) -> tuple[DataFrame, int]:
    """(q_block, block, first, parts, q_ids, q_ks, q_matrix): question tiles, once for every block
    of corpus tiles that their range meets; and the number of question blocks."""
    spans = labels.select(F.col("label").alias("_eff"), "dim", "first", "parts").filter("_eff IS NOT NULL")
    whole = labels.groupBy("dim").agg(F.min("first").alias("_first"), F.sum("parts").alias("_parts"))
    filtered = F.col("_eff").isNotNull()
    ranged = (q.withColumn("dim", F.size("vec")).join(spans, ["_eff", "dim"], "left").join(whole, "dim", "left")
              .select("q_id", "k", "vec", F.when(filtered, F.col("first")).otherwise(F.col("_first")).alias("first"),
                      F.when(filtered, F.col("parts")).otherwise(F.col("_parts")).alias("parts")).filter("parts > 0"))
    chunks = max(1, -(-ranged.count() // TILE_QUESTIONS))
    ranged = ranged.withColumn("chunk", F.pmod(F.xxhash64("q_id"), F.lit(chunks)))
    per_q_block = _per_block(chunks, TILE_QUESTIONS, dim)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        ids, matrix = _packed(table.column("q_id"), table.column("vec"))
        ks = table.column("k").to_numpy().astype("<i8").tobytes()
        return pa.Table.from_arrays([pa.array([k.as_py()], pa.int64()) for k in key]
                                    + [pa.array([b], pa.binary()) for b in (ids, ks, matrix)],
                                    ["first", "parts", "chunk", "q_ids", "q_ks", "q_matrix"])

    tiles = ranged.groupBy("first", "parts", "chunk").applyInArrow(
        gather, "first long, parts long, chunk long, q_ids binary, q_ks binary, q_matrix binary")
    blocks = F.sequence(F.floor(F.col("first") / per_block), F.floor((F.col("first") + F.col("parts") - 1) / per_block))
    asked = tiles.select(F.floor(F.col("chunk") / per_q_block).alias("q_block"), F.explode(blocks).alias("block"), "first", "parts", "q_ids", "q_ks", "q_matrix")
    return asked, -(-chunks // per_q_block)


class _Best:
    """Each question's k best rows of the tiles it has met (smaller row_id on ties)."""

    def __init__(self, q_ids: bytes, q_ks: bytes, q_matrix: bytes):
        self.ids, self.ks = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_ks, "<i8")
        self.q = np.frombuffer(q_matrix, "<f8").reshape(len(self.ids), -1)
        self.kth = np.full(len(self.ids), np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))  # question, distance, row_id, tile

    def meet(self, ids: np.ndarray, x: np.ndarray, tile: int) -> None:
        """``ids`` ascend."""
        parts = [self.found]
        for a in range(0, len(self.ids), 128):
            score, k, kth = self.q[a:a + 128] @ x.T, self.ks[a:a + 128], self.kth[a:a + 128]
            if not np.isfinite(kth).all():
                most = np.minimum(k, len(ids))
                places = np.unique(len(ids) - most)
                here = np.partition(score, places, axis=1)[np.arange(len(k)), len(ids) - most]
                kth = np.minimum(kth, np.where(k <= len(ids), _distance(here), np.inf))
            row, col = np.nonzero(score >= (1.0 - kth - SLACK)[:, None])
            d = _distance(score[row, col])
            within = d <= kth[row]
            row, col, d = row[within], col[within], d[within]
            # of rows as far as the k-th the first k will do
            equal = np.cumsum(d == kth[row])
            start = np.searchsorted(row, np.arange(len(k)))
            before = np.concatenate([[0], equal])[start]
            keep = (d < kth[row]) | (equal - before[row] <= k[row])
            row, col, d = row[keep], col[keep], d[keep]
            parts.append((row + a, d, ids[col], np.full(len(row), tile)))
        q, d, row_id, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((row_id, d, q))
        q, d, row_id, at = q[order], d[order], row_id[order], at[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.ks[q]
        last = place == self.ks[q] - 1
        self.kth[q[last]] = d[last]
        self.found = (q[keep], d[keep], row_id[keep], at[keep])


def _distance(score: np.ndarray) -> np.ndarray:
    return np.floor((1.0 - score) * 1e6 + 0.5) / 1e6 + 0.0


def _top_k(c: DataFrame) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy("distance", "row_id")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("k"))


def search(questions: DataFrame, index: VectorIndex, top_k: int = 5, focus_col: str | None = "focus",
           k_col: str | None = None) -> DataFrame:
    """SRCH: (q_id, rank, row_id, label, distance), ranks 1..k by ascending
    cosine distance (rounded to 6 places), row_id breaking ties."""
    q = questions.filter(usable("q_vec") & F.col("q_id").isNotNull()).select(
        F.col("q_id").cast("long").alias("q_id"), normalize("q_vec").alias("vec"),
        (F.col(k_col) if k_col else F.lit(top_k)).cast("long").alias("k"),
        (F.col(focus_col) if focus_col else F.lit(None).cast("string")).alias("focus")).filter("k > 0")
    sizes = index.labels.agg(F.sum("parts").alias("tiles"), F.max("dim").alias("dim")).first()
    per_block = _per_block(sizes.tiles or 1, TILE_ROWS, sizes.dim or 1)
    asked, q_blocks = _question_tiles(effective_focus(q, index.labels), index.labels, per_block, sizes.dim or 1)
    tiles = index.tiles.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("with"), F.floor(F.col("tile") / per_block).alias("part"),
                               "tile", "label", "ids", "matrix")

    def run(questions: pa.Table, tiles: pa.Table) -> pa.Table:
        met = []
        columns = ["first", "parts", "q_ids", "q_ks", "q_matrix"]
        groups = [(first, parts, _Best(*packed)) for first, parts, *packed in zip(*(questions.column(c).to_pylist() for c in columns), strict=True)]
        labels = tiles.column("label").combine_chunks()
        for at in range(tiles.num_rows):
            tile, ids = tiles.column("tile")[at].as_py(), np.frombuffer(tiles.column("ids")[at].as_buffer(), "<i8")
            x = np.frombuffer(tiles.column("matrix")[at].as_buffer(), "<f8").reshape(len(ids), -1)
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            for first, parts, best in groups:
                if first <= tile < first + parts:
                    best.meet(ids, x, at)
        for _, _, best in groups:
            row, d, row_id, at = best.found
            met.append(pa.Table.from_arrays([pa.array(best.ids[row]), pa.array(best.ks[row].astype(np.int32)), pa.array(row_id), labels.take(pa.array(at)), pa.array(d)],
                                            ["q_id", "k", "row_id", "label", "distance"]))
        return pa.concat_tables(met) if met else pa.schema(
            [("q_id", pa.int64()), ("k", pa.int32()), ("row_id", pa.int64()), ("label", pa.string()), ("distance", pa.float64())]).empty_table()

    found = asked.groupBy("q_block", "block").cogroup(tiles.groupBy("with", "part")).applyInArrow(
        run, "q_id long, k int, row_id long, label string, distance double")
    return _top_k(found).select("q_id", "rank", "row_id", "label", "distance")


# ---- IDX1: encoders ----------------------------------------------------------------------

@dataclass
class TextEncoder:
    """Hashed word counts times IDF, unit length: fitted once, used for corpus and questions."""

    dim: int
    idf: list[float]


def _buckets(tokens: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word of token lists: 32 bits of its MD5 modulo the dimension, hashed once a batch."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    row = np.repeat(np.arange(len(tokens)), pa.compute.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))
    words = tokens.flatten().dictionary_encode()
    bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words.dictionary.to_pylist()], np.int64)
    return row, bucket[words.indices.to_numpy(zero_copy_only=False)]


def fit_encoder(docs: DataFrame, text_col: str = "text", dim: int = 256) -> TextEncoder:
    """IDX1: smooth IDF of every bucket over the documents (``dim`` numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            row, bucket = _buckets(batch.column(0), dim)
            df += np.bincount(np.unique(row * dim + bucket) % dim, minlength=dim)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim), pa.int64()), pa.array(np.append(n, df), pa.int64())], ["b", "df"])

    rows = docs.select(word_tokens(F.col(text_col))).mapInArrow(run, "b long, df long").groupBy("b").agg(F.sum("df").alias("df")).collect()
    df = {r["b"]: r["df"] for r in rows}
    n = df.get(-1, 0)
    return TextEncoder(dim, [float(np.log((1 + n) / (1 + df.get(i, 0))) + 1) for i in range(dim)])


def encode(docs: DataFrame, encoder: TextEncoder, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """IDX1: the documents with their vector; a text without words has the zero vector."""
    @F.arrow_udf("array<double>")
    def vector(tokens: pa.Array) -> pa.Array:
        idf, dim, out = np.array(encoder.idf), encoder.dim, []
        for a in range(0, len(tokens), ENCODE_ROWS):
            part = tokens.slice(a, ENCODE_ROWS)
            row, bucket = _buckets(part, dim)
            v = np.bincount(row * dim + bucket, minlength=len(part) * dim).reshape(-1, dim) * idf
            norm = np.sqrt((v * v).sum(1))[:, None]
            out.append(np.divide(v, norm, out=v, where=norm > 0).ravel())
        flat = np.concatenate(out) if out else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * dim, pa.int32()), pa.array(flat))

    return docs.withColumn(out_col, vector(word_tokens(F.col(text_col))))
