"""Approximate nearest neighbours: an inverted file of k-means cells (IDX2).

Fit. ``ceil(sqrt(rows))`` cells are the k-means centres, brought to unit
length, of ``TRAIN_PER_CELL`` rows a cell; their number grows with the table.
What a vector has over its centre is cut into pieces, each coded by the nearest
of at most 256 code words (product quantisation, learned from ``CODE_ROWS``
rows). A row keeps its code, one byte a piece, and the length of what the code
leaves out, its error.

Storage. Rows of a cell and label are packed into tiles of about ``TILE_ROWS``
rows, in one folder a cell: ids, codes, errors and the exact vectors, as columns
of their own. A search reads the folders of the cells it probes.

Search. The tiles of cells form blocks of at most about ``BLOCK_VALUES`` numbers,
and so do questions; a question goes once to each block that holds cells it
probes. There, its products with the rows as coded give every row's score up to
its error, so a row is ruled out only if k others are better for
certain; the rest are scored exactly from the vectors beside the codes, and only
a question's k best rows of a block leave it. Within the probed cells the result
is therefore exact, and with all cells probed it equals ``retrieval.search``.
``rerank`` asks for less: that many candidates by coded score alone.

How many cells to probe is measured when the index is built: ``SAMPLE``
rows ask for their own neighbours, and the fewest cells that hold ``RECALL`` of
them are kept as ``probes``.

Defined cases: rows and questions without a usable vector take no part; all
rows must have one length (others are an error), questions of another length
find nothing; zero vectors score 0 with everything; null labels are found by
unfiltered questions; ties go to the smaller row_id; an empty table has no
cells and gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revscope.functions.vector import normalize, usable
from revscope.operators.retrieval import BLOCK_VALUES, TILE_QUESTIONS, TILE_ROWS, _packed, build_index, effective_focus, search

TRAIN_PER_CELL = 64
CODE_ROWS, CODE_WORDS, PIECE = 16_384, 256, 4
SAMPLE, RECALL = 256, 0.95
#: Centres up to so many bytes are sent to all tasks; more of them are searched tile by tile.
CENTER_BYTES = 1 << 27
#: Scores that differ by less may change places when distances are rounded.
SLACK = 2e-6

TILE_FIELDS = "tile string, label string, n int, ids binary, codes binary, errors binary, matrix binary"
CELL_SCHEMA = TILE_FIELDS + ", cell int"


@dataclass
class CellModel:
    """What a fit has learned: centres (cells x length) and code words of each piece of a vector."""

    centers: np.ndarray
    words: list[np.ndarray] = field(default_factory=list)

    def edges(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([w.shape[1] for w in self.words])]).astype(int)


@dataclass
class CellIndex:
    rows: DataFrame       # row_id, label, payload columns
    cells: DataFrame      # CELL_SCHEMA
    model: CellModel
    metadata: dict = field(default_factory=dict)
    encoder: object = None

    @property
    def labels(self) -> DataFrame:
        return self.cells.groupBy("label").agg(F.sum("n").alias("n"))

    def search(self, questions: DataFrame, top_k: int = 5, focus_col: str | None = "focus", k_col: str | None = None,
               probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """As ``retrieval.search``, over the ``probes`` nearest cells (as measured when built, if None)."""
        found = _hits(questions, self, top_k, focus_col, k_col, probes, rerank)
        return found.select("q_id", "rank", "row_id", "label", "distance")


def unit_rows(corpus: DataFrame, vec_col: str = "embedding", label_col: str = "label", id_col: str = "row_id",
              payload: tuple[str, ...] = ()) -> DataFrame:
    """row_id, label, vec (unit length) and the payload of all rows with a usable vector."""
    return corpus.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("row_id"), F.col(label_col).cast("string").alias("label"), normalize(vec_col).alias("vec"), *payload)


# ---- fit ---------------------------------------------------------------------------------

def _lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means of a bounded sample: at most k centres, those that got rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centers = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _nearest(x, centers, 1)[:, 0]
        n = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = total[n > 0] / n[n > 0, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centres of each row, nearest first; smaller numbers first among equals."""
    m = min(m, len(centers))
    out = np.empty((len(x), m), np.int64)
    half = (centers * centers).sum(1) / 2
    for a in range(0, len(x), 1024):
        far = half - x[a:a + 1024] @ centers.T
        if m == 1:
            out[a:a + 1024, 0] = far.argmin(1)
            continue
        far = np.round(far, 12)
        part = np.argpartition(far, m - 1, axis=1)[:, :m] if m < len(centers) else np.tile(np.arange(m), (len(far), 1))
        order = np.lexsort((part, np.take_along_axis(far, part, 1)), axis=1)
        out[a:a + 1024] = np.take_along_axis(part, order, 1)
    return out


def fit_cells(rows: DataFrame, cells: int | None = None, seed: int = 7) -> CellModel:
    """Centres and code words of unit vectors (row_id, vec)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    lengths = [r[0] for r in rows.select(F.size("vec").alias("d")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("the vectors of an index must have one length")
    n = rows.count()
    if not n:
        return CellModel(np.zeros((0, 0)))
    k = cells or int(np.ceil(np.sqrt(n)))
    drawn = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, TRAIN_PER_CELL * k / n))
    train = rows.filter(drawn).select(array_to_vector("vec").alias("features"))
    found = KMeans(k=k, seed=seed, maxIter=12).fit(train).clusterCenters() if k > 1 else [r.vec for r in rows.select("vec").limit(1).collect()]
    centers = np.array(found, float)
    norm = np.sqrt((centers * centers).sum(1, keepdims=True))
    centers = np.unique(np.divide(centers, norm, out=centers.copy(), where=norm > 0), axis=0)
    model = CellModel(centers)
    return CellModel(centers, _code_words(rows, model, lengths[0], seed))


def _code_words(rows: DataFrame, model: CellModel, length: int, seed: int) -> list[np.ndarray]:
    """Code words of each piece of what vectors have over their centres, one task a piece."""
    sample = rows.orderBy(F.xxhash64("row_id", F.lit(seed + 1)), "row_id").limit(CODE_ROWS).select("row_id", "vec")
    over = assign(sample, model).select("over")
    pieces = -(-length // PIECE)
    cut = over.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.slice("over", i * PIECE + 1, PIECE))).alias("piece", "part"))

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        x = np.array(table.column("part").to_pylist(), float)
        words = _lloyd(x, CODE_WORDS)
        return pa.table({"piece": pa.array([key[0].as_py()] * len(words), pa.int32()), "word": pa.array(list(words), pa.list_(pa.float64()))})

    found = cut.groupBy("piece").applyInArrow(learn, "piece int, word array<double>").collect()
    return [np.array([r.word for r in found if r.piece == p]) for p in range(pieces)]


# ---- rows to cells -----------------------------------------------------------------------

def assign(rows: DataFrame, model: CellModel, m: int = 1) -> DataFrame:
    """Rows (row_id, vec, others) with each of their m nearest cells: cell, place (from 0) and ``over``, the vector less the centre."""
    if model.centers.nbytes > CENTER_BYTES:
        return _assign_by_tiles(rows, model, m)
    shared = rows.sparkSession.sparkContext.broadcast(model.centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = _nearest(x, centers, m)
            for a in range(0, len(x), max(1, 65_536 // near.shape[1])):
                some = near[a:a + max(1, 65_536 // near.shape[1])]
                at = np.repeat(np.arange(a, a + len(some)), near.shape[1])
                cell = some.ravel()
                over = x[at] - centers[cell]
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell, pa.int32()), pa.array(np.tile(np.arange(near.shape[1]), len(some)), pa.int32()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, over.size + 1, over.shape[1]), pa.int32()), pa.array(over.ravel()))],
                    [*taken.schema.names, "cell", "place", "over"])

    added = T.StructType().add("cell", T.IntegerType()).add("place", T.IntegerType()).add("over", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def _center_rows(spark: SparkSession, model: CellModel) -> DataFrame:
    table = pa.table({"row_id": pa.array(np.arange(len(model.centers))), "center": pa.array(list(model.centers), pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def _assign_by_tiles(rows: DataFrame, model: CellModel, m: int) -> DataFrame:
    """As ``assign`` where there are too many centres for one task: they are the corpus of an exact search."""
    spark = rows.sparkSession
    numbered = rows.withColumn("_number", F.monotonically_increasing_id()).checkpoint(eager=True)
    centers = _center_rows(spark, model).checkpoint(eager=True)
    index = build_index(centers.withColumn("label", F.lit(None).cast("string")), "center")
    near = search(numbered.select(F.col("_number").alias("q_id"), F.col("vec").alias("q_vec")), index, m, focus_col=None)
    near = near.select(F.col("q_id").alias("_number"), F.col("row_id").cast("int").alias("cell"), (F.col("rank") - 1).alias("place"))
    return (numbered.join(near, "_number").join(centers.select(F.col("row_id").cast("int").alias("cell"), "center"), "cell")
            .select(*rows.columns, "cell", "place", F.zip_with("vec", "center", lambda a, b: a - b).alias("over")))


def encode_cells(rows: DataFrame, model: CellModel, tile_rows: int = TILE_ROWS, chunk: str = "") -> DataFrame:
    """CELL_SCHEMA: the tiles of unit vectors (row_id, label, vec). ``chunk`` keeps tiles of several calls apart."""
    if not len(model.centers):
        return rows.sparkSession.createDataFrame([], CELL_SCHEMA)
    placed = assign(rows.select("row_id", "label", "vec"), model).drop("place")
    counts = placed.groupBy("cell", "label").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("parts")).withColumnRenamed("label", "_label")
    placed = (placed.join(counts.withColumnRenamed("cell", "_cell"), (F.col("cell") == F.col("_cell")) & F.col("label").eqNullSafe(F.col("_label")))
              .withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts"))))
    words, edges = model.words, model.edges()

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        over = table.column("over").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        codes, left = np.empty((len(over), len(words)), np.uint8), np.zeros(len(over))
        for p, w in enumerate(words):
            piece = over[:, edges[p]:edges[p + 1]]
            codes[:, p] = _nearest(piece, w, 1)[:, 0]
            left += ((piece - w[codes[:, p]]) ** 2).sum(1)
        ids, matrix = _packed(table.column("row_id"), table.column("vec"))
        cell, label, part = (k.as_py() for k in key)
        name = f"{chunk}/{cell}/{part}/" + ("" if label is None else "=" + label)
        binary = lambda b: pa.array([b], pa.binary())
        return pa.Table.from_arrays(
            [pa.array([name]), pa.array([label], pa.string()), pa.array([len(over)], pa.int32()), binary(ids), binary(codes.tobytes()),
             binary((np.sqrt(left) + 1e-9).astype("<f8").tobytes()), binary(matrix), pa.array([cell], pa.int32())],
            ["tile", "label", "n", "ids", "codes", "errors", "matrix", "cell"])

    return placed.select("cell", "label", "part", "row_id", "vec", "over").groupBy("cell", "label", "part").applyInArrow(pack, CELL_SCHEMA)


def build_cells(corpus: DataFrame, vec_col: str = "embedding", label_col: str = "label", id_col: str = "row_id",
                payload: tuple[str, ...] = (), cells: int | None = None, tile_rows: int = TILE_ROWS,
                k: int = 5, recall: float = RECALL) -> CellIndex:
    """IDX2: fit, fill and measure an index that lives in the session (``sources.index`` keeps one in a folder)."""
    rows = unit_rows(corpus, vec_col, label_col, id_col, payload).checkpoint(eager=True)
    model = fit_cells(rows, cells)
    index = CellIndex(rows.drop("vec"), encode_cells(rows, model, tile_rows).checkpoint(eager=True), model)
    index.metadata = {"cells": len(model.centers), "probes": measured_probes(index, rows, k, recall)}
    return index


# ---- search ------------------------------------------------------------------------------

def _question_rows(questions: DataFrame, index: CellIndex, top_k: int, focus_col: str | None, k_col: str | None) -> DataFrame:
    q = questions.filter(usable("q_vec") & F.col("q_id").isNotNull()).select(
        F.col("q_id").cast("long").alias("q_id"), normalize("q_vec").alias("vec"),
        (F.col(k_col) if k_col else F.lit(top_k)).cast("long").alias("k"),
        (F.col(focus_col) if focus_col else F.lit(None).cast("string")).alias("focus")).filter("k > 0")
    width = index.model.centers.shape[1]
    return effective_focus(q.filter(F.size("vec") == width), index.labels).select("q_id", "k", F.col("_eff").alias("eff"), "vec")


def probed(q: DataFrame, model: CellModel, probes: int) -> DataFrame:
    """Questions (q_id, k, eff, vec), each with the numbers of its nearest cells (cells); null stands for all cells."""
    if probes >= len(model.centers):
        return q.withColumn("cells", F.lit(None).cast("array<int>"))
    if model.centers.nbytes > CENTER_BYTES:
        numbered = q.withColumn("_asked", F.monotonically_increasing_id()).checkpoint(eager=True)
        near = assign(numbered.select("_asked", "vec"), model, probes).groupBy("_asked").agg(F.collect_list("cell").alias("cells"))
        return numbered.join(near, "_asked").drop("_asked")
    shared = q.sparkSession.sparkContext.broadcast(model.centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = _nearest(x, shared.value, probes)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return q.mapInArrow(run, T.StructType([*q.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _cell_blocks(cells: DataFrame, n_cells: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last block that each cell's tiles lie in: a block has vectors of ``BLOCK_VALUES`` numbers, about, of
    one cell after the other, and a larger cell lies in several."""
    sizes = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a row for each cell, as many as centres at most
    rows = np.zeros(n_cells, np.int64)
    rows[sizes.column("cell").to_numpy()] = sizes.column("n").to_numpy()
    per_block = _rows_of_block(int(rows.sum()), width, cells.sparkSession)
    before = np.cumsum(rows) - rows
    return before // per_block, np.maximum(before, before + rows - 1) // per_block


def _rows_of_block(rows: int, width: int, spark: SparkSession) -> int:
    """Vectors in a block of either side: together the blocks of both are pairs for all cores."""
    least = int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism)))
    return max(1, min(BLOCK_VALUES // max(width, 1), max(TILE_QUESTIONS, -(-rows // least))))


def _hits(questions: DataFrame, index: CellIndex, top_k: int, focus_col: str | None, k_col: str | None,
          probes: int | None, rerank: int | None) -> DataFrame:
    """(q_id, rank, row_id, label, distance, cell)."""
    model, spark = index.model, questions.sparkSession
    n_cells = len(model.centers)
    if not n_cells:
        return spark.createDataFrame([], "q_id long, rank int, row_id long, label string, distance double, cell int")
    probes = min(n_cells, probes or index.metadata.get("probes") or n_cells)
    q = _question_rows(questions, index, top_k, focus_col, k_col).checkpoint(eager=True)
    width = model.centers.shape[1]
    first, last = _cell_blocks(index.cells, n_cells, width)
    n_asked = q.count()
    q_blocks = max(1, -(-n_asked // _rows_of_block(n_asked, width, spark)))
    near, tiles = probed(q, model, probes), index.cells
    if probes < n_cells:
        wanted = [r.cell for r in near.select(F.explode("cells").alias("cell")).distinct().collect()]  # numbers of cells: as many as centres, at most
        tiles = tiles.filter(F.col("cell").isin(wanted))
    # a question goes once to each block of tiles that holds some of its cells, with their numbers
    places = spark.sparkContext.broadcast((first, last))
    asked = near.withColumn("q_block", F.pmod(F.xxhash64("q_id"), F.lit(q_blocks)))
    if probes >= n_cells:
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(last.max())).cast("long"))))
    else:
        asked = asked.mapInArrow(_by_block(places), T.StructType([*asked.schema.fields, T.StructField("block", T.LongType())]))
    blocks = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(n_cells), pa.int32()), "_first": pa.array(first), "_span": pa.array(last - first + 1)}))
    placed = tiles.join(blocks, "cell").withColumn("block", F.col("_first") + F.pmod(F.xxhash64("tile"), F.col("_span"))).drop("_first", "_span", "n")
    shared = spark.sparkContext.broadcast((model.centers if model.centers.nbytes <= CENTER_BYTES else None, model.words, model.edges()))
    if model.centers.nbytes > CENTER_BYTES:
        placed = placed.join(_center_rows(spark, model).select(F.col("row_id").cast("int").alias("cell"), "center"), "cell")
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def meet(questions: pa.Table, tiles: pa.Table) -> pa.Table:
        if not questions.num_rows or not tiles.num_rows:
            return _NO_HITS.empty_table()
        block = _Block(tiles, *shared.value)
        found = [block.best(questions.slice(a, ASKED_ROWS), rerank) for a in range(0, questions.num_rows, ASKED_ROWS)]
        return pa.concat_tables(found)

    found = asked.groupBy("q_block", "block").cogroup(placed.groupBy("with", "block")).applyInArrow(
        meet, "q_id long, k long, row_id long, label string, distance double, cell int, coded double, tile string, at int")
    if rerank is not None:
        coded = Window.partitionBy("q_id").orderBy(F.desc("coded"), "tile", "at")
        found = found.withColumn("r", F.row_number().over(coded)).filter(F.col("r") <= F.greatest(F.lit(rerank).cast("long"), F.col("k")))
    # a hit of one of several questions that share a number comes once for each of them
    shares = q.groupBy("q_id").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 1")
    found = found.join(shares, "q_id", "left").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1)))))
    w = Window.partitionBy("q_id").orderBy("distance", "row_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("k")).select("q_id", "rank", "row_id", "label", "distance", "cell")


def _by_block(places):
    """Questions once for each block that holds some of their cells, with the numbers of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = places.value
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                cells = part.column("cells")
                row = np.repeat(np.arange(part.num_rows), np.diff(cells.offsets.to_numpy()))
                cell = cells.flatten().to_numpy(zero_copy_only=False)
                span = last[cell] - first[cell] + 1
                at = np.repeat(np.arange(len(cell)), span)
                block = first[cell][at] + np.arange(len(at)) - np.repeat(np.cumsum(span) - span, span)
                row, cell = row[at], cell[at]
                order = np.lexsort((block, row))
                row, cell, block = row[order], cell[order], block[order]
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else row
                taken = part.take(pa.array(row[starts]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(cell, pa.int32()))
                columns = [lists if name == "cells" else taken.column(name) for name in taken.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block[starts], pa.int64())], [*taken.schema.names, "block"])

    return run


#: Questions of a block that are searched together, and those whose scores stand in one matrix.
ASKED_ROWS, SCORE_ROWS = 2048, 32
_NO_HITS = pa.schema([("q_id", pa.int64()), ("k", pa.int64()), ("row_id", pa.int64()), ("label", pa.string()), ("distance", pa.float64()), ("cell", pa.int32()),
                      ("coded", pa.float64()), ("tile", pa.string()), ("at", pa.int32())])


def _kth_at_least(score: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of each row a value that k of its scores reach, near the k-th largest: the k-th of the largest scores of parts of the row."""
    parts = min(score.shape[1], max(256, 8 * int(k.max())))
    most = np.maximum.reduceat(score, np.arange(parts) * score.shape[1] // parts, axis=1) if parts < score.shape[1] else score
    least = np.minimum(k, parts)
    places = np.unique(parts - least)
    kth = np.partition(most, places, axis=1)[np.arange(len(k)), parts - least]
    return np.where(k <= parts, kth, -np.inf)


class _Block:
    """The rows of a block of tiles, beside which questions are scored: by their codes, which rule out what k others are
    above for certain, then exactly."""

    def __init__(self, tiles: pa.Table, centers: np.ndarray | None, words: list[np.ndarray], edges: np.ndarray):
        tiles = tiles.sort_by([("cell", "ascending"), ("tile", "ascending")])
        column = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in tiles.column(name)]
        ids = column("ids", "<i8")
        n = np.array([len(x) for x in ids])
        self.ids, self.errors = np.concatenate(ids), np.concatenate(column("errors", "<f8"))
        codes = np.concatenate(column("codes", np.uint8)).reshape(len(self.ids), -1)
        self.x = np.concatenate(column("matrix", "<f8")).reshape(len(self.ids), -1)
        self.tile, self.at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.tiles, self.labels, cells = tiles.column("tile").combine_chunks(), tiles.column("label").combine_chunks(), tiles.column("cell").to_numpy()
        self.names = {name: i for i, name in enumerate(sorted({x for x in self.labels.to_pylist() if x is not None}))}
        self.label = np.array([self.names.get(x, -1) for x in self.labels.to_pylist()])[self.tile]
        self.numbers, first, own = np.unique(cells, return_index=True, return_inverse=True)
        self.cell = own[self.tile]  # of a row, the place of its cell in the numbers
        centers = centers[self.numbers] if centers is not None else np.array([tiles.column("center")[int(i)].as_py() for i in first], float)
        self.coded = centers[self.cell]  # the vectors as their codes have them
        for p, w in enumerate(words):
            self.coded[:, edges[p]:edges[p + 1]] += w[codes[:, p]]

    def best(self, asked: pa.Table, rerank: int | None) -> pa.Table:
        """Each question's k best rows, or with ``rerank`` as many by coded score alone."""
        asked = asked.combine_chunks()
        n, k = asked.num_rows, asked.column("k").to_numpy()
        q = asked.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        eff = np.array([-1 if e is None else self.names.get(e, -2) for e in asked.column("eff").to_pylist()])
        cells, probes = asked.column("cells").combine_chunks(), None
        if not cells.null_count:
            probes = np.zeros((n, len(self.numbers)), bool)
            mine = cells.flatten().to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(self.numbers, mine), len(self.numbers) - 1)
            row, there = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy())), self.numbers[place] == mine
            probes[row[there], place[there]] = True
        whole = probes is None or 2 * probes.sum() >= probes.size  # else cell after cell, with the questions that probe it
        edges = np.searchsorted(self.cell, np.arange(len(self.numbers) + 1))
        groups = [(0, len(self.ids), np.arange(n))] if whole else [(edges[c], edges[c + 1], np.flatnonzero(probes[:, c])) for c in range(len(self.numbers))]
        bar = np.full(n, -np.inf)  # a score that k rows of a question reach
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
        for lo, hi, rows in groups:
            for some in (rows[a:a + SCORE_ROWS] for a in range(0, len(rows), SCORE_ROWS)):
                mask = (eff[some, None] == -1) | (eff[some, None] == self.label[lo:hi])
                if whole and probes is not None:
                    mask &= probes[some][:, self.cell[lo:hi]]
                if mask.any():
                    found.append(self._scored(q[some], k[some], mask, lo, hi, bar, some, rerank))
        row, at, score, coded = (np.concatenate(c) for c in zip(*found, strict=True))
        distance = np.floor((1.0 - score) * 1e6 + 0.5) / 1e6 + 0.0
        wanted = k if rerank is None else np.maximum(k, rerank)
        order = np.lexsort((self.ids[at], distance, row) if rerank is None else (self.at[at], self.tile[at], -coded, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < wanted[row]]
        at, row = at[order], np.concatenate([r for r, *_ in found])[order]
        return pa.Table.from_arrays(
            [asked.column("q_id").take(pa.array(row)), asked.column("k").take(pa.array(row)), pa.array(self.ids[at]), self.labels.take(pa.array(self.tile[at])),
             pa.array(distance[order]), pa.array(self.numbers[self.cell[at]], pa.int32()), pa.array(coded[order]),
             self.tiles.take(pa.array(self.tile[at])) if rerank is not None else pa.nulls(len(at), pa.string()), pa.array(self.at[at], pa.int32())], schema=_NO_HITS)

    def _scored(self, q: np.ndarray, k: np.ndarray, mask: np.ndarray, lo: int, hi: int, bar: np.ndarray, some: np.ndarray, rerank: int | None) -> tuple[np.ndarray, ...]:
        """Questions, rows, scores and coded scores of what may be among the best."""
        coded = q @ self.coded[lo:hi].T
        coded[~mask] = -np.inf
        if rerank is not None:
            wanted = np.minimum(np.maximum(k, rerank), coded.shape[1])
            floor = -np.partition(-coded, np.unique(wanted - 1), axis=1)[np.arange(len(k)), wanted - 1]
            keep = mask & (coded >= floor[:, None])
            columns = np.flatnonzero(keep.any(axis=0))
            r, c = np.nonzero(keep[:, columns])
        else:
            floor = np.maximum(_kth_at_least(coded - self.errors[lo:hi], k), bar[some])
            keep = coded + (self.errors[lo:hi] + SLACK) >= floor[:, None]
            keep &= mask
            columns = np.flatnonzero(keep.any(axis=0))
        if not len(columns):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
        if rerank is None and 2 * len(columns) > hi - lo:
            columns = np.arange(hi - lo)
        x = self.x[lo:hi] if len(columns) == hi - lo else self.x[lo:hi][columns]
        score = q @ x.T
        if rerank is None:
            score[~(keep if len(columns) == hi - lo else keep[:, columns])] = -np.inf
            bar[some] = np.maximum(bar[some], _kth_at_least(score, k))
            r, c = np.nonzero((score >= bar[some, None] - SLACK) & np.isfinite(score))
        return some[r], columns[c] + lo, score[r, c], coded[r, columns[c]]


# ---- how many cells ----------------------------------------------------------------------

def measured_probes(index: CellIndex, rows: DataFrame, k: int = 5, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """The fewest nearest cells that hold ``recall`` of the k nearest rows of a sample of rows, not counting the row itself."""
    if not len(index.model.centers):
        return 0
    drawn = rows.orderBy(F.xxhash64("row_id", F.lit(11)), "row_id").limit(sample).select(F.col("row_id").alias("q_id"), F.col("vec").alias("q_vec")).checkpoint(eager=True)
    n_cells = len(index.model.centers)
    hits = _hits(drawn, index, k + 1, None, None, n_cells, None).filter("row_id <> q_id")
    places = assign(drawn.select("q_id", F.col("q_vec").alias("vec")), index.model, n_cells).select("q_id", "cell", "place")
    by_place = {r.place: r.n for r in hits.join(places, ["q_id", "cell"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, held = sum(by_place.values()), 0
    for place in sorted(by_place):
        held += by_place[place]
        if held >= recall * total:
            return place + 1
    return n_cells


def unpacked(cells: DataFrame) -> DataFrame:
    """The rows (row_id, label, vec) of tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                x = np.frombuffer(batch.column("matrix")[i].as_py(), "<f8")
                width = len(x) // len(ids)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, width), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([batch.column("label")[i].as_py()] * len(ids), pa.string()), vectors],
                                                 ["row_id", "label", "vec"])

    return cells.select("label", "ids", "matrix").mapInArrow(run, "row_id long, label string, vec array<double>")


def recall_at_k(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits (q_id, row_id) that a search has found."""
    both = exact.select("q_id", "row_id").join(found.select("q_id", "row_id", F.lit(1).alias("hit")), ["q_id", "row_id"], "left")
    x = both.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).first()
    return x.hits / x.n if x.n else 1.0
