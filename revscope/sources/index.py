"""Folders of an approximate index: build, append, compact, open, clean (IDX1, IDX2, SNK5, SRC9).

A version names a model (centres, code words, encoder), and chunks of rows and
cells. Chunks are written once and never changed; a version is published as
``sources.commits`` does, so a reader sees one whole version whatever goes on,
and a build that dies leaves the last one. Appended rows are put into the cells
of the model that is there; ``compact`` joins the chunks of all appends, and
``rebuild`` learns the cells anew.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from revscope.operators import cells, dataset, encoders, profile
from revscope.operators.cells import CellIndex, CellModel
from revscope.sources import commits
from revscope.sources.commits import Version

#: Appends that lose a race start again from the newer version so often.
ATTEMPTS = 10


def _write_model(spark: SparkSession, base: str, model: CellModel, encoder) -> str:
    folder = commits.new_folder("model")
    path = os.path.join(base, folder)
    vectors = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    centers = pa.table({"cell": pa.array(np.arange(len(model.centers)), pa.int32()), "center": vectors(model.centers)})
    spark.createDataFrame(centers).write.parquet(os.path.join(path, "centers"))
    words = [(p, i, w) for p, piece in enumerate(model.words) for i, w in enumerate(piece)]
    table = pa.table({"piece": pa.array([x[0] for x in words], pa.int32()), "word": pa.array([x[1] for x in words], pa.int32()), "vec": vectors([x[2] for x in words])})
    spark.createDataFrame(table).write.parquet(os.path.join(path, "words"))
    if encoder is not None:
        encoders.save(spark, encoder, os.path.join(path, "encoder"))
    return folder


def _read_model(spark: SparkSession, path: str) -> CellModel:
    """The model fits the driver: as many centres as the square root of the rows."""
    centers = spark.read.parquet(os.path.join(path, "centers")).orderBy("cell").select("center").toArrow()
    if not centers.num_rows:
        return CellModel(np.zeros((0, 0)))
    words: dict[int, list] = {}
    for r in spark.read.parquet(os.path.join(path, "words")).orderBy("piece", "word").collect():
        words.setdefault(r.piece, []).append(r.vec)
    return CellModel(np.array(centers.column(0).to_pylist(), float), [np.array(words[p], float) for p in sorted(words)])


def _write_chunk(spark: SparkSession, base: str, rows: DataFrame, model: CellModel) -> tuple[str, str]:
    """Rows (row_id, label, vec, payload) as new folders of rows and of cells."""
    rows_folder, cells_folder = commits.new_folder("rows"), commits.new_folder("cells")
    rows.drop("vec").write.parquet(os.path.join(base, rows_folder))
    tiles = cells.encode_cells(rows, model, chunk=cells_folder[-32:])
    tiles.repartition("cell").write.partitionBy("cell").parquet(os.path.join(base, cells_folder))
    return rows_folder, cells_folder


def rebuild(corpus: DataFrame, base: str, *, encoder=None, vec_col: str = "embedding", label_col: str = "label", id_col: str = "row_id",
            payload: tuple[str, ...] = (), n_cells: int | None = None, k: int = 5, recall: float = cells.RECALL, meta: dict | None = None) -> Version:
    """Learn cells from a corpus with vectors and publish an index of it alone. Rows without a usable vector are left out."""
    spark = corpus.sparkSession
    last = commits.latest(spark, base)
    rows = cells.unit_rows(corpus, vec_col, label_col, id_col, payload).checkpoint(eager=True)
    model = cells.fit_cells(rows, n_cells)
    rows_folder, cells_folder = _write_chunk(spark, base, rows, model)
    parts = {"model": [_write_model(spark, base, model, encoder)], "rows": [rows_folder], "cells": [cells_folder]}
    schema = rows.drop("vec").schema.jsonValue()
    tiles = _cells(spark, base, parts["cells"])
    measured = cells.measured_probes(CellIndex(rows, tiles, model), rows, k, recall)
    record = {"vector_store": "cells", **(meta or {}), "size": rows.count(), "cells": len(model.centers), "probes": measured,
              "measured_recall": recall, "encoder": encoders.kind(encoder), "schema": schema}
    return commits.publish(spark, base, parts, record, last.number if last else 0)


def append(corpus: DataFrame, base: str, *, vec_col: str = "embedding", label_col: str = "label", id_col: str = "row_id") -> Version:
    """Add a chunk of rows to the last version's cells; the row ids must be new ones."""
    spark = corpus.sparkSession
    for _ in range(ATTEMPTS):
        last = _last(spark, base)
        schema = T.StructType.fromJson(last.meta["schema"])
        payload = tuple(c for c in schema.names if c not in ("row_id", "label"))
        rows = cells.unit_rows(corpus, vec_col, label_col, id_col, payload).checkpoint(eager=True)
        model = _read_model(spark, os.path.join(base, last.parts["model"][0]))
        n = rows.count()
        if n and not len(model.centers):
            raise ValueError("an index that was built of no rows has no cells: rebuild it")
        rows_folder, cells_folder = _write_chunk(spark, base, rows, model)
        parts = {**last.parts, "rows": [*last.parts["rows"], rows_folder], "cells": [*last.parts["cells"], cells_folder]}
        try:
            return commits.publish(spark, base, parts, {**last.meta, "size": last.meta["size"] + n}, last.number)
        except commits.Conflict:
            continue
    raise commits.Conflict(f"other writers were first {ATTEMPTS} times at {base}")


def compact(spark: SparkSession, base: str) -> Version:
    """One chunk of all: as many rows, full tiles, the same cells."""
    last = _last(spark, base)
    model = _read_model(spark, os.path.join(base, last.parts["model"][0]))
    vectors = cells.unpacked(_cells(spark, base, last.parts["cells"])).select("row_id", "vec")
    rows = _rows(spark, base, last).join(vectors, "row_id")
    rows_folder, cells_folder = _write_chunk(spark, base, rows.select("row_id", "label", "vec", *[c for c in rows.columns if c not in ("row_id", "label", "vec")]), model)
    return commits.publish(spark, base, {**last.parts, "rows": [rows_folder], "cells": [cells_folder]}, last.meta, last.number)


def open_index(spark: SparkSession, base: str, encoder=None, number: int | None = None) -> CellIndex:
    """SRC9: the last version (or that of a number), with its stored encoder or the caller's."""
    v = commits.version(spark, base, number) if number else _last(spark, base)
    path = os.path.join(base, v.parts["model"][0])
    if encoder is None and v.meta.get("encoder") in encoders.STORED:
        encoder = encoders.load(spark, v.meta["encoder"], os.path.join(path, "encoder"))
    missing = [f for folders in v.parts.values() for f in folders if not commits.names(spark, os.path.join(base, f))]
    if missing:
        raise FileNotFoundError(f"the index at {base} lacks {', '.join(missing)}")
    return CellIndex(_rows(spark, base, v), _cells(spark, base, v.parts["cells"]), _read_model(spark, path), {**v.meta, "version": v.number}, encoder)


def clean(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    return commits.clean(spark, base, keep)


def _last(spark: SparkSession, base: str) -> Version:
    v = commits.latest(spark, base)
    if v is None:
        raise FileNotFoundError(f"no index at {base}: no version has been published")
    return v


def _rows(spark: SparkSession, base: str, v: Version) -> DataFrame:
    schema = T.StructType.fromJson(v.meta["schema"])
    return spark.read.schema(schema).parquet(*[os.path.join(base, f) for f in v.parts["rows"]]).select(*schema.names)


def _cells(spark: SparkSession, base: str, folders: list[str]) -> DataFrame:
    read = spark.read.schema(cells.CELL_SCHEMA).option("basePath", os.path.join(base, "cells"))
    return read.parquet(*[os.path.join(base, f) for f in folders]).drop("chunk")


def build_review_index(reviews: DataFrame, base: str, *, encoder=None, sample_size: int | None = None, batch_size: int = 64,
                       collection: str = "reviews", n_cells: int | None = None) -> Version:
    """The whole index job: sample each split, clean, number the records, embed them, rebuild the index with its metadata.

    ``reviews``: id, text, label, split. ``encoder``: as ``operators.encoders``
    has them, or None to learn a semantic one from the texts.
    """
    sampled = profile.sample_per_split(reviews, sample_size)
    records = dataset.corpus_records(dataset.global_row_ids(sampled), keep=("row_id",)).checkpoint(eager=True)
    encoder = encoder if encoder is not None else encoders.fit_lsa(records)
    embedded = encoders.encode(records, encoder, batch_size=batch_size)
    return rebuild(embedded, base, encoder=encoder, payload=("text", "label_id", "split"), n_cells=n_cells,
                   meta={"collection_name": collection, "embedding_model": encoders.kind(encoder), "sample_size": sample_size, "batch_size": batch_size})
