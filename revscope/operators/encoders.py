"""Text encoders of an index: hashed words, latent semantics, or the caller's own (IDX1).

``LsaEncoder`` is a truncated singular value decomposition of the TF-IDF table,
found by randomised subspace iteration: rows stay where they are, every pass
multiplies them by a thin matrix (terms x length) and adds up the transposed
product in blocks of terms, so what moves is as large as the vocabulary, which
``max_features`` bounds, whatever the number of rows. A text's vector is its
TF-IDF row times the basis, at unit length. Encoding is one row-wise pass, so it
works on streams, too.

``CallerEncoder`` wraps a function from texts to vectors that is loaded once in
a worker and fed batches.

Defined cases: null counts as empty; a text without a known term has the zero
vector; rows need no ids and stay apart; an empty table gives an encoder without
terms. An encoder of fewer terms than ``dim`` has zeros in the last components.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revscope.operators import features as fe
from revscope.operators import retrieval
from revscope.operators.retrieval import TextEncoder

#: Kinds that an index can store with itself.
STORED = ("hashed", "lsa")
#: Terms whose rows of the thin matrix are added up together.
BLOCK = 512
LSA_SPEC = fe.TermSpec(ngram_max=1)


@dataclass
class LsaEncoder:
    """Terms with their idf, the basis (terms x dim) and the singular values."""

    spec: fe.TermSpec
    terms: list[str]
    idf: np.ndarray
    basis: np.ndarray
    singular: np.ndarray


@dataclass
class CallerEncoder:
    """``load()`` returns a function from a list of texts to a list of vectors of ``dim`` numbers."""

    load: Callable[[], Callable[[list[str]], list]]
    dim: int
    name: str = "caller"
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def kind(encoder) -> str:
    if encoder is None:
        return "precomputed"
    return {TextEncoder: "hashed", LsaEncoder: "lsa"}.get(type(encoder)) or encoder.name


# ---- latent semantics ----------------------------------------------------------------------

def tfidf_rows(docs: DataFrame, spec: fe.TermSpec, terms: list[str], idf: np.ndarray, text_col: str = "text") -> DataFrame:
    """Each text as its unit TF-IDF row: terms (numbers) and weights."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = pa.array(shared.value[0], pa.string()), shared.value[1]
        for batch in batches:
            row, term, w = fe.unit_rows(batch.column(0), vocabulary, idf, spec.sublinear_tf)
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, pa.array(term, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(w))], ["terms", "weights"])

    return fe.term_lists(docs, spec, text_col, "_terms").select("_terms").mapInArrow(run, "terms array<int>, weights array<double>")


def _gram_times(rows: DataFrame, thin: np.ndarray) -> np.ndarray:
    """A'A times a thin matrix, A being the table of TF-IDF rows."""
    shared = rows.sparkSession.sparkContext.broadcast(thin)
    width = thin.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thin = shared.value
        total = np.zeros_like(thin)
        for batch in batches:
            for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False))
                term, w = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "weights"))
                y = np.zeros((part.num_rows, width))
                np.add.at(y, row, w[:, None] * thin[term])
                np.add.at(total, term, w[:, None] * y[row])
        for lo in range(0, len(total), BLOCK):
            if total[lo:lo + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // BLOCK], pa.int32()), pa.array([total[lo:lo + BLOCK].tobytes()], pa.binary())], ["block", "sum"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("sum").to_pylist(), strict=True):
                totals[block] = totals.get(block, 0) + np.frombuffer(data).reshape(-1, width)
        for block, x in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "sum"])

    schema = "block int, sum binary"
    out = np.zeros_like(thin)
    for r in rows.mapInArrow(products, schema).repartition("block").mapInArrow(added, schema).collect():  # as large as the thin matrix
        out[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r["sum"]).reshape(-1, width)
    return out


def fit_lsa(docs: DataFrame, text_col: str = "text", dim: int = 64, spec: fe.TermSpec = LSA_SPEC, extra: int = 8, rounds: int = 4, seed: int = 7) -> LsaEncoder:
    """Learn the ``dim`` leading directions of the TF-IDF table of all documents."""
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("text")).checkpoint(eager=True)
    tf = fe.term_counts(fe.by_document(numbered, "_row"), spec, "_row", "text")
    vocab = fe.fit_vocabulary(tf, numbered.count(), spec, "_row").select("index", "term", "idf").orderBy("index").toArrow()  # max_features rows
    terms, idf = vocab.column("term").to_pylist(), vocab.column("idf").to_numpy()
    if not terms:
        return LsaEncoder(spec, [], np.zeros(0), np.zeros((0, dim)), np.zeros(dim))
    rows = tfidf_rows(numbered, spec, terms, idf).checkpoint(eager=True)
    thin = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), min(dim + extra, len(terms)))))[0]
    for _ in range(rounds):
        thin = np.linalg.qr(_gram_times(rows, thin))[0]
    values, turn = np.linalg.eigh(thin.T @ _gram_times(rows, thin))
    values, turn = values[::-1][:dim], turn[:, ::-1][:, :dim]
    basis = thin @ turn
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)  # the sign is free: fix it
    short = dim - basis.shape[1]
    return LsaEncoder(spec, terms, idf, np.pad(basis, ((0, 0), (0, short))), np.pad(np.sqrt(np.maximum(values, 0)), (0, short)))


def _encode_lsa(docs: DataFrame, encoder: LsaEncoder, text_col: str, out_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((encoder.terms, encoder.idf, encoder.basis))
    spec, dim = encoder.spec, encoder.basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, basis = shared.value
        vocabulary = pa.array(terms, pa.string())
        for batch in batches:
            for part in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
                row, term, w = fe.unit_rows(part.column(part.num_columns - 1), vocabulary, idf, spec.sublinear_tf)
                x = np.zeros((part.num_rows, dim))
                for a in range(0, len(row), 1 << 16):
                    np.add.at(x, row[a:a + (1 << 16)], w[a:a + (1 << 16), None] * basis[term[a:a + (1 << 16)]])
                yield _with_vectors(part.select(part.schema.names[:-1]), _unit(x), out_col)

    lists = fe.term_lists(docs, spec, text_col, "_terms")
    return lists.mapInArrow(run, _with_field(docs, out_col))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)


def _with_field(docs: DataFrame, out_col: str) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])


def _with_vectors(batch: pa.RecordBatch, x: np.ndarray, out_col: str) -> pa.RecordBatch:
    edges = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(edges, pa.array(x.ravel()))], [*batch.schema.names, out_col])


# ---- the caller's encoder ------------------------------------------------------------------

_LOADED: dict[str, Callable[[list[str]], list]] = {}


def _encode_caller(docs: DataFrame, encoder: CallerEncoder, text_col: str, out_col: str, batch_size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if encoder.key not in _LOADED:
            _LOADED[encoder.key] = encoder.load()
        for batch in batches:
            for part in (batch.slice(a, batch_size) for a in range(0, batch.num_rows, batch_size)):
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                x = np.asarray(_LOADED[encoder.key](texts), float)
                if x.shape != (len(texts), encoder.dim):
                    raise ValueError(f"the encoder returned vectors of shape {x.shape} for {len(texts)} texts of {encoder.dim} numbers each")
                yield _with_vectors(part.select(part.schema.names[:-1]), _unit(x), out_col)

    return docs.withColumn("_text", F.col(text_col)).mapInArrow(run, _with_field(docs, out_col))


def encode(docs: DataFrame, encoder, text_col: str = "text", out_col: str = "embedding", batch_size: int = 64) -> DataFrame:
    """IDX1: the documents with their vector at unit length (zero for texts the encoder knows nothing of)."""
    if isinstance(encoder, LsaEncoder):
        return _encode_lsa(docs, encoder, text_col, out_col)
    if isinstance(encoder, CallerEncoder):
        return _encode_caller(docs, encoder, text_col, out_col, max(1, batch_size))
    return retrieval.encode(docs, encoder, text_col, out_col)


# ---- stored beside an index ----------------------------------------------------------------

def save(spark: SparkSession, encoder, path: str) -> None:
    from revscope.sources import io

    if isinstance(encoder, LsaEncoder):
        table = pa.table({"number": pa.array(np.arange(len(encoder.terms)), pa.int64()), "term": pa.array(encoder.terms, pa.string()),
                          "idf": pa.array(encoder.idf, pa.float64()), "basis": pa.array(list(encoder.basis), pa.list_(pa.float64()))})
        spark.createDataFrame(table).write.parquet(os.path.join(path, "terms"))
        io.write_small_json(spark, {"spec": asdict(encoder.spec), "singular": encoder.singular.tolist()}, os.path.join(path, "meta"))
    elif isinstance(encoder, TextEncoder):
        io.write_small_json(spark, asdict(encoder), os.path.join(path, "meta"))


def load(spark: SparkSession, kind: str, path: str):
    from revscope.sources import io

    meta = io.read_small_json(spark, os.path.join(path, "meta"))
    if kind == "hashed":
        return TextEncoder(**meta)
    rows = spark.read.schema("number long, term string, idf double, basis array<double>").parquet(os.path.join(path, "terms")).orderBy("number").toArrow()
    singular = np.array(meta["singular"])
    basis = np.array(rows.column("basis").to_pylist(), float).reshape(rows.num_rows, len(singular))
    spec = fe.TermSpec(**{**meta["spec"], "stop_words": tuple(meta["spec"]["stop_words"])})
    return LsaEncoder(spec, rows.column("term").to_pylist(), rows.column("idf").to_numpy(), basis, singular)
